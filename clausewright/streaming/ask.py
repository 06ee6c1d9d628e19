"""Questions as a stream: class and risk of each, late repeats dropped, counts per window, and a search against a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright.functions import text as X
from clausewright.operators import index


def tagged(questions: DataFrame) -> DataFrame:
    """Stateless tags of a stream (or table) with a ``query`` column."""
    q = F.col("query")
    return questions.withColumns({"query_type": X.query_class(q), "risk_level": X.query_risk(q), "matched_markers": X.risk_markers(q)})


def once(questions: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The stream without entries delivered again within the watermark."""
    return questions.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def per_window(questions: DataFrame, time: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Questions per class, risk and window of event time; entries later than the watermark are dropped."""
    grouped = tagged(questions.withWatermark(time, late)).groupBy(F.window(time, size), "query_type", "risk_level")
    return grouped.agg(F.count(F.lit(1)).alias("questions"))


def answered(questions: DataFrame, postings: DataFrame, idf: DataFrame, key: str, folder: str, checkpoint: str, top: int = 5) -> StreamingQuery:
    """Searches each micro-batch against the index and appends its hits as parquet."""

    def batch(df: DataFrame, _: int) -> None:
        index.search(df, postings, idf, key, top=top).write.mode("append").parquet(folder)

    return questions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
