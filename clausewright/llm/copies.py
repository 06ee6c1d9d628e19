"""Records that are copies but for dress: white space, case, punctuation, look-alikes, field order (problem 2).

Canonical records are range-partitioned and externally sorted by (key, row
id), then adjacent runs are scanned comparing full keys. Because the row id is
part of the range key, a key that holds a third of all rows is spread over as
many range partitions as its size asks for; the runs at the partition edges
(at most two per partition) are stitched afterwards.

Defined results: null and '' are the same empty field; a field of nothing but
white space and marks is empty too; rows with both fields empty are copies of
one another; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import canon
from clausewright.plans.lineage import cut

def field_key(text: str | None) -> str:
    """The consistent text without white space, case and punctuation; a mark between two digits stays."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    last = len(text) - 1
    return "".join(ch for i, ch in enumerate(text) if _kept(ch) or (0 < i < last and not ch.isspace() and text[i - 1].isdigit() and text[i + 1].isdigit()))


def _kept(ch: str) -> bool:
    """Letters, digits, accents and symbols; no white space, control or punctuation character."""
    return ch.isalnum() or (not ch.isascii() and unicodedata.category(ch)[0] in "MS")


@F.pandas_udf(T.StringType())
def record_key(a: pd.Series, b: pd.Series) -> pd.Series:
    """Order-free key of two fields."""
    return pd.Series(["\x1f".join(sorted((field_key(x), field_key(y)))) for x, y in zip(a, b)])


def keyed(rows: DataFrame, row_id: str, first: str, second: str) -> DataFrame:
    """(row_id, key): the canonical record of each row."""
    fields = [F.struct(F.lit(i).alias("side"), F.col(c).alias("value")) for i, c in enumerate((first, second))]
    long = rows.select(F.col(row_id).alias("row_id"), F.explode(F.array(*fields)).alias("f")).select("row_id", "f.side", "f.value")
    done = canon.canonical(long, ["row_id", "side"], "value")
    both = done.groupBy("row_id").agg(F.max(F.when(F.col("side") == 0, F.col("canon"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("canon"))).alias("b"))
    return both.select("row_id", record_key("a", "b").alias("key"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adjacent runs of one sorted partition: each row with the first row of its run.

    Runs pass through and are never held. Of the first and the last run, which
    may go on in a neighbour, an extra row without ``row_id`` names the key.
    """
    last_key, head, first_key = None, None, None
    for pdf in batches:
        if not len(pdf):
            continue
        keys, ids = pdf["key"].to_numpy(object), pdf["row_id"].to_numpy()
        starts = np.concatenate(([keys[0] != last_key], keys[1:] != keys[:-1]))
        at = np.flatnonzero(starts)
        heads = np.empty(len(keys), np.int64)
        heads[: at[0] if len(at) else len(keys)] = head if head is not None else 0
        for a, b in zip(at, [*at[1:], len(keys)]):
            heads[a:b] = ids[a]
        if first_key is None:
            first_key = keys[0]
            yield pd.DataFrame({"row_id": [None], "head": [ids[0]], "edge": [first_key]})
        last_key, head = keys[-1], int(heads[-1])
        yield pd.DataFrame({"row_id": ids, "head": heads, "edge": None})
    if last_key is not None and last_key != first_key:
        yield pd.DataFrame({"row_id": [None], "head": [head], "edge": [last_key]})


def members(rows: DataFrame, row_id: str, first: str, second: str, partitions: int | None = None) -> DataFrame:
    """(first_row_id, copy_row_id) for every row, the smallest row id of its group of copies first."""
    return stitched(keyed(rows, row_id, first, second), partitions)


def stitched(keys: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range partitioning, external sort and run scan over (row_id, key)."""
    by = [F.col("key"), F.col("row_id")]
    ranged = keys.repartitionByRange(partitions, *by) if partitions else keys.repartitionByRange(*by)
    scanned = cut(ranged.sortWithinPartitions(*by).mapInPandas(_scan, "row_id long, head long, edge string"))
    # at most two rows per partition name an edge; a run that spans partitions takes the smallest head
    ends = scanned.where("row_id is null").select("edge", "head").distinct()
    heads = ends.groupBy("edge").agg(F.min("head").alias("true_head"))
    local = ends.join(heads, "edge").where("head <> true_head").select("head", "true_head")
    joined = scanned.where("row_id is not null").join(F.broadcast(local), "head", "left")
    return joined.select(F.coalesce("true_head", "head").alias("first_row_id"), F.col("row_id").alias("copy_row_id"))


def collapsed(pairs: DataFrame) -> DataFrame:
    """(first_row_id, copies): one record per group with the number of rows it stands for."""
    return pairs.groupBy("first_row_id").agg(F.count("*").alias("copies"))
