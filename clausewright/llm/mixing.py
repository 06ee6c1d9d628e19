"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. Source s is to give ``share * total``
tokens; no document may be repeated more than its source's cap, so the goal is
``min(share * total, cap * tokens of s)``. Entropy balancing chooses rates as
near to one as possible (least relative entropy) under these constraints: the
solution tilts each document exponentially by its size, ``min(cap,
exp(lambda_s * size / mean size))``, and Newton iterations on the convex dual
find the lambdas. Gradient and curvature are sums over a histogram of sizes
per source, computed by Spark; the driver holds one number per source.

Rates are rounded into copies by systematic rounding along the sizes, in
buckets of about 50,000 documents whose totals are prefix-summed, so that a hot
source needs no single task. Each document gets the rate rounded down or up, never above the cap.

Defined results: sources are compared in lower case with '_' for white space
and hyphens; documents without a source, of a source without a target, or
without tokens are not in the mix; a share that cannot be met is reported as capped.
"""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.plans.lineage import cut

_BUCKET = 50_000  # documents of one source that are prefix-summed in one task


def source_name(c: Column) -> Column:
    """The clean spelling of a source name."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text; null and '' have none."""

    @F.pandas_udf("long")
    def count(batches: pd.Series) -> pd.Series:
        # one text at a time: an encoding also holds offsets and words, many times the size of its text
        tok = _tokenizer(tokenizer)
        return pd.Series([len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for t in batches], dtype="int64")

    return count(text)


_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def sized(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents of a source with a target; targets are one row per source."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("_t"))
    wanted = rows.join(F.broadcast(targets.select("source")), "source").withColumn("tokens", token_count(F.col("_t"), tokenizer))
    return wanted.select("doc_id", "source", "tokens").where("tokens > 0")


def _tilt(lam: float, mean: float, cap: float) -> Column:
    z = F.lit(lam / mean) * F.col("tokens")
    return F.when(z >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(z))


def solve(histogram: DataFrame, goals: dict[str, tuple[float, float, float]], rounds: int = 40, close: float = 1e-6) -> dict[str, float]:
    """lambda of each source by Newton's method; goals: source -> (tokens wanted, mean size, cap).

    ``histogram`` is (source, tokens, n). One Spark aggregation per round
    serves all sources; a bracket keeps each step from leaving the solution.
    """
    lam = {s: 0.0 for s in goals}
    box = {s: [-60.0, 60.0] for s in goals}
    open_ = set(goals)
    for _ in range(rounds):
        if not open_:
            break
        rate = F.lit(None).cast("double")
        mean_of = F.lit(None).cast("double")
        capped = F.lit(False)
        for s in sorted(open_):
            _, mean, cap = goals[s]
            rate = F.when(F.col("source") == s, _tilt(lam[s], mean, cap)).otherwise(rate)
            mean_of = F.when(F.col("source") == s, F.lit(mean)).otherwise(mean_of)
            capped = F.when(F.col("source") == s, F.lit(lam[s] / mean) * F.col("tokens") >= math.log(cap)).otherwise(capped)
        sums = (
            histogram.where(F.col("source").isin(sorted(open_)))
            .select("source", "tokens", "n", rate.alias("w"), mean_of.alias("m"), capped.alias("c"))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("w") * F.col("tokens")).alias("got"),
                F.sum(F.when(~F.col("c"), F.col("n") * F.col("w") * F.col("tokens") * F.col("tokens") / F.col("m")).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for r in sums:
            want = goals[r["source"]][0]
            s, off = r["source"], r["got"] - want
            if abs(off) <= close * max(want, 1.0):
                open_.discard(s)
                continue
            box[s][0 if off < 0 else 1] = lam[s]
            step = lam[s] - off / r["slope"] if r["slope"] > 0 else math.nan
            lam[s] = step if box[s][0] < step < box[s][1] else sum(box[s]) / 2
    return lam


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, list[dict]]:
    """Documents with rate and copies, and one report row per target (targets are few and fixed).

    ``total`` is the wanted number of tokens, by default those of all sources together.
    """
    sizes = cut(sizes)
    histogram = cut(sizes.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: (r["t"], r["n"]) for r in histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    total = float(total if total is not None else sum(t for t, _ in have.values()))
    goals, report = {}, []
    for s, (share, cap) in sorted(wanted.items()):
        tokens, n = have.get(s, (0, 0))
        room = cap * tokens
        goal = float(min(share * total, room))
        report.append({"source": s, "target_share": share, "max_repeats": cap, "source_docs": n, "source_tokens": tokens, "goal_tokens": goal, "capped": room < share * total})
        if n and goal > 0:
            goals[s] = (goal, tokens / n, float(cap))
    full = {s for s, (goal, mean, cap) in goals.items() if goal >= cap * have[s][0] - 1e-9}
    lam = solve(histogram, {s: g for s, g in goals.items() if s not in full})
    rate, buckets = F.lit(0.0), F.lit(1)
    for s, (_, n) in have.items():
        buckets = F.when(F.col("source") == s, F.lit(-(-n // _BUCKET))).otherwise(buckets)
    for s, (_, mean, cap) in goals.items():
        rate = F.when(F.col("source") == s, F.lit(cap) if s in full else _tilt(lam[s], mean, cap)).otherwise(rate)
    rated = sizes.withColumn("rate", rate).withColumn("_b", F.pmod(F.xxhash64("doc_id"), buckets))
    ordered = Window.partitionBy("source", "_b").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = rated.groupBy("source", "_b").agg(F.sum("rate").alias("_s"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each 50,000 documents
    starts = sums.select("source", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_o"))
    run = rated.join(starts, ["source", "_b"]).withColumn("_c", F.col("_o") + F.sum("rate").over(ordered))
    copies = (F.floor(F.col("_c") + 0.5 + 1e-9) - F.floor(F.col("_c") - F.col("rate") + 0.5 + 1e-9)).cast("long")
    return run.select("doc_id", "source", "tokens", "rate", copies.alias("copies")), report


def shares(mixed: DataFrame, report: list[dict]) -> DataFrame:
    """Target and actual share per source, with sizes before and after."""
    spark = mixed.sparkSession
    base = spark.createDataFrame(report, "source string, target_share double, max_repeats int, source_docs long, source_tokens long, goal_tokens double, capped boolean")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    joined = base.join(F.broadcast(got), "source", "left").fillna(0, ["mixed_tokens", "copies", "most_repeats"])
    total = got.agg(F.sum("mixed_tokens").alias("_total"))
    return joined.join(F.broadcast(total)).withColumn("actual_share", F.when(F.col("_total") > 0, F.col("mixed_tokens") / F.col("_total")).otherwise(0.0)).drop("_total")
