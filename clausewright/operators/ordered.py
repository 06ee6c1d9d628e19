"""Order-sensitive operators that don't need one task per group.

A plain window over a source id puts a source with a third of all rows into one
task. Here each group is cut into buckets along its order; windows run within
buckets, one summary row per bucket is scanned along the group, and its result
is carried into the buckets. The rows feed both the windows and the summary, so
each step cuts its lineage in the shared folder; otherwise work and plan would
double from step to step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.plans.lineage import cut

BUCKET = 4096


def bucketed(df: DataFrame, group: list[str], order: list[str], size: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, ascending along the order of each group, of about ``size`` rows each.

    Buckets are the ranges of a range partitioning by group and order, so they
    follow ranks: neither sparse nor dense positions make them small or large,
    and rows with equal places stay together.
    """
    n = max(1, -(-df.count() // (size or BUCKET)))
    return cut(df.repartitionByRange(n, *group, *order).withColumn("_bucket", F.spark_partition_id()))


def _local(group: list[str], order: list[str]):
    return Window.partitionBy(*group, "_bucket").orderBy(*order)


def _along(group: list[str]):
    return Window.partitionBy(*group).orderBy("_bucket")


def _carry(df: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    on = [df[g].eqNullSafe(summary[g]) for g in group] + [df["_bucket"].eqNullSafe(summary["_bucket"])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(summary, cond, "left").drop(*[summary[c] for c in [*group, "_bucket"]])


def neighbour(df: DataFrame, group: list[str], order: list[str], value: str, out: str, step: int) -> DataFrame:
    """``out``: the value of the next (step 1) or previous (step -1) row of the group, null at its end."""
    df, w = cut(df), _local(group, order)
    edge = F.min_by if step > 0 else F.max_by
    ends = df.groupBy(*group, "_bucket").agg(edge(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_e"))
    shift = F.lead("_e.v") if step > 0 else F.lag("_e.v")
    summary = ends.withColumn("_n", shift.over(_along(group))).drop("_e")
    here = df.withColumn("_i", F.row_number().over(w)).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*group, "_bucket")))
    here = here.withColumn("_l", (F.lead(value) if step > 0 else F.lag(value)).over(w))
    at_edge = F.col("_i") == (F.col("_c") if step > 0 else F.lit(1))
    return _carry(here, summary, group).withColumn(out, F.when(at_edge, F.col("_n")).otherwise(F.col("_l"))).drop("_i", "_c", "_l", "_n")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the group up to and including the row."""
    here = cut(df.withColumn("_v", value))
    sums = here.groupBy(*group, "_bucket").agg(F.sum("_v").alias("_s"))
    summary = sums.withColumn("_before", F.coalesce(F.sum("_s").over(_along(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    local = F.sum("_v").over(_local(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return _carry(here, summary, group).withColumn(out, F.col("_before") + local).drop("_v", "_before")


def last_seen(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """For each name the last non-null value of its column up to and including the row."""
    here = cut(df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()]))
    pick = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.struct(*order))).alias(f"_s_{k}") for k in values]
    before = _along(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = here.groupBy(*group, "_bucket").agg(*pick)
    summary = sums.select(*group, "_bucket", *[F.last(f"_s_{k}", True).over(before).alias(f"_b_{k}") for k in values])
    local = _local(group, order).rowsBetween(Window.unboundedPreceding, 0)
    done = here.select("*", *[F.last(f"_v_{k}", True).over(local).alias(f"_l_{k}") for k in values])
    out = _carry(done, summary, group)
    for k in values:
        out = out.withColumn(k, F.coalesce(f"_l_{k}", f"_b_{k}"))
    return out.drop(*[f"{p}{k}" for k in values for p in ("_v_", "_l_", "_b_")])
