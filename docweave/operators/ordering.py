"""Row numbers and bounded lists that survive a key holding most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    out: str,
) -> DataFrame:
    """1-based row number per key, computed in buckets of the leading order column.

    ``bucket`` must not decrease along ``order``. Only rows of one (key, bucket)
    meet in a task; the offsets come from a partially aggregated count per bucket,
    so a hot key is spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_bucket").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    match.append(F.col("_bucket").eqNullSafe(F.col("_b")))
    numbered = rows.withColumn("_rn", F.row_number().over(local))
    joined = numbered.join(offsets, match)
    return joined.withColumn(out, (F.col("_rn") + F.col("_offset")).cast("int")).drop(
        "_rn", "_offset", "_bucket", "_b", *[f"_k{i}" for i in range(len(keys))]
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, out: str = "_rank"
) -> DataFrame:
    """The first ``limit`` rows per key; Spark prunes per task before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= limit)


def bounded_list(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    fields: Sequence[str],
    limit: int,
    out: str,
) -> DataFrame:
    """Per key, an ordered array of at most ``limit`` structs of ``fields``."""
    kept = first_rows(df, keys, order, limit)
    items = F.collect_list(F.struct("_rank", F.struct(*fields).alias("item")))
    return kept.groupBy(*keys).agg(
        F.transform(F.sort_array(items), lambda x: x["item"]).alias(out)
    )


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct non-null values per key: partial distinct, then partial count."""
    return (
        df.where(F.col(value).isNotNull())
        .select(*keys, value)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(out))
    )


def stack_counters(parts: Sequence[DataFrame], group: Sequence[str] = ()) -> DataFrame:
    """Counters computed in separate frames, side by side in one row per group.

    Each part has the group columns and its own counters; missing counters become 0.
    The parts are already aggregated, so this is a union of short frames.
    """
    names = [c for part in parts for c in part.columns if c not in group]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*group).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in dict.fromkeys(names)]
    )
