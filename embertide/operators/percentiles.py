"""Percentiles: sketches for speed, and an exact form without large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions.instants import instant, time_bucket
from embertide.operators.ordered import TARGET_ROWS, null_safe
from embertide.session import checked_broadcast, cut

GRID = 1000
ACCURACY = 20 * GRID


def _label(prob: float) -> str:
    return f"p{prob * 100:g}".replace(".", "_")


def approximate(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]):
    """Mergeable sketches: one pass, partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, p, ACCURACY).alias(_label(p)) for p in probs]
    )


SKETCH_K = 800  # of a KLL sketch: rank error below 0.5 %


def rollup(df: DataFrame, keys: Sequence[str], value: str, ts: str, width: str, k: int = SKETCH_K) -> DataFrame:
    """One KLL sketch and count per key and time bucket, to be stored; null values are left out.

    Buckets of any window merge into its quantiles, so the rows are read once for all windows.
    """
    bucket = time_bucket(width, F.col(ts), isinstance(df.schema[ts].dataType, T.TimestampNTZType))
    rows = df.where(F.col(value).isNotNull()).select(*keys, bucket.alias("bucket"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy(*keys, "bucket").agg(
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def from_rollup(
    rolled: DataFrame, keys: Sequence[str], probs: Sequence[float], start=None, end=None,
) -> DataFrame:
    """Quantiles per key over the buckets that begin in [start, end); all of them without bounds."""
    if start is not None:
        rolled = rolled.where(F.col("bucket") >= instant(start))
    if end is not None:
        rolled = rolled.where(F.col("bucket") < instant(end))
    merged = rolled.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[
        F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(_label(p)) for p in probs])


def exact(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Interpolated percentiles per group.

    Groups are counted first. Up to ``target_rows`` the built-in aggregate is
    used. Above it, sketches bracket every wanted rank and only rows inside the
    bracket go on (about 5 / GRID of them), until what is left per rank is
    small; rows below a bracket are merely counted.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= target_rows:
        return rows.groupBy(*keys).agg(
            *[F.percentile("_v", float(p)).alias(_label(p)) for p in probs]
        )
    band, wanted = _first_bracket(rows, keys, probs)
    group = [*keys, "_p"]
    while True:
        left = band.groupBy(*group).count().agg(F.max("count")).first()[0]
        if left <= target_rows or left >= largest:
            return _pick(band, wanted, keys, group, probs)
        largest = left
        band, wanted = _narrow(band, wanted, group)


def _cuts():
    """Sketch of the numbers; NaN sorts above all of them and is only counted."""
    grid = ", ".join(str(i / GRID) + "D" for i in range(GRID + 1))
    return F.expr(f"percentile_approx(nullif(_v, double('NaN')), array({grid}), {ACCURACY})").alias("_cuts")


def _numbers():
    return F.count_if(~F.isnan("_v"))


def _bracket(sized: DataFrame) -> DataFrame:
    """Value range sure to hold the wanted rank: two grid steps and two rows to each side.

    ``_n`` counts numbers; ranks beyond them are NaN, which an open upper end includes.
    """
    step = F.col("_rank") / F.greatest(F.col("_n") - 1, F.lit(1)) * GRID
    margin = 2 + F.lit(2.0 * GRID) / F.greatest(F.col("_n"), F.lit(1))
    low = F.least(F.greatest(F.floor(step - margin), F.lit(0)), F.lit(GRID)).cast("int")
    high = F.least(F.ceil(step + margin), F.lit(GRID)).cast("int")
    least = F.lit(float("-inf"))
    return sized.withColumns({
        "_lo": F.when(low == 0, least).otherwise(F.coalesce(F.get("_cuts", low), least)),
        "_hi": F.when(high == GRID, F.lit(float("nan"))).otherwise(F.get("_cuts", high)),
    }).drop("_cuts", "_n")


def _first_bracket(rows: DataFrame, keys: list[str], probs: Sequence[float]):
    """Rows near each wanted rank as (keys, _p, _v), and the ranks within them."""
    totals = rows.groupBy(*keys).agg(_numbers().alias("_n"), F.count(F.lit(1)).alias("_all"), _cuts())
    wanted = totals.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p"))
    wanted = cut(_bracket(wanted.withColumn("_rank", F.col("_p") * (F.col("_all") - 1)).drop("_all")))
    # Each row meets the few ranges of its group as columns, not as joined rows.
    ranges = wanted.groupBy(*keys).pivot("_p", [float(p) for p in probs]).agg(
        F.struct(F.first("_lo").alias("lo"), F.first("_hi").alias("hi"), F.first("_rank").alias("rank"))
    ).toDF(*keys, *[f"_r{i}" for i in range(len(probs))])
    ranged = null_safe(rows, checked_broadcast(ranges), keys, "inner")
    below = ranged.groupBy(*keys).agg(*[
        F.struct(
            F.lit(float(p)).alias("_p"),
            (F.first(f"_r{i}.rank") - F.count_if(F.col("_v") < F.col(f"_r{i}.lo"))).alias("_rank"),
        ).alias(f"_o{i}")
        for i, p in enumerate(probs)
    ])
    moved = below.select(
        *keys, F.inline(F.array(*[F.col(f"_o{i}") for i in range(len(probs))]))
    )
    hits = F.array(*[
        F.when(F.col("_v").between(F.col(f"_r{i}.lo"), F.col(f"_r{i}.hi")), F.lit(float(p)))
        for i, p in enumerate(probs)
    ])
    band = ranged.select(*keys, "_v", F.explode(F.array_compact(hits)).alias("_p"))
    return band, cut(moved)


def _narrow(band: DataFrame, wanted: DataFrame, group: list[str]):
    sized = band.groupBy(*group).agg(_numbers().alias("_n"), _cuts())
    bracket = cut(_bracket(null_safe(wanted, sized, group, "inner")))
    ranged = null_safe(band, checked_broadcast(bracket), group, "inner")
    moved = ranged.groupBy(*group).agg(
        (F.first("_rank") - F.count_if(F.col("_v") < F.col("_lo"))).alias("_rank")
    )
    inside = ranged.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*group, "_v")
    return inside, cut(moved)


def _pick(band, wanted, keys, group, probs):
    """Read the two neighbours of each rank from cumulative counts of equal values."""
    counted = band.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))
    placed = null_safe(counted.withColumn("_upto", upto), wanted, group, "inner")
    low, high = F.floor("_rank"), F.ceil("_rank")

    def at(rank):
        holds = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(holds, F.col("_v")))

    picked = placed.groupBy(*group).agg(
        at(low).alias("_lv"), at(high).alias("_hv"), F.max(F.col("_rank") - low).alias("_f")
    ).withColumn("_value", F.col("_lv") + (F.col("_hv") - F.col("_lv")) * F.col("_f"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == float(p), F.col("_value"))).alias(_label(p)) for p in probs]
    )
