"""Grouped summaries that are not tied to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.operators.series import exact_percentiles


def mono_fold(df: DataFrame, keys: list[str], value: str, amount: float, out: str) -> DataFrame:
    """Blend each channel with the mean over the channels of its row."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(mean, keys).withColumn(out, F.col(value) * (1.0 - amount) + F.col("_m") * amount).drop("_m")


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x)) + 1e-12


def batch_progress(state: Column, fraction: Column) -> Column:
    """Mean progress over jobs that were not cancelled; 0 when none are left."""
    p = (
        F.when(state.isin("done", "failed"), F.lit(1.0))
        .when(state == "running", fraction)
        .when(state == "queued", F.lit(0.0))
    )
    return F.coalesce(F.avg(p), F.lit(0.0))


def top_codes(df: DataFrame, cell: list[str], code: str) -> DataFrame:
    """The two most frequent codes of each cell; the runner-up falls back to the first."""
    counts = df.groupBy(*cell, code).agg(F.count(F.lit(1)).alias("_n"))
    first = F.max_by(code, F.struct(F.col("_n"), -F.col(code))).alias("first")
    best = counts.groupBy(*cell).agg(first)
    rest = counts.join(best, cell).filter(F.col(code) != F.col("first"))
    second = rest.groupBy(*cell).agg(F.max_by(code, F.struct(F.col("_n"), -F.col(code))).alias("second"))
    return best.join(second, cell, "left").withColumn("second", F.coalesce("second", "first"))


def typical_row(df: DataFrame, keys: list[str], row: str, features: list[str]) -> DataFrame:
    """The row of each key closest to the medians, in standard deviations summed over the features."""
    out = df
    for f in features:
        med = exact_percentiles(df, keys, f, {f"_med_{f}": 0.5})
        sd = df.groupBy(*keys).agg(F.greatest(F.stddev_pop(f), F.lit(1e-6)).alias(f"_sd_{f}"))
        out = out.join(med, keys).join(sd, keys)
    dist = sum((F.abs(F.col(f) - F.col(f"_med_{f}")) / F.col(f"_sd_{f}") for f in features), F.lit(0.0))
    # Rounded so that two equal distances stay equal on every machine; the lower row id then wins.
    scored = out.withColumn("_d", F.round(dist, 9))
    return scored.groupBy(*keys).agg(F.min(F.struct("_d", row)).alias("_b")).select(*keys, F.col(f"_b.{row}").alias(row), F.col("_b._d").alias("distance"))


def health(off_length: Column, has_sound: Column, brightest: Column, floor: float, broken: Column) -> Column:
    """First reason a result fails its check, in the order they are tested."""
    return (
        F.when(off_length, "duration").when(~has_sound, "no audio")
        .when(F.coalesce(brightest, F.lit(0.0)) < floor, "near black").when(broken, "non-finite").otherwise("ok")
    )
