"""Cleaning and quality of heart-rate samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import SEGMENT, median, over_segment

LOW, HIGH = 30.0, 220.0
HR_NAMES = ("heart_rate", "hr", "hr_bpm", "heartrate")


def resolve_hr(df: DataFrame, name: str = "hr") -> DataFrame:
    """Renames the first column whose name holds one of the usual names of heart rate."""
    for wish in HR_NAMES:
        for c in df.columns:
            if wish in c.lower():
                return df.withColumnRenamed(c, name)
    raise ValueError(f"no heart-rate column among {df.columns}")


def duplicate_count(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates over all columns."""
    kept = df.groupBy(*df.columns).agg(F.count("*").alias("c"))
    return kept.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def range_null(hr: Column, low: float = LOW, high: float = HIGH) -> Column:
    """hr within [low, high], else null; the row stays."""
    return F.when(hr.between(low, high), hr)


def numeric(x: Column) -> Column:
    """A number where the text is one, else null."""
    return x.try_cast("double")


def quality_pipeline(samples: DataFrame, keys: Sequence[str] = SEGMENT, z: float = 4.0, rate: float = 5.0) -> DataFrame:
    """Four stages per segment: not null, in range, robust z-score, rate of change.

    The z stage holds for segments of more than 10 with a spread; the rate stage keeps rows with a step in time and at
    most `rate` bpm a second since the row before, where any does. stage is 4 for what passes all, else the last passed.
    """
    w = Window.partitionBy(*keys)
    # Medians as windows keep all of it on one exchange by segment.
    ok = samples.withColumn("in_range", range_null(F.col("hr")))
    ok = ok.withColumns({"med": median("in_range").over(w), "n": F.count("in_range").over(w)})
    ok = ok.withColumn("mad", median(F.abs(F.col("in_range") - F.col("med"))).over(w))
    score = F.abs(F.lit(0.6745) * (F.col("in_range") - F.col("med")) / F.col("mad"))
    third = F.col("in_range").isNotNull() & F.when((F.col("n") > 10) & (F.col("mad") > 0), score <= z).otherwise(True)
    ok = ok.withColumn("third", F.coalesce(third, F.lit(False)))
    order = Window.partitionBy(*keys, "third").orderBy("t", "seq")
    dt, dh = F.col("t") - F.lag("t").over(order), F.col("hr") - F.lag("hr").over(order)
    steady = F.coalesce(F.col("third") & (dt > 0) & (F.abs(dh / dt) <= rate), F.lit(False))
    ok = ok.withColumn("steady", steady)
    ok = ok.withColumn("any_steady", F.max("steady").over(w))
    stage = (
        F.when(F.col("hr").isNull(), 0)
        .when(F.col("in_range").isNull(), 1)
        .when(~F.col("third"), 2)
        .when(F.col("any_steady") & ~F.col("steady"), 3)
        .otherwise(4)
    )
    return ok.withColumn("stage", stage).drop("in_range", "med", "n", "mad", "third", "steady", "any_steady")


def stage_counts(staged: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Rows that are left after each stage."""
    left = [F.sum((F.col("stage") >= k).cast("long")).alias(n) for k, n in enumerate(("n_total", "n_present", "n_in_range", "n_typical", "n_steady"))]
    return staged.groupBy(*keys).agg(*left)


def quality_record(samples: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Totals, ratios, spread, coverage and a status per segment, over valid heart rates."""
    hr = range_null(F.col("hr"))
    q = lambda p: F.percentile("v", F.lit(p))
    w = Window.partitionBy(*keys)
    v = samples.withColumn("v", hr).withColumns({"q1": q(0.25).over(w), "q3": q(0.75).over(w)})
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    s = v.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count("v").alias("n_valid"),
        F.avg("v").alias("mean_hr"),
        F.stddev_samp("v").alias("std_hr"),
        F.min("v").alias("min_hr"),
        F.max("v").alias("max_hr"),
        q(0.10).alias("resting_hr"),
        q(0.95).alias("q95"),
        ((F.max("t") - F.min("t")) / 3600).alias("coverage_hours"),
        F.count_if((F.col("v") < F.col("q1") - fence) | (F.col("v") > F.col("q3") + fence)).alias("n_out"),
    )
    s = s.withColumn("valid_ratio", F.col("n_valid") / F.col("n_total"))
    status = F.when(F.col("valid_ratio") >= 0.8, "EXCELLENT").when(F.col("valid_ratio") >= 0.7, "GOOD").when(F.col("valid_ratio") >= 0.6, "FAIR").otherwise("POOR")
    return s.select(
        *keys, "n_total", "n_valid", "valid_ratio", (1 - F.col("valid_ratio")).alias("missing_ratio"),
        F.when(F.col("n_valid") > 4, F.col("n_out") / F.col("n_valid")).otherwise(0.0).alias("outlier_ratio"),
        "mean_hr", "std_hr", "min_hr", "max_hr", "coverage_hours", "resting_hr",
        ((F.col("q95") - F.col("resting_hr")) / F.col("resting_hr")).alias("hr_reserve"), status.alias("status"),
    )


def quality_report(record: DataFrame, threshold: float = 0.8) -> DataFrame:
    """passes and recommendations, by rules over a quality record."""
    advice = F.array_compact(
        F.array(
            F.when(F.col("valid_ratio") < threshold, "improve signal quality"),
            F.when(F.col("missing_ratio") > 0.2, "check sensor contact"),
            F.when(F.col("outlier_ratio") > 0.05, "remove outliers"),
            F.when(F.col("coverage_hours") < 1, "record longer"),
            F.when(F.col("std_hr") < 2, "check for a stuck sensor"),
        )
    )
    return record.withColumns({"passes": F.col("valid_ratio") >= threshold, "recommendations": F.array_join(advice, ";")})


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: missing, missing percent, infinite, over a million. One pass."""
    per = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            (100 * F.avg(F.col(c).isNull().cast("double"))).alias("missing_percent"),
            F.count_if(F.abs(F.col(c)) == float("inf")).alias("n_infinite"),
            F.count_if(F.abs(F.col(c)) > 1e6).alias("n_huge"),
        )
        for c in columns
    ]
    return df.agg(F.array(*per).alias("x")).select(F.inline("x"))


def missing_rate(samples: DataFrame, keys: Sequence[str] = SEGMENT, over: float = 50.0) -> DataFrame:
    """Share of missing heart rates per segment, in percent, and whether it is over a limit."""
    out = samples.groupBy(*keys).agg((100 * F.avg(F.col("hr").isNull().cast("double"))).alias("missing_percent"))
    return out.withColumn("flagged", F.col("missing_percent") > over)


def sigma_clip(samples: DataFrame, keys: Sequence[str] = SEGMENT, sigmas: float = 4.0, least: int = 50) -> DataFrame:
    """Positive heart rates within the mean and `sigmas` deviations and [30, 200], of segments that keep `least` or more."""
    w = Window.partitionBy(*keys)
    up = samples.where("hr > 0").withColumns({"m": F.avg("hr").over(w), "s": F.stddev_samp("hr").over(w)})
    lo, hi = F.greatest(F.lit(30.0), F.col("m") - sigmas * F.col("s")), F.least(F.lit(200.0), F.col("m") + sigmas * F.col("s"))
    kept = up.where((F.col("hr") >= lo) & (F.col("hr") <= hi)).drop("m", "s")
    return kept.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).drop("n")


def mean_fill(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.avg(column).over(Window.partitionBy(*keys))))


def interpolate(samples: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Nulls of hr filled linearly in time between the nearest known values, at the ends by the nearest one, as `filled`."""
    w = over_segment(tuple(keys), "t", "seq")
    at = F.when(F.col("hr").isNotNull(), F.struct("t", "hr"))
    d = samples.withColumns({"p": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "row_": F.row_number().over(w)})
    # The next known value is the last one in reverse: a frame that ends with the group is gone through anew from every row.
    ahead = Window.partitionBy(*keys).orderBy(F.desc("row_")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("f", F.last(at, True).over(ahead))
    share = (F.col("t") - F.col("p.t")) / (F.col("f.t") - F.col("p.t"))
    between = F.when(F.col("f.t") > F.col("p.t"), F.col("p.hr") + share * (F.col("f.hr") - F.col("p.hr")))
    return d.withColumn("filled", F.coalesce("hr", between, F.col("p.hr"), F.col("f.hr"))).drop("p", "f", "row_")


def interval_stats(samples: DataFrame, keys: Sequence[str] = ("subject",), cap: float = 0.99) -> DataFrame:
    """Steps in time per group: number, mean, median, 99th percentile and the longest at or below it."""
    d = samples.withColumn("dt", F.col("t") - F.lag("t").over(over_segment(tuple(keys), "t", "seq"))).where("dt is not null")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dt").alias("mean_dt"), median("dt").alias("median_dt"), F.percentile("dt", F.lit(cap)).alias("p99_dt"))
    top = d.join(s.select(*keys, "p99_dt"), list(keys)).where(F.col("dt") <= F.col("p99_dt")).groupBy(*keys).agg(F.max("dt").alias("longest_usual"))
    return s.join(top, list(keys), "left")


def normalise(df: DataFrame, column: str, keys: Sequence[str], how: str = "zscore") -> DataFrame:
    """min-max, zscore (n - 1) or robust ((x - median) / IQR) per group; 0 where there is no spread."""
    x, w = F.col(column), Window.partitionBy(*keys)
    if how == "minmax":
        base, spread = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    elif how == "zscore":
        base, spread = F.avg(x).over(w), F.stddev_samp(x).over(w)
    elif how == "robust":
        s = df.groupBy(*keys).agg(median(column).alias("base"), (F.percentile(column, F.lit(0.75)) - F.percentile(column, F.lit(0.25))).alias("spread"))
        out = df.join(s, list(keys))
        return out.withColumn("normal", F.when(F.col("spread") > 0, (F.col(column) - F.col("base")) / F.col("spread")).otherwise(0.0)).drop("base", "spread")
    else:
        raise ValueError(f"how is minmax, zscore or robust, not {how}")
    return df.withColumn("normal", F.when(spread > 0, (x - base) / spread).otherwise(0.0))


def relative_time(df: DataFrame, keys: Sequence[str], unit: str = "hours") -> DataFrame:
    """Time since the group's first sample."""
    per = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    return df.withColumn("elapsed", (F.col("t") - F.min("t").over(Window.partitionBy(*keys))) / per)
