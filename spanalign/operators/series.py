"""Run logs and metric series (AGG-6, AGG-18..22).

Per-series results come from aggregates with map-side partial aggregation
(min_by / max_by), so one series holding a third of all samples costs one
partial row per task. Joining a per-series result back to the samples is
left to AQE: a broadcast when the measured per-series table is small,
otherwise a shuffle join whose hot key the skew-join rule splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def micros(ts, ntz: bool = True) -> F.Column:
    """Microseconds since the epoch. A TIMESTAMP_NTZ (wall-clock) column is
    measured against the NTZ epoch, so the result does not depend on the
    session time zone; a TIMESTAMP column uses unix_micros."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                c.cast("timestamp_ntz"))
    return F.unix_micros(c)


def _is_ntz(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampNTZType)


def run_summary(run_log: DataFrame, by="run", status: str = "status", ok_value: str = "ok") -> DataFrame:
    """AGG-18: successes, failures and total per run group."""
    by = [by] if isinstance(by, str) else list(by)
    return run_log.groupBy(*by).agg(F.count_if(F.col(status) == ok_value).alias("n_success"),
                                    F.count_if(F.col(status) != ok_value).alias("n_failure"),
                                    F.count(F.lit(1)).alias("n_total"))


def series_summary(samples: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value",
                   tie: str = "event_id") -> DataFrame:
    """AGG-19: initial, peak, final, increase, sample count and duration
    (seconds) per series; ties in time broken by ``tie``."""
    nz = _is_ntz(samples, ts)
    key = F.struct(micros(ts, nz).alias("t"), F.col(tie).alias("k"))
    g = samples.groupBy(series).agg(
        F.min_by(value, key).alias("initial"), F.max(value).alias("peak"), F.max_by(value, key).alias("final"),
        F.count(F.lit(1)).alias("n_samples"), F.min(micros(ts, nz)).alias("_t0"), F.max(micros(ts, nz)).alias("_t1"))
    return g.select(series, "initial", "peak", "final", (F.col("final") - F.col("initial")).alias("increase"),
                    "n_samples", ((F.col("_t1") - F.col("_t0")) / 1e6).alias("duration"))


def baseline_delta(samples: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value",
                   tie: str = "event_id") -> DataFrame:
    """AGG-20: every sample minus its series' first sample, and seconds since
    that first sample."""
    nz = _is_ntz(samples, ts)
    key = F.struct(micros(ts, nz).alias("t"), F.col(tie).alias("k"))
    base = samples.groupBy(series).agg(F.min_by(value, key).alias("_v0"), F.min(micros(ts, nz)).alias("_t0"))
    # no broadcast hint: AQE broadcasts the per-series side only where it is measured to be small
    x = samples.join(base, series)
    return x.select(series, tie, (F.col(value) - F.col("_v0")).alias("delta"),
                    ((micros(ts, nz) - F.col("_t0")) / 1e6).alias("elapsed"))


def peak_point(samples: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value",
               tie: str = "event_id") -> DataFrame:
    """AGG-21: first time at which each series reaches its maximum."""
    nz = _is_ntz(samples, ts)
    key = F.struct((-F.col(value)).alias("v"), micros(ts, nz).alias("t"), F.col(tie).alias("k"))
    g = samples.groupBy(series).agg(F.min_by(F.struct(F.col(value).alias("peak"), micros(ts, nz).alias("peak_us"),
                                                      F.col(tie).alias("peak_id")), key).alias("_p"))
    return g.select(series, "_p.*")


def phase_compare(samples: DataFrame, model: str, phase, ts: str = "ts", value: str = "value",
                  tie: str = "event_id") -> DataFrame:
    """AGG-22: per model and phase the start value, end value and increase
    (end - start) - the long form of the model x phase matrix."""
    key = F.struct(micros(ts, _is_ntz(samples, ts)).alias("t"), F.col(tie).alias("k"))
    ph = F.col(phase) if isinstance(phase, str) else phase
    g = samples.withColumn("phase", ph).groupBy(model, "phase").agg(
        F.min_by(value, key).alias("start_value"), F.max_by(value, key).alias("end_value"))
    return g.withColumn("increase", F.col("end_value") - F.col("start_value"))


def phase_matrix(long: DataFrame, model: str, phases) -> DataFrame:
    return long.groupBy(model).pivot("phase", list(phases)).agg(F.first("increase"))
