"""Common parts of the plans: the beats of the event table, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.operators.rr import clean_rr, compute_rr
from pulseloom.sources.samples import event_samples

SUBJECT = ("subject",)


def beats(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("subject", "sol")) -> DataFrame:
    """Beats of valid range, Malik artifacts removed."""
    return clean_rr(compute_rr(event_samples(spark, sf_dir), keys), "malik", keys)


SAMPLES = """samples AS (SELECT event_type AS subject, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS sol, ts,
(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t, event_id AS seq, value + 40 AS hr FROM events)"""


def rr_sql(keys: str = "subject, sol") -> str:
    return f"""{SAMPLES},
rr AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS i, 60000::DOUBLE / hr AS rr FROM samples WHERE hr > 0 AND 60000::DOUBLE / hr BETWEEN 300 AND 2000)"""


def nn_sql(keys: str = "subject, sol") -> str:
    return f"""{rr_sql(keys)},
near AS (SELECT *, lag(rr) OVER w AS p, lead(rr) OVER w AS q, count(*) OVER (PARTITION BY {keys}) AS n FROM rr WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
nn AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS i, rr FROM near WHERE NOT coalesce(n >= 10 AND abs(rr - p) / p > 0.2 AND abs(rr - q) / q > 0.2, false)),
dd AS (SELECT *, rr - lag(rr) OVER w AS d, rr + lag(rr) OVER w AS s FROM nn WINDOW w AS (PARTITION BY {keys} ORDER BY i))"""
