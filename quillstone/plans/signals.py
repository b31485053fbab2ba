"""Motion and audio queries: each user's events in order of time are a series of hundredths of value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import signals as S

CENTRE, FRAME, FLOOR, CROSSINGS, LAGS = 10_000, 8, 40_000_000, 4, 8


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return e.select(F.col("user_id").alias("series"), F.struct("ts", "event_id").alias("place"), F.rint(F.col("value") * 100).cast("long").alias("v"))


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("v", F.col("v") - CENTRE)


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.activity(S.frames(centred(spark, sf_dir), FRAME), FLOOR, CROSSINGS)


QUERIES = {
    "motion_cumulative": lambda s, f: S.cumulative(series(s, f)),
    "motion_progress": lambda s, f: S.progress(series(s, f)),
    "motion_easing": lambda s, f: S.easing(S.progress(series(s, f))),
    "motion_holds": lambda s, f: S.holds(series(s, f)),
    "motion_peaks": lambda s, f: S.peaks(series(s, f)),
    "motion_variation": lambda s, f: S.variation(series(s, f)),
    "audio_frames": lambda s, f: active(s, f),
    "audio_report": lambda s, f: S.report(active(s, f)),
    "audio_vote": lambda s, f: S.framed_vote(active(s, f)),
    "audio_autocorrelation": lambda s, f: S.autocorrelation(centred(s, f), LAGS),
    "audio_period": lambda s, f: S.period(S.autocorrelation(centred(s, f), LAGS)),
}

_S = "s AS (SELECT user_id AS series, CAST(round_even(value * 100, 0) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
_C = f"s AS (SELECT user_id AS series, CAST(round_even(value * 100, 0) AS BIGINT) - {CENTRE} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
_P = """t AS (SELECT series, CAST(i + 1 AS INT) AS i, CAST(sum(v) OVER (PARTITION BY series ORDER BY i) AS BIGINT) AS total FROM s), u AS (SELECT * FROM t UNION ALL SELECT DISTINCT series, 0, 0 FROM t),
 w AS (SELECT *, max(i) OVER (PARTITION BY series) AS last, lead(total) OVER (PARTITION BY series ORDER BY i) AS nx, last_value(total) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS span FROM u),
 pr AS (SELECT series, CAST(k.v AS INT) AS k, CASE WHEN span > 0 THEN least(1500, greatest(0, (total * (6 - k.v * last % 6) + coalesce(nx, total) * (k.v * last % 6)) * 1000 // (span * 6))) ELSE 0 END AS reached FROM w CROSS JOIN range(7) k(v) WHERE k.v * last // 6 = i)"""
_ERR = ", ".join(f"list_sum(list_transform(range(1, 8), lambda j: (c[j] - {list(v)!r}[j]) * (c[j] - {list(v)!r}[j])))" for v in S.CURVES.values())
_F = f"""fr AS (SELECT series, i // {FRAME} AS frame, i, v FROM (SELECT *, count(*) OVER (PARTITION BY series) AS a FROM s) WHERE (i // {FRAME} + 1) * {FRAME} <= a), fg AS (SELECT *, lag(v) OVER (PARTITION BY series, frame ORDER BY i) AS pv FROM fr),
 fa AS (SELECT series, frame, count(*) AS n, CAST(sum(v * v) AS BIGINT) AS energy, count(*) FILTER ((v >= 0) <> (pv >= 0)) AS crossings, count(*) FILTER (abs(v) >= 20000) AS clipped, sum(v * v) >= count(*) * {FLOOR} AND count(*) FILTER ((v >= 0) <> (pv >= 0)) <= {CROSSINGS} AS speech FROM fg GROUP BY series, frame)"""
_A = f"lg AS (SELECT a.series, CAST(k.v AS INT) AS lag, CAST(sum(a.v * b.v) AS BIGINT) AS products, count(*) AS n FROM s a CROSS JOIN range(1, {LAGS + 1}) k(v) JOIN s b ON a.series = b.series AND b.i = a.i + k.v GROUP BY a.series, k.v)"
ORACLES = {
    "motion_cumulative": f"WITH {_S} SELECT series, CAST(i + 1 AS INT) AS i, CAST(sum(v) OVER (PARTITION BY series ORDER BY i) AS BIGINT) AS total FROM s",
    "motion_progress": f"WITH {_S}, {_P} SELECT series, k, CAST(reached AS BIGINT) AS reached FROM pr",
    "motion_easing": f"WITH {_S}, {_P}, g AS (SELECT series, list(reached ORDER BY k) AS c, max(reached) AS top FROM pr GROUP BY series), e AS (SELECT *, [{_ERR}] AS err FROM g) SELECT series, CASE WHEN top > 1020 THEN 'overshoot' WHEN list_min(err) <= 17500 THEN {list(S.CURVES)!r}[list_position(err, list_min(err))] WHEN c[4] < 350 THEN 'ease-in' WHEN c[4] > 650 THEN 'ease-out' ELSE 'ease-in-out' END AS verdict, CAST(list_min(err) AS BIGINT) AS error FROM e",
    "motion_holds": f"WITH {_S}, lo AS (SELECT series, i, i - row_number() OVER (PARTITION BY series ORDER BY i) AS run FROM (SELECT *, max(v) OVER (PARTITION BY series) AS top FROM s) WHERE v * 20 < top) SELECT series, CAST(min(i) AS INT) AS start, count(*) AS length FROM lo GROUP BY series, run",
    "motion_peaks": f"WITH {_S} SELECT series, CAST(first(i ORDER BY v DESC, i) AS INT) AS peak FROM s GROUP BY series",
    "motion_variation": f"WITH {_S} SELECT series, CASE WHEN sum(v) > 0 THEN CAST(least(1000000, (count(*)::HUGEINT * sum(v * v) - sum(v)::HUGEINT * sum(v)) * 1000000 // (sum(v)::HUGEINT * sum(v))) AS BIGINT) ELSE 0 END AS variation FROM s GROUP BY series",
    "audio_frames": f"WITH {_C}, {_F} SELECT * FROM fa",
    "audio_report": f"WITH {_C}, {_F} SELECT series, count(*) AS frames, count(*) FILTER (speech) AS speech_frames, CASE WHEN sum(clipped) * 200 > sum(n) THEN 'clipped' WHEN count(*) FILTER (speech) = 0 THEN 'silent' WHEN count(*) FILTER (speech) * 2 < count(*) THEN 'mixed' ELSE 'speech' END AS quality FROM fa GROUP BY series",
    "audio_vote": f"WITH {_C}, {_F} SELECT series, CASE sign(count(*) FILTER (speech) - count(*) FILTER (NOT speech)) WHEN 1 THEN 'speech' WHEN -1 THEN 'silence' ELSE 'abstain' END AS label FROM fa GROUP BY series",
    "audio_autocorrelation": f"WITH {_C}, {_A} SELECT * FROM lg",
    "audio_period": f"WITH {_C}, {_A}, b AS (SELECT series, lag, CAST(trunc(CAST(products AS DECIMAL(38, 0)) / n) AS BIGINT) AS m FROM lg) SELECT series, CASE WHEN max(m) > 0 THEN first(lag ORDER BY m DESC, lag) ELSE 0 END AS period FROM b GROUP BY series",
}
