"""Specialists asked on images and series of the events table, the list of specialists, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import perception as Q
from quillstone.operators import specialists as S
from quillstone.plans import perception
from quillstone.plans.perception import _out
from quillstone.plans.raster import PX, d, pixels

c = F.col
EVERY = 5


def asked(name: str, rows: DataFrame) -> DataFrame:
    """Every fifth row against all others."""
    return S.ask(name, rows.where(c("id") % EVERY == 0), rows)


def flat_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images against images; exemplars with much spread of luma are called textured."""
    rows = Q.flat_color(pixels(spark, sf_dir)).withColumnRenamed("image_id", "id")
    return asked("flat-color", rows.withColumn("label", F.when(fixed(c("luma_std")) >= 500_000, "textured").otherwise("flat")))


def prosody_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' rhythm against users of the same remainder by three; exemplars are iambic or trochaic."""
    rows = Q.rhythm(perception.syllables(spark, sf_dir)).withColumnRenamed("series", "id")
    return asked("prosody", rows.withColumn("language_id", (c("id") % 3).cast("string")).withColumn("label", F.when(c("iamb_ratio") >= c("trochee_ratio"), "iambic").otherwise("trochaic")))


def _frames(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", c("series") * 100_000 + c("frame"))


def voice_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of samples against frames; exemplars with many crossings are called noise."""
    rows = _frames(Q.voice(perception.frames(spark, sf_dir)))
    return asked("voice-activity", rows.withColumn("label", F.when(fixed(c("zcr")) >= 500_000, "noise").otherwise("voice")))


def recording_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of samples against frames; exemplars that clip are called clipped."""
    rows = _frames(Q.recording(perception.frames(spark, sf_dir)))
    return asked("recording-quality", rows.withColumn("label", F.when(c("clipping") > 0, "clipped").otherwise("clean")))


QUERIES = {"specialist_flat_color": flat_color, "specialist_prosody": prosody_votes, "specialist_voice": voice_votes, "specialist_recording": recording_votes, "specialist_list": lambda s, f: S.listed(s)}


def _vote(features: int, minimum: float, cap: float) -> str:
    return f"""n AS (SELECT * FROM (SELECT q.id AS query_id, m.label, CAST(list_sum(list_transform(range(1, {features + 1}), lambda i: (q.v[i] - m.v[i]) * (q.v[i] - m.v[i]))) AS BIGINT) AS d2, row_number() OVER (PARTITION BY q.id ORDER BY d2, m.id) AS k FROM r q JOIN r m ON q.key = m.key AND q.id <> m.id WHERE q.id % {EVERY} = 0) WHERE k <= 5),
 s AS (SELECT *, CAST(floor(greatest({d(0.0)}, {d(1.0)} - sqrt(CAST(d2 AS DOUBLE)) / {d(1e6 * features**0.5)}) * 1000000) AS BIGINT) AS sim FROM n), p AS (SELECT query_id, count(*) AS n, min(label) AS lo, max(label) AS hi, CAST(sum(sim) AS BIGINT) AS total FROM s WHERE sim >= {int(minimum * 1e6)} GROUP BY 1),
 a AS (SELECT id AS query_id, coalesce(n, 0) AS n, lo, total, CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_similar' WHEN lo <> hi THEN 'mixed_labels' ELSE '' END AS reason FROM (SELECT id FROM r WHERE id % {EVERY} = 0) LEFT JOIN p ON query_id = id)
 SELECT query_id, CASE WHEN reason = '' THEN 'suggest' ELSE 'abstain' END AS status, reason, CASE WHEN reason = '' THEN lo END AS label, n AS neighbours, CASE WHEN reason = '' THEN least({int(cap * 1e6)}, total // n) ELSE 0 END AS confidence FROM a"""


_FLAT = S.SPECIALISTS["flat-color"]
_PROSODY = S.SPECIALISTS["prosody"]
_VOICE = S.SPECIALISTS["voice-activity"]
_RECORDING = S.SPECIALISTS["recording-quality"]
ORACLES = {
    "specialist_flat_color": f"WITH {PX}, {perception.FLAT}, f AS ({_out('image_id', perception.FLAT_PARTS, 'fl WHERE n >= 4')}), r AS (SELECT image_id AS id, 'all' AS key, CASE WHEN luma_std >= 500000 THEN 'textured' ELSE 'flat' END AS label, [{', '.join(_FLAT.features)}] AS v FROM f), {_vote(5, _FLAT.minimum, _FLAT.cap)}",
    "specialist_prosody": f"WITH {perception.RHYTHM}, f AS ({_out('series', perception.RHYTHM_PARTS, 'rh')}), r AS (SELECT series AS id, CAST(series % 3 AS VARCHAR) AS key, CASE WHEN iamb_ratio >= trochee_ratio THEN 'iambic' ELSE 'trochaic' END AS label, [{', '.join(_PROSODY.features)}] AS v FROM f), {_vote(6, _PROSODY.minimum, _PROSODY.cap)}",
    "specialist_voice": f"WITH {perception.SERIES}, f AS ({_out('series, frame', perception.VOICE, 'fe')}), r AS (SELECT series * 100000 + frame AS id, 'all' AS key, CASE WHEN zcr >= 500000 THEN 'noise' ELSE 'voice' END AS label, [{', '.join(_VOICE.features)}] AS v FROM f), {_vote(5, _VOICE.minimum, _VOICE.cap)}",
    "specialist_recording": f"WITH {perception.SERIES}, f AS ({_out('series, frame', perception.RECORDING, 'fe')}), r AS (SELECT series * 100000 + frame AS id, 'all' AS key, CASE WHEN clipping > 0 THEN 'clipped' ELSE 'clean' END AS label, [{', '.join(_RECORDING.features)}] AS v FROM f), {_vote(5, _RECORDING.minimum, _RECORDING.cap)}",
    # the contract of each specialist, written out
    "specialist_list": """SELECT name, features, minimum, isolation, 3 AS fewest, cap FROM (VALUES ('tool-router', 6, 62, '', 95), ('consequence', 8, 72, 'family', 90), ('prosody', 6, 85, 'language_id', 90), ('visual-anomaly', 7, 40, 'domain', 95),
 ('consistency', 7, 72, 'family', 90), ('flat-color', 5, 70, '', 100), ('voice-activity', 5, 70, '', 100), ('recording-quality', 5, 75, '', 100), ('panel-crop', 6, 55, 'family', 100), ('speech-bubble', 6, 80, '', 100),
 ('sprite-anchor', 7, 70, 'family', 90), ('texture-repeat', 6, 72, 'family', 90), ('texture-orientation', 7, 72, 'family', 90), ('tileability', 7, 70, 'family', 95), ('integration-method', 5, 72, '', 100), ('clip-loop', 7, 70, 'family', 90)) t(name, features, minimum, isolation, cap)""",
}
