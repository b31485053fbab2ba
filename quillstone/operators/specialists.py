"""Retrieval specialists: one vote over nearest exemplars, told apart by features, isolation and thresholds; memories come from the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import neighbours as N

c = F.col
#: Features are shares from 0 to 1, kept as millionths.
UNIT = 1_000_000


@dataclass(frozen=True)
class Specialist:
    """``key`` is the column that queries and exemplars must share (None: no isolation)."""

    name: str
    features: tuple[str, ...]
    minimum: float
    key: str | None = None
    fewest: int = 3
    cap: float = 0.95


# The features, least similarity, isolation, fewest neighbours and greatest confidence of each specialist.
SPECIALISTS = {
    s.name: s
    for s in (
        Specialist("tool-router", ("has_code", "has_files", "has_error", "wants_mutation", "wants_external_state", "criticality"), 0.62),
        Specialist("consequence", ("reversible", "scope_ratio", "touches_protected", "has_backup", "dry_run_available", "blast_radius", "idempotent", "recent_failures"), 0.72, "family", cap=0.9),
        Specialist("prosody", ("stress_ratio", "iamb_ratio", "trochee_ratio", "duration_cv", "final_lengthening", "late_stress"), 0.85, "language_id", cap=0.9),
        Specialist("visual-anomaly", ("mean_r", "mean_g", "mean_b", "luma_std", "dark_ratio", "border_delta", "chroma"), 0.40, "domain"),
        Specialist("consistency", ("mean_r", "mean_g", "mean_b", "luma_std", "dark_ratio", "border_delta", "chroma"), 0.72, "family", cap=0.9),
        Specialist("flat-color", ("luma_std", "chroma", "chroma_std", "unique_ratio", "channel_span"), 0.70, cap=1.0),
        Specialist("voice-activity", ("energy", "zcr", "periodicity", "crest", "high_ratio"), 0.70, cap=1.0),
        Specialist("recording-quality", ("energy", "clipping", "noise_floor", "periodicity", "zcr"), 0.75, cap=1.0),
        Specialist("panel-crop", ("fill", "aspect", "touch_left", "touch_right", "touch_top", "touch_bottom"), 0.55, "family", cap=1.0),
        Specialist("speech-bubble", ("fill", "aspect", "compactness", "brightness", "border_touch", "topness"), 0.80, cap=1.0),
        Specialist("sprite-anchor", ("coverage", "bbox_fill", "centroid_x", "centroid_y", "bottom_mass", "symmetry", "aspect"), 0.70, "family", cap=0.9),
        Specialist("texture-repeat", ("strength_x", "strength_y", "axis_balance", "gradient_energy", "profile_variance", "detail_ratio"), 0.72, "family", cap=0.9),
        Specialist("texture-orientation", ("strength_x", "strength_y", "axis_isotropy", "diagonal_strength", "diagonal_cos2theta", "diagonal_sin2theta", "smallest_period_ratio"), 0.72, "family", cap=0.9),
        Specialist("tileability", ("gap", "seam", "interior", "edge_step", "seam_max", "hot_rows", "axis_asym"), 0.70, "family"),
        Specialist("integration-method", ("direction_focus", "slope_uniformity", "divergence_ratio", "radial_alignment", "flat_field"), 0.72, cap=1.0),
        Specialist("clip-loop", ("iou_mismatch", "added_ratio", "removed_ratio", "centroid_shift", "area_ratio", "color_delta", "bbox_shift"), 0.70, "family", cap=0.9),
    )
}


def _vectors(rows: DataFrame, s: Specialist, *more: str) -> DataFrame:
    """(id, key, v): an unknown feature is an error and is never taken for 0; so is one outside of 0 to 1."""

    def share(name: str) -> Column:
        x = c(name).cast("double")
        return F.when((x >= 0) & (x <= 1), F.rint(x * UNIT).cast("long")).otherwise(F.raise_error(F.lit(f"feature {name} is unknown or not between 0 and 1")).cast("long"))

    return rows.select(c("id").cast("long").alias("id"), (c(s.key) if s.key else F.lit("all")).cast("string").alias("key"), F.array(*map(share, s.features)).alias("v"), *more)


def ask(name: str, queries: DataFrame, memory: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, status, reason, label, neighbours, confidence) of queries (id, features, key) against exemplars that also have a label."""
    s = SPECIALISTS[name]
    exemplars = _vectors(memory, s, "label")
    asked = _vectors(queries, s)
    near = N.nearest(asked, exemplars, k, len(s.features))
    return N.vote(near, exemplars.select("id", "label"), asked.select(c("id").alias("query_id")), len(s.features), float(UNIT), s.minimum, s.fewest, s.cap)


def listed(spark: SparkSession) -> DataFrame:
    """(name, features, minimum, isolation, fewest, cap) of all specialists; shares in hundredths."""
    rows = [(s.name, len(s.features), round(s.minimum * 100), s.key or "", s.fewest, round(s.cap * 100)) for s in SPECIALISTS.values()]
    return spark.createDataFrame(rows, "name string, features int, minimum int, isolation string, fewest int, cap int")
