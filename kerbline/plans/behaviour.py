"""Behaviour types: conflicts clustered by severity and cost, and the types' mean curves."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.operators.alignment import aligned_rows, event_spans, resample, with_anchor
from kerbline.operators.intervals import interval_bounds, slice_frames
from kerbline.operators.quantiles import summarise
from kerbline.operators.store import materialize
from kerbline.params import Params

WINDOW = (-5.0, 8.0)
VALUES = {"v": "v_long_smooth", "a": "a_long_smooth", "co2": "cpf_co2_rate_gps"}
# Which conflicts are clustered, and on what.
MAX_TTC, MIN_DURATION = 3.0, 0.8
FEATURES = ("min_TTC_conf", "conf_duration", "MEC_CO2_per_km", "E_real_CO2_per_km", "max_decel", "max_accel", "v_drop")


def clustering_events(mec: DataFrame) -> DataFrame:
    """Close, lasting conflicts with a known cost."""
    if not {"min_TTC_conf", "conf_duration"} <= set(mec.columns):
        return mec
    kept = mec.filter((F.col("min_TTC_conf") < MAX_TTC) & (F.col("conf_duration") >= MIN_DURATION))
    return kept.dropna(subset=["MEC_CO2_per_km"]) if "MEC_CO2_per_km" in mec.columns else kept


def kinematic_extremes(l1: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """Strongest braking and acceleration and the speed range of each event, empty where it has no frames."""
    recording = "recordingId" if "recordingId" in events.columns else "rec_id"
    start, end = interval_bounds(events.columns)
    if start is None or end is None or not {"v_long_smooth", "a_long_smooth"} <= set(l1.columns):
        return events.withColumns({c: F.lit(None).cast("double") for c in ("max_decel", "max_accel", "v_drop")})
    spans = events.select(
        F.col(recording).alias("recordingId"), "event_id", F.col("ego_id").cast("long").alias("ego_id"),
        start.alias("_from"), end.alias("_upto"))
    frames = l1.select("recordingId", "trackId", "frame", F.col("v_long_smooth").cast("double").alias("_v"),
                       F.col("a_long_smooth").cast("double").alias("_a"))
    extremes = slice_frames(frames, spans, F.col("_from"), F.col("_upto"), p).groupBy(
        F.col("recordingId").alias(recording), "event_id").agg(
        F.min("_a").alias("max_decel"), F.max("_a").alias("max_accel"), (F.max("_v") - F.min("_v")).alias("v_drop"))
    return events.join(extremes, [recording, "event_id"], "left")


def scaled_features(events: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Events with a vector ``features_z`` of z-scores, over the population, of the available features."""
    used = [c for c in (features or FEATURES) if c in events.columns]
    if not used:
        raise ValueError("none of the clustering features is present")
    number = {c: F.col(c).cast("double") for c in used}
    spread = events.agg(*[F.avg(x).alias(f"mean_{c}") for c, x in number.items()],
                        *[F.stddev_pop(x).alias(f"std_{c}") for c, x in number.items()]).first()
    # A feature without spread is 0 everywhere.
    z = {f"_z_{c}": (x - F.lit(spread[f"mean_{c}"])) / F.lit(spread[f"std_{c}"] or 1.0) for c, x in number.items()}
    vectors = VectorAssembler(inputCols=list(z), outputCol="features_z").transform(events.withColumns(z))
    return vectors.drop(*z), used


def cluster_events(events: DataFrame, k: int = 3, seed: int = 0, features: list[str] | None = None) -> DataFrame:
    """Add ``cluster``: KMeans on the z-scores, clusters numbered by ascending mean of the first feature."""
    stored = materialize(events, "cluster-input")
    if stored.limit(1).count() == 0:
        return stored.withColumn("cluster", F.lit(None).cast("int"))
    scaled, _ = scaled_features(stored, features)
    model = KMeans(k=k, seed=seed, featuresCol="features_z", predictionCol="_label").fit(scaled)
    centres = model.clusterCenters()
    order = sorted(range(len(centres)), key=lambda i: tuple(centres[i]))
    numbers = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
    return model.transform(scaled).withColumn("cluster", F.get(numbers, F.col("_label"))).drop("_label", "features_z")


def cluster_summary(clustered: DataFrame, p: Params) -> DataFrame:
    """Size and medians of each cluster."""
    used = ("min_TTC_conf", "conf_duration", "MEC_CO2_per_km")
    return summarise(clustered, ["cluster"], [F.count("*").alias("count")],
                     [(c, 0.5, f"{c}_median") for c in used]).orderBy("cluster")


def cluster_curves(l1: DataFrame, clustered: DataFrame, p: Params) -> DataFrame:
    """Mean speed, acceleration and CO2 of each cluster around the lowest TTC."""
    spans = event_spans(clustered, open_bounds=False)
    anchored = with_anchor(l1, spans, p, fall_back_to_start=True)
    rows = aligned_rows(l1, anchored, VALUES, WINDOW, p)
    series = resample(rows, spans.select("recordingId", "event_id"), list(VALUES), WINDOW, p)
    labels = clustered.select(F.col("rec_id").alias("recordingId"), "event_id", "cluster")
    return series.join(labels, ["recordingId", "event_id"]).groupBy("cluster", "offset").agg(
        *[F.avg(name).alias(f"{name}_mean") for name in VALUES],
    ).withColumn("t", F.col("offset") / p.frame_rate).orderBy("cluster", "offset")


def cluster_facts(clustered: DataFrame, summary: DataFrame, k: int = 3) -> DataFrame:
    """What must hold of any clustering: sizes add up, labels are in range and in order, every event is nearest to its own centre."""
    scaled, used = scaled_features(clustered)
    points = feature_array(scaled).select("cluster", "features_z")
    own = [F.avg(F.get("features_z", F.lit(i))).alias(f"c{i}") for i in range(len(used))]
    # At most k rows.
    centres = points.groupBy("cluster").agg(*own).orderBy("cluster").collect()

    def distance(centre) -> Column:
        return sum(((F.get("features_z", F.lit(i)) - F.lit(centre[f"c{i}"])) ** 2 for i in range(len(used))), F.lit(0.0))

    nearest = F.least(*[distance(c) for c in centres], F.lit(float("inf")), F.lit(float("inf")))
    mine = F.coalesce(*[F.when(F.col("cluster") == c.cluster, distance(c)) for c in centres], F.lit(0.0))
    disordered = sum(a.c0 > b.c0 for a, b in zip(centres, centres[1:]))
    counted = summary.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_in_summary"), F.lit(1).alias("_one"))
    return points.agg(
        F.count("*").alias("n_events"), F.count_if(~F.col("cluster").between(0, k - 1)).alias("n_out_of_range"),
        F.count_if(mine > nearest + 1e-9).alias("n_not_nearest"), F.lit(disordered).alias("n_out_of_order"), F.lit(1).alias("_one"),
    ).join(counted, "_one").drop("_one")


def feature_array(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("features_z", vector_to_array("features_z"))
