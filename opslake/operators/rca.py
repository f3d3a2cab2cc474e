"""Root-cause candidates ranked per incident, for all incidents in one job."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.functions.scalars import clip, iso_utc, seconds_between
from opslake.operators.topology import Topology
from opslake.plans.rollups import Part, window_totals
from opslake.plans.sizing import settle


@dataclass(frozen=True)
class RcaConfig:
    temporal_weight: float = 0.40
    topology_weight: float = 0.35
    severity_weight: float = 0.25
    epsilon: float = 1e-6


def with_anomalies(telemetry: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Telemetry with ``is_anomaly`` and ``anomaly_score``; rows without a finding get false and 0.

    Columns on both sides come from the findings. Without findings the telemetry's own columns are used.
    """
    rows = telemetry
    if anomalies is not None:
        shared = [c for c in anomalies.columns if c not in ("timestamp", "service") and c in telemetry.columns]
        rows = telemetry.drop(*shared).join(anomalies, ["timestamp", "service"], "left")
    flag = F.coalesce(F.col("is_anomaly"), F.lit(False)) if "is_anomaly" in rows.columns else F.lit(False)
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0)) if "anomaly_score" in rows.columns else F.lit(0.0)
    return rows.withColumn("is_anomaly", flag).withColumn("anomaly_score", score)


def evaluation_windows(incidents: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``incident_id, from_ts, to_ts``; explicit bounds override those of the incidents, an absent bound is open."""
    lo = F.lit(start).cast("timestamp_ntz") if start else F.col("start_time")
    hi = F.lit(end).cast("timestamp_ntz") if end else F.col("end_time")
    return incidents.select("incident_id", lo.alias("from_ts"), hi.alias("to_ts"))


def close_windows(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace open bounds, if there are any, by the span of the rows."""
    if windows.where(F.col("from_ts").isNull() | F.col("to_ts").isNull()).isEmpty():
        return windows
    return windows.select(
        *[c for c in windows.columns if c not in ("from_ts", "to_ts")],
        F.coalesce("from_ts", rows.agg(F.min("timestamp")).scalar()).alias("from_ts"),
        F.coalesce("to_ts", rows.agg(F.max("timestamp")).scalar()).alias("to_ts"))


#: Metrics of which a window's peak and mean are evidence.
EVIDENCE = ("connection_utilization", "error_rate", "latency_ms", "cpu_usage_pct", "memory_usage_pct", "active_connections")


def window_facts(rows: DataFrame, windows: DataFrame, evidence: bool = True) -> DataFrame:
    """Per (incident, service seen in its window): counts, onset, scores and, with ``evidence``, peak, sum and count of metrics.

    All that ranking and explaining need of the telemetry, in one pass over blocks of time (``window_totals``); written
    once, as several small steps read it. ``rows`` are as ``with_anomalies`` gives them.
    """
    flag, score = F.col("is_anomaly"), F.col("anomaly_score")
    parts = {"total_samples": Part(F.lit(1).cast("bigint"), "sum"), "anomaly_count": Part(F.when(flag, 1).otherwise(0).cast("bigint"), "sum"),
             "earliest_ts": Part(F.when(flag, F.col("timestamp")), "min"), "_score_sum": Part(score, "sum"),
             "_score_n": Part(F.when(score.isNotNull(), 1).otherwise(0).cast("bigint"), "sum"), "max_anomaly_score": Part(score, "max")}
    for out, c in (("max_conn_util", "connection_utilization"), ("max_error_rate", "error_rate")):
        if c in rows.columns:
            parts[out] = Part(F.col(c), "max")
    for c in EVIDENCE if evidence else ():
        if c in rows.columns:
            parts |= {f"{c}_peak": Part(F.col(c), "max"), f"{c}_sum": Part(F.col(c).cast("double"), "sum"),
                      f"{c}_n": Part(F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("bigint"), "sum")}
    return settle(window_totals(rows, windows, parts), "facts")


def service_stats(rows: DataFrame, windows: DataFrame, topology: Topology, facts: DataFrame | None = None) -> DataFrame:
    """One row per (incident, candidate): the services seen in the window and those of the topology, with zeros if unseen.

    Incidents whose window holds no row have no candidates. ``facts`` are the ``window_facts`` of the rows, if they were made before.
    """
    zero = F.lit(0.0)
    facts = window_facts(rows, windows, evidence=False) if facts is None else facts

    def peak(c: str) -> Column:
        return F.coalesce(F.col(c), zero) if c in facts.columns else zero

    seen = facts.select(
        "incident_id", "service", "total_samples", "anomaly_count", "earliest_ts",
        F.when(F.col("_score_n") > 0, F.col("_score_sum") / F.col("_score_n")).alias("mean_anomaly_score"), "max_anomaly_score",
        peak("max_conn_util").alias("max_conn_util"), peak("max_error_rate").alias("max_error_rate"))
    # A row of zeros per (incident with data, topology node) joins the measured rows in one more small aggregate.
    candidates = topology.nodes.where("listed").agg(F.collect_list("service")).scalar()
    blank = (
        seen.select("incident_id").distinct().withColumn("service", F.explode(candidates))
        .select("incident_id", "service", F.lit(0).cast("bigint").alias("total_samples"),
                F.lit(0).cast("bigint").alias("anomaly_count"),
                F.lit(None).cast(rows.schema["timestamp"].dataType).alias("earliest_ts"),
                *[zero.alias(c) for c in ("mean_anomaly_score", "max_anomaly_score", "max_conn_util", "max_error_rate")])
    )
    filled = seen.unionByName(blank).groupBy("incident_id", "service").agg(
        *[F.max_by(c, "total_samples").alias(c) for c in seen.columns if c not in ("incident_id", "service")])
    return filled.withColumn(
        "anomaly_ratio", F.when(F.col("total_samples") > 0, F.col("anomaly_count") / F.col("total_samples"))
        .otherwise(zero))


def neighbour_stats(stats: DataFrame, topology: Topology) -> DataFrame:
    """Per (incident, service): number of callers and dependencies and how many of them are anomalous, with their names."""
    hot = stats.select("incident_id", F.col("service").alias("_other"), (F.col("anomaly_count") > 0).alias("_hot"))
    links = topology.edges.select(
        F.inline(F.array(
            F.struct(F.col("caller").alias("service"), F.col("dependency").alias("_other"), F.lit("dep").alias("_side"),
                     F.col("pos").alias("_pos")),
            F.struct(F.col("dependency").alias("service"), F.col("caller").alias("_other"), F.lit("caller").alias("_side"),
                     F.col("pos").alias("_pos")))))
    met = stats.select("incident_id", "service").join(links, "service").join(hot, ["incident_id", "_other"], "left")
    named = F.struct("_pos", "_other")

    def names(side: str, only_hot: bool) -> Column:
        cond = F.col("_side") == side
        if only_hot:
            cond = cond & F.coalesce(F.col("_hot"), F.lit(False))
        return F.transform(F.array_sort(F.collect_list(F.when(cond, named))), lambda s: s["_other"])

    return met.groupBy("incident_id", "service").agg(
        names("caller", False).alias("callers"), names("dep", False).alias("deps"),
        names("caller", True).alias("anom_callers"), names("dep", True).alias("anom_deps"))


def rca_scores(stats: DataFrame, topology: Topology, config: RcaConfig = RcaConfig()) -> DataFrame:
    """Temporal, topology and severity scores, their weighted sum, and its share among the candidates of the incident.

    From here on there is one row per (incident, candidate service).
    """
    per_incident = Window.partitionBy("incident_id")
    zero, one = F.lit(0.0), F.lit(1.0)
    depths = topology.nodes.select("service", "depth")
    deepest = depths.agg(F.max("depth")).scalar()
    near = neighbour_stats(stats, topology)
    rows = (
        stats.join(depths, "service", "left").join(near, ["incident_id", "service"], "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("_deepest", deepest)
        .select(
            "*",
            F.min("earliest_ts").over(per_incident).alias("_first"), F.max("earliest_ts").over(per_incident).alias("_last"),
            F.min("max_anomaly_score").over(per_incident).alias("_low"),
            F.max("max_anomaly_score").over(per_incident).alias("_high"))
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.coalesce(F.size(whole), F.lit(0)) > 0, F.size(part) / F.size(whole)).otherwise(zero)

    dep_ratio, caller_ratio = share("anom_deps", "deps"), share("anom_callers", "callers")
    span = seconds_between(F.col("_first"), F.col("_last"))
    onset = F.when(span > 0, one - seconds_between(F.col("_first"), F.col("earliest_ts")) / span).otherwise(one)
    temporal = clip(F.lit(0.70) * onset + F.lit(0.30) * F.col("anomaly_ratio"), 0.0, 1.0)
    depth_ratio = F.when(F.col("_deepest") > 0, F.col("depth") / F.col("_deepest")).otherwise(zero)
    base = F.lit(0.40) * depth_ratio + F.lit(0.40) * caller_ratio + F.lit(0.20) * (one - dep_ratio)
    topo = clip(base * (one - F.lit(0.50) * dep_ratio), 0.0, 1.0)
    width = F.col("_high") - F.col("_low")
    intensity = F.when(width > 0, (F.col("max_anomaly_score") - F.col("_low")) / (width + F.lit(config.epsilon))).otherwise(one)
    sev = clip(F.lit(0.60) * intensity + F.lit(0.40) * F.greatest("max_conn_util", "max_error_rate"), 0.0, 1.0)
    hit = F.col("anomaly_count") > 0
    scored = rows.select(
        *stats.columns, "depth",
        F.when(hit, temporal).otherwise(zero).alias("temporal"),
        F.when(hit, topo).otherwise(zero).alias("topology"),
        F.when(hit, sev).otherwise(zero).alias("severity"))
    raw = (F.lit(config.temporal_weight) * F.col("temporal") + F.lit(config.topology_weight) * F.col("topology")
           + F.lit(config.severity_weight) * F.col("severity"))
    total = F.sum("raw_score").over(per_incident)
    return scored.withColumn("raw_score", raw).withColumn(
        "score", F.when(total > 0, F.round(F.col("raw_score") / total, 4)).otherwise(zero))


def rca_rank(scores: DataFrame) -> DataFrame:
    """Candidates in order: raw score (6 places) down, earliest anomaly up with none last, name up; plus their text."""
    order = Window.partitionBy("incident_id").orderBy(
        F.desc(F.round("raw_score", 6)), F.asc_nulls_last("earliest_ts"), F.asc("service"))
    onset = iso_utc(F.col("earliest_ts"))
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("bigint"))
    # Fixed value: the sentence.
    text = F.format_string(
        "Candidate '%s' (Rank %d, score %.3f): temporal=%.2f (onset: %s), topology=%.2f (depth: %d), "
        "severity=%.2f (max_score: %.3f).",
        F.col("service"), F.col("rank"), F.col("score"), F.col("temporal"), F.coalesce(onset, F.lit("None")),
        F.col("topology"), F.col("depth"), F.col("severity"), F.col("max_anomaly_score"))
    return ranked.select(
        "incident_id", "service", "rank", "score", F.round("raw_score", 4).alias("raw_score"),
        F.col("earliest_ts").alias("earliest_anomaly_time"), "anomaly_count",
        F.round("anomaly_ratio", 4).alias("anomaly_ratio"),
        F.round("mean_anomaly_score", 4).alias("mean_anomaly_score"),
        F.round("max_anomaly_score", 4).alias("max_anomaly_score"),
        F.struct(F.round("temporal", 4).alias("temporal"), F.round("topology", 4).alias("topology"),
                 F.round("severity", 4).alias("severity")).alias("score_breakdown"),
        text.alias("explanation"), (F.col("raw_score") > 0).alias("is_root_cause_candidate"))


def rank_root_causes(telemetry: DataFrame, incidents: DataFrame, topology: Topology, anomalies: DataFrame | None = None,
                     config: RcaConfig = RcaConfig(), start: str | None = None, end: str | None = None) -> DataFrame:
    """Telemetry, incidents and findings in; ranked candidates out. Without findings or flags the forest is run."""
    rows = with_findings(telemetry, anomalies)
    windows = evaluation_windows(incidents, start, end)
    return rca_rank(rca_scores(service_stats(rows, close_windows(windows, telemetry), topology), topology, config))


def with_findings(telemetry: DataFrame, anomalies: DataFrame | None) -> DataFrame:
    """``with_anomalies``, with the forest's findings where there are none."""
    if anomalies is None and "is_anomaly" not in telemetry.columns:
        from opslake.operators.iforest import detect_with_forest

        anomalies = detect_with_forest(telemetry)
    return with_anomalies(telemetry, anomalies)


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def rca_results(incidents: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per incident with its ranked candidates as an array; empty for incidents without data.

    An array holds one struct per service of the incident.
    """
    body = F.struct("rank", *[c for c in ranked.columns if c not in ("incident_id", "rank")])
    lists = ranked.groupBy("incident_id").agg(F.array_sort(F.collect_list(body)).alias("ranked_candidates"))
    return incidents.select("incident_id", "start_time", "end_time").join(lists, "incident_id", "left")
