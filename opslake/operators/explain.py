"""Evidence, confidence, classification and text behind a root-cause ranking."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.functions.scalars import iso_utc, seconds_between
from opslake.operators.rca import neighbour_stats
from opslake.operators.topology import Topology
from opslake.plans.rollups import Part, window_totals
from opslake.plans.sizing import settle

# Tracked metrics in display order with display name, unit, multiplier.
FORMATS = (
    ("connection_utilization", "Connection Pool Utilization", "%", 100.0),
    ("error_rate", "Error Rate", "%", 100.0),
    ("latency_ms", "Response Latency", "ms", 1.0),
    ("cpu_usage_pct", "CPU Usage", "%", 1.0),
    ("memory_usage_pct", "Memory Usage", "%", 1.0),
    ("active_connections", "Active Connections", " conn", 1.0),
)
# Metric -> (least peak that makes a signal, signal text, description).
SIGNALS = {
    "connection_utilization": (0.70, "Severe connection saturation: peak %.1f%%",
                               "Observed peak connection pool utilization of %.1f%% (mean %.1f%%)"),
    "error_rate": (0.01, "Elevated error rate: peak %.2f%%", "Observed peak error rate of %.2f%% (mean %.2f%%)"),
    "latency_ms": (100.0, "High response latency: peak %.1fms", "Observed peak response latency of %.1fms (mean %.1fms)"),
    "cpu_usage_pct": (75.0, "High CPU utilization: peak %.1f%%", "Observed peak cpu usage of %.1f%% (mean %.1f%%)"),
    "active_connections": (50.0, "High active connections: %.0f", "Observed peak active connections of %.0f conn"),
}
# Texts that stand in every explanation.
NOMINAL = "Nominal metric ranges across observed window."
LIMITATIONS = (
    "Heuristic candidate ranking is not definitive causal proof.",
    "Unobserved network hops, external third-party outages, or OS hardware faults cannot be ruled out.",
    "Propagation reasoning assumes a directed acyclic graph (DAG) topology.",
)


@dataclass(frozen=True)
class ExplainConfig:
    high_score: float = 0.45
    high_margin: float = 0.15
    medium_score: float = 0.30
    lower_rank_medium_score: float = 0.20


def evidence_metrics(telemetry: DataFrame, windows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``incident_id, service, metric, pos, peak, mean`` (unrounded) of each tracked metric in the window.

    All metrics are aggregated side by side, over blocks of time, and turned long afterwards, on one row per (incident, service).
    ``facts`` are the ``window_facts`` of the telemetry, if they were made before.
    """
    tracked = [(i, m) for i, (m, *_) in enumerate(f for f in FORMATS if f[0] in telemetry.columns)]
    if facts is None:
        parts = {}
        for _, m in tracked:
            parts |= {f"{m}_peak": Part(F.col(m), "max"), f"{m}_sum": Part(F.col(m).cast("double"), "sum"),
                      f"{m}_n": Part(F.when(F.col(m).isNotNull(), 1).otherwise(0).cast("bigint"), "sum")}
        facts = window_totals(telemetry, windows, parts)
    return facts.select("incident_id", "service", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(i).alias("pos"), F.col(f"{m}_peak").cast("double").alias("peak"),
                 F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n")).alias("mean"))
        for i, m in tracked]))).where(F.col("peak").isNotNull())


def _signal_cases(make) -> Column:
    out = F.lit(None).cast("string")
    for metric, (least, signal, desc) in SIGNALS.items():
        over = F.col("peak") > least if metric == "active_connections" else F.col("peak") >= least
        out = F.when((F.col("metric") == metric) & over, make(metric, signal, desc)).otherwise(out)
    return out


def evidence_detail(metrics: DataFrame) -> DataFrame:
    """Metric evidence with display name, unit, description and, where the peak is high enough, the signal text."""
    names = F.create_map(*[F.lit(v) for m, n, _, _ in FORMATS for v in (m, n)])
    units = F.create_map(*[F.lit(v) for m, _, u, _ in FORMATS for v in (m, u)])
    mults = F.create_map(*[F.lit(v) for m, _, _, k in FORMATS for v in (m, k)])
    mult = mults[F.col("metric")]
    peak, mean = F.col("peak") * mult, F.col("mean") * mult
    plain = F.format_string("%s: peak %.2f%s, mean %.2f%s", names[F.col("metric")], peak, units[F.col("metric")], mean,
                            units[F.col("metric")])
    return metrics.select(
        "*", names[F.col("metric")].alias("display_name"), units[F.col("metric")].alias("unit"),
        F.coalesce(_signal_cases(lambda m, s, d: F.format_string(d, *([peak] if d.count("%.") == 1 else [peak, mean]))),
                   plain).alias("description"),
        _signal_cases(lambda m, s, d: F.format_string(s, peak)).alias("signal"))


def evidence_signals(metrics: DataFrame) -> DataFrame:
    """``incident_id, service, signal_metrics``: the metrics, in display order, whose peak makes a signal."""
    hit = evidence_detail(metrics).where(F.col("signal").isNotNull())
    return hit.groupBy("incident_id", "service").agg(
        F.array_sort(F.collect_list(F.struct("pos", "metric", "signal"))).alias("_s")).select(
        "incident_id", "service", F.transform("_s", lambda s: s["metric"]).alias("signal_metrics"),
        F.transform("_s", lambda s: s["signal"]).alias("signals"))


def evidence_temporal(ranked: DataFrame) -> DataFrame:
    """Seconds from the earliest onset of the incident to the candidate's, with its sentence."""
    first = F.min("earliest_anomaly_time").over(Window.partitionBy("incident_id"))
    delta = F.round(seconds_between(first, F.col("earliest_anomaly_time")), 2)
    when = iso_utc(F.col("earliest_anomaly_time"))
    share = F.col("anomaly_ratio") * 100
    quiet = (F.col("anomaly_count") == 0) | F.col("earliest_anomaly_time").isNull()
    tail = F.format_string("anomalous in %d samples (%.1f%% persistence).", F.col("anomaly_count"), share)
    # The sentences.
    text = (
        F.when(quiet, F.lit("No anomalous samples observed during evaluation window."))
        .when(F.col("onset_delta_seconds") == 0.0,
              F.concat(F.lit("Earliest anomaly onset at "), when, F.lit(" (t0 across all services); "), tail))
        .otherwise(F.concat(F.lit("Anomaly onset at "), when,
                            F.format_string(" (+%.1fs after primary onset); ", F.col("onset_delta_seconds")), tail))
    )
    return ranked.withColumn("onset_delta_seconds", delta).select(
        "incident_id", "service", "earliest_anomaly_time", "onset_delta_seconds", "anomaly_count", "anomaly_ratio",
        text.alias("summary"))


def evidence_dependency(ranked: DataFrame, topology: Topology) -> DataFrame:
    """Callers, dependencies, their anomalous subsets, the display depth and the propagation role.

    The display depth is a fixed rule, not the graph depth used in the ranking: 0 without callers, 1 if the gateway calls
    and the orders service does not, else 2.
    """
    near = neighbour_stats(ranked.select("incident_id", "service", "anomaly_count"), topology)
    empty = F.array().cast("array<string>")
    rows = ranked.select("incident_id", "service").join(near, ["incident_id", "service"], "left").select(
        "incident_id", "service",
        *[F.coalesce(c, empty).alias(c) for c in ("callers", "deps", "anom_callers", "anom_deps")])
    has_callers, has_deps = F.size("callers") > 0, F.size("deps") > 0
    depth = (
        F.when(~has_callers, F.lit(0))
        .when(F.array_contains("callers", "orders_service"), F.lit(2))
        .when(F.array_contains("callers", "api_gateway"), F.lit(1)).otherwise(F.lit(2))
    )
    # Roles and sentences.
    role = (
        F.when(~has_deps & has_callers, "Leaf downstream dependency")
        .when(has_deps & ~has_callers, "Top-level ingress caller")
        .when(has_deps & has_callers, "Intermediate transit service")
        .otherwise("Independent isolated service")
    )
    up, down = F.size("anom_callers") > 0, F.size("anom_deps") > 0
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Topology role: "), role, F.lit(" (depth "), depth.cast("string"), F.lit(").")),
        F.when(up, F.concat(F.lit("Observed propagation to upstream callers: "), F.array_join("anom_callers", ", "),
                            F.lit("."))),
        F.when(down, F.concat(F.lit("Downstream dependencies exhibiting anomalies: "), F.array_join("anom_deps", ", "),
                              F.lit("."))),
        F.when(~up & ~down, F.lit("No active propagation along dependency graph edges.")))
    return rows.select("*", depth.alias("explainer_depth"), role.alias("propagation_role"), text.alias("summary"))


def rca_confidence(ranked: DataFrame, config: ExplainConfig = ExplainConfig()) -> DataFrame:
    """``incident_id, service, rank, score, margin, confidence, rationale``; the margin is over the runner-up."""
    runner_up = F.coalesce(F.lead("score").over(Window.partitionBy("incident_id").orderBy("rank")), F.lit(0.0))
    score, margin = F.col("score"), F.col("margin")
    quiet = (score <= 0) | (F.col("anomaly_count") == 0)
    high = (score >= config.high_score) | (margin >= config.high_margin)
    level = (
        F.when(quiet, "LOW")
        .when(F.col("rank") == 1, F.when(high, "HIGH").when(score >= config.medium_score, "MEDIUM").otherwise("LOW"))
        .otherwise(F.when(score >= config.lower_rank_medium_score, "MEDIUM").otherwise("LOW"))
    )
    # The sentences.
    why = (
        F.when(quiet, F.lit("No anomalous telemetry signals observed for this service."))
        .when(F.col("rank") != 1, F.format_string("Rank %d candidate score (%.3f).", F.col("rank"), score))
        .when(high, F.format_string("Decisive candidate score (%.3f) with strong margin (+%.3f) over runner-up.",
                                    score, margin))
        .when(score >= config.medium_score,
              F.format_string("Moderate candidate score (%.3f) with +%.3f lead over runner-up.", score, margin))
        .otherwise(F.format_string(
            "Diffused candidate score (%.3f); multiple services exhibit simultaneous degradation.", score))
    )
    return ranked.withColumn("margin", F.when(F.col("rank") == 1, score - runner_up)).select(
        "incident_id", "service", "rank", "score", "margin", level.alias("confidence"), why.alias("rationale"))


def rca_classification(ranked: DataFrame, topology: Topology) -> DataFrame:
    """``incident_id, service, classification`` with the precedence unaffected, root, cascading, secondary, correlated."""
    dep = evidence_dependency(ranked, topology).select("incident_id", "service", "anom_callers", "anom_deps")
    rows = ranked.join(dep, ["incident_id", "service"])
    # The classes.
    label = (
        F.when((F.col("score") <= 0) | (F.col("anomaly_count") == 0), "Unaffected service")
        .when(F.col("rank") == 1, "Probable root cause")
        .when(F.size("anom_deps") > 0, "Cascading failure symptom (downstream dependency failing)")
        .when(F.size("anom_callers") > 0, "Secondary contributing service")
        .otherwise("Correlated anomaly")
    )
    return rows.select("incident_id", "service", label.alias("classification"))


def explain_candidates(ranked: DataFrame, telemetry: DataFrame, windows: DataFrame, topology: Topology,
                       config: ExplainConfig = ExplainConfig(), facts: DataFrame | None = None) -> DataFrame:
    """One row per candidate with all evidence nested and its summary sentence."""
    by = ["incident_id", "service"]
    detail = evidence_detail(evidence_metrics(telemetry, windows, facts))
    one = F.struct("pos", F.col("metric").alias("metric_name"), "display_name",
                   F.round("peak", 4).alias("peak_value"), F.round("mean", 4).alias("mean_value"), "unit", "description")
    facts = detail.groupBy(*by).agg(
        F.array_sort(F.collect_list(one)).alias("contributing_metrics"),
        F.array_sort(F.collect_list(F.when(F.col("signal").isNotNull(), F.struct("pos", "signal")))).alias("_signals"))
    facts = facts.select(*by, "contributing_metrics", F.when(
        F.size("_signals") > 0, F.transform("_signals", lambda s: s["signal"])).otherwise(
        F.array(F.lit(NOMINAL))).alias("supporting_signals"))
    temporal = evidence_temporal(ranked).select(*by, "onset_delta_seconds", F.col("summary").alias("temporal_summary"))
    dep = evidence_dependency(ranked, topology).withColumnRenamed("summary", "dependency_summary")
    conf = rca_confidence(ranked, config).select(*by, "confidence", "rationale")
    kind = rca_classification(ranked, topology)
    rows = (
        ranked.join(facts, by, "left").join(temporal, by).join(dep, by).join(conf, by).join(kind, by)
        .withColumn("supporting_signals", F.coalesce("supporting_signals", F.array().cast("array<string>")))
    )
    said = F.array_join(F.slice("supporting_signals", 1, 2), "; ")
    score = F.format_string("%.3f", F.col("score"))
    # The sentences.
    root = F.concat(
        F.lit("Probable root cause: '"), F.col("service"), F.lit("' ranked #1 (Score: "), score, F.lit(", Confidence: "),
        F.col("confidence"), F.lit("). Temporal evidence: "), F.col("temporal_summary"), F.lit(" Dependency evidence: "),
        F.col("dependency_summary"), F.lit(" Supporting evidence: "), said, F.lit("."))
    other = F.concat(
        F.lit("Observed propagation: '"), F.col("service"), F.lit("' ranked #"), F.col("rank").cast("string"),
        F.lit(" as a "), F.lower("classification"), F.lit(" (Score: "), score, F.lit("). "), F.col("temporal_summary"),
        F.lit(" "), F.col("dependency_summary"), F.lit(" Supporting evidence: "), said, F.lit("."))
    quiet = F.concat(F.lit("Service '"), F.col("service"),
                     F.lit("' exhibited nominal telemetry behavior with 0 detected anomalies."))
    summary = F.when(F.col("anomaly_count") == 0, quiet).when(
        F.col("classification") == "Probable root cause", root).otherwise(other)
    return rows.select(
        *by, "rank", "score", "confidence", "rationale", "classification", "supporting_signals", "contributing_metrics",
        F.struct("earliest_anomaly_time", "onset_delta_seconds", "anomaly_count", "anomaly_ratio",
                 F.col("temporal_summary").alias("summary")).alias("temporal_evidence"),
        F.struct("explainer_depth", "callers", "deps", "anom_callers", "anom_deps", "propagation_role",
                 F.col("dependency_summary").alias("summary")).alias("dependency_evidence"),
        "score_breakdown", summary.alias("summary"), F.array(*[F.lit(v) for v in LIMITATIONS]).alias("limitations"))


def explain_incidents(incidents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per incident: probable root cause, confidence, overall summary and the nested candidates by rank."""
    body = F.struct("rank", *[c for c in candidates.columns if c not in ("incident_id", "rank")])
    lists = candidates.groupBy("incident_id").agg(F.array_sort(F.collect_list(body)).alias("candidates"))
    top = F.col("candidates")[0]
    found = F.coalesce(top["score"] > 0, F.lit(False))
    # The sentences.
    text = (
        F.when(F.col("candidates").isNull(), F.lit("No telemetry candidates available for RCA explanation."))
        .when(~found, F.lit("No anomalous telemetry observed; no probable root cause identified."))
        .otherwise(F.concat(F.lit("Probable root cause identified as '"), top["service"], F.lit("' (Score: "),
                            F.format_string("%.3f", top["score"]), F.lit(", Confidence: "), top["confidence"], F.lit("). "),
                            top["summary"]))
    )
    return incidents.select("incident_id", "start_time", "end_time").join(lists, "incident_id", "left").select(
        "incident_id", "start_time", "end_time", F.when(found, top["service"]).alias("probable_root_cause"),
        F.coalesce(top["confidence"], F.lit("LOW")).alias("confidence"), text.alias("summary"), "candidates")


def explain_root_causes(telemetry: DataFrame, incidents: DataFrame, topology: Topology,
                        anomalies: DataFrame | None = None, config: ExplainConfig = ExplainConfig()) -> DataFrame:
    """Rank and explain in one call, over the topology of the ranking."""
    from opslake.operators.rca import close_windows, evaluation_windows, rca_rank, rca_scores, service_stats, window_facts, with_findings

    incidents = settle(incidents, "incidents")
    rows = settle(with_findings(telemetry, anomalies), "flagged")
    windows = close_windows(evaluation_windows(incidents), rows)
    facts = window_facts(rows, windows)
    ranked = settle(rca_rank(rca_scores(service_stats(rows, windows, topology, facts), topology)), "ranked")
    return explain_incidents(incidents, explain_candidates(ranked, rows, windows, topology, config, facts))
