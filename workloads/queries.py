"""The registered queries: one callable per operator, each over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from opslake.operators import (
    clean, drift, evaluate, explain, features, health, iforest, labels, linear, metrics, prep, rca, topology, validate, zscore)
from opslake.operators.predictor import PredictorConfig, fit_predictor, predict_incidents, top_features
from opslake.operators.severity import fit_severity, predict_severity
from opslake.plans.sizing import settle
from opslake.schema import METRICS
from opslake.session import fresh_path
from opslake.sources import incidents as isource, registry, telemetry as tsource
from opslake.streaming import detect, rollup as srollup, run as srun, state as zstate
from workloads import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Only for the comparison with SQL, never in an operator: added before rounding, so that exact ties such as 50.4740625 round
# alike whatever their last bit is.
NUDGE = 1e-9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as sums differ in their last bits between engines."""
    return df.select(*[
        F.round(F.col(f.name) + NUDGE, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


# sources -------------------------------------------------------------------------------------------------------------

@query
def telemetry_rollup(spark, sf):
    return I.telemetry(spark, sf)


@query
def telemetry_scan(spark, sf):
    """Roll-up written as a date-partitioned table, read back through the loader with its contract check."""
    path = fresh_path(spark, "scan") + ".parquet"
    tsource.write_by_date(I.telemetry(spark, sf), path)
    return tsource.read_telemetry(spark, path, validate=True).drop("date")


@query
def incident_scan(spark, sf):
    return I.scanned_incidents(spark, sf).select(
        F.col("day").cast("string").alias("day"), "ord", "incident_id", "incident_type", "root_cause_service",
        F.coalesce(F.array_join("affected_services", ","), F.lit("-")).alias("affected"), "start_time", "detection_time",
        "end_time", "severity")


@query
def incident_scan_large(spark, sf):
    """The same documents as files of one JSON array each, read in pieces between commas."""
    path = fresh_path(spark, "arrays")
    I.incident_documents(spark, sf).select("text").write.option("maxRecordsPerFile", 1).text(path)
    return isource.scan_incidents(spark, path).select(
        F.substring("incident_id", 5, 10).alias("day"), "ord", "incident_id", "incident_type", "root_cause_service",
        F.coalesce(F.array_join("affected_services", ","), F.lit("-")).alias("affected"), "start_time", "detection_time",
        "end_time", "severity")


@query
def latest_telemetry(spark, sf):
    return tsource.latest(I.telemetry(spark, sf).select("timestamp", "service", "latency_ms", "error_rate"), 500)


@query
def telemetry_summary(spark, sf):
    s = tsource.summary(I.telemetry(spark, sf))
    return s.select("record_count", F.array_join("services", ",").alias("services"), "start_time", "end_time")


@query
def head_tail_split(spark, sf):
    t = I.telemetry(spark, sf).select("timestamp", "service", "latency_ms")
    return tsource.earliest(t, 1000).withColumn("side", F.lit("reference")).unionByName(
        tsource.latest(t, 1000).withColumn("side", F.lit("current")))


@query
def run_leaderboard(spark, sf):
    """Z-score runs at several thresholds as registry rows, ranked by F1; one run lacks the metric."""
    t = I.strained(spark, sf)
    truth = labels.incident_labels(t, I.incidents(spark)).select("timestamp", "service", "is_incident")
    scored = zscore.zscore_anomalies(t).select("timestamp", "service", "anomaly_score").join(truth, ["timestamp", "service"])
    tried = scored.select("is_incident", "anomaly_score", F.explode(F.array(
        *[F.lit(v) for v in (2.0, 2.5, 3.0, 3.5, 4.0)])).alias("cut")).withColumn("flag", F.col("anomaly_score") >= F.col("cut"))
    got = metrics.binary_metrics(tried, "is_incident", "flag", ("cut",))
    f1 = F.when(F.col("cut") != 3.5, F.col("f1_score"))
    runs = got.select(
        F.concat(F.lit("run-"), F.col("cut").cast("string")).alias("run_id"),
        F.when(F.col("cut") == 4.0, "other_model").otherwise("trailing_zscore").alias("model_name"),
        F.concat(F.lit("2024-02-01T00:00:"), F.lpad((F.col("cut") * 10).cast("int").cast("string"), 2, "0"))
        .alias("training_timestamp"),
        F.map_filter(F.create_map(F.lit("precision"), F.col("precision"), F.lit("f1_score"), f1),
                     lambda k, v: v.isNotNull()).alias("metrics"))
    ranked = registry.compare_runs(runs, "trailing_zscore", "f1_score")
    return ranked.select("run_id", "model_name", "metric_value", F.size("metrics").alias("n_metrics"))


# contract and cleaning -----------------------------------------------------------------------------------------------

@query
def validate_rules(spark, sf):
    return validate.validate_rules(I.dirty(spark, sf))


@query
def validate_order(spark, sf):
    return validate.validate_order(I.shuffled_events(spark, sf), "event_id")


@query
def validate_order_spread(spark, sf):
    return validate.validate_order(I.shuffled_events(spark, sf), "event_id", mode="spread")


@query
def validate_incidents(spark, sf):
    return validate.validate_incidents(I.broken_incidents(spark, sf), I.telemetry(spark, sf))


@query
def data_quality(spark, sf):
    d = I.dirty(spark, sf)
    inf = F.lit(float("inf"))
    broken = d.withColumn("latency_ms", F.when(F.col("latency_ms") < 0, inf).otherwise(F.col("latency_ms"))).withColumn(
        "cpu_usage_pct", F.when(F.col("cpu_usage_pct") >= 150, F.lit(float("nan"))).otherwise(F.col("cpu_usage_pct")))
    return validate.quality_counts(broken.drop("disk_usage_pct", "seq"))


@query
def clean_telemetry(spark, sf):
    return clean.clean_telemetry(I.dirty(spark, sf), "seq")


@query
def clean_report(spark, sf):
    return clean.clean_report(I.dirty(spark, sf), "seq")


@query
def dedup_first(spark, sf):
    d = I.dirty(spark, sf).select("timestamp", "service", "cpu_usage_pct", "seq")
    return clean.first_copies(d, ["timestamp", "service"], "seq")


@query
def pre_incident_slice(spark, sf):
    return labels.before_incidents(I.telemetry(spark, sf), I.incidents(spark)).select("timestamp", "service", "latency_ms")


# labels --------------------------------------------------------------------------------------------------------------

@query
def incident_labels(spark, sf):
    return labels.incident_labels(I.telemetry(spark, sf), I.incidents(spark))


@query
def features_ewma(spark, sf):
    t = features.ewma_features(I.telemetry(spark, sf))
    return rounded(t.select("timestamp", "service", "latency_ms_ewma", "error_rate_ewma"))


@query
def incident_labels_many(spark, sf):
    return labels.incident_labels(I.telemetry(spark, sf), I.all_incidents(spark, sf))


@query
def severity_labels(spark, sf):
    return labels.severity_labels(I.telemetry(spark, sf), I.incidents(spark))


@query
def horizon_labels(spark, sf):
    return labels.horizon_labels(I.telemetry(spark, sf), I.incidents(spark), I.HORIZON)


@query
def horizon_labels_lead(spark, sf):
    return labels.horizon_labels(I.telemetry(spark, sf), I.incidents(spark), I.HORIZON, lead_time_only=True)


@query
def active_window_labels(spark, sf):
    return labels.active_window_labels(I.telemetry(spark, sf), I.incidents(spark))


@query
def telemetry_with_anomalies(spark, sf):
    t = I.strained(spark, sf)
    found = zscore.zscore_anomalies(t).where("anomaly_score >= 1").select(
        "timestamp", "service", "anomaly_score", "is_anomaly", F.lit(1.0).alias("latency_ms"))
    return rounded(rca.with_anomalies(t, found).select(
        "timestamp", "service", "cpu_usage_pct", "latency_ms", "anomaly_score", "is_anomaly"))


# features ------------------------------------------------------------------------------------------------------------

CONFIG = features.FeatureConfig()
ROLLING = [f"{m}_roll_{s}_{n}" for m in CONFIG.metrics for n in CONFIG.windows for s in ("mean", "std", "max")]
DELTAS = [f"{m}_{s}_{n}" for m in CONFIG.metrics for n in CONFIG.steps for s in ("delta", "pct_change")]


@query
def features_rolling(spark, sf):
    return rounded(features.history_features(I.telemetry(spark, sf)).select("timestamp", "service", *ROLLING))


@query
def features_rolling_spread(spark, sf):
    return rounded(features.history_features(I.telemetry(spark, sf), mode="spread").select("timestamp", "service", *ROLLING))


@query
def features_delta(spark, sf):
    return rounded(features.history_features(I.telemetry(spark, sf)).select("timestamp", "service", *DELTAS), 4)


@query
def features_interaction(spark, sf):
    return rounded(features.interaction_features(I.telemetry(spark, sf)).select(
        "timestamp", "service", "latency_error_product", "error_per_request", "connection_pressure", "traffic_ratio_in_out"), 4)


@query
def features_cross_service(spark, sf):
    return rounded(features.cross_service_features(I.telemetry(spark, sf)).select(
        "timestamp", "service", "system_mean_latency", "system_max_error_rate", "system_mean_cpu",
        "latency_to_system_mean_ratio"))


@query
def features_all(spark, sf):
    f = rounded(features.extract_features(I.telemetry(spark, sf)), 4)
    return f.select("timestamp", "service", "latency_ms_roll_mean_12", "error_rate_delta_1", "latency_error_product",
                    "system_mean_latency", "latency_to_system_mean_ratio")


@query
def scaler_stats(spark, sf):
    t = I.dirty(spark, sf).drop("seq")
    return rounded(prep.scaler_stats(t, tsource.metric_columns(t)).select(
        "feature", "n", "n_missing", "median", "mean", "std"))


@query
def scaled_features(spark, sf):
    t = I.telemetry(spark, sf)
    cols = ["latency_ms", "error_rate", "cpu_usage_pct"]
    stats = [r.asDict() for r in prep.scaler_stats(t, cols).collect()]
    return rounded(prep.scale(t.select("timestamp", "service", *cols), stats))


@query
def chrono_split(spark, sf):
    t = I.telemetry(spark, sf).select("timestamp", "service")
    return prep.chronological_split(t, 1 - (0.15 + 0.15), 0.15, 0.15)


@query
def chrono_split_spread(spark, sf):
    t = I.telemetry(spark, sf).select("timestamp", "service")
    return prep.chronological_split(t, 1 - (0.15 + 0.15), 0.15, 0.15, mode="spread")


@query
def severity_split(spark, sf):
    lab = labels.severity_labels(I.telemetry(spark, sf), I.incidents(spark)).where(F.col("severity").isNotNull())
    return prep.positional_split(lab, 0.15)


# detectors -----------------------------------------------------------------------------------------------------------

@query
def zscore_baseline(spark, sf):
    z = zscore.zscore_frame(I.telemetry(spark, sf))
    return rounded(z.select("timestamp", "service", "latency_ms_base_mean", "latency_ms_base_std", "error_rate_base_mean",
                            "error_rate_base_std"))


@query
def zscore_anomalies(spark, sf):
    return zscore.zscore_anomalies(I.telemetry(spark, sf))


@query
def zscore_anomalies_spread(spark, sf):
    return zscore.zscore_anomalies(I.telemetry(spark, sf), mode="spread")


@query
def flagged_anomalies(spark, sf):
    return zscore.zscore_anomalies(I.strained(spark, sf)).where("is_anomaly")


@query
def iforest_imputed_medians(spark, sf):
    """Medians that fill gaps at scoring: of every feature, whether or not training has gaps in it."""
    t = I.telemetry(spark, sf)
    found = iforest.feature_medians(t, list(iforest.ForestConfig().features))
    return spark.createDataFrame(sorted(found.items()), "feature string, median double").withColumn("median", F.round("median", 9))


def _early_forest(spark, sf, **config):
    t = I.telemetry(spark, sf)
    train = labels.before_incidents(t, I.incidents(spark))
    return t, iforest.fit_forest(train, iforest.ForestConfig(**config))


@query
def iforest_tree_account(spark, sf):
    """Certifies the trees: each holds its sample once in its leaves and is no deeper than its limit."""
    _, m = _early_forest(spark, sf)
    leaf = F.col("feature") < 0
    limit = F.ceil(F.log2(F.greatest(F.max("sample"), F.lit(2))))
    return m.nodes.groupBy("model", "tree").agg(
        F.max("sample").alias("sample"), F.sum(F.when(leaf, F.col("size"))).alias("in_leaves"),
        F.count_if(~leaf).alias("_inner"), F.count_if(leaf).alias("_leaves"), (F.max("depth") <= limit).alias("within_limit")).select(
        "model", "tree", "sample", "in_leaves", (F.col("_leaves") == F.col("_inner") + 1).alias("is_binary"), "within_limit")


@query
def iforest_round_trip(spark, sf):
    """Certifies saving and both scoring plans: rows, and rows that a reloaded global forest or the other plan scores differently."""
    t, m = _early_forest(spark, sf, per_service=False)
    path = fresh_path(spark, "forest")
    m.save(path)
    loaded = iforest.ForestModel.load(spark, path)
    base = iforest.predict_forest(t, m)
    other = [iforest.predict_forest(t, loaded).withColumn("side", F.lit("reloaded")), iforest.predict_forest(t, loaded, "spread").withColumn(
        "side", F.lit("cogroup"))]
    both = other[0].unionByName(other[1]).join(base.select("timestamp", "service", F.col("anomaly_score").alias("s"), F.col("is_anomaly").alias("f")),
                                               ["timestamp", "service"], "left")
    same = F.col("anomaly_score").eqNullSafe(F.col("s")) & F.col("is_anomaly").eqNullSafe(F.col("f"))
    return both.groupBy("side").agg(F.count("*").alias("n_rows"), F.count_if(~same).alias("n_different"), (F.count_if("is_anomaly") > 0).alias("has_flags"))


@query
def contamination_flags(spark, sf):
    """Quantile threshold learned before the first incident, applied to all rows, on z-scores."""
    z = zscore.zscore_anomalies(I.strained(spark, sf)).select("timestamp", "service", "anomaly_score")
    cut = iforest.score_thresholds(labels.before_incidents(z, I.incidents(spark)), 0.05, "service", "anomaly_score")
    return z.join(cut.select("service", F.round("threshold", 9).alias("threshold")), "service", "left").select(
        "timestamp", "service", "anomaly_score", (F.col("anomaly_score") > F.col("threshold")).alias("is_anomaly"))


@query
def iforest_model_nodes(spark, sf):
    model = iforest.fit_forest(labels.before_incidents(I.telemetry(spark, sf), I.incidents(spark)))
    return model.nodes


@query
def iforest_anomalies(spark, sf):
    return iforest.detect_with_forest(I.strained(spark, sf), incidents=I.incidents(spark))


@query
def iforest_anomalies_cogroup(spark, sf):
    """The same forest scored by shuffle instead of broadcast."""
    t = I.strained(spark, sf)
    model = iforest.fit_forest(labels.before_incidents(t, I.incidents(spark)))
    return iforest.predict_forest(t, model, mode="spread")


@query
def detector_benchmark(spark, sf):
    return evaluate.detector_benchmark(I.strained(spark, sf), I.incidents(spark))


def _labelled_features(spark, sf):
    t = I.strained(spark, sf)
    feats = features.extract_features(t)
    return feats.join(labels.horizon_labels(t, I.incidents(spark), I.HORIZON), ["timestamp", "service"])


@query
def incident_predictions(spark, sf):
    rows = settle(prep.chronological_split(_labelled_features(spark, sf)), "labelled")
    return predict_incidents(rows, fit_predictor(rows.where("split = 'train'")))


@query
def top_features_report(spark, sf):
    rows = settle(prep.chronological_split(_labelled_features(spark, sf)), "labelled")
    return top_features(spark, fit_predictor(rows.where("split = 'train'")))


@query
def severity_predictions(spark, sf):
    t = I.strained(spark, sf)
    lab = labels.severity_labels(t, I.incidents(spark)).where(F.col("severity").isNotNull())
    rows = settle(t.join(lab, ["timestamp", "service"]), "labelled")
    return predict_severity(rows, fit_severity(rows))


def _certified(gradients: DataFrame) -> DataFrame:
    """What certifies the optimum: per class the largest gradient of the penalised loss, zero to four places."""
    return gradients.groupBy("class").agg(F.round(F.max(F.abs("gradient")), 4).alias("largest_gradient"))


@query
def predictor_certificate(spark, sf):
    rows = settle(prep.chronological_split(_labelled_features(spark, sf)), "labelled").where("split = 'train'")
    label = "is_incident_in_horizon"
    rows = rows.withColumn(label, F.col(label).cast("int"))
    return _certified(linear.optimality(rows, label, fit_predictor(rows)))


@query
def severity_certificate(spark, sf):
    t = I.strained(spark, sf)
    lab = labels.severity_labels(t, I.incidents(spark)).where(F.col("severity").isNotNull())
    rows = settle(t.join(lab, ["timestamp", "service"]), "labelled")
    return _certified(linear.optimality(rows, "severity", fit_severity(rows)))


@query
def incident_evaluation(spark, sf):
    done = evaluate.evaluate_incidents(I.strained(spark, sf), I.incidents(spark), PredictorConfig(horizon_seconds=I.HORIZON),
                                       0.2, 0.2)
    return done.prediction.withColumn("lead_time_seconds", done.lead_time.scalar()).withColumn(
        "severity_macro_f1", done.severity.agg(F.max("macro_f1")).scalar())


# root cause ----------------------------------------------------------------------------------------------------------

@query
def topology_depth(spark, sf):
    return topology.longest_depth(*I.entity_graph(spark, sf))


@query
def topology_cycles(spark, sf):
    return topology.cycles(*I.looped_graph(spark, sf))


@query
def topology_depth_condensed(spark, sf):
    return topology.condensed_depth(*I.looped_graph(spark, sf))


def _flagged(spark, sf):
    t = I.strained(spark, sf)
    kept = tuple(tsource.metric_columns(t))
    return rca.with_anomalies(zscore.zscore_anomalies(t, keep=kept).drop("anomalous_metrics"))


def _windows(spark, sf):
    return rca.evaluation_windows(I.all_incidents(spark, sf))


def _stats(spark, sf):
    return rca.service_stats(_flagged(spark, sf), _windows(spark, sf), topology.Topology.from_map(spark))


def _ranked(spark, sf):
    topo = topology.Topology.from_map(spark)
    return rca.rca_rank(rca.rca_scores(_stats(spark, sf), topo))


@query
def rca_service_stats(spark, sf):
    return rounded(_stats(spark, sf).select(
        "incident_id", "service", "total_samples", "anomaly_count", "anomaly_ratio", "earliest_ts", "mean_anomaly_score",
        "max_anomaly_score", "max_conn_util", "max_error_rate"))


@query
def rca_scores(spark, sf):
    scored = rca.rca_scores(_stats(spark, sf), topology.Topology.from_map(spark))
    return rounded(scored.select("incident_id", "service", "temporal", "topology", "severity", "raw_score", "score"), 4)


@query
def rca_rank(spark, sf):
    return _ranked(spark, sf).select("incident_id", "service", "rank", "score", "anomaly_count", "is_root_cause_candidate")


@query
def rca_top_k(spark, sf):
    return rca.top_k(_ranked(spark, sf), 3).select("incident_id", "rank", "service")


@query
def rca_explanations(spark, sf):
    done = explain.explain_root_causes(_flagged(spark, sf), I.all_incidents(spark, sf), topology.Topology.from_map(spark))
    return done.select("incident_id", "probable_root_cause", "confidence", "summary",
                       F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"))


@query
def rca_root_causes(spark, sf):
    """The verdict per incident, without the texts."""
    done = explain.explain_root_causes(_flagged(spark, sf), I.all_incidents(spark, sf), topology.Topology.from_map(spark))
    return done.select("incident_id", "probable_root_cause", "confidence")


@query
def evidence_metrics(spark, sf):
    m = explain.evidence_metrics(I.strained(spark, sf), _windows(spark, sf))
    return rounded(m.select("incident_id", "service", "metric", F.col("peak").alias("peak_value"),
                            F.col("mean").alias("mean_value")), 4)


@query
def evidence_signals(spark, sf):
    s = explain.evidence_signals(explain.evidence_metrics(I.strained(spark, sf), _windows(spark, sf)))
    return s.select("incident_id", "service", F.array_join("signal_metrics", ",").alias("signal_metrics"))


@query
def evidence_temporal(spark, sf):
    return explain.evidence_temporal(_ranked(spark, sf)).select(
        "incident_id", "service", "earliest_anomaly_time", "onset_delta_seconds", "anomaly_count")


@query
def evidence_dependency(spark, sf):
    d = explain.evidence_dependency(_ranked(spark, sf), topology.Topology.from_map(spark))
    return d.select("incident_id", "service", "explainer_depth", "propagation_role",
                    F.array_join("anom_callers", ",").alias("anom_callers"), F.array_join("anom_deps", ",").alias("anom_deps"))


@query
def rca_confidence(spark, sf):
    return rounded(explain.rca_confidence(_ranked(spark, sf)).select("incident_id", "service", "margin", "confidence"), 4)


@query
def rca_classification(spark, sf):
    return explain.rca_classification(_ranked(spark, sf), topology.Topology.from_map(spark))


# evaluation ----------------------------------------------------------------------------------------------------------

def _detected(spark, sf):
    t = I.strained(spark, sf)
    return zscore.zscore_anomalies(t), labels.incident_labels(t, I.incidents(spark))


@query
def anomaly_metrics(spark, sf):
    return metrics.anomaly_metrics(*_detected(spark, sf))


@query
def zscore_benchmark(spark, sf):
    """The statistical row of the detector comparison: rates and the mean delay."""
    flagged, truth = _detected(spark, sf)
    delay = metrics.mean_detection_delay(metrics.detection_delays(flagged, I.incidents(spark)))
    return metrics.anomaly_metrics(flagged, truth).withColumn(
        "detection_delay_seconds", delay.select("detection_delay_seconds").scalar()).select(
        F.lit("statistical_baseline").alias("detector"), "precision", "recall", "f1_score", "false_positive_rate",
        "detection_delay_seconds")


@query
def detection_delay(spark, sf):
    return metrics.detection_delays(_detected(spark, sf)[0], I.all_incidents(spark, sf))


@query
def prediction_lead_time(spark, sf):
    alerts = _detected(spark, sf)[0].withColumnRenamed("is_anomaly", "is_predicted_incident")
    return metrics.lead_times(alerts, I.all_incidents(spark, sf), I.HORIZON)


@query
def binary_metrics(spark, sf):
    flagged, truth = _detected(spark, sf)
    both = flagged.join(truth, ["timestamp", "service"])
    return metrics.binary_metrics(both, "is_incident", "is_anomaly", ("service",)).select(
        "service", "total_samples", "precision", "recall", "f1_score")


@query
def roc_auc(spark, sf):
    return evaluate.zscore_score_quality(*_detected(spark, sf)).select("roc_auc", "positive_samples", "negative_samples")


@query
def average_precision(spark, sf):
    return evaluate.zscore_score_quality(*_detected(spark, sf)).select("pr_auc")


@query
def average_precision_spread(spark, sf):
    return evaluate.zscore_score_quality(*_detected(spark, sf), mode="spread").select("pr_auc", "roc_auc")


@query
def severity_confusion(spark, sf):
    return metrics.severity_confusion(I.severity_pairs(spark, sf))


@query
def severity_metrics(spark, sf):
    return metrics.severity_metrics(I.severity_pairs(spark, sf))


@query
def rca_metrics(spark, sf):
    return metrics.rca_metrics(_ranked(spark, sf), I.all_incidents(spark, sf))


@query
def metric_degradation(spark, sf):
    """Detector rates of the first half of the month against the second half."""
    flagged, truth = _detected(spark, sf)
    both = flagged.join(truth, ["timestamp", "service"]).withColumn(
        "late", F.col("timestamp") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    got = metrics.binary_metrics(both, "is_incident", "is_anomaly", ("late",)).unpivot(
        ["late"], ["precision", "recall", "f1_score", "false_positive_rate"], "metric", "value")
    return metrics.metric_degradation(got.where("NOT late"), got.where("late"), 0.10)


# drift and health ----------------------------------------------------------------------------------------------------

def _counts(spark, sf, mode="auto"):
    ref, cur = I.drift_sides(spark, sf)
    shared, _ = drift.compared_features(ref, cur)
    return settle(drift.value_counts(ref, cur, shared, mode), "counts")


@query
def drift_psi(spark, sf):
    counts = _counts(spark, sf)
    return rounded(drift.psi_values(counts, drift.feature_shape(counts)), 4)


@query
def drift_psi_spread(spark, sf):
    counts = _counts(spark, sf, "spread")
    return rounded(drift.psi_values(counts, drift.feature_shape(counts)), 4)


@query
def drift_ks(spark, sf):
    return rounded(drift.feature_shape(_counts(spark, sf)).select(
        "feature", "ref_count", "cur_count", "ks_statistic", "ks_p_value"))


@query
def drift_verdicts(spark, sf):
    return drift.feature_drift(*I.drift_sides(spark, sf)).drop("message")


@query
def drift_ks_exact(spark, sf):
    """Exact p-values, also of weak differences: each metric of one service against the same metric of all others."""
    t = I.telemetry(spark, sf)
    return rounded(drift.feature_shape(drift.value_counts(t.where("service = 'database'"), t.where("service <> 'database'"), METRICS)).select(
        "feature", "ref_count", "cur_count", "ks_statistic", "ks_p_value"))


@query
def drift_messages(spark, sf):
    """The sentence per feature; the p-value in it is cut to the exponent's sign, as SQL subtracts from 1."""
    d = drift.feature_drift(*I.drift_sides(spark, sf))
    return d.select("feature", F.regexp_replace("message", r", p=.*", "").alias("message"))


@query
def drift_summary(spark, sf):
    ref, cur = I.drift_sides(spark, sf)
    r = drift.drift_report(drift.feature_drift(ref, cur), ref, cur)
    return r.select("reference_count", "current_count", F.array_join("drifted_features", ",").alias("drifted_features"),
                    F.array_join("warning_features", ",").alias("warning_features"), "has_drift", "drift_share")


@query
def prediction_distribution(spark, sf):
    return health.prediction_distribution(zscore.zscore_anomalies(I.strained(spark, sf)))


@query
def model_health(spark, sf):
    ref, cur = I.drift_sides(spark, sf)
    h = health.model_health(cur, ref, latency_ms=620.0)
    return h.select("model_name", "health_status", "quality_issues", "drifted_features", "warning_features", "drift_share",
                    F.size("status_reasons").alias("n_reasons"))


@query
def episode_union(spark, sf):
    """Two strained episodes and a plain one as one stream of telemetry."""
    t, heavy = I.telemetry(spark, sf), I.strained(spark, sf)
    mid, last = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21"))
    first = heavy.where(F.col("timestamp") < mid)
    second = heavy.where((F.col("timestamp") >= mid) & (F.col("timestamp") < last))
    third = t.where(F.col("timestamp") >= last)
    joined = first.withColumn("episode", F.lit(1)).unionByName(second.withColumn("episode", F.lit(2))).unionByName(
        third.withColumn("episode", F.lit(3)))
    return rounded(joined.select("episode", "timestamp", "service", "latency_ms", "error_rate", "active_connections"))


# streaming -----------------------------------------------------------------------------------------------------------

def _event_stream(spark, sf):
    batch = I.table(spark, sf, "events")
    return srun.table_stream(spark, f"{sf}/events.parquet", batch.schema)


@query
def stream_rollup(spark, sf):
    return srun.run_to_table(srollup.stream_telemetry(_event_stream(spark, sf)))


@query
def stream_dedup(spark, sf):
    events = _event_stream(spark, sf)
    doubled = events.unionByName(_event_stream(spark, sf).where("event_id % 10 = 0"))
    return srun.run_to_table(srollup.stream_distinct(doubled, ["event_id"])).select("event_id", "user_id", "event_type", "value")


@query
def stream_zscore(spark, sf):
    scores, _ = detect.stream_zscores(srollup.stream_telemetry(_event_stream(spark, sf)))
    return scores


@query
def stream_zscore_state(spark, sf):
    """The streamed roll-up lands in three periods; the stateful query is stopped and restarted for each of them."""
    rolled = srun.run_to_table(srollup.stream_telemetry(_event_stream(spark, sf)))
    landed, out, checkpoint = (fresh_path(spark, f"zstate-{n}") for n in ("in", "out", "offsets"))
    edges = ["0001-01-01", "2024-01-11", "2024-01-21", "9999-01-01"]
    for start, end in zip(edges, edges[1:]):
        inside = (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
        rolled.where(inside).write.mode("append").parquet(landed)
        scores, _ = zstate.stream_zscores_by_state(srun.table_stream(spark, landed, rolled.schema), out=out, checkpoint=checkpoint)
    return scores


def _batched(spark, sf, handler):
    out = fresh_path(spark, "batches")
    srun.run_batches(srollup.stream_telemetry(_event_stream(spark, sf)), handler(out))
    return spark.read.option("recursiveFileLookup", True).parquet(out)


@query
def stream_labels(spark, sf):
    return _batched(spark, sf, lambda out: detect.label_batches(I.incidents(spark), out))


@query
def stream_forest(spark, sf):
    model = iforest.fit_forest(labels.before_incidents(I.telemetry(spark, sf), I.incidents(spark)))
    return _batched(spark, sf, lambda out: detect.forest_batches(model, out))


@query
def stream_drift(spark, sf):
    ref = I.drift_sides(spark, sf)[0].drop("flat", "jump", "lost")
    return _batched(spark, sf, lambda out: detect.drift_batches(ref, out)).drop("batch_id", "message")
