"""Evaluation of detectors, predictors, classifiers and rankings against ground truth."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslake.functions.scalars import ratio, seconds_between, shift_seconds
from opslake.operators.labels import affected
from opslake.plans.nextevent import next_event
from opslake.plans.ordering import running_totals
from opslake.schema import SEVERITIES


def _n(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def confusion(predictions: DataFrame, labels: DataFrame, flag: str, truth: str, by: tuple[str, ...] = ()) -> DataFrame:
    """True and false positives and negatives after a join on (timestamp, service).

    Both sides must hold the same keys: ``total_samples`` and ``unmatched`` tell whether they did. With ``by``, labels
    without a prediction form a group of their own, whose ``by`` columns are null.
    """
    both = predictions.select("timestamp", "service", *by, F.col(flag).alias("_p"), F.lit(True).alias("_has_p")).join(
        labels.select("timestamp", "service", F.col(truth).alias("_t"), F.lit(True).alias("_has_t")),
        ["timestamp", "service"], "full")
    p, t = F.col("_p"), F.col("_t")
    grouped = both.groupBy(*by) if by else both.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total_samples"), _n(p & t).alias("true_positives"), _n(p & ~t).alias("false_positives"),
        _n(~p & ~t).alias("true_negatives"), _n(~p & t).alias("false_negatives"),
        _n(F.col("_has_p").isNull() | F.col("_has_t").isNull()).alias("unmatched"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate to 4 places, 0 where a denominator is 0."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(ratio(F.lit(2.0) * p * r, p + r), 4).alias("f1_score"),
        F.round(ratio(fp, fp + tn), 4).alias("false_positive_rate"))


def anomaly_metrics(predictions: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rates(confusion(predictions, labels, "is_anomaly", "is_incident", by))


def _watched(incidents: DataFrame, begin: Column, end: Column, match_all: bool) -> tuple[DataFrame, DataFrame]:
    """Ranges to look for alerts in: on the root service, else on the affected ones; else (if asked) on every service."""
    root = F.col("root_cause_service")
    base = incidents.select("incident_id", "start_time", begin.alias("from_ts"), end.alias("to_ts"),
                            F.when(root.isNotNull(), F.array(root)).otherwise(affected()).alias("_on"))
    named = base.withColumn("service", F.explode(F.array_distinct("_on"))).drop("_on")
    rest = base.where(F.size("_on") == 0).drop("_on")
    return named, rest if match_all else rest.limit(0)


def _first_alerts(alerts: DataFrame, named: DataFrame, rest: DataFrame, until_open: bool) -> DataFrame:
    """The first alert of each range that has one; a range looks up one alert, whatever else lies in it."""
    ok = F.col("_next") < F.col("to_ts") if until_open else F.col("_next") <= F.col("to_ts")
    hits = [next_event(named, alerts, "from_ts", ["service"], "_next")]
    if not rest.isEmpty():
        hits.append(next_event(rest, alerts, "from_ts", [], "_next"))
    found = [h.where(ok).select("incident_id", "start_time", "_next") for h in hits]
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).groupBy("incident_id").agg(
        F.min("start_time").alias("start_time"), F.min("_next").alias("first_alert"))


def detection_delays(predictions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per detected incident: seconds from its start to the first flagged row inside it."""
    alerts = predictions.where("is_anomaly").select("timestamp", "service")
    first = _first_alerts(alerts, *_watched(incidents, F.col("start_time"), F.col("end_time"), False), until_open=False)
    return first.select("incident_id", F.greatest(
        F.lit(0.0), seconds_between(F.col("start_time"), F.col("first_alert"))).alias("delay_seconds"))


def mean_detection_delay(delays: DataFrame) -> DataFrame:
    """Mean over detected incidents, null when none was detected."""
    return delays.agg(F.round(F.avg("delay_seconds"), 2).alias("detection_delay_seconds"),
                      F.count(F.lit(1)).alias("detected"))


def lead_times(predictions: DataFrame, incidents: DataFrame, horizon_seconds: float,
               flag: str = "is_predicted_incident") -> DataFrame:
    """Per alerted incident: seconds from the first alert in the horizon before its start to the start."""
    alerts = predictions.where(flag).select("timestamp", "service")
    begin = shift_seconds(F.col("start_time"), -horizon_seconds)
    first = _first_alerts(alerts, *_watched(incidents, begin, F.col("start_time"), True), until_open=True)
    return first.select("incident_id", F.greatest(
        F.lit(0.0), seconds_between(F.col("first_alert"), F.col("start_time"))).alias("lead_seconds"))


def score_curve(scored: DataFrame, truth: str, score: str, by: tuple[str, ...] = (), mode: str = "auto") -> DataFrame:
    """Positives and negatives per distinct score with running and whole totals."""
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        _n(F.col(truth)).alias("pos"), _n(~F.col(truth)).alias("neg"))
    return running_totals(counts, by, ["score"], {"cum_pos": "pos", "cum_neg": "neg"}, mode)


def ranking_quality(scored: DataFrame, truth: str, score: str, by: tuple[str, ...] = (), mode: str = "auto") -> DataFrame:
    """ROC-AUC with ties shared and average precision (step sum), 1 with only positives and 0 with none."""
    curve = score_curve(scored, truth, score, by, mode)
    pos, neg = F.col("cum_pos_total"), F.col("cum_neg_total")
    below = F.col("pos") * (F.col("cum_neg") - F.col("neg") / F.lit(2.0))
    at_or_above = pos - F.col("cum_pos") + F.col("pos")
    all_above = at_or_above + neg - F.col("cum_neg") + F.col("neg")
    step = F.col("pos") * at_or_above / all_above
    sums = curve.groupBy(*by).agg(F.sum(below).alias("_auc"), F.sum(step).alias("_ap"), F.max(pos).alias("positive_samples"),
                                  F.max(neg).alias("negative_samples"))
    p, n = F.col("positive_samples"), F.col("negative_samples")
    edge = F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    both = (p > 0) & (n > 0)
    return sums.select(
        *by, F.when(both, F.round(F.col("_auc") / (p * n), 4)).otherwise(edge).alias("roc_auc"),
        F.when(both, F.round(F.col("_ap") / p, 4)).otherwise(edge).alias("pr_auc"), "positive_samples", "negative_samples")


def binary_metrics(rows: DataFrame, truth: str, flag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of a flag held beside its truth."""
    p, t = F.col(flag), F.col(truth)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"), _n(p & t).alias("true_positives"), _n(p & ~t).alias("false_positives"),
        _n(~p & ~t).alias("true_negatives"), _n(~p & t).alias("false_negatives"))
    return rates(counts)


def severity_confusion(rows: DataFrame, truth: str = "severity", predicted: str = "predicted_severity",
                       labels: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """``true_label, predicted_label, n`` over the full grid of labels; the grid is labels x labels."""
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in labels])).alias("true_label")).select(
        "true_label", F.explode(F.array(*[F.lit(v) for v in labels])).alias("predicted_label"))
    counts = rows.groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["true_label", "predicted_label"], "left").select(
        "true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def severity_metrics(rows: DataFrame, truth: str = "severity", predicted: str = "predicted_severity",
                     labels: tuple[str, ...] | None = None) -> DataFrame:
    """Per target label: precision, recall, F1 and support; beside it the macro F1 over the labels that occur.

    Labels default to the four severities when all that occurs is among them. A single known label widens to the four.
    """
    pairs = rows.groupBy(F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    per = pairs.select(F.inline(F.array(
        F.struct(F.col("_t").alias("label"), F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0).alias("hit"),
                 F.col("_n").alias("of_true"), F.lit(0).cast("bigint").alias("of_pred")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("of_true"),
                 F.col("_n").alias("of_pred"))))).groupBy("label").agg(
        F.sum("hit").alias("hit"), F.sum("of_true").alias("of_true"), F.sum("of_pred").alias("of_pred"))
    p, r = ratio(F.col("hit"), F.col("of_pred")), ratio(F.col("hit"), F.col("of_true"))
    scored = per.select("label", p.alias("_p"), r.alias("_r"), ratio(F.lit(2.0) * p * r, p + r).alias("_f"),
                        F.col("of_true").alias("support"))
    macro = scored.agg(F.coalesce(F.round(F.avg("_f"), 4), F.lit(0.0))).scalar()
    if labels is not None:
        target = SEVERITIES if len(labels) == 1 and labels[0] in SEVERITIES else tuple(labels)
        wanted = F.array(*[F.lit(v) for v in target])
    else:
        known = F.array(*[F.lit(v) for v in SEVERITIES])
        present = scored.agg(F.array_sort(F.collect_list("label"))).scalar()
        wanted = F.when(F.size(F.array_except(present, known)) == 0, known).otherwise(present)
    out = rows.sparkSession.range(1).select(F.explode(wanted).alias("label")).join(scored, "label", "left")
    zero = F.lit(0.0)
    return out.select(
        "label", F.coalesce(F.round("_p", 4), zero).alias("precision"), F.coalesce(F.round("_r", 4), zero).alias("recall"),
        F.coalesce(F.round("_f", 4), zero).alias("f1_score"),
        F.coalesce("support", F.lit(0)).cast("bigint").alias("support"), macro.alias("macro_f1"))


def rca_hits(ranked: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident with a known root: its rank (null if not found) and the top candidate."""
    truth = incidents.select("incident_id", F.col("root_cause_service").alias("service"))
    top = ranked.where(F.col("rank") == 1).select("incident_id", F.col("service").alias("predicted_top_1"))
    found = truth.where(F.coalesce("service", F.lit("")) != "").join(
        ranked.select("incident_id", "service", "rank"), ["incident_id", "service"], "left")
    return found.join(top, "incident_id", "left").select(
        "incident_id", F.col("service").alias("ground_truth_root"), "predicted_top_1", F.col("rank").alias("actual_rank"),
        F.coalesce(F.col("rank") == 1, F.lit(False)).alias("top_1_hit"),
        F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("top_3_hit"))


def rca_metrics(ranked: DataFrame, incidents: DataFrame) -> DataFrame:
    """Top-1 and top-3 accuracy and mean reciprocal rank over incidents with ground truth."""
    hits = rca_hits(ranked, incidents)
    valid = F.col("valid_evaluations")
    total = incidents.agg(F.count(F.lit(1))).scalar()
    return hits.agg(
        F.count(F.lit(1)).alias("valid_evaluations"), _n(F.col("top_1_hit")).alias("_one"),
        _n(F.col("top_3_hit")).alias("_three"),
        F.coalesce(F.sum(F.lit(1.0) / F.col("actual_rank")), F.lit(0.0)).alias("_mrr"),
    ).withColumn("total_incidents", total).select(
        F.round(ratio(F.col("_one"), valid), 4).alias("top_1_accuracy"),
        F.round(ratio(F.col("_three"), valid), 4).alias("top_3_accuracy"),
        F.round(ratio(F.col("_mrr"), valid), 4).alias("mean_reciprocal_rank"),
        "total_incidents", "valid_evaluations", (F.col("total_incidents") - valid).alias("missing_ground_truth"))


def metric_degradation(baseline: DataFrame, current: DataFrame, max_drop: float = 0.05, relative: bool = True) -> DataFrame:
    """``metric, baseline, current, drop, degraded`` for metrics on both sides; inputs are ``(metric, value)``."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(
        current.select("metric", F.col("value").alias("current")), "metric")
    drop = F.col("baseline") - F.col("current")
    if relative:
        drop = drop / F.greatest(F.abs("baseline"), F.lit(1e-6))
    return both.select("metric", "baseline", "current", F.round(drop, 4).alias("drop"), (drop > max_drop).alias("degraded"))
