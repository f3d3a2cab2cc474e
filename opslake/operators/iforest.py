"""Isolation forest (Liu, Ting, Zhou 2008): trees are drawn, grown and applied as Spark jobs.

Sampling is keyed by row content, so the forest does not depend on partitioning or on row order. Each tree grows in its own
group of at most ``max_samples`` rows; scoring is one Arrow pass over the partitions.
"""
from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opslake.functions.scalars import finite
from opslake.plans.keys import null_safe_join
from opslake.plans.ordering import quantiles
from opslake.plans.sizing import broadcast_if_small, settle, use_spread_plan
from opslake.operators.labels import before_incidents

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = ("model string, tree int, node int, feature int, threshold double, left int, right int, depth int, "
               "size bigint, sample bigint")
# A forest with more nodes than this is shipped by a shuffle (cogroup), not by a broadcast.
BROADCAST_NODES = 2_000_000
ROWS_PER_SALT = 500_000
OVERDRAW = 2.0


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 100
    contamination: float | str = 0.05
    max_samples: int = 256
    seed: int = 42
    per_service: bool = True
    features: tuple[str, ...] = (
        "latency_ms", "error_rate", "cpu_usage_pct", "memory_usage_pct", "disk_usage_pct", "network_in_mbps",
        "network_out_mbps", "request_rate_rps", "active_connections", "connection_utilization")


@dataclass
class ForestModel:
    """Node table, training medians (one per feature) and the score threshold of each model (one row per model)."""
    nodes: DataFrame
    medians: dict[str, float]
    thresholds: DataFrame
    config: ForestConfig
    features: list[str]

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
        rows = [(f, float(self.medians[f]), i) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, "feature string, median double, pos int").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/medians")
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "config string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        saved = json.loads(spark.read.parquet(f"{path}/config").first()["config"])
        config = ForestConfig(**{**saved, "features": tuple(saved["features"])})
        rows = spark.read.parquet(f"{path}/medians").orderBy("pos").collect()
        return cls(spark.read.parquet(f"{path}/nodes"), {r["feature"]: r["median"] for r in rows},
                   spark.read.parquet(f"{path}/thresholds"), config, [r["feature"] for r in rows])


def average_path(n):
    """Mean depth of an unsuccessful search among n items: the path length credited to a leaf of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, out))


def _inputs(df: DataFrame, config: ForestConfig, features: list[str], medians: dict[str, float]) -> DataFrame:
    model = F.col("service").cast("string") if config.per_service else F.lit("all")
    return df.select("timestamp", "service", model.alias("model"), *[
        F.coalesce(finite(F.col(c)), F.lit(float(medians.get(c, 0.0)))).alias(c) for c in features])


def feature_medians(train: DataFrame, features: list[str], mode: str = "auto") -> dict[str, float]:
    """Training medians over all services, of every feature in one pass; rows to come may have gaps where these have none."""
    from opslake.operators.prep import long_values

    if train.isEmpty():
        raise ValueError("no training rows")
    found = dict.fromkeys(features, 0.0)
    for r in quantiles(long_values(train, features), ["feature"], "value", {"median": 0.5}, mode).collect():
        found[r["feature"]] = r["median"] or 0.0
    return found


def draw_samples(rows: DataFrame, config: ForestConfig) -> DataFrame:
    """``max_samples`` rows per (model, tree) without replacement, uniformly by content hash.

    A tree needs only rows with small hash. A row-level gate first keeps a pool that is ample for all trees of a model, and
    only pool rows are tried against each tree, so a huge history costs one hash per row and sends almost nothing on.
    """
    n = F.col("_n").cast("double")
    want = F.lit(OVERDRAW * config.max_samples)
    pool = F.least(F.lit(1.0), F.lit(4.0 * config.trees) * want / n)
    sizes = broadcast_if_small(settle(
        rows.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2), "sizes"))
    key = [F.col("timestamp"), F.col("service")]

    def unit(*parts):
        return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double")) / F.lit(float(1 << 52))

    gated = (
        rows.join(sizes, "model")
        .where(unit(F.lit(config.seed), F.lit(-1), *key) < pool)
        .withColumn("_p", F.least(F.lit(1.0), want / n) / pool)
        .withColumn("_row", F.xxhash64(F.lit(config.seed), *key))
        .withColumn("tree", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(config.trees - 1)), lambda t: unit(F.col("_row"), t) < F.col("_p"))))
        .withColumn("_draw", F.xxhash64("_row", "tree"))
    )
    ranked = Window.partitionBy("model", "tree").orderBy(
        F.pmod("_draw", F.lit(1 << 52)), "timestamp", "service")
    # Growing a tree costs time, not bytes, so the groups are spread by number and not merged by their small size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        gated.repartition(tasks, "model", "tree")
        .withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= config.max_samples)
        .drop("_p", "_n", "_row", "_draw")
    )


def _grow(values: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """One random isolation tree, grown a level at a time; leaves have feature -1.

    Rows are kept in node order, so the ranges of all nodes of a level come from one segmented minimum and maximum.
    """
    limit = math.ceil(math.log2(max(len(values), 2)))
    rows, starts, ids = np.arange(len(values)), np.array([0]), np.array([0])
    used, levels = 1, []
    for depth in range(limit + 1):
        part = values[rows]
        low, high = np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts)
        sizes = np.diff(np.append(starts, len(rows)))
        is_open = high > low
        splits = is_open.any(axis=1) & (depth < limit)
        draw = np.where(is_open, rng.random(is_open.shape), -1.0)
        feature = np.where(splits, draw.argmax(axis=1), -1)
        at = np.arange(len(ids)), np.maximum(feature, 0)
        span = high[at] - low[at]
        cut = low[at] + rng.random(len(ids)) * span
        cut = np.where(splits, np.where(cut >= high[at], low[at], cut), 0.0)
        left = np.where(splits, used + 2 * (np.cumsum(splits) - 1), -1)
        levels.append(pd.DataFrame({"node": ids, "feature": feature, "threshold": cut, "left": left,
                                    "right": np.where(splits, left + 1, -1), "depth": depth, "size": sizes}))
        if not splits.any():
            break
        node_of = np.repeat(np.arange(len(ids)), sizes)
        inner = splits[node_of]
        goes_right = values[rows, np.maximum(feature[node_of], 0)] > cut[node_of]
        child = np.where(goes_right, left[node_of] + 1, left[node_of])[inner]
        order = np.argsort(child, kind="stable")
        rows, child = rows[inner][order], child[order]
        ids, starts = np.unique(child, return_index=True)
        used += 2 * int(splits.sum())
    return pd.concat(levels, ignore_index=True)


def fit_nodes(rows: DataFrame, config: ForestConfig, features: list[str]) -> DataFrame:
    """The node table; every (model, tree) group is at most ``max_samples`` rows and grows from its own seed."""
    seed, names = config.seed, list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        model, tree = str(pdf["model"].iloc[0]), int(pdf["tree"].iloc[0])
        digest = hashlib.sha256(f"{seed}/{model}/{tree}".encode()).digest()
        out = _grow(pdf[names].to_numpy(dtype=float), np.random.default_rng(int.from_bytes(digest[:8], "big")))
        out.insert(0, "tree", tree)
        out.insert(0, "model", model)
        out["sample"] = len(pdf)
        return out

    return draw_samples(rows, config).groupBy("model", "tree").applyInPandas(build, NODE_SCHEMA)


class _Trees:
    """The nodes of one model as arrays, ready for vectorised descent."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        counts = nodes.groupby("tree", sort=True).size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(counts)[:-1]])
        base = np.repeat(self.roots, counts)
        self.feature = nodes["feature"].to_numpy(dtype=np.int64)
        self.threshold = nodes["threshold"].to_numpy(dtype=float)
        self.left = nodes["left"].to_numpy(dtype=np.int64) + base
        self.right = nodes["right"].to_numpy(dtype=np.int64) + base
        self.path = nodes["depth"].to_numpy(dtype=float) + average_path(nodes["size"].to_numpy())
        self.scale = float(average_path(nodes["sample"].iloc[0]))
        self.levels = int(nodes["depth"].max())

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values))
        at_row = np.arange(len(values))
        for root in self.roots:
            at = np.full(len(values), root)
            for _ in range(self.levels):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = values[at_row, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            total += self.path[at]
        mean = total / len(self.roots)
        return np.power(2.0, -mean / self.scale) if self.scale > 0 else np.full(len(values), 0.5)


def raw_scores(df: DataFrame, nodes: DataFrame, config: ForestConfig, features: list[str], medians: dict[str, float],
               mode: str = "auto") -> DataFrame:
    """``timestamp, service, model, raw_score``, null for rows of a service without a model.

    A forest of bounded, counted size goes to the executors as a broadcast; a larger one meets its rows by a cogroup on
    (model, salt), where a model gets as many salts as its row count asks for.
    """
    rows = _inputs(df, config, features, medians)
    names = list(features)
    schema = "timestamp timestamp_ntz, service string, model string, raw_score double"
    if rows.schema["timestamp"].dataType.simpleString() != "timestamp_ntz":
        schema = schema.replace("timestamp_ntz", rows.schema["timestamp"].dataType.simpleString())
    small = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    if small and mode != "spread":
        shipped = df.sparkSession.sparkContext.broadcast(nodes.toPandas())

        def score_batches(batches):
            forests = {m: _Trees(g) for m, g in shipped.value.groupby("model", sort=False)}
            for pdf in batches:
                scores = np.full(len(pdf), np.nan)
                for m, at in pdf.groupby("model", sort=False).indices.items():
                    if m in forests:
                        scores[at] = forests[m].score(pdf.iloc[at][names].to_numpy(dtype=float))
                out = pdf[["timestamp", "service", "model"]].copy()
                out["raw_score"] = pd.Series(scores, index=out.index).astype(object).where(~np.isnan(scores), None)
                yield out

        return rows.mapInPandas(score_batches, schema)

    salts = broadcast_if_small(settle(
        rows.groupBy("model").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("int").alias("_salts")), "salts"))
    salted = null_safe_join(rows, salts, ["model"]).withColumn("_salt", F.pmod(F.xxhash64("timestamp", "service"), F.col("_salts")))
    copies = nodes.join(salts, "model").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1))).drop("_salts")

    def score_group(pdf: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["timestamp", "service", "model"]].copy()
        out["raw_score"] = None if forest.empty else _Trees(forest).score(pdf[names].to_numpy(dtype=float))
        return out

    return salted.groupBy("model", "_salt").cogroup(copies.groupBy("model", "_salt")).applyInPandas(score_group, schema)


def score_thresholds(scores: DataFrame, contamination: float, by: str = "model", score: str = "raw_score",
                     mode: str = "auto") -> DataFrame:
    """Per model, the score above which the given share of training rows lies."""
    return quantiles(scores, [by], score, {"threshold": 1.0 - contamination}, mode)


def fit_forest(train: DataFrame, config: ForestConfig = ForestConfig(), mode: str = "auto") -> ForestModel:
    """Medians, nodes and thresholds. The node table is written once so that scoring never grows trees again."""
    features = [c for c in config.features if c in train.columns]
    if not features:
        raise ValueError("none of the configured features is present")
    train = settle(train.select("timestamp", "service", *features), "train")
    medians = feature_medians(train, features, mode)
    nodes = fit_nodes(_inputs(train, config, features, medians), config, features)
    nodes = settle(nodes.coalesce(8) if not use_spread_plan(train, mode) else nodes, "forest")
    if config.contamination == "auto":
        thresholds = nodes.select("model").distinct().withColumn("threshold", F.lit(0.5))
    else:
        trained = raw_scores(train, nodes, config, features, medians, mode)
        thresholds = settle(score_thresholds(trained, float(config.contamination), mode=mode), "thresholds")
    return ForestModel(nodes, medians, thresholds, config, features)


def predict_forest(df: DataFrame, model: ForestModel, mode: str = "auto") -> DataFrame:
    """``timestamp, service, anomaly_score`` (4 places) and ``is_anomaly`` from the unrounded score; no model gives 0."""
    scored = raw_scores(df, model.nodes, model.config, model.features, model.medians, mode)
    raw = F.col("raw_score")
    return scored.join(model.thresholds, "model", "left").select(
        "timestamp", "service", F.coalesce(F.round(raw, 4), F.lit(0.0)).alias("anomaly_score"),
        F.coalesce(raw > F.col("threshold"), F.lit(False)).alias("is_anomaly"))


def detect_with_forest(telemetry: DataFrame, config: ForestConfig = ForestConfig(), train: DataFrame | None = None,
                       incidents: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """Fit on ``train``; else on rows before the first incident if there are at least 10; else on everything."""
    telemetry = settle(telemetry.select("timestamp", "service", *[c for c in config.features if c in telemetry.columns]))
    if train is None and incidents is not None:
        early = before_incidents(telemetry, incidents)
        train = early if early.limit(10).count() == 10 else None
    return predict_forest(telemetry, fit_forest(telemetry if train is None else train, config, mode), mode)
