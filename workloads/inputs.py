"""Inputs of the registered queries, derived from the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.functions.scalars import epoch_seconds
from opslake.schema import METRICS, SERVICES
from opslake.session import tune
from opslake.sources.incidents import parse_incident_documents
from opslake.sources.rollup import event_service, telemetry_from_events

HORIZON = 6 * 3600
SPLIT_DAY = "2024-01-08 00:00:00"

INCIDENT_ROWS = """
  (0L, 'INC-001', 'database_connection_saturation', 'database', array('database','orders_service','api_gateway'),
   timestamp_ntz'2024-01-08 00:00:00', timestamp_ntz'2024-01-08 04:00:00', timestamp_ntz'2024-01-09 00:00:00', 'critical'),
  (1L, 'INC-002', 'database_connection_saturation', 'orders_service', array('orders_service','api_gateway'),
   timestamp_ntz'2024-01-17 06:00:00', timestamp_ntz'2024-01-17 08:00:00', timestamp_ntz'2024-01-18 06:00:00', 'high'),
  (2L, 'INC-003', 'database_connection_saturation', 'auth_service', array('auth_service','api_gateway'),
   timestamp_ntz'2024-01-26 00:00:00', timestamp_ntz'2024-01-26 01:00:00', timestamp_ntz'2024-01-26 12:00:00', 'medium'),
  (3L, 'INC-004', 'database_connection_saturation', 'auth_service', NULL,
   timestamp_ntz'2024-01-26 06:00:00', timestamp_ntz'2024-01-26 07:00:00', timestamp_ntz'2024-01-26 18:00:00', 'LOW')
"""
INCIDENT_COLUMNS = ("ord", "incident_id", "incident_type", "root_cause_service", "affected_services", "start_time",
                    "detection_time", "end_time", "severity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(table(spark, sf_dir, "events"))


def strained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry in which the error events of an hour weigh on its latency and connections, so that bursts stand out."""
    weight = F.lit(1.0) + F.lit(9.0) * F.col("error_rate")
    return telemetry(spark, sf_dir).withColumns({
        "latency_ms": F.col("latency_ms") * weight,
        "connection_utilization": F.least(F.lit(1.0), F.col("connection_utilization") * weight)})


def incidents(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {INCIDENT_ROWS} AS i({', '.join(INCIDENT_COLUMNS)})")


def row_number_of(service, ts):
    """A number per (hour, service) that both engines can compute without sorting."""
    slot = F.lit(-1)
    for i, s in enumerate(SERVICES):
        slot = F.when(service == s, F.lit(i)).otherwise(slot)
    return F.floor(epoch_seconds(ts) / 3600) * 4 + slot


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with defects by row number; later rules win. Timestamps are text, ``seq`` is the input order."""
    t = telemetry(spark, sf_dir).withColumn("r", row_number_of(F.col("service"), F.col("timestamp")))

    def every(n: int):
        return F.col("r") % n == 0

    bad = t.select(
        "r",
        F.when(every(127), F.lit("not a time")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(every(101), F.lit("rogue")).when(every(97), F.lit(" DataBase ")).otherwise(F.col("service")).alias("service"),
        *[{"cpu_usage_pct": F.when(every(103), F.lit(150.0)).otherwise(F.col("cpu_usage_pct")),
           "latency_ms": F.when(every(107), F.lit(-5.0)).otherwise(F.col("latency_ms")),
           "error_rate": F.when(every(109), F.lit(1.5)).otherwise(F.col("error_rate")),
           "memory_usage_pct": F.when(~every(113), F.col("memory_usage_pct"))}.get(m, F.col(m)).alias(m) for m in METRICS])
    copies = F.when(every(89), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = bad.withColumn("copy", F.explode(copies))
    return out.select("timestamp", "service", *[
        (F.col(m) + F.col("copy")).alias(m) if m == "cpu_usage_pct" else F.col(m) for m in METRICS],
        (F.col("r") * 2 + F.col("copy")).alias("seq"))


def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per service in ``event_id`` order, with every 97th moved back by three hours."""
    e = table(spark, sf_dir, "events")
    moved = F.when(F.col("event_id") % 97 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts"))
    return e.select(event_service().alias("service"), moved.cast("timestamp_ntz").alias("timestamp"), "event_id")


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per (day, service) with error events, spanning the first to the last of them."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        event_service().alias("service"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    g = e.groupBy(F.to_date("ts").alias("day"), "service").agg(
        F.count(F.lit(1)).alias("n"), F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    levels = F.array(*[F.lit(v) for v in ("low", "medium", "high", "critical")])
    days = F.datediff("day", F.lit("2024-01-01").cast("date"))
    slot = F.when(F.col("service") == SERVICES[0], 0).when(F.col("service") == SERVICES[1], 1).when(
        F.col("service") == SERVICES[2], 2).otherwise(3)
    return g.select(
        "day", "n", (F.lit(10) + days * 4 + slot).cast("bigint").alias("ord"),
        F.concat(F.lit("ERR-"), F.col("day").cast("string"), F.lit("-"), F.col("service")).alias("incident_id"),
        F.lit("database_connection_saturation").alias("incident_type"), F.col("service").alias("root_cause_service"),
        F.when(F.col("n") % 3 != 0, F.array("service")).alias("affected_services"),
        F.col("lo").alias("start_time"), (F.col("lo") + F.expr("INTERVAL 1 HOUR")).alias("detection_time"),
        (F.col("hi") + F.expr("INTERVAL 2 HOURS")).alias("end_time"),
        levels[(F.col("n") % 4).cast("int")].alias("severity"))


def all_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark).unionByName(bursts(spark, sf_dir).select(*INCIDENT_COLUMNS))


def incident_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array document per day with the bursts of that day, at most one per service."""
    iso = (lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c))
    body = F.struct("root_cause_service", "incident_id", "incident_type", "affected_services", iso("start_time"),
                    iso("detection_time"), iso("end_time"), "severity")
    return bursts(spark, sf_dir).groupBy("day").agg(
        F.to_json(F.array_sort(F.collect_list(body))).alias("text"))


def scanned_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_incident_documents(incident_documents(spark, sf_dir), "day", "text")


def broken_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with one kind of defect per rule, chosen by day of month and size."""
    d = F.dayofmonth("day")
    far = F.expr("INTERVAL 400 DAYS")
    shift = (lambda c: F.when(d % 13 == 0, F.col(c) + far).otherwise(F.col(c)))
    return bursts(spark, sf_dir).select(
        "ord", "incident_id",
        F.when(d % 7 == 0, F.lit("unknown_kind")).otherwise(F.col("incident_type")).alias("incident_type"),
        F.when(d % 11 == 0, F.lit("rogue")).when(d % 5 != 0, F.col("root_cause_service")).alias("root_cause_service"),
        shift("start_time").alias("start_time"),
        F.when(F.col("n") % 6 == 0, F.col("end_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("detection_time"))
        .alias("detection_time"),
        shift("end_time").alias("end_time"))


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Before the split day, and all from then on; plus a constant, a shifted constant and a column on one side only."""
    t = telemetry(spark, sf_dir)
    before = t.where(F.col("timestamp") < F.lit(SPLIT_DAY).cast("timestamp_ntz"))
    later = strained(spark, sf_dir).where(F.col("timestamp") >= F.lit(SPLIT_DAY).cast("timestamp_ntz"))
    return (
        before.withColumn("flat", F.lit(7.0)).withColumn("jump", F.lit(10.0)).withColumn("lost", F.col("latency_ms")),
        later.withColumn("flat", F.lit(7.0)).withColumn("jump", F.lit(20.0)))


def severity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the severity that the documented error-rate tiers would give."""
    from opslake.operators.labels import severity_labels

    t = strained(spark, sf_dir)
    tier = (
        F.when(F.col("error_rate") < 0.01, "low").when(F.col("error_rate") < 0.05, "medium")
        .when(F.col("error_rate") < 0.15, "high").otherwise("critical")
    )
    labels = severity_labels(t, incidents(spark)).where(F.col("severity").isNotNull())
    return t.select("timestamp", "service", tier.alias("predicted_severity")).join(labels, ["timestamp", "service"])


def entity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the order graph: order -> customer, supplier, part; customer, supplier -> nation -> region.

    An edge comes once per row that states it; the operators take repeats as one.
    """
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")}

    def key(kind: str, column: str):
        return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))

    def edge(name, a, ac, b, bc):
        return t[name].select(key(a, ac).alias("caller"), key(b, bc).alias("dependency"))

    edges = (
        edge("orders", "order", "o_orderkey", "customer", "o_custkey")
        .unionByName(edge("lineitem", "order", "l_orderkey", "supplier", "l_suppkey"))
        .unionByName(edge("lineitem", "order", "l_orderkey", "part", "l_partkey"))
        .unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edge("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    )
    kinds = (("orders", "order", "o_orderkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"),
             ("part", "part", "p_partkey"), ("nation", "nation", "n_nationkey"), ("region", "region", "r_regionkey"))
    nodes = None
    for name, kind, column in kinds:
        one = t[name].select(key(kind, column).alias("service"))
        nodes = one if nodes is None else nodes.unionByName(one)
    return nodes, edges


def looped_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entity graph with edges back from each customer to the last of its orders and from each nation to its first supplier."""
    nodes, edges = entity_graph(spark, sf_dir)
    back = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("caller"), F.concat(F.lit("order:"), F.col("k").cast("string")).alias("dependency"))
    more = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(
        F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("caller"), F.concat(F.lit("supplier:"), F.col("k").cast("string")).alias("dependency"))
    return nodes, edges.unionByName(back).unionByName(more)
