import pytest
from pyspark.sql import functions as F

from conftest import at
from opslake.operators.explain import explain_candidates, explain_root_causes
from opslake.operators.rca import evaluation_windows, rank_root_causes, rca_results, top_k
from opslake.operators.topology import CyclicTopology, Topology, longest_depth
from opslake.schema import SERVICES


def _flags(spark, telemetry, hot):
    """5 samples of each service; ``hot`` maps a service to the sample from which it is anomalous."""
    t = telemetry([(i * 10, s, {"error_rate": 0.5, "latency_ms": 900.0} if s in hot and i >= hot[s] else {})
                   for i in range(5) for s in SERVICES])
    found = spark.createDataFrame([(at(i * 10), s, s in hot and i >= hot[s], 0.9 if s in hot and i >= hot[s] else 0.1)
                                   for i in range(5) for s in SERVICES],
                                  "timestamp timestamp_ntz, service string, is_anomaly boolean, anomaly_score double")
    return t, found


def test_depths(spark):
    topo = Topology.from_map(spark)
    assert {r.service: r.depth for r in topo.nodes.collect()} == {
        "api_gateway": 0, "auth_service": 1, "orders_service": 1, "database": 2}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], "caller string, dependency string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxz"], "service string")
    assert {r.service: r.depth for r in longest_depth(nodes, edges).collect()} == dict(a=0, b=1, c=2, d=3, x=0, z=0)
    with pytest.raises(CyclicTopology):
        Topology.from_map(spark, {"r": ["a"], "a": ["b"], "b": ["a"]})
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "caller string, dependency string")
    with pytest.raises(CyclicTopology):
        longest_depth(nodes.where("service in ('a', 'b')"), loop)


def test_only_the_gateway_fails(spark, telemetry, incidents):
    t, found = _flags(spark, telemetry, {"api_gateway": 1})
    inc = incidents({"id": "I", "root": "api_gateway", "start": 0, "end": 100})
    ranked = rank_root_causes(t, inc, Topology.from_map(spark), found).orderBy("rank").collect()
    assert (ranked[0].service, ranked[0].score, ranked[0].anomaly_count) == ("api_gateway", 1.0, 4)
    assert len(ranked) == 4 and [r.is_root_cause_candidate for r in ranked] == [True, False, False, False]
    # onset 1, ratio .8; topology .2; intensity ~1 and error rate .5
    assert tuple(ranked[0].score_breakdown) == (0.94, 0.2, 0.8)
    assert ranked[0].explanation.startswith("Candidate 'api_gateway' (Rank 1, score 1.000): temporal=0.94 (onset: 2024-01-01T00:00:10Z)")


def test_no_anomalies_and_empty_windows(spark, telemetry, incidents):
    t, found = _flags(spark, telemetry, {})
    inc = incidents({"id": "I", "root": "database", "start": 0, "end": 100}, {"id": "far", "root": "database", "start": 9000, "end": 9100})
    ranked = rank_root_causes(t, inc, Topology.from_map(spark), found)
    assert {(r.incident_id, r.score, r.is_root_cause_candidate) for r in ranked.collect()} == {("I", 0.0, False)}
    assert [r.service for r in ranked.orderBy("rank").collect()] == sorted(SERVICES)
    got = {r.incident_id: r.ranked_candidates for r in rca_results(inc, ranked).collect()}
    assert len(got["I"]) == 4 and got["far"] is None
    told = {r.incident_id: r for r in explain_root_causes(t, inc, Topology.from_map(spark), found).collect()}
    assert told["I"].probable_root_cause is None and told["I"].summary.startswith("No anomalous telemetry")
    assert told["far"].summary.startswith("No telemetry candidates") and told["far"].confidence == "LOW"


def test_unknown_service_is_a_candidate_and_bounds_override(spark, telemetry, incidents):
    t, found = _flags(spark, telemetry, {"database": 0})
    extra = telemetry([(10, "sidecar", {})])
    inc = incidents({"id": "I", "root": "database", "start": 5000, "end": 6000})
    ranked = rank_root_causes(t.unionByName(extra), inc, Topology.from_map(spark), found, start="2024-01-01 00:00:00",
                              end="2024-01-01 00:00:40")
    assert {r.service for r in ranked.collect()} == {*SERVICES, "sidecar"}
    assert top_k(ranked, 1).first().service == "database" and top_k(ranked, 0).count() == 0


def test_cascade(spark, telemetry, incidents):
    t, found = _flags(spark, telemetry, {"database": 0, "orders_service": 1, "api_gateway": 2})
    inc = incidents({"id": "I", "root": "database", "start": 0, "end": 100})
    topo = Topology.from_map(spark)
    ranked = rank_root_causes(t, inc, topo, found)
    told = {r.candidate: r for r in explain_candidates(ranked, t, evaluation_windows(inc), topo).withColumnRenamed(
        "service", "candidate").collect()}
    assert told["database"].classification == "Probable root cause" and told["database"].confidence in ("HIGH", "MEDIUM")
    for s in ("orders_service", "api_gateway"):
        assert told[s].classification.startswith("Cascading failure symptom")
    assert told["auth_service"].classification == "Unaffected service"
    assert [told[s].temporal_evidence.onset_delta_seconds for s in ("database", "orders_service", "api_gateway")] == [0, 10, 20]
    assert told["database"].supporting_signals == ["Elevated error rate: peak 50.00%", "High response latency: peak 900.0ms"]
    assert told["auth_service"].supporting_signals == ["Nominal metric ranges across observed window."]
    assert told["auth_service"].summary.endswith("exhibited nominal telemetry behavior with 0 detected anomalies.")
    assert told["orders_service"].dependency_evidence.explainer_depth == 1
    assert told["database"].dependency_evidence.anom_callers == ["orders_service"]
    whole = explain_root_causes(t, inc, topo, found).first()
    assert whole.probable_root_cause == "database" and whole.candidates[0].rank == 1
    assert "Probable root cause: 'database' ranked #1" in whole.summary


def test_two_runs_agree(spark, telemetry, incidents):
    t, found = _flags(spark, telemetry, {"database": 0, "auth_service": 2})
    inc = incidents({"id": "I", "root": "database", "start": 0, "end": 100})
    topo = Topology.from_map(spark)
    runs = [rank_root_causes(x, inc, topo, found).orderBy("rank").collect() for x in (t, t.repartition(5))]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("width", [None, 7_000_000, 1_000_000_000])
def test_window_totals_equal_a_scan(spark, telemetry, monkeypatch, width):
    """Nested, touching, empty, unbounded and far-reaching windows, at any width of the lowest blocks."""
    import random

    from opslake.plans import rollups

    rng = random.Random(11)
    points = [(rng.randrange(0, 40_000) / 4, rng.choice(["database", "api_gateway", "orders_service"]), {"cpu_usage_pct": float(rng.randrange(100))}) for _ in range(500)]
    spans = [(f"w{i}", a, a + rng.choice([0, 0.25, 3, 50, 900, 9_000])) for i, a in enumerate(rng.randrange(-2_000, 42_000) / 4 for _ in range(60))]
    spans += [("all", -10**9, 10**9), ("back", 50, 40), ("far", 10**8, 10**9)]
    t = telemetry(points)
    w = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in spans] + [("open", None, at(5))], "incident_id string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    parts = {"n": rollups.Part(F.lit(1).cast("bigint"), "sum"), "top": rollups.Part(F.col("cpu_usage_pct"), "max"),
             "first": rollups.Part(F.when(F.col("cpu_usage_pct") > 50, F.col("timestamp")), "min")}
    want = []
    for i, a, b in spans:
        for svc in ("database", "api_gateway", "orders_service"):
            inside = [(s, m["cpu_usage_pct"]) for s, v, m in points if v == svc and a <= s <= b]
            if inside:
                want.append((i, svc, len(inside), max(m for _, m in inside), min((at(s) for s, m in inside if m > 50), default=None)))
    for few in (10**6, 0):
        monkeypatch.setattr(rollups, "FEW_WINDOWS", few)
        got = rollups.window_totals(t, w, parts, width=width)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda r: r[:2])


def test_no_window_and_no_row(spark, telemetry):
    from opslake.plans import rollups

    w = spark.createDataFrame([("a", at(0), at(9))], "incident_id string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    parts = {"n": rollups.Part(F.lit(1).cast("bigint"), "sum")}
    t = telemetry([(0, "database", {})])
    assert rollups.window_totals(t.limit(0), w, parts).collect() == []
    assert rollups.window_totals(t, w.limit(0), parts).collect() == []


def test_cycles_are_reported_and_condensed(spark):
    """Nested and chained cycles, a self-call, a tail, a node apart and an edge to nowhere, against plain reachability."""
    import random

    from opslake.operators.topology import condensed_depth, cycles, strong_components

    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(30)]
    lines = {(rng.choice(names), rng.choice(names)) for _ in range(20)} | {("n01", "n01"), ("n02", "gone")}
    for ring in ("05 06 07", "10 11 12 13", "12 11", "20 21"):
        around = [f"n{k}" for k in ring.split()]
        lines |= set(zip(around, around[1:] + around[:1], strict=True))
    lines |= {("n07", "n10"), ("n21", "n05")}
    edges = spark.createDataFrame(sorted(lines), "caller string, dependency string")
    nodes = spark.createDataFrame([(n,) for n in names], "service string")
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in lines:
            if b in reach:
                for n in names:
                    if a in reach[n]:
                        reach[n].add(b)
    part = {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in names}
    assert {r.service: r.component for r in strong_components(nodes, edges).collect()} == part
    size = {c: list(part.values()).count(c) for c in part.values()}
    assert max(size.values()) > 2
    want = {(n, c, size[c]) for n, c in part.items() if size[c] > 1 or (n, n) in lines}
    assert {tuple(r) for r in cycles(nodes, edges).collect()} == want
    deep = {r.service: (r.depth, r.in_cycle) for r in condensed_depth(nodes, edges).collect()}
    between = {(part[a], part[b]) for a, b in lines if b in part and part[a] != part[b]}

    def depth(c):
        return max((depth(a) + 1 for a, b in between if b == c), default=0)

    assert deep == {n: (depth(c), size[c] > 1) for n, c in part.items()}
    assert strong_components(nodes.limit(0), edges).collect() == []


def _star(spark, ring):
    """300 sources that call four of ten hubs each, stated twice; the hubs call each other in a row, or in rings of five."""
    calls = [(f"s{i:03d}", f"h{(i + k) % 10}") for i in range(300) for k in (0, 1, 3, 7)]
    among = [(f"h{i}", f"h{i // 5 * 5 + (i + 1) % 5}") for i in range(10)] if ring else [(f"h{i}", f"h{i + 1}") for i in range(9)]
    nodes = [(n,) for n in dict.fromkeys(c for c, _ in calls)] + [(f"h{i}",) for i in range(10)]
    return (spark.createDataFrame(nodes, "service string"),
            spark.createDataFrame(calls * 2 + among, "caller string, dependency string"), len(calls))


@pytest.fixture
def written(monkeypatch):
    """Rows that the graph's operators write between their steps."""
    from opslake.operators import topology

    rows, settle = [], topology.settle

    def counted(df, name):
        out = settle(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(topology, "settle", counted)
    return rows


def test_edges_of_sources_are_not_carried_along(spark, written):
    nodes, edges, calls = _star(spark, False)
    got = {r.service: r.depth for r in longest_depth(nodes, edges).collect()}
    assert got == {**{f"s{i:03d}": 0 for i in range(300)}, **{f"h{i}": i + 1 for i in range(10)}}
    assert sum(written) < calls


def test_unknown_callers_and_dependencies(spark):
    """A caller that is no node still calls; a path leads through a dependency that is no node; an edge to nothing is no edge."""
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "service string")
    lines = [("a", "gone"), ("gone", "b"), ("b", "c"), ("a", "c"), ("ghost", "d"), ("d", "e"), ("f", None), (None, "f")]
    got = {r.service: r.depth for r in longest_depth(nodes, spark.createDataFrame(lines, "caller string, dependency string")).collect()}
    assert got == {"a": 0, "b": 2, "c": 3, "d": 0, "e": 0, "f": 0}


def test_cycles_are_sought_among_called_nodes(spark, written):
    from opslake.operators.topology import cycles

    nodes, edges, calls = _star(spark, True)
    assert {tuple(r) for r in cycles(nodes, edges).collect()} == {(f"h{i}", f"h{i // 5 * 5}", 5) for i in range(10)}
    assert sum(written) < calls


def test_condensing_leaves_edges_of_sources_out(spark, written):
    from opslake.operators.topology import condensed_depth

    nodes, edges, calls = _star(spark, True)
    got = {r.service: (r.depth, r.in_cycle) for r in condensed_depth(nodes, edges).collect()}
    assert got == {**{f"s{i:03d}": (0, False) for i in range(300)}, **{f"h{i}": (1, True) for i in range(10)}}
    assert sum(written) < calls


def test_condensed_nodes_called_by_unknown_ones_start_paths(spark):
    from opslake.operators.topology import condensed_depth

    nodes = spark.createDataFrame([(n,) for n in "abcde"], "service string")
    lines = [("ghost", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "gone"), ("gone", "e"), ("e", "e")]
    got = {r.service: (r.depth, r.in_cycle) for r in condensed_depth(nodes, spark.createDataFrame(lines, "caller string, dependency string")).collect()}
    assert got == {"a": (0, False), "b": (1, True), "c": (1, True), "d": (2, False), "e": (0, False)}
