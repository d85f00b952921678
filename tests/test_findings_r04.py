"""Findings of round 4, each with a case that failed before."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import cores, evaluation, graph, motifs, temporal
from ledgerscope.plans import graph_queries, queries, score_queries


def test_report_walks_alerts_of_any_size(spark):
    """An alert of 150 members is kept, met and counted as every other."""
    rows = [(1, f"n{k}") for k in range(150)] + [(2, f"n{k}") for k in range(140)] + [(3, "m0"), (3, "m1")]
    alerts = spark.createDataFrame([(k, f"n{k}") for k in (1, 2, 3)], "rank long, src string")
    labels = spark.createDataFrame([("n149", "illicit"), ("m0", "illicit"), ("m1", "licit")], "node_id string, label string")
    scores = spark.createDataFrame([("n149", 0.9), ("m0", 0.8), ("m1", 0.1)], "node_id string, score double")
    got = {(r.level, r.metric, r.budget): r.value for r in evaluation.evaluation_report(alerts, spark.createDataFrame(rows, "rank long, node_id string"), labels, scores, [1, 10]).collect()}
    assert [got["dedup", m, None] for m in ("n_input", "n_oversized", "n_kept", "n_suppressed")] == [3, 0, 2, 1]
    assert (got["queue", "n_hits", 10], got["queue", "illicit_coverage", 1], got["queue", "illicit_coverage", 10]) == (2, 0.5, 1)


def test_all_cycles_of_an_alert_are_motifs(spark):
    """Six accounts that all pay one another have 394 cycles of three and more, not the hundred that an alert's report is cut to."""
    edges = [("a", x, y, "pays", 1, 10.0) for x, y in itertools.permutations("abcdef", 2)]
    found = motifs.alert_motifs(spark.createDataFrame(edges, "alert_id string, src string, dst string, edge_type string, timestamp long, amount double"))
    want = sum(len(list(itertools.permutations(s[1:]))) for n in range(3, 7) for s in itertools.combinations("abcdef", n))
    assert want == 394 and found.where("motif_type = 'cycle'").count() == want


def test_occlusion_of_all_members(spark, sf):
    """Every member of every alert has its changes, not the payer alone."""
    want = {(str(r["rank"]), r["node_id"]) for r in queries.queue(spark, sf)[1].collect()}
    got = [(r.alert_id, r.node_id) for r in queries.QUERIES["n15_edge_occlusion"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("first", [0, 1 << 40])
def test_fans_and_cycles_of_pairs(spark, monkeypatch, first):
    """Pairs known without repeats give the motifs of edges with repeats; alert ids beyond 32 bits stay, and fans are counted as they are listed."""
    rng = random.Random(9)
    members = sorted({(first + a, f"n{rng.randrange(14)}") for a in range(6) for _ in range(12)})
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(90)})
    m, e = spark.createDataFrame(members, "alert_id long, node_id string"), spark.createDataFrame(pairs, "src string, dst string")
    inside = collections.defaultdict(set)
    for a, n in members:
        inside[a].add(n)
    inner = motifs.induced_edges(m, e, repeated=False)
    assert collections.Counter(map(tuple, inner.collect())) == collections.Counter((a, *p) for a in inside for p in pairs if set(p) <= inside[a])
    twice = motifs.induced_edges(m.union(m), e.union(e)).withColumn("edge_type", F.lit("pays"))
    listed = collections.Counter((r.alert_id, r.motif_type, *r.nodes) for r in motifs.alert_fans(twice).collect())
    assert listed and listed == collections.Counter((r.alert_id, r.motif_type, *r.nodes) for r in motifs.pair_fans(inner).collect())
    n = collections.Counter()
    for k, v in listed.items():
        n[k[0]] += v
    assert n == {r.alert_id: r.n for r in motifs.fan_counts(inner).collect()}
    rounds = lambda df: {(r.alert_id, *r.nodes) for r in df.collect()}
    assert rounds(motifs.cycles(inner, 4, most=None, repeated=False)) == rounds(motifs.cycles(twice, 4, most=None))


def test_bundles_read_payments_once(spark, sf, monkeypatch):
    """Counts of bundles, fans and cycles join orders and lines once."""
    calls, once = [], queries.payments
    for module in (queries, graph_queries):
        monkeypatch.setattr(module, "payments", lambda *a: calls.append(1) or once(*a))
    for name in ("n14_bundle_counts", "n1_cycle_counts", "n10_alert_fans"):
        calls.clear()
        queries.QUERIES[name](spark, sf)
        assert len(calls) == 1, name


def test_tender_motifs_join_bids_once(spark, sf, monkeypatch):
    """All motifs of tenders come from one join of orders, lines and firms."""
    seen, staged = [], graph_queries.staged
    monkeypatch.setattr(graph_queries, "staged", lambda df, name: seen.append(df) or staged(df, name))
    found = graph_queries.tender_motifs(spark, sf)
    assert len(seen) == 1 and seen[0].count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_pairs_of_firms_count_once(spark):
    """Firms that meet in enough rows are told from each pair once; firms without a name meet none."""
    rng = random.Random(2)
    rows = [(f"a{rng.randrange(3)}", f"t{rng.randrange(8)}", rng.choice([None, *"uvwxyz"]), rng.choice([None, 10.0, 11.0])) for _ in range(120)]
    known = [r for r in rows if r[3] is not None]
    met = collections.Counter()
    for (a, t, f, _), (b, s, g, _) in itertools.product(known, known):
        if (a, t) == (b, s) and f and g and f != g:
            met[a, f, g] += 1
    core = {(a, f) for (a, f, _), n in met.items() if n >= 3}
    got = motifs.coordinated_cluster(spark.createDataFrame(rows, "alert_id string, tender string, firm string, amount double"), tenders=3, cv=9.0)
    n = collections.Counter(a for a, _ in core)
    assert {r.alert_id: r.n_firms for r in got.collect()} == {a: k for a, k in n.items() if k >= 3} and got.count()


def test_reconstruction_reads_payments_once(spark, sf, monkeypatch):
    """Features and links come from one join of orders and lines, and every node has a score."""
    calls, once = [], queries.payments
    for module in (queries, score_queries):
        monkeypatch.setattr(module, "payments", lambda *a: calls.append(1) or once(*a))
    got = {r.node_id for r in queries.QUERIES["l7_reconstruction"](spark, sf).collect()}
    assert len(calls) == 1 and got == {r.node_id for r in queries.sized(spark, sf)[0].collect()}


def test_template_numbers_pairs_once(spark, monkeypatch):
    """Components, triangles and cores share one table of pairs; parts are told as before, also that of a node which pays itself alone."""
    calls, once = [], cores.numbered_pairs
    for module in (cores, graph):
        monkeypatch.setattr(module, "numbered_pairs", lambda *a: calls.append(1) or once(*a))
    rows = [*itertools.permutations("abcd", 2), ("x", "y"), ("y", "z"), ("s", "s")]
    e = spark.createDataFrame([(u, v, k, 1.0) for k, (u, v) in enumerate(rows)], "src string, dst string, timestamp long, amount double")
    got = {r.node_id: (r.community_size, r.core, r.triangles) for r in graph.structural_template(temporal.nodes_of(e), e).collect()}
    assert len(calls) == 1
    assert got == dict.fromkeys("abcd", (4, 3, 3)) | dict.fromkeys("xyz", (3, 1, 0)) | {"s": (1, 0, 0)}
