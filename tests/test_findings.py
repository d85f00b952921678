"""Findings of round 3, each with a case that failed before."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import alerts, components, evaluation, graph, learning, motifs, temporal
from ledgerscope.plans import queries, score_queries, text_queries  # noqa: F401


def test_inner_edges_by_lists_and_hubs(spark):
    """Lists of alerts, and hubs in more than few of them, give the same rows; long alert ids stay long."""
    rng = random.Random(7)
    members = [(a, f"n{rng.randrange(12)}") for a in range(9) for _ in range(6)] + [(a, "n0") for a in range(9)] + [(3, None)]
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", k) for k in range(80)] + [(None, "n1", 80), ("n1", None, 81), ("n0", "n0", 82)]
    inside = collections.defaultdict(set)
    for a, n in members:
        inside[a].add(n)
    want = collections.Counter((a, *e) for a, e in itertools.product(inside, edges) if e[0] in inside[a] and e[1] in inside[a] and None not in e)
    m, e = spark.createDataFrame(members, "alert_id long, node_id string"), spark.createDataFrame(edges, "src string, dst string, k long")
    for few in (0, 2, 5, 200):
        assert collections.Counter(map(tuple, motifs.induced_edges(m, e, few).collect())) == want


def test_equal_outflows_are_ranked_by_account(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles; such sums tie."""
    amounts = dict(enumerate(itertools.permutations((0.1, 0.2, 0.3)), 1))
    assert (0.1 + 0.2) + 0.3 > (0.3 + 0.2) + 0.1
    spark.createDataFrame([(k, k) for k in amounts], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(k, 10 + p, x) for k, xs in amounts.items() for p, x in enumerate(xs)]
    df = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_extendedprice double").coalesce(1)
    df.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    ranked = {r["src"]: (r["rank"], r["total"]) for r in queries.queue(spark, str(tmp_path))[0].collect()}
    assert ranked == {f"acct:{k}": (k, pytest.approx(0.6)) for k in amounts}


@pytest.mark.parametrize("least", [0.04, 0.3, 0.5])
def test_overlaps_of_long_lists(spark, monkeypatch, least):
    """Members in more alerts than a list holds, and pairs that share members after a prefix, against all pairs."""
    rng = random.Random(11)
    sets = {k: {rng.randrange(70) for _ in range(rng.randrange(2, 45))} | ({0} if k % 2 else set()) for k in range(1, 40)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    met = alerts._met
    monkeypatch.setattr(alerts, "_met", lambda placed: met(placed, listed=4, in_task=50))
    rows = spark.createDataFrame([(k, f"n{x}") for k, xs in sets.items() for x in xs], "rank long, node_id string")
    got = {(r.better, r.worse): r.jaccard for r in alerts.overlaps(rows, least).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > least})


def test_no_alert_leaves_for_its_size(spark, sf):
    """Every alert of the queue is walked, those of more than 50 members too."""
    ranked, members = queries.queue(spark, sf)
    everyone = {r["rank"] for r in ranked.collect()}
    assert members.groupBy("rank").count().where("count > 50").count()
    assert {r["rank"] for r in queries.QUERIES["m3_greedy_dedup"](spark, sf).collect()} == everyone
    assert all(r.n_kept + r.n_suppressed == len(everyone) for r in queries.QUERIES["m14_sensitivity"](spark, sf).collect())


def test_payment_features_need_no_burstiness(spark, monkeypatch):
    """What features don't hold is not computed."""
    def none(*_):
        raise AssertionError("burstiness is not asked for")

    monkeypatch.setattr(graph, "burstiness", none)
    e = spark.createDataFrame([("a", "b", 3, 5.0), ("b", "c", 4, 5.0)], "src string, dst string, timestamp long, amount double")
    got = {r.node_id: (r.in_count, r.out_count, r.velocity, r.holding_time_median) for r in graph.payment_features(temporal.nodes_of(e), e).collect()}
    assert got == {"a": (0, 1, 1.0, None), "b": (1, 1, 1.0, 1.0), "c": (1, 0, 1.0, None)}


def test_folds_join_labels_once(spark, monkeypatch):
    """Each fold is what linear_scores() gives for it, and joins nothing with features or labels."""
    rng = random.Random(5)
    rows = [(f"buyer:{k % 3}:{k}", rng.random() + k % 2, rng.random(), k % 2) for k in range(60)]
    f = spark.createDataFrame([r[:3] for r in rows], "node_id string, a double, b double")
    y = spark.createDataFrame([(r[0], r[3]) for r in rows], "node_id string, y long")
    want = {}
    for g in "012":
        test = y.where(F.split("node_id", ":")[1] == g)
        df = learning.linear_scores(f, y.where(F.split("node_id", ":")[1] != g), ["a", "b"]).join(test, "node_id").withColumn("fold", F.lit(g))
        want[g] = evaluation.average_precision_by(df, ["fold"]).first().auc_pr

    def none(*_):
        raise AssertionError("a fold joins features and labels")

    monkeypatch.setattr(learning, "linear_scores", none)
    assert {r.fold: r.auc_pr for r in learning.fold_matrix(f, y, ["a", "b"], ["0", "1", "2"]).collect()} == pytest.approx(want)


def test_state_of_many_edges(spark):
    """The sum over 40 million edges is no overflow."""
    edges = spark.range(40_000_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert components._state(edges)[0] == 40_000_000


def test_catalog_joins_payments_once(spark, sf, monkeypatch):
    """The store's edges, nodes and features come from one join of orders and lines."""
    calls = []
    once = queries.payments
    for module in (queries, text_queries):
        monkeypatch.setattr(module, "payments", lambda *a: calls.append(1) or once(*a))
    got = {r["name"]: r.n for r in queries.QUERIES["a7_catalog"](spark, sf).collect()}
    assert len(calls) == 1 and got["nodes"] == got["features_degree"] > 0 and got["edges"] > 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("first", [1, 1 << 33])
def test_members_are_placed_in_two_shuffles(spark, monkeypatch, first):
    """One by member, one by alert; null members are shared by none, and ranks beyond 32 bits stay."""
    rng = random.Random(3)
    sets = {first + k: {rng.randrange(30) for _ in range(rng.randrange(2, 20))} for k in range(30)}
    rows = [(k, f"n{x}") for k, xs in sets.items() for x in [*xs, *xs]] + [(k, None) for k in sets]
    seen, staged = {}, alerts.staged
    monkeypatch.setattr(alerts, "staged", lambda df, name: seen.update({name: exchanges(df)}) or staged(df, name))
    got = {(r.better, r.worse): r.jaccard for r in alerts.overlaps(spark.createDataFrame(rows, "rank long, node_id string"), 0.3).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) + 2) for a, b in itertools.combinations(sets, 2)}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0.3}) and got
    assert seen["placed"] <= 2


def test_queue_reads_payments_once(spark, sf):
    """Members come from what the queue has written, one row for each alert and member."""
    ranked, members = queries.queue(spark, sf)
    assert not [f for df in (ranked, members) for f in df.inputFiles() if "lineitem" in f or "orders" in f]
    assert members.count() == members.distinct().count()


def test_moves_run_on_numbers(spark, monkeypatch):
    """Levels see long ids; communities bear the names of their least nodes."""
    edges = [(f"n{g}{a}", f"n{g}{b}") for g in range(6) for a, b in itertools.combinations(range(5), 2)] + [(f"n{g}0", f"n{(g + 1) % 6}1") for g in range(6)]
    seen, moved = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda both, *a, **k: seen.append(dict(both.dtypes)["u"]) or moved(both, *a, **k))
    got = graph.communities(spark.createDataFrame(edges, "src string, dst string"))
    assert set(seen) == {"bigint"}
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.community_id].add(r.node_id)
    assert all(min(x) == c for c, x in by.items()) and sum(map(len, by.values())) == 30
