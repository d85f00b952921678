"""Operators against plain versions and on awkward tables."""

import collections
import gzip
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import adapters, alerts, evaluation, graph, learning, motifs, order, planting, queues, scoring, screens, temporal, text
from ledgerscope.operators.components import connected_components
from ledgerscope.sources import files, schemas


def edge_table(spark, rows):
    """Rows (src, dst, timestamp, amount)."""
    return spark.createDataFrame(rows, "src string, dst string, timestamp long, amount double").withColumn("edge_type", F.lit("pays"))


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(f"a{rng.randrange(n)}", f"a{rng.randrange(n)}", rng.randrange(50), float(rng.randrange(1, 100))) for _ in range(m)]


def neighbours(rows):
    near = collections.defaultdict(set)
    for s, d, *_ in rows:
        if s != d:
            near[s].add(d)
            near[d].add(s)
    return near


def test_k_core(spark):
    rows = random_graph(40, 160, 1) + [("x", "x", 1, 1.0)]
    near = {k: set(v) for k, v in neighbours(rows).items()}
    want, k = {}, 0
    while near:
        low = [v for v, x in near.items() if len(x) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            want[v] = k
            for u in near.pop(v):
                if u in near:
                    near[u].discard(v)
    assert {r.node_id: r.core for r in graph.k_core(edge_table(spark, rows)).collect()} == want
    assert graph.k_core(edge_table(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rows = random_graph(60, 40, 2)
    near, seen, want = neighbours(rows), set(), {}
    for v in sorted(near):
        if v not in seen:
            part, todo = {v}, [v]
            while todo:
                for u in near[todo.pop()] - part:
                    part.add(u)
                    todo.append(u)
            seen |= part
            want |= dict.fromkeys(part, min(part))
    assert {r.node: r.component for r in connected_components(edge_table(spark, rows), "src", "dst").collect()} == want


def test_communities(spark):
    """Two dense groups with one edge between them are two communities; a part bears its least node."""
    pairs = [(f"{g}{i}", f"{g}{j}", 1, 1.0) for g in "ab" for i, j in itertools.combinations(range(6), 2)] + [("a0", "b0", 1, 1.0), ("c", "c", 1, 1.0)]
    e = edge_table(spark, pairs)
    got = graph.communities(e)
    assert {r.node_id: r.community_id for r in got.collect()} == {f"{g}{i}": f"{g}0" for g in "ab" for i in range(6)}
    whole = graph.modularity(e, got.select("node_id", F.lit("one").alias("community_id"))).first()[0]
    assert graph.modularity(e, got).first()[0] > 0.4 > abs(whole)
    assert graph.communities(e.limit(0)).count() == 0


def test_template_of_isolated_and_mutual_nodes(spark):
    e = edge_table(spark, [("a", "b", 1, 1.0), ("b", "a", 4, 1.0), ("b", "c", 9, 1.0), ("c", "a", 9, 1.0)])
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    got = {r.node_id: r for r in graph.structural_template(nodes, e).collect()}
    assert (got["a"].degree, got["a"].mutual_degree, got["a"].triangles, got["a"].core, got["a"].clustering) == (3, 1, 1, 2, 1.0)
    assert (got["d"].degree, got["d"].core, got["d"].community_size, got["d"].degree_rel_community, got["d"].burstiness) == (0, 0, 1, 1.0, None)
    floor = {r.node_id: r.score for r in graph.structural_floor(graph.structural_template(nodes, e)).collect()}
    assert floor["b"] > floor["d"]


def test_row_numbers(spark):
    rows = [(random.Random(i).randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {r.b: r["rank"] for r in order.row_numbers(df, [F.desc("a"), "b"]).collect()}
    assert got == {b: k for k, (a, b) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
    assert order.row_numbers(df.limit(0), ["b"]).count() == 0


def greedy(sets, threshold):
    kept, group, accepted = {}, {}, []
    for r in sorted(sets):
        hit = next((g for g, x in accepted if len(x & sets[r]) / len(x | sets[r]) > threshold), None)
        kept[r] = hit is None
        if hit is None:
            hit = len(accepted)
            accepted.append((hit, sets[r]))
        group[r] = hit
    return kept, group


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_greedy_dedup(spark, threshold):
    rng = random.Random(3)
    sets = {r: set(rng.sample(range(14), rng.randint(1, 6))) for r in range(1, 60)} | {60: set(range(100, 220))}
    members = spark.createDataFrame([(r, f"n{x}") for r, s in sets.items() for x in s], "rank long, node_id string")
    ranked = members.select("rank").distinct()
    want = greedy({r: s for r, s in sets.items() if r < 60}, threshold)
    got = alerts.greedy_dedup(ranked, members, threshold).collect()
    assert ({r["rank"]: r.kept for r in got}, {r["rank"]: r.overlap_group for r in got}) == want
    report = alerts.dedup_report(ranked, alerts.greedy_dedup(ranked, members, threshold)).first()
    assert (report.n_input, report.n_oversized, report.n_kept) == (60, 1, sum(want[0].values()))
    pairs = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}
    assert {(r.better, r.worse) for r in alerts.overlaps(members, threshold).collect()} == pairs
    grid = alerts.sensitivity(ranked, members, members.select("node_id").distinct().withColumn("label", F.lit("illicit")), [threshold, 0.9], [None])
    assert {r.threshold: r.n_kept for r in grid.collect()}[threshold] == sum(want[0].values())


def test_built_alerts(spark):
    c = spark.createDataFrame([("b", 1.0, ["x", "y"]), ("a", 1.0, ["x"]), ("big", 9.0, [f"n{i}" for i in range(101)])], "community_id string, score double, member_node_ids array<string>")
    nodes = spark.createDataFrame([("x", 5), ("y", None)], "node_id string, time_first_seen long")
    got = alerts.build_alerts(c, nodes, "d", "r").orderBy("rank").collect()
    assert [(r.alert_id, r.community_id, r.n_members, r.time_window_start) for r in got] == [("d:r:1", "a", 1, 5), ("d:r:2", "b", 2, 5)]
    assert got[0].caveats == alerts.CAVEAT
    with pytest.raises(ValueError):
        alerts.percent_budgets(["0%"], "n")


def brute_chains(rows, least=3):
    last = {}
    for s, d, t, a in sorted(rows, key=lambda x: (x[2], x[3])):
        last[s, d] = (t, a)
    ok = lambda x, y: last[x][1] and last[y][1] / last[x][1] >= 0.9 and 0 <= last[y][0] - last[x][0] <= 2
    found = set()
    for head in last:
        if any(p[1] == head[0] and ok(p, head) for p in last):
            continue
        chain = [head]
        while True:
            on = [e for e in last if e[0] == chain[-1][1] and ok(chain[-1], e)]
            if not on:
                break
            best = min(on, key=lambda e: (-last[e][1], e[1]))
            if best in chain:
                break
            chain.append(best)
        if len(chain) >= least:
            found.add(tuple([chain[0][0]] + [e[1] for e in chain]))
    return found


def test_pass_through_chains(spark):
    rows = random_graph(25, 90, 4) + [("p", "q", 1, 100.0), ("q", "r", 2, 99.0), ("r", "s", 3, 98.0), ("q", "z", 2, 95.0)]
    got = {tuple(r.nodes) for r in motifs.pass_through_chains(edge_table(spark, rows)).collect()}
    assert got == brute_chains(rows) and ("p", "q", "r", "s") in got
    loop = [("h", "a", 1, 10.0), ("a", "b", 1, 10.0), ("b", "c", 1, 10.0), ("c", "a", 1, 10.0)]
    assert {tuple(r.nodes) for r in motifs.pass_through_chains(edge_table(spark, loop)).collect()} == brute_chains(loop) == {("h", "a", "b", "c", "a")}


def test_cycles_and_cliques(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(26)}
    want = set()
    for n in range(3, 6):
        for p in itertools.permutations(range(9), n):
            if p[0] == min(p) and all(x in edges for x in zip(p, p[1:] + p[:1], strict=True)):
                want.add(tuple(map(str, p)))
    df = spark.createDataFrame([("q", str(a), str(b)) for a, b in edges], "alert_id string, src string, dst string")
    assert {tuple(r.nodes) for r in motifs.cycles(df, longest=5, most=None).collect()} == want
    assert motifs.cycles(df, longest=5, most=2).count() == 2
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    cliques = [set(c) for n in range(3, 9) for c in itertools.combinations(range(9), n) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    maximal = {tuple(sorted(map(str, c))) for c in cliques if not any(c < d for d in cliques)}
    assert {tuple(r.nodes) for r in motifs.maximal_cliques(df).collect()} == maximal


def test_planted_motifs_are_found_and_quiet_graphs_are_not(spark):
    new = planting.payment_motif(spark, "cycle", 2, (0, 100), 1)
    for m in ("fan_in", "fan_out", "pass_through", "common_control"):
        new = new.unionByName(planting.payment_motif(spark, m, 2, (0, 100), 1))
    inner = new.withColumnRenamed("instance_id", "alert_id")
    got = collections.Counter((r.alert_id.split(":")[0], r.motif_type) for r in motifs.alert_motifs(inner).collect())
    assert all(got[m, m] == 2 for m in planting.MEMBERS)
    quiet = edge_table(spark, [("a", "b", 1, 5.0), ("c", "d", 9, 2.0)]).withColumn("alert_id", F.lit("q"))
    assert motifs.alert_motifs(quiet).count() == 0
    flags = {r.indicator_id for r in motifs.red_flags(motifs.alert_motifs(inner), "FATF").collect()}
    assert flags == {x[1] for x in motifs.INDICATORS if x[0] == "FATF"}


def test_planted_tenders(spark):
    part = planting.tender_motif(spark, "partition", 1, (1995, 2001), 1)
    won = part.where("edge_type = 'awarded'").select(F.lit("a").alias("alert_id"), F.col("src").alias("tender"), F.col("dst").alias("firm"))
    buys = part.where("edge_type = 'buys_from'").select(F.lit("a").alias("alert_id"), F.col("src").alias("buyer"), F.col("dst").alias("tender"))
    assert motifs.market_partition(won, buys).first().n_buyers == 2
    ring = planting.tender_motif(spark, "coordinated_cluster", 1, (1995, 2001), 1).where("edge_type = 'bids_on'")
    bids = ring.select(F.lit("a").alias("alert_id"), F.col("dst").alias("tender"), F.col("src").alias("firm"), "amount")
    assert motifs.coordinated_cluster(bids).first().n_firms == 4
    cover = planting.tender_motif(spark, "cover_bid", 1, (1995, 2001), 1).where("edge_type = 'bids_on'").select(F.col("dst").alias("tender"), F.col("src").alias("firm"), "amount")
    assert motifs.cover_bids(cover).count() >= 1
    turns = planting.tender_motif(spark, "rotation", 1, (1995, 2001), 1).select(F.get(F.split("dst", ":"), F.lit(1)).alias("market"), F.col("dst").alias("firm"))
    assert motifs.rotation(turns).first().firms == 4


def test_injection_refuses_known_nodes_and_keeps_the_background(spark):
    e = edge_table(spark, random_graph(20, 50, 6))
    nodes = temporal.nodes_of(e)
    new = planting.payment_motif(spark, "fan_in", 2, (0, 50), 1)
    n, every, truth = planting.injected(nodes, e, new, 1)
    assert n.count() == nodes.count() + 18 and every.count() == 50 + 16 + 2 and truth.count() == 2
    with pytest.raises(ValueError):
        planting.injected(n, every, new, 1)
    found = evaluation.recovery_at_budgets(n.select("node_id", F.col("node_id").startswith("inj:").cast("double").alias("score")), truth, [18, 1]).first()
    assert (found.n_members, found.recall_at_18) == (18, 1.0)


def test_average_precision_and_bootstraps(spark):
    rng = random.Random(8)
    rows = [(f"n{i}", round(rng.random() + 0.5 * (i % 4 == 0), 1), round(rng.random(), 1), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "node_id string, score_a double, score_b double, y int")
    tp, n, want = 0, 0, 0.0
    for s in sorted({r[1] for r in rows}, reverse=True):
        own = [r[3] for r in rows if r[1] == s]
        tp, n = tp + sum(own), n + len(own)
        want += sum(own) * tp / n
    one = df.select("node_id", F.col("score_a").alias("score"), "y")
    assert abs(scoring.average_precision(one).first().auc_pr - want / 20) < 1e-12
    assert abs(evaluation.average_precision_by(one.withColumn("k", F.lit(1)), ["k"]).first().auc_pr - want / 20) < 1e-12
    b = evaluation.bootstrap_interval(one, 60).first()
    assert b.ci_low <= b.auc_pr <= b.ci_high and b.n_boot == 60
    p = evaluation.paired_bootstrap(df, 60).first()
    assert p.delta > 0 and p.delta_ci_low <= p.delta <= p.delta_ci_high and 0 < p.p_value < 0.2
    same = evaluation.paired_bootstrap(df.withColumn("score_b", F.col("score_a")), 20).first()
    assert same.delta == 0 and same.p_value == 1


def test_draws_of_ranges_are_the_same_for_every_task():
    rng = np.random.default_rng(1)
    totals = rng.integers(0, 50, 13)
    each = [evaluation.draws_of_range(totals, k, 40, 7, 1) for k in range(13)]
    assert np.array_equal(np.sum([d for d, _ in each], 0), np.full(40, totals.sum()))
    assert all(np.array_equal(before, np.sum([d for d, _ in each[:k]], 0) if k else np.zeros(40)) for k, (_, before) in enumerate(each))
    assert all((d <= 0).all() for (d, _), n in zip(each, totals, strict=True) if n == 0)
    inside = evaluation.drawn(np.array([3, 0, 7]), each[0][0], 7, 1, 0)
    assert np.array_equal(inside.sum(1), each[0][0]) and not inside[:, 1].any()


@pytest.mark.parametrize("per_range", [20_000, 7])
def test_replicates_are_those_of_their_draws(spark, per_range):
    """Precision of every replicate from the draws that the tree gives, ranges laid out as Spark cut them; their spread is that of a plain bootstrap."""
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.3).astype(int)
    score = np.round(rng.normal(y, 1.0), 1)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y, strict=True)], "score double, y int")

    def precision(s, v, w):
        order = np.argsort(-s, kind="stable")
        s, v, w = s[order], v[order], w[order]
        last = np.append(s[1:] != s[:-1], True)
        n, h = np.cumsum(w)[last], np.cumsum(w * v)[last]
        return float(np.sum(np.diff(h, prepend=0) * np.divide(h, n, out=np.zeros(len(n)), where=n > 0)) / h[-1])

    got = {r.replicate: r.auc_pr for r in evaluation.replicate_precision(df, 200, 5, per_range).collect()}
    counts = df.groupBy("score").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    dealt, totals = evaluation._ranged(counts, [F.desc("score")], per_range)
    own = dealt.toPandas().sort_values("score", ascending=False)
    draws = {}
    for v in (0, 1):
        draws[v] = np.concatenate([evaluation.drawn(part[f"n{v}"].to_numpy(), evaluation.draws_of_range(totals[v], int(at), 200, 5, v)[0], 5, v, int(at)) for at, part in own.groupby("at", sort=True)], 1)
    want = {r: precision(np.tile(own["score"].to_numpy(), 2), np.repeat([0, 1], len(own)), np.concatenate([draws[0][r], draws[1][r]])) for r in range(200)}
    assert got == pytest.approx(want)
    plain = [precision(score[i], y[i], np.ones(len(i))) for i in (np.concatenate([rng.choice(np.flatnonzero(y == v), (y == v).sum()) for v in (0, 1)]) for _ in range(400))]
    assert abs(np.mean(list(got.values())) - np.mean(plain)) < 0.01 and abs(np.std(list(got.values())) / np.std(plain) - 1) < 0.25


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_sums_and_last_values_inside_a_large_key(spark, parts):
    """A key that holds most rows is split into ranges; the rows are the same for any number of them."""
    rng = random.Random(2)
    rows = [("hub" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, rng.choice([None, i])) for i in range(400)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k string, t long, v long")
        sums = {(r.k, r.t): r.s for r in order.running_sums(df, [F.desc("t")], ["k"], s="t").collect()}
        last = {(r.k, r.t): r.l for r in order.running_last(df, ["t"], ["k"], "v", "l").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sums == {(k, t): sum(u for q, u, _ in rows if q == k and u > t) for k, t, _ in rows}
    assert last == {(k, t): max((v for q, u, v in rows if q == k and u < t and v is not None), default=None) for k, t, _ in rows}


def test_held_out_scores_see_no_later_row(spark):
    """Scores of later nodes follow what was learned early, whatever their own features and labels would teach."""
    early = spark.createDataFrame([(f"n{i}", float(i % 2), float(i)) for i in range(40)], "node_id string, a double, b double")
    y = spark.createDataFrame([(f"n{i}", i % 2) for i in range(40)], "node_id string, y int")
    late = spark.createDataFrame([("n1", 0.0, 3.0), ("m1", 1.0, 2.0), ("m0", 0.0, 5.0)], "node_id string, a double, b double")
    once = {r.node_id: r.score for r in learning.held_out_scores(learning.linear_scores, early, y, late, ["a", "b"]).collect()}
    assert set(once) == {"n1", "m1", "m0"} and once["m1"] > 0.8 > 0.2 > once["m0"] and once["n1"] < 0.2
    more = early.union(spark.createDataFrame([("later", 1.0, 1.0)], "node_id string, a double, b double"))
    again = {r.node_id: r.score for r in learning.held_out_scores(learning.linear_scores, more, y, late, ["a", "b"]).collect()}
    assert again == pytest.approx(once)


def test_calibration_and_fusion(spark):
    rows = [(f"n{i}", i / 40, int(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "node_id string, score double, y int")
    got = {r.node_id: r.score for r in learning.calibrated(df.select("node_id", "score"), df).collect()}
    values = [got[f"n{i}"] for i in range(40)]
    assert values == sorted(values) and values[0] == 0 and values[-1] == 1
    with pytest.raises(ValueError):
        learning.calibrated(df, df.where("y = 1"))
    members = {"a": df.select("node_id", "score"), "b": df.where("score < 0.5").select("node_id", "score")}
    fused = learning.calibrated_fusion(members, members | {"b": df.select("node_id", "score")}, df)
    assert fused.count() == 40
    with pytest.raises(ValueError):
        learning.calibrated_fusion(members, {"a": df}, df)


def test_learned_scores_tell_classes_apart(spark):
    rng = random.Random(9)
    rows = [(f"n{i}", rng.gauss(2.0 * (i % 3 == 0), 1), None if i % 7 == 0 else rng.random(), int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "node_id string, a double, b double, y int")
    for scores in (learning.tree_scores(df, df, ["a", "b"], trees=5), learning.linear_scores(df.na.fill(0.0), df, ["a", "b"])):
        r = scoring.average_precision(scores.join(df.select("node_id", "y"), "node_id")).first()
        assert r.auc_pr > r.prevalence + 0.2
    e = edge_table(spark, [(f"n{i}", f"n{(i + 3) % 150}", 1, 1.0) for i in range(150)])
    r = scoring.average_precision(learning.propagation_scores(e, e, df.na.fill(0.0), df, ["a"]).join(df.select("node_id", "y"), "node_id")).first()
    assert r.auc_pr > r.prevalence + 0.3
    odd = learning.reconstruction_scores(e, df.na.fill(0.0).withColumn("a", F.when(F.col("node_id") == "n5", 50.0).otherwise(F.col("a"))), ["a", "b"], rank=1, alpha=1.0)
    assert odd.count() == 150


def test_label_noise_and_samples(spark):
    l = spark.createDataFrame([(f"n{i}", ["illicit", "licit", "unknown"][i % 3]) for i in range(90)], "node_id string, label string")
    got = temporal.noisy_labels(l, 0.25, 1).join(l.withColumnRenamed("label", "was"), "node_id").where("label <> was").collect()
    assert len(got) == 15 and all("unknown" not in (r.label, r.was) for r in got)
    assert temporal.noisy_labels(l, 0.0, 1).exceptAll(l).count() == 0
    y = temporal.confirmed(l)
    assert sorted(r.y for r in temporal.stratified_subsample(y, 5, 1).collect()) == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        temporal.stratified_subsample(y, 1, 1)
    cases = spark.createDataFrame([(i, i % 2) for i in range(20)], "case_id long, kind int")
    s = evaluation.study_sample(cases, [("odd", "kind = 1", 4), ("any", "true", 6)], ["a", "b"], 2).collect()
    assert len({r.case_id for r in s}) == 10 and collections.Counter(r.arm for r in s) == {"a": 5, "b": 5}
    with pytest.raises(ValueError):
        evaluation.study_sample(cases, [("odd", "kind = 1", 11)], ["a"], 2)


def test_validation_groups(spark):
    stats = spark.createDataFrame([("a", 10, 2, 3), ("b", 5, 1, 4), ("c", 4, 0, 4), ("d", 5, 2, 3)], "fold string, n long, n_illicit long, n_licit long")
    got = {r.fold: r.validation for r in temporal.validation_groups(stats, 1, {"c": "a"}).collect()}
    assert got == {"a": "b", "b": "d", "c": "a", "d": "b"}


def test_neighbourhoods(spark):
    e = edge_table(spark, [("a", "b", 1, 1.0), ("c", "a", 1, 1.0), ("b", "d", 1, 1.0), ("d", "f", 1, 1.0)])
    seeds = spark.createDataFrame([("q", "a")], "alert_id string, node_id string")
    got = {r.node_id: (r.hop, r.truncated) for r in queues.neighbourhoods(seeds, e, 2, 50).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (1, False), "d": (2, False)}
    assert {r.node_id: r.truncated for r in queues.neighbourhoods(seeds, e, 2, 2).collect()} == {"a": True, "b": True}
    with pytest.raises(ValueError):
        queues.assembled(seeds.select("node_id"), {"x": e.select(F.col("src").alias("node_id"), "amount"), "y": e.select(F.col("src").alias("node_id"), "amount")})


def test_conform(spark):
    ok = spark.createDataFrame([("a", "b", "pays", "3", True)], "src string, dst string, edge_type string, timestamp string, directed boolean")
    row = schemas.conform(ok, "edges").first()
    assert (row.timestamp, row.amount, row.raw_attrs) == (3, None, None)
    for bad in (ok.withColumn("x", F.lit(1)), ok.drop("directed"), ok.withColumn("timestamp", F.lit("late")), ok.withColumn("src", F.lit(None).cast("string"))):
        with pytest.raises(schemas.SchemaError):
            schemas.conform(bad, "edges")
    with pytest.raises(schemas.SchemaError):
        schemas.conform(ok, "unheard_of")
    assert schemas.conform(ok.limit(0), "edges").count() == 0
    found = schemas.outside_vocabulary(ok.withColumn("edge_type", F.lit("owes"))).first()
    assert (found["column"], found.value, found.n) == ("edge_type", "owes", 1)


def test_alerts_conform(spark):
    """An alert has its 18 columns and the fixed caveat; ranks and sizes begin at 1."""
    ok = spark.sql(f"SELECT 'a' AS alert_id, 'financial' AS domain, 'd' AS dataset, 'r' AS model_run_id, 1L AS rank, 0.5D AS risk_score, array('x', 'y') AS member_node_ids, 'cycle' AS motif_type, 2 AS n_members, timestamp'2020-01-01 00:00:00' AS created_at, '{alerts.CAVEAT}' AS caveats")
    row = schemas.conform(ok, "alerts").first()
    assert (len(row), row["rank"], row.member_node_ids, row.anchor_edges, row.overlap_group) == (18, 1, ["x", "y"], None, None)
    for c, v in {"caveats": "guilty", "rank": 0, "n_members": -1, "created_at": None, "member_node_ids": None, "risk_score": "high"}.items():
        with pytest.raises(schemas.SchemaError, match=c):
            schemas.conform(ok.withColumn(c, F.lit(v)), "alerts")
    assert schemas.outside_vocabulary(ok.withColumn("motif_type", F.lit("ring"))).first()["value"] == "ring"
    assert schemas.outside_vocabulary(ok).count() == 0
    history = spark.sql("SELECT 'n' AS node_id, 3 AS step, 'illicit' AS label")
    assert schemas.conform(history, "label_history").dtypes[1] == ("step", "bigint")
    with pytest.raises(schemas.SchemaError):
        schemas.conform(history.withColumn("label", F.lit("unknown")), "label_history")
    truth = spark.sql("SELECT 'i' AS instance_id, 'cycle' AS motif_type, array('a') AS member_node_ids, 5 AS n_edges")
    assert schemas.conform(truth, "ground_truth").first().n_edges == 5
    with pytest.raises(schemas.SchemaError):
        schemas.conform(spark.sql("SELECT 'n' AS node_id, 'licit' AS label, 's' AS label_source, 1.5 AS confidence"), "labels")


def test_inner_edges_of_hubs(spark):
    """Hubs of payments and of alerts, repeated edges, loops, ends in no alert and null ends."""
    rng = random.Random(2)
    rows = [(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}", k, 1.0) for k in range(150)] + [("a0", f"b{k}", k, 1.0) for k in range(40)] + [("a1", "a1", 0, 1.0), ("a1", None, 0, 1.0)] * 2
    members = [(f"x{k}", f"a{rng.randrange(30)}") for k in range(8) for _ in range(9)] + [(f"x{k}", "a0") for k in range(8)] * 2 + [("x0", None)]
    own = collections.defaultdict(set)
    for a, n in members:
        own[a].add(n)
    want = collections.Counter((a, *r) for a in own for r in rows if r[1] and {r[0], r[1]} <= own[a])
    got = motifs.induced_edges(spark.createDataFrame(members, "alert_id string, node_id string"), edge_table(spark, rows).drop("edge_type"))
    assert collections.Counter(map(tuple, got.collect())) == want


def test_edge_occlusion(spark):
    """Means over neighbours with, without and with only the kept edges, against a plain version."""
    rng = random.Random(4)
    rows = random_graph(12, 60, 4)
    edges = {r[:2] for r in rows}
    value = {f"a{k}": rng.random() for k in range(11)} | {"a3": None}  # a11 has no features
    targets = [(f"x{k}", f"a{rng.randrange(13)}") for k in range(6)] * 2
    kept = [(a, *e) for a, _ in targets for e in rng.sample(sorted(edges), 12)] + [("x0", "a1", "nowhere")]
    weights = {"in_v": 0.7, "out_v": -0.2}

    def score(n, es):
        ins, outs = ([value[o] or 0 for o in os if o in value] for os in ([s for s, d in es if d == n], [d for s, d in es if s == n]))
        return sum(w * (sum(x) / len(x) if x else 0) for w, x in zip(weights.values(), (ins, outs)))

    got = {(r.alert_id, r.node_id): (r.change_without, r.change_only) for r in learning.edge_occlusion(
        spark.createDataFrame(targets, "alert_id string, node_id string"), edge_table(spark, rows), spark.createDataFrame(kept, "alert_id string, src string, dst string"),
        spark.createDataFrame(list(value.items()), "node_id string, v double"), weights).collect()}
    assert set(got) == set(targets)
    for (a, n), (without, only) in got.items():
        own = {(s, d) for x, s, d in kept if x == a} & edges
        assert without == pytest.approx(score(n, edges) - score(n, edges - own)) and only == pytest.approx(score(n, edges) - score(n, own))


def test_tender_motifs_of_alerts(spark):
    awards = [("r", f"t:m:{k}", f"f:m:{k % 3}", "awarded", 1.0) for k in range(6)] + [("r", "t:m:9", "f:m:9", "awarded", 1.0), ("r", "t:o:1", "f:o:1", "awarded", 1.0)]
    bids = [("c", f"f:{k}", "t:1", "bids_on", p) for k, p in enumerate((100.0, 103.0, 106.0))] + [("c", f"f:{k}", "t:2", "bids_on", p) for k, p in enumerate((100.0, 100.0, 101.0))]
    bids += [("c", f"f:{k}", "t:3", "bids_on", p) for k, p in enumerate((100.0, 103.0, 107.0))] + [("c", "f:0", "t:4", "bids_on", 1.0), ("c", "f:1", "t:4", "bids_on", None)]
    part = [("p", f"t:{k}", f"f:{k}", "awarded", 1.0) for k in range(4)] + [("p", f"b:{k // 2}", f"t:{k}", "buys_from", None) for k in range(4)]
    linked = [("l", "u", "v", "linked_to", None), ("l", "v", "w", "linked_to", None), ("l", "w", "u", "linked_to", None)]
    got = motifs.alert_tender_motifs(spark.createDataFrame(awards + bids + part + linked, "alert_id string, src string, dst string, edge_type string, amount double"))
    rows = {(r.alert_id, r.motif_type, tuple(r.nodes)) for r in got.collect()}
    assert rows == {
        ("r", "rotation", tuple(sorted([f"f:m:{k}" for k in range(3)] + [f"t:m:{k}" for k in (0, 1, 2, 3, 4, 5, 9)]))),
        ("c", "cover_bid", ("f:0", "f:1", "f:2", "t:1")), ("c", "clique", ("f:0", "f:1", "f:2", "t:1", "t:2", "t:3", "t:4")),
        ("p", "partition", ("b:0", "b:1", "f:0", "f:1", "f:2", "f:3")), ("l", "common_control", ("u", "v", "w")),
    }
    assert {r.alert_id: r.motif_type for r in motifs.largest_motif(got).collect()} == {"r": "rotation", "c": "clique", "p": "partition", "l": "common_control"}


def test_files(spark, tmp_path):
    (tmp_path / "releases").mkdir()
    rows = [json.dumps({"ocid": "a", "date": "2019-05-01"}), "", json.dumps({"ocid": "b"})]
    (tmp_path / "releases" / "x.jsonl").write_text("\n".join(rows) + "\n")
    with gzip.open(tmp_path / "releases" / "y.jsonl.gz", "wt") as f:
        f.write(json.dumps({"ocid": "c"}) + "\n")
    (tmp_path / "releases" / "note.txt").write_text("no release")
    got = files.read_json_lines(spark, str(tmp_path / "releases"), adapters.RELEASE, 2)
    assert sorted(r.ocid for r in got.collect()) == ["a", "b", "c"]
    (tmp_path / "t.csv").write_text("Bank,Account,Account\n1,x,y\n")
    assert tuple(files.read_csv_by_place(spark, str(tmp_path / "t.csv"), "bank int, a string, b string").first()) == (1, "x", "y")
    (tmp_path / "u.csv").write_text("a,b\n1,2\nx,3\n")
    assert [(r.a, r.b) for r in files.read_csv_lenient(spark, str(tmp_path / "u.csv"), "a int, b int").collect()] == [(1, 2), (None, 3)]
    with pytest.raises(schemas.SchemaError):
        files.write_features(spark.range(1).withColumnRenamed("id", "node_id"), str(tmp_path), "d", "no good")
    with pytest.raises(schemas.SchemaError):
        files.write_features(spark.range(1), str(tmp_path), "d", "good")


def test_contract_releases(spark):
    """A joint bid, an award alone, parties without ids, and an undated release."""
    rows = [
        {"ocid": "1", "date": "2019-05-01", "buyer": {"id": "B"}, "tender": {"value": {"amount": 9.0}}, "bids": {"details": [{"id": "x", "value": {"amount": 5.0, "currency": "EUR"}, "tenderers": [{"id": "F"}, {"id": "G"}]}, {"id": "y", "tenderers": [{"name": "nobody"}]}]}},
        {"ocid": "2", "tender": {"tenderPeriod": {"endDate": "2020-01-01"}}, "buyer": {"name": "no id"}, "awards": [{"id": "w", "value": {"amount": 7.0}, "suppliers": [{"id": "F"}]}]},
        {"ocid": "3"},
    ]
    df = spark.read.schema(adapters.RELEASE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    nodes, edges, labels = adapters.contract_releases(df, "p")
    assert {(r.node_id, r.time_first_seen) for r in nodes.collect()} == {("tender:p:1", 2019), ("tender:p:2", 2020), ("buyer:p:B", 2019), ("firm:p:F", 2019), ("firm:p:G", 2019)}
    assert collections.Counter(r.edge_type for r in edges.collect()) == {"buys_from": 1, "bids_on": 2, "awarded": 1}
    assert json.loads(edges.where("edge_type = 'awarded'").first().raw_attrs) == {"award_id": "w", "date": None, "related_bid": None}
    assert labels.count() == 4
    assert tuple(adapters.release_counts(df).first()) == (3, 1, 1, 1)


def test_adapters_of_wallets_accounts_and_markets(spark):
    w = spark.createDataFrame([("x", 2, 2, 5.0), ("x", 1, 3, 4.0), ("x", 9, 1, 6.0), ("y", 3, 3, 1.0)], "address string, step int, class int, f double")
    links = spark.createDataFrame([("x", "y"), ("x", "x")], "src_id string, dst_id string")
    nodes, edges, labels, history = adapters.wallets(w, links)
    assert {r.node_id: (r.time_first_seen, list(r.raw_features)) for r in nodes.collect()} == {"addr:x": (1, [4.0]), "addr:y": (3, [1.0])}
    assert {r.node_id: r.label for r in labels.collect()} == {"addr:x": "illicit", "addr:y": "unknown"}
    assert history.count() == 2 and edges.where("timestamp IS NULL").count() == 2
    a = spark.createDataFrame([("2022/09/01 00:20", 1, "A", 2, "B", 5.0, "EUR", 4.0, "USD", "Wire", 1)], "time_text string, from_bank int, from_account string, to_bank int, to_account string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, format string, is_laundering int")
    nodes, edges, labels = adapters.accounts(a)
    e = edges.first()
    assert (e.src, e.dst, e.timestamp, e.amount) == ("acct:1:A", "acct:2:B", 27699860, 4.0) and json.loads(e.raw_attrs)["cur_paid"] == "USD"
    assert {r.label for r in labels.collect()} == {"illicit"}
    anonymous = spark.createDataFrame([(7, 1.5, 1, 0, 2, 0.1), (7, 2.5, 0, 1, 2, 0.1)], "Tender int, Bid_value double, Winner int, Collusive_competitor int, Number_bids int, CV double")
    nodes, edges, labels = adapters.market_bids(anonymous, "m", False)
    assert {r.node_id for r in nodes.collect()} == {"tender:m:7", "bid:m:7-0", "bid:m:7-1"} and edges.where("timestamp IS NULL").count() == 2
    assert {r.node_id: r.label for r in labels.collect()} == {"bid:m:7-0": "licit", "bid:m:7-1": "illicit"}
    pre = screens.precomputed_screens(edges, ["cv", "number_bids"]).first()
    assert (pre.node_id, pre.pc_cv, pre.pc_number_bids, pre.pc_lot_bidscount_min) == ("tender:m:7", 0.1, 2.0, None)


def test_texts(spark):
    df = spark.createDataFrame([(1, "Intro\n1. First part\nbody\n2. Second\nmore"), (2, "no heading"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section_num): (r.title, r.body) for r in text.sections(df).collect()}
    assert got == {(1, 1): ("First part", "1. First part\nbody"), (1, 2): ("Second", "2. Second\nmore"), (2, 1): ("Full document", "no heading"), (3, 1): ("Full document", "")}
    bad = spark.createDataFrame([(1, "ab" * 16), (2, ""), (3, "abc abd " * 2), (4, "".join("abcdef"[i * i % 6] for i in range(40)) + "a" * 5)], "doc_id long, text string")
    why = {r.doc_id: r.degenerate for r in text.degenerate(bad).collect()}
    assert (why[1], why[2], why[3]) == ("repeated", "empty", None)
    rules = [(r"\bdid it\b", "may have done it"), (r"\bnever\b", "seldom"), (r"\bsurely (\w+)\b", "likely $1")]
    said = text.guarded(spark.createDataFrame([("He DID IT and surely knew",)], "text string"), rules).first()
    assert said.text.startswith("He may have done it and likely knew") and said.text.endswith(f"*{alerts.CAVEAT}*") and said.rules == [0, 2]
    tokens = spark.createDataFrame([(1, "so <UNK> " + "<unk>\n" * 8), (2, "<unk> " * 7), (3, "<|x|> <|yy|>" * 4), (4, "<|x|>" * 7)], "doc_id long, text string")
    assert {r.doc_id: r.degenerate for r in text.degenerate(tokens).collect()} == {1: "unknown tokens", 2: None, 3: "special tokens", 4: None}


NUMBER = re.compile(r"(?<![\w.])\d{2,}(?:,\d{3})*(?:\.\d+)?(?![\w.])")


@pytest.mark.parametrize("answer, evidence", [
    ("12,345", "12345"), ("12345", "12,345"), ("12.50", "12.5 of 50"), ("7 and 42", "none"), ("it was 12,345.", "12"), ("a12 12b 3.14 99.5% 1,234", "234"), ("10,000 20,0000 1234.5.6", ""), (None, "1"), ("55 55", None), ("33", "33,000"),
])
def test_numbers_without_support(spark, answer, evidence):
    seen = set(NUMBER.findall(evidence or ""))
    seen |= {n.replace(",", "") for n in seen}
    want = sorted({n for n in NUMBER.findall(answer or "") if n not in seen and n.replace(",", "") not in seen})
    df = spark.createDataFrame([(answer, evidence)], "a string, e string")
    assert text.unsupported_numbers(df, "a", "e").first().unsupported == want
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.05]), (2, [0.0, 1.0]), (3, [0.98, 0.1]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    pairs = text.close_pairs(v)
    assert {(r.better, r.worse) for r in pairs.collect()} == {(0, 1), (0, 3), (1, 3)}
    facts = v.select(F.col("vec_id").alias("fact_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), "vec_id").alias("source"), F.array(F.col("vec_id").cast("string")).alias("categories"), (F.col("vec_id") / 10).alias("confidence"))
    got = {r.owner: (r.fact_id, r.source) for r in text.merged_facts(facts, pairs).collect()}
    assert got == {0: (3, "s0 | s1 | s3"), 2: (2, "s2"), 4: (4, "s4")}
    top = text.dense_top(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 2)
    assert [r.vec_id for r in top.orderBy("place").collect()] == [0, 1]


def test_bm25_counts_repeated_query_words(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, ""), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red"), (2, "red red")], "item_id long, text string")
    got = {r.item_id: r.score for r in text.bm25(docs, q).collect()}
    assert got[2] == pytest.approx(2 * got[1], abs=1e-8)


def test_empty_tables(spark):
    e = edge_table(spark, [("a", "b", 1, 1.0)]).limit(0)
    nodes = temporal.nodes_of(e)
    assert graph.payment_features(nodes, e).count() == 0 and graph.structural_template(nodes, e).count() == 0
    assert motifs.pass_through_chains(e).count() == 0
    assert scoring.rank_percentiles(nodes.select("node_id", F.lit(1.0).alias("score"))).count() == 0
    assert screens.bid_screens(spark.createDataFrame([], "tender string, firm string, amount double")).count() == 0
    assert alerts.overlaps(spark.createDataFrame([], "rank long, node_id string"), 0.5).count() == 0
