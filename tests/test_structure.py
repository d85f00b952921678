"""Core indices, overlaps, chains, communities and cycles on shapes that need many rounds, against plain versions."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import alerts, graph, motifs


def pairs_table(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def peeled(pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[str(a)].add(str(b))
            near[str(b)].add(str(a))
    core, k, todo = {}, 0, None
    while near:
        todo = [v for v, x in near.items() if len(x) <= k]
        if not todo:
            k += 1
        while todo:
            v = todo.pop()
            if v not in near:
                continue
            core[v] = k
            for u in near.pop(v):
                near[u].discard(v)
                if len(near[u]) <= k:
                    todo.append(u)
    return core


def mixed_graph(seed):
    """Trees, chains between cliques, rings, rings with trees, and loops of chains at one node."""
    rng, new, pairs = random.Random(seed), itertools.count(), []

    def chain(a, b, n):
        line = [a, *(next(new) for _ in range(n)), b]
        pairs.extend(zip(line, line[1:], strict=False))

    cliques = [[next(new) for _ in range(rng.randrange(3, 7))] for _ in range(6)]
    for c in cliques:
        pairs.extend(itertools.combinations(c, 2))
    for _ in range(8):
        chain(rng.choice(rng.choice(cliques)), rng.choice(rng.choice(cliques)), rng.randrange(0, 9))
    for _ in range(5):
        chain(rng.choice(rng.choice(cliques)), next(new), rng.randrange(0, 9))
    ring = [next(new) for _ in range(rng.randrange(3, 20))]
    pairs.extend(zip(ring, ring[1:] + ring[:1], strict=True))
    hub = next(new)
    for n in (2, 3, 5):
        chain(hub, hub, n)
    tree = [next(new)]
    for _ in range(60):
        v = next(new)
        pairs.append((rng.choice(tree), v))
        tree.append(v)
    for _ in range(10):
        pairs.append((rng.choice(ring), next(new)))
    pairs.append((next(new),) * 2)
    rng.shuffle(pairs)
    return pairs


def test_k_core_of_mixed_graphs(spark):
    pairs = [(f"{seed}-{a}", f"{seed}-{b}") for seed in range(3) for a, b in mixed_graph(seed)]
    assert {r.node_id: r.core for r in graph.k_core(pairs_table(spark, pairs)).collect()} == peeled(pairs)


def test_k_core_of_long_shapes(spark, monkeypatch):
    """A path, a ring and a comb at once: rounds grow with the logarithm of the length."""
    from ledgerscope.operators import components, cores

    written, n = [], 20_000
    for module in (components, cores):
        monkeypatch.setattr(module, "staged", lambda df, name, own=module.staged: written.append(name) or own(df, name))
    name = lambda kind, i: F.concat(F.lit(kind), i.cast("string"))
    line = lambda kind, to: spark.range(n).select(name(kind, F.col("id")).alias("src"), name(kind, to).alias("dst"))
    e = line("path", F.col("id") + 1).union(line("ring", F.pmod(F.col("id") + 1, F.lit(n)))).union(line("comb", F.col("id") + 1)).union(spark.range(n).select(name("comb", F.col("id")), name("comb-tooth", F.col("id"))))
    got = graph.k_core(e).groupBy(F.substring("node_id", 1, 4).alias("shape"), "core").agg(F.count("*").alias("n")).collect()
    assert {(r["shape"], r.core, r.n) for r in got} == {("path", 1, n + 1), ("ring", 2, n), ("comb", 1, 2 * n + 1)}
    assert written.count("stars") < 40 and written.count("marked") < 5


def test_rounds_count_only_what_falls(spark, monkeypatch):
    """A strip that peels from its ends beside a clique: later rounds count only nodes that have lost support, not every node again."""
    from ledgerscope.operators import cores

    n, still, rows, staged = 30, 120, [], cores.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "cores":
            rows.append(out.count())
        return out

    monkeypatch.setattr(cores, "staged", counted)
    pairs = [(f"{a}", f"{b}") for a in range(n) for b in range(a + 1, min(n, a + 4))]
    pairs += [(f"c{a}", f"c{b}") for a, b in itertools.combinations(range(still), 2)]
    assert {r.node_id: r.core for r in graph.k_core(pairs_table(spark, pairs)).collect()} == peeled(pairs)
    assert len(rows) > 5 and sum(rows) <= 4 * n + still


def walked(ranks, pairs):
    held, kept = collections.defaultdict(list), {}
    for a, b in pairs:
        held[b].append(a)
    for r in sorted(ranks):
        kept[r] = not any(kept[a] for a in held[r])
    return kept


@pytest.mark.parametrize("one_task", [500_000, 1])
def test_conflicts_settle_in_parts_and_rounds(spark, one_task):
    """One task for all pairs; rounds, and connected parts that fit, where they are too many."""
    rng = random.Random(one_task)
    pairs = {(a, a + 1) for a in range(1, 12)} | {(100 + a, 100 + b) for a, b in itertools.combinations(range(6), 2) if rng.random() < 0.4} | {(200 + 2 * a, 201 + 2 * a) for a in range(20)}
    ranks = range(1, 260)
    a = spark.createDataFrame([(t, r) for t in ("x", "y") for r in ranks], "t string, rank long")
    p = spark.createDataFrame([("x", a, b) for a, b in pairs] + [("y", a, b) for a, b in pairs if a < 100], "t string, better long, worse long")
    rows = alerts.settled(a, p, ["t"], one_task).collect()
    got = {(r.t, r["rank"]): r.kept for r in rows}
    want = {("x", r): k for r, k in walked(ranks, pairs).items()} | {("y", r): k for r, k in walked(ranks, {x for x in pairs if x[0] < 100}).items()}
    assert got == want and len(rows) == len(want)


def test_a_long_chain_of_overlaps_settles(spark):
    """Each of 5,000 alerts shares two of three members with the next: every second one is kept."""
    members = spark.range(1, 5001).select(F.col("id").alias("rank"), F.explode(F.sequence("id", F.col("id") + 2)).alias("node_id"))
    got = alerts.greedy_dedup(members.select("rank").distinct(), members, 0.4)
    assert got.where("kept").count() == 2500 and got.where("kept AND rank % 2 = 0").count() == 0


@pytest.mark.parametrize("seed, least", [(1, 0.04), (2, 0.3), (3, 0.5), (4, 0.8)])
def test_overlaps_are_those_of_all_pairs(spark, seed, least):
    rng = random.Random(seed)
    sets = {r: set(rng.sample(range(30), rng.randint(1, 12))) for r in range(60)} | {r: set(range(r % 3, 20 + r % 5)) for r in range(60, 80)}
    sets |= {r: {0, *rng.sample(range(100, 400), rng.randint(0, 9))} for r in range(80, 140)}
    members = spark.createDataFrame([(r, f"n{x}") for r, s in sets.items() for x in s], "rank long, node_id string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert {(r.better, r.worse): r.jaccard for r in alerts.overlaps(members, least).collect()} == {p: pytest.approx(j) for p, j in want.items() if j > least}


def test_a_chain_of_many_hops(spark):
    n = 1200
    e = spark.range(n).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.col("id").alias("timestamp"), F.lit(10.0).alias("amount"))
    got = motifs.pass_through_chains(e).first()
    assert (got.head_src, got.head_dst, got.hops) == ("0", "1", n) and list(got.nodes) == [str(i) for i in range(n + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_end_at_rings(spark, seed):
    rng = random.Random(seed)
    follow = {i: rng.randrange(60) for i in range(60) if rng.random() < 0.95}
    if seed == 1:
        follow |= {0: 0, 1: 0, 2: 1}
    heads = list(dict.fromkeys([i for i in range(60) if i not in follow.values()] + [next(iter(follow))]))
    want = {}
    for h in heads:
        want[h] = [h]
        while (n := follow.get(want[h][-1])) is not None and n not in want[h]:
            want[h].append(n)
    got = collections.defaultdict(dict)
    for r in motifs.ranked_lists(spark.createDataFrame(list(follow.items()), "item long, next long"), spark.createDataFrame([(h,) for h in heads], "item long")).collect():
        assert r.place not in got[r.head]
        got[r.head][r.place] = r.item
    assert {h: [x[i] for i in range(len(x))] for h, x in got.items()} == want


def test_cycles_to_eight_with_a_cap_and_what_it_cut(spark):
    rng = random.Random(6)
    graphs = {"thin": {(rng.randrange(9), rng.randrange(9)) for _ in range(22)} | {(i, i + 1) for i in range(20, 60)}, "ring": {(i, (i + 1) % 8) for i in range(8)}, "none": {(1, 2), (2, 3), (1, 3)}, "dense": {(a, b) for a in range(7) for b in range(7)}}

    def brute(edges):
        out, step = [], collections.defaultdict(list)
        for a, b in edges:
            if a != b:
                step[a].append(b)

        def walk(path):
            for b in step[path[-1]]:
                if b == path[0] and len(path) >= 3:
                    out.append(tuple(map(str, path)))
                if b > path[0] and b not in path and len(path) < 8:
                    walk([*path, b])

        for a in list(step):
            walk([a])
        return sorted(out, key=lambda c: (len(c), c))

    want = {k: brute(g) for k, g in graphs.items()}
    df = spark.createDataFrame([(k, str(a), str(b)) for k, g in graphs.items() for a, b in g], "alert_id string, src string, dst string")
    every, counts = motifs.counted_cycles(df, most=None)
    got = collections.defaultdict(list)
    for r in every.collect():
        got[r.alert_id].append(tuple(r.nodes))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    capped, counts = motifs.counted_cycles(df, most=40)
    first = collections.defaultdict(set)
    for r in capped.collect():
        first[r.alert_id].add(tuple(r.nodes))
    assert dict(first) == {k: set(v[:40]) for k, v in want.items() if v}
    report = {r.alert_id: (r.n_found, r.n_reported, r.n_cut, r.searched_to) for r in counts.collect()}
    assert report["ring"] == (1, 1, 0, 8) and "none" not in report
    to = next(n for n in range(3, 9) if sum(len(c) <= n for c in want["dense"]) >= 40)
    found = sum(len(c) <= to for c in want["dense"])
    assert report["dense"] == (found, 40, found - 40, to)


def test_communities_are_no_worse_than_label_propagation_and_connected(spark):
    """Ten seeded graphs with planted groups of several sizes and mixing, as one table, whose modularity is compared."""
    pairs = []
    for seed in range(10):
        rng = random.Random(seed)
        group = [rng.randrange(3 + seed % 4) for _ in range(24)]
        pairs += [(f"{seed}-{a}", f"{seed}-{b}") for a, b in itertools.combinations(range(24), 2) if rng.random() < (0.6 if group[a] == group[b] else 0.03 + 0.01 * (seed % 5))]
    e = pairs_table(spark, pairs)
    got = {r.node_id: r.community_id for r in graph.communities(e).collect()}
    plain = {r.node_id: r.community_id for r in graph.label_propagation(e).collect()}

    def modularity(part):
        degree = collections.Counter(itertools.chain(*pairs))
        total = collections.Counter()
        for v, k in degree.items():
            total[part[v]] += k
        return sum(part[a] == part[b] for a, b in pairs) / len(pairs) - sum(k * k for k in total.values()) / (2 * len(pairs)) ** 2

    own, base = modularity(got), modularity(plain)
    print("MODULARITY", own, base)
    assert own >= base and own == pytest.approx(graph.modularity(e, spark.createDataFrame(list(got.items()), "node_id string, community_id string")).first()[0])
    near = collections.defaultdict(set)
    for a, b in pairs:
        if got[a] == got[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(got.values()):
        members = {v for v, x in got.items() if x == c}
        seen, todo = {c}, [c]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        assert seen == members and c == min(members)
