"""Motifs of payments and bids as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.operators.components import connected_components


def fans(edges: DataFrame, least: int = 5) -> DataFrame:
    """Nodes with at least least distinct sources (fan_in) or targets (fan_out)."""
    ins = edges.groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("n")).select("node_id", F.lit("fan_in").alias("motif"), "n")
    outs = edges.groupBy(F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("n")).select("node_id", F.lit("fan_out").alias("motif"), "n")
    return ins.union(outs).where(F.col("n") >= least)


def rotation(awards: DataFrame, firms: int = 3, wins: int = 2) -> DataFrame:
    """Markets in which at least firms firms win at least wins times each."""
    n = awards.groupBy("market", "firm").agg(F.count("*").alias("w")).where(F.col("w") >= wins)
    return n.groupBy("market").agg(F.count("*").alias("firms"), F.sum("w").alias("wins")).where(F.col("firms") >= firms)


def cover_bids(bids: DataFrame, losing: int = 2, above: float = 1.06) -> DataFrame:
    """Tenders with at least losing losing bids that all lie above the lowest, by a factor of above at most."""
    low = F.min("amount").over(Window.partitionBy("tender"))
    place = F.row_number().over(Window.partitionBy("tender").orderBy("amount", "firm"))
    rest = bids.withColumns({"low": low, "k": place}).where("k > 1")
    g = rest.groupBy("tender").agg(F.count("*").alias("losing"), F.bool_and((F.col("amount") > F.col("low")) & (F.col("amount") <= F.col("low") * above)).alias("close"))
    return g.where((F.col("losing") >= losing) & F.col("close")).select("tender", "losing")


def pass_through_hops(edges: DataFrame, share: float = 0.9, ticks: int = 2) -> DataFrame:
    """Pairs of consecutive payments of which the second forwards at least share of the first within ticks.

    Amounts and times must be known, and the first amount not 0. Payments are looked up
    by node and by blocks of ticks + 1 units of time, so a busy account is split.
    """
    e = edges.where("amount IS NOT NULL AND timestamp IS NOT NULL").select("src", "dst", "timestamp", "amount", *(c for c in ("alert_id",) if c in edges.columns))
    block = lambda t: F.floor(t / (ticks + 1)).cast("long")
    a = e.where("amount <> 0").withColumn("block", F.explode(F.array(block(F.col("timestamp")), block(F.col("timestamp")) + 1))).alias("a")
    b = e.withColumn("block", block(F.col("timestamp"))).alias("b")
    later = (F.col("b.timestamp") >= F.col("a.timestamp")) & (F.col("b.timestamp") <= F.col("a.timestamp") + ticks)
    same = (F.col("a.alert_id") == F.col("b.alert_id")) if "alert_id" in e.columns else F.lit(True)
    own = [F.col("a.alert_id")] if "alert_id" in e.columns else []
    return a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("a.block") == F.col("b.block")) & same & later & (F.col("b.amount") / F.col("a.amount") >= share)).select(
        *own, F.col("a.src").alias("from"), F.col("a.dst").alias("via"), F.col("b.dst").alias("to"), F.col("a.timestamp").alias("t1"), F.col("b.timestamp").alias("t2"), F.col("a.amount").alias("amount_in"), F.col("b.amount").alias("amount_out")
    )


def ranked_lists(follow: DataFrame, heads: DataFrame) -> DataFrame:
    """Lists (head, place, item) that begin at heads (item) and go on by follow (item, next) of one next item at most, to the end or to the first item met again.

    Steps are doubled: after k rounds an item knows what lies 2**k steps on, and each list
    its first 2**k items, so rounds go by the logarithm of the longest list. Items that
    still lead on after as many steps as there are items lead into a ring; the place
    where they end is on it. Lists are cut there, and the ring from its entry is added.
    """
    follow = staged(follow.select("item", "next"), "follow")
    total = follow.count()

    def doubled(steps: DataFrame, lists: DataFrame | None, most: int) -> tuple[DataFrame | None, DataFrame]:
        """lists with all that follows, and the steps that are left after at most most items."""
        reach = 1
        while reach <= most and not steps.isEmpty():
            if lists is not None:
                on = lists.join(steps, "item").select("head", (F.col("place") + reach).alias("place"), F.col("next").alias("item"))
                lists = staged(lists.union(on), "lists")
            steps = staged(steps.join(steps.toDF("next", "far"), "next").select("item", F.col("far").alias("next")), "steps")
            reach *= 2
        return lists, steps

    far = doubled(follow, None, total)[1]
    begun = heads.select(F.col("item").alias("head"), F.lit(0).alias("place"), "item")
    if far.isEmpty():
        return doubled(follow, begun, total)[0]
    ring = staged(far.select(F.col("next").alias("item")).distinct(), "rings")
    inside = staged(follow.join(ring, "item", "left_semi"), "ring-steps")
    parts = staged(connected_components(inside, "item", "next").select(F.col("node").alias("item"), F.col("component").alias("first")), "ring-parts")
    alone = inside.where("item = next").select("item", F.col("item").alias("first"))
    parts = parts.union(alone)
    opened = inside.join(parts.select("first").distinct(), F.col("next") == F.col("first"), "left_anti")
    placed = staged(doubled(opened, parts.select(F.col("first").alias("head"), F.lit(0).alias("place"), F.col("first").alias("item")).distinct(), total)[0], "ring-places")
    size = placed.groupBy("head").agg(F.count("*").alias("size"))
    tails = doubled(follow.join(ring, "item", "left_anti").join(ring.withColumnRenamed("item", "next"), "next", "left_anti").select("item", "next"), begun.join(ring, "item", "left_anti").select("head", "place", "item"), total)[0]
    tails = staged(tails, "tails")
    entry = tails.join(follow, "item").join(ring.withColumnRenamed("item", "next"), "next", "left_semi").select("head", (F.col("place") + 1).alias("begin"), F.col("next").alias("item"))
    entry = entry.union(begun.join(ring, "item", "left_semi").select("head", F.lit(0), "item"))
    entry = entry.join(placed.select(F.col("head").alias("first"), F.col("place").alias("at"), "item"), "item").select("head", "begin", "first", "at")
    around = entry.join(placed.select(F.col("head").alias("first"), "place", "item"), "first").join(size.withColumnRenamed("head", "first"), "first")
    return tails.union(around.select("head", (F.col("begin") + F.pmod(F.col("place") - F.col("at"), F.col("size"))).alias("place"), "item"))


def pass_through_chains(edges: DataFrame, least: int = 3, share: float = 0.9, ticks: int = 2) -> DataFrame:
    """Maximal chains of at least least payments, each hop as in pass_through_hops(): (head_src, head_dst, hops, nodes).

    Parallel payments are collapsed first. A chain begins at a payment that no other
    forwards to; at a fork the largest amount goes on, the least target of equals. Where
    amounts and times allow a loop, the chain ends before the first payment met again.
    edges may bear alert_id; then each alert's chains are found by themselves.
    """
    own = [c for c in ("alert_id",) if c in edges.columns]
    last = F.max_by(F.struct("timestamp", "amount"), F.struct("timestamp", "amount"))
    e = edges.groupBy(*own, "src", "dst").agg(last.alias("x")).select(*own, "src", "dst", "x.timestamp", "x.amount")
    hops = staged(pass_through_hops(e, share, ticks), "hops")
    to = F.min_by("to", F.struct((-F.col("amount_out")).alias("less"), "to"))
    chosen = hops.groupBy(*own, "from", "via").agg(to.alias("to"))
    ends = chosen.select(*own, "from", "via").union(chosen.select(*own, F.col("via").alias("from"), F.col("to").alias("via"))).distinct()
    items = staged(ends.withColumn("item", F.monotonically_increasing_id()), "payments")
    follow = chosen.join(items, [*own, "from", "via"]).join(items.select(*own, F.col("from").alias("via"), F.col("via").alias("to"), F.col("item").alias("next")), [*own, "via", "to"]).select("item", "next")
    fed = hops.select(*own, F.col("via").alias("from"), F.col("to").alias("via")).distinct()
    heads = chosen.select(*own, "from", "via").join(fed, [*own, "from", "via"], "left_anti").join(items, [*own, "from", "via"]).select("item")
    lists = ranked_lists(follow, heads)
    at = F.struct("place", "via")
    every = lists.join(items, "item").groupBy("head").agg(F.array_sort(F.collect_list(at)).alias("l"))
    out = every.join(items.withColumnRenamed("item", "head"), "head").select(*own, F.col("from").alias("head_src"), F.col("via").alias("head_dst"), F.size("l").alias("hops"), F.concat(F.array("from"), F.transform("l", lambda x: x["via"])).alias("nodes"))
    return out.where(F.col("hops") >= least)


def on_closed_walks(edges: DataFrame, rounds: int = 3, repeated: bool = True) -> DataFrame:
    """Distinct edges (alert_id, src, dst) without loops, less those that rounds of taking off nodes without a way in or out show to lie on no cycle; written.

    Edges whose source has no way in are most of a queue's and leave before anything is written. The ways in
    look at both ends, so that edges are dealt once for them and for what they are met with.
    """
    e = edges.where("src <> dst").select("alert_id", "src", "dst")
    e = e.distinct() if repeated else e
    ways_in = e.groupBy("alert_id", "dst").agg(F.max(F.xxhash64("src")).alias("way")).where("way IS NOT NULL").select("alert_id", F.col("dst").alias("src"))
    e = staged(e.join(ways_in, ["alert_id", "src"], "left_semi").select("alert_id", "src", "dst"), "cycle-edges")
    n = e.count()
    for _ in range(rounds):
        ways_in, ways_out = e.select("alert_id", F.col("dst").alias("src")).distinct(), e.select("alert_id", F.col("src").alias("dst")).distinct()
        e = staged(e.join(ways_in, ["alert_id", "src"], "left_semi").join(ways_out, ["alert_id", "dst"], "left_semi").select("alert_id", "src", "dst"), "cycle-edges")
        before, n = n, e.count()
        if n == before:
            break
    return e


def counted_cycles(edges: DataFrame, longest: int = 8, shortest: int = 3, most: int | None = 100, repeated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Directed cycles of shortest to longest distinct nodes in each alert's edges (alert_id, src, dst): (alert_id, nodes), and per alert with a cycle how many were found, reported and cut, and the length to which all were looked for.

    Edges that lie on no closed walk leave first. A cycle is told from its least node s: a
    path of larger nodes from s of half its length and one back to s of the other half
    meet in a node and share no other, so paths of at most half of longest are held.
    Cycles are found by length. Of an alert's cycles the first most, by length and nodes,
    are reported, which is the feature's cap; an alert that has as many goes to no further
    length, so a dense one ends early. None reports all. repeated tells that edges may repeat.
    """
    e = on_closed_walks(edges, repeated=repeated)
    spark = e.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = e.toDF("alert_id", "x", "next")
    ahead = e.where("src < dst").select("alert_id", F.col("src").alias("s"), F.col("dst").alias("x"), F.array("dst").alias("there"))
    back = e.where("dst < src").select("alert_id", F.col("dst").alias("s"), F.col("src").alias("x"), F.array("src").alias("home"))
    ahead, back, found = staged(ahead, "paths"), staged(back, "paths"), []
    rest, n_ahead, n_back = None, 1, 1
    for n in range(2, longest + 1):
        if n_ahead < (n + 1) // 2:
            grown = ahead.repartition(parts, "alert_id", "x").join(step, ["alert_id", "x"]).where((F.col("next") > F.col("s")) & ~F.array_contains("there", F.col("next")))
            ahead, n_ahead = staged(grown.select("alert_id", "s", F.col("next").alias("x"), F.concat("there", F.array("next")).alias("there")), "paths"), n_ahead + 1
        if n_back < n // 2:
            grown = back.repartition(parts, "alert_id", "x").join(step.toDF("alert_id", "before", "x"), ["alert_id", "x"]).where((F.col("before") > F.col("s")) & ~F.array_contains("home", F.col("before")))
            back, n_back = staged(grown.select("alert_id", "s", F.col("before").alias("x"), F.concat(F.array("before"), "home").alias("home")), "paths"), n_back + 1
        if n < shortest:
            continue
        met = ahead.join(back, ["alert_id", "s", "x"]).where(~F.arrays_overlap("there", F.slice("home", 2, longest)))
        found.append(staged(met.select("alert_id", F.concat(F.array("s"), "there", F.slice("home", 2, longest)).alias("nodes"), F.lit(n).alias("length")), "cycles"))
        if most is not None:
            full = reduce(DataFrame.union, found).groupBy("alert_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("alert_id")
            full = staged(full, "full")
            ahead, back = (df.join(full, "alert_id", "left_anti") for df in (ahead, back))
            ended = full.withColumn("searched_to", F.lit(n))
            rest = ended if rest is None else rest.union(ended.join(rest, "alert_id", "left_anti"))
        if ahead.isEmpty() or back.isEmpty():
            break
    if not found:
        none = e.select("alert_id", F.array("src").alias("nodes"), F.lit(0).alias("length")).limit(0)
        found.append(none)
    every = reduce(DataFrame.union, found)
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy("length", "nodes"))
    kept = every if most is None else every.withColumn("place", place).where(F.col("place") <= most)
    report = every.groupBy("alert_id").agg(F.count("*").alias("n_found"))
    ends = e.select("alert_id", F.lit(longest).alias("searched_to")).limit(0) if rest is None else rest
    report = report.join(ends.groupBy("alert_id").agg(F.min("searched_to").alias("searched_to")), "alert_id", "left")
    n = F.col("n_found")
    reported = n if most is None else F.least(n, F.lit(most))
    return kept.select("alert_id", "nodes"), report.select("alert_id", n, reported.cast("long").alias("n_reported"), (n - reported).cast("long").alias("n_cut"), F.coalesce("searched_to", F.lit(longest)).cast("long").alias("searched_to"))


def cycles(edges: DataFrame, longest: int = 8, shortest: int = 3, most: int | None = 100, repeated: bool = True) -> DataFrame:
    """The cycles (alert_id, nodes) that counted_cycles() reports."""
    return counted_cycles(edges, longest, shortest, most, repeated)[0]


def maximal_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """Maximal cliques of at least least nodes of each alert's undirected edges (alert_id, src, dst): (alert_id, nodes).

    Cliques grow by larger common neighbours, a table of (clique, candidates) at a time,
    so no alert's graph is held in one task; a clique no node extends is maximal.
    """
    e = edges.where("src <> dst").select("alert_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    both = e.union(e.select("alert_id", "v", "u"))
    near = staged(both.groupBy("alert_id", F.col("u").alias("node")).agg(F.collect_set("v").alias("near")), "neighbours")
    now = near.select("alert_id", F.array("node").alias("nodes"), F.col("near").alias("common"), "node")
    found = None
    while True:
        full = now.where((F.size("common") == 0) & (F.size("nodes") >= least)).select("alert_id", F.array_sort("nodes").alias("nodes"))
        found = full if found is None else found.union(full)
        grown = now.select("alert_id", "nodes", "common", F.explode("common").alias("next")).where(F.col("next") > F.array_max("nodes"))
        now = staged(grown.join(near.toDF("alert_id", "next", "near"), ["alert_id", "next"]).select("alert_id", F.concat("nodes", F.array("next")).alias("nodes"), F.array_intersect("common", "near").alias("common")), "cliques")
        if now.isEmpty():
            return found


def market_partition(awards: DataFrame, buys: DataFrame, least: int = 2) -> DataFrame:
    """Alerts with at least least buyers, each with least firms or more, none of which wins from two: (alert_id, n_buyers, nodes).

    awards has alert_id, tender, firm; buys alert_id, buyer, tender.
    """
    pairs = awards.join(buys, ["alert_id", "tender"]).select("alert_id", "buyer", "firm").distinct()
    firms = pairs.groupBy("alert_id", "firm").agg(F.count("*").alias("n")).groupBy("alert_id").agg(F.bool_and(F.col("n") == 1).alias("apart"), F.collect_list("firm").alias("firms"))
    buyers = pairs.groupBy("alert_id", "buyer").agg(F.count("*").alias("n")).groupBy("alert_id").agg(F.bool_and(F.col("n") >= least).alias("wide"), F.count("*").alias("n_buyers"), F.collect_list("buyer").alias("buyers"))
    both = firms.join(buyers, "alert_id").where("apart AND wide").where(F.col("n_buyers") >= least)
    return both.select("alert_id", "n_buyers", F.array_sort(F.concat("buyers", "firms")).alias("nodes"))


def coordinated_cluster(bids: DataFrame, firms: int = 3, tenders: int = 2, cv: float = 0.05) -> DataFrame:
    """Alerts in which at least firms firms meet another in tenders bid rows or more, and all tenders they bid on have prices of a CV of at most cv.

    bids has alert_id, tender, firm, amount; rows are (alert_id, n_firms, max_cv, nodes). Pairs are counted as products
    of the two firms' bid rows in a tender, each pair once; bids are dealt by tender once for both sides.
    """
    b = bids.where("amount IS NOT NULL")
    n = b.select("alert_id", "tender", "firm").repartition("alert_id", "tender").groupBy("alert_id", "tender", "firm").agg(F.count("*").alias("n"))
    pairs = n.join(n.withColumnsRenamed({"firm": "other", "n": "m"}), ["alert_id", "tender"]).where("firm < other")
    shared = pairs.groupBy("alert_id", "firm", "other").agg(F.sum(F.col("n") * F.col("m")).alias("rows")).where(F.col("rows") >= tenders)
    core = shared.select("alert_id", F.explode(F.array("firm", "other")).alias("firm")).distinct()
    enough = core.groupBy("alert_id").agg(F.count("*").alias("n_firms"), F.collect_list("firm").alias("core")).where(F.col("n_firms") >= firms)
    spread = b.join(core, ["alert_id", "firm"], "left_semi").groupBy("alert_id", "tender").agg((F.stddev_samp("amount") / F.avg("amount")).alias("cv"))
    close = spread.groupBy("alert_id").agg(F.max("cv").alias("max_cv"), F.collect_list("tender").alias("tenders")).where(F.col("max_cv") <= cv)
    return enough.join(close, "alert_id").select("alert_id", "n_firms", "max_cv", F.array_sort(F.concat("core", "tenders")).alias("nodes"))


def induced_edges(members: DataFrame, edges: DataFrame, few: int = 200, repeated: bool = True) -> DataFrame:
    """Edges with both ends among an alert's members, for all alerts at once: alert_id and the columns of edges.

    A node in at most few alerts has one list of them; an edge takes the list of its
    source to its target, and only the alerts in both lists become rows. An edge with an
    end in more is met with the alerts of that end which is in fewer, so that no row
    holds a long list and a hub is not multiplied by another. Repeated edges stay; an
    edge without an end has no alert. repeated tells that members may repeat; if not, they
    are read as they are. Lists hold long ids of alerts as short as they fit.
    """
    m = members.select("alert_id", "node_id").where("node_id IS NOT NULL")
    m = staged(m.repartition("node_id").distinct(), "members") if repeated else m
    kind = dict(m.dtypes)["alert_id"]
    if kind == "bigint":
        first, last = m.agg(F.min("alert_id"), F.max("alert_id")).first()
        if -(1 << 31) <= (first or 0) and (last or 0) < 1 << 31:
            m = m.withColumn("alert_id", F.col("alert_id").cast("int"))
    n = staged(m.groupBy("node_id").agg(F.count("*").alias("__n")), "alerts-of-nodes")
    hubs = n.where(F.col("__n") > few).select("node_id")
    busy = not hubs.isEmpty()
    own = m.join(hubs, "node_id", "left_anti") if busy else m
    lists = own.groupBy("node_id").agg(F.array_sort(F.collect_list("alert_id")).alias("__alerts"))
    listed = edges.join(lists.toDF("src", "__of_src"), "src").join(lists.toDF("dst", "__of_dst"), "dst")
    of = F.col("alert_id").cast(kind).alias("alert_id")
    out = listed.withColumn("alert_id", F.explode(F.array_intersect("__of_src", "__of_dst"))).select(of, *edges.columns)
    if not busy:
        return out
    at_src, at_dst = hubs.withColumnRenamed("node_id", "src"), hubs.withColumnRenamed("node_id", "dst")
    e = edges.join(at_src, "src", "left_semi").unionByName(edges.where("src IS NOT NULL").join(at_src, "src", "left_anti").join(at_dst, "dst", "left_semi"))
    e = e.join(n.toDF("src", "__of_src"), "src").join(n.toDF("dst", "__of_dst"), "dst")

    def met(some: DataFrame, near: str, far: str) -> DataFrame:
        return some.join(m.toDF("alert_id", near), near).join(m.toDF("alert_id", far), ["alert_id", far], "left_semi").select(of, *edges.columns)

    return out.union(met(e.where("__of_src <= __of_dst"), "src", "dst")).union(met(e.where("__of_src > __of_dst"), "dst", "src"))


def alert_fans(inner: DataFrame, least: int = 5) -> DataFrame:
    """Fans of at least least partners among every alert's inner payments: (alert_id, motif_type, nodes)."""
    return pair_fans(inner.where("edge_type = 'pays'").select("alert_id", "src", "dst").distinct(), least)


def pair_fans(pairs: DataFrame, least: int = 5) -> DataFrame:
    """alert_fans() of distinct pairs (alert_id, src, dst)."""
    ins = pairs.groupBy("alert_id", F.col("dst").alias("hub")).agg(F.collect_list("src").alias("others")).select("alert_id", "hub", "others", F.lit("fan_in").alias("motif_type"))
    outs = pairs.groupBy("alert_id", F.col("src").alias("hub")).agg(F.collect_list("dst").alias("others")).select("alert_id", "hub", "others", F.lit("fan_out").alias("motif_type"))
    return ins.union(outs).where(F.size("others") >= least).select("alert_id", "motif_type", F.array_sort(F.array_union(F.array("hub"), "others")).alias("nodes"))


def fan_counts(pairs: DataFrame, least: int = 5) -> DataFrame:
    """The number of pair_fans() of each alert that has any: (alert_id, n); partners are counted, not listed.

    Both counts look at both ends, so that the pairs are dealt once for the two.
    """
    def hubs(end: str, other: str) -> DataFrame:
        g = pairs.groupBy("alert_id", end).agg(F.count("*").alias("partners"), F.max(F.xxhash64(other)).alias("one"))
        return g.where((F.col("partners") >= least) & F.col("one").isNotNull()).select("alert_id")

    return hubs("dst", "src").union(hubs("src", "dst")).groupBy("alert_id").agg(F.count("*").alias("n"))


def alert_motifs(inner: DataFrame, fan_least: int = 5, longest: int = 8) -> DataFrame:
    """All motifs of payments of every alert's inner edges in one job, cycles of up to longest nodes without a cap: (alert_id, motif_type, nodes)."""
    e = inner.where("edge_type = 'pays'")
    named = lambda df, name: df.select("alert_id", F.lit(name).alias("motif_type"), F.array_sort(F.array_distinct("nodes")).alias("nodes"))
    linked = maximal_cliques(inner.where("edge_type = 'linked_to'"))
    return alert_fans(inner, fan_least).union(named(cycles(e, longest, most=None), "cycle")).union(named(pass_through_chains(e), "pass_through")).union(named(linked, "common_control"))


def alert_rotations(awards: DataFrame, firms: int = 3, wins: int = 2) -> DataFrame:
    """Per alert and market in which at least firms firms win wins times or more: these firms and all tenders of the market, (alert_id, nodes).

    awards has alert_id, market, tender, firm, one row per award.
    """
    n = awards.groupBy("alert_id", "market", "firm").agg(F.count("*").alias("w")).where(F.col("w") >= wins)
    turns = n.groupBy("alert_id", "market").agg(F.collect_list("firm").alias("firms")).where(F.size("firms") >= firms)
    sold = awards.groupBy("alert_id", "market").agg(F.collect_set("tender").alias("tenders"))
    both = turns.alias("a").join(sold.alias("b"), (F.col("a.alert_id") == F.col("b.alert_id")) & F.col("a.market").eqNullSafe(F.col("b.market")))
    return both.select("a.alert_id", F.array_sort(F.array_union("firms", "tenders")).alias("nodes"))


def alert_cover_bids(bids: DataFrame, losing: int = 2, above: float = 1.06) -> DataFrame:
    """Tenders of an alert with one lowest bid and at least losing others, all at most above times as high: the tender and its bidders, (alert_id, nodes).

    bids has alert_id, tender, firm, amount. Equal amounts are counted before tenders are
    compared, so no task sorts a tender's bids; these are dealt once.
    """
    n = bids.where("amount IS NOT NULL").repartition("alert_id", "tender").groupBy("alert_id", "tender", "amount").agg(F.count("*").alias("n"), F.collect_set("firm").alias("firms"))
    g = n.groupBy("alert_id", "tender").agg(F.sum("n").alias("n"), F.min_by("n", "amount").alias("lowest"), F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.array_distinct(F.flatten(F.collect_list("firms"))).alias("firms"))
    close = g.where((F.col("lowest") == 1) & (F.col("n") > losing) & (F.col("hi") <= F.col("lo") * above))
    return close.select("alert_id", F.array_sort(F.array_union(F.array("tender"), "firms")).alias("nodes"))


def alert_tender_motifs(inner: DataFrame, above: float = 1.06, cv: float = 0.05) -> DataFrame:
    """All motifs of tenders of every alert's inner edges in one job: (alert_id, motif_type, nodes).

    Awards go from tender to firm, bids from firm to tender, purchases from buyer to
    tender; a firm's market is the second part of its id. An alert without such edges has
    no row.
    """
    own = lambda kind, src, dst: inner.where(F.col("edge_type") == kind).select("alert_id", F.col("src").alias(src), F.col("dst").alias(dst), "amount")
    awards = own("awarded", "tender", "firm").withColumn("market", F.get(F.split("firm", ":"), F.lit(1)))
    bids, buys = own("bids_on", "firm", "tender"), own("buys_from", "buyer", "tender")
    found = {
        "rotation": alert_rotations(awards), "cover_bid": alert_cover_bids(bids, above=above), "partition": market_partition(awards, buys.select("alert_id", "buyer", "tender").distinct()),
        "clique": coordinated_cluster(bids, cv=cv), "common_control": maximal_cliques(inner.where("edge_type = 'linked_to'")),
    }
    return reduce(DataFrame.union, (df.select("alert_id", F.lit(k).alias("motif_type"), F.array_sort(F.array_distinct("nodes")).alias("nodes")) for k, df in found.items()))


def largest_motif(found: DataFrame) -> DataFrame:
    """The motif of each alert with most nodes, ties by type and nodes: (alert_id, motif_type, nodes)."""
    top = found.groupBy("alert_id").agg(F.min(F.struct((-F.size("nodes")).alias("less"), "motif_type", "nodes")).alias("m"))
    return top.select("alert_id", "m.motif_type", "m.nodes")


#: The indicators that motifs point to, by framework.
INDICATORS = [
    ("FATF", "FATF-STRUCT-01", "fan_in"), ("FATF", "FATF-LAYER-01", "fan_out"), ("FATF", "FATF-LAYER-02", "pass_through"), ("FATF", "FATF-CIRC-01", "cycle"), ("FATF", "FATF-SHELL-01", "common_control"),
    ("OECD", "OECD-ROT-01", "rotation"), ("OECD", "OECD-COVER-01", "cover_bid"), ("OECD", "OECD-ALLOC-01", "partition"), ("OECD", "OECD-CLUST-01", "clique"), ("OECD", "OECD-LINK-01", "common_control"),
]


def red_flags(motifs: DataFrame, framework: str) -> DataFrame:
    """One citation per alert and indicator of the framework, with the first nodes that matched and the number of matches."""
    table = motifs.sparkSession.createDataFrame([x for x in INDICATORS if x[0] == framework], "framework string, indicator_id string, motif_type string")
    g = motifs.join(F.broadcast(table), "motif_type").groupBy("alert_id", "framework", "indicator_id")
    return g.agg(F.count("*").alias("instances"), F.min("nodes").alias("first_nodes"))


def evidence(members: DataFrame, inner: DataFrame, motifs: DataFrame) -> DataFrame:
    """One record per alert: members, inner edges, time span, amounts where known, and the largest motif (ties by type and nodes)."""
    n = members.groupBy("alert_id").agg(F.countDistinct("node_id").alias("n_members"))
    e = inner.groupBy("alert_id").agg(F.count("*").alias("n_edges"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("amount").alias("amount_total"), F.max("amount").alias("amount_max"))
    top = motifs.groupBy("alert_id").agg(F.min(F.struct((-F.size("nodes")).alias("n"), "motif_type", "nodes")).alias("m"))
    return n.join(e, "alert_id", "left").join(top, "alert_id", "left").select(
        "alert_id", "n_members", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "first", "last", "amount_total", "amount_max", F.col("m.motif_type").alias("motif_type"), F.col("m.nodes").alias("motif_nodes")
    )
