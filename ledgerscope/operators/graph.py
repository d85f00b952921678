"""Graph features as joins and grouped sums over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.operators.components import connected_components
from ledgerscope.operators.cores import k_core, numbered_pairs, simple_pairs
from ledgerscope.operators.order import row_numbers, running_last
from ledgerscope.operators.temporal import group_of


def zero(column: str):
    return F.coalesce(F.col(column), F.lit(0)).alias(column)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree, out_degree and degree with multiplicity; 0 for isolated nodes."""
    ins = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    outs = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    df = nodes.select("node_id").join(ins, "node_id", "left").join(outs, "node_id", "left").select("node_id", zero("in_degree"), zero("out_degree"))
    return df.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def mutual_degree(edges: DataFrame) -> DataFrame:
    """Distinct partners in both directions of directed edges, for nodes that have any; a self-loop is its own partner."""
    pairs = (edges.where("directed") if "directed" in edges.columns else edges).select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("mutual_degree"))


def triangles(edges: DataFrame, numbered: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Triangles, simple degree and clustering (0 below degree 2) per node of a simple projection.

    Pairs are written once with long ids, or taken from numbered, what numbered_pairs()
    gives for the edges. They point from the smaller to the larger (degree, id), so a hub
    starts few wedges.
    """
    pairs, names = numbered or numbered_pairs(edges)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    size = staged(ends.groupBy("id").agg(F.count("*").alias("simple_degree")), "sizes")
    ranked = pairs.join(size.withColumnsRenamed({"id": "u", "simple_degree": "du"}), "u").join(size.withColumnsRenamed({"id": "v", "simple_degree": "dv"}), "v")
    low, high = F.struct(F.col("du"), F.col("u")), F.struct(F.col("dv"), F.col("v"))
    arcs = staged(ranked.select(F.when(low < high, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low < high, F.col("v")).otherwise(F.col("u")).alias("y")), "arcs")
    arcs = arcs.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x")  # wedges are far more than arcs
    wedges = arcs.join(arcs.select("x", F.col("y").alias("z")), "x").where("y < z")
    found = wedges.join(pairs, (wedges.y == pairs.u) & (wedges.z == pairs.v), "left_semi")
    corners = found.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    d = F.col("simple_degree")
    return size.join(corners, "id", "left").join(names, "id").select("node_id", "simple_degree", zero("triangles")).withColumn(
        "clustering", F.when(d < 2, 0.0).otherwise(F.try_divide(2.0 * F.col("triangles"), d * (d - 1)))
    )


def burstiness(events: DataFrame, node: str = "node_id", time: str = "timestamp") -> DataFrame:
    """(sd - mean) / (sd + mean) of the gaps between a node's dated events; null below two gaps or if both are 0.

    Events are counted by node and time first; what is left of a hub is cut into ranges
    of time, over whose edges its last time is carried. Events at one time are 0 apart.
    """
    times = events.where(F.col(time).isNotNull() & F.col(node).isNotNull()).groupBy(node, time).agg(F.count("*").alias("n"))
    gap = F.col(time) - F.col("__last")
    own = running_last(times, [time], [node], time, "__last").groupBy(node).agg(
        (F.sum("n") - 1).alias("k"), F.sum(gap).cast("double").alias("s"), F.sum(gap.cast("double") * gap).alias("q")
    )
    mean = F.col("s") / F.col("k")
    sd = F.when(F.col("k") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("k") * mean * mean) / (F.col("k") - 1))))
    return own.select(node, F.when(F.col("k") > 1, F.when(sd + mean > 0, (sd - mean) / (sd + mean))).alias("burstiness"))


def incident_events(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id"), "timestamp").union(edges.select("dst", "timestamp"))


def direction_sums(edges: DataFrame, end: str, prefix: str, base: float = 100.0) -> DataFrame:
    """Per node at one end of the payments: count, sum (null if none is known), share of round amounts, first and last time."""
    return edges.groupBy(F.col(end).alias("node_id")).agg(
        F.count("*").alias(f"{prefix}_count"), F.sum("amount").alias(f"{prefix}_sum"),
        F.avg((F.col("amount") % base == 0).cast("double")).alias(f"{prefix}_round_share"), F.min("timestamp").alias(f"{prefix}_first"), F.max("timestamp").alias(f"{prefix}_last"),
    )


def direction_stats(edges: DataFrame, end: str, prefix: str, base: float = 100.0) -> DataFrame:
    """direction_sums() and burstiness."""
    stats = direction_sums(edges, end, prefix, base)
    bursts = burstiness(edges.select(F.col(end).alias("node_id"), "timestamp")).withColumnRenamed("burstiness", f"{prefix}_burstiness")
    return stats.join(bursts, "node_id", "left")


def holding_time(edges: DataFrame) -> DataFrame:
    """Median over a node's dated outflows of the time since its latest inflow at or before it, ties included.

    Flows are counted by node and time first; a hub's times are cut into ranges, over
    whose edges its last inflow is carried.
    """
    flows = edges.where("timestamp IS NOT NULL")
    both = flows.select(F.col("dst").alias("node_id"), "timestamp", F.lit(0).alias("n")).union(flows.select("src", "timestamp", F.lit(1))).where("node_id IS NOT NULL")
    times = both.groupBy("node_id", "timestamp").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") == 0, F.col("timestamp"))).alias("t_in"))
    held = running_last(times, ["timestamp"], ["node_id"], "t_in", "before").withColumn("latest", F.coalesce("t_in", "before")).where("n > 0 AND latest IS NOT NULL")
    return held.groupBy("node_id").agg(F.percentile(F.col("timestamp") - F.col("latest"), F.lit(0.5), F.col("n")).alias("holding_time_median"))


def payment_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, sums, retention (in - out) / (in + out), velocity events / (span + 1) and median holding time, per node."""
    df = nodes.select("node_id").join(direction_sums(edges, "dst", "in"), "node_id", "left").join(direction_sums(edges, "src", "out"), "node_id", "left").join(holding_time(edges), "node_id", "left")
    total_in, total_out = F.coalesce("in_sum", F.lit(0.0)), F.coalesce("out_sum", F.lit(0.0))
    span = F.greatest("in_last", "out_last") - F.least("in_first", "out_first")
    events = F.coalesce("in_count", F.lit(0)) + F.coalesce("out_count", F.lit(0))
    return df.select(
        "node_id", zero("in_count"), zero("out_count"), F.when(total_in + total_out > 0, (total_in - total_out) / (total_in + total_out)).alias("retention_ratio"),
        F.when(span.isNotNull(), events / (span + 1)).alias("velocity"), "holding_time_median",
    )


def line_graph_flow(edges: DataFrame) -> DataFrame:
    """Two-walk throughput in * out, its log1p, pass ratio, and degrees one step up- and downstream; self-loops dropped, parallels kept."""
    e = edges.where("src <> dst").select("src", "dst")
    ins = e.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("i"))
    outs = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    base = ins.join(outs, "node_id", "full").select("node_id", zero("i"), zero("o"))
    up = e.join(base.select(F.col("node_id").alias("src"), "i"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.avg("i").alias("up_mean"), F.max("i").alias("up_max"))
    down = e.join(base.select(F.col("node_id").alias("dst"), "o"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("o").alias("down_mean"), F.max("o").alias("down_max"))
    flow = F.col("i") * F.col("o")
    return base.join(up, "node_id", "left").join(down, "node_id", "left").select(
        "node_id", flow.alias("flow"), F.log1p(flow).alias("flow_log"), (flow / (F.col("i") + F.col("o"))).alias("pass_ratio"), "up_mean", "up_max", "down_mean", "down_max"
    )


def neighbour_means(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each feature over distinct undirected neighbours, nulls skipped; nodes without neighbours get nulls."""
    pairs = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    values = features.select(F.col("node_id").alias("dst"), *columns)
    means = pairs.join(values, "dst").groupBy(F.col("src").alias("node_id")).agg(*(F.avg(c).alias(f"nbr_{c}") for c in columns))
    return features.select("node_id").join(means, "node_id", "left")


def zscores(features: DataFrame, columns: list[str], fill_null: bool = True) -> DataFrame:
    """Columns less their mean over their deviation (one-row stats, broadcast); 0 for no variance, and for null if fill_null."""
    stats = features.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"__{c}") for c in columns))
    z = lambda c: F.when(F.col(c).isNull(), F.lit(0.0 if fill_null else None)).when(F.col(f"__{c}.s") > 0, (F.col(c) - F.col(f"__{c}.m")) / F.col(f"__{c}.s")).otherwise(0.0)
    return features.join(F.broadcast(stats)).select("node_id", *(z(c).alias(c) for c in columns))


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, with direction 0 or 1 and a relation number: the place of the type, plus the number of types for reverses."""
    types = edges.agg(F.array_sort(F.collect_set("edge_type")).alias("types"))
    e = edges.join(F.broadcast(types))
    at = (F.array_position("types", F.col("edge_type")) - 1).cast("long")
    there = e.select("src", "dst", F.lit(0).cast("long").alias("direction"), at.alias("relation"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("direction"), (at + F.size("types")).alias("relation"))
    return there.union(back)


def collapsed(edges: DataFrame) -> DataFrame:
    """One row for parallel edges: the amount of the latest, the largest of those at the same time."""
    last = F.max_by("amount", F.struct("timestamp", "amount")).alias("amount")
    return edges.groupBy("src", "dst").agg(last, F.max("timestamp").alias("timestamp"), F.count("*").alias("parallel"))


def frozen_zscores(fit: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of df standardised with mean and deviation of fit; 0 for nulls and for no variance."""
    missing = [c for c in columns if c not in fit.columns or c not in df.columns]
    if missing:
        raise ValueError(f"columns not in both tables: {missing}")
    stats = fit.agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("d", F.stddev_samp))))
    z = {c: F.when(F.col(f"__d_{c}") > 0, F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}"), F.lit(0.0))).otherwise(0.0) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).select(*df.columns)


def community_stats(degrees: DataFrame, communities: DataFrame) -> DataFrame:
    """Size of each node's community and its degree over the community's mean, 1 where that is 0.

    degrees has node_id and degree, communities node_id and community_id; nodes without
    a community share one group.
    """
    df = degrees.select("node_id", "degree").join(communities.select("node_id", "community_id"), "node_id", "left")
    own = df.groupBy("community_id").agg(F.count("*").alias("community_size"), F.avg("degree").alias("mean"))
    both = df.join(own, df.community_id.eqNullSafe(own.community_id))
    return both.select("node_id", "community_size", F.when(F.col("mean") > 0, F.col("degree") / F.col("mean")).otherwise(1.0).alias("degree_rel_community"))


#: Columns of the structural template.
TEMPLATE = ["in_degree", "out_degree", "degree", "mutual_degree", "clustering", "core", "triangles", "burstiness", "community_size", "degree_rel_community"]


def structural_template(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """All structural features (node_id and TEMPLATE), one row per node; components stand in for communities.

    Pairs are numbered once for components, triangles and cores; numbers are in the order of names.
    """
    nodes = nodes.select("node_id").distinct()
    numbered = pairs, names = numbered_pairs(edges)
    if communities is None:
        parts = connected_components(pairs, "u", "v").join(names.toDF("node_id", "node"), "node").join(names.toDF("least", "component"), "component").select("node_id", F.col("least").alias("component"))
        communities = nodes.join(parts, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("community_id"))
    d = staged(degrees(nodes, edges), "degrees")
    df = d.join(mutual_degree(edges), "node_id", "left").join(triangles(edges, numbered).drop("simple_degree"), "node_id", "left").join(k_core(edges, numbered), "node_id", "left")
    df = df.join(burstiness(incident_events(edges.where("timestamp IS NOT NULL"))), "node_id", "left").join(community_stats(d, communities), "node_id")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("mutual_degree", "triangles", "core")} | {"clustering": F.coalesce("clustering", F.lit(0.0))}
    return df.withColumns(filled).select("node_id", *TEMPLATE)


def within_groups(edges: DataFrame) -> DataFrame:
    """Edges whose ends are in one group."""
    return edges.where(group_of("src") == group_of("dst"))


def grouped_zscores(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised inside each node's group; 0 for nulls and for no variance."""
    df = features.withColumn("group", group_of("node_id"))
    stats = df.groupBy("group").agg(*(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"__{c}") for c in columns))
    z = lambda c: F.when(F.col(f"__{c}.s") > 0, F.coalesce((F.col(c) - F.col(f"__{c}.m")) / F.col(f"__{c}.s"), F.lit(0.0))).otherwise(0.0)
    return df.join(stats, "group").select("node_id", "group", *(z(c).alias(c) for c in columns))


def structural_floor(template: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per node the mean over its standardised features of what lies above the mean."""
    columns = TEMPLATE if columns is None else columns
    z = zscores(template, columns)
    return z.select("node_id", (sum((F.greatest(F.col(c), F.lit(0.0)) for c in columns[1:]), F.greatest(F.col(columns[0]), F.lit(0.0))) / len(columns)).alias("score"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (node_id, community_id) of the undirected projection weighted by parallels."""
    w = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).groupBy("u", "v").agg(F.count("*").alias("w"))
    c = communities.select("node_id", "community_id")
    df = w.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v")
    inside = df.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0)).alias("own"))
    degree = df.select(F.col("cu").alias("c"), "w").union(df.select("cv", "w")).groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.join(F.broadcast(degree)).select((F.col("own") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs u < v without loops, weighted by their parallels (w); written."""
    e = edges.where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL")
    return staged(e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).groupBy("u", "v").agg(F.sum(F.lit(1.0)).alias("w")), "weighted")


def label_propagation(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """Communities (node_id, community_id) in which half of the nodes, by hash, take in each of rounds rounds the heaviest label around them, their own of equals, else the least; a base line."""
    base = weighted_pairs(edges)
    both = staged(base.union(base.select("v", "u", "w")), "links")
    state = staged(both.select("u").distinct().select("u", F.col("u").alias("c")), "labels")
    for turn in range(rounds):
        near = both.join(state.toDF("v", "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w")).join(state.toDF("u", "now"), "u")
        best = near.groupBy("u", "now").agg(F.min_by("c", F.struct((-F.col("w")).alias("w"), (F.col("c") != F.col("now")).alias("other"), "c")).alias("best"))
        state = staged(best.select("u", F.when(F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0, F.col("best")).otherwise(F.col("now")).alias("c")), "labels")
    return state.toDF("node_id", "community_id")


def _moved(both: DataFrame, degree: DataFrame, two_m: float, resolution: float, tolerance: float, rounds: int, salt: int, longer: int) -> tuple[DataFrame, int]:
    """Communities (u, k, c) of the nodes of links both (u, v, w) of degrees (u, k) after moves, and how many nodes moved in all.

    Links carry the degree of u, which moves don't change, and take along the community of v
    and its degree, so that in a round they are dealt once, by u. Once all gains together are
    within the tolerance, up to longer rounds follow while any node gains.
    """
    state, total_moves, least = staged(degree.select("u", "k", F.col("u").alias("c")), "state"), 0, tolerance * two_m
    links = staged(both.where("u <> v").join(state.select("u", "k"), "u").select("u", "k", "v", "w"), "links")
    none = F.lit(None).cast("boolean").alias("stays")
    for turn in range(rounds):
        now = state.join(state.groupBy("c").agg(F.sum("k").alias("kc")), "c")
        near = links.join(now.select(F.col("u").alias("v"), "c", "kc"), "v").select("u", "k", "c", "kc", "w", none)
        own = now.select("u", "k", "c", "kc", F.lit(0.0).alias("w"), F.lit(True).alias("stays"))
        may = near.union(own).repartition("u").groupBy("u", "c").agg(F.max("k").alias("k"), F.max("kc").alias("kc"), F.sum("w").alias("wc"), F.max("stays").isNotNull().alias("stays"))
        gain = F.col("wc") - resolution * F.col("k") * (F.col("kc") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / two_m
        scored = may.select("u", "k", "c", F.round(gain, 9).alias("gain"), "stays")
        best = scored.groupBy("u").agg(
            F.max("k").alias("k"), F.max(F.when(F.col("stays"), F.col("c"))).alias("now"),
            F.min_by("c", F.struct((-F.col("gain")).alias("g"), (~F.col("stays")).alias("s"), "c")).alias("best"), (F.max("gain") - F.max(F.when(F.col("stays"), F.col("gain")))).alias("more"),
        )
        # Fewer nodes move at a time as rounds go on, so that neighbours don't go on swapping.
        turns = F.pmod(F.xxhash64("u", F.lit(salt + turn)), F.lit(2 + turn // 8)) == 0
        state = staged(best.select("u", "k", F.when(turns, F.col("best")).otherwise(F.col("now")).alias("c"), "more", (turns & (F.col("best") != F.col("now"))).alias("moves")), "state")
        wanted, changed = state.agg(F.coalesce(F.sum("more"), F.lit(0.0)), F.count_if("moves")).first()
        state, total_moves = state.select("u", "k", "c"), total_moves + changed
        if wanted <= least:
            if not wanted or not longer:
                return state, total_moves
            longer -= 1
    if wanted <= least:
        return state, total_moves
    raise RuntimeError(f"nodes still gain more than the tolerance after {rounds} rounds of moves")


def communities(edges: DataFrame, resolution: float = 1.0, least: int = 2, tolerance: float = 2e-3, rounds: int = 80, levels: int = 20) -> DataFrame:
    """Communities (node_id, community_id) of at least least nodes of the undirected projection weighted by parallels.

    In each round part of the nodes, by hash, may move to the neighbouring community with
    the largest gain of modularity, until all nodes together could gain no more than
    tolerance of the edges' weight; above the first level, where nodes are few, eight rounds
    more while any gains, as a level costs more than these. Communities are then cut into connected parts, which
    become nodes, and the next level begins, until none moves. A community bears its least
    node id. Ties fall to the least community, so a run repeats. Nodes bear long ids in the
    order of their names meanwhile. RuntimeError if rounds or levels do not suffice.
    """
    base = weighted_pairs(edges)
    two_m = 2 * (base.agg(F.sum("w")).first()[0] or 0.0)
    names = staged(row_numbers(base.select(F.col("u").alias("node_id")).union(base.select("v")).distinct(), ["node_id"], "id"), "names")
    links = staged(base.join(names.toDF("u", "a"), "u").join(names.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "w"), "weighted")
    owner = names.select(F.col("id").alias("node_id"), F.col("id").alias("community_id"))
    for level in range(levels):
        both = staged(links.select("u", "v", "w").union(links.where("u <> v").select("v", "u", "w")), "links")
        degree = both.groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))
        state, moves = _moved(both, degree, two_m, resolution, tolerance, rounds, level * rounds, longer=8 if level else 0)
        if not moves:
            break
        inside = links.where("u <> v").join(state.select("u", F.col("c").alias("a")), "u").join(state.select(F.col("u").alias("v"), F.col("c").alias("b")), "v").where("a = b")
        joined = connected_components(inside, "u", "v").select(F.col("node").alias("u"), F.col("component").alias("c"))
        part = staged(state.select("u").join(joined, "u", "left").select("u", F.coalesce("c", "u").alias("c")), "parts")
        owner = staged(owner.join(part.select(F.col("u").alias("community_id"), "c"), "community_id").select("node_id", F.col("c").alias("community_id")), "owners")
        up = links.join(part.withColumnRenamed("c", "a"), "u").join(part.toDF("v", "b"), "v")
        links = staged(up.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "weighted")
    else:
        raise RuntimeError(f"communities still grow after {levels} levels")
    large = owner.groupBy("community_id").agg(F.count("*").alias("n"), F.min("node_id").alias("first")).where(F.col("n") >= least)
    own = owner.join(large, "community_id").select(F.col("node_id").alias("id"), "first")
    return own.join(names, "id").join(names.toDF("community_id", "first"), "first").select("node_id", "community_id")
