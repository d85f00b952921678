"""Known motifs planted into a ledger, and whether scores find them again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators.evaluation import recovery_at_budgets

MEMBERS = {"cycle": 5, "fan_in": 9, "fan_out": 9, "common_control": 4, "pass_through": 5}


def draw(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in keys)), F.lit(1 << 30)) / float(1 << 30)


def between(u: Column, low: float | Column, high: float | Column) -> Column:
    return low + u * (high - low)


def instances(spark: SparkSession, motif: str, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(f"{motif}:{seed}x"), F.col("id").cast("string")).alias("instance_id"))


def payment_motif(spark: SparkSession, motif: str, n: int, window: tuple[int, int], seed: int) -> DataFrame:
    """Edges of n instances of a payment motif in a window of time: instance_id and the columns of edges.

    A cycle returns 97 to 100 percent at each step; deposits of a fan_in lie just below
    10,000; a fan_out splits one sum; common control is a clique of links with a few
    payments; a pass-through forwards almost all at each tick.
    """
    t0, t1 = window
    k = MEMBERS[motif]
    own = lambda i: F.concat(F.lit("inj:"), F.col("instance_id"), F.lit(":"), i.cast("string"))
    df = instances(spark, motif, n, seed).withColumns({"u": draw(seed, "instance_id"), "v": draw(seed + 1, "instance_id")})
    time = lambda *keys: F.floor(between(draw(seed + 2, "instance_id", *keys), t0, t1 + 1))
    i = F.col("i")
    each = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1 if motif != "pass_through" else k - 2))))
    pays = F.lit("pays")
    if motif == "cycle":
        e = each.select("instance_id", own(i).alias("src"), own((i + 1) % k).alias("dst"), pays.alias("edge_type"), F.floor(t0 + (i + F.col("v")) * (t1 - t0) / k).alias("timestamp"), (between(F.col("u"), 5e3, 5e4) * between(draw(seed + 3, "instance_id", "i"), 0.97, 1.0)).alias("amount"))
    elif motif == "fan_in":
        e = each.where("i > 0").select("instance_id", own(i).alias("src"), own(F.lit(0)).alias("dst"), pays.alias("edge_type"), time("i").alias("timestamp"), between(draw(seed + 3, "instance_id", "i"), 8e3, 9.9e3).alias("amount"))
    elif motif == "fan_out":
        e = each.where("i > 0").select("instance_id", own(F.lit(0)).alias("src"), own(i).alias("dst"), pays.alias("edge_type"), time("i").alias("timestamp"), (between(F.col("u"), 5e4, 2e5) * (0.5 + draw(seed + 3, "instance_id", "i")) / (k - 1)).alias("amount"))
    elif motif == "common_control":
        pairs = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("j > i")
        links = pairs.select("instance_id", own(i).alias("src"), own(F.col("j")).alias("dst"), F.lit("linked_to").alias("edge_type"), F.lit(t0).alias("timestamp"), F.lit(None).cast("double").alias("amount"))
        e = links.union(each.where(i < k - 1).select("instance_id", own(i), own(i + 1), pays, time("i"), between(draw(seed + 3, "instance_id", "i"), 1e3, 2e4)))
    else:
        start = F.floor(between(F.col("v"), t0, max(t0 + 1, t1 - k)))
        e = each.select("instance_id", own(i).alias("src"), own(i + 1).alias("dst"), pays.alias("edge_type"), (start + i).alias("timestamp"), (between(F.col("u"), 2e4, 1e5) * F.pow(F.lit(0.99), i)).alias("amount"))
    return finished(e)


def finished(e: DataFrame) -> DataFrame:
    return e.select("instance_id", "src", "dst", "edge_type", F.col("timestamp").cast("long").alias("timestamp"), "amount", (F.col("edge_type") != "linked_to").alias("directed"))


def tender_motif(spark: SparkSession, motif: str, n: int, window: tuple[int, int], seed: int) -> DataFrame:
    """Edges of n instances of a procurement motif: rotation, cover_bid, partition, common_control or coordinated_cluster."""
    t0, t1 = window
    df = instances(spark, motif, n, seed).withColumn("m", F.translate(F.concat(F.lit("inj_"), "instance_id"), ":", "_"))
    name = lambda kind, i: F.concat(F.lit(f"{kind}:"), F.col("m"), F.lit(":"), i.cast("string"))
    year = F.floor(between(draw(seed, "instance_id", "t"), t0, t1 + 1))
    turns = lambda k: df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    row = lambda d, src, dst, kind, when=year, amount=None: d.select("instance_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), when.alias("timestamp"), (F.lit(None).cast("double") if amount is None else amount).alias("amount"))
    t, f = F.col("t"), F.col("f")
    price = between(draw(seed + 1, "instance_id", "t"), 1e5, 5e5)
    if motif == "rotation":
        return finished(row(turns(8), name("tender", t), name("firm", t % 4), "awarded"))
    if motif == "cover_bid":
        bids = turns(1).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4))))
        amount = price * F.when(f == 0, 1.0).otherwise(between(draw(seed + 2, "instance_id", "f"), 1.01, 1.05))
        return finished(row(bids, name("firm", f), name("tender", t), "bids_on", amount=amount).union(row(bids.where("f = 0"), name("tender", t), name("firm", f), "awarded", amount=price)))
    if motif == "partition":
        side = (t / 4).cast("int")
        return finished(row(turns(8), name("buyer", side), name("tender", t), "buys_from").union(row(turns(8), name("tender", t), name("firm", side * 2 + t % 2), "awarded")))
    if motif == "common_control":
        pairs = turns(3).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("f > t")
        links = row(pairs, name("firm", t), name("firm", f), "linked_to", F.lit(t0))
        return finished(links.union(row(turns(3), name("buyer", F.lit(0)), name("tender", t), "buys_from")).union(row(turns(3), name("tender", t), name("firm", t), "awarded")))
    if motif == "coordinated_cluster":
        bids = turns(4).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(3))))
        amount = price * (1 + 0.01 * f + 0.004 * draw(seed + 2, "instance_id", "t", "f"))
        return finished(row(bids, name("firm", f), name("tender", t), "bids_on", amount=amount).union(row(bids.where("f = t"), name("tender", t), name("firm", f), "awarded", amount=price)))
    raise ValueError(f"no motif {motif!r}")


def injected(nodes: DataFrame, edges: DataFrame, planted: DataFrame, seed: int, bridges: int = 1, financial: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Background with planted edges (instance_id, ...), and the truth (instance_id, motif_type, member_node_ids, n_edges).

    Nothing of the background changes; a planted node that is already there is an error.
    Each instance gets bridges edges to hash-drawn background nodes: payments either way,
    or bids of a planted firm on a background tender.
    """
    ends = planted.select("instance_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    if clash := [r[0] for r in ends.join(nodes.select("node_id"), "node_id", "left_semi").limit(5).collect()]:
        raise ValueError(f"planted nodes are already there: {sorted(clash)}")
    first = planted.groupBy("instance_id").agg(F.min("timestamp").alias("t"), F.max("timestamp").alias("t1"), F.count("*").alias("n_edges"))
    truth = ends.groupBy("instance_id").agg(F.array_sort(F.collect_list("node_id")).alias("member_node_ids")).join(first.select("instance_id", "n_edges"), "instance_id")
    truth = truth.select("instance_id", F.substring_index("instance_id", ":", 1).alias("motif_type"), "member_node_ids", "n_edges")
    new = ends.join(first.select("instance_id", "t"), "instance_id").select("node_id", F.col("t").alias("time_first_seen"))
    pool = nodes.select("node_id") if financial else nodes.where(F.col("node_id").startswith("tender:")).select("node_id")
    buckets = max(1, truth.count() * bridges)
    # Each bridge asks for a bucket of the background and takes its least node, so one grouped pass serves all instances.
    target = pool.groupBy(F.pmod(F.xxhash64(F.lit(seed), "node_id"), F.lit(buckets)).alias("bucket")).agg(F.min("node_id").alias("other"))
    own = ends if financial else ends.where(F.col("node_id").startswith("firm:"))
    asks = own.groupBy("instance_id").agg(F.min("node_id").alias("mine")).join(first.select("instance_id", "t", "t1"), "instance_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bridges - 1)))) if bridges else None
    every = edges.select("src", "dst", "edge_type", "timestamp", "amount").union(planted.select("src", "dst", "edge_type", "timestamp", "amount"))
    if asks is not None:
        met = asks.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "instance_id", "b"), F.lit(buckets))).join(target, "bucket")
        out = F.lit(True) if not financial else draw(seed, "instance_id", "b") < 0.5
        every = every.union(met.select(
            F.when(out, F.col("mine")).otherwise(F.col("other")), F.when(out, F.col("other")).otherwise(F.col("mine")), F.lit("pays" if financial else "bids_on"),
            F.floor(between(draw(seed + 2, "instance_id", "b"), F.col("t"), F.col("t1") + 1)).cast("long"), between(draw(seed + 3, "instance_id", "b"), 1e3, 5e4),
        ))
    return nodes.select("node_id", "time_first_seen").union(new), every, truth


def recovery_study(nodes: DataFrame, edges: DataFrame, scorers: dict, motifs: dict[str, int], window: tuple[int, int], seeds: list[int], budgets: list[int]) -> DataFrame:
    """Recall of planted members by scorer, motif, budget and seed; a scorer takes nodes and edges and returns (node_id, score)."""
    out = []
    for seed in seeds:
        planted = reduce(DataFrame.unionByName, (payment_motif(edges.sparkSession, m, n, window, seed) for m, n in motifs.items()))
        n, e, truth = injected(nodes, edges, planted, seed)
        for name, scorer in scorers.items():
            found = recovery_at_budgets(scorer(n, e), truth, budgets)
            out.append(found.unpivot(["motif_type", "n_members"], [f"recall_at_{k}" for k in budgets], "budget", "recall").select(F.lit(name).alias("member"), F.lit(seed).alias("seed"), "motif_type", F.regexp_extract("budget", r"(\d+)$", 1).cast("long").alias("budget"), "recall"))
    return reduce(DataFrame.unionByName, out)
