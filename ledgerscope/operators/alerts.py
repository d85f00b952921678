"""Alert queues: overlap, greedy rank-ordered removal of overlapping alerts, hits and coverage."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import shared_folder, staged
from ledgerscope.operators.components import connected_components
from ledgerscope.operators.order import row_numbers

#: Fixed value: what every alert says.
CAVEAT = "screening signal only — no determination of guilt"


def _met(placed: DataFrame, listed: int = 500, in_task: int = 1_000_000) -> DataFrame:
    """Rows (better, n, p, worse, m, q) for each member that two alerts of placed (rank, node_id, n, p, met) share, in partitions of better of about in_task rows.

    Lists hold at most listed alerts, from the worst; a longer one is met with each of those
    before it. They are most of what is shuffled, so ranks, sizes and places are as short as they fit.
    """
    kind = dict(placed.dtypes)["rank"]
    rows, longest, last, largest = placed.agg(F.sum((F.col("met") - 1) / 2), F.max("met"), F.max("rank"), F.max("n")).first()
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows or 0) // in_task))
    kinds = {"rank": "int" if (last or 0) < 1 << 31 else kind, **dict.fromkeys("np", "smallint" if (largest or 0) < 1 << 15 else "int")}
    entry = F.struct(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("rank")))
    lists = placed.withColumn("part", F.floor((place - 1) / listed)) if (longest or 0) > listed else placed.withColumn("part", F.lit(0))
    lists = lists.groupBy("node_id", "part").agg(F.sort_array(F.collect_list(entry), asc=False).alias("l"))
    arrays = [F.col(f"l.{c}").alias(f"{c}s") for c in ("rank", "n", "p")]
    own = lists.select(*arrays, F.posexplode("l").alias("i", "x")).where("i > 0").select("x", *(F.slice(f"{c}s", 1, F.col("i")).alias(f"{c}s") for c in ("rank", "n", "p")))
    if (longest or 0) > listed:
        lists = staged(lists, "lists")
        before = lists.select("node_id", F.col("part").alias("before"), *arrays)
        own = own.union(lists.join(before, "node_id").where("before < part").select(F.explode("l").alias("x"), "ranks", "ns", "ps"))
    dealt = own.select(F.col("x.rank").alias("better"), F.col("x.n").alias("n"), F.col("x.p").alias("p"), "ranks", "ns", "ps").repartition(parts, "better")
    y = dealt.select("better", "n", "p", F.explode(F.arrays_zip("ranks", "ns", "ps")).alias("y"))
    return y.select("better", *(F.col(c).cast("int").alias(c) for c in "np"), F.col("y.ranks").alias("worse"), F.col("y.ns").cast("int").alias("m"), F.col("y.ps").cast("int").alias("q"))


def overlaps(members: DataFrame, least: float) -> DataFrame:
    """Pairs better, worse (ranks) of alerts whose member sets have a Jaccard similarity (jaccard) above least; members has rank, node_id.

    Sets of n and m members are so alike only if they share more than
    least / (1 + least) * (n + m). Members are ordered from the rarest; all but the last
    least * n of a set, its prefix, hold one that is shared. Of each member in prefixes
    the alerts are listed, and every alert takes the worse ones of its lists along; they
    become pairs only where they are counted, so what is shuffled are the lists. A met
    pair is dropped where the members before and after its places can't be enough, then
    counted; after its last places p and q it shares at most min(n - p, m - q) more, and
    what it shares outside both prefixes lies after that prefix of the two which ends
    first, so that what can't reach the need is dropped unseen. For the pairs that are
    left the few members after the prefixes are looked up as well.
    """
    kind = dict(members.dtypes)["rank"]
    of_node, of_alert = Window.partitionBy("node_id"), Window.partitionBy("rank")
    known = members.select("rank", "node_id").repartition("node_id").distinct().withColumn("met", F.when(F.col("node_id").isNull(), 1).otherwise(F.count("*").over(of_node)))
    prefix = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    placed = known.withColumns({"n": F.count("*").over(of_alert), "p": F.row_number().over(of_alert.orderBy("met", "node_id"))}).where("met > 1")
    placed = staged(placed.withColumn("late", F.col("p") > prefix), "placed")
    met = _met(placed.where("NOT late").drop("late"))
    need = F.floor(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9) + 1
    after = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    met = met.where((F.least("n", "m") > least * F.greatest("n", "m")) & (F.least("p", "q") + after >= need))
    met = met.groupBy("better", "worse").agg(F.count("*").alias("both"), *(F.max(c).alias(c) for c in "nmpq"))
    beyond = lambda size: size - F.least(size - F.ceil(least * size - 1e-9) + 1, size)
    open_end = F.greatest(beyond(F.col("n")), beyond(F.col("m")))
    met = staged(met.where(F.col("both") + F.least(after, open_end) >= need).withColumn("exact", open_end == 0), "met")
    rest = met.where("NOT exact").select("better", "worse")
    late = placed.where("late").select("rank", "node_id")
    asked = rest.join(late.withColumnRenamed("rank", "better"), "better").select("better", "worse", "node_id", F.col("worse").alias("rank"), F.lit(True).alias("any"))
    asked = asked.union(rest.join(late.withColumnRenamed("rank", "worse"), "worse").select("better", "worse", "node_id", F.col("better").alias("rank"), F.lit(False).alias("any")))
    more = asked.join(placed.select("rank", "node_id", "late"), ["rank", "node_id"]).where("any OR NOT late").select("better", "worse")
    both = met.join(more.groupBy("better", "worse").agg(F.count("*").alias("more")), ["better", "worse"], "left").withColumn("both", F.col("both") + F.coalesce("more", F.lit(0)))
    return both.select(*(F.col(c).cast(kind).alias(c) for c in ("better", "worse")), (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") > least)


def conflicts(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs better, worse of overlaps() above threshold."""
    return overlaps(members, threshold).select("better", "worse")


def _walked(pairs: pd.DataFrame) -> pd.Series:
    """The better and worse ranks of some pairs, walked in rank order: rank and whether it is kept."""
    held: dict[int, list[int]] = {}
    for better, worse in zip(pairs["better"].tolist(), pairs["worse"].tolist(), strict=True):
        held.setdefault(worse, []).append(better)
    kept: dict[int, bool] = {}
    for rank in sorted(set(pairs["better"].tolist()) | held.keys()):
        kept[rank] = not any(kept[b] for b in held.get(rank, ()))
    return pd.Series(kept, dtype=bool)


def settled(alerts: DataFrame, pairs: DataFrame, keys: list[str], one_task: int = 500_000) -> DataFrame:
    """keys, rank and kept of alerts under pairs (keys, better, worse), as if walked in rank order for each value of keys.

    Alerts without a pair are kept. The others are walked, each connected part of the
    pairs in one task if it has at most one_task pairs; if all pairs of a value of keys
    are as few, they are one part. In larger parts, alerts without a better conflict are
    accepted and their conflicts suppressed, until what is left falls into parts that fit.
    """
    spark = alerts.sparkSession
    pairs = staged(pairs.select(*keys, "better", "worse"), "conflicts")
    kind = dict(alerts.dtypes)["rank"]
    names = [*keys, "part"]
    schema = ", ".join([*(f"`{k}` {dict(alerts.dtypes)[k]}" for k in keys), f"rank {kind}, kept boolean"])

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        kept = _walked(df)
        return pd.DataFrame({**{k: df[k].iloc[0] for k in keys}, "rank": kept.index.to_numpy(), "kept": kept.to_numpy()})[[*keys, "rank", "kept"]]

    ends = pairs.select(*keys, F.explode(F.array("better", "worse")).alias("rank")).distinct()
    path, number = f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}", 0

    def add(df: DataFrame) -> None:
        """Write to the next part of the result; parts are read as one table."""
        nonlocal number
        df.select(*keys, "rank", "kept").write.parquet(f"{path}/part={number}")
        number += 1

    add(alerts.join(ends, [*keys, "rank"], "left_anti").withColumn("kept", F.lit(True)))
    left, whole = pairs, True
    while not left.isEmpty():
        if whole:
            parts = left.withColumn("part", F.lit(0))
        else:
            a, b = (F.struct(*keys, F.col(c).alias("rank")) for c in ("better", "worse"))
            part = connected_components(left.select(a.alias("a"), b.alias("b"))).select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.rank").alias("better"), F.col("component.rank").alias("part"))
            parts = staged(left.join(part, [*keys, "better"]).select(*keys, "better", "worse", "part"), "parts")
        size = parts.groupBy(*names).agg(F.count("*").alias("n"))
        small = parts.join(size.where(F.col("n") <= one_task).select(*names), names, "left_semi")
        add(small.groupBy(*names).applyInPandas(walk, schema))
        left = staged(parts.join(size.where(F.col("n") > one_task).select(*names), names, "left_semi").select(*keys, "better", "worse"), "conflicts")
        if whole:
            whole = False
            continue
        for _ in range(8):
            held = left.select(*keys, F.col("worse").alias("rank")).distinct()
            accepted = staged(left.select(*keys, F.col("better").alias("rank")).distinct().join(held, [*keys, "rank"], "left_anti"), "accepted")
            out = staged(left.join(accepted.withColumnRenamed("rank", "better"), [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias("rank")).distinct(), "suppressed")
            add(accepted.withColumn("kept", F.lit(True)).union(out.withColumn("kept", F.lit(False))))
            both = accepted.union(out)
            rest = left.join(out.withColumnRenamed("rank", "worse"), [*keys, "worse"], "left_anti").join(both.withColumnRenamed("rank", "better"), [*keys, "better"], "left_anti")
            rest = staged(rest.select(*keys, "better", "worse"), "conflicts")
            # What no pair holds any more is neither suppressed nor to be suppressed.
            free = left.select(*keys, F.explode(F.array("better", "worse")).alias("rank")).distinct().join(both, [*keys, "rank"], "left_anti")
            add(free.join(rest.select(*keys, F.explode(F.array("better", "worse")).alias("rank")).distinct(), [*keys, "rank"], "left_anti").withColumn("kept", F.lit(True)))
            left = rest
            if left.isEmpty():
                break
    return spark.read.schema(schema).parquet(path).select(*keys, "rank", "kept")


def _of_size(alerts: DataFrame, members: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Alerts of at most most members, and these, written; None keeps all that have members."""
    if most is not None:
        n = F.count("*").over(Window.partitionBy("rank"))
        members = staged(members.select("rank", "node_id").repartition("rank").distinct().withColumn("n", n).where(F.col("n") <= most).drop("n"), "sized")
    return alerts.join(members.select("rank").distinct(), "rank", "left_semi"), members


def greedy_dedup(alerts: DataFrame, members: DataFrame, threshold: float = 0.5, most: int | None = 100, one_task: int = 500_000) -> DataFrame:
    """alerts (rank, ...) of at most most members (None: of any number) with kept and overlap_group, as if walked in rank order.

    An alert is suppressed if its overlap with an accepted better one is above
    threshold; its group is that of the best such one, accepted ones are numbered from
    0. Larger alerts leave first; dedup_report() counts them.
    """
    alerts, members = _of_size(alerts, members, most)
    pairs = staged(conflicts(members, threshold), "overlaps")
    state = settled(alerts, pairs, [], one_task)
    accepted = row_numbers(state.where("kept").select("rank"), ["rank"], "g").withColumn("g", F.col("g") - 1)
    owner = pairs.join(accepted.withColumnsRenamed({"rank": "better", "g": "owner"}), "better").groupBy(F.col("worse").alias("rank")).agg(F.min("owner").alias("owner"))
    out = alerts.join(state, "rank").join(accepted, "rank", "left").join(owner, "rank", "left")
    return out.withColumn("overlap_group", F.when(F.col("kept"), F.col("g")).otherwise(F.col("owner"))).drop("g", "owner")


def dedup_report(alerts: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row: alerts, those too large, kept and suppressed ones."""
    n = deduped.agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_suppressed"))
    return alerts.agg(F.count("*").alias("n_input")).join(F.broadcast(n)).select("n_input", (F.col("n_input") - F.col("n_kept") - F.col("n_suppressed")).alias("n_oversized"), "n_kept", "n_suppressed")


def hit_rule(members: DataFrame, labels: DataFrame, least: int = 2, share: float | None = None) -> DataFrame:
    """Per alert: members, illicit and confirmed ones, and whether at least least are illicit, and share of the confirmed ones if given; unknown is neither."""
    df = members.join(labels, "node_id", "left")
    g = df.groupBy("rank").agg(F.count("*").alias("n_members"), F.count_if(F.col("label") == "illicit").alias("n_illicit"), F.count_if(F.col("label").isin("illicit", "licit")).alias("n_confirmed"))
    hit = F.col("n_illicit") >= least
    return g.withColumn("is_hit", hit if share is None else hit & (F.col("n_illicit") >= share * F.col("n_confirmed")))


def build_alerts(communities: DataFrame, nodes: DataFrame, dataset: str, run: str, most: int = 100) -> DataFrame:
    """Ranked alerts from communities (community_id, score, member_node_ids) of at most most members.

    Best score first, ties by community_id; the window spans the times at which members
    were first seen. A screening signal is for review, which every alert says.
    """
    ranked = row_numbers(communities.where(F.size("member_node_ids") <= most), [F.desc("score"), "community_id"])
    times = ranked.select("community_id", F.explode("member_node_ids").alias("node_id")).join(nodes.select("node_id", "time_first_seen"), "node_id")
    spans = times.groupBy("community_id").agg(F.min("time_first_seen").alias("time_window_start"), F.max("time_first_seen").alias("time_window_end"))
    return ranked.join(spans, "community_id", "left").select(
        F.concat(F.lit(f"{dataset}:{run}:"), F.col("rank").cast("string")).alias("alert_id"), "rank", F.col("score").alias("risk_score"), "community_id", "member_node_ids",
        "time_window_start", "time_window_end", F.size("member_node_ids").alias("n_members"), F.lit(CAVEAT).alias("caveats"),
    )


def queue_metrics(hits: DataFrame, budgets: list[int]) -> DataFrame:
    """Per budget over a queue (rank, is_hit): hits, precision and false-alert rate among the first k alerts; k is cut at their number."""
    place = row_numbers(hits.select("rank", "is_hit"), ["rank"], "place")
    total = place.agg(F.count("*").alias("n")).where("n > 0")
    k = total.select(F.explode(F.array(*(F.lit(b).cast("long") for b in budgets))).alias("budget"), "n").withColumn("k_effective", F.least("budget", "n"))
    g = place.join(F.broadcast(k), F.col("place") <= F.col("k_effective")).groupBy("budget", "k_effective").agg(F.count_if("is_hit").alias("n_hits"))
    precision = F.col("n_hits") / F.col("k_effective")
    return g.select("budget", "k_effective", "n_hits", precision.alias("precision"), (1 - precision).alias("false_alert_rate"))


def percent_budgets(budgets: list[int | str], n: Column | str) -> list[Column]:
    """Budgets as columns: "N%" is the rounded (half to even) share of n, 1 at least; numbers stay."""
    out = []
    for b in budgets:
        if isinstance(b, str):
            share = float(b.removesuffix("%")) if b.endswith("%") else 0.0
            if not 0 < share <= 100:
                raise ValueError(f"budget {b!r} is no percentage in (0, 100]")
            out.append(F.greatest(F.lit(1), F.bround(F.col(n) * share / 100).cast("long")).cast("long"))
        else:
            out.append(F.lit(int(b)).cast("long"))
    return out


def sensitivity(alerts: DataFrame, members: DataFrame, labels: DataFrame, thresholds: list[float], shares: list[float | None], most: int | None = 100) -> DataFrame:
    """Per threshold and share: alerts kept and suppressed, and hits among the kept.

    Overlaps are found once, above the least threshold; the walks of all thresholds go
    through the same rounds.
    """
    few, some = _of_size(alerts.select("rank"), members, most)
    grid = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    pairs = overlaps(some, min(thresholds)).select("better", "worse", "jaccard", grid).where(F.col("jaccard") > F.col("threshold"))
    state = settled(few.select("rank", grid), pairs, ["threshold"])
    hits = hit_rule(members, labels, 1).select("rank", "n_illicit", "n_confirmed")
    rule = F.explode(F.array(*(F.lit(-1.0 if x is None else x) for x in shares))).alias("share")
    df = state.join(hits, "rank", "left").select("threshold", "kept", "n_illicit", "n_confirmed", rule)
    hit = (F.col("n_illicit") >= 1) & (F.col("n_illicit") >= F.col("share") * F.col("n_confirmed"))
    return df.groupBy("threshold", F.when(F.col("share") >= 0, F.col("share")).alias("share")).agg(
        F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_suppressed"), F.count_if(F.col("kept") & hit).alias("n_hits")
    )


def illicit_coverage(members: DataFrame, labels: DataFrame, budgets: list[int]) -> DataFrame:
    """Share of all illicit nodes met in the first k alerts."""
    bad = labels.where("label = 'illicit'").select("node_id")
    first = bad.join(members.groupBy("node_id").agg(F.min("rank").alias("first")), "node_id", "left")
    return first.agg(*(F.avg((F.coalesce("first", F.lit(1 << 40)) <= k).cast("double")).alias(f"at_{k}") for k in budgets))
