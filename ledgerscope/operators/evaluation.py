"""Metrics by step and member, bootstraps, recovery of planted members, and rating studies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.operators import alerts as queue
from ledgerscope.operators import scoring
from ledgerscope.operators.order import row_numbers, running_sums
from ledgerscope.operators.temporal import confirmed, in_hash_order


def average_precision_by(labelled: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Average precision, prevalence and counts of (keys, score, y) for each value of keys; auc_pr is null without both classes.

    Rows are counted by score first; the distinct scores of a key are summed up in ranges, so that no task holds a key.
    """
    w = F.col(weight) if weight else F.lit(1)
    g = labelled.groupBy(*keys, "score").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("hits"))
    g = running_sums(g, [F.desc("score")], keys, n_above="n", hits_above="hits")
    p = F.try_divide(F.col("hits_above") + F.col("hits"), F.col("n_above") + F.col("n"))
    out = g.groupBy(*keys).agg(F.sum(F.col("hits") * p).alias("ap"), F.sum("hits").alias("n_illicit"), F.sum("n").alias("n_confirmed"))
    both = (F.col("n_illicit") > 0) & (F.col("n_illicit") < F.col("n_confirmed"))
    return out.select(*keys, "n_confirmed", "n_illicit", F.when(both, F.col("ap") / F.col("n_illicit")).alias("auc_pr"), (F.col("n_illicit") / F.col("n_confirmed")).alias("prevalence"))


def metrics_by_step(scores: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Average precision of confirmed nodes by the step they are first seen in."""
    df = scores.join(confirmed(labels), "node_id").join(nodes.where("time_first_seen IS NOT NULL").select("node_id", F.col("time_first_seen").alias("step")), "node_id")
    return average_precision_by(df, ["step"])


def member_metrics(members: dict[str, DataFrame], labels: DataFrame, budgets: list[int]) -> DataFrame:
    """Average precision, and precision at each budget, of every member's confirmed scores."""
    y = confirmed(labels)
    named = reduce(DataFrame.union, (df.select(F.lit(m).alias("member"), "node_id", "score") for m, df in members.items()))
    out = average_precision_by(named.join(y, "node_id"), ["member"])
    cuts = []
    for m, df in members.items():
        at = scoring.budget_metrics(df.join(y, "node_id"), budgets)
        cuts.append(at.groupBy().agg(*(F.max(F.when(F.col("budget") == k, F.col("precision"))).alias(f"precision_at_{k}") for k in budgets)).withColumn("member", F.lit(m)))
    return out.join(reduce(DataFrame.unionByName, cuts), "member")


def evaluation_report(alerts: DataFrame, members: DataFrame, labels: DataFrame, scores: DataFrame, budgets: list[int]) -> DataFrame:
    """One report as rows (level, metric, budget, value): dedup counts, queue metrics and coverage, node metrics; alerts of any size."""
    deduped = staged(queue.greedy_dedup(alerts, members, most=None), "deduped")
    kept = deduped.where("kept").select("rank")
    own = members.join(kept, "rank", "left_semi")
    hits = queue.hit_rule(own, labels, 1)
    tall = lambda df, level, cols, b="CAST(NULL AS BIGINT)": df.select(F.lit(level).alias("level"), F.expr(b).cast("long").alias("budget"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols))).alias("m")).select("level", "m.metric", "budget", "m.value")
    places = row_numbers(kept, ["rank"], "place").select("rank", "place")
    coverage = queue.illicit_coverage(own.join(places, "rank").select(F.col("place").alias("rank"), "node_id"), labels, budgets)
    labelled = scores.join(confirmed(labels), "node_id")
    return reduce(DataFrame.union, [
        tall(queue.dedup_report(alerts, deduped), "dedup", ["n_input", "n_oversized", "n_kept", "n_suppressed"]),
        tall(queue.queue_metrics(hits, budgets), "queue", ["k_effective", "n_hits", "precision", "false_alert_rate"], "budget"),
        *(tall(coverage.select(F.lit(k).alias("budget"), F.col(f"at_{k}").alias("illicit_coverage")), "queue", ["illicit_coverage"], "budget") for k in budgets),
        tall(scoring.average_precision(labelled), "node", ["auc_pr", "prevalence"]),
        tall(scoring.budget_metrics(labelled, budgets), "node", ["precision", "recall", "fpr"], "budget"),
    ])


def draws_of_range(totals: np.ndarray, at: int, n_boot: int, seed: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Of totals[k] rows of class y in each range, drawn as often as there are rows, for every replicate the draws that fall on range at, and on those before it.

    Draws go down a tree of ranges: at each node a binomial, whose generator is seeded by
    the node, splits them between its halves. Every task walks the path to its own range.
    """
    low, high = 0, len(totals)
    draws, before = np.full(n_boot, totals.sum()), np.zeros(n_boot, np.int64)
    while high - low > 1:
        mid, both = (low + high) // 2, totals[low:high].sum()
        left = np.random.default_rng([seed, y, low, high]).binomial(draws, totals[low:mid].sum() / both if both else 0.0)
        if at < mid:
            draws, high = left, mid
        else:
            before, draws, low = before + left, draws - left, mid
    return draws, before


def drawn(counts: np.ndarray, draws: np.ndarray, seed: int, y: int, at: int) -> np.ndarray:
    """For every replicate the draws of each row of range at (counts of equal rows), of draws in all."""
    if not counts.sum():
        return np.zeros((len(draws), len(counts)), np.int64)
    return np.random.default_rng([seed, 2 + y, at]).multinomial(draws, counts / counts.sum())


def _ranged(counts: DataFrame, order: list[Column], per_range: int) -> tuple[DataFrame, np.ndarray]:
    """counts (..., n0, n1) in ranges (at) of order, written, and the ranges' totals of both classes, which are as few as the ranges."""
    counts = staged(counts, "counts")
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // per_range))
    dealt = staged(counts.repartitionByRange(parts, *order).withColumn("at", F.spark_partition_id()), "ranges")
    totals = np.zeros((2, parts), np.int64)
    for r in dealt.groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        totals[:, r["at"]] = r.n0, r.n1
    if not totals.sum():
        raise ValueError("no labelled rows to draw")
    return dealt, totals


def replicate_precision(labelled: DataFrame, n_boot: int, seed: int = 0, per_range: int = 20_000) -> DataFrame:
    """Rows (replicate, auc_pr) of labelled (score, y) under a bootstrap in which each class is drawn as often as it has rows; null without both classes.

    Rows are counted by score. A task takes a range of scores and draws how often each
    is met in every replicate (draws_of_range, drawn), with what was drawn above it, so
    that only one sum for each range and replicate is shuffled.
    """
    counts = labelled.groupBy("score").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    dealt, totals = _ranged(counts, [F.desc("score")], per_range)
    both = bool(totals.sum(1).all())

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df, at = df.sort_values("score", ascending=False), int(df["at"].iloc[0])
        (m0, above0), (m1, above1) = (draws_of_range(totals[y], at, n_boot, seed, y) for y in (0, 1))
        sums = np.zeros(n_boot)
        none, hit = (drawn(df[f"n{y}"].to_numpy(), m, seed, y, at) for y, m in ((0, m0), (1, m1)))
        hits = above1[:, None] + np.cumsum(hit, 1)
        met = above0[:, None] + np.cumsum(none, 1) + hits
        np.sum(hit * np.divide(hits, met, out=np.zeros(hits.shape), where=met > 0), 1, out=sums)
        return pd.DataFrame({"replicate": np.arange(n_boot), "ap": sums})

    sums = dealt.groupBy("at").applyInPandas(run, "replicate long, ap double").groupBy("replicate").agg(F.sum("ap").alias("ap"))
    return sums.select("replicate", (F.col("ap") / int(totals[1].sum()) if both else F.lit(None).cast("double")).alias("auc_pr"))


def bootstrap_interval(labelled: DataFrame, n_boot: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row: auc_pr and prevalence of labelled (node_id, score, y) and the stratified percentile interval of auc_pr."""
    runs = replicate_precision(labelled, n_boot, seed)
    ends = runs.agg(F.percentile("auc_pr", F.lit(alpha / 2)).alias("ci_low"), F.percentile("auc_pr", F.lit(1 - alpha / 2)).alias("ci_high"), F.count("*").alias("n_boot"))
    return scoring.average_precision(labelled).join(F.broadcast(ends))


def paired_bootstrap(labelled: DataFrame, n_boot: int = 200, alpha: float = 0.05, seed: int = 0, per_range: int = 5_000) -> DataFrame:
    """One row: auc_pr of score_a and score_b over the same nodes, their difference, its interval, and a two-sided p-value with one added to each count.

    Rows are counted by pairs of scores, which are drawn in ranges as in
    replicate_precision(). Both sides see the same draws, summed by score inside the
    range before they are shuffled: at most distinct pairs times replicates.
    """
    counts = labelled.groupBy("score_a", "score_b").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    dealt, totals = _ranged(counts, [F.desc("score_a"), F.desc("score_b")], per_range)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df, at = df.sort_values(["score_a", "score_b"], ascending=False), int(df["at"].iloc[0])
        none, hit = (drawn(df[f"n{y}"].to_numpy(), draws_of_range(totals[y], at, n_boot, seed, y)[0], seed, y, at) for y in (0, 1))
        out = []
        for who in "ab":
            names, place = np.unique(df[f"score_{who}"].to_numpy(), return_inverse=True)
            n, hits = np.zeros((len(names), n_boot), np.int64), np.zeros((len(names), n_boot), np.int64)
            np.add.at(n, place, (none + hit).T)
            np.add.at(hits, place, hit.T)
            some = n > 0
            score, replicate = np.nonzero(some)
            out.append(pd.DataFrame({"replicate": replicate, "who": who, "score": names[score], "n": n[some], "hits": hits[some]}))
        return pd.concat(out)

    met = dealt.groupBy("at").applyInPandas(run, "replicate long, who string, score double, n long, hits long")
    g = running_sums(met.groupBy("replicate", "who", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), [F.desc("score")], ["replicate", "who"], n_above="n", hits_above="hits")
    ap = F.sum(F.col("hits") * (F.col("hits_above") + F.col("hits")) / (F.col("n_above") + F.col("n"))) / F.sum("hits")
    delta = g.groupBy("replicate", "who").agg(ap.alias("auc_pr")).groupBy("replicate").agg(F.sum(F.when(F.col("who") == "a", F.col("auc_pr")).otherwise(-F.col("auc_pr"))).alias("d"))
    one = lambda who: scoring.average_precision(labelled.select("node_id", F.col(f"score_{who}").alias("score"), "y")).select(F.col("auc_pr").alias(f"auc_pr_{who}"))
    side = lambda c: (1 + F.count_if(c)) / (F.count("*") + 1)
    p = F.least(F.lit(1.0), 2 * F.least(side(F.col("d") <= 0), side(F.col("d") >= 0)))
    ends = delta.agg(F.percentile("d", F.lit(alpha / 2)).alias("delta_ci_low"), F.percentile("d", F.lit(1 - alpha / 2)).alias("delta_ci_high"), p.alias("p_value"))
    return one("a").join(F.broadcast(one("b"))).withColumn("delta", F.col("auc_pr_a") - F.col("auc_pr_b")).join(F.broadcast(ends))


def compared_scores(a: DataFrame, b: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed nodes scored by both (node_id, score_a, score_b, y), and one row with what each side and the labels lost."""
    x, z = (df.select("node_id", F.col("score").alias(f"score_{k}")) for k, df in (("a", a), ("b", b)))
    full = x.withColumn("in_a", F.lit(True)).join(z.withColumn("in_b", F.lit(True)), "node_id", "full")
    lost = full.agg(F.count_if(F.col("in_b").isNull()).alias("n_only_a"), F.count_if(F.col("in_a").isNull()).alias("n_only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))
    return x.join(z, "node_id").join(confirmed(labels), "node_id"), lost


def recovery_at_budgets(scores: DataFrame, truth: DataFrame, budgets: list[int]) -> DataFrame:
    """Per motif the share of planted members (truth: motif_type, member_node_ids) among the first k scored nodes, ties by node_id."""
    planted = truth.select("motif_type", F.explode("member_node_ids").alias("node_id")).distinct()
    place = row_numbers(scores.select("node_id", "score"), [F.desc("score"), "node_id"], "place")
    df = planted.join(place, "node_id", "left")
    return df.groupBy("motif_type").agg(F.count("*").alias("n_members"), *(F.avg(F.coalesce((F.col("place") <= k).cast("int"), F.lit(0))).alias(f"recall_at_{k}") for k in budgets))


def rating_summary(ratings: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per dimension, and per dimension and arm: mean, deviation and number of ratings (arm, dimension columns); arm is null over all arms."""
    tall = ratings.select("arm", *(F.col(d).cast("double").alias(d) for d in dimensions)).unpivot(["arm"], dimensions, "dimension", "rating").where("rating IS NOT NULL")
    measures = [F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("sd"), F.count("*").alias("n")]
    return tall.groupBy("dimension").agg(*measures).select(F.lit(None).cast("string").alias("arm"), "dimension", "mean", "sd", "n").union(tall.groupBy("arm", "dimension").agg(*measures))


def rating_matrix(ratings: DataFrame, raters: list) -> DataFrame:
    """Units by raters: one row per unit, one column per rater, the mean of repeated ratings."""
    return ratings.groupBy("unit").pivot("rater", raters).agg(F.avg("rating"))


def study_sample(cases: DataFrame, strata: list[tuple[str, str, int]], arms: list[str], seed: int) -> DataFrame:
    """Cases (case_id, ...) for a study: of each stratum (name, condition, quota) in turn, quota cases not yet taken, in a seeded order.

    Arms alternate in a random order of all cases. A stratum with too few cases is an error.
    """
    taken = None
    for name, condition, quota in strata:
        pool = cases.where(condition)
        if taken is not None:
            pool = pool.join(taken.select("case_id"), "case_id", "left_anti")
        own = staged(row_numbers(pool, in_hash_order(seed, "case_id"), "__k").where(F.col("__k") <= quota).drop("__k").withColumn("stratum", F.lit(name)), "stratum")
        if (n := own.count()) < quota:
            raise ValueError(f"stratum {name!r} has {n} of {quota} cases")
        taken = own if taken is None else taken.unionByName(own)
    order = row_numbers(taken, in_hash_order(seed + 1, "case_id"), "place")
    arm = F.element_at(F.array(*(F.lit(a) for a in arms)), (F.pmod(F.col("place") - 1, F.lit(len(arms))) + 1).cast("int"))
    return order.withColumn("arm", arm)
