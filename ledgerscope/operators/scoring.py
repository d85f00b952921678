"""Scores, ranks, fusion and budget metrics over (node_id, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators.order import running_sums


def rule_scores(features: DataFrame, train: DataFrame, rules: dict[str, float]) -> DataFrame:
    """Share of rules triggered: a column above the given percentile of it in train; null never triggers, a column without any value is an error."""
    cuts = train.agg(*(F.percentile(c, F.lit(q)).alias(f"__{c}") for c, q in rules.items()))
    known = cuts.first()
    if empty := [c for c in rules if known[f"__{c}"] is None]:
        raise ValueError(f"no value in train for {empty}")
    hit = [F.coalesce((F.col(c) > F.lit(known[f"__{c}"])).cast("double"), F.lit(0.0)) for c in rules]
    return features.select("node_id", (sum(hit[1:], hit[0]) / len(hit)).alias("score"))


def mean_of_known(columns: list[str]):
    """Mean over columns that are not null; null if none is."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    known = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return F.when(known > 0, total / known)


def rank_percentiles(scores: DataFrame) -> DataFrame:
    """Average rank over n. Scores are counted by value first; ranks are running sums over the distinct values."""
    counts = scores.groupBy("score").agg(F.count("*").alias("c"))
    ranks = running_sums(counts, ["score"], below="c")
    ranks = ranks.join(F.broadcast(ranks.agg(F.sum("c").alias("n"))))
    pct = (F.col("below") + (F.col("c") + 1) / 2) / F.col("n")
    return scores.join(ranks.select("score", pct.alias("percentile")), "score").select("node_id", "percentile")


def rank_fusion(members: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean percentile over the members that score a node; weights are 1 where not given."""
    weights = weights or {}
    if not members or set(weights) - set(members):
        raise ValueError("rank fusion needs members, and weights only of these")
    every = None
    for name, df in members.items():
        one = rank_percentiles(df).withColumn("w", F.lit(float(weights.get(name, 1.0))))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("node_id").agg((F.sum(F.col("percentile") * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("members"))


def community_scores(members: DataFrame, scores: DataFrame, top_share: float = 0.2) -> DataFrame:
    """Per community (max + mean of its best ceil(share * n)) / 2 over scored members."""
    w = Window.partitionBy("community_id")
    df = members.join(scores, "node_id").withColumns({"k": F.row_number().over(w.orderBy(F.desc("score"), "node_id")), "n": F.count("*").over(w)})
    top = F.when(F.col("k") <= F.greatest(F.lit(1), F.ceil(top_share * F.col("n"))), F.col("score"))
    return df.groupBy("community_id").agg(((F.max("score") + F.avg(top)) / 2).alias("score"), F.count("*").alias("n_scored"))


def by_score(labelled: DataFrame) -> DataFrame:
    """Distinct scores from the best down with their counts and running counts (n, hits, n_above, hits_above)."""
    g = labelled.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    return running_sums(g, [F.desc("score")], n_above="n", hits_above="hits")


def budget_metrics(labelled: DataFrame, budgets: list[int]) -> DataFrame:
    """Precision, recall and false-positive rate at each budget; a tie at the cut counts with its expected value; k is cut at n."""
    s = by_score(labelled)
    total = s.agg(F.sum("n").alias("all"), F.sum("hits").alias("pos"))
    k = F.explode(F.array(*(F.lit(b) for b in budgets))).alias("budget")
    cut = total.select(k, "all", "pos").withColumn("k", F.least("budget", "all"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("n_above")))
    hit = s.join(F.broadcast(cut)).groupBy("budget", "k", "all", "pos").agg(F.sum(taken * F.col("hits") / F.col("n")).alias("h"))
    return hit.select(
        "budget", F.col("k").alias("k_effective"), (F.col("h") / F.col("k")).alias("precision"), F.when(F.col("pos") > 0, F.col("h") / F.col("pos")).alias("recall"),
        F.when(F.col("all") > F.col("pos"), (F.col("k") - F.col("h")) / (F.col("all") - F.col("pos"))).alias("fpr"),
    )


def average_precision(labelled: DataFrame) -> DataFrame:
    """Average precision over distinct scores, and the prevalence."""
    s = by_score(labelled)
    p = (F.col("hits_above") + F.col("hits")) / (F.col("n_above") + F.col("n"))
    out = s.agg(F.sum(F.col("hits") * p).alias("ap"), F.sum("hits").alias("pos"), F.sum("n").alias("all"))
    return out.select(F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("auc_pr"), (F.col("pos") / F.col("all")).alias("prevalence"))


def krippendorff(ratings: DataFrame, ordinal: bool = True) -> DataFrame:
    """Krippendorff's alpha of (unit, rater, rating); units with one rating are dropped, 1.0 without variation."""
    per = ratings.groupBy("unit", "rating").agg(F.count("*").alias("c"))
    m = per.withColumn("m", F.sum("c").over(Window.partitionBy("unit"))).where("m > 1")
    pairs = m.join(m.select("unit", F.col("rating").alias("rating2"), F.col("c").alias("c2")), "unit")
    same = F.col("rating") == F.col("rating2")
    weight = F.when(same, F.col("c") * (F.col("c") - 1)).otherwise(F.col("c") * F.col("c2")) / (F.col("m") - 1)
    o = pairs.groupBy("rating", "rating2").agg(F.sum(weight).alias("o"))
    marginal = o.groupBy("rating").agg(F.sum("o").alias("n"))
    upto = F.sum("n").over(Window.orderBy("rating"))
    marginal = marginal.select("rating", "n", (upto - F.col("n") / 2).alias("mid"))
    grid = marginal.join(marginal.select(F.col("rating").alias("rating2"), F.col("n").alias("n2"), F.col("mid").alias("mid2"))).join(o, ["rating", "rating2"], "left")
    distance = F.pow(F.col("mid") - F.col("mid2"), 2) if ordinal else (F.col("rating") != F.col("rating2")).cast("double")
    out = grid.withColumn("d", distance).agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("do"), F.sum(F.col("n") * F.col("n2") * F.col("d")).alias("de"), F.sum(F.coalesce("o", F.lit(0.0))).alias("n"))
    return out.select(F.when(F.col("de") > 0, 1 - (F.col("n") - 1) * F.col("do") / F.col("de")).otherwise(1.0).alias("alpha"))
