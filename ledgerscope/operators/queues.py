"""What a reviewer reads of an alert queue: slices, lookups, neighbourhoods, features and explanations side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged


def unpacked(df: DataFrame, column: str = "raw_features", n: int = 2) -> DataFrame:
    """node_id and the first n values of a list column as raw_0 ... raw_{n-1}; null past its end."""
    return df.select("node_id", *(F.get(F.col(column), F.lit(i)).alias(f"raw_{i}") for i in range(n)))


def packed(df: DataFrame, columns: list[str], name: str = "raw_features") -> DataFrame:
    """df with the columns as one list of floats."""
    return df.withColumn(name, F.array(*(F.col(c).cast("float") for c in columns)))


def assembled(nodes: DataFrame, packs: dict[str, DataFrame]) -> DataFrame:
    """node_id and the columns of all packs in order, null where a pack lacks the node; a column in two packs is an error."""
    seen: dict[str, str] = {}
    for name, df in packs.items():
        for c in df.columns:
            if c != "node_id" and seen.setdefault(c, name) != name:
                raise ValueError(f"column {c!r} is in the packs {seen[c]!r} and {name!r}")
    return reduce(lambda a, b: a.join(b, "node_id", "left"), packs.values(), nodes.select("node_id"))


def neighbourhoods(seeds: DataFrame, edges: DataFrame, hops: int = 1, most: int = 50) -> DataFrame:
    """Nodes within hops steps of each alert's seeds (alert_id, node_id): (alert_id, node_id, hop, truncated).

    Of the nodes that a step adds, the first by id are taken until the alert has most;
    that cap is the feature, and truncated tells where it cut.
    """
    both = edges.select("src", F.col("dst").alias("node_id")).union(edges.select(F.col("dst"), F.col("src"))).where("src <> node_id").distinct()
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy("node_id"))
    now = seeds.select("alert_id", "node_id").distinct().withColumn("k", place)
    cut = now.where(F.col("k") > most).select("alert_id")
    held = staged(now.where(F.col("k") <= most).select("alert_id", "node_id", F.lit(0).alias("hop")), "held")
    last = held
    for hop in range(1, hops + 1):
        new = last.select("alert_id", F.col("node_id").alias("src")).join(both, "src").select("alert_id", "node_id").distinct().join(held, ["alert_id", "node_id"], "left_anti")
        room = held.groupBy("alert_id").agg((F.lit(most) - F.count("*")).alias("room"))
        new = staged(new.withColumn("k", place).join(room, "alert_id").select("alert_id", "node_id", F.lit(hop).alias("hop"), (F.col("k") <= F.col("room")).alias("fits")), "added")
        cut = cut.union(new.where("NOT fits").select("alert_id"))
        last = new.where("fits").drop("fits")
        held = staged(held.union(last), "held")
    full = cut.distinct().withColumn("truncated", F.lit(True))
    return held.join(full, "alert_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def top_slice(alerts: DataFrame, budget: int, motifs: DataFrame, explained: DataFrame) -> DataFrame:
    """The first budget alerts by rank with their pattern: that of an explanation (alert_id, motif_type), else the one matched in the queue."""
    top = alerts.orderBy("rank").limit(budget)
    return coalesced_patterns(top, motifs, explained).orderBy("rank")


def coalesced_patterns(alerts: DataFrame, motifs: DataFrame, explained: DataFrame) -> DataFrame:
    """alerts with motif_type, an explanation's before the queue's, and whether there is an explanation."""
    a = explained.select("alert_id", F.col("motif_type").alias("told"), F.lit(True).alias("has_bundle"))
    b = motifs.select("alert_id", F.col("motif_type").alias("matched"))
    df = alerts.join(a, "alert_id", "left").join(b, "alert_id", "left")
    return df.withColumns({"motif_type": F.coalesce("told", "matched"), "explained": F.coalesce("has_bundle", F.lit(False))}).drop("told", "matched", "has_bundle")


def one_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def decoded(alerts: DataFrame) -> DataFrame:
    """alert_id as dataset, run, number and, where the run ends in -s and digits, its seed."""
    part = lambda i: F.get(F.split("alert_id", ":"), F.lit(i))
    seed = F.regexp_extract(part(1), r"-s([0-9]+)$", 1)
    return alerts.select("alert_id", part(0).alias("dataset"), part(1).alias("run"), part(2).try_cast("bigint").alias("number"), F.when(seed != "", seed.cast("bigint")).alias("seed"))


def explanation_coverage(alerts: DataFrame, bundles: DataFrame, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Per dataset and band of risk_score: alerts with and without a bundle."""
    told = bundles.select("alert_id").distinct().withColumn("told", F.lit(True))
    band = F.when(F.col("risk_score") >= high, "high").when(F.col("risk_score") >= low, "med").otherwise("low")
    df = alerts.join(told, "alert_id", "left").groupBy("dataset", band.alias("band"))
    return df.agg(F.count_if(F.col("told")).alias("with_bundle"), F.count_if(F.col("told").isNull()).alias("without_bundle"))


def checked_claims(claims: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """claims (metric, value) against stored ones: ok, mismatch or missing."""
    df = claims.join(stored.withColumnRenamed("value", "stored"), "metric", "left")
    state = F.when(F.col("stored").isNull(), "missing").when(F.abs(F.col("value") - F.col("stored")) <= tolerance, "ok").otherwise("mismatch")
    return df.select("metric", state.alias("state"))


def pass_rates(results: DataFrame) -> DataFrame:
    """Share and number of ok per category, and over all (category null)."""
    measures = [F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("rate")]
    return results.groupBy("category").agg(*measures).union(results.agg(F.lit(None).cast("string").alias("category"), *measures))


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Per metric over seeds (metric, seed, value): runs, mean and deviation, 0 for one run."""
    return metrics.groupBy("metric").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def macro_lift(folds: DataFrame) -> DataFrame:
    """One row over folds (fold, auc_pr, prevalence, skipped): folds, those skipped, macro mean of auc_pr and of its lift over the prevalence."""
    lift = F.when(F.col("prevalence") > 0, F.col("auc_pr") / F.col("prevalence"))
    run = F.col("skipped").isNull()
    return folds.agg(F.count("*").alias("folds"), F.count_if(~run).alias("skipped"), F.avg(F.when(run, F.col("auc_pr"))).alias("macro_auc_pr"), F.avg(F.when(run, lift)).alias("macro_lift"))


def best_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per keys the name with the largest value, the least name of equals."""
    return df.groupBy(*keys).agg(F.min_by(name, F.struct((-F.col(value)).alias("v"), name)).alias(name), F.max(value).alias(value))


def sensitivity_summary(grid: DataFrame) -> DataFrame:
    """One row over a sensitivity grid: its size, distinct numbers of kept alerts, least and most hits."""
    return grid.agg(F.count("*").alias("cells"), F.array_sort(F.collect_set("n_kept")).alias("kept_values"), F.min("n_hits").alias("min_hits"), F.max("n_hits").alias("max_hits"))
