"""Procurement screens over a bid table (tender, market, firm, buyer, amount, won)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concentration(df: DataFrame, owner: str, partner: str) -> DataFrame:
    """Sum of squared shares of partners in an owner's rows."""
    n = df.groupBy(owner, partner).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(owner))
    return n.withColumn("share", share).groupBy(owner).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def award_screens(awards: DataFrame) -> DataFrame:
    """Per firm: awards won, share of its market's awards, concentration of its buyers."""
    n = awards.groupBy("market", "firm").agg(F.count("*").alias("n_awards"))
    n = n.withColumn("market_share", F.col("n_awards") / F.sum("n_awards").over(Window.partitionBy("market")))
    return n.join(concentration(awards, "firm", "buyer"), "firm").select("firm", "n_awards", "market_share", F.col("hhi").alias("buyer_hhi"))


def buyer_screens(awards: DataFrame) -> DataFrame:
    """Per buyer: awards made, distinct winners, supplier concentration, normalised entropy of winners (null for one)."""
    n = awards.groupBy("buyer", "firm").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("buyer"))
    out = n.withColumn("p", p).groupBy("buyer").agg(
        F.sum("n").alias("awards_made"), F.count("*").alias("winners"), F.sum(F.col("p") * F.col("p")).alias("supplier_hhi"), (-F.sum(F.col("p") * F.ln("p"))).alias("h")
    )
    return out.select("buyer", "awards_made", "winners", "supplier_hhi", F.when(F.col("winners") > 1, F.col("h") / F.ln("winners")).alias("rotation_entropy"))


def bid_screens(bids: DataFrame) -> DataFrame:
    """Per tender: n, CV and spread and gap of the two lowest (2 bids), relative distance and skewness (3), kurtosis (4).

    Nulls where the quorum fails or a denominator is 0. The relative distance is the
    gap over the deviation of all bids but the lowest.
    """
    place = F.row_number().over(Window.partitionBy("tender").orderBy("amount", "firm"))
    b = bids.where("amount IS NOT NULL").withColumn("k", place)
    s = b.groupBy("tender").agg(
        F.count("*").alias("n_bids"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("sd"), F.max("amount").alias("hi"),
        F.min("amount").alias("lo"), F.min(F.when(F.col("k") == 2, F.col("amount"))).alias("second"), F.stddev_samp(F.when(F.col("k") > 1, F.col("amount"))).alias("sd_rest"),
        F.skewness("amount").alias("sk"), F.kurtosis("amount").alias("ku"),
    )
    n, over = F.col("n_bids"), lambda a, x: F.when(x != 0, a / x)
    return s.select(
        "tender", "n_bids", F.when(n >= 2, over(F.col("sd"), F.col("mean"))).alias("bid_cv"), F.when(n >= 2, over(F.col("hi") - F.col("lo"), F.col("lo"))).alias("bid_spread"),
        F.when(n >= 2, over(F.col("second") - F.col("lo"), F.col("lo"))).alias("diffp"), F.when(n >= 3, over(F.col("second") - F.col("lo"), F.col("sd_rest"))).alias("rd"),
        F.when((n >= 3) & (F.col("sd") > 0), F.col("sk")).alias("skew"), F.when((n >= 4) & (F.col("sd") > 0), F.col("ku")).alias("kurtosis"),
    )


def co_bidding(bids: DataFrame) -> DataFrame:
    """Per firm: distinct firms met in a tender and the most tenders shared with one of them."""
    pairs = bids.select("tender", "firm").where("firm IS NOT NULL").distinct()
    met = pairs.join(pairs.withColumnRenamed("firm", "other"), "tender").where("firm <> other").groupBy("firm", "other").agg(F.count("*").alias("n"))
    return met.groupBy("firm").agg(F.count("*").alias("co_bidders"), F.max("n").alias("max_repeat"))


#: Screens that bids and awards may bear in their attributes.
BID_KEYS = ["cv", "spd", "diffp", "rd", "kurt", "skew", "kstest", "number_bids"]
AWARD_COLUMNS = ["pc_lot_bidscount_mean", "pc_lot_bidscount_min", "pc_relative_value_mean"]


def precomputed_screens(edges: DataFrame, bid_keys: list[str] | None = None) -> DataFrame:
    """Screens that a data set brings along, per firm and tender (node_id, AWARD_COLUMNS, pc_<key>); nodes without any value have no row."""
    keys = BID_KEYS if bid_keys is None else bid_keys
    value = lambda k: F.get_json_object("raw_attrs", f"$.{k}").try_cast("double")
    e = edges.where("raw_attrs IS NOT NULL")
    won = e.where("edge_type = 'awarded'").select("src", "dst", value("lot_bidscount").alias("n"), value("relative_value").alias("v"))
    measures = [F.avg("n").alias("pc_lot_bidscount_mean"), F.min("n").alias("pc_lot_bidscount_min"), F.avg("v").alias("pc_relative_value_mean")]
    firms = won.groupBy(F.col("dst").alias("node_id")).agg(*measures)
    tenders = won.groupBy(F.col("src").alias("node_id")).agg(*measures)
    bids = e.where("edge_type = 'bids_on'").groupBy(F.col("dst").alias("node_id")).agg(*(F.avg(value(k)).alias(f"pc_{k}") for k in keys))
    every = firms.unionByName(tenders.join(bids, "node_id", "full"), allowMissingColumns=True)
    columns = [*AWARD_COLUMNS, *(f"pc_{k}" for k in keys)]
    return every.where(F.coalesce(*columns).isNotNull()).select("node_id", *columns)
