"""Raw ledgers as core tables: nodes, edges and labels, and what was read and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = ["node_id", "node_type", "domain", "time_first_seen", "raw_features", "raw_attrs"]


def identifier(kind: str, *parts: str | Column) -> Column:
    """kind:part:..., null if a part is."""
    out = F.lit(kind)
    for p in parts:
        out = F.concat(out, F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string"))
    return out


def typed_nodes(df: DataFrame, node: Column, kind: str, domain: str, time: Column, features: Column | None = None) -> DataFrame:
    """One row per known node with its least time."""
    g = df.select(node.alias("node_id"), time.cast("long").alias("t"), *([features.alias("f")] if features is not None else [])).where("node_id IS NOT NULL")
    first = F.min_by("f", F.struct(F.col("t").isNull(), "t", F.col("f").cast("string"))) if features is not None else F.lit(None).cast("array<float>")
    out = g.groupBy("node_id").agg(F.min("t").alias("time_first_seen"), *([first.alias("raw_features")] if features is not None else []))
    if features is None:
        out = out.withColumn("raw_features", first)
    return out.select("node_id", F.lit(kind).alias("node_type"), F.lit(domain).alias("domain"), "time_first_seen", "raw_features", F.lit(None).cast("string").alias("raw_attrs"))


def edge_rows(df: DataFrame, src: Column, dst: Column, kind: str, time: Column, amount: Column, attrs: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), time.cast("long").alias("timestamp"), amount.cast("double").alias("amount"), F.lit(True).alias("directed"),
        (attrs if attrs is not None else F.lit(None).cast("string")).alias("raw_attrs"),
    )


def label_rows(df: DataFrame, source: str) -> DataFrame:
    return df.select("node_id", "label", F.lit(source).alias("label_source"), F.lit(1.0).cast("float").alias("confidence"))


def attributes(**columns: Column) -> Column:
    """A JSON record that keeps null fields."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})


def class_label(column: str) -> Column:
    """Label of a class code: 1 illicit, 2 licit, others unknown."""
    c = F.col(column).cast("string")
    return F.when(c == "1", "illicit").when(c == "2", "licit").otherwise("unknown")


def known_label(flag: Column) -> Column:
    return F.when(flag, "illicit").otherwise("licit")


def worst_label(labels: DataFrame) -> DataFrame:
    """Per node illicit if it ever is, else licit if it ever is, else unknown."""
    ever = lambda x: F.bool_or(F.col("label") == x)
    return labels.groupBy("node_id").agg(F.when(ever("illicit"), "illicit").when(ever("licit"), "licit").otherwise("unknown").alias("label"))


def transactions(features: DataFrame, classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels of a transaction graph.

    features: tx_id, step and numeric columns, all of which, step first, make the feature
    array; classes: tx_id, class; links: src_id, dst_id. An edge has the step of its
    source, null if the source is unknown.
    """
    array = F.array(*(F.col(c).cast("float") for c in features.columns[1:]))
    nodes = features.select(identifier("tx", "tx_id").alias("node_id"), F.lit("transaction").alias("node_type"), F.lit("financial").alias("domain"), F.col("step").cast("long").alias("time_first_seen"), array.alias("raw_features"), F.lit(None).cast("string").alias("raw_attrs"))
    dated = links.join(features.select(F.col("tx_id").alias("src_id"), "step"), "src_id", "left")
    edges = edge_rows(dated, identifier("tx", "src_id"), identifier("tx", "dst_id"), "pays", F.col("step"), F.lit(None))
    return nodes, edges, label_rows(classes.select(identifier("tx", "tx_id").alias("node_id"), class_label("class").alias("label")), "class")


def wallets(observed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, undated edges, labels over all time and the history of known labels of a wallet graph.

    observed: address, step, class and numeric columns, one row per wallet and step; a
    wallet's features are those of its first row, the least by step and features.
    """
    array = F.array(*(F.col(c).cast("float") for c in observed.columns[3:]))
    nodes = typed_nodes(observed, identifier("addr", "address"), "address", "financial", F.col("step"), array)
    edges = edge_rows(links, identifier("addr", "src_id"), identifier("addr", "dst_id"), "pays", F.lit(None), F.lit(None))
    told = observed.select(identifier("addr", "address").alias("node_id"), F.col("step").cast("long").alias("step"), class_label("class").alias("label"))
    return nodes, edges, label_rows(worst_label(told), "rollup"), told.where("label <> 'unknown'")


def accounts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels of an account ledger.

    rows: time_text (yyyy/MM/dd HH:mm), from_bank, from_account, to_bank, to_account, amount_received,
    receiving_currency, amount_paid, payment_currency, format, is_laundering. Times are
    minutes since 1970; an account is illicit if a laundering payment touches it.
    """
    minutes = F.floor(F.unix_timestamp(F.to_timestamp("time_text", "yyyy/MM/dd HH:mm")) / 60)
    df = rows.withColumns({"src": identifier("acct", "from_bank", "from_account"), "dst": identifier("acct", "to_bank", "to_account"), "t": minutes})
    attrs = attributes(fmt=F.col("format"), cur_paid=F.col("payment_currency"), cur_recv=F.col("receiving_currency"), amount_received=F.col("amount_received"), is_laundering=F.col("is_laundering"))
    edges = edge_rows(df, F.col("src"), F.col("dst"), "pays", F.col("t"), F.col("amount_paid"), attrs)
    bad = (F.col("is_laundering") == 1).alias("bad")
    ends = df.select(F.col("src").alias("node_id"), "t", bad).union(df.select("dst", "t", bad))
    nodes = typed_nodes(ends, F.col("node_id"), "account", "financial", F.col("t"))
    return nodes, edges, label_rows(ends.groupBy("node_id").agg(known_label(F.coalesce(F.bool_or("bad"), F.lit(False))).alias("label")), "edge_rollup")


def awards(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels of an award table: country, tender_id, lot_id, buyer_id, bidder_id, is_cartel, cartel_id, tender_year, lot_bidscount, relative_value.

    A row without buyer has no buyer node and no purchase; a buyer's purchases from a
    tender count once, at the first year.
    """
    df = rows.withColumns({"firm": identifier("firm", "country", "bidder_id"), "tender": identifier("tender", "country", "tender_id"), "buyer": identifier("buyer", "country", "buyer_id"), "y": F.col("tender_year").cast("long")})
    nodes = typed_nodes(df, F.col("firm"), "firm", "procurement", F.col("y")).union(typed_nodes(df, F.col("tender"), "tender", "procurement", F.col("y"))).union(typed_nodes(df, F.col("buyer"), "buyer", "procurement", F.col("y")))
    kept = {c: F.col(c) for c in ("lot_id", "is_cartel", "cartel_id", "lot_bidscount", "relative_value")}
    won = edge_rows(df, F.col("tender"), F.col("firm"), "awarded", F.col("y"), F.lit(None), attributes(**kept))
    bought = df.where("buyer IS NOT NULL").groupBy("buyer", "tender").agg(F.min("y").alias("y"))
    edges = won.union(edge_rows(bought, F.col("buyer"), F.col("tender"), "buys_from", F.col("y"), F.lit(None)))
    flags = df.select(F.col("firm").alias("node_id"), "is_cartel").union(df.select("tender", "is_cartel"))
    return nodes, edges, label_rows(flags.groupBy("node_id").agg(known_label(F.coalesce(F.max("is_cartel") == 1, F.lit(False))).alias("label")), "is_cartel")


def bid_year(date: Column | None, seconds: bool) -> Column:
    """Year of a bid: unknown without a date column, from seconds since 1970, or from text; null where it cannot be read."""
    if date is None:
        return F.lit(None).cast("long")
    return F.year(F.timestamp_seconds(date) if seconds else F.try_to_timestamp(date.cast("string"))).cast("long")


def market_bids(rows: DataFrame, market: str, firms: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels of one market's bids: Tender, Bid_value, Winner, Collusive_competitor, Number_bids, and where known Date and Competitors.

    A bid is named by its place in the order of tender, value and all other columns, so
    names do not hang on the order of a file. Further columns are kept with the bid.
    """
    date = F.col("Date") if "Date" in rows.columns else None
    seconds = date is not None and dict(rows.dtypes)["Date"] in ("int", "bigint")
    order = [F.col(c).cast("string") for c in rows.columns if c not in ("Tender", "Bid_value")]
    place = F.row_number().over(Window.partitionBy("Tender").orderBy("Bid_value", *order)) - 1
    df = rows.withColumns({"y": bid_year(date, seconds), "tender": identifier("tender", F.lit(market), "Tender"), "bid": F.concat(identifier("bid", F.lit(market), "Tender"), F.lit("-"), place.cast("string"))})
    own = {c.lower(): F.col(c) for c in rows.columns if c not in ("Tender", "Date", "Competitors", "Bid_value", "Collusive_competitor")}
    nodes = typed_nodes(df, F.col("tender"), "tender", "procurement", F.col("y")).union(typed_nodes(df, F.col("bid"), "bid", "procurement", F.col("y")))
    edges = edge_rows(df, F.col("bid"), F.col("tender"), "bids_on", F.col("y"), F.col("Bid_value"), attributes(**own))
    flags = df.select(F.col("bid").alias("node_id"), "Collusive_competitor")
    if firms:
        df = df.withColumn("firm", identifier("firm", F.lit(market), "Competitors"))
        nodes = nodes.union(typed_nodes(df, F.col("firm"), "firm", "procurement", F.col("y")))
        edges = edges.union(edge_rows(df, F.col("firm"), F.col("tender"), "bids_on", F.col("y"), F.col("Bid_value"))).union(edge_rows(df.where("Winner = 1"), F.col("tender"), F.col("firm"), "awarded", F.col("y"), F.col("Bid_value")))
        flags = flags.union(df.select("firm", "Collusive_competitor"))
    return nodes, edges, label_rows(flags.where("node_id IS NOT NULL").groupBy("node_id").agg(known_label(F.coalesce(F.max("Collusive_competitor") == 1, F.lit(False))).alias("label")), "collusive_competitor")


#: What is read of a contract release.
RELEASE = (
    "ocid string, date string, buyer struct<id:string,name:string>, tender struct<value:struct<amount:double>,tenderPeriod:struct<endDate:string>>,"
    " bids struct<details:array<struct<id:string,value:struct<amount:double,currency:string>,tenderers:array<struct<id:string,name:string>>>>>,"
    " awards array<struct<id:string,value:struct<amount:double>,suppliers:array<struct<id:string>>,relatedBid:string>>"
)


def release_year() -> Column:
    """Year of a release: of its date, else of the end of its tender period."""
    out = [F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).cast("long")) for c in (F.col("date"), F.col("tender.tenderPeriod.endDate"))]
    return F.coalesce(*out)


def contract_releases(releases: DataFrame, publisher: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels (all unknown) of nested contract releases (RELEASE).

    A release without a year is left out; a bid counts once for each tenderer with an
    id, an award once for each supplier with one. release_counts() tells what is left out.
    """
    df = releases.withColumn("y", release_year()).where("y IS NOT NULL").withColumn("t", identifier("tender", F.lit(publisher), "ocid"))
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    bought = df.withColumn("b", identifier("buyer", F.lit(publisher), known("buyer.id"))).where("b IS NOT NULL")
    bid = df.select("t", "y", "date", F.explode("bids.details").alias("d")).withColumn("who", F.filter("d.tenderers", lambda x: F.coalesce(x["id"], F.lit("")) != ""))
    bid = bid.select("t", "y", "date", "d", F.size("who").alias("n"), F.explode("who").alias("w")).withColumn("f", identifier("firm", F.lit(publisher), "w.id"))
    won = df.select("t", "y", "date", F.explode("awards").alias("a")).select("t", "y", "date", "a", F.explode("a.suppliers").alias("s")).withColumn("f", identifier("firm", F.lit(publisher), known("s.id"))).where("f IS NOT NULL")
    edges = edge_rows(bought, F.col("b"), F.col("t"), "buys_from", F.col("y"), F.col("tender.value.amount"))
    edges = edges.union(edge_rows(bid, F.col("f"), F.col("t"), "bids_on", F.col("y"), F.col("d.value.amount"), attributes(bid_id=F.col("d.id"), date=F.col("date"), currency=F.col("d.value.currency"), n_tenderers=F.col("n"))))
    edges = edges.union(edge_rows(won, F.col("t"), F.col("f"), "awarded", F.col("y"), F.col("a.value.amount"), attributes(award_id=F.col("a.id"), date=F.col("date"), related_bid=F.col("a.relatedBid"))))
    firms = bid.select("f", "y").union(won.select("f", "y"))
    nodes = typed_nodes(df, F.col("t"), "tender", "procurement", F.col("y")).union(typed_nodes(bought, F.col("b"), "buyer", "procurement", F.col("y"))).union(typed_nodes(firms, F.col("f"), "firm", "procurement", F.col("y")))
    return nodes, edges, label_rows(nodes.where("node_type IN ('firm', 'tender')").select("node_id", F.lit("unknown").alias("label")), "unlabelled")


def release_counts(releases: DataFrame) -> DataFrame:
    """One row: releases, those without a year, and among the others bids kept and left out for want of a tenderer's id."""
    df = releases.withColumn("y", release_year())
    held = F.transform(F.coalesce("bids.details", F.array()), lambda d: F.exists(F.coalesce(d["tenderers"], F.array()), lambda x: F.coalesce(x["id"], F.lit("")) != ""))
    n = df.select("y", F.when(F.col("y").isNotNull(), F.size(F.filter(held, lambda x: x))).alias("kept"), F.when(F.col("y").isNotNull(), F.size(F.filter(held, lambda x: ~x))).alias("skipped"))
    return n.agg(F.count("*").alias("n_releases"), F.count_if(F.col("y").isNull()).alias("no_date"), F.coalesce(F.sum("kept"), F.lit(0)).alias("bids_kept"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("bids_skipped"))


def statistics(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (kind, value, n): nodes and edges by type and by year, labels."""
    count = lambda df, kind, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return count(nodes, "nodes", "node_type").union(count(edges, "edges", "edge_type")).union(count(labels, "labels", "label")).union(count(edges, "times", "timestamp"))
