"""As-of restriction, splits and leave-one-group-out folds of a graph held as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.order import row_numbers


def nodes_of(edges: DataFrame) -> DataFrame:
    """Endpoints with the least timestamp seen (null if all are undated)."""
    both = edges.select(F.col("src").alias("node_id"), "timestamp").union(edges.select(F.col("dst"), "timestamp"))
    return both.groupBy("node_id").agg(F.min("timestamp").alias("time_first_seen"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids, edges.src == ids.node_id, "left_semi").join(ids, edges.dst == ids.node_id, "left_semi")


def as_of(nodes: DataFrame, edges: DataFrame, t: int, undated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes not first seen after t and edges dated at most t between them; undated keeps edges without a date too."""
    kept = nodes.where(F.col("time_first_seen").isNull() | (F.col("time_first_seen") <= t))
    dated = F.col("timestamp") <= t
    return kept, inside(edges.where(dated | F.col("timestamp").isNull() if undated else dated), kept)


def strict_split(nodes: DataFrame, edges: DataFrame, train_end: int, test_start: int) -> DataFrame:
    """Nodes with role train, test, gap or unplaced; train edges are as_of(..., train_end, undated=True)."""
    t = F.col("time_first_seen")
    role = F.when(t.isNull(), "unplaced").when(t <= train_end, "train").when(t >= test_start, "test").otherwise("gap")
    return nodes.withColumn("role", role)


def group_of(column: str):
    """Second segment of a type:group:id identifier, null if there is none."""
    return F.get(F.split(F.col(column), ":"), F.lit(1))


def fold_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Per left-out group: edges in the test part, in the training part, and between groups (in neither)."""
    counts = edges.select(group_of(src).alias("a"), group_of(dst).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    groups = counts.select(F.col("a").alias("fold")).union(counts.select("b")).where("fold IS NOT NULL").distinct()
    within, across = F.col("a") == F.col("b"), F.col("a") != F.col("b")
    own = groups.join(counts.where(within), F.col("fold") == F.col("a"), "left").select("fold", F.coalesce("n", F.lit(0)).alias("test_edges"))
    total = counts.agg(F.coalesce(F.sum(F.when(within, F.col("n"))), F.lit(0)).alias("all_within"), F.coalesce(F.sum(F.when(across, F.col("n"))), F.lit(0)).alias("excluded"))
    return own.join(F.broadcast(total)).select("fold", "test_edges", (F.col("all_within") - F.col("test_edges")).alias("train_edges"), "excluded")


def labels_as_of(history: DataFrame, t: int) -> DataFrame:
    """Of a history (node_id, step, label) up to step t: illicit if ever so, else licit if ever so; other nodes have no row."""
    seen = history.where((F.col("step") <= t) & F.col("label").isin("illicit", "licit"))
    return seen.groupBy("node_id").agg(F.when(F.bool_or(F.col("label") == "illicit"), "illicit").otherwise("licit").alias("label"))


def leakage_counts(train_nodes: DataFrame, train_edges: DataFrame, test_nodes: DataFrame, train_end: int) -> DataFrame:
    """Rows (check, n) of what a strict split must not hold; every n is 0 for strict_split."""
    ids = train_nodes.select("node_id").distinct()
    ends = train_edges.select(F.col("src").alias("node_id")).union(train_edges.select("dst"))
    found = {
        "late_nodes": train_nodes.where(F.col("time_first_seen") > train_end),
        "late_edges": train_edges.where(F.col("timestamp") > train_end),
        "ends_outside": ends.join(ids, "node_id", "left_anti"),
        "shared_nodes": ids.join(test_nodes, "node_id", "left_semi"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def train_graph(nodes: DataFrame, edges: DataFrame, train_end: int) -> tuple[DataFrame, DataFrame]:
    """Nodes first seen by train_end, and edges between them dated at most train_end or not at all."""
    kept = nodes.where(F.col("time_first_seen") <= train_end)
    return kept, inside(edges.where(F.col("timestamp").isNull() | (F.col("timestamp") <= train_end)), kept)


def window_graph(nodes: DataFrame, edges: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Nodes first seen from start to end and the edges between them."""
    kept = nodes.where(F.col("time_first_seen").between(start, end))
    return kept, inside(edges, kept)


def group_graph(nodes: DataFrame, edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose identifier's second part is group and the edges between them."""
    kept = nodes.where(group_of("node_id") == group)
    return kept, inside(edges, kept)


def nodes_by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes whose identifier begins with prefix; an error that lists the kinds there are if none does."""
    kept = nodes.where(F.col("node_id").startswith(prefix))
    if kept.isEmpty():
        kinds = [r[0] for r in nodes.select(F.substring_index("node_id", ":", 1)).distinct().limit(20).collect()]
        raise ValueError(f"no node begins with {prefix!r}; kinds there are: {sorted(kinds)}")
    return kept


def edges_of_type(edges: DataFrame, *types: str) -> DataFrame:
    """Edges of the given types; an error if there are none."""
    kept = edges.where(F.col("edge_type").isin(*types))
    if kept.isEmpty():
        raise ValueError(f"no edge of type {types}")
    return kept


def confirmed(labels: DataFrame) -> DataFrame:
    """Nodes with a confirmed label and y, 1 if it is illicit."""
    known = labels.where(F.col("label").isin("illicit", "licit"))
    return known.select("node_id", (F.col("label") == "illicit").cast("int").alias("y"))


def split_report(nodes: DataFrame, edges: DataFrame, train_end: int, test_start: int | None = None, fence_after: int | None = None) -> DataFrame:
    """One row of counts of a strict split: nodes in train, test, gap and unplaced, edges of train and inference, and what the fence cut off.

    Train edges join train nodes by train_end or undated, inference edges join placed
    nodes. The fence drops what comes after it, but keeps nodes without a time.
    """
    test_start = train_end + 1 if test_start is None else test_start
    if test_start <= train_end:
        raise ValueError(f"test_start {test_start} is not after train_end {train_end}")
    kept, within = as_of(nodes, edges, fence_after) if fence_after is not None else (nodes, edges)
    roles = strict_split(kept, within, train_end, test_start)
    n = roles.agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}_nodes") for r in ("train", "test", "gap", "unplaced")))
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    out = n
    for one in (
        counted(train_graph(kept, within, train_end)[1], "n_train_edges"), counted(inside(within, kept.where("time_first_seen IS NOT NULL")), "n_inference_edges"),
        counted(nodes, "all_nodes"), counted(edges, "all_edges"), counted(within, "kept_edges"),
    ):
        out = out.join(F.broadcast(one))
    placed = sum((F.col(f"n_{r}_nodes") for r in ("test", "gap", "unplaced")), F.col("n_train_nodes"))
    return out.withColumns({"n_fenced_nodes": F.col("all_nodes") - placed, "n_fenced_edges": F.col("all_edges") - F.col("kept_edges")}).drop("all_nodes", "all_edges", "kept_edges")


def award_labels_as_of(edges: DataFrame, t: int) -> DataFrame:
    """Labels of firms from awards dated at most t: illicit if one bears is_cartel 1 in its attributes; firms without awards by then have no row."""
    flag = F.coalesce(F.get_json_object("raw_attrs", "$.is_cartel").try_cast("bigint"), F.lit(0))
    won = edges.where((F.col("edge_type") == "awarded") & (F.col("timestamp") <= t))
    return won.groupBy(F.col("dst").alias("node_id")).agg(F.when(F.max(flag) == 1, "illicit").otherwise("licit").alias("label"))


def train_labels(policy: str, labels: DataFrame, edges: DataFrame, t: int, history: DataFrame | None = None) -> DataFrame:
    """Labels to learn from by policy: static as they are, award or history as of t."""
    if policy == "static":
        return labels.select("node_id", "label")
    if policy == "award":
        return award_labels_as_of(edges, t)
    if policy == "history" and history is not None:
        return labels_as_of(history, t)
    raise ValueError(f"label policy {policy!r} is unknown or lacks its history")


def in_hash_order(seed: int, key: str = "node_id"):
    """An order of rows that looks random and repeats for a seed."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def noisy_labels(labels: DataFrame, rate: float, seed: int) -> DataFrame:
    """Labels of which exactly round(rate * confirmed ones) are turned from illicit to licit or back; unknown ones stay."""
    if not 0 <= rate < 1:
        raise ValueError(f"rate {rate} is not in [0, 1)")
    known = labels.where(F.col("label").isin("illicit", "licit"))
    n = round(rate * known.count())
    if not n:
        return labels
    chosen = row_numbers(known.select("node_id"), in_hash_order(seed), "k").where(F.col("k") <= n).select("node_id", F.lit(True).alias("turned"))
    new = F.when(F.col("turned") & (F.col("label") == "illicit"), "licit").when(F.col("turned"), "illicit").otherwise(F.col("label"))
    return labels.join(chosen, "node_id", "left").withColumn("label", new).drop("turned").select(*labels.columns)


def pools(labelled: DataFrame, split: int) -> DataFrame:
    """labelled (node_id, y, time_first_seen) with pool: loss up to split, validation after; an error if a pool lacks a class."""
    df = labelled.where("time_first_seen IS NOT NULL").withColumn("pool", F.when(F.col("time_first_seen") <= split, "loss").otherwise("validation"))
    seen = {(r.pool, r.y) for r in df.select("pool", "y").distinct().collect()}
    if lacking := {(p, y) for p in ("loss", "validation") for y in (0, 1)} - seen:
        raise ValueError(f"pools without a class: {sorted(lacking)}")
    return df


def group_label_stats(nodes: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """Per group of the nodes with prefix: labelled, illicit and licit ones."""
    df = nodes.where(F.col("node_id").startswith(prefix)).select("node_id").join(labels, "node_id").groupBy(group_of("node_id").alias("fold"))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "illicit").alias("n_illicit"), F.count_if(F.col("label") == "licit").alias("n_licit"))


def validation_groups(stats: DataFrame, least: int, overrides: dict[str, str] | None = None) -> DataFrame:
    """Per fold the smallest other group with at least least of each class, ties by name; overrides win, null if there is none.

    Only the two smallest groups with enough can be an answer, so no pairs are formed.
    """
    fit = stats.where((F.col("n_illicit") >= least) & (F.col("n_licit") >= least) & F.col("fold").isNotNull())
    two = fit.agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "fold"))), 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0))["fold"], F.get("two", F.lit(1))["fold"]
    pick = F.when(first != F.col("fold"), first).otherwise(second)
    for fold, group in (overrides or {}).items():
        pick = F.when(F.col("fold") == fold, group).otherwise(pick)
    return stats.where("fold IS NOT NULL").join(F.broadcast(two)).select("fold", pick.alias("validation"))


def stratified_subsample(labelled: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows of labelled (node_id, y, ...), classes in proportion and one of each at least; all rows if k is not less than their number."""
    n = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
    total = sum(n.values())
    if k >= total:
        return labelled
    if k < 2:
        raise ValueError(f"{k} rows cannot hold both classes")
    positive = min(max(round(k * n.get(1, 0) / total), 1), k - 1)
    out = None
    for y, quota in ((1, positive), (0, k - positive)):
        own = row_numbers(labelled.where(F.col("y") == y), in_hash_order(seed), "__k").where(F.col("__k") <= quota).drop("__k")
        out = own if out is None else out.unionByName(own)
    return out
