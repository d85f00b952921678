"""Evaluation, fusion and learned scores on the standard tables, with SQL where it can state the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.operators import alerts, evaluation, graph, learning, queues, scoring, temporal
from ledgerscope.plans.bindings import LABELS, NODES, PAYMENTS, account_labels, key, payments, table
from ledgerscope.plans.graph_queries import buyer_labels, planted
from ledgerscope.plans.queries import COMPOSITE, MOST, QUEUE, T0, composite, composite_of, query, queue, rounded, sized, walks

HITS = f"hr AS (SELECT m.rank, count(*) FILTER (label = 'illicit') AS bad, count(*) FILTER (label IN ('illicit', 'licit')) AS known FROM m LEFT JOIN l USING (node_id) GROUP BY 1)"
LABELLED = "la AS (SELECT node_id, score, (label = 'illicit')::INT AS y FROM y JOIN l USING (node_id) WHERE label <> 'unknown')"


def degree_scores(spark, sf_dir) -> DataFrame:
    return graph.degrees(*sized(spark, sf_dir)).select("node_id", F.col("degree").cast("double").alias("score"))


def labelled(spark, sf_dir) -> DataFrame:
    return composite(spark, sf_dir).join(temporal.confirmed(account_labels(spark, sf_dir)), "node_id")


def features(spark, sf_dir) -> DataFrame:
    return staged(graph.payment_features(*sized(spark, sf_dir)), "features")


COLUMNS = ["in_count", "out_count", "retention_ratio", "velocity", "holding_time_median"]


@query(f"WITH {QUEUE}, {LABELS}, {HITS} SELECT rank, bad AS n_illicit, known AS n_confirmed, bad >= 1 AND bad >= 0.1 * known AS is_hit FROM hr")
def m4_hit_rule_share(spark, sf_dir):
    return alerts.hit_rule(queue(spark, sf_dir)[1], account_labels(spark, sf_dir), 1, 0.1).drop("n_members")


@query(f"""WITH {QUEUE}, {NODES}, c AS (SELECT q.rank AS r, 'c' || q.rank AS id, count(*) AS n, round(max(total), 2) AS score FROM q JOIN m ON q.rank = m.rank GROUP BY 1 HAVING count(*) <= 100),
w AS (SELECT m.rank AS r, min(t) AS a, max(t) AS z FROM m JOIN n USING (node_id) GROUP BY 1)
SELECT 'ledger:main:' || row_number() OVER (ORDER BY score DESC, id) AS alert_id, row_number() OVER (ORDER BY score DESC, id) AS rank, score AS risk_score, id AS community_id, a AS time_window_start, z AS time_window_end, n AS n_members FROM c JOIN w USING (r)""")
def m1_built_alerts(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    c = members.groupBy("rank").agg(F.collect_list("node_id").alias("member_node_ids")).join(ranked, "rank")
    c = c.select(F.concat(F.lit("c"), F.col("rank").cast("string")).alias("community_id"), F.round("total", 2).alias("score"), "member_node_ids")
    return rounded(alerts.build_alerts(c, sized(spark, sf_dir)[0], "ledger", "main").drop("member_node_ids", "caveats"), 2)


@query(f"""WITH {QUEUE}, {LABELS}, {HITS}, k AS (SELECT unnest([10, 100, 100000]) AS budget) SELECT budget::BIGINT AS budget, least(budget, (SELECT count(*) FROM hr))::BIGINT AS k_effective,
(SELECT count(*) FROM hr WHERE rank <= budget AND bad >= 3) AS n_hits, round((SELECT count(*) FROM hr WHERE rank <= budget AND bad >= 3) / least(budget, (SELECT count(*) FROM hr)), 6) AS precision,
round(1 - (SELECT count(*) FROM hr WHERE rank <= budget AND bad >= 3) / least(budget, (SELECT count(*) FROM hr)), 6) AS false_alert_rate FROM k""")
def m9_queue_metrics(spark, sf_dir):
    return rounded(alerts.queue_metrics(alerts.hit_rule(queue(spark, sf_dir)[1], account_labels(spark, sf_dir), 3), [10, 100, 100_000]))


@query(f"WITH {QUEUE} SELECT count(*) AS n, greatest(1, round_even(count(*) * 0.01, 0))::BIGINT AS k_1, greatest(1, round_even(count(*) * 0.125, 0))::BIGINT AS k_2, 50::BIGINT AS k_3 FROM q")
def m11_percent_budgets(spark, sf_dir):
    n = queue(spark, sf_dir)[0].agg(F.count("*").alias("n"))
    return n.select("n", *(c.alias(f"k_{i}") for i, c in enumerate(alerts.percent_budgets(["1%", "12.5%", 50], "n"), 1)))


@query(f"""WITH {COMPOSITE}, {LABELS}, {LABELLED}, st AS (SELECT t // 200 AS step, score, y FROM la JOIN n USING (node_id) WHERE t IS NOT NULL), g AS (SELECT step, score, count(*) AS c, sum(y) AS h FROM st GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER w AS cu, sum(h) OVER w AS hu FROM g WINDOW w AS (PARTITION BY step ORDER BY score DESC))
SELECT step, sum(c)::BIGINT AS n_confirmed, sum(h)::BIGINT AS n_illicit, round(CASE WHEN sum(h) > 0 AND sum(h) < sum(c) THEN sum(h * hu / cu) / sum(h) END, 6) AS auc_pr, round(sum(h) / sum(c), 6) AS prevalence FROM r GROUP BY 1""")
def m12_metrics_by_step(spark, sf_dir):
    n = sized(spark, sf_dir)[0].withColumn("time_first_seen", F.floor(F.col("time_first_seen") / 200))
    return rounded(evaluation.metrics_by_step(composite(spark, sf_dir), account_labels(spark, sf_dir), n))


@query()
def m13_evaluation_report(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    return rounded(evaluation.evaluation_report(ranked, members, account_labels(spark, sf_dir), composite(spark, sf_dir), [10, 100]))


def grid_sql(*thresholds: float, most: int | None = MOST) -> str:
    """A sensitivity grid (table gr) over thresholds and shares null and 0.1."""
    each = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, * FROM st{k}" for k, t in enumerate(thresholds))
    return f"""{walks(*thresholds, most=most)}, {LABELS}, {HITS}, sa AS ({each}), gr AS (SELECT threshold, share, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_suppressed,
 count(*) FILTER (kept AND bad >= 1 AND bad >= coalesce(share, -1) * known) AS n_hits FROM sa JOIN hr USING (rank), (SELECT unnest([NULL, 0.1]) AS share) GROUP BY 1, 2)"""


@query(f"WITH {grid_sql(0.04, 0.5, most=None)} SELECT * FROM gr")
def m14_sensitivity(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    return alerts.sensitivity(ranked, members, account_labels(spark, sf_dir), [0.04, 0.5], [None, 0.1], most=None)


@query(f"WITH {grid_sql(0.04, 0.06, 0.5)} SELECT count(*) AS cells, array_to_string(list_sort(list_distinct(list(n_kept))), ',') AS kept_values, min(n_hits) AS min_hits, max(n_hits) AS max_hits FROM gr")
def f17_sensitivity_summary(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    grid = alerts.sensitivity(ranked, members, account_labels(spark, sf_dir), [0.04, 0.06, 0.5], [None, 0.1], most=MOST)
    return queues.sensitivity_summary(grid).withColumn("kept_values", F.concat_ws(",", F.transform("kept_values", lambda x: x.cast("string"))))


@query()
def m15_bootstrap(spark, sf_dir):
    return rounded(evaluation.bootstrap_interval(labelled(spark, sf_dir), 100))


@query()
def m16_paired_bootstrap(spark, sf_dir):
    both, _ = evaluation.compared_scores(composite(spark, sf_dir), degree_scores(spark, sf_dir), account_labels(spark, sf_dir))
    return rounded(evaluation.paired_bootstrap(both, 100))


@query(f"""WITH {COMPOSITE}, {LABELS} SELECT (SELECT count(*) FROM y WHERE node_id NOT IN (SELECT node_id FROM n)) AS n_only_a, (SELECT count(*) FROM n WHERE node_id NOT IN (SELECT node_id FROM y)) AS n_only_b,
(SELECT count(*) FROM y JOIN n USING (node_id)) AS n_both""")
def m17_compared_scores(spark, sf_dir):
    return evaluation.compared_scores(composite(spark, sf_dir), degree_scores(spark, sf_dir), account_labels(spark, sf_dir))[1]


@query()
def m18_recovery(spark, sf_dir):
    n, e, truth = planted(spark, sf_dir)
    return rounded(evaluation.recovery_at_budgets(graph.degrees(n, e).select("node_id", F.col("degree").cast("double").alias("score")), truth, [50, 500]))


@query("""WITH r AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'graph' ELSE 'list' END AS arm, (1 + l_partkey % 5)::DOUBLE AS clear, (1 + l_suppkey % 7)::DOUBLE AS useful FROM lineitem),
t AS (SELECT arm, 'clear' AS dimension, clear AS v FROM r UNION ALL SELECT arm, 'useful', useful FROM r)
SELECT NULL AS arm, dimension, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT arm, dimension, round(avg(v), 6), round(stddev_samp(v), 6), count(*) FROM t GROUP BY 1, 2""")
def m20_rating_summary(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, "graph").otherwise("list").alias("arm"), (1 + F.col("l_partkey") % 5).alias("clear"), (1 + F.col("l_suppkey") % 7).alias("useful"))
    return rounded(evaluation.rating_summary(r, ["clear", "useful"]))


@query("WITH r AS (SELECT l_orderkey AS unit, l_linenumber AS rater, avg(1 + l_partkey % 5) AS v FROM lineitem GROUP BY 1, 2) SELECT unit, round(max(v) FILTER (rater = 1), 6) AS r1, round(max(v) FILTER (rater = 2), 6) AS r2, round(max(v) FILTER (rater = 3), 6) AS r3 FROM r WHERE rater <= 3 GROUP BY 1")
def f11_rating_matrix(spark, sf_dir):
    """Units by the first three raters."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    m = evaluation.rating_matrix(items.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), (1 + F.col("l_partkey") % 5).alias("rating")), [1, 2, 3])
    return rounded(m.withColumnsRenamed({str(k): f"r{k}" for k in (1, 2, 3)}))


@query(f"WITH {QUEUE} SELECT 'top' AS stratum, 6::BIGINT AS n UNION ALL SELECT 'rest', 10")
def m21_study_sample(spark, sf_dir):
    cases = queue(spark, sf_dir)[0].select(F.col("rank").alias("case_id"), "total")
    s = evaluation.study_sample(cases, [("top", "case_id <= 20", 6), ("rest", "case_id > 0", 10)], ["graph", "list"], 4)
    return s.groupBy("stratum").agg(F.count("*").alias("n"))


@query()
def m23_alert_queue(spark, sf_dir):
    """From scores to a queue: calibrated scores, communities, community scores, alerts."""
    n, e = sized(spark, sf_dir)
    scores = composite(spark, sf_dir)
    y = temporal.confirmed(account_labels(spark, sf_dir))
    cal = staged(learning.calibrated(scores, scores.join(y, "node_id")), "calibrated")
    c = staged(graph.communities(e), "communities")
    scored = scoring.community_scores(c, cal)
    members = c.groupBy("community_id").agg(F.array_sort(F.collect_list("node_id")).alias("member_node_ids"))
    return rounded(alerts.build_alerts(scored.join(members, "community_id"), n, "ledger", "calibrated", most=10_000).drop("member_node_ids"))


def strict(spark, sf_dir) -> tuple[tuple[DataFrame, DataFrame], DataFrame, tuple[DataFrame, DataFrame], DataFrame, DataFrame]:
    """The graph as of T0 and the labels of its nodes; the whole graph, its nodes first seen later and their labels. No node is on both sides."""
    n, e = sized(spark, sf_dir)
    y = temporal.confirmed(account_labels(spark, sf_dir))
    early = tuple(staged(x, "train-graph") for x in temporal.train_graph(n, e, T0))
    late = staged(n.where(F.col("time_first_seen") > T0).select("node_id"), "test-nodes")
    return early, y.join(early[0].select("node_id"), "node_id", "left_semi"), (n, e), late, y.join(late, "node_id", "left_semi")


def split_scores(spark, sf_dir) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame, DataFrame]:
    """Composite and degree of the nodes seen after T0, the same of the graph as of T0, and the labels of these and of those."""
    early, y, whole, late, y_late = strict(spark, sf_dir)
    scores = lambda n, e: {"composite": composite_of(n, e), "degree": graph.degrees(n, e).select("node_id", F.col("degree").cast("double").alias("score"))}
    tests = {k: staged(v.join(late, "node_id", "left_semi"), k) for k, v in scores(*whole).items()}
    return tests, {k: staged(v, k) for k, v in scores(*early).items()}, y, y_late


def trees(features: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    return learning.tree_scores(features, train, columns, trees=10)


@query()
def m24_ensemble(spark, sf_dir):
    """Members and fusions on the nodes first seen after T0; what is fitted is fitted on the graph and labels as of T0."""
    tests, known, y, y_late = split_scores(spark, sf_dir)
    fused = {"calibrated_fusion": learning.calibrated_fusion(tests, known, y), "rank_fusion": scoring.rank_fusion(tests).select("node_id", "score")}
    labels = y_late.select("node_id", F.when(F.col("y") == 1, "illicit").otherwise("licit").alias("label"))
    return rounded(evaluation.member_metrics(tests | {k: staged(v, k) for k, v in fused.items()}, labels, [10, 100]))


@query()
def l2_tree_scores(spark, sf_dir):
    """Nodes first seen after T0, by trees learned on the graph and labels as of T0."""
    early, y, whole, late, _ = strict(spark, sf_dir)
    test = graph.payment_features(*whole).join(late, "node_id", "left_semi")
    return rounded(learning.held_out_scores(trees, graph.payment_features(*early), y, test, COLUMNS))


@query()
def l3_tree_scores_with_neighbours(spark, sf_dir):
    """As l2, with means over neighbours and flows, those of the graph as of T0 for learning."""
    early, y, whole, late, _ = strict(spark, sf_dir)

    def wide(n: DataFrame, e: DataFrame) -> DataFrame:
        f = staged(graph.payment_features(n, e), "features")
        flow = graph.line_graph_flow(e).select("node_id", "flow_log", "pass_ratio")
        return f.join(graph.neighbour_means(e, f, COLUMNS), "node_id").join(flow, "node_id", "left")

    fit = wide(*early)
    return rounded(learning.held_out_scores(trees, fit, y, wide(*whole).join(late, "node_id", "left_semi"), [c for c in fit.columns if c != "node_id"]))


@query()
def l5_propagation_scores(spark, sf_dir):
    """Learned on the graph as of T0, applied to all; rows of the two classes weigh the same (L6)."""
    n, e = sized(spark, sf_dir)
    train_nodes, train_edges = temporal.train_graph(n, e, T0)
    y = temporal.confirmed(account_labels(spark, sf_dir)).join(train_nodes.select("node_id"), "node_id", "left_semi")
    return rounded(learning.propagation_scores(e, train_edges, features(spark, sf_dir).select("node_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("in_count", "velocity"))), y, ["in_count", "velocity"]))


@query(f"WITH {LABELS}, c AS (SELECT count(*) FILTER (label = 'illicit') AS p, count(*) FILTER (label = 'licit') AS q FROM l) SELECT (label = 'illicit')::BIGINT AS y, count(*) AS n, round(max(CASE WHEN label = 'illicit' THEN q / p ELSE 1 END), 6) AS weight FROM l, c WHERE label <> 'unknown' GROUP BY 1")
def l6_class_weights(spark, sf_dir):
    y = temporal.confirmed(account_labels(spark, sf_dir))
    return rounded(y.withColumn("w", learning.class_weight(y)).groupBy("y").agg(F.count("*").alias("n"), F.max("w").alias("weight")))


@query()
def l7_reconstruction(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    f = staged(graph.payment_features(n, e), "features").select("node_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS))
    return rounded(learning.reconstruction_scores(e, f, COLUMNS))


@query()
def l8_calibrated(spark, sf_dir):
    """Composite scores of the nodes first seen after T0, calibrated on scores and labels as of T0."""
    tests, known, y, _ = split_scores(spark, sf_dir)
    return rounded(learning.calibrated(tests["composite"], known["composite"].join(y, "node_id")))


@query()
def l9_calibrated_fusion(spark, sf_dir):
    """As l8, fused with the degree."""
    tests, known, y, _ = split_scores(spark, sf_dir)
    return rounded(learning.calibrated_fusion(tests, known, y, {"degree": 0.5}))


@query()
def l13_label_efficiency(spark, sf_dir):
    f = features(spark, sf_dir).select("node_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS))
    n, _ = sized(spark, sf_dir)
    own = temporal.pools(temporal.confirmed(account_labels(spark, sf_dir)).join(n, "node_id"), T0)
    return rounded(learning.label_efficiency(f, own.where("pool = 'loss'"), own.where("pool = 'validation'"), COLUMNS, [10, 40], 2))


@query()
def l14_fold_matrix(spark, sf_dir):
    """Per nation of buyers, scores learned from all other nations' buyers, on their orders and balances' signs as labels."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price"))
    f = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(key("buyer", "c_nationkey", "c_custkey").alias("node_id"), F.coalesce("orders", F.lit(0)).cast("double").alias("orders"), F.coalesce("mean_price", F.lit(0.0)).alias("mean_price"))
    groups = [str(r[0]) for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return rounded(learning.fold_matrix(staged(f, "buyers"), temporal.confirmed(buyer_labels(spark, sf_dir)), ["orders", "mean_price"], groups))


@query("""WITH f AS (SELECT c_nationkey::VARCHAR AS fold, avg(c_acctbal) / 10000 AS a, avg((c_acctbal < 0)::INT) AS p, CASE WHEN c_nationkey % 6 = 0 THEN 'too few' END AS skipped FROM customer GROUP BY 1, 4)
SELECT count(*) AS folds, count(skipped) AS skipped, round(avg(a) FILTER (skipped IS NULL), 6) AS macro_auc_pr, round(avg(CASE WHEN p > 0 THEN a / p END) FILTER (skipped IS NULL), 6) AS macro_lift FROM f""")
def f15_macro_lift(spark, sf_dir):
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("fold"), F.when(F.col("c_nationkey") % 6 == 0, "too few").alias("skipped"))
    return rounded(queues.macro_lift(f.agg((F.avg("c_acctbal") / 10000).alias("auc_pr"), F.avg((F.col("c_acctbal") < 0).cast("int")).alias("prevalence"))))


@query("SELECT l_returnflag AS metric, count(*) AS runs, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd FROM (SELECT l_returnflag, l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def f14_seed_summary(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("value"))
    return rounded(queues.seed_summary(m))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, min_by(c_name, (-c_acctbal, c_name)) AS c_name, round(max(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1")
def f13_best_by_group(spark, sf_dir):
    return rounded(queues.best_by(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_name"), 2)


@query(f"""WITH {QUEUE} SELECT 'ledger' AS dataset, CASE WHEN s >= 0.66 THEN 'high' WHEN s >= 0.33 THEN 'med' ELSE 'low' END AS band, count(*) FILTER (rank % 4 = 0) AS with_bundle, count(*) FILTER (rank % 4 <> 0) AS without_bundle FROM (SELECT *, 1 / (1 + rank / 100.0) AS s FROM q) GROUP BY 2""")
def f19_explanation_coverage(spark, sf_dir):
    a = queue(spark, sf_dir)[0].select("rank", F.col("rank").cast("string").alias("alert_id"), F.lit("ledger").alias("dataset"), (1 / (1 + F.col("rank") / 100.0)).alias("risk_score"))
    return queues.explanation_coverage(a, a.where("rank % 4 = 0").select("alert_id"))


@query("WITH r AS (SELECT lang AS category, n_chars > 200 AS ok FROM documents) SELECT category, count(*) AS n, round(avg(ok::INT), 6) AS rate FROM r GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(ok::INT), 6) FROM r")
def f20_pass_rates(spark, sf_dir):
    return rounded(queues.pass_rates(table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), (F.col("n_chars") > 200).alias("ok"))))


@query("SELECT 'o' || o_orderkey AS metric, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM orders")
def f21_checked_claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    metric = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("metric")
    claims = o.select(metric, F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("value"))
    return queues.checked_claims(claims, o.where("o_orderkey % 7 <> 0").select(metric, F.col("o_totalprice").alias("value")), 0.5)


@query(f"WITH {QUEUE} SELECT 'ledger:run-s' || (rank % 3) || ':' || rank AS alert_id, 'ledger' AS dataset, 'run-s' || (rank % 3) AS run, rank AS number, rank % 3 AS seed FROM q")
def i10_decoded_ids(spark, sf_dir):
    a = queue(spark, sf_dir)[0].select(F.concat(F.lit("ledger:run-s"), (F.col("rank") % 3).cast("string"), F.lit(":"), F.col("rank").cast("string")).alias("alert_id"))
    return queues.decoded(a)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"user\":' || user_id || ',\"gone\":null}' AS record FROM events")
def i6_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("user_id").alias("user"), F.lit(None).cast("string").alias("gone")), {"ignoreNullFields": "false"})
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), record.alias("record"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'illicit' WHEN 'O' THEN 'licit' ELSE 'unknown' END AS label FROM orders")
def i9_mapped(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("F", "illicit", "O", "licit")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("unknown")).alias("label"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL AS s_only FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey::VARCHAR FROM supplier")
def h4_union_of_differing_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("s_only"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def f10_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH {PAYMENTS}, s AS (SELECT src, count(*) AS c, avg(amount) AS m FROM e GROUP BY 1) SELECT src, dst, ts AS timestamp, round(amount, 2) AS amount, c AS n_of_source, round(amount / m, 6) AS over_mean FROM e JOIN s USING (src)")
def g3_group_means(spark, sf_dir):
    """Each payment against the count and mean of its source; grouped and joined, so a busy source is not one window."""
    e = payments(spark, sf_dir)
    s = e.groupBy("src").agg(F.count("*").alias("n_of_source"), F.avg("amount").alias("mean"))
    return rounded(e.join(s, "src").select("src", "dst", "timestamp", F.round("amount", 2).alias("amount"), "n_of_source", (F.col("amount") / F.col("mean")).alias("over_mean")))


@query(f"WITH {PAYMENTS}, i AS (SELECT dst AS node_id, count(*) AS c FROM e GROUP BY 1), o AS (SELECT src AS node_id, count(*) AS c FROM e GROUP BY 1) SELECT coalesce(i.node_id, o.node_id) AS node_id, i.c AS received, o.c AS paid FROM i FULL JOIN o ON i.node_id = o.node_id")
def e3_full_outer(spark, sf_dir):
    e = payments(spark, sf_dir)
    i = e.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("received"))
    return i.join(e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("paid")), "node_id", "full")
