"""Operators on the standard tables, each with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators import alerts, graph, motifs, profiles, scoring, screens, temporal, text
from ledgerscope.functions.staging import staged
from ledgerscope.operators.components import connected_components
from ledgerscope.operators.order import row_numbers
from ledgerscope.plans.bindings import BIDS, LABELS, NODES, PAYMENTS, account_labels, bids, payments, table

#: A day by which about half of the accounts of the standard tables have been seen.
T0 = 9160
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind in ("double", "float") else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes))


def sized(spark, sf_dir):
    """Nodes and payments; these are joined once and written, as every feature reads them again."""
    e = staged(payments(spark, sf_dir), "payments")
    return temporal.nodes_of(e), e


def queue_with_pairs(spark, sf_dir):
    """Alerts (rank) by sum of outflows over accounts that pay three or more others, their members, and all distinct pairs (src, dst) of payers and paid.

    Amounts are added as decimals (to a millionth), so that equal sums are equal in any
    order of addition and ranks do not hang on how the rows were dealt. Payments are
    joined and dealt by payer once; their pairs and the members are written.
    """
    e = payments(spark, sf_dir).select("src", "dst", "amount").repartition("src")
    pairs = staged(e.groupBy("src", "dst").agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("amount")), "pairs")
    out = pairs.groupBy("src").agg(F.sum("amount").alias("total"), F.count("dst").alias("n")).where("n >= 3")
    ranked = staged(row_numbers(out, [F.desc("total"), "src"]).select("rank", "src", F.col("total").cast("double").alias("total")), "queue")
    paid = ranked.join(pairs.where("NOT src <=> dst").select("src", "dst"), "src").select("rank", "dst")
    return ranked, staged(ranked.select("rank", F.col("src").alias("node_id")).union(paid), "members"), pairs.select("src", "dst")


def queue(spark, sf_dir):
    """Alerts and members of queue_with_pairs()."""
    return queue_with_pairs(spark, sf_dir)[:2]


QUEUE = f"""{PAYMENTS}, q AS (SELECT src, sum(amount) AS total, row_number() OVER (ORDER BY sum(amount) DESC, src) AS rank FROM e GROUP BY src HAVING count(DISTINCT dst) >= 3),
 m AS (SELECT rank, src AS node_id FROM q UNION SELECT rank, dst FROM q JOIN e USING (src))"""
#: Pairs of alerts whose members overlap by more than 0.04.
PAIRS = f"""{QUEUE}, mn AS (SELECT rank, count(*) AS n FROM m GROUP BY 1), x AS (SELECT a.rank AS better, b.rank AS worse, count(*) AS c FROM m a JOIN m b ON a.node_id = b.node_id AND a.rank < b.rank GROUP BY 1, 2),
 pr AS (SELECT better, worse, c / (a.n + b.n - c) AS jaccard FROM x JOIN mn a ON better = a.rank JOIN mn b ON worse = b.rank WHERE c / (a.n + b.n - c) > 0.04)"""
#: Members of the largest alert that a queue keeps here, which some alerts of the standard tables exceed.
MOST = 50


def walks(*thresholds: float, most: int | None = MOST) -> str:
    """The walks in rank order over alerts of at most most members (None: of any number), each of which appends to a list of accepted alerts: tables st0, st1, ... of rank, kept and overlap_group."""
    sql = f"""RECURSIVE {PAIRS}, qs AS (SELECT rank, row_number() OVER (ORDER BY rank) AS i FROM mn{"" if most is None else f" WHERE n <= {most}"}), ps AS (SELECT * FROM pr WHERE better IN (SELECT rank FROM qs) AND worse IN (SELECT rank FROM qs))"""
    for k, t in enumerate(thresholds):
        sql += f""", p{k} AS (SELECT better, worse FROM ps WHERE jaccard > {t}), cf{k} AS (SELECT worse, list(better) AS bs FROM p{k} GROUP BY 1),
 k{k} AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL SELECT qs.i, CASE WHEN list_has_any(acc, coalesce(bs, []::BIGINT[])) THEN acc ELSE list_append(acc, qs.rank) END FROM k{k} JOIN qs ON qs.i = k{k}.i + 1 LEFT JOIN cf{k} ON worse = qs.rank),
 acc{k} AS (SELECT unnest(acc) AS rank, generate_subscripts(acc, 1) - 1 AS g FROM (SELECT acc FROM k{k} ORDER BY i DESC LIMIT 1)),
 st{k} AS (SELECT qs.rank, a.rank IS NOT NULL AS kept, coalesce(a.g, (SELECT min(o.g) FROM p{k} JOIN acc{k} o ON o.rank = p{k}.better WHERE p{k}.worse = qs.rank))::BIGINT AS overlap_group FROM qs LEFT JOIN acc{k} a ON qs.rank = a.rank)"""
    return sql


@query(f"""WITH {PAYMENTS}, {NODES}, f AS (SELECT * FROM e WHERE ts <= {T0})
SELECT a.src, count(*) AS n_edges, round(sum(a.amount), 2) AS total FROM f a WHERE a.src IN (SELECT node_id FROM n WHERE t <= {T0}) AND a.dst IN (SELECT node_id FROM n WHERE t <= {T0}) GROUP BY a.src""")
def b4_as_of(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    _, kept = temporal.as_of(n, e, T0)
    return kept.groupBy("src").agg(F.count("*").alias("n_edges"), F.round(F.sum("amount"), 2).alias("total"))


@query(f"""WITH {PAYMENTS}, {NODES} SELECT CASE WHEN t IS NULL THEN 'unplaced' WHEN t <= {T0} THEN 'train' WHEN t >= {T0 + 40} THEN 'test' ELSE 'gap' END AS role, count(*) AS n FROM n GROUP BY 1""")
def d1_strict_split(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    return temporal.strict_split(n, e, T0, T0 + 40).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {BIDS}, g AS (SELECT split_part(firm, ':', 2) AS a, split_part(tender, ':', 2) AS c FROM b),
k AS (SELECT DISTINCT a AS fold FROM g UNION SELECT DISTINCT c FROM g)
SELECT fold, (SELECT count(*) FROM g WHERE a = c AND a = fold) AS test_edges, (SELECT count(*) FROM g WHERE a = c AND a <> fold) AS train_edges, (SELECT count(*) FROM g WHERE a <> c) AS excluded FROM k""")
def d3_leave_one_group_out(spark, sf_dir):
    return temporal.fold_edges(bids(spark, sf_dir), "firm", "tender")


@query(f"""WITH {PAYMENTS}, {NODES} SELECT node_id, (SELECT count(*) FROM e WHERE dst = node_id) AS in_degree, (SELECT count(*) FROM e WHERE src = node_id) AS out_degree,
(SELECT count(*) FROM e WHERE dst = node_id) + (SELECT count(*) FROM e WHERE src = node_id) AS degree FROM n""")
def j1_degrees(spark, sf_dir):
    return graph.degrees(*sized(spark, sf_dir))


@query(f"WITH {PAYMENTS}, p AS (SELECT DISTINCT src, dst FROM e) SELECT a.src AS node_id, count(*) AS mutual_degree FROM p a JOIN p z ON a.src = z.dst AND a.dst = z.src GROUP BY 1")
def j2_mutual_degree(spark, sf_dir):
    return graph.mutual_degree(payments(spark, sf_dir))


@query(f"""WITH {PAYMENTS}, p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst),
d AS (SELECT x AS node_id, count(*) AS k FROM (SELECT u AS x FROM p UNION ALL SELECT v FROM p) GROUP BY 1),
t AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM p a JOIN p b ON a.v = b.u JOIN p c ON c.u = a.u AND c.v = b.v),
c AS (SELECT node_id, count(*) AS n FROM (SELECT x AS node_id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1)
SELECT d.node_id, k AS simple_degree, coalesce(n, 0) AS triangles, round(CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(n, 0) / (k * (k - 1)) END, 6) AS clustering FROM d LEFT JOIN c USING (node_id)""")
def j4_triangles(spark, sf_dir):
    return rounded(graph.triangles(payments(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PAYMENTS}, p AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst UNION SELECT DISTINCT dst, src FROM e WHERE src <> dst),
c AS (SELECT DISTINCT src AS node_id, src AS component, 0 AS i FROM p UNION ALL SELECT node_id, min(c), i FROM (SELECT c.node_id, c.component AS c, c.i + 1 AS i FROM c WHERE i < 16 UNION ALL SELECT p.dst, c.component, c.i + 1 FROM c JOIN p ON p.src = c.node_id WHERE i < 16) GROUP BY node_id, i)
SELECT node_id, component FROM c WHERE i = 16""")
def j7_components(spark, sf_dir):
    return connected_components(payments(spark, sf_dir), "src", "dst").withColumnsRenamed({"node": "node_id"})


@query(f"""WITH {PAYMENTS}, v AS (SELECT src AS node_id, ts FROM e UNION ALL SELECT dst, ts FROM e), g AS (SELECT node_id, ts - lag(ts) OVER (PARTITION BY node_id ORDER BY ts) AS gap FROM v),
s AS (SELECT node_id, stddev_samp(gap) AS sd, avg(gap) AS m FROM g GROUP BY 1) SELECT node_id, round(CASE WHEN sd + m > 0 THEN (sd - m) / (sd + m) END, 6) AS burstiness FROM s""")
def j9_burstiness(spark, sf_dir):
    return rounded(graph.burstiness(graph.incident_events(payments(spark, sf_dir))))


@query(f"""WITH {PAYMENTS}, g AS (SELECT dst AS node_id, ts - lag(ts) OVER (PARTITION BY dst ORDER BY ts) AS gap FROM e), s AS (SELECT node_id, stddev_samp(gap) AS sd, avg(gap) AS m FROM g GROUP BY 1),
d AS (SELECT dst AS node_id, count(*) AS in_count, round(sum(amount), 2) AS in_sum, round(avg(CASE WHEN amount % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS in_round_share, min(ts) AS in_first, max(ts) AS in_last FROM e GROUP BY 1)
SELECT d.*, round(CASE WHEN sd + m > 0 THEN (sd - m) / (sd + m) END, 6) AS in_burstiness FROM d JOIN s USING (node_id)""")
def j14_direction_stats(spark, sf_dir):
    df = graph.direction_stats(payments(spark, sf_dir), "dst", "in", base=10.0)
    return rounded(df.withColumn("in_sum", F.round("in_sum", 2)))


FEATURES = f"""{PAYMENTS}, {NODES}, i AS (SELECT dst AS node_id, count(*) AS c, sum(amount) AS s, min(ts) AS a, max(ts) AS z FROM e GROUP BY 1),
o AS (SELECT src AS node_id, count(*) AS c, sum(amount) AS s, min(ts) AS a, max(ts) AS z FROM e GROUP BY 1),
h AS (SELECT x.src AS node_id, median(x.ts - (SELECT max(y.ts) FROM e y WHERE y.dst = x.src AND y.ts <= x.ts)) AS held FROM e x GROUP BY 1),
f AS (SELECT n.node_id, coalesce(i.c, 0) AS in_count, coalesce(o.c, 0) AS out_count,
 CASE WHEN coalesce(i.s, 0) + coalesce(o.s, 0) > 0 THEN (coalesce(i.s, 0) - coalesce(o.s, 0)) / (coalesce(i.s, 0) + coalesce(o.s, 0)) END AS retention_ratio,
 (coalesce(i.c, 0) + coalesce(o.c, 0)) / (greatest(i.z, o.z) - least(i.a, o.a) + 1) AS velocity, held AS holding_time_median
 FROM n LEFT JOIN i ON n.node_id = i.node_id LEFT JOIN o ON n.node_id = o.node_id LEFT JOIN h ON n.node_id = h.node_id)"""


@query(f"WITH {FEATURES} SELECT node_id, in_count, out_count, round(retention_ratio, 6) AS retention_ratio, round(velocity, 6) AS velocity, round(holding_time_median, 6) AS holding_time_median FROM f")
def j15_payment_features(spark, sf_dir):
    return rounded(graph.payment_features(*sized(spark, sf_dir)))


@query(f"""WITH {PAYMENTS}, x AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), i AS MATERIALIZED (SELECT dst AS node_id, count(*) AS i FROM x GROUP BY 1), o AS MATERIALIZED (SELECT src AS node_id, count(*) AS o FROM x GROUP BY 1),
b AS MATERIALIZED (SELECT coalesce(i.node_id, o.node_id) AS node_id, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM i FULL JOIN o ON i.node_id = o.node_id),
u AS MATERIALIZED (SELECT dst AS node_id, avg(b.i) AS m, max(b.i) AS k FROM x JOIN b ON x.src = b.node_id GROUP BY 1), d AS MATERIALIZED (SELECT src AS node_id, avg(b.o) AS m, max(b.o) AS k FROM x JOIN b ON x.dst = b.node_id GROUP BY 1)
SELECT b.node_id, i * o AS flow, round(ln(1 + i * o), 6) AS flow_log, round(i * o / (i + o), 6) AS pass_ratio, round(u.m, 6) AS up_mean, u.k AS up_max, round(d.m, 6) AS down_mean, d.k AS down_max
FROM b LEFT JOIN u ON b.node_id = u.node_id LEFT JOIN d ON b.node_id = d.node_id""")
def j17_line_graph_flow(spark, sf_dir):
    return rounded(graph.line_graph_flow(payments(spark, sf_dir)))


@query(f"""WITH {FEATURES}, p AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)
SELECT f.node_id, round((SELECT avg(y.velocity) FROM p JOIN f y ON p.z = y.node_id WHERE p.a = f.node_id), 6) AS nbr_velocity, round((SELECT avg(y.holding_time_median) FROM p JOIN f y ON p.z = y.node_id WHERE p.a = f.node_id), 6) AS nbr_holding_time_median FROM f""")
def j18_neighbour_means(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    return rounded(graph.neighbour_means(e, graph.payment_features(n, e), ["velocity", "holding_time_median"]))


@query(f"""WITH {FEATURES}, s AS (SELECT avg(velocity) AS m, stddev_samp(velocity) AS d, avg(retention_ratio) AS m2, stddev_samp(retention_ratio) AS d2 FROM f)
SELECT node_id, round(CASE WHEN velocity IS NULL THEN 0 WHEN d > 0 THEN (velocity - m) / d ELSE 0 END, 6) AS velocity, round(CASE WHEN retention_ratio IS NULL THEN 0 WHEN d2 > 0 THEN (retention_ratio - m2) / d2 ELSE 0 END, 6) AS retention_ratio FROM f, s""")
def j11_zscores(spark, sf_dir):
    return rounded(graph.zscores(graph.payment_features(*sized(spark, sf_dir)), ["velocity", "retention_ratio"]))


AWARDS = f"{BIDS}, w AS (SELECT * FROM b WHERE won)"


@query(f"""WITH {AWARDS}, p AS (SELECT firm, buyer, count(*) AS n FROM w GROUP BY 1, 2), h AS (SELECT firm, sum(n) AS t, sum(n * n) AS q FROM p GROUP BY 1),
a AS (SELECT market, firm, count(*) AS n_awards FROM w GROUP BY 1, 2)
SELECT a.firm, n_awards, round(n_awards / sum(n_awards) OVER (PARTITION BY market), 6) AS market_share, round(q / (t * t), 6) AS buyer_hhi FROM a JOIN h ON a.firm = h.firm""")
def k1_award_screens(spark, sf_dir):
    return rounded(screens.award_screens(bids(spark, sf_dir).where("won")))


@query(f"""WITH {AWARDS}, p AS (SELECT buyer, firm, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT buyer, n, n / sum(n) OVER (PARTITION BY buyer) AS p FROM p)
SELECT buyer, sum(n)::BIGINT AS awards_made, count(*) AS winners, round(sum(p * p), 6) AS supplier_hhi, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END, 6) AS rotation_entropy FROM s GROUP BY 1""")
def k2_buyer_screens(spark, sf_dir):
    return rounded(screens.buyer_screens(bids(spark, sf_dir).where("won")))


@query(f"""WITH {BIDS}, k AS (SELECT *, row_number() OVER (PARTITION BY tender ORDER BY amount, firm) AS k FROM b), m AS (SELECT tender, avg(amount) AS mean FROM b GROUP BY 1),
c AS (SELECT b.tender, avg(pow(amount - mean, 2)) AS m2, avg(pow(amount - mean, 3)) AS m3, avg(pow(amount - mean, 4)) AS m4 FROM b JOIN m ON b.tender = m.tender GROUP BY 1),
s AS (SELECT tender, count(*) AS n, avg(amount) AS mean, stddev_samp(amount) AS sd, max(amount) AS hi, min(amount) AS lo, min(CASE WHEN k = 2 THEN amount END) AS second, stddev_samp(CASE WHEN k > 1 THEN amount END) AS rest FROM k GROUP BY 1)
SELECT s.tender, n AS n_bids, round(CASE WHEN n >= 2 THEN sd / nullif(mean, 0) END, 6) AS bid_cv, round(CASE WHEN n >= 2 THEN (hi - lo) / nullif(lo, 0) END, 6) AS bid_spread,
round(CASE WHEN n >= 2 THEN (second - lo) / nullif(lo, 0) END, 6) AS diffp, round(CASE WHEN n >= 3 THEN (second - lo) / nullif(rest, 0) END, 4) AS rd,
round(CASE WHEN n >= 3 AND sd > 0 THEN m3 / pow(m2, 1.5) END, 4) AS skew, round(CASE WHEN n >= 4 AND sd > 0 THEN m4 / (m2 * m2) - 3 END, 4) AS kurtosis FROM s JOIN c ON s.tender = c.tender""")
def k3_bid_screens(spark, sf_dir):
    df = screens.bid_screens(bids(spark, sf_dir))
    return df.select("tender", "n_bids", *(F.round(c, 4 if c in ("rd", "skew", "kurtosis") else 6).alias(c) for c in df.columns[2:]))


@query(f"""WITH {BIDS}, p AS (SELECT DISTINCT tender, firm FROM b), x AS (SELECT a.firm, z.firm AS other, count(*) AS n FROM p a JOIN p z ON a.tender = z.tender AND a.firm <> z.firm GROUP BY 1, 2)
SELECT firm, count(*) AS co_bidders, max(n) AS max_repeat FROM x GROUP BY 1""")
def k4_co_bidding(spark, sf_dir):
    return screens.co_bidding(bids(spark, sf_dir))


@query(f"""WITH {FEATURES}, c AS (SELECT quantile_cont(velocity, 0.9) AS a, quantile_cont(in_count, 0.95) AS b FROM f)
SELECT node_id, round((coalesce((velocity > a)::INT, 0) + coalesce((in_count > b)::INT, 0)) / 2, 6) AS score FROM f, c""")
def l1_rule_scores(spark, sf_dir):
    f = graph.payment_features(*sized(spark, sf_dir))
    return rounded(scoring.rule_scores(f, f, {"velocity": 0.9, "in_count": 0.95}))


COMPOSITE = f"""{FEATURES}, s AS (SELECT avg(velocity) AS m, stddev_samp(velocity) AS d, avg(holding_time_median) AS m2, stddev_samp(holding_time_median) AS d2 FROM f),
z AS (SELECT node_id, CASE WHEN velocity IS NOT NULL THEN (velocity - m) / d END AS a, CASE WHEN holding_time_median IS NOT NULL THEN -(holding_time_median - m2) / d2 END AS b FROM f, s),
y0 AS (SELECT node_id, (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) AS score FROM z WHERE a IS NOT NULL OR b IS NOT NULL),
y AS (SELECT node_id, round(score, 6) AS score FROM y0)"""


def composite_of(nodes: DataFrame, edges: DataFrame, places: int | None = 6) -> DataFrame:
    """Composite scores; rounded to places where ties and ranks are to agree with SQL."""
    f = staged(graph.payment_features(nodes, edges).select("node_id", "velocity", "holding_time_median"), "features")
    z = graph.zscores(f, ["velocity", "holding_time_median"], fill_null=False)
    z = z.withColumn("holding_time_median", -F.col("holding_time_median"))
    score = scoring.mean_of_known(["velocity", "holding_time_median"])
    return z.select("node_id", (score if places is None else F.round(score, places)).alias("score")).where("score IS NOT NULL")


def composite(spark, sf_dir, places: int | None = 6) -> DataFrame:
    return composite_of(*sized(spark, sf_dir), places)


@query(f"WITH {COMPOSITE} SELECT * FROM y")
def l4_screen_composite(spark, sf_dir):
    return composite(spark, sf_dir)


@query(f"WITH {COMPOSITE} SELECT node_id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER (), 6) AS percentile FROM y")
def l10_rank_percentiles(spark, sf_dir):
    return rounded(scoring.rank_percentiles(composite(spark, sf_dir)))


@query(f"""WITH {COMPOSITE}, d AS (SELECT node_id, (in_count + out_count)::DOUBLE AS score FROM f),
r AS (SELECT node_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS p FROM y UNION ALL
 SELECT node_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () FROM d)
SELECT node_id, round(avg(p), 6) AS score, count(*) AS members FROM r GROUP BY 1""")
def l11_rank_fusion(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    degree = graph.degrees(n, e).select("node_id", F.col("degree").cast("double").alias("score"))
    return rounded(scoring.rank_fusion({"composite": composite(spark, sf_dir), "degree": degree}))


@query(f"""WITH {COMPOSITE}, {QUEUE.removeprefix(PAYMENTS + ", ")},
k AS (SELECT m.rank AS community_id, y0.score, row_number() OVER (PARTITION BY m.rank ORDER BY y0.score DESC, m.node_id) AS k, count(*) OVER (PARTITION BY m.rank) AS n FROM m JOIN y0 USING (node_id))
SELECT community_id, round((max(score) + avg(CASE WHEN k <= greatest(1, ceil(0.2 * n)) THEN score END)) / 2, 6) AS score, count(*) AS n_scored FROM k GROUP BY 1""")
def l12_community_scores(spark, sf_dir):
    _, members = queue(spark, sf_dir)
    return rounded(scoring.community_scores(members.withColumnRenamed("rank", "community_id"), composite(spark, sf_dir, None)))


@query(f"WITH {QUEUE} SELECT q.rank, src, round(total, 2) AS total, (SELECT count(*) FROM m WHERE m.rank = q.rank) AS n_members, (SELECT min(ts) FROM e WHERE e.src = q.src) AS window_start, (SELECT max(ts) FROM e WHERE e.src = q.src) AS window_end FROM q")
def m1_alerts(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    spans = payments(spark, sf_dir).groupBy("src").agg(F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"))
    return ranked.join(members.groupBy("rank").agg(F.count("*").alias("n_members")), "rank").join(spans, "src").withColumn("total", F.round("total", 2))


@query(f"WITH {PAIRS} SELECT better, worse, round(jaccard, 6) AS jaccard FROM pr")
def m2_overlaps(spark, sf_dir):
    return rounded(alerts.overlaps(queue(spark, sf_dir)[1], 0.04))


@query(f"WITH {walks(0.04, most=None)} SELECT * FROM st0")
def m3_greedy_dedup(spark, sf_dir):
    """Alerts of any size."""
    ranked, members = queue(spark, sf_dir)
    return alerts.greedy_dedup(ranked, members, 0.04, most=None).select("rank", "kept", "overlap_group")


@query(f"WITH {walks(0.04)} SELECT (SELECT count(*) FROM q) AS n_input, (SELECT count(*) FROM mn WHERE n > {MOST}) AS n_oversized, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_suppressed FROM st0")
def m3_dedup_report(spark, sf_dir):
    ranked, members = queue(spark, sf_dir)
    return alerts.dedup_report(ranked, alerts.greedy_dedup(ranked, members, 0.04, most=MOST))


@query(f"""WITH {QUEUE}, {LABELS} SELECT rank, count(*) AS n_members, count(*) FILTER (label = 'illicit') AS n_illicit, count(*) FILTER (label IN ('illicit', 'licit')) AS n_confirmed,
count(*) FILTER (label = 'illicit') >= 2 AS is_hit FROM m LEFT JOIN l USING (node_id) GROUP BY 1""")
def m4_hit_rule(spark, sf_dir):
    return alerts.hit_rule(queue(spark, sf_dir)[1], account_labels(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    """Confirmed accounts with y and a coarse score, so that ties occur."""
    y = account_labels(spark, sf_dir).where("label <> 'unknown'")
    return composite(spark, sf_dir).join(y, "node_id").select(F.round("score", 1).alias("score"), (F.col("label") == "illicit").cast("long").alias("y"))


LABELLED = f"{COMPOSITE}, {LABELS}, v AS (SELECT round(score, 1) AS score, (label = 'illicit')::BIGINT AS y FROM y JOIN l USING (node_id) WHERE label <> 'unknown')"
BYSCORE = """g AS (SELECT score, count(*) AS n, sum(y) AS h FROM v GROUP BY 1),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na, coalesce(sum(h) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ha FROM g)"""


@query(f"""WITH {LABELLED}, {BYSCORE}, t AS (SELECT count(*) AS a, sum(y) AS p FROM v), k AS (SELECT unnest([10, 50, 200, 1000000]) AS budget),
x AS (SELECT budget, least(budget, a) AS k, a, p, sum(greatest(0, least(n, least(budget, a) - na)) * h / n) AS h FROM k, t, c GROUP BY 1, 2, 3, 4)
SELECT budget::BIGINT AS budget, k::BIGINT AS k_effective, round(h / k, 6) AS precision, round(h / p, 6) AS recall, round((k - h) / (a - p), 6) AS fpr FROM x""")
def m5_budget_metrics(spark, sf_dir):
    return rounded(scoring.budget_metrics(labelled(spark, sf_dir), [10, 50, 200, 1_000_000]))


@query(f"WITH {LABELLED}, {BYSCORE} SELECT round(sum(h * (ha + h) / (na + n)) / sum(h), 6) AS auc_pr, round(sum(h) / sum(n), 6) AS prevalence FROM c")
def m8_average_precision(spark, sf_dir):
    return rounded(scoring.average_precision(labelled(spark, sf_dir)))


@query(f"""WITH {QUEUE}, {LABELS}, x AS (SELECT l.node_id, (SELECT min(rank) FROM m WHERE m.node_id = l.node_id) AS r FROM l WHERE label = 'illicit')
SELECT round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS at_10, round(avg(CASE WHEN r <= 100 THEN 1.0 ELSE 0.0 END), 6) AS at_100 FROM x""")
def m10_illicit_coverage(spark, sf_dir):
    return rounded(alerts.illicit_coverage(queue(spark, sf_dir)[1], account_labels(spark, sf_dir), [10, 100]))


@query("""WITH r AS (SELECT l_orderkey AS u, 1 + l_partkey % 5 AS v FROM lineitem), p AS (SELECT u, v, count(*) AS c FROM r GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER (PARTITION BY u) AS m FROM p),
o AS (SELECT a.v AS x, b.v AS y, sum(CASE WHEN a.v = b.v THEN a.c * (a.c - 1) ELSE a.c * b.c END / (a.m - 1)) AS o FROM m a JOIN m b ON a.u = b.u WHERE a.m > 1 GROUP BY 1, 2),
n AS (SELECT x, sum(o) AS n FROM o GROUP BY 1), k AS (SELECT x, n, sum(n) OVER (ORDER BY x) - n / 2 AS mid FROM n),
z AS (SELECT sum(coalesce(o, 0) * pow(a.mid - b.mid, 2)) AS d, sum(a.n * b.n * pow(a.mid - b.mid, 2)) AS e, sum(coalesce(o, 0)) AS n FROM k a CROSS JOIN k b LEFT JOIN o ON o.x = a.x AND o.y = b.x)
SELECT round(CASE WHEN e > 0 THEN 1 - (n - 1) * d / e ELSE 1 END, 6) AS alpha FROM z""")
def m19_krippendorff(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return rounded(scoring.krippendorff(items.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), (1 + F.col("l_partkey") % 5).alias("rating"))))


@query(f"""WITH {PAYMENTS} SELECT dst AS node_id, 'fan_in' AS motif, count(DISTINCT src) AS n FROM e GROUP BY 1 HAVING count(DISTINCT src) >= 5
UNION ALL SELECT src, 'fan_out', count(DISTINCT dst) FROM e GROUP BY 1 HAVING count(DISTINCT dst) >= 5""")
def n2_fans(spark, sf_dir):
    return motifs.fans(payments(spark, sf_dir))


#: Payments without parallels, the latest kept, and the pairs of which the second forwards 0.9 of the first within two days.
HOPS = f"""{PAYMENTS}, c AS (SELECT src, dst, (max({{'ts': ts, 'amount': amount}})).ts AS ts, (max({{'ts': ts, 'amount': amount}})).amount AS amount FROM e GROUP BY 1, 2),
 h AS (SELECT a.src AS a, a.dst AS b, z.dst AS c, a.ts AS t1, z.ts AS t2, a.amount AS x, z.amount AS y FROM c a JOIN c z ON a.dst = z.src AND z.ts BETWEEN a.ts AND a.ts + 2 AND a.amount <> 0 AND z.amount / a.amount >= 0.9)"""


@query(f"""WITH {PAYMENTS} SELECT a.src AS "from", a.dst AS via, b.dst AS "to", a.ts AS t1, b.ts AS t2, round(a.amount, 2) AS amount_in, round(b.amount, 2) AS amount_out
FROM e a JOIN e b ON a.dst = b.src AND b.ts BETWEEN a.ts AND a.ts + 2 AND a.amount <> 0 AND b.amount / a.amount >= 0.9""")
def n4_pass_through_hops(spark, sf_dir):
    return rounded(motifs.pass_through_hops(payments(spark, sf_dir)), 2)


@query(f"""WITH RECURSIVE {HOPS}, f AS (SELECT a, b, (min({{'y': -y, 'c': c}})).c AS c FROM h GROUP BY 1, 2), s AS (SELECT f.a, f.b FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.b = f.a AND h.c = f.b)),
w AS (SELECT a AS head_src, b AS head_dst, [a, b] AS nodes, a, b FROM s UNION ALL SELECT head_src, head_dst, list_append(nodes, f.c), f.b, f.c FROM w JOIN f ON w.a = f.a AND w.b = f.b
 WHERE NOT list_contains(list_transform(range(1, len(nodes)), lambda i: nodes[i] || '>' || nodes[i + 1]), f.b || '>' || f.c)),
g AS (SELECT *, row_number() OVER (PARTITION BY head_src, head_dst ORDER BY len(nodes) DESC) AS k FROM w)
SELECT head_src, head_dst, (len(nodes) - 1)::BIGINT AS hops, array_to_string(nodes, ',') AS nodes FROM g WHERE k = 1 AND len(nodes) >= 4""")
def n4_pass_through_chains(spark, sf_dir):
    return rounded(motifs.pass_through_chains(payments(spark, sf_dir))).withColumn("nodes", F.array_join("nodes", ","))


@query(f"""WITH {AWARDS}, n AS (SELECT market, firm, count(*) AS w FROM w GROUP BY 1, 2 HAVING count(*) >= 2) SELECT market::BIGINT AS market, count(*) AS firms, sum(w)::BIGINT AS wins FROM n GROUP BY 1 HAVING count(*) >= 3""")
def n6_rotation(spark, sf_dir):
    return rounded(motifs.rotation(bids(spark, sf_dir).where("won")))


@query(f"""WITH {BIDS}, k AS (SELECT *, min(amount) OVER (PARTITION BY tender) AS low, row_number() OVER (PARTITION BY tender ORDER BY amount, firm) AS k FROM b)
SELECT tender, count(*) AS losing FROM k WHERE k > 1 GROUP BY 1 HAVING count(*) >= 2 AND bool_and(amount > low AND amount <= low * 1.5)""")
def n7_cover_bids(spark, sf_dir):
    return motifs.cover_bids(bids(spark, sf_dir), above=1.5)


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d), u AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d), p AS MATERIALIZED (SELECT term, doc_id, len, count(*) AS tf FROM u WHERE term IN (SELECT term FROM t) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), x AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 9) AS score FROM p JOIN f USING (term) JOIN t USING (term), s GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place FROM x WHERE score > 0) SELECT item_id, doc_id, round(score, 4) AS score, place FROM y WHERE place <= 5""")
def o1_bm25(spark, sf_dir):
    return rounded(text.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), 4).select("item_id", "doc_id", "score", "place")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY source, doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def o6_exact_text_dedup(spark, sf_dir):
    return text.first_of_equal_texts(table(spark, sf_dir, "documents"), ["source", "doc_id"]).select("doc_id", "source")


@query(f"""WITH {PAYMENTS}, {LABELS} SELECT ts // 30 AS step, count(*) FILTER (label = 'illicit') AS illicit, count(*) FILTER (label = 'licit') AS licit, count(*) AS total,
round(count(*) FILTER (label = 'illicit') / count(*), 6) AS share FROM e JOIN l ON e.src = l.node_id GROUP BY 1""")
def p1_labels_per_step(spark, sf_dir):
    df = payments(spark, sf_dir).join(account_labels(spark, sf_dir).withColumnRenamed("node_id", "src"), "src").groupBy(F.floor(F.col("timestamp") / 30).alias("step"))
    bad = F.count_if(F.col("label") == "illicit")
    return rounded(df.agg(bad.alias("illicit"), F.count_if(F.col("label") == "licit").alias("licit"), F.count("*").alias("total"), (bad / F.count("*")).alias("share")))


@query("""WITH r AS (SELECT min(epoch_ms(ts)) AS a, max(epoch_ms(ts)) AS z FROM events) SELECT least(15, floor((epoch_ms(ts) - a) / (z - a) * 16))::BIGINT AS bucket, count(*) AS n FROM events, r WHERE ts IS NOT NULL GROUP BY 1""")
def f16_time_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t")).where("t IS NOT NULL")
    span = e.agg(F.min("t").alias("a"), F.max("t").alias("z"))
    place = F.least(F.lit(15), F.floor((F.col("t") - F.col("a")) / (F.col("z") - F.col("a")) * 16)).cast("long")
    return e.join(F.broadcast(span)).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAYMENTS}, {NODES}, a AS (SELECT * FROM n WHERE t <= {T0 + 20}), z AS (SELECT * FROM n WHERE t >= {T0 + 10}), x AS (SELECT * FROM e WHERE ts <= {T0 + 30})
SELECT 'late_nodes' AS "check", count(*) AS n FROM a WHERE t > {T0} UNION ALL SELECT 'late_edges', count(*) FROM x WHERE ts > {T0}
UNION ALL SELECT 'ends_outside', count(*) FROM (SELECT src AS node_id FROM x UNION ALL SELECT dst FROM x) WHERE node_id NOT IN (SELECT node_id FROM a)
UNION ALL SELECT 'shared_nodes', count(*) FROM a WHERE node_id IN (SELECT node_id FROM z)""")
def d4_leakage_counts(spark, sf_dir):
    """The checks on a split that is loose on purpose."""
    n, e = sized(spark, sf_dir)
    seen = F.col("time_first_seen")
    return temporal.leakage_counts(n.where(seen <= T0 + 20), e.where(F.col("timestamp") <= T0 + 30), n.where(seen >= T0 + 10), T0)


@query("""SELECT 'acct:' || o_custkey AS node_id, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'illicit' ELSE 'licit' END AS label FROM orders
WHERE o_orderstatus IN ('P', 'F') AND year(o_orderdate) <= 1996 GROUP BY 1""")
def d9_labels_as_of(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "illicit").when(F.col("o_orderstatus") == "F", "licit").otherwise("unknown")
    history = table(spark, sf_dir, "orders").select(F.concat(F.lit("acct:"), F.col("o_custkey").cast("string")).alias("node_id"), F.year("o_orderdate").alias("step"), status.alias("label"))
    return temporal.labels_as_of(history, 1996)


@query(f"""WITH {COMPOSITE}, r AS (SELECT (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS p FROM y)
SELECT CASE WHEN p >= 0.66 THEN 'high' WHEN p >= 0.33 THEN 'med' ELSE 'low' END AS band, count(*) AS n FROM r GROUP BY 1""")
def f18_risk_bands(spark, sf_dir):
    return profiles.risk_bands(scoring.rank_percentiles(composite(spark, sf_dir)), "percentile")


@query(f"""WITH {PAYMENTS} SELECT src, dst, ts AS timestamp, """ + ", ".join(f"round({f}(ts * (2 * pi() / pow(10000.0, {k} / 3))), 6) AS {f}_{k}" for k in range(4) for f in ("sin", "cos")) + " FROM e")
def i4_time_encoding(spark, sf_dir):
    return rounded(profiles.time_encoding(payments(spark, sf_dir).select("src", "dst", "timestamp"), "timestamp"))


@query(f"WITH {PAYMENTS} SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst")
def j3_simple_projection(spark, sf_dir):
    return graph.simple_pairs(payments(spark, sf_dir))


@query(f"""WITH {FEATURES}, s AS (SELECT avg(velocity) AS m, stddev_samp(velocity) AS d, avg(holding_time_median) AS m2, stddev_samp(holding_time_median) AS d2 FROM f JOIN n USING (node_id) WHERE t <= {T0})
SELECT node_id, round(coalesce((velocity - m) / d, 0), 6) AS velocity, round(coalesce((holding_time_median - m2) / d2, 0), 6) AS holding_time_median FROM f, s""")
def j12_frozen_zscores(spark, sf_dir):
    """Statistics of the accounts first seen by T0, applied to all."""
    n, e = sized(spark, sf_dir)
    f = graph.payment_features(n, e).select("node_id", "velocity", "holding_time_median")
    return rounded(graph.frozen_zscores(f.join(n.where(F.col("time_first_seen") <= T0).select("node_id"), "node_id", "left_semi"), f, ["velocity", "holding_time_median"]))


@query(f"WITH {PAYMENTS} SELECT src, dst, 0::BIGINT AS direction, 0::BIGINT AS relation FROM e UNION ALL SELECT dst, src, 1, 1 FROM e")
def j19_both_directions(spark, sf_dir):
    return graph.both_directions(payments(spark, sf_dir))


@query("SELECT 'password' AS token, count(*) FILTER (contains(lower(text), 'password')) AS n FROM documents UNION ALL SELECT 'secret', count(*) FILTER (contains(lower(text), 'secret')) FROM documents")
def m22_marked_texts(spark, sf_dir):
    return profiles.marked_texts(table(spark, sf_dir, "documents"), ["password", "secret"])


@query(f"WITH {PAYMENTS} SELECT src, dst, arg_max(amount, (ts, amount)) AS amount, max(ts) AS timestamp, count(*) AS parallel FROM e GROUP BY 1, 2")
def n11_collapsed_payments(spark, sf_dir):
    return graph.collapsed(payments(spark, sf_dir))


@query("SELECT doc_id, upper(substr(sha256(text), 1, 10)) AS content_id FROM documents")
def o10_content_ids(spark, sf_dir):
    return profiles.content_ids(table(spark, sf_dir, "documents")).select("doc_id", "content_id")


#: Runs of letters, digits, lines and points stand between two marks, so that a number is a chain of whole runs.
NUMBERS = r"""list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '([\p{L}\p{N}_.]+)', chr(1) || '\1' || chr(2), 'g'), '\x01\p{Nd}{2,}(?:\x02,\x01\p{Nd}{3})*(?:\.\p{Nd}+)?\x02'), lambda v: translate(v, chr(1) || chr(2), ''))"""


@query(f"""WITH x AS (SELECT conv_id, turn, {NUMBERS} AS n FROM conversations), y AS (SELECT *, list_concat(n, list_transform(n, lambda v: replace(v, ',', ''))) AS seen FROM x)
SELECT a.conv_id, a.turn, array_to_string(list_sort(list_distinct(list_filter(a.n, lambda v: NOT list_contains(b.seen, v) AND NOT list_contains(b.seen, replace(v, ',', ''))))), ',') AS unsupported FROM y a JOIN y b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def o11_unsupported_numbers(spark, sf_dir):
    """Each turn against the turn before it."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return text.unsupported_numbers(c.join(before, ["conv_id", "turn"]), "text", "before").select("conv_id", "turn", F.array_join("unsupported", ",").alias("unsupported"))


@query(f"WITH {LABELS} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(CASE WHEN label <> 'unknown' THEN count(*) / sum(count(*) FILTER (label <> 'unknown')) OVER () END, 6) AS share_known FROM l GROUP BY 1")
def p2_class_distribution(spark, sf_dir):
    n = account_labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    known = F.col("label") != "unknown"
    total = n.agg(F.sum("n").alias("all"), F.sum(F.when(known, F.col("n"))).alias("known"))
    return rounded(n.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("all")).alias("share"), F.when(known, F.col("n") / F.col("known")).alias("share_known")))


@query(f"WITH {BIDS} SELECT market::BIGINT AS market, count(*) AS bids, count(DISTINCT tender) AS tenders, round(avg(won::INT), 6) AS won_share, min(year) AS first_year, max(year) AS last_year FROM b GROUP BY 1")
def p5_markets(spark, sf_dir):
    m = bids(spark, sf_dir).groupBy("market")
    return rounded(m.agg(F.count("*").alias("bids"), F.countDistinct("tender").alias("tenders"), F.avg(F.col("won").cast("int")).alias("won_share"), F.min("year").alias("first_year"), F.max("year").alias("last_year")))


@query("SELECT column_name, round(share, 6) AS share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(({c} IS NOT NULL)::INT) AS share FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def p6_known_shares(spark, sf_dir):
    return rounded(profiles.known_shares(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")))


@query(f"WITH {PAYMENTS}, {LABELS} SELECT count(*) AS n, round(avg((label = 'illicit')::INT), 6) AS share FROM e JOIN l ON src = node_id WHERE ts > {T0}")
def p7_tail(spark, sf_dir):
    late = payments(spark, sf_dir).where(F.col("timestamp") > T0).join(account_labels(spark, sf_dir).withColumnRenamed("node_id", "src"), "src")
    return rounded(late.agg(F.count("*").alias("n"), F.avg((F.col("label") == "illicit").cast("int")).alias("share")))
