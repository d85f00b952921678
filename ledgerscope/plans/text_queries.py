"""Text jobs, profiles, sources and adapters on the standard tables, with SQL where it can state the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.staging import shared_folder, staged
from ledgerscope.operators import adapters, profiles, text
from ledgerscope.operators.alerts import CAVEAT
from ledgerscope.plans.bindings import BIDS, LABELS, NODES, PAYMENTS, account_labels, bids, payments, table
from ledgerscope.plans.queries import query, rounded, sized
from ledgerscope.sources import files, schemas


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9) AS score FROM embeddings, q)
SELECT query_id, vec_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""")
def o2_dense_top(spark, sf_dir):
    """Queries are the vectors whose id divides by 100, against all."""
    v = table(spark, sf_dir, "embeddings")
    return rounded(text.dense_top(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))), 5)


@query("""WITH l AS (SELECT c_nationkey AS item_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer
UNION ALL SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) FROM customer) SELECT item_id::BIGINT AS item_id, doc_id, round(sum(1 / (60.0 + place - 1)), 9) AS score FROM l GROUP BY 1, 2""")
def o3_hybrid_fusion(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("item_id"), F.col("c_custkey").alias("doc_id"), "c_acctbal")
    from pyspark.sql import Window

    w = Window.partitionBy("item_id")
    lists = {"balance": c.withColumn("place", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "doc_id"))), "key": c.withColumn("place", F.row_number().over(w.orderBy("doc_id")))}
    return rounded(text.hybrid_fusion(lists), 9)


@query(r"SELECT doc_id, 1::BIGINT AS place, 1::BIGINT AS section_num, 'Full document' AS title, length(regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS n FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]*[0-9]{1,2}\.[ \t]+[A-Z][^\n]*$')")
def o4_sections(spark, sf_dir):
    """Sections of all documents; the given ones have no numbered headings, so each is whole."""
    return text.sections(table(spark, sf_dir, "documents")).select("doc_id", "place", "section_num", "title", F.length("body").cast("long").alias("n"))


@query()
def o5_merged_facts(spark, sf_dir):
    """Embeddings as facts: near-duplicates at a cosine of 0.92 are one."""
    v = table(spark, sf_dir, "embeddings")
    facts = v.select(F.col("vec_id").alias("fact_id"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("vec_id") % 7).cast("string")).alias("source"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("categories"), ((F.col("vec_id") % 10) / 10).alias("confidence"))
    same = staged(text.equal_vectors(v), "equal")
    firsts = v.join(same.where("fact_id = first").select(F.col("fact_id").alias("vec_id")), "vec_id", "left_semi")
    return rounded(text.merged_facts(facts, text.close_pairs(firsts), same).withColumn("categories", F.array_join("categories", ",")))


KEYWORDS = {"credentials": ["password", "secret", "token"], "licence": ["license", "copyright"], "numbers": ["1", "2"]}
EXPANSIONS = {"credentials": ["access"], "licence": ["legal"]}


@query("""WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_concat(
CASE WHEN contains(t, 'password') OR contains(t, 'secret') OR contains(t, 'token') THEN ['credentials', 'access'] ELSE [] END, CASE WHEN contains(t, 'license') OR contains(t, 'copyright') THEN ['licence', 'legal'] ELSE [] END,
CASE WHEN contains(t, '1') OR contains(t, '2') THEN ['numbers'] ELSE [] END)), ',') AS categories FROM h""")
def o7_category_tags(spark, sf_dir):
    return text.category_tags(table(spark, sf_dir, "documents"), KEYWORDS, EXPANSIONS).withColumn("categories", F.array_join("categories", ","))


@query("""WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, unnest(list_concat(
CASE WHEN contains(t, 'password') OR contains(t, 'secret') OR contains(t, 'token') THEN ['credentials', 'access'] ELSE [] END, CASE WHEN contains(t, 'license') OR contains(t, 'copyright') THEN ['licence', 'legal'] ELSE [] END,
CASE WHEN contains(t, '1') OR contains(t, '2') THEN ['numbers'] ELSE [] END)) AS c FROM h),
f AS (SELECT vec_id AS fact_id, CASE vec_id % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'auto_schema' ELSE 'other' END AS origin, unnest(CASE WHEN vec_id % 2 = 0 THEN ['access', 'numbers'] ELSE ['legal'] END) AS c FROM embeddings),
g AS (SELECT doc_id, fact_id, origin, count(*) AS overlap FROM c JOIN f USING (c) GROUP BY 1, 2, 3)
SELECT doc_id, fact_id, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, CASE origin WHEN 'curated' THEN 0 WHEN 'auto_schema' THEN 1 ELSE 9 END, fact_id) AS place FROM g) WHERE place <= 3""")
def o8_ranked_facts(spark, sf_dir):
    tagged = text.category_tags(table(spark, sf_dir, "documents"), KEYWORDS, EXPANSIONS)
    k = F.col("vec_id") % 3
    facts = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fact_id"), F.when(k == 0, "curated").when(k == 1, "auto_schema").otherwise("other").alias("origin"),
        F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("access"), F.lit("numbers"))).otherwise(F.array(F.lit("legal"))).alias("categories"),
    )
    return rounded(text.ranked_facts(tagged, facts, 3))


@query("""SELECT 'Table `orders` has ' || count(*) || ' rows.' AS text FROM orders UNION ALL
SELECT 'Column `orders.' || c || '` has actual values: ' || string_agg('''' || v || '''', ', ' ORDER BY v) || '.' FROM (SELECT DISTINCT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY c HAVING count(*) BETWEEN 2 AND 10""")
def o9_table_facts(spark, sf_dir):
    return text.table_facts(table(spark, sf_dir, "orders"), "orders")


@query()
def o12_degenerate(spark, sf_dir):
    return text.degenerate(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("degenerate").agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), b AS (SELECT *, regexp_replace(t, '(?i)\b(the)\b', 'that', 'g') AS u FROM a), c AS (SELECT *, regexp_replace(u, '(?i)\bproves? (that )?\b', 'is consistent with ', 'g') AS v FROM b)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i)\b(the)\b') THEN '0' ELSE '' END || CASE WHEN regexp_matches(u, '(?i)\bproves? (that )?\b') THEN '1' ELSE '' END AS rules, md5(rtrim(v, ' ') || chr(10) || chr(10) || '---' || chr(10) || '*CAVEAT*') AS said FROM c""".replace("CAVEAT", CAVEAT))
def o13_guarded(spark, sf_dir):
    rules = [(r"\b(the)\b", "that"), (r"\bproves? (that )?\b", "is consistent with ")]
    df = text.guarded(table(spark, sf_dir, "conversations"), rules)
    return df.select("conv_id", "turn", F.array_join(F.transform("rules", lambda x: x.cast("string")), "").alias("rules"), F.md5("text").alias("said"))


LEXICON = ["data", "model", "time"]


@query("""WITH a AS (SELECT conv_id, turn, list_filter(['data', 'model', 'time'], lambda x: contains(lower(coalesce(text, '')), x)) AS terms FROM conversations)
SELECT conv_id, turn, array_to_string(terms, ',') AS terms, len(terms) = 0 OR turn % 2 = 0 AS grounded FROM a""")
def o14_grounded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("trace", F.when(F.col("turn") % 2 == 0, F.array(F.lit("corpus_search(x)"))).otherwise(F.array(F.lit("other()"))))
    return text.grounded(c, LEXICON, "text").select("conv_id", "turn", F.array_join("terms", ",").alias("terms"), "grounded")


@query("SELECT count(*) AS n, round(avg((length(coalesce(text, '')) > 20)::INT), 6) AS pass_rate, count(*) FILTER (contains(coalesce(text, ''), 'guilty'))::BIGINT AS violations, round(avg((turn % 9 = 0)::INT), 6) AS rewrite_rate, avg((length(coalesce(text, '')) > 20)::INT) >= 0.5 AND count(*) FILTER (contains(coalesce(text, ''), 'guilty')) = 0 AND avg((turn % 9 = 0)::INT) <= 0.9 AS gate_passed FROM conversations")
def o15_gate_rates(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    r = table(spark, sf_dir, "conversations").select((F.length(t) > 20).alias("passed"), t.contains("guilty").cast("int").alias("violations"), (F.col("turn") % 9 == 0).alias("rewritten"))
    return rounded(text.gate_rates(r, 0.5, 0.9))


@query(f"WITH {BIDS} SELECT split_part(tender, ':', 2) AS country, count(*) AS n, round(avg(won::INT), 6) AS share, min(year) AS first_year, max(year) AS last_year FROM b GROUP BY 1")
def p3_countries(spark, sf_dir):
    b = bids(spark, sf_dir).withColumn("country", F.get(F.split("tender", ":"), F.lit(1)))
    return rounded(profiles.group_profile(b, "country", F.col("won"), "year"))


@query("SELECT c_nationkey::BIGINT AS country, " + ", ".join(f"round(avg((o_orderstatus = 'F')::INT) FILTER (year(o_orderdate) = {y}), 6) AS y{y}" for y in range(1995, 1999)) + " FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IS NOT NULL GROUP BY 1")
def p4_year_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("country"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("ok"))
    return rounded(profiles.year_coverage(o, "country", "year", F.col("ok"), [1995, 1996, 1997, 1998]))


@query(r"""WITH t AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS value FROM documents) SELECT regexp_extract(value, '(?i)(licen[cs]e|warrant[yi]|http)', 1) AS pattern, count(*) AS n FROM t WHERE regexp_matches(value, '(?i)(licen[cs]e|warrant[yi]|http)') GROUP BY 1""")
def p8_pattern_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value"))
    return profiles.pattern_counts(lines, r"(?i)(licen[cs]e|warrant[yi]|http)")


@query("WITH a AS (SELECT count(*)::DOUBLE AS nations FROM nation), b AS (SELECT count(*)::DOUBLE AS regions FROM region) SELECT 'nations' AS \"check\", 25::DOUBLE AS expected, nations AS actual, nations = 25 AS ok FROM a UNION ALL SELECT 'regions', 7, regions, regions = 7 FROM b")
def p9_expected_checks(spark, sf_dir):
    one = table(spark, sf_dir, "nation").agg(F.count("*").alias("nations")).join(F.broadcast(table(spark, sf_dir, "region").agg(F.count("*").alias("regions"))))
    return profiles.expected_checks(one, {"nations": 25, "regions": 7})


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def a1_csv(spark, sf_dir):
    """Orders written as CSV and read with a schema."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.csv(path, header=True)
    return files.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price, o_orderkey % 10 = 0 AS bad FROM orders")
def a2_csv_lenient(spark, sf_dir):
    path = scratch(spark, "csv")
    price = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")).write.csv(path, header=True)
    df = files.read_csv_lenient(spark, path, "o_orderkey bigint, price double")
    return df.select("o_orderkey", "price", F.col("_corrupt_record").isNotNull().alias("bad"))


@query("SELECT o_custkey AS account_from, o_orderkey AS account_to FROM orders")
def a3_csv_repeated_header(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("value"))
    parts = rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(8)).alias("p")).agg(F.concat(F.lit("Account,Account\n"), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    parts.select("value").repartition(8, "value").write.option("lineSep", "\n").text(path)
    df = files.read_csv_by_place(spark, path, "account_from string, account_to string").where("account_from <> 'Account'")
    return df.select(F.col("account_from").cast("long").alias("account_from"), F.col("account_to").cast("long").alias("account_to"))


@query("SELECT o_orderkey::VARCHAR AS ocid, o_totalprice AS amount FROM orders")
def a4_json_lines(spark, sf_dir):
    """Orders as nested gzipped JSON lines with blank ones between, read again."""
    path = scratch(spark, "json")
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("ocid"), F.struct(F.col("o_totalprice").alias("amount")).alias("value")))
    table(spark, sf_dir, "orders").select(F.concat(record, F.lit("\n")).alias("value")).write.option("compression", "gzip").text(path)
    df = spark.read.json(path, schema="ocid string, value struct<amount:double>")
    return df.where("ocid IS NOT NULL").select("ocid", F.col("value.amount").alias("amount"))


def stored(spark, sf_dir) -> str:
    """A store with two data sets of the ledger's tables; nodes and both parts of the edges come from payments that are joined once."""
    root = scratch(spark, "store")
    n, e = sized(spark, sf_dir)
    e = e.withColumns({"directed": F.lit(True), "raw_attrs": F.lit(None).cast("string")})
    n = n.select("node_id", F.lit("account").alias("node_type"), F.lit("financial").alias("domain"), "time_first_seen")
    l = account_labels(spark, sf_dir).select("node_id", "label", F.lit("balance").alias("label_source"), F.lit(1.0).alias("confidence"))
    for dataset, part in (("even", 0), ("odd", 1)):
        files.write_table(e.where(F.col("timestamp") % 2 == part), root, dataset, "edges")
    files.write_table(n, root, "even", "nodes")
    files.write_table(l, root, "even", "labels")
    return root


@query(f"WITH {PAYMENTS} SELECT CASE WHEN ts % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, count(*) AS n, round(sum(amount), 2) AS total FROM e GROUP BY 1")
def a6_union_view(spark, sf_dir):
    root = stored(spark, sf_dir)
    files.union_view(spark, {d: f"{root}/{d}/edges" for d in ("even", "odd")}, "all_edges")
    return spark.sql("SELECT dataset, count(*) AS n, round(sum(amount), 2) AS total FROM all_edges GROUP BY dataset")


@query(f"WITH {PAYMENTS}, {NODES}, {LABELS} SELECT 'edges' AS name, count(*) AS n FROM e WHERE ts % 2 = 0 UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'labels', count(*) FROM l UNION ALL SELECT 'features_degree', count(*) FROM n")
def a7_catalog(spark, sf_dir):
    """The features are of the nodes that the store holds."""
    root = stored(spark, sf_dir)
    files.write_features(files.read_table(spark, root, "even", "nodes", ["node_id"]).withColumn("x", F.lit(1)), root, "even", "degree", 9800)
    return files.table_counts(spark, files.open_catalog(spark, root, "even", ["edges", "nodes", "labels"], ["degree"]))


@query("SELECT unnest(['src', 'dst', 'edge_type', 'timestamp', 'amount', 'directed', 'raw_attrs']) AS column_name, unnest(['string', 'string', 'string', 'bigint', 'double', 'boolean', 'string']) AS type")
def a8_described(spark, sf_dir):
    root = stored(spark, sf_dir)
    files.open_catalog(spark, root, "even", ["edges"])
    return files.described(spark, "edges")


@query(f"WITH {PAYMENTS} SELECT src, dst, ts AS timestamp, amount FROM e WHERE ts % 2 = 0")
def a9_conformed_store(spark, sf_dir):
    return files.read_table(spark, stored(spark, sf_dir), "even", "edges", ["src", "dst", "timestamp", "amount"])


@query(f"WITH {PAYMENTS}, {NODES} SELECT node_id, t AS first, 9800::BIGINT AS as_of FROM n")
def a10_feature_pack(spark, sf_dir):
    root = scratch(spark, "store")
    files.write_features(sized(spark, sf_dir)[0].select("node_id", F.col("time_first_seen").alias("first")), root, "even", "first_seen", 9800)
    df, as_of = files.read_features(spark, root, "even", "first_seen")
    return df.withColumn("as_of", F.lit(as_of))


@query("SELECT c_custkey, c_name, NULL AS note FROM customer")
def a11_json_records(spark, sf_dir):
    path = scratch(spark, "records")
    files.write_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("note")), path)
    return spark.read.json(path, schema="c_custkey bigint, c_name string, note string")


@query(f"WITH {PAYMENTS}, {NODES}, {LABELS} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT string_agg(label || '=' || c, ',' ORDER BY label) FROM (SELECT label, count(*) AS c FROM l GROUP BY 1)) AS label_counts, 'day' AS time_unit")
def a12_metadata(spark, sf_dir):
    n, e = sized(spark, sf_dir)
    df = files.metadata(n, e, account_labels(spark, sf_dir), "day")
    said = F.transform(F.array_sort(F.map_entries("label_counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return df.withColumn("label_counts", F.array_join(said, ","))


@query("SELECT 'mismatch' AS state, 1::BIGINT AS n UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unexpected', 1 UNION ALL SELECT 'verified', 2")
def a13_manifest(spark, sf_dir):
    """Four files of customers against a manifest that lacks one, names one too many and has one wrong sum."""
    path = scratch(spark, "files")
    table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("value"), (F.col("c_custkey") % 4).alias("p")).repartition(4, "p").write.partitionBy("p").text(path)
    found = staged(files.file_sums(spark, f"{path}/p=*", 2), "manifest")
    wrong = found.where("name NOT LIKE 'p=0/%'").withColumn("sha256", F.when(F.col("name").startswith("p=1/"), "00").otherwise(F.col("sha256")))
    extra = found.where("name LIKE 'p=0/%'").withColumn("name", F.lit("lost.txt"))
    return files.verify_manifest(spark, f"{path}/p=*", wrong.union(extra), 2).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {PAYMENTS} SELECT src, dst, ts AS timestamp, round(amount, 2) AS amount, NULL AS raw_attrs FROM e")
def b1_conform(spark, sf_dir):
    df = schemas.conform(payments(spark, sf_dir).withColumn("directed", F.lit(True)).withColumn("amount", F.col("amount").cast("string")), "edges")
    return df.select("src", "dst", "timestamp", F.round("amount", 2).alias("amount"), "raw_attrs")


@query("SELECT 'label' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2")
def b2_outside_vocabulary(spark, sf_dir):
    """Order states are no labels."""
    return schemas.outside_vocabulary(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0")
def b3_without_caveat(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, CAVEAT).when(F.col("c_custkey") % 2 == 0, "other").alias("caveats"))
    return schemas.without_caveat(a).select("c_custkey")


def told(parts) -> DataFrame:
    return adapters.statistics(*(staged(df, "adapted") for df in parts[:3]))


def stats_sql(ctes: str, kinds: dict[str, str]) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, v::VARCHAR AS value, count(*) AS n FROM ({q}) GROUP BY 2" for k, q in kinds.items())


@query(stats_sql("o AS (SELECT * FROM orders)", {
    "nodes": "SELECT 'transaction' AS v FROM o", "edges": "SELECT 'pays' AS v FROM lineitem", "labels": "SELECT CASE o_orderstatus WHEN 'F' THEN 'illicit' WHEN 'O' THEN 'licit' ELSE 'unknown' END AS v FROM o",
    "times": "SELECT year(o_orderdate) AS v FROM lineitem LEFT JOIN o ON l_partkey = o_orderkey"}))
def c1_transactions(spark, sf_dir):
    """Orders as transactions, lines as links from the order with the part's number."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("tx_id"), F.year("o_orderdate").alias("step"), "o_totalprice")
    c = o.select(F.col("o_orderkey").alias("tx_id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("class"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_orderkey").alias("dst_id"))
    return told(adapters.transactions(f, c, links))


@query(stats_sql("o AS (SELECT * FROM orders), w AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS bad, bool_or(o_orderstatus = 'F') AS good FROM o GROUP BY 1)", {
    "nodes": "SELECT 'address' AS v FROM w", "edges": "SELECT 'pays' AS v FROM lineitem", "labels": "SELECT CASE WHEN bad THEN 'illicit' WHEN good THEN 'licit' ELSE 'unknown' END AS v FROM w", "times": "SELECT NULL AS v FROM lineitem"}))
def c2_wallets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seen = o.select(F.col("o_custkey").alias("address"), F.year("o_orderdate").alias("step"), F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("class"), "o_totalprice")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"))
    return told(adapters.wallets(seen, links))


@query("""WITH r AS (SELECT 'acct:' || l_suppkey % 3 || ':' || l_suppkey AS s, 'acct:' || l_partkey % 3 || ':' || l_partkey AS d, floor(epoch(l_shipdate) / 60)::BIGINT AS t, l_extendedprice AS a, l_discount > 0.09 AS bad FROM lineitem),
n AS (SELECT x, min(t) AS t, bool_or(bad) AS bad FROM (SELECT s AS x, t, bad FROM r UNION ALL SELECT d, t, bad FROM r) GROUP BY 1) SELECT x AS node_id, t AS time_first_seen, CASE WHEN bad THEN 'illicit' ELSE 'licit' END AS label FROM n""")
def c3_accounts(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(
        F.date_format("l_shipdate", "yyyy/MM/dd HH:mm").alias("time_text"), (F.col("l_suppkey") % 3).alias("from_bank"), F.col("l_suppkey").alias("from_account"), (F.col("l_partkey") % 3).alias("to_bank"), F.col("l_partkey").alias("to_account"),
        F.col("l_extendedprice").alias("amount_received"), F.lit("EUR").alias("receiving_currency"), F.col("l_extendedprice").alias("amount_paid"), F.lit("EUR").alias("payment_currency"), F.lit("wire").alias("format"), (F.col("l_discount") > 0.09).cast("int").alias("is_laundering"),
    )
    n, _, l = adapters.accounts(rows)
    return n.join(l, "node_id").select("node_id", "time_first_seen", "label")


AWARD_ROWS = "r AS (SELECT c_nationkey AS c, o_orderkey AS t, l_linenumber AS lot, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS u, l_suppkey AS s, (l_discount > 0.09)::INT AS bad, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)"


@query(stats_sql(AWARD_ROWS, {
    "nodes": "SELECT 'firm' AS v FROM (SELECT DISTINCT c, s FROM r) UNION ALL SELECT 'tender' FROM (SELECT DISTINCT c, t FROM r) UNION ALL SELECT 'buyer' FROM (SELECT DISTINCT c, u FROM r WHERE u IS NOT NULL)",
    "edges": "SELECT 'awarded' AS v FROM r UNION ALL SELECT 'buys_from' FROM (SELECT DISTINCT c, u, t FROM r WHERE u IS NOT NULL)",
    "labels": "SELECT CASE WHEN max(bad) = 1 THEN 'illicit' ELSE 'licit' END AS v FROM r GROUP BY c, s UNION ALL SELECT CASE WHEN max(bad) = 1 THEN 'illicit' ELSE 'licit' END FROM r GROUP BY c, t",
    "times": "SELECT y AS v FROM r UNION ALL SELECT min(y) FROM r WHERE u IS NOT NULL GROUP BY c, u, t"}))
def c4_awards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = o.select(
        F.col("c_nationkey").alias("country"), F.col("o_orderkey").alias("tender_id"), F.col("l_linenumber").alias("lot_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("buyer_id"), F.col("l_suppkey").alias("bidder_id"),
        (F.col("l_discount") > 0.09).cast("int").alias("is_cartel"), F.lit(None).cast("string").alias("cartel_id"), F.year("o_orderdate").alias("tender_year"), F.lit(1).alias("lot_bidscount"), F.col("l_discount").alias("relative_value"),
    )
    return told(adapters.awards(rows))


@query(stats_sql("r AS (SELECT l_orderkey AS t, l_suppkey AS s, year(l_shipdate) AS y, l_linenumber = 1 AS won, l_discount > 0.09 AS bad FROM lineitem)", {
    "nodes": "SELECT 'bid' AS v FROM r UNION ALL SELECT 'tender' FROM (SELECT DISTINCT t FROM r) UNION ALL SELECT 'firm' FROM (SELECT DISTINCT s FROM r)", "edges": "SELECT 'bids_on' AS v FROM r UNION ALL SELECT 'bids_on' FROM r UNION ALL SELECT 'awarded' FROM r WHERE won",
    "labels": "SELECT CASE WHEN bad THEN 'illicit' ELSE 'licit' END AS v FROM r UNION ALL SELECT CASE WHEN bool_or(bad) THEN 'illicit' ELSE 'licit' END FROM r GROUP BY s", "times": "SELECT y AS v FROM r UNION ALL SELECT y FROM r UNION ALL SELECT y FROM r WHERE won"}))
def c5_market_bids(spark, sf_dir):
    """Lines as bids of one market, dated in seconds."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("Tender"), F.unix_timestamp("l_shipdate").alias("Date"), F.col("l_suppkey").alias("Competitors"), (F.col("l_linenumber") == 1).cast("int").alias("Winner"), (F.col("l_discount") > 0.09).cast("int").alias("Collusive_competitor"),
        F.col("l_extendedprice").alias("Bid_value"), F.lit(3).alias("Number_bids"), F.col("l_partkey").alias("CV"),
    )
    return told(adapters.market_bids(rows, "m", True))


def releases(spark, sf_dir) -> DataFrame:
    """Orders as nested contract releases: lines are bids, of which every seventh has no tenderer, first lines awards; every ninth order is undated."""
    i = table(spark, sf_dir, "lineitem")
    who = F.when(F.col("l_partkey") % 7 != 0, F.col("l_suppkey").cast("string"))
    bid = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.struct(F.col("l_extendedprice").alias("amount"), F.lit("EUR").alias("currency")).alias("value"), F.array(F.struct(who.alias("id"), F.lit("n").alias("name"))).alias("tenderers"))
    won = F.when(F.col("l_linenumber") == 1, F.struct(F.lit("a").alias("id"), F.struct(F.col("l_extendedprice").alias("amount")).alias("value"), F.array(F.struct(F.col("l_suppkey").cast("string").alias("id"))).alias("suppliers"), F.lit(None).cast("string").alias("relatedBid")))
    lines = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(bid).alias("details"), F.collect_list(won).alias("awards"))
    when = F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("ocid"), when.alias("date"), F.struct(F.col("o_custkey").cast("string").alias("id"), F.lit("b").alias("name")).alias("buyer"),
        F.struct(F.struct(F.col("o_totalprice").alias("amount")).alias("value"), F.struct(F.lit(None).cast("string").alias("endDate")).alias("tenderPeriod")).alias("tender"), F.struct("details").alias("bids"), "awards",
    )


RELEASES = "o AS (SELECT *, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 9 <> 0), r AS (SELECT o.*, l.* FROM o JOIN lineitem l ON l_orderkey = o_orderkey)"


@query(stats_sql(RELEASES, {
    "nodes": "SELECT 'tender' AS v FROM o UNION ALL SELECT 'buyer' FROM (SELECT DISTINCT o_custkey FROM o) UNION ALL SELECT 'firm' FROM (SELECT l_suppkey FROM r WHERE l_partkey % 7 <> 0 UNION SELECT l_suppkey FROM r WHERE l_linenumber = 1)",
    "edges": "SELECT 'buys_from' AS v FROM o UNION ALL SELECT 'bids_on' FROM r WHERE l_partkey % 7 <> 0 UNION ALL SELECT 'awarded' FROM r WHERE l_linenumber = 1",
    "labels": "SELECT 'unknown' AS v FROM o UNION ALL SELECT 'unknown' FROM (SELECT l_suppkey FROM r WHERE l_partkey % 7 <> 0 UNION SELECT l_suppkey FROM r WHERE l_linenumber = 1)",
    "times": "SELECT y AS v FROM o UNION ALL SELECT y FROM r WHERE l_partkey % 7 <> 0 UNION ALL SELECT y FROM r WHERE l_linenumber = 1"}))
def c6_contract_releases(spark, sf_dir):
    return told(adapters.contract_releases(staged(releases(spark, sf_dir), "releases"), "p"))


@query(f"WITH {RELEASES} SELECT (SELECT count(*) FROM orders) AS n_releases, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) AS no_date, (SELECT count(*) FROM r WHERE l_partkey % 7 <> 0) AS bids_kept, (SELECT count(*) FROM r WHERE l_partkey % 7 = 0) AS bids_skipped")
def c7_release_counts(spark, sf_dir):
    return adapters.release_counts(releases(spark, sf_dir))
