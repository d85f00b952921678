"""Reading and writing the files of a ledger: CSV, nested JSON lines, Parquet stores, feature packs, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.schemas import SchemaError, conform

PACK = re.compile(r"[A-Za-z0-9_]+")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a row that does not meet the schema is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def read_csv_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; cells that cannot be read are null, and such rows are kept whole in _corrupt_record."""
    return spark.read.csv(path, schema=f"{schema}, _corrupt_record string", header=True, mode="PERMISSIVE")


def read_csv_by_place(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file whose header repeats a name: columns are told by their place and named by the schema."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="FAILFAST")


def read_json_lines(spark: SparkSession, folder: str, schema: str, partitions: int | None = None) -> DataFrame:
    """All *.jsonl and *.jsonl.gz of a folder; blank lines are skipped. A gz file is read by one task, so partitions deals its rows anew."""
    df = spark.read.json(folder, schema=schema, pathGlobFilter="*.{jsonl,jsonl.gz}")
    return df.repartition(partitions) if partitions else df


def write_table(df: DataFrame, root: str, dataset: str, table: str) -> None:
    """Write df as a core table of a dataset, once it conforms."""
    conform(df, table).write.mode("overwrite").parquet(f"{root}/{dataset}/{table}")


def read_table(spark: SparkSession, root: str, dataset: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A core table of a dataset; only the columns asked for are read."""
    df = spark.read.parquet(f"{root}/{dataset}/{table}")
    return df.select(*columns) if columns else df


def union_view(spark: SparkSession, paths: dict[str, str], name: str) -> DataFrame:
    """Parquet tables of several datasets under one view, each row with its dataset; columns that one lacks are null there."""
    out = None
    for dataset, path in paths.items():
        one = spark.read.parquet(path).withColumn("dataset", F.lit(dataset))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to unite")
    out.createOrReplaceTempView(name)
    return out


def open_catalog(spark: SparkSession, root: str, dataset: str, tables: list[str], packs: list[str] = ()) -> list[str]:
    """Views of a dataset's tables and feature packs (features_<pack>); their names."""
    names = []
    for name, path in [(t, t) for t in tables] + [(f"features_{p}", f"features/{p}") for p in packs]:
        spark.read.parquet(f"{root}/{dataset}/{path}").createOrReplaceTempView(name)
        names.append(name)
    return names


def table_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows (name, n) of views."""
    parts = [spark.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def described(spark: SparkSession, name: str) -> DataFrame:
    """Rows (column_name, type) of a view."""
    return spark.createDataFrame(spark.table(name).dtypes, "column_name string, type string")


def write_features(df: DataFrame, root: str, dataset: str, pack: str, as_of: int | None = None) -> None:
    """Write a feature pack: node_id and any columns; as_of is kept in every row."""
    if not PACK.fullmatch(pack):
        raise SchemaError(f"no name for a feature pack: {pack!r}")
    if "node_id" not in df.columns:
        raise SchemaError("a feature pack needs node_id")
    df.withColumn("as_of", F.lit(as_of).cast("long")).write.mode("overwrite").parquet(f"{root}/{dataset}/features/{pack}")


def read_features(spark: SparkSession, root: str, dataset: str, pack: str) -> tuple[DataFrame, int | None]:
    """A feature pack without as_of, and its as_of."""
    df = spark.read.parquet(f"{root}/{dataset}/features/{pack}")
    row = df.select("as_of").first()
    return df.drop("as_of"), row and row[0]


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a row, null fields kept."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def metadata(nodes: DataFrame, edges: DataFrame, labels: DataFrame, time_unit: str) -> DataFrame:
    """One row: counts of nodes and edges, labels by kind, and the unit of time."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"))
    kinds = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    return n.join(F.broadcast(e)).join(F.broadcast(kinds)).withColumn("time_unit", F.lit(time_unit))


def file_sums(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """Files of a folder: name (the last depth parts of the path), sha256, size."""
    df = spark.read.format("binaryFile").load(folder)
    return df.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame, depth: int = 1) -> DataFrame:
    """Per file of a folder or of manifest (name, sha256, size): missing, unexpected, mismatch or verified.

    Each file is read whole by one task, so files of over 2 GB are out of reach.
    """
    found = file_sums(spark, folder, depth).toDF("name", "found_sha256", "found_size")
    both = manifest.select("name", F.lower("sha256").alias("sha256"), "size").join(found, "name", "full")
    state = F.when(F.col("found_size").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("sha256") == F.col("found_sha256")) & (F.col("size") == F.col("found_size")), "verified").otherwise("mismatch")
    return both.select("name", state.alias("state"))


