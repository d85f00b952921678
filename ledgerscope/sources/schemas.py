"""The core tables of a ledger graph, and what a DataFrame must meet to be one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerscope.operators.alerts import CAVEAT

#: Columns of the core tables; NOT NULL ones are required.
CORE = {
    "nodes": "node_id string NOT NULL, node_type string NOT NULL, domain string NOT NULL, time_first_seen bigint, raw_features array<float>, raw_attrs string",
    "edges": "src string NOT NULL, dst string NOT NULL, edge_type string NOT NULL, timestamp bigint, amount double, directed boolean NOT NULL, raw_attrs string",
    "labels": "node_id string NOT NULL, label string NOT NULL, label_source string NOT NULL, confidence float NOT NULL",
    "communities": "community_id string NOT NULL, member_node_ids array<string> NOT NULL, method string NOT NULL",
    "alerts": "alert_id string NOT NULL, domain string NOT NULL, dataset string NOT NULL, model_run_id string NOT NULL, rank int NOT NULL, risk_score double NOT NULL, community_id string, "
    "member_node_ids array<string> NOT NULL, anchor_nodes array<string>, anchor_edges array<string>, time_window_start bigint, time_window_end bigint, motif_type string, n_members int NOT NULL, "
    "overlap_group int, explanation_ref string, created_at timestamp NOT NULL, caveats string NOT NULL",
    "label_history": "node_id string NOT NULL, step bigint NOT NULL, label string NOT NULL",
    "ground_truth": "instance_id string NOT NULL, motif_type string NOT NULL, member_node_ids array<string> NOT NULL, n_edges bigint NOT NULL",
}

#: What must hold in every row of a core table, besides types: a name and a condition.
RULES = {
    "labels": {"confidence is outside 0 to 1": "try_cast(confidence AS float) BETWEEN 0 AND 1"},
    "label_history": {"label is unknown": "label <> 'unknown'"},
    "alerts": {"rank is below 1": "try_cast(rank AS int) >= 1", "n_members is below 1": "try_cast(n_members AS int) >= 1", "caveats is not the fixed one": f"caveats = '{CAVEAT}'"},
}

#: The closed vocabularies.
VOCABULARY = {
    "domain": ["financial", "procurement"],
    "node_type": ["account", "address", "transaction", "firm", "tender", "bid", "lot", "buyer"],
    "edge_type": ["pays", "bids_on", "awarded", "buys_from", "linked_to", "co_bid"],
    "label": ["illicit", "licit", "unknown"],
    "motif_type": ["cycle", "fan_in", "fan_out", "common_control", "pass_through", "rotation", "cover_bid", "partition", "clique"],
}


class SchemaError(ValueError):
    """A table is not what a core table must be."""


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a core table.

    A lacking nullable column becomes null. An unknown or lacking required column, a
    value that cannot be cast, a null in a required column and a row that breaks one of
    RULES are errors; one pass over df counts them.
    """
    if table not in CORE:
        raise SchemaError(f"no core table {table!r}")
    want = StructType.fromDDL(CORE[table])
    if extra := sorted(set(df.columns) - set(want.names)):
        raise SchemaError(f"{table}: unknown columns {extra}")
    if lacking := [f.name for f in want if not f.nullable and f.name not in df.columns]:
        raise SchemaError(f"{table}: required columns {lacking} are missing")
    cast = {f.name: F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in want}
    faults = {f"{f.name} is no {f.dataType.simpleString()}": F.count_if(F.col(f.name).isNotNull() & cast[f.name].isNull()) for f in want if f.name in df.columns}
    faults |= {f"{f.name} is null": F.count_if(F.col(f.name).isNull()) for f in want if not f.nullable}
    faults |= {k: F.count_if(~F.expr(rule)) for k, rule in RULES.get(table, {}).items()}
    counts = df.agg(*(c.alias(k) for k, c in faults.items())).first().asDict()
    if bad := {k: n for k, n in counts.items() if n}:
        raise SchemaError(f"{table}: {bad}")
    return df.select(*(c.alias(k) for k, c in cast.items()))


def outside_vocabulary(df: DataFrame) -> DataFrame:
    """Rows (column, value, n) of values of df's closed-vocabulary columns that the vocabulary lacks."""
    found = [df.where(~F.col(c).isin(v)).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "value", "n") for c, v in VOCABULARY.items() if c in df.columns]
    if not found:
        raise SchemaError("no column with a closed vocabulary")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def without_caveat(alerts: DataFrame) -> DataFrame:
    """Alerts whose caveat is not the fixed one."""
    return alerts.where(~F.col("caveats").eqNullSafe(F.lit(CAVEAT)))
