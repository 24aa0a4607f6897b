"""Data-quality gates: grain, conservation, de-duplication, integrity, rejects; and reports beside them.

Every measurement is a DataFrame; ``Gate`` turns small collected ones into a verdict. An empty list of failures
passes, and ``rows_checked`` shows that there were data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalars import safe_ratio
from sedimenta.operators.cases import current_cases
from sedimenta.sources.tables import GRAINS, PARENTS, PARTIAL_DATES


@dataclass
class Gate:
    name: str
    description: str
    passed: bool
    rows_checked: int = 0
    failures: list[dict] = field(default_factory=list)
    detail: list[dict] = field(default_factory=list)


# ---------------------------------------------------------------- measurements


def grain_profile(df: DataFrame, key: Sequence[str], name: str, unique: bool = False) -> DataFrame:
    """One row on how a table's key repeats; null keys group together, whole rows compare with nulls equal.

    Rows are first counted per (key, 96-bit row hash), map-side, then per key; no row content is shuffled.
    """
    # hashes pass over nulls, so which columns are null is hashed too
    masks = [sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0).cast("bigint") for i, c in enumerate(df.columns[k : k + 60])), F.lit(0).cast("bigint")) for k in range(0, len(df.columns), 60)]
    hashed = df.select(*key, F.struct(F.xxhash64(*df.columns, *masks), F.hash(*df.columns, *masks)).alias("_row"))
    per_row = hashed.groupBy(*key, "_row").agg(F.count("*").alias("_n"))
    per_key = per_row.groupBy(*key).agg(F.sum("_n").alias("n"), F.count("*").alias("d"))
    whole = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"),
        F.count_if(F.col("d") > 1).alias("conflicting_keys"),
        F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("identical_rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("worst_group"),
    )
    fan_out = F.round(safe_ratio(F.col("rows").cast("double"), F.col("distinct_keys").cast("double"), 1.0), 6)
    return whole.select(F.lit(name).alias("table"), F.lit(" + ".join(key)).alias("key"), F.lit(unique).alias("unique"), "rows", "distinct_keys", "repeated_keys", "excess_rows", "conflicting_keys", "identical_rows", "worst_group", fan_out.alias("fan_out"))


def grain_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of all tables with a declared grain; tables that are absent are skipped."""
    return reduce(DataFrame.unionByName, [grain_profile(df, GRAINS[t].key, t, GRAINS[t].unique) for t, df in tables.items() if t in GRAINS])


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest successful run per (source, partition, table)."""
    rest = [c for c in runs.columns if c not in ("source", "partition", "table_name", "id")]
    ok = runs.where(F.col("status") == "success")
    newest = ok.groupBy("source", "partition", "table_name").agg(F.max(F.struct("id", *rest)).alias("r"))
    return newest.select("source", "partition", "table_name", "r.*")


def unbalanced_runs(runs: DataFrame) -> DataFrame:
    """Successful runs whose rows do not add up."""
    wrong = F.col("rows_read") != F.col("rows_loaded") + F.col("rows_rejected")
    return runs.where((F.col("status") == "success") & wrong).select("id", "source", "partition", "table_name", "rows_read", "rows_loaded", "rows_rejected")


def claimed_rows(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, claimed_by_load_runs, rows_in_table) for the tables present."""
    claimed = latest_runs(runs).groupBy(F.col("table_name").alias("table")).agg(F.sum("rows_loaded").alias("claimed_by_load_runs"))
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows_in_table")).select(F.lit(t).alias("t"), "rows_in_table") for t, df in tables.items()])
    return claimed.join(counts, F.col("table") == F.col("t")).select("table", "claimed_by_load_runs", "rows_in_table")


def dedup_numbers(demo: DataFrame, current: DataFrame) -> DataFrame:
    """One row: demo_rows, with_caseid, kept, superseded, deleted_cases; one pass over either side."""
    rows = demo.agg(F.count("*").alias("demo_rows"), F.count("caseid").alias("with_caseid"))
    cases = current.agg(F.count("*").alias("kept"), F.coalesce(F.sum("superseded"), F.lit(0)).alias("superseded"), F.count_if("is_deleted").alias("deleted_cases"))
    return rows.join(cases)


def orphan_profile(child: DataFrame, parent: DataFrame, rejects: DataFrame, keys: Sequence[str], child_name: str, parent_name: str) -> DataFrame:
    """Orphans of one child table per partition, and how many the parent's rejects explain.

    Rows are counted per key before anything is joined; a null key is an orphan row but no orphan key.
    """
    partition, key = keys
    counted = child.groupBy(*keys).agg(F.count("*").alias("_n"))
    there = parent.select(F.col(partition).alias("_q"), F.col(key).alias("_k")).distinct()
    lost = counted.join(there, (F.col(partition) == F.col("_q")) & (F.col(key) == F.col("_k")), "left_anti")
    hints = rejects.where((F.col("table_name") == parent_name) & F.col("key_hint").isNotNull()).select(F.col("partition").alias("_rq"), F.col("key_hint").alias("_rk")).distinct()
    lost = lost.join(hints, (F.col(partition).cast("string") == F.col("_rq")) & (F.col(key).cast("string") == F.col("_rk")), "left")
    known = F.col("_rk").isNotNull()
    profile = lost.groupBy(F.col(partition).cast("string").alias("partition")).agg(
        F.sum("_n").alias("orphan_rows"), F.count(key).alias("orphan_keys"), F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("explained_rows"), F.count_if(known).alias("explained_keys")
    )
    return profile.select(F.lit(child_name).alias("child"), F.lit(parent_name).alias("parent"), "partition", "orphan_rows", "orphan_keys", "explained_rows", "explained_keys", (F.col("orphan_rows") - F.col("explained_rows")).alias("unexplained_rows"))


def reject_summary(runs: DataFrame) -> DataFrame:
    """(source, table_name, rows_read, rejected, capped_runs, reject_rate) of tables with rejects, over latest runs."""
    totals = latest_runs(runs).groupBy("source", "table_name").agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_rejected").alias("rejected"), F.count("notes").alias("capped_runs"))
    rate = F.round(safe_ratio(F.col("rejected").cast("double"), F.col("rows_read").cast("double")), 6)
    return totals.where(F.col("rejected") > 0).withColumn("reject_rate", rate)


def top_reasons(runs: DataFrame, rejects: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent reject reasons per table over latest runs; ties by reason."""
    from pyspark.sql import Window

    latest = latest_runs(runs).select(F.col("id").alias("load_id"))
    counted = rejects.join(latest, "load_id", "left_semi").groupBy("source", "table_name", "reason").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source", "table_name").orderBy(F.desc("n"), "reason")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reject_totals(runs: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: stored rejects, counted rejects and capped runs, over latest runs."""
    latest = latest_runs(runs)
    stored = rejects.join(latest.select(F.col("id").alias("load_id")), "load_id", "left_semi").agg(F.count("*").alias("stored"))
    counted = latest.agg(F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("counted"), F.count("notes").alias("capped_runs"))
    return stored.join(counted)


def date_precision(df: DataFrame, table: str, column: str) -> DataFrame:
    """One row on how precise a partial date column is."""
    prec = F.col(f"{column}_prec")
    n = lambda value: F.count_if(prec == value).alias(value)
    row = df.agg(F.count("*").alias("rows"), n("day"), n("month"), n("year"), n("invalid"), F.count_if(prec.isNull()).alias("absent"))
    present, partial = F.col("rows") - F.col("absent"), F.col("month") + F.col("year") + F.col("invalid")
    share = F.round(safe_ratio(partial.cast("double"), present.cast("double")), 6)
    return row.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "*", present.alias("present"), partial.alias("partial_or_invalid"), share.alias("partial_share"))


def inventory(tables: dict[str, DataFrame], partition: dict[str, str]) -> DataFrame:
    """(table, rows, partitions): row counts and the distinct partition values in order."""
    parts = []
    for t, df in tables.items():
        at = F.col(partition[t]).cast("string") if t in partition else F.lit(None).cast("string")
        per = df.groupBy(at.alias("p")).agg(F.count("*").alias("n"))
        parts.append(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("partitions")).select(F.lit(t).alias("table"), "rows", "partitions"))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- verdicts


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def grain_gate(tables: dict[str, DataFrame]) -> Gate:
    detail = _rows(grain_profiles(tables))
    failures = [d for d in detail if d["unique"] and d["repeated_keys"]]
    return Gate("grain", "keys declared unique are unique; other keys have their fan-out measured", not failures, sum(d["rows"] for d in detail), failures, detail)


def conservation_gate(tables: dict[str, DataFrame], runs: DataFrame) -> Gate:
    failures = [{"check": "run arithmetic", **r} for r in _rows(unbalanced_runs(runs).orderBy("id"))]
    detail = _rows(claimed_rows(runs, tables))
    failures += [{"check": "table vs load runs", **d} for d in detail if d["claimed_by_load_runs"] != d["rows_in_table"]]
    return Gate("conservation", "rows read are loaded or rejected, and tables hold what the runs claim", not failures, sum(d["rows_in_table"] for d in detail), failures, detail)


def dedup_gate(tables: dict[str, DataFrame]) -> Gate:
    if "faers_case_current" not in tables or "faers_demo" not in tables:
        return Gate("dedup", "case versions are kept or superseded", True)
    d = _rows(dedup_numbers(tables["faers_demo"], tables["faers_case_current"]))[0]
    off = d["with_caseid"] - d["kept"] - d["superseded"]
    failures = [{"check": "kept + superseded = rows with a caseid", **d, "difference": off}] if off else []
    return Gate("dedup", "case versions are kept or superseded", not off, d["demo_rows"], failures, [d])


def integrity_gate(tables: dict[str, DataFrame], rejects: DataFrame) -> Gate:
    failures, detail, checked = [], [], 0
    for child, (parent, keys) in PARENTS.items():
        if child not in tables or parent not in tables:
            continue
        per = _rows(orphan_profile(tables[child], tables[parent], rejects, keys, child, parent))
        n = tables[child].count()
        checked += n
        orphans, explained = sum(r["orphan_rows"] for r in per), sum(r["explained_rows"] for r in per)
        detail.append({"child": child, "parent": parent, "join": " + ".join(keys), "rows": n, "orphan_rows": orphans, "explained_rows": explained, "unexplained_rows": orphans - explained})
        failures += [r for r in per if r["unexplained_rows"]]
    return Gate("integrity", "every orphan is explained by a rejected parent, per partition", not failures, checked, failures, detail)


def rejects_gate(runs: DataFrame, rejects: DataFrame) -> Gate:
    reasons: dict[tuple, list[str]] = {}
    for r in top_reasons(runs, rejects).orderBy("source", "table_name", "place").collect():
        reasons.setdefault((r["source"], r["table_name"]), []).append(f"{r['reason']} ×{r['n']}")
    detail = [d | {"reasons": reasons.get((d["source"], d["table_name"]), [])} for d in _rows(reject_summary(runs).orderBy(F.desc("rejected"), "source", "table_name"))]
    t = _rows(reject_totals(runs, rejects))[0]
    failures = [{"check": "every rejected line is stored unless the run says it capped", "counted": t["counted"], "stored": t["stored"]}] if t["counted"] > t["stored"] and not t["capped_runs"] else []
    return Gate("rejects", "rejected lines are counted, stored and attributable", not failures, t["counted"], failures, detail)


def run_gates(tables: dict[str, DataFrame], runs: DataFrame, rejects: DataFrame) -> list[Gate]:
    """All gates in their fixed order; the current cases are derived if the tables for it are there."""
    if "faers_case_current" not in tables and {"faers_demo", "faers_deleted_case"} <= tables.keys():
        tables = tables | {"faers_case_current": current_cases(tables["faers_demo"], tables["faers_deleted_case"])}
    return [grain_gate(tables), conservation_gate(tables, runs), dedup_gate(tables), integrity_gate(tables, rejects), rejects_gate(runs, rejects)]


def precision_report(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [date_precision(tables[t], t, c) for t, c in PARTIAL_DATES if t in tables])
