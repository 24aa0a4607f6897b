"""Orphan references over a foreign-key graph, direct and inherited.

``fixpoint`` finds, for every reference, the child keys that no parent row has (direct), then treats the
child rows behind them as gone and follows the graph with semi-joins, round by round, until a round brings no
new orphan key (inherited). The graph may have self-references and cycles: a key is an orphan only if a chain of
references leads from it to a missing row, and each key is found once, at its least depth.

Only distinct keys are kept and joined, made distinct map-side first, so neither repeated rows nor a hot key
cross the network more than once per partition. A round joins the new keys of the round before and no others;
its result is written to the checkpoint folder, so plans do not grow with the rounds.

Defined results: a key with any null part matches no parent, so it is a direct orphan (SQL's NOT
EXISTS), unless the reference is ``optional``: then it refers to nothing; repeated parents do not fan out; an empty parent
orphans all children; an empty child none; a parent key is orphaned if any of its rows is. Tables may have any other
columns, but for names that start with ``__``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut


@dataclass(frozen=True)
class Reference:
    """``child``.``columns`` refers to ``parent``.``parent_columns``; if ``optional``, a null key refers to nothing."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    optional: bool = False

    @property
    def keys(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.columns))]


def _every(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _named(columns: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(n) for c, n in zip(columns, names)]


def _child_keys(df: DataFrame, r: Reference) -> DataFrame:
    keys = df.select(*_named(r.columns, r.keys)).distinct()
    return keys.dropna() if r.optional else keys


def _rows_behind(df: DataFrame, r: Reference, lost: DataFrame) -> DataFrame:
    """The child's rows whose key is among the lost ones; null parts are equal here."""
    found = lost.select(*[F.col(k).alias(f"_{k}") for k in r.keys])
    return df.join(found, _every([F.col(c).eqNullSafe(F.col(f"_{k}")) for c, k in zip(r.columns, r.keys)]), "left_semi")


def fixpoint(tables: dict[str, DataFrame], references: Sequence[Reference]) -> dict[Reference, DataFrame]:
    """The orphan keys of every reference, each once: (__k0, __k1, ..., __depth).

    Depth 0 has no parent row (anti-join); depth n+1 has a parent row that is an orphan at depth n (semi-join with the keys
    found in round n), and at no lesser depth.
    """
    lost: dict[Reference, DataFrame] = {}
    for r in references:
        there = tables[r.parent].select(*_named(r.parent_columns, r.keys)).dropna().distinct()
        lost[r] = cut(_child_keys(tables[r.child], r).join(there, r.keys, "left_anti").withColumn("__depth", F.lit(0)))
    handed_down = {r.parent for r in references}
    new, depth = {r: keys for r, keys in lost.items() if r.child in handed_down and not keys.isEmpty()}, 0
    while True:
        depth += 1
        fresh: dict[Reference, DataFrame] = {}
        for r in references:
            sources = [(s, keys) for s, keys in new.items() if s.child == r.parent]
            if not sources:
                continue
            gone = reduce(DataFrame.unionByName, [_rows_behind(tables[r.parent], s, keys).select(*_named(r.parent_columns, r.keys)) for s, keys in sources])
            gone = gone.dropna().distinct().join(lost[r].select(*r.keys), r.keys, "left_anti")
            found = cut(_child_keys(tables[r.child], r).join(gone, r.keys, "left_semi").withColumn("__depth", F.lit(depth)))
            if not found.isEmpty():
                fresh[r] = found
        if not fresh:
            return lost
        for r, found in fresh.items():
            lost[r] = lost[r].unionByName(found)
        new = fresh


def _per_key(df: DataFrame, r: Reference, at: Column) -> DataFrame:
    """(keys, period, rows) of a child, counted map-side first."""
    return df.groupBy(*_named(r.columns, [f"_{k}" for k in r.keys]), at.alias("period")).agg(F.count("*").alias("_n"))


def cascade(tables: dict[str, DataFrame], references: Sequence[Reference], period: dict[str, str] | None = None) -> DataFrame:
    """Orphans per reference and period: (child_table, parent_table, kind, depth, period, orphan_rows, orphan_keys).

    kind is ``direct`` (depth 0) or ``inherited``. ``period`` names the column of each table to report by; a
    table without one reports null. Rows are counted per key first, so a hot key is one partial count per task.
    """
    reports = []
    for r, lost in fixpoint(tables, references).items():
        at = F.col(period[r.child]).cast("string") if period and r.child in period else F.lit(None).cast("string")
        counted = _per_key(tables[r.child], r, at)
        met = counted.join(lost, _every([F.col(f"_{k}").eqNullSafe(F.col(k)) for k in r.keys]))
        totals = met.groupBy(F.col("__depth").alias("depth"), "period").agg(F.sum("_n").alias("orphan_rows"), F.count("*").alias("orphan_keys"))
        kind = F.when(F.col("depth") == 0, "direct").otherwise("inherited")
        reports.append(totals.select(F.lit(r.child).alias("child_table"), F.lit(r.parent).alias("parent_table"), kind.alias("kind"), "depth", "period", "orphan_rows", "orphan_keys"))
    return reduce(DataFrame.unionByName, reports)


def profile(tables: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """One row for every reference, with or without orphans: (child_table, parent_table, child_rows, child_keys, direct_rows, inherited_rows)."""
    reports = []
    for r, lost in fixpoint(tables, references).items():
        counted = _per_key(tables[r.child], r, F.lit(None))
        met = counted.join(lost, _every([F.col(f"_{k}").eqNullSafe(F.col(k)) for k in r.keys]), "left")
        rows = lambda wanted: F.coalesce(F.sum(F.when(wanted, F.col("_n"))), F.lit(0))
        sums = met.agg(rows(F.lit(True)).alias("child_rows"), F.count("*").alias("child_keys"), rows(F.col("__depth") == 0).alias("direct_rows"), rows(F.col("__depth") > 0).alias("inherited_rows"))
        reports.append(sums.select(F.lit(r.child).alias("child_table"), F.lit(r.parent).alias("parent_table"), "*"))
    return reduce(DataFrame.unionByName, reports)


def explain_orphans(children: dict[str, DataFrame], parent: DataFrame, rejects: DataFrame, deleted: DataFrame, parent_table: str, period: str, key: str, entity: str) -> DataFrame:
    """Orphan keys of each child table, direct and inherited, with what else is known of the parent.

    Parent rows refer to their entity, which is gone if it is on the deletion list; child rows refer to the parent of their
    period. Returns (child_table, kind, period, key, cause), one row per distinct (period, key) of a child table that is an orphan.
    A direct one has no parent row of the same period and key, and its cause is the first that holds: ``rejected`` (a stored reject
    of the parent table names the key for that period), ``deleted`` (an entity of the child rows is on the
    deletion list), ``late`` / ``early`` (the parent has the key in a later / only in an earlier period), ``missing``. An
    inherited one has a parent row that is an orphan itself; its cause is ``withdrawn``.
    """
    gone = deleted.select(F.col(entity).alias("__e")).dropna().distinct()
    reports = parent.select(period, key, entity)
    living = reports.select(entity).dropna().distinct().join(gone, F.col(entity) == F.col("__e"), "left_anti")
    graph = [Reference(parent_table, (entity,), "__entities", (entity,), optional=True)]
    graph += [Reference(name, (period, key), parent_table, (period, key)) for name in children]
    found = fixpoint({"__entities": living, parent_table: reports} | {n: df.select(period, key, entity) for n, df in children.items()}, graph)

    lost = []
    for r, keys in found.items():
        if r.child not in children:
            continue
        kids = children[r.child].select(*_named((period, key), [f"_{k}" for k in r.keys]), F.col(entity).alias("__c")).distinct()
        met = kids.join(keys, _every([F.col(f"_{k}").eqNullSafe(F.col(k)) for k in r.keys]))
        lost.append(met.select(F.lit(r.child).alias("child_table"), F.col("__k0").alias(period), F.col("__k1").alias(key), "__depth", "__c"))
    known = reduce(DataFrame.unionByName, lost).join(gone.withColumn("__deleted", F.lit(True)), F.col("__c") == F.col("__e"), "left")
    cases = known.groupBy("child_table", period, key, "__depth").agg(F.max(F.coalesce("__deleted", F.lit(False))).alias("__deleted"))

    hint = F.regexp_replace("key_hint", r'^[ \t"]+|[ \t"]+$', "")
    named = rejects.where((F.col("table_name") == parent_table) & F.col("key_hint").isNotNull()).select(F.col("partition").alias("__rq"), hint.alias("__rk")).distinct().withColumn("__rejected", F.lit(True))
    cases = cases.join(named, (F.col(period) == F.col("__rq")) & (F.col(key).cast("string") == F.col("__rk")), "left")

    spans = parent.where(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(F.col(key).alias("__sk")).agg(F.min(period).alias("__from"), F.max(period).alias("__to"))
    cases = cases.join(spans, F.col(key) == F.col("__sk"), "left")
    cause = (
        F.when(F.col("__depth") > 0, "withdrawn")
        .when(F.col("__rejected"), "rejected")
        .when(F.col("__deleted"), "deleted")
        .when(F.col("__to") > F.col(period), "late")
        .when(F.col("__from") < F.col(period), "early")
        .otherwise("missing")
    )
    kind = F.when(F.col("__depth") == 0, "direct").otherwise("inherited")
    return cases.select("child_table", kind.alias("kind"), period, key, cause.alias("cause"))
