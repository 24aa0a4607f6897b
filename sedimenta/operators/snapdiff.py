"""What changed between consecutive full snapshots of a table.

Rows are reduced to (snapshot, key, key hash, row hash) and spread over buckets by a second, independent
hash of the key. Each bucket holds a bounded share of the keys; its arrays of hashes are sorted in numpy, and
``searchsorted`` gives the keys added, removed and changed between neighbouring snapshots; the texts of
those keys, and of no others, are taken out of the bucket. The table is read once and its keys are aggregated
once; nothing is joined. Full values are fetched for changed keys only (``changed_fields``).

Two keys are taken for one only if both their 64-bit hash and their bucket (a 32-bit hash of another
kind) agree; a change is missed only if two different rows of a key share a 64-bit hash.

Defined results: rows with a null key or snapshot are left out; of repeated rows for a key in a snapshot the
greatest by ``order`` counts (a null order is the least), ties fall to the greater row hash; null equals
only null; with fewer than two snapshots the result is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

ROWS_PER_BUCKET = 25_000
#: The list of changed keys is broadcast past the table up to so many entries; a longer one is shuffled with it.
MOST_BROADCAST = 200_000
NULL_MARK = "\u0000"


def loose(column: Column) -> Column:
    """Letters and digits of a string without case, for comparison."""
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]+", ""))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64-bit hash of a row; strings compare loosely, null differs from everything else."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        text = loose(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string")
        parts.append(F.coalesce(text, F.lit(NULL_MARK)))
    return F.xxhash64(*parts)


def compact(df: DataFrame, snapshot: str, key: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """(snapshot, key, row hash), one row per key of a snapshot."""
    rows = df.select(F.col(snapshot).alias("_s"), key.alias("_key"), F.struct(F.col(order).alias("o"), row_hash(df, columns).alias("h")).alias("_row"))
    rows = rows.where(F.col("_s").isNotNull() & F.col("_key").isNotNull())
    return rows.groupBy("_s", "_key").agg(F.max("_row").alias("_row")).select("_s", "_key", F.col("_row")["h"].alias("_hash"))


def differences(snap: np.ndarray, key: np.ndarray, row: np.ndarray, snapshots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over one bucket: (later snapshot, index of a row that has the key, kind), kind 0 added, 1 removed, 2 changed."""
    order = np.lexsort((key, snap))
    snap, key, row = snap[order], key[order], row[order]
    edges = np.searchsorted(snap, np.arange(snapshots + 1))
    out_s, out_i, out_c = [], [], []
    for s in range(1, snapshots):
        a, b = slice(edges[s - 1], edges[s]), slice(edges[s], edges[s + 1])
        old, new = key[a], key[b]
        in_old = np.searchsorted(old, new)
        known = in_old < len(old)
        known[known] = old[in_old[known]] == new[known]
        in_new = np.searchsorted(new, old)
        kept = in_new < len(new)
        kept[kept] = new[in_new[kept]] == old[kept]
        moved = np.zeros(len(new), bool)
        moved[known] = row[a][in_old[known]] != row[b][known]
        for kind, at in ((0, order[b][~known]), (1, order[a][~kept]), (2, order[b][moved])):
            out_s.append(np.full(len(at), s))
            out_i.append(at)
            out_c.append(np.full(len(at), kind))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_s, np.int64), cat(out_i, np.int64), cat(out_c, np.int64)


KINDS = pa.array(["added", "removed", "changed"])


def snapshot_changes(df: DataFrame, snapshot: str, key: Column, order: str, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(snapshot, since, key, change): ``added``, ``removed`` or ``changed`` in a snapshot since the one before.

    The number of buckets follows the number of rows. Only the list of distinct snapshots, one value for each
    delivery, reaches the driver and the tasks.
    """
    counted = df.select(F.col(snapshot).alias("_s")).where(F.col("_s").isNotNull()).groupBy("_s").agg(F.count("*").alias("n")).toArrow()
    days = counted.column("_s").combine_chunks()
    days = days.take(pc.sort_indices(days))
    buckets = max(1, -(-(pc.sum(counted.column("n")).as_py() or 0) // rows_per_bucket))
    small = compact(df, snapshot, key, order, columns)
    spread = small.select(F.pmod(F.hash("_key"), F.lit(buckets)).alias("_bucket"), "_s", "_key", F.xxhash64("_key").alias("_kh"), "_hash")
    kinds = dict(small.dtypes)

    def one(table: pa.Table) -> pa.Table:
        told = days.cast(table.schema.field("_s").type)
        nth = pc.index_in(table.column("_s"), value_set=told).to_numpy()
        later, at, kind = differences(nth, table.column("_kh").to_numpy(), table.column("_hash").to_numpy(), len(days))
        return pa.table({"snapshot": told.take(pa.array(later)), "since": told.take(pa.array(later - 1)), "key": table.column("_key").take(pa.array(at)), "change": KINDS.take(pa.array(kind))})

    return spread.groupBy("_bucket").applyInArrow(one, f"snapshot {kinds['_s']}, since {kinds['_s']}, key {kinds['_key']}, change string")


def changed_fields(df: DataFrame, changes: DataFrame, snapshot: str, key: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """For the changed keys only: (snapshot, key, field, before, after), values as text.

    The changed keys are written out and counted first. Up to MOST_BROADCAST they are sent past the table, which is then
    neither shuffled nor broadcast; beyond, both sides are shuffled by snapshot and key. Only rows that match one are
    aggregated, and only differing fields become rows.
    """
    wanted = changes.where(F.col("change") == "changed").select(F.col("snapshot").alias("_c"), F.col("key").alias("_ck"), "since")
    sides = F.array(F.struct(F.col("since").alias("s"), F.lit(False).alias("after")), F.struct(F.col("_c").alias("s"), F.lit(True).alias("after")))
    need = cut(wanted.select("_c", "_ck", F.explode(sides).alias("_x"))).select("_c", "_ck", F.col("_x.s").alias("_ns"), F.col("_x.after").alias("_after"))
    if need.count() <= MOST_BROADCAST:
        need = F.broadcast(need)
    kinds = dict(df.dtypes)
    values = [F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(snapshot).alias("_rs"), key.alias("_rk"), F.col(order).alias("_o"), *values)
    renamed = [f"_v{i}" for i in range(len(columns))]
    met = rows.join(need, (F.col("_ck") == F.col("_rk")) & (F.col("_ns") == F.col("_rs")))
    row = F.struct("_o", row_hash(met, renamed).alias("_h"), *renamed)
    got = met.groupBy("_c", "_ck").agg(F.max(F.when(~F.col("_after"), row)).alias("b"), F.max(F.when(F.col("_after"), row)).alias("a"))
    cells = []
    for name, c in zip(renamed, columns):
        b, a = F.col(f"b.{name}"), F.col(f"a.{name}")
        same = loose(b).eqNullSafe(loose(a)) if kinds[c] == "string" else b.eqNullSafe(a)
        cells.append(F.when(~same, F.struct(F.lit(c).alias("field"), b.cast("string").alias("before"), a.cast("string").alias("after"))))
    return got.select(F.col("_c").alias("snapshot"), F.col("_ck").alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("snapshot", "key", "x.field", "x.before", "x.after")
