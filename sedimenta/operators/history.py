"""Full history of entity attributes, kept as checkpoints and patches.

Versions come in as one row per (entity, version) with the day the version starts. On any day the valid version
is the highest one that has started, so a version is valid from its start until the first start of a
higher version, and never if that is not later than its own start.

Storage: the version numbers of an entity are cut into spans of ``every``. One stored row is the chain of a span: its first version
holds all attributes (the checkpoint), each later one only the attributes that changed (a patch). ``fold`` folds
the patches forward from the checkpoint. A chain has at most ``every`` versions and depends on no other chain, so

* an append (``HistoryStore.append``) reads, folds and writes again only the chains that get new versions, whatever order these
  come in, under a new generation number; of several generations of a chain the latest counts;
* a read as of a day (``HistoryStore.as_of``) needs a number per entity and then the one chain nearest to the day.

``intervals`` works in blocks of ``BLOCK`` version numbers, and only one date passes from block to block, so no task
ever holds an unbounded group, whatever one entity's share of the rows.

Defined results: rows with a null entity, version or start are left out; of rows repeated
for an (entity, version) the latest delivery counts (``latest_delivery``); a null attribute is a value
like any other, so a change to or from null is a patch; negative version numbers count like others; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.scalars import day_of_digits
from sedimenta.session import cut

BLOCK = 1024
CHECKPOINT_EVERY = 16


def latest_delivery(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, remaining columns breaking ties so reruns agree.

    Repeated rows collapse map-side before the shuffle, so a key with a third of all rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in (*order, *rest)])


def start_of(raw: Column, prec: Column, exact: Column, quarter: Column) -> Column:
    """First day that a partial date can mean, else the first day of the quarter like ``2024Q3``."""
    digits = F.trim(raw)
    month = F.lpad((F.substring(quarter, 6, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0")
    of_quarter = F.concat(F.substring(quarter, 1, 4), F.lit("-"), month, F.lit("-01")).try_cast("date")
    partial = (
        F.when(prec == "day", exact)
        .when(prec == "month", day_of_digits(F.concat(digits, F.lit("01"))))
        .when(prec == "year", day_of_digits(F.concat(digits, F.lit("0101"))))
    )
    return F.coalesce(partial, of_quarter)


def intervals(versions: DataFrame, entity: str, version: str, start: str) -> DataFrame:
    """Adds valid_from, valid_to (null: open) and keeps only versions valid on at least one day.

    ``versions`` has one row per (entity, version).
    """
    df = versions.where(F.col(entity).isNotNull() & F.col(version).isNotNull() & F.col(start).isNotNull())
    df = df.withColumn("_block", F.floor(F.col(version) / BLOCK).cast("long"))
    inside = W.partitionBy(entity, "_block").orderBy(F.col(version).desc()).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(entity).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(entity, "_block").agg(F.min(start).alias("_first"))
    later = blocks.withColumn("_later", F.min("_first").over(above)).where(F.col("_later").isNotNull())
    later = later.select(F.col(entity).alias("_e"), F.col("_block").alias("_b"), "_later")
    df = df.withColumn("_inside", F.min(start).over(inside))
    df = df.join(later, (F.col(entity) == F.col("_e")) & (F.col("_block") == F.col("_b")), "left").drop("_e", "_b")
    df = df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.least("_inside", "_later"))
    return df.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))).drop("_inside", "_later")


def stripe(versions: DataFrame, entity: str, version: str, carried: Sequence[str], attributes: Sequence[str], every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Chains out of versions, one row per (entity, version): (entity, block, span, chain).

    A link of a chain is (version, carried columns, patch). ``patch`` has one optional box per attribute: null where the
    attribute did not change, else a struct with the new value ``v``, which may be null. The first link fills every box.
    """
    number = F.col(version)
    rows = versions.select(F.col(entity).alias("entity"), F.floor(number / BLOCK).cast("long").alias("block"), F.floor(number / every).cast("long").alias("span"), F.struct(number.alias("version"), *carried, F.struct(*attributes).alias("_all")).alias("_row"))
    spans = rows.repartition("entity", "block").groupBy("entity", "block", "span").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))

    def link(x: Column, i: Column) -> Column:
        before = F.get("_rows", i - 1)["_all"]
        boxes = [F.when((i == 0) | ~x["_all"][a].eqNullSafe(before[a]), F.struct(x["_all"][a].alias("v"))).alias(a) for a in attributes]
        return F.struct(x["version"].alias("version"), *[x[c].alias(c) for c in carried], F.struct(*boxes).alias("patch"))

    return spans.select("entity", "block", "span", F.transform("_rows", link).alias("chain"))


def _last_value(chain: Column, attribute: str) -> Column:
    """The value an attribute has at the end of a chain that begins with a checkpoint."""
    changed = F.filter(chain, lambda x: x["patch"][attribute].isNotNull())
    return F.try_element_at(changed, F.lit(-1))["patch"][attribute]["v"]


def fold(chains: DataFrame, entity: str, version: str, carried: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Versions with whole attributes out of chains: patches folded forward from the checkpoint of each chain."""

    def whole(x: Column, i: Column) -> Column:
        until = F.slice("chain", F.lit(1), i + 1)
        state = [_last_value(until, a).alias(a) for a in attributes]
        return F.struct(x["version"].alias(version), *[x[c].alias(c) for c in carried], *state)

    rows = chains.select(F.col("entity").alias(entity), F.explode(F.transform("chain", whole)).alias("_x"))
    return rows.select(entity, "_x.*")


def history(versions: DataFrame, entity: str, version: str, start: str, attributes: Sequence[str], every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Versions in, whole history out, by way of checkpoints and patches, without writing them.

    Columns other than those named are left aside, whatever their names.
    """
    versions = versions.select(*dict.fromkeys([entity, version, start, *attributes])).dropna(subset=[entity, version, start])
    told = fold(stripe(versions, entity, version, [start], attributes, every), entity, version, [start], attributes)
    return intervals(told, entity, version, start).select(entity, version, "valid_from", "valid_to", *attributes)


class HistoryStore:
    """Histories under a folder that all executors share; every append adds a generation of chains.

    ``order`` are the columns by which the latest delivery of an (entity, version) is told; they are kept with each version.
    A generation is visible once it is whole (its files are committed together); a failed append leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, version: str, start: str, order: Sequence[str], attributes: Sequence[str], every: int = CHECKPOINT_EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.entity, self.version, self.start = entity, version, start
        self.carried, self.order, self.attributes = list(dict.fromkeys([start, *order])), list(order), list(attributes)

    def generations(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(place):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(place)]
        return sorted(int(n.removeprefix("generation=")) for n, p in names if n.startswith("generation=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _stored(self) -> DataFrame | None:
        paths = [f"{self.path}/generation={g}" for g in self.generations()]
        return self.spark.read.option("basePath", self.path).parquet(*paths) if paths else None

    @staticmethod
    def _latest(stored: DataFrame) -> DataFrame:
        return stored.groupBy("entity", "block", "span").agg(F.max_by("chain", "generation").alias("chain"))

    def _fold(self, chains: DataFrame) -> DataFrame:
        return fold(chains, self.entity, self.version, self.carried, self.attributes)

    def append(self, versions: DataFrame) -> int:
        """Add versions in any order; returns the number of chains written. Chains without new versions are not read past their keys."""
        columns = list(dict.fromkeys([self.entity, self.version, *self.carried, *self.attributes]))
        incoming = cut(latest_delivery(versions.select(*columns).dropna(subset=[self.entity, self.version, self.start]), [self.entity, self.version], self.order))
        stored, merged = self._stored(), incoming
        if stored is not None:
            touched = incoming.select(F.col(self.entity).alias("_e"), F.floor(F.col(self.version) / self.every).cast("long").alias("_s")).distinct()
            old = stored.join(touched, (F.col("entity") == F.col("_e")) & (F.col("span") == F.col("_s")), "left_semi")
            merged = latest_delivery(incoming.unionByName(self._fold(self._latest(old)).select(*incoming.columns)), [self.entity, self.version], self.order)
        chains = stripe(merged, self.entity, self.version, self.carried, self.attributes, self.every)
        number = max(self.generations(), default=0) + 1
        chains.write.mode("overwrite").parquet(f"{self.path}/generation={number}")
        return self.spark.read.parquet(f"{self.path}/generation={number}").count()

    def versions(self) -> DataFrame:
        """All stored versions with whole attributes."""
        return self._fold(self._latest(self._stored()))

    def history(self) -> DataFrame:
        """Validity rows: (entity, version, valid_from, valid_to, attributes)."""
        return intervals(self.versions(), self.entity, self.version, self.start).select(self.entity, self.version, "valid_from", "valid_to", *self.attributes)

    def as_of(self, day: Column) -> DataFrame:
        """(entity, version, attributes) of the version valid on a day, folded from the nearest checkpoint.

        The highest version started by then is found from the chains' dates alone; only its own chain is folded.
        """
        latest = self._latest(self._stored())
        begun = F.filter("chain", lambda x: x[self.start] <= day)
        # within a chain versions ascend, so the last link that has begun is its highest
        reached = latest.select("entity", "span", F.slice("chain", F.lit(1), F.array_position(F.transform("chain", lambda x: x["version"]), F.try_element_at(begun, F.lit(-1))["version"]).cast("int")).alias("chain")).where(F.size(begun) > 0)
        nearest = reached.groupBy("entity").agg(F.max_by("chain", "span").alias("chain"))
        last = F.try_element_at("chain", F.lit(-1))
        state = [_last_value(F.col("chain"), a).alias(a) for a in self.attributes]
        return nearest.select(F.col("entity").alias(self.entity), last["version"].alias(self.version), *state)


def versions_from_snapshots(snapshots: DataFrame, entity: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """Versions out of periodic full snapshots: a row numbered by day for each attribute change.

    One row per (entity, snapshot) is expected; disappearance between snapshots is not a change here
    (the snapshot difference operator reports it).
    """
    day = F.datediff(F.col(at), F.lit("1970-01-01").cast("date"))
    df = snapshots.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).withColumn("version", day)
    order = W.partitionBy(entity).orderBy("version")
    row = F.struct(*attributes)
    first = F.row_number().over(order) == 1
    changed = ~row.eqNullSafe(F.lag(row).over(order))
    return df.withColumn("_keep", first | changed).where("_keep").select(entity, "version", F.col(at).alias("start"), *attributes)
