"""Partition-replacing loads with a reject lane and an append-only run ledger.

A run is a sequence of ledger events; the current state of a run is its latest event. Data are written
first and the closing event last, so a torn load leaves a run that is not successful. Loading a
partition again replaces it; older runs stay in the ledger as history.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.scalars import strip
from sedimenta.session import cut, spread
from sedimenta.sources import delimited
from sedimenta.sources.tables import TableSpec

STORED_REJECTS = 5000
LEDGER = "id bigint, source string, partition string, table_name string, rows_read bigint, rows_loaded bigint, rows_rejected bigint, started_at timestamp, finished_at timestamp, status string, notes string, event_at timestamp"


@dataclass(frozen=True)
class Loaded:
    run: int
    read: int
    loaded: int
    rejected: int
    notes: str | None


class Warehouse:
    """A folder of Parquet tables with their ledger (``load_run``) and rejects (``load_reject``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def tables(self, names: list[str]) -> dict[str, DataFrame]:
        """The tables that are there; absent ones are skipped."""
        return {n: self.read(n) for n in names if self.exists(n)}

    # ---------------------------------------------------------- ledger

    def _append(self, **event) -> None:
        row = {k.split()[0]: None for k in LEDGER.split(", ")} | event | {"event_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
        names = [k.split()[0] for k in LEDGER.split(", ")]
        self.spark.createDataFrame([tuple(row[n] for n in names)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/load_run")

    def runs(self) -> DataFrame:
        """Current state of every run."""
        if not self.exists("load_run"):
            return self.spark.createDataFrame([], LEDGER).drop("event_at")
        events = self.read("load_run")
        rest = [c for c in events.columns if c not in ("id", "event_at")]
        latest = events.groupBy("id").agg(F.max_by(F.struct(*rest), "event_at").alias("r"))
        return latest.select("id", "r.*")

    def open_run(self, source: str, partition: str, table: str) -> int:
        """A new run; runs of the same target that never finished are retired as abandoned."""
        runs = self.runs()
        same = (F.col("source") == source) & (F.col("partition") == partition) & (F.col("table_name") == table)
        for stale in runs.where(same & (F.col("status") == "running")).collect():
            self._append(**{k: v for k, v in stale.asDict().items()} | {"status": "abandoned"})
        run = (runs.agg(F.max("id")).first()[0] or 0) + 1
        self._append(id=run, source=source, partition=partition, table_name=table, rows_read=0, rows_loaded=0, rows_rejected=0, started_at=dt.datetime.now(), status="running")
        return run

    # ---------------------------------------------------------- loads

    def load(self, lines: DataFrame, spec: TableSpec, source: str, partition: str, limit: int | None = None, keep_rejects: int = STORED_REJECTS) -> Loaded:
        """Parse lines (archive, member, line_no, line), replace the partition, store rejects, close the run."""
        run = self.open_run(source, partition, spec.table)
        base = {"id": run, "source": source, "partition": partition, "table_name": spec.table, "started_at": dt.datetime.now()}
        try:
            # a member is read by one task; its lines are parsed by all
            parsed = cut(delimited.parse(spread(lines), spec, ["archive", "member"], limit))
            counts = parsed.agg(F.count("*").alias("read"), F.count("reason").alias("rejected")).first()
            good = delimited.loadable(parsed).select(F.lit(partition).alias(spec.partition), *[c for c in spec.names if c != spec.partition])
            if good.isEmpty():
                self._drop_partition(spec, partition)
            else:
                good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(spec.partition).parquet(f"{self.path}/{spec.table}")
            bad = delimited.rejected(parsed, ["archive", "member"])
            order = W.partitionBy("archive", "member").orderBy("line_no")
            kept = bad.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep_rejects)
            kept.select(F.lit(run).cast("bigint").alias("load_id"), F.lit(source).alias("source"), F.lit(partition).alias("partition"), F.lit(spec.table).alias("table_name"), "line_no", "reason", "raw_line", "key_hint").write.mode("append").parquet(f"{self.path}/load_reject")
            notes = f"stored the first {keep_rejects} of {counts['rejected']} rejects" if counts["rejected"] > keep_rejects else None
        except Exception as e:
            self._append(**base, rows_read=0, rows_loaded=0, rows_rejected=0, finished_at=dt.datetime.now(), status="error", notes=str(e)[:500])
            raise
        done = Loaded(run, counts["read"], counts["read"] - counts["rejected"], counts["rejected"], notes)
        self._append(**base, rows_read=done.read, rows_loaded=done.loaded, rows_rejected=done.rejected, finished_at=dt.datetime.now(), status="success", notes=notes)
        return done

    def _drop_partition(self, spec: TableSpec, partition: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{spec.table}/{spec.partition}={partition}")
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    def load_archive(self, archive: str, specs: list[TableSpec], source: str, partition: str, limit: int | None = None) -> dict[str, Loaded]:
        """Load every table of an archive, parents first; members that are missing are skipped."""
        from sedimenta.sources.zip_lines import ZipLines, ZipLinesReader

        self.spark.dataSource.register(ZipLines)
        out = {}
        for spec in specs:
            if ZipLinesReader(archive, [spec.members]).partitions():
                lines = self.spark.read.format("zip_lines").option("path", archive).option("members", spec.members).load()
                out[spec.table] = self.load(lines, spec, source, partition, limit)
        return out


def upsert(current: DataFrame | None, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows with incoming ones put in their place: within ``incoming`` the last by ``order`` wins,
    and incoming wins over current whatever its dates say."""
    rest = [c for c in incoming.columns if c not in keys]
    pick = [c for c in rest if c not in order]
    last = incoming.groupBy(*keys).agg(F.max(F.struct(*order, *pick)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    if current is None:
        return last
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last)


def first_arrivals(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first occurrence of each key within a run."""
    rest = [c for c in df.columns if c not in keys]
    pick = [c for c in rest if c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *pick)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def ingest_counts(docs: DataFrame) -> DataFrame:
    """One row: fetched, skipped (no id or nothing to embed), unique and duplicates of a batch of documents."""
    good = (F.col("doc_id") != "") & (strip(F.col("embed_text")) != "")
    per = docs.groupBy(F.when(good, F.col("source_id")).alias("s"), F.when(good, F.col("doc_id")).alias("d")).agg(F.count("*").alias("n"))
    skipped = F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), skipped.alias("skipped"), F.count("d").alias("unique"))
    return out.withColumn("duplicates", F.col("fetched") - F.col("skipped") - F.col("unique"))
