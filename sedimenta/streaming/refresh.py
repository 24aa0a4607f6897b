"""Incremental refresh of a document table with Structured Streaming.

New landing files are picked up once (the stream's checkpoint is the high-water mark), normalized, and upserted per
batch; a failed batch is replayed, and the replay writes the same rows again. Every run leaves events (running, then success
or error) in the store, out of which ``status.source_state`` tells the state of a source and from where it must be read again.

The documents of a source lie in buckets by a hash of their id. Their number follows the store's size; a batch rewrites only the
buckets it touches, under a new version number, and then a new pointer file is renamed into its place, so that a reader
never sees half a write, two writers cannot both win, and the cost of a batch follows the batch. Versions that no pointer of the last
``KEPT_POINTERS`` names are removed.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.load import upsert
from sedimenta.operators.status import source_state
from sedimenta.session import cut
from sedimenta.sources.records import NORMALIZERS, usable

LOG = logging.getLogger(__name__)
MOST_ERROR = 500
BUCKETS = 8
#: A store with more documents a bucket than this is written into twice as many buckets with its next batch.
ROWS_PER_BUCKET = 20_000
KEPT_POINTERS = 2
STATE = "source string, status string, at timestamp, started_at timestamp, documents bigint, error string"


@dataclass(frozen=True)
class Pointer:
    """What a version of a source consists of: the number of buckets, rows at the last count, and the version that holds each bucket."""

    number: int = 0
    buckets: int = BUCKETS
    rows: int = 0
    versions: dict = field(default_factory=dict)


class DocumentStore:
    """Documents by source under a folder that all executors share; the pointer file with the greatest number holds."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.buckets, self.rows_per_bucket = spark, path.rstrip("/"), buckets, rows_per_bucket

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    def pointer(self, source: str) -> Pointer:
        names = [n for n in self._names(f"{self.path}/{source}") if n.startswith("POINTER-")]
        if not names:
            return Pointer(buckets=self.buckets)
        told = json.loads(self.spark.read.text(f"{self.path}/{source}/{names[-1]}").first()[0])
        return Pointer(told["number"], told["buckets"], told["rows"], {int(k): v for k, v in told["versions"].items()})

    def current(self, source: str) -> dict[int, int]:
        """Version of each bucket that has rows."""
        return self.pointer(source).versions

    def version(self, source: str) -> int:
        return self.pointer(source).number

    def _read(self, source: str, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/{source}/v{v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, source: str) -> DataFrame | None:
        return self._read(source, self.current(source))

    def _publish(self, source: str, pointer: Pointer) -> None:
        """Write the pointer beside its place and rename it there; a place that is taken means another writer was first."""
        fs, place = self._fs(f"{self.path}/{source}/POINTER-{pointer.number:09d}")
        _, aside = self._fs(f"{self.path}/{source}/_pointer-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"number": pointer.number, "buckets": pointer.buckets, "rows": pointer.rows, "versions": pointer.versions}), "ascii"))
        out.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer published version {pointer.number} of {source}")

    def _tidy(self, source: str) -> None:
        """Remove pointers but the last, and versions that none of these names."""
        folder = f"{self.path}/{source}"
        names = self._names(folder)
        pointers = [n for n in names if n.startswith("POINTER-")]
        kept = pointers[-KEPT_POINTERS:]
        wanted = {v for n in kept for v in json.loads(self.spark.read.text(f"{folder}/{n}").first()[0])["versions"].values()}
        old = [n for n in pointers if n not in kept] + [n for n in names if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) not in wanted]
        for n in old:
            fs, place = self._fs(f"{folder}/{n}")
            fs.delete(place, True)

    def put(self, source: str, incoming: DataFrame, order: list[str]) -> int:
        """Upsert a batch; returns the new version."""
        now = self.pointer(source)
        number, incoming = now.number + 1, cut(incoming)
        buckets = now.buckets * 2 if now.rows > now.buckets * self.rows_per_bucket else now.buckets
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        touched = set(range(buckets)) if buckets != now.buckets else {r[0] for r in incoming.select(bucket.alias("b")).distinct().collect()}
        before = now.versions if buckets != now.buckets else {b: v for b, v in now.versions.items() if b in touched}
        merged = upsert(self._read(source, before), incoming, ["source_id", "doc_id"], order)
        out = f"{self.path}/{source}/v{number}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(out)
        written = {int(n.removeprefix("bucket=")) for n in self._names(out) if n.startswith("bucket=")}
        kept = {} if buckets != now.buckets else {b: v for b, v in now.versions.items() if b not in touched}
        pointer = Pointer(number, buckets, 0, kept | dict.fromkeys(sorted(written), number))
        self._publish(source, replace(pointer, rows=self._read(source, pointer.versions).count() if pointer.versions else 0))
        self._tidy(source)
        return number

    # ---------------------------------------------------------- state

    def tell(self, source: str, status: str, started: dt.datetime, documents: int = 0, error: str | None = None) -> None:
        """Append an event of a run."""
        row = (source, status, dt.datetime.now(dt.timezone.utc), started, documents, error and error[:MOST_ERROR])
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/_state")

    def state(self) -> DataFrame:
        """(source, status, error, last_success) of every source that was ever refreshed."""
        fs, place = self._fs(f"{self.path}/_state")
        events = self.spark.read.parquet(str(place)) if fs.exists(place) else self.spark.createDataFrame([], STATE)
        return source_state(events)

    def all(self) -> DataFrame | None:
        parts = [d for s in NORMALIZERS if (d := self.read(s)) is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None


def refresh(spark: SparkSession, store: DocumentStore, source: str, landing: str, checkpoint: str, as_of: dt.datetime, normalize: Callable | None = None, full: bool = False) -> int:
    """Take in what is new in a landing folder of JSON lines; returns the number of batches that wrote.

    Within a batch the record of the latest file wins, then the greatest in its other columns. ``full`` reads the whole folder
    again and leaves the stream's own mark where it is. The run's start is what its success event is told by, so whatever arrives while
    it runs counts as later than it. Errors leave an event and are raised.
    """
    normalize = normalize or NORMALIZERS[source]
    wrote, started, documents = [], dt.datetime.now(dt.timezone.utc), [0]

    def batch(df: DataFrame, number: int) -> None:
        docs = cut(usable(normalize(df, F.lit(as_of).cast("timestamp"))))
        n = docs.count()
        if n:
            wrote.append(store.put(source, docs, ["arrived"]))
            documents[0] += n

    columns = [F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("arrived")]
    store.tell(source, "running", started)
    try:
        if full:
            batch(spark.read.text(landing).select(*columns), 0)
        else:
            lines = spark.readStream.format("text").load(landing).select(*columns)
            query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{source}").trigger(availableNow=True).start()
            query.awaitTermination()
    except Exception as e:
        store.tell(source, "error", started, documents[0], str(e))
        raise
    store.tell(source, "success", started, documents[0])
    return len(wrote)


def refresh_all(spark: SparkSession, store: DocumentStore, landings: dict[str, str], checkpoint: str, as_of: dt.datetime, full: bool = False) -> dict[str, str]:
    """Refresh several sources, one after the other; the trouble of one does not stop the next."""
    out = {}
    for source, landing in landings.items():
        try:
            out[source] = f"ok: {refresh(spark, store, source, landing, checkpoint, as_of, full=full)} batches"
        except Exception as e:  # noqa: BLE001
            out[source] = f"error: {str(e)[:MOST_ERROR]}"
    return out


def choose(sources: list[str], wanted: list[str] | None = None, everything: bool = False, due: list[str] | None = None) -> list[str]:
    """Which sources to refresh: those named, else all if asked, else those that are due."""
    if wanted:
        unknown = sorted(set(wanted) - set(sources))
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        return list(wanted)
    return list(sources) if everything else [s for s in sources if s in (due or [])]


def append_calls(spark: SparkSession, path: str, calls: list[dict]) -> bool:
    """Append metered calls (tool, key, status, duration_ms, chars, created_at); metering never fails a call, but what it could not write is logged."""
    schema = "tool string, key string, status string, duration_ms bigint, chars bigint, created_at timestamp"
    names = [c.split()[0] for c in schema.split(", ")]
    try:
        spark.createDataFrame([tuple(c.get(n) for n in names) for c in calls], schema).coalesce(1).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        LOG.exception("%d calls were not metered", len(calls))
        return False


def stream_events(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Running counts by user and type of an event folder, each run taking in the new files only."""
    schema = spark.read.parquet(path).schema

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

