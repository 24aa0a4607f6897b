"""Corpus status, usage, freshness, access keys and rolling limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions.scalars import age_of, half_up, key_digest

CADENCE_DAYS = {"daily": 1, "weekly": 7}


def corpus_counts(docs: DataFrame, now: Column, source: str = "source", updated: str = "updated_at", ingested: str = "ingested_at") -> DataFrame:
    """(source, documents, newest, ingested): dates that lie ahead of ``now`` do not make a source look fresh."""
    return docs.groupBy(source).agg(F.count("*").alias("documents"), F.max(F.when(F.col(updated) <= now, F.col(updated))).alias("newest"), F.max(ingested).alias("ingested"))


def corpus_status(counts: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Counts and refresh state side by side, sources of either kept: (source, documents, newest, last_success, freshness)."""
    joined = counts.join(state, "source", "full_outer")
    return joined.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), "newest", "last_success", age_of(F.col("last_success"), now).alias("freshness"))


def usage(calls: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(tool, calls, mean_ms, errors) over the last days before ``now``."""
    recent = calls.where(F.col("created_at") > now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy("tool").agg(F.count("*").alias("calls"), half_up(F.avg("duration_ms")).alias("mean_ms"), F.count_if(F.col("status") == "error").alias("errors"))


def rolling_use(calls: DataFrame, now: Column, limit: Column, days: int = 30, key: str = "key") -> DataFrame:
    """(key, used, allowed): calls of each key in the last days before ``now``, and whether one more may be made.

    All calls of a key count, those that were turned away too. A null limit is none.
    """
    recent = calls.where(F.col("created_at") > now - F.expr(f"INTERVAL {int(days)} DAYS"))
    used = recent.groupBy(key).agg(F.count("*").alias("used"))
    return used.withColumn("allowed", limit.isNull() | (F.col("used") < limit))


def key_state(events: DataFrame) -> DataFrame:
    """Current state per key digest out of append-only issue and revoke events (latest wins)."""
    hashed = events.withColumn("key_hash", key_digest(F.col("key"))) if "key" in events.columns else events
    rest = [c for c in hashed.columns if c not in ("key", "key_hash", "created_at")]
    return hashed.groupBy("key_hash").agg(F.max(F.struct("created_at", *rest)).alias("r")).select("key_hash", F.left("key_hash", F.lit(12)).alias("key_id"), "r.*")


def list_keys(events: DataFrame, now: Column) -> DataFrame:
    """(key_id, plan, active, since): every key by the first letters of its digest, newest first; keys themselves are never stored."""
    return key_state(events).select("key_id", "plan", "active", age_of(F.col("created_at"), now).alias("since"), "created_at").orderBy(F.desc("created_at"), "key_id").drop("created_at")


def decide_access(calls: DataFrame, keys: DataFrame, used: DataFrame, limits: dict[str, int | None], default: str, exempt: tuple[str, ...] = (), restricted: tuple[str, ...] = (), may_restricted: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``reason`` to calls (tool, key): null if allowed, else missing_key, invalid_key, not_permitted or rate_limit, the first that holds.

    ``limits`` gives the calls per window of each plan; plans, tools and limits are the caller's.
    """
    hashed = calls.withColumn("key_hash", key_digest(F.col("key")))
    known = keys.select(F.col("key_hash").alias("_h"), "plan", "active")
    joined = hashed.join(known, F.col("key_hash") == F.col("_h"), "left").join(used.select(F.col("key_hash").alias("_u"), "used"), F.col("key_hash") == F.col("_u"), "left")
    plan = F.when(F.col("plan").isin(*limits), F.col("plan")).otherwise(default)
    limit = None
    for name, n in limits.items():
        limit = F.when(plan == name, F.lit(n).cast("long")) if limit is None else limit.when(plan == name, F.lit(n).cast("long"))
    reason = (
        F.when(F.col("tool").isin(*exempt), None)
        .when(F.col("key").isNull() | (F.trim("key") == ""), "missing_key")
        .when(F.col("_h").isNull() | ~F.col("active"), "invalid_key")
        .when(F.col("tool").isin(*restricted) & ~plan.isin(*may_restricted), "not_permitted")
        .when(limit.isNotNull() & (F.coalesce("used", F.lit(0)) >= limit), "rate_limit")
    )
    return joined.withColumn("reason", reason).drop("_h", "_u", "key", "plan", "active", "used")


def source_state(events: DataFrame) -> DataFrame:
    """Refresh state per source out of append-only events (source, status, at, started_at, error).

    last_success is the start of the latest run that ended well: what arrived while it ran is read again next time.
    """
    latest = events.groupBy("source").agg(F.max_by(F.struct("status", "error"), "at").alias("now"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"))
    return latest.select("source", F.col("now.status").alias("status"), F.when(F.col("now.status") == "error", F.left("now.error", F.lit(500))).alias("error"), "last_success")


def due(states: DataFrame, now: Column) -> DataFrame:
    """Adds ``due`` to (source, cadence, last_success): never succeeded is due, manual never is."""
    days = None
    for cadence, n in CADENCE_DAYS.items():
        days = F.when(F.col("cadence") == cadence, n) if days is None else days.when(F.col("cadence") == cadence, n)
    late = F.unix_timestamp(now) - F.unix_timestamp("last_success") >= days * 86400
    return states.withColumn("due", F.when(days.isNull(), False).when(F.col("last_success").isNull(), True).otherwise(late))


def select_budget(docs: DataFrame, group: str, key: str, pinned: Column, themes: DataFrame, newest: str, budget: int) -> DataFrame:
    """(group, key, why): up to ``budget`` documents per group: pinned first, then theme matches by rank, then the newest.

    ``themes`` has (key, rank) of theme matches, the best rank of a document counting. Nothing is picked twice.
    """
    best = themes.groupBy(F.col(key).alias("_t")).agg(F.min("rank").alias("_rank"))
    joined = docs.select(group, key, newest, pinned.alias("_pin")).join(best, F.col(key) == F.col("_t"), "left")
    why = F.when(F.col("_pin"), "pinned").when(F.col("_rank").isNotNull(), "theme").otherwise("newest")
    stage = F.when(F.col("_pin"), 0).when(F.col("_rank").isNotNull(), 1).otherwise(2)
    order = W.partitionBy(group).orderBy(stage, F.coalesce("_rank", F.lit(0)), F.desc_nulls_last(newest), key)
    return joined.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget).select(group, key, why.alias("why"))


def retrieval_scores(results: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: questions, hit@k and mean reciprocal rank of the gold document in ranked results (query_id, doc_id, place)."""
    found = gold.join(results, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    hits = [F.round(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in at]
    return found.agg(F.count("*").alias("questions"), *hits, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
