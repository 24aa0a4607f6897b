"""The current version of each case, and what it superseded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_cases(demo: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row per caseid: its latest version with n_versions, superseded and is_deleted.

    Latest is by fda_dt, then fda_dt_raw, primaryid and quarter, greatest first and nulls last. A maximum of structs
    and a count go through one aggregation with a map-side step, so a case with a large share of all rows is
    no hot spot, as it would be for a window. Rows without caseid are left out.
    """
    order = F.struct("fda_dt", "fda_dt_raw", "primaryid", "quarter", "caseversion")
    best = demo.where(F.col("caseid").isNotNull()).groupBy("caseid").agg(F.max(order).alias("b"), F.count("*").alias("n_versions"))
    gone = deleted.select(F.col("caseid").alias("_c")).dropna().distinct().withColumn("_gone", F.lit(True))
    joined = best.join(gone, F.col("caseid") == F.col("_c"), "left")
    return joined.select(
        "caseid", "b.primaryid", "b.quarter", "b.caseversion", "b.fda_dt_raw", "b.fda_dt", "n_versions", (F.col("n_versions") - 1).alias("superseded"), F.coalesce("_gone", F.lit(False)).alias("is_deleted")
    )


def without_deleted(current: DataFrame) -> DataFrame:
    return current.where(~F.col("is_deleted"))
