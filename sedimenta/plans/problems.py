"""Queries of the general training-data problems: nesting, history, orphans, snapshot changes, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import history, orphans, shred, snapdiff
from sedimenta.session import scratch, spread, table
from sedimenta.sources import delimited_rejects

INGREDIENT = {"name": None, "strength": None}
PRODUCT = {"product_number": None, "brand_name": None, "dosage_form": None, "route": None, "marketing_status": None, "active_ingredients": [INGREDIENT]}
APPLICATION_DOC = {"id": None, "date": None, "type": None}
SUBMISSION = {"submission_type": None, "submission_number": None, "submission_status": None, "submission_status_date": None, "submission_class_code_description": None, "application_docs": [APPLICATION_DOC]}
EVENT_DRUG = {"name": None, "role": None, "indication": None, "authorization_number": None}
APPLICATION_LAYOUT = {"products": [PRODUCT], "submissions": [SUBMISSION]}
PAYLOAD_LAYOUT = APPLICATION_LAYOUT | {"drugs": [EVENT_DRUG]}

DEMO_ATTRIBUTES = ("i_f_code", "rept_cod", "mfr_num", "mfr_sndr", "age", "age_cod", "sex", "wt", "wt_cod", "occp_cod", "reporter_country", "occr_country")


# ---------------------------------------------------------------- 1 nested records


def _shredded(spark: SparkSession, sf: str, with_fields: bool) -> DataFrame:
    """Every object of every list of both sources, with its source_table."""
    applications = shred.shred(table(spark, sf, "openfda_drugsfda"), "record_id", ["products", "submissions"], APPLICATION_LAYOUT, with_fields)
    payloads = spread(table(spark, sf, "documents").select("doc_id", "structured").where(F.col("structured").isNotNull()))
    documents = shred.shred(payloads, "doc_id", "structured", PAYLOAD_LAYOUT, with_fields)
    return applications.withColumn("source_table", F.lit("openfda_drugsfda")).unionByName(documents.withColumn("source_table", F.lit("documents")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _shredded(spark, sf, False).select("source_table", "record_key", "path", "parent_pos", "pos")


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    """All five flat tables with every value they hold: products, ingredients, submissions, application documents and event drugs."""
    cells = _shredded(spark, sf, True).select("source_table", "record_key", "path", "parent_pos", "pos", F.explode("fields").alias("field", "value"))
    return cells.where(F.col("value").isNotNull())


def p1_ingredients(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of ingredients joined to the product each belongs to, by the links alone."""
    return _ingredients(shred.shred(table(spark, sf, "openfda_drugsfda"), "record_id", ["products", "submissions"], APPLICATION_LAYOUT))


def p1_ingredients_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same table over both sources: applications, and the payloads of documents."""
    applications = p1_ingredients(spark, sf).withColumn("source_table", F.lit("openfda_drugsfda"))
    payloads = spread(table(spark, sf, "documents").select("doc_id", "structured").where(F.col("structured").isNotNull()))
    documents = _ingredients(shred.shred(payloads, "doc_id", "structured", APPLICATION_LAYOUT))
    return applications.unionByName(documents.withColumn("source_table", F.lit("documents")))


def _ingredients(flat: DataFrame) -> DataFrame:
    products = shred.flat_table(flat, APPLICATION_LAYOUT, "products").select(F.col("record_key").alias("_r"), F.col("pos").alias("_p"), "product_number", "brand_name")
    parts = shred.flat_table(flat, APPLICATION_LAYOUT, "products.active_ingredients")
    joined = parts.join(products, (F.col("record_key") == F.col("_r")) & (F.col("parent_pos") == F.col("_p")))
    return joined.select("record_key", "product_number", "brand_name", "pos", "name", "strength")


# ---------------------------------------------------------------- 2 history


def _deliveries(spark: SparkSession, sf: str, attributes: tuple[str, ...]) -> DataFrame:
    """(caseid, caseversion, quarter, start, attributes) of every delivered row."""
    demo = table(spark, sf, "faers_demo").where(F.col("caseid").isNotNull() & F.col("caseversion").isNotNull())
    start = history.start_of(F.col("fda_dt_raw"), F.col("fda_dt_prec"), F.col("fda_dt"), F.col("quarter"))
    code = F.coalesce(F.nullif(F.upper(F.trim("i_f_code")), F.lit("")), F.lit("?"))
    return demo.select("caseid", "caseversion", "quarter", start.alias("start"), *[code.alias(a) if a == "i_f_code" else F.col(a) for a in attributes])


def demo_versions(spark: SparkSession, sf: str, attributes: tuple[str, ...]) -> DataFrame:
    return history.latest_delivery(_deliveries(spark, sf, attributes), ["caseid", "caseversion"], ["quarter"])


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.coalesce(F.col("valid_to").cast("string"), F.lit("open")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    whole = history.history(demo_versions(spark, sf, ("i_f_code",)), "caseid", "caseversion", "start", ("i_f_code",))
    return _days(whole).select("caseid", "caseversion", "i_f_code", "valid_from", "valid_to")


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    whole = history.history(demo_versions(spark, sf, DEMO_ATTRIBUTES), "caseid", "caseversion", "start", DEMO_ATTRIBUTES)
    return _days(whole)


def p2_store(spark: SparkSession, sf: str) -> DataFrame:
    """How the history is stored: versions, checkpoints and attribute values kept, per case."""
    chains = history.stripe(demo_versions(spark, sf, DEMO_ATTRIBUTES), "caseid", "caseversion", ["start"], DEMO_ATTRIBUTES)
    values = F.aggregate("chain", F.lit(0), lambda n, x: n + sum(x["patch"][a].isNotNull().cast("int") for a in DEMO_ATTRIBUTES))
    return chains.groupBy(F.col("entity").alias("caseid")).agg(F.sum(F.size("chain").cast("long")).alias("versions"), F.count("*").alias("checkpoints"), F.sum(values.cast("long")).alias("values_kept"))


def _appended(spark: SparkSession, sf: str) -> history.HistoryStore:
    """A store written from the first half of the quarters, to which every later quarter is appended as it arrives."""
    rows = _deliveries(spark, sf, DEMO_ATTRIBUTES)
    quarters = sorted(r[0] or "" for r in rows.select("quarter").distinct().collect())  # one value for each delivery
    begun = quarters[: max(1, len(quarters) // 2)]
    kept = history.HistoryStore(spark, scratch(spark, "history"), "caseid", "caseversion", "start", ["quarter"], DEMO_ATTRIBUTES)
    delivered = F.coalesce("quarter", F.lit(""))
    for batch in [begun, *[[q] for q in quarters[len(begun) :]]]:
        kept.append(rows.where(delivered.isin(*batch)))
    return kept


def p2_append(spark: SparkSession, sf: str) -> DataFrame:
    """The whole history out of a written store to which quarters were appended one by one."""
    return _days(_appended(spark, sf).history())


AS_OF = "2025-02-15"


def p2_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The version of every case valid on a day, read from the written store."""
    return _appended(spark, sf).as_of(F.lit(AS_OF).cast("date"))


# ---------------------------------------------------------------- 3 orphans


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    children = {name: table(spark, sf, name) for name in ("faers_drug", "faers_reac")}
    return orphans.explain_orphans(children, table(spark, sf, "faers_demo"), table(spark, sf, "load_reject"), table(spark, sf, "faers_deleted_case"), "faers_demo", "quarter", "primaryid", "caseid")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The direct orphans of the cascade; ``p3_orphans`` reports the inherited ones beside them."""
    return _orphans(spark, sf).where(F.col("kind") == "direct").drop("kind")


def p3_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan keys per child table, quarter, kind and cause, inherited ones being those whose report is of a withdrawn case."""
    return _orphans(spark, sf).groupBy("child_table", "kind", "quarter", "cause").agg(F.count("*").alias("keys"))


def p3_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of a case refer to the version before them in the same table: chains broken by a missing one, by depth."""
    demo = table(spark, sf, "faers_demo").where(F.col("caseid").isNotNull() & F.col("caseversion").isNotNull())
    before = F.when(F.col("caseversion") > 1, F.col("caseversion") - 1)
    versions = demo.select("caseid", "caseversion", before.alias("previous"))
    graph = [orphans.Reference("version", ("caseid", "previous"), "version", ("caseid", "caseversion"), optional=True)]
    return orphans.cascade({"version": versions}, graph).drop("period")


def p3_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Drug and reaction rows whose report is missing, and reports whose case was withdrawn, per quarter.

    A report of a withdrawn case refers to a case that is gone (direct); its drug and reaction rows are orphaned with it (inherited).
    """
    demo = table(spark, sf, "faers_demo").select("quarter", "primaryid", "caseid")
    gone = table(spark, sf, "faers_deleted_case").select(F.col("caseid").alias("_c")).dropna().distinct()
    cases = demo.select("caseid").dropna().distinct().join(gone, F.col("caseid") == F.col("_c"), "left_anti")
    tables = {"case": cases, "faers_demo": demo} | {n: table(spark, sf, n).select("quarter", "primaryid") for n in ("faers_drug", "faers_reac")}
    graph = [orphans.Reference("faers_demo", ("caseid",), "case", ("caseid",))]
    graph += [orphans.Reference(n, ("quarter", "primaryid"), "faers_demo", ("quarter", "primaryid")) for n in ("faers_drug", "faers_reac")]
    return orphans.cascade(tables, graph, {n: "quarter" for n in ("faers_demo", "faers_drug", "faers_reac")})


# ---------------------------------------------------------------- 4 snapshot changes


def _study_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("snapshot", "nct_id", "aact_updated_at")]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    studies = table(spark, sf, "aact_studies")
    found = snapdiff.snapshot_changes(studies, "snapshot", F.upper("nct_id"), "aact_updated_at", _study_columns(studies))
    return found.select(F.col("snapshot").cast("string").alias("snapshot"), F.col("key").alias("nct_id"), "change")


def p4_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot and field, how many studies changed in it."""
    studies = table(spark, sf, "aact_studies")
    columns = _study_columns(studies)
    found = snapdiff.snapshot_changes(studies, "snapshot", F.upper("nct_id"), "aact_updated_at", columns)
    cells = snapdiff.changed_fields(studies, found, "snapshot", F.upper("nct_id"), "aact_updated_at", columns)
    return cells.groupBy(F.col("snapshot").cast("string").alias("snapshot"), "field").agg(F.count("*").alias("studies"))


# ---------------------------------------------------------------- 6 rejects


def member_delimiter():
    return F.when(F.col("table_name").startswith("aact_"), "|").otherwise("$")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    judged = delimited_rejects.judge_members(table(spark, sf, "raw_member_line"), member_delimiter())
    return judged.where(F.col("cause").isNotNull()).select("load_id", "line_no", "cause")


def p6_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The loadable lines with their fields by column name, as JSON."""
    judged = delimited_rejects.judge_members(table(spark, sf, "raw_member_line"), member_delimiter(), fields=True)
    return judged.where(F.col("cause").isNull()).select("load_id", "table_name", "line_no", F.to_json("values").alias("fields"))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p1_ingredients, p1_ingredients_all, p2_found, p2_history, p2_store, p2_append, p2_asof, p3_found, p3_orphans, p3_tree, p3_cascade, p4_found, p4_fields, p6_found, p6_loaded)}
