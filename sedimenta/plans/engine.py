"""Queries of the engine's own operators over the test tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions import scalars, text, vectors
from sedimenta.operators import cases, context, gates, load, search, status
from sedimenta.operators.orphans import Reference, profile
from sedimenta.session import cut, table
from sedimenta.sources import delimited, records
from sedimenta.sources.tables import TableSpec, spec_of

CASE_TABLES = ("faers_demo", "faers_drug", "faers_reac", "faers_deleted_case")
#: Every query that needs a present moment takes this one, so that runs repeat.
NOW = "2025-06-30 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

#: Written queries for full text; a search has few of them, whatever the corpus.
TOPICS = ((1, "patients who received treatment"), (2, "blood pressure in older patients"), (3, "dose of the tablets"), (4, "recall of the product"), (5, "chronic kidney disease"), (6, "the of and"), (7, "serum potassium"))


def _tables(spark: SparkSession, sf: str, names) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names}


def _now(text_: str = NOW):
    return F.lit(text_).cast("timestamp")


# ---------------------------------------------------------------- cases and gates


def case_current(spark: SparkSession, sf: str) -> DataFrame:
    out = cases.current_cases(table(spark, sf, "faers_demo"), table(spark, sf, "faers_deleted_case"))
    return out.withColumn("fda_dt", F.col("fda_dt").cast("string"))


def case_current_kept(spark: SparkSession, sf: str) -> DataFrame:
    return cases.without_deleted(case_current(spark, sf)).select("caseid", "primaryid")


def grain(spark: SparkSession, sf: str) -> DataFrame:
    tables = _tables(spark, sf, (*CASE_TABLES, "aact_studies"))
    tables["faers_case_current"] = cases.current_cases(tables["faers_demo"], tables["faers_deleted_case"])
    return gates.grain_profiles(tables)


def grain_orders(spark: SparkSession, sf: str) -> DataFrame:
    parts = [gates.grain_profile(table(spark, sf, "orders"), ["o_orderkey"], "orders", True), gates.grain_profile(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")]
    return parts[0].unionByName(parts[1])


def conservation_runs(spark: SparkSession, sf: str) -> DataFrame:
    return gates.unbalanced_runs(table(spark, sf, "load_run"))


def conservation_tables(spark: SparkSession, sf: str) -> DataFrame:
    return gates.claimed_rows(table(spark, sf, "load_run"), _tables(spark, sf, (*CASE_TABLES, "aact_studies")))


def dedup_conservation(spark: SparkSession, sf: str) -> DataFrame:
    demo = table(spark, sf, "faers_demo")
    return gates.dedup_numbers(demo, cases.current_cases(demo, table(spark, sf, "faers_deleted_case")))


def integrity(spark: SparkSession, sf: str) -> DataFrame:
    demo, rejects = table(spark, sf, "faers_demo"), table(spark, sf, "load_reject")
    parts = [gates.orphan_profile(table(spark, sf, c), demo, rejects, ("quarter", "primaryid"), c, "faers_demo") for c in ("faers_drug", "faers_reac")]
    return parts[0].unionByName(parts[1])


def integrity_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The whole key graph of order lines, orders, customers, suppliers and places: rows checked and orphans of every reference."""
    graph = [Reference("nation", ("n_regionkey",), "region", ("r_regionkey",)), Reference("customer", ("c_nationkey",), "nation", ("n_nationkey",)), Reference("supplier", ("s_nationkey",), "nation", ("n_nationkey",))]
    graph += [Reference("orders", ("o_custkey",), "customer", ("c_custkey",)), Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), Reference("lineitem", ("l_partkey",), "part", ("p_partkey",)), Reference("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",))]
    return profile(_tables(spark, sf, {n for r in graph for n in (r.child, r.parent)}), graph)


def reject_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gates.reject_summary(table(spark, sf, "load_run"))


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return gates.top_reasons(table(spark, sf, "load_run"), table(spark, sf, "load_reject"))


def reject_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gates.reject_totals(table(spark, sf, "load_run"), table(spark, sf, "load_reject"))


def date_precision(spark: SparkSession, sf: str) -> DataFrame:
    return gates.precision_report(_tables(spark, sf, CASE_TABLES))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    names = (*CASE_TABLES, "aact_studies", "load_run", "load_reject")
    return gates.inventory(_tables(spark, sf, names), dict.fromkeys(CASE_TABLES, "quarter") | {"aact_studies": "snapshot", "load_run": "partition", "load_reject": "partition"})


# ---------------------------------------------------------------- scalars and parsing


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct date as written, of all date columns in one scan, and what it is read as."""
    names = ("event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_dt")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_raw").alias("text")) for c in names]))
    counted = table(spark, sf, "faers_demo").select(cells.alias("x")).groupBy("x.field", "x.text").agg(F.count("*").alias("n"))
    raw, prec, exact = scalars.partial_date(F.col("text"))
    read = counted.select("field", raw.alias("raw"), prec.alias("prec"), exact.cast("string").alias("exact"), "n")
    return read.groupBy("field", "raw", "prec", "exact").agg(F.sum("n").alias("n"))


def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    demo = table(spark, sf, "faers_demo").select("age", "wt", "e_sub")
    row = demo.groupBy("age", "wt", "e_sub").agg(F.count("*").alias("n"))
    return row.select("age", "wt", "e_sub", scalars.integer(F.col("age")).alias("age_int"), scalars.number(F.col("wt")).alias("wt_num"), scalars.boolean(F.col("e_sub")).alias("e_sub_flag"), "n")


def delimited_split(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all running members read without quoting: kept and rejected lines per member and reason."""
    lines = table(spark, sf, "raw_member_line").select(F.col("load_id").cast("string").alias("archive"), F.col("table_name").alias("member"), "line_no", F.regexp_replace("raw_line", r"^\x{FEFF}|\r$", "").alias("line"))
    parts = []
    for name in ("faers_demo", "faers_reac", "aact_sponsors"):
        parsed = delimited.parse(lines.where(F.col("member") == name), spec_of(name), ["archive", "member"])
        parts.append(parsed.groupBy("archive", "member", "reason").agg(F.count("*").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def part_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as delimited lines, some with a delimiter too many, and read back."""
    part = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("|x"))).otherwise(F.col("p_name"))
    lines = part.select(F.lit("a").alias("archive"), F.lit("part").alias("member"), F.col("p_partkey").alias("line_no"), F.concat_ws("|", F.col("p_partkey").cast("string"), name, "p_brand", F.col("p_size").cast("string")).alias("line"))
    spec = TableSpec("part", "|", "p", "part.txt", "id", (("id", "bigint"), ("name", "string"), ("brand", "string"), ("size", "int")), ("id", "name", "brand", "size"))
    return delimited.parse(lines, spec, ["archive", "member"]).select("line_no", "reason", "key_hint", "id", "name", "brand", "size")


def normalize_applications(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "openfda_drugsfda")
    docs = records.application_document(df, _now())
    j = lambda path: F.get_json_object("structured", f"$.{path}").alias(path)
    return docs.select("doc_id", "title", "embed_text", "url", j("application_type"), j("is_approved"), j("marketing_statuses"), j("latest_submission_status_date"), j("has_products"), F.col("updated_at").cast("date").cast("string").alias("updated"))


def _payloads(spark: SparkSession, sf: str, source: str) -> tuple[DataFrame, object]:
    """Documents of a source whose payload is JSON, and a function that reads a path of it."""
    docs = table(spark, sf, "documents").where((F.col("source") == source) & F.try_parse_json("structured").isNotNull())
    return docs, lambda path: F.get_json_object("structured", f"$.{path}")


def _list(path) -> object:
    return F.from_json(path, "array<string>")


def normalize_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trials, written as records of the registry out of the payloads, and normalized again."""
    docs, j = _payloads(spark, sf, "clinical")
    names = F.transform(_list(j("interventions")), lambda x: F.struct(x.alias("name")))
    record = F.struct(
        F.struct(j("nct_id").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"),
        F.struct(j("status").alias("overallStatus"), F.col("updated_at").cast("date").cast("string").alias("lastUpdateSubmitDate")).alias("statusModule"),
        F.struct(F.array(j("phase")).alias("phases")).alias("designModule"),
        F.struct(_list(j("conditions")).alias("conditions")).alias("conditionsModule"),
        F.struct(names.alias("interventions")).alias("armsInterventionsModule"),
    )
    out = records.trials(docs.select(F.to_json(F.struct(record.alias("protocolSection"))).alias("raw")), _now())
    k = lambda path: F.get_json_object("structured", f"$.{path}")
    return out.select("doc_id", "title", "url", F.col("updated_at").cast("date").cast("string").alias("updated"), k("status").alias("status"), k("phase").alias("phase"), F.size(_list(k("conditions"))).alias("conditions"), F.size(_list(k("interventions"))).alias("interventions"))


def normalize_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, written as records out of the payloads, and normalized again."""
    docs, j = _payloads(spark, sf, "openfda_label")
    harmonized = F.struct(_list(j("brand_name")).alias("brand_name"), _list(j("generic_name")).alias("generic_name"), _list(j("route")).alias("route"))
    boxed = F.when(j("has_boxed_warning") == "true", F.array(F.lit("boxed")))
    record = F.struct(F.col("native_id").alias("id"), j("set_id").alias("set_id"), j("version").alias("version"), F.date_format("updated_at", "yyyyMMdd").alias("effective_time"), boxed.alias("boxed_warning"), F.array("title").alias("spl_product_data_elements"), harmonized.alias("openfda"))
    out = records.labels(docs.where(F.size(F.coalesce(_list(j("brand_name")), F.array().cast("array<string>"))) > 0).select(F.to_json(record).alias("raw")), _now())
    k = lambda path: F.get_json_object("structured", f"$.{path}")
    return out.select("doc_id", "title", "url", F.col("updated_at").cast("date").cast("string").alias("updated"), k("version").alias("version"), k("has_boxed_warning").alias("boxed"))


def normalize_events(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of adverse events, written as records out of the payloads, and normalized again: roles by code, titles by drug and reaction."""
    docs, j = _payloads(spark, sf, "openfda_event")
    code = lambda role: F.when(role == "suspect", "1").when(role == "concomitant", "2").when(role == "interacting", "3")
    # elements that are no objects are left out
    objects = F.filter(_list(j("drugs")), lambda d: d.startswith("{"))
    given = F.transform(objects, lambda d: F.from_json(d, "struct<name:string,role:string,indication:string,authorization_number:string>"))
    arms = F.transform(given, lambda d: F.struct(d["name"].alias("medicinalproduct"), code(d["role"]).alias("drugcharacterization"), d["indication"].alias("drugindication"), d["authorization_number"].alias("drugauthorizationnumb")))
    reactions = F.transform(_list(j("reactions")), lambda x: F.struct(x.alias("reactionmeddrapt")))
    record = F.struct(j("safetyreportid").alias("safetyreportid"), j("serious").alias("serious"), F.date_format("updated_at", "yyyyMMdd").alias("receivedate"), F.struct(j("patient.age").alias("patientonsetage"), reactions.alias("reaction"), arms.alias("drug")).alias("patient"))
    out = records.events(docs.where(j("drugs").startswith("[") & j("reactions").startswith("[")).select(F.to_json(record).alias("raw")), _now())
    k = lambda path: F.get_json_object("structured", f"$.{path}")
    roles = F.transform(F.from_json(k("drugs"), "array<struct<role:string>>"), lambda d: d["role"])
    return out.select("doc_id", "title", "url", F.col("updated_at").cast("date").cast("string").alias("updated"), k("serious").alias("serious"), F.array_join(roles, ",").alias("roles"))


def normalize_recalls(spark: SparkSession, sf: str) -> DataFrame:
    """Recalls, written as records out of the payloads, and normalized again."""
    docs, j = _payloads(spark, sf, "openfda_enforcement")
    record = F.struct(*[j(x).alias(x) for x in ("recall_number", "classification", "status", "recalling_firm")], F.date_format("updated_at", "yyyyMMdd").alias("report_date"), F.col("title").alias("reason_for_recall"))
    out = records.recalls(docs.select(F.to_json(record).alias("raw")), _now())
    k = lambda path: F.get_json_object("structured", f"$.{path}")
    return out.select("doc_id", "title", "url", F.col("updated_at").cast("date").cast("string").alias("updated"), k("status").alias("status"), k("recalling_firm").alias("firm"))


def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    """JSON paths projected out of the documents' payloads."""
    docs = table(spark, sf, "documents").where(F.col("source") == "clinical")
    j = lambda path, name: F.get_json_object("structured", f"$.{path}").alias(name)
    return docs.select("doc_id", j("nct_id", "nct_id"), j("status", "status"), j("interventions[0]", "first_intervention"), F.col("native_id").rlike(r"^NCT\d{8}$").alias("good_id"))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Digest, short key, age in words, secret masking and an excerpt for every document."""
    docs = table(spark, sf, "documents")
    url = F.concat(F.lit("https://x.test/q?api_key="), F.col("native_id"), F.lit("&id="), F.col("doc_id").cast("string"))
    return docs.select("doc_id", scalars.key_digest(F.col("native_id")).alias("digest"), F.left(scalars.key_digest(F.col("native_id")), F.lit(12)).alias("key_id"), scalars.age_of(F.col("ingested_at"), _now()).alias("age"), scalars.redact_secret(url).alias("url"), F.left("text", F.lit(40)).alias("head"))


# ---------------------------------------------------------------- retrieval


def knn(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20, against all."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = search.nearest(rows.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id"), rows, 10)
    return near.withColumn("similarity", F.round("similarity", 6))


def knn_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors within each label, for the same queries, in one scan."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = search.nearest(rows.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id"), rows, 3, within="label")
    return near.withColumn("similarity", F.round("similarity", 6))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat_ws(" ", "title", "text")
    return table(spark, sf, "documents").select("doc_id", "source", text.plain_terms(body).alias("terms"))


def _topics(docs: DataFrame, topics: tuple, every: bool) -> DataFrame:
    only = sorted({t for _, q in topics for t in text.analyze(q, False)})
    index = search.postings(docs, "doc_id", "terms", only)
    return search.term_matches(index, search.query_terms(list(topics), docs), "doc_id", every, by_rarest=False)


def _searched(spark: SparkSession, sf: str, every: bool) -> DataFrame:
    return search.top(_topics(_terms(spark, sf), TOPICS, every), 10, "rank", "doc_id", ["query_id"])


def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, True).withColumn("rank", F.round("rank", 6))


def fts_or(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, False).withColumn("rank", F.round("rank", 6))


def fts_language(spark: SparkSession, sf: str) -> DataFrame:
    """One query with phrase, alternative and exclusion over stemmed terms."""
    docs = table(spark, sf, "documents").select("doc_id", text.stemmed_terms(F.concat_ws(" ", "title", "text")).alias("terms"))
    return search.search_text(docs, '"heart failure" or asthma -placebo treated', 20).select("doc_id", "rank")


LANGUAGE = '"heart failure" or asthma -placebo dose'


def fts_plain_language(spark: SparkSession, sf: str) -> DataFrame:
    """One query with phrase, alternative and exclusion over unstemmed terms: every document that matches."""
    parsed = text.parse_query(LANGUAGE, stem=False)
    docs = _terms(spark, sf)
    return docs.where(text.matches(parsed, F.col("terms"))).select("doc_id")


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and lexical arms fused, for the vectors whose id is divisible by 20, over documents that have one.

    The lexical arm of a query are the words of its own document's title.
    """
    docs = _terms(spark, sf)
    embedded = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    scope = docs.join(embedded, "doc_id")
    asked = scope.where(F.col("doc_id") % 20 == 0)
    titles = table(spark, sf, "documents").select("doc_id", F.array_distinct(text.plain_terms(F.col("title"))).alias("q"))
    words = asked.join(titles, "doc_id").select(F.col("doc_id").alias("query_id"), F.size("q").alias("wanted"), F.explode("q").alias("term"))
    lexical = search.term_matches(search.postings(scope, "doc_id", "terms"), words, "doc_id", True)
    fused = search.hybrid(asked.select(F.col("doc_id").alias("query_id"), "embedding"), scope, lexical, 10)
    return fused.select("query_id", "doc_id", "place", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def trial_context(spark: SparkSession, sf: str) -> DataFrame:
    """For each trial and each of the first five drugs it lists, the three best documents of every other source that name the drug."""
    return _trial_context(spark, sf, 5)


def trial_context_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every drug a trial lists, however many."""
    return _trial_context(spark, sf, None)


def _trial_context(spark: SparkSession, sf: str, most: int | None) -> DataFrame:
    docs = table(spark, sf, "documents")
    valid = docs.where((F.col("source") == "clinical") & F.col("structured").isNotNull())
    names = F.from_json(F.get_json_object("structured", "$.interventions"), "array<string>")
    listed = context.mentioned(valid.select("doc_id", names.alias("names")).withColumnRenamed("doc_id", "trial"), "trial", "names", most)
    others = _terms(spark, sf).where(F.col("source").startswith("openfda_"))
    return context.context(listed, "trial", others, "doc_id", "source", "terms", 3).withColumn("rank", F.round("rank", 6))


def drug_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, reports and recalls about the brand of every label whose id is divisible by 20."""
    docs = table(spark, sf, "documents")
    brand = F.get_json_object("structured", "$.brand_name[0]")
    labels = docs.where((F.col("source") == "openfda_label") & (F.col("doc_id") % 20 == 0)).select(brand.alias("name")).where(F.col("name").isNotNull()).distinct()
    named = labels.select("name", F.array_distinct(text.plain_terms(F.col("name"))).alias("terms"))
    return context.profiles(named, _terms(spark, sf)).withColumn("rank", F.round("rank", 6))


def safety_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of every profile with their title, an excerpt and the flags that their payload sets."""
    docs = table(spark, sf, "documents")
    j = lambda path: F.get_json_object("structured", f"$.{path}")
    flags = scalars.set_flags({"boxed warning": F.when(j("has_boxed_warning") == "true", "1"), "serious": j("serious")})
    told = docs.select("doc_id", "title", scalars.excerpt(F.col("text"), "take", 0, 160).alias("excerpt"), F.array_join(flags, ",").alias("flags"))
    return drug_profiles(spark, sf).select("name", "source", "doc_id", "place").join(told, "doc_id")


def drug_profiles_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, reports and recalls about the same brands, by vector and terms fused."""
    docs = table(spark, sf, "documents")
    brand = F.get_json_object("structured", "$.brand_name[0]")
    labels = docs.where((F.col("source") == "openfda_label") & (F.col("doc_id") % 20 == 0)).select("doc_id", brand.alias("name")).where(F.col("name").isNotNull())
    named = labels.groupBy("name").agg(F.min("doc_id").alias("query_id")).withColumn("terms", F.array_distinct(text.plain_terms(F.col("name"))))
    bodies = docs.select("doc_id", "source", F.concat_ws(" ", "title", "text").alias("body")).withColumn("terms", text.plain_terms(F.col("body")))
    found = context.fused_profiles(named, bodies)
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("score", F.round("score", 6))


def trial_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Articles for every trial whose id is divisible by 20, by its conditions, interventions and title."""
    docs = table(spark, sf, "documents")
    j = lambda path: F.from_json(F.get_json_object("structured", f"$.{path}"), "array<string>").alias(path)
    trials = docs.where((F.col("source") == "clinical") & (F.col("doc_id") % 20 == 0)).select(F.col("doc_id").alias("query_id"), "title", j("conditions"), j("interventions"))
    questions = trials.select("query_id", context.question_of("title", "conditions", "interventions").alias("question"))
    articles = docs.where(F.col("source") == "pubmed").select("doc_id", F.concat_ws(" ", "title", "text").alias("body")).withColumn("terms", text.plain_terms(F.col("body")))
    found = context.evidence(questions, articles)
    return context.cite(found, docs).select("query_id", "doc_id", "place", "citation")


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.coalesce("native_id", F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("embed_text"))
    return load.ingest_counts(docs)


def source_state(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "load_run").select(F.concat_ws("/", "source", "table_name").alias("source"), "status", F.struct(F.col("started_at"), F.col("id")).alias("at"), "started_at", F.col("notes").alias("error"))
    return status.source_state(events).withColumn("last_success", F.col("last_success").cast("string"))


def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """hit@k and mean reciprocal rank of known items: every document whose id is divisible by 20 is sought by the words of its title in the texts alone."""
    docs = table(spark, sf, "documents")
    bodies = docs.select("doc_id", text.plain_terms(F.col("text")).alias("terms"))
    sought = docs.where((F.col("doc_id") % 20 == 0) & F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.array_distinct(text.plain_terms(F.col("title"))).alias("q")).where(F.size("q") > 0)
    words = sought.select("query_id", F.size("q").alias("wanted"), F.explode("q").alias("term"))
    index = cut(search.postings(bodies, "doc_id", "terms", among=words))
    ranked = search.top(search.term_matches(index, words, "doc_id", True), 10, "rank", "doc_id", ["query_id"])
    return status.retrieval_scores(ranked.select("query_id", "doc_id", "place"), sought.select("query_id", F.col("query_id").alias("doc_id")))


# ---------------------------------------------------------------- status, freshness, limits


def corpus_status(spark: SparkSession, sf: str) -> DataFrame:
    counts = status.corpus_counts(table(spark, sf, "documents"), _now())
    state = table(spark, sf, "load_run").where(F.col("status") == "success").groupBy("source").agg(F.max("finished_at").alias("last_success"))
    out = status.corpus_status(counts, state, _now("2026-03-01 00:00:00"))
    return out.withColumn("newest", F.col("newest").cast("string")).withColumn("last_success", F.col("last_success").cast("string"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("key"), F.col("ts").alias("created_at"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))


def usage_7d(spark: SparkSession, sf: str) -> DataFrame:
    return status.usage(_calls(spark, sf), _now(EVENTS_NOW), 7)


def access_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Why calls are refused, by tool: keys are customers, plans their segments, inactive ones in debt; every tenth user sends no key."""
    calls = _calls(spark, sf)
    sent = calls.select("tool", F.when(F.col("key").cast("bigint") % 10 != 0, F.col("key")).alias("key"))
    keys = table(spark, sf, "customer").where(F.col("c_custkey") % 7 != 0).select(scalars.key_digest(F.col("c_custkey").cast("string")).alias("key_hash"), F.col("c_mktsegment").alias("plan"), (F.col("c_acctbal") >= 0).alias("active"))
    used = status.rolling_use(calls.withColumn("key_hash", scalars.key_digest(F.col("key"))), _now(EVENTS_NOW), F.lit(None), 30, "key_hash").select("key_hash", "used")
    told = status.decide_access(sent, keys, used, {"AUTOMOBILE": 60, "BUILDING": 40, "MACHINERY": None}, "BUILDING", ("signup",), ("purchase",), ("AUTOMOBILE",))
    return told.groupBy("tool", "reason").agg(F.count("*").alias("calls"))


def rolling_30d(spark: SparkSession, sf: str) -> DataFrame:
    return status.rolling_use(_calls(spark, sf), _now(EVENTS_NOW), F.lit(60), 30)


def due_sources(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "load_run")
    state = runs.groupBy("source", "partition", "table_name").agg(F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))
    cadence = F.when(F.col("source") == "faers", "weekly").when(F.col("source") == "aact", "daily").otherwise("manual")
    return status.due(state.withColumn("cadence", cadence), _now("2026-01-05 12:00:00")).select("source", "partition", "table_name", "cadence", "due")


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents taken in two batches by year of ingestion: what arrives later replaces what is there."""
    docs = table(spark, sf, "documents").where(F.col("native_id").isNotNull()).select("source", "native_id", "ingested_at", "doc_id", "n_chars")
    first = load.upsert(None, docs.where(F.col("ingested_at") < F.lit("2025-01-01")), ["source", "native_id"], ["ingested_at", "doc_id"])
    return load.upsert(first, docs.where(F.col("ingested_at") >= F.lit("2025-01-01")), ["source", "native_id"], ["ingested_at", "doc_id"]).select("source", "native_id", "doc_id", "n_chars")


def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(F.col("native_id").isNotNull()).select("source", "native_id", "doc_id", "ingested_at")
    return load.first_arrivals(docs, ["source", "native_id"], ["doc_id"]).select("source", "native_id", "doc_id")


def newest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest documents of each source, undated ones last."""
    order = W.partitionBy("source").orderBy(F.desc_nulls_last("updated_at"), "doc_id")
    docs = table(spark, sf, "documents").select("source", "doc_id", "updated_at")
    return docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 5).select("source", "doc_id", "place")


def demo_selection(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    themes = search.top(_topics(_terms(spark, sf), TOPICS[:3], True), 20, "rank", "doc_id", ["query_id"])
    return status.select_budget(docs.select("source", "doc_id", "updated_at"), "source", "doc_id", F.col("doc_id") % 500 == 1, themes.select("doc_id", F.col("place").alias("rank")), "updated_at", 30)


def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of each label's vectors to the label's first vector, in plain column expressions."""
    rows = table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("seed"))
    joined = rows.join(first, "label")
    return joined.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.cosine_distance(F.col("embedding"), F.col("seed"))), 6).alias("mean_distance"))


QUERIES = {
    f.__name__: f
    for f in (case_current, case_current_kept, grain, grain_orders, conservation_runs, conservation_tables, dedup_conservation, integrity, integrity_orders, reject_summary, reject_reasons, reject_totals, date_precision, inventory, parse_dates, parse_numbers, delimited_split, part_lines, normalize_applications, normalize_trials, normalize_labels, normalize_events, normalize_recalls, payload_fields, event_props, text_scalars, knn, knn_per_label, fts_and, fts_or, fts_language, fts_plain_language, hybrid, trial_context, trial_context_all, drug_profiles, safety_profiles, drug_profiles_fused, trial_evidence, ingest_counts, source_state, retrieval_eval, corpus_status, usage_7d, access_ladder, rolling_30d, due_sources, upsert_documents, first_documents, newest_documents, demo_selection, label_vectors)
}
