"""Normalizers: records of six public sources into one document shape.

Each takes a DataFrame of raw records and gives (source_id, doc_id, title, embed_text, structured, url,
updated_at); ``structured`` is JSON. JSON records come as a string column ``raw`` and are read with an explicit schema;
article sets come as XML text. Dates that cannot be read become ``as_of``, an argument, so that runs repeat.
Records without an id or without any text to embed are dropped by ``usable``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import scalars

COLUMNS = ("source_id", "doc_id", "title", "embed_text", "structured", "url", "updated_at")


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _passed(raw: DataFrame) -> list[str]:
    """A column ``arrived``, if there is one, stays with the documents; it orders repeated deliveries."""
    return ["arrived"] if "arrived" in raw.columns else []


def _document(df: DataFrame, source: str, doc_id: Column, title: Column, embed: Column, structured: Column, url: Column, updated: Column, as_of: Column) -> DataFrame:
    embed = F.coalesce(_text(embed), title)
    body = F.to_json(structured, {"ignoreNullFields": "false"})
    return df.select(*_passed(df), F.lit(source).alias("source_id"), F.coalesce(doc_id, F.lit("")).alias("doc_id"), title.alias("title"), embed.alias("embed_text"), body.alias("structured"), url.alias("url"), F.coalesce(updated, as_of).alias("updated_at"))


def usable(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("doc_id") != "") & (scalars.strip(F.col("embed_text")) != ""))


# ---------------------------------------------------------------- trials

TRIAL = """struct<protocolSection:struct<
 identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,
 statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,lastUpdateSubmitDate:string,lastUpdatePostDateStruct:struct<date:string>>,
 designModule:struct<phases:array<string>>, conditionsModule:struct<conditions:array<string>>,
 armsInterventionsModule:struct<interventions:array<struct<name:string>>>,
 descriptionModule:struct<briefSummary:string>, eligibilityModule:struct<eligibilityCriteria:string>>>"""


def trials(raw: DataFrame, as_of: Column) -> DataFrame:
    df = raw.select(F.from_json("raw", TRIAL)["protocolSection"].alias("p"), *_passed(raw))
    p = lambda path: F.col(f"p.{path}")
    nct = F.coalesce(p("identificationModule.nctId"), F.lit(""))
    title = F.coalesce(_text(p("identificationModule.briefTitle")), F.lit("(no title)"))
    summary, criteria = (F.coalesce(scalars.strip(p(x)), F.lit("")) for x in ("descriptionModule.briefSummary", "eligibilityModule.eligibilityCriteria"))
    names = F.filter(F.transform(p("armsInterventionsModule.interventions"), lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    structured = F.struct(
        nct.alias("nct_id"),
        p("identificationModule.officialTitle").alias("official_title"),
        p("statusModule.overallStatus").alias("status"),
        F.try_element_at(p("designModule.phases"), F.lit(1)).alias("phase"),
        _array(p("conditionsModule.conditions")).alias("conditions"),
        _array(names).alias("interventions"),
        _text(summary).alias("brief_summary"),
        _text(criteria).alias("eligibility_criteria"),
        p("statusModule.startDateStruct.date").alias("start_date"),
    )
    updated = scalars.day_or_month(F.coalesce(_text(p("statusModule.lastUpdateSubmitDate")), p("statusModule.lastUpdatePostDateStruct.date")))
    url = F.when(nct != "", F.concat(F.lit("https://clinicaltrials.gov/study/"), nct)).otherwise("")
    return _document(df, "clinical", nct, title, scalars.strip(F.concat_ws(" ", title, summary, F.left(criteria, F.lit(300)))), structured, url, updated, as_of)


# ---------------------------------------------------------------- labels

LABEL = """struct<id:string,set_id:string,version:string,effective_time:string,spl_product_data_elements:array<string>,
 indications_and_usage:array<string>,boxed_warning:array<string>,warnings:array<string>,warnings_and_cautions:array<string>,
 contraindications:array<string>,adverse_reactions:array<string>,
 openfda:struct<spl_set_id:array<string>,brand_name:array<string>,generic_name:array<string>,manufacturer_name:array<string>,
 product_ndc:array<string>,product_type:array<string>,route:array<string>,substance_name:array<string>,unii:array<string>>>"""
MOST_TITLE_WORDS, MOST_TITLE_CHARS = 6, 80


def leading_name(elements: Column) -> Column:
    """A product name out of a run of words: the leading phrase of up to six words that repeats at once, without
    case; else the words before the first all-capital one, immediate repeats dropped; else the first six."""
    words = F.filter(F.split(elements, r"(?U)\s+"), lambda w: w != "")
    folded = F.transform(words, F.lower)
    sizes = F.filter(F.sequence(F.lit(1), F.lit(MOST_TITLE_WORDS)), lambda k: (k * 2 <= F.size(words)) & (F.slice(folded, F.lit(1), k) == F.slice(folded, k + 1, k)))
    repeated = F.slice(words, F.lit(1), F.try_element_at(sizes, F.lit(1)))
    loud = F.transform(words, lambda w: (F.length(F.regexp_replace(w, r"\P{L}", "")) >= 2) & (F.upper(w) == w) & (F.lower(w) != w))
    first_loud = F.array_position(loud, True)
    lead = F.slice(words, F.lit(1), F.when(first_loud > 0, first_loud - 1).otherwise(F.size(words)).cast("int"))
    lone = F.filter(lead, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.try_element_at(lead, F.greatest(i, F.lit(1))))))
    chosen = F.when(F.size(sizes) > 0, repeated).when(F.size(lone) > 0, F.slice(lone, 1, MOST_TITLE_WORDS)).otherwise(F.slice(words, 1, MOST_TITLE_WORDS))
    return F.regexp_replace(F.left(F.array_join(chosen, " "), F.lit(MOST_TITLE_CHARS)), r"[\s,;]+$", "")


def labels(raw: DataFrame, as_of: Column) -> DataFrame:
    df = raw.select(F.from_json("raw", LABEL).alias("r"), *_passed(raw))
    r, o = (lambda x: F.col(f"r.{x}")), (lambda x: F.col(f"r.openfda.{x}"))
    set_id = F.coalesce(_text(scalars.first_text(o("spl_set_id"))), r("set_id"), F.lit(""))
    named = _text(leading_name(scalars.first_text(r("spl_product_data_elements"))))
    title = F.coalesce(_text(scalars.first_text(o("brand_name"))), _text(scalars.first_text(o("generic_name"))), named, F.lit("(unnamed label)"))
    warnings = F.when(F.size(_array(r("warnings"))) > 0, r("warnings")).otherwise(r("warnings_and_cautions"))
    embed = scalars.join_texts(o("brand_name"), o("generic_name"), r("indications_and_usage"), r("boxed_warning"), warnings, r("contraindications"), r("adverse_reactions"))
    has = lambda c: F.size(_array(c)) > 0
    structured = F.struct(
        F.coalesce(r("id"), F.lit("")).alias("id"),
        set_id.alias("set_id"),
        *[_array(o(x)).alias(x) for x in ("brand_name", "generic_name", "manufacturer_name", "product_ndc", "product_type", "route", "substance_name", "unii")],
        r("effective_time").alias("effective_time"),
        r("version").alias("version"),
        has(r("boxed_warning")).alias("has_boxed_warning"),
        has(r("indications_and_usage")).alias("has_indications"),
        has(warnings).alias("has_warnings"),
    )
    url = F.when(set_id != "", F.concat(F.lit("https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid="), set_id)).otherwise("")
    return _document(df, "openfda_label", r("id"), title, embed, structured, url, scalars.compact_day(r("effective_time")), as_of)


# ---------------------------------------------------------------- event reports

EVENT_FLAGS = ("serious", "seriousnessdeath", "seriousnesshospitalization", "seriousnesslifethreatening", "seriousnessdisabling", "seriousnesscongenitalanomal", "seriousnessother")
EVENT = f"""struct<safetyreportid:string,safetyreportversion:string,receivedate:string,receiptdate:string,transmissiondate:string,
 {",".join(f"{f}:string" for f in EVENT_FLAGS)},
 patient:struct<patientonsetage:string,patientsex:string,patientweight:string,reaction:array<struct<reactionmeddrapt:string>>,
 drug:array<struct<medicinalproduct:string,drugcharacterization:string,drugindication:string,drugauthorizationnumb:string>>>,
 primarysource:struct<reportercountry:string,qualification:string>>"""
# Fixed role codes.
ROLES = {"1": "suspect", "2": "concomitant", "3": "interacting"}


def role_of(code: Column) -> Column:
    out = None
    for k, v in ROLES.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise("unknown")


def events(raw: DataFrame, as_of: Column) -> DataFrame:
    df = raw.select(F.from_json("raw", EVENT).alias("r"), *_passed(raw))
    r, p = (lambda x: F.col(f"r.{x}")), (lambda x: F.col(f"r.patient.{x}"))
    arms = F.filter(F.coalesce(p("drug"), F.array()), lambda d: d.isNotNull())
    filled = lambda a: F.filter(a, lambda x: x.isNotNull() & (scalars.strip(x) != ""))
    drugs = filled(F.transform(arms, lambda d: d["medicinalproduct"]))
    reactions = filled(F.transform(F.coalesce(p("reaction"), F.array()), lambda x: x["reactionmeddrapt"]))
    indications = filled(F.transform(arms, lambda d: d["drugindication"]))
    head = lambda a, default: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(default))
    title = F.concat(head(drugs, "(unknown drug)"), F.lit(" → "), head(reactions, "(unspecified reaction)"))
    kept = F.transform(arms, lambda d: F.struct(d["medicinalproduct"].alias("name"), role_of(d["drugcharacterization"]).alias("role"), d["drugindication"].alias("indication"), d["drugauthorizationnumb"].alias("authorization_number")))
    structured = F.struct(
        *[r(x).alias(x) for x in ("safetyreportid", "safetyreportversion", "receivedate", "receiptdate", "transmissiondate", *EVENT_FLAGS)],
        F.struct(p("patientonsetage").alias("age"), p("patientsex").alias("sex"), p("patientweight").alias("weight")).alias("patient"),
        r("primarysource.reportercountry").alias("reporter_country"),
        r("primarysource.qualification").alias("reporter_qualification"),
        kept.alias("drugs"),
        reactions.alias("reactions"),
    )
    url = F.concat(F.lit('https://api.fda.gov/drug/event.json?search=safetyreportid:"'), F.coalesce(r("safetyreportid"), F.lit("")), F.lit('"'))
    embed = F.array_join(F.concat(drugs, reactions, indications), " | ")
    return _document(df, "openfda_event", r("safetyreportid"), title, embed, structured, url, scalars.compact_day(r("receivedate")), as_of)


# ---------------------------------------------------------------- recalls

RECALL_FIELDS = ("recall_number", "event_id", "classification", "status", "voluntary_mandated", "report_date", "recall_initiation_date", "center_classification_date", "termination_date", "recalling_firm", "address_1", "address_2", "city", "state", "country", "reason_for_recall", "product_description", "code_info", "product_quantity")
RECALL = f"struct<{','.join(f'{f}:string' for f in (*RECALL_FIELDS, 'more_code_info'))},openfda:map<string,array<string>>>"


def recalls(raw: DataFrame, as_of: Column) -> DataFrame:
    df = raw.select(F.from_json("raw", RECALL).alias("r"), *_passed(raw))
    r = lambda x: F.col(f"r.{x}")
    title = F.concat(F.coalesce(_text(r("classification")), F.lit("(unclassified)")), F.lit(" — "), F.coalesce(_text(r("recalling_firm")), F.lit("(unknown firm)")))
    embed = F.concat_ws(" | ", *[_text(scalars.strip(r(x))) for x in ("reason_for_recall", "product_description", "code_info", "more_code_info")])
    structured = F.struct(*[r(x).alias(x) for x in RECALL_FIELDS], F.coalesce(r("openfda"), F.create_map().cast("map<string,array<string>>")).alias("openfda"))
    url = F.concat(F.lit('https://api.fda.gov/drug/enforcement.json?search=recall_number:"'), F.coalesce(r("recall_number"), F.lit("")), F.lit('"'))
    return _document(df, "openfda_enforcement", r("recall_number"), title, embed, structured, url, scalars.compact_day(r("report_date")), as_of)


# ---------------------------------------------------------------- applications

APPLICATION = """struct<application_number:string,sponsor_name:string,
 products:array<struct<product_number:string,brand_name:string,dosage_form:string,route:string,marketing_status:string,active_ingredients:array<struct<name:string,strength:string>>>>,
 submissions:array<struct<submission_type:string,submission_number:string,submission_status:string,submission_status_date:string,submission_class_code_description:string>>,
 openfda:struct<brand_name:array<string>,generic_name:array<string>,substance_name:array<string>,manufacturer_name:array<string>,product_ndc:array<string>,route:array<string>,unii:array<string>>>"""
# Fixed application types.
APPLICATION_TYPES = {"ANDA": "ANDA (generic)", "NDA": "NDA (brand)", "BLA": "BLA (biologic)"}


def application_type(number: Column) -> Column:
    prefix = F.upper(F.regexp_extract(F.coalesce(number, F.lit("")), "^[A-Za-z]+", 0))
    out = F.when(prefix == "", "(unknown)")
    for k, v in APPLICATION_TYPES.items():
        out = out.when(prefix == k, v)
    return out.otherwise(prefix)


def application_document(df: DataFrame, as_of: Column) -> DataFrame:
    """Documents out of typed columns application_number, sponsor_name, products, submissions and openfda."""
    have = {f.name for f in df.schema["openfda"].dataType.fields}
    o = lambda x: F.col(f"openfda.{x}") if x in have else F.lit(None).cast("array<string>")
    number, sponsor = F.coalesce("application_number", F.lit("")), F.coalesce("sponsor_name", F.lit(""))
    products = F.filter(F.coalesce("products", F.array()), lambda p: p.isNotNull())
    submissions = F.filter(F.coalesce("submissions", F.array()), lambda s: s.isNotNull())
    filled = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    brands = filled(F.transform(products, lambda p: p["brand_name"]))
    ingredients = filled(F.flatten(F.transform(products, lambda p: F.transform(F.filter(F.coalesce(p["active_ingredients"], F.array()), lambda i: i.isNotNull()), lambda i: i["name"]))))
    title = F.coalesce(F.try_element_at(brands, F.lit(1)), _text(scalars.first_text(o("brand_name"))), _text(scalars.first_text(o("generic_name"))), _text(number), F.lit("(unnamed application)"))
    embed = scalars.join_texts(brands, o("generic_name"), o("substance_name"), ingredients, F.array(sponsor))
    dates = F.filter(F.transform(submissions, lambda s: s["submission_status_date"]), lambda d: d.rlike("^[0-9]+$"))
    latest = F.array_max(dates)
    parts = ("product_number", "brand_name", "dosage_form", "route", "marketing_status")
    steps = ("submission_type", "submission_number", "submission_status", "submission_status_date", "submission_class_code_description")
    structured = F.struct(
        number.alias("application_number"),
        application_type(number).alias("application_type"),
        _text(sponsor).alias("sponsor_name"),
        F.exists(submissions, lambda s: F.coalesce(s["submission_status"] == "AP", F.lit(False))).alias("is_approved"),
        F.array_sort(F.array_distinct(filled(F.transform(products, lambda p: p["marketing_status"])))).alias("marketing_statuses"),
        latest.alias("latest_submission_status_date"),
        F.transform(products, lambda p: F.struct(*[p[x].alias(x) for x in parts], F.filter(F.coalesce(p["active_ingredients"], F.array()), lambda i: i.isNotNull()).alias("active_ingredients"))).alias("products"),
        F.transform(submissions, lambda s: F.struct(*[s[x].alias(x) for x in steps])).alias("submissions"),
        F.when(F.size(_array(o("brand_name"))) > 0, o("brand_name")).otherwise(brands).alias("brand_name"),
        *[_array(o(x)).alias(x) for x in ("generic_name", "substance_name", "manufacturer_name", "product_ndc", "route", "unii")],
        (F.size(products) > 0).alias("has_products"),
    )
    digits = F.regexp_extract(number, r"\d+", 0)
    url = F.when(digits != "", F.concat(F.lit("https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?event=overview.process&ApplNo="), digits)).otherwise("")
    return _document(df, "openfda_drugsfda", number, title, embed, structured, url, scalars.compact_day(latest), as_of)


def applications(raw: DataFrame, as_of: Column) -> DataFrame:
    return application_document(raw.select(F.from_json("raw", APPLICATION).alias("r"), *_passed(raw)).select("r.*", *_passed(raw)), as_of)


# ---------------------------------------------------------------- articles

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def _flat(node) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def publication_day(node) -> tuple[dt.date | None, str]:
    """(day, as shown): year, month by name or number and day, clamped to real months and to day 28; a free
    text date gives its leading year."""
    if node is None:
        return None, ""
    year, month, day, free = (_flat(node.find(x)) for x in ("Year", "Month", "Day", "MedlineDate"))
    if not year:
        lead = re.match(r"\d{4}", free)
        return (dt.date(int(lead[0]), 1, 1) if lead and int(lead[0]) > 0 else None), free
    m = MONTHS.get(month[:3].lower()) or (int(month) if month.isascii() and month.isdigit() else 1)
    d = int(day) if day.isascii() and day.isdigit() else 1
    shown = " ".join(x for x in (year, month, day) if x)
    if not (year.isascii() and year.isdigit() and 1 <= int(year) <= 9999):
        return None, shown
    return dt.date(int(year), min(max(m, 1), 12), min(max(d, 1), 28)), shown


def article(node) -> dict | None:
    """One article as a flat record, or None if it has no id."""
    citation = node.find("MedlineCitation")
    body = citation.find("Article") if citation is not None else None
    if body is None or not _flat(citation.find("PMID")):
        return None
    sections = []
    for part in body.iterfind("Abstract/AbstractText"):
        if text := _flat(part):
            sections.append(f"{part.get('Label')}: {text}" if part.get("Label") else text)
    authors = []
    for a in body.iterfind("AuthorList/Author"):
        last, fore, group = (_flat(a.find(x)) for x in ("LastName", "ForeName", "CollectiveName"))
        if last or group:
            authors.append(f"{fore} {last}".strip() if last else group)
    ids = [(e.get("EIdType"), _flat(e)) for e in body.iterfind("ELocationID")]
    ids += [(e.get("IdType"), _flat(e)) for e in node.iterfind("PubmedData/ArticleIdList/ArticleId")]
    day, shown = publication_day(body.find("Journal/JournalIssue/PubDate"))
    each = lambda root, path: [t for e in root.iterfind(path) if (t := _flat(e))]
    return {
        "pmid": _flat(citation.find("PMID")),
        "title": _flat(body.find("ArticleTitle")) or "(untitled article)",
        "abstract": "\n".join(sections) or None,
        "journal": _flat(body.find("Journal/Title")) or None,
        "pubdate": shown or None,
        "authors": authors,
        "doi": next((v for k, v in ids if k == "doi" and v), None),
        "mesh_terms": each(citation, "MeshHeadingList/MeshHeading/DescriptorName"),
        "keywords": each(citation, "KeywordList/Keyword"),
        "publication_types": each(body, "PublicationTypeList/PublicationType"),
        "has_abstract": bool(sections),
        "_day": day,
    }


def articles_of(xml: str | None) -> list[dict]:
    """Articles of one set; text that is not XML gives none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    return [a for node in root.iterfind("PubmedArticle") if (a := article(node))]


def articles(raw: DataFrame, as_of: Column) -> DataFrame:
    """Documents out of article sets, XML in the column ``raw``; a set may hold many articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, at) for xml, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a in articles_of(xml)]
            arrived, found = [at for _, at in found], [a for a, _ in found]
            days = [a.pop("_day") for a in found]
            embed = ["\n".join(x for x in (a["title"], a["abstract"], " ".join(a["mesh_terms"]), " ".join(a["keywords"])) if x) for a in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a["pmid"] for a in found], pa.string()), pa.array([a["title"] for a in found], pa.string()), pa.array(embed, pa.string()), pa.array([json.dumps(a, ensure_ascii=False) for a in found], pa.string()), pa.array(days, pa.date32()), pa.array(arrived, pa.timestamp("us", "UTC"))],
                names=["doc_id", "title", "embed_text", "structured", "day", "arrived"],
            )

    at = F.col("arrived") if "arrived" in raw.columns else F.lit(None).cast("timestamp")
    parsed = raw.select("raw", at.cast("timestamp").alias("at")).mapInArrow(run, "doc_id string, title string, embed_text string, structured string, day date, arrived timestamp")
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("doc_id"), F.lit("/"))
    return parsed.select(*_passed(raw), F.lit("pubmed").alias("source_id"), "doc_id", "title", "embed_text", "structured", url.alias("url"), F.coalesce(F.col("day").cast("timestamp"), as_of).alias("updated_at"))


NORMALIZERS = {"clinical": trials, "openfda_label": labels, "openfda_event": events, "openfda_enforcement": recalls, "openfda_drugsfda": applications, "pubmed": articles}
#: How often each source is refreshed, unless a configuration says otherwise.
CADENCES = {s: "daily" if s == "openfda_event" else "weekly" for s in NORMALIZERS}


def landed(spark, path: str) -> DataFrame:
    """Raw records of a landing folder: one JSON object per line, or whole XML files."""
    return spark.read.text(path, wholetext=path.rstrip("/").endswith("xml")).withColumnRenamed("value", "raw")


def since(df: DataFrame, column: str, mark: Column | None) -> DataFrame:
    """Records at or after a high-water mark, by day."""
    return df if mark is None else df.where(F.col(column) >= mark.cast("date"))
