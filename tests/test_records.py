import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sedimenta.sources import records

AS_OF = dt.datetime(2024, 5, 5)


def run(spark, source, *raws):
    raw = [r if isinstance(r, str) else json.dumps(r) for r in raws]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    rows = records.NORMALIZERS[source](df, F.lit(AS_OF)).collect()
    return [(r, json.loads(r["structured"])) for r in rows]


def test_trials(spark):
    full = {
        "protocolSection": {
            "identificationModule": {"nctId": "NCT00000001", "briefTitle": "A title", "officialTitle": "An official title"},
            "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-01"}, "lastUpdatePostDateStruct": {"date": "2023-02"}},
            "designModule": {"phases": ["PHASE2", "PHASE3"]},
            "conditionsModule": {"conditions": ["asthma"]},
            "armsInterventionsModule": {"interventions": [{"name": "Drug A"}, {"name": ""}, {"type": "x"}, None]},
            "descriptionModule": {"briefSummary": " sum "},
            "eligibilityModule": {"eligibilityCriteria": "e" * 400},
        }
    }
    (row, s), (bare, t) = run(spark, "clinical", full, {})
    assert row["doc_id"] == "NCT00000001" and row["embed_text"] == "A title sum " + "e" * 300 and row["updated_at"] == dt.datetime(2023, 2, 1)
    assert s["phase"] == "PHASE2" and s["interventions"] == ["Drug A"] and s["brief_summary"] == "sum" and s["start_date"] == "2020-01"
    assert bare["title"] == "(no title)" and bare["url"] == "" and bare["updated_at"] == AS_OF and t["interventions"] == [] and t["phase"] is None


@pytest.mark.parametrize(
    ("elements", "name"),
    [
        ("Amlodipine Besylate amlodipine besylate AMLODIPINE", "Amlodipine Besylate"),
        ("Ofloxacin Ofloxacin OFLOXACIN OFLOXACIN Sodium", "Ofloxacin"),
        ("Cold Relief Extra CAMPHOR MENTHOL", "Cold Relief Extra"),
        ("ALL CAPS NAME OF SOME LONG PRODUCT HERE", "ALL CAPS NAME OF SOME LONG"),
        ("Balm, balm,", "Balm"),
        ("Herbal 30C ARNICA", "Herbal 30C"),
        ("", "(unnamed label)"),
    ],
)
def test_label_titles(spark, elements, name):
    assert run(spark, "openfda_label", {"id": "x", "spl_product_data_elements": [elements]})[0][0]["title"] == name


def test_labels(spark):
    raw = {"id": "L1", "version": "2", "effective_time": "20230105", "warnings_and_cautions": ["care"], "indications_and_usage": [" use "], "openfda": {"brand_name": ["Brand"], "generic_name": ["gen"], "spl_set_id": ["S1"]}}
    (row, s), (bare, t) = run(spark, "openfda_label", raw, {"id": "x"})
    assert (row["title"], row["embed_text"], row["updated_at"]) == ("Brand", "Brand gen use care", dt.datetime(2023, 1, 5)) and row["url"].endswith("setid=S1")
    assert s["has_warnings"] and s["has_indications"] and not s["has_boxed_warning"] and s["route"] == []
    assert bare["title"] == bare["embed_text"] == "(unnamed label)" and t["set_id"] == ""


def test_events(spark):
    raw = {"safetyreportid": "77", "receivedate": "20240102", "serious": "1", "patient": {"patientonsetage": "50", "reaction": [{"reactionmeddrapt": "Rash"}], "drug": [{"medicinalproduct": "A", "drugcharacterization": "1", "drugindication": "Pain"}, {"medicinalproduct": "B", "drugcharacterization": "9"}, None]}, "primarysource": {"reportercountry": "US"}}
    (row, s), (bare, _) = run(spark, "openfda_event", raw, {"safetyreportid": "78", "receivedate": "20241301"})
    assert row["title"] == "A → Rash" and row["embed_text"] == "A | B | Rash | Pain" and s["drugs"][0]["role"] == "suspect" and s["drugs"][1]["role"] == "unknown" and s["reporter_country"] == "US"
    assert bare["title"] == bare["embed_text"] == "(unknown drug) → (unspecified reaction)" and bare["updated_at"] == AS_OF


def test_recalls(spark):
    (row, s), (bare, _) = run(spark, "openfda_enforcement", {"recall_number": "D-1", "classification": "Class I", "recalling_firm": "F", "reason_for_recall": " r ", "code_info": "c", "report_date": "20200101", "openfda": {"route": ["ORAL"]}}, {})
    assert row["title"] == "Class I — F" and row["embed_text"] == "r | c" and s["openfda"] == {"route": ["ORAL"]}
    assert bare["title"] == "(unclassified) — (unknown firm)"


def test_applications(spark):
    raw = {
        "application_number": "ANDA012345",
        "sponsor_name": "Firm",
        "products": [{"brand_name": None, "marketing_status": "B"}, {"brand_name": "Br", "marketing_status": "A", "active_ingredients": [{"name": "ing", "strength": "1MG"}]}, None],
        "submissions": [{"submission_status": "TA", "submission_status_date": "20030505"}, {"submission_status": "AP", "submission_status_date": "20150713"}, {"submission_status_date": "soon"}],
        "openfda": {"generic_name": ["gen"]},
    }
    (row, s), (bare, t) = run(spark, "openfda_drugsfda", raw, {"application_number": "77"})
    assert row["title"] == "Br" and row["embed_text"] == "Br gen ing Firm" and row["updated_at"] == dt.datetime(2015, 7, 13) and row["url"].endswith("ApplNo=012345")
    assert s["application_type"] == "ANDA (generic)" and s["is_approved"] and s["marketing_statuses"] == ["A", "B"] and s["latest_submission_status_date"] == "20150713" and len(s["products"]) == 2
    assert bare["title"] == "77" and t["application_type"] == "(unknown)" and not t["has_products"] and bare["url"].endswith("ApplNo=77")


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2023</Year><Month>Jul</Month><Day>31</Day></PubDate></JournalIssue></Journal>
<ArticleTitle>On <i>EGFR</i>-mutated disease</ArticleTitle><Abstract><AbstractText Label="AIM">To <sub>x</sub> see.</AbstractText><AbstractText> </AbstractText><AbstractText>End.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author/></AuthorList><ELocationID EIdType="pii">p</ELocationID><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Lung</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2021 Jul-Aug</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID/><Article/></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles(spark):
    (row, s), (bare, t) = run(spark, "pubmed", XML, "<broken", "")
    assert s["title"] == "On EGFR-mutated disease" and s["abstract"] == "AIM: To x see.\nEnd." and s["authors"] == ["Jo Doe", "Group"] and s["doi"] == "10.1/x" and s["pubdate"] == "2023 Jul 31"
    assert row["embed_text"] == "On EGFR-mutated disease\nAIM: To x see.\nEnd.\nLung\nk" and row["updated_at"] == dt.datetime(2023, 7, 28)
    assert bare["title"] == "(untitled article)" and bare["updated_at"] == dt.datetime(2021, 1, 1) and not t["has_abstract"]


def test_usable_and_since(spark):
    df = spark.createDataFrame([("a", "x", dt.date(2024, 1, 1)), ("", "x", None), ("b", " \t", dt.date(2024, 1, 3))], "doc_id string, embed_text string, day date")
    assert [r["doc_id"] for r in records.usable(df).collect()] == ["a"]
    assert records.since(df, "day", F.lit("2024-01-03 12:00:00").cast("timestamp")).count() == 1 and records.since(df, "day", None).count() == 3
