import zipfile

import pytest
from pyspark.sql import functions as F

from sedimenta import cli
from sedimenta.operators import gates
from sedimenta.operators.load import Warehouse, first_arrivals, upsert
from sedimenta.sources import delimited
from sedimenta.sources.tables import GRAINS, PARENTS, TableSpec, case_report_specs, spec_of, study_specs
from sedimenta.sources.zip_lines import ZipLines, find_member, member_lines

QUARTER = "2099Q1"
DEMO = "primaryid$caseid$caseversion$i_f_code$event_dt$fda_dt$mfr_sndr$age\r\n1000$10$1$I$202401$20240301$A$5\r\n1001$10$2$F$2024$20240305$B \"x$\r\n2000$20$1$I$$20240101$C$7\r\nnotanid$30$1$I$$20240101$C$7\r\n"
REAC = "primaryid$caseid$pt$drug_rec_act\n1000$10$Rash$\n2000$20$Fall$\n9999$99$Pain$\nnotanid$30$Pain$\n"


def archive(tmp_path, name="a.zip", demo=DEMO, method=zipfile.ZIP_DEFLATED):
    path = str(tmp_path / name)
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("ascii/demo99q1.txt", "﻿" + demo)
        z.writestr("ASCII/REAC99Q1.txt", REAC)
        z.writestr("Deleted/DELETED99Q1.txt", "20\n")
        z.writestr("folder/", "")
    return path


def test_zip_lines(spark, tmp_path):
    path = archive(tmp_path)
    assert find_member(["x/A.txt", "b.txt"], "b.txt") == "b.txt" and find_member(["x/A.txt"], "q/a.TXT") == "x/A.txt" and find_member(["a/"], "a") is None
    spark.dataSource.register(ZipLines)
    df = spark.read.format("zip_lines").option("path", path).option("members", "ASCII/DEMO99Q1.txt|nothing.txt|Deleted/DELETE99Q1.txt;Deleted/DELETED99Q1.txt").load()
    got = sorted(map(tuple, df.select("member", "line_no", "line").collect()))
    assert got[0] == ("Deleted/DELETED99Q1.txt", 1, "20") and got[1][2].startswith("primaryid$") and len(got) == 6
    assert spark.read.format("zip_lines").option("path", str(tmp_path)).load().select("member").distinct().count() == 3


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_lines_across_chunks(tmp_path, method, monkeypatch):
    import sedimenta.sources.zip_lines as z

    monkeypatch.setattr(z, "CHUNK", 5)
    path = archive(tmp_path, demo="ab\r\n\ncdefghijkl\n\xff\r\r\nend", method=method)
    assert list(member_lines(path, "ascii/demo99q1.txt")) == [(1, "ab"), (2, ""), (3, "cdefghijkl"), (4, "\xff\r"), (5, "end")]


def test_parser_micro_cases(spark):
    spec = TableSpec("t", "|", "p", "t.txt", "id", (("id", "string"), ("name", "string"), ("n", "int")))
    lines = [(1, "  "), (2, " ID | Name | extra "), (3, "1|ada|x"), (4, ""), (5, "2||x"), (6, "NCT02|a | split"), (7, "a|b|c|d"), (8, " |z|y"), (9, '"3|q"|w'), (10, "x" * 3000)]
    df = spark.createDataFrame([("a", "m", n, x) for n, x in lines], "archive string, member string, line_no bigint, line string")
    parsed = delimited.parse(df, spec, ["archive", "member"])
    good = [(r["line_no"], r["id"], r["name"], r["n"]) for r in delimited.loadable(parsed).orderBy("line_no").collect()]
    assert good == [(3, "1", "ada", None), (5, "2", None, None), (6, "NCT02", "a", None), (9, '"3', 'q"', None)]
    bad = [(r["line_no"], r["reason"], len(r["raw_line"])) for r in delimited.rejected(parsed, ["archive", "member"]).orderBy("line_no").collect()]
    assert bad == [(7, "expected 3 fields, got 4", 7), (8, "id is empty", 5), (10, "expected 3 fields, got 1", 2000)]
    assert delimited.parse(df, spec, ["archive", "member"], limit=3).count() == 3
    told = TableSpec("t", "|", "p", "t.txt", "id", (("id", "bigint"),), ("id",))
    one = delimited.parse(df.where("line_no = 3").withColumn("line", F.lit("x'y")), told, ["archive", "member"]).first()
    assert one["reason"] == "id='x'y' is not an integer"


def test_specs_grains_and_parents_agree():
    specs = {s.table: s for s in [*case_report_specs(QUARTER), *study_specs()]}
    assert case_report_specs(QUARTER)[0].table == "faers_demo" and len(specs) == 13
    for table, grain in GRAINS.items():
        if table != "faers_case_current":
            assert set(grain.key) <= set(specs[table].names)
    for child, (parent, keys) in PARENTS.items():
        assert set(keys) <= set(specs[child].names) & set(specs[parent].names)
    assert len(spec_of("aact_studies").columns) == 30


def test_whole_life_of_a_load(spark, tmp_path):
    path, store = archive(tmp_path), Warehouse(spark, str(tmp_path / "w"))
    assert cli.main(["--warehouse", store.path, "load-reports", f"{path}={QUARTER}"], spark) == 0
    demo = {r["primaryid"]: r for r in store.read("faers_demo").collect()}
    assert len(demo) == 3 and demo[1001]["fda_dt"].isoformat() == "2024-03-05" and demo[1000]["event_dt_prec"] == "month" and demo[1000]["event_dt"] is None and demo[1001]["mfr_sndr"] == 'B "x'
    rejects = store.read("load_reject").collect()
    assert {(r["table_name"], r["key_hint"], r["reason"]) for r in rejects} == {("faers_demo", "notanid", "primaryid='notanid' is not an integer"), ("faers_reac", "notanid", "primaryid='notanid' is not an integer")}
    current = {r["caseid"]: r for r in store.read("faers_case_current").collect()}
    assert (current[10]["primaryid"], current[10]["n_versions"], current[10]["superseded"], current[10]["is_deleted"]) == (1001, 2, 1, False) and current[20]["is_deleted"]

    cli.main(["--warehouse", store.path, "load-reports", f"{path}={QUARTER}"], spark)
    assert store.read("faers_demo").count() == 3 and store.runs().where("table_name = 'faers_demo'").count() == 2
    report = tmp_path / "r.md"
    report.write_text("old\n<!-- notes below this line are kept -->\nmy notes\n")
    assert cli.main(["--warehouse", store.path, "gates", "--report", str(report)], spark) == 1
    assert "my notes" in report.read_text() and "| integrity | FAIL |" in report.read_text()
    results = {g.name: g for g in gates.run_gates(store.tables(list(GRAINS)), store.runs(), store.read("load_reject"))}
    assert [n for n, g in results.items() if not g.passed] == ["integrity"]
    assert results["integrity"].failures[0]["orphan_keys"] == 1 and results["grain"].rows_checked == 3 + 1 + 2 + 3
    assert results["rejects"].detail[0]["reasons"] == ["primaryid='notanid' is not an integer ×1"]


def test_ledger_retires_stale_runs_and_records_errors(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    first = store.open_run("s", "p", "t")
    second = store.open_run("s", "p", "t")
    assert {r["id"]: r["status"] for r in store.runs().collect()} == {first: "abandoned", second: "running"}
    spec = spec_of("faers_reac", QUARTER)
    bad = spark.range(1).select(F.lit("a").alias("archive"))
    with pytest.raises(Exception, match="(?i)line"):
        store.load(bad, spec, "faers", QUARTER)
    assert store.runs().where("table_name = 'faers_reac' AND status = 'error'").count() == 1


def test_reject_cap_and_empty_partition(spark, tmp_path):
    store, spec = Warehouse(spark, str(tmp_path / "w")), spec_of("faers_reac", QUARTER)
    lines = lambda rows: spark.createDataFrame([("a", "m", i, x) for i, x in enumerate(rows, 1)], "archive string, member string, line_no bigint, line string")
    head = "primaryid$caseid$pt$drug_rec_act"
    done = store.load(lines([head, "1$1$a$", *["x$1$a$"] * 6]), spec, "faers", QUARTER, keep_rejects=4)
    assert (done.read, done.loaded, done.rejected) == (7, 1, 6) and "4 of 6" in done.notes and store.read("load_reject").count() == 4
    again = store.load(lines([head]), spec, "faers", QUARTER)
    assert again.read == 0 and not store.exists(f"faers_reac/quarter={QUARTER}")


def test_upsert_and_first_arrivals(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 3, "d"), (3, 1, None), (3, 1, None)], "k int, t int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"], ["t"]).collect())) == [(1, 5, "a"), (2, 3, "d"), (3, 1, None)]
    assert sorted(map(tuple, first_arrivals(new, ["k"], ["t"]).collect())) == [(2, 1, "c"), (3, 1, None)]


def test_command_line_checks():
    parse = cli.parser().parse_args
    with pytest.raises(SystemExit):
        parse(["--warehouse", "w", "load-studies", "z", "--snapshot", "2024-01-02"])
    import argparse
    import datetime as dt

    with pytest.raises(argparse.ArgumentTypeError):
        cli.quarter("2024Q5")
    assert cli.previous_month(dt.date(2024, 1, 15)) == "2023-12-01"


def test_command_line_refresh_search_and_keys(spark, tmp_path, capsys):
    import json

    landing = tmp_path / "land"
    landing.mkdir()
    trial = {"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "Treated asthma"}, "statusModule": {"lastUpdateSubmitDate": "2024-01-01"}}}
    (landing / "1.json").write_text(json.dumps(trial))
    home = ["--warehouse", str(tmp_path / "w")]
    assert cli.main([*home, "search", "asthma"], spark) == 1
    assert cli.main([*home, "refresh", f"clinical={landing}"], spark) == 0 and cli.main([*home, "refresh", f"clinical={landing}", "--full"], spark) == 0
    assert cli.main([*home, "search", "asthma treatment or treating", "-k", "3"], spark) == 0
    assert "NCT1" in capsys.readouterr().out
    assert cli.main([*home, "keys", "issue", "--plan", "big"], spark) == 0
    key = capsys.readouterr().out.strip()
    assert cli.main([*home, "keys", "list"], spark) == 0 and "big active" in capsys.readouterr().out
    assert cli.main([*home, "keys", "revoke", "--key", key], spark) == 0 and cli.main([*home, "keys", "revoke", "--key", key], spark) == 1
    assert cli.main([*home, "keys", "list"], spark) == 0 and "big revoked" in capsys.readouterr().out
