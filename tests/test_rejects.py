import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.sources import delimited_rejects as dr


def fields_of(line, d):
    """Fields by a hand-written automaton, or None if the quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != d:
                return None
        else:
            j = line.find(d, i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def real_date(v):
    import datetime

    if not re.fullmatch("[0-9]{4}|[0-9]{6}|[0-9]{8}", v, re.ASCII) or not 1900 <= int(v[:4]) <= 2100:
        return False
    try:
        datetime.date(int(v[:4]), int(v[4:6] or 1), int(v[6:8] or 1))
    except ValueError:
        return False
    return True


def cause_of(line, columns, d):
    fields = fields_of(line, d)
    if fields is None:
        return "quoting"
    if len(fields) != len(columns):
        return "columns"
    for c, v in zip(columns, (f.strip() for f in fields)):
        if c in ("primaryid", "caseid", "id") and not re.fullmatch("[0-9]+", v, re.ASCII):
            return "value"
        if c == "nct_id" and not re.fullmatch("NCT[0-9]{8}", v, re.ASCII):
            return "value"
        if c.endswith("_dt") and v and not real_date(v):
            return "value"
    return None


COLUMNS = ["id", "name", "x_dt"]
piece = st.sampled_from(['"', '""', "$", "a", " ", "1", "12", "20240229", "20230229", "190013", "1899", "é", "\\", "²", "\t"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=9).map("".join).filter(str.strip), min_size=1, max_size=20))
def test_judge_equals_the_automaton(lines):
    causes, values = dr.judge(lines, COLUMNS, "$", re.compile(dr.field_pattern("$")), True)
    assert causes == [cause_of(x, COLUMNS, "$") for x in lines]
    for line, cause, row in zip(lines, causes, values):
        if cause is None:
            assert row == [f.strip() or None for f in fields_of(line, "$")]


def test_dates():
    import pyarrow as pa

    cells = ["20240229", "20230229", "19000228", "19000229", "20000229", "21001231", "21010101", "189912", "202413", "202412", "2024", "24", "", "2024-01-01", "20240431"]
    assert dr.is_date(pa.array(cells)).to_pylist() == [real_date(c) for c in cells]


def test_members_headers_and_odd_lines(spark):
    lines = [
        (1, "t", 1, " \r"), (1, "t", 2, "﻿ ID $ Name $x_DT \r"), (1, "t", 3, "1$a$\r"), (1, "t", 4, ""), (1, "t", 5, None), (1, "t", 6, '2$"b$c"$2024'), (1, "t", 7, "x$a$"), (1, "t", 8, '3$"b'), (1, "t", 9, "4$a"),
        (1, "t", 10, "5$" + "w" * 300_000 + "$"), (1, "t", 10, "5$a$"), (2, "t", 1, "x_dt$id$name"), (2, "t", 2, "20240101$7$n"), (2, "t", 3, "7$20240101$n"), (3, "aact_t", 1, "id|nct_id"), (3, "aact_t", 2, "1|NCT12345678"), (3, "aact_t", 3, "1|nct12345678"), (4, "t", 1, "  "), (5, None, 1, "id"), (5, None, 2, "8"),
    ]
    df = spark.createDataFrame([(*x, "clash", 0) for x in lines], "load_id bigint, table_name string, line_no bigint, raw_line string, header string, salt int")
    delimiter = F.when(F.col("table_name").startswith("aact_"), "|").otherwise("$")
    got = dr.judge_members(df, delimiter, fields=True).collect()
    causes = sorted((r["load_id"], r["line_no"], r["cause"] or "") for r in got)
    assert causes == [(1, 3, ""), (1, 6, ""), (1, 7, "value"), (1, 8, "quoting"), (1, 9, "columns"), (1, 10, ""), (1, 10, ""), (2, 2, ""), (2, 3, "value"), (3, 2, ""), (3, 3, "value"), (5, 2, "")]
    assert next(r for r in got if r["line_no"] == 6)["values"] == {"id": "2", "name": "b$c", "x_dt": "2024"}
    assert dr.judge_members(df.limit(0), delimiter).count() == 0
