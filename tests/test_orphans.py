from sedimenta.operators.orphans import Reference, cascade, explain_orphans, fixpoint, profile


def test_cascade_is_direct_then_inherited(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "a": make([(1,)], "id int"),
        "b": make([(10, 1), (11, 2), (12, None), (11, 2)], "id int, a int"),
        "c": make([(100, 10), (101, 11), (102, 99), (103, 11)], "id int, b int"),
        "d": make([(1000, 101, "p"), (1001, 100, "p"), (1002, 102, None)], "id int, c int, period string"),
    }
    graph = [Reference("b", ("a",), "a", ("id",)), Reference("c", ("b",), "b", ("id",)), Reference("d", ("c",), "c", ("id",))]
    got = {(r["child_table"], r["depth"], r["period"]): (r["kind"], r["orphan_rows"], r["orphan_keys"]) for r in cascade(tables, graph, {"d": "period"}).collect()}
    assert got == {
        ("b", 0, None): ("direct", 3, 2),
        ("c", 0, None): ("direct", 1, 1),
        ("c", 1, None): ("inherited", 2, 1),
        ("d", 2, "p"): ("inherited", 1, 1),
        ("d", 1, None): ("inherited", 1, 1),
    }


def test_self_references_and_cycles(spark):
    # employees and managers: 9 is missing, so 1 is an orphan and 2 and 3 inherit; 4 and 5 manage each other, 6 is above itself, 7 has nobody
    people = spark.createDataFrame([(1, 9), (2, 1), (3, 2), (3, 2), (4, 5), (5, 4), (6, 6), (7, None)], "id int, boss int")
    graph = [Reference("p", ("boss",), "p", ("id",), optional=True)]
    got = {(r["__k0"], r["__depth"]) for r in fixpoint({"p": people}, graph)[graph[0]].collect()}
    assert got == {(9, 0), (1, 1), (2, 2)}
    rows = {r["depth"]: (r["orphan_rows"], r["orphan_keys"]) for r in cascade({"p": people}, graph).collect()}
    assert rows == {0: (1, 1), 1: (1, 1), 2: (2, 1)}
    strict = [Reference("p", ("boss",), "p", ("id",))]
    assert {(r["__k0"], r["__depth"]) for r in fixpoint({"p": people}, strict)[strict[0]].collect()} == {(9, 0), (1, 1), (2, 2), (None, 0)}


def test_cycle_between_tables(spark):
    a = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id int, b int")
    b = spark.createDataFrame([(10, 1), (11, 3), (12, 99)], "id int, a int")
    graph = [Reference("a", ("b",), "b", ("id",)), Reference("b", ("a",), "a", ("id",))]
    got = {(r.child, x["__k0"], x["__depth"]) for r, lost in fixpoint({"a": a, "b": b}, graph).items() for x in lost.collect()}
    assert got == {("b", 99, 0), ("a", 12, 1), ("b", 3, 2), ("a", 11, 3)}
    report = {r["child_table"]: tuple(r)[2:] for r in profile({"a": a, "b": b}, graph).collect()}
    assert report == {"a": (3, 3, 0, 2), "b": (3, 3, 1, 1)}


def test_causes_and_their_order(spark):
    demo = spark.createDataFrame([("2024Q1", 1, 7), ("2024Q3", 2, 7), ("2024Q1", 3, 7), ("2024Q3", 3, 7), ("2024Q1", 4, None), (None, 5, 7), ("2024Q2", 20, 8)], "quarter string, primaryid bigint, caseid bigint")
    child = spark.createDataFrame(
        [("2024Q1", 1, 7), ("2024Q2", 2, 7), ("2024Q2", 2, 7), ("2024Q2", 3, 7), ("2024Q2", 4, 7), ("2024Q2", 5, 7), ("2024Q2", 6, 8), ("2024Q2", 6, 7), ("2024Q2", 9, 8), ("2024Q2", None, None), (None, 1, None), ("2024Q2", 20, 7)],
        "quarter string, primaryid bigint, caseid bigint",
    )
    rejects = spark.createDataFrame([("faers_demo", "2024Q2", '\t "9" '), ("faers_drug", "2024Q2", "4"), ("faers_demo", "2024Q1", "4"), ("faers_demo", "2024Q2", None)], "table_name string, partition string, key_hint string")
    deleted = spark.createDataFrame([("2020Q1", 8), ("2020Q1", 8), ("2020Q1", None)], "quarter string, caseid bigint")
    got = explain_orphans({"c": child, "e": child.limit(0)}, demo, rejects, deleted, "faers_demo", "quarter", "primaryid", "caseid").collect()
    assert [tuple(r) for r in got if r["kind"] == "inherited"] == [("c", "inherited", "2024Q2", 20, "withdrawn")]
    got = [r for r in got if r["kind"] == "direct"]
    assert {(r["quarter"], r["primaryid"]): r["cause"] for r in got} == {
        ("2024Q2", 2): "late", ("2024Q2", 3): "late", ("2024Q2", 4): "early", ("2024Q2", 5): "missing", ("2024Q2", 6): "deleted", ("2024Q2", 9): "rejected", ("2024Q2", None): "missing", (None, 1): "missing",
    }
    assert len(got) == 8
