import datetime as dt
import random

from pyspark.sql import functions as F

from sedimenta.operators import history

SCHEMA = "case bigint, version int, start date, a string, b string, block string, valid_from string"


def brute(rows):
    """Walk the days on which anything starts and note which version is valid."""
    out = []
    for case in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == case and r[1] is not None and r[2] is not None), key=lambda r: r[1])
        for r in own:
            later = [x[2] for x in own if x[1] > r[1]]
            stop = min(later, default=None)
            if stop is None or r[2] < stop:
                out.append((case, r[1], r[2], stop, r[3], r[4]))
    return sorted(out, key=str)


def rows(n, cases, seed):
    rnd = random.Random(seed)
    seen, out = set(), []
    for _ in range(n):
        case, version = rnd.choice([None, *range(cases)]), rnd.choice([None, *range(0, 5000, 7)])
        if (case, version) not in seen:
            seen.add((case, version))
            day = rnd.choice([None, *(dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(90))])
            out.append((case, version, day, rnd.choice([None, "x", "y"]), rnd.choice([None, "p"]), "z", "w"))
    return out


def test_history_equals_brute_force(spark):
    data = rows(3000, 3, 1)
    df = spark.createDataFrame(data, SCHEMA)
    got = history.history(df, "case", "version", "start", ["a", "b"], every=5)
    assert sorted(map(tuple, got.select("case", "version", "valid_from", "valid_to", "a", "b").collect()), key=str) == brute(data)


def test_patches_hold_only_changes_and_nulls_are_values(spark):
    day = dt.date(2024, 1, 1)
    data = [(1, v, day + dt.timedelta(days=v), a, "p", "", "") for v, a in enumerate(["x", "x", None, None, "x"])]
    chains = history.stripe(spark.createDataFrame(data, SCHEMA), "case", "version", ["start"], ["a", "b"], every=16)
    (row,) = chains.collect()
    assert [x["patch"]["a"] is not None for x in row["chain"]] == [True, False, True, False, True]
    assert [x["patch"]["b"] is not None for x in row["chain"]] == [True, False, False, False, False]
    whole = history.fold(chains, "case", "version", ["start"], ["a", "b"]).orderBy("version").collect()
    assert [(r["version"], r["start"], r["a"], r["b"]) for r in whole] == [(v, r[2], r[3], "p") for v, r in enumerate(data)]


def test_store_appends_and_reads_as_of(spark, tmp_path):
    rnd = random.Random(4)
    schema = "case bigint, version int, start date, q string, a string, chain string"
    every, data = 4, []
    for i in range(1500):
        data.append((rnd.choice([None, *range(40)]), rnd.choice([None, *range(-3, 30)]), rnd.choice([None, *(dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(60))]), f"q{i // 300}", rnd.choice([None, "x", "y"]), "z"))
    store = history.HistoryStore(spark, str(tmp_path / "h"), "case", "version", "start", ["q"], ["a"], every)
    written = []
    for q in ("q0", "q2", "q1", "q3"):  # late deliveries too
        written.append(store.append(spark.createDataFrame([r for r in data if r[3] == q], schema)))
    written.append(store.append(spark.createDataFrame([(7, 50, dt.date(2024, 5, 1), "q4", "n", "z")], schema)))
    assert store.generations() == [1, 2, 3, 4, 5] and written[-1] == 1
    best = {}
    for r in [r for r in data if r[3] != "q4"] + [(7, 50, dt.date(2024, 5, 1), "q4", "n", "z")]:
        if None not in r[:3] and (r[:2] not in best or (r[3], r[2], r[4] or "", r[4] is not None) > (best[r[:2]][3], best[r[:2]][2], best[r[:2]][4] or "", best[r[:2]][4] is not None)):
            best[r[:2]] = r
    expected = brute([(c, v, s, a, None) for (c, v), (_, _, s, _, a, _) in best.items()])
    got = store.history().select("case", "version", "valid_from", "valid_to", "a").collect()
    assert sorted(map(tuple, got), key=str) == sorted([r[:5] for r in expected], key=str)
    for day in (dt.date(2023, 12, 31), dt.date(2024, 1, 9), dt.date(2024, 2, 20), dt.date(2025, 1, 1)):
        there = {(r["case"], r["version"], r["a"]) for r in store.as_of(F.lit(day)).collect()}
        assert there == {(c, v, a) for c, v, f, t, a, _ in expected if f <= day and (t is None or day < t)}


def test_empty_and_latest_delivery(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert history.history(empty, "case", "version", "start", ["a"]).count() == 0
    df = spark.createDataFrame([(1, 1, "q1", "old"), (1, 1, "q2", "new"), (1, 1, "q2", "new"), (1, 1, None, "zz")], "k int, v int, quarter string, a string")
    assert [tuple(r) for r in history.latest_delivery(df, ["k", "v"], ["quarter"]).collect()] == [(1, 1, "q2", "new")]


def test_start_of_partial_dates(spark):
    df = spark.createDataFrame(
        [("20240315", "day", dt.date(2024, 3, 15), "2024Q1"), ("202403", "month", None, "2024Q2"), ("2023", "year", None, "2024Q2"), ("0", "invalid", None, "2024Q3"), (None, None, None, "2025Q4"), (None, None, None, None)],
        "raw string, prec string, d date, quarter string",
    )
    got = df.select(history.start_of(F.col("raw"), F.col("prec"), F.col("d"), F.col("quarter")).alias("s")).collect()
    assert [str(r["s"]) for r in got] == ["2024-03-15", "2024-03-01", "2023-01-01", "2024-07-01", "2025-10-01", "None"]


def test_versions_from_snapshots(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([("k", d(1), "a"), ("k", d(2), "a"), ("k", d(3), None), ("k", d(4), None), ("j", d(1), "b"), (None, d(1), "b")], "e string, at date, v string")
    got = history.versions_from_snapshots(df, "e", "at", ["v"]).orderBy("e", "version").collect()
    assert [(r["e"], str(r["start"]), r["v"]) for r in got] == [("j", "2024-01-01", "b"), ("k", "2024-01-01", "a"), ("k", "2024-01-03", None)]
