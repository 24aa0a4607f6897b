import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from sedimenta.operators import snapdiff

SCHEMA = "snap date, id string, at timestamp, s string, n int, _key string, snapshot string"


def norm(v):
    return None if v is None else "".join(c for c in v if c.isalnum()).lower() if isinstance(v, str) else v


def brute(rows):
    best = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k = (r[0], r[1].upper())
        if k not in best or (r[2] or dt.datetime.min) > (best[k][2] or dt.datetime.min):
            best[k] = r
    days = sorted({d for d, _ in best})
    out = []
    for a, b in zip(days, days[1:]):
        old, new = ({k: tuple(map(norm, r[3:5])) for (d, k), r in best.items() if d == x} for x in (a, b))
        out += [(b, k, "added") for k in new.keys() - old.keys()] + [(b, k, "removed") for k in old.keys() - new.keys()]
        out += [(b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out)


def test_equals_brute_force_over_several_buckets(spark, monkeypatch):
    rnd = random.Random(3)
    rows, used = [], set()
    for _ in range(4000):
        day = rnd.choice([None, dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 4, 1)])
        key = rnd.choice([None, f"k{rnd.randrange(900)}", f"K{rnd.randrange(900)}"])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(10**6))
        if (day, key and key.upper(), at) not in used:
            used.add((day, key and key.upper(), at))
            rows.append((day, key, at, rnd.choice([None, "", "A-b", "ab", "AB.", "c"]), rnd.choice([None, 1, 2]), "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = snapdiff.snapshot_changes(df, "snap", F.upper("id"), "at", ["s", "n"], rows_per_bucket=300)
    assert sorted(map(tuple, got.drop("since").collect())) == brute(rows)
    assert got.where("since >= snapshot or since is null").count() == 0
    fields = snapdiff.changed_fields(df, got, "snap", F.upper("id"), "at", ["s", "n"])
    whole = sorted(map(str, fields.collect()))
    monkeypatch.setattr(snapdiff, "MOST_BROADCAST", 0)
    assert sorted(map(str, snapdiff.changed_fields(df, got, "snap", F.upper("id"), "at", ["s", "n"]).collect())) == whole
    fields = fields.select("snapshot", "key").distinct()
    assert sorted(map(tuple, fields.collect())) == [(d, k) for d, k, c in brute(rows) if c == "changed"]


def test_few_snapshots_and_repeats(spark):
    one = dt.date(2024, 1, 1)
    row = (one, "a", None, "s", 1, "", "")
    for rows in ([], [row], [row, row]):
        assert snapdiff.snapshot_changes(spark.createDataFrame(rows, SCHEMA), "snap", F.upper("id"), "at", ["s"]).count() == 0
    two = [row, row, (dt.date(2024, 2, 1), "A", None, "S!", 1, "", ""), (dt.date(2024, 2, 1), "b", None, None, None, "", "")]
    got = snapdiff.snapshot_changes(spark.createDataFrame(two, SCHEMA), "snap", F.upper("id"), "at", ["s", "n"]).collect()
    assert [(r["key"], r["change"]) for r in got] == [("B", "added")]


def test_differences_in_numpy():
    snap, key, row = np.array([0, 0, 1, 1, 3]), np.array([5, 7, 7, 9, 9]), np.array([1, 1, 2, 1, 1])
    s, at, c = snapdiff.differences(snap, key, row, 4)
    assert sorted(zip(s.tolist(), key[at].tolist(), c.tolist())) == [(1, 5, 1), (1, 7, 2), (1, 9, 0), (2, 7, 1), (2, 9, 1), (3, 9, 0)]


def test_snapshots_told_by_instants(spark):
    rows = [(dt.datetime(2024, 1, 1, 5), "a", 1), (dt.datetime(2024, 1, 1, 6), "a", 2)]
    df = spark.createDataFrame(rows, "snap timestamp, id string, n int")
    got = snapdiff.snapshot_changes(df, "snap", F.col("id"), "n", ["n"]).collect()
    assert [tuple(r) for r in got] == [(rows[1][0], rows[0][0], "a", "changed")]
