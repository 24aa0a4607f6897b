import random
from collections import defaultdict

import numpy as np

from sedimenta.llm import packing


def brute(sizes, capacity, most, attention):
    """Best fit by tokens alone, in plain loops."""
    bins = []
    for s in sizes:
        ok = [b for b in bins if b[0] + s <= capacity and b[1] < most and b[2] + s * s <= attention]
        if ok:
            b = max(ok, key=lambda x: x[0])
        else:
            b = [0, 0, 0]
            bins.append(b)
        b[0], b[1], b[2] = b[0] + s, b[1] + 1, b[2] + s * s
    return len(bins)


def fits(sizes, container, offset, capacity, most, attention):
    by = defaultdict(list)
    for s, c, o in zip(sizes, container, offset):
        by[c].append((o, s))
    for items in by.values():
        assert sum(s for _, s in items) <= capacity and len(items) <= most and sum(s * s for _, s in items) <= attention
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
    return len(by)


def test_constraints_hold_and_little_is_unused():
    rnd = random.Random(1)
    for score in ("norm", "dot"):
        for most, attention in ((256, 2048**2), (5, 2048**2), (256, 600_000)):
            sizes = np.array(sorted((rnd.choice([rnd.randrange(1, 700), 3]) for _ in range(800)), reverse=True))
            container, offset = packing.best_fit(sizes, 2048, most, attention, score=score)
            n = fits(sizes.tolist(), container.tolist(), offset.tolist(), 2048, most, attention)
            assert n <= 1.15 * brute(sizes.tolist(), 2048, most, attention) + 1
    assert packing.best_fit(np.array([], int))[0].tolist() == []


def test_items_beyond_the_attention_capacity():
    sizes = np.array([1500, 1200, 100])
    try:
        packing.best_fit(sizes, 2048, 256, 1_000_000)
        raise AssertionError("an item beyond a capacity was taken")
    except ValueError:
        pass
    container, _ = packing.best_fit(sizes, 2048, 256, 1_000_000, alone=True)
    assert len(set(container.tolist())) == 3


def test_binding_attention(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([rnd.randrange(1, 300), rnd.randrange(900, 2400), 1000, 2048])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    limit = 1_000_000
    cut = packing.pack(df, "doc_id", "n", max_attention=limit)
    got = packing.fill(cut, "doc_id", max_attention=limit).first()
    assert got["breaches"] == got["alone"] == 0 and got["tokens"] == sum(n for _, n in rows) and got["items"] == len(rows)
    assert cut.agg({"n_tokens": "max"}).first()[0] <= 1000 and packing.containers(cut).where("attention > 1000000").count() == 0
    pieces = sorted((r[0] for r in cut.select("n_tokens").collect() if r[0]), reverse=True)
    assert got["containers"] <= 1.02 * brute(pieces, 2048, 256, limit) + 1
    whole = packing.fill(packing.pack(df, "doc_id", "n", max_attention=limit, cut_dense=False), "doc_id", max_attention=limit).first()
    assert whole["breaches"] == whole["split_whole"] == 0 and whole["alone"] > 0 and whole["split"] == sum(n > 2048 for _, n in rows)
    empty = packing.fill(packing.pack(df.limit(0), "doc_id", "n"), "doc_id").first()
    assert (empty["items"], empty["containers"], empty["breaches"]) == (0, 0, 0)


def test_fill_sees_breaches(spark):
    schema = "doc_id bigint, piece int, begin bigint, n_tokens bigint, container bigint, start int"
    bad = [(1, 0, 0, 1500, 1, 0), (2, 0, 0, 1000, 1, 1500), (3, 0, 0, 10, 2, 5), (4, 0, 0, 2048, 3, 0), (4, 1, 2000, 10, 4, 0)]
    got = packing.fill(spark.createDataFrame(bad, schema), "doc_id").first()
    assert got["breaches"] == 3  # too many tokens, a gap in a container, a gap in an item


def test_pack_covers_every_token_once(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, 2048, 2049, 4096, 10_000, rnd.randrange(3000)]), "x", 1) for i in range(400)] + [(None, 7, "x", 1), (5, 9, "x", 1), (6, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, key string, container int")
    got = packing.pack(df, "doc_id", "n", cut_dense=False).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        if r["n_tokens"] == 0:
            assert r["container"] is None
    total = defaultdict(int)
    for d, n, *_ in rows:
        total[d] += n or 0
    assert {d: sum(r["n_tokens"] for r in rs) for d, rs in by.items()} == dict(total)
    for d, n, *_ in rows:
        if d not in (5, 6, None):
            pieces = sorted(by[d], key=lambda r: r["piece"])
            assert [r["piece"] for r in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(1, -(-n // 2048)) and [r["begin"] for r in pieces] == [2048 * i for i in range(len(pieces))]
    used = packing.containers(packing.pack(df, "doc_id", "n", cut_dense=False))
    assert used.where("unused < 0 or items > 256").count() == 0
    tokens = sum(n or 0 for _, n, *_ in rows)
    assert used.count() <= 1.08 * tokens / 2048 + 2
    again = packing.pack(df.repartition(3), "doc_id", "n", cut_dense=False).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0
