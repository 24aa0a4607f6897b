import math
import random
from itertools import combinations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sedimenta.llm import names

# invented for these tests
MAKERS = ["Oakhurst Meridian", "Quillfeather", "Brandywine Tarrow", "Juniper Voss", "Halcyon Grebe", "Wexcombe", "Tamsin Orchard", "Pellucid Yarrow"]
SUFFIXES = ["Widgetry Ltd", "Foundry Oy", "Works AB", "Widgetry Oy", "Foundry AB", "Works Ltd"]


def test_words_of_a_name():
    assert names.parts_of("Quillfeather 250 mg/5 ml SYRUP (new)") == [["quillfeather", "syrup"]]
    assert names.parts_of("O\u2019Hara-Smith, B.V. & Sons") == [["oharasmith"], ["bv"], ["sons"]]
    assert names.parts_of("JUN\u00cdPER\\VOSS and CO") == [["juniper"], ["voss"], ["co"]]
    assert names.parts_of("(only this)") == [["only", "this"]] and names.parts_of("5 mg") == [["mg"]] and names.parts_of("12") == [] and names.parts_of(" ") == []
    assert names.shortens("wdg", "widgetry") and names.shortens("wid", "widgetry") and not names.shortens("widgetry", "wid") and not names.shortens("ow", "works") and not names.shortens("foundrx", "foundry")


def test_additions_are_learned(spark):
    rnd = random.Random(1)
    rows = [("f", f"{m} {s}", rnd.randrange(1, 50)) for m in MAKERS for s in rnd.sample(SUFFIXES, 4)]
    rows += [("f", f"{m} Wks", 2) for m in MAKERS[:2]] + [("f", "Meridian Oakhurts Ltd", 1), ("g", "Widgetry", 1)]
    df = spark.createDataFrame(rows, "field string, name string, n bigint")
    got = {tuple(r) for r in names.additions(names.with_parts(df)).collect()}
    assert got == {("f", w) for w in ("widgetry", "foundry", "works", "wks", "ltd", "oy", "ab")}


def test_collision_curve_and_bands():
    bands = names.bands_for(0.42, 0.99, 3)
    assert names.collision(0.42, 3, bands) >= 0.99 > names.collision(0.42, 3, bands - 1)
    a, b, c = (names.band_hashes([w], bands) for w in ("quillfeather", "quillfether", "marzipanloaf"))
    assert (a == b).any() and (a == names.band_hashes(["quillfeather"], bands)).all() and not (a == c).any()
    assert not (a == names.band_hashes(["quillfeather"], bands, salt=1)).any()


def slip(word, rnd):
    i = rnd.randrange(len(word))
    kind = rnd.randrange(4)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2 and i + 1 < len(word):
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    near = [c for c in "abcdefghijklmnopqrstuvwxyz" if names.neighbours(c, word[i]) and c != word[i]]
    return word[:i] + rnd.choice(near) + word[i + 1 :]


def test_recall_of_banding_against_all_pairs():
    """Of all pairs that verification accepts, nine in ten at least meet, whatever their length."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 7))) for _ in range(150)]
    pool = sorted({x for w in words for x in (w, slip(w, rnd), slip(w, rnd), slip(slip(w, rnd), rnd)) if len(x) > 2} | {f"{a} {b}" for a, b in zip(words[:30], words[30:60])} | {f"{slip(b, rnd)} {a}" for a, b in zip(words[:30], words[30:60])})
    bands = names.bands_for()
    keys = [set(names.meeting_keys(x.split(), x.replace(" ", ""), bands).tolist()) for x in pool]
    alike = [(i, j) for i, j in combinations(range(len(pool)), 2) if names.name_similarity(pool[i].split(), pool[j].split()) >= names.LEAST_SIMILARITY]
    met = sum(bool(keys[i] & keys[j]) for i, j in alike)
    assert len(alike) > 300 and met >= 0.95 * len(alike)
    short = [(i, j) for i, j in alike if len(pool[i]) < 6]
    assert short and sum(bool(keys[i] & keys[j]) for i, j in short) >= 0.9 * len(short)


def test_names_of_common_syllables_do_not_meet_by_chance():
    """Made of the same few syllables, other names than the misspelled ones hardly meet, and those all do."""
    rnd = random.Random(9)
    parts = ["bren", "lal", "cil", "glu", "mo", "ta", "xin", "dol", "pra", "ve", "kan", "ru", "sil", "fen", "go", "ne"]
    words = sorted({"".join(rnd.choice(parts) for _ in range(4)) for _ in range(250)})
    bands = names.bands_for()
    keys = {w: set(names.meeting_keys([w], w, bands).tolist()) for w in words}
    pairs = list(combinations(words, 2))
    met = [p for p in pairs if keys[p[0]] & keys[p[1]]]
    alike = [p for p in pairs if names.name_similarity([p[0]], [p[1]]) >= names.LEAST_SIMILARITY]
    assert set(alike) <= set(met) and len(met) < 0.01 * len(pairs)
    for w in words:
        for x in (slip(w, rnd), slip(slip(w, rnd), rnd), w[0] + w, w[:1] + "h" + w[1:], w[: math.ceil(0.6 * len(w))]):
            if names.name_similarity([w], [x]) >= names.LEAST_SIMILARITY:
                assert keys[w] & set(names.meeting_keys([x], x, bands).tolist()), (w, x)


def test_hashes_of_deletions_equal_brute_force():
    for word in ("a", "ab", "banana", "marlowenthar", "abcabcabcabcabcabcabcd"):
        one = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        two = one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
        assert [len(names.deletions(word, 0, m)) for m in (1, 2)] == [len(one), len(two)]


def damerau(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abeh", max_size=6), st.text("abeh", max_size=6))
def test_slip_distance_is_bounded_by_edits(a, b):
    got = names.slip_distance(a, b, 100.0)
    assert got == names.slip_distance(b, a, 100.0)
    assert names.DOUBLED * damerau(a, b) - 1e-9 <= got <= names.OTHER * 2 * damerau(a, b) + 1e-9


def test_similarity():
    alike = lambda a, b: names.name_similarity(a.split(), b.split()) >= names.LEAST_SIMILARITY
    assert alike("oakhurst meridian", "meridian oakhurst") and alike("oakhurst meridian", "meridan oakhurts") and alike("oakhurst m", "oakhurst meridian")
    assert alike("quill feather", "quillfeather") and alike("quillfe", "quillfeather") and alike("oakhmeri", "oakhurst meridian")
    assert not alike("oakhurst", "oakhurst meridian") and not alike("oakhurst meridian", "oakhurst brandywine") and not alike("juniper", "jupiter voss")


def test_kinds_of_differences():
    kind = lambda a, b: names.KINDS[names.difference(a.split(), b.split())]
    assert [kind("marlow tarn", x) for x in ("tarn marlow", "marlow tarm", "marliw tarn", "marlew tarn", "marlox tarn", "marow tarn", "amrlow tarn", "narlwo tarn")] == ["form", "key", "near vowel", "vowel", "letter", "slip", "slip", "slips"]


def test_estimate_follows_prior_and_data():
    shape = tuple(len(names.PRIOR[f][0]) for f in names.FEATURES)
    slip_, vowel = names.KINDS.index("slip"), names.KINDS.index("vowel")
    bare = names.estimate(np.zeros(shape))
    assert bare[slip_, 0, 0] > 0.99 and bare[vowel, 7, 4] < 0.01
    counts = np.zeros(shape)
    counts[vowel, 0, 0], counts[slip_, 0, 0] = 20_000, 1000  # one vowel is how these names are mistyped
    assert names.estimate(counts)[vowel, 0, 0] > bare[vowel, 0, 0]


def test_linking(spark):
    groups = [
        ["QUILLFEATHER", "quillfeather.", "QUILLFETHER", "Quillfeather 5 Mg", "quill feather", "QUILLF\u00c9ATHER"],
        ["MARLOWENTHAR", "marlowent-har", "MARLOWENTHARR"],
        ["MARLOWENTHER", "Marlowentthur"],
        ["TAMSINORCHARD"],
        ["Ebbingdale", "Ebbingdael"],
    ]
    rows = [(g[0], "x") for g in groups[:4] for _ in range(90)] + [(n, "x") for g in groups for n in g[1:] for _ in range(3)] + [("Ebbingdale", "x")] * 3 + [(None, "x"), ("  ", "x")]
    rows = [("Marlowentehr" if n == "Marlowentthur" else n, x) for n, x in rows]
    groups[2][1] = "Marlowentehr"
    df = spark.createDataFrame(rows, "name string, core string")
    linked = names.link_spellings(names.spellings(df, "name", "f"))
    got = {(r["name_a"], r["name_b"]) for r in names.pairs_of(linked).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    assert linked.count() == sum(map(len, groups))
    odd = spark.createDataFrame([("!!!", "x"), ("7", "x"), ("a" * 5000, "x"), ("b c " * 900, "x")], "name string, core string")
    assert names.link_spellings(names.spellings(odd, "name", "f")).select("cluster").distinct().count() == 4
    empty = names.link_spellings(names.spellings(df.limit(0), "name", "f"))
    assert names.pairs_of(empty).count() == 0


def test_a_key_that_all_share_is_spread(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, i, 1 if i else 500) for i in range(400)], "key bigint, node bigint, weight bigint")
    monkeypatch.setattr(names, "SHARE", 50)
    shared = names.shared_keys(nodes.union(spark.createDataFrame([(2, 7, 1)], "key bigint, node bigint, weight bigint")))
    assert shared.count() == 400 and {r["_shares"] for r in shared.collect()} == {8}
    assert names.candidates(shared, names.DOMINANCE).count() == 399
    assert names.candidates(shared.where("node < 9"), None).count() == 36


def test_stars_take_the_nearest_centre(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node bigint")
    links = spark.createDataFrame([(1, 0, 0.9, 100), (2, 1, 0.99, 50), (2, 0, 0.8, 100), (3, 1, 0.9, 50), (4, 3, 0.9, 10)], "rare bigint, frequent bigint, similarity double, weight bigint")
    got = {r["node"]: r["centre"] for r in names.stars(nodes, links).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
