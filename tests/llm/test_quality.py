import numpy as np
import pytest

from sedimenta.llm import quality

COMMON = frozenset("the of and a to in is was for with not be or who on by at from as it that which were are this has had".split())
PROSE = "The study was stopped because of a rash, which had been seen in two of the groups. It is not known who was at risk, and the result of the trial was not clear."
TEXTS = {
    PROSE: "prose",
    PROSE.replace(". ", ".\n").replace(" of", "\nof"): "prose",
    PROSE.lower().replace(",", "").replace(".", ""): "prose",
    PROSE + "\n- nausea\n- fall": "prose",
    "The dose was changed:\n- nausea\n- fall\n- headache\n- dry mouth\n- rash\n- cough\n- fever": "list",
    "1. nausea\n2. lot 55A\n3. dry mouth\n4. weight gain\n5. fever": "list",
    "nausea • fall • headache • dry mouth • rash • cough • fever": "list",
    "Nausea.\nDry mouth.\nHeadache.\nWeight gain.\nRash.\nCough.\nFever.": "list",
    "Dose | N | SD\n10 mg | 5 | 0.3\n20 mg | 7 | 0.4\n30 mg | 9 | 1.2\n40 mg | 2 | 2.2": "table",
    "Dose\tN\tSD\n10 mg\t5\t0.3\n20 mg\t7\t0.4\n30 mg\t9\t1.2": "table",
    "  1.20   44   0.3\n  2.20   54   0.4\n  9.10   14   0.9\n": "table",
    "xq zvrtk wqpl kdjfh vbnmz rtwq plkjh gfdsz xcvbq wrtzp": "junk",
    "null undefined NaN null [object Object] null TODO undefined null": "junk",
    "page page page page page page page page page page page page": "junk",
    "eht fo dna saw eht gurd dna eht tluser saw ton ni eht puorg": "junk",
    "%&$ #@! *&^ %$# @!~ ^&* %$# !@# $%^ &*( )_+ #@!": "junk",
}


@pytest.mark.parametrize("text", TEXTS)
def test_kinds(text):
    assert quality.LABELS[quality.decide(*quality.shares([text], COMMON))[0]] == TEXTS[text]


def slow_viterbi(model, emission):
    score, back = np.log(model.start) + emission[0], []
    for e in emission[1:]:
        path = score[:, None] + np.log(model.transition)
        back.append(path.argmax(axis=0))
        score = path.max(axis=0) + e
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_batched_viterbi_equals_one_by_one():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 0, 1, 17, 5, 5, 0, 2])
    emission = rng.normal(0, 3, (lengths.sum(), len(quality.STATES)))
    expected, at = [], 0
    for n in lengths:
        if n:
            expected += slow_viterbi(quality.initial(), emission[at : at + n])
        at += n
    assert quality.viterbi(quality.initial(), emission, lengths).tolist() == expected


def test_fit_follows_data_and_keeps_what_it_has_not_seen():
    first = quality.initial()
    assert all(np.allclose(a, b) for a, b in zip(vars(quality.fit(quality.line_statistics([], COMMON))).values(), vars(first).values()))
    lines = quality.line_statistics([PROSE, *[PROSE.replace(". ", ".\n")] * 400], COMMON)
    fitted = quality.fit(lines)
    unseen = list(quality.STATES).index("rules")
    assert np.allclose(fitted.words[unseen], first.words[unseen]) and not np.allclose(fitted.words[0], first.words[0])
    score = lambda m: quality.viterbi(m, m.emission(lines), lines.lengths)
    gain = lambda m: m.emission(lines)[np.arange(len(lines.counts)), score(m)].sum()
    assert gain(fitted) > gain(first)
    for text, kind in TEXTS.items():
        if kind != "list":
            assert quality.LABELS[quality.decide(*quality.shares([text], COMMON, fitted))[0]] == kind


def test_packed_lines_come_back():
    lines = quality.line_statistics([*TEXTS, None, "", "word " * 61, "word " * 60], COMMON)
    again = quality.unpack(*quality.pack(lines))
    assert all(np.array_equal(a, b) for a, b in zip(vars(lines).values(), vars(again).values()))


def test_corpus_model_comes_from_every_line(spark):
    """Texts of another kind far down, and long ones, count as much as the first; neither order nor tasks matter."""
    texts = [PROSE.replace(". ", ".\n")] * 2500 + ["Dose | N | SD\n10 mg | 5 | 0.3\n20 mg | 7 | 0.4\n30 mg | 9 | 1.2"] * 400 + ["1.20   44   0.3\n" * 3000, None, ""]
    whole = quality.fit(quality.line_statistics(texts, COMMON))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    for order, tasks in ((rows, 1), (rows[::-1], 5)):
        body = spark.createDataFrame(order, "key bigint, text string, own array<string>").coalesce(tasks)
        found = quality.fit_corpus(quality.observe(body, COMMON))
        assert all(np.array_equal(a, b) for a, b in zip(vars(found).values(), vars(whole).values()))
    assert not np.allclose(whole.words, quality.fit(quality.line_statistics(texts[:2000], COMMON)).words)


def test_repeated_pairs_equal_brute_force():
    rng = np.random.default_rng(6)
    codes, owner = rng.integers(0, 9, 400), np.repeat(np.arange(8), 50)
    got = quality._repeated(codes, owner)
    expected, seen = [], {}
    for i, (c, o) in enumerate(zip(codes, owner)):
        pair = (o, codes[i - 1] if i and owner[i - 1] == o else None, c)
        expected.append(i - seen.get(pair, -999) <= quality.NEAR)
        seen[pair] = i
    assert got.tolist() == expected


def test_parameters_are_distributions():
    for label, words, shapes in quality.STATES.values():
        assert label in quality.LABELS and abs(sum(words) - 1) < 0.05
        assert len(words) == len(quality.WORD_KINDS) and len(shapes) == len(quality.SHAPES) and all(0 < p < 1 for p in shapes)
    assert np.allclose(quality.initial().transition.sum(axis=1), 1)


def test_spark_on_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "few words"), (5, "page " * 50_000), (6, PROSE * 300), (7, "-" * 100_000), (None, "null " * 9), (7, PROSE), (8, "a" + "-" * 100_000 + "b " * 9), (9, "1" + "." * 100_000 + "x"), (10, "x " + " " * 100_000 + "; a, b, c, d, e, f, g, h")]
    df = spark.createDataFrame([(*r, "z", "k") for r in rows], "doc_id bigint, text string, key string, kind string")
    got = sorted((str(r["doc_id"]), r["kind"], r["n_words"]) for r in quality.label_corpus(df.where("doc_id is null or doc_id < 8"), "doc_id", "text", sorted(COMMON)).collect())
    assert quality.label_corpus(df.where("doc_id > 7"), "doc_id", "text", sorted(COMMON)).where("n_words > 0").count() == 3
    assert [x[:2] for x in got] == [("1", "prose"), ("2", "prose"), ("3", "prose"), ("4", "prose"), ("5", "junk"), ("6", "prose"), ("7", "prose"), ("7", "prose"), ("None", "junk")]
    stats = {r["doc_id"]: r for r in quality.statistics(df.where("doc_id < 5"), "doc_id", "text", ["few"]).collect()}
    assert stats[1]["words"] == stats[3]["words"] == 0 and stats[1]["mean_word_length"] is None and stats[4]["common_words"] == 0.5
    listed = spark.createDataFrame([("few",), (None,)], "word string")
    told = sorted(map(str, quality.statistics(df, "doc_id", "text", listed).collect()))
    labels = sorted(map(str, quality.label_corpus(df, "doc_id", "text", spark.createDataFrame([(w,) for w in COMMON], "word string")).collect()))
    monkeypatch.setattr(quality, "MOST_WORDS_SENT", 0)  # the way of lists too long to send
    assert sorted(map(str, quality.statistics(df, "doc_id", "text", listed).collect())) == told
    assert sorted(map(str, quality.label_corpus(df, "doc_id", "text", spark.createDataFrame([(w,) for w in COMMON], "word string")).collect())) == labels
    assert quality.label_corpus(df.limit(0), "doc_id", "text", []).count() == 0
