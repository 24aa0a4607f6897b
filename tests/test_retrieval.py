import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import vectors
from sedimenta.operators import context, search, status
from sedimenta.plans import engine
from sedimenta.streaming import refresh as streaming


def test_nearest_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, str(i % 3), rng.normal(size=5).tolist()) for i in range(120)] + [(200, "0", None), (201, "0", [0.0] * 5), (202, "1", rng.normal(size=5).tolist())]
    data[7] = (7, "1", data[3][2])
    df = spark.createDataFrame(data, "doc_id bigint, g string, embedding array<double>").repartition(3)
    queries = df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = search.nearest(queries, df, 4, block=5)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data if v and any(v)}
    expected = set()
    for q in [i for i in unit if i % 10 == 0]:
        best = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q)[:4]
        expected |= {(q, i, p) for p, (_, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["place"]) for r in got.collect()} == expected
    within = search.nearest(queries, df, 2, within="g", exclude_self=False)
    assert within.groupBy("query_id", "g").count().where("count <> 2").count() == 0
    assert search.nearest(queries.limit(0), df, 2).count() == 0 and search.nearest(queries, df.limit(0), 2).count() == 0


def test_likely_columns_hold_the_best_with_all_ties():
    rng = np.random.default_rng(9)
    s, own = rng.integers(0, 6, (7, 90)).astype(float), np.tile(rng.permutation(90), (7, 1))
    s[0] = 3.0
    order = np.lexsort((own, -s), axis=1)[:, :5]
    x, y = search._likely(s, own, 5)
    again = np.lexsort((y, -x), axis=1)[:, :5]
    assert (np.take_along_axis(own, order, 1) == np.take_along_axis(y, again, 1)).all()
    assert search._likely(s[:, :9], own[:, :9], 5)[0].shape == (7, 9)


def test_exact_places_of_pairs(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=4).tolist()) for i in range(80)] + [(90, None), (91, [0.0] * 4)]
    data[5] = (5, data[6][1])
    df = spark.createDataFrame(data, "doc_id bigint, embedding array<double>").repartition(3)
    queries = df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    every = search.nearest(queries, df, 1000, exclude_self=False)
    pairs = [(q, d) for q in (0, 10, 30, 90, 77) for d in (5, 6, 10, 44, 90, 200)] * 2
    got = search.places(queries, df, spark.createDataFrame(pairs, "query_id bigint, doc_id bigint"), block=4)
    asked = spark.createDataFrame(sorted(set(pairs)), "query_id bigint, doc_id bigint")
    expected = every.join(asked, ["query_id", "doc_id"]).select("query_id", "doc_id", "similarity", F.col("place").cast("bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 12
    assert search.places(queries, df, asked.limit(0)).count() == 0


def test_fusion_prune_changes_nothing(spark):
    rnd = random.Random(4)
    vector = [(q, d, round(rnd.random(), 6)) for q in (1, 2) for d in range(60)]
    lexical = [(q, d, round(rnd.random(), 6)) for q in (1, 2) for d in rnd.sample(range(60), 12)]
    kept = []
    for q in (1, 2):
        matched = {d for p, d, _ in lexical if p == q}
        for place, (_, d, s) in enumerate(sorted((r for r in vector if r[0] == q), key=lambda r: (-r[2], r[1])), 1):
            if place <= 7 or d in matched:
                kept.append((q, d, s, place))
    v = spark.createDataFrame(kept, "query_id int, doc_id int, similarity double, place bigint")
    ranked = [(q, d, n) for q in (1, 2) for n, (_, d, _) in enumerate(sorted((r for r in lexical if r[0] == q), key=lambda r: (-r[2], r[1])), 1)]
    x = spark.createDataFrame(ranked, "query_id int, doc_id int, nth int")
    got = {(r["query_id"], r["place"]): r["doc_id"] for r in search.fuse(v, x, "doc_id", ["query_id"], 5, offset=2).collect()}
    for q in (1, 2):
        by_v = [d for _, d, _ in sorted((r for r in vector if r[0] == q), key=lambda r: (-r[2], r[1]))]
        by_x = [d for _, d, _ in sorted((r for r in lexical if r[0] == q), key=lambda r: (-r[2], r[1]))]
        sim = {d: s for p, d, s in vector if p == q}
        score = {d: round(1 / (60 + i) + (1 / (61 + by_x.index(d)) if d in by_x else 0), 12) for i, d in enumerate(by_v, 1)}
        order = sorted(score, key=lambda d: (-score[d], -sim[d], d))
        assert [got[q, p] for p in range(3, 8)] == order[2:7]
    assert search.clamp(0) == 1 and search.clamp(99) == 50


def test_hybrid_equals_ranking_everything(spark):
    rng, rnd = np.random.default_rng(8), random.Random(8)
    vectors = {d: [float(x) for x in rng.normal(size=3).round(1)] for d in range(900)}
    df = spark.createDataFrame(list(vectors.items()), "doc_id bigint, embedding array<double>").repartition(4)
    queries = df.where("doc_id in (3, 400)").withColumnRenamed("doc_id", "query_id")
    lexical = [(q, d, rnd.randrange(50) / 10) for q in (3, 400) for d in rnd.sample(range(900), 700)]
    k = 4
    assert search.fuse_depth(k, search.EXACT_HITS * k) < 700
    got = search.hybrid(queries, df, spark.createDataFrame(lexical, "query_id bigint, doc_id bigint, rank double"), k, offset=1)
    for q in (3, 400):
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
        sim = {d: round(float(unit(vectors[q]) @ unit(v)), 9) for d, v in vectors.items() if any(v)}
        by_v = {d: i for i, d in enumerate(sorted(sim, key=lambda d: (-sim[d], d)), 1)}
        by_x = {d: i for i, (_, d, _) in enumerate(sorted((r for r in lexical if r[0] == q), key=lambda r: (-r[2], r[1])), 1)}
        score = {d: round(1 / (60 + by_v[d]) + (1 / (60 + by_x[d]) if d in by_x else 0), 12) for d in sim}
        best = sorted(score, key=lambda d: (-score[d], -sim[d], d))[1 : 1 + k]
        assert [r["doc_id"] for r in got.where(F.col("query_id") == q).orderBy("place").collect()] == best


def test_context_skips_comparators_and_needs_all_terms(spark):
    trials = spark.createDataFrame([(1, ["Drug A", "Placebo", None, " ", "sham procedure", "Drug B", "Drug C"]), (2, ["Drug A"]), (3, None)], "trial bigint, names array<string>")
    listed = context.mentioned(trials, "trial", "names", 2)
    assert sorted((r["trial"], r["name"], r["skipped"]) for r in listed.collect()) == [(1, "Drug A", False), (1, "Drug B", False), (1, "Placebo", True), (1, "sham procedure", True), (2, "Drug A", False)]
    docs = spark.createDataFrame([(10, "s1", "drug a a".split()), (11, "s1", "drug a".split()), (12, "s2", "drug a x y".split()), (13, "s1", ["drug"])], "doc_id bigint, source string, terms array<string>")
    got = sorted((r["trial"], r["name"], r["source"], r["doc_id"], r["place"]) for r in context.context(listed, "trial", docs, "doc_id", "source", "terms", 1).collect())
    assert got == [(1, "Drug A", "s1", 10, 1), (1, "Drug A", "s2", 12, 1), (2, "Drug A", "s1", 10, 1), (2, "Drug A", "s2", 12, 1)]
    assert context.summarize("H", ["p", "q"], "Q?") == "H\n\n[1] p\n[2] q\n\nQ?" and context.summarize("H", [], "Q", len) == len(context.prompt("H", [], "Q"))


def test_trial_context_looks_up_every_drug(spark, tmp_path):
    drugs = [f"drug{i}" for i in range(8)]
    rows = [(1, "clinical", "a trial", None, json.dumps({"interventions": [*drugs, "Placebo"]}))]
    rows += [(10 + i, "openfda_label", d, "text", None) for i, d in enumerate(drugs)]
    spark.createDataFrame(rows, "doc_id bigint, source string, title string, text string, structured string").write.parquet(f"{tmp_path}/documents.parquet")
    got = engine.trial_context_all(spark, str(tmp_path)).select("trial", "name", "source", "doc_id", "place").collect()
    assert sorted(map(tuple, got)) == [(1, d, "openfda_label", 10 + i, 1) for i, d in enumerate(drugs)]
    assert {r["name"] for r in engine.trial_context(spark, str(tmp_path)).collect()} == set(drugs[:5])


def test_all_terms_through_the_rarest_equals_brute_force(spark):
    rnd = random.Random(8)
    docs = {d: [rnd.choice("aaaabbbccd") for _ in range(rnd.randrange(1, 8))] for d in range(200)}
    asked = {1: "ab", 2: "abd", 3: "z", 4: "az", 5: "d", 6: "abcd"}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, terms array<string>")
    wanted = spark.createDataFrame([(q, t, len(ts)) for q, ts in asked.items() for t in ts], "query_id bigint, term string, wanted int")
    index = search.postings(df, "doc_id", "terms")
    every = {(r["query_id"], r["doc_id"]) for r in search.term_matches(index, wanted, "doc_id", True).collect()}
    assert every == {(q, d) for q, ts in asked.items() for d, have in docs.items() if set(ts) <= set(have)}
    some = {(r["query_id"], r["doc_id"]) for r in search.term_matches(index, wanted, "doc_id", False).collect()}
    assert some == {(q, d) for q, ts in asked.items() for d, have in docs.items() if set(ts) & set(have)}


def test_postings_among_wanted_terms(spark):
    docs = spark.createDataFrame([(i, [f"w{i % 50}", f"w{i % 7}", f"rare{i}", f"w{i % 7}"]) for i in range(300)] + [(300, None)], "doc_id int, terms array<string>")
    wanted = spark.createDataFrame([(f"w{i}",) for i in range(9)] + [("nowhere",), (None,)], "term string")
    whole, some = search.postings(docs, "doc_id", "terms"), search.postings(docs, "doc_id", "terms", among=wanted)
    held = lambda df: sorted(map(tuple, df.join(wanted, "term", "left_semi").collect()))
    assert held(some) == held(whole)
    assert some.count() < whole.count() / 2
    assert search.postings(docs, "doc_id", "terms", among=wanted.limit(0)).count() == 0


def test_profiles_take_so_many_of_each_source(spark):
    docs = spark.createDataFrame([(i, s, ["drug", "x"]) for s in ("a", "b", "c") for i in range(hash(s) % 97 * 100, hash(s) % 97 * 100 + 9)], "doc_id bigint, source string, terms array<string>")
    names = spark.createDataFrame([("Drug X", ["drug", "x"]), ("nothing", ["q"]), ("", [])], "name string, terms array<string>")
    got = context.profiles(names, docs, wanted={"a": 2, "b": 5}).groupBy("name", "source").count().collect()
    assert {(r["name"], r["source"]): r["count"] for r in got} == {("Drug X", "a"): 2, ("Drug X", "b"): 5}


def test_fused_profiles_rank_every_source_to_its_number(spark):
    rnd = random.Random(6)
    words = ["drug", "x", "drugs", "xy", "pain", "label", "recall", "dose"]
    docs = {d: (rnd.choice("abc"), [rnd.choice(words) for _ in range(rnd.randrange(1, 9))]) for d in range(90)}
    docs |= {100 + i: ("d", ["pain", "drugs"][: 1 + i % 2]) for i in range(4)} | {200: ("e", ["drug", "x"])}
    asked = {7: "Drug X", 8: "nothing", 9: "dose pain recall label"}
    names = spark.createDataFrame([(q, n, n.lower().split()) for q, n in asked.items()], "query_id bigint, name string, terms array<string>")
    df = spark.createDataFrame([(d, s, " ".join(t), t) for d, (s, t) in docs.items()], "doc_id bigint, source string, body string, terms array<string>").repartition(3)
    wanted = {"a": 2, "b": 5, "d": 3}
    got = {(r["name"], r["source"], r["place"]): r["doc_id"] for r in context.fused_profiles(names, df, wanted).collect()}
    unit = dict(zip(docs, vectors.embed([" ".join(t) for _, t in docs.values()]).astype(float)))
    unit = {d: v / np.linalg.norm(v) for d, v in unit.items()}
    expected = {}
    for name in asked.values():
        q, need = vectors.embed([name])[0].astype(float), name.lower().split()
        for source, k in wanted.items():
            sim = {d: round(float(unit[d] @ q / np.linalg.norm(q)), 9) for d, (s, _) in docs.items() if s == source}
            rank = {d: round(sum(1 + np.log(docs[d][1].count(t)) for t in need) / (1 + np.log(1 + len(docs[d][1]))), 9) for d in sim if set(need) <= set(docs[d][1])}
            score = {d: 1 / (60 + i) for i, d in enumerate(sorted(sim, key=lambda d: (-sim[d], d)), 1)}
            for i, d in enumerate(sorted(rank, key=lambda d: (-rank[d], d)), 1):
                score[d] += 1 / (60 + i)
            best = sorted(sim, key=lambda d: (-round(score[d], 12), -sim[d], d))[:k]
            assert len(best) == k
            expected |= {(name, source, i): d for i, d in enumerate(best, 1)}
    assert got == expected


def test_evidence_and_citations(spark):
    articles = spark.createDataFrame([(1, "asthma in children", "asthma children".split()), (2, "liver disease", "liver disease".split()), (3, "treatment of asthma", "treatment of asthma".split())], "doc_id bigint, body string, terms array<string>")
    trials = spark.createDataFrame([(9, "A study", ["asthma"], None)], "query_id bigint, title string, conditions array<string>, interventions array<string>")
    asked = trials.select("query_id", context.question_of("title", "conditions", "interventions").alias("question"))
    assert asked.first()["question"] == "asthma A study"
    found = context.evidence(asked, articles, 2)
    titled = context.cite(found, articles.withColumn("title", F.col("body"))).orderBy("place").collect()
    assert [r["doc_id"] for r in titled] in ([1, 3], [3, 1]) and titled[0]["citation"].startswith("[1] ")


def test_evidence_reads_articles_to_their_end(spark):
    head = "word " * 2000
    articles = spark.createDataFrame([(1, head + "liver " * 3000, []), (2, head + "asthma " * 3000, [])], "doc_id bigint, body string, terms array<string>")
    asked = spark.createDataFrame([(9, "asthma")], "query_id bigint, question string")
    found = {r["place"]: (r["doc_id"], r["similarity"]) for r in context.evidence(asked, articles, 2).collect()}
    assert found[1][0] == 2 and found[1][1] > found[2][1]


def test_ingest_counts_and_source_state(spark):
    from sedimenta.operators.load import ingest_counts

    docs = spark.createDataFrame([("s", "a", "t"), ("s", "a", "u"), ("s", "", "t"), ("s", "b", " \t"), ("r", "a", "t")], "source_id string, doc_id string, embed_text string")
    assert ingest_counts(docs).first().asDict() == {"fetched": 5, "skipped": 2, "unique": 2, "duplicates": 1}
    at = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([("s", "running", at(1), at(1), None), ("s", "success", at(2), at(1), None), ("s", "running", at(3), at(3), None), ("s", "error", at(4), at(3), "x" * 600), ("r", "running", at(1), at(1), None)], "source string, status string, at timestamp, started_at timestamp, error string")
    got = {r["source"]: (r["status"], len(r["error"] or ""), r["last_success"]) for r in status.source_state(events).collect()}
    assert got == {"s": ("error", 500, at(1)), "r": ("running", 0, None)}


def test_access_ladder(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    issued = spark.createDataFrame([("good", "small", True, dt.datetime(2024, 1, 1)), ("gone", "small", True, dt.datetime(2024, 1, 1)), ("gone", "small", False, dt.datetime(2024, 1, 2)), ("big", "large", True, dt.datetime(2024, 1, 1)), ("odd", "??", True, dt.datetime(2024, 1, 1))], "key string, plan string, active boolean, created_at timestamp")
    keys = status.key_state(issued)
    made = spark.createDataFrame([("odd", dt.datetime(2024, 1, 30)), ("odd", dt.datetime(2024, 1, 29)), ("good", dt.datetime(2023, 12, 1))], "key string, created_at timestamp")
    used = status.rolling_use(made.select(status.key_digest(F.col("key")).alias("key"), "created_at"), now, F.lit(2)).withColumnRenamed("key", "key_hash")
    calls = spark.createDataFrame([("t", None), ("t", "nope"), ("t", "gone"), ("x", "good"), ("x", "big"), ("t", "odd"), ("t", " good "), ("free", None)], "tool string, key string").withColumn("n", F.monotonically_increasing_id())
    out = status.decide_access(calls, keys, used, {"small": 2, "large": None}, "small", exempt=("free",), restricted=("x",), may_restricted=("large",))
    assert [r["reason"] for r in out.orderBy("n").collect()] == ["missing_key", "invalid_key", "invalid_key", "not_permitted", None, "rate_limit", None, None]


def test_due_status_and_budget(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    states = spark.createDataFrame([("a", "daily", dt.datetime(2024, 1, 9)), ("b", "daily", dt.datetime(2024, 1, 9, 1)), ("c", "weekly", None), ("d", "manual", None), ("e", "weekly", dt.datetime(2024, 1, 3))], "source string, cadence string, last_success timestamp")
    assert {r["source"]: r["due"] for r in status.due(states, now).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}
    docs = spark.createDataFrame([("s", i, dt.datetime(2024, 1, 1 + i)) for i in range(6)] + [("s", 9, None)], "source string, doc_id bigint, updated_at timestamp")
    themes = spark.createDataFrame([(3, 2), (1, 1), (3, 5)], "doc_id bigint, rank int")
    got = {r["doc_id"]: r["why"] for r in status.select_budget(docs, "source", "doc_id", F.col("doc_id") == 0, themes, "updated_at", 5).collect()}
    assert got == {0: "pinned", 1: "theme", 3: "theme", 5: "newest", 4: "newest"}
    counts = status.corpus_counts(docs.withColumn("ingested_at", F.col("updated_at")), F.lit("2024-01-03").cast("timestamp"))
    both = {r["source"]: (r["documents"], r["freshness"]) for r in status.corpus_status(counts, states.select("source", "last_success"), now).collect()}
    assert both["s"] == (7, "never") and both["a"] == (0, "1d ago")


def trial(nct, title, day="2024-01-01"):
    return json.dumps({"protocolSection": {"identificationModule": {"nctId": nct, "briefTitle": title}, "statusModule": {"lastUpdateSubmitDate": day}}})


def test_refresh_takes_new_files_once_and_upserts(spark, tmp_path):
    landing, store = tmp_path / "land", streaming.DocumentStore(spark, str(tmp_path / "docs"))
    landing.mkdir()
    as_of = dt.datetime(2024, 5, 5)
    go = lambda: streaming.refresh(spark, store, "clinical", str(landing), str(tmp_path / "cp"), as_of)
    (landing / "1.json").write_text("\n".join([trial("NCT1", "one"), trial("NCT2", "two"), trial("", "no id")]))
    assert go() == 1 and store.read("clinical").count() == 2
    assert go() == 0 and store.version("clinical") == 1 and len(store.current("clinical")) <= 2
    (landing / "2.json").write_text(trial("NCT2", "two again", "2020-01-01") + "\n" + trial("NCT3", "three"))
    assert go() == 1
    assert {r["doc_id"]: r["title"] for r in store.all().collect()} == {"NCT1": "one", "NCT2": "two again", "NCT3": "three"}
    assert streaming.refresh(spark, store, "clinical", str(landing), str(tmp_path / "cp"), as_of, full=True) == 1
    assert {r["doc_id"]: r["title"] for r in store.all().collect()} == {"NCT1": "one", "NCT2": "two again", "NCT3": "three"}
    state = store.state().first()
    assert state["status"] == "success" and state["last_success"] is not None and go() == 0


def test_store_grows_its_buckets_and_tidies(spark, tmp_path):
    store = streaming.DocumentStore(spark, str(tmp_path / "docs"), buckets=2, rows_per_bucket=10)
    docs = lambda a, b: spark.createDataFrame([("s", f"d{i}", a, i) for i in range(a, b)], "source_id string, doc_id string, title int, arrived int")
    for step in range(5):
        store.put("s", docs(step * 15, step * 15 + 20), ["arrived"])
    got = {r["doc_id"]: r["title"] for r in store.read("s").collect()}
    assert got == {f"d{i}": min(i // 15, 4) * 15 for i in range(80)}
    pointer = store.pointer("s")
    assert pointer.number == 5 and pointer.buckets == 8 and pointer.rows == 80
    names = store._names(f"{store.path}/s")
    assert len([n for n in names if n.startswith("POINTER-")]) == 2 and "v1" not in names
    with pytest.raises(RuntimeError):
        store._publish("s", pointer)


def test_errors_leave_an_event(spark, tmp_path):
    store = streaming.DocumentStore(spark, str(tmp_path / "docs"))
    out = streaming.refresh_all(spark, store, {"clinical": str(tmp_path / "nowhere")}, str(tmp_path / "cp"), dt.datetime(2024, 1, 1))
    assert out["clinical"].startswith("error") and store.state().first()["status"] == "error"
    assert streaming.append_calls(spark, str(tmp_path / "calls"), [{"tool": "t"}]) and not streaming.append_calls(spark, "nofs://x/y", [{"tool": "t"}])


def test_a_failed_batch_is_replayed(spark, tmp_path):
    landing, store, failed = tmp_path / "land", streaming.DocumentStore(spark, str(tmp_path / "docs")), []
    landing.mkdir()
    (landing / "1.json").write_text(trial("NCT1", "one"))

    def flaky(df, as_of):
        if not failed:
            failed.append(1)
            raise RuntimeError("no luck")
        return streaming.NORMALIZERS["clinical"](df, as_of)

    with pytest.raises(Exception):
        streaming.refresh(spark, store, "clinical", str(landing), str(tmp_path / "cp"), dt.datetime(2024, 1, 1), flaky)
    assert streaming.refresh(spark, store, "clinical", str(landing), str(tmp_path / "cp"), dt.datetime(2024, 1, 1), flaky) == 1
    assert store.read("clinical").count() == 1
    out = streaming.refresh_all(spark, store, {"pubmed": str(tmp_path / "nowhere"), "clinical": str(landing)}, str(tmp_path / "cp"), dt.datetime(2024, 1, 1))
    assert out["pubmed"].startswith("error:") and out["clinical"] == "ok: 0 batches"


def test_choice_metering_and_event_stream(spark, sf_dir, tmp_path):
    assert streaming.choose(["a", "b"], ["b"]) == ["b"] and streaming.choose(["a", "b"], everything=True) == ["a", "b"] and streaming.choose(["a", "b"], due=["b"]) == ["b"]
    with pytest.raises(ValueError):
        streaming.choose(["a"], ["z"])
    streaming.append_calls(spark, str(tmp_path / "calls"), [{"tool": "t", "status": "denied"}])
    streaming.append_calls(spark, "/proc/nowhere", [{"tool": "t"}])
    assert spark.read.parquet(str(tmp_path / "calls")).first()["status"] == "denied"
    folder = tmp_path / "events"
    folder.mkdir()
    os.symlink(f"{sf_dir}/events.parquet", folder / "events.parquet")
    for _ in range(2):
        streaming.stream_events(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()
