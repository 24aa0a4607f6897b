"""Retrieval over a document table: nearest vectors, full text, and both fused by reciprocal rank.

Batch forms take many queries at once; ranks are windows per query, pruned to candidates first. Vectors
are compared by blocked matrix products: each task holds one block of queries (at most ``QUERY_BLOCK``, fewer if many results
are kept for each) and streams its own rows, keeping its best k per query, so that only k rows per query and task
are shuffled. One scan of the rows serves a whole block.

Fused search needs two such scans whatever the number of matches: one for the first V rows by vector, one that counts the exact
place by vector of the first lexical hits. V follows from the fused score (``fuse_depth``): a row further down in both lists cannot
reach the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions import text as analysis
from sedimenta.session import cut

RRF_K = 60
QUERY_BLOCK = 65_536
#: Queries of a block times results kept for each, and queries compared with a batch of rows at once.
MOST_KEPT, AT_ONCE = 2_000_000, 512
MOST_RESULTS = 50


def clamp(value: int, least: int = 1, most: int = MOST_RESULTS) -> int:
    return max(least, min(most, int(value)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision, and which rows are real vectors."""
    ok = np.array([v is not None and len(v) > 0 for v in column.to_pylist()]) if column.null_count else np.ones(len(column), bool)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, int(ok.sum()))
    m = np.zeros((len(column), max(1, width)))
    if width:
        m[ok] = flat.reshape(-1, width)
    size = np.linalg.norm(m, axis=1)
    good = ok & (size > 0)
    m[good] /= size[good, None]
    return m, good


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id", vector: str = "embedding", within: str | None = None, exclude_self: bool = True, block: int | None = None) -> DataFrame:
    """The k nearest rows of each query by cosine similarity: (query_key, [within,] key, similarity, place).

    Ties go to the lesser key; null and zero vectors are left out; with ``within`` the k best are found per value
    of that column. Similarities are rounded to 9 places before ranking, so that equal vectors tie everywhere.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    scope = [F.col(within).cast("string").alias("w")] if within else [F.lit("").alias("w")]
    data = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), *scope, F.col(vector).cast("array<double>").alias("v"))
    found = []
    for matrix, names in _blocks(asked, block or max(1, min(QUERY_BLOCK, MOST_KEPT // max(1, k)))):
        sent = spark.sparkContext.broadcast((matrix, names))
        found.append(data.mapInArrow(_scan(sent, k, exclude_self), "q bigint, w string, k bigint, s double"))
    if not found:
        best = spark.createDataFrame([], "q bigint, w string, k bigint, s double")
    else:
        best = reduce(DataFrame.unionByName, found)
    order = W.partitionBy("q", "w").orderBy(F.desc("s"), "k")
    top = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    out = [F.col("q").alias(query_key), *([F.col("w").alias(within)] if within else []), F.col("k").alias(key), F.col("s").alias("similarity"), "place"]
    return top.select(*out)


def pair_similarities(queries: DataFrame, rows: DataFrame, pairs: DataFrame, query_key: str = "query_id", key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(q, k, s) of given (query, row) pairs, by joining both vectors to each pair; pairs without a real vector are left out."""
    wanted = pairs.select(F.col(query_key).cast("bigint").alias("q"), F.col(key).cast("bigint").alias("k")).distinct()
    left = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("a"))
    right = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("b"))
    joined = wanted.join(right, "k").join(left, "q").select("q", "k", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, good), (y, fine) = _matrix(batch.column("a")), _matrix(batch.column("b"))
            s = np.round(np.einsum("ij,ij->i", x, y), 9)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("k"), pa.array(s)], names=["q", "k", "s"]).filter(pa.array(good & fine))

    return joined.mapInArrow(run, "q bigint, k bigint, s double")


def places(queries: DataFrame, rows: DataFrame, pairs: DataFrame, query_key: str = "query_id", key: str = "doc_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """Exact similarity and place among all rows of given (query, row) pairs: (query_key, key, similarity, place).

    ``pairs`` has a bounded number of rows for each query. One scan of the rows serves a block of queries: per task it counts the rows
    that come before each pair of the block. Nothing but the pairs is shuffled, however many rows there are.
    """
    spark = rows.sparkSession
    scored = cut(pair_similarities(queries, rows, pairs, query_key, key, vector))
    lists = scored.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("s", "k"))).alias("_t"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")).join(lists, "q")
    data = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    found = []
    for chunk in _chunks(asked, block or QUERY_BLOCK // 8):
        matrix, names = _unit(chunk)
        marks = {r["q"]: (np.array([x["s"] for x in r["_t"]]), np.array([x["k"] for x in r["_t"]], np.int64)) for r in chunk}
        sent = spark.sparkContext.broadcast((matrix, names, [marks[q] for q in names.tolist()]))
        found.append(data.mapInArrow(_count_before(sent), "q bigint, k bigint, s double, n bigint"))
    if not found:
        return spark.createDataFrame([], f"{query_key} bigint, {key} bigint, similarity double, place bigint")
    counted = reduce(DataFrame.unionByName, found).groupBy("q", "k", "s").agg((F.sum("n") + 1).alias("place"))
    return counted.select(F.col("q").alias(query_key), F.col("k").alias(key), F.col("s").alias("similarity"), "place")


def _before(levels: np.ndarray, owners: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every (level, owner) in ascending order of level: how many (value, key) come before it, greater first, ties by lesser key."""
    at = np.searchsorted(levels, values, side="left")
    n = len(levels)
    counts = np.bincount(at, minlength=n + 1)[::-1].cumsum()[::-1][1:]
    tied = np.flatnonzero((at < n) & (levels[np.minimum(at, n - 1)] == values))
    for i in tied.tolist():
        for j in range(int(at[i]), n):
            if levels[j] != values[i]:
                break
            counts[j] += keys[i] < owners[j]
    return counts


def _count_before(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names, marks = sent.value
        counts = [np.zeros(len(levels), np.int64) for levels, _ in marks]
        for batch in batches:
            m, good = _matrix(batch.column("v"))
            m, keys = m[good], batch.column("k").to_numpy(zero_copy_only=False)[good]
            for begin in range(0, len(names), AT_ONCE):
                s = np.round(matrix[begin : begin + AT_ONCE] @ m.T, 9)
                for i, row in enumerate(s, begin):
                    counts[i] += _before(*marks[i], row, keys)
        sizes = [len(c) for c in counts]
        if sum(sizes):
            columns = [np.repeat(names, sizes), np.concatenate([k for _, k in marks]), np.concatenate([s for s, _ in marks]), np.concatenate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "k", "s", "n"])

    return run


def _chunks(df: DataFrame, size: int) -> Iterator[list]:
    batch = []
    for row in df.toLocalIterator():
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def _blocks(asked: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query vectors in blocks of at most ``block`` rows, one at a time on the driver."""
    for chunk in _chunks(asked, block):
        yield _unit(chunk)


def _unit(batch: list) -> tuple[np.ndarray, np.ndarray]:
    if not batch:
        return np.zeros((0, 1)), np.zeros(0, np.int64)
    m = np.array([r["v"] for r in batch], np.float64)
    size = np.linalg.norm(m, axis=1)
    good = size > 0
    return m[good] / size[good, None], np.array([r["q"] for r in batch], np.int64)[good]


def _likely(s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each row that can be among its k best, ties at the k-th kept; rows are filled up with lesser ones."""
    if s.shape[1] <= 4 * k:
        return s, own
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    mask = s >= least[:, None]
    most = int(mask.sum(axis=1).max())
    keep = np.argsort(~mask, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(s, keep, 1), np.take_along_axis(own, keep, 1)


def _scan(sent, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = sent.value
        best: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            m, good = _matrix(batch.column("v"))
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            scope = np.array(batch.column("w").to_pylist(), object)
            for w in set(scope[good].tolist()):
                pick = good & (scope == w)
                for begin in range(0, len(names), AT_ONCE):
                    s = np.round(matrix[begin : begin + AT_ONCE] @ m[pick].T, 9)
                    own = np.broadcast_to(keys[pick], s.shape)
                    if exclude_self:
                        s = np.where(own == names[begin : begin + AT_ONCE, None], -np.inf, s)
                    if (begin, w) in best:
                        s, own = np.hstack([best[begin, w][0], s]), np.hstack([best[begin, w][1], own])
                    s, own = _likely(s, own, k)
                    order = np.lexsort((own, -s), axis=1)[:, :k]
                    best[begin, w] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
        for (begin, w), (s, own) in best.items():
            real = np.isfinite(s)
            q = np.broadcast_to(names[begin : begin + AT_ONCE, None], s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array([w] * int(real.sum()), pa.string()), pa.array(own[real].astype(np.int64)), pa.array(s[real])], names=["q", "w", "k", "s"])

    return run


# ---------------------------------------------------------------- full text


#: Places of the table that tells which terms may be wanted; a byte each, however many terms there are.
PLACES = 1 << 20


def _place(term: str):
    return F.pmod(F.xxhash64(term), F.lit(PLACES)).cast("int")


def _places_of(terms: DataFrame) -> DataFrame:
    """One row and column: a byte for every place, 1 where one of the terms falls."""
    at = terms.select((_place("term") + 1).alias("p"))
    bits = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    table = np.zeros(PLACES, np.uint8)
    for b, m in bits.collect():
        part = np.unpackbits(np.frombuffer(bytes(m), np.uint8), bitorder="little")
        begin = (b - 1) * len(part)
        table[begin : begin + len(part)] = part[: PLACES - begin]
    return terms.sparkSession.createDataFrame([(bytearray(table.tobytes()),)], "places binary")


def postings(docs: DataFrame, key: str, terms: str, only: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """Inverted index: (term, key, tf, length) of every document; for a few known terms, only theirs is built.

    ``among`` has any number of wanted terms (column ``term``): all of theirs are built, and of others hardly any, which are left out
    before the shuffle by a table of bounded size.
    """
    kept = F.col(terms) if only is None else F.filter(terms, lambda t: t.isin(only))
    exploded = docs.select(key, F.size(terms).alias("length"), F.explode(kept).alias("term"))
    if among is not None:
        exploded = exploded.where(F.substring(_places_of(among).scalar(), _place("term") + 1, F.lit(1)) == F.lit(bytearray(b"\x01")))
    return exploded.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def query_terms(queries: list[tuple[int, str]], df: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, term, wanted): the distinct terms of a few written queries, and how many each has."""
    rows = []
    for q, text in queries:
        terms = sorted(set(analysis.analyze(text, stem)))
        rows += [(q, t, len(terms)) for t in terms]
    return df.sparkSession.createDataFrame(rows, "query_id bigint, term string, wanted int")


def term_matches(index: DataFrame, wanted: DataFrame, key: str, every: bool, group: str = "query_id", by_rarest: bool = True) -> DataFrame:
    """(group, key, rank): documents with all (or any) of a query's terms, through the inverted index.

    ``wanted`` has (group, term, wanted), the distinct terms of each query and their number. rank is the sum of 1 + ln(tf),
    divided by 1 + ln(1 + length). If every term is needed, only the postings of a query's rarest term become
    candidates, and the other terms are looked up for those; a term that most documents have is never joined whole.
    For a handful of queries the plain join is cheaper (``by_rarest`` false).
    """
    asked = wanted.select(group, "term", "wanted")
    if every and by_rarest:
        frequency = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_df"))
        rarest = asked.join(frequency, "term", "left").groupBy(group).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "term")).alias("_r"))
        first = rarest.where(F.col("_r.df") > 0).select(group, F.col("_r.term").alias("term"))
        candidates = first.join(index.select("term", key), "term").select(group, key)
        hits = candidates.join(asked, group).join(index, [key, "term"])
    else:
        hits = index.join(asked, "term")
    scored = hits.groupBy(group, key).agg(F.count("*").alias("_n"), F.max("wanted").alias("_w"), (F.sum(1.0 + F.log(F.col("tf").cast("double"))) / (1.0 + F.log(1.0 + F.max("length")))).alias("rank"))
    if every:
        scored = scored.where(F.col("_n") == F.col("_w"))
    return scored.select(group, key, F.round("rank", 9).alias("rank"))


def top_by_source(scored: DataFrame, wanted: dict[str, int], score: str, key: str, group: list[str], source: str = "source") -> DataFrame:
    """The best rows per group and source, so many of each source as ``wanted`` says; other sources are left out."""
    limit = None
    for name, k in wanted.items():
        limit = F.when(F.col(source) == name, k) if limit is None else limit.when(F.col(source) == name, k)
    order = W.partitionBy(*group, source).orderBy(F.desc(score), key)
    kept = scored.where(F.col(source).isin(*wanted))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def top(scored: DataFrame, k: int, score: str, key: str, group: list[str], offset: int = 0) -> DataFrame:
    """The k best rows per group after an offset; ties go to the lesser key."""
    order = W.partitionBy(*group).orderBy(F.desc(score), key)
    return scored.withColumn("place", F.row_number().over(order)).where((F.col("place") > offset) & (F.col("place") <= offset + k))


#: Lexical hits of each query, in multiples of the results asked for, whose place by vector is counted exactly.
EXACT_HITS = 5


def fuse_depth(k: int, hits: int) -> int:
    """How far down the vector list a row may lie that is not among the first ``hits`` lexical ones, and still be among the k best.

    The k best by vector alone score 1 / (RRF_K + k) at least; beside its vector place v, the row scores 1 / (RRF_K + hits + 1) at most.
    """
    room = 1.0 / (RRF_K + k) - 1.0 / (RRF_K + hits + 1)
    return max(k, int(1.0 / room - RRF_K) + 1)


def fuse(vector: DataFrame, lexical: DataFrame, key: str, group: list[str], k: int, offset: int = 0) -> DataFrame:
    """Reciprocal rank fusion: (group, key, similarity, score, place).

    ``vector`` has (group, key, similarity, place) by vector of every document that can reach the result, ``lexical`` (group, key, nth)
    the lexical place of the matching ones.
    """
    x = lexical.select(*group, key, F.col("nth").alias("_x"))
    both = vector.withColumnRenamed("place", "_v").join(x, [*group, key], "left")
    score = F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("_v")) + F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("_x")), F.lit(0.0))
    both = both.withColumn("score", F.round(score, 12))
    order = W.partitionBy(*group).orderBy(F.desc("score"), F.desc("similarity"), key)
    return both.withColumn("place", F.row_number().over(order)).where((F.col("place") > offset) & (F.col("place") <= offset + k)).select(*group, key, "similarity", "score", "place")


def hybrid(queries: DataFrame, rows: DataFrame, lexical: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Both arms fused: the nearest by vector, and the first lexical hits with their exact place by vector.

    Both arms are used several times, so each is written once to the checkpoint folder.
    """
    hits = EXACT_HITS * (offset + k)
    near = cut(search_nearest(queries, rows, fuse_depth(offset + k, hits)))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank"), "doc_id"))
    lexical = cut(lexical.withColumn("nth", nth).select("query_id", "doc_id", "nth"))
    first = lexical.where(F.col("nth") <= hits).join(near.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return fuse(near.unionByName(places(queries, rows, first)), lexical, "doc_id", ["query_id"], k, offset)


def search_nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Nearest rows with the query itself among them, places as wide as exact ones."""
    near = nearest(queries, rows, k, exclude_self=False)
    return near.withColumn("place", F.col("place").cast("bigint"))


def search_text(docs: DataFrame, query: str, k: int = 10, offset: int = 0, terms: str = "terms", key: str = "doc_id") -> DataFrame:
    """One written query with the whole query language, over a column of stemmed terms."""
    parsed = analysis.parse_query(query)
    hits = docs.where(analysis.matches(parsed, F.col(terms)))
    wanted = F.array(*[F.lit(t) for t in parsed.terms]) if parsed.terms else F.array().cast("array<string>")
    ranked = hits.withColumn("rank", F.round(analysis.lexical_rank(wanted, F.col(terms)), 9))
    return ranked.orderBy(F.desc("rank"), key).offset(max(0, offset)).limit(clamp(k))


def details(docs: DataFrame, source: str, doc_id: str, source_column: str = "source", key: str = "native_id") -> DataFrame:
    """One document by its id, as JSON beside its columns."""
    return docs.where((F.col(source_column) == source) & (F.col(key) == doc_id)).withColumn("record", F.to_json(F.struct(*docs.columns)))
