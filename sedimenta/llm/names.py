"""Variant spellings of names typed by people, linked to the entity they mean.

1. **Words.** A name is folded (case, accents), quantities and brackets are taken off, and the rest falls into words. Words that
   name nothing (forms, salts, legal suffixes and their shortenings) are learned from the corpus (``additions``): they stand
   beside many different names and hardly ever alone. No list of them is written down.
2. **Nodes.** Spellings with the same remaining words, in any order, are one node with the sum of their counts.
3. **Candidates.** Names of several words, and long ones, meet by MinHash banding over padded q-grams of their words, the number of
   bands taken from the collision curve for a wanted recall. Words of up to ``LONG_WORD`` letters, which are made of the same few
   syllables and so share q-grams by chance, meet by what is left of them without the letters that verification may forgive
   (``deletions``), and by their beginnings.
4. **Verification.** Monge-Elkan similarity over words, whose inner measure weighs slips of the hand.
5. **Decision.** Alike is not the same: real names differ by a letter too. Two classes of verified pairs, same and different, are told
   apart by a mixture over three features of a pair (``FEATURES``) in the manner of Fellegi and Sunter, estimated from the corpus by
   expectation maximization, with a stated prior that decides where there is little data (``PRIOR``).
6. **Clusters.** Star clustering: a spelling joins the most similar more frequent one.

Candidates lead from a spelling to one ``DOMINANCE`` times as frequent; what such a one does not claim is compared with whatever
else is left, whatever its frequency. So two rare spellings are linked as well, yet the many slips of one name are not
paired with each other.

Defined results: null and blank names are left out; repeated rows only add to a spelling's count; a name of
which nothing is left keeps its whole folded text; ties go to the greater count, then the lesser id.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.session import cut

# ---------------------------------------------------------------- words

_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_RATIO = re.compile(r"\d[\d.,]*\s*[a-z%]{0,4}\s*/\s*[\d.,]*\s*[a-z]{1,4}\b")
_DOTTED = re.compile(r"\b(?:[a-z]\.){1,}[a-z]{1,4}\b\.?")
_INNER = re.compile(r"(?<=[a-z])['’\-](?=[a-z])")
_PART = re.compile(r"[\\/+&;,]|\band\b")
_WORD = re.compile(r"[^\W_]+")


def fold(name: str) -> str:
    """Lower case without accents, ``ph`` as it sounds."""
    text = unicodedata.normalize("NFKD", name)
    return "".join(c for c in text if not unicodedata.combining(c)).lower().strip().replace("ph", "f")


def parts_of(name: str) -> list[list[str]]:
    """Words of a name in order, part by part; parts are divided by commas, slashes, ``and`` and the like.

    Words that begin with a digit are quantities and left out.
    """
    text = _INNER.sub("", _DOTTED.sub(lambda m: m[0].replace(".", ""), fold(name)))
    for plain in (_RATIO.sub(" ", _BRACKETS.sub(" ", text)), text):
        parts = [[w for w in _WORD.findall(p) if not w[0].isdigit()] for p in _PART.split(plain)]
        parts = [p for p in parts if p]
        if parts:
            return parts
    return []


# ---------------------------------------------------------------- words that name nothing

#: A word's company: words of the same part so far to either side.
NEAR = 6
#: Company is counted by first letters, so that misspelled company counts once.
STEM = 3
#: Company that belongs to the word alone: the sum over its companions of one divided by their own companions.
COMMON_COMPANY = 2.4
#: A rarer addition has so many different companions, evenly counted (leaving out one that it may form a phrase with), is seldom
#: without one, and these are often seen without it and keep less company themselves.
LEAST_COMPANY, LEAST_ACCOMPANIED, LEAST_APART = 2.5, 0.5, 0.2
#: Longest word that shortens another by leaving out letters; longer ones do by their end.
LONGEST_SHORT = 6


def shortens(short: str, long: str) -> bool:
    """Whether a word is a shortening of another: its beginning, or, up to LONGEST_SHORT, letters of it in order, the first one kept."""
    if not short or len(short) >= len(long) or short[0] != long[0]:
        return False
    if len(short) > LONGEST_SHORT:
        return long.startswith(short)
    rest = iter(long)
    return all(c in rest for c in short)


def additions(names: DataFrame) -> DataFrame:
    """(field, word): words that name nothing, learned from the distinct spellings (field, name, n, parts) of a field.

    First the plain ones: what stands beside many different words that keep no other company. Then the rarer ones: what, these
    taken away, is still mostly accompanied, and by different words. Then short forms of either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for field, n, parts in zip(b.column("field").to_pylist(), b.column("n").to_pylist(), b.column("parts").to_pylist()):
                for part in parts:
                    if len(part) == 1 and len(parts) > 1:  # neither alone nor beside a word
                        continue
                    for i, w in enumerate(part):
                        if len(w) == 1:  # an initial may stand for anything
                            continue
                        out.append((field, w, None, n))
                        out += [(field, w, v, n) for v in {*part[max(0, i - NEAR) : i], *part[i + 1 : i + 1 + NEAR]} if v != w and len(v) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["field", "word", "beside", "n"])

    seen = names.mapInArrow(run, "field string, word string, beside string, n bigint")
    seen = cut(seen.groupBy("field", "word", "beside").agg(F.sum("n").alias("n"), F.count("*").alias("spellings")))
    total = seen.where("beside is null").select("field", "word", F.col("n").alias("total"), "spellings")
    pairs = seen.where("beside is not null").withColumn("near", F.left("beside", F.lit(STEM)))
    reach = pairs.groupBy("field", F.left("word", F.lit(STEM)).alias("near")).agg(F.count_distinct("near").alias("reach"))
    own = pairs.select("field", "word", "near").distinct().join(reach, ["field", "near"]).groupBy("field", "word").agg(F.sum(1.0 / F.col("reach")).alias("own"))
    plain = cut(own.where(F.col("own") >= COMMON_COMPANY).select("field", "word"))
    left = pairs.join(plain.withColumnRenamed("word", "beside"), ["field", "beside"], "left_anti")
    left = left.join(total.select("field", F.col("word").alias("beside"), F.col("total").alias("_all")), ["field", "beside"])
    by_stem = left.groupBy("field", "word", "near").agg(F.sum("spellings").alias("x"), F.sum("n").alias("with"), F.sum(F.col("n") * (1 - F.col("n") / F.col("_all"))).alias("apart"))
    company = by_stem.groupBy("field", "word").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.max("x").alias("top"), F.sum("with").alias("with"), (F.sum("apart") / F.sum("with")).alias("apart"))
    told = company.join(total, ["field", "word"]).withColumn("accompanied", F.least(F.lit(1.0), F.col("with") / F.col("total")))
    rest = F.col("x") - F.col("top")
    evenly = F.when(4 * rest >= F.col("spellings"), F.try_divide(F.pow(rest, 2), F.col("xx") - F.col("top") * F.col("top")))
    told = told.withColumn("company", F.greatest(F.pow("x", 2) / F.col("xx"), F.coalesce(evenly, F.lit(1.0))))
    told = cut(told.select("field", "word", "company", "accompanied", "apart", "spellings"))
    theirs = left.select("field", "word", "beside", left["spellings"].alias("_n")).join(told.select("field", F.col("word").alias("beside"), F.col("company").alias("_c")), ["field", "beside"])
    theirs = theirs.groupBy("field", "word").agg((F.sum(F.col("_n") * F.col("_c")) / F.sum("_n")).alias("theirs"))
    kept = told.join(theirs, ["field", "word"]).where(F.col("accompanied") >= LEAST_ACCOMPANIED)
    rarer = kept.where((F.col("company") > F.col("theirs")) & (F.col("apart") >= LEAST_APART) & (F.least(F.col("company"), F.col("spellings").cast("double")) >= LEAST_COMPANY))
    known = cut(plain.unionByName(rarer.select("field", "word")).distinct())
    short = kept.select("field", "word", F.left("word", F.lit(1)).alias("first"))
    pairs_of_forms = short.join(known.select("field", F.col("word").alias("long"), F.left("word", F.lit(1)).alias("first")), ["field", "first"]).select("field", "word", "long")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [shortens(w, x) for w, x in zip(b.column("word").to_pylist(), b.column("long").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select(["field", "word"])

    return cut(known.unionByName(pairs_of_forms.mapInArrow(forms, "field string, word string")).distinct())


# ---------------------------------------------------------------- MinHash banding

GRAM = 3
ROWS = 4
WANTED_SIMILARITY, WANTED_RECALL = 0.36, 0.95
#: Words of up to so many letters meet by what is left without a few of them, longer ones by MinHash; those near the limit by both.
LONG_WORD = 20
#: A word with this share of a name's letters may stand for the name; what is left is an initial or too little to count.
MAIN_WORD = 0.7


def collision(similarity: float, rows: int, bands: int) -> float:
    """Chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float = WANTED_SIMILARITY, recall: float = WANTED_RECALL, rows: int = ROWS) -> int:
    """Fewest bands whose collision curve reaches the recall at the similarity."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def grams(tokens: list[str], q: int = GRAM) -> set[str]:
    """Padded q-grams of every token; the order of tokens does not matter."""
    out = set()
    for t in tokens:
        padded = "^" * (q - 1) + t + "$" * (q - 1)
        out.update(padded[i : i + q] for i in range(len(padded) - q + 1))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    draw = lambda: random.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]
    return draw() | np.uint64(1), draw()


def band_hashes(tokens: list[str], bands: int, rows: int = ROWS, salt: int = 0) -> np.ndarray:
    """One 64-bit hash per band, different for every band and salt. A row is the least multiply-shift hash of the q-grams."""
    x = np.array([zlib.crc32(g.encode()) for g in grams(tokens)], np.uint64)
    a, b = _functions(bands * rows)
    low = ((x[None, :] * a + b) >> np.uint64(32)).min(axis=1).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) + np.uint64((salt * int(_MIX)) & 0xFFFFFFFFFFFFFFFF)
    for j in range(rows):
        out = (out ^ low[:, j]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(LONG_WORD + 2, _BASE)]), dtype=np.uint64)


def plain_form(word: str) -> str:
    """A word without what slips change at little cost: each ``h``, and letters doubled or more."""
    return "".join(c for c, _ in groupby(word.replace("h", ""))) or word[:1]


def deletions(word: str, salt: int = 0, most: int = 2) -> np.ndarray:
    """Hashes of a word of up to LONG_WORD + 2 letters and of what is left of it without one letter, or up to two.

    Two words that differ by so many letters lost, added or changed share one: each is left without the letters that differ.
    """
    n = len(word)
    c, power = _mixed(np.fromiter(map(ord, word), np.uint64, n)), _powers()
    # sums of letters by place, and by the place they have after one and two letters are gone
    p0, p1, p2 = (np.concatenate([np.zeros(k + 1, np.uint64), np.cumsum(c[k:] * power[: max(0, n - k)], dtype=np.uint64)])[: n + 1] for k in range(3))
    parts = [p0[n:], p0[:n] + p1[n] - p1[1:]]
    if most > 1 and n > 1:
        i, j = np.triu_indices(n, 1)
        parts.append(p0[i] + p1[j] - p1[i + 1] + p2[n] - p2[j + 1])
    return np.unique(_mixed(np.concatenate(parts) ^ _mixed(np.array([salt + 1], np.uint64)))).view(np.int64)


def beginnings(word: str, salt: int = 0) -> np.ndarray:
    """Hashes of a word and of its beginnings that ``word_similarity`` takes for the word cut off."""
    least = max(5, math.ceil(0.55 * len(word)))
    return np.array([(zlib.crc32(word[:i].encode(), (salt + 7) & 0xFFFFFFFF) << 31) ^ zlib.crc32(word[i - 1 :: -1].encode()) for i in range(least, len(word) + 1)], np.int64)


def word_keys(word: str, bands: int, rows: int = ROWS, salt: int = 0) -> list[np.ndarray]:
    """Keys by which a single word, or a name drawn into one, meets others."""
    plain = plain_form(word)
    if len(plain) > LONG_WORD:
        return [band_hashes([word], bands, rows, salt)]
    most = 2 if allowed(len(word)) >= 2 * SLIP else 1
    # also as written: a slip between doubled letters counts more in the plain form
    keys = [*(deletions(x, salt, most) for x in dict.fromkeys((plain, word)) if len(x) <= LONG_WORD + 2), beginnings(word, salt)]
    return [*keys, band_hashes([word], bands, rows, salt)] if len(plain) > LONG_WORD - 2 else keys


def meeting_keys(tokens: list[str], joined: str, bands: int, rows: int = ROWS, salt: int = 0) -> np.ndarray:
    """All keys by which a name meets others: those of its word, or bands of its words and the keys of the words drawn into one, of its
    short forms, and of a word that makes up most of the name."""
    if len(tokens) == 1:
        return np.unique(np.concatenate(word_keys(tokens[0], bands, rows, salt)))
    most = [w for w in tokens if len(w) >= MAIN_WORD * sum(map(len, tokens))]
    keys = [k for x in dict.fromkeys([joined, *short_forms(tokens), *most]) for k in word_keys(x, bands, rows, salt)]
    return np.unique(np.concatenate([band_hashes(tokens, bands, rows, salt), *keys]))


def short_forms(tokens: list[str]) -> list[str]:
    """Names of two words drawn together: the first four letters of either, with all or four of the other."""
    if len(tokens) != 2 or min(map(len, tokens)) < 4:
        return []
    out = []
    for a, b in (tokens, tokens[::-1]):
        out += [a[:4] + b[:4], a[:4] + b]
    return out


# ---------------------------------------------------------------- Monge-Elkan with slips of the hand

_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(_KEYS) for i, c in enumerate(row)}
_SOUND = {frozenset(p) for p in ("ck", "iy", "bv", "vw", "sz", "mn", "fv", "dt", "cs", "gj", "kq", "td")}
VOWELS = set("aeiou")
#: Cost of changes: a slip (neighbouring key, like sound, swap, letter lost or added), a doubled letter or silent h, any other letter.
SLIP, DOUBLED, OTHER = 1.0, 0.6, 1.5


def neighbours(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE:
        return False
    (r, x), (s, y) = _PLACE[a], _PLACE[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1.0


def change_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if neighbours(a, b) or frozenset((a, b)) in _SOUND:
        return SLIP
    return OTHER


def slip_distance(a: str, b: str, limit: float) -> float:
    """Weighted edit distance with swaps; ``inf`` beyond the limit."""
    n, m = len(a), len(b)
    if abs(n - m) * DOUBLED > limit:
        return math.inf
    two, one = None, [j * SLIP for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[i - 1]
        row = [i * SLIP]
        for j in range(1, m + 1):
            y = b[j - 1]
            best = one[j - 1] + change_cost(x, y)
            lost = one[j] + (DOUBLED if i > 1 and a[i - 2] == x or x == "h" else SLIP)
            added = row[j - 1] + (DOUBLED if j > 1 and b[j - 2] == y or y == "h" else SLIP)
            best = lost if lost < best else best
            best = added if added < best else best
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + SLIP)
            row.append(best)
        if min(row) > limit:
            return math.inf
        two, one = one, row
    return one[m] if one[m] <= limit else math.inf


def allowed(n: int) -> float:
    """Cost of slips that a word of so many letters may carry."""
    return 1.0 if n < 6 else 1.6 if n < 8 else 2.2


@lru_cache(maxsize=200_000)
def word_similarity(a: str, b: str) -> float:
    """1 for equal words, falling with the cost of slips; a cut-off word counts as nearly equal."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if long.startswith(short):
        if len(short) == 1:
            return 0.80
        if len(short) >= 5 and len(short) >= 0.55 * len(long):
            return 1 - 0.08 - 0.01 * (len(long) - len(short))
    limit = allowed(len(short))
    cost = slip_distance(a, b, limit)
    return 0.0 if cost == math.inf else 1 - 0.07 * cost


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The lesser of the two directed means of best word matches, words weighed by their letters."""

    def directed(x: list[str], y: list[str]) -> float:
        return sum(len(p) * max(word_similarity(p, q) for q in y) for p in x) / sum(map(len, x))

    forth = directed(a, b)
    return min(forth, directed(b, a)) if forth > 0 else 0.0


def name_similarity(a: list[str], b: list[str], joined_a: str | None = None, joined_b: str | None = None) -> float:
    """Monge-Elkan similarity of two names, of the names drawn into one word, or of one with a short form of the other."""
    best = monge_elkan(a, b)
    if len(a) != len(b):
        best = max(best, word_similarity(joined_a or "".join(a), joined_b or "".join(b)))
        for x, y in ((a, b), (b, a)):
            if len(x) == 1 and len(y) == 2:
                for form in short_forms(y):
                    cost = 0.0 if x[0] == form else slip_distance(x[0], form, SLIP)
                    best = max(best, 0.0 if cost == math.inf else 0.95 - 0.07 * cost)
    return best


LEAST_SIMILARITY = 0.80

# ---------------------------------------------------------------- same or different

#: How two names differ: not by letters; one letter by a neighbouring key, a neighbouring vowel, any vowel, any letter; one
#: letter lost, added, doubled or swapped; more than that.
KINDS = ("form", "key", "near vowel", "vowel", "letter", "slip", "slips")


def difference(a: list[str], b: list[str]) -> int:
    """Index into KINDS, by the words that are not in both names."""
    x, y = "".join(w for w in a if w not in b), "".join(w for w in b if w not in a)
    if not x or not y or x.startswith(y) or y.startswith(x) or "".join(a) == "".join(b):
        return 0
    if len(x) == len(y):
        odd = [(p, q) for p, q in zip(x, y) if p != q]
        if len(odd) == 1:
            p, q = odd[0]
            near = change_cost(p, q) == SLIP
            return (2 if near else 3) if p in VOWELS and q in VOWELS else 1 if near else 4
    return 5 if slip_distance(x, y, SLIP) <= SLIP else 6


#: Share of the mentions of a name that one slip of it may well have. How far a spelling exceeds that is its surprise, in nats.
SLIP_SHARE = 0.05
SURPRISE = (0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 64.0)
#: Size of the rarer spelling against the usual entity of its field, in powers of two.
SIZE = (-4.0, -2.0, -1.0, 0.0, 1.0, 2.0)
FEATURES = ("kind", "surprise", "size")
#: Before any data: chance of each value if two names are the same, and if they are different; how many pairs that is worth.
PRIOR = {
    "kind": ((0.45, 0.08, 0.02, 0.01, 0.04, 0.30, 0.10), (0.05, 0.07, 0.10, 0.30, 0.15, 0.08, 0.25)),
    "surprise": ((0.80, 0.08, 0.05, 0.03, 0.02, 0.01, 0.007, 0.003), (0.25, 0.08, 0.08, 0.09, 0.10, 0.10, 0.15, 0.15)),
    "size": ((0.40, 0.25, 0.12, 0.08, 0.07, 0.05, 0.03), (0.02, 0.06, 0.12, 0.30, 0.30, 0.12, 0.08)),
}
PRIOR_SAME, PRIOR_PAIRS, ROUNDS = 0.8, 60.0, 40


def estimate(counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Chance of being the same for every cell of a table of pairs (kinds, surprises, sizes), by expectation maximization.

    Features count as independent within a class; the prior stands for PRIOR_PAIRS pairs of each class.
    """
    tables = [np.array(PRIOR[f]) for f in FEATURES]
    tables = [t / t.sum(axis=1, keepdims=True) for t in tables]
    prior, share = [t.copy() for t in tables], PRIOR_SAME
    for _ in range(rounds + 1):
        odds = []
        for c in (0, 1):
            part = np.log(share if c == 0 else 1 - share)
            odds.append(part + np.log(tables[0][c])[:, None, None] + np.log(tables[1][c])[None, :, None] + np.log(tables[2][c])[None, None, :])
        same = 1 / (1 + np.exp(odds[1] - odds[0]))
        for c, weight in enumerate((same, 1 - same)):
            held = counts * weight
            for k, others in enumerate(((1, 2), (0, 2), (0, 1))):
                t = held.sum(axis=others) + PRIOR_PAIRS * prior[k][c]
                tables[k][c] = t / t.sum()
        total = counts.sum()
        share = ((counts * same).sum() + PRIOR_PAIRS * PRIOR_SAME) / (total + PRIOR_PAIRS)
    return same


# ---------------------------------------------------------------- Spark operator

#: A spelling is first compared with those so many times as frequent.
DOMINANCE = 2.5
#: Nodes that share a key are compared in shares of so many.
SHARE = 1000


def _wide(df: DataFrame, *keys: str) -> DataFrame:
    """Spread over every core for work that is heavier than its bytes tell; adaptive execution leaves a stated number as it is."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spellings(df: DataFrame, column: str, field: str) -> DataFrame:
    """(field, name, n): distinct spellings with their counts, counted map-side first."""
    named = df.where(F.col(column).isNotNull() & (F.trim(column) != ""))
    return named.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(field).alias("field"), "name", "n")


def with_parts(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([parts_of(x) for x in b.column("name").to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("name"), b.column("n"), parts], names=["field", "name", "n", "parts"])

    return _wide(names, "field", "name").mapInArrow(run, "field string, name string, n bigint, parts array<array<string>>")


def with_core(parted: DataFrame, dropped: DataFrame) -> DataFrame:
    """(field, name, n, core, joined, node): the words that name the entity, sorted, and drawn into one in their own order."""
    words = parted.select("field", "name", F.posexplode(F.flatten("parts")).alias("at", "word")).join(dropped, ["field", "word"], "left_anti")
    left = words.groupBy("field", "name").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_w"))
    whole = F.flatten("parts")
    told = parted.join(left, ["field", "name"], "left").withColumn("_w", F.coalesce(F.transform("_w", lambda x: x["word"]), whole))
    bare = F.regexp_replace(F.lower("name"), r"(?U)\s+", "")
    told = told.withColumn("_w", F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.array(bare)))
    cored = told.select("field", "name", "n", F.array_join(F.array_sort(F.array_distinct("_w")), " ").alias("core"), F.array_join("_w", "").alias("joined"))
    return cored.withColumn("node", F.xxhash64("field", "core"))


def meetings(nodes: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """(key, node, weight): the keys by which each node meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salts = [zlib.crc32(f.encode()) for f in b.column("field").to_pylist()]
            keys = [meeting_keys(c.split(" "), j, bands, rows, s) for c, j, s in zip(b.column("core").to_pylist(), b.column("joined").to_pylist(), salts)]
            if not keys:
                continue
            owner = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column("node").take(owner), b.column("weight").take(owner)], names=["key", "node", "weight"])

    return _wide(nodes.select("field", "core", "joined", "node", "weight"), "node").mapInArrow(run, "key bigint, node bigint, weight bigint")


def shared_keys(met: DataFrame) -> DataFrame:
    """(key, node, weight, shares) of the keys that several nodes have, and how many shares of SHARE nodes that makes."""
    counted = met.withColumn("_c", F.count("*").over(W.partitionBy("key"))).where(F.col("_c") > 1)
    return counted.select("key", "node", "weight", F.ceil(F.col("_c") / SHARE).cast("int").alias("_shares"))


def candidates(shared: DataFrame, dominance: float | None) -> DataFrame:
    """(rare, frequent): nodes that share a key, each pair once.

    With ``dominance`` the second is so many times as frequent; without, it is more frequent, or as frequent with a lesser id. The rare side
    of a key that more than SHARE nodes share is cut into shares, to each of which the frequent side is sent, so the key is
    spread over tasks.
    """
    rare = shared.select("key", F.pmod(F.xxhash64("node"), "_shares").cast("int").alias("_share"), F.col("node").alias("rare"), F.col("weight").alias("_w"))
    frequent = shared.where(F.col("weight") >= dominance) if dominance else shared
    frequent = frequent.select("key", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), F.col("node").alias("frequent"), F.col("weight").alias("_v"))
    ahead = F.col("_v") >= F.col("_w") * dominance if dominance else (F.col("_v") > F.col("_w")) | ((F.col("_v") == F.col("_w")) & (F.col("frequent") < F.col("rare")))
    pairs = rare.join(frequent, ["key", "_share"]).where(ahead & (F.col("rare") != F.col("frequent")))
    return pairs.select("rare", "frequent").distinct()


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rare, frequent, field, similarity, kind, wa, weight) of the pairs that Monge-Elkan accepts; weight is that of the frequent node."""
    left = nodes.select(F.col("node").alias("rare"), F.col("core").alias("a"), F.col("joined").alias("ja"), F.col("weight").alias("wa"), "field")
    right = nodes.select(F.col("node").alias("frequent"), F.col("core").alias("b"), F.col("joined").alias("jb"), "weight")
    full = _wide(pairs.join(left, "rare").join(right, "frequent"), "rare", "frequent").select("rare", "frequent", "field", "a", "b", "ja", "jb", "wa", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [[x.split(" ") for x in batch.column(c).to_pylist()] for c in ("a", "b")]
            scores = [name_similarity(a, b, ja, jb) for a, b, ja, jb in zip(*names, batch.column("ja").to_pylist(), batch.column("jb").to_pylist())]
            kinds = [difference(a, b) if s >= LEAST_SIMILARITY else 0 for a, b, s in zip(*names, scores)]
            keep = pa.array([s >= LEAST_SIMILARITY for s in scores], pa.bool_())
            columns = [batch.column(c) for c in ("rare", "frequent", "field")] + [pa.array(scores, pa.float64()), pa.array(kinds, pa.int32()), batch.column("wa"), batch.column("weight")]
            yield pa.RecordBatch.from_arrays(columns, names=["rare", "frequent", "field", "similarity", "kind", "wa", "weight"]).filter(keep)

    return full.mapInArrow(run, "rare bigint, frequent bigint, field string, similarity double, kind int, wa bigint, weight bigint")


def unclaimed(nodes: DataFrame, verified: DataFrame) -> DataFrame:
    """Nodes without a far more frequent one that they differ from by more than a vowel."""
    claimed = verified.where(~F.col("kind").isin(KINDS.index("near vowel"), KINDS.index("vowel"))).select(F.col("rare").alias("node")).distinct()
    return nodes.join(claimed, "node", "left_anti")


def _bin(value, edges: tuple[float, ...]):
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(value <= edge, i).otherwise(out)
    return out


def with_features(verified: DataFrame, usual: DataFrame) -> DataFrame:
    """Adds surprise and size, as bins; ``usual`` has (field, usual), the usual weight of an entity."""
    n = F.col("wa") + F.col("weight")
    x = F.col("wa") / n
    nats = F.when(x > SLIP_SHARE, n * (x * F.log(x / SLIP_SHARE) + (1 - x) * F.log((1 - x) / (1 - SLIP_SHARE)))).otherwise(0.0)
    told = verified.join(usual, "field", "left")
    size = F.log2(F.col("wa") / F.greatest(F.coalesce("usual", F.col("weight")), F.lit(1)))
    return told.withColumn("surprise", _bin(nats, SURPRISE)).withColumn("size", _bin(size, SIZE)).drop("usual")


def decide(featured: DataFrame) -> DataFrame:
    """The pairs that are more likely the same: (rare, frequent, similarity, weight).

    Only the table of counts by feature values, a few hundred cells whatever the number of pairs, reaches the driver.
    """
    shape = tuple(len(PRIOR[f][0]) for f in FEATURES)
    counts = np.zeros(shape)
    for r in featured.groupBy(*FEATURES).count().collect():
        counts[r[0], r[1], r[2]] = r[3]
    same = estimate(counts) >= 0.5
    yes = F.lit("".join("1" if v else "0" for v in same.ravel()))
    place = (F.col("kind") * shape[1] + F.col("surprise")) * shape[2] + F.col("size") + 1
    return featured.where(F.substring(yes, place.cast("int"), F.lit(1)) == "1").select("rare", "frequent", "similarity", "weight")


def stars(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, centre): greedy star clustering by frequency.

    In each round the nodes that no link leads to a more frequent node still unplaced become centres, and the nodes
    linked to one join the most similar; the rest goes on to the next round. Links lead from rare to frequent,
    so every round places at least the most frequent node and the loop ends.
    """
    left, links, done = nodes.select("node"), links, []
    while True:
        bound = links.select(F.col("rare").alias("node")).distinct()
        centres = left.join(bound, "node", "left_anti")
        done.append(centres.select("node", F.col("node").alias("centre")))
        to_centres = links.join(centres.select(F.col("node").alias("frequent")), "frequent", "left_semi")
        best = to_centres.groupBy("rare").agg(F.max(F.struct("similarity", "weight", (-F.col("frequent")).alias("minus"))).alias("b"))
        joined = best.select(F.col("rare").alias("node"), (-F.col("b.minus")).alias("centre"))
        done.append(joined)
        placed = joined.select("node")
        rest = left.join(bound, "node", "left_semi").join(placed, "node", "left_anti")
        still = rest.select(F.col("node").alias("rare"))
        ends = rest.select(F.col("node").alias("frequent"))
        left = cut(rest)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        links = cut(links.join(still, "rare", "left_semi").join(ends, "frequent", "left_semi"))


def link_spellings(names: DataFrame, similarity: float = WANTED_SIMILARITY, recall: float = WANTED_RECALL) -> DataFrame:
    """(field, name, n, core, cluster): every spelling with the entity it belongs to.

    ``names`` is a union of ``spellings``. The cluster is named by the core of its centre.
    """
    parted = cut(with_parts(names))
    cored = cut(with_core(parted, additions(parted)))
    nodes = cut(cored.groupBy("field", "core", "node").agg(F.sum("n").alias("weight"), F.max_by("joined", F.struct("n", "joined")).alias("joined")))
    met = cut(shared_keys(meetings(nodes, bands_for(similarity, recall))))
    first = cut(verify(candidates(met, DOMINANCE), nodes))
    rest = cut(unclaimed(nodes, first))
    usual = rest.groupBy("field").agg(F.percentile_approx("weight", 0.5).alias("usual"))
    second = verify(candidates(met.join(rest.select("node"), "node", "left_semi"), None), nodes)
    second = second.where(F.col("weight") < F.col("wa") * DOMINANCE)
    featured = cut(with_features(first.unionByName(second), usual))
    placed = stars(nodes, cut(decide(featured)))
    centre = nodes.select(F.col("node").alias("centre"), F.col("core").alias("cluster"))
    return cored.join(placed, "node").join(centre, "centre").select("field", "name", "n", "core", "cluster")


def pairs_of(linked: DataFrame) -> DataFrame:
    """(field, name_a, name_b): all pairs of different spellings of one entity, name_a first by code point."""
    a = linked.select("field", "cluster", F.col("name").alias("name_a"))
    b = linked.select("field", "cluster", F.col("name").alias("name_b"))
    return a.join(b, ["field", "cluster"]).where(F.col("name_a") < F.col("name_b")).select("field", "name_a", "name_b")
