"""Text quality: plain statistics per document, and prose/list/table/junk by a hidden Markov model over lines.

The model's observations are statistics of a line: how many of its words are common words, numbers, symbols,
placeholders, page furniture, unnatural letter strings, damaged or backward words, together with the line's shape (item
marker, cells, rules, separators, repeated phrases seen up to ``NEAR`` words before, end). Each hidden state draws the
word counts from a categorical distribution and the shapes from Bernoulli ones;
several states share a label, since a table may be ruled or aligned and junk comes in many sorts. Lines of more than
``WINDOW`` words count as several.

The parameters are estimated from the corpus itself, without labels: ``fit`` starts from ``STATES`` and re-estimates all
distributions on every line of every text by Viterbi training, the starting values standing for ``PRIOR_LINES`` lines of
every state, so that states keep their meaning and rare ones their values. The statistics of the lines are found once and written
(11 bytes a line); a round decodes them where they lie and adds up whole numbers (``tally``), so the model depends neither on the order of
texts nor on how they are divided among tasks.

Lines are decoded with Viterbi for all texts of a batch at once; a text's label follows the shares of its words and lines under
each label. Words are judged once per batch and distinct word, everything else is array arithmetic.

Defined results: null, empty and blank texts have zero words and null ratios and are prose; texts of fewer than
``MIN_WORDS`` words are prose; nothing is cut off, however long the text; a null or empty list of common words is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

MIN_WORDS = 8
WINDOW = 40
NEAR = 24
AROUND = 5
LABELS = ("prose", "list", "table", "junk")
BATCH = 500

# ---------------------------------------------------------------- common words

#: A list of common words is sent to the tasks up to so many; a longer one is joined to the words of the texts.
MOST_WORDS_SENT = 10_000


def _with_common(df: DataFrame, key: str, text: str, common: DataFrame | Sequence[str]) -> tuple[DataFrame, frozenset]:
    """(key, text, own) and the words to send: ``own`` are the common words of each text if the list is too long to send, else null.

    ``common`` is a column of words or a list of them.
    """
    body = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not isinstance(common, DataFrame):
        return body.withColumn("own", F.lit(None).cast("array<string>")), frozenset(w for w in common if w)
    listed = common.select(F.col(common.columns[0]).alias("word")).dropna().distinct()
    rows = listed.limit(MOST_WORDS_SENT + 1).collect()
    if len(rows) <= MOST_WORDS_SENT:
        return body.withColumn("own", F.lit(None).cast("array<string>")), frozenset(r[0] for r in rows)
    kind = body.schema["key"].dataType.simpleString()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                found = [{f for w in set(t.split()) for f in _forms(w)} if t else () for t in part.column(1).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array([w for f in found for w in f], pa.string())], names=["key", "word"])

    words = body.select("key", "text").mapInArrow(words_of, f"key {kind}, word string")
    own = words.join(listed, "word", "left_semi").groupBy(F.col("key").alias("_key")).agg(F.collect_set("word").alias("own"))
    return body.join(own, F.col("key").eqNullSafe(F.col("_key")), "left").select("key", "text", "own"), frozenset()


def _forms(word: str) -> tuple[str, str, str]:
    """The forms of a word that are looked up among common words."""
    inner = _inner(word.lower())
    return _bare(word), inner, inner[::-1]


def _batches(batch: pa.RecordBatch, sent: frozenset) -> Iterator[tuple[pa.RecordBatch, list, frozenset]]:
    """Slices of a batch with their texts and the common words to judge them by."""
    for begin in range(0, batch.num_rows, BATCH):
        part = batch.slice(begin, BATCH)
        own = part.column(2)
        common = sent if own.null_count == len(own) else sent.union(*(x for x in own.to_pylist() if x))
        yield part, part.column(1).to_pylist(), common


# ---------------------------------------------------------------- plain statistics

END_MARKS = frozenset(".!?…:;\"”»)。！？")
_SPACE = re.compile("[ \t\n\x0b\f\r\xa0]+")
_BLANKS = " \t\n\x0b\f\r\xa0"


def plain_statistics(texts: list[str | None], common: frozenset) -> dict[str, np.ndarray]:
    """Words, letters (characters in words), symbols, characters, lines, ended lines and common words of every text."""
    words: list[str] = []
    n, lines, ended = [], [], []
    for text in texts:
        found = [w for w in _SPACE.split(text) if w] if text else []
        words += found
        n.append(len(found))
        ends = [x[-1] for line in text.split("\n") if (x := line.strip(_BLANKS))] if text else []
        lines.append(len(ends))
        ended.append(sum(e in END_MARKS for e in ends))
    coded = pa.array(words, pa.string()).dictionary_encode()
    per = [(len(w), len(w) - sum(map(str.isalnum, w)), _bare(w) in common) for w in coded.dictionary.to_pylist()]
    table = np.array(per, np.int64).reshape(-1, 3)
    owner = np.repeat(np.arange(len(texts)), n)
    sums = np.zeros((len(texts), 3), np.int64)
    if len(words):
        np.add.at(sums, owner, table[coded.indices.to_numpy()])
    chars = np.array([len(t) if t else 0 for t in texts])
    return {"words": np.array(n), "letters": sums[:, 0], "symbols": sums[:, 1], "chars": chars, "lines": np.array(lines), "ended": np.array(ended), "common": sums[:, 2]}


def _bare(word: str) -> str:
    """Lower case without marks around; letters and digits stay."""
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j].lower()


def statistics(df: DataFrame, key: str, text: str, common: DataFrame | Sequence[str]) -> DataFrame:
    """(key, words, mean_word_length, symbol_ratio, ended_lines, common_words) of every text; one pass, no shuffle.

    Words are separated by white space; symbol_ratio is the share of characters that are neither letters,
    digits nor white space; ended_lines is the share of non-blank lines whose last character is a closing punctuation
    mark; common_words is the share of words that, in lower case and without marks around them, are in ``common``.
    """
    body, sent = _with_common(df, key, text, common)
    kind = df.schema[key].dataType.simpleString()

    def ratio(part: np.ndarray, whole: np.ndarray) -> pa.Array:
        return pa.array(part / np.maximum(whole, 1), mask=whole == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, words in _batches(batch, sent):
                s = plain_statistics(texts, words)
                columns = [part.column(0), pa.array(s["words"], pa.int64()), ratio(s["letters"], s["words"]), ratio(s["symbols"], s["chars"]), ratio(s["ended"], s["lines"]), ratio(s["common"], s["words"])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words"])

    schema = f"key {kind}, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double"
    told = body.mapInArrow(run, schema)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_lines", "common_words")]
    return told.select(F.col("key").alias(key), "words", *rounded)


# ---------------------------------------------------------------- line statistics

WORD_KINDS = ("common", "natural", "number", "symbol", "holder", "strange", "damaged", "backward", "furniture")
SHAPES = ("marker", "cells", "rule", "items", "short", "sentence_end", "item_end", "aligned", "repeats", "open", "inner_end", "hangs", "fills")

# Fixed words of unfilled templates and of page furniture.
HOLDERS = {"null", "undefined", "nan", "todo", "#value!", "#ref!", "#n/a", "[object", "object]", "%s", "%d", "{}", "lorem", "ipsum", "tbd", "xxx"}
FURNITURE = {"menu", "home", "print", "share", "login", "cookies", "next", "back", "top", "search...", "search", "accept", "»", "«", ">", "<", "(c)", "©", "page", "prev", "previous", "logout", "sitemap", "subscribe"}

_NUMBER = re.compile(r"^[(\[<>≤≥~±+\-]*[$€£]?\d[\d.,:/\-–%°]*[)\]%;,.]*$|^\(?\d+(?:\.\d+)?%?\)?[,;.]?$")
_HOLDER = re.compile(r"^(?:\{\{.*\}\}|\{\d*\}|%[sd]|&\w+;|</?\w[^>]*>?|\w*=['\"#][^>]*>?|<!--|-->|\$\{.*\})+$|</?\w+[^>]*>")
_LETTERS = re.compile(r"^[^\W\d_]+(?:['’\-./][^\W\d_]+)*$")
_ODD = re.compile(r"[^\W\d_][^\w\s'’\-‐‑.,/()&:+%;\"“”|][^\W\d_]|[^\W\d_][{}|\\^~=*@!;¬#+%][^\W\d_]|[Ã¢Â¾©¬Å][\x80-\xbf¾©¬¢ÃÂâÅ]|^[{}\\^~*@¬]+[^\W\d_]|[^\W\d_][{}\\^~@¬¾©=#]+[,.;]?$|[¾¢¬©]")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ]")
# letter sequences that hardly any language writes
_RUN = re.compile(r"[bcdfghjklmnpqrstvwxz]{6,}|[aeiou]{5,}|q[^u\W]|[jv][bcdfghjkmpqsvwz]|x[bdgjkmqrvwz]|[bcdfghkmpqvw][jqxz](?<!bj)(?<!dj)(?<!cz)(?<!dz)|[wz][bcdfgjmpqvxz](?<!zz)(?<!zb)(?<!wb)")
_HEX = re.compile(r"^(?:[0-9a-f]{2}|[0-9a-f]{8})$")
_MARKER = re.compile(r"^\s*(?:[-*•–—·▪◦‣○●■□+►➢✓]\s+|\(?\d{1,3}[.)]\s+|\(?[A-Za-z][.)]\s+|\(?[ivxIVX]{1,5}[.)]\s+|\[[ xX✓]?\]\s*|☐|☑|#\d+\s)")
_RULE_MARKS = " \t+|:=-"
_DASHES = re.compile(r"[-=]{3,}(?:\s|$)")
_GAP = re.compile(r"\S(?:\s{2,}|\t+|\s*\.{3,}\s*)(?=\S)")
_GAP_HINT = re.compile(r"\s\s|\t|\.\.\.")
_COMMA_CELL = re.compile(r"[,;](?=\S)|[,;]$")
_ITEM_BREAK = re.compile(r"\s*[•·▪]\s*|\s+[/|*–—-]\s+|;\s+|,\s+|\s+(?=\(?\d{1,2}[.)]\s)|\s+(?=\([a-z]\)\s)")
_SENTENCE = re.compile(r"[.!?…]['\"”»)]*\s+[\"“«¿¡(]?[^\Wa-zß-ÿ_]")


LONGEST_NUMBER = 64


def _inner(word: str) -> str:
    """A word without marks around it."""
    i, j = 0, len(word)
    while i < j and not (word[i].isalnum() or word[i] == "_"):
        i += 1
    while j > i and not (word[j - 1].isalnum() or word[j - 1] == "_"):
        j -= 1
    return word[i:j]


def is_rule(line: str) -> bool:
    """Whether a line is made of dashes, bars and the like, as under the head of a table."""
    if line.strip(_RULE_MARKS):
        return False
    return "+-" in line or "+=" in line or "++" in line or (line.count("|") > 1 and "-" in line[line.index("|") : line.rindex("|")]) or len(_DASHES.findall(line)) > 1


def word_kind(word: str, common: frozenset) -> int:
    """Index into WORD_KINDS."""
    lower = word.lower()
    bare = _inner(lower)
    if not bare:
        return 4 if lower in FURNITURE or lower in HOLDERS or _HOLDER.search(word) else 3
    if lower in HOLDERS or _HOLDER.search(word):
        return 4
    if len(word) <= LONGEST_NUMBER and _NUMBER.match(word):
        return 2
    if _HEX.match(lower):
        return 5 if any(c.isalpha() for c in lower) and bare not in common else 0 if bare in common else 2
    if bare in common:
        return 0
    if _ODD.search(word):
        return 6
    if _LETTERS.match(bare):
        if bare[::-1] in common and len(bare) > 1:
            return 7
        n = len(bare)
        if n > 3 and bare.isascii():
            vowels = len(_VOWEL.findall(bare))
            inner = word.strip(".,;:()[]\"'")
            mixed = sum(a.islower() and b.isupper() for a, b in zip(inner, inner[1:]))
            if n > 40 or mixed > 2 or vowels / n < 0.2 or vowels / n > 0.8 or _RUN.search(bare):
                return 5
        return 1
    if len(bare) >= 12 and any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare):
        return 5
    mixed = sum(a.isalpha() != b.isalpha() for a, b in zip(bare, bare[1:]))
    return 5 if mixed > 3 and not any(c in "-/." for c in bare) else 1


class Kinds(dict):
    """Kinds of words, each found once; forgotten when many have been seen. Page furniture is a kind of its own."""

    def __init__(self, common: frozenset):
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = 8 if word.lower() in FURNITURE else word_kind(word, self.common)
        return value


def units_of(text: str) -> list[tuple[str, list[str], bool, bool]]:
    """Lines with something on them, long ones cut at every WINDOW words: (line, words, begins, ends)."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        if len(words) <= 1.5 * WINDOW:
            out.append((line, words, True, True))
        else:
            for k in range(0, len(words), WINDOW):
                part = words[k : k + WINDOW]
                out.append((" ".join(part), part, k == 0, k + WINDOW >= len(words)))
    return out


def _repeated(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every word, whether it and the word before it stood together up to NEAR words before in the same text."""
    n = len(codes)
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = owner[1:] != owner[:-1]
    before = np.where(first, 0, np.roll(codes, 1) + 1)
    width = int(codes.max()) + 2
    pair = (owner.astype(np.int64) * width + before) * width + codes
    order = np.argsort(pair, kind="stable")
    close = (np.diff(pair[order]) == 0) & (np.diff(order) <= NEAR)
    out = np.zeros(n, bool)
    out[order[1:][close]] = True
    return out


def _items(line: str, n: int, sentences: int) -> bool:
    """Whether a line is a series of short items; the pattern is only tried on lines with separators enough."""
    least = max(4, n / 6)
    marks = sum(map(line.count, ",;•·▪/|*–—-"))
    if marks + 1 < least and (marks + line.count(".") + line.count(")") + 1 < least or not any(map(str.isdigit, line)) and "(" not in line):
        return False
    parts = [p for p in _ITEM_BREAK.split(line) if p and p.strip()]
    return len(parts) >= least and sentences <= 0.25 * len(parts) and max(len(p.split()) for p in parts) <= 9


@dataclass
class Lines:
    """Statistics of the lines of a batch of texts, one text after the other."""

    counts: np.ndarray
    shapes: np.ndarray
    lengths: np.ndarray
    words: np.ndarray


_KINDS: dict[frozenset, Kinds] = {}


def line_statistics(texts: Sequence[str | None], common: frozenset, kinds: Kinds | None = None) -> Lines:
    """Word counts by kind and shapes of every line of every text."""
    if kinds is None:
        if len(_KINDS) > 8:
            _KINDS.clear()
        kinds = _KINDS.setdefault(common, Kinds(common))
    words: list[str] = []
    sizes, lengths, rows = [], [], []
    for text in texts:
        units = units_of(text) if text else []
        lengths.append(len(units))
        ends_at = [len(line.rstrip()) if begins and ends else 0 for line, _, begins, ends in units]
        cells_before, fills = -1, False
        for at, (line, own, begins, ends) in enumerate(units):
            n = len(own)
            words += own
            sizes.append(n)
            stripped = line.strip()
            pipes, tabs = stripped.count("|"), stripped.count("\t")
            gaps = len(_GAP.findall(stripped)) if _GAP_HINT.search(stripped) else 0
            commas = len(_COMMA_CELL.findall(stripped)) if "," in stripped or ";" in stripped else 0
            marker = begins and not tabs and pipes < 2 and gaps < 2 and bool(_MARKER.match(line))
            width = max(pipes - 1 if pipes > 1 else 0, gaps, commas if commas > 1 and commas >= 0.3 * n else 0, tabs)
            cells = width >= 1 and not marker and (pipes > 1 or commas > 1 or gaps > 1 or tabs > 0 or (gaps == 1 and cells_before == 1))
            sentences = len(_SENTENCE.findall(stripped))
            last = stripped[-1]
            if at + 1 < len(units):
                # a wrapped line is as long as it could be: the next word would not have fitted
                fills = 0 < ends_at[at] and ends_at[at] + 1 + len(units[at + 1][1][0]) > max(ends_at[max(0, at - AROUND) : at + AROUND + 1])
            rows.append((marker, cells, is_rule(stripped), n >= 6 and _items(" ".join(own), n, sentences), cells and width == cells_before, sentences > 0, fills, ends, last in ".!?…", last not in ".!?…,-"))
            cells_before = width if cells else -1
    if not rows:
        return Lines(np.zeros((0, len(WORD_KINDS))), np.zeros((0, len(SHAPES))), np.array(lengths, np.int64), np.zeros(0, np.int64))
    coded = pa.array(words, pa.string()).dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    n, lengths = np.array(sizes), np.array(lengths, np.int64)
    line_of = np.repeat(np.arange(len(n)), n)
    kind = np.array([kinds[w] for w in distinct])[codes]
    counts = np.bincount(line_of * len(WORD_KINDS) + kind, minlength=len(n) * len(WORD_KINDS)).reshape(len(n), -1).astype(float)
    lower: dict[str, int] = {}
    folded = np.array([lower.setdefault(w.lower(), len(lower)) for w in distinct])[codes]
    again = np.bincount(line_of, _repeated(folded, np.repeat(np.repeat(np.arange(len(lengths)), lengths), n)), len(n))
    last_word = np.cumsum(n) - 1
    hangs = np.array([w.lower() in common for w in distinct])[codes[last_word]]
    marker, cells, rule, items, aligned, inner, fills, ends, stops, plain_end = np.array(rows, bool).T
    share = counts[:, 0] / n
    shapes = [marker, cells, rule, items, (n <= 9) & (share <= 0.4), stops & (n > 3) & ((share > 0.15) | (n > 9)), ends & plain_end & (n <= 9), aligned, (n >= 4) & (again > 0.7 * n), n > 9, inner, ends & hangs, fills]
    return Lines(counts, np.column_stack(shapes).astype(float), lengths, n)


# ---------------------------------------------------------------- the model

# Where estimation starts: hidden states; first the label, then the distribution over WORD_KINDS, then the probabilities of SHAPES.
STATES = {
    "sentences": ("prose", (0.36, 0.50, 0.06, 0.01, 0.002, 0.035, 0.025, 0.003, 0.005), (0.02, 0.01, 0.001, 0.02, 0.05, 0.60, 0.08, 0.003, 0.005, 0.85, 0.55, 0.05, 0.15)),
    "wrapped": ("prose", (0.36, 0.50, 0.06, 0.01, 0.002, 0.035, 0.025, 0.003, 0.005), (0.02, 0.01, 0.001, 0.02, 0.40, 0.15, 0.35, 0.003, 0.005, 0.50, 0.35, 0.35, 0.88)),
    "heading": ("prose", (0.20, 0.70, 0.05, 0.01, 0.002, 0.02, 0.01, 0.003, 0.005), (0.02, 0.01, 0.001, 0.02, 0.90, 0.10, 0.55, 0.003, 0.005, 0.005, 0.01, 0.03, 0.10)),
    "marked items": ("list", (0.18, 0.58, 0.15, 0.05, 0.005, 0.025, 0.005, 0.005, 0.005), (0.97, 0.02, 0.001, 0.10, 0.70, 0.10, 0.60, 0.005, 0.06, 0.20, 0.02, 0.02, 0.20)),
    "long items": ("list", (0.34, 0.52, 0.07, 0.02, 0.005, 0.035, 0.005, 0.005, 0.005), (0.97, 0.01, 0.001, 0.05, 0.10, 0.50, 0.10, 0.003, 0.05, 0.80, 0.15, 0.02, 0.20)),
    "plain items": ("list", (0.18, 0.60, 0.15, 0.03, 0.005, 0.025, 0.005, 0.005, 0.005), (0.02, 0.02, 0.001, 0.10, 0.93, 0.01, 0.90, 0.005, 0.06, 0.03, 0.01, 0.02, 0.35)),
    "closed items": ("list", (0.18, 0.60, 0.15, 0.03, 0.005, 0.025, 0.005, 0.005, 0.005), (0.02, 0.02, 0.001, 0.05, 0.93, 0.20, 0.01, 0.005, 0.06, 0.03, 0.02, 0.01, 0.30)),
    "run-on items": ("list", (0.20, 0.49, 0.13, 0.14, 0.005, 0.025, 0.005, 0.005, 0.005), (0.05, 0.05, 0.001, 0.97, 0.10, 0.02, 0.10, 0.01, 0.06, 0.90, 0.03, 0.03, 0.15)),
    "rows": ("table", (0.04, 0.40, 0.40, 0.10, 0.04, 0.02, 0.005, 0.005, 0.005), (0.02, 0.97, 0.02, 0.30, 0.60, 0.02, 0.60, 0.80, 0.15, 0.40, 0.02, 0.02, 0.55)),
    "piped rows": ("table", (0.03, 0.20, 0.22, 0.50, 0.02, 0.01, 0.005, 0.005, 0.005), (0.02, 0.97, 0.05, 0.50, 0.40, 0.02, 0.30, 0.80, 0.15, 0.60, 0.02, 0.02, 0.50)),
    "rules": ("table", (0.01, 0.02, 0.02, 0.91, 0.01, 0.01, 0.01, 0.01, 0.005), (0.01, 0.30, 0.97, 0.10, 0.90, 0.01, 0.70, 0.30, 0.30, 0.10, 0.01, 0.01, 0.60)),
    "strings": ("junk", (0.04, 0.28, 0.10, 0.02, 0.01, 0.52, 0.02, 0.01, 0.005), (0.02, 0.05, 0.001, 0.05, 0.30, 0.02, 0.30, 0.02, 0.02, 0.60, 0.05, 0.05, 0.40)),
    "symbols": ("junk", (0.01, 0.02, 0.25, 0.68, 0.02, 0.01, 0.005, 0.005, 0.005), (0.05, 0.10, 0.01, 0.10, 0.30, 0.02, 0.30, 0.03, 0.30, 0.60, 0.05, 0.01, 0.40)),
    "holders": ("junk", (0.05, 0.05, 0.05, 0.13, 0.60, 0.01, 0.005, 0.005, 0.10), (0.02, 0.05, 0.001, 0.05, 0.30, 0.02, 0.30, 0.02, 0.30, 0.60, 0.03, 0.02, 0.40)),
    "damage": ("junk", (0.20, 0.30, 0.05, 0.02, 0.01, 0.05, 0.36, 0.01, 0.005), (0.02, 0.02, 0.001, 0.05, 0.20, 0.30, 0.20, 0.01, 0.02, 0.70, 0.30, 0.10, 0.50)),
    "scramble": ("junk", (0.25, 0.47, 0.06, 0.01, 0.005, 0.05, 0.005, 0.15, 0.005), (0.02, 0.01, 0.001, 0.03, 0.20, 0.02, 0.30, 0.01, 0.05, 0.70, 0.02, 0.25, 0.50)),
    "echo": ("junk", (0.33, 0.46, 0.09, 0.06, 0.01, 0.03, 0.01, 0.01, 0.005), (0.02, 0.02, 0.001, 0.35, 0.20, 0.10, 0.20, 0.02, 0.97, 0.70, 0.15, 0.15, 0.40)),
    "furniture": ("junk", (0.06, 0.30, 0.08, 0.06, 0.03, 0.01, 0.005, 0.005, 0.45), (0.02, 0.05, 0.001, 0.25, 0.50, 0.02, 0.50, 0.02, 0.10, 0.50, 0.03, 0.05, 0.40)),
}
STATE_LABEL = np.array([LABELS.index(v[0]) for v in STATES.values()])
#: Words of a line are not independent; their evidence is tempered, and shapes count more than one word.
WORD_WEIGHT, SHAPE_WEIGHT, MOST_WORDS = 0.6, 1.0, 25
STAY, SAME_LABEL = 0.80, 0.10
#: A heading is followed by something else.
HEADING_STAY, HEADING_SAME = 0.05, 0.65


@dataclass(frozen=True)
class Model:
    """Start and transition probabilities, word distributions and shape probabilities of the states."""

    start: np.ndarray
    transition: np.ndarray
    words: np.ndarray
    shapes: np.ndarray

    def emission(self, lines: Lines) -> np.ndarray:
        """Log-likelihood of every line under every state."""
        x, y = lines.counts, lines.shapes
        tempered = x * (np.minimum(lines.words, MOST_WORDS) / lines.words)[:, None] * WORD_WEIGHT
        return tempered @ np.log(self.words).T + SHAPE_WEIGHT * (y @ np.log(self.shapes).T + (1 - y) @ np.log1p(-self.shapes).T)


def initial() -> Model:
    """The model that estimation starts from."""
    k = len(STATES)
    transition = np.zeros((k, k))
    for a, name in enumerate(STATES):
        stay, alike = (HEADING_STAY, HEADING_SAME) if name == "heading" else (STAY, SAME_LABEL)
        same = (STATE_LABEL == STATE_LABEL[a]) & (np.arange(k) != a)
        other = STATE_LABEL != STATE_LABEL[a]
        transition[a, a] = stay
        transition[a, same] = alike / max(1, same.sum())
        transition[a, other] = (1 - stay - alike) / other.sum()
    start = np.array([0.7 if v[0] == "prose" else 0.1 for v in STATES.values()])
    words = np.array([v[1] for v in STATES.values()])
    return Model(start / start.sum(), transition / transition.sum(axis=1, keepdims=True), words / words.sum(axis=1, keepdims=True), np.array([v[2] for v in STATES.values()]))


def viterbi(model: Model, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Most likely states of many sequences at once; emission rows lie one sequence after the other."""
    total, k = emission.shape
    begin, move = np.log(model.start), np.log(model.transition)
    states = np.zeros(total, np.int64)
    if not total:
        return states
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, sizes = first[order], lengths[order]
    back = np.zeros((total, k), np.int8)
    score = begin + emission[starts]
    final = np.zeros((len(order), k))
    final[:] = score
    live = len(order)
    for t in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
        path = final[:live, :, None] + move[None]
        best = path.argmax(axis=1)
        at = starts[:live] + t
        back[at] = best
        final[:live] = np.take_along_axis(path, best[:, None, :], axis=1)[:, 0] + emission[at]
    at_state = final.argmax(axis=1)
    ends = starts + sizes - 1
    for t in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + t
        later = at < ends[:live]
        at_state[:live] = np.where(later, back[np.minimum(at + 1, total - 1), at_state[:live]], at_state[:live])
        states[at] = at_state[:live]
    return states


#: How many rounds parameters are estimated in, and how many lines the starting values stand for.
FIT_ROUNDS, PRIOR_LINES = 4, 200.0
#: One more than the most words of a line.
SIZES = WINDOW + WINDOW // 2 + 1


def tally(model: Model, lines: Lines) -> np.ndarray:
    """How often lines decoded with a model begin a text in a state (states), move from one to another (states, states), are in
    one (states), have so many words of a kind by state and words of the line (states, SIZES, kinds) and a shape (states, shapes); in one row."""
    k, n = len(STATES), len(lines.counts)
    state = viterbi(model, model.emission(lines), lines.lengths)
    begins = (np.cumsum(lines.lengths) - lines.lengths)[lines.lengths > 0]
    follows = np.ones(n, bool)
    follows[begins] = False
    cell = state * SIZES + lines.words
    words = [np.bincount(cell, c, k * SIZES) for c in lines.counts.T]
    shapes = [np.bincount(state, y, k) for y in lines.shapes.T]
    moves = np.bincount(state[:-1][follows[1:]] * k + state[1:][follows[1:]], minlength=k * k)
    parts = [np.bincount(state[begins], minlength=k), moves, np.bincount(state, minlength=k), np.column_stack(words).ravel(), np.column_stack(shapes).ravel()]
    return np.concatenate(parts).astype(np.int64)


def estimate(tallied: np.ndarray, prior_lines: float = PRIOR_LINES) -> Model:
    """Every distribution from what each state was seen to emit and to be followed by."""
    prior, k = initial(), len(STATES)
    start, moves, seen, words, shapes = np.split(tallied, np.cumsum([k, k * k, k, k * SIZES * len(WORD_KINDS)]))
    start = start + prior_lines * prior.start
    moves = moves.reshape(k, k) + prior_lines * prior.transition
    # a line counts once, whatever its words
    share = (words.reshape(k, SIZES, -1) / np.maximum(np.arange(SIZES), 1)[None, :, None]).sum(axis=1) + prior_lines * prior.words
    shapes = (shapes.reshape(k, -1) + prior_lines * prior.shapes) / (seen[:, None] + prior_lines)
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), share / share.sum(axis=1, keepdims=True), shapes)


def fit(lines: Lines, rounds: int = FIT_ROUNDS, prior_lines: float = PRIOR_LINES) -> Model:
    """Viterbi training: decode, then estimate from what was found, and again."""
    model = initial()
    for _ in range(rounds):
        model = estimate(tally(model, lines), prior_lines)
    return model


def shares(texts: Sequence[str | None], common: frozenset, model: Model | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Share of words and of lines under each label, as (texts, labels); rows of texts without words are zero."""
    return shares_of(line_statistics(texts, common), model or initial())


def shares_of(lines: Lines, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The same from the statistics of the lines."""
    n = len(lines.lengths)
    labels = STATE_LABEL[viterbi(model, model.emission(lines), lines.lengths)] if len(lines.counts) else np.zeros(0, np.int64)
    cell = np.repeat(np.arange(n), lines.lengths) * len(LABELS) + labels
    by_word = np.bincount(cell, lines.words, n * len(LABELS)).reshape(n, -1)
    by_line = np.bincount(cell, minlength=n * len(LABELS)).reshape(n, -1).astype(float)
    norm = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    return norm(by_word), norm(by_line)


#: A text is not prose if labels other than prose hold more than this share, words and lines weighed alike.
NOT_PROSE = 0.5


def decide(by_word: np.ndarray, by_line: np.ndarray) -> np.ndarray:
    """Label of each text: prose unless the other labels together outweigh it; then the greatest of them."""
    weight = (by_word + by_line) / 2
    other = weight[:, 1:].sum(axis=1)
    return np.where(other > NOT_PROSE, 1 + weight[:, 1:].argmax(axis=1), 0)


def pack(lines: Lines) -> tuple[bytes, bytes]:
    """Lengths and lines as bytes: a byte for each word count, a bit for each shape."""
    rows = np.hstack([lines.counts.astype(np.uint8), np.packbits(lines.shapes.astype(bool), axis=1)])
    return lines.lengths.astype(np.int64).tobytes(), rows.tobytes()


def unpack(lengths: bytes, rows: bytes) -> Lines:
    kinds, shapes = len(WORD_KINDS), len(SHAPES)
    table = np.frombuffer(rows, np.uint8).reshape(-1, kinds + (shapes + 7) // 8)
    counts = table[:, :kinds].astype(float)
    return Lines(counts, np.unpackbits(table[:, kinds:], axis=1, count=shapes).astype(float), np.frombuffer(lengths, np.int64), counts.sum(axis=1).astype(np.int64))


def observe(body: DataFrame, sent: frozenset) -> DataFrame:
    """(keys, lengths, lines): line statistics of all texts of a corpus (key, text, own), up to BATCH texts a row."""
    kind = body.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, words in _batches(batch, sent):
                lengths, lines = pack(line_statistics(texts, words))
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([lengths], pa.binary()), pa.array([lines], pa.binary())], names=["keys", "lengths", "lines"])

    return body.mapInArrow(run, f"keys array<{kind}>, lengths binary, lines binary")


def fit_corpus(observed: DataFrame, rounds: int = FIT_ROUNDS) -> Model:
    """The model of a corpus, from all its lines; a few thousand sums a round reach the driver, whatever the number of texts."""
    model = initial()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for lengths, lines in zip(batch.column("lengths"), batch.column("lines")):
                    found = tally(model, unpack(lengths.as_py(), lines.as_py()))
                    total = found if total is None else total + found
            if total is not None:
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

        summed = observed.select("lengths", "lines").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect()
        k = len(STATES)
        tallied = np.zeros(k * (2 + k + SIZES * len(WORD_KINDS) + len(SHAPES)), np.int64)
        for cell, n in summed:
            tallied[cell] = n
        model = estimate(tallied)
    return model


def label_corpus(df: DataFrame, key: str, text: str, common: DataFrame | Sequence[str]) -> DataFrame:
    """(key, n_words, kind, share_prose, share_list, share_table, share_junk) of every text; texts are read once, none is shuffled."""
    body, sent = _with_common(df, key, text, common)
    kind_of_key = df.schema[key].dataType.simpleString()
    observed = cut(observe(body, sent))
    model = fit_corpus(observed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, lengths, rows in zip(*(batch.column(c) for c in ("keys", "lengths", "lines"))):
                lines = unpack(lengths.as_py(), rows.as_py())
                by_word, by_line = shares_of(lines, model)
                n = np.bincount(np.repeat(np.arange(len(lines.lengths)), lines.lengths), lines.words, len(lines.lengths)).astype(np.int64)
                kind = np.where(n >= MIN_WORDS, decide(by_word, by_line), 0)
                columns = [keys.values, pa.array(n), pa.array([LABELS[k] for k in kind], pa.string())]
                columns += [pa.array(by_word[:, j]) for j in range(len(LABELS))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "kind", *(f"share_{x}" for x in LABELS)])

    schema = f"key {kind_of_key}, n_words bigint, kind string, " + ", ".join(f"share_{x} double" for x in LABELS)
    return observed.mapInArrow(run, schema).withColumnRenamed("key", key)
