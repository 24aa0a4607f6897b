"""Text analysis and a search query language.

The analyzer lower-cases, splits into runs of letters and digits, drops stop words and, for English, stems
with Porter's published algorithm. Ranking is by term frequency of our own; only its order matters.

Query language: words are all required; ``"a b"`` is a phrase, ``or`` joins its neighbours, ``-word`` excludes.
"""

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed English stop words.
STOP_WORDS = frozenset(
    "a about after all also am an and any are as at be because been before being but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no nor not of off on once only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
_WORD = re.compile(r"[^\W_]+")


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _consonant(word, i - 1)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


# Suffix tables of steps 2 to 4 of the published algorithm.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for suffix, instead in sorted(table, key=lambda x: -len(x[0])):
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + instead
                break
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def analyze(text: str | None, stem: bool = True) -> list[str]:
    """Terms of a text in order."""
    words = [w for w in _WORD.findall((text or "").lower()) if w not in STOP_WORDS]
    return [porter(w) for w in words] if stem else words


def plain_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, JVM-side: the analyzer without stop words and stems."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


@F.pandas_udf(ArrayType(StringType()))
def stemmed_terms(text: pd.Series) -> pd.Series:
    """Analyzer as a vectorized function over a text column."""
    return text.map(analyze)



@dataclass
class SearchQuery:
    """A parsed query: every group needs one of its terms, no excluded term may occur, phrases occur in order."""

    groups: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for t in g})


def parse_query(text: str, stem: bool = True) -> SearchQuery:
    query, join = SearchQuery(), False
    for negative, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
        if word.lower() == "or" and not negative:
            join = bool(query.groups)
            continue
        terms = analyze(phrase or word, stem)
        if negative:
            query.excluded += terms
            continue
        for k, term in enumerate(terms):
            if join and k == 0:
                query.groups[-1].append(term)
            else:
                query.groups.append([term])
        if len(terms) > 1 and not join:
            query.phrases.append(terms)
        join = False
    return query


def matches(query: SearchQuery, terms: Column) -> Column:
    """Whether an array of terms satisfies a query; a query without terms matches nothing."""
    if not query.groups:
        return F.lit(False)
    ok = F.lit(True)
    for group in query.groups:
        ok = ok & F.arrays_overlap(terms, F.array(*[F.lit(t) for t in group]))
    for term in query.excluded:
        ok = ok & ~F.array_contains(terms, term)
    joined = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    for phrase in query.phrases:
        ok = ok & joined.contains(f" {' '.join(phrase)} ")
    return ok


def lexical_rank(wanted: Column, terms: Column) -> Column:
    """Sum over wanted terms of 1 + ln(frequency), by ln of the text's length: an order, not a score to compare."""
    hits = F.aggregate(wanted, F.lit(0.0), lambda s, t: s + F.coalesce(F.when(F.array_contains(terms, t), 1.0 + F.log(F.size(F.filter(terms, lambda x: x == t)).cast("double"))), F.lit(0.0)))
    return hits / (1.0 + F.log(1.0 + F.size(terms)))

