"""Joins across sources by the names and concepts that records mention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions import text as analysis
from sedimenta.functions.vectors import embed_column
from sedimenta.operators import search
from sedimenta.session import cut

# Comparators that are no drug.
COMPARATORS = ("placebo", "placebos", "sham", "standard of care", "best supportive care", "no intervention", "no treatment", "observation")


def is_comparator(terms: Column) -> Column:
    """Whether the terms of a name hold those of a comparator, one after the other."""
    spoken = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    return reduce(lambda a, b: a | b, [spoken.contains(f" {c} ") for c in COMPARATORS])


def mentioned(records: DataFrame, key: str, names: str, most: int | None = None) -> DataFrame:
    """(key, nth, name, terms, skipped): the names a record lists, comparators marked as skipped.

    ``most`` bounds the names looked up per record, counting drugs only; nth counts all names from 0.
    """
    listed = records.select(key, F.posexplode(names).alias("nth", "name")).where(F.col("name").isNotNull() & (F.trim("name") != ""))
    spoken = analysis.plain_terms(F.col("name"))
    listed = listed.withColumn("skipped", is_comparator(spoken)).withColumn("terms", F.array_distinct(spoken))
    if most is not None:
        order = W.partitionBy(key, "skipped").orderBy("nth")
        listed = listed.withColumn("_n", F.row_number().over(order)).where(F.col("skipped") | (F.col("_n") <= most)).drop("_n")
    return listed


def _asked(names: DataFrame) -> DataFrame:
    """(name, term, wanted) of (name, terms), for the inverted index."""
    known = names.where(F.size("terms") > 0).select("name", "terms").distinct()
    return known.select("name", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))


def context(listed: DataFrame, key: str, docs: DataFrame, doc_key: str, source: str, terms: str, k: int = 3) -> DataFrame:
    """(key, name, source, doc_key, rank, place): per name and source the k best documents with all its terms.

    Each distinct name is matched once, through the inverted index, and joined back to the records that mention it;
    the theta join on term containment is never formed.
    """
    met = search.term_matches(search.postings(docs, doc_key, terms), _asked(listed.where(~F.col("skipped"))), doc_key, True, "name")
    placed = met.join(docs.select(doc_key, source), doc_key)
    order = W.partitionBy("name", source).orderBy(F.desc("rank"), doc_key)
    best = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return listed.where(~F.col("skipped")).select(key, "name").distinct().join(best, "name").select(key, "name", source, doc_key, "rank", "place")


#: How many labels, reports and recalls make a profile.
PROFILE = {"openfda_label": 3, "openfda_event": 5, "openfda_enforcement": 3}


def profiles(names: DataFrame, docs: DataFrame, doc_key: str = "doc_id", source: str = "source", terms: str = "terms", wanted: dict[str, int] | None = None) -> DataFrame:
    """(name, source, doc_key, rank, place): what several sources say about each name, in one pass over them all.

    This is the lexical arm alone: documents with all terms of the name. ``fused_profiles`` ranks the rest too.
    """
    wanted = wanted or PROFILE
    scope = docs.where(F.col(source).isin(*wanted))
    met = search.term_matches(search.postings(scope, doc_key, terms), _asked(names), doc_key, True, "name")
    return search.top_by_source(met.join(scope.select(doc_key, source), doc_key), wanted, "rank", doc_key, ["name"], source).select("name", source, doc_key, "rank", "place")


def fused_profiles(names: DataFrame, docs: DataFrame, wanted: dict[str, int] | None = None) -> DataFrame:
    """(name, source, doc_id, similarity, score, place): the best documents of each source by vector and by all terms, fused.

    ``names`` has (query_id, name, terms), ids and names distinct; ``docs`` (doc_id, source, body, terms). A name is embedded
    once for all sources and a document once for all names. Each source is ranked by itself, so it gives as many documents
    as ``wanted`` says if it has them, whether they hold the terms of the name or not.
    """
    wanted = wanted or PROFILE
    scope = docs.where(F.col("source").isin(*wanted))
    asked = cut(embed_column(names.select("query_id", "name"), "query_id", "name"))
    terms = names.select("query_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
    met = search.term_matches(search.postings(scope, "doc_id", "terms"), terms, "doc_id", True)
    met = cut(met.join(scope.select("doc_id", "source"), "doc_id"))
    found = []
    for name, k in wanted.items():
        rows = cut(embed_column(scope.where(F.col("source") == name).select("doc_id", "body"), "doc_id", "body"))
        best = search.hybrid(asked, rows, met.where(F.col("source") == name).drop("source"), k)
        found.append(best.withColumn("source", F.lit(name)))
    every = reduce(DataFrame.unionByName, found)
    return every.join(names.select("query_id", "name"), "query_id").select("name", "source", "doc_id", "similarity", "score", "place")


def question_of(title: str, *lists: str):
    """One search text out of a title and lists of names: the lists first, nulls left out."""
    parts = [F.nullif(F.array_join(F.col(c), " "), F.lit("")) for c in lists]
    return F.concat_ws(" ", *parts, F.col(title))


def evidence(questions: DataFrame, articles: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, doc_id, similarity, score, place): articles for each question, found by vector and, lexically, by all of its terms but stop words.

    ``questions`` has (query_id, question), ``articles`` (doc_id, body, terms); both are embedded alike.
    """
    asked = cut(embed_column(questions.select("query_id", "question"), "query_id", "question"))
    rows = cut(embed_column(articles.select("doc_id", "body"), "doc_id", "body"))  # read by both scans and the join of pairs
    words = questions.select("query_id", F.array_distinct(analysis.plain_terms(F.col("question"))).alias("t"))
    stop = F.array(*[F.lit(w) for w in sorted(analysis.STOP_WORDS)])
    words = words.select("query_id", F.array_except("t", stop).alias("t")).select("query_id", F.size("t").alias("wanted"), F.explode("t").alias("term"))
    lexical = search.term_matches(search.postings(articles, "doc_id", "terms"), words, "doc_id", True)
    return search.hybrid(asked, rows, lexical, k)


def cite(found: DataFrame, docs: DataFrame, title: str = "title", key: str = "doc_id") -> DataFrame:
    """Numbered citations ``[n] title`` of a ranked result."""
    named = found.join(docs.select(key, title), key)
    return named.withColumn("citation", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce(title, F.lit("(untitled)"))))


def prompt(heading: str, rows: list[str], question: str) -> str:
    """Numbered passages and a question, as text for a summarizer."""
    cited = "\n".join(f"[{i}] {r}" for i, r in enumerate(rows, 1))
    return f"{heading}\n\n{cited}\n\n{question}"


def summarize(heading: str, rows: list[str], question: str, summarizer=None) -> str:
    """The summarizer's answer; without one, the prompt it would be given."""
    text = prompt(heading, rows, question)
    return summarizer(text) if summarizer else text
