"""Queries of the language-model problems: names, token ids, packing, text quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import encode, names, packing, quality
from sedimenta.session import spread, table


# ---------------------------------------------------------------- 5 names


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    drug, demo = table(spark, sf, "faers_drug"), table(spark, sf, "faers_demo")
    fields = names.spellings(drug, "drugname", "drugname").unionByName(names.spellings(drug, "prod_ai", "prod_ai"))
    return names.link_spellings(fields.unionByName(names.spellings(demo, "mfr_sndr", "mfr_sndr")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.pairs_of(_linked(spark, sf))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with its entity and the number of other spellings it is linked to."""
    linked = _linked(spark, sf)
    sizes = linked.groupBy("field", "cluster").agg((F.count("*") - 1).alias("links"))
    return linked.join(sizes, ["field", "cluster"]).select("field", "name", "n", "cluster", "links")


# ---------------------------------------------------------------- 7 token ids


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(_texts(spark, sf), "doc_id", "text")


# ---------------------------------------------------------------- 8 packing


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Where every text goes; a text is cut only if it has more tokens than a container.

    The attention capacity is three quarters of what a container of one text costs, so it binds: short texts may not join a long
    one beyond it. A text that alone costs more keeps a container to itself.
    """
    counts = encode.token_counts(_texts(spark, sf), "doc_id", "text")
    return packing.pack(counts, "doc_id", "n_tokens", items=table(spark, sf, "documents").count(), cut_dense=False)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of ``p8_pack`` are, and whether every constraint holds."""
    return packing.fill(p8_pack(spark, sf), "doc_id")


#: Containers in characters, for an account that SQL can check.
CHARACTERS = 8192


def p8_fill_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The same account for texts measured in characters, cut by attention too: totals, pieces and breaches."""
    sized = table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    packed = packing.pack(sized, "doc_id", "n", CHARACTERS)
    good = F.col("containers") <= F.col("least") * 1.02 + 1 + F.col("items") / packing.ITEMS_PER_GROUP
    return packing.fill(packed, "doc_id", CHARACTERS).select("items", "tokens", "pieces", "split", "breaches", "alone", good.alias("near_least"))


# ---------------------------------------------------------------- 9 text quality


def _common(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent words of all languages."""
    return table(spark, sf, "common_word").select("word")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    labelled = quality.label_corpus(_texts(spark, sf), "doc_id", "text", _common(spark, sf))
    return labelled.where(F.col("kind") != "prose").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(_texts(spark, sf), "doc_id", "text", _common(spark, sf))


QUERIES = {f.__name__: f for f in (p5_found, p5_clusters, p7_ids, p8_pack, p8_fill, p8_fill_chars, p9_found, p9_statistics)}

P9_STATISTICS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\s\x0B\x{00A0}]+'), lambda w: w <> '') AS w,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\x0B\x{00A0}]+|[\s\x0B\x{00A0}]+$', '', 'g')), lambda x: x <> '') AS l FROM t),
c AS (SELECT list(DISTINCT word) AS words FROM common_word)
SELECT doc_id, len(w)::BIGINT AS words,
  CASE WHEN len(w) > 0 THEN round(length(regexp_replace(t, '[\s\x0B\x{00A0}]', '', 'g')) / len(w), 6) END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\p{L}\p{N}\s\x0B\x{00A0}]', '', 'g')) / length(t), 6) END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: contains('.!?…:;"”»)。！？', right(x, 1)))) / len(l), 6) END AS ended_lines,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(c.words, lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))))) / len(w), 6) END AS common_words
FROM p, c
"""

#: Texts beyond the root of the attention capacity are cut into halves of a container.
_LONGEST = math.isqrt(packing.attention_capacity(CHARACTERS))
P8_FILL_CHARS = f"""
WITH s AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)
SELECT count(*)::BIGINT AS items, sum(n)::BIGINT AS tokens, sum(CASE WHEN n > {_LONGEST} THEN ceil(n / {CHARACTERS // 2}) ELSE 1 END)::BIGINT AS pieces, count(*) FILTER (WHERE n > {_LONGEST})::BIGINT AS split,
  0::BIGINT AS breaches, 0::BIGINT AS alone, true AS near_least FROM s
"""

SQL: dict[str, str] = {"p8_fill_chars": P8_FILL_CHARS, "p9_statistics": P9_STATISTICS}
