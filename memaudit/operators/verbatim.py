"""Verbatim passages of a small table found in a large one (M3 and M2 on any two text tables), without a cross join.

If a normalised passage is a substring of a normalised text, all its tokens but the first and last are whole tokens of
the text. So a run of five inner tokens (one, if it has fewer) is a key that both sides share. A passage of one or two tokens
may lie inside words: its key is its first ``GRAM`` characters (all, if it has fewer), and the text's keys of that kind are all
its runs of as many characters. Texts and passages meet by an equi-join on keys, and only pairs that meet are compared in full.

The keys of a text are checked where they are made against a set of the passages' keys, ``1 << BITS`` bits whatever the number of
passages, so that of a text's many keys only those are shuffled that a passage may share; a full set lets more keys through and loses none. Character
runs are made only of the lengths that some short passage asks for.

Defined results: a null text is empty; a passage without a token is found nowhere; a text counts as often as its row; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import text as T

RUN = 5
GRAM = 8
BITS = 20


def _run(tokens: Column, first, width: int) -> Column:
    return F.xxhash64(F.array_join(F.slice(tokens, first, width), " "))


def _gram(characters: Column) -> Column:
    return F.xxhash64(F.lit("gram"), characters)


def _text_keys(norm: Column, lengths: Column, bits: Column) -> Column:
    """Keys of a text that the set may hold. A one-element array binds the tokens to a name, so that they are not split anew for every run."""
    none = F.array().cast("array<bigint>")
    words = F.transform(F.array(F.split(norm, " ")), _keys_of)[0]
    grams = [F.when(F.array_contains(lengths, q), F.transform(F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{{q}}}))"), F.lit(1)), _gram)).otherwise(none)
             for q in range(1, GRAM + 1)]
    return F.array_distinct(F.filter(F.concat(words, *grams), lambda k: _in_set(k, bits)))


def _keys_of(tokens: Column) -> Column:
    runs = F.when(F.size(tokens) >= RUN, F.transform(F.sequence(F.lit(1), F.size(tokens) - RUN + 1), lambda i: _run(tokens, i, RUN)))
    words = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.concat(words, F.coalesce(runs, F.array().cast("array<bigint>")))


def _passage_key(norm: Column, tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n >= RUN + 2, _run(tokens, 2, RUN)).when(n >= 3, _run(tokens, 2, 1)).otherwise(_gram(F.substring(norm, 1, GRAM)))


_LONGS = 1 << (BITS - 6)


def _word_of(key: Column) -> Column:
    return F.pmod(key, F.lit(_LONGS)).cast("int")


def _bit_of(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(key, BITS - 6), F.lit(64)).cast("int"))


def _in_set(key: Column, bits: Column) -> Column:
    return F.get(bits, _word_of(key)).bitwiseAND(_bit_of(key)) != 0


def key_set(keys: DataFrame) -> DataFrame:
    """One row ``bits``: the set of the keys (column _key) as ``1 << BITS`` bits in an array of longs."""
    words = keys.groupBy(_word_of(F.col("_key")).alias("w")).agg(F.bit_or(_bit_of(F.col("_key"))).alias("b"))  # at most 2^14 rows
    one = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    return one.select(F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("bits"))


def wanted_keys(passages: DataFrame, passage_id: str = "item_id", text: str = "text") -> DataFrame:
    """(passage_id, _np, _key, _short): one key per passage that has a token; ``_short``: characters of a short passage's key."""
    p = passages.select(F.col(passage_id), T.normalize(text).alias("_np")).filter(F.col("_np") != "")
    tokens = F.split("_np", " ")
    return p.select(passage_id, "_np", _passage_key(F.col("_np"), tokens).alias("_key"),
                    F.when(F.size(tokens) < 3, F.least(F.length("_np"), F.lit(GRAM))).alias("_short"))


def text_keys(texts: DataFrame, wanted: DataFrame, text_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_id, _key): the keys of the texts that a passage may share."""
    bits = key_set(wanted).scalar()
    lengths = wanted.agg(F.collect_set("_short")).scalar()  # at most GRAM numbers
    ready = texts.select(text_id, T.normalize(text).alias("_norm"), bits.alias("_bits"), F.coalesce(lengths, F.array().cast("array<int>")).alias("_lengths"))
    return ready.select(text_id, F.explode(_text_keys(F.col("_norm"), F.col("_lengths"), F.col("_bits"))).alias("_key"))


def verbatim_hits(texts: DataFrame, passages: DataFrame, text_id: str = "doc_id", passage_id: str = "item_id",
                  text: str = "text") -> DataFrame:
    """(passage_id, text_id, jaccard): every text that holds a passage verbatim after M1, and the token overlap (M2) of the two.

    The keys of the texts are joined with one key per passage; ids alone travel until a pair has met."""
    t = texts.select(F.col(text_id), F.col(text).alias("_text"))
    wanted = wanted_keys(passages, passage_id, text)
    met = text_keys(t, wanted, text_id, "_text").join(wanted.drop("_short"), "_key").select(text_id, passage_id, "_np").distinct()
    both = met.join(t, text_id).select(text_id, passage_id, "_np", T.normalize("_text").alias("_nt"))  # of pairs that met alone
    return both.filter(F.col("_nt").contains(F.col("_np"))).select(
        passage_id, text_id, T.jaccard(T.token_set("_nt"), T.token_set("_np")).alias("jaccard"))
