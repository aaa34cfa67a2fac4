"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point, by pivotal grams.

Words are counted in the tasks that read the texts and summed by a shuffle. Bigrams are ordered by the number of words that
hold them, rarest first. A word's *prefix* is its ``2 * q + ...`` = 3 rarest bigrams with their positions, and every other
occurrence of the last of them; its *pivots* are the two bigrams of the prefix that do not overlap and are rarest in sum, chosen
by dynamic programming over the positions. One edit leaves one of the two pivots whole. Let s be the word whose prefix ends
no later in the order of bigrams than that of its near word r: then the pivot of s that is left is in the prefix of r, at the same
position or, if the lengths differ, one further or before. So pivots meet prefixes by an equi-join on (bigram, position, length),
five keys a pivot, where the order of the two prefixes is as said; each pair is then verified. No pair is lost and no bucket is cut.

``variants`` takes from the near words of each word the most frequent one as its ``form`` (ties: the least in code-point
order) if that is ``RATIO`` times as frequent, and follows forms to the last by pointer doubling.

The table of bigrams has at most 90 * 90 rows (26 small letters and 64 letters of U+00C0 to U+00FF), so it is sent to the
tasks. Everything else is left to shuffles; a word that has very many near words is split by the join's adaptive skew handling.

Defined results: null and empty texts have no words; a null ``doc_id`` is empty in the contract's key; repeated rows count as often
as they stand there; texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from memaudit.session import materialize

EDITS = 1
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run in this many loses a letter (the contract's planted slips).
SLIP = 199
#: Words that a task holds before it passes their counts on.
HELD_WORDS = 100_000
#: ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8, after A-Z were lower-cased; shorter runs can give no word.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LENGTH)


# --- words --------------------------------------------------------------------------------------------------

def _slipped(doc_id: bytes, run: bytes) -> bytes:
    """The run, or what is left of it after the contract's slip."""
    h = crc32(doc_id + b":" + run)
    if h % SLIP:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LENGTH`` code points that stand in the texts ``LEAST_COUNT`` times or more."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, raw in zip(*[c.cast(pa.binary()).to_pylist() for c in batch.columns]):
                for run, n in Counter(RUN.findall((raw or b"").lower())).items():
                    held[_slipped(own or b"", run)] += n
                if len(held) > HELD_WORDS:
                    yield passed()
                    held.clear()
        yield passed()

    counts = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(count, schema)
    return (counts.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


# --- grams --------------------------------------------------------------------------------------------------

def bigrams(word: str) -> list[str]:
    return [word[i:i + 2] for i in range(len(word) - 1)]


def prefix(word: str, rank: dict[str, int], edits: int = EDITS) -> list[tuple[int, int]]:
    """(rank, position) of the rarest ``2 * edits + 1`` bigrams and of all others that equal the last of them."""
    order = sorted((rank[g], at) for at, g in enumerate(bigrams(word)))
    last = order[min(2 * edits, len(order) - 1)][0]
    return [x for x in order if x[0] <= last]


def pivots(grams: list[tuple[int, int]], weight: list[int], edits: int = EDITS) -> list[tuple[int, int]]:
    """The ``edits`` + 1 grams (rank, position) that do not overlap and are rarest in sum; over positions in order, for
    each number of grams the best choice among those seen, with its last gram two positions before or more."""
    by_place = sorted(grams, key=lambda x: x[1])
    best: list[list[tuple[int, tuple] | None]] = [[(0, ())] + [None] * (edits + 1)]
    for i, (r, at) in enumerate(by_place):
        before = max((j for j in range(i) if by_place[j][1] <= at - 2), default=-1) + 1
        row = list(best[i])
        for k in range(1, edits + 2):
            less = best[before][k - 1]
            if less is not None:
                chosen = (less[0] + weight[r], less[1] + ((r, at),))
                row[k] = chosen if row[k] is None else min(row[k], chosen)
        best.append(row)
    return list(best[-1][edits + 1][1])


def _signatures(words: DataFrame) -> DataFrame:
    """(word, length, last, gram, at, pivot): the prefix grams of each word, the pivots among them marked."""
    spark = words.sparkSession
    gram = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))))
    often = words.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    order = often.orderBy("n", "gram").collect()  # at most 8,100 rows: all pairs of the 90 letters
    sent = spark.sparkContext.broadcast(([r["gram"] for r in order], [r["n"] for r in order]))
    schema = T.StructType([T.StructField(c, T.StringType() if c == "word" else T.BooleanType() if c == "pivot" else T.IntegerType())
                           for c in ("word", "length", "last", "gram", "at", "pivot")])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weight = sent.value
        rank = {g: i for i, g in enumerate(grams)}
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                found = prefix(word, rank)
                chosen = set(pivots(found, weight))
                rows += [(word, len(word), found[-1][0], r, at, (r, at) in chosen) for r, at in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows) if rows else [()] * 6, (pa.string(), *[pa.int32()] * 4, pa.bool_()))],
                                             names=schema.names)

    return words.select("word").mapInArrow(sign, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): every ordered pair of ``words`` (distinct, in column word) that are one edit apart."""
    signed = materialize(_signatures(words), "spelling-grams")
    # where the lengths are equal the gram has not moved; in a longer word it may stand one further, in a shorter one before
    moves = F.array(*[F.struct(F.lit(a).alias("longer"), F.lit(b).alias("further")) for a, b in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    own = signed.where("pivot").select(F.col("word").alias("s"), F.col("last").alias("s_last"), "gram", "at", "length", F.explode(moves).alias("m"))
    own = own.select("s", "s_last", "gram", (F.col("at") + F.col("m.further")).alias("at"), (F.col("length") + F.col("m.longer")).alias("length"))
    other = signed.select(F.col("word").alias("r"), F.col("last").alias("r_last"), "gram", "at", "length")
    found = own.join(other, ["gram", "at", "length"]).where((F.col("s_last") <= F.col("r_last")) & (F.col("s") != F.col("r")) & (F.levenshtein("s", "r", 1) == 1))
    pairs = found.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")


# --- forms --------------------------------------------------------------------------------------------------

def _roots(edges: DataFrame) -> DataFrame:
    """(word, root) for edges (word, form) without cycles: each round follows twice as many edges."""
    at = materialize(edges.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = materialize(at.join(onward, at["root"] == onward["_from"], "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("on")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n)."""
    words = materialize(words, "spelling-words")
    count = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = (near_pairs(words).join(count, "near").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near"))).alias("top")))
    known = words.join(best, "word", "left")
    chosen = -F.col("top.less") >= ratio * F.col("n")
    formed = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("top.near")).alias("form"),
                                      F.when(chosen, -F.col("top.less")).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
