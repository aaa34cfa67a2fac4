"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: one row per segment of whole documents, with its terms and,
for each term, the rising word positions in the segment (as gaps). Segments are built where the texts are read, so
no posting is shuffled, and a hot document, source or term spreads over the segments like any other.

``match`` takes the test items as windows of ten words (an item of fewer words is one window). In each segment a
window's terms are looked up, the posting list of the rarest is taken first, and the lists of the next rarest terms,
less their offsets in the window, are intersected with it until it is empty or all terms are used: what is left are the
exact phrase matches. The windows of a segment take each of these steps together, ``CANDIDATES`` positions at a time. With ``slop`` it also gives proximity matches: occurrences of the rarest term around which every
other term of the window occurs within the window's length plus ``slop`` words, in any order; with ``repeats`` as often
as the window holds it.

``contamination`` and ``decontaminate`` run both with ``slop`` = ``SLOP``. ``n_hit``, ``items`` and ``contaminated`` count exact
matches only; items with proximity matches alone are in ``near_items``. ``decontaminate`` drops a document for either;
``slop=None`` leaves proximity out. A proximity match needs every word of its window, so it finds words inserted or moved; a
passage that lacks or replaces a word in each of its windows is neither kind of match.

The test items pass through the driver in blocks of ``BLOCK_WINDOWS`` distinct windows at most; each block is one
pass over the index, whatever the size of the test set.

Defined results: A-Z are lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a null or empty text has no word and
no match; an item without a word has no window; items with the same id count once, a null id counts as an empty
string; ids are of any atomic type; equal documents get equal results; texts are indexed whole; empty tables give empty or clean results; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memaudit.llm.common import fresh, quoted, utf8
from memaudit.session import materialize

WINDOW = 10
#: Words beyond the window's length within which a proximity match may lie.
SLOP = 2
#: Words of a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 400_000
#: A segment is a row of megabytes. Parquet looks at a row group's size after a hundred rows unless told otherwise, and both its
#: writer and its reader hold a whole row group: with these, that is a few segments, however many a task has.
SMALL_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}
#: Distinct windows of the test items that are looked up in one pass.
BLOCK_WINDOWS = 200_000
#: Positions that are tested in one step; a window whose rarest term has more is a step of its own.
CANDIDATES = 1 << 20
#: Word bytes are kept, A-Z lower-cased; all other bytes become spaces. Bytes over 0x7F are parts of word characters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TABLE).split()


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


_INDEX = "segment long, doc_ids array<{}>, digests array<binary>, n_words array<int>, terms array<binary>, counts array<int>, gaps binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The written index; a document is known by its id and the MD5 of its text."""
    source = docs.select(quoted(id_col), quoted(text).cast("string"))
    id_type = source.schema[0].dataType
    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(id_kind)), ("digests", pa.list_(pa.binary())),
                            ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("gaps", pa.binary())])
        part, made = TaskContext.get().partitionId(), 0
        numbers, tokens, ids, digests, sizes = _Numbers(), [], [], [], []

        def segment() -> pa.RecordBatch:
            token = np.array(tokens, np.int32)
            position = np.argsort(token.astype(np.uint16) if len(numbers) <= 1 << 16 else token, kind="stable").astype(np.int32)  # numpy counts short numbers
            counts = np.bincount(token, minlength=len(numbers)).astype(np.int32)
            gaps = np.diff(position, prepend=np.int32(0))
            starts = np.cumsum(counts) - counts
            gaps[starts] = position[starts]  # each list begins with a position
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), one(ids, id_kind), one(digests, pa.binary()), one(sizes, pa.int32()),
                                               one(list(numbers), pa.binary()), one(counts, pa.int32()), pa.array([gaps.astype("<i4").tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(raw)
                if tokens and len(tokens) + len(words) > segment_words:
                    yield segment()
                    made += 1
                    numbers, tokens, ids, digests, sizes = _Numbers(), [], [], [], []
                tokens.extend(map(numbers.__getitem__, words))
                ids.append(doc)
                digests.append(hashlib.md5(raw or b"", usedforsecurity=False).digest())
                sizes.append(len(words))
        if ids:
            yield segment()

    return materialize(source.mapInArrow(run, _INDEX.format(id_type.simpleString())), "postings", SMALL_GROUPS)


def window_blocks(items: DataFrame, id_col: str, text: str, window: int, block: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The distinct windows of the items with the ids of their items, a block at a time; the items stream through."""
    held: dict[tuple[bytes, ...], set[str]] = {}
    rows = items.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("i"), quoted(text).cast("string").alias("t"))
    for item, body in rows.toLocalIterator():
        words = words_of(body.encode() if body else None)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            held.setdefault(tuple(words[at:at + window]), set()).add(item)
            if len(held) >= block:
                yield held
                held = {}
    if held:
        yield held


class _Segment:
    """The posting lists of a segment, one behind the other; ``own`` gives the list of a wanted term."""

    #: Room around a list's positions, so that a place before the first or behind the last word is in no list.
    MARGIN = 1 << 16

    def __init__(self, terms: pa.Array, counts: np.ndarray, gaps: np.ndarray, wanted: pa.Array):
        self.own = pc.index_in(wanted, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = counts.astype(np.int64)
        self.counts = np.where(self.own >= 0, counts[self.own], 0)
        self.starts = np.cumsum(counts) - counts
        positions = np.cumsum(gaps, dtype=np.int64)
        self.positions = positions - (positions[self.starts] - gaps[self.starts]).repeat(counts)
        self.stride = len(gaps) + 2 * self.MARGIN
        self.places = np.arange(len(counts)).repeat(counts) * self.stride + self.positions  # rises: lists by number, each by position

    def rarest(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the terms, each position beside the number of its term in ``terms``."""
        counts = self.counts[terms]
        of = np.arange(len(terms)).repeat(counts)
        return of, self.positions[np.arange(len(of)) + (self.starts[self.own[terms]] - np.cumsum(counts) + counts).repeat(counts)]

    def before(self, terms: np.ndarray, at: np.ndarray, side: str = "left") -> np.ndarray:
        """How many entries of all lists lie before these places of the terms' lists (``right``: or there)."""
        return np.searchsorted(self.places, self.own[terms] * self.stride + at, side)

    def among(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these places are in the terms' lists."""
        return self.places[np.minimum(self.before(terms, at), len(self.places) - 1)] == self.own[terms] * self.stride + at


def _phrases(segment: _Segment, table: np.ndarray, size: np.ndarray, order: np.ndarray, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the (window, start) have the window's terms in a row: offset-adjusted lists, intersected from the rarest."""
    for j in range(1, table.shape[1]):
        k = order[of, j]
        keep = j >= size[of]
        rest = np.flatnonzero(~keep)
        keep[rest] = segment.among(table[of[rest], k[rest]], starts[rest] + k[rest])
        of, starts = of[keep], starts[keep]
    return of, starts


def _near(segment: _Segment, table: np.ndarray, size: np.ndarray, order: np.ndarray, need: np.ndarray, of: np.ndarray, at: np.ndarray, slop: int, doc_of: np.ndarray,
          first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the (window, place of its rarest term) have each term of the window, as often as ``need`` says, within the window's
    length plus ``slop`` words in the same document; a term is looked for where ``need`` is not 0."""
    for j in range(table.shape[1]):
        k = order[of, j]
        keep = need[of, k] == 0
        rest = np.flatnonzero(~keep)
        w, here, doc = of[rest], at[rest], doc_of[at[rest]]
        reach, term = size[w] - 1 + slop, table[w, k[rest]]
        low, high = np.maximum(here - reach, first[doc]), np.minimum(here + reach, last[doc])
        keep[rest] = segment.before(term, high, "right") - segment.before(term, low) >= need[w, k[rest]]
        of, at = of[keep], at[keep]
    return of, at


_HIT = "segment long, doc int, item string, first int, past int, exact boolean"


def match(index: DataFrame, items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW,
          slop: int | None = None, block: int = BLOCK_WINDOWS, repeats: bool = False) -> DataFrame:
    """(segment, doc, item, first, past, exact): maximal runs of words in exact windows of an item; with ``slop`` also
    single anchor words of proximity matches, which are not exact."""
    found = index.sparkSession.createDataFrame([], _HIT)
    for held in window_blocks(items, id_col, text, window, block):
        numbers = _Numbers()
        size = np.array([len(w) for w in held])
        table = np.full((len(held), window), -1, np.int32)
        for row, words in zip(table, held):
            row[:len(words)] = [numbers[w] for w in words]
        names = sorted(set().union(*held.values()))
        number = {n: i for i, n in enumerate(names)}
        owners = [np.array([number[i] for i in own], np.int64) for own in held.values()]
        found = found.union(_one_block(index, list(numbers), table, size, owners, names, slop, repeats))
    return materialize(found, "matches")


def _one_block(index: DataFrame, vocabulary: list[bytes], table: np.ndarray, size: np.ndarray, owners: list[np.ndarray], names: list[str], slop: int | None,
               repeats: bool) -> DataFrame:
    used = np.arange(table.shape[1]) < size[:, None]
    same = (table[:, :, None] == table[:, None, :]) & used[:, None, :]
    # how often a proximity match must hold each term, at the term's first place in the window
    need = np.where(used & (same.argmax(axis=2) == np.arange(table.shape[1])), same.sum(axis=2) if repeats else 1, 0).astype(np.int32)
    own_items, n_items = np.concatenate(owners), np.array([len(own) for own in owners])
    first_item = np.cumsum(n_items) - n_items

    def of_segment(number: int, sizes: np.ndarray, segment: _Segment) -> Iterator[pa.RecordBatch]:
        first = np.cumsum(sizes) - sizes
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.where(used, segment.counts[table], np.iinfo(np.int64).max)
        docs, items, starts, pasts, exact = [], [], [], [], []

        def add(w: np.ndarray, at: np.ndarray, length: np.ndarray, is_exact: bool) -> None:
            n = n_items[w]
            item = own_items[np.arange(n.sum()) + (first_item[w] - np.cumsum(n) + n).repeat(n)]
            for out, value in ((docs, doc_of[at].repeat(n)), (items, item), (starts, at.repeat(n)), (pasts, (at + length).repeat(n)), (exact, np.full(len(item), is_exact))):
                out.append(value)

        live = np.flatnonzero(counts.min(axis=1) > 0)
        step = np.cumsum(counts[live].min(axis=1)) // CANDIDATES
        for windows in np.split(live, np.flatnonzero(np.diff(step)) + 1) if len(live) else []:
            t, n, ranks = table[windows], size[windows], np.argsort(counts[windows], axis=1, kind="stable")
            of, at = segment.rarest(t[np.arange(len(t)), ranks[:, 0]])
            if slop is not None:  # an exact match is a proximity match too, so it is looked for among these
                of, at = _near(segment, t, n, ranks, need[windows], of, at, slop, doc_of, first, first + sizes - 1)
                add(windows[of], at, np.ones(len(at), np.int64), False)
            of, at = _phrases(segment, t, n, ranks, of, at - ranks[of, 0])
            whole = doc_of[at] == doc_of[at + n[of] - 1]  # not over the end of a document
            add(windows[of[whole]], at[whole], n[of[whole]], True)
        docs, items, starts, pasts, exact = ([x for x in of if len(x)] for of in (docs, items, starts, pasts, exact))
        if not docs:
            return
        doc, item, start, past, is_exact = (np.concatenate(x) for x in (docs, items, starts, pasts, exact))
        rank = np.lexsort((start, item, doc, is_exact))
        doc, item, start, past, is_exact = (x[rank] for x in (doc, item, start, past, is_exact))
        # windows of one kind, document and item that touch or overlap are one run; starts and ends rise together or nest
        base = np.cumsum(np.r_[0, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(is_exact.astype(int)) != 0)]) * (int(past.max()) + 2)
        reach = np.maximum.accumulate(past + base)
        new = np.r_[True, (start + base)[1:] > reach[:-1]]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(new)] - 1
        offset = first[doc[head]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(head), number, np.int64)), pa.array(doc[head], pa.int32()), pa.array([names[i] for i in item[head]], pa.string()),
             pa.array(start[head] - offset, pa.int32()), pa.array(reach[tail] - base[tail] - offset, pa.int32()), pa.array(is_exact[head])],
            names=["segment", "doc", "item", "first", "past", "exact"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                number, sizes, terms, counts, gaps = (batch.column(c)[i] for c in range(5))
                sizes, counts = (x.values.to_numpy(zero_copy_only=False) for x in (sizes, counts))
                if len(counts):
                    yield from of_segment(number.as_py(), sizes.astype(np.int64), _Segment(terms.values, counts, np.frombuffer(gaps.as_buffer(), "<i4"), wanted))

    return index.select("segment", "n_words", "terms", "counts", "gaps").mapInArrow(run, _HIT)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """(id, digest, n_words, n_hit, items array, contaminated, near_items array) of every document."""
    index = build_index(docs, id_col, text)
    return _per_document(index, match(index, items, item_id, item_text, window, slop, repeats=True), id_col)


def _per_document(index: DataFrame, runs: DataFrame, id_col: str) -> DataFrame:
    before = Window.partitionBy("segment", "doc").orderBy("first", "past", "item").rowsBetween(Window.unboundedPreceding, -1)
    fresh_words = F.greatest(F.lit(0), F.col("past") - F.greatest("first", F.coalesce(F.max("past").over(before), F.lit(0))))
    hits = (runs.where("exact").select("segment", "doc", "item", fresh_words.alias("words")).groupBy("segment", "doc")
            .agg(F.sum("words").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")))
    near = runs.where("NOT exact").groupBy("segment", "doc").agg(F.array_sort(F.collect_set("item")).alias("near"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "digests", "n_words")).alias("doc", "d"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    found = F.coalesce("items", none)
    return (docs.join(hits, ["segment", "doc"], "left").join(near, ["segment", "doc"], "left")
            .select(F.col("d.doc_ids").alias(id_col), F.col("d.digests").alias("digest"), F.col("d.n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                    found.alias("items"), (n_hit > 0).alias("contaminated"), F.array_except(F.coalesce("near", none), found).alias("near_items")))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs, exactly or (unless ``slop`` is None) as a proximity
    match; a decision holds for all copies of a text."""
    digest, other = fresh(docs, "digest", "hit_digest")
    hit = contamination(docs, items, id_col, text, item_id, item_text, window, slop).where(F.col("contaminated") | (F.size("near_items") > 0)).select(F.col("digest").alias(other)).distinct()
    marked = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary"))))
    return marked.join(hit, marked[digest] == hit[other], "left_anti").select(*[quoted(c) for c in docs.columns])
