"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, so eight bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at
most ``max_bits`` bytes and so share at least ``8 - max_bits`` bytes at the same positions: the guaranteed minimum
of the count filter. A plain index on (position, byte) has lists of n/256 fingerprints, whose pairs grow with n^2.
The index here is keyed by *three* positions and their bytes: twenty triples of positions, chosen so that any four
of the eight positions contain one of them (Turan's covering design), so each pair that reaches the minimum meets
in some list, of n/2^24 fingerprints. In a list the shared positional bytes of each pair are tallied, pairs below the
minimum are dropped, and the rest are verified by counting their differing bits.

Only distinct fingerprints enter the index: exact copies cost one row. A list of more than ``list_limit`` distinct
fingerprints (many near copies of one text) is not compared pair by pair. Its members go the exact way that is
linear in their number: each is dealt to all 64-bit values within half the distance of it, and whatever meets at one
value is linked to one of those that met there. Links leave a list or a meeting point as a star, never as all pairs;
connected components over them are those of the full graph.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any
other; repeated rows are rows of one component; a null ``doc_id`` never names a component unless all its ids are null;
texts are read whole; an empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memaudit.llm.common import add_columns, fresh, quoted
from memaudit.session import materialize

WIDTH, MAX_BITS, SEED = 4, 4, 42
#: Distinct fingerprints of one list that are compared with one another in a task.
LIST_LIMIT = 8192


def simhash64(raw: bytes | None, width: int = WIDTH, block: int = 1 << 15) -> int:
    """The fingerprint of a text as a signed 64-bit number; ``block`` bounds the memory of long texts."""
    words = (raw or b"").lower().split()  # of bytes: lowers A-Z only, cuts at \x20 and \x09-\x0D only
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths).tolist(), ends[width - 1:].tolist() or [len(text)]
    digest, n, ones = xxhash.xxh64_digest, len(last), np.zeros(64, np.int64)
    for at in range(0, n, block):
        hashes = b"".join([digest(text[i:j], SEED) for i, j in zip(first[at:at + block], last[at:at + block])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint of each whole text."""
    return add_columns(docs, text, [T.StructField(out, T.LongType())], lambda texts: [[simhash64(x, width) for x in texts]], keep)


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight byte positions; any four positions contain one of them.

    The positions are dealt into three groups in a ring; a triple lies in one group, or has two positions in a group
    and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    kinds = [sorted((g, g, h)) for g in range(3) for h in (g, (g + 1) % 3)]
    return [t for t in combinations(range(8), 3) if [group[i] for i in t] in kinds]


def _postings(fps: DataFrame, fp: str) -> DataFrame:
    """(key, fp): the number of a triple of positions and the three bytes there, in one int."""
    def key(k: int, triple: tuple[int, int, int]) -> Column:
        value = F.lit(k)
        for i in triple:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(quoted(fp), 8 * i).bitwiseAND(255).cast("int"))
        return value

    return fps.select(quoted(fp).alias("fp"), F.explode(F.array(*[key(k, t) for k, t in enumerate(position_triples())])).alias("key"))


def _forest(fp: np.ndarray, key: np.ndarray, max_bits: int) -> np.ndarray:
    """For each entry the first entry that it is linked to, directly or over others of its list. Entries of a list are adjacent."""
    label, at, step = np.arange(len(fp)), np.arange(len(fp)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[key[at] == key[at + step]]  # lists shorter than the step are done
        apart = at[label[at] != label[at + step]]
        differing = fp[apart] ^ fp[apart + step]
        shared = 8 - np.count_nonzero(differing.view(np.uint8).reshape(-1, 8), axis=1)  # the tally
        reached = shared >= 8 - max_bits
        apart, differing = apart[reached], differing[reached]
        a = apart[np.bitwise_count(differing.view(np.uint64)) <= max_bits]  # the verification
        while len(a):
            low, high = np.minimum(label[a], label[a + step]), np.maximum(label[a], label[a + step])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            a = a[label[a] != label[a + step]]
    return label


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _pairs_of_lists(max_bits: int, list_limit: int):
    """Scans sorted postings; gives (a, b) links of the lists up to the limit, and (member, null) for longer lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, hot = np.empty(0, np.int32), np.empty(0, np.int64), None

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            label = _forest(fp, key, max_bits)
            own = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[label[own]], pa.int64()), pa.array(fp[own], pa.int64())], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)])
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])  # the last list may go on in the next batch
            if cut:
                counts = np.unique(key[:cut], return_counts=True)[1]
                over = (counts.repeat(counts) > list_limit) | (key[:cut] == hot if hot is not None else False)
                yield pa.RecordBatch.from_arrays([pa.array(fp[:cut][over], pa.int64()), pa.nulls(int(over.sum()), pa.int64())], names=["a", "b"])
                yield links(key[:cut][~over], fp[:cut][~over])
            held_key, held_fp = key[cut:], fp[cut:]
            if held_key[0] == hot or len(held_key) > list_limit:
                hot = held_key[0]
                yield pa.RecordBatch.from_arrays([pa.array(held_fp, pa.int64()), pa.nulls(len(held_fp), pa.int64())], names=["a", "b"])
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield links(held_key, held_fp)

    return run


def _ball(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks of up to ``radius`` bits, and the number of bits of each."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    masks = np.array(masks, np.uint64)
    return masks.view(np.int64), np.bitwise_count(masks).astype(np.int32)


def _links_of_crowds(members: DataFrame, max_bits: int) -> DataFrame:
    """The links among fingerprints of over-long lists, by the values that lie between two of them.

    Fingerprints at most ``max_bits`` apart have a value within the larger half of the distance of the one and the
    smaller half of the other. Whatever meets at a value is linked to one that is within the smaller half of it."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    masks, radius = _ball(far)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(all_fp), 64):
                fp = all_fp[i:i + 64]
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks[None, :]).ravel()), pa.array(np.tile(radius, len(fp))),
                                                  pa.array(fp.repeat(len(masks)))], names=["x", "r", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, centred = None, 0, False  # of the meeting point that the last batch ended in
        for batch in batches:
            x, r, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(x):
                continue
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            mid, ok = fp[start].copy(), r[start] <= near
            if at is not None and x[0] == at:
                mid[0], ok[0] = centre, centred
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(x)]))
            at, centre, centred = x[-1], mid[-1], ok[-1]
            linked = ok[group] & (mid[group] != fp)
            pairs = np.unique(np.stack([mid[group][linked], fp[linked]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = members.mapInArrow(deal, "x long, r int, fp long")
    return dealt.repartition("x").sortWithinPartitions("x", "r", "fp").mapInArrow(meet, _LINK)


def links(fps: DataFrame, fp: str, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): enough links at most ``max_bits`` apart to connect whatever such links connect. ``fps``: distinct, not null."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees four shared bytes: max_bits must be 0 to 4")
    found = materialize(_postings(fps, fp).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
                        .mapInArrow(_pairs_of_lists(max_bits, list_limit), _LINK).distinct(), "links")
    crowd = found.where(F.col("b").isNull()).select("a")
    return found.where(F.col("b").isNotNull()).union(_links_of_crowds(crowd, max_bits)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b), one root per connected component.

    Each round every vertex joins its least neighbour and links between joined vertices go; vertices are compared
    after a bijective scramble, so chains of rising numbers shrink as fast as any others. Each round's table is
    written, so the lineage stays short and survives lost executors."""
    def scramble(c: Column) -> Column:
        for left, n in ((True, 13), (False, 7), (True, 17)):
            c = c.bitwiseXOR(F.shiftleft(c, n) if left else F.shiftrightunsigned(c, n))
        return c

    vertices = edges.select(scramble(F.col("a")).alias("a"), scramble(F.col("b")).alias("b")).where("a <> b")
    names = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", scramble(F.col("v")).alias("root"))
    left, rounds = materialize(vertices, "edges"), []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "parents")
        rounds.append(parent)
        left = materialize(left.join(parent.select("a", F.col("p").alias("pa")), "a")
                           .join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
                           .select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
    for parent in rounds:
        names = names.join(parent.select(F.col("a").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return names


def cluster(rows: DataFrame, fp: str, pick: Column, out: str, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(fp, out): for each distinct fingerprint the least ``pick`` of all rows of its component.

    ``rows`` should be a written table: it is read more than once."""
    own = rows.groupBy(quoted(fp).alias("v")).agg(F.min(pick).alias("own"))
    root = components(links(own.select("v"), "v", max_bits, list_limit))
    own = own.join(root, "v", "left").select("v", F.coalesce("root", "v").alias("root"), F.col("root").isNotNull().alias("linked"), "own")
    least = own.where("linked").groupBy("root").agg(F.min("own").alias("least"))  # few rows: of linked texts alone
    least = least.select(F.col("root").alias("r"), F.col("least"), F.lit(True).alias("is_linked"))
    joined = own.join(least, (own["root"] == least["r"]) & (own["linked"] == least["is_linked"]), "left")
    return joined.select(F.col("v").alias(fp), F.coalesce("least", "own").alias(out))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; a component is named by its smallest id."""
    rows = materialize(with_fingerprint(docs, "_fp", text, width, [id_col]), "fingerprints")
    named = cluster(rows, "_fp", quoted(id_col), "component_id", max_bits)
    hex16 = F.lower(F.lpad(F.hex(F.col("_fp")), 16, "0"))
    return rows.join(named, "_fp").select(quoted(id_col), hex16.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, nulls last; of equal ids the first row."""
    fp, row, kept = fresh(docs, "fp", "row_no", "kept_row")
    rows = materialize(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), fp, text, width), "fingerprints")
    rank = F.struct(quoted(id_col).isNull(), quoted(id_col), quoted(row).alias("row_no"))
    kept_rows = cluster(rows, fp, rank, kept, max_bits).select(quoted(kept)["row_no"].alias(row)).distinct()
    return rows.join(kept_rows, row, "left_semi").select(*[quoted(c) for c in docs.columns])
