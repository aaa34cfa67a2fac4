"""Segments of the decontamination index on disk."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from memaudit.llm import decontam


def test_a_row_group_of_the_index_is_a_few_segments_however_many_a_task_writes(spark):
    words = 150_000
    docs = spark.range(12, numPartitions=1).selectExpr(
        "id AS doc_id", f"array_join(transform(sequence(1, {words}), i -> concat('w', i * 12 + id)), ' ') AS text")
    index = decontam.build_index(docs, segment_words=words)
    groups = [m.row_group(i) for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12
    assert max(g.total_byte_size for g in groups) < (12 << 20)
    items = spark.createDataFrame([("i", "w12 w24 w36 w48 w60 w72 w84 w96 w108 w120")], "item_id string, text string")
    assert [(r["doc"], r["first"], r["past"]) for r in decontam.match(index, items).collect()] == [(0, 0, 10)]


def test_the_lists_of_a_segment_are_one_binary_value(spark):
    """As an array each gap is copied alone, three times, on its way into the file."""
    index = decontam.build_index(spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").repartition(1), segment_words=9)
    (row,) = index.collect()
    assert dict(index.dtypes)["gaps"] == "binary"
    lists = dict(zip([bytes(t) for t in row["terms"]], np.split(np.frombuffer(row["gaps"], "<i4"), np.cumsum(row["counts"])[:-1])))
    text = [b"a", b"b", b"a", b"b"] if row["doc_ids"] == [1, 2] else [b"b", b"a", b"b", b"a"]
    assert {t: np.cumsum(g).tolist() for t, g in lists.items()} == {t: [i for i, w in enumerate(text) if w == t] for t in (b"a", b"b")}


@pytest.mark.parametrize("candidates,repeats,slop", [(1, True, 2), (50, False, 0), (1 << 20, True, None)])
def test_windows_taken_together_equal_plain_search(spark, monkeypatch, candidates, repeats, slop):
    monkeypatch.setattr(decontam, "CANDIDATES", candidates)
    rng = random.Random(7)
    docs = [[rng.choice("abcde") for _ in range(rng.choice([0, 3, 30]))] for _ in range(25)]
    items = [[rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 4]))] for _ in range(20)]
    rows = [(d, " ".join(w)) for d, w in enumerate(docs)]
    index = decontam.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(1))
    (segment,) = index.collect()
    found = decontam.match(index, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), window=4, slop=slop, repeats=repeats)
    got = {(segment["doc_ids"][r["doc"]], int(r["item"]), r["exact"], p) for r in found.collect() for p in range(r["first"], r["past"])}
    counts = {bytes(t).decode(): n for t, n in zip(segment["terms"], segment["counts"])}
    want = set()
    for d, w in enumerate(docs):
        for i, terms in enumerate(items):
            want |= {(d, i, True, p) for at in range(len(w)) if w[at:at + len(terms)] == terms for p in range(at, at + len(terms))}
            if slop is None:
                continue
            rare, reach = min(terms, key=lambda t: counts[t]), len(terms) - 1 + slop
            for p, x in enumerate(w):
                around = w[max(0, p - reach):p + reach + 1]
                if x == rare and all(around.count(t) >= (terms.count(t) if repeats else 1) for t in terms):
                    want.add((d, i, False, p))
    assert got == want


def test_a_segment_takes_its_windows_together():
    """Ten thousand windows that a segment may hold cost a few steps, not some for each window."""
    rng = np.random.default_rng(1)
    words, windows = rng.integers(0, 2000, 100_000), rng.integers(0, 2000, (10_000, 10))
    order = np.argsort(words, kind="stable")
    counts = np.bincount(words, minlength=2000)
    gaps = np.diff(order, prepend=0)
    gaps[np.cumsum(counts) - counts] = order[np.cumsum(counts) - counts]
    terms = pa.array([str(t).encode() for t in range(2000)], pa.binary())
    began = time.process_time()
    segment = decontam._Segment(terms, counts, gaps.astype(np.int32), terms)
    ranks = np.argsort(segment.counts[windows], axis=1, kind="stable")
    of, at = segment.rarest(windows[np.arange(len(windows)), ranks[:, 0]])
    of, at = decontam._phrases(segment, windows, np.full(len(windows), 10), ranks, of, at - ranks[of, 0])
    assert time.process_time() - began < 5
    assert len(of) == 0
