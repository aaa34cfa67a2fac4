"""Token-ID output: best-fit-decreasing packing into rows of one length.

Each partition tokenises its documents with a public byte-level BPE, adds the end token, and packs shards of about
``SHARD_TOKENS`` tokens. A document of more than a row's length is split, without loss, into full rows and a rest.
The pieces of a shard are placed longest first, each into the open row with the least room that still holds it; a
segment tree over the possible rooms finds that row in O(log length). No document is shuffled, and a shard is all
that a task holds.

One output row is one row of a shard's packed matrix: ``ids`` (little-endian, 2 bytes an id where the vocabulary fits,
else 4; the rest filled with the end token), ``positions`` (same coding, restarting at 0 with each piece; the fill counts
as a piece of its own), ``cu_seqlens`` (cumulative piece lengths from 0 on), and for each piece its document's id and the
piece's first token in the document.

Defined results: a null or empty text is a document of the end token alone; every document, repeated or not, is
packed once per row of the input; ids may be null and of any atomic type; ties in length keep the input's order; an empty table gives an
empty result. The vocabulary file is read by path on the executors.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from memaudit.llm.common import quoted

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_LENGTH = 4096
#: Tokens that are packed together.
SHARD_TOKENS = 4_000_000
#: Words whose ids a worker keeps, and the most characters of such a word (longer ones are coded each time).
CACHED_WORDS, CACHED_LENGTH = 400_000, 64

_TWO_SPACES = re.compile(r"\s\s")


class WordTokenizer(dict):
    """Ids of texts as bytes. The merges never cross a single space, so the ids of words are kept and joined."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_LENGTH:
            return self.plain(" " + word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = self.plain(" " + word)
        return ids

    def encode(self, raw: bytes | None) -> np.ndarray:
        text = (raw or b"").decode()
        if _TWO_SPACES.search(text):  # runs of white space depend on what stands around them
            return np.frombuffer(self.plain(text), self.kind)
        first, *rest = text.split(" ")
        return np.frombuffer(self.plain(first) + b"".join(map(self.__getitem__, rest)), self.kind)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class _Rooms:
    """Open rows by the room left in them; a segment tree finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.full = bytearray(2 * self.size)  # whether any row is below this node
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of ``need`` or more, and its room."""
        node = need + self.size
        if not self.full[node]:
            while node > 1 and (node & 1 or not self.full[node + 1]):  # up, until a right neighbour has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.full[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.full[node] = 0
            while node > 1 and not self.full[node ^ 1]:
                node >>= 1
                self.full[node] = 0
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items (by number) of each row; every length is 1 to ``capacity``."""
    rooms, rows = _Rooms(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[item])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, room = found
        rows[row].append(item)
        if room > lengths[item]:
            rooms.add(room - lengths[item], row)
    return rows


_SCHEMA = "shard long, row int, n_tokens int, doc_ids array<{}>, piece_starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = ROW_LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    source = docs.select(quoted(id_col), quoted(text).cast("string"))
    id_type = source.schema[0].dataType
    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, made = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        pieces, owners, starts, held = [], [], [], 0
        schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(id_kind)), ("piece_starts", pa.list_(pa.int32())),
                            ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())])

        def shard() -> Iterator[pa.RecordBatch]:
            count = np.arange(length, dtype=coder.kind)
            out = []
            rows = best_fit_decreasing([len(p) for p in pieces], length)
            for number, items in enumerate(rows):
                sizes = [len(pieces[i]) for i in items]
                used = sum(sizes)
                ids = np.concatenate([pieces[i] for i in items] + [np.full(length - used, coder.end, coder.kind)])
                positions = np.concatenate([count[:n] for n in [*sizes, length - used]])
                out.append((part << 32 | made, number, used, [owners[i] for i in items], [starts[i] for i in items], [0, *np.cumsum(sizes).tolist()], ids.tobytes(), positions.tobytes()))
                if len(out) == 256 or number == len(rows) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids = np.append(coder.encode(raw), coder.kind.type(coder.end))
                for at in range(0, len(ids), length):
                    pieces.append(ids[at:at + length])
                    owners.append(doc)
                    starts.append(at)
                held += len(ids)
                if held >= shard_tokens:
                    yield from shard()
                    made, pieces, owners, starts, held = made + 1, [], [], [], 0
        if pieces:
            yield from shard()

    return source.mapInArrow(run, _SCHEMA.format(id_type.simpleString()))


def matrix(rows: list, length: int, field: str = "ids", vocabulary: str = VOCABULARY) -> np.ndarray:
    """The packed matrix of collected output rows: one row of ids (or positions) each."""
    return np.stack([np.frombuffer(r[field], tokenizer(vocabulary).kind) for r in rows]) if rows else np.empty((0, length), np.int64)
