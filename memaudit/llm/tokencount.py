"""Token counts by the whole-token shortcut, for byte-level BPE vocabularies (``tokenizers`` JSON files).

Before the job, once per vocabulary file, ``prove`` finds the vocabulary strings that the merges turn into exactly one token
when they stand alone, and reads the library's own letters, digits and white space off its pre-tokeniser. In the tasks a text
is cut at the special strings (one token each, as the library does), then into pre-tokens. A pre-token that is proved counts
one; only the others go through the merges, and their counts are kept (at most ``KEPT`` of them, none over ``KEPT_BYTES``).

The class table covers the basic plane. Stretches with other characters are cut by the library's pre-tokeniser itself. Texts
are cut in stretches of about ``STRETCH`` characters, only in front of white space that follows a visible character, where
every pre-token ends; so a task's memory is a batch of texts and one stretch, or one run without white space.

Defined results: a null or empty text has no bytes and no tokens; repeated rows get equal results; texts are read whole; an
empty table gives an empty result; other columns are left alone (a new column whose name is taken gets a leading ``_``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import filterfalse

from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from memaudit.llm.common import add_columns, fresh

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 512
STRETCH = 1 << 20
KEPT, KEPT_BYTES = 200_000, 64
PLANE = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]


@dataclass(frozen=True)
class Proof:
    """What a task needs to know of a vocabulary; its size is bounded by the vocabulary file."""

    pattern: str
    special: tuple[str, ...]
    alone: frozenset[str]


def _joined(cut: ByteLevel, before: str) -> set[int]:
    """Code points of the plane that the pre-tokeniser leaves together with ``before``."""
    probe = "".join(before + chr(c) + "\n" for c in PLANE)
    starts = {span[0] for _, span in cut.pre_tokenize_str(probe)}
    return {c for i, c in enumerate(PLANE) if 3 * i + 1 not in starts}


def _class(points: set[int]) -> str:
    """The points as ranges of a character class."""
    order, out, at = sorted(points), [], 0
    while at < len(order):
        end = at
        while end + 1 < len(order) and order[end + 1] == order[end] + 1:
            end += 1
        out.append(f"\\u{order[at]:04x}-\\u{order[end]:04x}")
        at = end + 1
    return "".join(out)


@lru_cache(maxsize=2)
def prove(path: str) -> Proof:
    """The proved strings, the special strings and the pattern of pre-tokens."""
    tokenizer = Tokenizer.from_file(path)
    cut, added = tokenizer.pre_tokenizer, tokenizer.get_added_tokens_decoder().values()
    if not isinstance(cut, ByteLevel) or cut.add_prefix_space or tokenizer.normalizer or any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    special = {t.content for t in added}
    # the letters of the byte alphabet, one for each byte in order of its number
    alphabet = {letter: byte for byte, letter in enumerate(_byte_letters())}
    alone = set()
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(map(alphabet.__getitem__, piece)).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # no text on its own, so no pre-token
        if len(tokenizer.model.tokenize(piece)) == 1:
            alone.add(text)
    letter, digit, mark = (_joined(cut, c) for c in "a1!")
    a, n, s = _class(letter), _class(digit), _class(set(PLANE) - letter - digit - mark)
    pattern = rf"'(?:[stmd]|re|ve|ll)| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
    return Proof(pattern, tuple(sorted(special, key=len, reverse=True)), frozenset(alone))


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Counter(dict):
    """Counts tokens of texts; as a mapping, the tokens of pre-tokens that the merges had to make."""

    def __init__(self, path: str, proof: Proof):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.proved = proof.alone.__contains__
        self.pieces = re.compile(proof.pattern).findall
        self.special = re.compile("|".join(map(re.escape, proof.special)) or "(?!)")
        self.beyond = re.compile("[\U00010000-\U0010FFFF]")
        self.border = re.compile(r"(?<=[^\t-\r ])[\t-\r ]")

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, raw))))
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def stretches(self, text: str, size: int):
        """``text`` in parts that no pre-token crosses."""
        at = 0
        while len(text) - at > size and (border := self.border.search(text, at + size)):
            yield text[at:border.start()]
            at = border.start()
        yield text[at:]

    def stretch(self, text: str) -> int:
        if self.beyond.search(text):
            pieces = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = self.pieces(text)
        rest = list(filterfalse(self.proved, pieces))
        return len(pieces) - len(rest) + sum(map(self.__getitem__, rest))

    def count(self, raw: bytes | None, size: int = STRETCH) -> int:
        parts = self.special.split((raw or b"").decode())
        return len(parts) - 1 + sum(self.stretch(s) for part in parts for s in self.stretches(part, size) if s)


@lru_cache(maxsize=2)
def _counter(path: str, proof: Proof) -> Counter:
    return Counter(path, proof)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (or its columns ``keep``) with ``n_bytes``, ``n_tokens`` and ``over_limit``, and the names that these have got."""
    names = dict(zip(("n_bytes", "n_tokens", "over_limit"), fresh(docs, "n_bytes", "n_tokens", "over_limit")))
    proof = docs.sparkSession.sparkContext.broadcast(prove(vocabulary))

    def compute(texts: list[bytes | None]) -> list[list]:
        counter = _counter(vocabulary, proof.value)
        return [[len(t or b"") for t in texts], [counter.count(t) for t in texts]]

    fields = [T.StructField(names[c], T.LongType()) for c in ("n_bytes", "n_tokens")]
    return add_columns(docs, text, fields, compute, keep).withColumn(names["over_limit"], F.col(names["n_tokens"]) > limit), names
