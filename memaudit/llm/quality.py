"""Quality rules by tokeniser fertility.

Each whole text is tokenised word by word with a public SentencePiece vocabulary: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens in bits. A text's reference group is its language (its script where
that is null) and its length (floor of log2 of its tokens). For each group the median and the median absolute deviation of
the three measures are taken over *all* texts that pass the base rules; a text is kept if each measure is within ``WIDTH`` scaled
deviations below and above the median. A group of fewer than ``LEAST_GROUP`` texts is judged by the first of these bands that
has as many: its language at the nearest length (at most ``NEAR_LENGTHS`` away), its language at all lengths, its script at
its own or the nearest length, its script at all lengths, all texts at its own or the nearest length. The band of all texts at
all lengths is there for any number of texts, so every text that passes the base rules is judged; under ``LEAST_GROUP`` of
them its deviations are no less than ``FEW``, shrinking with their number, so that only gross outliers are rejected.

Base counts: white-space words, code points in them, symbols, lines equal to an earlier line, and words in 3-word windows
found twice or more. Base rules: fewer than 50 words, or more than half of the words repeated, fail.

Defined results: a null or empty text has no words and fails; repeated rows get equal results; texts are read whole; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from memaudit.llm.common import add_columns, fresh, quoted
from memaudit.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Scaled deviations that a measure may lie below and above its group's median; repetition lowers entropy, mixture only raises it.
WIDTH = {"fertility": (5.0, 5.0), "bytes": (1000.0, 5.0), "entropy": (5.0, 10.0)}
LEAST_GROUP = 50
#: Doublings of length over which a band of the same key may stand in.
NEAR_LENGTHS = 2
#: Keys under which the rows of a group meet its bands.
SALTS = 64
#: Least deviations, so that a group of near-equal texts does not reject on noise.
FLOOR = {"fertility": 0.02, "bytes": 0.003, "entropy": 0.1}
#: Least deviations of the band of all texts where there are next to none; they shrink to nothing at ``LEAST_GROUP`` texts.
FEW = {"fertility": 0.5, "bytes": 0.02, "entropy": 0.5}
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
#: Words whose ids a worker keeps, and the most bytes of such a word (longer ones are coded each time).
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
#: Scripts by the lead byte of their letters in UTF-8 (fixed values); ASCII letters are Latin.
SCRIPTS = {"Latin": (0xC3, 0xCA), "Greek": (0xCD, 0xCF), "Cyrillic": (0xD0, 0xD4), "Hebrew": (0xD6, 0xD7), "Arabic": (0xD8, 0xDD), "Indic": (0xE0, 0xE1), "Kana": (0xE3, 0xE3),
           "Han": (0xE4, 0xE9), "Hangul": (0xEA, 0xED)}


class WordPieces(dict):
    """Ids of words as bytes of 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.array([i for i in range(self.model.get_piece_size()) if self.model.is_byte(i)])
        self.is_byte = np.zeros(self.model.get_piece_size(), bool)
        self.is_byte[self.byte_ids] = True

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode(word.decode()), np.int32).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def pieces(path: str) -> WordPieces:
    return WordPieces(path)


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(number)
    if n < 1 << 20:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # three numbers do not fit in 63 bits: number the pairs first
        keys = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys) + 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


def measure(raw: bytes | None, coder: WordPieces) -> tuple:
    raw = raw or b""
    words = raw.split()
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += bool(line.strip())
        seen.add(line)
    lead = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = int(sum(map(len, words)) - lead[0x80:0xC0].sum())
    latin = lead[65:91].sum() + lead[97:123].sum()
    letters = {name: int(lead[a:b + 1].sum()) + (int(latin) if name == "Latin" else 0) for name, (a, b) in SCRIPTS.items()}
    ids = np.frombuffer(b"".join(map(coder.__getitem__, words)), np.int32)
    n = len(ids)
    entropy = 0.0
    if n:
        counts = np.unique(ids, return_counts=True)[1]
        entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
    return (len(words), word_chars, sum(map(raw.count, SYMBOLS)), dup_lines, _repeated_words(words), n, word_chars / n if n else 0.0,
            float(coder.is_byte[ids].sum() / n) if n else 0.0, entropy, max(letters, key=letters.get) if any(letters.values()) else "none")


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_tokens", "long"),
           ("fertility", "double"), ("bytes", "double"), ("entropy", "double"), ("script", "string")]


def measured(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all measures, and the name that each has got (another where ``docs`` has such a column)."""
    names = dict(zip([c for c, _ in COLUMNS], fresh(docs, *[c for c, _ in COLUMNS])))
    fields = [T.StructField(names[c], {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}[k]) for c, k in COLUMNS]

    def compute(texts: list[bytes | None]) -> list[list]:
        coder = pieces(vocabulary)
        return list(map(list, zip(*[measure(t, coder) for t in texts]))) or [[] for _ in COLUMNS]

    return add_columns(docs, text, fields, compute, keep), names


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The measures of every row with ``base_failed`` and ``kept``, and the names of all these columns."""
    group, size, failed, kept, salt = fresh(docs, "own_group", "own_size", "base_failed", "kept", "salt")
    grouped = docs.withColumn(group, quoted(lang).cast("string"))
    out, n = measured(grouped, text, vocabulary, [*(docs.columns if keep is None else keep), group])
    out = out.withColumn(group, F.coalesce(F.col(group), F.col(n["script"]))).withColumn(size, F.floor(F.log2(F.greatest(F.col(n["n_tokens"]), F.lit(1)))).cast("int"))
    out = materialize(out.withColumn(failed, (F.col(n["n_words"]) < 50) | (100 * F.col(n["n_repeat_words"]) > 50 * F.col(n["n_words"]))), "measures")
    # one language may hold most rows: they meet its few bands under SALTS keys
    out = out.withColumn(salt, F.pmod(F.xxhash64(*[F.col(n[c]) for c in ("n_words", "word_chars", "n_tokens", "fertility", "entropy")]), F.lit(SALTS)).cast("int"))
    parts = {m: out[n[m]] for m in FLOOR}
    sound = out.where(~F.col(failed)).select(F.col(group).alias("g"), F.col(n["script"]).alias("script"), F.lit("all").alias("every"), F.col(size).alias("s"),
                                             F.col(salt).alias("salt"), *[F.col(n[m]).alias(m) for m in FLOOR])

    def salted(table: DataFrame, name: str = "salt") -> DataFrame:
        return table.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def bands(*by: str, least: int = LEAST_GROUP) -> DataFrame:
        middle = sound.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(m, 0.5, 10_000).alias("mid_" + m) for m in FLOOR])
        # scripts are a fixed list and lengths are logarithms, so without the language the middles are a few hundred rows
        rows = sound.join(salted(middle), [*by, "salt"]) if "g" in by else sound.join(F.broadcast(middle), [*by])
        wide = rows.groupBy(*by).agg(F.first("n").alias("n"), *[F.first("mid_" + m).alias("mid_" + m) for m in FLOOR],
                                     *[F.percentile_approx(F.abs(F.col(m) - F.col("mid_" + m)), 0.5, 10_000).alias("dev_" + m) for m in FLOOR])
        few = F.greatest(F.lit(0.0), 1 - F.col("n") / LEAST_GROUP)
        return wide.where(F.col("n") >= least).select(*by, F.struct(*[F.struct(
            F.col("mid_" + m).alias("mid"), F.greatest(1.4826 * F.col("dev_" + m), F.lit(FLOOR[m]), few * FEW[m]).alias("dev")).alias(m) for m in FLOOR]).alias("band"))

    def ladder(key: str, least: int = LEAST_GROUP) -> DataFrame:
        """The band of each key at all lengths (``whole``) and those at single lengths (``sizes``, one per doubling)."""
        sizes = bands(key, "s").groupBy(key).agg(F.collect_list(F.struct("s", "band")).alias(key + "_sizes"))
        return bands(key, least=least).withColumnRenamed("band", key + "_whole").join(sizes, key, "left")

    own, script, every = salted(ladder("g"), "own_salt"), ladder("script").withColumnRenamed("script", "own_script"), salted(ladder("every", 0), "every_salt")
    marked = (out.join(own, (out[group] == own["g"]) & (out[salt] == own["own_salt"]), "left")
              .join(F.broadcast(script), out[n["script"]] == script["own_script"], "left").join(F.broadcast(every), out[salt] == every["every_salt"], "left"))

    def steps(table: DataFrame, key: str) -> list:
        away = lambda x: F.abs(x["s"] - out[size])
        near = F.array_min(F.transform(F.filter(table[key + "_sizes"], lambda x: away(x) <= NEAR_LENGTHS), lambda x: F.struct(away(x).alias("away"), x["s"].alias("s"), x["band"].alias("band"))))
        return [near["band"], table[key + "_whole"]]

    band = F.coalesce(*steps(own, "g"), *steps(script, "script"), *steps(every, "every"))
    inside = F.lit(True)
    for m, value in parts.items():
        off = (value - band[m]["mid"]) / band[m]["dev"]
        inside &= off.between(-WIDTH[m][0], WIDTH[m][1])
    own_columns = [out[c].alias(c) for c in out.columns if c not in (group, size, salt)]
    return marked.select(*own_columns, (~out[failed] & F.coalesce(inside, F.lit(False))).alias(kept)), n | {"base_failed": failed, "kept": kept}
