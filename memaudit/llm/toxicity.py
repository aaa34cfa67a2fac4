"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech. Insults are a lexicon of words and word beginnings with weights of
evidence, learned from labelled rows; the other classes are small fixed word lists in four languages. Four transducers
over these symbols (negation, reported speech, target, and a recogniser of insults and threats) are composed
into one machine, which reads the symbols of one clause after another and emits each insult or threat marked by what the
clause does to it: plain, targeted, negated, reported. A text's features are the weights of its matched clauses by mark; a
logistic regression, fitted on the same labelled rows and drawn to a prior (a negated or reported insult counts less), turns
them into a score.

Lexicon: beginnings of 4 to 7 letters and whole words of distinct texts (stretches of 2 to 4 letters in scripts without spaces), counted where the grammar reads them as neither
negated nor reported, in toxic and other texts alike, so that quoting or denying an insult does not speak for or against it. A
pattern is kept where its share of toxic texts is so far above the classes' share that chance would give none (Chernoff's bound
on the binomial tail, Bonferroni over all patterns tried) and it is ``RATIO`` times as frequent in toxic texts. Texts that are near copies of one
another are no independent witnesses: a pattern counts in at most as many toxic texts as it has different surroundings (its own
white-space word and the two beside it). Labelled rows are a
hash sample of about ``SAMPLE`` rows of the training labels, as large for any corpus; whole texts are read in training and scoring.

Training rows have crc32(id as text) mod 5 other than 0; a row without an id, text or label is no training row; a
document labelled twice counts as toxic if half of its labels are. Defined results: a null or empty text has no clause
and gets the bias alone; without any toxic training row the prior alone scores; repeated rows get equal results; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from memaudit.llm.common import add_columns, quoted, utf8
from memaudit.llm.langid import trains
from memaudit.session import materialize

#: Labelled rows that lexicon and weights are fitted on, about.
SAMPLE = 20_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words (fixed ranges: Thai and Lao, Myanmar, Khmer, Kana, Han); their runs are
#: clauses, so the lexicon takes stretches of ``INSIDE`` letters anywhere in them.
UNSPACED, INSIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]"), (2, 3, 4)
#: Letters of a word that may stand in the lexicon as a whole. Shorter words are function words and no insults by themselves;
#: a longer run of letters is known by its beginnings.
SHORTEST, LONGEST = 3, 64
BREAK = re.compile(r"[.!?;\n]")
#: Fixed word lists: English, German, French, Spanish.
CLASSES = {
    "N": "not no never isn't aren't wasn't nicht kein keine nie niemals ne pas jamais nunca tampoco",
    "R": "said says say told claimed wrote quoted called sagte sagt schrieb behauptete dit disait écrit dijo dice escribió",
    "T": "you your you're he she they him her them du dich euch ihr sie er tu toi vous il elle ils tú usted ustedes ellos ella",
    "X": "kill hurt beat stab shoot burn töten umbringen schlagen tuer frapper matar golpear",
}
MARKS = ["plain", "targeted", "negated", "reported"]
#: Where the regression starts from, per unit of evidence of each mark, and how strongly it is drawn there: as if the prior of the bias
#: had a variance of one. Weaker, classes that are far apart would push the boundary up to the weakest labelled toxic text.
PRIOR, BIAS, DRAW = {"plain": 1.0, "targeted": 1.1, "negated": 0.5, "reported": 0.6}, -4.0, 1.0
#: How many times as frequent in toxic texts as in others a pattern of the lexicon is at least; less is topic, not insult.
RATIO = 8.0
#: The evidence of one match and of one text's mark, at most: features saturate, so a long text is not toxic by length alone. All
#: matches are read; the bound is on the feature, as large for any text.
MOST, THREAT = 12.0, 3.0


@dataclass(frozen=True)
class Transducer:
    """From a state a symbol leads to a state and leaves a set of marks; unknown symbols keep the state and leave none."""

    arcs: dict
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, frozenset()))

    def compose(self, other: Transducer, symbols: str) -> Transducer:
        """Both machines read the same symbols; the marks that either leaves are left."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in symbols:
                (a, left), (b, right) = self.step(state[0], symbol), other.step(state[1], symbol)
                arcs[state, symbol] = (a, b), left | right
                todo.append((a, b))
        return Transducer(arcs, (self.start, other.start))


#: Symbols: N R T, I insult, X threat, and "-", a stretch of more than four words without a symbol.
SYMBOLS = "NRTIX-"


def _marks_after(trigger: str, mark: str, lasting: bool) -> Transducer:
    """Insults and threats after the trigger get the mark; unless lasting, a long stretch ends its reach."""
    hit = frozenset([mark])
    arcs = {(0, trigger): (1, frozenset()), (1, "I"): (1, hit), (1, "X"): (1, hit)}
    return Transducer(arcs if lasting else arcs | {(1, "-"): (0, frozenset())})


GRAMMAR = (Transducer({(0, "I"): (0, frozenset(["insult"])), (0, "X"): (0, frozenset(["threat"]))})
           .compose(_marks_after("N", "negated", False), SYMBOLS).compose(_marks_after("R", "reported", True), SYMBOLS).compose(_marks_after("T", "targeted", False), SYMBOLS))


def mark_of(marks: frozenset) -> str:
    return next((m for m in ("reported", "negated", "targeted") if m in marks), "plain")


@dataclass
class Model:
    lexicon: dict[str, float]  # "word " or the beginning of words -> evidence
    weights: list[float] = field(default_factory=lambda: [BIAS, *PRIOR.values()])

    def machines(self) -> tuple:
        """Automata of the insults and threats, and of the words around them."""
        strong, around = ahocorasick.Automaton(), ahocorasick.Automaton()
        same: dict[str, list] = {}  # a word may stand in the lexicon as a whole and as a beginning
        for pattern, weight in self.lexicon.items():
            same.setdefault(_letters_of(pattern), []).append(("I", pattern, weight))
        for symbol, words in CLASSES.items():
            for word in words.split():
                if symbol != "X":
                    around.add_word(word, [(symbol, word + " ", 0.0)])
                else:
                    same.setdefault(word, [("X", word + " ", THREAT)])
        for word, entries in same.items():
            strong.add_word(word, entries)
        strong.make_automaton()
        around.make_automaton()
        return strong, around


def _letters_of(pattern: str) -> str:
    return pattern.removeprefix("*").rstrip()


def _found(machine, text: str, offset: int = 0) -> list[tuple[int, int, str, float]]:
    """(start, end, symbol, weight) of the machine's words in the text; a match begins a word, and ends it if it must."""
    out = []
    for last, symbol, pattern, weight in ((last, *entry) for last, entries in machine.iter(text) for entry in entries):
        size = len(_letters_of(pattern))
        start = last + 1 - size
        if pattern[0] != "*" and start and text[start - 1].isalpha():
            continue
        if pattern.endswith(" ") and last + 1 < len(text) and text[last + 1].isalpha():
            continue
        out.append((offset + start, offset + last + 1, symbol, weight))
    return out


def evidence(raw: bytes | None, strong, around) -> list[float]:
    """The matched clauses' weights by mark. Only clauses with an insult or threat are read by the grammar."""
    text = (raw or b"").decode().lower()
    total = dict.fromkeys(MARKS, 0.0)
    hits: dict[int, tuple] = {}
    for hit in _found(strong, text):  # of matches that begin at one place the weightiest counts
        if hit[0] not in hits or hit[3] > hits[hit[0]][3]:
            hits[hit[0]] = hit
    order, begin = [hits[start] for start in sorted(hits)], 0
    breaks = BREAK.finditer(text)
    close = next(breaks, None)
    at = 0
    while at < len(order):  # hits and breaks are passed once, and a clause's text is read once
        while close and close.start() < order[at][0]:
            begin, close = close.end(), next(breaks, None)
        done, first = close.start() if close else len(text), at
        while at < len(order) and order[at][0] < done:
            at += 1
        for mark, weight in _clause(text, begin, sorted(_found(around, text[begin:done], begin) + order[first:at])):
            total[mark] += weight
    return [min(total[m], MOST) for m in MARKS]


def _clause(text: str, begin: int, events: list[tuple]) -> Iterator[tuple[str, float]]:
    """(mark, weight) of each insult or threat among a clause's events in order."""
    state, past = GRAMMAR.start, begin
    for at, end, symbol, weight in events:
        if _stretch(text, past, at):
            state = GRAMMAR.step(state, "-")[0]
        state, marks = GRAMMAR.step(state, symbol)
        past = max(past, end)
        if marks & {"insult", "threat"}:
            yield mark_of(marks), weight


def _stretch(text: str, start: int, end: int) -> bool:
    """Whether more than four words stand between two places."""
    words = LETTERS.finditer(text, start, max(start, end))
    return sum(1 for _ in islice(words, 5)) > 4


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> list[float]:
    """The logistic regression that is drawn to the prior, by Newton's method with halved steps where a whole one would not
    lower the loss; a mark whose weight would be negative gets none."""
    x, prior = np.c_[np.ones(len(x)), x], np.array([BIAS, *PRIOR.values()])
    draw, free = DRAW * np.array([1.0, 20, 20, 20, 20]), np.ones(5, bool)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + draw @ (w - prior) ** 2 / 2)

    while True:
        w = np.where(free, prior, 0.0)
        for _ in range(rounds):
            p = _sigmoid(x @ w)
            slope = x.T @ (p - y) + draw * (w - prior)
            step = np.zeros(5)
            step[free] = np.linalg.solve(((x * (p * (1 - p))[:, None]).T @ x + np.diag(draw))[np.ix_(free, free)], slope[free])
            part = 1.0
            while part > 1e-9 and loss(w - part * step) > loss(w) - 1e-4 * part * float(slope @ step):
                part /= 2
            w = w - part * step
            if float(np.abs(part * step).max()) < 1e-8:
                break
        below = free & (w < 0)
        below[0] = False
        if not below.any():
            return w.tolist()
        free &= ~below


def patterns_of(raw: bytes | None) -> set[str]:
    """Whole words (with a space behind), beginnings of 4 to 7 letters, and in scripts without spaces stretches (with a star before) of a text."""
    out = set()
    for word in set(LETTERS.findall((raw or b"").decode().lower())):
        if UNSPACED.search(word):
            out.update("*" + word[i:i + k] for k in INSIDE for i in range(len(word) - k + 1))
            continue
        out.update(word[:k] for k in range(4, 8) if len(word) > k)
        if SHORTEST <= len(word) <= LONGEST:
            out.add(word + " ")
    return out


def _around() -> ahocorasick.Automaton:
    return Model({}).machines()[1]


def plain_patterns_of(raw: bytes | None, around) -> set[str]:
    """The patterns that occur somewhere in a text outside negation and reported speech."""
    text, words = (raw or b"").decode().lower(), set()
    for clause in BREAK.split(text):
        events = _found(around, clause)
        if not any(e[2] in "NR" for e in events):
            words.update(LETTERS.findall(clause))
            continue
        events.sort()
        state, gap, at = GRAMMAR.start, 0, 0
        for m in LETTERS.finditer(clause):
            while at < len(events) and events[at][1] <= m.start():  # a symbol acts on what follows it
                if gap > 4:
                    state = GRAMMAR.step(state, "-")[0]
                state, gap = GRAMMAR.step(state, events[at][2])[0], 0
                at += 1
            now = GRAMMAR.step(state, "-")[0] if gap > 4 else state
            if not GRAMMAR.step(now, "I")[1] & {"negated", "reported"}:
                words.add(m[0])
            gap += 1
    return patterns_of(" ".join(words).encode())


def _counts(texts: DataFrame, wanted: dict | None = None, flush: int = 300_000) -> DataFrame:
    """(pattern, n): in how many of the texts (the only column) each pattern, or each wanted one, occurs outside negation and reported speech."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        around = _around()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

        for batch in batches:
            for raw in utf8(batch.column(0)):
                found = plain_patterns_of(raw, around)
                counts.update(found if wanted is None else found & wanted.keys())
                if len(counts) > flush:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return texts.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def witnesses_of(raw: bytes | None, wanted: dict) -> set[tuple[str, int]]:
    """(pattern, surroundings) of the wanted patterns in a text: the white-space word that holds the pattern, and its neighbours."""
    tokens, out = (raw or b"").decode().lower().split(), set()
    for i, token in enumerate(tokens):
        found = patterns_of(token.encode()) & wanted.keys()
        if found:
            around = crc32(" ".join(tokens[max(0, i - 1):i + 2]).encode())
            out.update((pattern, around) for pattern in found)
    return out


def _witnesses(texts: DataFrame, wanted: dict) -> DataFrame:
    """(pattern, n): in how many different surroundings each wanted pattern stands in the texts (the only column)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({w for raw in utf8(batch.column(0)) for w in witnesses_of(raw, wanted)})
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["pattern", "around"])

    return texts.mapInArrow(run, "pattern string, around long").distinct().groupBy("pattern").agg(F.count("*").alias("n"))


def significance(a: int, b: int, base: float) -> float:
    """Minus the logarithm of Chernoff's bound on the chance that ``a`` or more of ``a + b`` texts are toxic, of which a share
    ``base`` of all texts is."""
    share = a / (a + b)
    if share <= base:
        return 0.0
    return a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    known = labels.where(trains(id_col) & quoted(label).isNotNull()).groupBy(quoted(id_col).alias("own_id")).agg((F.avg(quoted(label).cast("double")) >= 0.5).cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("own_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(quoted(id_col).alias("own_id"), quoted(text).cast("string").alias("text")).where("text IS NOT NULL")
    # the sample is about ``sample`` ids whatever the corpus, so it may be broadcast and the texts need no shuffle
    rows = rows.join(F.broadcast(known), "own_id").select(F.xxhash64("text").alias("h"), "y", "text")
    rows = materialize(rows.dropDuplicates(["h", "y"]), "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model({})
    seen = materialize(_counts(rows.where("y = 1").select("text")), "patterns")
    tried = seen.count()
    base = n[1] / (n[0] + n[1])
    bar = math.log(tried + 1) + 5
    least = max(3, math.ceil(bar / -math.log(base)))
    toxic = {r["pattern"]: r["n"] for r in seen.where(F.col("n") >= least).collect()}  # of the sample's texts
    clean = {r["pattern"]: r["n"] for r in _counts(rows.where("y = 0").select("text"), dict.fromkeys(toxic)).collect()}
    likely = {p: a for p, a in toxic.items() if significance(a, clean.get(p, 0), base) >= bar and a * n[0] >= RATIO * clean.get(p, 0) * n[1]}
    apart = {r["pattern"]: r["n"] for r in _witnesses(rows.where("y = 1").select("text"), dict.fromkeys(likely)).collect()}  # of the few likely ones
    lexicon = {}
    for pattern in sorted(likely):
        a, b = min(likely[pattern], apart.get(pattern, 0)), clean.get(pattern, 0)  # copies of one text bear witness once
        if a and significance(a, b, base) >= bar and a * n[0] >= RATIO * b * n[1]:
            lexicon[pattern] = min(MOST, math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)))
    # a longer pattern within a kept beginning of no less weight says nothing more
    lexicon = {p: w for p, w in lexicon.items() if not any(lexicon.get(p[:k], 0.0) >= w for k in range(4, len(p.rstrip())) if p[0] != "*")}
    return Model(lexicon, _fit(rows, Model(lexicon)))


def _fit(rows: DataFrame, model: Model) -> list[float]:
    data = np.array([[*r[1], r[0]] for r in _evidence(rows, model, "text", ["y"]).collect()])  # of the sample
    return fit_weights(data[:, :-1], data[:, -1])


def _evidence(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    machines: list = []

    def compute(texts: list[bytes | None]) -> list[list]:
        if not machines:
            machines.extend(model.machines())
        return [[evidence(t, *machines) for t in texts]]

    return add_columns(docs, text, [T.StructField("evidence", T.ArrayType(T.DoubleType()))], compute, keep)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the probability of being toxic."""
    machines: list = []

    def compute(texts: list[bytes | None]) -> list[list]:
        if not machines:
            machines.extend(model.machines())
        return [_sigmoid(np.array([[1.0, *evidence(t, *machines)] for t in texts]).reshape(-1, 5) @ np.array(model.weights)).tolist()]

    return add_columns(docs, text, [T.StructField(out, T.DoubleType())], compute, keep)
