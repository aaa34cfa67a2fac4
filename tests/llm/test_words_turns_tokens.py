"""Spelling variants, conversation repair and token counts against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memaudit.llm import spelling, tokencount, turnrepair
from memaudit.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# --- spelling -----------------------------------------------------------------------------------------------

def words_of(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def grouped(count):
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 5 * count[w]:
            form[w] = best
    out = set()
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, count[w], len(near[w]), count[form[w]] if w in form else None))
    return out


def found(words):
    return {tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, SMALL)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == grouped(words_of(rows))


@pytest.mark.parametrize("letters", ["ab", "abcdeéß÷"])
def test_spelling_of_close_words(spark, letters):
    """Few letters: repeated bigrams, ties of their counts, and words with very many near ones."""
    rng, count = random.Random(len(letters)), {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        for _ in range(8):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:], word[:at] + word[at + 1:]])
            if len(word) >= 6:
                count[word] = rng.choice([5, 5, 6, 25, 30, 125, 700])
    assert found(spark.createDataFrame(list(count.items()), "word string, n long")) == grouped(count)


def test_pivots_do_not_overlap_and_are_the_rarest():
    rng = random.Random(2)
    for _ in range(300):
        grams = rng.sample(range(12), rng.randint(3, 8))
        grams = [(rng.randrange(6), at) for at in grams]
        weight = sorted(rng.randint(1, 9) for _ in range(6))
        pairs = [(weight[a[0]] + weight[b[0]]) for a in grams for b in grams if a[1] + 2 <= b[1]]
        got = spelling.pivots(grams, weight)
        assert len(got) == 2 and abs(got[0][1] - got[1][1]) >= 2 and sum(weight[r] for r, _ in got) == min(pairs)


def test_forms_are_followed_to_the_last(spark):
    count = {"aaaaaa": 5 ** 9, "aaaaab": 5 ** 8, "aaaabb": 5 ** 7, "aaabbb": 5 ** 6, "aabbbb": 5 ** 5, "abbbbb": 5 ** 4, "bbbbbb": 5 ** 3}
    got = found(spark.createDataFrame(list(count.items()), "word string, n long"))
    assert got == grouped(count) and {r[2] for r in got} == {"aaaaaa"}


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Öffnung " * 7), (3, "ÀÉÎÕÜß " * 6 + "x" * 6 + "9" + "STRASSE " * 5), (3, "strasse"), (3, "strasse"), (4, "ab " * 30000 + "naïveté " * 3000), (5, "a-b÷cdefg×" * 9)]
    got = spelling.vocabulary(spark.createDataFrame([(*r, 7, "w") for r in rows], "doc_id long, text string, n long, word string"))
    assert {r["word"]: r["n"] for r in got.collect()} == words_of(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.vocabulary(empty)) == set()


# --- conversations ------------------------------------------------------------------------------------------

def cheapest(rows):
    """(cost, audit) of rows (letter, fault) by a search over all edits."""
    @lru_cache(None)
    def best(i, phase, spare):
        options = [(0, "")] if i == len(rows) and phase in "^a" else []
        due = "a" if phase == "u" else "u"

        def go(cost, edit, rest):
            if rest:
                options.append((cost + rest[0], edit + rest[1]))
        if spare:
            go(3, "I", best(i, due, spare - 1))
        if i < len(rows):
            letter, fault = rows[i]
            go(4, "D", best(i + 1, phase, spare))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                go(more + (0 if letter == due else 3), "K" if letter == due else "R", best(i + 1, due, spare))
                if letter == "s" and phase == "^":
                    go(more, "K", best(i + 1, "s", spare))
        return min(options, default=None)
    return best(0, "^", len(rows) + 1)


def mended(conv, rows):
    """The whole result of one conversation from its rows (turn, role, text) before damage."""
    after = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in after:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    letters = [r[:1] for _, r, _ in after]
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(tuple(zip(letters, faults)))
    said, at, phase = [], 0, "^"
    for edit in audit:
        if edit != "D":
            phase = "s" if edit == "K" and letters[at] == "s" and phase == "^" else "a" if phase == "u" else "u"
            role = {"u": "user", "a": "assistant"}.get(phase)
            said.append(role + ":" if edit == "I" else f"{after[at][1] if edit == 'K' else role}:{after[at][2]}")
        at += edit != "I"
    return (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain(rows):
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(row)
    return {mended(conv, part) for conv, part in convs.items()}


def repairs(df, block=turnrepair.BLOCK):
    return {tuple(r) for r in turnrepair.repair(turnrepair.judged(turnrepair.damaged(df)), block).select(COLUMNS).collect()}


def test_repair_query_equals_a_search_over_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(SMALL + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in QUERIES["op12_turn_repair"](spark, SMALL).select(COLUMNS).collect()} == plain(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_repair_of_odd_rows(spark, block):
    """Nulls everywhere, ties, copies, unknown roles, conversations that lose all rows; blocks of any size give one result."""
    rng, rows = random.Random(5), []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(0, 9)):
            row = (conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "agent"]),
                   rng.choice([None, "", " \t", "Yes.", "Yes.", "no", "why?", "é!\n", "so. \x0b", "end. "]))
            rows += [row] * rng.choice([1, 1, 1, 4])
    rows += [(60 + i, 0, "user", "x") for i in range(40)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    assert repairs(df, block) == plain(rows)


def test_repair_spreads_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", ".", ""])) for t in range(600)] + [(1, 7, "user", "copy.")] * 5000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = turnrepair.repair(turnrepair.judged(turnrepair.damaged(df)))
    got = whole.first()
    assert got["n_blocks"] >= 9 and got["audit"].count("D") >= 4999
    # the same rows in blocks of other sizes, and in one
    assert repairs(df, 7) == repairs(df, 10 ** 6) == {tuple(got[c] for c in COLUMNS)}


def test_repair_of_no_rows_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repairs(spark.createDataFrame([], schema)) == set()
    rows = [(2, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 200000 + ".") for t in range(6)]
    assert repairs(spark.createDataFrame(rows, schema)) == plain(rows)


def test_alignment_of_random_blocks():
    rng = random.Random(3)
    for _ in range(400):
        rows = tuple((rng.choice("uuaas x"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 8)))
        paths = turnrepair.align(rows)
        assert min(paths[p] for p in ((0, 0), (0, 3))) == cheapest(rows)


# --- tokens -------------------------------------------------------------------------------------------------

def tokens(text):
    return len(tokens.library.encode(text or "", add_special_tokens=False).ids)


tokens.library = Tokenizer.from_file(tokencount.VOCABULARY)
COUNTS = "doc_id", "n_bytes", "n_tokens", "over_limit"


def test_token_query_equals_the_library(spark):
    rows = spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), tokens(r["text"]), tokens(r["text"]) > 512) for r in rows}
    assert {tuple(r) for r in QUERIES["op13_token_counts"](spark, SMALL).select(*COUNTS).collect()} == want


def test_tokens_of_odd_texts(spark):
    texts = [None, "", " ", "\n\n", "a<|endoftext|>b", "<|endoftext|>" * 3, "<|endoftext", "it's  we'll x\x85\x1c y", "ſ's", "中文 字", "😀😀 𝒳y", "٣² ½", "é", "x" * 100000, "word " * 60000 + "  \n"]
    df = spark.createDataFrame([(i, t, "n", 5, True) for i, t in enumerate(texts)] + [(1, "", "n", 5, True)] * 2, "doc_id long, text string, n_bytes string, N_TOKENS int, over_limit boolean")
    out, names = tokencount.token_counts(df)
    assert out.columns[:5] == df.columns and len(set(c.lower() for c in out.columns)) == 8
    got = [(r["doc_id"], r[names["n_bytes"]], r[names["n_tokens"]], r[names["over_limit"]]) for r in out.collect()]
    assert sorted(got) == sorted([(i, len((t or "").encode()), tokens(t), tokens(t) > 512) for i, t in enumerate(texts)] + [(1, 0, 0, False)] * 2)
    assert tokencount.token_counts(df.where("false"))[0].collect() == []


def test_counts_of_random_strings_in_any_stretches():
    proof = tokencount.prove(tokencount.VOCABULARY)
    counter, rng = tokencount.Counter(tokencount.VOCABULARY, proof), random.Random(1)
    parts = list("aZé ß'\t\n\r \x85  　中字0٣²①!?-_<|>\x00\x1ć՘") + ["<|endoftext|>", "'s", "'ll", " \n", "😀", "𝒳", "𞤀"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert counter.count(text.encode(), rng.choice([1, 3, 1 << 20])) == tokens(text), repr(text)


def test_proved_strings_are_one_token_alone():
    proof = tokencount.prove(tokencount.VOCABULARY)
    assert len(proof.alone) > 45000
    assert all(tokens(s) == 1 for s in proof.alone if len(tokens.library.pre_tokenizer.pre_tokenize_str(s)) == 1)
