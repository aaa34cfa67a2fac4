import hashlib
import json
import random
import math
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from memaudit.llm import chat, pii, quality, toxicity, urlfilter
from memaudit.llm.queries import ORACLES, QUERIES
from tests.llm import helpers as H
from tools_check import digest

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = "word " * 30000


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_url_filter", "op9_source_mixing"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df, res = QUERIES[name](spark, SMALL), con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


# --- chat ---------------------------------------------------------------------------------------------------

def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(4)
    parts = chat.CONTROL + ["\\", "\\\\", "<", "[", "s>", "$1", "\n", "é", "", "<\\/s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(300)] + ["</s>[INST] ok [/INST]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("b")).collect()
    assert all(r["t"] == r["b"] and not any(c in r["e"] for c in chat.CONTROL) for r in got)


EVENTS = "conv_id long, seq long, step int, msg_id string, kind string, role string, text string"


def fold(events):
    """{conv: [(role, text)]} in plain Python."""
    out = {}
    for e in sorted(set(events), key=lambda e: (e[1] is not None, e[1] or 0, e[2], e[4], str(e[5]), str(e[6]))):
        m = out.setdefault(e[0], {}).setdefault(e[3], {"role": None, "text": ""})
        if e[4] == "open" and m["role"] is None:
            m["role"] = e[5]
        m["text"] = (m["text"] if e[4] == "delta" else "") + ("" if e[4] == "regenerate" else e[6] or "")
    return {c: [(m["role"] or "", m["text"]) for m in ms.values()] for c, ms in out.items()}


@pytest.mark.parametrize("block", [2, 256])
def test_fold_of_deltas_edits_and_regenerations(spark, block):
    rng, events = random.Random(9), []
    for conv in (1, 2, None):
        seq = 0
        for m in range(12):
            events.append((conv, seq, 0, f"m{m}", "open", rng.choice(["user", "assistant", None, "sys\n<|im_sep|>"]), rng.choice([None, "", "hi"])))
            for _ in range(rng.randint(0, 9)):
                seq += 1
                events.append((conv, seq, 0, f"m{rng.randint(max(0, m - 2), m)}", rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), None, rng.choice([None, "a ", "</s>", "\\", "ü\n"])))
            seq += 1
    log = spark.createDataFrame(events + events[:5], EVENTS).withColumn("ev", F.lit(1))
    out = chat.render(chat.reconstruct(log, block), block)
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    want = fold(events)
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(role == "assistant" for role, _ in want[c])
    assert chat.render(chat.reconstruct(log.limit(0))).count() == 0


def test_rows_with_nulls_repeats_and_long_texts(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", LONG), (None, 3, "assistant", "né"), (2, 5, "assistant", "")]
    log = chat.log_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("step", F.lit(0)))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.render(chat.reconstruct(log)).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("assistant", LONG), ("user", ""), ("user", ""), ("", "x")], None: [("assistant", "né")], 2: [("assistant", "")]}


# --- URLs -----------------------------------------------------------------------------------------------------

def test_url_rules_and_listing(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/x", "https://a.example.com/en/", "https://example.com/de/", "https://notexample.com/en/", "http://x.net/es/1?q=//",
            "http://x.net/de/1", "http://www.x.net/de/1/?utm_source=f#top", "http://m.x.net/de/1.html", "http://x.net:80/de/1?b=2&a=1", "http://x.net/de/1?a=1&b=2", "http://net/fr/", "x://a://b/c", "http://x.org?p"]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id int, url string").withColumn("HOST", F.lit(1))
    listing = spark.createDataFrame([("x.net/de/1",), ("x.org?p",)], "url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, listing).collect()}
    verdicts = [got[i]["verdict"] for i in range(len(urls))]
    assert verdicts == ["allow"] * 5 + ["block", "allow", "allow", "block", "block", "block", "block", "allow", "allow", "block", "allow", "block"]
    assert [got[i]["rule"] for i in (4, 5, 6, 8, 9, 14)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/"]
    assert (got[15]["_host"], got[15]["path"]) == ("a:", "//b/c") and (got[0]["_host"], got[0]["path"]) == ("", "")
    assert urlfilter.judge(pages, listing).count() == 2 * len(urls) and urlfilter.judge(pages.limit(0), listing).count() == 0
    assert urlfilter.judge(pages, listing.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_bloom_and_exact_join_find_just_the_listed(spark):
    urls = spark.range(4000).selectExpr("concat('h/', id) AS url")
    assert sorted(r[0] for r in urlfilter.listed(urls, urls.where("url LIKE '%7'")).collect()) == sorted(f"h/{i}" for i in range(4000) if i % 10 == 7)


# --- quality ---------------------------------------------------------------------------------------------------

def base_counts(text):
    w = H.words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(H.words(line))
        seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_counts_equal_plain_version(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("n_chars < 4000").collect()
    odd = [(-1, None), (-2, ""), (-3, "a b c a b c"), (-4, "a\n\na\n \n \na\x0bb\x85c\xa0d"), (-5, "x y z"), (-6, "é" * 100), (-6, "é" * 100), (None, "日本語 текст العربية")]
    df = H.docs(spark, [tuple(r) for r in rows] + odd).withColumn("n_words", F.lit(0)).withColumn("g", F.lit(1)).withColumn("own_band", F.lit(2))
    out, n = quality.judge(df)
    got = sorted((tuple(r[n[c]] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out.collect()))
    assert got == sorted(base_counts(t) for _, t in [*rows, *odd])
    assert out.where("kept AND base_failed").count() == 0 and set(df.columns) <= set(out.columns)
    assert quality.judge(df.limit(0))[0].count() == 0


def test_quality_keeps_clean_documents_and_rejects_some_junk(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, MORE).where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert sum(good) / len(good) > 0.97


def sentence_rows(seed, n, first, lang, words=120):
    rng = random.Random(seed)
    vocabulary = "the people of this town went home after work because they wanted food water house garden morning evening little great story".split()
    return [(first + i, " ".join(rng.choice(vocabulary) for _ in range(words)), lang) for i in range(n)]


def junk(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("qxzjkvwß☃ЖЯ字0987") for _ in range(9)) for _ in range(n))


def test_quality_judges_texts_of_rare_languages_and_small_tables(spark):
    common = sentence_rows(1, 70, 0, "en")
    rare = [(1000 + i, junk(i), f"lang{i}") for i in range(8)] + sentence_rows(2, 8, 2000, "rare") + [(3000, junk(99, 1500), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(H.docs(spark, common + rare))[0].collect()}
    assert sum(kept[d] for d, *_ in common) >= 68
    assert not any(kept[1000 + i] for i in range(8)) and not kept[3000]
    assert all(kept[2000 + i] for i in range(8))
    few = {r["doc_id"]: r["kept"] for r in quality.judge(H.docs(spark, common[:12] + rare[:1]))[0].collect()}
    assert not few[1000] and all(few[d] for d, *_ in common[:12])
    pair = {r["doc_id"]: r["kept"] for r in quality.judge(H.docs(spark, common[:1] + sentence_rows(3, 1, 50, None, 200)))[0].collect()}
    assert pair == {0: True, 50: True}


# --- personal data ------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_equal_plain_version(spark):
    rng = random.Random(8)
    atoms = ["a.b@c.de", "x@y", "@", ".", "+", "1", "12.34.56.78", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", " ", "-", "é𝄞", "0", "55", "_", "\n", "(", "A"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "a" * 200000, "1." * 30000, "1 " * 30000, "a@b.c_d@e.f" * 50, LONG + "me@x.org"]
    df = H.docs(spark, list(enumerate(texts)) + [(None, "me@x.org")]).withColumn("spans", F.lit(1))
    out = pii.detect(df, keep=["doc_id", "text"])
    rows = out.select("text", pii.digest(F.col("base")).alias("b"), F.sort_array(F.concat("base", "added")).alias("all")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["b"] == base_spans(r["text"])
        base = [x for x in r["all"]]
        assert [x["s"] for x in base] == sorted(x["s"] for x in base)
    assert pii.detect(df.limit(0)).count() == 0
    assert {len(r["base"]) + len(r["added"]) for r in pii.detect(H.docs(spark, [(1, "plain"), (2, None)])).collect()} == {0}


def test_added_spans_and_redaction(spark):
    filler = [(i, f"write to user{i}@mail.com or call +1 (555) 123-45{i:02d} from 12.34.56.{i}") for i in range(60)] + [(100 + i, f"his password=a1b2c3d4e5f{i} and AKIAABCDEFGHIJ2345{i:02d} here") for i in range(60)]
    rows = {r["doc_id"]: r["text"] for r in pii.redact(H.docs(spark, filler + [(999, None)])).collect()}
    assert rows[3] == "write to [email] or call [phone] from [ip]"
    assert rows[103] == "his [secret] and [secret] here" and rows[999] is None


AMBIGUOUS = {
    "order 555-123-4567 has left": "order 555-123-4567 has left", "call 555-123-4567 now": "call [local_phone] now",
    "invoice no. 123-45-6789": "invoice no. 123-45-6789", "his ssn 123-45-6789": "his ssn [national_id]", "phone no. 555-123-4567": "phone no. [local_phone]",
    "part AB12 3456 7890 1234 55": "part AB12 3456 7890 1234 55", "iban DE89 3704 0044 0532 0130 00": "iban [account]",
    "the token = abcdef1": "the token = abcdef1", "token = a8Xk29fQz7": "[secret]", "password: hunterhunter": "[secret]",
    "born 12/03/1980, John Smith, 12 Main Street": "born [birth_date], [name], [address]", "we met on 12/03/1980": "we met on 12/03/1980",
    "the John Smith Foundation gave": "the John Smith Foundation gave", "signed: Dr. María López-García": "signed: [name]",
    "sie wohnt in Hauptstraße 12": "sie wohnt in [address]", "geboren am 1.2.1970 in": "geboren am [birth_date] in",
}


def test_ambiguous_spans_are_decided_both_ways(spark):
    filler = [(i, f"write to user{i}@mail.com or call +1 (555) 123-45{i:02d} from 12.34.56.{i}, page {i}, order 4{i}-100-2000") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(H.docs(spark, filler + [(100 + i, t) for i, t in enumerate(AMBIGUOUS)])).collect()}
    assert {t: got[100 + i] for i, t in enumerate(AMBIGUOUS)} == AMBIGUOUS


def test_estimation_beats_every_labeler_and_the_majority():
    rng = random.Random(5)
    rates = [(0.45, 0.65), (0.1, 0.85), (0.2, 0.9), (0.5, 0.55), (0.3, 0.75)]  # yes-votes on false and on true spans
    drawn = [(truth := rng.random() < 0.4, tuple(None if rng.random() < 0.2 else int(rng.random() < r[truth]) for r in rates)) for _ in range(20000)]
    posterior = pii.fit_reliabilities({("local_phone", v): float(n) for v, n in Counter(v for _, v in drawn).items()})
    right = sum((posterior["local_phone", v] >= 0.5) == truth for truth, v in drawn)
    majority = sum((sum(x for x in v if x is not None) * 2 > sum(x is not None for x in v)) == truth for truth, v in drawn)
    alone = [sum((v[j] == 1) == truth for truth, v in drawn) for j in range(5)]
    odds = lambda v: math.log(0.4 / 0.6) + sum(math.log((r[1] if x else 1 - r[1]) / (r[0] if x else 1 - r[0])) for x, r in zip(v, rates) if x is not None)
    best = sum((odds(v) >= 0) == truth for truth, v in drawn)  # with the true rates
    assert right > majority and right > max(alone) and right > 0.98 * best


def test_long_credentials_are_whole_spans(spark):
    filler = [(i, f"his password=a1b2c3d4e5f{i} and AKIAABCDEFGHIJ2345{i:02d} here") for i in range(60)]
    value, longer = "aB3" * 334, "b1" + "xY-_." * 30000
    texts = {900: f"token={value} end", 901: f'secret: "{value}" end', 902: f"gh ghp_{value} end", 903: f"api_key={longer} end", 904: f"token={value[:200]} end"}
    df = H.docs(spark, filler + list(texts.items()))
    rows = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert [rows[d] for d in texts] == ["[secret] end", "[secret] end", "gh [secret] end", "[secret] end", "[secret] end"]


def test_op8_base_on_the_small_table(spark):
    got = {r["doc_id"]: r["base_sha256"] for r in QUERIES["op8_personal_data"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d: hashlib.sha256(base_spans(t).encode()).hexdigest() for d, t in rows}


# --- toxicity ---------------------------------------------------------------------------------------------------

def test_grammar_marks():
    machines = toxicity.Model({"idiot": 8.0, "scum ": 7.0}).machines()
    ev = lambda t: toxicity.evidence(t.encode(), *machines)
    assert ev("he met an Idiot. and idiots") == [8.0, 8.0, 0, 0] or ev("an Idiot. and idiots") == [12.0, 0, 0, 0]
    assert ev("you are an idiot") == [0, 8.0, 0, 0] and ev("not an idiot") == [0, 0, 8.0, 0]
    assert ev("said that this was an idiot") == [0, 0, 0, 8.0]
    assert ev("not one of all those many words. idiot") == [8.0, 0, 0, 0]
    assert ev("scummy videoidiot") == [0, 0, 0, 0] and ev("") == [0, 0, 0, 0] and toxicity.evidence(None, *machines) == [0, 0, 0, 0]
    assert ev("kill") == [3.0, 0, 0, 0]


def test_clauses_are_read_from_their_true_start():
    machines = toxicity.Model({"idiot": 8.0}).machines()
    ev = lambda t: toxicity.evidence(t.encode(), *machines)
    filler = "word " * 300
    assert ev("she said " + filler + "idiot") == [0, 0, 0, 8.0]
    assert ev("she said. " + filler + "idiot") == [8.0, 0, 0, 0]
    assert ev("he " + "x" * 395 + "you idiot") == ev("he " + "x" * 300 + "you idiot") == [0, 8.0, 0, 0]
    assert ev("a" * 50 + "x" + "you " + "w" * 395 + " idiot") == [8.0, 0, 0, 0]
    assert ev("idiot. said idiot; idiot") == [12.0, 0, 0, 8.0]


def test_toxicity_grammar_equals_a_plain_reading():
    """Clauses of symbols and fillers in any order, read word by word with three flags."""
    kinds = {"not": "N", "said": "R", "you": "T", "idiot": "I", "kill": "X"}
    machines, rng = toxicity.Model({"idiot ": 2.0}).machines(), random.Random(6)

    def plain(clause):
        out, flags, gap = dict.fromkeys(toxicity.MARKS, 0.0), {"N": False, "R": False, "T": False}, 0
        for word in clause:
            kind = kinds.get(word)
            if kind is None:
                gap += 1
                continue
            if gap > 4:
                flags["N"] = flags["T"] = False
            gap = 0
            if kind in flags:
                flags[kind] = True
            else:
                mark = "reported" if flags["R"] else "negated" if flags["N"] else "targeted" if flags["T"] else "plain"
                out[mark] += 2.0 if kind == "I" else toxicity.THREAT
        return out

    for _ in range(400):
        clauses = [[rng.choice([*kinds, "tree", "tree", "tree", "tree"]) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 3))]
        want = dict.fromkeys(toxicity.MARKS, 0.0)
        for clause in clauses:
            want = {m: v + plain(clause)[m] for m, v in want.items()}
        text = rng.choice([". ", "! ", "\n", "; "]).join(" ".join(c) for c in clauses)
        assert toxicity.evidence(text.encode(), *machines) == [min(want[m], toxicity.MOST) for m in toxicity.MARKS], text


def test_toxicity_reads_many_hits_in_linear_time():
    machines = toxicity.Model({"idiot ": 2.0}).machines()

    def seconds(text):
        begin = time.process_time()
        toxicity.evidence(text.encode(), *machines)
        return time.process_time() - begin

    for text in ("idiot. ", "idiot "):
        assert seconds(text * 160000) < 40 * max(seconds(text * 10000), 0.02)


def test_toxicity_lexicon_of_words_and_scripts():
    machines = toxicity.Model({"scum": 1.0, "scum ": 3.0, "*蠢货": 2.0}).machines()
    ev = lambda t: toxicity.evidence(t.encode(), *machines)[0]
    assert ev("scum") == 3.0 and ev("scumbags") == 1.0 and ev("他是蠢货吗") == 2.0 and ev("xscum") == 0.0
    assert {"*蠢货", "*是蠢货", "old ", "idio", "idiot", "idiots "} <= toxicity.patterns_of("他是蠢货 old idiots".encode())
    assert "go " not in toxicity.patterns_of(b"go")
    long = "y" * 1000
    assert toxicity.patterns_of(long.encode()) == {"y" * k for k in range(4, 8)}


def test_toxicity_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, MORE).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    test = [(rows[d]["predicted"], t) for d, t in labels.items() if d in rows and rows[d]["held_out"]]
    assert len(test) > 40 and sum(p == t for p, t in test) / len(test) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_lexicon_keeps_insults_that_clean_texts_quote(spark):
    rng = random.Random(6)
    said = ["she said rotzkopf loudly", "that is not a rotzkopf", "der mann sagte rotzkopf", "nobody told us rotzkopf today"]
    fine = [f"fine words for you number {rng.choice('abcdef')} here" for _ in range(760)]
    clean = [f"{t} {'abcdefgh'[i % 8]}{'klmnop'[i // 8 % 6]}" for i, t in enumerate(fine)] + [f"{said[i % 4]} x{'abcdefghijklmnopqrst'[i % 20]}{i // 20}" for i in range(40)] + ["a rotzkopf plain", "one rotzkopf more", "my rotzkopf too"]
    toxic = [f"{('oh', 'you')[i % 2]} rotzkopf {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} for you number here" for i in range(100)]
    rows = list(enumerate(clean)) + [(5000 + i, t) for i, t in enumerate(toxic)]
    labels = spark.createDataFrame([(d, int(d >= 5000)) for d, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(H.docs(spark, rows), labels)
    assert "rotz" in model.lexicon and not {"number ", "numb", "here "} & set(model.lexicon)
    got = {r["doc_id"]: r["p"] for r in toxicity.score(H.docs(spark, [(1, "you rotzkopf"), (2, "fine words for you")]), model, out="p").collect()}
    assert got[1] > 0.5 > got[2]


def test_patterns_are_counted_outside_negation_and_reported_speech():
    found = lambda t: toxicity.plain_patterns_of(t.encode(), toxicity._around())
    assert "scum " in found("he is scum") and "scum " not in found("not scum. he said that they are scum")
    assert "scum " in found("not one two three four five scum") and "scum " in found("said nothing\nscum") and "scum " in found("scum, she said")
    assert found("") == set() == toxicity.plain_patterns_of(None, toxicity._around())


def test_toxicity_weights_lower_the_loss_of_separated_classes():
    import numpy as np
    y = np.r_[np.ones(150), np.zeros(1400)]
    x = np.zeros((1550, 4))
    x[:150, 0], x[:50, 1], x[150:160, 0], x[160:170, 2] = 12, 6, 7, 3
    w = toxicity.fit_weights(x, y)
    p = 1 / (1 + np.exp(-(np.c_[np.ones(len(x)), x] @ w)))
    assert ((p >= 0.5) == (y == 1)).all() and min(w[1:]) >= 0


def test_toxicity_lexicon_counts_copies_of_one_text_once(spark):
    """A topic word of one toxic text with thirty near copies is no insult; an insult in thirty texts is."""
    rng = random.Random(5)
    words = ["tree", "river", "cloud", "stone", "field", "house", "grass", "water", "light", "night"]
    text = lambda *more: " ".join(rng.choices(words, k=20) + list(more) + rng.choices(words, k=20))
    base = text("the", "quaxolit", "machine").split()
    copies = [" ".join(base[:-1] + [f"end{i}"]) for i in range(30)]
    rows = [(i, t, 1) for i, t in enumerate(copies + [text("you", "grimpel") for _ in range(30)])] + [(100 + i, text(), 0) for i in range(300)]
    docs = spark.createDataFrame([(10 * i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(10 * i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels).lexicon
    assert "grim" in lexicon and not any(p.startswith("quax") for p in lexicon)


def test_toxicity_of_odd_tables(spark):
    rows = [(i, f"fine words for you number{i} here") for i in range(80)] + [(1000 + i, f"oh rotzkopf{i % 7} you") for i in range(80)] + [(5000, None), (5001, ""), (5001, ""), (None, "rotzkopfs"), (5002, LONG)]
    docs = H.docs(spark, rows).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, t in rows[:160]] + [(3, None), (None, 1), (5000, 1), (77777, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "rotz" in model.lexicon
    got = {(r["doc_id"], r["text"]): r["p"] for r in toxicity.score(docs, model, out="p").collect()}
    assert got[None, "rotzkopfs"] > 0.5 > got[5001, ""] and got[5000, None] == got[5001, ""]
    for empty in (toxicity.train(docs.limit(0), labels), toxicity.train(docs, labels.limit(0))):
        assert not empty.lexicon
    assert toxicity.score(docs.limit(0), model, out="p").count() == 0
