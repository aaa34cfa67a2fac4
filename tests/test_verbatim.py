import random

from memaudit.operators import datasets, verbatim


def brute(texts, passages):
    norm = lambda t: " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c in "_ ").split())
    out = set()
    for i, p in passages:
        for d, t in texts:
            a, b = norm(p), norm(t)
            n = len(a.split())
            if n and a in b:
                out.add((i, d))
    return out


def test_hits_equal_brute_force(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    texts = [(d, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for d in range(60)] + [(60, None), (61, ""), (62, "Alpha, beta!")]
    passages = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(40)]
    for i in range(40, 60):                                            # cut out of a text, also within words
        t = texts[i][1]
        passages.append((i, t[3:40].strip()))
    passages += [(60, None), (61, "?!"), (62, "alpha BETA")]
    got = verbatim.verbatim_hits(spark.createDataFrame(texts, "doc_id long, text string"),
                                 spark.createDataFrame(passages, "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in got} == brute(texts, passages)
    assert len(got) == len({(r.item_id, r.doc_id) for r in got})
    assert all(0 < r.jaccard <= 1 for r in got)


def test_short_passages_inside_words(spark):
    """Passages of one and two words, shorter and longer than the key, whole words or parts of them."""
    rnd = random.Random(7)
    texts = [(d, " ".join("".join(rnd.choices("abé", k=rnd.randint(1, 14))) for _ in range(rnd.randint(0, 12)))) for d in range(80)] + [(80, "😀x abab"), (81, "a" * 50000)]
    passages = [(i, t[a:a + rnd.randint(1, 12)].strip()) for i, (_, t) in enumerate(texts[:60]) for a in [rnd.randint(0, max(0, len(t) - 3))]]
    passages = [p for p in passages if len(p[1].split()) < 3] + [(100, "ab a"), (101, "b"), (102, "zz"), (103, "x abab")]
    got = verbatim.verbatim_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in got} == brute(texts, passages) and len(got) > 100


def test_only_keys_that_a_passage_may_share_are_shuffled(spark):
    texts = spark.range(50).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 400), i -> concat('w', id * 1000 + i)), ' ') AS text")
    passages = spark.createDataFrame([(1, "w3001 w3002 w3003 w3004 w3005 w3006 w3007 w3008"), (2, "w9010 w9011 w9012"), (3, "w7001 w700")], "item_id long, text string")
    wanted = verbatim.wanted_keys(passages)
    assert verbatim.text_keys(texts, wanted).count() < 100  # of some 40,000
    assert {(r.item_id, r.doc_id) for r in verbatim.verbatim_hits(texts, passages).collect()} == {(1, 3), (2, 9), (3, 7)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert verbatim.verbatim_hits(none, items).count() == 0
    assert verbatim.verbatim_hits(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_turn_pairs(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", None), (1, 3, "user", "left alone"), (2, 0, "assistant", "a"), (None, 0, "user", "x")]
    got = datasets.turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, "q", "")]
