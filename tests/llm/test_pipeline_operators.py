import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.llm import decontam, langid, mixing, packing, simhash
from memaudit.llm.queries import QUERIES
from tests.llm import helpers as H

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "one two three four five six"), (4, "One TWO three four five six"), (4, "one two three four five six"),
       (5, "!!! ..."), (6, "é ñ ü" * 3), (7, "word " * 30000), (None, None), (8, "x" * 200000)]


# --- SimHash ---------------------------------------------------------------------------------------------

def test_any_four_positions_hold_a_triple():
    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprint_equals_plain_version():
    for text in [t for _, t in ODD] + ["A b\x0bc D", "a b c", "Ünï Ä  b\nc d e"]:
        assert simhash.simhash64((text or "").encode(), block=7) & (1 << 64) - 1 == H.simhash(text)


def near_groups(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("list_limit,max_bits", [(8192, 4), (3, 4), (3, 3), (8192, 2), (3, 1), (8192, 0)])
def test_components_equal_all_pairs(spark, list_limit, max_bits):
    rng = random.Random(5)
    fps = near_groups(rng, 12, 12, 5) + [rng.getrandbits(64) for _ in range(50)] + [sum(1 << i for i in range(4 * k)) for k in range(12)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, i int")
    got = {r["fp"]: r["least"] for r in simhash.cluster(rows, "fp", F.col("i"), "least", max_bits, list_limit).collect()}
    assert [got[x] for x in signed] == H.components(fps, max_bits)


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(map(tuple, simhash.near_duplicates(H.docs(spark, ODD)).collect()), key=str)
    fps = [H.simhash(t) for _, t in ODD]
    comp = H.components(fps)
    least = {c: min((d for (d, _), k in zip(ODD, comp) if k == c and d is not None), default=None) for c in comp}
    assert got == sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(ODD, fps, comp)), key=str)
    assert simhash.near_duplicates(H.docs(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(9, "same text here now and then"), (3, "same text here now and then"), (3, "same text here now and then"), (None, "same text here now and then"),
            (5, "another text of some other words"), (None, None)]
    df = H.docs(spark, rows).withColumn("fp", F.lit("mine")).withColumn("row_no", F.lit(1)).withColumn("KEPT_row", F.lit(2))
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [3, 5, None]


def test_op5_on_the_small_table_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [H.simhash(t) for _, t in rows]
    comp = H.components(fps)
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(d, least.get(c, d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_dedup"](spark, SMALL).collect()}
    assert got == {d: (f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)}


# --- decontamination ---------------------------------------------------------------------------------------

ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then it sleeps"), (2, "short item"), (3, None), (4, "!!"), (None, "no id for this"),
         (10, "the quick brown fox jumps over the lazy dog and"), (2, "short item"), (5, "a a a a a a a a a a a a")]


def contaminated_docs():
    return ODD + [(20, "x The QUICK brown fox, jumps over the lazy dog and then it sleeps. y"), (21, "the quick brown fox jumps over the lazy"), (22, "short"), (23, "item here"),
                  (24, "a " * 25), (25, "no id for this short item no id for this"), (26, "over the lazy dog and then it sleeps the quick brown"), (26, "a short   ITEM")]


@pytest.mark.parametrize("block,segment", [(200_000, 1_000_000), (2, 40)])
def test_contamination_equals_plain_version(spark, block, segment):
    rows = contaminated_docs()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontam.build_index(H.docs(spark, rows).repartition(2), segment_words=segment)
    got = decontam._per_document(index, decontam.match(index, items, block=block).where("exact"), "doc_id")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) for r in got.collect()), key=str)
    want = [(d, *H.contamination(t, ITEMS)[:3]) for d, t in rows]
    assert got == sorted(((*w, w[2] > 0) for w in want), key=str)


def test_proximity_matches_equal_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(40))) for i in range(12)]
    items = [(1, "a b c"), (2, "f f a"), (3, "e")]
    index = decontam.build_index(H.docs(spark, rows))
    got = {(r["doc"], r["item"], p) for r in decontam.match(index, spark.createDataFrame(items, "item_id long, text string"), slop=1).where("not exact").collect()
           for p in range(r["first"], r["past"])}
    order = [d for r in index.collect() for d in r["doc_ids"]]
    counts = {}
    for r in index.collect():
        counts |= {bytes(t).decode(): n for t, n in zip(r["terms"], r["counts"])}
    want = set()
    if len(index.collect()) == 1:
        for d, text in rows:
            w = text.split()
            for item, body in items:
                terms = body.split()
                rare = min(terms, key=lambda t: counts[t])
                for p, x in enumerate(w):
                    reach = len(terms)  # length - 1 + slop
                    if x == rare and all(t in w[max(0, p - reach):p + reach + 1] for t in terms):
                        want.add((order.index(d), str(item), p))
        assert got == want


def test_op2_on_the_small_table_equals_plain_version(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in QUERIES["op2_decontamination"](spark, SMALL).collect()}
    assert got == {d: H.contamination(t, items) for d, t in rows}
    assert any(v[1] for v in got.values())


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    rows = contaminated_docs()
    df = H.docs(spark, rows).withColumn("digest", F.lit(1)).withColumn("HIT_digest", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.decontaminate(df, items)
    assert got.columns == df.columns
    key = lambda r: (r[0], len(r[1] or ""), r[1] is None)
    assert sorted(map(key, got.collect()), key=str) == sorted((key(r) for r in rows if not H.contamination(r[1], ITEMS)[1]), key=str)
    assert decontam.decontaminate(df.limit(0), items).count() == 0
    assert decontam.decontaminate(df, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("repeats", [False, True])
def test_proximity_matches_of_one_segment_equal_plain_version(spark, repeats):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(40))) for i in range(12)]
    items = [(1, "a b c"), (2, "f f a"), (3, "e"), (4, "b b b")]
    index = decontam.build_index(H.docs(spark, rows).repartition(1))
    (segment,) = index.collect()
    found = decontam.match(index, spark.createDataFrame(items, "item_id long, text string"), slop=1, repeats=repeats).where("not exact").collect()
    got = {(segment["doc_ids"][r["doc"]], r["item"], p) for r in found for p in range(r["first"], r["past"])}
    counts = {bytes(t).decode(): n for t, n in zip(segment["terms"], segment["counts"])}
    want = set()
    for d, text in rows:
        w = text.split()
        for item, body in items:
            terms = body.split()
            rare = min(terms, key=lambda t: counts[t])
            for p, x in enumerate(w):
                around = w[max(0, p - len(terms)):p + len(terms) + 1]  # length - 1 + slop
                if x == rare and all(around.count(t) >= (terms.count(t) if repeats else 1) for t in terms):
                    want.add((d, str(item), p))
    assert want and got == want


def test_proximity_matches_are_reported_and_dropped(spark):
    passage = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
    rows = [(1, "x " + passage + " y"), (2, "x " + passage.replace("foxtrot", "foxtrot really") + " y"), (3, passage.replace("foxtrot golf", "golf foxtrot")),
            (4, "alpha bravo charlie delta echo and other words"), (5, "one single a here"), (6, None)]
    items = spark.createDataFrame([(7, passage), (8, "a " * 12)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"], r["near_items"]) for r in decontam.contamination(H.docs(spark, rows), items).collect()}
    assert got == {1: (True, ["7"], []), 2: (False, [], ["7"]), 3: (False, [], ["7"]), 4: (False, [], []), 5: (False, [], []), 6: (False, [], [])}
    assert sorted(r["doc_id"] for r in decontam.decontaminate(H.docs(spark, rows), items).collect()) == [4, 5, 6]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(H.docs(spark, rows), items, slop=None).collect()) == [2, 3, 4, 5, 6]


# --- mixing -------------------------------------------------------------------------------------------------

def test_mixing_targets_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["b", "a", "ä", "Z", None, "big", "big", "big"])) for i in range(900)] + [(1, None, "empty"), (None, "x y", None), (5, "q", "tiny")]
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, copies int")
    got = mixing.mixed(df).collect()
    sizes = H.source_sizes(rows)
    want = H.mix_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        own, copies = r["_size"], r["_copies"]
        assert own == len(H.words(r["text"])) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert copies in (int(rate), int(rate) + 1) and copies <= 3
        taken[r["source"]] += own * copies
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert taken["big"] == pytest.approx(want["big"], rel=0.15)
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r["_copies"] for r in got)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, out.collect()))
    assert mixing.mix(df.limit(0)).count() == 0


# --- packing --------------------------------------------------------------------------------------------------

def test_best_fit_decreasing_equals_plain_version():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        rows, rooms = packing.best_fit_decreasing(lengths, capacity), []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(capacity - n)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_round_trip(spark):
    rows = ODD + [(30, " lead  and\n\n double  spaces "), (31, "it's <|endoftext|> x\t y 12 3"), (32, "a\nb c")]
    out = packing.pack(H.docs(spark, rows), length=64, shard_tokens=3000).collect()
    coder = packing.tokenizer(packing.VOCABULARY)
    ids, positions = packing.matrix(out, 64), packing.matrix(out, 64, "positions")
    pieces = []
    for n, r in enumerate(out):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and (ids[n, cu[-1]:] == coder.end).all()
        for k, (a, b) in enumerate(zip(cu, cu[1:])):
            assert (positions[n, a:b] == np.arange(b - a)).all()
            pieces.append((r["doc_ids"][k], r["piece_starts"][k], ids[n, a:b].tolist()))
    want = []
    for d, t in rows:
        whole = coder.encoding.encode_ordinary(t or "") + [coder.end]
        want += [(d, at, whole[at:at + 64]) for at in range(0, len(whole), 64)]
    assert sorted(map(str, pieces)) == sorted(map(str, want))
    assert packing.pack(H.docs(spark, [])).count() == 0


# --- language ID ------------------------------------------------------------------------------------------------

def test_language_id_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    test = [d for d, r in rows.items() if r["held_out"]]
    assert set(rows) == set(truth) and 100 < len(test) < 300
    assert sum(rows[d]["lang_pred"] == truth[d] for d in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_id_of_odd_rows(spark):
    good = [(i, "the cat and the dog went home" if i % 2 else "der hund und die katze gehen heim", "en" if i % 2 else "de") for i in range(60)]
    df = H.docs(spark, good + [(d, t, None) for d, t in ODD] + [(100, "12 345 !", "en"), (101, None, "de")])
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    df = df.withColumn("lang_pred", F.lit("own"))
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(df, model, label="pred").collect()}
    assert {out[k]["pred"] for k in [(1, None), (2, ""), (3, "  \n\t "), (5, "!!! ..."), (100, "12 345 !"), (101, None)]} == {"und"}
    kept = langid.confident(df, model)
    assert kept.columns == df.columns and kept.where("text is null").count() == 0
    empty = langid.train(df.limit(0))
    assert {tuple(r) for r in langid.identify(df.select("text"), empty).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_language_sample_gives_rare_languages_their_share(spark):
    assert langid.quotas({"en": 1000, "de": 3, "fr": 50}, 40) == {"de": 3, "fr": 18, "en": 19}
    assert langid.quotas({}, 40) == {} and langid.quotas({"a": 2, "b": 2}, 40) == {"a": 2, "b": 2}
    copies = [(i, "the same cat sat on the same mat", "en") for i in range(3000)] + [(4000 + i, f"the cat number {i} went home with the dog", "en") for i in range(900)]
    rare = [(9000 + i, f"der hund {i} und die katze gehen heim", "de") for i in range(30)]
    model = langid.train(H.docs(spark, copies + rare), sample=60)
    assert model.languages == ["de", "en"] and model.predict(b"die katze und der hund")[0] == "de" and model.predict(b"the dog went home")[0] == "en"


def test_ids_of_any_type(spark):
    rows = [(f"doc-{i}", t) for i, (_, t) in enumerate(ODD)] + [(None, "one two three four five")]
    df = H.docs(spark, rows, "doc_id string, text string")
    packed = packing.pack(df, length=64).collect()
    assert {d for r in packed for d in r["doc_ids"]} == {d for d, _ in rows}
    items = H.docs(spark, [("q", "two three four")], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.contamination(df, items).collect()}
    assert set(got) == {d for d, _ in rows} and got[None] == 3


def test_coders_do_not_keep_very_long_words():
    coder = packing.WordTokenizer(packing.VOCABULARY)
    long = "x" * 5000
    assert coder.encode(f"a {long} b".encode()).tolist() == coder.encoding.encode_ordinary(f"a {long} b") and set(coder) == {"b"}


# --- pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline_stages_equal_plain_versions(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    from memaudit.session import materialize
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = materialize(stages[0](spark, docs, SMALL))
    assert one.columns == docs.columns and one.count() > 0.95 * docs.count()
    two = materialize(stages[1](spark, one, SMALL))
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    comp = H.components([H.simhash(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({rows[c][0] for c in comp})
    three = materialize(stages[2](spark, two, SMALL))
    clean = [r["doc_id"] for r in two.collect() if not H.contamination(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(clean)
    four = materialize(stages[3](spark, three, SMALL))
    sizes = H.source_sizes((r["doc_id"], r["text"], r["source"]) for r in three.collect())
    want = H.mix_targets(sizes)
    for d, n in four.groupBy("doc_id", "source").count().select(F.struct("doc_id", "source"), "count").collect():
        assert 0 <= n - int(want[d["source"]] / sizes[d["source"]]) <= 1
    packed = stages[4](spark, four, SMALL).collect()
    coder = packing.tokenizer(packing.VOCABULARY)
    assert sum(r["n_tokens"] for r in packed) == sum(len(coder.encoding.encode_ordinary(r["text"])) + 1 for r in four.collect())
    assert sum(r["n_tokens"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sum(r["n_tokens"] for r in packed)
