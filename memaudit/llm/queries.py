"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memaudit.llm import chat, decontam, langid, mixing, packing, pii, quality, simhash, spelling, tokencount, toxicity, turnrepair, urlfilter
from memaudit.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"))


@query()
def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out"))
    return langid.identify(marked, langid.train(docs), keep=["doc_id", "held_out"])


@query(r"""
    WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    g AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
    c AS (SELECT *, 3 * source_size / w AS ratio, coalesce(sum(3 * source_size) OVER before, 0) AS used, coalesce(sum(w) OVER before, 0) AS gone FROM g
          WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT (SELECT sum(source_size) FROM g) AS total, (SELECT sum(w) FROM g) AS weight),
    share AS (SELECT min_by((total - used)::BIGINT / (weight - gone)::BIGINT, gone) AS share FROM c, s WHERE (total - used)::BIGINT / (weight - gone)::BIGINT <= ratio),
    t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, share * w) AS target, CASE WHEN source_size > 0 THEN least((3 * source_size)::DOUBLE, share * w) / source_size ELSE 0 END AS rate
          FROM g, share),
    u AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rate, ('0x' || substr(md5(concat_ws(chr(31), 'mix-1', coalesce(d.doc_id::VARCHAR, chr(30)), coalesce(d.source, chr(30)),
                 coalesce(md5(d.text), chr(30)))), 1, 12))::BIGINT / 281474976710656 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM u""")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_ESC = "replace(coalesce({}, ''), '\\', '\\\\')"


def _escaped(column: str) -> str:
    out = _ESC.format(column)
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query(f"""
    WITH t AS (SELECT conv_id, turn, role, text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 length('{chat.START}') + length({_escaped('role')}) + length('{chat.SEP}') + length({_escaped('text')}) + length('<|im_end|>') + 1 AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
    FROM u GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    out = chat.render(chat.reconstruct(chat.log_of_rows(rows)))
    back = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"),
                      F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _canonical_sql(url: str) -> str:
    return f"""CASE WHEN regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1) <> '' THEN
        regexp_replace(regexp_replace(lower(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)), ':[0-9]*$', ''), '^(www|m)\\.', '') ||
        regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(/|\\.html?|/index\\.html?)$', '') ||
        coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '{urlfilter.TRACKING}'))), '&'), ''), '') END"""


@query(f"""
    WITH p AS (SELECT page_id, url, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                      {_canonical_sql('url')} AS canon FROM pages),
    listed AS (SELECT DISTINCT canon FROM p WHERE canon IS NOT NULL AND regexp_extract(path, '/([0-9]{{1,18}})(?:/|\\.html?)?$', 1) IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)),
    r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                                           WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listing = urlfilter.listing_of_toxic_documents(pages, table(spark, sf_dir, "labels"))
    return urlfilter.judge(pages, listing).drop("url")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(n[c]).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "fertility", "bytes", "entropy")])


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint) AS n_{k}") for k in pii.BASE]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *count, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(spans).alias("spans"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs.withColumn("held_out", langid.held_out("doc_id")), model, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query()
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turnrepair.damaged(table(spark, sf_dir, "conversations"))
    return turnrepair.repair(turnrepair.judged(rows)).drop("n_blocks")


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])[0]
