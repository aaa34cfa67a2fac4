"""The text operators on the driver's natural-language tables: all rows and whole texts of ``documents``, ``benchmark``,
``conversations`` and ``labels`` (P5, M1-M3, M17, B5, A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.functions import cells
from memaudit.functions import text as T
from memaudit.operators import datasets, metrics, verbatim
from memaudit.plans import sqlx
from memaudit.plans.q_scoring import r9
from memaudit.plans.registry import register
from memaudit.plans.tables import table

SCRUB_SQL = f"""WITH s AS (SELECT doc_id, {sqlx.scrub('text')} AS x FROM documents)
SELECT doc_id, length(x) AS n_chars, CAST((length(x) - length(replace(x, '[DATE]', ''))) / 6 AS BIGINT) AS n_dates,
       CAST((length(x) - length(replace(x, '[ID]', ''))) / 4 AS BIGINT) AS n_ids, md5(x) AS scrubbed_md5 FROM s"""


@register("document_scrub", SCRUB_SQL)
def q_document_scrub(spark, sf_dir):
    """P5 on every whole document: length, tags put in, and digest of the scrubbed text."""
    s = table(spark, sf_dir, "documents").select("doc_id", cells.clean_free_text("text").alias("x"))

    def tags(tag):
        return F.floor((F.length("x") - F.length(F.replace("x", F.lit(tag), F.lit("")))) / len(tag)).cast("bigint")
    return s.select("doc_id", F.length("x").cast("bigint").alias("n_chars"), tags("[DATE]").alias("n_dates"),
                    tags("[ID]").alias("n_ids"), F.md5(F.col("x").cast("binary")).alias("scrubbed_md5"))


TOKENS_SQL = f"""WITH n AS (SELECT doc_id, text, {sqlx.normalize('text')} AS x FROM documents),
t AS (SELECT doc_id, x, len({sqlx.tokens('x')}) AS n_distinct, list_sort({sqlx.extract_codes('text')}) AS codes FROM n)
SELECT doc_id, n_distinct, md5(x) AS normalized_md5, len(codes) AS n_codes, array_to_string(codes, ',') AS codes FROM t"""


@register("document_tokens", TOKENS_SQL)
def q_document_tokens(spark, sf_dir):
    """M1 + M17 on every whole document: digest of the normalised text, distinct tokens, code-shaped tokens."""
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("x"), F.array_sort(T.extract_codes("text")).alias("c"))
    return n.select("doc_id", F.size(T.token_set("x")).cast("bigint").alias("n_distinct"), F.md5(F.col("x").cast("binary")).alias("normalized_md5"),
                    F.size("c").cast("bigint").alias("n_codes"), F.array_join("c", ",").alias("codes"))


VERBATIM_SQL = f"""WITH d AS (SELECT doc_id, {sqlx.normalize('text')} AS nd FROM documents),
i AS (SELECT item_id, {sqlx.normalize('text')} AS ni FROM benchmark),
p AS (SELECT item_id, doc_id, {sqlx.tokens('nd')} AS td, {sqlx.tokens('ni')} AS ti FROM d JOIN i ON contains(nd, ni) WHERE ni <> '')
SELECT item_id, doc_id, round({sqlx.jaccard('td', 'ti')}, 9) AS jaccard FROM p"""


@register("benchmark_in_documents", VERBATIM_SQL)
def q_benchmark_in_documents(spark, sf_dir):
    """M3 + M2: every benchmark text that a document reproduces verbatim, with the token overlap of the two."""
    return r9(verbatim.verbatim_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


TURNS_SQL = """SELECT a.conv_id, a.turn, coalesce(a.text, '') AS user_content, coalesce(b.text, '') AS assistant_content
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'"""


@register("conversation_records", TURNS_SQL)
def q_conversation_records(spark, sf_dir):
    """Chat records (a user turn and the assistant's answer) of all logged conversations."""
    return datasets.turn_pairs(table(spark, sf_dir, "conversations"))


LABEL_AUC_SQL = f"""WITH n AS (SELECT doc_id, {sqlx.normalize('text')} AS x FROM documents),
s AS (SELECT doc_id, round(len({sqlx.tokens('x')}) / len(string_split(x, ' '))::DOUBLE, 12) AS s FROM n),
y AS (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM labels),
r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS r
      FROM y JOIN s USING (doc_id) WHERE y IS NOT NULL),
g AS (SELECT label, sum(r) FILTER (WHERE y = 1) AS rp, count_if(y = 1) AS p, count_if(y = 0) AS n FROM r GROUP BY label)
SELECT label, round(CASE WHEN p > 0 AND n > 0 THEN (rp - p * (p + 1) / 2.0) / (p * n) END, 9) AS auc FROM g"""


@register("label_auc", LABEL_AUC_SQL)
def q_label_auc(spark, sf_dir):
    """A24 + W1: how well the share of distinct tokens in a document tells each of its labels, as AUC."""
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("x"))
    share = n.select("doc_id", F.round(F.size(T.token_set("x")) / F.size(F.split("x", " ")), 12).alias("share"))
    y = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in ("quality", "toxic")])).alias("l")).select("doc_id", "l.*")
    scored = share.join(y.filter(F.col("y").isNotNull()), "doc_id")
    return r9(metrics.membership_auc(scored, "label", F.col("y") == 1, "share"))
