"""URL filters: host rules, then a blocked Bloom filter in front of an exact hash join; DataFrame functions only.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end. A
rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's; the longest wins.

URLs without a rule are judged by a list of canonical URLs. The list is hashed into blocks of 256 bits, one row a block:
four longs, two bits of each per URL, so a probe touches one row. Distinct canonical URLs that pass are joined exactly
with the list, which removes the false positives, and what is left is joined back. Sides are broadcast only where Spark
finds them small; otherwise a hot URL is split by the adaptive skew join.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is not listed: it is
allowed; repeated rows get equal verdicts; an empty list allows, an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memaudit.llm.common import fresh, quoted
from memaudit.session import materialize

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BITS_PER_URL, BLOCK_BITS = 16, 256
#: Query parameters that do not name another page (fixed values of trackers in use).
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|mc_cid|mc_eid)(=|$)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without port, ``www.`` or ``m.``, path without a final ``/`` or ``.html``, other than tracking parameters sorted; null without a host."""
    own_host = F.regexp_replace(F.regexp_replace(host(url), r":[0-9]*$", ""), r"^(www|m)\.", "")
    own_path = F.regexp_replace(path(url), r"(/|\.html?|/index\.html?)$", "")
    parts = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    parts = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(own_host != "", F.concat(own_host, own_path, F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise("")))


def best_rule(own_host: Column, own_path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((own_host == h) | own_host.endswith("." + h)) & own_path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _probe(url: Column, blocks: int) -> list[Column]:
    """The block of a URL and its two bits in each of the block's four longs."""
    where, bits = F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), F.xxhash64(url, F.lit("bits"))

    def bit(n: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * n).bitwiseAND(63).cast("int"))

    return [where] + [bit(2 * w).bitwiseOR(bit(2 * w + 1)).alias(f"w{w}") for w in range(4)]


def listed(urls: DataFrame, listing: DataFrame) -> DataFrame:
    """Those of the distinct canonical ``url`` that the distinct ``url`` of the listing holds."""
    blocks = max(1, listing.count() * BITS_PER_URL // BLOCK_BITS)
    words = [f"w{w}" for w in range(4)]
    bloom = listing.select(*_probe(F.col("url"), blocks)).groupBy("block").agg(*[F.bit_or(w).alias("b" + w) for w in words])
    passes = reduce(Column.__and__, [F.col("b" + w).bitwiseAND(F.col(w)) == F.col(w) for w in words])
    possible = urls.select("url", *_probe(F.col("url"), blocks)).join(bloom, "block").where(passes).select("url")
    return possible.join(listing, "url", "left_semi")


def judge(pages: DataFrame, listing: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (renamed where ``pages`` has such columns); ``listing``: distinct canonical ``url``."""
    own_host, own_path, rule, verdict, fit, canon, hit = fresh(pages, "host", "path", "rule", "verdict", "fit", "canonical_url", "listed_url")
    judged = pages.withColumn(own_host, host(quoted(url))).withColumn(own_path, path(quoted(url)))
    judged = judged.withColumn(fit, best_rule(F.col(own_host), F.col(own_path), rules))
    judged = judged.withColumn(canon, F.when(F.col(fit).isNull(), canonical(quoted(url))))
    asked = judged.where(F.col(canon).isNotNull()).select(F.col(canon).alias("url")).distinct()
    found = listed(asked, listing).select(F.col("url").alias(hit))
    # a row that is not asked about joins nothing; its key is its own hash, so that such rows do not meet in one task
    nothing = F.concat(F.lit("\x00"), F.xxhash64(*[quoted(c) for c in pages.columns]).cast("string"))
    judged = judged.withColumn(canon, F.coalesce(F.col(canon), nothing))
    out = judged.join(found, judged[canon] == found[hit], "left")
    return out.select(*[quoted(c) for c in pages.columns], F.col(own_host), F.col(own_path), F.col(fit)["rule"].alias(rule),
                      F.coalesce(F.col(fit)["verdict"], F.when(F.col(hit).isNotNull(), "block").otherwise("allow")).alias(verdict))


def listing_of_toxic_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The canonical URLs of pages whose number (the last digits of the path) is that of a document labelled toxic."""
    numbered = pages.select(canonical(F.col("url")).alias("url"), F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:/|\.html?)?$", 1).alias("n"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("n")).distinct()
    return materialize(numbered.where("url IS NOT NULL AND n <> ''").join(toxic, "n", "left_semi").select("url").distinct(), "listing")
