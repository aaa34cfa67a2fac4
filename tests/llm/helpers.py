"""Small tables and plain-Python versions that the operators are held against."""

import hashlib
import re
from collections import Counter

import xxhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOC):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, width=4):
    w = words(lower(text))
    grams = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(fps, max_bits=4):
    """The least position that each position reaches over pairs of at most max_bits differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items, window=10):
    """(n_words, n_hit, items, digest) of a text against {item_id: text}."""
    w, hit, found = tokens(text), set(), set()
    for item, body in items:
        t = tokens(body)
        for at in range(max(1, len(t) - window + 1) if t else 0):
            part = t[at:at + window]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def mix_targets(sizes):
    """{source: target} by rounds of sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in cut]
        share = (total - sum(3 * sizes[s] for s in cut)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if share * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in cut else share * weight[s] for s in order}
        cut |= more


def source_sizes(rows):
    total = Counter()
    for _, text, source in rows:
        total[source] += len(words(text))
    return total
