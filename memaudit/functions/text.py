"""Text-match scoring kernel (M1-M20) as Column expressions.

Python's ``re`` on str is Unicode-aware; Java regex is not unless ``(?U)``. ``(?d)``
makes ``.`` stop only at ``\\n`` like Python. What varies by row (a gene name) is found by its
position; patterns are constants, compiled once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from memaudit.functions import vocab
from memaudit.functions.cells import col, py_strip

PY = "(?dU)"  # Python-like: Unicode classes, only \n ends a line


def normalize(t) -> Column:
    """M1: lower -> drop non-word/non-space (Unicode) -> collapse whitespace; NULL -> ''."""
    x = F.lower(F.coalesce(col(t), F.lit("")))
    x = F.regexp_replace(x, PY + r"[^\w\s]+", "")
    x = F.regexp_replace(x, PY + r"\s+", " ")
    return py_strip(x)


def token_set(norm) -> Column:
    """Distinct whitespace tokens of a normalised text ('' -> [])."""
    n = col(norm)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " ")))


def jaccard(tokens_a, tokens_b) -> Column:
    """M2: |A∩B|/|A∪B|; both empty -> 1.0, one empty -> 0.0."""
    a, b = col(tokens_a), col(tokens_b)
    return jaccard_of_sizes(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def jaccard_of_sizes(a, b, both) -> Column:
    """M2 from the sizes of two sets and of their intersection."""
    a, b, both = col(a), col(b), col(both)
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both.cast("double") / (a + b - both))


def collapse_hit(norm_gen, norm_expected, empty_is_hit: bool = True) -> Column:
    """M3: normalised truth is a substring of the normalised generation."""
    hit = col(norm_gen).contains(col(norm_expected))
    return hit if empty_is_hit else hit & (col(norm_expected) != "")


def concept_set(t, concepts=vocab.SURGERY_CONCEPTS_12, lowered: bool = False) -> Column:
    """M4: concepts (fixed vocabulary order) whose lower-case form occurs in the text.

    Pass an already lower-cased column with ``lowered=True`` so the text is not
    lower-cased once per phrase."""
    low = F.coalesce(col(t), F.lit("")) if lowered else F.lower(F.coalesce(col(t), F.lit("")))
    hits = [F.when(low.contains(c.lower()), F.lit(c)) for c in concepts]
    return F.array_compact(F.array(*hits))


def _field_value(block, label: str, default: str) -> Column:
    pat = PY + re.escape(label) + r":\s*(.+)"
    b = F.coalesce(col(block), F.lit(""))
    return F.when(b.rlike(pat), py_strip(F.regexp_extract(b, pat, 1))).otherwise(F.lit(default))


def gene_target(block, skips=("none identified", "present")) -> Column:
    """M7: pathogenic gene unless generic, else VUS gene, else NULL (lower-cased)."""
    v1 = F.lower(_field_value(block, "Pathogenic variant", "None identified"))
    v2 = F.lower(_field_value(block, "VUS", "None identified"))
    return F.when(~v1.isin(*skips), v1).when(~v2.isin(*skips), v2)


def gene_target_typed(block) -> Column:
    """M7 (summary variant): struct(gene, type) with the wider skip list; NULL gene when none."""
    skips = ("none identified", "present", "none", "")
    v1 = F.lower(_field_value(block, "Pathogenic variant", "None identified"))
    v2 = F.lower(_field_value(block, "VUS", "None identified"))
    return F.struct(F.when(~v1.isin(*skips), v1).when(~v2.isin(*skips), v2).alias("gene"),
                    F.when(~v1.isin(*skips), F.lit("pathogenic")).when(~v2.isin(*skips), F.lit("vus")).alias("type"))


def size_values(block) -> Column:
    """M8: struct(v1, v2) — the two ``([\\d.]+)\\s*mm`` captures ('' when absent)."""
    b = F.coalesce(col(block), F.lit(""))

    def grab(label):
        pat = PY + re.escape(label) + r":\s*([\d\.]+)\s*mm"
        return F.when(b.rlike(pat), py_strip(F.regexp_extract(b, pat, 1))).otherwise(F.lit(""))
    return F.struct(grab("First reported diameter").alias("v1"), grab("Diameter at intervention").alias("v2"))


def size_targets(values) -> Column:
    """M12 targets: non-empty values (not 'Unknown'), in order."""
    v = col(values)
    return F.array_compact(F.array(*[F.when((v[k] != "") & (v[k] != "Unknown"), v[k]) for k in ("v1", "v2")]))


def gen_lower(g) -> Column:
    return F.lower(py_strip(F.coalesce(col(g), F.lit(""))))


def gene_loose(gen_l, target) -> Column:
    """M9: target is a substring of the lower-cased generation (empty target never hits)."""
    t = col(target)
    return F.coalesce(t.isNotNull() & (t != "") & col(gen_l).contains(t), F.lit(False))


def _ctx(g: Column, start0: Column, end0: Column) -> Column:
    """Python slice g[max(0,start0):end0] on code points."""
    s = F.greatest(start0, F.lit(0))
    return F.substring(g, (s + 1).cast("int"), F.greatest(end0 - s, F.lit(0)).cast("int"))


def _n_commas(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))


def _lists_genes(ctx: Column, commas: int) -> Column:
    """Whether a context reads like an enumeration of genes rather than a statement about one."""
    return (_n_commas(ctx) >= commas) | ctx.contains("such as") | ctx.contains("include")


# The labels that a gene must stand beside, in the wording of the audited scorers.
GENE_LABELS = "pathogenic variant|vus|variant|mutation"
GENE_WORDS = "pathogenic|vus|variant|mutation"
CANARY_LABELS = "pathogenic variant|vus|pathogenic|variant"
CANARY_WORDS = "pathogenic|vus|variant"
#: How far a label may stand from the gene (a fixed value), and the letters of the longest single-word label.
REACH, LABEL_LETTERS = 30, len("pathogenic")


def _names_itself(target: Column) -> Column:
    """Whether a string can overlap its own next occurrence (an end of it is its beginning)."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.length(target) - 1, F.lit(1))),
                    lambda k: (k < F.length(target)) & (F.substring(target, F.lit(1), k) == F.right(target, k)))


def occurrences(g: Column, target: Column) -> Column:
    """Positions (from 1) of all occurrences of a non-empty string in a text, overlapping ones included.

    The target is looked up as it is written, so it needs no pattern and no escaping. It has at most as many occurrences
    as the text shrinks by when they are cut out; one that can overlap itself, as many as its first character."""
    first = F.substring(target, F.lit(1), F.lit(1))

    def cut(x: Column) -> Column:
        return F.length(g) - F.length(F.replace(g, x, F.lit("")))

    most = F.when(_names_itself(target), cut(first)).otherwise(F.floor(cut(target) / F.length(target))).cast("int")
    none = F.array().cast("array<int>")
    after = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + 1

    def step(acc: Column, _: Column) -> Column:
        at = F.array(F.call_function("locate", target, g, after(acc)))
        return F.concat(acc, F.filter(at, lambda p: p > 0))

    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), none, step)).otherwise(none)


def _is_word(c: Column) -> Column:
    return F.regexp_like(c, F.lit(PY + r"\w"))


def _before(g: Column, at: Column) -> Column:
    return F.substring(g, F.lit(1), at - 1)


def _after(g: Column, at: Column, target: Column, size: int) -> Column:
    return F.substring(g, at + F.length(target), F.lit(size))


def gene_guarded(gen_l, target) -> Column:
    """The gene stands beside a label, and the +-50 characters around its first occurrence have fewer than 3 commas
    and no 'such as' / 'include'.

    Every occurrence is found by its position and its surroundings are read with constant patterns: the label right before it, a
    label up to 30 characters of the same line before it, or after it; a word must end with the gene. The gene is taken as
    written. A scorer that puts it into a pattern unescaped agrees wherever the gene has no pattern characters; with such
    characters it would match other strings or fail, which is not reproduced."""
    g, t = col(gen_l), col(target)
    near = PY + rf"(?:{GENE_WORDS}).{{1,{REACH}}}\z"
    beside = PY + rf"(?:{GENE_LABELS})[:\-\s]+(?:potential\s+)?\z"
    behind = PY + rf"^.{{1,{REACH}}}(?:{GENE_WORDS})"

    def stated(at: Column) -> Column:
        rest = _after(g, at, t, REACH + LABEL_LETTERS)
        ends = _is_word(F.right(t, F.lit(1))) != F.coalesce(_is_word(F.substring(rest, 1, 1)), F.lit(False))
        line = _ctx(g, at - 1 - REACH - LABEL_LETTERS, at - 1)
        return ends & (F.regexp_like(line, F.lit(near)) | F.regexp_like(rest, F.lit(behind)) | F.regexp_like(_before(g, at), F.lit(beside)))

    first = F.call_function("locate", t, g) - 1
    ctx = _ctx(g, first - 50, F.least(F.length(g), first + 50))
    there = t.isNotNull() & (t != "") & g.contains(t)
    return F.coalesce(F.when(there, ~_lists_genes(ctx, 3) & F.exists(occurrences(g, t), stated)), F.lit(False))


def gene_canary(gen_l, gene) -> Column:
    """A label right before the gene, or a label up to 30 characters after it; for either form the first such place, with
    50 characters on both sides, must have fewer than 4 commas and no 'such as' / 'include'.

    Positions and constant patterns as in ``gene_guarded``; of the places that begin with one label, the last is taken, as a
    pattern reads as many separators as it can."""
    g, t = col(gen_l), F.lower(col(gene))
    beside = PY + rf"(?:{CANARY_LABELS})[:\-\s]+(?:potential\s+)?\z"
    behind = PY + rf"^.{{1,{REACH}}}(?:{CANARY_WORDS})"

    def span(start, end) -> Column:
        return F.struct(start.cast("int").alias("start"), (-end).cast("int").alias("less"))

    def labelled(at: Column) -> Column:
        start = F.regexp_instr(_before(g, at), F.lit(beside))
        return F.when(start > 0, span(start, at + F.length(t) - 1))

    def followed(at: Column) -> Column:
        rest = _after(g, at, t, REACH + LABEL_LETTERS)
        size = F.length(F.regexp_extract(rest, behind, 0))
        return F.when(size > 0, span(at, at + F.length(t) - 1 + size))

    def stated(place) -> Column:
        first = F.array_compact(F.array(F.array_min(F.transform(occurrences(g, t), place))))  # none or one, bound to a name
        return F.exists(first, lambda m: ~_lists_genes(_ctx(g, m["start"] - 51, -m["less"] + 50), 4))

    return F.coalesce(F.when((t != "") & g.contains(t), stated(labelled) | stated(followed)), F.lit(False))


def without_buckets(gen_l) -> Column:
    """The text without the coarsening bucket strings."""
    x = col(gen_l)
    for s in vocab.SIZE_BUCKET_STRINGS:
        x = F.replace(x, F.lit(s), F.lit(""))
    return x


def size_loose(gen_l, targets) -> Column:
    """Strip coarsening bucket strings, then any target is a bare substring."""
    return any_of(without_buckets(gen_l), targets)


def any_of(text, targets) -> Column:
    """Whether any of the strings is a substring of the text."""
    x = col(text)
    return F.exists(col(targets), lambda t: x.contains(t))


def size_strict(gen_l, values) -> Column:
    """Anchored ``first reported diameter: V`` / ``diameter at intervention: V``.

    A missing side is vacuously true; needs at least one real side. No ``mm`` suffix,
    so ``45`` also hits ``450`` (prefix match, as in the audited scorer)."""
    g, v = col(gen_l), col(values)

    return says_sizes(g, said_sizes(v))


def said_sizes(values) -> Column:
    """M13 targets: struct(first, interv) of what a generation must say of either diameter, NULL where there is none."""
    v = col(values)

    def said(label: str, x: Column) -> Column:
        clean = py_strip(F.replace(F.lower(x), F.lit("mm"), F.lit("")))
        return F.when((clean != "") & (clean != "unknown"), F.concat(F.lit(label + ": "), clean))
    return F.struct(said("first reported diameter", v["v1"]).alias("first"), said("diameter at intervention", v["v2"]).alias("interv"))


def says_sizes(gen_l, said) -> Column:
    """M13 from its targets (``said_sizes``), which are made once per record and not once per generation."""
    g, s = col(gen_l), col(said)
    m1, m2 = (F.coalesce(g.contains(s[k]), s[k].isNull()) for k in ("first", "interv"))
    return (s["first"].isNotNull() | s["interv"].isNotNull()) & m1 & m2


def size_canary(gen_l, first_mm, interv_mm) -> Column:
    """struct(first, interv, both, any) with the `` mm`` suffix anchored."""
    g = col(gen_l)
    f = g.contains(F.concat(F.lit("first reported diameter: "), col(first_mm), F.lit(" mm")))
    i = g.contains(F.concat(F.lit("diameter at intervention: "), col(interv_mm), F.lit(" mm")))
    return F.struct(f.alias("first"), i.alias("interv"), (f & i).alias("both"), (f | i).alias("any"))


def code_set(raw, lower: bool = True) -> Column:
    """Comma list -> sorted distinct set (strip, drop empty; none tokens -> [])."""
    s = F.coalesce(col(raw).cast("string"), F.lit(""))
    norm = F.lower(py_strip(s))
    items = F.transform(F.split(s, ","), lambda c: F.lower(py_strip(c)) if lower else F.upper(py_strip(c)))
    codes = F.array_sort(F.array_distinct(F.filter(items, lambda c: c != "")))
    return F.when(norm.isin("", "none recorded", "none"), F.array().cast("array<string>")).otherwise(codes)


def code_line_set(gen_l) -> Column:
    """M16 helper: set parsed from the first ``icd-?10 codes?:\\s*(.+)`` line; NULL if absent."""
    pat = PY + r"icd-?10 codes?:\s*(.+)"
    g = col(gen_l)
    return F.when(g.rlike(pat), code_set(F.regexp_extract(g, pat, 1)))


def exact_code_match(gen_l, gt_set) -> Column:
    """Generated code line set equals the ground-truth set."""
    s = code_line_set(gen_l)
    return F.coalesce(s.isNotNull() & (F.size(col(gt_set)) > 0) & (s == col(gt_set)), F.lit(False))


CODE_PATTERN = r"(?U)\b([A-Za-z]\d{2}(?:\.\d{1,4})?)\b"


def extract_codes(t) -> Column:
    """Code-shaped tokens in free text, upper-cased, distinct."""
    found = F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit(CODE_PATTERN), 1)
    return F.array_distinct(F.transform(found, lambda c: F.upper(c)))


def code3(c) -> Column:
    """3-character category (text before the first dot), upper-cased."""
    return F.upper(F.split_part(col(c), F.lit("."), F.lit(1)))


def is_plain_category(c) -> Column:
    """Whether a category is a letter A to Z and two of the digits 0 to 9."""
    return F.regexp_like(col(c), F.lit(r"\A[A-Z][0-9]{2}\z"))


def category_number(c) -> Column:
    """A plain category as a number of two bytes."""
    return ((F.ascii(col(c)) - 65) * 100 + F.substring(col(c), 2, 2).cast("int")).cast("smallint")


def prefix_match(gt_codes, gen_codes) -> Column:
    """struct(recall, precision, f1, matched) at 3-char level; matched counts GT codes,
    so precision can exceed 1 when several GT codes share a category."""
    gt, gen = col(gt_codes), col(gen_codes)

    def scores(matched: Column) -> Column:
        m = F.size(matched).cast("double")
        recall = F.when(F.size(gt) > 0, m / F.size(gt)).otherwise(F.lit(0.0))
        precision = F.when(F.size(gen) > 0, m / F.size(gen)).otherwise(F.lit(0.0))
        f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
        return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), matched.alias("matched"))

    # one-element arrays bind the categories and the matches to names: each is made once a row, not once a code
    categories = F.array(F.array_distinct(F.transform(gen, code3)))
    matched = F.transform(categories, lambda gen3: F.filter(gt, lambda c: F.array_contains(gen3, code3(c))))
    return F.transform(matched, scores)[0]


def display_text(gen, limit: int = 800) -> Column:
    """A generation cut to ``limit`` chars with a marker; newlines -> <br>; NULL -> ''."""
    g = F.coalesce(col(gen), F.lit(""))
    cut = F.when(F.length(g) > limit, F.concat(F.substring(g, 1, limit), F.lit("... [TRUNCATED DUE TO LENGTH]"))).otherwise(g)
    return F.replace(cut, F.lit("\n"), F.lit("<br>"))


def display_generation(gens, pred, limit: int = 800) -> Column:
    """M20 on an array: its first generation satisfying ``pred``, else its first."""
    g = col(gens)
    return display_text(F.coalesce(F.get(F.filter(g, pred), 0), F.get(g, 0)), limit)
