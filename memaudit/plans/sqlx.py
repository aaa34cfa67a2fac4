"""DuckDB SQL snippets for the oracle queries (independent re-statements of the
cell semantics; string templates only)."""

from __future__ import annotations


EMPTY = "''"
WS = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name + '"'


def strip(x: str) -> str:
    # Python str.strip(): RE2 \s is ASCII, so the Unicode white space is listed explicitly
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def num(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN regexp_full_match({s}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
            f"THEN TRY_CAST({s} AS DOUBLE) END)")


def bool01(x: str) -> str:
    n = num(x)
    return (f"(CASE WHEN {x} IS NULL THEN 0 WHEN {n} IS NOT NULL THEN CASE WHEN {n} = 1.0 THEN 1 ELSE 0 END "
            f"WHEN lower({strip(x)}) IN ('1', 'yes', 'y', 'true') THEN 1 ELSE 0 END)")


def int_list(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN {x} IS NULL OR {s} = '' THEN []::BIGINT[] "
            f"WHEN {num(x)} IS NOT NULL THEN [CAST(trunc({num(x)}) AS BIGINT)] "
            f"ELSE list_transform(regexp_extract_all({s}, '\\d+'), lambda d: CAST(d AS BIGINT)) END)")


def case_map(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def dedupe_ordered(lst: str) -> str:
    """Order-preserving distinct (first occurrence wins)."""
    return (f"list_transform(list_filter(list_zip({lst}, generate_series(1, len({lst}))), "
            f"lambda p: list_position({lst}, p[1]) = p[2]), lambda p: p[1])")


def map_multi(x: str, mapping: dict) -> str:
    labels = f"list_transform({int_list(x)}, lambda c: {case_map('c', mapping, chr(39) + 'Unknown(' + chr(39) + ' || c || ' + chr(39) + ')' + chr(39))})"
    return dedupe_ordered(labels)


def known_labels(xs: list[str], mapping: dict) -> str:
    codes = " || ".join(int_list(x) for x in xs) if len(xs) > 1 else int_list(xs[0])
    labels = f"list_filter(list_transform({codes}, lambda c: {case_map('c', mapping, 'NULL')}), lambda v: v IS NOT NULL)"
    return dedupe_ordered(labels)


def clean_free_text(x: str) -> str:
    t = strip(x)
    t1 = f"regexp_replace({t}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', '[DATE]', 'g')"
    t2 = f"regexp_replace({t1}, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}\\b', '[DATE]', 'g')"
    t3 = f"regexp_replace({t2}, '\\b\\d{{7,}}\\b', '[ID]', 'g')"
    t4 = f"regexp_replace({t3}, '\\s+', ' ', 'g')"
    return (f"(CASE WHEN {x} IS NULL OR {t} = '' THEN '' "
            f"WHEN lower({t}) IN ('0', '0.0', 'none', 'n/a', 'na', 'nan') THEN '' ELSE {t4} END)")


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} IN ('', 'nan', 'NaN'))"


def r9(x: str) -> str:
    return f"round({x}, 9)"


# ------------------------------------------------------------------ text-match snippets
def normalize(x: str) -> str:
    """Lower, drop non-word/non-space (Unicode letters/digits/_ kept), collapse spaces."""
    y = f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return strip(f"regexp_replace({y}, '\\s+', ' ', 'g')")


def tokens(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({n}, ' ')) END)"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return (f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 "
            f"THEN 0.0::DOUBLE ELSE {inter} / ({union})::DOUBLE END)")


def concepts(x: str, vocab_list) -> str:
    parts = ", ".join(f"CASE WHEN contains(lower(coalesce({x}, '')), {q(c.lower())}) THEN {q(c)} END" for c in vocab_list)
    return f"list_filter([{parts}], lambda v: v IS NOT NULL)"


def field_value(block: str, label: str, default: str) -> str:
    pat = q(label + ":\\s*(.+)")
    return (f"(CASE WHEN regexp_matches(coalesce({block}, ''), {pat}) "
            f"THEN {strip(f'regexp_extract(coalesce({block}, {EMPTY}), {pat}, 1)')} "
            f"ELSE {q(default)} END)")


def gene_target(block: str) -> str:
    v1 = f"lower({field_value(block, 'Pathogenic variant', 'None identified')})"
    v2 = f"lower({field_value(block, 'VUS', 'None identified')})"
    return (f"(CASE WHEN {v1} NOT IN ('none identified', 'present') THEN {v1} "
            f"WHEN {v2} NOT IN ('none identified', 'present') THEN {v2} END)")


def size_value(block: str, label: str) -> str:
    pat = q(label + ":\\s*([\\d\\.]+)\\s*mm")
    return (f"(CASE WHEN regexp_matches(coalesce({block}, ''), {pat}) "
            f"THEN {strip(f'regexp_extract(coalesce({block}, {EMPTY}), {pat}, 1)')} ELSE '' END)")


def gen_lower(g: str) -> str:
    return f"lower({strip(f'coalesce({g}, {EMPTY})')})"


def code_set(raw: str, upper: bool = False) -> str:
    case = "upper" if upper else "lower"
    s = f"coalesce(CAST({raw} AS VARCHAR), '')"
    items = f"list_transform(string_split({s}, ','), lambda c: {case}({strip('c')}))"
    return (f"(CASE WHEN lower({strip(s)}) IN ('', 'none recorded', 'none') THEN []::VARCHAR[] "
            f"ELSE list_sort(list_distinct(list_filter({items}, lambda c: c <> ''))) END)")


def extract_codes(t: str) -> str:
    found = f"regexp_extract_all(coalesce({t}, ''), '\\b([A-Za-z]\\d{{2}}(?:\\.\\d{{1,4}})?)\\b', 1)"
    return f"list_distinct(list_transform({found}, lambda c: upper(c)))"


def code3(c: str) -> str:
    return f"upper(split_part({c}, '.', 1))"


def n_commas(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ',', '')))"


# ------------------------------------------------------------------ any language (RE2's \\b, \\d and \\s are ASCII)
def scrub(x: str) -> str:
    """P5 on text in any language: a tag's borders are the text's ends or characters that are not of words.

    A match takes the border characters along, so each tag is put twice: neighbours may share one."""
    out = strip(f"coalesce({x}, '')")
    for body, tag in (("\\p{Nd}{4}-\\p{Nd}{2}-\\p{Nd}{2}", "[DATE]"), ("\\p{Nd}{1,2}/\\p{Nd}{1,2}/\\p{Nd}{2,4}", "[DATE]"), ("\\p{Nd}{7,}", "[ID]")):
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){body}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{tag}\\2', 'g')"
    out = f"regexp_replace({out}, '[{WS}]+', ' ', 'g')"
    return f"(CASE WHEN lower({strip(f'coalesce({x}, {EMPTY})')}) IN ('', '0', '0.0', 'none', 'n/a', 'na', 'nan') THEN '' ELSE {out} END)"
