"""Cell parsing and scrub expressions (Column -> Column), all JVM-side.

Regexes carry ``(?U)`` so ``\\s \\w \\d \\b`` follow Unicode rules like Python's ``re``,
and ``(?d)`` where ``.`` must only stop at ``\\n``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from memaudit.functions import vocab

NUMERIC_LITERAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lit(mapping: dict) -> Column:
    """A literal map Column (folded by Catalyst)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


# Characters Python's str.isspace() accepts (Unicode White_Space plus the ASCII separators).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace (NBSP included) on both ends (btrim, no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def normalize_na(c, tokens=vocab.NA_TOKENS) -> Column:
    """Trap T2: exact NA tokens become NULL right after the scan."""
    c = col(c)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def is_blank(c) -> Column:
    """NULL, whitespace/NBSP only, or the strings nan/NaN."""
    s = py_strip(col(c).cast("string"))
    return col(c).isNull() | s.isin("", "nan", "NaN")


def parse_num(c) -> Column:
    """Numeric literal -> double; anything else NULL (T9: '45d' is not a number)."""
    s = py_strip(col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_LITERAL), s.try_cast("double"))


def to_int_list(c) -> Column:
    """NULL/blank -> []; numeric literal -> [trunc]; else every digit run.

    Codes are decimals of up to 38 digits, so an over-long run is a code like any other
    (it maps to ``Unknown(...)``) instead of ending the query with an overflow."""
    s = py_strip(col(c).cast("string"))
    num = parse_num(c)
    whole = F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num))  # truncates toward zero
    runs = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda d: d.try_cast("decimal(38,0)"))
    literal = F.when(F.abs(num) < 1e15, whole.cast("decimal(38,0)")).otherwise(num.try_cast("decimal(38,0)"))
    return (F.when(col(c).isNull() | (s == ""), F.array().cast("array<decimal(38,0)>"))
            .when(num.isNotNull(), F.array_compact(F.array(literal)))
            .otherwise(F.array_compact(runs)))


def bool01(c) -> Column:
    """1 iff numeric value == 1.0, or text in {1, yes, y, true}; NULL -> 0."""
    num = parse_num(c)
    txt = F.lower(py_strip(col(c).cast("string")))
    return (F.when(col(c).isNull(), 0)
            .when(num.isNotNull(), F.when(num == 1.0, 1).otherwise(0))
            .when(txt.isin(*vocab.TRUE_TOKENS), 1)
            .otherwise(0))


def age_bucket(age) -> Column:
    """Decade band ``40–49`` (EN DASH); Unknown when NULL. Truncates toward zero first."""
    a = col(age).cast("double")
    ai = a.cast("bigint")  # trunc toward zero
    lo = F.floor(ai / F.lit(10.0)).cast("bigint") * 10
    return F.when(a.isNull(), F.lit("Unknown")).otherwise(
        F.concat(lo.cast("string"), F.lit("–"), (lo + 9).cast("string")))


def diameter_bucket(mm) -> Column:
    """<50 mm / 50–59 mm / ≥60 mm / Unknown."""
    v = col(mm).cast("double")
    return (F.when(v.isNull(), "Unknown").when(v < 50, "<50 mm")
            .when(v < 60, "50–59 mm").otherwise("≥60 mm"))


def clean_free_text(c) -> Column:
    """P5: trim; blank tokens -> ''; ISO date / d/d/y -> [DATE]; >=7 digits -> [ID]; collapse spaces."""
    t = py_strip(col(c).cast("string"))
    t1 = F.regexp_replace(t, r"(?U)\b\d{4}-\d{2}-\d{2}\b", "[DATE]")
    t2 = F.regexp_replace(t1, r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]")
    t3 = F.regexp_replace(t2, r"(?U)\b\d{7,}\b", "[ID]")
    t4 = F.regexp_replace(t3, r"(?U)\s+", " ")
    return (F.when(col(c).isNull() | (t == ""), F.lit(""))
            .when(F.lower(t).isin(*vocab.BLANK_TEXT_TOKENS), F.lit(""))
            .otherwise(t4))


def map_multi(c, mapping: dict) -> Column:
    """Codes -> labels (``Unknown(c)`` if absent), order-preserving dedupe."""
    m = map_lit(mapping)
    labels = F.transform(to_int_list(c), lambda k: F.coalesce(
        F.try_element_at(m, k.try_cast("int")), F.concat(F.lit("Unknown("), k.cast("string"), F.lit(")"))))
    return F.array_distinct(labels)


def first_code_label(c, mapping: dict, unknown: str = "Unknown") -> Column:
    """Label of the first code; Unknown when unmapped; '' when there is no code."""
    codes = to_int_list(c)
    lab = F.coalesce(F.try_element_at(map_lit(mapping), F.get(codes, 0).try_cast("int")), F.lit(unknown))
    return F.when(F.size(codes) > 0, lab).otherwise(F.lit(""))


def known_labels(cols: list, mapping: dict) -> Column:
    """Concat code lists of several columns, keep mapped codes only, dedupe."""
    m = map_lit(mapping)
    codes = F.concat(*[to_int_list(x) for x in cols])
    return F.array_distinct(F.array_compact(F.transform(codes, lambda k: F.try_element_at(m, k.try_cast("int")))))


def flag_categories(prefix: str, rules=vocab.SURGERY_CATEGORIES, present: set | None = None) -> Column:
    """Ordered category labels whose flag column ``{prefix}{flag}`` is true."""
    parts = []
    for label, flag in rules:
        name = f"{prefix}{flag}"
        if present is not None and name not in present:
            continue
        parts.append(F.when(bool01(name) == 1, F.lit(label)))
    if not parts:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*parts)))


def coarsen_codes(codes) -> Column:
    """``X.y`` -> ``X``, else first 3 chars; order-preserving dedupe."""
    return F.array_distinct(F.transform(col(codes), lambda c: F.when(
        c.contains("."), F.split_part(c, F.lit("."), F.lit(1))).otherwise(F.substring(c, 1, 3))))


def comma_list(c) -> Column:
    """Split on commas, strip each item, drop empties (NULL -> [])."""
    items = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), ","), py_strip)
    return F.filter(items, lambda x: x != "")


def presence(c, present: str, absent: str) -> Column:
    """Presence coarsening."""
    return F.when(F.coalesce(col(c), F.lit("")) != "", F.lit(present)).otherwise(F.lit(absent))


def format_age(age, mode: str) -> Column:
    """Exact -> round(x, 2) printed like a Python float; other modes -> truncated int."""
    a = col(age).cast("double")
    if mode == "exact":
        return F.round(a, 2).cast("string")
    return a.cast("bigint").cast("string")


def format_diameter(x) -> Column:
    """``f"{x:.0f} mm"`` — half-to-even like Python; Unknown when NULL."""
    v = col(x).cast("double")
    return F.when(v.isNull(), F.lit("Unknown")).otherwise(
        F.concat(F.bround(v, 0).cast("bigint").cast("string"), F.lit(" mm")))


DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "yyyy-MM-dd HH:mm:ss"]


def parse_date_multi(c) -> Column:
    """First format that parses; two-digit years pivot at 69 like Python."""
    s = py_strip(col(c).cast("string"))
    # a cell is tried in the one format that its shape allows: a failed try costs far more than a pattern
    iso = F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))),
                     F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss"))))
    full = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(s, F.lit("M/d/yyyy")))
    short = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(s, F.lit("M/d/yy")))
    # Spark maps yy into 2000-2099 (and 1970-2069 is Python's window): shift >= 2069 back a century
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200).cast("timestamp")).otherwise(short)
    return F.coalesce(iso, full, short)


# The month names that a date cell may hold, by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?:^|[t\s]\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([ap]\.?m\.?)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
PIVOT = 69


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _clock(text: Column) -> Column:
    """struct(h, m, s, off) of a clock as ``_TIME`` finds it (minutes of the zone in off); NULL where there is none."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, _TIME, i), F.lit(""))

    hour, half, zone = part(1).cast("int"), F.substring(part(4), 1, 1), part(5)
    hour = F.when(half.isNotNull() & (hour.between(1, 12)), hour % 12 + F.when(half == "p", 12).otherwise(0)).when(half.isNull(), hour)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, r"\D", "")
    off = F.when(digits != "", sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))).otherwise(F.lit(0))
    return F.when(text != "", F.struct(hour.alias("h"), part(2).cast("int").alias("m"), F.coalesce(part(3), F.lit("0")).cast("int").alias("s"), F.coalesce(off, F.lit(0)).alias("off")))


def _day_tokens(text: Column) -> Column:
    """The tokens of a cell without its clock; NULL if it holds anything but numbers, month names, weekdays and separators."""
    day = F.regexp_replace(text, r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b\.?,?", " ")
    day = F.regexp_replace(day, r"\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    kept = F.lit(rf"^(?:\d+|{_MONTH})(?: (?:\d+|{_MONTH})){{0,2}}$")
    return _let(F.trim(F.regexp_replace(day, r"[\s,./-]+", " ")), lambda d: F.when(F.regexp_like(d, kept), F.split(d, " ")))


def _padded(tokens: Column) -> Column:
    return _let(tokens, lambda t: F.array(*[F.get(t, i) for i in range(3)]))


def _layout(t: Column) -> Column:
    """struct(y, m, d) as strings from one to three tokens (a four-digit year, or a number over 31, is the year); NULL if no
    layout fits. Without a year there is no date; without a day or month it is the first."""
    month = [F.regexp_like(t[i], F.lit("^[a-z]")) for i in range(3)]
    named = [F.when(month[i], F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(t[i], 1, 3)).cast("string")) for i in range(3)]
    number = [F.when(~month[i] & (F.length(t[i]) <= 8), t[i].cast("bigint")) for i in range(3)]
    year = [F.coalesce((F.length(t[i]) >= 3) | (number[i] > 31), F.lit(False)) & ~month[i] for i in range(3)]

    def ymd(y, m, d="1") -> Column:
        return F.struct((F.lit(y) if isinstance(y, str) else y).alias("y"), (F.lit(m) if isinstance(m, str) else m).alias("m"), (F.lit(d) if isinstance(d, str) else d).alias("d"))

    a, b, c = t[0], t[1], t[2]
    one = F.when(F.regexp_like(a, F.lit(r"^\d{8}$")), ymd(F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2))).when(F.regexp_like(a, F.lit(r"^\d{4}$")), ymd(a, "1"))
    two = (F.when(month[0] & year[1], ymd(b, named[0])).when(month[1] & year[0], ymd(a, named[1]))
           .when(~month[0] & ~month[1] & year[0], ymd(a, b)).when(~month[0] & ~month[1] & year[1], ymd(b, a)))
    three = (F.when(month[0], F.when(year[1], ymd(b, named[0], c)).otherwise(ymd(c, named[0], b)))
             .when(month[1], F.when(year[0], ymd(a, named[1], c)).otherwise(ymd(c, named[1], a)))
             .when(month[2], F.when(year[1], ymd(b, named[2], a)).otherwise(ymd(a, named[2], b)))
             .when(year[0], ymd(a, b, c)).when(number[0] > 12, ymd(c, b, a)).otherwise(ymd(c, a, b)))
    n = F.size(F.array_compact(t))
    return F.when(n == 1, one).when(n == 2, two).when(n == 3, three)


def parse_date_generic(c) -> Column:
    """P17's fallback: a cell as tokens (numbers, month names, separators, clock, zone) whose kinds decide the layout.

    Month before day where both could be (05.03.2010 is May 3rd), day first where the first number is over 12, year first where
    it has four digits; two-digit years pivot at 69 like the named formats; a clock with a zone is taken to UTC. Cells
    without a year, with a day that does not exist, or with other words are NULL."""
    s = F.lower(py_strip(col(c).cast("string")))
    cut = lambda x: F.struct(_clock(x["clock"]).alias("t"), _padded(_day_tokens(F.substring(x["s"], F.lit(1), F.length(x["s"]) - F.length(x["clock"])))).alias("tokens"))

    def moment(x: Column) -> Column:
        y, t = x["l"]["y"], x["t"]
        two = F.length(y) <= 2
        year = y.cast("bigint") + F.when(two, F.when(y.cast("bigint") >= PIVOT, 1900).otherwise(2000)).otherwise(0)
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), x["l"]["m"], x["l"]["d"])
        clock = F.concat_ws(":", *[F.coalesce(t[k], F.lit(0)).cast("string") for k in ("h", "m", "s")])
        at = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-M-d H:m:s"))
        at = F.when(t.isNull() | t["h"].isNotNull(), at)
        return F.when(x["l"]["m"].isNotNull() & x["l"]["d"].isNotNull() & (F.length(y) <= 4), F.timestamp_seconds(F.unix_timestamp(at) - F.coalesce(t["off"], F.lit(0)) * 60))

    whole = _let(F.struct(s.alias("s"), F.regexp_extract(s, _TIME, 0).alias("clock")), cut)
    return _let(_let(whole, lambda x: F.struct(x["t"].alias("t"), _layout(x["tokens"]).alias("l"))), moment)


def parse_date(c) -> Column:
    """P17 whole: the four named formats, then the generic parser."""
    return F.coalesce(parse_date_multi(c), parse_date_generic(c))


def age_at_event(birth, event) -> Column:
    """``int(days // 365.25)`` over whole elapsed days; NULL if a side is NULL or negative."""
    secs = F.unix_timestamp(col(event)) - F.unix_timestamp(col(birth))
    days = F.floor(secs / F.lit(86400.0))
    return F.when(days >= 0, F.floor(days / F.lit(365.25)).cast("int"))


def ordinal(n) -> Column:
    """P20: 1st / 2nd / 3rd / nth."""
    n = col(n) if not isinstance(n, int) else F.lit(n)
    return (F.when(n == 1, "1st").when(n == 2, "2nd").when(n == 3, "3rd")
            .otherwise(F.concat(n.cast("string"), F.lit("th"))))


def identifier_header(mrn="MRN", name="Name", dob="DOB", present: set | None = None) -> Column:
    """Identifier header lines put in front of a card (synthetic identifiers only)."""
    def v(c):
        if present is not None and c not in present:
            return F.lit("Unknown")
        return F.coalesce(F.nullif(py_strip(F.col(c).cast("string")), F.lit("")), F.lit("Unknown"))
    return F.concat_ws("\n", F.concat(F.lit("MRN: "), v(mrn)), F.concat(F.lit("Name: "), v(name)),
                       F.concat(F.lit("DOB: "), v(dob)))
