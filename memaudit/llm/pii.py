"""Personal data by weak supervision, with DataFrame functions only.

Candidates are spans of regular expressions: the four base kinds (email, ip, card, phone) and further kinds (phones without a
country code, social-security-like numbers, account numbers, credentials), and spans that a gazetteer proposes (a given name
or a title before a capitalised word, street words with a number) or that only context can decide (dates, which are personal if someone
was born on them). Labelers vote on each, or abstain where they know nothing: its *format* check, a *gazetteer* (top-level
domains, first octets, issuer prefixes, country codes, credential names, given names, years of life), *context* words around it,
its *borders*, and whether its digits or characters *vary*. They disagree on the spans that matter ("order 555-123-4567", "the John
Smith Foundation"). Expectation-maximisation estimates, from the counts of vote patterns over all
documents, how reliable each labeler is and how likely each kind is personal data; the posteriors train the final
classifier, a logistic regression on the votes of each kind. Counts, EM and training work on the table of vote patterns,
which is bounded by kinds times 3^labelers whatever the corpus; spans are found and scored by column expressions.

Base spans (leftmost, non-overlapping per kind, failing ones dropped without a retry) always stay. The method adds
candidates of the further kinds, and base matches that failed their check, whose probability is one half or more and
which overlap no span before them and no base span.

The patterns are written so that every text is scanned in time linear in its length (possessive runs that begin where a
run begins); each gives the leftmost matches of the plain form beside it. Offsets are code points, end exclusive.

Defined results: a null text is empty and has no span; repeated rows get equal results and vote once each; texts are
read whole and spans have no greatest length; without candidates nothing is fitted; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from memaudit.llm.common import quoted
from memaudit.session import materialize

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "national_id", "account", "local_phone", "birth_date", "name", "address"]


def _run(chars: str) -> str:
    """Where a run of these characters begins, or where the last match ended: no other place can begin a leftmost match."""
    return rf"(?:\G|(?<![{chars}]))"


_LOCAL = "A-Za-z0-9._%+-"
#: Gazetteers that propose spans.
GIVEN_NAMES = ("James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Peter|Paul|George|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Sarah|"
               "Karen|Emma|Anna|Laura|Julia|Alice|Jane|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Sabine|Monika|Ursula|Petra|Heike|Jean|Pierre|Jacques|Michel|Philippe|Marie|Nathalie|"
               "Isabelle|Sophie|Claire|Juan|José|Carlos|Luis|Miguel|Antonio|Pablo|María|Carmen|Lucía|Elena|Ana|Marco|Giulia")
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Blvd|Court|Square|Way"
_CAPITAL, _ALONE = r"\p{Lu}\p{Ll}++", r"(?![\p{L}\p{N}])"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": _run(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": _run("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": _run("0-9") + r"[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key) ?[=:] ?\"?[^\s\"]{6,}+\"?)",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{TITLES})\.? (?:{_CAPITAL} )?|(?:{GIVEN_NAMES}) )(?:\p{{Lu}}\. )?{_CAPITAL}(?:-{_CAPITAL})?{_ALONE}",
    "address": rf"(?<![\p{{L}}\p{{N}}])(?=[0-9\p{{Lu}}])(?:[0-9]{{1,5}}[A-Za-z]? (?:{_CAPITAL} ){{1,3}}(?:{STREETS})|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |le )*{_CAPITAL}"
               rf"|\p{{Lu}}\p{{Ll}}*(?:straße|strasse|weg|gasse|platz|allee) [0-9]{{1,4}}[a-z]?|(?:Calle|Avenida|Plaza) (?:de |del |la |las |los )*{_CAPITAL},? [0-9]{{1,4}}){_ALONE}",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "contains(t, '@')", "phone": "contains(t, '+')", "secret": "contains(t, '=') OR contains(t, ':') OR contains(t, 'AKIA') OR contains(t, 'gh')",
         "name": "t RLIKE '[A-Z]'"}
#: Fixed values of the gazetteers and context labelers.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|eu|us|uk|de|fr|es|it|nl|ch|at)$",
    "ip": r"^(?!0|127\.|22[4-9]|2[3-5][0-9])[0-9]",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(AKIA|gh[pousr]_|password|passwd|pwd|secret|api)",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^(DE|FR|ES|GB|IT|NL|BE|CH|AT|PT|IE|PL|LU)",
    "local_phone": r"^\(?[2-9]",
    "birth_date": r"^(19[0-9]{2}|20[01][0-9])-|[./-](19[0-9]{2}|20[01][0-9])$",
    "name": rf"(^| )({GIVEN_NAMES}) ",
    "address": r"[0-9]",
}
#: Words before a span that speak for its kind.
_CALL = "call|phone|tel|fax|mobile|cell|telefon|contact|ring|móvil|portable"
CONTEXT_YES = {"email": "mail|contact|write to|correo|kontakt|courriel", "ip": "host|server|address|login|ip", "card": "card|visa|credit|pay|karte|carte|tarjeta",
               "phone": _CALL, "local_phone": _CALL, "secret": "login|user|key|credential|access|aws", "national_id": "ssn|social|security|taxpayer",
               "account": "iban|account|konto|compte|cuenta|bank"}
CONTEXT_NO = r"(?i)(?<![a-z])(version|ver\.?|v|isbn|issn|order|invoice|page|line|build|release|rfc|no\.|part|serial|ticket|tracking|batch|item|sku|ref\.?|#)[\s:]*$"
BORN = r"(?i)(?<![\p{L}])(born|birth|birthday|birthdate|dob|geboren|geb\.|geburtsdatum|naissance|née?|nacid[oa]|nacimiento)(?![\p{L}])[^\n]{0,12}$"
NAMED = r"(?i)(?<![\p{L}])(name is|name|named|signed|contact|dear|patient|sincerely|by|from|name ist|heiße|appelle|llamo)[\s:,]{1,3}$"
NOT_NAMED = r"(?i)(?<![\p{L}])(the|saint|st\.|university|airport|museum)\s$"
NOT_A_NAME = r"^ (Street|University|Inc|Foundation|Prize|Airport|Hospital|School|Ltd|GmbH|Corporation|Award|Avenue|Library|Museum|Stadium)"
LIVES = r"(?i)(?<![\p{L}])(live[sd]? (at|in)|address|residing (at|in)|resides (at|in)|home|ship to|wohnt in|wohnhaft in|habite|vive en)[^\n]{0,12}$"
NOT_LIVED = r"(?i)(?<![\p{L}])(chapter|page|figure|table|exit)\s$"
#: A word before the weak credential name that makes it prose.
PROSE = r"(?i)(?<![\p{L}])(the|a|an|each|every|next|first|last)\s$"
LABELERS = ["format", "gazetteer", "context", "borders", "variety"]
#: Rates of yes-votes on false and on true candidates that the estimation starts from.
#: The candidates that each start counts as much as, and the part of a kind's candidates on which a labeler may vote otherwise, or abstain, and still says the same of all.
FIRM, DISSENT = 10, 0.01
TRUST = {"format": (0.2, 0.85), "gazetteer": (0.4, 0.7), "context": (0.05, 0.95), "borders": (0.3, 0.8), "variety": (0.45, 0.6)}

#: Matches of a text that are gone through in one run.
RUN = 256
_FOUND = "array<struct<kind:string,s:int,e:int,t:string,before:string,after:string>>"


def _spans(kind: str) -> tuple[str, str, str]:
    """SQL for the matches, for what lies between them, and for the spans made of both."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    need = NEEDS.get(kind, "t RLIKE '[0-9]'")
    matches = f"CASE WHEN {need} THEN regexp_extract_all(t, '{pattern}', 0) END AS m_{kind}"
    gaps = f"CASE WHEN size(m_{kind}) > 0 THEN transform(split(t, '{pattern}', -1), g -> named_struct('n', length(g), 'head', left(g, 16), 'tail', right(g, 32))) END AS g_{kind}"
    m, g = f"m_{kind}", f"g_{kind}"
    span = f"""named_struct('kind', '{kind}', 's', b.p + {g}[i].n, 'e', b.p + {g}[i].n + length({m}[i]), 't', {m}[i], 'before', {g}[i].tail, 'after', {g}[i + 1].head)"""
    # an array grows by copying, so the matches of a text are gone through in runs, and the runs joined at the end
    run = f"""aggregate(sequence(c * {RUN}, least(size({m}), (c + 1) * {RUN}) - 1), named_struct('p', a.p, 'out', cast(array() AS {_FOUND})),
        (b, i) -> named_struct('p', b.p + {g}[i].n + length({m}[i]), 'out', concat(b.out, array({span}))))"""
    spans = f"""CASE WHEN size({m}) > 0 THEN aggregate(sequence(0, (size({m}) - 1) DIV {RUN}), named_struct('p', 0, 'runs', cast(array() AS array<{_FOUND}>)),
        (a, n) -> transform(array(cast(n AS int)), c -> transform(array({run}), r -> named_struct('p', r.p, 'runs', concat(a.runs, array(r.out))))[0])[0], a -> flatten(a.runs)) ELSE cast(array() AS {_FOUND}) END"""
    return matches, gaps, spans


_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN (length(d) - i) % 2 = 0 THEN cast(substring(d, i, 1) AS int)
    ELSE 2 * cast(substring(d, i, 1) AS int) - if(substring(d, i, 1) >= '5', 9, 0) END) % 10 = 0"""


def _valid(kind: str) -> str:
    """SQL for whether the match ``x`` passes its check."""
    if kind == "ip":
        return "forall(split(x.t, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS int) <= 255, false))"
    if kind == "card":
        return f"exists(filter(array({_DIGITS}), d -> length(d) BETWEEN 12 AND 19), d -> {_LUHN})"
    if kind == "phone":
        return f"length({_DIGITS}) BETWEEN 9 AND 15"
    if kind == "account":
        return "length(regexp_replace(x.t, ' ', '')) BETWEEN 15 AND 34"
    if kind == "secret":
        return "if(x.t RLIKE '[0-9]' AND x.t RLIKE '[A-Za-z]', true, NULL)"
    if kind == "birth_date":
        day, month = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])"
        return f"if(x.t RLIKE '^({day}[./-]{month}|{month}[./-]{day}|[0-9]{{4}}-{month}-{day})($|[./-])', NULL, false)"
    if kind == "name":
        return f"if(x.t RLIKE '^({TITLES})[. ]', true, NULL)"
    return "true" if kind == "email" else "cast(NULL AS boolean)"  # the pattern is all there is to check


def _votes() -> str:
    """SQL for the votes on ``x``, in the labelers' order: 1, 0, or null for no vote."""
    case = lambda parts: "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in parts.items()) + " END"
    like = lambda what, p: f"x.{what} RLIKE '" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by_kind = {
        "birth_date": f"int({like('before', BORN)})",  # most dates are nobody's birthday, so no word is a vote too
        "name": f"CASE WHEN {like('before', NOT_NAMED)} OR {like('after', NOT_A_NAME)} THEN 0 WHEN {like('before', NAMED)} THEN 1 END",
        "address": f"CASE WHEN {like('before', NOT_LIVED)} THEN 0 WHEN {like('before', LIVES)} THEN 1 END",
    }
    for kind, words in CONTEXT_YES.items():  # "phone no." names a phone, "order no." does not
        named, near = rf"(?i)({words})[ .]*(no\.?|number|nr\.?|#)?[\s:]*$", rf"(?i)({words})[^\n]{{0,12}}$"
        by_kind[kind] = f"CASE WHEN {like('before', named)} THEN 1 WHEN {like('before', CONTEXT_NO)} THEN 0 WHEN {like('before', near)} THEN 1 END"
    weak = f"WHEN x.kind = 'secret' AND {like('t', '(?i)^token')} AND {like('before', PROSE)} THEN 0"
    context = "CASE " + weak + "".join(f" WHEN x.kind = '{k}' THEN {v}" for k, v in by_kind.items()) + " END"
    bounded = ", ".join(f"'{k}'" for k in KINDS if k not in (*BASE, "secret"))  # their patterns look at the borders themselves
    value = "regexp_replace(x.t, '^[A-Za-z_]+ ?[=:] ?', '')"
    return f"""array(int({case({k: _valid(k) for k in KINDS})}), int({case({k: f"if({like('t', p)}, true, NULL)" if k == "secret" else like('t', p) for k, p in GAZETTEER.items()})}), {context},
        CASE WHEN x.kind NOT IN ({bounded}) THEN int(NOT (x.before RLIKE '[A-Za-z0-9_]$' OR x.after RLIKE '^[A-Za-z0-9_]')) END,
        CASE WHEN x.kind = 'secret' THEN int(length({value}) >= 20 OR size(array_distinct(split({value}, ''))) >= 8) WHEN x.kind IN ('birth_date', 'name', 'address') OR length({_DIGITS}) < 6 THEN NULL
             ELSE int(size(array_distinct(split({_DIGITS}, ''))) > 3) END)"""


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``spans``: array of (kind, s, e, votes) in order of start, then kind as listed."""
    keep = docs.columns if keep is None else keep
    parts = {k: _spans(k) for k in KINDS}
    step = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(quoted(text).cast("string"), F.lit("")).alias("t"))
    ks = [f"k{i}" for i in range(len(keep))]
    step = step.selectExpr(*ks, "t", *[p[0] for p in parts.values()])
    step = step.selectExpr(*ks, *[f"m_{k}" for k in KINDS], *[p[1] for p in parts.values()])
    step = step.selectExpr(*ks, "concat(" + ", ".join(p[2] for p in parts.values()) + ") AS found")
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind)"
    step = step.selectExpr(*ks, f"""array_sort(transform(found, x -> named_struct('s', x.s, 'rank', int({rank}), 'e', x.e, 'kind', x.kind, 'votes', {_votes()}))) AS spans""")
    return step.select(*[F.col(k).alias(c) for k, c in zip(ks, keep)], "spans")


def fit_reliabilities(patterns: dict[tuple, float], rounds: int = 50) -> dict[tuple, float]:
    """The probability of each (kind, votes) pattern to be personal data, by expectation-maximisation.

    A labeler has, on each kind, one rate of yes-votes on true and one on false candidates; a kind has a share of true ones.
    Rates start from ``TRUST`` and carry pseudo-counts, so a labeler that seldom votes stays near its start. They are kept
    apart by kind, as the many plain numbers that look a little like cards say nothing about who reads names well."""
    out: dict[tuple, float] = {}
    for kind in sorted({k for k, _ in patterns}):
        own = {votes: c for (k, votes), c in patterns.items() if k == kind}
        yes, n = [list(TRUST[name]) for name in LABELERS], sum(own.values())
        weight = lambda j, v: math.log(yes[j][1] / yes[j][0]) if v else math.log((1 - yes[j][1]) / (1 - yes[j][0]))
        said = [[sum(c for v, c in own.items() if v[j] == x) for x in (0, 1)] for j in range(len(LABELERS))]
        agreed = [max(x) >= (1 - DISSENT) * n for x in said]
        # what a labeler says of all candidates alike can only tell how many of them are true
        start = 1 / (1 + math.exp(-sum(weight(j, v) * m / n for j, x in enumerate(said) if agreed[j] for v, m in enumerate(x))))
        share, posterior = start, {}
        for _ in range(rounds):
            for votes in own:
                odds = math.log(share / (1 - share)) + sum(weight(j, v) for j, v in enumerate(votes) if v is not None and not agreed[j])
                posterior[votes] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
            share = (sum(c * posterior[v] for v, c in own.items()) + FIRM * start) / (n + FIRM)
            for j, rates in enumerate(yes):
                if agreed[j]:
                    continue
                for y in (0, 1):
                    mass = [(c * (posterior[v] if y else 1 - posterior[v]), v[j]) for v, c in own.items() if v[j] is not None]
                    rates[y] = min(0.999, max(0.001, (sum(m for m, v in mass if v) + FIRM * TRUST[LABELERS[j]][y]) / (sum(m for m, _ in mass) + FIRM)))
                rates[1] = max(rates)  # a yes never speaks against
        out.update({(kind, votes): p for votes, p in posterior.items()})
    return out


def _features(votes: tuple) -> list[float]:
    return [1.0, *[0.0 if v is None else 2.0 * v - 1 for v in votes]]


def train_classifier(patterns: dict[tuple, float], posterior: dict[tuple, float], steps: int = 400) -> dict[str, list[float]]:
    """Logistic-regression weights (bias, votes) of each kind on the posteriors, by gradient descent with a small L2 penalty."""
    out = {}
    for kind in sorted({k for k, _ in patterns}):
        rows = [(_features(v), posterior[k, v], math.sqrt(c)) for (k, v), c in patterns.items() if k == kind]
        scale = sum(w for *_, w in rows)
        weights = [0.0] * (1 + len(LABELERS))
        for _ in range(steps):
            step = [0.001 * w for w in weights]
            for x, y, c in rows:
                error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x)))) - y
                for i, v in enumerate(x):
                    step[i] += c / scale * error * v
            weights = [w - s for w, s in zip(weights, step)]
        out[kind] = weights
    return out


def _score(weights: dict[str, list[float]]) -> str:
    """SQL for the log-odds of the span ``x``."""
    sums = {k: " + ".join([f"{w[0]!r}D"] + [f"coalesce(2 * x.votes[{j}] - 1, 0) * {v!r}D" for j, v in enumerate(w[1:])]) for k, w in weights.items()}
    return "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sums.items()) + " ELSE -1D END" if sums else "-1D"


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with ``base`` and ``added``: arrays of (kind, s, e) in order of start, then kind as listed."""
    keep = docs.columns if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    found = materialize(candidates(docs, text, keep).toDF(*names, "spans"), "candidates")
    counts = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes").count().collect()  # kinds times 3^labelers rows at most
    patterns = {(r["kind"], tuple(r["votes"])): float(r["count"]) for r in sorted(counts, key=str)}
    weights = train_classifier(patterns, fit_reliabilities(patterns))
    base_kinds = ", ".join(f"'{k}'" for k in BASE)
    parts = found.selectExpr(*names, f"filter(spans, x -> x.kind IN ({base_kinds}) AND x.votes[0] = 1) AS base",
                             f"filter(spans, x -> NOT (x.kind IN ({base_kinds}) AND x.votes[0] = 1) AND {_score(weights)} >= 0) AS more")
    parts = parts.selectExpr(*names, "base", "filter(more, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e)) AS more")
    added = """aggregate(more, cast(array() AS array<struct<s:int,rank:int,e:int,kind:string,votes:array<int>>>),
               (a, x) -> if(size(a) > 0 AND element_at(a, -1).e > x.s, a, concat(a, array(x)))) AS added"""
    parts = parts.selectExpr(*names, "base", added if patterns else "base AS added")
    out = [F.col(n).alias(c) for n, c in zip(names, keep)]
    return parts.select(*out, F.col("base").alias("base"), F.col("added").alias("added"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; a null text stays null."""
    found = detect(docs, text).withColumn("all", F.array_sort(F.concat("base", "added")))
    body = quoted(text).cast("string")
    pieces = F.aggregate("all", F.struct(F.lit(0).alias("p"), F.lit("").alias("out")), lambda a, x: F.struct(
        F.greatest(a["p"], x["e"]).alias("p"),
        F.concat(a["out"], F.when(x["s"] >= a["p"], F.concat(F.substring(body, a["p"] + 1, x["s"] - a["p"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")).alias("out")),
        lambda a: F.concat(a["out"], F.substring(body, a["p"] + 1, F.greatest(F.length(body) - a["p"], F.lit(0)))))
    return found.select(*[F.when(body.isNotNull(), pieces).alias(c) if c == text else quoted(c) for c in docs.columns])
