"""Card queries on the record stand-in (R1-R8, P1-P16, P21, A32, K1 shape)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memaudit.functions import cells, vocab
from memaudit.operators import cards, verify
from memaudit.plans import sqlx
from memaudit.plans.cohort import SLOTS, cohort_sql, raw_cohort
from memaudit.plans.q_rarity import profile_sql, typed_records
from memaudit.plans.registry import register
from memaudit.plans.tables import table

NL = "chr(10)"


# ------------------------------------------------------------------ oracle: typed records
def _strip_or_null(col: str) -> str:
    c = sqlx.ident(col)
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE {sqlx.strip(c)} END"


def _first_code_label(col: str, mapping: dict) -> str:
    codes = sqlx.int_list(sqlx.ident(col))
    return (f"CASE WHEN len({codes}) > 0 THEN coalesce({sqlx.case_map(f'({codes})[1]', mapping, 'NULL')}, 'Unknown') "
            f"ELSE '' END")


def _comma_list(col: str) -> str:
    c = sqlx.ident(col)
    return (f"list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: {sqlx.strip('x')}), "
            f"lambda x: x <> '')")


def typed_sql() -> str:
    """profile CTEs + ``typed``: the parsed record table."""
    return profile_sql() + typed_cte()


def typed_cte() -> str:
    """``typed``: the parsed record table (needs the profile CTEs before it)."""
    slots = []
    for n in SLOTS:
        slots.append(f"""present{n}, {sqlx.num(sqlx.ident(f'surg_{n}_age'))} AS sage{n}, cats{n},
      {sqlx.clean_free_text(sqlx.ident(f'surg_{n}_type'))} AS stype{n},
      {sqlx.clean_free_text(sqlx.ident(f'surg_{n}_others'))} AS sother{n}""")
    return f""",
typed AS (
  SELECT s.patient_id,
      {_strip_or_null('Sex')} AS sex,
      {sqlx.num('age')} AS age,
      {sqlx.bool01('fam_hx')} AS fam_hx,
      {_strip_or_null('Pathogenic Gene')} AS pathogenic_gene,
      {_strip_or_null('VUS Gene')} AS vus_gene,
      {sqlx.map_multi(sqlx.ident('Aneurysm_involvement'), vocab.ANEURYSM_INVOLVEMENT)} AS aneurysm,
      {sqlx.map_multi(sqlx.ident('Acute_aortic_syndrome'), vocab.ACUTE_AORTIC_SYNDROME)} AS aas,
      {sqlx.bool01('ER_presentation')} AS er,
      {sqlx.map_multi(sqlx.ident('Complicating_factor'), vocab.COMPLICATING_FACTORS)} AS complicating,
      {sqlx.bool01('Bicuspid_aortic_valve')} AS bav,
      {sqlx.num('first_reported_diameter')} AS first_diameter,
      {sqlx.num('intervention_diameter')} AS interv_diameter,
      {sqlx.known_labels(['pathology_v1', 'pathology_v2'], vocab.PATHOLOGY)} AS pathology,
      {','.join(slots)},
      {sqlx.bool01('underwent_reoperation')} AS reop_flag,
      {sqlx.clean_free_text(sqlx.ident('reoperation indication'))} AS reop_indication,
      {sqlx.bool01('mortality')} AS mortality,
      {_first_code_label('Causes_of_death', vocab.CAUSE_OF_DEATH)} AS cause_of_death,
      {_comma_list('Icd10 Codes')} AS icd10,
      {_strip_or_null('Icd10 Codes')} AS icd10_raw,
      p.n_surg, p.reop
  FROM slots s JOIN (SELECT patient_id AS pid, n_surg, reop FROM prof) p ON s.patient_id = p.pid
)"""


# ------------------------------------------------------------------ oracle: card text
def _fmt_age(x: str, mode: str) -> str:
    if mode == "exact":
        return f"CAST(round({x}, 2) AS VARCHAR)"
    return f"CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR)"


def _age_bucket(x: str) -> str:
    lo = f"CAST(floor(CAST(trunc({x}) AS BIGINT) / 10.0) * 10 AS BIGINT)"
    return f"(CASE WHEN {x} IS NULL THEN 'Unknown' ELSE CAST({lo} AS VARCHAR) || '–' || CAST({lo} + 9 AS VARCHAR) END)"


def _diam_bucket(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} < 50 THEN '<50 mm' WHEN {x} < 60 THEN '50–59 mm' "
            f"ELSE '≥60 mm' END)")


def _fmt_diam(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'Unknown' ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) || ' mm' END)"


def _yes_no(x: str, yes="Yes", no="No/Unknown") -> str:
    return f"(CASE WHEN {x} = 1 THEN {sqlx.q(yes)} ELSE {sqlx.q(no)} END)"


def _surgery_line(n: int, mode: str) -> str:
    age = f"sage{n}"
    age_str = f"(CASE WHEN {age} IS NULL THEN 'age unknown' ELSE 'age ' || {_fmt_age(age, 'exact' if mode == 'exact' else 'full')} END)"
    core = f"(CASE WHEN len(cats{n}) > 0 THEN array_to_string(cats{n}, ', ') ELSE 'Aortic surgery (type unspecified)' END)"
    extras = (f"concat_ws('; ', CASE WHEN stype{n} <> '' THEN 'type: ' || stype{n} END, "
              f"CASE WHEN sother{n} <> '' THEN 'other: ' || sother{n} END)")
    extra_str = f"(CASE WHEN {extras} <> '' THEN ' (' || {extras} || ')' ELSE '' END)"
    ordn = {1: "1st", 2: "2nd", 3: "3rd"}[n]
    text = f"'{ordn} surgery (' || {age_str} || '): ' || {core} || {extra_str} || '.'"
    if mode == "coarsened":
        bucket = _age_bucket(f"CAST(trunc({age}) AS DOUBLE)")
        text = f"regexp_replace({text}, '\\(age [^)]+\\)', '(age ' || {bucket} || ')', 'g')"
        text = f"replace(replace({text}, 'Aortic valve repair', 'Valve intervention'), 'Aortic valve replacement', 'Valve intervention')"
    return f"CASE WHEN present{n} THEN {text} END"


def card_sql(mode: str) -> str:
    lines = lambda *xs: f"concat_ws({NL}, {', '.join(xs)})"
    if mode == "coarsened":
        age = _age_bucket("CAST(trunc(age) AS DOUBLE)")
    else:
        age = f"coalesce({_fmt_age('age', mode)}, 'Unknown')"
    demo = lines("'Demographics:'", "'- Sex: ' || coalesce(sex, 'Unknown')", f"'- Age at presentation: ' || {age}",
                 f"'- Family history of aortic disease: ' || {_yes_no('fam_hx')}")
    pg, vg = "coalesce(pathogenic_gene, '')", "coalesce(vus_gene, '')"
    if mode == "coarsened":
        p = f"CASE WHEN {pg} <> '' THEN 'Present' ELSE 'None identified' END"
        v = f"CASE WHEN {vg} <> '' THEN 'Present' ELSE 'None identified' END"
    else:
        p = f"CASE WHEN {pg} <> '' THEN {pg} ELSE 'None identified' END"
        v = f"CASE WHEN {vg} <> '' THEN {vg} ELSE 'None identified' END"
    gen = lines("'Genetics:'", f"'- Pathogenic variant: ' || {p}", f"'- VUS: ' || {v}")
    aneurysm = ("CASE WHEN len(aneurysm) > 0 THEN '- Aneurysm involvement: ' || array_to_string(aneurysm, ', ') "
                "ELSE '- Aneurysm involvement: Unknown/Not recorded' END")
    aas = ("CASE WHEN len(list_filter(aas, lambda a: NOT contains(a, 'None'))) > 0 THEN '- Acute aortic syndrome: ' || "
           "array_to_string(list_transform(list_filter(aas, lambda a: a <> 'None'), "
           "lambda a: replace(a, 'Acute aortic syndrome: ', '')), ', ') ELSE '- Acute aortic syndrome: None recorded' END")
    clin = ["'Clinical presentation:'", aneurysm, aas]
    if mode != "partial":
        cc = "list_filter(complicating, lambda c: c <> 'None')"
        shown = "'- Complicating factors: Present'" if mode == "coarsened" else \
            f"'- Complicating factors: ' || array_to_string({cc}, ', ')"
        clin += [f"'- Initial ER presentation: ' || {_yes_no('er')}",
                 f"CASE WHEN len({cc}) > 0 THEN {shown} ELSE '- Complicating factors: None recorded' END"]
    clin_s = lines(*clin)
    slines = "list_filter([" + ", ".join(_surgery_line(n, mode) for n in SLOTS) + "], lambda x: x IS NOT NULL)"
    body = (f"CASE WHEN len({slines}) > 0 THEN array_to_string(list_transform({slines}, lambda x: '- ' || x), {NL}) "
            f"ELSE '- No aortic surgery details recorded.' END")
    surg = lines("'Surgical course:'", "'- Number of aortic surgeries recorded: ' || CAST(n_surg AS VARCHAR)", body)
    secs = ["'Patient Summary'", demo, gen, clin_s, surg]
    if mode != "partial":
        shown = "'- Indication: Progressive or residual aortic disease / other (coarsened)'" if mode == "coarsened" \
            else "'- Indication: ' || reop_indication"
        yes = lines("'- Underwent reoperation: Yes'",
                    f"CASE WHEN reop_indication <> '' THEN {shown} ELSE '- Indication: Not recorded' END")
        secs.append(lines("'Reoperation:'", f"CASE WHEN reop = 1 THEN {yes} ELSE '- Underwent reoperation: No/Unknown' END"))
        fmt = _diam_bucket if mode == "coarsened" else _fmt_diam
        secs.append(lines("'Aortic size:'", f"'- First reported diameter: ' || {fmt('first_diameter')}",
                          f"'- Diameter at intervention: ' || {fmt('interv_diameter')}"))
        shown = "'- Pathology reported: Yes (coarsened)'" if mode == "coarsened" else \
            "'- Findings: ' || array_to_string(pathology, ', ')"
        secs.append(lines("'Histopathology:'", f"CASE WHEN len(pathology) > 0 THEN {shown} ELSE '- Not recorded' END"))
        v = _yes_no("bav", "Present", "Not recorded/absent") if mode == "coarsened" else _yes_no("bav")
        secs.append(lines("'Valve anatomy:'", f"'- Bicuspid aortic valve: ' || {v}"))
        codes = "icd10"
        if mode == "coarsened":
            codes = sqlx.dedupe_ordered("list_transform(icd10, lambda c: CASE WHEN contains(c, '.') "
                                        "THEN split_part(c, '.', 1) ELSE substr(c, 1, 3) END)")
        secs.append(lines("'Billing/Diagnoses:'", f"CASE WHEN len({codes}) > 0 THEN '- ICD-10 Codes: ' || "
                          f"array_to_string({codes}, ', ') ELSE '- ICD-10 Codes: None recorded' END"))
    dead = lines("'- Vital status: Deceased'",
                 "'- Cause of death category: ' || CASE WHEN cause_of_death <> '' THEN cause_of_death ELSE 'Unknown' END")
    secs.append(lines("'Outcome:'", f"CASE WHEN mortality = 1 THEN {dead} ELSE "
                      "'- Vital status: Alive at last follow-up / not recorded as deceased' END"))
    return sqlx.strip(f"concat_ws({NL} || {NL}, {', '.join(secs)})")


def cards_sql_cte(modes=cards.MODES) -> str:
    """typed CTEs + ``cards(patient_id, mode, text, ...meta)``."""
    return typed_sql() + cards_cte(modes)


def cards_cte(modes=cards.MODES, name: str = "cards") -> str:
    parts = [f"SELECT patient_id, '{m}' AS mode, {card_sql(m)} AS text, sex, pathogenic_gene, vus_gene, "
             f"reop_flag AS underwent_reoperation, mortality, icd10_raw AS icd10_codes FROM typed" for m in modes]
    return f",\n{name} AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"


# ------------------------------------------------------------------ queries
def all_cards(spark, sf_dir, modes=cards.MODES):
    return cards.cards(typed_records(spark, sf_dir), modes)


CARDS_SQL = cards_sql_cte() + "\nSELECT * FROM cards"


@register("cards", CARDS_SQL)
def q_cards(spark, sf_dir):
    """R1-R6 + P21: four disclosure levels per record with flattened meta."""
    c = all_cards(spark, sf_dir)
    return c.select(F.col("meta.patient_id").alias("patient_id"), "mode", "text", "meta.sex", "meta.pathogenic_gene",
                    "meta.vus_gene", "meta.underwent_reoperation", "meta.mortality", "meta.icd10_codes")


SECTIONS = ["Demographics", "Genetics", "Clinical presentation", "Surgical course", "Reoperation", "Aortic size", "Histopathology",
            "Valve anatomy", "Billing/Diagnoses", "Outcome"]


def _section_sql(text: str, name: str) -> str:
    # RE2 has no look-ahead: cut at the first blank line after the header instead
    start = f"instr({text}, {sqlx.q(name + ':')})"
    return (f"CASE WHEN {start} > 0 THEN {sqlx.strip(f'split_part(substr({text}, {start}), {NL} || {NL}, 1)')} "
            f"ELSE '' END")


SECTIONS_SQL = cards_sql_cte() + "\nSELECT patient_id, mode, " + ", ".join(
    f"{_section_sql('text', s)} AS {s.split('/')[0].replace(' ', '_').lower()}" for s in SECTIONS) + " FROM cards"


@register("card_sections", SECTIONS_SQL)
def q_card_sections(spark, sf_dir):
    """Every section of the rendered cards of all four modes."""
    c = all_cards(spark, sf_dir)
    return c.select(F.col("meta.patient_id").alias("patient_id"), "mode",
                    *[cards.section("text", s).alias(s.split("/")[0].replace(" ", "_").lower()) for s in SECTIONS])


def _verify_sql() -> str:
    def actual(label, digits=False):
        pat = "- " + label + (": (\\d+)" if digits else ": (.*)")
        return (f"CASE WHEN regexp_matches(c.text, {sqlx.q(pat)}) THEN "
                f"{sqlx.strip(f'regexp_extract(c.text, {sqlx.q(pat)}, 1)')} ELSE 'Not found' END")
    comp = "list_filter(t.complicating, lambda x: x <> 'None')"
    exp = {
        "Sex": "coalesce(t.sex, 'Unknown')",
        "Age": "coalesce(CAST(CAST(trunc(t.age) AS BIGINT) AS VARCHAR), 'Unknown')",
        "Vital status": "CASE WHEN t.mortality = 1 THEN 'Deceased' ELSE 'Alive at last follow-up / not recorded as deceased' END",
        "BAV": "CASE WHEN t.bav = 1 THEN 'Yes' ELSE 'No/Unknown' END",
        "Pathogenic Variant": "CASE WHEN coalesce(t.pathogenic_gene, '') <> '' THEN t.pathogenic_gene ELSE 'None identified' END",
        "VUS": "CASE WHEN coalesce(t.vus_gene, '') <> '' THEN t.vus_gene ELSE 'None identified' END",
        "Complicating factors": f"CASE WHEN len({comp}) > 0 THEN array_to_string({comp}, ', ') ELSE 'None recorded' END",
        "Number of surgeries": "CAST(t.n_surg AS VARCHAR)",
        "Underwent reoperation": "CASE WHEN t.reop = 1 THEN 'Yes' ELSE 'No/Unknown' END",
        "Reoperation Indication": "CASE WHEN t.reop = 1 THEN CASE WHEN t.reop_indication <> '' THEN t.reop_indication ELSE 'Not recorded' END END",
    }
    parts = [f"SELECT {sqlx.q(name)} AS field, {exp[name]} AS expected, {actual(label, name == 'Number of surgeries')} AS actual "
             f"FROM typed t JOIN cards c ON t.patient_id = c.patient_id" for name, label in verify.FIELDS]
    return (cards_sql_cte(("full",)) + ",\nchecks AS (\n" + "\nUNION ALL\n".join(parts) + "\n)\n"
            "SELECT field, count(*) AS n_checked, count_if(expected <> actual) AS n_mismatch "
            "FROM checks WHERE expected IS NOT NULL GROUP BY field")


VERIFY_SQL = _verify_sql()


@register("card_fidelity", VERIFY_SQL)
def q_card_fidelity(spark, sf_dir):
    """Derive 10 fields a second time from the raw rows and compare with the rendered full cards."""
    return verify.fidelity_summary(raw_cohort(spark, sf_dir), cards.card(typed_records(spark, sf_dir), "full"))


FAULTS_SQL = "WITH " + cohort_sql() + """,
k AS (SELECT *, CAST(substr(patient_id, 5) AS BIGINT) AS k, "surg_1_age" IS NOT NULL AS s1, "surg_2_age" IS NOT NULL AS s2, "surg_3_age" IS NOT NULL AS s3 FROM raw_cohort),
r AS (SELECT *, CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) AS n_surg FROM k)
SELECT patient_id, 'Age' AS field, CAST(CAST(trunc(CAST(age AS DOUBLE)) AS BIGINT) AS VARCHAR) AS expected,
       CAST(CAST(trunc(CAST(age AS DOUBLE)) AS BIGINT) + 1 AS VARCHAR) AS actual FROM r WHERE k % 13 = 0
UNION ALL
SELECT patient_id, 'BAV', CASE WHEN "Bicuspid_aortic_valve" = 'TRUE' THEN 'Yes' ELSE 'No/Unknown' END,
       CASE WHEN "Bicuspid_aortic_valve" = 'TRUE' THEN 'No/Unknown' ELSE 'Yes' END FROM r WHERE k % 17 = 0
UNION ALL
SELECT patient_id, 'Complicating factors', CASE "Complicating_factor" WHEN '7' THEN 'Unknown(7)'
       ELSE 'Cardiac tamponade, Malperfusion (e.g., MI, stroke, paraplegia, abdominal pain, AKI, absent/unequal pulses)' END, 'None recorded'
FROM r WHERE k % 19 = 0 AND "Complicating_factor" <> '0'
UNION ALL
SELECT patient_id, 'Reoperation Indication', regexp_replace("reoperation indication", '[0-9]{7,}', '[ID]'), "reoperation indication"
FROM r WHERE k % 23 = 0 AND "reoperation indication" IS NOT NULL AND ("underwent_reoperation" = 'true' OR n_surg >= 2)
UNION ALL
SELECT patient_id, 'Number of surgeries', CAST(n_surg AS VARCHAR), CAST(n_surg + 1 AS VARCHAR) FROM r WHERE k % 29 = 0"""


@register("parser_faults", FAULTS_SQL)
def q_parser_faults(spark, sf_dir):
    """The check against records that a faulty parser has typed: ages a year too high (numbers divisible by 13), valve flags
    turned (17), codes lost (19), indications left unscrubbed (23), a surgery too many (29). The raw rows show exactly these."""
    k = F.substring("patient_id", 5, 1 << 20).cast("bigint")
    raw = raw_cohort(spark, sf_dir)
    unscrubbed = raw.select("patient_id", F.col("reoperation indication").alias("as_written"))
    wrong = (typed_records(spark, sf_dir).join(unscrubbed, "patient_id")
             .withColumn("age", F.when(k % 13 == 0, F.col("age") + 1).otherwise(F.col("age")))
             .withColumn("bav", F.when(k % 17 == 0, 1 - F.col("bav")).otherwise(F.col("bav")))
             .withColumn("complicating", F.when(k % 19 == 0, F.array(F.lit("None"))).otherwise(F.col("complicating")))
             .withColumn("reop_indication", F.when(k % 23 == 0, F.coalesce("as_written", F.lit(""))).otherwise(F.col("reop_indication")))
             .withColumn("n_surg", F.when(k % 29 == 0, F.col("n_surg") + 1).otherwise(F.col("n_surg"))))
    return verify.mismatches(raw, cards.card(wrong, "full"))


DRIFT_SQL = "WITH " + cohort_sql() + """,
k AS (SELECT patient_id, "Sex" AS sex, CAST(substr(patient_id, 5) AS BIGINT) AS k FROM raw_cohort)
SELECT patient_id, 'Row' AS field, 'record' AS expected, 'missing card' AS actual FROM k WHERE k % 11 = 0
UNION ALL
SELECT patient_id, 'Row', 'missing record', 'record' FROM (SELECT 'card_' || k AS patient_id FROM k WHERE k % 11 = 0)
UNION ALL
SELECT patient_id, 'Sex', coalesce(sex, 'Unknown'), 'drifted' FROM k WHERE k % 11 <> 0 AND k % 7 = 0"""


@register("mismatch_preview", f"SELECT * FROM ({DRIFT_SQL}) ORDER BY patient_id, field LIMIT 20")
def q_mismatch_preview(spark, sf_dir):
    """The first twenty mismatches by id and field — a top-k, not a sample."""
    return q_card_mismatches(spark, sf_dir).orderBy("patient_id", "field").limit(20)


@register("card_mismatches", DRIFT_SQL)
def q_card_mismatches(spark, sf_dir):
    """A32 + J10: the check against cards that have drifted from their records. Of the full cards, those whose number is
    divisible by 11 carry another id, and those divisible by 7 another sex; exactly these are found, joined on the id."""
    rec = typed_records(spark, sf_dir)
    k = F.substring("patient_id", 5, 1 << 20).cast("bigint")
    drifted = cards.card(rec, "full").select(
        F.when(k % 11 == 0, F.concat(F.lit("card_"), k.cast("string"))).otherwise(F.col("patient_id")).alias("patient_id"),
        F.when(k % 7 == 0, F.regexp_replace("text", "- Sex: [^\\n]*", "- Sex: drifted")).otherwise(F.col("text")).alias("text"))
    return verify.mismatches(raw_cohort(spark, sf_dir), drifted)


PREVIEW_SQL = cards_sql_cte(("full",)) + """
SELECT patient_id, text FROM cards ORDER BY patient_id LIMIT 5"""


@register("card_preview", PREVIEW_SQL)
def q_card_preview(spark, sf_dir):
    """The first five full cards by id (string order) — a top-k, not a sample."""
    return cards.card(typed_records(spark, sf_dir).orderBy("patient_id").limit(5), "full").orderBy("patient_id")


HEADER_SQL = "WITH " + cohort_sql() + """,
ids AS (SELECT 'row_' || CAST(c_custkey AS VARCHAR) AS patient_id, CAST(c_custkey AS VARCHAR) AS mrn, c_name AS name
        FROM customer)
SELECT r.patient_id, 'MRN: ' || coalesce(nullif(trim(i.mrn), ''), 'Unknown') || chr(10) ||
       'Name: ' || coalesce(nullif(trim(i.name), ''), 'Unknown') || chr(10) || 'DOB: Unknown' AS header
FROM raw_cohort r JOIN ids i ON i.patient_id = r.patient_id"""


@register("identifier_header", HEADER_SQL)
def q_identifier_header(spark, sf_dir):
    """Identifier header (MRN / Name / DOB, 'Unknown' when absent) for each record —
    synthetic identifiers from the customer table, never written to a dump file."""
    ids = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("row_"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.col("c_custkey").cast("string").alias("MRN"), F.col("c_name").alias("Name"))
    raw = raw_cohort(spark, sf_dir).select("patient_id").join(ids, "patient_id")
    return raw.select("patient_id", cells.identifier_header(present={"MRN", "Name"}).alias("header"))
