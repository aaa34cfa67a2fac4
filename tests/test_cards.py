from pyspark.sql import functions as F

from memaudit.operators import cards, records, verify

RAW = {
    "patient_id": "row_0", "Sex": "M", "age": "45.25", "fam_hx": "yes", "Pathogenic Gene": "FBN1",
    "VUS Gene": None, "Icd10 Codes": "I71.01, I71.2, E11", "Aneurysm_involvement": "1, 2",
    "Acute_aortic_syndrome": "0", "ER_presentation": "1", "Complicating_factor": "0",
    "Bicuspid_aortic_valve": "0", "first_reported_diameter": "44.5", "intervention_diameter": None,
    "pathology_v1": "1, 25", "pathology_v2": None, "surg_1_age": "50", "surg_1_aortic_valve_replacement": "1",
    "surg_1_type": "Bentall 2020-01-02", "surg_1_others": None, "underwent_reoperation": "0",
    "reoperation indication": None, "mortality": "0", "Causes_of_death": None,
}

FULL = """Patient Summary

Demographics:
- Sex: M
- Age at presentation: 45
- Family history of aortic disease: Yes

Genetics:
- Pathogenic variant: FBN1
- VUS: None identified

Clinical presentation:
- Aneurysm involvement: Root, Ascending
- Acute aortic syndrome: None recorded
- Initial ER presentation: Yes
- Complicating factors: None recorded

Surgical course:
- Number of aortic surgeries recorded: 1
- 1st surgery (age 50): Aortic valve replacement (type: Bentall [DATE]).

Reoperation:
- Underwent reoperation: No/Unknown

Aortic size:
- First reported diameter: 44 mm
- Diameter at intervention: Unknown

Histopathology:
- Findings: Medial degeneration

Valve anatomy:
- Bicuspid aortic valve: No/Unknown

Billing/Diagnoses:
- ICD-10 Codes: I71.01, I71.2, E11

Outcome:
- Vital status: Alive at last follow-up / not recorded as deceased"""


def _raw(spark, *rows):
    cols = list(rows[0])
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def _records(spark, raw=RAW):
    return records.conform(_raw(spark, raw))


def test_full_card_text(spark):
    c = {r["mode"]: r["text"] for r in cards.cards(_records(spark)).collect()}
    assert c["full"] == FULL


def test_other_modes(spark):
    c = {r["mode"]: r["text"] for r in cards.cards(_records(spark)).collect()}
    co = c["coarsened"]
    assert "- Age at presentation: 40–49" in co and "- Pathogenic variant: Present" in co
    assert "1st surgery (age 50–59): Valve intervention (type: Bentall [DATE])." in co
    assert "- ICD-10 Codes: I71, E11" in co and "- First reported diameter: <50 mm" in co
    assert "FBN1" not in co
    assert "Aortic size:" not in c["partial"] and "Initial ER presentation" not in c["partial"]
    assert "- Age at presentation: 45.25" in c["exact"] and "(age 50.0)" in c["exact"]


def test_sections(spark):
    df = spark.createDataFrame([(FULL,)], "text string")
    r = df.select(cards.section("text", "Genetics").alias("g"), cards.section("text", "Nope").alias("n")).first()
    assert r["g"] == "Genetics:\n- Pathogenic variant: FBN1\n- VUS: None identified" and r["n"] == ""


def test_fidelity_zero_then_detects_corruption(spark):
    rec, raw = _records(spark), _raw(spark, RAW)
    full = cards.card(rec, "full")
    assert verify.mismatches(raw, full).count() == 0
    bad = full.withColumn("text", F.regexp_replace("text", "- Sex: M", "- Sex: F"))
    m = verify.mismatches(raw, bad).collect()
    assert [(r["field"], r["expected"], r["actual"]) for r in m] == [("Sex", "M", "F")]


ODD = [
    {"age": "\xa045 ", "Complicating_factor": "2.0", "surg_1_age": "NA", "surg_2_type": "nan", "mortality": " YES "},
    {"age": "45d", "Complicating_factor": "3, 3; 0 and 07", "Bicuspid_aortic_valve": "1e0", "reoperation indication": "seen 2020-01-02,\u2003id 12345678 x9999999", "underwent_reoperation": "y"},
    {"age": "-3.7", "Complicating_factor": "none", "reoperation indication": "N/A", "underwent_reoperation": "1.0", "Sex": " "},
    {"age": "1e2", "Complicating_factor": "-1", "surg_2_age": "x", "surg_3_TEVAR": "true", "reoperation indication": " None ", "VUS Gene": "\u2028"},
    {"age": ".5", "Complicating_factor": "0", "surg_1_type": "\xa0", "surg_1_aortic_valve_replacement": "0", "Pathogenic Gene": " TGFBR2\t"},
    {"age": "Infinity", "Complicating_factor": None, "Bicuspid_aortic_valve": "2", "mortality": "0x1", "Sex": None, "surg_1_age": "1"},
]


def test_second_derivation_agrees_with_the_parsers_on_odd_cells(spark):
    rows = [dict.fromkeys([*RAW, "surg_2_age", "surg_2_type", "surg_3_TEVAR"]) | odd | {"patient_id": f"p{i}"} for i, odd in enumerate(ODD)]
    raw = _raw(spark, *rows)
    assert verify.mismatches(raw, cards.card(records.conform(raw), "full")).collect() == []
    got = {r["patient_id"]: r.asDict() for r in verify.expected_fields(raw).collect()}
    assert [got[f"p{i}"]["Age"] for i in range(6)] == ["45", "Unknown", "-3", "100", "0", "Unknown"]
    assert got["p1"]["Complicating factors"] == "Malperfusion (e.g., MI, stroke, paraplegia, abdominal pain, AKI, absent/unequal pulses), Unknown(7)"
    assert got["p1"]["Reoperation Indication"] == "seen [DATE], id [ID] x9999999" and got["p2"]["Reoperation Indication"] == "Not recorded"
    assert got["p3"]["Number of surgeries"] == "2" and got["p3"]["Underwent reoperation"] == "Yes" and got["p5"]["Vital status"].startswith("Alive")


def test_fidelity_on_empty_tables_missing_cards_and_clashing_columns(spark):
    raw, full = _raw(spark, RAW, RAW | {"patient_id": "row_1"}), cards.card(_records(spark), "full")
    assert verify.mismatches(raw.limit(0), full.limit(0)).collect() == []
    assert [tuple(r) for r in verify.mismatches(raw, full).collect()] == [("row_1", "Row", "record", "missing card")]
    clash = raw.withColumn("text", F.lit("x")).withColumn("Age ", F.lit("9")).withColumn("expected", F.lit("x"))
    assert verify.mismatches(clash, full).count() == 1
    blank = full.withColumn("text", F.lit(None).cast("string"))
    assert {r["actual"] for r in verify.mismatches(raw.limit(1), blank).collect()} == {"Not found"}


def test_a_section_is_found_by_position(spark):
    from memaudit.functions import cells
    texts = ["Title\n\nGenetics:\n- a\n\nAortic size:\n- b", "Genetics:", "x Genetics: y\n\n\nGenetics: z", "genetics:\n- a", "", None, "Genetics:\n \n- a\n", "Genetics:\r\n\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = cells.py_strip(F.regexp_extract("t", r"(?s)(Genetics:.*?)(?=\n\n|\z)", 1))
    got = df.select(cards.section("t", "Genetics").alias("now"), old.alias("was"))
    assert all(r["now"] == r["was"] for r in got.collect())
    assert "regexp" not in got.select("now")._jdf.queryExecution().optimizedPlan().toString().lower()
