import pytest
from pyspark.sql import functions as F

from tamarack.operators import documents, prose
from tamarack.operators.prose import Field, FieldPattern, ParagraphReader

READER = ParagraphReader([Field("GLU"), Field("UA", aliases=("uric acid",)), Field("seen", "date")])


@pytest.mark.parametrize(
    ("text", "value", "confidence"),
    [
        ("GLU for patient 12345 was 98.5.", "98.5", "high"),
        ("GLU in 2003 was 98.5", "98.5", "high"),
        ("GLU was 1999 in that unit", "1999", "high"),
        ("GLU, which the second nurse of the ward read from the sheet twice, was 7", "7", "medium"),
        ("GLU was not available. Priority 3-MEDIUM.", None, None),
        ("GLU was -5.5mg/dL on the 4th day", "-5.5", "high"),
        ("no label 5", None, None),
        ("a data void around GLU 5", None, None),
    ],
)
def test_numbers(text, value, confidence):
    got = READER.number(text, "GLU")
    assert (got.value, got.confidence) == (value, confidence) if value else got is None


def test_nearest_number_wins_and_others_are_alternatives():
    v = READER.number("GLU, by the first tube, was 9.5. GLU 8.5 later.", "GLU")
    assert (v.value, v.alternatives) == ("8.5", ("9.5",))


@pytest.mark.parametrize(
    "text",
    [
        "GLU was initially logged as 3 and later corrected to 4.5",
        "GLU 3 mg/dL, but was subsequently amended to 4.5",
        "GLU adjusted from 3 to 4.5 mg/dL",
        "GLU: suggested 3, but manual verification confirmed 4.5",
        "GLU was originally noted as 3; conclusive reading established 4.5",
    ],
)
def test_corrections(text):
    assert READER.corrected(text, "GLU").value == "4.5"
    assert READER.corrected(text.replace("GLU", "UA 1. GLU"), "UA") is None  # cut at the next field


def test_missing_and_panels():
    assert READER.missing("UA was not recorded that day", "UA") and not READER.missing("UA was 5", "UA")
    assert [(v.field, v.value) for v in READER.missing_panel("The full panel (GLU, uric acid) was unavailable.")] == [("GLU", None), ("UA", None)]
    assert {(v.field, v.confidence) for v in READER.missing_panel("The entire renal panel was marked as not available (NaN).")} == {("GLU", "medium"), ("UA", "medium")}
    assert [v.field for v in READER.missing_panel("data voids for the renal panel (UA)")] == ["UA"]


def test_dates_persons_states():
    assert prose.dates("on 2004-03-05, March 5, 2004; the tenth of May, 1990 and 3rd June 2001; 31 February 2004") == ["2004-03-05", "1990-05-10", "2001-06-03"]
    got = {v.field: v.value for v in READER.person("Identified as female. Diagnosis: SLE. Date of birth is May 1, 1950.")}
    assert got == {"Sex": "F", "Diagnosis": "SLE", "Birthday": "1950-05-01"}
    assert READER.state("GLU was elevated.", "GLU") == "abnormal" and READER.state("a stable UA", "UA") == "normal" and READER.state("GLU 5", "GLU") is None
    assert READER.field_named("Uric-Acid") is None and READER.field_named("uric acid") == "UA" and READER.field_named("glu value") == "GLU"


def test_paragraphs_of_every_kind(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "short"), (1, 3, "Patient 1234567: UA was unavailable. GLU was 5. Seen May 1, 2001."), (2, 0, "x " * 50_000 + "GLU was 6."), (2, 0, "x " * 50_000 + "GLU was 6.")]
    got = prose.read_paragraphs(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, place int, text string, value string"), [Field("GLU"), Field("UA"), Field("seen", "date")])
    assert sorted((r["doc_id"], r["record"], r["field"], r["value"]) for r in got.collect()) == sorted([(1, "1234567", "GLU", "5"), (1, "1234567", "UA", None), (1, "1234567", "seen", "2001-05-01"), (2, "", "GLU", "6"), (2, "", "GLU", "6")], key=str)
    assert prose.read_paragraphs(spark.createDataFrame([], "doc_id long, place int, text string"), []).count() == 0


def test_pipeline(spark):
    text = "Intro 99999 and 88888 with GLU was 1.\n\n## Data\n\nEntry 1234567: GLU was 5.5 of 2.\n\nEntry 1234567: GLU was initially 6 and corrected to 7.\n\nEntry 7654321: GLU was 9 of 3 tubes.\n\n## Prose\n\nNothing is said here about values.\n\nNor is here, to be sure of that."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    records, flags = prose.documents_to_records(docs)
    assert {(r["record"], r["value"]) for r in records.where("field = 'GLU'").collect()} == {("1234567", "5.5"), ("7654321", "9")}
    assert flags.count() == 0
    units = documents.extraction_units(prose.data_paragraphs(docs), 15).orderBy("unit").collect()
    assert [(u["section_heading"], u["token_estimate"]) for u in units] == [("Data", 8), ("Data", 13), ("Data", 9)]


def test_patterns_links_and_first_values(spark):
    rows = [(1, 0, "recABCDEFGH1 costs <5>, see recABCDEFGH2"), (2, 0, "recABCDEFGH1 costs <6>, amended to <7>, see recZZZZZZZZ9"), (3, 0, "recABCDEFGH2 is free"), (4, 0, None), (5, 0, "no id <9>")]
    p = spark.createDataFrame(rows, "doc_id long, place int, text string")
    f = [FieldPattern("cost", "costs <([0-9]+)>", "amended to <([0-9]+)>", ("is free",))]
    got = prose.apply_patterns(p, documents.DOC_ID, f)
    assert sorted((r["doc_id"], r["record"], r["cost"]) for r in got.collect()) == [(1, "recABCDEFGH1", "5"), (2, "recABCDEFGH1", "7"), (3, "recABCDEFGH2", None)]
    assert {(r["record"], r["cost"]) for r in prose.first_values(got, ["cost"]).collect()} == {("recABCDEFGH1", "5"), ("recABCDEFGH2", None)}
    assert [tuple(r) for r in prose.pattern_coverage(got, ["cost"]).collect()] == [("cost", 0.666667)]
    targets = spark.createDataFrame([("recZZZZZZZZ9",), ("recABCDEFGH2",), (None,)], "k string")
    assert [tuple(r) for r in prose.paragraph_links(p, targets, "k").collect()] == [("recABCDEFGH1", "recABCDEFGH2")]
    assert [tuple(r) for r in prose.link_targets(prose.id_mentions(p), {"t": (targets, "k"), "u": (targets.limit(0), "k")}).collect()] == [("t", 2)]
    keyed = prose.with_dated_key(spark.createDataFrame([("a", "2001-01-01"), ("b", None), ("c", "")], "record string, date string"))
    assert [r["key"] for r in keyed.orderBy("record").collect()] == ["a_2001-01-01", "b", "c"]


def test_greedy_units():
    assert documents.greedy_units([3, 3, 3, 10, 1], 6) == [(0, 2), (2, 1), (3, 1), (4, 1)]
    assert documents.greedy_units([1, 1, 1], 100, 2) == [(0, 2), (2, 1)] and documents.greedy_units([], 5) == []


def test_fields_and_aliases(spark):
    docs = spark.createDataFrame([(i, "blood glucose (GLU) then GLU was 5 mg/dL; GLU of 6; LDH at 3") for i in range(3)] + [(9, None)], "doc_id long, text string")
    assert [tuple(r) for r in documents.discover_fields(docs).orderBy("field").collect()] == [("GLU", 6, 5.5, "mg/dL"), ("LDH", 3, 3.0, None)]
    assert [tuple(r) for r in documents.field_aliases(docs).collect()] == [("GLU", "blood glucose", 3)]
    assert prose.field_states(docs.withColumn("place", F.lit(0)), [Field("GLU")]).count() == 0
