"""Queries of the prose operators, on paragraphs rendered from tables whose values the statements read directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import documents as D
from tamarack.operators import prose as P
from tamarack.queries import core
from tamarack.session import load

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


FIELDS = [P.Field("GLU"), P.Field("WBC", aliases=("white cell count",))]


def lab_prose(spark, d: str) -> DataFrame:
    """A paragraph per result with both values: plain with a correction, one value missing, a missing panel, an id and a year before the number."""
    lab = load(spark, d, "laboratory").where("glu is not null and wbc is not null and exam_date is not null")
    two = lambda c: F.format_string("%.2f", c)
    who = F.concat(F.lit("Patient "), (F.col("lab_id") + 10_000_000).cast("string"))
    m = F.col("lab_id") % 4
    text = (
        F.when(m == 0, F.concat(who, F.lit(", on "), F.date_format("exam_date", "d MMMM yyyy"), F.lit(". GLU was "), two("glu"), F.lit(" mg/dL. WBC was initially logged as 3.1 and later corrected to "), two("wbc"), F.lit(".")))
        .when(m == 1, F.concat(who, F.lit(": GLU was not recorded; the white cell count stood, as the second reader of the sheet confirmed by hand, at "), two("wbc"), F.lit(".")))
        .when(m == 2, F.concat(who, F.lit(": the full panel (GLU, WBC) was unavailable.")))
        .otherwise(F.concat(who, F.lit(": GLU for sample 12345 dated 2003 was "), two("glu"), F.lit(". GLU of "), two("wbc"), F.lit(" came from the other tube.")))
    )
    return lab.select("lab_id", "glu", "wbc", "exam_date", F.col("lab_id").alias("doc_id"), F.lit(0).alias("place"), text.alias("text"))


_LAB = "lab AS (SELECT *, lab_id % 4 AS m, printf('%.2f', glu) AS g, printf('%.2f', wbc) AS w FROM laboratory WHERE glu IS NOT NULL AND wbc IS NOT NULL AND exam_date IS NOT NULL)"
_LAB_VALUES = f"""WITH {_LAB} SELECT * FROM (
    SELECT lab_id AS doc_id, CAST(lab_id + 10000000 AS VARCHAR) AS record, 'GLU' AS field, CASE m WHEN 0 THEN g WHEN 3 THEN w END AS value, 'high' AS confidence, false AS is_correction, CASE WHEN m = 3 THEN g ELSE '' END AS others FROM lab
    UNION ALL SELECT lab_id, CAST(lab_id + 10000000 AS VARCHAR), 'WBC', CASE WHEN m IN (0, 1) THEN w END, CASE WHEN m = 1 THEN 'medium' ELSE 'high' END, m = 0, '' FROM lab WHERE m < 3
    UNION ALL SELECT lab_id, CAST(lab_id + 10000000 AS VARCHAR), 'date', strftime(exam_date, '%Y-%m-%d'), 'high', false, '' FROM lab WHERE m = 0)"""


@query("prose_lab_values", _LAB_VALUES)
def _(spark, d):
    return P.read_paragraphs(lab_prose(spark, d), FIELDS).select("doc_id", "record", "field", "value", "confidence", "is_correction", F.array_join("alternatives", ",").alias("others"))


@query("prose_corrected_forms", "SELECT lab_id AS doc_id, round(glu, 2) AS value FROM laboratory WHERE glu IS NOT NULL")
def _(spark, d):
    """The five ways of taking a value back, one per result in turn; all leave the value itself."""
    lab = load(spark, d, "laboratory").where("glu is not null")
    v = F.format_string("%.2f", "glu")
    forms = [("GLU was originally noted as 7 mg/dL but a review finalized at ", ""), ("GLU was 7 mg/dL, but was subsequently revised to ", " mg/dL"), ("GLU was updated from 7.5 mg/dL to ", ""), ("GLU: first indicated 7, though re-check revealed ", ""), ("GLU was recorded as 7 on paper; the conclusive measurement established ", " mg/dL")]
    k = F.col("lab_id") % 5
    text = F.coalesce(*(F.when(k == n, F.concat(F.lit(a), v, F.lit(b), F.lit("."))) for n, (a, b) in enumerate(forms)))
    return lab.select(F.col("lab_id").alias("doc_id"), P.corrected(text).alias("value"))


@query("prose_states", f"WITH {_LAB} SELECT lab_id AS doc_id, 'GLU' AS field, CASE WHEN glu > 110 THEN 'abnormal' ELSE 'normal' END AS state FROM lab WHERE m < 3")
def _(spark, d):
    lab = lab_prose(spark, d)
    text = F.when(F.col("lab_id") % 4 < 3, F.concat(F.lit("GLU of this patient was "), F.when(F.col("glu") > 110, "elevated").otherwise("comfortably within range"), F.lit("."))).otherwise("GLU was measured.")
    return P.field_states(lab.withColumn("text", text), FIELDS[:1]).select("doc_id", "field", "state")


_PEOPLE = "patient WHERE regexp_full_match(id, '[0-9]{5,}') AND birthday IS NOT NULL"


@query(
    "prose_persons",
    f"""WITH p AS (SELECT DISTINCT CAST(id AS BIGINT) AS doc_id, id AS record, birthday, CAST(id AS BIGINT) % 2 = 0 AS even FROM {_PEOPLE})
    SELECT doc_id, record, 'Sex' AS field, CASE WHEN even THEN 'F' ELSE 'M' END AS value FROM p UNION ALL SELECT doc_id, record, 'Diagnosis', CASE WHEN even THEN 'SLE' ELSE 'APS' END FROM p UNION ALL SELECT doc_id, record, 'Birthday', strftime(birthday, '%Y-%m-%d') FROM p
    UNION ALL SELECT doc_id, record, 'date', strftime(birthday, '%Y-%m-%d') FROM p""",
)
def _(spark, d):
    p = load(spark, d, "patient").where("id rlike '^[0-9]{5,}$' and birthday is not null").select("id", "birthday").distinct()
    even = F.col("id").cast("bigint") % 2 == 0
    text = F.concat(F.lit("Subject "), F.col("id"), F.lit(" was identified as "), F.when(even, "female").otherwise("male"), F.lit(". Diagnosis: "), F.when(even, "SLE").otherwise("APS"), F.lit(". Born on "), F.date_format("birthday", "MMMM d, yyyy"), F.lit("."))
    rows = p.select(F.col("id").cast("bigint").alias("doc_id"), F.lit(0).alias("place"), text.alias("text"))
    return P.read_paragraphs(rows, []).select("doc_id", "record", "field", "value")


@query("prose_field_means", "SELECT 'PRICE' AS field, count(*) AS n, round(avg(CAST(printf('%.2f', o_totalprice) AS DOUBLE)), 3) AS mean FROM orders WHERE o_orderkey % 3 = 1")
def _(spark, d):
    return D.discover_fields(core.prose(spark, d)).select("field", "n", F.round("mean", 3).alias("mean"))


@query("prose_units_and_aliases", f"WITH {_LAB}, n AS (SELECT count(*) AS n FROM lab) SELECT 'GLU' AS field, 'mg/dL' AS unit, 'fasting blood glucose' AS alias, n FROM n WHERE n >= 3")
def _(spark, d):
    lab = lab_prose(spark, d).withColumn("text", F.concat(F.lit("Fasting blood glucose (GLU) counts. GLU was "), F.format_string("%.2f", "glu"), F.lit(" mg/dL.")))
    return D.discover_fields(lab).join(D.field_aliases(lab, least=3).drop("n"), "field").select("field", "unit", "alias", "n")


# --- documents to a table -----------------------------------------------------


def order_documents(spark, d: str) -> DataFrame:
    """A Markdown document per fifty customers: an introduction, a section of orders, one of prose without data."""
    o = load(spark, d, "orders")
    paragraph = F.concat(F.lit("Order "), (F.col("o_orderkey") + 10_000_000).cast("string"), F.lit(" of "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(": PRICE was "), F.format_string("%.2f", "o_totalprice"), F.lit(" in all."))
    own = o.groupBy((F.col("o_custkey") % 50).alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", paragraph.alias("p")))), lambda x: x["p"]), "\n\n").alias("orders"))
    return own.select("doc_id", F.concat(F.lit("Order 99999999: PRICE was 1 before any heading, 2 of them.\n\n## Orders\n\n"), F.col("orders"), F.lit("\n\n### Remarks\n\nNothing of note was said in this part.\n\nNor in this one, as far as we know.")).alias("text"))


@query("doc_pipeline", "SELECT CAST(o_orderkey + 10000000 AS VARCHAR) AS record, printf('%.2f', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    records, _ = P.documents_to_records(order_documents(spark, d))
    return P.as_table(records, ["PRICE", "date"]).select("record", F.col("PRICE").alias("price"), F.col("date").alias("day"))


@query("doc_dated_keys", "SELECT CAST(o_orderkey + 10000000 AS VARCHAR) || '_' || strftime(o_orderdate, '%Y-%m-%d') AS key, printf('%.2f', o_totalprice) AS price FROM orders")
def _(spark, d):
    records, _ = P.documents_to_records(order_documents(spark, d), [P.Field("PRICE")])
    return P.with_dated_key(P.as_table(records, ["PRICE", "date"])).select("key", F.col("PRICE").alias("price"))


@query("doc_flags", f"WITH {_LAB} SELECT CAST(lab_id + 10000000 AS VARCHAR) AS record, f AS field, 'no_value_found' AS flag FROM lab, (VALUES ('GLU'), ('WBC')) t(f) WHERE (m = 1 AND f = 'GLU') OR m = 2 UNION ALL SELECT CAST(lab_id + 10000000 AS VARCHAR), 'GLU', 'multiple_values' FROM lab WHERE m = 3")
def _(spark, d):
    from tamarack.operators import merge

    return merge.flag_values(P.read_paragraphs(lab_prose(spark, d), FIELDS)).where("flag is not null").select("record", "field", "flag")


@query("doc_extraction_units", core.packed_sql("SELECT o_custkey % 50 AS doc_id, o_orderkey AS k, length('Order 10000000 of : PRICE was  in all.' || strftime(o_orderdate, '%B %-d, %Y') || printf('%.2f', o_totalprice)) // 4 AS size FROM orders", 300, None, "token_estimate", "unit").replace("max(parts) AS parts", "'Orders' AS section_heading"))
def _(spark, d):
    return D.extraction_units(P.data_paragraphs(order_documents(spark, d)), 300).select("doc_id", "unit", "token_estimate", "section_heading")


def event_prose(spark, d: str) -> DataFrame:
    e = load(spark, d, "club_event").where("event_id is not null and event_type is not null and event_status is not null")
    text = F.concat(F.lit("Event "), F.col("event_id"), F.lit(" is booked; its type: <"), F.col("event_type"), F.lit(">. "), F.when(F.length("event_type") % 2 == 0, F.concat(F.lit("State was <draft>, amended to <"), F.col("event_status"), F.lit(">."))).otherwise(F.concat(F.lit("State was <"), F.col("event_status"), F.lit(">; amount is unknown."))))
    return e.select(F.xxhash64("event_id").alias("doc_id"), F.lit(0).alias("place"), text.alias("text"))


PATTERNS = [P.FieldPattern("kind", "type: <([^>]*)>"), P.FieldPattern("state", "State was <([^>]*)>", "amended to <([^>]*)>"), P.FieldPattern("amount", "(amount)", null_signals=("amount is unknown",))]
_EVENTS = "club_event WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND event_status IS NOT NULL"


@query("doc_patterns", f"SELECT event_id AS record, nullif(event_type, '') AS kind, nullif(event_status, '') AS state FROM {_EVENTS}")
def _(spark, d):
    return P.apply_patterns(event_prose(spark, d), D.DOC_ID, PATTERNS).select("record", "kind", "state")


@query("doc_pattern_coverage", f"SELECT 'kind' AS field, round(avg(CASE WHEN event_type <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM {_EVENTS} UNION ALL SELECT 'state', round(avg(CASE WHEN event_status <> '' THEN 1.0 ELSE 0.0 END), 6) FROM {_EVENTS} UNION ALL SELECT 'amount', 0.0")
def _(spark, d):
    return P.pattern_coverage(P.apply_patterns(event_prose(spark, d), D.DOC_ID, PATTERNS), ["kind", "state", "amount"])


def _edge_paragraphs(spark, d: str) -> DataFrame:
    """A paragraph per clean edge from a result to a patient: "Result 1234567 belongs to 2345678, sheet 99999"."""
    r = load(spark, d, "relationships").where("source_id rlike '^[0-9]{5,}$' and target_id rlike '^[0-9]{5,}$' and lower(trim(source_type)) = 'laboratory'")
    return r.select(F.col("rel_id").alias("doc_id"), F.lit(0).alias("place"), F.concat(F.lit("Result "), F.col("source_id"), F.lit(" on sheet 99999 belongs to "), F.col("target_id"), F.lit(".")).alias("text"))


_CLEAN_EDGES = "relationships WHERE regexp_full_match(source_id, '[0-9]{5,}') AND regexp_full_match(target_id, '[0-9]{5,}') AND lower(trim(source_type)) = 'laboratory'"


@query("doc_paragraph_links", f"SELECT source_id AS record, arg_min(target_id, rel_id) AS link FROM {_CLEAN_EDGES} AND target_id IN (SELECT id FROM patient) AND target_id <> source_id GROUP BY source_id")
def _(spark, d):
    return P.paragraph_links(_edge_paragraphs(spark, d), load(spark, d, "patient"), "id")


@query("doc_link_targets", f"SELECT t AS table_name, hits FROM (SELECT 'patient' AS t, count(DISTINCT target_id) AS hits FROM {_CLEAN_EDGES} AND target_id IN (SELECT id FROM patient) UNION ALL SELECT 'club_event', 0) WHERE hits >= 2")
def _(spark, d):
    return P.link_targets(P.id_mentions(_edge_paragraphs(spark, d)), {"patient": (load(spark, d, "patient"), "id"), "club_event": (load(spark, d, "club_event"), "event_id")})


@query("doc_first_values", f"SELECT source_id AS record, arg_min(target_id, rel_id) AS target FROM {_CLEAN_EDGES} GROUP BY source_id")
def _(spark, d):
    rows = P.apply_patterns(_edge_paragraphs(spark, d), D.DOC_ID, [P.FieldPattern("target", "belongs to ([0-9]+)")])
    return P.first_values(rows, ["target"])


_KINDS = " UNION ALL ".join(rf"SELECT '{k}' AS kind, unnest(regexp_extract_all(text, '\b({p})\b', 1)) AS id FROM documents WHERE text IS NOT NULL" for k, p in P.ID_KINDS.items())


@query("doc_id_kinds", f"SELECT kind, count(DISTINCT id) AS ids, count(*) AS n FROM ({_KINDS}) GROUP BY kind HAVING count(DISTINCT id) >= 3")
def _(spark, d):
    return P.id_kinds(load(spark, d, "documents"))


@query("doc_id_references", rf"WITH i AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b({P.ID_KINDS['digits']})\b', 1)) AS id FROM documents WHERE text IS NOT NULL) SELECT 'patient' AS table_name, count(*) FILTER (id IN (SELECT id FROM patient WHERE id IS NOT NULL)) AS hits FROM i UNION ALL SELECT 'laboratory', count(*) FILTER (id IN (SELECT CAST(lab_id AS VARCHAR) FROM laboratory)) FROM i")
def _(spark, d):
    return P.id_references(load(spark, d, "documents"), {"patient": (load(spark, d, "patient"), "id"), "laboratory": (load(spark, d, "laboratory"), "lab_id")}, "digits")


_HEADED = r"regexp_split_to_array(text, '\n#{2,4}[ \t]')"


@query("doc_section_chunks", core.packed_sql(f"SELECT doc_id, k, length(trim(v)) AS size FROM (SELECT doc_id, unnest({_HEADED}) AS v, generate_subscripts({_HEADED}, 1) AS k FROM documents WHERE text IS NOT NULL) WHERE length(trim(v)) >= 60", 1500, None, "chars", "chunk"))
def _(spark, d):
    return D.chunks(load(spark, d, "documents"), 1500, None, least=60, separator=r"\n#{2,4}[ \t]")


@query("doc_section_bodies", rf"SELECT doc_id, CAST(sum(length(v) - length(regexp_extract(v, '^[^\n]*\n?'))) AS BIGINT) AS body_chars, count(*) AS sections FROM (SELECT doc_id, unnest(parts[2:]) AS v FROM (SELECT doc_id, regexp_split_to_array(chr(10) || text, '\n#{{2,4}}[ \t]+') AS parts FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id")
def _(spark, d):
    """Headings and what stands below them; the line break before a heading belongs to neither here."""
    s = D.sections(load(spark, d, "documents")).where("level is not null")
    last = F.max("section").over(core.Window.partitionBy("doc_id"))
    body = s.withColumn("last", last).withColumn("chars", F.length(F.when(F.col("section") < F.col("last"), F.regexp_replace("body", r"\n\z", "")).otherwise(F.col("body"))))
    return body.groupBy("doc_id").agg(F.sum("chars").alias("body_chars"), F.count("*").alias("sections"))
