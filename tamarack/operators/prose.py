"""Records out of prose paragraphs: values, corrections, missing values, dates and persons, and the pipeline from documents to a table.

What a paragraph says about a field depends on the order of its words, so each
paragraph is read once by a Python reader in Arrow batches; all that goes
beyond one paragraph (schemas, keys, merging, coverage) are DataFrame operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators import documents as D
from tamarack.operators import merge
from tamarack.session import spread

# The words that prose uses for corrections, missing values and states.
FIRST = "initially|first|originally"
CLAIMED = r"logged\s+as|thought\s+to\s+be|recorded\s+as|estimated\s+at|suggested|transcribed\s+as|reported\s+as|read\s+as|measured\s+at|flagged\s+at|entered\s+as|noted\s+as|listed\s+as|underestimated\s+at"
CHANGED = "amend(?:ed)?|correct(?:ed|ion)?|adjust(?:ed)?|revis(?:ed|ion)?|verif(?:ied|y)|confirm(?:ed)?|finali[sz]ed?"
CHECKED = r"manual\s+verification|re-?check|review|reanalysis|verification"
DECIDED = r"(?:definitive|final|conclusive|authoritative)\s+(?:analysis|reading|measurement|assessment)"
SHOWED = "confirmed|showed|revealed|yielded|established"
NOT_THERE = ("not available", "unavailable", "not recorded", "data gap", "nan")
ABNORMAL = ("significant reduction", "impaired", "abnormal", "elevated", "decreased", "reduced clearance", "outside normal", "above normal", "below normal", "compromised", "deteriorat", "dysfunction", "failure")
NORMAL = ("healthy", "normal", "within expected", "within physiological", "unremarkable", "stable", "well-maintained", "comfortably within", "adequate")

_N = r"([-+]?\d+(?:\.\d+)?)"
_UNIT = r"\s*[A-Za-z/%]*"
#: A number that is not part of a word, an id with letters, an ordinal or a longer number; a unit may follow at once.
_NUMBER = re.compile(r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?!\d|-[A-Za-z]|(?:st|nd|rd|th)\b)")
_CORRECTIONS = tuple(
    re.compile(p, re.I | re.S)
    for p in (
        rf"\b(?:{FIRST})\s+(?:(?:{CLAIMED})\s+)?{_N}.*?\b(?:{CHANGED})\s+(?:to\s+(?:be\s+)?|at\s+|value\s+of\s+)?{_N}",
        rf"{_N}{_UNIT}\s*(?:,?\s*(?:but|however|though))?\s*(?:was\s+(?:later\s+|subsequently\s+)?)?(?:{CHANGED})\s+(?:to\s+(?:be\s+)?|at\s+){_N}",
        rf"\b(?:{CHANGED}|changed?|updated?)\s+from\s+{_N}{_UNIT}\s+to\s+{_N}",
        rf"\b(?:(?:{FIRST})\s+)?(?:suggested|thought|indicated)\s+{_N}{_UNIT}.*?\b(?:{CHECKED})\s+(?:{SHOWED})\s+{_N}",
        rf"\b(?:(?:originally|initially)\s+)?(?:transcribed|recorded|logged|noted)\s+(?:as\s+)?{_N}{_UNIT}.*?\b{DECIDED}\s+(?:{SHOWED})\s+{_N}",
    )
)
_PANEL = re.compile(r"(?:full\s+panel|entire\s+[\w\s]+?panel|all\s+(?:tests|values|measurements|parameters|markers))\s*(?:\(([^)]+)\)\s*)?[^.()]{0,40}?\b(?:was|were)\s+(?:marked\s+as\s+)?(?:unavailable|not\s+available|not\s+recorded)|data\s+(?:void|gap)s?\s+(?:for|in)\s+(?:the\s+)?[\w\s]+?(?:panel|markers?)\s*\(([^)]+)\)", re.I)
_PERSON_ID = re.compile(r"\b(?:patient|subject|id)\s*[:#]?\s*(\d{5,})", re.I)
_ANY_ID = re.compile(D.DOC_ID)
_SEX = re.compile(r"\b(?:sex\s*:\s*|(?:identified|denoted|classified)\s+as\s+(?:a\s+)?)['\"]?(male|female|m|f)\b", re.I)
_DIAGNOSIS = re.compile(r"\bdiagnosis\s*:\s*(\S+)", re.I)
_BORN = re.compile(r"\b(?:date\s+of\s+birth|dob|born\s+on|birthday)\s+(?:is\s+)?", re.I)
_MONTH = "|".join(D.MONTHS)
_DAY = r"(\d{1,2}|[a-z]+(?:-[a-z]+)?)(?:(?<=\d)(?:st|nd|rd|th))?"
_DATE = re.compile(rf"\b(?:(\d{{4}}-\d{{2}}-\d{{2}})|({_MONTH})\s+{_DAY},?\s+(\d{{4}})|(?:the\s+)?{_DAY}\s+(?:of\s+)?({_MONTH}),?\s+(\d{{4}}))\b", re.I)

CORRECTION_REACH, NUMBER_REACH, MISSING_REACH, STATE_REACH, NEAR = 500, 120, 150, 200, 40
SCHEMA = "doc_id bigint, place int, record string, field string, value string, confidence string, is_correction boolean, alternatives array<string>"


@dataclass(frozen=True)
class Field:
    """A field that paragraphs may tell: its name, its kind (numeric, date, text) and further labels."""

    name: str
    kind: str = "numeric"
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Value:
    field: str
    value: str | None
    confidence: str = "high"
    is_correction: bool = False
    alternatives: tuple[str, ...] = ()


def _day(text: str) -> int | None:
    low = text.lower()
    return D.ORDINALS.index(low) + 1 if low in D.ORDINALS else int(low) if low.isdigit() else None


def dates(text: str) -> list[str]:
    """The dates of a text in ISO form, each once, in order: ISO, "March 5, 2004", "5 March 2004", "the fifth of March, 2004"."""
    out: dict[str, None] = {}
    for m in _DATE.finditer(text):
        if m[1]:
            out[m[1]] = None
            continue
        month, day, year = (m[2], m[3], m[4]) if m[2] else (m[6], m[5], m[7])
        try:
            out[date(int(year), D.MONTHS.index(month.lower()) + 1, _day(day) or 0).isoformat()] = None
        except ValueError:
            continue
    return list(out)


class ParagraphReader:
    """Reads one paragraph after another against a list of fields."""

    def __init__(self, fields: list[Field]):
        self.fields = {f.name: f for f in fields}
        self.labels = {label.lower(): f.name for f in fields for label in (f.name, *f.aliases)}
        words = sorted(self.labels, key=lambda x: (-len(x), x))
        self.label = re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})\b", re.I) if words else re.compile(r"(?!)")
        self._seen: tuple[str, list[tuple[str, int, int, int]]] = ("", [])

    def mentions(self, text: str) -> list[tuple[str, int, int, int]]:
        """(field, start, end, start of the next mention of another field); those of the last text are kept."""
        if self._seen[0] != text:
            self._seen = (text, self._mentions(text))
        return self._seen[1]

    def _mentions(self, text: str) -> list[tuple[str, int, int, int]]:
        found = [(self.labels[m[0].lower()], m.start(), m.end()) for m in self.label.finditer(text)]
        return [(f, a, b, next((c for g, c, _ in found[k + 1 :] if g != f), len(text))) for k, (f, a, b) in enumerate(found)]

    def field_named(self, name: str) -> str | None:
        """The field a text names: exactly, by an alias, or containing or contained."""
        plain = name.lower().strip().replace("-", "_")
        near = {label.replace("-", "_"): f for label, f in self.labels.items()}
        return near.get(plain) or next((f for label, f in near.items() if plain and (plain in label or label in plain)), None)

    def corrected(self, text: str, field: str) -> Value | None:
        """The value a correction leaves, within reach of a mention and before the next field."""
        for f, _, end, stop in self.mentions(text):
            if f == field:
                region = text[end : min(end + CORRECTION_REACH, stop)]
                m = next((m for p in _CORRECTIONS if (m := p.search(region))), None)
                if m:
                    return Value(field, m[2], is_correction=True)
        return None

    def missing_panel(self, text: str) -> list[Value]:
        """Fields that a statement about a whole panel says are missing: those it lists, else every numeric one."""
        m = _PANEL.search(text)
        if not m:
            return []
        named = m[1] or m[2]
        if named:
            return [Value(f, None) for n in re.split(r",|\band\b", named) if (f := self.field_named(n))]
        return [Value(f.name, None, "medium") for f in self.fields.values() if f.kind == "numeric"]

    def missing(self, text: str, field: str) -> bool:
        return any(f == field and any(p in text[end : end + MISSING_REACH].lower() for p in NOT_THERE) for f, _, end, _ in self.mentions(text))

    def number(self, text: str, field: str) -> Value | None:
        """The number nearest behind a mention: neither an id of five digits or more, nor a year, nor part of a word; the others are alternatives."""
        got = []
        for f, start, end, _ in self.mentions(text):
            before = text[max(0, start - 100) : start].lower()
            if f != field or "data void" in before or "data gap" in before:
                continue
            region = text[end : end + NUMBER_REACH]
            for m in _NUMBER.finditer(region):
                whole = "." not in m[0]
                if whole and len(m[0].lstrip("-+")) >= 5:
                    continue
                if whole and re.fullmatch(r"19\d\d|20\d\d|2100", m[0]) and re.search(r"patient|\b(?:on|in|dated)\b|,", region[: m.start()], re.I):
                    continue
                got.append((m.start(), m[0]))
                break
        if not got:
            return None
        distance, value = min(got, key=lambda x: x[0])
        others = tuple(v for d, v in got if (d, v) != (distance, value))
        return Value(field, value, "high" if distance < NEAR else "medium", alternatives=others)

    def state(self, text: str, field: str) -> str | None:
        """normal or abnormal, as the words around a mention say; abnormal counts before normal."""
        for f, start, end, _ in self.mentions(text):
            if f == field:
                around = text[max(0, start - STATE_REACH) : end + STATE_REACH].lower()
                for word, phrases in (("abnormal", ABNORMAL), ("normal", NORMAL)):
                    if any(p in around for p in phrases):
                        return word
        return None

    @staticmethod
    def record(text: str) -> str:
        m = _PERSON_ID.search(text)
        return m[1] if m else m[0] if (m := _ANY_ID.search(text)) else ""

    @staticmethod
    def person(text: str) -> list[Value]:
        """Sex, Diagnosis and Birthday of the person a paragraph describes."""
        out = []
        if m := _SEX.search(text):
            out.append(Value("Sex", m[1][0].upper()))
        if m := _DIAGNOSIS.search(text):
            out.append(Value("Diagnosis", m[1].strip(".,;")))
        if (m := _BORN.search(text)) and (born := dates(text[m.end() :])):
            out.append(Value("Birthday", born[0]))
        return out

    def read(self, text: str | None) -> tuple[str, list[Value]]:
        """(record id, values): corrections count before missing panels, those before missing fields, then numbers; dates go to the date fields in order."""
        text = (text or "").strip()
        if len(text) < 10:
            return "", []
        got: dict[str, Value] = {}
        mentioned = {f for f, *_ in self.mentions(text)}
        numeric = [f for f in self.fields if f in mentioned and self.fields[f].kind == "numeric"]
        for f in numeric:
            if v := self.corrected(text, f):
                got[f] = v
        for v in self.missing_panel(text):
            got.setdefault(v.field, v)
        for f in mentioned - got.keys():
            if self.missing(text, f):
                got[f] = Value(f, None)
        for f in numeric:
            if f not in got and (v := self.number(text, f)):
                got[f] = v
        if days := dates(text):
            free = [f.name for f in self.fields.values() if f.kind == "date" and f.name not in got]
            if free:
                got |= {f: Value(f, d) for f, d in zip(free, days, strict=False)}
            else:
                got.setdefault("date", Value("date", days[0], alternatives=tuple(days[1:])))
        for v in self.person(text):
            got.setdefault(v.field, v)
        return self.record(text), list(got.values())


def number_after(c: Column, label: str) -> Column:
    """The number a text gives for a label, as ParagraphReader.number() finds it, in Arrow batches; null without one."""

    @F.pandas_udf("double")
    def find(texts: pd.Series) -> pd.Series:
        reader = ParagraphReader([Field(label)])
        return pd.Series([float(v.value) if t and (v := reader.number(t, label)) else None for t in texts], dtype="float64")

    return find(c)


def corrected(c: Column) -> Column:
    """The value the first correction of a text leaves, in Arrow batches; null without one."""

    @F.pandas_udf("double")
    def find(texts: pd.Series) -> pd.Series:
        hits = (next((m for p in _CORRECTIONS if (m := p.search(t))), None) if t else None for t in texts)
        return pd.Series([float(m[2]) if m else None for m in hits], dtype="float64")

    return find(c)


def read_paragraphs(paragraphs: DataFrame, fields: list[Field]) -> DataFrame:
    """doc_id, place, record, field, value, confidence, is_correction, alternatives of every field a paragraph tells.

    paragraphs: doc_id, place, text. A missing value is null. Null and short
    paragraphs tell nothing; record is blank where a paragraph names no id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ParagraphReader(fields)
        for pdf in batches:
            rows = []
            for doc, place, text in pdf[["doc_id", "place", "text"]].itertuples(index=False):
                record, values = reader.read(text)
                rows += [(doc, place, record, v.field, v.value, v.confidence, v.is_correction, list(v.alternatives)) for v in values]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "record", "field", "value", "confidence", "is_correction", "alternatives"])

    return spread(paragraphs.select("doc_id", "place", "text")).mapInPandas(run, SCHEMA)


def field_states(paragraphs: DataFrame, fields: list[Field]) -> DataFrame:
    """doc_id, place, field, state (normal, abnormal) where words around a field's mention say one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ParagraphReader(fields)
        for pdf in batches:
            rows = [(d, p, f.name, s) for d, p, t in pdf[["doc_id", "place", "text"]].itertuples(index=False) for f in fields if (s := reader.state(t or "", f.name))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "field", "state"])

    return spread(paragraphs.select("doc_id", "place", "text")).mapInPandas(run, "doc_id bigint, place int, field string, state string")


def paragraphs_of(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, place, text of the paragraphs, blank lines between them, of least characters or more."""
    parts = docs.select("doc_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "part"))
    return parts.select("doc_id", "place", F.btrim("part", F.lit(" \t\r\n")).alias("text")).where(F.length("text") >= least)


def data_paragraphs(docs: DataFrame, least: int = 30, density: float = 0.3) -> DataFrame:
    """doc_id, place, heading, text: paragraphs of the sections in which enough paragraphs bear data; what stands before the first heading is none.

    place numbers the paragraphs of a document by section and place in it.
    """
    titled = D.sections(docs).where("level is not null").withColumn("parts", F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != ""))
    bearing = F.size(F.filter("parts", D.is_data_bearing))
    kept = titled.where((F.size("parts") > 0) & (bearing / F.size("parts") >= density))
    parts = kept.select("doc_id", "section", "heading", F.posexplode("parts").alias("k", "text"))
    return parts.where(F.length("text") >= least).select("doc_id", (F.col("section") * 100_000 + F.col("k")).cast("int").alias("place"), "heading", "text")


def discovered_fields(docs: DataFrame, least: int = 3) -> list[Field]:
    """Fields that texts state least times or more as "ABBR was/of/at N"; names are metadata and come to the driver."""
    found = D.discover_fields(docs, "text", least).select("field").collect()
    return [Field(r["field"]) for r in sorted(found)]


def documents_to_records(docs: DataFrame, fields: list[Field] | None = None) -> tuple[DataFrame, DataFrame]:
    """(record, field, value; and the flagged values) of documents: data-bearing sections, fields, values, flags, merge by id.

    docs: doc_id, text. Fields are discovered where none are given. A record's
    value is the first of high confidence, else the first correction, else the
    last; paragraphs without an id add to no record. Flags name values without a
    find, of low confidence or with alternatives.
    """
    paragraphs = data_paragraphs(docs)
    read = read_paragraphs(paragraphs, fields if fields is not None else discovered_fields(docs))
    keyed = read.where("record <> ''").withColumn("at", F.struct("doc_id", "place"))
    flags = merge.flag_values(keyed).where("flag is not null").select("record", "field", "flag", "doc_id", "place")
    return merge.merge_by_confidence(keyed.withColumn("place", F.col("at")).drop("at")), flags


def as_table(records: DataFrame, names: list[str]) -> DataFrame:
    """One row per record with a column per name; a name without a value is null."""
    return records.groupBy("record").agg(*(F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names))


def with_dated_key(records: DataFrame, record: str = "record", day: str = "date") -> DataFrame:
    """Adds key: the id, and the day behind "_" where there is one; for ids that several days share."""
    return records.withColumn("key", F.concat_ws("_", F.col(record), F.when(F.trim(F.col(day).cast("string")) != "", F.col(day).cast("string"))))


@dataclass(frozen=True)
class FieldPattern:
    """How a text tells a field: words that say there is none, a correction, the plain statement. Patterns hold one group."""

    name: str
    pattern: str
    correction: str | None = None
    null_signals: tuple[str, ...] = ()

    def of(self, text: Column) -> Column:
        direct = F.nullif(F.regexp_extract(text, f"(?i){self.pattern}", 1), F.lit(""))
        fixed = F.nullif(F.regexp_extract(text, f"(?i){self.correction}", 1), F.lit("")) if self.correction else F.lit(None).cast("string")
        signals = [F.contains(F.lower(text), F.lit(s.lower())) for s in self.null_signals]
        value = F.coalesce(fixed, direct)
        return F.when(~F.coalesce(F.array_max(F.array(*signals)), F.lit(False)), value) if signals else value


def apply_patterns(paragraphs: DataFrame, id_pattern: str, fields: list[FieldPattern]) -> DataFrame:
    """record and a column per field of every paragraph with an id: null by signal, else the correction, else the plain statement."""
    record = F.regexp_extract("text", f"({id_pattern})", 1)
    return paragraphs.select("doc_id", "place", record.alias("record"), *(f.of(F.col("text")).alias(f.name) for f in fields)).where("record <> ''")


def first_values(rows: DataFrame, names: list[str]) -> DataFrame:
    """record and, per name, the first value in reading order that is not null; one combinable aggregate."""
    order = F.struct("doc_id", "place")
    return rows.groupBy("record").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), order)).alias(n) for n in names))


def pattern_coverage(rows: DataFrame, names: list[str]) -> DataFrame:
    """field, coverage: the share of paragraphs with an id in which a field has a value."""
    one = rows.agg(*(F.avg(F.when(F.col(n).isNotNull(), 1.0).otherwise(0.0)).alias(n) for n in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.round(F.col(n), 6).alias("coverage")) for n in names))).alias("x")).select("x.field", "x.coverage")


def id_mentions(paragraphs: DataFrame, id_pattern: str = D.DOC_ID) -> DataFrame:
    """doc_id, place, record, other, k: a paragraph's first id and each later, different one."""
    found = F.regexp_extract_all("text", F.lit(f"({id_pattern})"), F.lit(1))
    ids = paragraphs.select("doc_id", "place", found.alias("ids")).where(F.size("ids") > 1)
    return ids.select("doc_id", "place", F.col("ids")[0].alias("record"), F.posexplode("ids").alias("k", "other")).where("other <> record")


def paragraph_links(paragraphs: DataFrame, targets: DataFrame, key: str, id_pattern: str = D.DOC_ID) -> DataFrame:
    """record, link: for each record the first other id in its paragraphs that the target table has."""
    keys = targets.select(F.col(key).cast("string").alias("other")).where("other is not null").distinct()
    met = id_mentions(paragraphs, id_pattern).join(keys, "other", "left_semi")
    return met.groupBy("record").agg(F.min_by("other", F.struct("doc_id", "place", "k")).alias("link"))


def link_targets(mentions: DataFrame, tables: dict[str, tuple[DataFrame, str]], least: int = 2) -> DataFrame:
    """table_name, hits: the tables of which the other ids in paragraphs hit least different keys or more."""
    ids = mentions.select("other").distinct()
    rows = None
    for name, (df, key) in sorted(tables.items()):
        hits = ids.join(df.select(F.col(key).cast("string").alias("other")).distinct(), "other", "left_semi").agg(F.count("*").alias("hits")).select(F.lit(name).alias("table_name"), "hits")
        rows = hits if rows is None else rows.unionByName(hits)
    return rows.where(F.col("hits") >= least)


#: Kinds of ids and their patterns.
ID_KINDS = {"digits": r"[0-9]{5,}", "record": r"rec[A-Za-z0-9]{8,}", "coded": r"[A-Z]{1,4}-?[0-9]{2,}", "named": r"(?:[Ee]ntry|[Nn]ote|[Rr]ecord|[Cc]ase|[Pp]art) [0-9]+"}


def id_kinds(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """kind, ids, n: for each kind of id how many different ones, and how many in all, of kinds with least different ones or more."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rf"\b({pattern})\b"), F.lit(1)), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("id")))

    found = F.explode(F.concat(*(of_kind(k, p) for k, p in ID_KINDS.items())))
    counts = docs.select(found.alias("x")).groupBy("x.kind", "x.id").agg(F.count("*").alias("n"))
    return counts.groupBy("kind").agg(F.count("*").alias("ids"), F.sum("n").alias("n")).where(F.col("ids") >= least)


def id_references(docs: DataFrame, tables: dict[str, tuple[DataFrame, str]], kind: str = "record", text: str = "text") -> DataFrame:
    """table_name, hits: how many of the documents' different ids of a kind each table has; two or more tell whose ids they are."""
    ids = docs.select(F.explode(F.regexp_extract_all(text, F.lit(rf"\b({ID_KINDS[kind]})\b"), F.lit(1))).alias("other"))
    return link_targets(ids, tables, 0)
