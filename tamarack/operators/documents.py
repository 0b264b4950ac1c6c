"""Prose to tables: sections, packing, ids, dates and vocabulary, as built-in expressions.

A document stays one row until an array of its parts is exploded; sequential
packing is one Arrow pass over the sizes of its parts, never a window over
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: English month names, and ordinal words of days.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second", "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh", "twenty-eighth", "twenty-ninth", "thirtieth", "thirty-first")

#: Long runs of digits or record ids.
DOC_ID = r"\b(?:[0-9]{5,}|rec[A-Za-z0-9]{8,})\b"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, place, line of every non-blank line."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("place", "line")).where(F.trim("line") != "")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, section, level, heading, body for ## to #### headings; what stands before the first is section 0 without heading."""
    marked = F.split(F.regexp_replace(text, r"(?m)^(#{2,4})[ \t]+", "\u0001$1 "), "\u0001")
    parts = docs.select("doc_id", F.posexplode(marked).alias("section", "part"))
    head = r"(?s)^(#{2,4}) ([^\n]*)\n?(.*)$"
    titled = F.col("part").rlike(r"^#{2,4} ")
    return parts.select(
        "doc_id", "section", F.when(titled, F.length(F.regexp_extract("part", head, 1))).alias("level"), F.when(titled, F.trim(F.regexp_extract("part", head, 2))).alias("heading"), F.when(titled, F.regexp_extract("part", head, 3)).otherwise(F.col("part")).alias("body")
    ).where((F.trim("part") != ""))


def is_data_bearing(c: Column) -> Column:
    """At least 30 characters and an id or two numbers."""
    return F.coalesce((F.length(c) >= 30) & (c.rlike(DOC_ID) | (F.size(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))) >= 2)), F.lit(False))


def data_density(parts: DataFrame, by: str, text: str, least: float = 0.3) -> DataFrame:
    """by, parts, density, kept: the share of data-bearing parts."""
    return parts.groupBy(by).agg(F.count("*").alias("parts"), F.round(F.avg(F.when(is_data_bearing(F.col(text)), 1.0).otherwise(0.0)), 6).alias("density")).withColumn("kept", F.col("density") >= least)


def greedy_units(sizes: list[int], limit: int, most: int | None = None) -> list[tuple[int, int]]:
    """(first part, parts) of units packed in order: a new one begins when the next part would pass the limit, or most parts are in."""
    units: list[list[int]] = []
    total = 0
    for k, n in enumerate(sizes):
        if units and total + n <= limit and (most is None or units[-1][1] < most):
            units[-1][1] += 1
            total += n
        else:
            units.append([k, 1])
            total = n
    return [(a, b) for a, b in units]


def _packed(docs: DataFrame, parts: Column, size: Column, limit: int, most: int | None = None) -> DataFrame:
    """doc_id, unit, total, parts: one Arrow pass over the sizes of each document's parts; texts stay behind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, u, int(sum(s[a : a + n])), n) for d, s in zip(pdf["doc_id"], pdf["sizes"], strict=True) for u, (a, n) in enumerate(greedy_units(list(s), limit, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "total", "parts"])

    sizes = docs.where(parts.isNotNull()).select("doc_id", F.transform(parts, lambda x: size(x)).alias("sizes"))
    return sizes.mapInPandas(run, "doc_id bigint, unit int, total int, parts int")


def pack_parts(docs: DataFrame, limit: int = 3000, text: str = "text", separator: str = "\n") -> DataFrame:
    """doc_id, unit, tokens, parts: a document's parts packed in order, a new unit when the next part would pass the limit.

    A single part above the limit is a unit of its own. Null texts have no units.
    """
    parts = F.filter(F.split(text, separator), lambda x: F.trim(x) != "")
    return _packed(docs, parts, lambda x: F.floor(F.length(x) / CHARS_PER_TOKEN).cast("int"), limit).withColumnRenamed("total", "tokens")


def extraction_units(paragraphs: DataFrame, limit: int = 3000) -> DataFrame:
    """doc_id, unit, section_heading, text, token_estimate: the data-bearing paragraphs of a document packed in order.

    paragraphs: doc_id, place, heading, text, those of sections dense with data.
    A unit has the heading of its first paragraph; paragraphs are joined by
    blank lines. One document's paragraphs meet in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, parts in zip(pdf["doc_id"], pdf["parts"], strict=True):
                sizes = [len(p["text"]) // CHARS_PER_TOKEN for p in parts]
                for u, (a, n) in enumerate(greedy_units(sizes, limit)):
                    rows.append((doc, u, parts[a]["heading"], "\n\n".join(p["text"] for p in parts[a : a + n]), sum(sizes[a : a + n])))
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "section_heading", "text", "token_estimate"])

    kept = paragraphs.where(is_data_bearing(F.col("text"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "heading", "text"))).alias("parts"))
    return kept.mapInPandas(run, "doc_id bigint, unit int, section_heading string, text string, token_estimate int")


def ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, place, id of every record id."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(DOC_ID), F.lit(0))).alias("place", "id"))


def id_pattern(docs: DataFrame, text: str = "text", least: int = 3) -> str | None:
    """The kind of id that repeats most over different ones: digits or record; None under least different ids."""
    kinds = ids(docs, text).select(F.when(F.col("id").rlike("^[0-9]+$"), "digits").otherwise("record").alias("kind"), "id")
    rows = kinds.groupBy("kind").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("n")).where(F.col("ids") >= least).orderBy(F.desc("n"), "kind").limit(1).collect()
    return rows[0]["kind"] if rows else None


def composite_key(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """id, parts of ids that appear in least or more documents: such ids need a date beside them."""
    return ids(docs, text).groupBy("id").agg(F.count_distinct("doc_id").alias("parts")).where(F.col("parts") >= least)


def missing_field(c: Column, label: str, reach: int = 150) -> Column:
    """Whether a text says near a label that there is no value."""
    return F.coalesce(c.rlike(rf"(?i)\b{label}\b[^.]{{0,{reach}}}?\b(?:not (?:available|recorded|measured|reported|documented)|missing|unavailable|no (?:value|data|result))\b"), F.lit(False))


def prose_date(c: Column) -> Column:
    """The first date of a text: ISO, "March 5, 2004", "5 March 2004" or "the fifth of March, 2004"."""
    months = "|".join(MONTHS)
    t = F.lower(c)
    iso = F.regexp_extract(t, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1)
    month_of = lambda x: F.array_position(F.array(*(F.lit(m) for m in MONTHS)), x).cast("int")
    us, eu = rf"\b({months}) ([0-9]{{1,2}}),? ([0-9]{{4}})\b", rf"\b([0-9]{{1,2}}) ({months}),? ([0-9]{{4}})\b"
    words = rf"\bthe ([a-z-]+) of ({months}),? ([0-9]{{4}})\b"
    day_of = lambda x: F.array_position(F.array(*(F.lit(o) for o in ORDINALS)), x).cast("int")
    made = lambda p, y, m, d, day: F.when(t.rlike(p), F.try_make_timestamp(F.regexp_extract(t, p, y).cast("int"), month_of(F.regexp_extract(t, p, m)), day, F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    number = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    return F.coalesce(F.when(iso != "", iso.try_cast("date")), made(us, 3, 1, 2, number(us, 2)), made(eu, 3, 2, 1, number(eu, 1)), made(words, 3, 2, 1, day_of(F.regexp_extract(t, words, 1))))


def longest_contained(c: Column, vocabulary: list[str]) -> Column:
    """The longest value of a vocabulary that a text holds, case aside; ties go to the smaller."""
    t = F.lower(c)
    found = F.filter(F.array(*(F.when(F.contains(t, F.lit(v.lower())), F.struct(F.lit(-len(v)).alias("n"), F.lit(v).alias("v"))) for v in vocabulary)), lambda x: x.isNotNull())
    return F.array_min(found)["v"]


def binary_category(c: Column, yes: str, negation: str = r"\b(?:no|not|without|never|denies)\b") -> Column:
    """1 where a phrase occurs, 0 where its sentence negates it before, null where it does not occur."""
    return F.when(c.rlike(rf"(?i){negation}[^.]{{0,60}}?{yes}"), 0).when(c.rlike(rf"(?i){yes}"), 1)


def discover_fields(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """field, n, mean, unit of "ABBR was/of/at N unit" statements seen least times or more; unit: the one seen most often, the smaller of equals, null where none follows."""
    pattern = F.lit(rf"\b([A-Z]{{2,6}}) (?:was|of|at) ({NUMBER})(?: ?([a-zA-Z%]+(?:/[a-zA-Z]+)?))?")
    part = lambda g: F.regexp_extract_all(text, pattern, F.lit(g))
    hits = docs.select(F.explode(F.arrays_zip(part(1).alias("field"), part(2).alias("value"), part(3).alias("unit"))).alias("h"))
    by_unit = hits.groupBy("h.field", F.nullif("h.unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"), F.sum(F.col("h.value").cast("double")).alias("sum"))
    best = F.min(F.when(F.col("unit").isNotNull(), F.struct((-F.col("n")).alias("less"), "unit")))
    return by_unit.groupBy("field").agg(F.sum("n").alias("n"), F.round(F.sum("sum") / F.sum("n"), 6).alias("mean"), best["unit"].alias("unit")).where(F.col("n") >= least)


def field_aliases(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """field, alias, n of "full name (ABBR)" statements, names in lower case."""
    pattern = F.lit(r"([A-Za-z]+(?: [a-z]+){0,3}) \(([A-Z][A-Z-]{1,6})\)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(2)).alias("field"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("alias"))
    return docs.select(F.explode(pairs).alias("h")).groupBy("h.field", F.lower("h.alias").alias("alias")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def knowledge_fields(text: Column) -> Column:
    """name, type, description of "- **Name (type):** description" lines, as an array."""
    p = r"(?m)^[-*] \*\*([^(*\n]+?)(?: \(([^)\n]*)\))?:\*\* *([^\n]*)"
    part = lambda g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    return F.arrays_zip(part(1).alias("name"), part(2).alias("type"), part(3).alias("description"))


def chunks(docs: DataFrame, chars: int, parts: int | None, text: str = "text", least: int = 1, separator: str = r"\n\s*\n") -> DataFrame:
    """doc_id, chunk, chars, parts: paragraphs of at least least characters packed in order, a new chunk when characters or parts would pass their limits.

    With a separator of headings it packs sections.
    """
    pieces = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return _packed(docs, pieces, lambda x: F.length(x), chars, parts).select("doc_id", F.col("unit").alias("chunk"), F.col("total").alias("chars"), "parts")


def stratified_sample(parts: DataFrame, text: str, order: str, spaced: int = 5) -> DataFrame:
    """The shortest, the longest, the median and evenly spaced parts; the sample is what is asked for."""
    n = parts.count()
    if not n:
        return parts
    counts = parts.groupBy(F.length(text).alias("len")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rows = sorted((r["len"], r["n"], r["first"]) for r in counts.where("len is not null").collect())
    middle, seen = rows[-1][2], 0
    for _, k, first in rows:
        seen += k
        if 2 * seen >= n:
            middle = first
            break
    low, high = parts.agg(F.min(order), F.max(order)).first()
    step = max(1, (high - low + 1) // spaced)
    wanted = {rows[0][2], rows[-1][2], middle} | {low + i * step for i in range(spaced)}
    return parts.where(F.col(order).isin(*wanted))


def known_value(c: Column, values: list[str]) -> Column:
    """The known value a text mentions most often, the longer one on ties; for a few dozen values."""
    t = F.lower(c)
    count = lambda v: F.size(F.split(t, F.lit(rf"\Q{v.lower()}\E"))) - 1
    found = F.filter(F.array(*(F.struct((-count(v)).alias("less"), F.lit(-len(v)).alias("len"), F.lit(v).alias("v")) for v in values)), lambda x: x["less"] < 0)
    return F.array_min(found)["v"]


def canonical_values(df: DataFrame, column: str, least: int = 2, longest: int = 30) -> DataFrame:
    """value, canonical: verbose values that begin with or end in a short value seen least times or more stand for it.

    Short values have at most longest characters; they are compared by their words' first and last, in equi-joins.
    """
    counts = df.where(F.trim(column) != "").groupBy(F.lower(F.trim(column)).alias("value")).agg(F.count("*").alias("n"))
    short = counts.where((F.col("n") >= least) & (F.length("value") <= longest)).select(F.col("value").alias("canonical"))
    # No form longer than the limit is made: a short value of longest characters has at most half as many words.
    words = F.split("value", r"\s+")
    reach = F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest // 2 + 1)))
    heads = F.filter(F.transform(reach, lambda i: F.array_join(F.slice(words, F.lit(1), i), " ")), lambda x: F.length(x) <= longest)
    tails = F.filter(F.transform(reach, lambda i: F.array_join(F.slice(words, F.size(words) - i + 1, i), " ")), lambda x: F.length(x) <= longest)
    forms = counts.select("value", F.explode(F.array_distinct(F.concat(heads, tails))).alias("canonical")).where("canonical <> value")
    return forms.join(short, "canonical").groupBy("value").agg(F.min_by("canonical", F.struct(F.length("canonical"), "canonical")).alias("canonical"))


def normalise_date_column(df: DataFrame, column: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """A column of prose dates as ISO text, if at least half of three values or more are such dates; a month without day counts as its first."""
    months = "|".join(MONTHS)
    month_only = F.when(F.lower(F.trim(column)).rlike(rf"^(?:{months}) [0-9]{{4}}$"), F.concat(F.regexp_replace(F.trim(column), " ", " 1, ")))
    day = F.coalesce(prose_date(F.col(column)), prose_date(month_only))
    row = df.agg(F.count(column).alias("n"), F.count(day).alias("d")).first()
    if row["n"] < least or row["d"] < share * row["n"]:
        return df
    return df.withColumn(column, F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.col(column)))
