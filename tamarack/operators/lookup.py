"""Finding values and keys: where a value occurs, what a failed filter may have meant, names resolved to keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.profile import is_text
from tamarack.session import broadcast_if_small, spread

#: The shortest value that is looked for in documents.
LEAST_CHARS = 5


def term_matches(column: str, terms: list[str]) -> bool:
    """Equal, contained either way, or sharing a prefix of three fifths of the shorter word (three letters at least)."""
    name = column.lower()
    for t in (t.lower() for t in terms if t):
        if t == name or t in name or name in t:
            return True
        shared = next((i for i, (a, b) in enumerate(zip(t, name, strict=False)) if a != b), min(len(t), len(name)))
        if shared >= 3 and shared >= 0.6 * min(len(t), len(name)):
            return True
    return False


def token_overlap(a: str, b: str) -> float:
    """Shared words over the words of the smaller text."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def overlap_with(c: Column, text: str) -> Column:
    """token_overlap() of a column with a text; null and blank texts share nothing."""
    wanted = sorted(set(text.lower().split()))
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")), lambda w: w != "")
    shared = F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in wanted)))) if wanted else F.lit(0)
    return F.when(F.size(words) > 0, shared / F.least(F.size(words), F.lit(max(1, len(wanted))))).otherwise(0.0)


def find_value(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """table_name, column_name, exact, partial: rows of text columns equal to a value or holding it, case aside; one pass per table."""
    out = []
    for t, df in tables.items():
        texts = [c for c in df.columns if is_text(df, c)]
        if not texts:
            continue
        low = value.lower()
        row = df.agg(*(F.struct(F.count_if(F.lower(c) == low).alias("exact"), F.count_if(F.contains(F.lower(c), F.lit(low))).alias("partial")).alias(c) for c in texts))
        x = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in texts))).alias("x"))
        out.append(x.select(F.lit(t).alias("table_name"), "x.column_name", "x.n.exact", "x.n.partial").where("partial > 0"))
    if not out:
        raise ValueError("no table has text columns")
    return reduce(DataFrame.unionByName, out)


def map_value(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """find_value() with how it matched, best first."""
    found = find_value(tables, value)
    method = F.when(F.col("exact") > 0, "exact").otherwise("like")
    return found.select("table_name", "column_name", method.alias("method"), F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("partial")).alias("n")).orderBy(F.asc("method"), F.desc("n"), "table_name", "column_name")


def empty_filter_hints(df: DataFrame, column: str, value: str, most: int = 10) -> DataFrame:
    """candidate, reason, n: stored values that an equality with no rows may have meant.

    Reasons: case (differs in letter case or outer spaces), part (equal to a
    part of the value between : . - / and blanks, zeros stripped), prefix.
    """
    parts = sorted({p.lstrip("0").lower() for p in re.split(r"[:.\-/\s]+", value) if p.lstrip("0")})
    c = F.col(column).cast("string")
    bare = F.lower(F.regexp_replace(F.trim(c), "^0+", ""))
    reason = F.when(F.lower(F.trim(c)) == value.strip().lower(), "case").when(bare.isin(*parts) if parts else F.lit(False), "part").when(F.startswith(F.lower(c), F.lit(value[: max(3, len(value) // 2)].lower())), "prefix")
    counts = df.where(c.isNotNull() & (c != value)).groupBy(c.alias("candidate"), reason.alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")
    return counts.orderBy("reason", F.desc("n"), "candidate").limit(most)


def compare_columns(a: DataFrame, b: DataFrame, column: str, most: int = 8) -> DataFrame:
    """side, samples, empty_share of a column two tables have: the smallest distinct filled values and the share of blanks."""
    rows = []
    for side, df in (("left", a), ("right", b)):
        c = F.col(column).cast("string")
        blank = df.agg(F.round(F.avg(F.when(c.isNull() | (F.trim(c) == ""), 1.0).otherwise(0.0)), 6)).first()[0]
        smallest = df.where(c.isNotNull() & (F.trim(c) != "")).select(c.alias("v")).distinct().orderBy("v").limit(most).collect()
        rows.append((side, "|".join(r["v"] for r in smallest), blank))
    return a.sparkSession.createDataFrame(rows, "side string, samples string, empty_share double")


def resolve_keys(df: DataFrame, column: str, lookup: DataFrame, key: str, name: str) -> DataFrame:
    """Adds <column>_key: the key a text stands for, as the key itself or by its exact name, case aside.

    Two equi-joins; texts that only contain a name are left to resolve_contained().
    """
    text = F.lower(F.trim(F.col(column)))
    keys = lookup.select(F.lower(F.col(key).cast("string")).alias("__t"), F.col(key).alias("__k")).where("__t is not null").groupBy("__t").agg(F.min("__k").alias("__by_key"))
    names = lookup.select(F.lower(F.trim(F.col(name))).alias("__t"), F.col(key).alias("__k")).where("__t is not null and __t <> ''").groupBy("__t").agg(F.min("__k").alias("__by_name"))
    return df.withColumn("__t", text).join(keys, "__t", "left").join(names, "__t", "left").withColumn(f"{column}_key", F.coalesce("__by_key", "__by_name")).drop("__t", "__by_key", "__by_name")


def resolve_contained(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Adds <column>_key: the key of the longest name a text contains whole, case aside; ties go to the smaller name.

    names: key, name, any number of them. Names and texts meet by the runs of
    words they have: a join on equality, of which the longest run is bounded by
    the longest name. Texts that contain no name get null.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = names.select(F.array_join(words(F.col("name")), " ").alias("__run"), F.size(words(F.col("name"))).alias("__n"), F.col("key").cast("string").alias("__k")).where("__run <> '' and __k is not null")
    known = known.groupBy("__run", "__n").agg(F.min("__k").alias("__k"))
    longest = known.agg(F.max("__n")).first()[0] or 0
    if not longest:
        return df.withColumn(f"{column}_key", F.lit(None).cast("string"))
    texts = df.select(F.col(column).alias("__t")).where("__t is not null").distinct().withColumn("__w", words(F.col("__t")))
    starts = F.sequence(F.lit(1), F.size("__w"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("__w") - i + 1)), lambda n: F.array_join(F.slice("__w", i, n), " "))))
    met = texts.where(F.size("__w") > 0).select("__t", F.explode(F.array_distinct(runs)).alias("__run")).join(known, "__run")
    best = met.groupBy("__t").agg(F.min(F.struct((-F.length("__run")).alias("less"), "__run", "__k"))["__k"].alias(f"{column}_key"))
    return df.withColumn("__t", F.col(column)).join(best, "__t", "left").drop("__t")


def ambiguous_columns(columns: DataFrame) -> DataFrame:
    """column_name, tables, n of names that several tables have: unqualified use of them is ambiguous."""
    return columns.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("tables"), F.count_distinct("table_name").alias("n")).where("n > 1")


def ambiguous_joins(edges: DataFrame) -> DataFrame:
    """left_table, right_table, ways of table pairs with more than one direct foreign key or two-step path."""
    both = edges.select(F.col("source_table").alias("a"), F.col("target_table").alias("b")).unionByName(edges.select(F.col("target_table").alias("a"), F.col("source_table").alias("b")))
    direct = both.where("a < b").groupBy("a", "b").agg(F.count("*").alias("ways"))
    two = both.alias("x").join(both.alias("y"), F.col("x.b") == F.col("y.a")).where("x.a < y.b").groupBy(F.col("x.a").alias("a"), F.col("y.b").alias("b")).agg(F.count("*").alias("ways"))
    return direct.unionByName(two).groupBy("a", "b").agg(F.sum("ways").alias("ways")).where("ways > 1").select(F.col("a").alias("left_table"), F.col("b").alias("right_table"), "ways")


def mentioned_values(result: DataFrame, column: str, docs: DataFrame, most: int = 500) -> DataFrame:
    """value, documents: result values of 5 to 50 characters that documents mention, case aside; numbers are no values.

    Up to most values go to the documents as literals; more are joined. docs: doc_id, text.
    """
    c = F.col(column).cast("string")
    values = result.select(c.alias("value")).where(F.length("value").between(LEAST_CHARS, 50) & ~F.rlike("value", F.lit(r"(?U)\A[-\d.,\s]+\z"))).distinct()
    few = [r[0] for r in values.limit(most + 1).collect()]
    if not few:
        return docs.sparkSession.createDataFrame([], "value string, documents bigint")
    if len(few) > most:
        return _joined_mentions(values, docs)
    hits = F.filter(F.array(*(F.when(F.contains(F.lower("text"), F.lit(v.lower())), F.lit(v)) for v in sorted(few))), lambda x: x.isNotNull())
    return docs.where("text is not null").select(F.explode(hits).alias("value")).groupBy("value").agg(F.count("*").alias("documents"))


def _joined_mentions(values: DataFrame, docs: DataFrame) -> DataFrame:
    """mentioned_values() of any number of values: each is joined by its first characters to the places of the texts that begin with them, and compared there."""
    lowered = values.select("value", F.lower("value").alias("low"))
    reach = lowered.agg(F.max(F.length("low"))).first()[0]
    keyed = broadcast_if_small(lowered.withColumn("start", F.substring("low", 1, LEAST_CHARS)))
    places = spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=(.{{{LEAST_CHARS},{reach}}}))"), 1)).alias("place"))
    found = places.withColumn("start", F.substring("place", 1, LEAST_CHARS)).join(keyed, "start").where(F.startswith("place", "low"))
    return found.select("value", "doc_id").distinct().groupBy("value").agg(F.count("*").alias("documents"))


def paragraph_hits(docs: DataFrame, question: str) -> DataFrame:
    """doc_id, place, hits of the paragraphs that hold any word of three letters or more of a question."""
    words = sorted({w for w in re.findall(r"\w{3,}", question.lower())})
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("place", "paragraph"))
    hits = reduce(lambda a, b: a + b, (F.when(F.contains(F.lower("paragraph"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return parts.select("doc_id", "place", hits.alias("hits")).where("hits > 0")


def paragraphs_for(docs: DataFrame, question: str, best: int = 5) -> DataFrame:
    """doc_id, place, hits of the paragraphs that hold most words of a question; ties by document and place."""
    return paragraph_hits(docs, question).orderBy(F.desc("hits"), "doc_id", "place").limit(best)


def alias_candidates(df: DataFrame) -> DataFrame:
    """column_name, distinct_values of text columns that aliases make sense for: 2 to 50 values, and not almost as many values as rows."""
    from tamarack.operators.profile import value_counts

    texts = [c for c in df.columns if is_text(df, c)]
    k = value_counts(df, texts).where("value is not null").groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("n"))
    return k.where((F.col("distinct_values").between(2, 50)) & ~((F.col("distinct_values") / F.col("n") > 0.8) & (F.col("distinct_values") > 20))).select("column_name", "distinct_values")


def semantic_type(name: str, kind: str, cardinality: float) -> str:
    """identifier, timestamp, free_text, measure or category, by name, type and share of distinct values."""
    low = name.lower()
    if re.search(r"(?:^|_)id$|id$|^link", low) or low in ("key", "code"):
        return "identifier"
    if kind.startswith(("timestamp", "date")) or re.search(r"date|time|year|month", low):
        return "timestamp"
    if kind == "string":
        return "free_text" if cardinality > 0.8 else "category"
    return "measure"


def best_paragraph_per_document(docs: DataFrame, question: str) -> DataFrame:
    """doc_id, place, hits: the first paragraph of each document among those with most hits; one aggregate, no order of the corpus."""
    best = paragraph_hits(docs, question).groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("place")).alias("less"))).alias("b"))
    return best.select("doc_id", (-F.col("b.less")).alias("place"), "b.hits")


def zero_row_hints(tables: dict[str, DataFrame], table: str, column: str, value: str, edges: list[tuple[str, str, str, str]] = (), most: int = 10) -> DataFrame:
    """kind, place, candidate, n: what an equality that kept no rows may have meant.

    elsewhere: columns of other tables that hold the value; case, part, prefix:
    stored values of the column (see empty_filter_hints()); sample: its
    commonest values where nothing else was found; related: name columns of the
    tables its table refers to. Hints are for people: most of each kind.
    """
    spark = tables[table].sparkSession
    place = f"{table}.{column}"
    there = find_value(tables, value).where((F.col("exact") > 0) & (F.concat_ws(".", "table_name", "column_name") != place))
    elsewhere = there.select(F.lit("elsewhere").alias("kind"), F.concat_ws(".", "table_name", "column_name").alias("place"), F.lit(value).alias("candidate"), F.col("exact").alias("n"))
    near = empty_filter_hints(tables[table], column, value, most).select(F.col("reason").alias("kind"), F.lit(place).alias("place"), "candidate", "n")
    c = F.col(column).cast("string")
    common = tables[table].where(c.isNotNull()).groupBy(c.alias("candidate")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "candidate").limit(most)
    sample = common.select(F.lit("sample").alias("kind"), F.lit(place).alias("place"), "candidate", "n")
    names = [(t, n) for a, _, t, _ in edges if a == table for n in tables[t].columns if re.search(r"name|title|label", n.lower())]
    related = spark.createDataFrame([("related", f"{t}.{n}", "", 0) for t, n in names], "kind string, place string, candidate string, n bigint")
    found = elsewhere.unionByName(near)
    return (sample if found.isEmpty() else found).unionByName(related)
