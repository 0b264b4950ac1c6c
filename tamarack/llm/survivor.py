"""The best representative of each group of duplicate records.

Two results come from the same groups:

surviving_values() names the row whose value survives under a stated total
order of preference. An order that leaves no ties decides alone: no vote could
change it, so none is held, and a group is one combinable aggregate.

consensus_values() builds a record. The distinct values a group holds for one
quantity, in the common unit, are aligned token by token to the group's
preferred value; each column of the alignment is decided by votes weighted by
the tier of the rows (clear, confidence, correction, but neither time nor row
number), and the existing value closest to the consensus is taken. Three rows
of one tier that agree outvote a later one that does not.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.keys import entity_number, is_known, stripped
from tamarack.operators.units import canonical_values
from tamarack.session import load, materialise, spread

GROUP = ("entity", "record", "quantity")
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")


def align(a: list[str | None], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of a least-cost alignment of two token sequences (gap 1, mismatch 1)."""
    n, m = len(a), len(b)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    pairs, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            pairs.append((i, None))
        else:
            j -= 1
            pairs.append((None, j))
    return pairs[::-1]


def slots(head: str, text: str) -> list[str]:
    """The tokens of a text as "slot token", slots being places in the alignment to a head: "3" its third token, "3+2" the second one put in behind it."""
    out, place, put_in = [], -1, 0
    tokens = _TOKEN.findall(text)
    for i, j in align(_TOKEN.findall(head), tokens):
        if i is None:
            put_in += 1
            out.append(f"{place}+{put_in} {tokens[j]}")
        else:
            place, put_in = i, 0
            if j is not None:
                out.append(f"{place} {tokens[j]}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def slots_of(head: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([slots(h, t) for h, t in zip(head, text, strict=True)])


def with_record(records: DataFrame) -> DataFrame:
    """Adds entity and record: what a record id means, however it is written.

    The id is a number, or a number and a day or month behind "_", given as ISO
    date, with slashes, compact or in English words. An id in an unforeseen form
    stands for itself. Rows whose entity or id is null, blank or a word for an
    unknown value are left out: nothing shows that two such rows hold the same
    record.
    """
    known = records.where(is_known(F.col("entity_type")) & is_known(F.col("record_id")))
    parts = known.withColumn("entity", F.lower(stripped(F.col("entity_type")))).withColumn("parts", F.split(stripped(F.col("record_id")), r"\s*_\s*", 2))
    head = parts.withColumn("head", entity_number(F.col("parts")[0])).withColumn("tail", F.initcap(F.translate(F.try_element_at("parts", F.lit(2)), "/.", "--")))
    dated = head.withColumn("date", F.coalesce(*(F.try_to_date("tail", f) for f in ("yyyy-M-d", "yyyyMMdd", "d MMMM yyyy", "MMMM d, yyyy", "yyyyMM", "yyyy-M", "MMMM yyyy"))))
    own = F.lower(F.array_join("parts", "_"))
    record = F.when(F.col("tail").isNull(), F.coalesce("head", own)).when(F.col("date").isNull(), own).otherwise(F.coalesce(F.concat_ws("|", "head", "date"), own))
    return dated.withColumn("record", record).drop("parts", "head", "tail", "date")


def grouped_values(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Every value of every record held by two or more rows: entity, record, quantity, row_id, col_name, raw, value, unit, common, weight, order.

    records: row_id, record_id, entity_type, source_table, fields_json,
    ambiguous_fields, extracted_at; columns: in_table, col_name, description.
    order sorts the preferred value first: its column not ambiguous in its row,
    higher confidence, a correction, later extraction (null is earliest),
    smaller row_id. weight is the tier alone: three times for clear columns, as
    much more for each step of confidence, twice for corrections. Null
    confidence is the lowest, null flags are false. Rows without an entity or
    record id belong to no group.
    """
    rows = with_record(records.select("row_id", "record_id", "entity_type", "source_table", "fields_json", "ambiguous_fields", F.col("extracted_at").cast("timestamp").alias("extracted_at"))).drop("record_id", "entity_type")
    held = rows.groupBy("entity", "record").agg(F.count("*").alias("rows")).where("rows > 1").select("entity", "record")
    confidence = F.coalesce(F.element_at(F.create_map(F.lit("high"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("low"), F.lit(1)), F.lower(F.trim("confidence"))), F.lit(0))
    ambiguous = F.coalesce(F.array_contains("ambiguous_fields", F.col("col_name")), F.lit(False)).cast("int")
    correction = F.coalesce(F.col("is_correction"), F.lit(False)).cast("int")
    order = F.struct(ambiguous.alias("ambiguous"), (-confidence).alias("confidence"), (-correction).alias("correction"), (-F.coalesce(F.unix_micros("extracted_at"), F.lit(-(2**62)))).alias("at"), "row_id", "col_name")
    weight = (3 - 2 * ambiguous) * (1 + confidence) * (1 + correction)
    values = canonical_values(rows, columns).withColumn("order", order).withColumn("weight", weight)
    return values.select(*GROUP, "row_id", "col_name", "raw", "value", "unit", "common", "weight", "order").join(held, ["entity", "record"], "left_semi")


def surviving_values(values: DataFrame, *kept: str) -> DataFrame:
    """entity, record, quantity and the kept columns (all by default) of the first value of each group in the stated order.

    values: as of grouped_values(). One aggregate that combines map-side: a
    record that holds a third of all rows sends one value per task. Groups
    without any value of a quantity give no row for it.
    """
    kept = kept or ("row_id", "raw", "value", "unit", "common")
    best = values.groupBy(*GROUP).agg(F.min_by(F.struct(*kept), "order").alias("best"))
    return best.select(*GROUP, *(F.col("best")[c].alias(c) for c in kept))


def consensus_values(values: DataFrame, places: int = 4) -> DataFrame:
    """entity, record, quantity, value, votes, voters of every group: the existing value closest to the token consensus.

    values: as of grouped_values(). Values count as equal when they agree to
    places decimals in the common unit. votes is the weight of the rows that
    hold the value taken, voters of all. A column of the alignment goes to the
    token of most weight, ties to the greater one; the distance of a value is
    the number of columns in which it differs, ties go to the preferred one.
    Nothing is collected per group but its columns, which the length of a value bounds.
    """
    text = F.round("value", places).cast("string")
    texts = materialise(values.where("value is not null").groupBy(*GROUP, text.alias("text")).agg(F.sum("weight").alias("weight"), F.min("order").alias("order")))
    heads = texts.groupBy(*GROUP).agg(F.min_by("text", "order").alias("head"), F.sum("weight").alias("voters"), F.count("*").alias("texts"))
    single = heads.where("texts = 1").select(*GROUP, F.col("head").alias("text"), F.col("voters").alias("votes"), "voters")
    several = texts.join(heads.where("texts > 1"), list(GROUP))
    aligned = materialise(several.withColumn("slots", slots_of("head", "text")).drop("texts", "head"))
    cast = aligned.select(*GROUP, "voters", "weight", F.explode("slots").alias("slot")).groupBy(*GROUP, "slot").agg(F.sum("weight").alias("votes"), F.first("voters").alias("voters"))
    column = F.substring_index("slot", " ", 1)
    won = cast.groupBy(*GROUP, column.alias("column")).agg(F.max(F.struct("votes", "slot")).alias("best"), F.sum("votes").alias("all"), F.first("voters").alias("voters"))
    # Who has no token in a column votes for none there.
    consensus = won.where(F.col("best.votes") >= F.col("voters") - F.col("all")).groupBy(*GROUP).agg(F.collect_list("best.slot").alias("consensus"))
    met = aligned.join(consensus, list(GROUP), "left").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<string>")))
    columns_off = F.size(F.array_distinct(F.transform(F.concat(F.array_except("slots", "consensus"), F.array_except("consensus", "slots")), lambda s: F.substring_index(s, " ", 1))))
    best = met.groupBy(*GROUP).agg(F.min_by(F.struct("text", "weight", "voters"), F.struct(columns_off.alias("off"), "order")).alias("best"))
    taken = single.unionByName(best.select(*GROUP, "best.text", F.col("best.weight").alias("votes"), "best.voters"))
    return taken.select(*GROUP, F.col("text").cast("double").alias("value"), "votes", "voters")


def values_of(spark, sf_dir: str) -> DataFrame:
    return grouped_values(spread(load(spark, sf_dir, "extracted_record")), load(spark, sf_dir, "column_info"))


def survivors_of(spark, sf_dir: str) -> DataFrame:
    return surviving_values(values_of(spark, sf_dir), "row_id")


def built_records(consensus: DataFrame) -> DataFrame:
    """One row per record: the consensus values by quantity, in the common units."""
    return consensus.groupBy("entity", "record").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("quantity", "value")))).alias("fields"))
