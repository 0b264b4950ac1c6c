"""References to records that do not exist, found with bitmaps per key range and period.

Keys become integers: numeric keys are their own code, text keys get codes from
a dictionary of the parent keys. Codes are grouped in ranges of 64 and times in
calendar months; a range of one month is a 64-bit map, and only non-empty maps
are kept, which is the compression. A month's references AND-NOT the parents
that are there during the whole month leave the suspects; only these are decoded
and held against the exact times.

The maps are built with partial aggregation, so a key that holds a third of all
references costs one bit per input partition, range and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.keys import PLAIN_NUMBER, entity_number, is_known, stripped
from tamarack.session import BROADCAST_ROWS, load, materialise

ALWAYS, NEVER = -(2**31), 2**31 - 1


def month_number(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def key_dictionary(parents: DataFrame) -> DataFrame:
    """Codes of the text keys: negative, dense within ranges of sorted keys. Written once, as two readers must agree."""
    keys = parents.where("number is null and key is not null").select("parent", "key").distinct()
    ranged = keys.repartitionByRange("parent", "key").sortWithinPartitions("parent", "key")
    return materialise(ranged.select("parent", "key", (-1 - F.monotonically_increasing_id()).alias("code")))


def encode(df: DataFrame, dictionary: DataFrame, small: bool) -> DataFrame:
    """Adds code: the key's number, or its place in the dictionary, null when it has none.

    A small dictionary is broadcast and met in the same pass; with a large one
    only the text keys go through a shuffle join.
    """
    text = F.when(F.col("number").isNull(), F.col("key"))
    if small:
        met = df.withColumn("text", text).join(F.broadcast(dictionary.select("parent", F.col("key").alias("text"), F.col("code").alias("place"))), ["parent", "text"], "left")
        return met.withColumn("code", F.coalesce("number", "place")).drop("text", "place")
    numeric = df.where("number is not null").withColumn("code", F.col("number"))
    texts = df.where("number is null").join(dictionary, ["parent", "key"], "left")
    return numeric.unionByName(texts.select(*numeric.columns))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference that does not hold at its time, with the reason.

    references: from_table, row_id, col_name, parent, key, number, at.
    parents: parent, key, number, loaded_at, deleted_at.
    key is the canonical text of a key, number its integer form or null.
    Result: from_table, row_id, col_name, parent, at, reason (missing, deleted, late).

    Nulls: a reference without key is none and must not be passed; a parent
    without loaded_at was always there; a reference without time is judged after
    everything. Repeated parent rows are versions of one record; repeated
    references each get a row. Empty parents make every reference missing.
    """
    parents = parents.where("key is not null").select("parent", "key", "number", "loaded_at", "deleted_at").distinct()
    dictionary = key_dictionary(parents)
    small = dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    refs = encode(references.withColumn("month", F.coalesce(month_number(F.col("at")), F.lit(NEVER))), dictionary, small)
    kept = encode(parents, dictionary, small).select("parent", "code", "loaded_at", "deleted_at")

    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    word = F.expr("shiftright(code, 6)").alias("word")
    since = F.when(F.col("loaded_at").isNull(), F.lit(ALWAYS)).otherwise(month_number(F.col("loaded_at")) + 1)
    empty = F.lit(0).cast("bigint")
    asked = refs.where("code is not null").select("parent", word, "month", bit.alias("asked"), empty.alias("lasting"), empty.alias("passing"))
    lasting = kept.where("deleted_at is null").select("parent", word, since.alias("month"), empty.alias("asked"), bit.alias("lasting"), empty.alias("passing"))
    ended = kept.where("deleted_at is not null and loaded_at is not null").withColumn("first", since).withColumn("last", month_number(F.col("deleted_at")) - 1).where("first <= last")
    passing = ended.select("parent", "code", F.explode(F.sequence("first", "last")).alias("month")).select("parent", word, "month", empty.alias("asked"), empty.alias("lasting"), bit.alias("passing"))
    maps = asked.unionByName(lasting).unionByName(passing).groupBy("parent", "word", "month").agg(*(F.bit_or(c).alias(c) for c in ("asked", "lasting", "passing")))
    so_far = Window.partitionBy("parent", "word").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    left = maps.withColumn("left", F.col("asked").bitwiseAND(F.bitwise_not(F.bit_or("lasting").over(so_far).bitwiseOR(F.col("passing"))))).where("left != 0")
    bits = F.expr("filter(sequence(0, 63), i -> shiftright(left, i) & 1 = 1)")
    suspects = left.select("parent", "word", "month", F.explode(bits).alias("i")).select("parent", (F.col("word") * 64 + F.col("i")).alias("code"), "month")

    open_refs = refs.join(suspects, ["parent", "code", "month"]).select("from_table", "row_id", "col_name", "parent", "at", "code")
    ends = F.coalesce(F.col("deleted_at"), F.lit("9999-12-31").cast("timestamp_ntz"))
    starts = F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    versions = kept.groupBy("parent", "code", starts.alias("starts")).agg(F.max(ends).alias("ends"))
    now = F.coalesce(F.col("at"), F.lit("9999-12-30").cast("timestamp_ntz"))
    there = F.col("starts") <= now
    judged = (
        open_refs.join(versions, ["parent", "code"], "left")
        .groupBy("from_table", "row_id", "col_name", "parent", "at")
        .agg(F.max(there & (F.col("ends") > now)).alias("holds"), F.max(there).alias("was_there"))
        .where("not coalesce(holds, false)")
        .withColumn("reason", F.when(F.col("was_there").isNull(), "missing").when(F.col("was_there"), "deleted").otherwise("late"))
    )
    columns = ["from_table", "row_id", "col_name", "parent", "at", "reason"]
    unknown = refs.where("code is null").withColumn("reason", F.lit("missing"))
    return judged.select(*columns).unionByName(unknown.select(*columns))


#: Parents with numeric keys, and the words that may stand before their numbers.
NUMERIC_PARENTS = {"patient": "pt|patient", "laboratory": "lab|laboratory"}


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    """Adds key and number by the parent: "LAB-12" is a number among results but not among patients. Text keys keep their case, numbers their digits."""
    numeric = F.col("parent").isin(*NUMERIC_PARENTS)
    cleaned = F.coalesce(*(F.when(F.col("parent") == p, entity_number(key, words)) for p, words in NUMERIC_PARENTS.items()))
    digits = F.when(numeric & key.rlike(PLAIN_NUMBER), key).when(numeric, cleaned)
    return df.withColumn("key", F.coalesce(digits, stripped(key))).withColumn("number", digits.cast("bigint"))


def domain_references(patient: DataFrame, laboratory: DataFrame, relationships: DataFrame, club_event: DataFrame, column_info: DataFrame, foreign_key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of the domain tables and the parents they name, for orphan_references()."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    no_time = F.lit(None).cast("timestamp_ntz")
    declared = F.lit("column_info.in_table")

    lab_refs = laboratory.where(is_known(F.col("id"))).select(F.lit("laboratory").alias("from_table"), F.col("lab_id").alias("row_id"), F.lit("id").alias("col_name"), F.lit("patient").alias("parent"), F.col("id").alias("raw"), ntz("loaded_at").alias("at"))
    sides = F.explode(
        F.array(
            *(F.struct(F.lit(f"{side}_id").alias("col_name"), F.lower(stripped(F.col(f"{side}_type"))).alias("parent"), F.col(f"{side}_id").alias("raw")) for side in ("source", "target"))
        )
    )
    edge_refs = (
        relationships.select(F.col("rel_id"), ntz("loaded_at").alias("at"), sides.alias("s"))
        .where(is_known(F.col("s.raw")) & is_known(F.col("s.parent")))
        .select(F.lit("relationships").alias("from_table"), F.col("rel_id").alias("row_id"), "s.col_name", "s.parent", "s.raw", "at")
    )
    fk_refs = foreign_key.where(is_known(F.col("ref_table"))).select(F.lit("foreign_key").alias("from_table"), F.col("fk_id").alias("row_id"), F.lit("ref_table").alias("col_name"), declared.alias("parent"), F.lower("ref_table").alias("raw"), ntz("loaded_at").alias("at"))
    references = lab_refs.unionByName(edge_refs).unionByName(fk_refs)
    references = _keyed(references, F.col("raw")).drop("raw")

    people = patient.where(is_known(F.col("id"))).select(F.lit("patient").alias("parent"), F.col("id").alias("raw"), ntz("loaded_at").alias("loaded_at"), ntz("deleted_at").alias("deleted_at"))
    labs = laboratory.select(F.lit("laboratory").alias("parent"), F.col("lab_id").cast("string").alias("raw"), ntz("loaded_at").alias("loaded_at"), no_time.alias("deleted_at"))
    events = club_event.where(is_known(F.col("event_id"))).select(F.lit("club_event").alias("parent"), F.col("event_id").alias("raw"), ntz("loaded_at").alias("loaded_at"), ntz("deleted_at").alias("deleted_at"))
    tables = column_info.where(is_known(F.col("in_table"))).select(declared.alias("parent"), F.lower("in_table").alias("raw"), no_time.alias("loaded_at"), no_time.alias("deleted_at"))
    parents = people.unionByName(labs).unionByName(events).unionByName(tables)
    return references, _keyed(parents, F.col("raw")).drop("raw")


def orphans_of(spark, sf_dir: str) -> DataFrame:
    tables = (load(spark, sf_dir, t) for t in ("patient", "laboratory", "relationships", "club_event", "column_info", "foreign_key"))
    return orphan_references(*domain_references(*tables))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, column, month of loading and reason."""
    return orphans.groupBy("from_table", "col_name", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"))
