"""Quantities recorded in different units, brought to the common one.

Conversions are a graph of affine functions whose shortest compositions are
computed once; values meet them in an equi-join on quantity and source unit.
Reading values and units stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.keys import is_known
from tamarack.functions.quantities import COMMON_UNIT, column_meaning, conversion_table, unit_table
from tamarack.session import broadcast_if_small, load, materialise, spread

#: Columns that canonical_values() adds; such columns of its input are dropped.
ADDED = frozenset(("col_name", "field", "raw", "confidence", "is_correction", "number", "unit_text", "plain", "feet", "reading", "quantity", "col_unit", "spelling", "unit", "common", "guesses", "value", "a", "b"))

#: The values of one record, by column name.
FIELDS = T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("is_correction", T.BooleanType())]))


def conversions(spark) -> DataFrame:
    """quantity, unit, common, a, b, place, low, high: a few rows fixed by the graph."""
    return spark.createDataFrame(conversion_table(), "quantity string, unit string, common string, a double, b double, place int, low double, high double")


def spellings(spark) -> DataFrame:
    return spark.createDataFrame(unit_table(), "quantity string, spelling string, unit string")


def column_quantities(columns: DataFrame) -> DataFrame:
    """in_table, col_name, quantity, col_unit for the columns that hold a quantity.

    columns: in_table, col_name, description; repeated columns keep the least
    quantity and unit. A column of unknown meaning is left out.
    """
    meaning = F.udf(column_meaning, "quantity string, unit string")
    return (
        columns.select("in_table", "col_name", meaning("col_name", "description").alias("m"))
        .where("m.quantity is not null and in_table is not null and col_name is not null")
        .groupBy("in_table", "col_name")
        .agg(F.min("m.quantity").alias("quantity"), F.min("m.unit").alias("col_unit"))
    )


def _plain(value: Column) -> Column:
    """A value's text without spaces and decoration, the unit behind the number, in the form of SPELLINGS."""
    v = F.lower(value)
    v = F.translate(v, "µμ³⁹", "uu39")
    v = F.regexp_replace(v, r"10([39])/", r"10^$1/")
    v = F.regexp_replace(v, r"[\s\x{00a0}\x{200b}()\[\]]+", "")
    v = F.regexp_replace(v, r"^(?:about|was|approx\.?|circa|ca\.|roughly|around|~)+|(?:onarrival|approx\.?)$", "")
    return F.regexp_replace(v, r"^([^:]*[^0-9.,:+-][^:]*):([+-]?[0-9][0-9.,]*)$", "$2$1")


BARE = r"^[0-9]{1,15}(?:\.[0-9]{1,15})?$"
NUMBER = r"^([+-]?[0-9.,]*?[0-9])((?:[x*]?10\^[0-9]+)?(?:[^0-9.,+-].*)?)$"
FEET = r"^([0-9]+)(?:ft|foot|feet|')\.?([0-9]+(?:\.[0-9]+)?)(?:in|inch|inches|\"|'')?\.?$"


def number_of(text: Column) -> Column:
    """A decimal number with point or comma; groups of three after commas are thousands."""
    thousands = text.rlike(r"^[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$")
    european = text.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$")
    plain = F.when(thousands, F.replace(text, F.lit(","), F.lit(""))).when(european, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def raw_fields(records: DataFrame) -> DataFrame:
    """One row per field with a value: the record's columns but fields_json, and col_name, raw, confidence, is_correction."""
    kept = [c for c in records.columns if c != "fields_json"]
    rows = records.select(*kept, F.explode(F.from_json("fields_json", FIELDS)).alias("col_name", "field"))
    return rows.where(is_known(F.col("field.value"))).select(*kept, "col_name", F.col("field.value").alias("raw"), F.col("field.confidence").alias("confidence"), F.col("field.is_correction").alias("is_correction"))


def _reading(raw: Column) -> Column:
    """number and unit_text of a value. Bare decimals, the most of them, are cast; each step of the others is bound to a variable, so that it runs once."""

    def number(plain: Column) -> Column:
        feet = F.regexp_extract(plain, FEET, 1)
        whole = F.transform(F.array(F.regexp_extract(plain, NUMBER, 1)), lambda digits: F.struct(number_of(digits).alias("number"), F.regexp_extract(plain, NUMBER, 2).alias("unit_text")))[0]
        return F.when(feet != "", F.struct((feet.cast("double") + F.regexp_extract(plain, FEET, 2).cast("double") / 12).alias("number"), F.lit("ft").alias("unit_text"))).otherwise(whole)

    bare = F.struct(raw.try_cast("double").alias("number"), F.lit("").alias("unit_text"))
    return F.when(raw.rlike(BARE), bare).otherwise(F.transform(F.array(_plain(raw)), number)[0])


def read_numbers(rows: DataFrame) -> DataFrame:
    """Adds number and unit_text to rows with raw; rows without a number are left out.

    The reading passes through a generator: a filter on its result then stays
    behind it, and is not pushed below as a second reading.
    """
    read = rows.withColumn("reading", F.explode(F.array(_reading(F.col("raw"))))).where("reading.number is not null")
    return read.withColumns({"number": F.col("reading.number"), "unit_text": F.col("reading.unit_text")}).drop("reading")


def explode_fields(records: DataFrame) -> DataFrame:
    """One row per field that holds a number: the record's columns but fields_json, and col_name, raw, confidence, is_correction, number, unit_text.

    Fields that are null, blank, "not recorded" and the like, or without a
    number, are left out; text that is not JSON counts as no fields. Feet with
    inches become decimal feet.
    """
    return read_numbers(raw_fields(records))


def canonical_values(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Every value in the common unit of its quantity.

    records: row_id, source_table, fields_json; further columns are kept, except
    those named like an added one. columns: in_table, col_name, description.
    Adds col_name, raw, confidence, is_correction, number, quantity, unit,
    common, value. A unit given with the value counts before one in the
    column's name, that before its description; without any, the unit is the
    one that makes the value plausible, the common one first. Values of columns
    that hold no known quantity are left out.
    """
    spark = records.sparkSession
    values = raw_fields(records.drop(*(c for c in records.columns if c in ADDED)))
    # The listing lacks some columns: their names alone must tell what they hold.
    names = F.explode(F.json_object_keys("fields_json"))
    # Written before the meanings are asked for, so that they are asked of each name once and not of every field.
    seen = materialise(records.select(F.col("source_table").alias("in_table"), names.alias("col_name")).distinct())
    listed = columns.select("in_table", "col_name", "description")
    unlisted = seen.join(listed, ["in_table", "col_name"], "left_anti").withColumn("description", F.lit(None).cast("string"))
    # A few dozen names meet all values; as a shuffle join they would be a few dozen hot keys.
    meanings = broadcast_if_small(materialise(column_quantities(listed.unionByName(unlisted)).withColumnRenamed("in_table", "source_table")))
    units = conversions(spark)
    known = read_numbers(values.join(meanings, ["source_table", "col_name"]))
    spelling = F.regexp_replace("unit_text", r"\.$", "")
    known = known.withColumn("spelling", spelling).join(F.broadcast(spellings(spark)), ["quantity", "spelling"], "left").drop("spelling")
    # The units of a quantity, common first, to try a bare number against: four at most.
    guesses = units.where("place is not null").groupBy("quantity").agg(F.sort_array(F.collect_list(F.struct("place", "unit", "low", "high"))).alias("guesses"))
    fits = F.filter("guesses", lambda g: (F.col("number") >= g["low"]) & (F.col("number") <= g["high"]))
    near = F.array_min(F.transform("guesses", lambda g: F.struct(F.abs(F.log(F.greatest(F.col("number"), F.lit(1e-12)) / F.sqrt(g["low"] * g["high"]))).alias("off"), g["unit"].alias("unit"))))
    known = known.join(F.broadcast(guesses), "quantity").withColumn("unit", F.coalesce("unit", "col_unit", F.try_element_at(fits, F.lit(1))["unit"], near["unit"])).drop("guesses", "col_unit", "unit_text")
    factors = units.select("quantity", "unit", "common", "a", "b")
    return known.join(F.broadcast(factors), ["quantity", "unit"]).withColumn("value", F.col("a") * F.col("number") + F.col("b")).drop("a", "b")


def values_of(spark, sf_dir: str) -> DataFrame:
    records = spread(load(spark, sf_dir, "extracted_record").select("row_id", "source_table", "fields_json"))
    return canonical_values(records, load(spark, sf_dir, "column_info"))


def other_units(values: DataFrame) -> DataFrame:
    """The values recorded in another unit than the common one."""
    return values.where("unit <> common").select("row_id", "quantity")


def common_units() -> dict[str, str]:
    return dict(COMMON_UNIT)
