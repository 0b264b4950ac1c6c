"""What must hold of the training-text results, computed from them, beside DuckDB statements that compute it from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import leakage, mixing, packing, pairs, splitting
from tamarack.session import load

CAPACITY = 3000
_MOST = CAPACITY * packing.CHARS_PER_TOKEN + packing.CHARS_PER_TOKEN - 1


def packing_fit(spark, d: str) -> DataFrame:
    """pieces, tokens, repeated, overfull, over_least: what was placed, pieces placed twice, requests above the capacity, requests beyond the fewest possible."""
    placed, totals = packing.pack(load(spark, d, "paragraph_unit"), CAPACITY)
    full = placed.groupBy("request_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    twice = placed.groupBy("unit_id", "piece").agg(F.count("*").alias("n")).where("n > 1").count()
    sums = full.agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > CAPACITY).alias("overfull"), (F.count("*") - F.lit(totals["least"])).alias("over_least"))
    return sums.select("pieces", "tokens", F.lit(twice).alias("repeated"), "overfull", "over_least")


PACKING_FIT = f"""WITH u AS (SELECT coalesce(length(text), 0) AS n FROM paragraph_unit), p AS (SELECT n, unnest(range(CAST(greatest(ceil(n / {_MOST}), 1) AS BIGINT))) AS k FROM u)
SELECT count(*) AS pieces, CAST(sum(least({_MOST}, n - k * {_MOST}) // 4) AS BIGINT) AS tokens, 0 AS repeated, 0 AS overfull, 0 AS over_least FROM p"""


def packing_summary(spark, d: str) -> DataFrame:
    """p4_summary without what only the packing knows."""
    return packing.summary_of(spark, d).select("tokens", "units", "least_requests", (F.col("fullest") <= CAPACITY).alias("fits"))


PACKING_SUMMARY = PACKING_FIT.replace("count(*) AS pieces, ", "").replace("0 AS repeated, 0 AS overfull, 0 AS over_least", f"count(*) AS units, CAST(ceil(sum(least({_MOST}, n - k * {_MOST}) // 4) / {CAPACITY}) AS BIGINT) AS least_requests, true AS fits")


def rebuilt_units(spark, d: str) -> DataFrame:
    """unit_id, chars, digest, fits: each cut unit put together again from what its pieces do not repeat, and whether all pieces and overlaps keep their limits."""
    p = splitting.pieces_of(spark, d)
    own = F.substring("text", F.col("own_start") - F.col("start") + 1, F.col("end") - F.col("own_start"))
    fits = (F.floor(F.length("text") / 4) <= 1000) & (F.col("own_start") - F.col("start") <= 200)
    parts = p.groupBy("unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", own.alias("own")))), lambda x: x["own"]), "").alias("whole"), F.min(fits).alias("fits"))
    return parts.select("unit_id", F.length("whole").alias("chars"), F.md5("whole").alias("digest"), "fits")


REBUILT_UNITS = "SELECT unit_id, length(text) AS chars, md5(text) AS digest, true AS fits FROM extraction_unit WHERE length(text) // 4 > 1000"


def shares_met(spark, d: str) -> DataFrame:
    """source, target_share, met: whether a source gives its share of what the sources with documents are to give.

    Documents are not divided, so a source may be off by half a hundredth and one document, the largest drawn.
    """
    drawn = mixing.mix_of(spark, d)
    row = drawn.agg(F.max("tokens").alias("largest"), F.sum(F.col("tokens") * F.col("copies")).alias("all")).first()
    off = 0.005 + (row["largest"] / row["all"] if row["all"] else 0.0)
    r = mixing.share_report(drawn, load(spark, d, "mix_target"))
    held = F.sum(F.when(F.col("documents") > 0, F.col("target_share"))).over(mixing.Window.partitionBy())  # a row per source
    near = F.abs(F.col("actual_share") - F.col("target_share") / held) < off
    return r.select("source", "target_share", ((F.col("documents") > 0) & near & (F.col("most_copies") <= F.col("max_repeats"))).alias("met"))


SHARES_MET = r"""WITH d AS (SELECT DISTINCT trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS s FROM documents WHERE trim(text) <> '' AND source IS NOT NULL)
SELECT source, target_share, source IN (SELECT s FROM d) AS met FROM mix_target WHERE source IS NOT NULL"""

_RUN = r"[\p{L}\p{N}]+"


def exact_leaks(spark, d: str) -> DataFrame:
    """doc_id, item_id, found: pairs that share twelve words in a row, letter by letter, which at most two items have and with a word of which few items have any; whether the search reports them."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_RUN), F.lit(0))
    items, docs = load(spark, d, "eval_item").where("text is not null"), load(spark, d, "documents").where("text is not null")
    w = items.select("item_id", words(F.col("text")).alias("w"))
    users = w.select("item_id", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    few = max(2, items.count() // leakage.OWN_SHARE)
    runs = lambda df: df.where(F.size("w") >= leakage.WINDOW).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - leakage.WINDOW + 1))).withColumn("run", F.slice("w", F.col("k"), leakage.WINDOW))
    own = runs(w).select("item_id", "run").distinct()
    rare = own.select("run", F.explode("run").alias("word")).join(users.where(F.col("n") <= few), "word").select("run").distinct()
    lone = own.join(rare, "run").groupBy("run").agg(F.count_distinct("item_id").alias("items"), F.collect_set("item_id").alias("who")).where("items <= 2")
    met = runs(docs.select("doc_id", words(F.col("text")).alias("w"))).select("doc_id", F.array_join("run", " ").alias("run")).join(lone.select(F.array_join("run", " ").alias("run"), F.explode("who").alias("item_id")), "run").select("doc_id", "item_id").distinct()
    return met.join(leakage.leaks_of(spark, d).withColumn("found", F.lit(True)), ["doc_id", "item_id"], "left").select("doc_id", "item_id", F.coalesce("found", F.lit(False)).alias("found"))


EXACT_LEAKS = rf"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '{_RUN}') AS w FROM eval_item WHERE text IS NOT NULL), x AS (SELECT item_id, unnest(list_distinct(w)) AS word FROM w), few AS (SELECT word FROM x GROUP BY word HAVING count(*) <= greatest(2, (SELECT count(*) FROM w) // {leakage.OWN_SHARE})),
i AS (SELECT DISTINCT item_id, w[k:k + 11] AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12)), rare AS (SELECT DISTINCT run FROM (SELECT run, unnest(run) AS word FROM i) WHERE word IN (SELECT word FROM few)),
lone AS (SELECT run FROM i WHERE run IN (SELECT run FROM rare) GROUP BY run HAVING count(DISTINCT item_id) <= 2), t AS (SELECT item_id, array_to_string(run, ' ') AS run FROM i WHERE run IN (SELECT run FROM lone)),
d AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_RUN}') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id, true AS found FROM d JOIN t USING (run)"""


def plain_pairs(spark, d: str) -> DataFrame:
    """step_id, defect, found: defects that need no model: nothing but blanks or a word for nothing, and replies equal to the thought but for case, marks and spaces; whether they are reported."""
    s = load(spark, d, "step_record")
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    said, asked = F.trim(bare(F.col("raw_response"))), F.trim(bare(F.col("thought")))
    sure = s.select("step_id", F.when(said.isin("", "null", "none"), "empty").when((said == asked) & (F.length(asked) >= 20), "copy").alias("defect")).where("defect is not null")
    found = pairs.pairs_of(spark, d).withColumn("found", F.lit(True))
    return sure.join(found, ["step_id", "defect"], "left").select("step_id", "defect", F.coalesce("found", F.lit(False)).alias("found"))


PLAIN_PAIRS = r"""WITH s AS (SELECT step_id, trim(regexp_replace(lower(coalesce(raw_response, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS said, trim(regexp_replace(lower(coalesce(thought, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS asked FROM step_record)
SELECT step_id, CASE WHEN said IN ('', 'null', 'none') THEN 'empty' ELSE 'copy' END AS defect, true AS found FROM s WHERE said IN ('', 'null', 'none') OR (said = asked AND length(asked) >= 20)"""

QUERIES = {"p4_fit": packing_fit, "p4_totals": packing_summary, "p5_rebuilt": rebuilt_units, "p8_met": shares_met, "p7_exact": exact_leaks, "p2_plain": plain_pairs}
ORACLE = {"p4_fit": PACKING_FIT, "p4_totals": PACKING_SUMMARY, "p5_rebuilt": REBUILT_UNITS, "p8_met": SHARES_MET, "p7_exact": EXACT_LEAKS, "p2_plain": PLAIN_PAIRS}
