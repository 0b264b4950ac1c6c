"""Mixing sources to target weights.

Documents with a known source belong to it; for the others a classifier fitted
on all labelled documents gives the posterior of each source, and they belong
to the two most probable ones in parts: membership is soft, and nothing is
dropped for being uncertain. Projected-gradient least squares fits nonnegative
rates, capped by the repeats a source allows, whose expected token totals match
the targets. Documents of one membership have one gradient, so they keep one
rate: a descent over classes is the descent over documents, and what it needs
of them is one combinable aggregate. Rates become whole counts by systematic
sampling along the documents ordered by size.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.keys import is_known
from tamarack.llm.words import words
from tamarack.session import load, materialise, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word buckets of the source classifier.
BUCKETS = 4096
#: A document without source is shared out in so many equal parts; with two sources at most there are under S * S * PARTS * PARTS classes for S sources, whatever the number of documents.
PARTS = 16
#: Documents of about the same size (a twentieth of a factor e) are drawn in turn.
SIZE_STEPS = 20
#: Documents of one source and size that are put in order in one task, about; at least LEAST_BLOCKS tasks share them.
BLOCK_ROWS, LEAST_BLOCKS = 1_000_000, 32
MOST_ROUNDS, TOLERANCE = 2000, 1e-9


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The byte-level encoder of a public vocabulary file; built once per worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds tokens, the size of text in tokens, in place of text; null texts have none."""
    kept = [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema) + ", tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(vocabulary)
        for pdf in batches:
            yield pdf[kept].assign(tokens=[len(encoder.encode_ordinary(t)) if t else 0 for t in pdf["text"]])

    return documents.select(*kept, "text").mapInPandas(count, schema)


def source_name(c: Column) -> Column:
    """A source however it is spelled: lower case, runs of other characters as one underscore; null when not known."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(is_known(c) & (name != ""), name)


def _bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


def fit_sources(documents: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sources, log priors, log likelihoods) of a naive Bayes model counted over all labelled documents.

    documents: source (named or null), text. What reaches the driver is bounded
    by sources x BUCKETS.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple[str, int], int] = {}
            for source, text in zip(pdf["source"], pdf["text"], strict=True):
                for b in {_bucket(w) for w in words(text or "")} | {-1}:
                    seen[source, b] = seen.get((source, b), 0) + 1
            yield pd.DataFrame([(s, b, n) for (s, b), n in seen.items()], columns=["source", "bucket", "n"])

    rows = documents.where("source is not null").select("source", "text").mapInPandas(count, "source string, bucket int, n bigint").groupBy("source", "bucket").agg(F.sum("n").alias("n")).collect()
    sources = sorted({r["source"] for r in rows})
    place = {s: k for k, s in enumerate(sources)}
    counts, docs = np.zeros((len(sources), BUCKETS)), np.zeros(len(sources))
    for r in rows:
        if r["bucket"] < 0:
            docs[place[r["source"]]] = r["n"]
        else:
            counts[place[r["source"]], r["bucket"]] = r["n"]
    rate = (counts + 0.5) / (docs[:, None] + 1.0) if sources else counts
    return sources, np.log(docs / max(docs.sum(), 1.0)) if sources else docs, np.log(rate / np.maximum(1 - rate, 1e-9)) if sources else rate


def _parts(p: np.ndarray) -> tuple[int, int, int, int]:
    """(first, second, parts of the first, parts of the second) of a posterior over the wanted sources; second is -1 where it has no part."""
    order = np.argsort(-p, kind="stable")[:2]
    parts = [int(p[k] * PARTS + 0.5) for k in order] + [0]
    parts[1] = min(parts[1], PARTS - parts[0])
    return int(order[0]), int(order[1]) if parts[1] else -1, parts[0], parts[1]


def sized_members(documents: DataFrame, sources: list[str], model: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, first, second, a, b, tokens of every document that may belong to a wanted source: a and b sixteenths to its first and second source.

    documents: doc_id, source (named or null), text. One pass over the texts
    counts tokens and, where the source is null, asks the model. Documents of
    other sources, and those of which no sixteenth goes to a wanted one, are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = {s: k for k, s in enumerate(sources)}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, prior, odds = shared.value
        encoder = tokenizer(vocabulary)
        base = prior + np.log1p(-1 / (1 + np.exp(-odds))).sum(1) if len(names) else prior
        wanted = np.array([names.index(s) if s in place and s in names else -1 for s in sources])
        for pdf in batches:
            rows = []
            for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
                if not text:
                    continue
                if source is not None:
                    member = (place[source], -1, PARTS, 0)
                elif len(names):
                    score = base + odds[:, sorted({_bucket(w) for w in words(text)})].sum(1)
                    p = np.exp(score - score.max())
                    p /= p.sum()
                    member = _parts(np.where(wanted >= 0, p[wanted], 0.0))
                else:
                    continue
                if member[2]:
                    rows.append((doc, *member, len(encoder.encode_ordinary(text))))
            yield pd.DataFrame(rows, columns=["doc_id", "first", "second", "a", "b", "tokens"])

    may = documents.where(F.col("source").isin(*sources) | F.col("source").isNull()).select("doc_id", "source", "text")
    return may.mapInPandas(read, "doc_id bigint, first int, second int, a int, b int, tokens bigint").where("tokens > 0")


def reachable_total(capacity: dict[str, float], share: dict[str, float], shortfall: float = 0.0) -> float:
    """The largest total at which the shares that sources fail to give sum to at most shortfall; sources without documents do not count.

    With no shortfall every source can give its share in full.
    """
    limits = sorted((capacity[s] / share[s], capacity[s], share[s]) for s in share if share[s] > 0 and capacity.get(s, 0) > 0)
    if not limits:
        return 0.0
    held = missed = 0.0
    for k, (limit, cap, part) in enumerate(limits):
        held, missed = held + cap, missed + part
        # Beyond its limit a source gives all it has: the missed part of a total T is missed - held / T.
        bound = held / (missed - shortfall) if missed > shortfall else float("inf")
        if k + 1 == len(limits) or bound <= limits[k + 1][0]:
            return max(limit, bound if bound < float("inf") else limit)
    return limits[-1][0]


def fit_rates(weight: np.ndarray, member: np.ndarray, most: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rates between 0 and most whose expected totals match the targets best, by projected-gradient least squares.

    weight: tokens of each class; member: its parts by source (rows sum to at
    most 1); target: tokens wanted by source. Squares are weighed by the
    sources' sizes; then steps of one neither diverge nor need a search.
    """
    rate = np.zeros(len(weight))
    size = weight @ member
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    for _ in range(MOST_ROUNDS):
        off = ((rate * weight) @ member - target) * scale
        moved = np.clip(rate - member @ off, 0.0, most)
        if np.abs(moved - rate).max(initial=0.0) <= TOLERANCE:
            return moved
        rate = moved
    return rate


def draw(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, shortfall: float = 0.0) -> DataFrame:
    """doc_id, source, tokens, copies, target_share, actual_share of every document drawn.

    documents: doc_id, text, source; targets: source, target_share, max_repeats.
    The total is the largest at which the shares missed sum to at most
    shortfall: by default every source that has documents gives its share in
    full, and the smallest for its share limits the whole; with more, small
    sources are drawn as often as allowed and fall short. Sources without
    documents give nothing and the others share their part. Documents of other
    sources and documents without tokens are not drawn. Null shares and repeats
    count as 0. source is a document's most probable one; actual_share is the
    source's expected part of all tokens drawn, documents without source
    counted by their memberships. A document of two sources repeats no more
    often than either allows.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (r["share"], r["most"]) for r in targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most")).where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).collect()}
    sources = sorted(wanted)
    if not sources:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, copies int, target_share double, actual_share double")
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    # All other sources count as one, so that the model is bounded by the targets.
    model = fit_sources(named.withColumn("source", F.when(F.col("source").isin(*sources), F.col("source")).when(F.col("source").isNotNull(), F.lit("#"))))
    key = ["first", "second", "a", "b"]
    sized = materialise(sized_members(named, sources, model, vocabulary))
    classes = sorted((tuple(r[c] for c in key), r["tokens"], r["documents"]) for r in sized.groupBy(*key).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).collect())

    member, most = np.zeros((len(classes), len(sources))), np.zeros(len(classes))
    for n, ((first, second, a, b), _, _) in enumerate(classes):
        member[n, first], most[n] = a / PARTS, wanted[sources[first]][1]
        if b:
            member[n, second], most[n] = b / PARTS, min(most[n], wanted[sources[second]][1])
    weight = np.array([float(t) for _, t, _ in classes])
    capacity = (weight * most) @ member if classes else np.zeros(len(sources))
    there = {s: wanted[s][0] for s, n in zip(sources, capacity, strict=True) if n > 0}
    share = {s: x / sum(there.values()) for s, x in there.items() if sum(there.values()) > 0}
    total = reachable_total(dict(zip(sources, capacity, strict=True)), share, shortfall)
    rate = fit_rates(weight, member, most, np.array([total * share.get(s, 0.0) for s in sources]))
    rates = spark.createDataFrame([(*k, float(r)) for (k, _, _), r in zip(classes, rate, strict=True)], "first int, second int, a int, b int, rate double")

    # Systematic sampling: along a source's documents by size, whole counts follow the running sum of rates.
    rows: dict[int, int] = {}
    for (first, *_), _, n in classes:
        rows[first] = rows.get(first, 0) + n
    blocks = max(LEAST_BLOCKS, max(rows.values(), default=0) // BLOCK_ROWS)
    # The classes are bounded by PARTS and the sources.
    rated = sized.join(F.broadcast(rates), key).where("rate > 0")
    blocked = rated.withColumn("step", F.floor(F.log("tokens") * SIZE_STEPS).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    group = ["first", "step", "block"]
    sums = blocked.groupBy(*group).agg(F.sum("rate").alias("sum"))
    before = Window.partitionBy("first").orderBy("step", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("offset"))
    within = Window.partitionBy(*group).orderBy("doc_id", "tokens", "second", "a").rowsBetween(Window.unboundedPreceding, 0)
    run = blocked.withColumn("own", F.sum("rate").over(within)).join(offsets, group).withColumn("end", F.col("offset") + F.col("own"))
    # Half a step of shift centres the rounding; the nudge keeps whole rates whole.
    whole = lambda c: F.floor(c + 0.5 + 1e-7)
    drawn = materialise(run.withColumn("copies", (whole(F.col("end")) - whole(F.col("end") - F.col("rate"))).cast("int")).where("copies > 0").select("doc_id", *key, "tokens", "copies"))
    place = {k: n for n, (k, _, _) in enumerate(classes)}
    got, every = np.zeros(len(sources)), 0.0
    for r in drawn.groupBy(*key).agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn")).collect():
        got += r["drawn"] * member[place[tuple(r[c] for c in key)]]
        every += r["drawn"]
    names = spark.createDataFrame([(k, s, wanted[s][0], float(got[k] / every) if every else 0.0) for k, s in enumerate(sources)], "first int, source string, target_share double, actual_share double")
    return drawn.join(F.broadcast(names), "first").select("doc_id", "source", "tokens", "copies", "target_share", "actual_share")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, documents, tokens of every source wanted, those that gave nothing too."""
    got = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.max("actual_share").alias("actual_share"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    return wanted.join(got, "source", "left").select("source", "target_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")


def mix_of(spark, sf_dir: str) -> DataFrame:
    return draw(spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source")), load(spark, sf_dir, "mix_target"))


def report_of(spark, sf_dir: str) -> DataFrame:
    return share_report(mix_of(spark, sf_dir), load(spark, sf_dir, "mix_target"))

