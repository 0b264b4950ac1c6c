"""Subject areas of documents, by labels propagated over a verified graph of like passages.

A passage is a sentence as the set of its terms. Two passages are linked when
at least four fifths of the larger one's terms are in both, and the link is
verified: passages meet at a hub, and a hub is what is left of a set when one
term is taken out, or, of ten terms or more, the rarest and one more. Whoever
has the same hub has all of its terms in common, so equality of hubs proves the
share, and no pair is ever written: the graph keeps its factored form, document
- passage - hub - passage - document. Links whose two sides differ in two terms
each of which neither is the rarest are the ones not met; a test measures them
against all pairs.

A round of propagation joins the documents' subjects to passages, these to
hubs, and the verdicts of the hubs that tell a subject back to passages and
documents. Only a passage that no hub tells is told by its words, where two or
more of them agree. Trusted seeds are clamped: labels by readers of which the graph finds
at least a little in the text keep their full weight in every round and stand in
the result. Documents keep several subjects, each with its share of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.keys import is_known
from tamarack.llm.pairs import language
from tamarack.llm.words import plain
from tamarack.session import broadcast_if_small, load, materialise, spread

LANGUAGES = ("en", "de", "es", "zh")
ROUNDS = 2
#: A subject counts from this share of a document's text on.
SUBJECT_SHARE = 0.25
#: A seed's label is trusted when the graph finds at least this share of it; a share below FAINT gives a document without label no vote.
TRUSTED_SHARE, FAINT = 0.1, 0.05
#: Linked passages share four terms of five: one may differ from five terms on, two from ten on.
ONE_DIFFERS, TWO_DIFFER = 5, 10
#: Part of the information a hub of its subject could carry that it must carry, if that is less than INFORMATION.
INFORMED = 0.3
#: Smoothing of a hub's subject counts; the information in nats a hub must carry; a passage's least score and lead.
SMOOTHING, INFORMATION, LEAST_SCORE, LEAST_LEAD = 0.4, 0.6, 0.5, 0.5
#: Rows of two or three numbers that may be broadcast after they were counted, and rows with a number per subject: 60 MB at most.
NARROW_ROWS, SUBJECT_ROWS = 1_000_000, 500_000
#: A passage that no hub tells needs so many terms that tell the same subject.
AGREEING_TERMS = 2

_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+|(?<=[。！？；])")
_TERM = re.compile(r"[一-鿿]+|(?:(?![一-鿿])[^\W\d_])+")
#: Chinese function characters, between which content words stand.
FUNCTION_CHARACTERS = "的了是在和与及或不没有于为以之其到第才也就都而但却从向对由把被让使这那此每各个些着过得地里上下中前后很更最已曾将会能可要还再又且如若因所比等几一"
_FUNCTION = re.compile(f"[{FUNCTION_CHARACTERS}]+")


def terms_of(sentence: str) -> set[str]:
    """Words of two letters or more; of Chinese, what stands between function characters."""
    out: set[str] = set()
    for w in _TERM.findall(sentence):
        if "一" <= w[0] <= "鿿":
            out.update(x for x in _FUNCTION.split(w) if x)
        elif len(w) > 1:
            out.add(w)
    return out


def passages(text: str | None) -> tuple[int, list[tuple[frozenset[str], int]]]:
    """(language, sentences): the terms of each sentence and its length."""
    whole = plain(text or "")
    found = language(whole)[0]
    lang = LANGUAGES.index(found) if found in LANGUAGES else 0
    return lang, [(frozenset(terms_of(s)), len(s)) for part in _SENTENCE.split(whole) if (s := part.strip())]


def sentences(documents: DataFrame) -> DataFrame:
    """What one pass over the texts finds, as rows of two kinds.

    doc_id, lang: every document. doc_id, lang, passage, share, terms: its
    passages with their share of its text; terms only where a task first meets
    a passage. A term's number is a hash of its language and itself, a
    passage's all its terms' numbers xored, so none is given out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        numbers: dict[tuple[int, str], int] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                lang, parts = passages(text)
                total = sum(n for _, n in parts) or 1
                rows.append((doc, lang, None, None, None))
                shares: dict[tuple[int, ...], float] = {}
                for terms, n in parts:
                    for t in terms:
                        if (lang, t) not in numbers:
                            numbers[lang, t] = xxhash.xxh3_64_intdigest(f"{lang} {t}") - 2**63
                    key = tuple(sorted(numbers[lang, t] for t in terms))
                    shares[key] = shares.get(key, 0.0) + n / total
                for key, share in shares.items():
                    if key:
                        h = reduce(xor, key)
                        rows.append((doc, lang, h, share, None if h in known else key))
                        known.add(h)
                if len(known) > 500_000:
                    known.clear()  # met again, its terms are only written again
                if len(numbers) > 500_000:
                    numbers.clear()
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "lang", "passage", "share", "terms"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float32(), pa.list_(pa.int64())]
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, "doc_id bigint, lang int, passage bigint, share float, terms array<bigint>")


def hubs_of(passage: Column, terms: Column, rare: Column) -> Column:
    """The hubs of a passage: itself, and what is left of it as far as four fifths of its terms remain."""
    size = F.size(terms)
    one = F.transform(terms, lambda t: passage.bitwiseXOR(t))
    two = F.transform(terms, lambda t: F.when(t == rare, passage.bitwiseXOR(rare)).otherwise(passage.bitwiseXOR(rare).bitwiseXOR(t)))
    less = F.when(size >= TWO_DIFFER, two).when(size >= ONE_DIFFERS, one).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(passage), less)


def passage_hubs(spelled: DataFrame) -> DataFrame:
    """passage, lang, hub: every passage with itself and with each hub that another passage has too.

    spelled: passage, lang, terms, one row per passage. The rarest term is the
    one that fewest passages have, the smaller number of equals.
    """
    each = spelled.select("passage", F.explode("terms").alias("term"))
    counts = broadcast_if_small(materialise(each.groupBy("term").agg(F.count("*").alias("n"))), limit=NARROW_ROWS)
    rare = each.join(counts, "term").groupBy("passage").agg(F.min(F.struct("n", "term"))["term"].alias("rare"))
    rows = spelled.join(rare, "passage").select("passage", "lang", F.explode(hubs_of(F.col("passage"), F.col("terms"), F.col("rare"))).alias("hub"))
    rows = materialise(rows)
    shared = broadcast_if_small(materialise(rows.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")), limit=NARROW_ROWS)
    met = rows.where("hub <> passage").join(shared, "hub", "left_semi")
    return met.select("passage", "lang", "hub").unionByName(rows.where("hub = passage"))


def passage_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, lang), (doc_id, passage, share), (passage, lang, hub) and (passage, lang, terms): documents, their passages with their share of the text, the hubs at which passages meet, and the passages' terms."""
    read = materialise(sentences(documents))
    spelled = materialise(read.where("terms is not null").groupBy("passage").agg(F.first("lang").alias("lang"), F.first("terms").alias("terms")))
    return read.where("passage is null").select("doc_id", "lang"), read.where("passage is not null").select("doc_id", "passage", "share"), materialise(passage_hubs(spelled)), spelled


def _priors(spoken: DataFrame, beliefs: DataFrame, subjects: list[str]) -> DataFrame:
    """lang, prior: the share of each subject in the beliefs of a language's documents; a row for each language."""
    base = np.full((len(LANGUAGES), len(subjects)), 1.0)
    for r in spoken.join(beliefs, "doc_id").groupBy("lang", "subject").agg(F.sum("weight").alias("weight")).collect():
        base[r["lang"], r["subject"]] += r["weight"]
    base /= base.sum(1, keepdims=True)
    return spoken.sparkSession.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(base)], "lang int, prior array<double>")


def _lifts(counted: DataFrame, priors: DataFrame) -> DataFrame:
    """hub, lift: per hub (or term) that tells a subject, its lift of each subject over the subject's share in its language.

    counted: hub, lang, own (votes by subject), all.
    """
    p = counted.join(F.broadcast(priors), "lang").withColumn("p", F.zip_with("own", "prior", lambda o, b: (o + SMOOTHING * b) / (F.col("all") + SMOOTHING)))
    lifted = p.withColumn("lift", F.zip_with("p", "prior", lambda x, b: F.log(x / b)))
    # A frequent subject leaves less to be told: the bound is at most INFORMED of what its hubs could tell.
    top = F.element_at("prior", F.array_position("lift", F.array_max("lift")).cast("int"))
    told = F.aggregate(F.zip_with("p", "lift", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return lifted.where(told > F.least(F.lit(INFORMATION), -INFORMED * F.log(top))).select("hub", F.col("lift").cast("array<float>").alias("lift"))


def _own(count: int) -> list[Column]:
    """Votes by subject and in all, of rows with subject and weight."""
    return [F.array(*(F.sum(F.when(F.col("subject") == k, F.col("weight")).otherwise(0.0)) for k in range(count))).alias("own"), F.sum("weight").alias("all")]


def _top(summed: DataFrame, count: int) -> DataFrame:
    """Adds subject to rows of s0, s1, ...: the one that leads; rows where none leads clearly are left out."""
    ranked = F.sort_array(F.array(*(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("subject")) for k in range(count))), asc=False)
    clear = (F.col("r")[0]["score"] > LEAST_SCORE) & (F.col("r")[0]["score"] - F.coalesce(F.try_element_at("r", F.lit(2))["score"], F.lit(-1e9)) > LEAST_LEAD)
    return summed.withColumn("r", ranked).where(clear).withColumn("subject", F.col("r")[0]["subject"]).drop("r")


def told_passages(votes: DataFrame, hubs: DataFrame, spelled: DataFrame, priors: DataFrame, count: int) -> DataFrame:
    """passage, subject of every passage whose hubs, or else two terms or more that agree, tell its subject.

    votes: passage, subject, weight.
    """
    sums = [F.sum(F.col("lift")[k]).alias(f"s{k}") for k in range(count)]
    lifts = broadcast_if_small(materialise(_lifts(hubs.join(votes, "passage").groupBy("hub", "lang").agg(*_own(count)), priors)), limit=SUBJECT_ROWS)
    told = materialise(_top(hubs.join(lifts, "hub").groupBy("passage").agg(*sums), count).select("passage", "subject"))
    voted = spelled.where(F.size("terms") >= AGREEING_TERMS).join(votes, "passage").select("passage", F.explode("terms").alias("hub"), "lang", "subject", "weight")
    # A term that one passage alone has would only repeat what that passage's documents believe.
    spoken = voted.groupBy("hub", "lang").agg(*_own(count), F.min("passage").alias("a"), F.max("passage").alias("b")).where("a <> b")
    words = broadcast_if_small(materialise(_lifts(spoken, priors)), limit=SUBJECT_ROWS)
    untold = spelled.where(F.size("terms") >= AGREEING_TERMS).join(broadcast_if_small(told, limit=NARROW_ROWS), "passage", "left_anti").select("passage", F.explode("terms").alias("hub"))
    top = F.array_position("lift", F.array_max("lift")).cast("int") - 1
    agreeing = [F.sum(F.when(top == k, 1).otherwise(0)).alias(f"n{k}") for k in range(count)]
    said = _top(untold.join(words, "hub").groupBy("passage").agg(*sums, *agreeing), count)
    agree = F.array(*(F.col(f"n{k}") for k in range(count)))[F.col("subject")] >= AGREEING_TERMS
    return materialise(told.unionByName(said.where(agree).select("passage", "subject")))


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = ROUNDS) -> DataFrame:
    """doc_id, subject_id, share: the share of each document's text that treats each subject.

    documents: doc_id, text; labels: doc_id, subject_id as readers gave them,
    repeats and wrong ones among them; labels of unknown documents or subjects
    are ignored. A trusted label has a share of SUBJECT_SHARE at least. Without
    subjects there is nothing to tell. Documents that are empty, or whose
    passages tell no subject, have no rows. Without labels there are none.
    doc_id is unique.
    """
    spark = documents.sparkSession
    if not subjects:
        return spark.createDataFrame([], "doc_id bigint, subject_id string, share double")
    spoken, edges, hubs, spelled = passage_graph(documents)
    count = len(subjects)
    number = F.array_position(F.array(*(F.lit(s) for s in subjects)), F.lower(F.trim("subject_id"))).cast("int") - 1
    seeds = materialise(labels.where(is_known(F.col("subject_id"))).select("doc_id", number.alias("subject")).where("subject >= 0 and doc_id is not null").distinct())
    of_document = seeds.groupBy("doc_id").agg((1.0 / F.count("*")).alias("weight"))

    beliefs = seeds.join(of_document, "doc_id")
    for n in range(rounds):
        votes = edges.join(broadcast_if_small(materialise(beliefs), limit=NARROW_ROWS), "doc_id").groupBy("passage", "subject").agg(F.sum("weight").alias("weight"))
        votes = broadcast_if_small(materialise(votes), limit=NARROW_ROWS)
        told = broadcast_if_small(told_passages(votes, hubs, spelled, _priors(spoken, beliefs, subjects), count), limit=NARROW_ROWS)
        # A passage that a third of all documents have makes one large group of edges only in the shuffle join; adaptive execution splits it.
        shares = materialise(edges.join(told, "passage").groupBy("doc_id", "subject").agg(F.sum(F.col("share").cast("double")).alias("share")))
        trusted = materialise(shares.where(F.col("share") >= TRUSTED_SHARE).join(seeds, ["doc_id", "subject"], "left_semi").select("doc_id", "subject"))
        if n < rounds - 1:
            clamped = trusted.join(trusted.groupBy("doc_id").agg((1.0 / F.count("*")).alias("weight")), "doc_id")
            free = shares.where(F.col("share") >= FAINT).join(trusted, "doc_id", "left_anti")
            free = free.join(free.groupBy("doc_id").agg(F.sum("share").alias("all")), "doc_id").select("doc_id", "subject", (F.col("share") / F.col("all")).alias("weight"))
            beliefs = materialise(clamped.unionByName(free))
    marked = shares.join(trusted.withColumn("trusted", F.lit(True)), ["doc_id", "subject"], "left")
    share = F.when(F.coalesce("trusted", F.lit(False)), F.greatest("share", F.lit(SUBJECT_SHARE))).otherwise(F.col("share"))
    return marked.select("doc_id", F.array(*(F.lit(s) for s in subjects))[F.col("subject")].alias("subject_id"), share.alias("share"))


def shares_of(spark, sf_dir: str) -> DataFrame:
    subjects = sorted(r["s"] for r in load(spark, sf_dir, "subject_area").select(F.lower(F.trim("subject_id")).alias("s")).distinct().collect() if r["s"])
    return subject_shares(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), load(spark, sf_dir, "doc_subject_label"), subjects)


def document_subjects(shares: DataFrame) -> DataFrame:
    return shares.where(F.col("share") >= SUBJECT_SHARE - 1e-9).select("doc_id", "subject_id")


def corpus_shares(shares: DataFrame, documents: DataFrame) -> DataFrame:
    """subject_id, documents, share: the share of each subject in the text of the corpus."""
    size = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    total = size.agg(F.sum("chars")).first()[0] or 1
    part = shares.join(size, "doc_id").groupBy("subject_id").agg(F.count_if(F.col("share") >= SUBJECT_SHARE - 1e-9).alias("documents"), F.sum(F.col("share") * F.col("chars")).alias("chars"))
    return part.select("subject_id", "documents", F.round(F.col("chars") / total, 6).alias("share"))
