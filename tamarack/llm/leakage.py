"""Evaluation texts leaking into training text.

Windows of twelve words are embedded by the CGK random walk, which maps edit
distance to Hamming distance: a walk over the window copies a word at every
step and goes on by one word or stays, as random bits of step and word say, so
that two windows that differ by few edits fall into step again. Sampled places of several walks
are the keys of repeated bit-sampling LSH. Windows that meet an item's window in
any key are verified exactly.

A stretch of n >= 12 words with at most n / 6 changed always holds one of
fewer than 24 words with that share: of two halves of a longer one, one is no
worse than the whole. So verification needs three edits at most.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.words import plain, words
from tamarack.session import load, materialise, spread

WINDOW = 12
#: Walks, samples per walk and places per sample: measured recall in the README.
WALKS, SAMPLES, PLACES = 8, 5, 4
STEPS = 24
#: A sentence this many items share is a standing instruction.
STANDING = 3
#: A word that at most one item in so many has is its own.
OWN_SHARE = 50
#: Items indexed at a time, about 25 KB each in memory; more go through the corpus in further passes.
BLOCK_ITEMS = 4000
MOST_EDITS = 3


def sentences(text: str) -> list[list[str]]:
    return [w for s in re.split(r"(?<=[.!?。！？])\s+", text or "") if (w := words(s))]


def longest_stretches(doc: list[int], item: list[int], own: set[int], most_edits: int = MOST_EDITS) -> tuple[list[int], list[int]]:
    """For each number of edits the most item words of a common stretch that begins and ends with an equal word: of any, and of those that hold one of the item's own.

    Words between equal words may be changed, left out or added: between two
    equal words the edits are the larger of the two gaps. own: the words that
    few items have; phrases that many items share, with their names and numbers
    changed, are not the item's own text.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for j, w in enumerate(item):
        at[w].append(j)
    span = most_edits + 1
    best, every = [0] * span, [0] * span
    rows: list[dict[int, list[int]]] = []
    for i, w in enumerate(doc):
        row: dict[int, list[int]] = {}
        special = w in own
        for j in at.get(w, ()):
            # The longest stretches ending here by edits, then those that hold an own word; 0 where there is none.
            cell = [1] + [0] * most_edits + [int(special)] + [0] * most_edits
            for di in range(1, min(span + 1, i + 1)):
                before = rows[i - di]
                if not before:
                    continue
                for dj in range(1, span + 1):
                    prev = before.get(j - dj)
                    if prev:
                        cost = max(di, dj) - 1
                        for e in range(span - cost):
                            f = e + cost
                            if prev[e]:
                                n = prev[e] + dj
                                cell[f] = max(cell[f], n)
                                if special:
                                    cell[span + f] = max(cell[span + f], n)
                                elif prev[span + e]:
                                    cell[span + f] = max(cell[span + f], prev[span + e] + dj)
            row[j] = cell
            for e in range(span):
                best[e] = max(best[e], cell[span + e])
                every[e] = max(every[e], cell[e])
        rows.append(row)
    return every, best


def longest_stretch(doc: list[int], item: list[int], own: set[int]) -> list[int]:
    return longest_stretches(doc, item, own)[1]


def may_match(window: list[int], places: dict[int, list[int]], most_edits: int = MOST_EDITS) -> bool:
    """Whether so many words of a window stand in an item at nearly the same distance that the window may be within most_edits of one there.

    A necessary condition: edits shift what follows by one each, so the words
    that stay equal lie on most_edits + 1 neighbouring diagonals.
    """
    least = len(window) - most_edits
    if sum(w in places for w in window) < least:
        return False
    diagonals: dict[int, int] = {}
    for i, w in enumerate(window):
        for j in places.get(w, ()):
            diagonals[j - i] = diagonals.get(j - i, 0) + 1
    return any(sum(diagonals.get(d + k, 0) for k in range(most_edits + 1)) >= least for d in diagonals)


def _long_enough(best: list[int]) -> bool:
    return any(n >= max(WINDOW, 6 * e) for e, n in enumerate(best))


def holds_stretch(doc: list[int], item: list[int], own: set[int]) -> bool:
    """Whether both share a stretch of at least WINDOW item words of which at most one in six is changed."""
    return _long_enough(longest_stretch(doc, item, own))


#: One random number per step of every walk; with a word's hash it tells whether the walk goes on at that word.
_STEP_SALT = np.random.default_rng(20).integers(0, 2**63, (WALKS, STEPS, 1), dtype=np.uint64)
_PLACES = np.stack([np.stack([np.sort(np.random.default_rng((21, w, s)).choice(STEPS, PLACES, replace=False)) for s in range(SAMPLES)]) for w in range(WALKS)])


def goes_on(codes: np.ndarray) -> np.ndarray:
    """The random bit of every walk, step and word: walks x steps x words. It depends on the word alone, not on what else is indexed."""
    x = (codes[None, None, :] ^ _STEP_SALT) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(63)).astype(np.int8)


def keys_of(windows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """LSH keys of windows of word places in codes, one row of keys per walk and sample."""
    used, local = np.unique(windows, return_inverse=True)
    n, end = len(windows), len(used)
    codes = np.append(codes[used], np.uint64(0))
    bits = goes_on(codes)
    bits[:, :, end] = 0
    signed = codes.view(np.int64)
    padded = np.concatenate([local.reshape(n, WINDOW), np.full((n, 1), end)], 1)
    rows, out = np.arange(n), []
    for walk in range(WALKS):
        at, copied = np.zeros(n, np.int64), np.empty((STEPS, n), np.int64)
        for step in range(STEPS):
            word = padded[rows, at]
            copied[step] = signed[word]
            at = np.minimum(at + bits[walk, step][word], WINDOW)
        for sample in range(SAMPLES):
            key = np.full(n, walk * SAMPLES + sample, np.int64)
            for p in _PLACES[walk, sample]:
                key = key * np.int64(1_000_003) + copied[p]
            out.append(key)
    return np.stack(out)


class ItemIndex:
    """The items' own words and the LSH tables of their windows."""

    #: Words of documents that are remembered besides the items' own.
    MOST_WORDS = 1_000_000

    def __init__(self, runs: list[tuple[int, list[str]]], own_words: set[str]):
        """runs: (item id, words) for every run between standing instructions; own_words: the words that few of all items have."""
        long = [(item, w) for item, w in runs if len(w) >= WINDOW]
        self.words = sorted({w for _, ws in long for w in ws})
        self.items = [item for item, _ in long]
        self._start()
        self.runs = [[self.lexicon[w] for w in ws] for _, ws in long]
        self.own = {self.lexicon[w] for w in own_words if w in self.lexicon}
        self.places: list[dict[int, list[int]]] = [{} for _ in self.runs]
        for at, run in zip(self.places, self.runs, strict=True):
            for j, w in enumerate(run):
                at.setdefault(w, []).append(j)
        self.keys, self.owners = np.empty(0, np.int64), np.empty(0, np.int32)
        if self.runs:
            starts = [(r, p) for r, run in enumerate(self.runs) for p in range(len(run) - WINDOW + 1)]
            keys = keys_of(np.array([self.runs[r][p : p + WINDOW] for r, p in starts]), np.array(self.codes, np.uint64))
            flat, who = keys.ravel(), np.tile(np.array([r for r, _ in starts], np.int32), len(keys))
            order = np.lexsort((who, flat))
            flat, who = flat[order], who[order]
            first = np.ones(len(flat), bool)
            first[1:] = (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])
            self.keys, self.owners = flat[first], who[first]

    def _start(self) -> None:
        """Items' words come first in the lexicon; a word's number tells whether an item has it."""
        self.lexicon = {w: k for k, w in enumerate(self.words)}
        self.codes = [xxhash.xxh64_intdigest(w) for w in self.words]

    def _number(self, word: str) -> int:
        n = self.lexicon.get(word)
        if n is None:
            n = self.lexicon[word] = len(self.codes)
            self.codes.append(xxhash.xxh64_intdigest(word))
        return n

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, bool]]:
        """(place of the text, item id, whether it holds an own word) of every text that holds a stretch of an item."""
        if not self.runs:
            return []
        if len(self.codes) > len(self.words) + self.MOST_WORDS:
            self._start()
        docs = [[self._number(w) for w in words(t)] if t else [] for t in texts]
        lengths = np.array([len(d) for d in docs])
        if not lengths.sum():
            return []
        flat = np.concatenate([np.array(d, np.int32) for d in docs if d])
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        begins = np.cumsum(lengths) - lengths
        if len(flat) < WINDOW:
            return []
        # A window within three edits of an item's has nine of its words, an exact bound.
        known = np.concatenate([[0], np.cumsum(flat < len(self.words))])
        inside = doc_of[: len(flat) - WINDOW + 1] == doc_of[WINDOW - 1 :]
        starts = np.flatnonzero(inside & (known[WINDOW:] - known[:-WINDOW] >= WINDOW - MOST_EDITS))
        codes = np.array(self.codes, np.uint64)
        met: list[np.ndarray] = []  # (place of the text, run, window)
        for part in range(0, len(starts), 50_000):
            own = starts[part : part + 50_000]
            keys = keys_of(flat[own[:, None] + np.arange(WINDOW)], codes)
            for row in keys:
                low, high = np.searchsorted(self.keys, row, "left"), np.searchsorted(self.keys, row, "right")
                hit = np.flatnonzero(high > low)
                n = high[hit] - low[hit]
                at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                met.append(np.stack([doc_of[own[hit]].repeat(n), self.owners[at].astype(np.int64), own[hit].repeat(n)], 1))
        found: dict[tuple[int, int], bool] = {}
        tried: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, run, p in np.unique(np.concatenate(met), axis=0).tolist() if met else ():
            tried[d, run].append(p)
        for (d, run), places in tried.items():
            item = self.items[run]
            if found.get((d, item)):
                continue
            doc, target, done = docs[d], self.runs[run], -1
            for p in (q - int(begins[d]) for q in places):
                if p <= done or not may_match(doc[p : p + WINDOW], self.places[run]):
                    continue
                done = p + WINDOW
                around = doc[max(0, p - 3 * WINDOW) : p + 5 * WINDOW]
                every, best = longest_stretches(around, target, self.own)
                if _long_enough(best):
                    found[d, item] = True
                    break
                if _long_enough(every):
                    found[d, item] = False
        return sorted((d, item, own) for (d, item), own in found.items())


def item_runs(items: DataFrame) -> DataFrame:
    """item_id, runs: the item's own words, standing instructions taken out and their places left as breaks.

    items: item_id, text. A sentence that STANDING or more items share is a
    standing instruction. Null texts have no runs.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, w) for i, text in zip(pdf["item_id"], pdf["text"], strict=True) for k, w in enumerate(sentences(text))]
            yield pd.DataFrame(rows, columns=["item_id", "place", "words"])

    cut_up = items.select("item_id", "text").mapInPandas(cut, "item_id bigint, place int, words array<string>")
    key = F.concat_ws(" ", "words")
    shared = cut_up.groupBy(key.alias("key")).agg(F.count_distinct("item_id").alias("items"))
    own = cut_up.withColumn("key", key).join(shared, "key").where(F.col("items") < STANDING)
    return own.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("sentences"))


def _runs(item: int, parts: list) -> list[tuple[int, list[str]]]:
    runs: list[tuple[int, list[str]]] = []
    last = None
    for place, ws in parts:
        if last is None or place != last + 1:
            runs.append((item, []))
        runs[-1][1].extend(ws)
        last = place
    return runs


def with_own_words(runs: DataFrame, few: int) -> DataFrame:
    """Adds own: the item's words that at most few of all items have in a run of WINDOW words or more."""

    def long_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, w) for i, parts in zip(pdf["item_id"], pdf["sentences"], strict=True) for w in sorted({w for _, ws in _runs(i, [(p["place"], p["words"]) for p in parts]) if len(ws) >= WINDOW for w in ws})]
            yield pd.DataFrame(rows, columns=["item_id", "word"])

    used = runs.mapInPandas(long_words, "item_id bigint, word string").distinct()
    rare = used.groupBy("word").agg(F.count("*").alias("items")).where(F.col("items") <= few).select("word")
    own = used.join(rare, "word").groupBy("item_id").agg(F.collect_list("word").alias("own"))
    return runs.join(own, "item_id", "left")


def held_stretches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, own of every document that holds a stretch of an item's text; own: the stretch holds one of the item's own words.

    documents: doc_id, text; items: item_id, text. The items are a stated query
    set: BLOCK_ITEMS of them at a time are indexed and sent to the executors, and
    every document is searched whole against each block. A word is an item's
    own when at most one item in OWN_SHARE (two at least) has it; that is
    counted over all items, so blocks do not change the result. Null and short
    texts hold nothing. Repeated documents give a row each, repeated items one.
    """
    spark = documents.sparkSession
    runs = materialise(item_runs(items))
    total = runs.count()
    whole = materialise(with_own_words(runs, max(2, total // OWN_SHARE)))
    blocks = max(1, -(-total // BLOCK_ITEMS))
    results = []
    for block in range(blocks):
        rows = whole.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else whole.collect()
        coded = [run for r in sorted(rows, key=lambda r: r["item_id"]) for run in _runs(r["item_id"], r["sentences"])]
        index = spark.sparkContext.broadcast(ItemIndex(coded, {w for r in rows for w in r["own"] or ()}))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["doc_id"].tolist()
                rows = [(ids[d], i, own) for d, i, own in index.value.matches(pdf["text"].tolist())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "own"]).astype({"doc_id": "int64", "item_id": "int64", "own": "bool"})

        results.append(documents.select("doc_id", "text").where("text is not null").mapInPandas(search, "doc_id bigint, item_id bigint, own boolean"))
    return reduce(DataFrame.unionByName, results)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document that holds a stretch of an item's own text; see held_stretches()."""
    return held_stretches(documents, items).where("own").select("doc_id", "item_id")


def stretches_of(spark, sf_dir: str) -> DataFrame:
    return held_stretches(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), load(spark, sf_dir, "eval_item"))


def leak_report(stretches: DataFrame) -> DataFrame:
    """item_id, documents, any_words: per item, how many documents hold a stretch of it with an own word, and with any words."""
    return stretches.groupBy("item_id").agg(F.count_if("own").alias("documents"), F.count("*").alias("any_words"))


def leaks_of(spark, sf_dir: str) -> DataFrame:
    return stretches_of(spark, sf_dir).where("own").select("doc_id", "item_id")


__all__ = ["ItemIndex", "held_stretches", "holds_stretch", "leak_report", "leaked_items", "leaks_of", "plain", "stretches_of"]
