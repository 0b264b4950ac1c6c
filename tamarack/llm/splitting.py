"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments at every pause; adjacent pairs lie in a heap
by the strength of the boundary between them, and the weakest boundary is merged
first while the pair and the overlap still fit. What remains are pieces that end
at the strongest pauses their sizes allow.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import load, spread

CHARS_PER_TOKEN = 4

#: Abbreviations after which a point ends no sentence, lower case.
ABBREVIATIONS = frozenset(
    "approx ca cf e.g i.e etc vs fig figs sec no nos vol pp p ed eds al dr mr mrs ms prof st sr jr inc ltd co dept est resp incl max min avg a.m p.m u.s z.b d.h u.a bzw usw ggf evtl vgl nr abs bd s str tel hr fr ing med p.ej ej pág núm sra srta dra ud uds aprox art cap".split()
)

#: Strengths of pauses, weakest first; inside a word is the last resort.
INSIDE, SPACE, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)

_PAUSE = re.compile(r"(?P<paragraph>\n[ \t]*\n\s*)|(?P<line>\n[ \t]*)|(?P<sentence>[.!?…]+[\"'”’»)\]]*(?=\s)[ \t]*|[。！？]+[”’」』）]*)|(?P<clause>[;:](?=\s)[ \t]*|[；：])|(?P<comma>,[ \t]*|[，、])|(?P<space>[ \t]+)")
_STRENGTH = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "clause": CLAUSE, "comma": COMMA, "space": SPACE}
_WORD_BEFORE = re.compile(r"([^\W\d_](?:[^\s]*[^\W_])?|\d+)$")


def _ends_sentence(text: str, at: int, mark: str, after: int) -> bool:
    """Whether a point at a place ends a sentence: not after an abbreviation, an initial or a number that goes on."""
    if not mark.startswith("."):
        return True
    word = _WORD_BEFORE.search(text, max(0, at - 24), at)
    before = word[1].lower() if word else ""
    if before in ABBREVIATIONS or (len(before) == 1 and before.isalpha()):
        return False
    nxt = text[after : after + 1]
    return not nxt.islower()


def pauses(text: str) -> list[tuple[int, int]]:
    """(place, strength) of every pause inside a text; a place is the start of what follows."""
    found = []
    for m in _PAUSE.finditer(text):
        kind = m.lastgroup
        strength = _STRENGTH[kind]
        if kind == "sentence" and not _ends_sentence(text, m.start(), m[0], m.end()):
            strength = SPACE
        if kind == "line" and m.end() < len(text) and text[m.end()] == "#":
            strength = PARAGRAPH  # a heading begins
        if 0 < m.end() < len(text):
            found.append((m.end(), strength))
    return found


def _safe(text: str, at: int) -> int:
    """The nearest place at or before at that divides no composed character."""
    start = at
    while at > 1 and start - at < 32 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or unicodedata.category(text[at]) == "Sk" and ord(text[at]) > 0xFFFF):
        at -= 1
    return at


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(place, strength) of the cuts that leave segments of at most most characters, using only as weak pauses as that takes."""
    every = pauses(text)
    cuts: list[tuple[int, int]] = []

    def divide(start: int, end: int, level: int, own: list[tuple[int, int]]) -> None:
        while level > SPACE:
            inner = [p for p in own if p[1] >= level]
            if inner and (level >= SENTENCE or end - start > most):
                bounds = [start, *(p for p, _ in inner), end]
                k = 0
                for (a, b), cut in zip(zip(bounds, bounds[1:], strict=False), [*inner, None], strict=True):
                    part = []
                    while k < len(own) and own[k][0] < b:
                        if own[k][0] > a and own[k][1] < level:
                            part.append(own[k])
                        k += 1
                    divide(a, b, level - 1, part)
                    if cut:
                        cuts.append(cut)
                return
            level -= 1
        if end - start > most:
            spaces = [p for p, _ in own]
            at, i = start, 0
            while end - at > most:
                last = None
                while i < len(spaces) and spaces[i] - at <= most:
                    last = spaces[i] if spaces[i] > at else last
                    i += 1
                at, strength = (last, SPACE) if last and last - at > most // 4 else (_safe(text, at + most), INSIDE)
                cuts.append((at, strength))

    divide(0, len(text), PARAGRAPH, every)
    return cuts


def split_text(text: str, limit: int = 1000, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece: characters from start to own start repeat the piece before.

    A text within the limit is one piece. No piece holds more than limit tokens,
    overlap included; the overlap starts at a word where there is one.
    """
    if len(text) // CHARS_PER_TOKEN <= limit:
        return [(0, 0, len(text))]
    most, repeat = limit * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, overlap * CHARS_PER_TOKEN
    room = most - repeat
    cuts = atoms(text, room)
    starts = [0, *(p for p, _ in cuts)]
    ends = [*starts[1:], len(text)]
    strength = [s for _, s in cuts]
    n = len(starts)
    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or size != ends[j] - starts[i]:
            continue
        if size > (room if i else most):
            continue
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        if after[j] != -1:
            before[after[j]] = i
            heapq.heappush(heap, (strength[after[j] - 1], ends[after[j]] - starts[i], i, after[j]))
        if before[i] != -1:
            heapq.heappush(heap, (strength[i - 1], ends[i] - starts[before[i]], before[i], i))
    pieces, i = [], 0
    while i != -1:
        start = starts[i]
        if i:
            start = max(starts[i] - repeat, starts[before[i]])
            gap = re.compile(r"\s").search(text, start, starts[i])
            if start > starts[before[i]] and not text[start - 1].isspace() and gap:
                start = gap.end()
        pieces.append((start, starts[i], ends[i]))
        i = after[i]
    return pieces


def split_units(units: DataFrame, limit: int = 1000, overlap: int = 50) -> DataFrame:
    """unit_id, doc_path, section_heading, piece, pieces, start, own_start, end, tokens, text of every unit above the limit.

    units: unit_id, doc_path, section_heading, text. Units within the limit,
    empty and null texts give no rows. Repeated units are split each. Pieces
    without their repeated part make up the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, path, heading, text in pdf[["unit_id", "doc_path", "section_heading", "text"]].itertuples(index=False):
                pieces = split_text(text, limit, overlap)
                for k, (start, own, end) in enumerate(pieces):
                    rows.append((unit, path, heading, k, len(pieces), start, own, end, (end - start) // CHARS_PER_TOKEN, text[start:end]))
            yield pd.DataFrame(rows, columns=["unit_id", "doc_path", "section_heading", "piece", "pieces", "start", "own_start", "end", "tokens", "text"])

    large = units.select("unit_id", "doc_path", "section_heading", "text").where(F.floor(F.length("text") / CHARS_PER_TOKEN) > limit)
    return large.mapInPandas(run, "unit_id bigint, doc_path string, section_heading string, piece int, pieces int, start int, own_start int, end int, tokens int, text string")


def pieces_of(spark, sf_dir: str) -> DataFrame:
    return split_units(spread(load(spark, sf_dir, "extraction_unit").select("unit_id", "doc_path", "section_heading", "text")))
