import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.packing import pack, plan_slots
from tamarack.llm.splitting import split_text, split_units


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b + x <= capacity]
        if fit:
            bins[max(fit, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80))
def test_plan_is_best_fit(lengths):
    steps, containers = plan_slots(dict(Counter(lengths)), 60)
    fill, ranks = Counter(), Counter()
    for s in steps:
        for r in range(s.count):
            fill[s.container + r // s.each] += s.length
        assert s.first == ranks[s.length]
        ranks[s.length] += s.count
    assert ranks == Counter(lengths) and all(v <= 60 for v in fill.values())
    assert containers == first_fit([x for x in lengths if x], 60) or (containers == 1 and not any(lengths))


def test_rows_take_slots(spark):
    random.seed(3)
    texts = ["x" * random.choice([0, 3, 40, 40, 40, 400, 399, 130, 1000]) for _ in range(300)] + [None, "y" * 5000]
    units = spark.createDataFrame([(i, t, 7, 1) for i, t in enumerate(texts)], "unit_id long, text string, tokens int, rank int")
    placed, totals = pack(units, 100)
    rows = placed.collect()
    used = Counter()
    for r in rows:
        used[r["request_id"]] += r["tokens"]
    assert max(used.values()) <= 100
    pieces = Counter(r["unit_id"] for r in rows)
    assert set(pieces) == set(range(len(texts))) and all(n == 1 or len(texts[i]) // 4 > 100 for i, n in pieces.items())
    spans = sorted((r["start"], r["chars"]) for r in rows if r["unit_id"] == len(texts) - 1)
    assert sum(c for _, c in spans) == 5000 and spans[0][0] == 0
    assert set(used) == set(range(totals["requests"])) and totals["least"] <= totals["requests"] <= totals["least"] + 1


def test_one_length_for_all_and_no_units(spark):
    units = spark.createDataFrame([(i, "x" * 120) for i in range(1000)], "unit_id long, text string")
    placed, totals = pack(units, 100)
    assert totals["requests"] == 334 and placed.groupBy("request_id").count().where("count > 3").count() == 0
    assert placed.select("unit_id").distinct().count() == 1000
    placed, totals = pack(units.limit(0), 100)
    assert placed.count() == 0 and totals["requests"] == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. ,\n。é́😀", max_size=900), st.integers(20, 60), st.integers(0, 8))
def test_pieces_make_up_the_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    for (start, own, end), before in zip(pieces[1:], pieces, strict=False):
        assert own == before[2] and own - start <= overlap * 4 and start >= before[1]
        assert (end - start) // 4 <= limit
    assert (len(pieces) == 1) == (len(text) // 4 <= limit)


def test_natural_boundaries():
    text = "Dr. Sovel wrote i.e. 3.5 vs. 3.4, etc., in the chart on that day. " * 80
    for _, _, end in split_text(text)[:-1]:
        assert text[:end].endswith("day. ")
    paragraphs = "\n\n".join(["One line here.\nAnother line there."] * 200)
    assert all(paragraphs[:end].endswith("\n\n") for _, _, end in split_text(paragraphs, 500)[:-1])
    assert all(r.endswith(",") for r in (("12345,67890," * 900)[:e] for _, _, e in split_text("12345,67890," * 900)[:-1]))
    assert len(split_text("x" * 10_000)) == 3


def test_heading_and_edges(spark):
    units = spark.createDataFrame([(1, "p", "H", "word " * 2000, 5), (2, "p", None, "short", 1), (3, None, "H", None, 0), (4, "p", "H", "", 0), (1, "p", "H", "word " * 2000, 5)], "unit_id long, doc_path string, section_heading string, text string, piece int")
    rows = split_units(units).collect()
    assert {r["unit_id"] for r in rows} == {1} and {r["section_heading"] for r in rows} == {"H"}
    assert max(r["tokens"] for r in rows) <= 1000 and {r["piece"] for r in rows} == set(range(rows[0]["pieces"]))
    assert split_units(units.limit(0)).count() == 0
