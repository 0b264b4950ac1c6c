import random

import numpy as np
import pytest

from tamarack.llm import leakage
from tamarack.llm.words import words

STANDING = "Answer from the tables in the context folder only."


def name(rng):
    return "".join(rng.choice(["vel", "tor", "min", "dra", "phi", "lu", "sto", "qui", "bra", "ne"]) for _ in range(4)).capitalize()


def make_items(n=40, seed=1):
    rng = random.Random(seed)
    fill = "for the entries of this ledger give every share once that weekly tally reads past and split by".split()
    items = []
    for i in range(n):
        body = " ".join(rng.choice(fill) if rng.random() < 0.7 else name(rng) for _ in range(40))
        items.append((i, f"{body}. {STANDING}" if i % 2 else f"{STANDING} {body}."))
    return items


def brute(doc, items):
    return {i for i, text in items if any(exact(words(doc), run) for run in [words(text.replace(STANDING, ""))])}


def exact(doc, item):
    """Substitutions only, straight from the definition."""
    for a in range(len(item)):
        for b in range(a + 12, len(item) + 1):
            part = item[a:b]
            for s in range(len(doc) - len(part) + 1):
                wrong = sum(x != y for x, y in zip(doc[s : s + len(part)], part, strict=True))
                if 6 * wrong <= len(part) and doc[s] == part[0] and doc[s + len(part) - 1] == part[-1]:
                    return True
    return False


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in leakage.leaked_items(d, i).collect()}


def test_settings_of_a_leak(spark):
    items = make_items()
    own = items[4][1].replace(STANDING, "").strip()
    part = " ".join(own.split()[5:22])
    docs = [
        (0, f"Before it. {part} and after"),
        (1, part.upper().replace(" ", "\n")),
        (2, "- " + part.replace(" ", " <b>") + "</b>"),
        (3, part[:30] + "​" + part[30:]),
        (4, " ".join(w if k % 8 != 5 else "changed" for k, w in enumerate(part.split()))),
        (5, " ".join(own.split()[5:14])),
        (6, STANDING * 3),
        (7, None),
        (8, ""),
        (9, "é".join(["nothing to see"] * 50)),
        (10, " ".join(w if k % 3 else "changed" for k, w in enumerate(own.split()))),
    ]
    assert found(spark, docs, items) == {(k, 4) for k in range(5)}


def test_recall_against_brute_force(spark):
    """Stretches of 12 to 20 words with up to one word in six changed, at any place."""
    items = make_items(30, 7)
    rng, docs = random.Random(9), []
    for k in range(150):
        text = items[rng.randrange(len(items))][1].replace(STANDING, "").strip().rstrip(".").split()
        n = rng.randint(12, 20)
        s = rng.randrange(len(text) - n)
        part = text[s : s + n]
        for p in rng.sample(range(1, n - 1), rng.randint(0, n // 6)):
            part[p] = name(rng)
        docs.append((k, " ".join([name(rng) for _ in range(20)] + part + [name(rng) for _ in range(20)])))
    want = {(k, i) for k, text in docs for i in brute(text, items)}
    got = found(spark, docs, items)
    assert len(want) >= 100 and len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("size", [4, 1])
def test_blocks_of_items_agree(spark, monkeypatch, size):
    items = make_items(12, 3)
    docs = [(k, t) for k, t in items] + [(100 + k, " ".join(items[k][1].split()[8:24] + items[k + 1][1].split()[5:30])) for k in range(0, 10)]
    whole = found(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", size)
    assert whole == found(spark, docs, items)
    assert {(k, k) for k, _ in items} <= whole


def test_empty_tables(spark):
    assert found(spark, [], make_items(3)) == set()
    assert found(spark, [(1, "x " * 50)], []) == set()
    assert found(spark, [(1, "x " * 50)], [(1, None), (2, "too short")]) == set()


def test_keys_depend_on_the_words_alone():
    one = leakage.ItemIndex([(1, [f"w{i}" for i in range(20)])], {"w3"})
    two = leakage.ItemIndex([(1, [f"w{i}" for i in range(20)]), (2, [f"a{i}" for i in range(30)])], {"w3"})
    keys = lambda index: leakage.keys_of(np.array([[index.lexicon[f"w{i}"] for i in range(12)]]), np.array(index.codes, np.uint64))
    assert (keys(one) == keys(two)).all() and keys(one).shape == (leakage.WALKS * leakage.SAMPLES, 1)
    bits = leakage.goes_on(np.arange(1, 20_000, dtype=np.uint64))
    assert abs(bits.mean() - 0.5) < 0.01


def test_stretch_counts_edits():
    item = list(range(30))
    assert leakage.longest_stretch(item, item, {5})[0] == 30
    assert leakage.longest_stretch(item, item, set()) == [0, 0, 0, 0]
    assert leakage.longest_stretch([*range(8), *range(9, 20)], item, {5})[:2] == [8, 20]
    assert leakage.longest_stretch([*range(8), 99, *range(8, 20)], item, {5})[:2] == [12 if 5 >= 8 else 8, 20]


def test_windows_that_may_match():
    rng = random.Random(5)
    item = [rng.randrange(40) for _ in range(60)]
    places: dict[int, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    for _ in range(300):
        p = rng.randrange(len(item) - 16)
        window = item[p : p + 12]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(window))
            window = rng.choice([window[:k] + [99] + window[k + 1 :], window[:k] + window[k + 1 :] + [item[p + 12]], (window[:k] + [99] + window[k:])[:12]])
        assert leakage.may_match(window, places)
    assert not leakage.may_match([99] * 12, places) and not leakage.may_match(item[:12][::-1], {w: [k] for k, w in enumerate(range(100, 160))})
