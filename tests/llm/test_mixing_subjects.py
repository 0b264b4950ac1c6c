import random
from collections import Counter

import numpy as np
import pytest

from tamarack.llm import mixing, subjects

DOCS = "doc_id long, text string, source string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in (("big one", 300), ("small", 60), ("tiny", 12)):
        for _ in range(n):
            rows.append((len(rows), " ".join(rng.choice([f"{s.split()[0]}word", "the", "of"]) for _ in range(rng.randint(1, 60))), rng.choice([s, s.upper(), f" {s} ", s.replace(" ", "_")]), 0))
    return [*rows, (9000, None, "small", 0), (9001, "", "small", 0), (9002, "bigword other", "elsewhere", 0), (9003, "bigword bigword the of", None, 0)]


def test_shares_are_met(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.1, 8), ("nothing", 0.0, 3)], TARGETS)
    drawn = mixing.draw(docs, targets)
    rows = drawn.collect()
    total = sum(r["tokens"] * r["copies"] for r in rows)
    most = {"big_one": 1, "small": 4, "tiny": 8}
    by = Counter()
    for r in rows:
        by[r["source"]] += r["tokens"] * r["copies"]
        assert 1 <= r["copies"] <= most[r["source"]]
    for s, share in (("big_one", 0.6), ("small", 0.3), ("tiny", 0.1)):
        assert by[s] / total == pytest.approx(share, abs=0.02)
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {9000, 9001, 9002} & {r["doc_id"] for r in rows}
    report = {r["source"]: r for r in mixing.share_report(drawn, targets).collect()}
    assert report["nothing"]["documents"] == 0 and report["small"]["actual_share"] == pytest.approx(by["small"] / total)


def test_source_far_too_small_falls_short(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 1)], TARGETS)
    rows = mixing.draw(docs, targets, shortfall=0.2).collect()
    tiny = [r for r in rows if r["source"] == "tiny"]
    assert len(tiny) >= 10 and {r["copies"] for r in tiny} == {1}
    assert sum(1 for r in rows if r["source"] == "big_one") > 200


def test_without_shortfall_the_smallest_source_limits_the_total(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 1)], TARGETS)
    rows = mixing.draw(docs, targets).collect()
    total = sum(r["tokens"] * r["copies"] for r in rows)
    assert sum(r["tokens"] for r in rows if r["source"] == "tiny") / total == pytest.approx(0.2, abs=0.05)


def test_soft_membership_meets_targets_that_hard_assignment_misses():
    """Half of the tokens are of documents that are two thirds a and one third b: counted as a's they hide a third of what b gets."""
    weight, member, most = np.array([100.0, 100.0, 200.0]), np.array([[1, 0], [0, 1], [2 / 3, 1 / 3]]), np.ones(3)
    target = np.array([150.0, 150.0])
    soft = (mixing.fit_rates(weight, member, most, target) * weight) @ member
    assert soft == pytest.approx(target, rel=1e-6)
    hard = (mixing.fit_rates(weight, member.round(), most, target) * weight) @ member
    assert abs(hard - target).max() > 15


def test_mixed_documents_without_source_are_drawn(spark):
    rng = random.Random(8)
    say = lambda *names: " ".join(rng.choice([f"{n}word{rng.randint(1, 3)}" for n in names]) for _ in range(20))
    docs = [(i, say("alpha" if i % 2 else "beta"), "alpha" if i % 2 else "beta", 0) for i in range(200)] + [(1000 + i, say("alpha", "beta"), None, 0) for i in range(60)]
    targets = spark.createDataFrame([("alpha", 0.5, 1), ("beta", 0.5, 1)], TARGETS)
    rows = mixing.draw(spark.createDataFrame(docs, DOCS), targets).collect()
    assert sum(r["doc_id"] >= 1000 for r in rows) >= 55
    assert {r["source"]: r["actual_share"] for r in rows} == pytest.approx({"alpha": 0.5, "beta": 0.5}, abs=0.02)


def test_parts():
    assert mixing._parts(np.array([1.0, 0.0])) == (0, -1, 16, 0)
    assert mixing._parts(np.array([0.3, 0.0, 0.7])) == (2, 0, 11, 5)
    assert mixing._parts(np.array([0.01, 0.01]))[2] == 0


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.draw(docs, targets).count() == 0
    assert mixing.draw(spark.createDataFrame(corpus(), DOCS), targets).count() == 0
    assert mixing.draw(spark.createDataFrame(corpus(), DOCS), targets.limit(0)).count() == 0


def test_reachable_total():
    assert mixing.reachable_total({"a": 100, "b": 60}, {"a": 0.5, "b": 0.5}) == 120
    few = ({"a": 100, "b": 90, "c": 1}, {"a": 0.4, "b": 0.4, "c": 0.2})
    assert mixing.reachable_total(*few) == 5
    # A fifth may be missed: all of c, and of b what 227.5 tokens ask beyond its 90.
    assert mixing.reachable_total(*few, 0.2) == pytest.approx(227.5)
    assert mixing.reachable_total(*few, 0.1) == pytest.approx(10)
    assert mixing.reachable_total({}, {}) == 0.0


AREAS = {"sport": "the driver won the race on worn tyres at the old circuit".split(), "law": "the judge read the verdict of the court to both parties".split(), "food": "stir the flour into melted butter and bake the bread slowly".split()}


def text(rng, area, n):
    return " ".join(" ".join(rng.sample(AREAS[area], 6)).capitalize() + f" {rng.randint(1, 99)}." for _ in range(n))


def test_subjects_from_few_seeds(spark):
    rng = random.Random(4)
    names = list(AREAS)
    docs, truth = [], {}
    for i in range(400):
        kind = i % 5
        if kind < 3:
            truth[i] = {names[kind]}
            docs.append((i, text(rng, names[kind], 8), "z"))
        elif kind == 3:
            truth[i] = {"sport", "law"}
            docs.append((i, text(rng, "sport", 5) + "\n\n" + text(rng, "law", 4), "z"))
        else:
            truth[i] = {"food"}
            docs.append((i, text(rng, "food", 12) + " " + text(rng, "law", 1), "z"))
    docs += [(9000, None, "z"), (9001, "", "z"), (9002, "unrelated words without any kin whatsoever.", "z")]
    labels = [(i, s.upper() if i == 0 else s) for i in range(0, 400, 9) for s in truth[i]] + [(0, "sport")] + [(1, "food"), (77777, "law"), (5, None), (5, "unheard")]
    d = spark.createDataFrame(docs, "doc_id long, text string, share string")
    shares = subjects.subject_shares(d, spark.createDataFrame(labels, "doc_id long, subject_id string"), names)
    got: dict[int, set] = {}
    for r in subjects.document_subjects(shares).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    right = sum(got.get(i) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth) and not {9000, 9001} & set(got)
    total = subjects.corpus_shares(shares, d).collect()
    assert {r["subject_id"] for r in total} == set(names) and sum(r["share"] for r in total) <= 1.000001


def test_hubs_prove_four_fifths():
    """Sets that meet at a hub share four fifths of the larger one's terms; those that differ in one term always meet."""
    rng = random.Random(3)
    numbers = [rng.getrandbits(62) for _ in range(40)]

    def hubs(terms, rare):
        whole = 0
        for t in terms:
            whole ^= t
        if len(terms) >= 10:
            return {whole, whole ^ rare, *(whole ^ rare ^ t for t in terms if t != rare)}
        return {whole, *(whole ^ t for t in terms)} if len(terms) >= 5 else {whole}

    met = 0
    for _ in range(4000):
        a = set(rng.sample(numbers, rng.randint(3, 14)))
        b = set(a)
        for t in rng.sample(sorted(a), min(len(a), rng.randint(0, 2))):
            b.remove(t)
            if rng.random() < 0.8:
                b.add(rng.choice(numbers))
        if not b:
            continue
        meet = bool(hubs(a, min(a)) & hubs(b, min(b)))
        share = len(a & b) / max(len(a), len(b))
        met += meet
        assert not meet or share >= 0.8
        if len(a - b) <= 1 and len(b - a) <= 1 and share >= 0.8:
            assert meet
    assert met > 500


def test_links_against_all_pairs(spark, sf):
    """Of all pairs of passages that share four fifths of the larger one's terms, at least nine tenths meet at a hub, and no others."""
    from tamarack.session import load

    docs = load(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    read = subjects.sentences(docs).where("terms is not null").select("passage", "lang", "terms").dropDuplicates(["passage"])
    spelled = read.collect()
    found = subjects.passage_hubs(spark.createDataFrame(spelled, read.schema)).where("hub is not null").collect()
    at: dict[int, list[int]] = {}
    for r in found:
        at.setdefault(r["hub"], []).append(r["passage"])
    place = {r["passage"]: k for k, r in enumerate(spelled)}
    meet = np.zeros((len(spelled), len(spelled)), bool)
    for members in at.values():
        rows = np.array([place[m] for m in members])
        meet[np.ix_(rows, rows)] = True
    words = {t: k for k, t in enumerate(sorted({t for r in spelled for t in r["terms"]}))}
    held = np.zeros((len(spelled), len(words)), np.float32)
    for k, r in enumerate(spelled):
        held[k, [words[t] for t in r["terms"]]] = 1
    size = held.sum(1)
    linked = both = wrong = 0
    for k in range(0, len(spelled), 500):
        like = held[k : k + 500] @ held.T >= 0.8 * np.maximum(size[k : k + 500, None], size[None, :]) - 1e-4
        like[np.arange(len(like)), np.arange(k, k + len(like))] = False
        own = meet[k : k + 500].copy()
        own[np.arange(len(own)), np.arange(k, k + len(own))] = False
        linked, both, wrong = linked + like.sum(), both + (like & own).sum(), wrong + (own & ~like).sum()
    assert wrong == 0 and both >= 0.9 * linked


def test_trusted_seeds_are_clamped(spark):
    """A label stands when the graph finds a tenth of it; a label that nothing bears out does not."""
    rng = random.Random(6)
    docs = [(i, text(rng, "law" if i % 2 else "sport", 6)) for i in range(300)] + [(1000, text(rng, "sport", 9) + " " + text(rng, "law", 2)), (1001, text(rng, "sport", 9))]
    labels = [(i, "law" if i % 2 else "sport") for i in range(0, 300, 7)] + [(1000, "sport"), (1000, "law"), (1001, "law")]
    shares = subjects.subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject_id string"), list(AREAS))
    got = {(r["doc_id"], r["subject_id"]) for r in subjects.document_subjects(shares).where("doc_id >= 1000").collect()}
    assert got == {(1000, "sport"), (1000, "law"), (1001, "sport")}


def test_subject_of_few_documents(spark):
    """A subject with less than 0.2 % of a language's documents is told by the terms that its few documents share."""
    rng = random.Random(5)
    docs = [(i, text(rng, "law" if i % 2 else "sport", 2)) for i in range(2500)] + [(9000 + i, text(rng, "food", 6)) for i in range(4)]
    labels = [(i, "law" if i % 2 else "sport") for i in range(0, 2500, 9)] + [(9000, "food"), (9001, "food")]
    shares = subjects.subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject_id string"), list(AREAS))
    assert {r["doc_id"] for r in subjects.document_subjects(shares).where("subject_id = 'food'").collect()} == {9000, 9001, 9002, 9003}


def test_subjects_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "the race was won.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject_id string")
    assert subjects.subject_shares(d, none, ["sport"]).count() == 0
    assert subjects.subject_shares(d.limit(0), none, ["sport"]).count() == 0
    assert subjects.subject_shares(d, none, []).count() == 0


def test_held_out_labels(spark, sf):
    """Labels of every fifth labelled document are hidden and come back; readers err in a few."""
    from tamarack.session import load

    mid = sf.replace("sf0.001", "sf0.01")
    labels = load(spark, mid, "doc_subject_label")
    areas = sorted(r[0] for r in load(spark, mid, "subject_area").select("subject_id").collect())
    hidden = {}
    for r in labels.collect():
        if r["doc_id"] % 5 == 0:
            hidden.setdefault(r["doc_id"], set()).add(r["subject_id"])
    shares = subjects.subject_shares(load(spark, mid, "documents"), labels.where("doc_id % 5 <> 0"), areas)
    got: dict[int, set] = {}
    for r in subjects.document_subjects(shares).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    assert sum(bool(got.get(i, set()) & s) for i, s in hidden.items()) >= 0.75 * len(hidden)
