import random

import pytest

from tideglass.llm.mixing import Rates, SourceClassifier, marks, mixed, shares

DOCS, TARGETS = "doc_id long, text string, source string, tokens int", "source string, target_share double, max_repeats int"
WORDS = {"a": "alpha beta gamma delta", "b": "uno due tre quattro", "c": "red green blue black"}


def corpus(sizes, none=0, seed=0):
    rng = random.Random(seed)
    out, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((k, " ".join(rng.choices(WORDS[s].split(), k=rng.randrange(5, 40))), s, 0))
            k += 1
    for _ in range(none):
        out.append((k, " ".join(rng.choices(WORDS["a"].split(), k=20)), None, 0))
        k += 1
    return out + [(k, None, "a", 0), (k + 1, "", "a", 0), (k + 2, " ".join(WORDS["a"]), "unlisted", 0)]


def mix(spark, docs, targets, **how):
    t = spark.createDataFrame(targets, TARGETS)
    sel = mixed(spark.createDataFrame(docs, DOCS), t, **how)
    return sel.collect(), {r.source: r for r in shares(sel, t).collect()}


def test_targets_are_met_within_caps(spark):
    sel, by = mix(spark, corpus({"a": 400, "b": 100, "c": 300}, none=20), [("a", 0.3, 1), ("b", 0.4, 4), ("c", 0.2, 2), ("gone", 0.1, 3)])
    assert by["a"].reached_share == pytest.approx(0.3 / 0.9, abs=0.01)
    assert by["b"].reached_share == pytest.approx(0.4 / 0.9, abs=0.01)
    assert by["gone"].reached_share == 0
    for s, cap in (("a", 1), ("b", 4), ("c", 2)):
        assert by[s].most_copies <= cap
    assert len({r.doc_id for r in sel}) == len(sel)
    assert all(r.copies >= 1 and r.tokens > 0 for r in sel)
    assert sum(r.source_is_predicted and r.source == "a" for r in sel) == sum(r.source_is_predicted for r in sel)


def test_a_fixed_total_leaves_short_sources_at_their_cap(spark):
    docs = corpus({"a": 300, "b": 10})
    sel, by = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=5000)
    assert all(r.copies == 2 for r in sel if r.source == "b") and by["b"].documents == 10
    assert by["a"].tokens == pytest.approx(2500, rel=0.03)


def test_one_source_long_document_and_empty(spark):
    sel, by = mix(spark, [(1, "word " * 50_000, "a", 0), (2, "few words", "a", 0)], [("a", 1.0, 1)])
    assert {r.doc_id for r in sel} == {1, 2} and by["a"].reached_share == 1
    assert mix(spark, [], [("a", 1.0, 1)])[0] == []
    assert mix(spark, corpus({"a": 5}), [])[0] == []
    assert mix(spark, [(1, None, "a", 0)], [("a", 1.0, 1)])[0] == []


def test_same_selection_every_time(spark):
    docs, t = corpus({"a": 60, "b": 60}), [("a", 0.7, 2), ("b", 0.3, 1)]
    assert sorted(mix(spark, docs, t)[0]) == sorted(mix(spark, docs[::-1], t)[0])


def test_classifier_on_held_out_texts():
    docs = [d for d in corpus({"a": 60, "b": 60, "c": 60}) if d[1] and d[2] in WORDS]
    model = SourceClassifier(["a", "b", "c"]).fit([marks(d[1]) for d in docs[::2]], [d[2] for d in docs[::2]])
    post = model.posterior([d[1] for d in docs[1::2]])
    assert post.sum(1) == pytest.approx(1)
    assert (post.argmax(1) == [["a", "b", "c"].index(d[2]) for d in docs[1::2]]).mean() > 0.95


def test_rates_stay_between_zero_and_cap():
    import numpy as np

    r = Rates()
    r.steps = [np.array([-5.0, 2.0]), np.array([1.0, -0.5])]
    x = r.of(np.array([[1.0, 0], [0, 1.0], [0.5, 0.5]]), np.array([2.0, 1.0, 1.0]))
    assert x.tolist() == [1.0, 0.5, 0.75]


def test_the_fit_says_how_settled_it_is(spark):
    sel, _ = mix(spark, corpus({"a": 200, "b": 100}, none=40), [("a", 0.5, 1), ("b", 0.5, 3)])
    assert len({r.unsettled for r in sel}) == 1 and sel[0].unsettled <= 1e-5
