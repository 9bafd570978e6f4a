import random

import numpy as np
import pytest

from tideglass.llm.subjects import BUCKETS, Model, Prepared, features, repaired, sentences, subjects_of, train

TOPICS = {"law": "court clause liability contract ruling", "sport": "goal match team referee season", "science": "entropy phase diffusion lattice energy"}
FILLER = "it was noted again before noon the point remains open for now"


def made(n, seed):
    rng = random.Random(seed)
    docs, truth = [], []
    for k in range(n):
        own = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        parts = []
        for s in own:
            parts += [f"the {rng.choice(TOPICS[s].split())} {' '.join(rng.sample(FILLER.split(), 4))}" for _ in range(5)]
        parts += [" ".join(rng.sample(FILLER.split(), 6)) for _ in range(3)]
        rng.shuffle(parts)
        docs.append((k, ". ".join(parts) + "."))
        truth += [(k, s) for s in own]
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = made(400, 1)
    labels = spark.createDataFrame([t for t in truth if t[0] % 2 == 0], "doc_id long, subject string")
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, " \n "), (903, "123 !!")], "doc_id long, text string")
    df = df.selectExpr("*", "1 AS share", "'x' AS subject", "2 AS subjects")
    model = train(df, labels.selectExpr("*", "'t' AS text"), sorted(TOPICS), steps=35, parts=3)
    got = {(r.doc_id, r.subject) for r in subjects_of(df, model).collect()}
    want = {t for t in truth if t[0] % 2}
    mine = {g for g in got if g[0] % 2 and g[0] < 900}
    assert len(mine & want) / len(want) > 0.95 and len(mine & want) / len(mine) > 0.95
    assert not {g for g in got if g[0] >= 900}
    whole = " ".join(d[1] for d in docs if (d[0], "law") in want and (d[0], "sport") not in want and (d[0], "science") not in want) * 20
    assert {r.subject for r in subjects_of(spark.createDataFrame([(1, whole)], "doc_id long, text string"), model).collect()} == {"law"}


def test_no_labels_no_subjects(spark):
    df = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = train(df, spark.createDataFrame([], "doc_id long, subject string"), ["x"])
    assert model is None and subjects_of(df, model).count() == 0
    assert subjects_of(df.limit(0), Model(["x"], BUCKETS, 4)).count() == 0


def test_parts_of_the_data_give_the_gradient_of_all():
    docs, truth = made(20, 2)
    texts = [sentences(d[1]) for d in docs]
    y = np.array([[1.0 if (d[0], s) in truth else 0.0 for s in sorted(TOPICS)] for d in docs], dtype=np.float32)
    v = Model(sorted(TOPICS), 4096, 4).values
    whole = Prepared(texts, 4096).gradient(v, y)
    a, b = Prepared(texts[:9], 4096).gradient(v, y[:9]), Prepared(texts[9:], 4096).gradient(v, y[9:])
    for k in whole:
        assert np.allclose(whole[k], a[k] + b[k], rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("name", ["embed", "out", "bias", "share", "steep"])
def test_gradient_against_differences(name):
    texts = [sentences("the court ruled. a goal was scored"), sentences("entropy grows")]
    y = np.array([[1.0, 0.0], [0.0, 1.0]])
    v = {k: x.astype(np.float64) for k, x in Model(["a", "b"], 64, 3).values.items()}

    def cost():
        *_, share = p.forward(v)
        q = 1 / (1 + np.exp(-v["steep"] * (share - v["share"])))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()

    p = Prepared(texts, 64)
    g = p.gradient(v, y)[name]
    at = np.unravel_index(np.abs(g).argmax(), g.shape)
    v[name][at] += 1e-4
    up = cost()
    v[name][at] -= 2e-4
    assert (up - cost()) / 2e-4 == pytest.approx(g[at], rel=0.02)


def test_words():
    assert sentences(None) == [] and sentences("  ") == []
    assert sentences("Die Größe, NOTÉ! 盘口价差被") == [["die", "große", "note"], ["盘口", "口价", "价差", "差被"]]
    assert repaired("Ohne RÃ¼ckstellung lÃ¤sst") == "Ohne Rückstellung lässt"
    assert repaired("Müller – gut") == "Müller – gut"
    assert len(set(features("court", 1 << 16))) > 5
