"""PU classifier: held-out accuracy, and that labels reach only the fit."""

import random
import zlib

import numpy as np
import pytest

from loanlens.llm.quality_classifier import FIGURES, figures, gradient, risk, score_quality


def make(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "er", "ou", "ti", "on", "sh", "ble"]
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        junk = rng.random() < 0.2
        if junk:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [w[0]] * len(w) if kind == 1 else [x + " |" for x in w]
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(not junk), 0))
    return docs, labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = make(900, 1)
    truth = {i: q for i, q, _ in labels}
    got = {r.doc_id: r for r in score_quality(corpus(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 900
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(got[i].predicted == 1 for i in held if truth[i] == 1)
    # held-out labels are not used
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in score_quality(corpus(docs), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows(spark, corpus):
    docs, labels = make(60, 2)
    docs += [(None, "no id"), (100, None), (101, ""), (5, docs[5][1]), (102, " \n"), (103, "x" * 300_000)]
    labels += [(5, None, 0), (None, 1, 0), (5, 1, 1)]
    got = score_quality(corpus(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_no_labels_and_empty_table(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(corpus([(1, "a"), (2, "b")]), none).collect()} == {0.5}
    assert score_quality(corpus([]), none).collect() == []


def test_figures_do_not_depend_on_neighbours():
    texts = ["Some words here", "", "UPPER CASE!! text", "a a a a"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = figures(data, offsets)
    assert whole.shape == (4, FIGURES)
    for k, t in enumerate(texts):
        one = figures(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]))
        assert np.allclose(one[0], whole[k])


@pytest.mark.parametrize("prior, reversed_part", [(0.5, False), (0.9, True)])
def test_gradient_equals_finite_differences(prior, reversed_part):
    rng = np.random.default_rng(5)
    positive, unlabelled = rng.normal(1, 1, (40, 6)), rng.normal(0, 1, (70, 6))
    params = [rng.normal(0, 0.5, (6, 3)), rng.normal(0, 0.5, 3), rng.normal(0, 1, 3), np.array(-1.0 if reversed_part else 0.3)]
    if reversed_part:  # unlabelled rows all far on the negative side
        unlabelled = unlabelled - 3
        params[0] = np.abs(params[0])
        params[2] = np.abs(params[2]) * 3

    def value():
        first, second = risk(params, positive, unlabelled, prior)
        assert (second < 0) == reversed_part
        return -second if reversed_part else first + second

    for w, got in zip(params, gradient(params, positive, unlabelled, prior)):
        for at in np.ndindex(w.shape):
            old = w[at].copy()
            w[at] = old + 1e-5
            more = value()
            w[at] = old - 1e-5
            less = value()
            w[at] = old
            assert abs((more - less) / 2e-5 - got[at]) < 1e-6


def test_partitions_and_order_of_sums_do_not_matter_to_repeat(spark, corpus):
    docs, labels = make(300, 6)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = [{r.doc_id: r.score for r in score_quality(corpus(docs, 5), table).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
