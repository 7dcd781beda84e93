"""Containment search against sets of shingles of all pairs."""

import math
import random
import re

import pytest

from loanlens.llm.decontamination import decontaminate, find_leaks


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items, threshold):
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, x in items:
            s = shingles(x)
            if s and len(s & own) >= math.ceil(threshold * len(s) - 1e-9):
                out.append((d, i, len(s), len(s & own), len(s & own) / len(s), len(own)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(30)]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() for x in leak]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (None, items[9][1] + " tail"), (5, docs[5][1]), (300, items[0][1])]
    items += [(40, None), (41, ""), (42, "one"), (None, items[3][1]), (7, items[7][1])]
    return docs, items


@pytest.mark.parametrize("threshold,slice_shingles", [(0.75, 2_000_000), (0.4, 100), (1.0, 300)])
def test_equals_all_pairs(spark, corpus, threshold, slice_shingles):
    docs, items = data(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, threshold)
    assert sorted((tuple(r) for r in find_leaks(corpus(docs), bench, threshold, slice_shingles).collect()), key=str) == want
    left = sorted((r.doc_id, r.text) for r in decontaminate(corpus(docs), bench, threshold, slice_shingles).where("doc_id is not null").collect() if r.text)
    assert left == sorted((d, t) for d, t in docs if d is not None and t and not brute([(d, t)], items, threshold))


def test_empty_tables(spark, corpus):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = corpus([(1, "a b c d e f")])
    assert find_leaks(docs, bench).collect() == [] and decontaminate(docs, bench).count() == 1
    assert find_leaks(corpus([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
