"""Jaccard components against a comparison of all pairs of documents."""

import random
import re

import numpy as np
import pytest

from loanlens.llm.jaccard_join import jaccard_components, similar


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted([(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)], key=str)


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(1000)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(corpus, seed):
    rng = random.Random(seed)
    rows = []
    common = [f"c{k}" for k in range(40)]
    for _ in range(12):
        base = [f"w{rng.randrange(1000)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            w = near(rng, base, rng.randint(0, 5))
            rows.append((len(rows), " ".join(w if rng.random() < 0.5 else w + common)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "two words"), (5, rows[5][1]), (5, "other text for a used id")]
    rows += [(None, rows[9][1]), (None, "only a null id has this text here"), (906, "é ü ß a b c"), (907, "É ü ß a b c")]
    assert sorted((tuple(r) for r in jaccard_components(corpus(rows)).collect()), key=str) == brute(rows)


def test_a_hot_group_and_a_hot_passage(corpus):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(80)]
    rows = [(i, " ".join(near(rng, base, rng.randint(0, 3)))) for i in range(60)]
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(100 + i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 14)))) for i in range(60)]
    assert sorted((tuple(r) for r in jaccard_components(corpus(rows)).collect()), key=str) == brute(rows)


def test_empty_table(corpus):
    assert jaccard_components(corpus([])).collect() == []


def test_similar_at_the_border():
    a = np.arange(100, dtype=np.uint64)
    assert similar(a, np.r_[a[:75]])
    assert not similar(a, a[:74])
