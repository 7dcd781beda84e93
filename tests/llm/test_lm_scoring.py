"""Elias-Fano trie and language model against plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loanlens.llm import elias_fano
from loanlens.llm.lm_scoring import quantised, score_documents


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 5), (1000, 1001), (3000, 10**6), (2000, 2**64 - 1)])
def test_elias_fano(n, top):
    rng = random.Random(n)
    keys = np.array(sorted({rng.randrange(top) for _ in range(n)} | ({top - 1} if n else set())), dtype=np.uint64)
    code = elias_fano.EliasFano(elias_fano.encode(keys))
    assert code.keys().tolist() == keys.tolist()
    assert code.find(keys).tolist() == list(range(len(keys)))
    place = {int(k): i for i, k in enumerate(keys)}
    asked = sorted({rng.randrange(top) for _ in range(500)} | {0, top - 1})
    assert code.find(np.array(asked, dtype=np.uint64)).tolist() == [place.get(a, -1) for a in asked]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Plain:
    def __init__(self, rows, order, min_count, discount):
        self.order, self.d = order, discount
        train = [tokens(t) for i, t in rows if not held(i)]
        self.grams = [Counter() for _ in range(order + 1)]
        for t in train:
            self.grams[1].update((x,) for x in t)
            seq = [None, *t]
            for k in range(2, order + 1):
                self.grams[k].update(tuple(seq[j : j + k]) for j in range(len(seq) - k + 1))
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])
        self.kept = [None, self.grams[1], *[{g: c for g, c in self.grams[k].items() if c >= min_count} for k in range(2, order + 1)]]
        self.share = [None] + [Counter() for _ in range(order)]
        for k in range(2, order + 1):
            for g, c in self.kept[k].items():
                self.share[k - 1][g[:-1]] += max(c - discount, 0) / self.kept[k - 1][g[:-1]]

    def p(self, context, w):
        if not context:
            return (self.grams[1][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        shorter = self.p(context[1:], w)
        if context not in self.kept[len(context)]:
            return shorter
        c = self.kept[len(context) + 1].get((*context, w), 0)
        return (max(c - self.d, 0) / self.kept[len(context)][context] if c else 0) + (1 - self.share[len(context)][context]) * shorter

    def score(self, text):
        seq = [None, *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, j - self.order + 1) : j]), seq[j])) for j in range(1, len(seq)))


def rows_of(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(40)]
    rows = []
    for i in range(n):
        w, out = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 60)):
            out.append(w)
            w = vocabulary[(vocabulary.index(w) * 3 + rng.randrange(3)) % 40] if rng.random() < 0.9 else f"rare{rng.randrange(500)}"
            w = w if w in vocabulary else rng.choice(vocabulary)
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("order,min_count", [(1, 1), (2, 1), (3, 2), (4, 2)])
def test_equals_plain_model(corpus, order, min_count):
    rows = rows_of(order) + [(500, None), (501, ""), (502, "never seen é words W1 W2"), (503, "never seen here"), (None, "W1 W3 W9"), (7, "W1 W2"), (7, "W1 W2")]
    plain = Plain(rows, order, min_count, 0.75)
    got = sorted(score_documents(corpus(rows), order, min_count).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        t = min(texts[r.doc_id], key=lambda x: abs(len(tokens(x)) - r.n_tokens))
        w = tokens(t)
        assert (r.n_tokens, r.held_out, r.train_tokens) == (len(w), held(r.doc_id), plain.n)
        assert r.n_known == sum(plain.grams[1][(x,)] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10(plain.p((), x)) for x in w), rel_tol=1e-9)
        assert abs(r.score - plain.score(t)) <= 0.03 * len(w)  # codes are bin means
    if order > 1:
        out = [r for r in got if r.held_out and r.n_tokens > 5 and r.doc_id < 200]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_default_stores_ngrams_seen_once(corpus):
    once = " ".join(f"once{k}" for k in range(25))
    trained, asked = next(i for i in range(600, 700) if not held(i)), next(i for i in range(600, 700) if held(i))
    rows = [*rows_of(8, 60), (trained, once), (asked, once)]
    plain = Plain(rows, 3, 1, 0.75)
    got = {r.doc_id: r.score for r in score_documents(corpus(rows)).collect()}
    for i, t in rows:
        assert abs(got[i] - plain.score(t)) <= 0.03 * len(tokens(t))
    assert got[asked] > Plain(rows, 3, 2, 0.75).score(once) + 0.5 * len(tokens(once))


def test_probabilities_sum_to_one():
    plain = Plain(rows_of(9), 3, 2, 0.75)
    for context in [(), ("w1",), ("w1", "w3"), (None,), (None, "w2")]:
        every = sum(plain.p(context, w) for (w,) in plain.grams[1]) + plain.p(context, "unseen")
        assert math.isclose(every, 1, rel_tol=1e-9)


def test_empty_tables(corpus):
    assert score_documents(corpus([])).collect() == []
    only_held = [i for i in range(50) if held(i)][:2]
    got = score_documents(corpus([(i, "a b") for i in only_held])).collect()
    assert [(r.train_tokens, r.n_known, r.score, r.base_score) for r in got] == [(0, 0, 0.0, 0.0)] * 2


def test_codes_keep_the_mean():
    values = np.random.default_rng(1).normal(size=5000)
    code, book = quantised(values)
    assert code.dtype == np.uint8 and abs(book[code].mean() - values.mean()) < 1e-9 and np.abs(book[code] - values).mean() < 0.02
