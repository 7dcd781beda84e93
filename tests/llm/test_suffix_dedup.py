"""Repeated byte strings against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from loanlens.llm.suffix_dedup import remove_repeats, repeated_spans


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, length):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(rng.randint(length - 3, 4 * length)) for _ in range(4)]
    rows = []
    for i in range(40):
        t = "".join(rng.choice([word(rng.randint(0, 2 * length)), rng.choice(shared)]) for _ in range(rng.randint(1, 4)))
        rows.append((i, t))
        if rng.random() < 0.3:  # a near copy
            k = rng.randrange(len(t) + 1)
            rows.append((100 + i, t[:k] + "#" + t[k:]))
    return rows


@pytest.mark.parametrize("length,group_rows", [(20, 20_000), (21, 2), (40, 3)])
def test_equals_brute_force(corpus, length, group_rows):
    rows = texts(length, length) + [(900, None), (901, ""), (902, "a" * 100), (903, "ab" * 70), (None, "xyz" * 30), (7, "dup" * 20), (7, "dup" * 20)]
    assert got(remove_repeats(corpus(rows), length, group_rows)) == brute(rows, length)


def test_all_unique_and_empty_table(corpus):
    rows = [(1, "abcdefghij"), (2, "klmnopqrst")]
    assert got(remove_repeats(corpus(rows), 4)) == brute(rows, 4)
    assert remove_repeats(corpus([]), 4).collect() == []


def test_long_text_is_cut_into_parts(corpus, monkeypatch):
    from loanlens.llm import suffix_dedup

    rng = random.Random(5)
    body = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(1, body + "#" + body[500:900]), (2, "x" + body[2000:2200])]
    assert got(remove_repeats(corpus(rows), 50)) == brute(rows, 50)


def test_thousands_of_equal_rows_have_the_spans_of_one(corpus):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh") for _ in range(1500))
    rows = [(None, body)] * 3000 + [(1, "x" * 5 + body[200:300] + "y"), (2, "nothing here is twice")]
    spans = repeated_spans(corpus(rows), 40).collect()
    assert len(spans) == len(set(spans)) <= len(body)
    out = got(remove_repeats(corpus(rows), 40))
    assert Counter(out) == Counter(brute(rows[-4:], 40)) + Counter({x: 2998 for x in out if x[0] is None})


def test_contract_length_decides_on_planted_passages(corpus):
    """Passages of over 50 words: removed from 400 equal bytes on, left alone below; a shorter `length` finds them all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    short, long = prose(55), prose(57) + "!!"
    assert (len(short), len(long)) == (384, 400)
    # no two rows have the same byte before or after their passage; ids 3 to 5 share all but the last byte of `long`
    passages = [short] * 3 + [long[:-1]] * 3 + [long] * 3
    rows = [(k, f"{prose(30)}{chr(65 + k)}{p}{chr(65 + k)}{prose(30)}") for k, p in enumerate(passages)]
    rows += [(100 + i, prose(150)) for i in range(3)]
    result = got(remove_repeats(corpus(rows)))
    assert result == brute(rows, 400)
    assert {r[0]: r[2:4] for r in result if r[2]} == {6: (400, 1), 7: (400, 1), 8: (400, 1)}
    at_250 = {r[0]: r[2] for r in got(remove_repeats(corpus(rows), 250))}
    assert at_250 == {**{k: len(p) for k, p in enumerate(passages[:6])}, 6: 400, 7: 400, 8: 400, 100: 0, 101: 0, 102: 0}
