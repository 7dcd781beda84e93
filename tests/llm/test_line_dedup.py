"""Line dedup against a search of every run at every earlier place."""

import random

import pytest

from loanlens.llm.line_dedup import dedup_lines


def brute(rows, min_words):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [[x for x in (y.strip() for y in t.split("\n")) if x] for _, t in docs]
    words = [[len(x.split()) for x in d] for d in lines]
    gone = [set() for _ in docs]
    for b in range(len(docs)):
        for j in range(len(lines[b])):
            for a in range(b + 1):
                for i in range(len(lines[a]) if a < b else j):
                    n = 0
                    while j + n < len(lines[b]) and i + n < len(lines[a]) and lines[a][i + n] == lines[b][j + n]:
                        n += 1
                    if sum(words[b][j : j + n]) >= min_words:
                        gone[b].update(range(j, j + n))
    out = {}
    for (i, t), g in zip(docs, gone):
        kept, k = [], 0
        for line in t.split("\n"):
            if line.strip():
                if k not in g:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        out[(i, t)] = ("\n".join(kept), len(g))
    return out


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_equals_brute_force(corpus, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), "", f"own {i} {k}"]) for k in range(rng.randint(0, 14)))) for i in range(25)]
    rows += [(50, rows[3][1]), (51, rows[7][1] + "\nmore"), (52, "a b c\n" * 8), (None, rows[5][1]), (53, None), (54, ""), (55, " \n\t\n")]
    want = brute(rows, min_words)
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(corpus(rows), min_words).collect()}
    assert got == {i: want.get((i, t), (None, 0)) for i, t in rows}


def test_equal_rows_get_one_result_and_first_copy_stays(corpus):
    run = "\n".join(f"line {k} of a long shared run" for k in range(10))
    rows = [(1, run), (1, run), (2, "intro\n" + run + "\noutro"), (3, "clean text")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in dedup_lines(corpus(rows)).collect())
    assert got == [(1, run, 0), (1, run, 0), (2, "intro\noutro", 10), (3, "clean text", 0)]


def test_empty_table(corpus):
    assert dedup_lines(corpus([])).collect() == []
