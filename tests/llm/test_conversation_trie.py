"""The vertical-bitmap trie against dictionaries over whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loanlens.llm.conversation_trie import prefix_trie


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(seed=1, convs=120):
    """Copies, shared openings, ties, nulls, repeated rows, gaps in the ids and negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), convs):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12, 20])
        for t in range(n):
            text = rng.choice(["hi", "hi", "ä, long", "", None, "b"])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 0, t]), rng.choice(["user", "user", None]), text))
    rows += rows[:10]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]
    rows += [(None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("shard,segment", [(1024, 256), (7, 4), (3, 1)])
def test_equals_brute_force(spark, shard, segment):
    rows = made()
    got = [tuple(r) for r in prefix_trie(frame(spark, rows).repartition(3), shard, segment).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_long_conversation_and_long_text(spark):
    """Copies of a conversation of 700 turns, one text of a megabyte."""
    rows = [(c, t, "user", f"turn {t}" + ("x" * 1_000_000 if t == 650 else "")) for c in (5, 6, 15) for t in range(700)]
    rows += [(6, 700, "user", "more"), (25, 0, "user", "turn 0")]
    got = [tuple(r) for r in prefix_trie(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_tables_and_extra_columns(spark):
    assert prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    one = frame(spark, [(5, 0, None, None)]).withColumns({c: F.lit("x") for c in ("conv", "place", "shard", "seg", "depth", "key1", "_place", "_salt", "_at")})
    assert sorted((tuple(r) for r in prefix_trie(one).collect()), key=str) == brute([(5, 0, None, None)])
