"""Packing: exact round trip of every id, gapless sequences, little padding."""

import random
import zlib

import numpy as np
import pytest

from loanlens.llm.packing import OpenWindows, WordTokenizer, pack_document, pack_documents, tokenizer_path

WORDS = ["Hello", "don't", "I'll", "naïve", "ÉCOLE,", "x1y22", "...", "a.b", "日本語", "<|endoftext|>", "éte", "ﬁne", "İ", " z", "a\x1cb", "word." * 30]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_word_ids_equal_whole_text_ids():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCZàâçéèêëîïôûùüÿñæœßøÀÉ"
    texts = ["", " \n", " ".join(WORDS)]
    for _ in range(60):
        texts.append("".join(rng.choice([" ", "\n", "\t", ". ", ", "]) if k % 2 else rng.choice(WORDS + ["".join(rng.choices(letters, k=rng.randint(1, 14)))] * 3)
                             for k in range(80)))
    small = WordTokenizer(tokenizer_path(), kept=50)  # forgets all the time
    for text, want in zip(texts, reference_ids(texts)):
        assert np.frombuffer(small.ids(text.encode()), dtype="<u4").tolist() == want[:-1]


def check(rows, got, window=4096):
    want = dict()
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        want.setdefault(i, []).append(ids)
    sequences = {}
    pieces = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for i, lists in want.items():
        assert sum(r.length for r in got if r.doc_id == i) == sum(map(len, lists))
        if len(lists) == 1:
            ids, at = np.array(lists[0], dtype="<u4"), 0
            for start, length, crc in sorted(pieces[(i, len(ids))]):
                assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
    return sequences


def test_round_trip(corpus):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 200, 900])))) for i in range(60)]
    rows += [(100, None), (101, "long text " * 9000), (None, "no id"), (7, rows[7][1]), (7, rows[7][1])]
    got = pack_documents(corpus(rows, 7), open_windows=2, fan_in=2).collect()
    sequences = check(rows, got)
    used = sum(r.length for r in got)
    assert len(sequences) * 4096 - used <= 4096 * 3  # padding in the last windows only


def test_empty_table(corpus):
    assert pack_documents(corpus([])).collect() == []


@pytest.mark.parametrize("limit", [1, 4])
def test_early_windows_are_full(limit):
    rng = random.Random(limit)
    windows = OpenWindows(limit, 64)
    for k in range(500):
        pack_document(windows, k, bytes(4 * rng.randint(1, 150)))
        assert len(windows.content) <= limit
    assert windows.closed and all(sum(p[2] for p in pieces) == 64 for _, pieces in windows.closed)
