import random
import re

import numpy as np
import pyarrow as pa

from loanlens.llm import common


def block(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    return data, np.r_[0, np.cumsum([len(t.encode()) for t in texts])]


def test_words_are_those_of_the_expression():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\t", "\x0b", "\x1c", "xy"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    value, owner = common.words(*block(texts))
    names, want = {}, []
    for i, t in enumerate(texts):
        want += [(i, w) for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    assert owner.tolist() == [i for i, _ in want]
    for h, (_, w) in zip(value.tolist(), want):
        assert names.setdefault(h, w) == w
    assert len(names) == len({w for _, w in want})


def test_long_text_in_pieces(monkeypatch):
    text = " ".join("w" * random.Random(k).randint(1, 40) + str(k % 50) for k in range(2000)) + " " + "z" * 5000
    whole = common.words(*block([text]))
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    pieces = common.words(*block([text]))
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_blocks_cover_all_rows():
    rng = random.Random(2)
    texts = [b"x" * rng.choice([0, 1, 5000, 700_000]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.binary())], names=["body"]).slice(3)
    rows = []
    for start, end, data, offsets in common.blocks(batch):
        assert len(data) <= common.BLOCK_BYTES or end == start + 1
        rows += [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    assert rows == texts[3:]


def test_sliding_hashes_name_their_bytes():
    data = np.frombuffer(b"abcabcabdabc" * 3, dtype=np.uint8)
    hashes = common.Windows(data).sliding(5)
    names = {}
    for i, h in enumerate(hashes.tolist()):
        assert names.setdefault(data[i : i + 5].tobytes(), h) == h
    assert len(set(names.values())) == len(names)


def test_local_temporary_folder_only_for_local_sessions(spark):
    assert common.shared_dir(spark) != common.shared_dir(spark)
