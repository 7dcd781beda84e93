"""Packing token sequences into windows by bounded-space online best-fit.

Each input partition keeps at most `open_windows` windows open. A document
longer than a window fills whole windows first; its rest goes to the open
window with the least room that holds it. If none does and no more windows
may be opened, the fullest one is topped up with the head of the rest (a cut)
and emitted full. So a window emitted early has no padding at all. What is
still open at the end of a partition is merged in rounds: `fan_in` groups of
leftovers at a time are packed best-fit-decreasing, whole pieces only, and all
but the emptiest `open_windows` windows leave; each round has `fan_in` times
fewer groups, so no task sees more than fan_in * open_windows windows and
padding is left in the last few windows only.

Tokens. The word tokenizer drops white space and never joins across it, so
ASCII-space-separated words are encoded one by one and their ids kept in a
bounded per-worker memory; ids are those of encoding the whole text.

Sequences are padded to the window, unless their length is a power of two.
Pieces of the online step are written to the shared folder before merging, so
a lost executor changes no sequence. Defined results: a null or empty text is
one piece of one id (the end id); repeated rows are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import documents, give_back, staged

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_FIELDS = [f.split()[0] for f in PIECES.split(", ")]
_SCHEMA = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in _FIELDS])


# Plain words: letters whose lower case and composed form are one letter, then marks.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """Plain letters as the byte-level alphabet writes their UTF-8 bytes: a
    printable Latin-1 byte as itself, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


# The steps of the public tokenizer that make words independent of each other.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLITTERS = ["Split", "ByteLevel"]
_MARKS = b".,;:!?"


class _Memory(dict):
    """Ids by word; an unknown word is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self._encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordTokenizer:
    """Little-endian uint32 ids of a text, word by word.

    A word made of plain letters and marks goes to the vocabulary's merges
    directly (its letters and its marks are encoded apart anyway); any other
    word goes through the whole tokenizer. Both are remembered in two
    generations of about `kept` words, `forget` drops them. A tokenizer that
    does not lower-case, or that keeps white space, raises ValueError.
    """

    def __init__(self, path: str, kept: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._check(json.loads(self._tokenizer.to_str()))
        self._merges = self._tokenizer.model
        self._letters = _byte_letters()
        self._kept = kept
        self._marks: dict[bytes, bytes] = {b"": b""}
        self._packs = [struct.Struct(f"<{n}I").pack for n in range(65)]
        self.forget()

    @staticmethod
    def _check(config: dict) -> None:
        steps = (config.get("normalizer") or {}).get("normalizers") or []
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if (
            [x["type"] for x in steps] != _NORMALIZERS or [x["type"] for x in splits] != _SPLITTERS
            or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or config["model"]["type"] != "BPE"
        ):
            raise ValueError("packing takes a lower-casing byte-level BPE tokenizer that drops white space")

    def forget(self) -> None:
        self._young, self._old = _Memory(self._word), {}

    def _whole(self, word: str) -> bytes:
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        known = self._old.get(word)
        if known is not None:
            return known
        core = word.rstrip(_MARKS)
        if len(word) > 64:
            return self._whole(word.decode("utf-8", "replace"))
        marks = word[len(core) :]
        if core.isalpha():  # of bytes: ASCII letters only
            key = core.lower()
            letters = key.decode()
        else:
            text = word.decode("utf-8", "replace")
            plain = _PLAIN.fullmatch(text)
            if not plain:
                return self._whole(text)
            lower = plain[1].lower()
            key, letters = lower.encode(), lower.translate(self._letters)
        after = self._marks.get(marks)
        if after is None:
            after = self._whole(marks.decode())
            if len(self._marks) < 1000:
                self._marks[marks] = after
        if key != word:
            known = self._young.get(key) or self._old.get(key)
        if known is None:
            ids = [t.id for t in self._merges.tokenize(letters)]
            known = self._packs[len(ids)](*ids) if len(ids) < 65 else array("I", ids).tobytes()
            if key != word:
                self._young[key] = known
        return known + after if after else known

    def ids(self, body: bytes) -> bytes:
        if len(self._young) > self._kept:  # bounded: forget what was not used lately
            self._old, self._young = self._young, _Memory(self._word)
        return b"".join(map(self._young.__getitem__, body.split()))  # ASCII white space


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


class OpenWindows:
    """At most `limit` open windows; pieces are (doc_id, start, length, crc, doc_tokens)."""

    def __init__(self, limit: int, window: int = WINDOW):
        self.limit, self.window = limit, window
        self.free: list[tuple[int, int]] = []  # (room, window number), by room
        self.content: dict[int, list[tuple]] = {}
        self.opened = 0
        self.closed: list[tuple[int, list[tuple]]] = []

    def fits(self, length: int) -> bool:
        return bool(self.free) and self.free[-1][0] >= length

    def fullest_room(self) -> int:
        return self.free[0][0]

    def open(self) -> None:
        insort(self.free, (self.window, self.opened))
        self.content[self.opened] = []
        self.opened += 1

    def put(self, piece: tuple) -> None:
        """Into the window with the least room that holds the piece."""
        room, number = self.free.pop(bisect_left(self.free, (piece[2], -1)))
        self.content[number].append(piece)
        if room == piece[2]:
            self.closed.append((number, self.content.pop(number)))
        else:
            insort(self.free, (room - piece[2], number))


def pack_document(windows: OpenWindows, doc_id, ids: bytes) -> None:
    """Cut and place one document's ids (little-endian uint32, end id included)."""
    total, start = len(ids) // 4, 0

    def piece(length: int) -> tuple:
        return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total

    while start < total:
        rest = total - start
        if rest >= windows.window:
            length = windows.window
            windows.closed.append((windows.opened, [piece(length)]))
            windows.opened += 1
        else:
            if windows.fits(rest):
                length = rest
            elif len(windows.free) < windows.limit:
                windows.open()
                length = rest
            else:
                length = windows.fullest_room()
            windows.put(piece(length))
        start += length


def _rows(found: list[tuple[int, list[tuple]]], prefix: int, part: int, is_open: bool) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _FIELDS}
    for number, pieces in found:
        at = 0
        for p in pieces:
            for name, value in zip(_FIELDS, (*p, prefix + number, at, part, is_open)):
                out[name].append(value)
            at += p[2]
    return out


def _prefix(level: int, part: int) -> int:
    """Sequence ids: level of merging, partition or group, window number."""
    return (level << 57) | (part << 26)


def _pack_partition(path: str, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        tokenizer, part = _TOKENIZERS[path], TaskContext.get().partitionId()
        windows, end = OpenWindows(open_windows), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                pack_document(windows, doc_id, tokenizer.ids(body.as_py()) + end)
                if len(windows.closed) >= 4096:
                    yield pa.RecordBatch.from_pydict(_rows(windows.closed, _prefix(0, part), part, False), schema=_SCHEMA)
                    windows.closed = []
        yield pa.RecordBatch.from_pydict(_rows(windows.closed, _prefix(0, part), part, False), schema=_SCHEMA)
        left = [(n, windows.content[n]) for _, n in windows.free]
        yield pa.RecordBatch.from_pydict(_rows(left, _prefix(0, part), part, True), schema=_SCHEMA)
        tokenizer.forget()  # a worker outlives its tasks
        give_back()

    return run


def _merge_group(level: int, open_windows: int, last: bool):
    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = zip(*(pieces.column(n).to_pylist() for n in _FIELDS[:5]))  # doc_id, start, length, ids_crc32, doc_tokens
        windows = OpenWindows(pieces.num_rows + 1)
        for p in sorted(rows, key=lambda p: (-p[2], p[0] is None, p[0] or 0, *p[1:])):
            if not windows.fits(p[2]):
                windows.open()
            windows.put(p)
        left = windows.free  # by room: the emptiest last
        cut = len(left) if last else max(0, len(left) - open_windows)
        done = windows.closed + [(n, windows.content[n]) for _, n in left[:cut]]
        kept = [(n, windows.content[n]) for _, n in left[cut:]]
        return pa.concat_tables([pa.Table.from_pydict(_rows(x, _prefix(level, group), group, o), schema=_SCHEMA) for x, o in ((done, False), (kept, True))])

    return run


def pack_documents(docs: DataFrame, open_windows: int = 16, fan_in: int = 32, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    path = tokenizer or tokenizer_path()
    body = documents(docs).select("doc_id", "body")
    online = staged(body.mapInArrow(_pack_partition(path, open_windows), PIECES))
    done = [online.where("not open")]
    left = online.where("open")
    parts = (left.agg(F.max("part").alias("m")).first().m or 0) + 1
    level = 0
    while True:
        level += 1
        parts = -(-parts // fan_in)
        last = parts == 1
        merged = staged(
            left.withColumn("group", F.floor(F.col("part") / fan_in))
            .groupBy("group").applyInArrow(_merge_group(level, open_windows, last), PIECES)
        )
        done.append(merged.where("not open"))
        left = merged.where("open")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(_FIELDS[:7])
