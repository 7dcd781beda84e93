"""Language-model scoring with an Elias-Fano n-gram trie.

The trie. Level 1 holds the training tokens, as ascending 64-bit hashes; a
token's number is its place. A node of level k is (parent, token): the number
of its first k - 1 tokens' node and its last token's number, packed into one
ascending key parent * V + token, so a context's children are neighbours and
the parents are monotone pointers. Keys are Elias-Fano coded; looking a token
up after a context is a successor search among the context's children. Beside
the keys lie 8-bit codes of the smoothed log-probability of the last token and
of the context's back-off weight, each with a codebook of 256 bin means.
Levels are cut by parent into slices, files of the shared folder
(spark.checkpoint.dir), which tasks memory-map; the folder must therefore be a
mounted one (file:), the same on all machines.

Smoothing. Interpolated absolute discounting down to the additive unigram
(c + 0.5) / (N + 0.5 * (V + 1)), which leaves 0.5 / (...) for any unseen token:
p(w | h) = max(c(h w) - D, 0) / c(h) + b(h) * p(w | shorter h), where nodes seen
less than `min_count` times are not stored and their share goes to b(h). Over V
tokens and the unseen one, the probabilities after any context sum to 1 (up to
the codes' rounding). The end token also stands before the first token.

Counting. All training documents are counted. Tasks send sorted distinct keys
with counts per slice, as deltas; a slice's task merges them, writes its file,
and returns one row. A level asks only for n-grams whose two shorter n-grams
are stored (with a count of at least `min_count` they must be). All n-grams
that begin with one token meet in one task, each once per batch that has it:
for a very common first word that is not bounded, and grows with the rows.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end.
Training documents are those whose crc32(doc_id as text) mod 5 is not 1; the
others are held out. Defined results: a null or empty text is one end token; a
null doc_id is hashed as the empty string, so it trains; repeated rows count
and are scored as rows of their own; without training documents every token
has probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm import elias_fano
from loanlens.llm.common import blocks, documents, shared_dir, staged, words
from loanlens.llm.quality_classifier import held_out

ORDER = 3
MIN_COUNT = 1  # every n-gram is stored
DISCOUNT = 0.75
END_HASH = np.uint64(0)
# Bytes of text per slice of the model's levels, and tokens counted together.
SLICE_BYTES = 16 << 20
BATCH_TOKENS = 1_000_000
# Nodes whose shorter n-grams are looked up together.
NODE_ROWS = 500_000
UNKNOWN = np.uint32(0xFFFFFFFF)

PARTS = "slice int, n long, deltas binary, counts binary"
_PARTS = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("deltas", pa.binary()), ("counts", pa.binary())])
SLICES = "slice int, nodes long, total long"
_SLICES = pa.schema([("slice", pa.int32()), ("nodes", pa.int64()), ("total", pa.int64())])
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tokens binary"
_CODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("tokens", pa.binary())])


def mounted(uri: str) -> str:
    """The path of a folder that can be memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the model's levels are memory-mapped: spark.checkpoint.dir must be a mounted folder (file:), not {uri}")
    return uri


# --- packed parts -----------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """Byte planes of uint64 values: shuffles compress the empty high ones away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _part(number: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    return number, len(keys), _planes(np.r_[keys[:1], np.diff(keys)]), counts.astype("<u4").tobytes()


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a slice and their counts."""
    keys = [np.cumsum(_from_planes(d.as_py(), n.as_py()), dtype=np.uint64) for d, n in zip(group.column("deltas"), group.column("n"))]
    key = np.concatenate(keys)
    count = np.concatenate([np.frombuffer(c.as_py(), dtype="<u4") for c in group.column("counts")]).astype(np.int64)
    del keys
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _hash_slice(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _slice_row(number: int, nodes: int, total: int) -> pa.Table:
    return pa.Table.from_pydict({"slice": [number], "nodes": [nodes], "total": [total]}, schema=_SLICES)


# --- the model --------------------------------------------------------------

def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook: 256 bins of equal frequency, by mean."""
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(256)
    edges = np.unique(np.quantile(values, np.arange(1, 256) / 256))
    code = np.searchsorted(edges, values, side="right")
    size = np.bincount(code, minlength=256)
    return code.astype(np.uint8), np.bincount(code, weights=values, minlength=256) / np.maximum(size, 1)


class Model:
    """The trie's files: `bases[k - 1]` has the first node of each slice of level
    k, and the number of nodes last."""

    def __init__(self, root: str, bases: list[list[int]], total: int):
        self.root, self.bases, self.total = root, [np.array(b, dtype=np.int64) for b in bases], total
        self._arrays: dict = {}

    @property
    def vocabulary(self) -> int:
        return int(self.bases[0][-1])

    def _get(self, level: int, number: int, name: str):
        key = (level, number, name)
        if key not in self._arrays:
            path = f"{self.root}/{level}/{number}"
            self._arrays[key] = elias_fano.EliasFano.open(path) if name == "keys" else elias_fano.read(path, name)
        return self._arrays[key]

    def _spans(self, level: int, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(slice, start, end) of ascending node numbers of a level."""
        cuts = np.searchsorted(numbers, self.bases[level - 1])
        for s in range(len(cuts) - 1):
            if cuts[s] < cuts[s + 1]:
                yield s, int(cuts[s]), int(cuts[s + 1])

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending token hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        slices = len(self.bases[0]) - 1
        cuts = np.searchsorted(_hash_slice(hashes, slices), np.arange(slices + 1))
        for s in range(slices):
            if cuts[s] < cuts[s + 1] and self.bases[0][s] < self.bases[0][s + 1]:
                at = self._get(1, s, "keys").find(hashes[cuts[s] : cuts[s + 1]])
                out[cuts[s] : cuts[s + 1]] = np.where(at >= 0, at + self.bases[0][s], -1)
        return out

    def nodes(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Node numbers of ascending keys of a level from 2 on, -1 if not stored."""
        out = np.full(len(keys), -1, dtype=np.int64)
        parent = (keys // np.uint64(max(1, self.vocabulary))).astype(np.int64)
        for s, a, b in self._spans(level - 1, parent):
            if self.bases[level - 1][s] < self.bases[level - 1][s + 1]:
                at = self._get(level, s, "keys").find(keys[a:b])
                out[a:b] = np.where(at >= 0, at + self.bases[level - 1][s], -1)
        return out

    def values(self, level: int, numbers: np.ndarray, name: str) -> np.ndarray:
        """`logp` or `back` of ascending node numbers; 0 for -1."""
        out = np.zeros(len(numbers))
        for s, a, b in self._spans(level, numbers):
            code = self._get(level, s, name)[numbers[a:b] - self.bases[level - 1][s]]
            out[a:b] = self._get(level, s, f"{name}_book")[code]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), dtype=np.int64)
        for s, a, b in self._spans(1, numbers):
            out[a:b] = self._get(1, s, "count")[numbers[a:b] - self.bases[0][s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))


@lru_cache(maxsize=2)
def _opened(root: str, bases: tuple, total: int) -> Model:
    return Model(root, [list(b) for b in bases], total)


def each(values: np.ndarray, look_up, missing) -> np.ndarray:
    """look_up of the distinct non-negative values, spread over all of them."""
    distinct, back = np.unique(values, return_inverse=True)
    known = distinct >= 0
    first = look_up(distinct[known])
    out = np.full(len(distinct), missing, dtype=first.dtype)
    out[known] = first
    return out[back]


# --- level 1 ----------------------------------------------------------------

def _hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words per row, word hashes) of runs of rows, end tokens left out."""
    at, sizes, found = 0, [], []
    for start, end, data, offsets in blocks(batch):
        value, owner = words(data, offsets)
        sizes.append(np.bincount(owner, minlength=end - start))
        found.append(value)
        if sum(map(len, found)) >= BATCH_TOKENS or end == batch.num_rows:
            yield at, np.concatenate(sizes), np.concatenate(found)
            at, sizes, found = end, [], []


def _count_tokens(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, size, value in _hashes(batch):
                key, count = np.unique(np.r_[value, np.full(len(size), END_HASH)], return_counts=True)
                cuts = np.searchsorted(_hash_slice(key, slices), np.arange(slices + 1))
                yield _parts([_part(s, key[a:b], count[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b])

    return run


def _write_tokens(root: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        hashes, count = _merged(group)
        elias_fano.write({**elias_fano.encode(hashes), "count": _counts(count)}, f"{root}/1/{number}")
        return _slice_row(number, len(hashes), int(count.sum()))

    return run


def _code(root: str, bases: tuple, total: int):
    """Texts to token numbers, with the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(root, bases, total)
        for batch in batches:
            for at, size, value in _hashes(batch):
                distinct, back = np.unique(np.r_[END_HASH, value], return_inverse=True)
                number = model.tokens(distinct)
                known = number >= 0
                count = np.zeros(len(distinct), dtype=np.int64)
                order = np.flatnonzero(known)
                count[order] = model.counts(number[order])  # numbers ascend with hashes
                base = model.unigram(count)
                owner = np.repeat(np.arange(len(size)), size)
                word = back[1:]
                n_known = np.bincount(owner, weights=known[word], minlength=len(size)) + known[back[0]]
                score = np.bincount(owner, weights=base[word], minlength=len(size)) + base[back[0]]
                code = np.where(known, number, int(UNKNOWN)).astype("<u4")
                # words of a document, then its end
                ends = np.cumsum(size)
                tokens = np.insert(code[word], ends, code[back[0]]).tobytes()
                cuts = 4 * np.r_[0, ends + np.arange(1, len(size) + 1)]
                rows = slice(at, at + len(size))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[rows], batch.column(1)[rows], pa.array(size + 1), pa.array(n_known.astype(np.int64)), pa.array(score),
                    pa.array([tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:])], type=pa.binary())], schema=_CODED)

    return run


# --- levels 2 and up --------------------------------------------------------

def _runs(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, token numbers with an end before every document, place in the
    document) for runs of rows; -1 is an unknown token."""
    column = batch.column(batch.schema.get_field_index("tokens"))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype="<u4")
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + 4 * BATCH_TOKENS, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        own = data[offsets[at] // 4 : offsets[end] // 4]
        first = (offsets[at:end] - offsets[at]) // 4
        seq = np.insert(np.where(own == UNKNOWN, -1, own.astype(np.int64)), first, 0)  # token 0 is the end
        size = np.diff(np.r_[first, len(own)]) + 1
        begin = np.cumsum(size) - size
        yield slice(at, end), seq, np.arange(len(seq)) - np.repeat(begin, size)
        at = end


def _climb(model: Model, seq: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
    """Per position, the node of its last `level` tokens, -1 if not stored."""
    node = seq
    for k in range(2, level + 1):
        node = _step(model, np.r_[-1, node[:-1]], seq, place, k)
    return node


def _step(model: Model, before: np.ndarray, seq: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
    """Nodes of a level from the positions' parents (the node one before)."""
    good = np.flatnonzero((before >= 0) & (seq >= 0) & (place >= level - 1))
    key = before[good].astype(np.uint64) * np.uint64(model.vocabulary) + seq[good].astype(np.uint64)
    distinct, back = np.unique(key, return_inverse=True)
    out = np.full(len(seq), -1, dtype=np.int64)
    out[good] = model.nodes(level, distinct)[back]
    return out


def _count_nodes(root: str, bases: tuple, total: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(root, bases, total)
        for batch in batches:
            for _, seq, place in _runs(batch):
                node = _climb(model, seq, place, level - 1)
                before = np.r_[-1, node[:-1]]
                good = (before >= 0) & (place >= level - 1)
                if level > 2:
                    good &= node >= 0  # the last level - 1 tokens are stored as well
                key, count = np.unique(before[good].astype(np.uint64) * np.uint64(model.vocabulary) + seq[good].astype(np.uint64), return_counts=True)
                parent = (key // np.uint64(max(1, model.vocabulary))).astype(np.int64)
                yield _parts([_part(s, key[a:b], count[a:b]) for s, a, b in model._spans(level - 1, parent)])

    return run


def _counts(count: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them all."""
    return count.astype(np.min_scalar_type(int(count.max()) if len(count) else 0))


def _write_nodes(root: str, bases: tuple, total: int, level: int, order: int, min_count: int, discount: float):
    def run(group_key: tuple, group: pa.Table) -> pa.Table:
        number = group_key[0].as_py()
        model = _opened(root, bases, total)
        key, count = _merged(group)
        kept = count >= min_count
        key, count = key[kept], count[kept]
        size = np.uint64(model.vocabulary)
        base, upto = (int(x) for x in model.bases[level - 2][number : number + 2])
        parent, token = (key // size).astype(np.int64) - base, (key % size).astype(np.int64)
        seen = elias_fano.read(f"{root}/{level - 1}/{number}", "count").astype(np.float64)
        share = np.maximum(count - discount, 0) / seen[parent]
        back = np.maximum(1 - np.bincount(parent, weights=share, minlength=upto - base), 1e-9)
        if level == 2:
            shorter = 10 ** each(token, lambda t: model.unigram(model.counts(t)), 0.0)
        else:  # the node without its first token: (all but the first of the parent, token)
            shorter = np.empty(len(key))
            paths = model._get(level - 1, number, "keys").keys()
            for at in range(0, len(key), NODE_ROWS):
                rows = slice(at, at + NODE_ROWS)
                shorter[rows] = 10 ** _shorter(model, level, paths[parent[rows]], token[rows])
            del paths
        logp = np.log10(share + back[parent] * shorter)
        code, book = quantised(logp)
        back_code, back_book = quantised(np.log10(back))
        kept = {"count": _counts(count)} if level < order else {}  # only the next level reads them
        elias_fano.write({**elias_fano.encode(key), **kept, "logp": code, "logp_book": book}, f"{root}/{level}/{number}")
        elias_fano.write({"back": back_code, "back_book": back_book}, f"{root}/{level - 1}/{number}")
        return _slice_row(number, len(key), int(count.sum()))

    return run


def _shorter(model: Model, level: int, path: np.ndarray, token: np.ndarray) -> np.ndarray:
    """log10 p of the nodes' last token after all but the first of the context;
    `path` has the keys of their contexts."""
    size = np.uint64(model.vocabulary)
    middle = [(path % size).astype(np.int64)]  # the context's tokens from the second on, last first
    up, k = path // size, level - 1
    while k > 2:
        owner = up.astype(np.int64)
        k -= 1
        path = each(owner, lambda o, k=k: _keys_of(model, k, o), 0).astype(np.uint64)
        middle.append((path % size).astype(np.int64))
        up = path // size
    seq = np.stack([*middle[::-1], token], axis=1)
    node = seq[:, 0]
    for j in range(1, seq.shape[1]):
        k = j + 1
        good = np.flatnonzero(node >= 0)
        key = node[good].astype(np.uint64) * size + seq[good, j].astype(np.uint64)
        distinct, back = np.unique(key, return_inverse=True)
        found = np.full(len(node), -1, dtype=np.int64)
        found[good] = model.nodes(k, distinct)[back]
        node = found
    return each(node, lambda n: model.values(level - 1, n, "logp"), 0.0)


def _keys_of(model: Model, level: int, numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers), dtype=np.uint64)
    for s, a, b in model._spans(level, numbers):
        out[a:b] = model._get(level, s, "keys").keys()[numbers[a:b] - model.bases[level - 1][s]]
    return out


# --- scoring ----------------------------------------------------------------

def token_scores(model: Model, seq: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the token at every position (0 at places 0)."""
    count = each(seq, model.counts, 0)
    score = model.unigram(count)
    context = seq  # node of the last k - 1 tokens, by position
    for k in range(2, order + 1):
        before = np.r_[-1, context[:-1]]
        before[place < k - 1] = -1
        back = each(before, lambda n, k=k: model.values(k - 1, n, "back"), 0.0)
        node = _step(model, before, seq, place, k)
        score = np.where(node >= 0, each(node, lambda n, k=k: model.values(k, n, "logp"), 0.0), back + score)
        context = node
    score[place == 0] = 0
    return score


def _score(root: str, bases: tuple, total: int, order: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(root, bases, total)
        for batch in batches:
            for rows, seq, place in _runs(batch):
                score = token_scores(model, seq, place, order)
                whole = np.add.reduceat(score, np.flatnonzero(place == 0))
                own = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(n)) for n in names), pa.array(whole)], names=[*names, "score"])

    return run


def _bases(rows: DataFrame, slices: int, root: str, level: int, parents: tuple = ()) -> tuple[tuple, int]:
    """First node of each slice, and all counts (one small row per slice comes
    to the driver). A slice without rows gets empty files, and its contexts, if
    any, a back-off weight of 1."""
    found = {r.slice: r for r in rows.collect()}
    base, total = [0], 0
    for s in range(slices):
        r = found.get(s)
        if r is None:
            code, book = quantised(np.zeros(0))
            empty = {**elias_fano.encode(np.zeros(0, dtype=np.uint64)), "count": np.zeros(0, dtype=np.uint64), "logp": code, "logp_book": book}
            elias_fano.write(empty, f"{root}/{level}/{s}")
            if parents:
                elias_fano.write({"back": np.zeros(parents[s + 1] - parents[s], dtype=np.uint8), "back_book": book}, f"{root}/{level - 1}/{s}")
        base.append(base[-1] + (r.nodes if r else 0))
        total += r.total if r else 0
    return tuple(base), total


def score_documents(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document."""
    if order < 1 or min_count < 1 or not 0 < discount < 1:
        raise ValueError("order and min_count must be positive, discount between 0 and 1")
    root = mounted(shared_dir(docs.sparkSession))
    body = documents(docs).select("doc_id", held_out("doc_id", fold).alias("held_out"), "body")
    size = body.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first().n
    slices = max(4, -(-size // SLICE_BYTES))
    os.makedirs(root, exist_ok=True)

    parts = body.where("not held_out").mapInArrow(_count_tokens(slices), PARTS)
    first, total = _bases(parts.groupBy("slice").applyInArrow(_write_tokens(root), SLICES), slices, root, 1)
    if first[-1] >= int(UNKNOWN):
        raise ValueError("more distinct tokens than 32-bit numbers")
    bases = (first,)
    coded = staged(body.mapInArrow(_code(root, bases, total), CODED))
    for level in range(2, order + 1):
        parts = coded.where("not held_out").select("tokens").mapInArrow(_count_nodes(root, bases, total, level), PARTS)
        rows = parts.groupBy("slice").applyInArrow(_write_nodes(root, bases, total, level, order, min_count, discount), SLICES)
        base, _ = _bases(rows, slices, root, level, bases[-1])
        if base[-1] * max(1, first[-1]) >= 1 << 64:
            raise ValueError("more nodes than 64-bit keys hold")
        bases = (*bases, base)
    scored = coded.mapInArrow(_score(root, bases, total, order), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
