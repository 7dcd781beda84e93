"""Quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives are training rows labelled 1; all training texts, labelled or
not, are the unlabelled set. With l the logistic loss, f the score's log-odds
and p the class prior, the minimised risk is

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

and where the second part would turn negative, its gradient is reversed, so a
flexible model can't win by pushing it below zero. The prior is estimated as
the smoothed share of 1 among all labelled training rows, less 2.5 standard
errors: too high a prior would make "all positive" a perfect answer. f is a small network (one hidden
layer) on figures of a whole text: shares of characters of each kind, of words
in capitals, with symbols, repeated from the word before; each also as the
maximum over windows of 20 words, so junk inside a long clean text shows.

One scan writes the figures of all training rows. Their mean and scale are
aggregates over all of them, and the fit makes PASSES passes over all of them: in
a pass every task takes mini-batch steps from the same model over its own rows,
and the models are averaged, weighted by rows, by one aggregate (as many rows as
the model has weights). Only the positives are bounded: the `sample` labelled rows
with the smallest hash of doc_id, some 80 floats each, go to every task. Sums are
decimal, so a result doesn't depend on the order in which parts arrive. Scoring is
one scan. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null text is empty, and an empty text has a score of its
own like any other; a null doc_id is hashed as the empty string; several labels
of one doc_id count as positive if any is 1; without any positive training
label every score is the prior; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import blocks, discard, documents, giving_back, in_parts, staged

SAMPLE = 10_000
KEEP = 0.3
WINDOW_WORDS = 20
# The fit: passes over all training rows, rows of a step, least steps of a task in a
# pass, rows of a small table in one task, first rate of a step, decay of weights.
PASSES = 10
BATCH = 2048
STEPS = 40
PART_ROWS = 50_000
RATE = 0.03
DECAY = 1e-5

# Byte kinds whose share of a text is a figure of its own.
_KINDS = [b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#", b"%",
          b"&", b"$", b"*", b"@", b"_-", b"=+", b"<>", b"()[]{}", b":;", b"'\"`", b"/\\", b"~^", bytes(range(128, 256))]
_SYMBOLS = b"|#%&$*@=+<>[]{}/\\~^_!"
_KIND_OF = np.full(256, len(_KINDS), dtype=np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND_OF[list(_bytes)] = _k
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FIGURES = 2 * (len(_KINDS) + 1) + 24


def held_out(doc_id: str | Column, fold: int = 0) -> Column:
    """crc32(doc_id as text) mod 5 = fold."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == fold


def _largest_share(flag: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per document with words: the largest share of flagged words in a window."""
    sums = np.r_[0, np.cumsum(flag)]
    at = np.arange(len(flag))
    start = np.maximum(at + 1 - WINDOW_WORDS, np.repeat(first, count))
    return np.maximum.reduceat((sums[at + 1] - sums[start]) / WINDOW_WORDS, first)


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of figures per document of a block."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((docs, FIGURES), dtype=np.float64)
    out[:, 0] = np.log1p(size)
    doc = np.repeat(np.arange(docs), size)
    shares = np.bincount(doc * (len(_KINDS) + 1) + _KIND_OF[data], minlength=docs * (len(_KINDS) + 1)).astype(np.float64).reshape(docs, -1) / np.maximum(size, 1)[:, None]
    out[:, 1 : 1 + shares.shape[1]] = shares
    out[:, 1 + shares.shape[1] : 1 + 2 * shares.shape[1]] = np.log(shares + 1e-3)
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return out
    owner = doc[start]
    length = end - start

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return sums[end] - sums[start]

    upper = within((data >= 65) & (data <= 90))
    lower = within((data >= 97) & (data <= 122))
    symbol = within(np.isin(data, np.frombuffer(_SYMBOLS, dtype=np.uint8)))
    digit = within((data >= 48) & (data <= 57))
    print_sum = np.r_[0, np.cumsum(data.astype(np.int64) * data)]
    name = (print_sum[end] - print_sum[start]) * 64 + length  # equal for equal words, and for few others
    same = np.r_[False, (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])]
    flags = [
        (upper >= 2) & (lower == 0), symbol > 0, (symbol == length) & (length > 0), same, digit > 0, length > 20, length <= 2, (upper == 1) & (lower > 0),
    ]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    has, count = owner[first], np.diff(np.r_[first, len(owner)])
    base = 1 + 2 * shares.shape[1]
    for k, flag in enumerate(flags):
        out[has, base + 2 * k] = np.add.reduceat(flag.astype(np.float64), first) / count
        out[has, base + 2 * k + 1] = _largest_share(flag, owner, first, count)
    base += 2 * len(flags)
    out[has, base] = np.log1p(count)
    out[has, base + 1] = np.add.reduceat(length.astype(np.float64), first) / count
    out[has, base + 2] = np.log(np.add.reduceat(symbol.astype(np.float64), first) / count + 1e-3)
    pair = np.unique(owner * (1 << 44) + name % (1 << 44))
    distinct = np.bincount(pair >> 44, minlength=docs)[has]
    out[has, base + 3] = distinct / count
    return out


@dataclass
class Model:
    """Standardisation and one hidden layer; log-odds of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


Params = list[np.ndarray]


def risk(params: Params, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the PU risk of standardised rows; the second may be negative."""
    w1, b1, w2, b2 = params
    s = [_sigmoid(np.tanh(x @ w1 + b1) @ w2 + b2) for x in (positive, unlabelled)]
    above, below = (-np.log(np.maximum(x, 1e-12)) for x in (s[0], 1 - s[0]))
    return prior * above.mean(), -np.log(np.maximum(1 - s[1], 1e-12)).mean() - prior * below.mean()


def gradient(params: Params, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Params:
    """Of the sum of both parts; of minus the second part where that is negative."""
    w1, b1, w2, b2 = params
    x, n = np.vstack([positive, unlabelled]), len(positive)
    h = np.tanh(x @ w1 + b1)
    s = _sigmoid(h @ w2 + b2)
    # l(f) = -log s, l(-f) = -log(1 - s); derivatives by f: s - 1 and s
    below = -np.log(np.maximum(1 - s, 1e-12))
    g = np.empty(len(x))
    if below[n:].mean() - prior * below[:n].mean() >= 0:
        g[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
        g[n:] = s[n:] / (len(x) - n)
    else:  # reversed: raise the part that went below zero
        g[:n] = prior * s[:n] / n
        g[n:] = -s[n:] / (len(x) - n)
    back = np.outer(g, w2) * (1 - h * h)
    return [x.T @ back, back.sum(axis=0), h.T @ g, np.array(g.sum())]


class Adam:
    def __init__(self, params: Params):
        self.params = params
        self._first, self._second = ([np.zeros_like(w) for w in params] for _ in range(2))
        self.steps = 0

    def step(self, grads: Params, rate: float) -> None:
        self.steps += 1
        for i, (w, d) in enumerate(zip(self.params, grads)):
            d = d + (DECAY * w if w.ndim == 2 or i == 2 else 0)
            self._first[i] = 0.9 * self._first[i] + 0.1 * d
            self._second[i] = 0.999 * self._second[i] + 0.001 * d * d
            self.params[i] = w - rate * (self._first[i] / (1 - 0.9**self.steps)) / (np.sqrt(self._second[i] / (1 - 0.999**self.steps)) + 1e-8)


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """The figures of a partition, `rows` rows at a time; the last may hold up to
    half as many more."""
    kept = np.zeros((0, FIGURES))
    for batch in batches:
        found = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, FIGURES)
        kept = np.vstack([kept, found])
        while len(kept) >= 1.5 * rows:
            yield kept[:rows]
            kept = kept[rows:]
    if len(kept):
        yield kept


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and sums of squares of a partition's figures."""
    for x in _matrices(batches, 1 << 14):
        yield _numbered(np.r_[x.sum(axis=0), (x * x).sum(axis=0)], len(x))


def _numbered(values: np.ndarray, rows: int) -> pa.RecordBatch:
    """(at, value) rows: the number of rows at -1, then the values."""
    return pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, len(values), dtype=np.int32)), "value": pa.array(np.r_[float(rows), values])})


def _added(parts: DataFrame) -> tuple[float, np.ndarray]:
    """(rows, sums) of such rows, added as decimals."""
    found = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(30,10)")).cast("double").alias("value")).toArrow().sort_by("at")
    values = found.column("value").to_numpy()
    return (float(values[0]), values[1:]) if len(values) else (0.0, values)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _one_pass(params: Params, positive: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, at: int):
    """Steps over a partition's rows from `params`; its weights times its rows."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, rows, seen = Adam([w.copy() for w in params]), 0, []

        def step(x: np.ndarray) -> None:
            chosen = np.arange(fitted.steps * BATCH, (fitted.steps + 1) * BATCH) % len(positive) if len(positive) > BATCH else slice(None)
            rate = RATE * (1 - (at + min(1, fitted.steps / STEPS)) / (PASSES + 0.01))
            fitted.step(gradient(fitted.params, positive[chosen], x, prior), rate)

        for x in _matrices(batches, BATCH):
            x = _standard(x, mean, scale)
            rows += len(x)
            step(x)
            if len(seen) < STEPS:
                seen.append(x)
        while seen and fitted.steps < STEPS:  # a small partition is gone over again
            step(seen[fitted.steps % len(seen)])
        if rows:
            yield _numbered(rows * np.concatenate([w.ravel() for w in fitted.params]), rows)

    return run


def fit(table: DataFrame, rows: int, positive: np.ndarray, prior: float, hidden: int = 12, seed: int = 11) -> Model:
    """Minimise the non-negative PU risk of all rows of `table` (figures)."""
    table = in_parts(table, rows, PART_ROWS)
    n, sums = _added(table.mapInArrow(_sums, "at int, value double"))
    mean = sums[:FIGURES] / n
    scale = np.sqrt(np.maximum(sums[FIGURES:] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    positive = _standard(positive, mean, scale)[rng.permutation(len(positive))]
    params = [rng.normal(0, 1 / np.sqrt(FIGURES), (FIGURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array(np.log(prior / (1 - prior)))]
    cuts = np.cumsum([w.size for w in params])[:-1]
    for at in range(PASSES):
        n, sums = _added(table.mapInArrow(_one_pass(params, positive, prior, mean, scale, at), "at int, value double"))
        params = [part.reshape(w.shape) for part, w in zip(np.split(sums / n, cuts), params)]
    return Model(mean, scale, params[0], params[1], params[2], float(params[3]))


@giving_back
def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in blocks(batch, "body"):
            rows = figures(data, offsets)
            flat = pa.array(rows.ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FIGURES), flat), *(batch.column(i)[start:end] for i in range(2))],
                names=["figures", "id", "key"])


def _scores(model: Model | None, prior: float):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch, "body"):
                score = _sigmoid(model.log_odds(figures(data, offsets))) if model else np.full(end - start, prior)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[start:end] for i in range(3)), pa.array(score)], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """(model, class prior) from the rows outside the held-out fold; `sample` bounds
    the positives (labelled rows), nothing else."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id", fold))
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    )
    share = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)).alias("ones")).first()
    prior = (share.ones + 1) / (share.n + 2)
    positive = known.where("quality = 1").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("_id"))
    training = documents(docs.where(~held_out("doc_id", fold)))  # without null ids: these are held out
    table = staged(training.select("doc_id", "text_key", "body").mapInArrow(_figures, "figures array<float>, id long, key long"))
    trusted = (
        table.join(F.broadcast(positive), table["id"] == F.col("_id"))  # at most `sample` rows
        .groupBy("id").agg(F.min(F.struct("key", "figures")).alias("row")).select("id", "row.figures")  # one row per id
    ).toArrow().sort_by("id")
    if not trusted.num_rows:
        discard(table)
        return None, prior
    rows = table.count()
    matrix = np.asarray(trusted.column("figures").combine_chunks().flatten(), dtype=np.float64).reshape(-1, FIGURES)
    error = np.sqrt(prior * (1 - prior) * (1 / share.n + 1 / rows))
    prior = float(np.clip(prior - 2.5 * error, 0.02, 0.98))
    model = fit(table.select("figures"), rows, matrix, prior)
    discard(table)
    return model, prior


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted per document."""
    model, prior = train(docs, labels, fold, sample)
    return (
        documents(docs).select("doc_id", "text_key", held_out("doc_id", fold).alias("held_out"), "body")
        .mapInArrow(_scores(model, prior), "doc_id long, text_key long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= keep).cast("int"))
    )


def _keep(model: Model | None, prior: float, keep: float, text: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, prior)
            body = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.binary()).fill_null(b"")], names=["body"])
            for start, end, data, offsets in blocks(body) if model else ():
                score[start:end] = _sigmoid(model.log_odds(figures(data, offsets)))
            yield batch.filter(pa.array(score >= keep))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier predicts as 1."""
    model, prior = train(docs, labels, fold, sample)
    return docs.mapInArrow(_keep(model, prior, keep, docs.columns.index("text")), docs.schema)
