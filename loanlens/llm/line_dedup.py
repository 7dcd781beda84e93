"""Line dedup: suffix ranks of line sequences by distributed prefix doubling.

A document is the sequence of its non-blank lines (white space at the ends
ignored). A run of consecutive lines with at least `min_words` words in total
that also occurs at an earlier place is a copy: its lines are deleted, the
first occurrence stays. Places are ordered by (doc_id, text_key, line).

Doubling. Rank 1 of a line position is its line's 128-bit hash; rank 2h of
position i is the pair of the ranks h of positions i and i + h. After each
round only positions whose rank occurs again are kept ("until unique"), and
rounds end when 2h passes the longest window in question ("past the
threshold"). Positions of equal rank h are an interval of the suffix array
whose longest common prefix is at least h lines, so intervals come out as
groups: counted by partial aggregation and never gathered, whatever their size.

Windows. A maximal repeated run is the union of its shortest windows of at
least `min_words` words: the one that begins at each of its lines and the one
that ends there. A window of h <= L < 2h lines is named by the ranks h of its
first position and of the position h before its end, so all windows are named
from the doubling ranks; those named like an earlier window are copies. As
every line has a word, no window has more than `min_words` lines.

Defined results: a null text stays null and has no lines; rows equal in doc_id
and text count as one document and get one result; a null doc_id comes before
all others; blank lines stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loanlens.llm.common import documents, giving_back, occurring_again, staged, text_key

MIN_WORDS = 50

_LINES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("rank", pa.binary()),
                    ("ahead", pa.int32()), ("back", pa.int32())])
LINES = "doc_id long, text_key long, line int, rank binary, ahead int, back int"


def _content(body: bytes) -> list[tuple[int, bytes]]:
    """(line number, stripped line) of the non-blank lines."""
    return [(k, x) for k, line in enumerate(body.split(b"\n")) if (x := line.strip())]


def shortest_windows(counts: list[int], min_words: int) -> tuple[list[int], list[int]]:
    """Per line: how many lines the shortest window with `min_words` words has
    that begins there, and that ends there (0: none)."""
    total = np.r_[0, np.cumsum(counts)]
    at = np.arange(len(counts))
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    return np.where(end <= len(counts), end - at, 0).tolist(), np.where(begin >= 0, at + 1 - begin, 0).tolist()


def _lines(min_words: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, key, line, rank, ahead, back = [], [], [], [], [], []
            for i, k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                content = [x for _, x in _content(body.as_py())]
                forward, backward = shortest_windows([len(x.split()) for x in content], min_words)
                doc_id += [i] * len(content)
                key += [k] * len(content)
                line += range(len(content))
                rank += map(xxhash.xxh3_128_digest, content)
                ahead += forward
                back += backward
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((doc_id, key, line, rank, ahead, back), _LINES)], schema=_LINES)

    return run


def copied_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (struct of doc_id, text_key), line, lines: windows that are copies of
    an earlier one; `line` counts non-blank lines."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    lines = staged(documents(docs).mapInArrow(_lines(min_words), LINES)).withColumn("doc", F.struct("doc_id", "text_key"))
    live = staged(lines.join(occurring_again(lines, "rank"), "rank", "left_semi").dropDuplicates(["doc", "line"]).select("doc", "line", "rank", "ahead", "back"))
    windows = live.where("ahead > 0").select("doc", "line", F.col("ahead").alias("lines")).unionByName(
        live.where("back > 0").select("doc", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("lines"))
    )
    windows = staged(windows.distinct())
    longest = windows.agg(F.max("lines").alias("n")).first().n or 0
    found = None
    h = 1
    ranks = live.select("doc", "line", "rank")
    while h <= longest:
        at_end = ranks.select("doc", F.col("line").alias("at"), F.col("rank").alias("tail"))
        named = (
            windows.where(F.col("lines").between(h, 2 * h - 1))
            .join(ranks, ["doc", "line"])
            .withColumn("at", F.col("line") + F.col("lines") - h)
            .join(at_end, ["doc", "at"])
            .select("doc", "line", "lines", F.md5(F.concat("rank", "tail", F.col("lines").cast("string").cast("binary"))).alias("name"))
        )
        named = staged(named)
        firsts = staged(named.groupBy("name").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        copies = named.join(firsts, "name").where(F.struct("doc", "line") != F.col("first")).select("doc", "line", "lines")
        found = copies if found is None else found.unionByName(copies)
        if 2 * h <= longest:
            after = ranks.select("doc", (F.col("line") - h).alias("line"), F.col("rank").alias("next"))
            pairs = staged(ranks.join(after, ["doc", "line"]).select(
                "doc", "line", F.unhex(F.md5(F.concat("rank", "next"))).alias("rank")))
            ranks = staged(pairs.join(occurring_again(pairs, "rank"), "rank", "left_semi"))
        h *= 2
    return found if found is not None else windows


def without_copies(body: bytes, copies: list[dict] | None) -> tuple[bytes, int, list[int]]:
    """(text left, non-blank lines, numbers of the deleted lines)."""
    content = _content(body)
    gone: set[int] = set()
    for c in copies or ():
        gone.update(content[k][0] for k in range(c["line"], c["line"] + c["lines"]))
    left = b"\n".join(x for k, x in enumerate(body.split(b"\n")) if k not in gone) if gone else body
    return left, len(content), sorted(gone)


def _clean(names: list[str]):
    """Replace `text` by what is left and add n_lines and removed_lines; the last
    column has the copies."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_lines, removed = [], [], []
            at = names.index("text")
            for value, copies in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value = value.as_py()
                left, n, gone = without_copies((value or "").encode("utf-8", "replace"), copies.as_py())
                text.append(None if value is None else left.decode("utf-8", "replace"))
                n_lines.append(n)
                removed.append(gone)
            columns = [pa.array(text, type=pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, type=pa.int32()), pa.array(removed, type=pa.list_(pa.int32()))],
                                             names=[*names, "_n_lines", "_removed_lines"])

    return run


def _with_lines_removed(docs: DataFrame, min_words: int) -> DataFrame:
    """All columns of `docs`, `text` cleaned, and _n_lines, _removed_lines."""
    copies = copied_windows(docs, min_words).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("line", "lines")).alias("_copies"))
    joined = docs.join(copies, F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key")) == F.col("_doc"), "left").drop("_doc")
    schema = StructType([*docs.schema.fields, StructField("_n_lines", IntegerType()), StructField("_removed_lines", ArrayType(IntegerType()))])
    return joined.mapInArrow(_clean(docs.columns), schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines (non-blank ones),
    n_removed, removed_lines (numbers of the deleted lines, from 0) per document."""
    cleaned = _with_lines_removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return cleaned.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.size("_removed_lines").alias("n_removed"),
                          F.col("_removed_lines").alias("removed_lines"))


def clean_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of `docs` with the deleted lines gone from `text` (and
    `n_chars`, if there is one, counted anew). Documents that had lines and lost
    all of them go."""
    cleaned = _with_lines_removed(docs, min_words)
    cleaned = cleaned.where((F.col("_n_lines") == 0) | (F.size("_removed_lines") < F.col("_n_lines")))
    if "n_chars" in docs.columns:
        counted = F.when(F.size("_removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)
