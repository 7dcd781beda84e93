"""Mergeable sketches per column: one narrow row per (group, column).

A table of sketches made per day is merged for a week, a month or all days
without reading the data again: counts and extremes add up, central moments are
merged by their shift formulas, and the three sketches have merges of their own:

  quantiles  KLL (`kll_sketch_agg_double`), rank error `rank_error(k)` with 99 %
             confidence, also after any merge
  distinct   HyperLogLog (`hll_sketch_agg`), relative standard error 1.04 / 2^(lg / 2)
  mode       frequent items (`approx_top_k_accumulate`) of the values as text, every
             value of more than 3.5 / `items` of the rows among them
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
)

from loanlens.functions.exprs import nan_to_null

INTEGRAL = (ByteType, ShortType, IntegerType, LongType, BooleanType)
NUMERIC = INTEGRAL + (FloatType, DoubleType, DecimalType)

KLL_K = 4096
HLL_LG = 12
ITEMS = 2000
SHOWN_ITEMS = 200
# sums of one aggregate, those of three numeric columns: they keep 97 fields, and one of
# more than 100 (`spark.sql.codegen.maxFields`) is not compiled as a whole
TOGETHER = 39


def rank_error(k: int = KLL_K) -> float:
    """Share of the rows by which the rank of a quantile may be off (99 % confidence)."""
    return 2.296 / k**0.9021


def unnamed_share(items: int = ITEMS) -> float:
    """Share of the rows above which a value is sure to be named by the sketch of frequent items."""
    return 7 / items


def lg_for(rsd: float) -> int:
    """Size of a distinct-count sketch with relative standard error `rsd` or less."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def k_for(error: float) -> int:
    """Size of a quantile sketch with rank error `error` or less."""
    return min(65535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021))))


def value_of(df: DataFrame, name: str) -> Column:
    """A column's value as the report counts it: booleans as 0/1, no NaN, one zero."""
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, BooleanType):
        return c.cast("int")
    if isinstance(dtype, (FloatType, DoubleType)):
        return nan_to_null(c) + F.lit(0.0)  # NaN counts as missing, as in pandas
    return c


def _sums(df: DataFrame, names: Sequence[str], target: str) -> list[dict[str, Column]]:
    """Of each column its count and, of numbers, extremes, moments and the moments of the pairs with `target`."""
    y = value_of(df, target).cast("double") if target in names and isinstance(df.schema[target].dataType, NUMERIC) else None
    sums = []
    for name in names:
        v = value_of(df, name)
        own = {"nn": F.count(v)}
        if isinstance(df.schema[name].dataType, NUMERIC):
            d = v.cast("double")
            own |= {"min": F.min(d), "max": F.max(d), "mean": F.avg(d), "var": F.var_pop(d), "skew": F.skewness(d), "kurt": F.kurtosis(d)}
            if y is not None and name != target:
                a, b = F.when(y.isNotNull(), d), F.when(d.isNotNull(), y)
                own |= {"pair_n": F.count(a), "pair_x": F.avg(a), "pair_y": F.avg(b), "pair_vx": F.var_pop(a), "pair_vy": F.var_pop(b),
                        "pair_xy": F.covar_pop(a, b)}
        sums.append(own)
    return sums


_DOUBLES = ["min", "max", "mean", "var", "skew", "kurt", "pair_x", "pair_y", "pair_vx", "pair_vy", "pair_xy"]
_FIGURES = {"nn": "bigint", "pair_n": "bigint", **dict.fromkeys(_DOUBLES, "double")}


def _unpivoted(df: DataFrame, aggs: dict[int, dict[str, Column]], kinds: dict[str, str | None], by: Sequence[str] = ()) -> DataFrame:
    """One aggregate over the columns `aggs` (ord -> figures), then a row per column."""
    grouped = (df.groupBy(*by) if by else df).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"c{i}_{m}") for i, at in aggs.items() for m, c in at.items()])

    def figure(i: int, m: str, kind: str | None) -> str:
        got = f"c{i}_{m}" if m in aggs[i] else "null"
        return f"{f'cast({got} as {kind})' if kind else got} as {m}"

    # as text: hundreds of columns are thousands of expressions, and each made from Python is a call
    cells = [f"struct({', '.join([f'{i} as ord', 'n', *[figure(i, m, kind) for m, kind in kinds.items()]])})" for i in aggs]
    return grouped.selectExpr(*[f"`{c}`" for c in by], f"inline(array({', '.join(cells)}))")


def _moment_columns() -> list[Column]:
    """The rows of `_sums` as counts, extremes and sums of powers of the deviations."""
    nn, var = F.col("nn"), F.col("var")
    flat = var == 0  # skewness and kurtosis are undefined there; their sums are 0
    return [
        F.col("ord"), F.col("n"), nn, F.col("min"), F.col("max"), F.col("mean"), (var * nn).alias("m2"),
        F.when(flat, 0.0).otherwise(F.col("skew") * F.pow(var, 1.5) * nn).alias("m3"),
        F.when(flat, 0.0).otherwise((F.col("kurt") + 3) * var * var * nn).alias("m4"),
        F.coalesce("pair_n", F.lit(0)).alias("pair_n"), F.col("pair_x"), F.col("pair_y"), (F.col("pair_vx") * F.col("pair_n")).alias("pair_x2"),
        (F.col("pair_vy") * F.col("pair_n")).alias("pair_y2"), (F.col("pair_xy") * F.col("pair_n")).alias("pair_xy")]


def sum_columns(df: DataFrame, target: str) -> DataFrame:
    """The rows of `sketch_columns` without the sketches, by aggregates of at most
    `TOGETHER` sums. `df` is read once for each of them, so it should be a table."""
    groups: list[dict[int, dict[str, Column]]] = []
    left = 0
    for i, own in enumerate(_sums(df, df.columns, target)):
        if not groups or len(own) > left:
            groups.append({})
            left = TOGETHER
        groups[-1][i] = own
        left -= len(own)
    return reduce(DataFrame.unionAll, [_unpivoted(df, some, _FIGURES) for some in groups]).select(*_moment_columns())


def sketch_columns(df: DataFrame, target: str, by: Sequence[str] = (), k: int = KLL_K, lg: int = HLL_LG, items: int = ITEMS) -> DataFrame:
    """One row per (`by`, column of `df` not in `by`): `ord`, counts n and nn,
    min, max, mean, m2..m4 (sums of powers of the deviations), the same of the
    pairs with `target`, and the sketches kll, hll and top. Without `by`, an
    empty frame still gives a row per column. `df` is read twice, so it should
    be a table."""
    names = [c for c in df.columns if c not in by]
    sketches = []
    for name in names:
        v, dtype = value_of(df, name), df.schema[name].dataType
        text = v if isinstance(dtype, StringType) else v.cast("string")
        shapes = {"top": F.call_function("approx_top_k_accumulate", text, F.lit(items)),
                  "hll": F.hll_sketch_agg(v.cast("bigint") if isinstance(dtype, INTEGRAL) else text, F.lit(lg))}
        if isinstance(dtype, NUMERIC):
            shapes["kll"] = F.kll_sketch_agg_double(v.cast("double"), F.lit(k))
        sketches.append(shapes)

    # apart: beside sketches, which are objects, the sums would not be compiled
    left = _unpivoted(df, dict(enumerate(_sums(df, names, target))), _FIGURES, by)
    right = _unpivoted(df, dict(enumerate(sketches)), {"kll": "binary", "hll": None, "top": None}, by)
    right = right.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("ord").alias("_ord"), "kll", "hll", "top")
    rows = left.join(right, [left["ord"] == right["_ord"], *[left[c].eqNullSafe(right[f"_by{i}"]) for i, c in enumerate(by)]])
    return rows.select(*by, *_moment_columns(), "kll", "hll", "top")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of `sketch_columns` merged to one per (`by`, column)."""
    keys = [*by, "ord"]
    means = sketches.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("mean") * F.col("nn")), F.sum(F.when(F.col("mean").isNotNull(), F.col("nn")))).alias("_m"),
        F.try_divide(F.sum(F.col("pair_x") * F.col("pair_n")), F.sum("pair_n")).alias("_x"),
        F.try_divide(F.sum(F.col("pair_y") * F.col("pair_n")), F.sum("pair_n")).alias("_y"))
    both = sketches.join(means, keys)  # sketch rows, not data rows
    n, d = F.col("nn"), F.col("mean") - F.col("_m")
    dx, dy, pn = F.col("pair_x") - F.col("_x"), F.col("pair_y") - F.col("_y"), F.col("pair_n")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("_m").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.sum("pair_n").alias("pair_n"), F.max("_x").alias("pair_x"), F.max("_y").alias("pair_y"),
        F.sum(F.col("pair_x2") + pn * dx * dx).alias("pair_x2"), F.sum(F.col("pair_y2") + pn * dy * dy).alias("pair_y2"),
        F.sum(F.col("pair_xy") + pn * dx * dy).alias("pair_xy"),
        F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"),
        F.call_function("approx_top_k_combine", F.col("top")).alias("top"))


def quantile(rank: float | Column, sketch: str = "kll") -> Column:
    """The sketch's value at a normalised rank; null without values."""
    return F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(rank) if isinstance(rank, float) else rank))


def frequent() -> Column:
    """The sketch's most frequent values as (item, count), counts from above."""
    shown = F.call_function("approx_top_k_estimate", F.col("top"), F.lit(SHOWN_ITEMS))
    return F.filter(shown, lambda x: x["item"].isNotNull())  # nulls are counted as well


def read_moments(rows: DataFrame) -> DataFrame:
    """Rows of `sum_columns` or sketch rows with std, population skewness `skew`
    and excess kurtosis `kurt`, and correlation `corr`."""
    nn, m2, pn = F.col("nn"), F.col("m2"), F.col("pair_n")
    return rows.select(
        "*", F.when(nn > 1, F.sqrt(m2 / (nn - 1))).alias("std"),
        F.when(m2 > 0, F.sqrt(nn.cast("double")) * F.col("m3") / F.pow(m2, 1.5)).alias("skew"),
        F.when(m2 > 0, nn * F.col("m4") / (m2 * m2) - 3).alias("kurt"),
        F.when((pn > 1) & (F.col("pair_x2") > 0) & (F.col("pair_y2") > 0), F.col("pair_xy") / F.sqrt(F.col("pair_x2") * F.col("pair_y2"))).alias("corr"))


def read_out(sketches: DataFrame) -> DataFrame:
    """Sketch rows with the figures of `read_moments` and the estimate `distinct`."""
    return read_moments(sketches).withColumn("distinct", F.when(F.col("nn") > 0, F.hll_sketch_estimate("hll")).otherwise(F.lit(0)))
