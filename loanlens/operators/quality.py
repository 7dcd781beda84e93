"""Per-column data-quality report (21 metrics per column).

Approximate: one pass of sketches (`sketches.sketch_columns`): counts, moments,
correlation, and mergeable sketches of quantiles, distinct counts and frequent
values, from which the report is read; sketches of parts, such as days, can be kept
and merged, and `report_of_sketches` reads the merged ones.

Exact: no row per cell is ever made. Grouping one column of a written table by its
own value costs less than sketching it, so each column is grouped alone, combined
before the shuffle:

  moments    sums over the rows, a few columns per aggregate, so that it is compiled
  distinct   the number of a column's groups
  mode       the greatest count (ties: the smallest value)
  quantiles  the numeric groups range-partitioned by value, with running counts

Exact with sketches made before: counts and moments are read from the sketches,
which also say where to look for the rest.

  quantiles  by selection: the quantile sketch bounds each wanted rank from both
             sides; one pass counts the values below and at the bounds and keeps
             those strictly between (a share of about four rank errors), which are
             counted and ranked alone. Bounds that miss their rank are widened and
             tried again, so the result does not rest on the sketch.
  distinct   a column of integers that fill their range: bitmaps of 32,768 values
             each (`bitmap_construct_agg`), a row per bitmap; all others: the
             column alone, grouped by value in its own type, combined before the
             shuffle
  mode       of a grouped column its greatest count (ties: the smallest value); of
             a bitmap column the exact counts of the sketch's frequent values, as
             long as one of them is frequent enough that no value outside the
             sketch can match it; if no value occurs twice, the smallest; else the
             column is grouped after all
Quantiles use linear interpolation; skewness and kurtosis are the
bias-corrected sample values (0 for a constant column); correlation is
Pearson on rows where both values exist (null when undefined).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loanlens.operators import sketches as sk
from loanlens.plans.stages import handoff
from loanlens.session import shared_code

QUANTILES = (0.25, 0.5, 0.75)
# a column with fewer distinct values is grouped whatever its type: its groups combine to next to nothing
FEW = 10_000
# values per bitmap
BITMAP = 32_768


def report_columns(target_col: str) -> list[str]:
    return [
        "Column", "Data Type", "Missing Values", "Missing Percentage", "Unique Values", "Min", "Max", "Mean",
        "Median", "Mode", "Mode Percentage", "Std Dev", "Non-missing Percentage", "25% Quantile",
        "50% Quantile", "75% Quantile", "IQR", "Skewness", "Kurtosis", "CV (%)", f"Correlation with {target_col}",
    ]


def _lerp(a, b, t):
    """Linear interpolation as numpy computes it (stable for t >= 0.5)."""
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)


def _value_order(is_numeric) -> Column:
    """Smallest value first: numbers by size (digits decide where doubles tie)."""
    number = F.when(is_numeric, F.col("value").cast("double"))
    minus = number < 0
    size = F.when(is_numeric, F.when(minus, -F.length("value")).otherwise(F.length("value")))
    return F.struct(number.alias("number"), size.alias("size"),
                    F.when(minus, F.translate("value", "0123456789", "9876543210")).otherwise(F.col("value")).alias("text"))


def _counted(df: DataFrame, ords: list[int], names: list[str]) -> DataFrame:
    """(ord, value as the text of its own type, cnt), each column grouped alone."""
    return _all([_own_counts(df, names[i]).select(F.lit(i).alias("ord"), F.col("v").cast("string").alias("value"), "cnt") for i in ords])


def _own_counts(df: DataFrame, name: str) -> DataFrame:
    """(v, cnt) of one column."""
    return df.select(sk.value_of(df, name).alias("v")).where("v is not null").groupBy("v").agg(F.expr("count(1) as cnt"))


def _all(parts: list[DataFrame]) -> DataFrame:
    """The union of `parts`, halved, so that the plans of many are not analysed over and over."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return _all(parts[:half]).unionAll(_all(parts[half:]))


def _grouped(df: DataFrame, ords: list[int], names: list[str], info: DataFrame) -> DataFrame:
    """ord, distinct, mode, mode_n of the columns `ords`."""
    counts = _counted(df, ords, names).join(F.broadcast(info.select("ord", "numeric")), "ord")  # a row per column
    place = F.struct((-F.col("cnt")).alias("rare"), _value_order(F.col("numeric")).alias("place"))
    return counts.groupBy("ord").agg(F.count(F.lit(1)).alias("distinct"), F.min_by(F.struct("value", "cnt"), place).alias("top")).select(
        "ord", "distinct", F.col("top.value").alias("mode"), F.col("top.cnt").alias("mode_n"))


def _filled(row: Row) -> bool:
    """Whether integers fill their range well enough for bitmaps to be smaller than their values."""
    return row.integral and row.distinct > FEW and row.max - row.min < 16 * row.distinct and max(-row.min, row.max) < 2**53


def _by_bitmap(df: DataFrame, rows: list[Row], names: list[str], info: DataFrame, items: int) -> tuple[DataFrame | None, list[int]]:
    """(ord, distinct, mode, mode_n) of integer columns by bitmaps and frequent
    values, and the columns whose mode these cannot give."""
    maps, heavy = [], []
    for r in rows:
        v = sk.value_of(df, names[r.ord]).cast("bigint")
        own = df.select(v.alias("v")).where(F.col("v").isNotNull())
        bits = own.groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        maps.append(bits.select(F.lit(r.ord).alias("ord"), F.bitmap_count("bits").alias("n")))
        wanted = [int(x["item"]) for x in r.frequent]
        if wanted:
            heavy.append(own.where(F.col("v").isin(wanted)).groupBy("v").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(r.ord).alias("ord"), "v", "cnt"))
    distinct = {r.ord: r.n for r in reduce(DataFrame.unionAll, maps).groupBy("ord").agg(F.sum("n").alias("n")).collect()}
    top: dict[int, tuple[int, int]] = {}
    if heavy:
        best = reduce(DataFrame.unionAll, heavy).groupBy("ord").agg(F.min(F.struct((-F.col("cnt")).alias("rare"), "v")).alias("t"))
        top = {r.ord: (r.t.v, -r.t.rare) for r in best.collect()}
    done, open_ = [], []
    for r in rows:
        value, count = top.get(r.ord, (None, 0))
        # a value that the sketch does not name occurs no more often than this
        missed = max(sk.unnamed_share(items) * r.n, r.frequent[-1]["count"] if len(r.frequent) >= sk.SHOWN_ITEMS - 1 else 0)
        if distinct[r.ord] == r.nn:
            done.append((r.ord, distinct[r.ord], str(int(r.min)), 1))
        elif count > missed:
            done.append((r.ord, distinct[r.ord], str(value), count))
        else:
            open_.append(r.ord)
    found = df.sparkSession.createDataFrame(done, "ord int, distinct bigint, mode string, mode_n bigint") if done else None
    return found, open_


def _asked(rows: list[Row]) -> dict[tuple[int, float], tuple[int, int, float]]:
    """(ord, quantile) -> the two ranks (from 0) it lies between, and where between them."""
    asked = {}
    for r in rows:
        for q in QUANTILES:
            pos = q * (r.nn - 1)
            asked[r.ord, q] = (int(pos), min(int(pos) + (pos > int(pos)), r.nn - 1), pos - int(pos))
    return asked


def _quartiles(rows: list[Row], asked: dict, found: dict[tuple[int, float], tuple[float, float]]) -> list[tuple]:
    """(ord, q25, q50, q75) from the values `found` at the ranks `asked`."""
    out = []
    for r in rows:
        pair = [(*found[r.ord, q], asked[r.ord, q][2]) for q in QUANTILES]
        out.append((r.ord, *[float(b - (b - a) * (1 - t)) if t >= 0.5 else float(a + (b - a) * t) for a, b, t in pair]))
    return out


def _selected(df: DataFrame, rows: list[Row], names: list[str], k: int) -> list[tuple]:
    """(ord, q25, q50, q75) of the numeric columns in `rows`, exactly."""
    spark = df.sparkSession
    asked = _asked(rows)
    least = {r.ord: (r.min, r.max) for r in rows}
    bounds = {(r.ord, q): tuple(r.bounds[2 * j:2 * j + 2]) for r in rows for j, q in enumerate(QUANTILES)}
    found: dict[tuple[int, float], tuple[float, float]] = {}
    while len(found) < len(asked):
        todo = {key: bounds[key] for key in asked if key not in found}
        value = {i: sk.value_of(df, names[i]).cast("double") for i, _ in todo}
        counts = df.agg(*[F.sum(test.cast("bigint")).alias(f"{j}_{what}") for j, ((i, _), (a, b)) in enumerate(todo.items())
                          for what, test in (("below", value[i] < a), ("at_a", value[i] == a), ("at_b", value[i] == b))]).first()
        spans = {}  # of each column, the values strictly inside any of its bounds
        for (i, _), (a, b) in todo.items():
            if a < b:
                spans[i] = spans.get(i, F.lit(False)) | ((value[i] > a) & (value[i] < b))
        inside = None
        if spans:
            cells = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("ord"), value[i].alias("v"))) for i, test in spans.items()]))
            kept = df.select(F.explode(cells).alias("c")).groupBy("c.ord", "c.v").agg(F.count(F.lit(1)).alias("cnt"))
            limits = spark.createDataFrame([(i, q, float(a), float(b)) for (i, q), (a, b) in todo.items()], "ord int, q double, a double, b double")
            inside = handoff(kept.join(F.broadcast(limits), "ord").where("v > a and v < b").select("ord", "q", "v", "cnt"))  # 3 rows per column
            sums = {(r.ord, r.q): r.n for r in inside.groupBy("ord", "q").agg(F.sum("cnt").alias("n")).collect()}
        else:
            sums = {}
        picks = []
        for j, ((i, q), (a, b)) in enumerate(todo.items()):
            below, at_a, at_b = (counts[f"{j}_{w}"] for w in ("below", "at_a", "at_b"))
            if a == b:
                at_b = 0
            lo, hi, _ = asked[i, q]
            whole = sums.get((i, q), 0)
            if lo < below or hi >= below + at_a + whole + at_b:
                bounds[i, q] = least[i]  # missed: all values of the column
                continue
            ends = [a if r < below + at_a else b if r >= below + at_a + whole else None for r in (lo, hi)]
            found[i, q] = tuple(ends)
            picks += [(i, q, r - below - at_a, e) for e, r in enumerate((lo, hi)) if ends[e] is None]
        if picks:
            for i, q, e, v in _ranked(inside, picks):
                found[i, q] = tuple(v if j == e else x for j, x in enumerate(found[i, q]))
    return _quartiles(rows, asked, found)


def _by_value(df: DataFrame, names: list[str]) -> DataFrame:
    """Each column grouped alone, in its own type, all in one written table: of
    every column a row (ord, distinct, mode, mode_n), of a numeric one also a row
    (ord, v, cnt) per value. Both are read from one shuffle of its groups."""
    found = []
    for i, name in enumerate(names):
        own = _own_counts(df, name)
        number = isinstance(df.schema[name].dataType, sk.NUMERIC)
        # of equally frequent values the smallest
        top = own.selectExpr("count(1) as n", f"min(struct(-cnt as rare, {'v' if number else 'cast(v as string) as v'})) as top")
        found.append(top.selectExpr(f"{i} as ord", "cast(null as double) as v", "cast(null as bigint) as cnt",
                                    "n as `distinct`", "cast(top.v as string) as mode", "-top.rare as mode_n"))
        if number:
            found.append(own.selectExpr(f"{i} as ord", "cast(v as double) as v", "cnt",
                                        "cast(null as bigint) as `distinct`", "cast(null as string) as mode", "cast(null as bigint) as mode_n"))
    return handoff(_all(found))


def _at_ranks(counts: DataFrame, rows: list[Row]) -> list[tuple]:
    """(ord, q25, q50, q75) of the numeric columns in `rows` from their values and counts."""
    asked = _asked(rows)
    picks = [(i, rank, 2 * QUANTILES.index(q) + e) for (i, q), ranks in asked.items() for e, rank in enumerate(ranks[:2])]
    value = {(i, e): v for i, e, v in _ranked(counts, picks, ("ord",))}
    return _quartiles(rows, asked, {(i, q): tuple(value[i, 2 * QUANTILES.index(q) + e] for e in (0, 1)) for i, q in asked})


def _ranked(values: DataFrame, picks: list[tuple], keys: tuple[str, ...] = ("ord", "q")) -> list[tuple]:
    """The values at given ranks (`picks`: keys, rank, any number e) among the
    counted `values` (keys, v, cnt) of each key, as (keys, e, v): range-partitioned
    and written with their partition number, an offset per partition, and running
    counts inside each."""
    spark = values.sparkSession
    ranged = handoff(values.repartitionByRange(*keys, "v").withColumn("pid", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("pid", *keys).agg(F.sum("cnt").alias("n")).select(
        "pid", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pid", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("end", F.sum("cnt").over(inside)).join(F.broadcast(offsets), ["pid", *keys])  # a row per partition and key at most
    kinds = {"ord": "int", "q": "double"}
    wanted = spark.createDataFrame(picks, ", ".join([*[f"{c} {kinds[c]}" for c in keys], "rank bigint", "e int"]))
    end = F.col("offset") + F.col("end")
    hit = placed.join(F.broadcast(wanted), [*keys]).where((F.col("rank") >= end - F.col("cnt")) & (F.col("rank") < end))
    return [tuple(r) for r in hit.select(*keys, "e", "v").collect()]  # 6 rows per column


def _info(df: DataFrame, names: list[str]) -> DataFrame:
    meta = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(df.schema[n].dataType.simpleString()).alias("dtype"),
                 F.lit(isinstance(df.schema[n].dataType, sk.NUMERIC)).alias("numeric"))
        for i, n in enumerate(names)
    ])
    return df.sparkSession.range(1).select(F.explode(meta).alias("x")).select("x.*")


def report_of_sketches(sketches: DataFrame, df: DataFrame, target_col: str, by=(), decimals: int | None = None) -> DataFrame:
    """The report read from the rows of `sketch_columns` (or merged ones) of the
    columns of `df`, of which only names and types are used."""
    info = _info(df, [c for c in df.columns if c not in by])
    out = sk.read_out(sketches).withColumn("t", F.get(sk.frequent(), F.lit(0))).select(
        "*", F.col("t.item").alias("mode"), F.col("t.count").alias("mode_n"), *[sk.quantile(q).alias(f"q{int(q * 100)}") for q in QUANTILES])
    return _laid_out(out.join(F.broadcast(info), "ord"), target_col, decimals)  # a row per column


def data_quality_report(df: DataFrame, target_col: str = "ln_fspd30_flag", approx: bool = False,
                        decimals: int | None = None, rsd: float = 0.02, accuracy: int = 790, items: int = sk.ITEMS,
                        sketches: DataFrame | None = None) -> DataFrame:
    """One row per column of `df` with missing/unique counts, numeric summary,
    mode, quantiles, shape and correlation with `target_col`.

    Numeric = integral, fractional, decimal and boolean (as 0/1) columns;
    others get counts and the mode only. With `approx` a column in which no value
    is frequent has no mode. `decimals` rounds the double metrics.
    `rsd` is the relative standard error of the distinct sketch, 1 / `accuracy`
    the rank error of the quantile sketch: of the results with `approx`, else
    only of where the exact passes look in given sketches. The input is handed off
    as a written table, read column by column; with `sketches` (those of
    `sketch_columns` of the whole of `df`, or merged ones, of this size) `df` is
    such a table already.
    """
    k, lg = sk.k_for(1 / accuracy), sk.lg_for(rsd)
    names = df.columns
    info = _info(df, names)
    if sketches is None:
        df = handoff(df)
        if not approx:
            return _laid_out(_exact(df, names, target_col, info), target_col, decimals)
        sketches = sk.sketch_columns(df, target_col, k=k, lg=lg, items=items)
    if approx:
        return report_of_sketches(sketches, df, target_col, decimals=decimals)
    return _laid_out(_exact_by_sketches(df, sketches, names, info, k, items), target_col, decimals)


def _exact(df: DataFrame, names: list[str], target_col: str, info: DataFrame) -> DataFrame:
    """The figures of every column of the written table `df`, without sketches."""
    with shared_code(df.sparkSession):
        figures = handoff(sk.read_moments(sk.sum_columns(df, target_col)))
        values = _by_value(df, names)
    numbers = figures.where("min is not null").select("ord", "nn").collect()  # a row per column
    quantiles = _at_ranks(values.where("cnt is not null").select("ord", "v", "cnt"), numbers) if numbers else []
    found = values.where("distinct is not null").select("ord", "distinct", "mode", "mode_n")
    return _put_together(figures, info, found, quantiles)


def _exact_by_sketches(df: DataFrame, sketches: DataFrame, names: list[str], info: DataFrame, k: int, items: int) -> DataFrame:
    """The same where the sketches of `df` are at hand: they say where to look."""
    figures = handoff(sk.read_out(sketches))
    slack = 2 * sk.rank_error(k)
    ends = [sk.quantile(e) if 0 < e < 1 else F.col("min" if e <= 0 else "max") for q in QUANTILES for e in (q - slack, q + slack)]
    rows = figures.select("ord", "n", "nn", "min", "max", "distinct", F.array(*ends).alias("bounds"), sk.frequent().alias("frequent"),
                          F.col("ord").isin([i for i, c in enumerate(names) if isinstance(df.schema[c].dataType, sk.INTEGRAL)
                                             and not isinstance(df.schema[c].dataType, BooleanType)]).alias("integral")).collect()  # a row per column
    found, left = _by_bitmap(df, [r for r in rows if _filled(r)], names, info, items) if any(map(_filled, rows)) else (None, [])
    group = [r.ord for r in rows if not _filled(r)] + left
    if group:
        grouped = _grouped(df, group, names, info)
        found = grouped if found is None else found.unionByName(grouped)
    numbers = [r for r in rows if r.min is not None]
    return _put_together(figures.drop("distinct"), info, found, _selected(df, numbers, names, k) if numbers else [])


def _put_together(figures: DataFrame, info: DataFrame, found: DataFrame, quantiles: list[tuple]) -> DataFrame:
    quartiles = figures.sparkSession.createDataFrame(quantiles, "ord int, q25 double, q50 double, q75 double")
    return figures.join(F.broadcast(info), "ord").join(found, "ord", "left").join(F.broadcast(quartiles), "ord", "left")


def _laid_out(out: DataFrame, target_col: str, decimals: int | None) -> DataFrame:
    n, nn = F.col("n"), F.col("nn")
    missing = n - nn
    std, mean = F.col("std"), F.col("mean")
    skew = F.when(nn < 3, F.lit(None)).when(std == 0, F.lit(0.0)).otherwise(
        F.col("skew") * F.sqrt(nn * (nn - 1)) / (nn - 2))
    kurt = F.when(nn < 4, F.lit(None)).when(std == 0, F.lit(0.0)).otherwise(
        ((nn + 1) * F.col("kurt") + 6) * (nn - 1) / ((nn - 2) * (nn - 3)))
    is_num = F.col("min").isNotNull() | F.col("q50").isNotNull()
    distinct = F.col("distinct")

    def r(c):
        return F.round(c, decimals) if decimals is not None else c

    cols = report_columns(target_col)
    result = out.select(
        "ord",
        F.col("name").alias(cols[0]),
        F.col("dtype").alias(cols[1]),
        missing.alias(cols[2]),
        r(F.try_divide(missing, n) * 100).alias(cols[3]),
        F.coalesce(distinct, F.lit(0)).cast("bigint").alias(cols[4]),
        r(F.col("min")).alias(cols[5]),
        r(F.col("max")).alias(cols[6]),
        r(mean).alias(cols[7]),
        r(F.col("q50")).alias(cols[8]),
        F.col("mode").alias(cols[9]),
        r(F.try_divide(F.col("mode_n"), n) * 100).alias(cols[10]),
        r(std).alias(cols[11]),
        r(F.try_divide(nn, n) * 100).alias(cols[12]),
        r(F.col("q25")).alias(cols[13]),
        r(F.col("q50")).alias(cols[14]),
        r(F.col("q75")).alias(cols[15]),
        r(F.col("q75") - F.col("q25")).alias(cols[16]),
        r(F.when(is_num, skew)).alias(cols[17]),
        r(F.when(is_num, kurt)).alias(cols[18]),
        r(F.when(mean != 0, std / mean * 100)).alias(cols[19]),
        r(F.col("corr")).alias(cols[20]),
    )
    # one row per profiled column (bounded by the column count): sorted in a
    # single partition, without a range-partition sampling job
    return result.repartition(1).sortWithinPartitions("ord").drop("ord")
