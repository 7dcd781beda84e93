import math

from loanlens.operators.quality import data_quality_report


def _report(spark, values, target=None, approx=False):
    if target is None:
        df = spark.createDataFrame([(v,) for v in values], "x bigint")
    else:
        df = spark.createDataFrame(list(zip(values, target)), "x bigint, t bigint")
    return {r["Column"]: r for r in data_quality_report(df, target_col="t", approx=approx).collect()}


def test_report_column(spark):
    r = _report(spark, [1, 2, 4, 8, 16, None])["x"]
    assert r["Missing Values"] == 1 and math.isclose(r["Missing Percentage"], 100 / 6)
    assert r["Unique Values"] == 5 and math.isclose(r["Mean"], 6.2)
    assert math.isclose(r["Std Dev"], 6.099180272790763, rel_tol=1e-9)
    assert (r["25% Quantile"], r["Median"], r["75% Quantile"], r["IQR"]) == (2.0, 4.0, 8.0, 6.0)
    assert r["Mode"] == "1" and math.isclose(r["Mode Percentage"], 100 / 6)
    assert math.isclose(r["Skewness"], 1.325315, rel_tol=1e-5)
    assert math.isclose(r["Kurtosis"], 1.303763, rel_tol=1e-5)
    assert math.isclose(r["CV (%)"], 98.3739, rel_tol=1e-5)


def test_constant_column(spark):
    r = _report(spark, [3, 3, 3, 3, 3], target=[0, 1, 0, 1, 1])["x"]
    assert r["Skewness"] == 0.0 and r["Kurtosis"] == 0.0
    assert r["Correlation with t"] is None


def test_approx_matches_on_small_data(spark):
    r = _report(spark, [1, 2, 4, 8, 16, None], approx=True)["x"]
    assert r["Unique Values"] == 5 and r["Median"] == 4.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = {row["Column"]: row for row in data_quality_report(df, target_col="t").collect()}["x"]
    assert r["Missing Values"] == 2 and r["Mean"] == 2.0 and r["Max"] == 3.0 and r["Unique Values"] == 2


def test_large_integers_keep_their_digits(spark):
    for approx in (False, True):
        r = _report(spark, [2**60, 2**60 + 1, 2**60 + 2, 2**60 + 2], approx=approx)["x"]
        assert (r["Unique Values"], r["Mode"], r["Mode Percentage"]) == (3, str(2**60 + 2), 50.0)
    r = _report(spark, [-(2**60), -(2**60) - 1, -(2**60) - 2])["x"]  # ties: the smallest value
    assert r["Mode"] == str(-(2**60) - 2)


def test_empty_frame_has_a_row_per_column(spark):
    df = spark.createDataFrame([], "x bigint, s string, t double")
    for approx in (False, True):
        rows = data_quality_report(df, target_col="t", approx=approx).collect()
        assert [(r["Column"], r["Missing Values"], r["Missing Percentage"], r["Unique Values"]) for r in rows] == [
            ("x", 0, None, 0), ("s", 0, None, 0), ("t", 0, None, 0)]


def test_nulls_are_no_mode(spark):
    df = spark.createDataFrame([(None,), (None,), (None,), (4,), (4,), (5,)], "x bigint")
    for approx in (False, True):
        r = data_quality_report(df, target_col="t", approx=approx).first()
        assert (r["Mode"], r["Missing Values"]) == ("4", 3)


def _brute(values):
    """Distinct count, mode and quartiles of one column."""
    import numpy as np
    from collections import Counter

    seen = [v for v in values if v is not None]
    counts = Counter(seen)
    mode = min((v for v in counts if counts[v] == max(counts.values())), default=None)
    return len(counts), mode, counts[mode] if seen else 0, [float(np.quantile(np.array(seen, dtype=float), q)) for q in (0.25, 0.5, 0.75)]


def test_exact_report_by_bitmaps_and_selection(spark, monkeypatch):
    """Columns of every kind: filled and sparse integers, a heavy hitter, ties,
    few values, fractions; small sketches, so that bounds miss and values are cut."""
    import random

    from loanlens.operators import quality as ql

    monkeypatch.setattr(ql, "FEW", 500)
    rng = random.Random(7)
    n = 4000
    data = {
        "ids": list(range(5, n + 5)), "filled": [rng.randrange(-2000, 2000) for _ in range(n)],
        "heavy": [77 if rng.random() < 0.3 else rng.randrange(5000) for _ in range(n)], "sparse": [rng.randrange(10**12) for _ in range(n)],
        "few": [rng.choice([1, 2, 2, 3]) for _ in range(n)], "frac": [rng.gauss(0, 1) for _ in range(n)],
        "gaps": [None if rng.random() < 0.4 else rng.randrange(3 * n) for _ in range(n)], "none": [None] * n,
    }
    kinds = ", ".join(f"{c} {'double' if c == 'frac' else 'bigint'}" for c in data)
    df = spark.createDataFrame(list(zip(*data.values())), kinds).repartition(4)
    for accuracy in (20,):
        got = {r["Column"]: r for r in data_quality_report(df, target_col="few", accuracy=accuracy).collect()}
        for name, values in data.items():
            distinct, mode, count, quartiles = _brute(values) if name != "none" else (0, None, 0, [None] * 3)
            r = got[name]
            assert (r["Unique Values"], r["Mode"]) == (distinct, None if mode is None else str(mode)), name
            assert [r["25% Quantile"], r["Median"], r["75% Quantile"]] == quartiles or \
                all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip([r["25% Quantile"], r["Median"], r["75% Quantile"]], quartiles)), name
            if count:
                assert math.isclose(r["Mode Percentage"], 100 * count / n)


def test_merged_sketches_equal_one_pass(spark):
    """Sketches per group, written and merged, against one over all rows."""
    import random

    import pytest
    from loanlens.operators import quality as ql
    from loanlens.operators import sketches as sk
    from loanlens.plans.stages import handoff

    rng = random.Random(3)
    rows = [(d, rng.gauss(1000 + d, 3), rng.choice(["a", "a", "b", None]), rng.random() < 0.3 if d else None) for d in range(12) for _ in range(500)]
    df = spark.createDataFrame(rows, "day int, x double, s string, t boolean")
    parts = handoff(sk.sketch_columns(df, "t", by=["day"]))
    assert parts.count() == 36
    merged = {r["Column"]: r for r in ql.report_of_sketches(sk.merge_sketches(parts), df, "t", by=["day"]).collect()}
    whole = {r["Column"]: r for r in data_quality_report(df.drop("day"), target_col="t").collect()}
    for name in ("x", "s", "t"):
        for c in ("Missing Values", "Min", "Max", "Mean", "Std Dev", "Skewness", "Kurtosis", "Correlation with t"):
            a, b = merged[name][c], whole[name][c]
            assert a == b or a == pytest.approx(b, rel=1e-7, abs=1e-9), (name, c)
    assert [merged[c]["Mode"] for c in ("s", "t")] == [whole[c]["Mode"] for c in ("s", "t")] == ["a", "0"]
    xs = sorted(r[1] for r in rows)
    for q in (25, 50, 75):
        rank = sum(v <= merged["x"][f"{q}% Quantile"] for v in xs)
        assert abs(rank - q / 100 * len(xs)) <= sk.rank_error() * len(xs) + 1
    assert abs(merged["x"]["Unique Values"] - whole["x"]["Unique Values"]) <= 0.08 * whole["x"]["Unique Values"]
    weeks = sk.merge_sketches(parts.withColumn("week", (parts.day / 7).cast("int")), by=["week"])
    assert weeks.count() == 6


def test_no_row_per_cell(spark):
    """The exact report makes far fewer rows than cells beyond its scans."""
    from loanlens.operators import quality as ql

    df = spark.range(20_000).selectExpr("id", "id % 3 as a", "id % 7 as b", "cast(id % 5 as double) as c")
    counted = ql._counted(df, [1, 2], df.columns)
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "Expand" not in text
    assert counted.count() == 10


def test_exact_report_from_given_sketches(spark, tmp_path):
    """Sketches made before (here merged from two parts) say where to look: the
    same report, and the table is neither written nor sketched again."""
    from pyspark.sql import functions as F

    from loanlens.operators import quality as ql
    from loanlens.operators import sketches as sk
    from loanlens.plans import stages

    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id % 2 as part", "cast(id % 37 as double) as x", "id as y", "if(id % 5 = 0, null, concat('v', id % 3)) as z").write.parquet(path)
    frame = spark.read.parquet(path)
    merged = stages.handoff(sk.merge_sketches(sk.sketch_columns(frame.withColumn("_p", F.col("part")), "x", by=["_p"])))
    before = len(stages._WRITTEN)
    got = ql.data_quality_report(frame, "x", decimals=6, sketches=merged)
    given = len(stages._WRITTEN) - before
    want = ql.data_quality_report(frame, "x", decimals=6)
    assert got.collect() == want.collect()
    assert given == len(stages._WRITTEN) - before - given - 1


def test_exact_report_makes_no_sketches(spark, monkeypatch):
    """Of 30 numeric columns of every kind: the exact report groups, sums and ranks
    them without sketches, and equals plain aggregates."""
    import pytest

    from loanlens.operators import quality as ql
    from loanlens.operators import sketches as sk

    kinds = ["bigint", "decimal(18,2)", "double", "float", "boolean", "int"]
    exprs = [f"cast(if(id % {i + 2} = 0, null, (id * {i + 7}) % {2 + i * i} - {i}) as {kinds[i % 6]}) as c{i}" for i in range(30)]
    df = spark.range(3000).selectExpr("id % 2 as t", *exprs, "concat('v', id % 9) as s", "cast(null as int) as gone")

    def never(*args, **kwargs):
        raise AssertionError("sketched")

    monkeypatch.setattr(sk, "sketch_columns", never)
    got = {r["Column"]: r for r in ql.data_quality_report(df, "t").collect()}
    frame = df.toPandas()
    assert list(got) == df.columns
    for name in [c for c in df.columns if c not in ("s", "gone")]:
        x, y, r = frame[name].dropna().astype(float), frame["t"], got[name]
        assert (r["Missing Values"], r["Unique Values"]) == (3000 - len(x), x.nunique()), name
        want = [x.min(), x.max(), x.mean(), x.median(), x.std(), *x.quantile([0.25, 0.75])]
        assert [r[c] for c in ("Min", "Max", "Mean", "Median", "Std Dev", "25% Quantile", "75% Quantile")] == pytest.approx(want), name
        assert float(r["Mode"]) == pytest.approx(x.mode().min()) and r["Mode Percentage"] == pytest.approx((x == x.mode().min()).sum() / 30), name
        if x.std() > 0 and name != "t":
            assert r["Correlation with t"] == pytest.approx(x.corr(y[x.index].astype(float)), abs=1e-12), name
    assert (got["s"]["Unique Values"], got["s"]["Mode"], got["s"]["Min"]) == (9, "v0", None)
    assert (got["gone"]["Missing Values"], got["gone"]["Unique Values"], got["gone"]["Mode"], got["gone"]["Median"]) == (3000, 0, None, None)


def test_sums_of_many_columns_are_compiled(spark):
    """Every aggregate over the rows is part of a compiled stage, however many columns."""
    from loanlens.operators import sketches as sk

    df = spark.range(100).selectExpr(*[f"if(id % 7 = {i}, null, cast(id as double)) as c{i}" for i in range(20)],
                                     *[f"if(id % 7 = {i}, null, cast(id as string)) as s{i}" for i in range(60)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sk.sum_columns(df, "c0")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    partial = [line for line in plan.splitlines() if "HashAggregate" in line and "partial_" in line]
    assert len(partial) == 9 and all("*(" in line.split("HashAggregate")[0] for line in partial)


def test_bitmaps_and_selection_equal_groups(spark, monkeypatch):
    """Given small sketches, so that bounds miss, the exact report equals the one without."""
    import random

    from loanlens.operators import quality as ql
    from loanlens.operators import sketches as sk
    from loanlens.plans.stages import handoff

    monkeypatch.setattr(ql, "FEW", 500)
    rng = random.Random(11)
    n = 4000
    rows = [(i + 5, rng.randrange(-2000, 2000), 77 if rng.random() < 0.3 else rng.randrange(5000), rng.gauss(0, 1), rng.choice([1, 2, 2, None])) for i in range(n)]
    frame = handoff(spark.createDataFrame(rows, "ids bigint, filled bigint, heavy bigint, frac double, few bigint").repartition(4))
    sketches = handoff(sk.sketch_columns(frame, "few", k=sk.k_for(1 / 20)))
    given = ql.data_quality_report(frame, "few", decimals=6, accuracy=20, sketches=sketches).collect()
    assert given == ql.data_quality_report(frame, "few", decimals=6).collect()
