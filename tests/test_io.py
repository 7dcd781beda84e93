import os
import tempfile

import pytest

from loanlens.sources import io as lio


def test_format_guard(spark):
    with pytest.raises(ValueError):
        lio.read_dataset(spark, "/nowhere", "pickle")
    with pytest.raises(ValueError):
        lio.write_dataset(spark.range(1), "/nowhere", "joblib")


def test_write_multi_manifest_and_csv_read(spark):
    root = tempfile.mkdtemp(prefix="loanlens-io-")
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id bigint, s string, x double")
    manifest = lio.write_multi(df, root, "/sub/dir", "frame")
    assert manifest == {"csv": f"{root}/sub/dir/frame.csv", "parquet": f"{root}/sub/dir/frame.parquet"}
    back = lio.read_dataset(spark, manifest["csv"], "csv")
    assert dict(back.dtypes) == {"id": "int", "s": "string", "x": "double"}
    assert sorted(r.id for r in back.collect()) == [1, 2]
    assert lio.read_dataset(spark, manifest["parquet"], "parquet").count() == 2
    with pytest.raises(ValueError):
        lio.write_multi(df, None, "p", "n")


def test_write_multi_records_error(spark):
    root = tempfile.mkdtemp(prefix="loanlens-io-")
    blocker = os.path.join(root, "p")
    open(blocker, "w").close()  # a file where a folder must go
    manifest = lio.write_multi(spark.range(3), root, "p", "n")
    assert "error" in manifest and "csv" not in manifest


def test_replace_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS loanlens_test")
    name = lio.replace_table(spark.range(3), "loanlens_test", "scores", "2025-09-15")
    assert name == "loanlens_test.scores_20250915"
    lio.replace_table(spark.range(5), "loanlens_test", "scores", "2025-09-15")
    assert spark.table(name).count() == 5


def test_replace_is_atomic(spark):
    """A failing write leaves the old rows; a reader of the old version goes on
    reading it; the table is never absent; old versions go."""
    from pyspark.sql import functions as F

    spark.sql("CREATE DATABASE IF NOT EXISTS loanlens_test")
    name = lio.replace_table(spark.range(3), "loanlens_test", "atomic", "2025-09-15")
    reader = spark.table(name)
    broken = spark.range(4).select(F.when(F.col("id") == 2, F.raise_error(F.lit("bad row")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        lio.replace_table(broken, "loanlens_test", "atomic", "2025-09-15")
    assert spark.table(name).count() == 3 and [n for n, _ in lio.versions(spark, name)] == [1]
    lio.replace_table(spark.range(5).withColumn("extra", F.lit("x")), "loanlens_test", "atomic", "2025-09-15")
    assert spark.table(name).columns == ["id", "extra"] and spark.table(name).count() == 5
    assert reader.count() == 3  # planned before the swap
    lio.replace_table(spark.table(name).limit(2), "loanlens_test", "atomic", "2025-09-15")  # from itself
    assert spark.table(name).count() == 2 and [n for n, _ in lio.versions(spark, name)] == [2, 3]


def test_replace_takes_over_a_plain_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS loanlens_test")
    spark.range(7).write.mode("overwrite").saveAsTable("loanlens_test.plain_20250915")
    name = lio.replace_table(spark.range(2), "loanlens_test", "plain", "2025-09-15")
    assert spark.table(name).count() == 2 and [n for n, _ in lio.versions(spark, name)] == [0, 1]


def test_written_order_is_kept(spark):
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="loanlens-io-")
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b")).repartition(5)
    path = lio.write_ordered(df, [F.col("b").desc(), "a"], f"{root}/ordered", parts=6)
    back = spark.read.parquet(path)
    rows = sorted(back.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1000))
    assert [(-r.b, r.a) for r in rows] == sorted((-r.b, r.a) for r in rows)
    assert back.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n")).where(
        "hi - lo + 1 <> n").count() == 0  # each file is one range


def test_missing_columns_are_named(spark):
    from loanlens.operators import targets as tg
    from loanlens.sources import MissingColumns, Sources

    reps = spark.createDataFrame([(1, 10)], "user_id bigint, loan_id bigint")
    emp = spark.createDataFrame([(1,)], "ee_customer_id bigint")
    with pytest.raises(MissingColumns, match="vendor_id"):
        tg.user_targets(reps, emp)
    with pytest.raises(MissingColumns, match="tendopay_user_id"):
        from loanlens.operators import delinquency as dq

        dq.delinquency(Sources({"payment_responses": reps, "users": reps}), "2025-01-01")


def test_sources_from_parquet(spark):
    from loanlens.sources import Sources

    root = tempfile.mkdtemp(prefix="loanlens-src-")
    spark.range(4).withColumnRenamed("id", "user_id").write.parquet(f"{root}/user_tag")
    src = Sources.from_parquet(spark, root)
    assert src.table("user_tag", "user_id").count() == 4
    with pytest.raises(Exception):
        src.table("user_tag", "tag_id")


def test_declared_schemas_match_adapter(spark):
    from loanlens.sources.schemas import SCHEMAS, conform, ddl
    from loanlens.sources.testdata import adapter_sources

    src = adapter_sources(spark, "/root/testdata/sf0.001")
    for name in SCHEMAS:
        df = conform(src[name], name)
        assert [f.name for f in df.schema.fields] == [c for c, _ in SCHEMAS[name]]
    # DDL strings are readable by Spark
    assert spark.createDataFrame([], ddl("payment_responses")).columns[1] == "tendopay_user_id"
