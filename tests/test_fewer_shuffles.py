"""The repayment fact, its balances and the target inputs read their rows once:
results as before, counted shuffles and reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanlens.operators import prep as pr
from loanlens.operators import relational as rl
from loanlens.operators import repayments as rp
from loanlens.operators.repayments import FACT_COLUMNS
from loanlens.plans import registry
from loanlens.session import bounded_tasks
from loanlens.sources import Sources
from loanlens.sources.testdata import adapter_sources

AS_OF = "2024-06-01"
FACT = ("user_id long, loan_id long, installment_number int, vendor_id string, subfamily string, repaid_date date, due_date date, "
        "due_principal decimal(18,2), due_interest decimal(18,2), due_amount decimal(18,2), paid_principal decimal(18,2), "
        "paid_interest decimal(18,2), paid_amount decimal(18,2), outstanding_balance decimal(18,2), dpd int")


def _sources(spark):
    """Two employer users, one consumer, a deleted payment, a repeated schedule
    key in the payments, a payment without a schedule key."""
    return Sources({
        "users": spark.sql("select * from values (1L, 'employer', null), (2L, 'consumer', null), (3L, 'employer', null) as t(id, product_type, is_delete)"),
        "payment_responses": spark.sql("select * from values (10L, 1L), (20L, 2L), (30L, 3L) as t(id, tendopay_user_id)"),
        "repayment_schedules": spark.sql("""select id, loan as payment_response_id, date(due) as due_date, cast(99 as decimal(18,2)) as principal,
            cast(1 as decimal(18,2)) as interest, cast(100 as decimal(18,2)) as amount, cast(bal as decimal(18,2)) as outstanding_balance, gone as is_delete
            from values (101L, 10L, '2024-01-31', 200, null), (102L, 10L, '2024-02-29', 100, null), (103L, 10L, '2024-03-31', 0, 1),
            (201L, 20L, '2024-01-31', 0, null), (301L, 30L, '2024-01-31', 0, null) as t(id, loan, due, bal, gone)"""),
        "split_purchases": spark.sql("""select key as repayment_schedule_id, txn as txnid, cast(paid as decimal(18,2)) as principal,
            cast(0 as decimal(18,2)) as interest, cast(paid as decimal(18,2)) as amount, date(at) as repaid_date, gone as is_delete
            from values ('101', 'a', 60, '2024-02-01', null), ('101', 'b', 40, '2024-02-05', 1), ('102', 'c', 50, '2024-03-10', null),
            ('201', 'a', 100, '2024-01-31', null), ('301', 'z', 100, '2024-01-31', null), (null, 'a', 5, '2024-01-01', null),
            ('103', 'a', 100, '2024-03-31', null), ('101', 'a', 1, '2024-07-01', null) as t(key, txn, paid, at, gone)"""),
        "customer_repayment_responses": spark.sql("select * from values ('a', 'TPSD', 's'), ('b', 'TPFP', 's'), ('c', null, 't') as t(txn_id, vendor_id, subfamily)"),
    })


@pytest.mark.parametrize("spread", [False, True])
def test_fact_counts_deleted_and_late_payments_in_the_roll_up(spark, spread):
    got = rp.repayment_fact(_sources(spark), AS_OF, spread=spread)
    assert got.columns == FACT_COLUMNS
    rows = sorted((r.loan_id, r.installment_number, str(r.repaid_date), r.vendor_id, r.dpd) for r in got.collect())
    # 101: 60 + 40 deleted + 1 after the date make it paid, by 2024-07-01; 102 stays short
    assert rows == [(10, 1, "2024-02-01", "TPSD", 152), (10, 2, "2024-03-10", None, 93)]


def test_fact_of_some_columns(spark):
    names = pr.FACT_INPUT_COLUMNS
    some = rp.repayment_fact(_sources(spark), AS_OF, columns=names)
    assert some.columns == names
    assert sorted(map(str, some.collect())) == sorted(map(str, rp.repayment_fact(_sources(spark), AS_OF).select(*names).collect()))


def _fact(spark, n=60):
    day = dt.date(2024, 1, 1)
    rows = [(i % 3, i % 5, 1 + i % 4 if i % 11 else None, ["TPSD", "TPFP", None][i % 3], "s", day + dt.timedelta(days=i % 9), day + dt.timedelta(days=30 * (i % 4)),
             *[i % 7] * 3, i % 6 if i % 10 else None, 0, i, 500 - i, i) for i in range(n)]
    return spark.createDataFrame([tuple(r) for r in rows], FACT.replace("decimal(18,2)", "int")).select(
        *[F.col(c).cast("decimal(18,2)") if "principal" in c or "amount" in c or "interest" in c or "balance" in c else F.col(c) for c in FACT_COLUMNS])


def _shuffles(df) -> int:
    """Shuffles that a plan runs once its equal ones are shared."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.splitlines())


def test_balance_before_deals_the_rows_once(spark, tmp_path):
    """The rows once, not once more for their days, nor again to meet them."""
    _fact(spark).write.parquet(str(tmp_path / "fact"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(rp.with_balance_before(spark.read.parquet(str(tmp_path / "fact")))) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_pass_gives_balances_and_next_vendor(spark):
    """The rows that the two separate passes give, ties by whole row aside."""
    rows = _fact(spark).withColumn("ln_original_principal", F.lit(1000).cast("decimal(18,2)"))
    both = rp.balances_of_split(rp.split_by_day(rows), FACT_COLUMNS, next_vendor=True)
    apart = rp.balances_of_split(rp.split_by_day(rows), FACT_COLUMNS)
    nxt = rp.with_next_vendor(rows)
    assert sorted(map(str, both.drop("next_vendor").collect())) == sorted(map(str, apart.collect()))
    key = ["loan_id", "repaid_date", "installment_number", "due_date", "vendor_id", "next_vendor"]
    assert sorted(map(str, both.select(*key).collect())) == sorted(map(str, nxt.select(*key).collect()))


@pytest.mark.parametrize("name", ["leave_labels", "tpfp_labels", "tpfp_labels_spread"])
def test_labels_read_a_written_base(spark, name):
    """Both branches of a label query read the anchored payments, not their making."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    leaves = [line for line in plan.splitlines() if "Relation [" in line]
    assert leaves and all("obs_end" in line for line in leaves)


def _loans(spark):
    """Payments with principal, some without a loan."""
    rows = _fact(spark).withColumn("ln_original_principal", F.lit(1000).cast("decimal(18,2)"))
    return rows.unionByName(rows.limit(3).withColumn("loan_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("least, named", [(5, 5), (1000, 0)])
def test_loans_in_one_window_equal_loans_by_day(spark, least, named):
    rows = _loans(spark)
    heavy = rl.heavy_keys(rows, "loan_id", least)
    assert heavy.count() == named
    whole = rp.balances_of_split(rp.split_by_day(rows), FACT_COLUMNS, next_vendor=True)
    got = rp.loan_balances(rows, FACT_COLUMNS, heavy, next_vendor=True)
    assert got.schema.simpleString() == whole.schema.simpleString()
    assert got.count() == 60 and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_heavy_and_light_loans_meet(spark):
    rows = _loans(spark)
    some = spark.createDataFrame([(1,), (3,)], "loan_id long")
    whole = rp.balances_of_split(rp.split_by_day(rows), FACT_COLUMNS, next_vendor=True)
    assert sorted(map(str, rp.loan_balances(rows, FACT_COLUMNS, some, next_vendor=True).collect())) == sorted(map(str, whole.collect()))


def test_balances_of_light_loans_take_one_shuffle(spark, tmp_path):
    _loans(spark).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert _shuffles(rp.loan_balances(rows, FACT_COLUMNS, rl.heavy_keys(rows, "loan_id"), next_vendor=True)) == 1


def test_fact_ranks_of_a_written_fact(spark, tmp_path):
    apart = rp.repayment_fact(_sources(spark), AS_OF)
    written = rp.repayment_fact(_sources(spark), AS_OF, stage=str(tmp_path / "rows"))
    assert written.schema.simpleString() == apart.schema.simpleString()
    assert sorted(map(str, written.collect())) == sorted(map(str, apart.collect()))


@pytest.mark.parametrize("name, key", [("repayment_schedules", "payment_response_id"), ("customer_repayment_responses", "txn_id")])
def test_lending_tables_come_dealt_by_their_key(spark, name, key):
    """What groups a schedule by loan, or joins a response by transaction, shuffles no second time."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        table = adapter_sources(spark, "/root/testdata/sf0.001").table(name)
        assert _shuffles(table.groupBy(key).count()) <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_task_sizes_are_bounded_unless_the_session_says(spark):
    size, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    mine = spark.newSession()
    bounded_tasks(mine)
    assert mine.conf.get(size) == "16m" and int(mine.conf.get(number)) == 4 * int(mine.conf.get("spark.sql.shuffle.partitions"))
    own = spark.newSession()
    own.conf.set(size, "8m")
    bounded_tasks(own)
    assert own.conf.get(size) == "8m" and own.conf.get(number, None) is None
