"""Repayment transaction fact and balance columns.

Plan shape: schedules JOIN loans x users (loan id), so that only employer
users' schedules go on; payments are dealt by schedule id text once, for the
paid roll-up and for the rows, JOIN the schedules, then vendor responses (txn
id). The installment DENSE_RANK is computed on schedules, not payments. The
balance columns
(ROW_NUMBER, LAG, LEAD, running sum) split each loan's payments by repaid
day: per-row windows run inside one (loan, day) and one-row-per-day
summaries carry values across days, so no task holds a whole loan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.operators.delinquency import beside_paid, dpd, paid_payments
from loanlens.operators.ordering import position_in
from loanlens.operators.relational import heavy_keys, light_and_heavy, same_id
from loanlens.plans.stages import handoff
from loanlens.sources.catalog import Sources, active, lit_date, require

FACT_COLUMNS = [
    "user_id", "loan_id", "installment_number", "vendor_id", "subfamily", "repaid_date", "due_date",
    "due_principal", "due_interest", "due_amount", "paid_principal", "paid_interest", "paid_amount",
    "outstanding_balance", "dpd",
]

# deterministic order of payments inside an installment: the source orders
# by repaid and due date; the remaining fact columns break exact ties
PAYMENT_TIEBREAK = ["outstanding_balance", "paid_amount", "paid_principal", "paid_interest", "vendor_id", "subfamily"]


def repayment_fact(src: Sources, as_of, ordered: bool = False, stage: str | None = None, spread: bool = False,
                   columns: list[str] | None = None) -> DataFrame:
    """One row per live payment (paid before `as_of`) of employer users, with
    DENSE_RANK installment number, due and paid splits, vendor and DPD.

    Loans of any status; schedules without a payment are absent. `ordered`
    adds the source's final sort (user, loan, installment, repaid date); a
    written table does not keep row order, so it is off by default. The joined
    payments feed the ranks and the rows; with `stage` they are written to that
    folder once and both read it. `spread` ranks the due dates of a loan by range
    partitions and offsets and joins the paid roll-up, for loans whose due dates
    and schedules whose payments nothing bounds. `columns`
    are the fact columns the caller reads (default: all); the rows are the same.
    """
    names = list(columns) if columns is not None else FACT_COLUMNS
    as_of_col = lit_date(as_of)
    users = active(src.table("users", "id", "product_type", "is_delete")).where(
        F.col("product_type") == K.EMPLOYER_PRODUCT_TYPE
    ).select(F.col("id").alias("user_id"))
    loans = src.table("payment_responses", "id", K.LOAN_USER_ID).select(
        F.col("id").alias("loan_id"), F.col(K.LOAN_USER_ID).alias("user_id")
    )
    sched = active(src.table("repayment_schedules", "id", "payment_response_id", "due_date", "principal", "interest",
                             "amount", "outstanding_balance", "is_delete")).select(
        F.col("id").cast("string").alias("sched_key"),
        F.col("payment_response_id").alias("loan_id"),
        "due_date",
        F.col("principal").alias("due_principal"),
        F.col("interest").alias("due_interest"),
        F.col("amount").alias("due_amount"),
        "outstanding_balance",
    )
    payments = src.table("split_purchases", "repayment_schedule_id", "txnid", "principal", "interest", "amount",
                         "repaid_date", "is_delete")
    late = "dpd" in names  # the paid roll-up serves the DPD alone: every payment has one for its schedule
    if late and not spread:
        payments = beside_paid(payments)
    pay = active(payments).where(F.col("repaid_date").cast("date") < as_of_col).select(
        F.col("repayment_schedule_id").alias("sched_key"),
        "txnid",
        "repaid_date",
        F.col("principal").alias("paid_principal"),
        F.col("interest").alias("paid_interest"),
        F.col("amount").alias("paid_amount"),
        *(["pp_amount", "pp_repaid_date"] if late and not spread else []),
    )
    if late and spread:
        pay = pay.join(paid_payments(src).select(
            F.col("repayment_schedule_id").alias("sched_key"),
            F.col("amount").alias("pp_amount"),
            F.col("repaid_date").alias("pp_repaid_date"),
        ), "sched_key")
    crs = src.table("customer_repayment_responses", "txn_id", "vendor_id", "subfamily")
    days_late = dpd(F.col("due_amount"), F.col("pp_amount"), F.col("pp_repaid_date"), F.col("due_date"), as_of_col).alias("dpd")
    due = sched.join(loans.join(users, "user_id"), "loan_id")
    found = pay.join(due, "sched_key").select(
        "txnid", "user_id", "loan_id", "repaid_date", "due_date", "due_principal", "due_interest", "due_amount",
        "paid_principal", "paid_interest", "paid_amount", "outstanding_balance", *([days_late] if late else []))
    rows = found.join(crs, found["txnid"] == crs["txn_id"]).select(
        *dict.fromkeys(["loan_id", "due_date", *[c for c in names if c != "installment_number"]]))
    if stage:
        rows = handoff(rows, stage)
    # DENSE_RANK over a loan's distinct due dates with a surviving payment: one
    # row per (loan, due date), so the window holds a loan's schedules, not its
    # payments (bounded by its tenor, an input contract); the payments only pass
    # through a join, which AQE can split when a loan is hot. Written rows tell
    # which loans hold so many payments; those of the others meet in one window
    light = None
    if stage and not spread:
        light, rows = light_and_heavy(rows, heavy_keys(rows, "loan_id"), "loan_id")
    dates = rows.select("loan_id", "due_date").distinct()
    if spread:
        ranks = position_in(dates, ["loan_id"], ["due_date"], "_at").select("loan_id", "due_date", (F.col("_at") + 1).cast("int").alias("installment_number"))
    else:
        w = Window.partitionBy("loan_id").orderBy("due_date")
        ranks = dates.select("*", F.row_number().over(w).alias("installment_number"))
    ranks = ranks.select(F.col("loan_id").alias("_loan"), F.col("due_date").alias("_due"), "installment_number")
    fact = rows.join(ranks, (rows["loan_id"] == ranks["_loan"]) & rows["due_date"].eqNullSafe(ranks["_due"])).select(*names)
    if light is not None:
        place = F.dense_rank().over(Window.partitionBy("loan_id").orderBy("due_date"))
        fact = light.withColumn("installment_number", place).select(*names).unionByName(fact)
    if ordered:
        fact = fact.orderBy("user_id", "loan_id", "installment_number", "repaid_date")
    return fact


def with_balance_before(fact: DataFrame) -> DataFrame:
    """Add payment_seq, prev_installment_balance and outstanding_before.

    First payment of an installment: the previous installment's balance, else
    balance + paid amount; later payments: the previous payment's balance.
    Payments of a loan are split by repaid day like `with_outstanding_balance`:
    per-row windows run inside one (installment, day); one-row-per-day
    summaries carry the sequence offset and the previous balance across days.
    """
    order = ["repaid_date", "due_date"] + PAYMENT_TIEBREAK
    day = F.coalesce(F.col("repaid_date").cast("date"), F.lit(FIRST_DAY).cast("date"))
    bucket = ["user_id", "loan_id", "installment_number", "_day"]
    split = fact.withColumn("_day", day).repartition(*bucket)
    in_bucket = Window.partitionBy(*bucket).orderBy(*order)
    rows = split.select("*", F.row_number().over(in_bucket).alias("_rn"),
                        F.lag("outstanding_balance").over(in_bucket).alias("_lag"))
    # ascending with nulls first, as the window orders: max(struct) is the last
    # row; taken whole, so that days and rows read the same columns of one shuffle
    last = F.max(F.struct(*order, *[c for c in fact.columns if c not in {*order, *bucket}])).alias("_last")
    days = split.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), last).select(
        *bucket, "_n", F.col("_last.outstanding_balance").alias("_balance"))
    in_inst = Window.partitionBy("user_id", "loan_id", "installment_number").orderBy("_day")
    in_loan = Window.partitionBy("user_id", "loan_id").orderBy("installment_number", "_day")
    # by loan first: the windows of its installments then need no shuffle of their own
    days = days.select("*", F.lag("_balance").over(in_loan).alias("_prev_loan_day")).select(
        *bucket,
        F.coalesce(F.sum("_n").over(in_inst.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.lag("_balance").over(in_inst).alias("_prev_inst_day"),
        "_prev_loan_day",
    )
    out = rows.join(days, bucket)
    first_in_day = F.col("_rn") == 1
    seq = (F.col("_offset") + F.col("_rn")).cast("int")
    prev_inst = F.when(first_in_day, F.col("_prev_loan_day")).otherwise(F.col("_lag"))
    prev_row = F.when(first_in_day, F.col("_prev_inst_day")).otherwise(F.col("_lag"))
    out = out.select(*fact.columns, seq.alias("payment_seq"), prev_inst.alias("prev_installment_balance"),
                     prev_row.alias("_prev_in_inst"))
    before = F.when(
        F.col("payment_seq") == 1,
        F.coalesce(F.col("prev_installment_balance"), F.col("outstanding_balance") + F.col("paid_amount")),
    ).otherwise(F.col("_prev_in_inst"))
    return out.select(*fact.columns, "payment_seq", "prev_installment_balance", before.alias("outstanding_before"))


# pandas-style per-loan order: repaid date, installment (missing last), then
# the remaining fact columns so exact ties cannot change a running total
LOAN_ORDER_KEYS = ["repaid_date", "installment_number", "due_date", "vendor_id", "paid_principal"]
NO_DAY = "9999-12-31"  # bucket for payments without a repaid date (sorted last)
FIRST_DAY = "0001-01-01"  # same, where missing dates sort first


def loan_order(cols: list[str]):
    return [F.col(k).asc_nulls_last() for k in LOAN_ORDER_KEYS if k in cols]


def _order_struct(cols: list[str]):
    """Struct whose max is the last row (and min the first) in `loan_order`."""
    fields = []
    for k in LOAN_ORDER_KEYS:
        if k in cols:
            fields += [F.col(k).isNull().alias(f"{k}_missing"), F.col(k).alias(k)]
    return fields


def split_by_day(rows: DataFrame) -> DataFrame:
    """Add `_day` (repaid day; missing days last) and spread each loan's rows
    over (loan, day). Repaid date leads the loan order, so a loan's order is
    its days in turn: per-row windows run inside one (loan, day) and only
    per-day summaries run over a whole loan (one row per day), so a loan with
    a third of all payments is still split over its days."""
    day = F.coalesce(F.col("repaid_date").cast("date"), F.lit(NO_DAY).cast("date"))
    return rows.withColumn("_day", day).repartition("loan_id", "_day")


def with_outstanding_balance(fact: DataFrame, employees: DataFrame) -> DataFrame:
    """Outstanding principal after each payment of a loan.

    principal comes from the employee frame (loans of other users get null);
    cumulative_paid_principal is a running sum in loan order where a missing
    payment gives null on its own row and is skipped afterwards;
    osbal_before is the previous row's osbal_after, else the principal.
    """
    require(fact, ["loan_id", "repaid_date", "installment_number", "paid_principal"], "repayment fact")
    require(employees, ["ln_loan_id", "ln_original_principal"], "employee frame")
    return balances_of_split(split_by_day(with_principal(fact, employees)), fact.columns)


def with_principal(fact: DataFrame, employees: DataFrame) -> DataFrame:
    """Fact rows with the loan principal of the employee frame (else null)."""
    principal = employees.select(
        F.col("ln_loan_id").alias("loan_id"), F.col("ln_original_principal")
    ).distinct()
    principal = principal.withColumnRenamed("loan_id", "_loan")
    return fact.join(principal, same_id(fact, "loan_id", principal, "_loan"), "left").drop("_loan")


def balances_of_split(rows: DataFrame, fact_columns: list[str], next_vendor: bool = False) -> DataFrame:
    """Running balance columns over rows already split by `split_by_day`; with
    `next_vendor` also that column, from the same days and windows."""
    paid = F.col("paid_principal")
    # per day: total paid, and whether the day's last row has a payment; that row
    # is taken whole, so that days and rows read the same columns of one shuffle
    rest = [c for c in rows.columns if c not in {*LOAN_ORDER_KEYS, "loan_id", "_day"}]
    last = F.max(F.struct(*_order_struct(rows.columns), paid.isNull().alias("_none"), *rest))
    first = F.min(F.struct(*_order_struct(rows.columns), F.col("vendor_id").alias("_vendor"))).alias("_first") if next_vendor else None
    days = rows.groupBy("loan_id", "_day").agg(F.sum(paid).alias("_tot"), last.alias("_last"), *([first] if next_vendor else []))
    # only what the windows read goes to them
    days = days.select("loan_id", "_day", "_tot", F.col("_last._none").alias("_none"),
                       *([F.col("_first._vendor").alias("_vendor")] if next_vendor else []))
    over_days = Window.partitionBy("loan_id").orderBy("_day")
    days = days.select(
        "*",
        F.coalesce(F.sum("_tot").over(over_days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_tot").over(over_days.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_end"),
    )
    days = days.select(
        "loan_id", "_day", "_offset",
        F.lag(F.when(~F.col("_none"), F.col("_end"))).over(over_days).alias("_prev_end"),
        *([F.lead("_vendor").over(over_days).alias("_next_day_vendor")] if next_vendor else []),
    )
    in_day = Window.partitionBy("loan_id", "_day").orderBy(*loan_order(rows.columns))
    local = F.sum(paid).over(in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.join(days, ["loan_id", "_day"]).select(
        "*",
        F.when(paid.isNotNull(), F.col("_offset") + local).alias("cumulative_paid_principal"),
        F.row_number().over(in_day).alias("_rn"),
        *([_next_in_day(in_day).alias("next_vendor")] if next_vendor else []),
    )
    out = out.withColumn("osbal_after", F.col("ln_original_principal") - F.col("cumulative_paid_principal"))
    first_before = F.col("ln_original_principal") - F.col("_prev_end")
    before = F.when(F.col("_rn") == 1, first_before).otherwise(F.lag("osbal_after").over(in_day))
    return out.select(
        *fact_columns, "ln_original_principal", "cumulative_paid_principal", "osbal_after",
        F.coalesce(before, F.col("ln_original_principal")).alias("osbal_before"),
        *(["next_vendor"] if next_vendor else []),
    )


def loan_balances(rows: DataFrame, fact_columns: list[str], heavy: DataFrame, next_vendor: bool = False) -> DataFrame:
    """`balances_of_split` for rows of `with_principal`: a loan's payments meet in
    one window, except those of the `heavy` loans (`heavy_keys`), which are split
    by day. Payments without a loan are left out, as there."""
    light, split = light_and_heavy(rows, heavy, "loan_id")
    order = Window.partitionBy("loan_id").orderBy(*loan_order(rows.columns))
    paid = F.col("paid_principal")
    total = F.sum(paid).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    light = light.where(F.col("loan_id").isNotNull()).select(
        "*", F.when(paid.isNotNull(), total).alias("cumulative_paid_principal"),
        *([F.lead("vendor_id").over(order).alias("next_vendor")] if next_vendor else []),
    ).withColumn("osbal_after", F.col("ln_original_principal") - F.col("cumulative_paid_principal"))
    light = light.select(
        *fact_columns, "ln_original_principal", "cumulative_paid_principal", "osbal_after",
        F.coalesce(F.lag("osbal_after").over(order), F.col("ln_original_principal")).alias("osbal_before"),
        *(["next_vendor"] if next_vendor else []),
    )
    return light.unionByName(balances_of_split(split_by_day(split), fact_columns, next_vendor))


def _next_in_day(in_day):
    """The next row's vendor; of a day's last row that of the next day."""
    is_last = F.lead(F.lit(1)).over(in_day).isNull()
    return F.when(is_last, F.col("_next_day_vendor")).otherwise(F.lead("vendor_id").over(in_day))


def with_next_vendor(repayments: DataFrame) -> DataFrame:
    """Add `next_vendor`: the vendor of the next payment of the loan in loan
    order (null for the last), split by day like `with_outstanding_balance`."""
    return next_vendor_of_split(split_by_day(repayments), repayments.columns)


def next_vendor_of_split(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`next_vendor` over rows already split by `split_by_day`."""
    first = F.min(F.struct(*_order_struct(rows.columns), F.col("vendor_id").alias("_vendor")))
    days = rows.groupBy("loan_id", "_day").agg(first.alias("_first"))
    over_days = Window.partitionBy("loan_id").orderBy("_day")
    days = days.select("loan_id", "_day", F.lead(F.col("_first._vendor")).over(over_days).alias("_next_day_vendor"))
    in_day = Window.partitionBy("loan_id", "_day").orderBy(*loan_order(rows.columns))
    out = rows.join(days, ["loan_id", "_day"])
    return out.select(*columns, _next_in_day(in_day).alias("next_vendor"))
