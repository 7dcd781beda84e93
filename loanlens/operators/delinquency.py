"""Installment delinquency, default points and first-to-fourth payment defaults.

Plan shape (one shuffle per key change, none repeated):
  payments --(partial+final agg by schedule id)--> paid
  schedules LEFT JOIN paid on schedule id         (shuffle by schedule id)
  loans JOIN users on user id                     (shuffle by user id)
  ... JOIN on loan id                             (shuffle by loan id)
  RANK over loan, per-loan points and flags       (reuse the loan-id partitioning)
  customer flags: partial+final agg by user id
Windows run over one loan's schedules (bounded by the tenor), never over a
user or a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions.exprs import days_between, flag, max_if, min_if, month_label
from loanlens.operators.ordering import ranked_in
from loanlens.operators.relational import join_as_string
from loanlens.plans.stages import handoff
from loanlens.sources.catalog import Sources, lit_date


def paid_payments(src: Sources) -> DataFrame:
    """Per schedule: total paid and last repaid date over all payments
    (soft-deleted ones included, as in both source queries)."""
    p = src.table("split_purchases", "repayment_schedule_id", "amount", "repaid_date")
    return p.groupBy("repayment_schedule_id").agg(
        F.sum("amount").alias("amount"), F.max("repaid_date").alias("repaid_date")
    )


def beside_paid(payments: DataFrame) -> DataFrame:
    """Payments with the figures of `paid_payments` of their schedule beside them,
    as `pp_amount` and `pp_repaid_date`. The rows are dealt by schedule once, for
    the roll-up and for a join on the schedule. The window holds the payments of one
    schedule; where nothing bounds them, join `paid_payments`."""
    w = Window.partitionBy("repayment_schedule_id")
    return payments.where(F.col("repayment_schedule_id").isNotNull()).select(
        "*", F.sum("amount").over(w).alias("pp_amount"), F.max("repaid_date").over(w).alias("pp_repaid_date"))


def dpd(annuity, paid_amount, repaid_date, due_date, as_of_col):
    """Days past due of one schedule at `as_of`.

    fully paid -> last repaid - due; paid short -> as_of - due;
    unpaid and already due -> as_of - due; otherwise null.
    """
    return (
        F.when(repaid_date.isNotNull() & (annuity <= paid_amount), days_between(repaid_date, due_date))
        .when(repaid_date.isNotNull() & (annuity > paid_amount), days_between(as_of_col, due_date))
        .when(repaid_date.isNull() & (due_date < as_of_col), days_between(as_of_col, due_date))
    )


def _delinquency_frame(src: Sources, as_of, spread: bool = False) -> DataFrame:
    as_of_col = lit_date(as_of)
    loans = src.table(
        "payment_responses", "id", K.LOAN_USER_ID, "principal", "fee", "bir",
        K.LOAN_TERM, "created_at", "status", K.LOAN_DISPOSITION,
    ).where(
        (F.col(K.LOAN_DISPOSITION) == K.SUCCESS_DISPOSITION) & (F.col("status") == K.DISBURSED_STATUS)
    )
    users = src.table("users", "id", "product_type").select(
        F.col("id").alias("user_id"), "product_type"
    )
    sched = src.table("repayment_schedules", "id", "payment_response_id", "due_date", "amount", "outstanding_balance")
    paid = paid_payments(src).select(
        "repayment_schedule_id", F.col("amount").alias("pp_amount"), "repaid_date"
    )
    sched_paid = join_as_string(sched, "id", paid, "repayment_schedule_id", "left").select(
        F.col("payment_response_id").alias("loan_id"),
        "due_date",
        F.col("amount").alias("annuity"),
        "pp_amount",
        "repaid_date",
        "outstanding_balance",
    )
    loan_users = loans.join(users, loans[K.LOAN_USER_ID] == users["user_id"]).select(
        "user_id",
        "product_type",
        F.col("id").alias("loan_id"),
        "principal",
        "fee",
        "bir",
        F.col(K.LOAN_TERM).alias("term"),
        month_label("created_at").alias("mth"),
        F.col("created_at").cast("date").alias("loan_created_date"),
    )
    d = sched_paid.join(loan_users, "loan_id")
    if spread:
        d = ranked_in(handoff(d), ["loan_id"], ["due_date"], "installment_number", None)
    else:
        w = Window.partitionBy("loan_id").orderBy("due_date")
        d = d.withColumn("installment_number", F.rank().over(w))
    return d.select(
        "user_id", "product_type", "loan_id", "principal", "fee", "bir", "term", "mth", "due_date",
        "installment_number",
        "annuity", "pp_amount", "repaid_date", "outstanding_balance",
        flag(F.col("annuity") - F.col("pp_amount") > 0).alias("flag_part_payment"),
        dpd(F.col("annuity"), F.col("pp_amount"), F.col("repaid_date"), F.col("due_date"), as_of_col).alias("dpd"),
        "loan_created_date",
    )


DELINQUENCY_COLUMNS = [
    "user_id", "product_type", "loan_id", "principal", "fee", "bir", "term", "mth", "due_date",
    "installment_number", "annuity", "pp_amount", "repaid_date", "outstanding_balance",
    "flag_part_payment", "dpd",
]


def delinquency(src: Sources, as_of, spread: bool = False) -> DataFrame:
    """One row per schedule of every successful disbursed loan, with RANK
    installment number, part-payment flag and DPD at `as_of`.

    The rank is a window over a loan's schedules, which its tenor bounds; where
    nothing bounds them (one loan id with a large share of all rows), `spread`
    ranks by range partitions and offsets instead."""
    return _delinquency_frame(src, as_of, spread).select(*DELINQUENCY_COLUMNS)


def _level_name(level: int) -> str:
    return f"def{level}"


def _points_frame(d: DataFrame, as_of) -> DataFrame:
    as_of_col = lit_date(as_of)
    inst = F.col("installment_number")
    age = days_between(as_of_col, F.col("due_date"))
    aggs = [
        F.min(F.col("due_date").cast("date")).alias("min_loan_due_date"),
        F.max(inst).alias("max_installment_number"),
        F.avg("principal").alias("principal"),
        F.avg("annuity").alias("annuity"),
        min_if(inst == 1, "annuity").alias("first_outstanding_due_amount"),
    ]
    for k, name in enumerate(["first", "second", "third", "fourth"], start=1):
        aggs.append(min_if(inst == k, "outstanding_balance").alias(f"{name}_outstanding_balance"))
    for level in K.DPD_LEVELS:
        hit = F.col("dpd") > 0 if level == 0 else F.col("dpd") >= level
        aggs.append(min_if(hit, inst).alias(f"min_inst_{_level_name(level)}"))
    for level in K.DPD_LEVELS:
        aged = age > 0 if level == 0 else age >= level
        aggs.append(max_if(aged, inst).alias(f"obs_min_inst_{_level_name(level)}"))
    # loan attributes carried through the same aggregate (constant per loan),
    # so the flag steps need no second join back to the loans table
    aggs += [
        F.max("term").alias("term"),
        F.max("principal").alias("loan_principal"),
        F.min("loan_created_date").alias("loan_created_date"),
    ]
    return d.groupBy("user_id", "product_type", "loan_id").agg(*aggs)


POINTS_COLUMNS = [
    "user_id", "product_type", "loan_id", "min_loan_due_date", "max_installment_number", "principal",
    "annuity", "first_outstanding_due_amount", "first_outstanding_balance", "second_outstanding_balance",
    "third_outstanding_balance", "fourth_outstanding_balance",
] + [f"min_inst_{_level_name(v)}" for v in K.DPD_LEVELS] + [f"obs_min_inst_{_level_name(v)}" for v in K.DPD_LEVELS]


def loan_default_points(src: Sources, as_of) -> DataFrame:
    """Per loan: first due date, last installment, average principal/annuity,
    balances at installments 1-4, first installment reaching each DPD level,
    and last installment aged past each level at `as_of`."""
    return _points_frame(_delinquency_frame(src, as_of), as_of).select(*POINTS_COLUMNS)


_K_NAMES = {1: "fpd30", 2: "spd30", 3: "tpd30", 4: "fstfpd30"}
_BALANCE_AT = {1: "first", 2: "second", 3: "third", 4: "fourth"}


def _observed(k: int):
    return F.col("obs_min_inst_def30") >= k


def _default_at(k: int):
    return _observed(k) & (F.col("min_inst_def30") == k)


def _flags_from_points(p: DataFrame) -> DataFrame:
    cols = [F.col("loan_id"), F.col("min_loan_due_date")]
    for k in range(1, 5):
        name = _K_NAMES[k]
        cols.append(flag(_observed(k)).alias(f"obs_{name}"))
        cols.append(flag(_default_at(k)).alias(f"def_{name}"))
    for k in range(1, 5):
        name = _K_NAMES[k]
        cols.append(F.when(_observed(k), F.col("loan_principal")).otherwise(F.lit(0)).alias(f"obs_{name}_vol"))
        if k == 1:
            # a one-installment loan in default uses the due amount
            vol = (
                F.when(_default_at(1) & (F.col("term").cast("string") == "1"), F.col("first_outstanding_due_amount"))
                .when(_default_at(1), F.col("first_outstanding_balance"))
                .otherwise(F.lit(0))
            )
        else:
            vol = F.when(_default_at(k), F.col(f"{_BALANCE_AT[k]}_outstanding_balance")).otherwise(F.lit(0))
        cols.append(vol.alias(f"def_{name}_vol"))
    return p.select(*cols)


FLAG_COLUMNS = ["loan_id", "min_loan_due_date"] + [
    f"{kind}_{_K_NAMES[k]}" for k in range(1, 5) for kind in ("obs", "def")
] + [f"{kind}_{_K_NAMES[k]}_vol" for k in range(1, 5) for kind in ("obs", "def")]


def payment_default_flags(src: Sources, as_of) -> DataFrame:
    """Per loan: observed / defaulted at installment k = 1..4 (first 30+ DPD
    installment is exactly k) and the matching volumes."""
    p = _points_frame(_delinquency_frame(src, as_of), as_of)
    return _flags_from_points(p).select(*FLAG_COLUMNS)


def customer_default_flags(src: Sources, as_of) -> DataFrame:
    """Per user, cumulative flags (fpd, fspd, fstpd, fstfpd) and maturity of the
    first qualifying loan (60/90/120/150 days after its creation date)."""
    return _customer_flags(_points_frame(_delinquency_frame(src, as_of), as_of), as_of)


def default_flags(src: Sources, as_of) -> tuple[DataFrame, DataFrame]:
    """(payment_default_flags, customer_default_flags) from one points frame,
    so both share the delinquency shuffles."""
    p = _points_frame(_delinquency_frame(src, as_of), as_of)
    return _flags_from_points(p).select(*FLAG_COLUMNS), _customer_flags(p, as_of)


def _customer_flags(p: DataFrame, as_of) -> DataFrame:
    as_of_col = lit_date(as_of)
    per_user = p.groupBy("user_id").agg(
        F.min("loan_created_date").alias("first_loan_date"),
        *[F.sum(flag(_default_at(k))).alias(f"n_def{k}") for k in range(1, 5)],
    )
    age = days_between(as_of_col, F.col("first_loan_date"))
    cols = [F.col("user_id")]
    for name, days in K.CUSTOMER_MATURITY_DAYS.items():
        cols.append(flag(age >= days).alias(f"cl_matured_{name}_flag"))
    for upto, name in [(1, "fpd30"), (2, "fspd30"), (3, "fstpd30"), (4, "fstfpd30")]:
        any_def = None
        for k in range(1, upto + 1):
            c = F.col(f"n_def{k}") >= 1
            any_def = c if any_def is None else (any_def | c)
        cols.append(flag(any_def).alias(f"cl_{name}_flag"))
    return per_user.select(*cols)


def loan_flag_columns(flags: DataFrame, as_of):
    """Loan-grain cumulative default flags and maturity (30/60/90/120 days
    after the first due date) as columns over a `payment_default_flags` row.
    A loan without flags (no row) gets 0."""
    as_of_col = lit_date(as_of)
    d = {k: F.col(f"def_{_K_NAMES[k]}") == 1 for k in range(1, 5)}
    age = days_between(as_of_col, F.col("min_loan_due_date"))
    out = {
        "ln_fpd30_flag": flag(d[1]),
        "ln_fspd30_flag": flag(d[1] | d[2]),
        "ln_fstpd30_flag": flag(d[1] | d[2] | d[3]),
        "ln_fstfpd30_flag": flag(d[1] | d[2] | d[3] | d[4]),
        "ln_min_loan_due_date": F.col("min_loan_due_date"),
        "ln_os_principal_at_fpd30": F.col("def_fpd30_vol"),
        "ln_os_principal_at_fspd30": F.col("def_spd30_vol"),
        "ln_os_principal_at_fstpd30": F.col("def_tpd30_vol"),
        "ln_os_principal_at_fstfpd30": F.col("def_fstfpd30_vol"),
    }
    for name, days in K.LOAN_MATURITY_DAYS.items():
        out[f"ln_matured_{name}_flag"] = flag(age >= days)
    return out


def payment_channels(src: Sources) -> DataFrame:
    """Per loan: distinct payment vendors, sorted, joined by '|' (null if none)."""
    crs = src.table("customer_repayment_responses", "txn_id", "vendor_id")
    pay = src.table("split_purchases", "txnid", "repayment_schedule_id")
    sched = src.table("repayment_schedules", "id", "payment_response_id")
    loans = src.table("payment_responses", "id")
    pv = pay.join(crs, pay["txnid"] == crs["txn_id"]).select("repayment_schedule_id", "vendor_id")
    lv = join_as_string(sched, "id", pv, "repayment_schedule_id").select(
        F.col("payment_response_id").alias("loan_id"), "vendor_id"
    )
    lv = lv.join(loans.select(F.col("id").alias("loan_id")), "loan_id")
    vendors = F.array_sort(F.collect_set("vendor_id"))
    return lv.groupBy("loan_id").agg(
        F.when(F.size(vendors) > 0, F.array_join(vendors, "|")).alias("payment_channels")
    )
