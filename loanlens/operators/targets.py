"""User-level targets from salary-deduction (TPSD) and after-leave (TPFP) activity.

Everything is keyed by user id and built from aggregations that combine
map-side plus joins against one-row-per-user frames, so a user with a third
of all payments never lands whole in one task:
  anchor      max(struct(repaid, due, balance > threshold)) per user: the
              newest TPSD row and its peers in one partial aggregate
  tpfp branch per (user, loan) then per user aggregates; window slice by a
              join against the per-user performance window
  leave       anti join against TPFP-in-observation users; per-user max
Dates compare as timestamp_ntz: resignation and freeze dates carry a time of
day, and month arithmetic keeps it (end of month clamps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from pyspark.sql.types import DoubleType, FloatType, StringType

from loanlens.functions.exprs import add_months, flag, is_other_vendor, month_floor_prev, nan_to_null, parse_number
from loanlens.operators.relational import in_keys, not_in_keys, same_id, slice_buckets, slice_window, typed_time
from loanlens.plans.stages import handoff
from loanlens.sources.catalog import require

TARGET_COLUMNS = [
    "user_id", "target", "target_type", "last_tpsd_date", "obs_end", "perf_start_date", "perf_end_date",
    "ee_resignation_date_correct", "target_maturity_flag", "obs_incomplete_flag", "target_maturity_flag_for_dev",
]
BASE_COLUMNS = [
    "user_id", "loan_id", "installment_number", "vendor_id", "repaid_date", "due_date", "osbal_after",
    "ee_resignation_date_correct", "last_tpsd_date", "obs_end", "future_flag",
]


def _ts_lit(value):
    return F.lit(str(value)).cast("timestamp_ntz")


def attach_resignation(repayments: DataFrame, employees: DataFrame) -> DataFrame:
    """Repayment rows (dates as timestamps) with the user's resignation date: the
    latest one where a user has several employee rows."""
    dim = employees.groupBy("ee_customer_id").agg(
        F.max(typed_time(employees, "ee_resignation_date_correct")).alias("ee_resignation_date_correct")
    )
    bal = F.col("osbal_after")
    if isinstance(repayments.schema["osbal_after"].dataType, StringType):
        bal = nan_to_null(parse_number(bal))
    elif isinstance(repayments.schema["osbal_after"].dataType, (FloatType, DoubleType)):
        bal = nan_to_null(bal)  # NaN balance = missing, as pandas compares it
    rep = repayments.select(
        "user_id", "loan_id", "installment_number", "vendor_id",
        typed_time(repayments, "repaid_date").alias("repaid_date"), typed_time(repayments, "due_date").alias("due_date"),
        bal.alias("osbal_after"),
    )
    return rep.join(dim, same_id(rep, "user_id", dim, "ee_customer_id"), "left").drop("ee_customer_id")


def tpsd_anchor(rep: DataFrame, balance_threshold: float, obs_window: int, current_date) -> DataFrame:
    """Per resigned user: the newest TPSD payment (repaid desc, due desc, with
    peers); kept if any peer has balance > threshold. obs_end = anchor +
    obs_window months; future_flag = obs_end after current_date."""
    tpsd = rep.where(F.col("ee_resignation_date_correct").isNotNull() & (F.col("vendor_id") == K.VENDOR_SALARY))
    top = tpsd.groupBy("user_id").agg(
        F.max(F.struct("repaid_date", "due_date", (F.col("osbal_after") > F.lit(balance_threshold)).alias("ok"))).alias("top"),
        F.max("ee_resignation_date_correct").alias("ee_resignation_date_correct"),
    )
    kept = top.where(F.col("top.ok") & F.col("top.repaid_date").isNotNull())
    last = F.col("top.repaid_date")
    return kept.select(
        "user_id",
        last.alias("last_tpsd_date"),
        add_months(last, obs_window).alias("obs_end"),
        flag(add_months(last, obs_window) > _ts_lit(current_date)).alias("future_flag"),
        "ee_resignation_date_correct",
    )


def target_base(rep: DataFrame, anchor: DataFrame) -> DataFrame:
    """All of an anchored user's payments on or after the anchor date."""
    a = anchor.select("user_id", "last_tpsd_date", "obs_end", "future_flag")
    joined = rep.join(a, "user_id").where(F.col("repaid_date") >= F.col("last_tpsd_date"))
    return joined.select(*BASE_COLUMNS)


def tpfp_in_observation(base: DataFrame) -> DataFrame:
    """Users with a TPFP payment up to the end of observation."""
    hit = base.where((F.col("repaid_date") <= F.col("obs_end")) & (F.col("vendor_id") == K.VENDOR_AFTER_LEAVE))
    return hit.select("user_id").distinct()


def _label(rows: DataFrame, current_date) -> DataFrame:
    closed = F.col("perf_end_date") <= _ts_lit(current_date)
    mature = flag(~((F.col("row_target") == 0) & ~closed))
    return rows.withColumn("row_mature", mature).groupBy("user_id").agg(
        F.max("row_target").alias("target"),
        F.max("last_tpsd_date").alias("last_tpsd_date"),
        F.max("row_mature").alias("target_maturity_flag"),
        F.max("perf_start_date").alias("perf_start_date"),
        F.max("perf_end_date").alias("perf_end_date"),
    )


def tpfp_labels(base: DataFrame, balance_threshold: float, current_date,
                perf_months: int = K.DEFAULT_PERF_WINDOW_MONTHS, spread: bool = False) -> DataFrame:
    """Users with TPFP in observation and a non-repaid TPFP loan (min balance >
    threshold). Window: least(min repaid, max due) .. greatest(...) + 2 months
    over the TPFP rows of those loans; target = any other vendor inside.
    `spread` deals a user's payments by time bucket to meet its window."""
    tp = base.where(F.col("vendor_id") == K.VENDOR_AFTER_LEAVE)
    per_loan = tp.groupBy("user_id", "loan_id").agg(
        F.min("osbal_after").alias("min_osbal"),
        F.min("repaid_date").alias("min_repaid"),
        F.max("due_date").alias("max_due"),
        F.max(flag(F.col("repaid_date") <= F.col("obs_end"))).alias("in_obs"),
    )
    open_loan = F.col("min_osbal") > F.lit(balance_threshold)
    per_user = per_loan.groupBy("user_id").agg(
        F.max("in_obs").alias("in_obs"),
        F.max(flag(open_loan)).alias("has_open"),
        F.min(F.when(open_loan, F.col("min_repaid"))).alias("r"),
        F.max(F.when(open_loan, F.col("max_due"))).alias("d"),
    )
    perf = per_user.where((F.col("in_obs") == 1) & (F.col("has_open") == 1)).select(
        "user_id",
        F.least("r", "d").alias("perf_start_date"),
        add_months(F.greatest("r", "d"), perf_months).alias("perf_end_date"),
    )
    cut = slice_buckets if spread else slice_window
    span = cut(base, perf, "user_id", "repaid_date", "perf_start_date", "perf_end_date")
    rows = span.select("user_id", "last_tpsd_date", "perf_start_date", "perf_end_date",
                       flag(is_other_vendor("vendor_id")).alias("row_target"))
    return _label(rows, current_date)


def leave_labels(base: DataFrame, current_date, perf_months: int = K.DEFAULT_PERF_WINDOW_MONTHS,
                 tpfp_users: DataFrame | None = None) -> DataFrame:
    """Users without TPFP in observation whose resignation lies in
    [month floor of (anchor - 1 month), obs_end]. Window: greatest(anchor,
    resignation) .. + 2 months; target = any other vendor inside; users with
    no row inside keep target 0."""
    tpfp_users = tpfp_in_observation(base) if tpfp_users is None else tpfp_users
    lv = not_in_keys(base, tpfp_users, "user_id")
    resign = F.col("ee_resignation_date_correct")
    lv = lv.where((resign <= F.col("obs_end")) & (resign >= month_floor_prev("last_tpsd_date")))
    start = F.greatest("last_tpsd_date", "ee_resignation_date_correct")
    lv = lv.select("*", start.alias("perf_start_date"), add_months(start, perf_months).alias("perf_end_date"))
    inside = (F.col("repaid_date") >= F.col("perf_start_date")) & (F.col("repaid_date") <= F.col("perf_end_date"))
    rows = lv.select("user_id", "last_tpsd_date", "perf_start_date", "perf_end_date",
                     flag(inside & is_other_vendor("vendor_id")).alias("row_target"))
    return _label(rows, current_date)


def user_targets(
    repayments: DataFrame,
    employees: DataFrame,
    *,
    obs_window: int = K.DEFAULT_OBS_WINDOW_MONTHS,
    current_date=K.DEFAULT_CURRENT_DATE,
    balance_threshold: float = K.DEFAULT_BALANCE_THRESHOLD,
    stage: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """One row per labelled user: tpfp or leave target, windows, maturity,
    observation-incomplete flag and the model-development maturity flag.

    The anchored base feeds both branches and the metadata; with `stage` it is
    written to that folder once and the branches read it instead of
    recomputing it. Dates may be text (`yyyy-MM-dd`, anything else raises) and
    balances too (not a number: missing); ids are compared as text where the two
    inputs have them in different types. `ordered` adds the
    source's final sort (user id as text, target type, target); a written
    table does not keep row order, so it is off by default.
    """
    require(repayments, ["user_id", "loan_id", "installment_number", "vendor_id", "repaid_date", "due_date",
                         "osbal_after"], "repayments")
    require(employees, ["ee_customer_id", "ee_resignation_date_correct"], "employees")
    rep = attach_resignation(repayments, employees)
    anchor = tpsd_anchor(rep, balance_threshold, obs_window, current_date)
    base = target_base(rep, anchor)
    if stage:
        base = handoff(base, stage)
    # user-level values, so distinct keeps one row per user
    meta = base.select("user_id", "future_flag", "ee_resignation_date_correct", "obs_end").distinct()
    tpfp_users = tpfp_in_observation(base)
    tpfp = tpfp_labels(base, balance_threshold, current_date).withColumn("target_type", F.lit("tpfp"))
    leave = leave_labels(base, current_date, tpfp_users=tpfp_users).withColumn("target_type", F.lit("leave"))
    labels = tpfp.unionByName(leave)
    out = labels.join(meta, "user_id", "left")
    dev = flag((F.col("target_maturity_flag") == 1) & ~((F.col("future_flag") == 1) & (F.col("target_type") == "leave")))
    result = out.select(
        "user_id", "target", "target_type", "last_tpsd_date", "obs_end", "perf_start_date", "perf_end_date",
        "ee_resignation_date_correct", "target_maturity_flag", F.col("future_flag").alias("obs_incomplete_flag"),
        dev.alias("target_maturity_flag_for_dev"),
    )
    if ordered:
        result = result.orderBy(F.col("user_id").cast("string"), "target_type", "target")
    return result
