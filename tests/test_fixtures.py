"""Hand-computed edge rows (FIXTURES.md section 4)."""

import datetime as dt
from decimal import Decimal

from loanlens.operators import apps as ap
from loanlens.operators import delinquency as dq
from loanlens.operators import prep as pr
from loanlens.operators import profile as pf
from loanlens.operators import targets as tg
from loanlens.sources import Sources
from tests.conftest import rows

D = dt.date
T = dt.datetime


def _loan_sources(spark):
    users = spark.createDataFrame([(1, "employer")], "id bigint, product_type string")
    loans = spark.createDataFrame(
        [(10, 1, Decimal("700.00"), Decimal("0"), Decimal("0"), 7, T(2025, 1, 1), "PTOK", "success")],
        "id bigint, tendopay_user_id bigint, principal decimal(18,2), fee decimal(18,2), bir decimal(18,2), "
        "tendopay_installments int, created_at timestamp_ntz, status string, tendopay_disposition string",
    )
    dues = [D(2025, 1, 31), D(2025, 2, 28), D(2025, 3, 31), D(2025, 4, 30), D(2025, 7, 31), D(2025, 7, 31),
            D(2025, 8, 31)]
    sched = spark.createDataFrame(
        [(100 + i, 10, d, Decimal("100.00"), Decimal(str(600 - 100 * i))) for i, d in enumerate(dues)],
        "id bigint, payment_response_id bigint, due_date date, amount decimal(18,2), outstanding_balance decimal(18,2)",
    )
    pays = spark.createDataFrame(
        [("100", Decimal("100"), D(2025, 1, 25)), ("101", Decimal("60"), D(2025, 2, 28)),
         ("101", Decimal("40"), D(2025, 4, 10)), ("102", Decimal("50"), D(2025, 3, 31))],
        "repayment_schedule_id string, amount decimal(18,2), repaid_date date",
    )
    return Sources({"users": users, "payment_responses": loans, "repayment_schedules": sched,
                    "split_purchases": pays})


def test_dpd_rank_and_part_payment(spark):
    d = rows(dq.delinquency(_loan_sources(spark), "2025-06-30"), "due_date")
    d.sort(key=lambda r: (r["due_date"], r["outstanding_balance"]))
    assert [r["dpd"] for r in d] == [-6, 41, 91, 61, None, None, None]
    assert [r["flag_part_payment"] for r in d] == [0, 0, 1, 0, 0, 0, 0]
    assert [r["installment_number"] for r in d] == [1, 2, 3, 4, 5, 5, 7]


def test_default_points_and_flags(spark):
    p = dq.loan_default_points(_loan_sources(spark), "2025-06-30").first()
    assert (p.min_inst_def0, p.min_inst_def10, p.min_inst_def30, p.min_inst_def60, p.min_inst_def90,
            p.min_inst_def180) == (2, 2, 2, 3, 3, None)
    assert p.obs_min_inst_def30 == 4
    f = dq.payment_default_flags(_loan_sources(spark), "2025-06-30").first()
    assert (f.obs_fpd30, f.obs_spd30, f.obs_tpd30, f.obs_fstfpd30) == (1, 1, 1, 1)
    assert (f.def_fpd30, f.def_spd30, f.def_tpd30, f.def_fstfpd30) == (0, 1, 0, 0)
    assert f.def_spd30_vol == Decimal("500.00")


def test_one_installment_loan_volume(spark):
    users = spark.createDataFrame([(1, "employer")], "id bigint, product_type string")
    loans = spark.createDataFrame(
        [(10, 1, Decimal("100"), Decimal("0"), Decimal("0"), 1, T(2025, 1, 1), "PTOK", "success")],
        "id bigint, tendopay_user_id bigint, principal decimal(18,2), fee decimal(18,2), bir decimal(18,2), "
        "tendopay_installments int, created_at timestamp_ntz, status string, tendopay_disposition string")
    sched = spark.createDataFrame([(100, 10, D(2025, 1, 31), Decimal("120"), Decimal("7"))],
                                  "id bigint, payment_response_id bigint, due_date date, amount decimal(18,2), "
                                  "outstanding_balance decimal(18,2)")
    pays = spark.createDataFrame([], "repayment_schedule_id string, amount decimal(18,2), repaid_date date")
    src = Sources({"users": users, "payment_responses": loans, "repayment_schedules": sched, "split_purchases": pays})
    f = dq.payment_default_flags(src, "2025-06-30").first()
    assert f.def_fpd30 == 1 and f.def_fpd30_vol == Decimal("120.00")


def test_running_balance_with_null_payment(spark):
    fact = spark.createDataFrame(
        [(1, 10, 1, "TPSD", D(2025, 1, 1), D(2025, 1, 1), Decimal("100")),
         (1, 10, 2, "TPSD", D(2025, 2, 1), D(2025, 2, 1), None),
         (1, 10, 3, "TPSD", D(2025, 3, 1), D(2025, 3, 1), Decimal("50"))],
        "user_id bigint, loan_id bigint, installment_number int, vendor_id string, repaid_date date, "
        "due_date date, paid_principal decimal(18,2)")
    emp = spark.createDataFrame([(10, Decimal("200"))], "ln_loan_id bigint, ln_original_principal decimal(18,2)")
    from loanlens.operators.repayments import with_outstanding_balance

    got = rows(with_outstanding_balance(fact, emp), "repaid_date")
    assert [r["osbal_after"] for r in got] == [Decimal("100.00"), None, Decimal("50.00")]
    assert [r["osbal_before"] for r in got] == [Decimal("200.00"), Decimal("100.00"), Decimal("200.00")]


def test_transition_resignation(spark):
    fact = spark.createDataFrame(
        [(1, 10, 1, "TPSD", D(2025, 1, 31)), (1, 10, 2, "TPFP", D(2025, 3, 15)),
         (2, 20, 1, "TPFP", D(2025, 1, 1)), (2, 20, 2, "TPSD", D(2025, 2, 1))],
        "user_id bigint, loan_id bigint, installment_number int, vendor_id string, repaid_date date")
    got = {r.user_id: r.resignation_date_fp_new for r in pr.transition_resignation(fact).collect()}
    assert got == {1: T(2025, 2, 28)}


def _rep(spark, data):
    return spark.createDataFrame(
        data,
        "user_id bigint, loan_id bigint, installment_number int, vendor_id string, repaid_date timestamp_ntz, "
        "due_date timestamp_ntz, osbal_after decimal(18,2), ee_resignation_date_correct timestamp_ntz")


def test_anchor_peers(spark):
    r = T(2025, 2, 1)
    keep = _rep(spark, [(1, 10, 1, "TPSD", T(2025, 1, 1), T(2025, 1, 1), Decimal("500"), r),
                        (1, 10, 2, "TPSD", T(2025, 2, 1), T(2025, 2, 1), Decimal("5"), r),
                        (1, 10, 2, "TPSD", T(2025, 2, 1), T(2025, 2, 1), Decimal("50"), r)])
    assert [a.user_id for a in tg.tpsd_anchor(keep, 10.0, 5, "2025-12-31").collect()] == [1]
    drop = _rep(spark, [(1, 10, 1, "TPSD", T(2025, 1, 1), T(2025, 1, 1), Decimal("500"), r),
                        (1, 10, 2, "TPSD", T(2025, 2, 1), T(2025, 2, 1), Decimal("5"), r),
                        (1, 10, 2, "TPSD", T(2025, 2, 1), T(2025, 2, 1), Decimal("5"), r)])
    assert tg.tpsd_anchor(drop, 10.0, 5, "2025-12-31").count() == 0


def _tpfp_rep(spark, tpfp_balances=("300", "200")):
    res = T(2025, 2, 15)
    return _rep(spark, [
        (1, 10, 1, "TPSD", T(2025, 2, 1), T(2025, 1, 31), Decimal("500"), res),
        (1, 20, 1, "TPFP", T(2025, 3, 1), T(2025, 2, 20), Decimal(tpfp_balances[0]), res),
        (1, 20, 2, "TPFP", T(2025, 4, 1), T(2025, 3, 31), Decimal(tpfp_balances[1]), res),
        (1, 20, 3, "OTHER", T(2025, 6, 1), T(2025, 4, 30), Decimal("100"), res),
    ])


def test_perf_window_follows_code(spark):
    rep = _tpfp_rep(spark)
    anchor = tg.tpsd_anchor(rep, 10.0, 5, "2025-05-31")
    base = tg.target_base(rep, anchor)
    got = tg.tpfp_labels(base, 10.0, "2025-05-31").first()
    assert (got.perf_start_date, got.perf_end_date, got.target) == (T(2025, 3, 1), T(2025, 5, 31), 0)
    assert got.target_maturity_flag == 1
    assert tg.tpfp_labels(base, 10.0, "2025-05-30").first().target_maturity_flag == 0


def test_all_tpfp_loans_repaid_gives_no_label(spark):
    rep = _tpfp_rep(spark, ("100", "5"))
    out = tg.user_targets(rep.drop("ee_resignation_date_correct"), _employees(spark, T(2025, 2, 15)),
                          current_date="2025-12-31")
    assert out.count() == 0


def _employees(spark, res):
    return spark.createDataFrame([(1, res)], "ee_customer_id bigint, ee_resignation_date_correct timestamp_ntz")


def _leave_rep(spark, res, extra=()):
    return _rep(spark, [(1, 10, 1, "TPSD", T(2025, 6, 15), T(2025, 6, 10), Decimal("500"), res), *extra])


def test_leave_bounds_and_window(spark):
    inside = tg.user_targets(_leave_rep(spark, T(2025, 5, 1)).drop("ee_resignation_date_correct"),
                             _employees(spark, T(2025, 5, 1)), current_date="2025-12-31")
    r = inside.first()
    assert (r.target_type, r.target, r.perf_start_date, r.perf_end_date) == ("leave", 0, T(2025, 6, 15),
                                                                            T(2025, 8, 15))
    outside = tg.user_targets(_leave_rep(spark, T(2025, 4, 30)).drop("ee_resignation_date_correct"),
                              _employees(spark, T(2025, 4, 30)), current_date="2025-12-31")
    assert outside.count() == 0


def test_leave_null_vendor_is_positive_and_dev_flag(spark):
    res = T(2025, 5, 1)
    rep = _leave_rep(spark, res, [(1, 10, 2, None, T(2025, 7, 1), T(2025, 7, 10), Decimal("400"), res)])
    r = tg.user_targets(rep.drop("ee_resignation_date_correct"), _employees(spark, res),
                        current_date="2025-09-01").first()
    assert r.target == 1 and r.obs_incomplete_flag == 1 and r.target_maturity_flag == 1
    assert r.target_maturity_flag_for_dev == 0


def test_asof_reference_then_cutoff(spark):
    refs = spark.createDataFrame(
        [(1, 7, "a", None, T(2025, 9, 1), T(2025, 9, 1)), (2, 7, "b", None, T(2025, 9, 9), T(2025, 9, 9)),
         (3, 7, "c", None, T(2025, 9, 12), T(2025, 9, 12))],
        "id bigint, user_id bigint, reference_number string, deleted_at timestamp_ntz, created_at timestamp_ntz, "
        "updated_at timestamp_ntz")
    cust = spark.createDataFrame([(7, T(2025, 9, 10))], "ee_customer_id bigint, ee_onboarding_date timestamp_ntz")
    src = Sources({"credo_lab_reference_numbers": refs})
    assert [r.id for r in ap.user_reference(src, cust, "2025-09-30").collect()] == [2]
    assert ap.user_reference(src, cust, "2025-09-05").count() == 0


def test_unnest_drops_null_and_empty(spark):
    apps = spark.createDataFrame(
        [("#1:a", D(2025, 1, 1), [("p1", None, None, "1", 0), ("p2", None, None, "1", 0)]),
         ("#1:b", D(2025, 1, 1), None), ("#1:c", D(2025, 1, 1), [])],
        "deviceId string, run_date date, Application array<struct<package_name:string, "
        "first_install_time:timestamp_ntz, last_update_time:timestamp_ntz, version_name:string, flags:bigint>>")
    out = ap.device_apps(Sources({"android_credolab_Application": apps}))
    assert sorted(r.package_name for r in out.collect()) == ["p1", "p2"]


def test_fraud_vs_frozen_deleted_tag(spark):
    tags = spark.createDataFrame([(1, 39, "x", T(2025, 1, 1), T(2025, 1, 1), T(2025, 2, 1))],
                                 "user_id bigint, tag_id int, tag_name string, created_at timestamp_ntz, "
                                 "updated_at timestamp_ntz, deleted_at timestamp_ntz")
    src = Sources({"user_tag": tags})
    assert pf.frozen_status(src).first().frozen_status == "Frozen"
    assert pf.fraud_status(src).first().customer_status == "Normal"
