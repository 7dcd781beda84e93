"""Query registry: one entry per operator, run on the test-data adapter.

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole
tables at `sf_dir`. Parameters are the fixed test parameters below; the same
values appear in the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loanlens.operators import apps as ap
from loanlens.functions import constants as K
from loanlens.operators import delinquency as dq
from loanlens.operators import prep as pr
from loanlens.operators import profile as pf
from loanlens.operators import quality as ql
from loanlens.operators import repayments as rp
from loanlens.operators import targets as tg
from loanlens.operators import scoring as sc
from loanlens.operators import sketches as sk
from loanlens.operators.relational import latest_by
from loanlens.plans.features import bucket_inputs, loan_features
from loanlens.plans.oracle_sql import APP_CUTOFF, AS_OF, FEATURE_TARGET, MERGED_DECIMALS, MERGED_EXACT, OBS_MONTHS, REPORT_DECIMALS, REPORT_TARGET, THRESHOLD
from loanlens.plans.output import edge
from loanlens.plans.stages import handoff
from loanlens.session import bounded_tasks, checkpoint_dir, fast_planning
from loanlens.sources import io as lio
from loanlens.sources.catalog import active
from loanlens.sources.testdata import adapter_sources

Query = Callable[[SparkSession, str], DataFrame]


_SOURCES: dict[str, tuple[SparkSession, object]] = {}


def _sources(spark: SparkSession, sf_dir: str):
    """Adapter sources per (session, folder). Only the lazy DataFrame plans are
    kept (nothing is cached in memory), so later queries skip re-parsing and
    re-analysing the ~30 adapter statements."""
    key = sf_dir.rstrip("/")
    hit = _SOURCES.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, adapter_sources(spark, key))
        _SOURCES[key] = hit
    return hit[1]


def _q(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fast_planning(spark)
        bounded_tasks(spark)
        return edge(fn(_sources(spark, sf_dir)))

    return run


def _raw(fn) -> Query:
    """Like _q, but the operator's output types are kept (no decimal edge)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fast_planning(spark)
        bounded_tasks(spark)
        return fn(_sources(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _inputs(s, stage: str | None = None):
    """Feature table and repayment fact (the columns prep reads) handed to
    prep as written tables, as in the source pipeline."""
    features = handoff(loan_features(s, AS_OF).select(*pr.FEATURE_INPUT_COLUMNS))
    return pr.prepare_target_inputs(features, handoff(_fact(s, columns=pr.FACT_INPUT_COLUMNS)), stage)


def _stage(s) -> str:
    return f"{checkpoint_dir(s.table('users').sparkSession)}/stages/{uuid.uuid4().hex}"


def _fact(s, **kwargs):
    return rp.repayment_fact(s, AS_OF, stage=_stage(s), **kwargs)


def _anchor(s):
    employees, repayments = _inputs(s, _stage(s))
    rep = tg.attach_resignation(repayments, employees)
    return rep, tg.tpsd_anchor(rep, THRESHOLD, OBS_MONTHS, AS_OF)


def _base(s):
    """The anchored payments as a written table: the labels read them several times."""
    return handoff(tg.target_base(*_anchor(s)))


def _targets(s, **kwargs):
    employees, repayments = _inputs(s, _stage(s))
    return tg.user_targets(repayments, employees, obs_window=OBS_MONTHS, current_date=AS_OF,
                           balance_threshold=THRESHOLD, stage=_stage(s), **kwargs)


def _as_text(df, *typed):
    """A frame as a text file would hold it: ids, money and dates as strings,
    missing values as null tokens; `typed` columns stay."""
    return df.select(*[F.col(c) if c in typed else F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias(c) for c in df.columns])


def _positions(df, order):
    """`df` written in its source's final order with positions, and read back;
    the remaining columns break ties."""
    path = f"{checkpoint_dir(df.sparkSession)}/ordered/{uuid.uuid4().hex}"
    named = {c for c in order if isinstance(c, str)}
    return df.sparkSession.read.parquet(lio.write_ordered(df, [*order, *[c for c in df.columns if c not in named]], path))


def _text_inputs(s):
    """Employee frame of a feature table read as text (null tokens, lenient dates, numbers)."""
    features = loan_features(s, AS_OF).select(*pr.FEATURE_INPUT_COLUMNS)
    dated = features.withColumns({c: F.col(c).cast("date") for c in pr.FEATURE_INPUT_COLUMNS[4:]})
    frame = pr.employee_frame(_as_text(dated, "ee_product_type"))
    return frame.select("ee_customer_id", "ln_loan_id", "ln_original_principal", "ee_resignation_date_correct")


def _text_targets(s):
    """Targets from text inputs: strict dates, coerced balances, ids as text."""
    employees, repayments = _inputs(s, _stage(s))
    employees = handoff(employees)
    day = {c: F.col(c).cast("date").cast("string") for c in ("repaid_date", "due_date")}
    reps = repayments.withColumns({**day, "user_id": F.col("user_id").cast("string"), "osbal_after": F.col("osbal_after").cast("string")})
    out = tg.user_targets(reps, employees, obs_window=OBS_MONTHS, current_date=AS_OF, balance_threshold=THRESHOLD, stage=_stage(s))
    return out.withColumn("user_id", F.col("user_id").cast("bigint"))


def _exported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """Loan flags written as parquet and CSV under the shared checkpoint folder."""
    flags = QUERIES["payment_default_flags"](spark, sf_dir)
    manifest = lio.write_multi(flags, f"{checkpoint_dir(spark)}/roundtrip", f"/{uuid.uuid4().hex}", "payment_default_flags")
    if "error" in manifest:
        raise RuntimeError(manifest["error"])
    return flags, manifest


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lio.read_dataset(spark, _exported(spark, sf_dir)[1]["parquet"], "parquet")


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, manifest = _exported(spark, sf_dir)
    return lio.read_dataset(spark, manifest["csv"], "csv", schema=flags.schema)


def _csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as CSV and back: texts with quotes, line breaks, blanks
    around them, empty and null ones."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    kind = F.col("doc_id") % 7
    texts = docs.select(
        "doc_id", "text", F.concat(F.lit('say "'), "source", F.lit('", "ok"\n')).alias("quoted"),
        F.when(kind == 0, F.lit("")).when(kind != 1, F.concat(F.lit(" "), "lang", F.lit("\r\n "))).alias("padded"), F.col("n_chars").alias("chars"))
    path = lio.write_dataset(texts, f"{checkpoint_dir(spark)}/roundtrip/{uuid.uuid4().hex}", "csv")
    return lio.read_dataset(spark, path, "csv", schema=texts.schema)


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan flags as a date-suffixed table, replaced by a second write."""
    flags = handoff(QUERIES["payment_default_flags"](spark, sf_dir))
    lio.replace_table(flags.limit(1), "default", "loan_flags", AS_OF)  # replaced by the next line
    return spark.table(lio.replace_table(flags, "default", "loan_flags", AS_OF))


def _bucketed_features(s):
    """The feature table from user-keyed inputs written in buckets."""
    spark = s.table("users").sparkSession
    schema = f"features_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    return loan_features(s, AS_OF, bucketed=bucket_inputs(s, AS_OF, schema, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _report_features(s):
    return ql.data_quality_report(loan_features(s, AS_OF), target_col=FEATURE_TARGET, decimals=REPORT_DECIMALS)


def _errors_within(frame, rough, sketches):
    """Whether an approximate report keeps its stated errors, as 0/1 per column:
    distinct count within 4 standard errors, quartiles within the rank error,
    the mode among the most frequent values, or none named where none is
    frequent. A quantile of n values stands for
    a whole rank, and p * n is rounded to one: one row more. The exact report
    looks where the written `sketches` of the written frame say, as for `rough`."""
    rsd, error = 0.02, sk.rank_error()
    cols = ql.report_columns(REPORT_TARGET)
    exact = ql.data_quality_report(frame, REPORT_TARGET, sketches=sketches).select(
        F.col("Column").alias("name"), F.col(cols[4]).alias("n"), F.col(cols[10]).alias("top"))
    numbers = [f.name for f in frame.schema.fields if isinstance(f.dataType, NumericType)]
    asked = rough.where(F.col("Column").isin(numbers)).select(
        F.col("Column").alias("name"), F.array(*[F.col(c) for c in cols[13:16]]).alias("q"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numbers])
    ranks = frame.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").join(F.broadcast(asked), "name").groupBy("name").agg(
        F.count("*").alias("all"),
        *[F.sum((F.col("v") < F.col("q")[k]).cast("bigint")).alias(f"lo{k}") for k in range(3)],
        *[F.sum((F.col("v") <= F.col("q")[k]).cast("bigint")).alias(f"hi{k}") for k in range(3)])
    within = F.lit(True)
    for k, p in enumerate(ql.QUANTILES):
        off = F.col("all") * error + 1
        within = within & (F.col(f"lo{k}") <= F.col("all") * p + off) & (F.col(f"hi{k}") >= F.col("all") * p - off)
    joined = rough.join(exact, F.col("Column") == F.col("name")).drop("name").join(ranks, F.col("Column") == F.col("name"), "left")
    return joined.select(
        F.col("Column"), F.col("Missing Values"),
        (F.abs(F.col(cols[4]) - F.col("n")) <= F.greatest(4 * rsd * F.col("n"), F.lit(1))).cast("int").alias("distinct_within"),
        F.coalesce(within, F.lit(True)).cast("int").alias("quartiles_within"),
        F.coalesce(F.abs(F.col(cols[10]) - F.col("top")) <= 1.0, F.col("top") <= 100 * sk.unnamed_share()).cast("int").alias("mode_within"))


def _approx_error(s):
    frame = handoff(dq.delinquency(s, AS_OF))
    sketches = handoff(sk.sketch_columns(frame, REPORT_TARGET))
    return _errors_within(frame, handoff(ql.data_quality_report(frame, REPORT_TARGET, approx=True, sketches=sketches)), sketches)


def _merged(s) -> tuple[DataFrame, DataFrame]:
    """The delinquency table and its sketches per due month, written, then merged."""
    frame = handoff(dq.delinquency(s, AS_OF))
    monthly = frame.withColumn("_month", F.date_trunc("month", "due_date"))
    return frame, handoff(sk.merge_sketches(handoff(sk.sketch_columns(monthly, REPORT_TARGET, by=["_month"]))))


def _merged_error(s):
    frame, merged = _merged(s)
    return _errors_within(frame, handoff(ql.report_of_sketches(merged, frame, REPORT_TARGET)), merged)


def _merged_moments(s):
    """The figures of the merged report that are exact: counts, extremes, moments, correlation."""
    frame, merged = _merged(s)
    report = ql.report_of_sketches(merged, frame, REPORT_TARGET, decimals=MERGED_DECIMALS)
    cols = ql.report_columns(REPORT_TARGET)
    return report.select(*[F.col(f"`{cols[i]}`") for i in MERGED_EXACT])


QUERIES: dict[str, Query] = {
    "paid_payments": _q(dq.paid_payments),
    "delinquency": _q(lambda s: dq.delinquency(s, AS_OF)),
    "loan_default_points": _q(lambda s: dq.loan_default_points(s, AS_OF)),
    "payment_default_flags": _q(lambda s: dq.payment_default_flags(s, AS_OF)),
    "customer_default_flags": _q(lambda s: dq.customer_default_flags(s, AS_OF)),
    "payment_channels": _q(dq.payment_channels),
    "frozen_status": _q(pf.frozen_status),
    "fraud_status": _q(pf.fraud_status),
    "permanent_freeze": _q(pf.permanent_freeze),
    "latest_by": _q(lambda s: latest_by(s.table("payment_responses"), [K.LOAN_USER_ID], ["created_at"], ["id"])),
    "latest_employment": _q(pf.latest_employment),
    "latest_kyc_document": _q(pf.latest_kyc_document),
    "user_address": _q(pf.user_address),
    "user_address_v1": _q(lambda s: pf.user_address(s, region="v1")),
    "max_debt_income_ratio": _q(pf.max_debt_income_ratio),
    "risk_inputs": _q(sc.risk_inputs),
    "scorecard_points": _q(lambda s: sc.scorecard_points(sc.risk_inputs(s)).select(
        "user_id", *list(sc.DEFAULT_CARDS))),
    "credit_rating": _q(lambda s: sc.credit_rating(sc.risk_inputs(s))),
    "loan_features": _q(lambda s: loan_features(s, AS_OF)),
    "loan_features_bucketed": _q(_bucketed_features),
    "loan_features_v1": _q(lambda s: loan_features(s, AS_OF, region="v1")),
    "repayment_fact": _q(lambda s: _fact(s)),
    "with_balance_before": _q(lambda s: rp.with_balance_before(_fact(s))),
    "transition_resignation": _q(lambda s: pr.transition_resignation(_fact(s))),
    "prepare_employees": _q(lambda s: _inputs(s)[0]),
    "with_outstanding_balance": _q(lambda s: rp.with_outstanding_balance(
        _fact(s), pr.employee_frame(loan_features(s, AS_OF)))),
    "prepare_target_inputs": _q(lambda s: _inputs(s)[1]),
    "tpsd_anchor": _q(lambda s: _anchor(s)[1].drop("ee_resignation_date_correct")),
    "target_base": _q(lambda s: tg.target_base(*_anchor(s))),
    "tpfp_labels": _q(lambda s: tg.tpfp_labels(_base(s), THRESHOLD, AS_OF)),
    "leave_labels": _q(lambda s: tg.leave_labels(_base(s), AS_OF)),
    "user_targets": _q(lambda s: _targets(s)),
    "clean_reference_strict": _q(lambda s: ap.cleaned_references(s, "strict")),
    "clean_reference_lenient": _q(lambda s: ap.cleaned_references(s, "lenient")),
    "user_reference": _q(lambda s: ap.user_reference(s, ap.customer_onboarding(s), APP_CUTOFF)),
    "user_reference_lenient": _q(lambda s: ap.user_reference(s, ap.customer_onboarding(s), APP_CUTOFF, "lenient")),
    "device_apps": _q(ap.device_apps),
    "user_app_packages": _q(lambda s: ap.user_app_packages(s, ap.customer_onboarding(s), APP_CUTOFF)),
    "user_app_packages_lenient": _q(
        lambda s: ap.user_app_packages(s, ap.customer_onboarding(s), APP_CUTOFF, "lenient")),
    "data_quality_report": _raw(lambda s: ql.data_quality_report(
        dq.delinquency(s, AS_OF), target_col=REPORT_TARGET, decimals=REPORT_DECIMALS)),
    "data_quality_report_features": _raw(_report_features),
    "approx_report_error": _raw(_approx_error),
    "merged_report_error": _raw(_merged_error),
    "merged_report_moments": _raw(_merged_moments),
    "write_read_roundtrip": _roundtrip,
    "csv_roundtrip": _csv_roundtrip,
    "csv_text_roundtrip": _csv_text_roundtrip,
    "replace_table": _replaced,
    "active_users": _q(lambda s: active(s.table("users", "id", "product_type", "is_delete")).select("id", "product_type")),
    "repayment_fact_ordered": _q(lambda s: _fact(s, ordered=True)),
    "user_targets_ordered": _q(lambda s: _targets(s, ordered=True)),
    "user_targets_from_text": _q(_text_targets),
    "employee_frame_from_text": _q(_text_inputs),
    "employment_date_corrected": _q(lambda s: pr.employee_frame(loan_features(s, AS_OF), with_employment_correct=True).select(
        "ee_customer_id", "ln_loan_id", "ee_employment_date_correct")),
    "delinquency_spread": _q(lambda s: dq.delinquency(s, AS_OF, spread=True)),
    "repayment_fact_spread": _q(lambda s: _fact(s, spread=True)),
    "user_reference_spread": _q(lambda s: ap.user_reference(s, ap.customer_onboarding(s), APP_CUTOFF, spread=True)),
    "user_app_packages_lenient_spread": _q(
        lambda s: ap.user_app_packages(s, ap.customer_onboarding(s), APP_CUTOFF, "lenient", spread=True)),
    "tpfp_labels_spread": _q(lambda s: tg.tpfp_labels(_base(s), THRESHOLD, AS_OF, spread=True)),
    "repayment_fact_positions": _q(lambda s: _positions(_fact(s), ["user_id", "loan_id", "installment_number", "repaid_date"])),
    "user_targets_positions": _q(lambda s: _positions(_targets(s), [F.col("user_id").cast("string"), "target_type", "target"])),
    "user_app_packages_of_features": _q(lambda s: ap.user_app_packages(
        s, handoff(loan_features(s, AS_OF).select("ee_customer_id", "ee_onboarding_date")), APP_CUTOFF)),
    "data_quality_report_approx": _raw(lambda s: ql.data_quality_report(
        dq.delinquency(s, AS_OF), target_col=REPORT_TARGET, approx=True, decimals=REPORT_DECIMALS)),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
