"""Loan feature table: every user, left-joined to profile, employer, credit
line, scorecard and every loan (any status) with its default flags.

Plan shape:
  user side: users LEFT JOIN ~15 user-keyed tables. Each right side is
    shuffled once by user id; the left side keeps its user-id partitioning
    through the chain (no re-shuffle). Employer-keyed dimensions are small
    by nature and broadcast when the planner's size check allows.
  loan side: loans LEFT JOIN disbursement channel (merchant order id) and
    per-loan default flags (loan id).
  attach: the loan rows, plus one empty row per user without loans (an anti
    join of user ids only), INNER JOIN the user side once. AQE can split a user
    who holds a third of all loans; a plain left outer join with the skew on
    its right side could not be split.
The output grain is the reference's: user x loan x any duplicate rows of the
non-unique left joins (income records, permissions, employer groups, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions.exprs import contains_class, flag, loan_type, map_codes
from loanlens.operators import delinquency as dq
from loanlens.operators import profile as pf
from loanlens.operators import scoring as sc
from loanlens.sources.catalog import Sources, require

USER_COLUMNS_V2 = [
    "ee_customer_id", "ee_email", "ee_phone_number", "ee_firstname", "ee_middlename", "ee_lastname",
    "ee_birthdate", "ee_gender", "ee_email_verified_flag", "ee_telephone_verified_flag", "ee_id_verified_flag",
    "ee_income_verified_flag", "ee_morning_time_contact_time", "ee_afternoon_time_contact_time",
    "ee_account_activated_flag", "ee_region_name", "ee_city_name", "ee_barangay", "ee_address_line_1",
    "ee_address_line_2", "ee_postal_code", "ee_landmark", "ee_residing_date", "ee_employment_status",
    "ee_civil_status", "ee_kyc_doc_name", "ee_is_citizen_flag", "ee_onboarding_date", "ee_employment_date",
    "ee_fraud_status", "ee_job_type", "ee_comment", "ee_department", "ee_recommended_ir", "ee_job_title",
    "ee_employment_type", "ee_nature_of_work", "ee_permanent_freeze_date", "ee_resignation_date",
    "ee_product_type", "ee_frozen_status", "cust_risk_employer_time_score_v1", "cust_risk_gender_score_v1",
    "cust_risk_declared_income_score_v1", "cust_risk_civil_status_score_v1", "cust_risk_combined_score_v1",
    "cust_risk_cat_v1",
]
EMPLOYER_COLUMNS = [
    "er_employer_id", "er_employer_group_id", "er_employer_name", "er_email_domain", "er_repayment_days_month",
    "er_custom_email", "er_payment_reminders", "er_address", "er_postal_code_id", "er_max_base_interest_rate",
    "er_employer_industry", "er_employer_status", "er_activated_at", "er_deleted_at", "er_created_at",
    "er_updated_at",
]
CREDIT_COLUMNS = [
    "cl_monthly_utility_bills_amount", "cl_monthly_income_gross", "cl_monthly_income_net",
    "cl_multiple_purchases_enabled_flag", "cl_max_credit_limit_multiplier", "cl_max_debt_income_ratio",
    "cl_matured_fpd30_flag", "cl_matured_fspd30_flag", "cl_matured_fstpd30_flag", "cl_matured_fstfpd30_flag",
    "cl_fpd30_flag", "cl_fspd30_flag", "cl_fstpd30_flag", "cl_fstfpd30_flag",
]
LOAN_COLUMNS = [
    "ln_loan_id", "ln_loan_type", "ln_loan_status", "ln_disbursement_channel", "ln_original_principal",
    "ln_orig_interest_fees", "ln_orig_tenor", "ln_loan_application_datetime", "ln_repaid_full_flag",
    "ln_fully_repaid_date", "ln_fpd30_flag", "ln_fspd30_flag", "ln_fstpd30_flag", "ln_fstfpd30_flag",
    "ln_min_loan_due_date", "ln_os_principal_at_fpd30", "ln_os_principal_at_fspd30",
    "ln_os_principal_at_fstpd30", "ln_os_principal_at_fstfpd30", "ln_matured_fpd30_flag",
    "ln_matured_fspd30_flag", "ln_matured_fstpd30_flag", "ln_matured_fstfpd30_flag",
]


def feature_columns(region: str = "v2") -> list[str]:
    users = list(USER_COLUMNS_V2)
    if region == "v1":
        users.insert(users.index("ee_region_name") + 1, "ee_region_name_V2")
    return users + EMPLOYER_COLUMNS + CREDIT_COLUMNS + LOAN_COLUMNS


# column -> Spark type of the feature table, before the output edge
FEATURE_TYPES = {
    "ee_customer_id": "bigint",
    "ee_email": "string",
    "ee_phone_number": "string",
    "ee_firstname": "string",
    "ee_middlename": "string",
    "ee_lastname": "string",
    "ee_birthdate": "date",
    "ee_gender": "string",
    "ee_email_verified_flag": "int",
    "ee_telephone_verified_flag": "int",
    "ee_id_verified_flag": "int",
    "ee_income_verified_flag": "int",
    "ee_morning_time_contact_time": "string",
    "ee_afternoon_time_contact_time": "string",
    "ee_account_activated_flag": "int",
    "ee_region_name": "string",
    "ee_city_name": "string",
    "ee_barangay": "string",
    "ee_address_line_1": "string",
    "ee_address_line_2": "string",
    "ee_postal_code": "string",
    "ee_landmark": "string",
    "ee_residing_date": "date",
    "ee_employment_status": "string",
    "ee_civil_status": "string",
    "ee_kyc_doc_name": "string",
    "ee_is_citizen_flag": "int",
    "ee_onboarding_date": "timestamp_ntz",
    "ee_employment_date": "date",
    "ee_fraud_status": "string",
    "ee_job_type": "string",
    "ee_comment": "string",
    "ee_department": "string",
    "ee_recommended_ir": "string",
    "ee_job_title": "string",
    "ee_employment_type": "string",
    "ee_nature_of_work": "string",
    "ee_permanent_freeze_date": "timestamp_ntz",
    "ee_resignation_date": "date",
    "ee_product_type": "string",
    "ee_frozen_status": "string",
    "cust_risk_employer_time_score_v1": "int",
    "cust_risk_gender_score_v1": "int",
    "cust_risk_declared_income_score_v1": "int",
    "cust_risk_civil_status_score_v1": "int",
    "cust_risk_combined_score_v1": "int",
    "cust_risk_cat_v1": "string",
    "er_employer_id": "bigint",
    "er_employer_group_id": "bigint",
    "er_employer_name": "string",
    "er_email_domain": "string",
    "er_repayment_days_month": "string",
    "er_custom_email": "string",
    "er_payment_reminders": "string",
    "er_address": "string",
    "er_postal_code_id": "bigint",
    "er_max_base_interest_rate": "decimal(18,2)",
    "er_employer_industry": "string",
    "er_employer_status": "string",
    "er_activated_at": "timestamp_ntz",
    "er_deleted_at": "timestamp_ntz",
    "er_created_at": "timestamp_ntz",
    "er_updated_at": "timestamp_ntz",
    "cl_monthly_utility_bills_amount": "decimal(18,2)",
    "cl_monthly_income_gross": "decimal(18,2)",
    "cl_monthly_income_net": "decimal(18,2)",
    "cl_multiple_purchases_enabled_flag": "int",
    "cl_max_credit_limit_multiplier": "decimal(18,2)",
    "cl_max_debt_income_ratio": "string",
    "cl_matured_fpd30_flag": "int",
    "cl_matured_fspd30_flag": "int",
    "cl_matured_fstpd30_flag": "int",
    "cl_matured_fstfpd30_flag": "int",
    "cl_fpd30_flag": "int",
    "cl_fspd30_flag": "int",
    "cl_fstpd30_flag": "int",
    "cl_fstfpd30_flag": "int",
    "ln_loan_id": "bigint",
    "ln_loan_type": "string",
    "ln_loan_status": "string",
    "ln_disbursement_channel": "string",
    "ln_original_principal": "decimal(18,2)",
    "ln_orig_interest_fees": "decimal(18,2)",
    "ln_orig_tenor": "int",
    "ln_loan_application_datetime": "timestamp_ntz",
    "ln_repaid_full_flag": "int",
    "ln_fully_repaid_date": "date",
    "ln_fpd30_flag": "int",
    "ln_fspd30_flag": "int",
    "ln_fstpd30_flag": "int",
    "ln_fstfpd30_flag": "int",
    "ln_min_loan_due_date": "date",
    "ln_os_principal_at_fpd30": "decimal(18,2)",
    "ln_os_principal_at_fspd30": "decimal(18,2)",
    "ln_os_principal_at_fstpd30": "decimal(18,2)",
    "ln_os_principal_at_fstfpd30": "decimal(18,2)",
    "ln_matured_fpd30_flag": "int",
    "ln_matured_fspd30_flag": "int",
    "ln_matured_fstpd30_flag": "int",
    "ln_matured_fstfpd30_flag": "int",
}


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Keep `keep` (checked to be there), renamed with `prefix` (one projection)."""
    return require(df, keep).selectExpr(*[f"`{c}` AS `{prefix}{c}`" for c in keep])


# user-keyed inputs of the feature table, in join order, and their user id
USER_KEYS = {
    "users": "uid", "income": "ii_user_id", "employment": "ee_user_id", "kyc_document": "doc_user_id", "identity": "id_user_id",
    "address": "ad_user_id", "timeline": "ut_user_id", "credit_info": "kc_user_id", "permission": "mp_model_id", "fraud": "fr_user_id",
    "freeze": "fz_user_id", "rating": "rt_user_id", "customer_flags": "cl_user_id",
}


def _user_inputs(src: Sources, region: str, cl: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """The frames that the user side joins on the user id, in join order: name
    -> (its key, the frame)."""
    users = src.table(
        "users", "id", "email", "phone", "firstname", "middlename", "lastname", "birthdate", "gender",
        "email_verified", "telephone_verified", "id_verified", "income_verified", "morning_time",
        "afternoon_time", "account_activated", "civil_status", "product_type", "employer_id",
    ).select(
        F.col("id").alias("uid"), "email", "phone", "firstname", "middlename", "lastname", "birthdate", "gender",
        "email_verified", "telephone_verified", "id_verified", "income_verified", "morning_time",
        "afternoon_time", "account_activated", "civil_status", "product_type", "employer_id",
    )
    ii = _prefixed(
        src.table("income_info"), "ii_",
        ["user_id", "employee_status", "contract", "job_title", "employment_id", "nature_of_work",
         "verified_gross_income", "verified_net_income"],
    )
    work = ["hired_date", "comment", "department", "recommended_ir", "user_deleted_at"]
    ee = _prefixed(pf.latest_employment(src, work), "ee_", ["user_id", *work])
    doc = _prefixed(pf.latest_kyc_document(src), "doc_", ["user_id", "name"])
    idi = _prefixed(src.table("id_info"), "id_",
                    ["user_id", "postal_code", "landmark", "city_name", "residing_date", "is_citizen"])
    addr_cols = ["user_id", "region_name", "barangay_name", "address_line_1", "address_line_2", "landmark"]
    if region == "v1":
        addr_cols.append("region_name_v1")
    addr = _prefixed(pf.user_address(src, region), "ad_", addr_cols)
    ut = _prefixed(src.table("user_timelines"), "ut_", ["user_id", "first_account_activated_at"])
    kyc = _prefixed(src.table("kyc_credit_info"), "kc_", ["user_id", "monthly_utility_bills_amount"])
    perm = _prefixed(src.table("model_has_permissions"), "mp_", ["model_id", "permission_id", "model_type"])
    fraud = _prefixed(pf.fraud_status(src), "fr_", ["user_id", "customer_status"])
    freeze = _prefixed(pf.permanent_freeze(src), "fz_", ["user_id", "created_at"])
    rating = _prefixed(sc.credit_rating(sc.risk_inputs(src)), "rt_",
                       ["user_id", "frozen_status"] + list(sc.DEFAULT_CARDS) + ["credit_rating"])
    cl = cl.withColumnRenamed("user_id", "cl_user_id")

    frames = {"users": users, "income": ii, "employment": ee, "kyc_document": doc, "identity": idi, "address": addr, "timeline": ut, "credit_info": kyc,
              "permission": perm, "fraud": fraud, "freeze": freeze, "rating": rating, "customer_flags": cl}
    return {name: (key, frames[name]) for name, key in USER_KEYS.items()}


def _user_side(src: Sources, inputs: dict[str, tuple[str, DataFrame]], region: str) -> DataFrame:
    emp = _prefixed(
        src.table("employers"), "er_",
        ["id", "name", "email_domain", "repayment_days", "custom_email", "payment_reminders", "address",
         "postal_code_id", "max_bir", "industry", "status", "activated_at", "deleted_at", "created_at",
         "updated_at", "max_credit_limit"],
    )
    grp = _prefixed(src.table("employer_group", "employer_id", "group_id"), "eg_", ["employer_id", "group_id"])
    etype = _prefixed(src.table("employment_ids", "id", "name"), "et_", ["id", "name"])
    ratio = pf.max_debt_income_ratio(src).select(
        F.col("model_id").alias("tp_model_id"), F.col("max_debt_income_ratio").alias("tp_ratio")
    )

    (_, side), *others = inputs.values()
    for key, frame in others:
        side = side.join(frame, F.col("uid") == F.col(key), "left")
    side = (
        side
        .join(emp, F.col("er_id").cast("string") == F.col("employer_id"), "left")
        .join(grp, F.col("eg_employer_id") == F.col("er_id"), "left")
        .join(etype, F.col("et_id") == F.col("ii_employment_id"), "left")
        .join(ratio, F.col("tp_model_id") == F.col("er_id"), "left")
    )
    scores = [F.col(f"rt_{n}") for n in sc.DEFAULT_CARDS]
    region_cols = (
        [F.col("ad_region_name_v1").alias("ee_region_name"), F.col("ad_region_name").alias("ee_region_name_V2")]
        if region == "v1"
        else [F.col("ad_region_name").alias("ee_region_name")]
    )
    return side.select(
        F.col("uid").alias("ee_customer_id"),
        F.col("email").alias("ee_email"),
        F.col("phone").alias("ee_phone_number"),
        F.col("firstname").alias("ee_firstname"),
        F.col("middlename").alias("ee_middlename"),
        F.col("lastname").alias("ee_lastname"),
        F.col("birthdate").alias("ee_birthdate"),
        F.col("gender").alias("ee_gender"),
        F.col("email_verified").alias("ee_email_verified_flag"),
        F.col("telephone_verified").alias("ee_telephone_verified_flag"),
        F.col("id_verified").alias("ee_id_verified_flag"),
        F.col("income_verified").alias("ee_income_verified_flag"),
        F.col("morning_time").alias("ee_morning_time_contact_time"),
        F.col("afternoon_time").alias("ee_afternoon_time_contact_time"),
        F.col("account_activated").alias("ee_account_activated_flag"),
        *region_cols,
        F.col("id_city_name").alias("ee_city_name"),
        F.col("ad_barangay_name").alias("ee_barangay"),
        F.col("ad_address_line_1").alias("ee_address_line_1"),
        F.col("ad_address_line_2").alias("ee_address_line_2"),
        F.col("id_postal_code").alias("ee_postal_code"),
        F.coalesce(F.col("id_landmark"), F.col("ad_landmark")).alias("ee_landmark"),
        F.col("id_residing_date").alias("ee_residing_date"),
        F.col("ii_employee_status").alias("ee_employment_status"),
        F.col("civil_status").alias("ee_civil_status"),
        F.col("doc_name").alias("ee_kyc_doc_name"),
        F.col("id_is_citizen").alias("ee_is_citizen_flag"),
        F.col("ut_first_account_activated_at").alias("ee_onboarding_date"),
        F.col("ee_hired_date").alias("ee_employment_date"),
        F.col("fr_customer_status").alias("ee_fraud_status"),
        F.col("ii_contract").alias("ee_job_type"),
        F.col("ee_comment"),
        F.col("ee_department"),
        F.col("ee_recommended_ir"),
        F.col("ii_job_title").alias("ee_job_title"),
        F.col("et_name").alias("ee_employment_type"),
        F.col("ii_nature_of_work").alias("ee_nature_of_work"),
        F.col("fz_created_at").alias("ee_permanent_freeze_date"),
        F.col("ee_user_deleted_at").cast("date").alias("ee_resignation_date"),
        F.col("product_type").alias("ee_product_type"),
        F.col("rt_frozen_status").alias("ee_frozen_status"),
        F.col("rt_employer_time_score").alias("cust_risk_employer_time_score_v1"),
        F.col("rt_gender_score").alias("cust_risk_gender_score_v1"),
        F.col("rt_declared_income_score").alias("cust_risk_declared_income_score_v1"),
        F.col("rt_civil_status_score").alias("cust_risk_civil_status_score_v1"),
        (scores[0] + scores[1] + scores[2] + scores[3]).alias("cust_risk_combined_score_v1"),
        F.col("rt_credit_rating").alias("cust_risk_cat_v1"),
        F.col("er_id").alias("er_employer_id"),
        F.col("eg_group_id").alias("er_employer_group_id"),
        F.col("er_name").alias("er_employer_name"),
        F.col("er_email_domain"),
        F.col("er_repayment_days").alias("er_repayment_days_month"),
        F.col("er_custom_email"),
        F.col("er_payment_reminders"),
        F.col("er_address"),
        F.col("er_postal_code_id"),
        F.col("er_max_bir").alias("er_max_base_interest_rate"),
        F.col("er_industry").alias("er_employer_industry"),
        map_codes("er_status", K.EMPLOYER_STATUS_LABELS).alias("er_employer_status"),
        F.col("er_activated_at"),
        F.col("er_deleted_at"),
        F.col("er_created_at"),
        F.col("er_updated_at"),
        F.col("kc_monthly_utility_bills_amount").alias("cl_monthly_utility_bills_amount"),
        F.col("ii_verified_gross_income").alias("cl_monthly_income_gross"),
        F.col("ii_verified_net_income").alias("cl_monthly_income_net"),
        flag(contains_class("mp_model_type", K.USER_OWNER_CLASS)
             & (F.col("mp_permission_id") == K.MULTIPLE_PURCHASES_PERMISSION)).alias(
            "cl_multiple_purchases_enabled_flag"),
        F.col("er_max_credit_limit").alias("cl_max_credit_limit_multiplier"),
        F.col("tp_ratio").alias("cl_max_debt_income_ratio"),
        *[F.col(c) for c in CREDIT_COLUMNS[6:]],
    )


def _loan_side(src: Sources, flags: DataFrame) -> DataFrame:
    loans = src.table(
        "payment_responses", "id", K.LOAN_USER_ID, "merchant_id", "merchant_order_id", "status", "principal",
        "fee", K.LOAN_TERM, "created_at", "repaid_full", "fully_repaid_at",
    )
    xendit = src.table("xendit_payment_responses", "reference_id", "channel_code").select(
        F.col("reference_id").alias("x_ref"), F.col("channel_code").alias("ln_disbursement_channel")
    )
    flags = flags.withColumnRenamed("loan_id", "f_loan_id")
    side = (
        loans.join(xendit, F.col("merchant_order_id") == F.col("x_ref"), "left")
        .join(flags, F.col("id") == F.col("f_loan_id"), "left")
    )
    return side.select(
        F.col(K.LOAN_USER_ID).alias("loan_user_id"),
        F.col("id").alias("ln_loan_id"),
        "merchant_id",
        F.col("status").alias("ln_status_code"),
        "ln_disbursement_channel",
        F.col("principal").alias("ln_original_principal"),
        F.col("fee").alias("ln_orig_interest_fees"),
        F.col(K.LOAN_TERM).alias("ln_orig_tenor"),
        F.col("created_at").alias("ln_loan_application_datetime"),
        F.col("repaid_full").alias("ln_repaid_full_flag"),
        F.col("fully_repaid_at").cast("date").alias("ln_fully_repaid_date"),
        "min_loan_due_date", "def_fpd30", "def_spd30", "def_tpd30", "def_fstfpd30",
        "def_fpd30_vol", "def_spd30_vol", "def_tpd30_vol", "def_fstfpd30_vol",
    )


def _driving_loans(src: Sources, loans: DataFrame) -> DataFrame:
    """One row per loan, and one without a loan per user that has none; the user
    is `driving_id`. Only user ids pass through the anti join, so the wide user
    side is joined (and planned) once, by an inner join that AQE can split."""
    ids = src.table("users", "id").select(F.col("id").alias("driving_id")).distinct()
    owners = src.table("payment_responses", K.LOAN_USER_ID).select(F.col(K.LOAN_USER_ID).alias("driving_id")).distinct()
    without = ids.join(owners, "driving_id", "left_anti").select(
        "driving_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in loans.schema.fields if f.name != "loan_user_id"])
    return loans.withColumnRenamed("loan_user_id", "driving_id").unionByName(without)


# left-joined tables that are not de-duplicated: (table, key) -> extra rows fan out
FAN_OUT_TABLES = [
    ("income_info", "user_id"), ("id_info", "user_id"), ("user_timelines", "user_id"),
    ("kyc_credit_info", "user_id"), ("employer_group", "employer_id"), ("model_has_permissions", "model_id"),
    ("xendit_payment_responses", "reference_id"), ("model_has_tp_events", "model_id"),
]


def duplicated_keys(src: Sources) -> list[str]:
    """Fan-out tables that hold a non-null key more than once (null keys never
    join). One job over the union of all tables' keys; it returns at most one
    row per table."""
    keys = None
    for table, key in FAN_OUT_TABLES:
        rows = src.table(table, key)
        if table == "model_has_tp_events":  # only this event is joined
            rows = rows.where(F.col("tp_event") == K.DEBT_INCOME_EVENT)
        own = rows.where(F.col(key).isNotNull()).select(F.lit(f"{table}.{key}").alias("name"), F.col(key).cast("string").alias("key"))
        keys = own if keys is None else keys.unionByName(own)
    found = keys.groupBy("name", "key").count().where(F.col("count") > 1).select("name").distinct().collect()
    names = {r["name"] for r in found}
    return [f"{t}.{k}" for t, k in FAN_OUT_TABLES if f"{t}.{k}" in names]


def bucket_inputs(src: Sources, as_of, schema: str, buckets: int, region: str = "v2") -> str:
    """Write all user-keyed inputs of the feature table into the tables
    `<schema>.feature_<name>`, each bucketed and sorted by the user id into the
    same `buckets`; returns `schema`. `loan_features(bucketed=schema)` then joins
    them bucket by bucket without a shuffle, as often as it is run. Each input is
    shuffled once, here."""
    loan_flags, customer_flags = dq.default_flags(src, as_of)
    frames = _user_inputs(src, region, customer_flags)
    frames["loans"] = ("driving_id", _driving_loans(src, _loan_side(src, loan_flags)))
    for name, (key, frame) in frames.items():
        # one file per bucket
        frame.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{schema}.feature_{name}")
    return schema


def loan_features(src: Sources, as_of, region: str = "v2", on_duplicate: str = "keep", bucketed: str | None = None) -> DataFrame:
    """The wide customer x loan feature table (100 columns; 101 with region="v1").

    `bucketed` names the schema that `bucket_inputs` wrote with the same `as_of`
    and `region`: the chain of user-keyed joins and the loans then need no shuffle.

    on_duplicate="keep" keeps the source semantics: a key repeated in a
    left-joined table repeats the user's rows. "error" checks those tables
    first and raises, naming them, if any key repeats.
    """
    if region not in ("v1", "v2"):
        raise ValueError(f"region must be 'v1' or 'v2', not {region!r}")
    if on_duplicate not in ("keep", "error"):
        raise ValueError(f"on_duplicate must be 'keep' or 'error', not {on_duplicate!r}")
    if on_duplicate == "error":
        dups = duplicated_keys(src)
        if dups:
            raise ValueError(f"duplicate keys in left-joined tables: {', '.join(dups)}")
    if bucketed:
        spark = src.table("users").sparkSession
        inputs = {name: (key, spark.table(f"{bucketed}.feature_{name}")) for name, key in USER_KEYS.items()}
        driving = spark.table(f"{bucketed}.feature_loans")
    else:
        loan_flags, customer_flags = dq.default_flags(src, as_of)
        inputs = _user_inputs(src, region, customer_flags)
        driving = _driving_loans(src, _loan_side(src, loan_flags))
    users = _user_side(src, inputs, region)
    both = driving.join(users, F.col("driving_id") == F.col("ee_customer_id"), "inner").drop("driving_id")
    derived = dq.loan_flag_columns(both, as_of)
    loan_cols = {
        "ln_loan_id": F.col("ln_loan_id"),
        "ln_loan_type": loan_type("merchant_id", "ln_loan_id"),
        "ln_loan_status": map_codes("ln_status_code", K.LOAN_STATUS_LABELS),
        **{c: F.col(c) for c in LOAN_COLUMNS[3:10]},
        **derived,
    }
    head = [c for c in feature_columns(region) if not c.startswith("ln_")]
    return both.select(*head, *[loan_cols[c].alias(c) for c in LOAN_COLUMNS])
