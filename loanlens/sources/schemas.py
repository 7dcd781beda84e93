"""Declared schemas of the lending source tables.

Column names and types as the operators use them (inferred from use; the
warehouse DDL is not available). `ddl(name)` feeds `spark.read.schema(...)`
for CSV/JSON sources; `conform(df, name)` casts a frame to the declared
types and fails with the names of missing columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.sources.catalog import require

TS = "timestamp_ntz"
MONEY = "decimal(18,2)"
APP = ("array<struct<package_name:string, first_install_time:timestamp_ntz, last_update_time:timestamp_ntz, "
       "version_name:string, flags:bigint>>")

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "users": [
        ("id", "bigint"), ("product_type", "string"), ("gender", "string"), ("civil_status", "string"),
        ("employer_id", "string"), ("email", "string"), ("phone", "string"), ("firstname", "string"),
        ("middlename", "string"), ("lastname", "string"), ("birthdate", "date"), ("email_verified", "int"),
        ("telephone_verified", "int"), ("id_verified", "int"), ("income_verified", "int"),
        ("account_activated", "int"), ("morning_time", "string"), ("afternoon_time", "string"),
        ("created_at", TS), ("is_delete", "int"),
    ],
    "payment_responses": [
        ("id", "bigint"), ("tendopay_user_id", "bigint"), ("merchant_id", "bigint"), ("merchant_order_id", "string"),
        ("principal", MONEY), ("fee", MONEY), ("bir", MONEY), ("tendopay_installments", "int"), ("status", "string"),
        ("tendopay_disposition", "string"), ("repaid_full", "int"), ("created_at", TS), ("fully_repaid_at", TS),
    ],
    "repayment_schedules": [
        ("id", "bigint"), ("payment_response_id", "bigint"), ("due_date", "date"), ("principal", MONEY),
        ("interest", MONEY), ("amount", MONEY), ("outstanding_balance", MONEY), ("is_delete", "int"),
    ],
    "split_purchases": [
        ("repayment_schedule_id", "string"), ("txnid", "string"), ("principal", MONEY), ("interest", MONEY),
        ("amount", MONEY), ("repaid_date", "date"), ("is_delete", "int"),
    ],
    "customer_repayment_responses": [("txn_id", "string"), ("vendor_id", "string"), ("subfamily", "string")],
    "user_tag": [
        ("id", "bigint"), ("user_id", "bigint"), ("tag_id", "bigint"), ("tag_name", "string"), ("created_at", TS),
        ("updated_at", TS), ("deleted_at", TS),
    ],
    "employer_employees": [
        ("id", "bigint"), ("user_id", "bigint"), ("comment", "string"), ("department", "string"),
        ("recommended_ir", "string"), ("hired_date", "date"), ("user_deleted_at", TS), ("updated_at", TS),
    ],
    "user_timelines": [("user_id", "bigint"), ("first_account_activated_at", TS)],
    "income_info": [
        ("user_id", "bigint"), ("employment_id", "bigint"), ("employment_date", "string"),
        ("employee_status", "string"), ("income", "string"), ("contract", "string"), ("job_title", "string"),
        ("nature_of_work", "string"), ("verified_gross_income", MONEY), ("verified_net_income", MONEY),
        ("created_at", TS),
    ],
    "id_info": [
        ("user_id", "bigint"), ("postal_code", "string"), ("landmark", "string"), ("city_name", "string"),
        ("residing_date", "date"), ("is_citizen", "int"),
    ],
    "address": [
        ("id", "bigint"), ("user_id", "bigint"), ("barangay_id", "bigint"), ("address_line_1", "string"),
        ("address_line_2", "string"), ("landmark", "string"), ("created_at", TS), ("deleted_at", TS),
    ],
    "barangay": [("id", "bigint"), ("name", "string"), ("city_id", "bigint")],
    "cities_v2": [("id", "bigint"), ("province_id", "bigint"), ("name", "string")],
    "provinces_v2": [("id", "bigint"), ("region_id", "bigint")],
    "regions_v2": [("id", "bigint"), ("name", "string")],
    "regions": [("id", "bigint"), ("name", "string")],
    "document_ids": [("type", "bigint"), ("name", "string")],
    "files": [
        ("id", "bigint"), ("user_id", "bigint"), ("doc_id", "bigint"), ("doc_type", "int"), ("owner_type", "string"),
        ("updated_at", TS),
    ],
    "kyc_credit_info": [("user_id", "bigint"), ("monthly_utility_bills_amount", MONEY)],
    "employers": [
        ("id", "bigint"), ("name", "string"), ("email_domain", "string"), ("repayment_days", "string"),
        ("custom_email", "string"), ("payment_reminders", "string"), ("address", "string"),
        ("postal_code_id", "bigint"), ("max_bir", MONEY), ("industry", "string"), ("max_credit_limit", MONEY),
        ("status", "int"), ("activated_at", TS), ("deleted_at", TS), ("created_at", TS), ("updated_at", TS),
    ],
    "employer_group": [("employer_id", "bigint"), ("group_id", "bigint")],
    "employment_ids": [("id", "bigint"), ("name", "string")],
    "model_has_permissions": [("model_id", "bigint"), ("permission_id", "bigint"), ("model_type", "string")],
    "model_has_tp_events": [("model_id", "bigint"), ("tp_event", "string"), ("options", "string")],
    "xendit_payment_responses": [("reference_id", "string"), ("channel_code", "string")],
    "credo_lab_reference_numbers": [
        ("id", "bigint"), ("user_id", "bigint"), ("reference_number", "string"), ("deleted_at", TS),
        ("created_at", TS), ("updated_at", TS),
    ],
    "android_credolab_Application": [("deviceId", "string"), ("run_date", "date"), ("Application", APP)],
}


def ddl(name: str) -> str:
    """DDL string of a source table, for `spark.read.schema(...)`."""
    return ", ".join(f"`{c}` {t}" for c, t in SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of `name`, cast to their declared types."""
    cols = SCHEMAS[name]
    require(df, [c for c, _ in cols], f"source table {name!r}")
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols])
