"""Installed-app facts per user via device reference numbers.

Plan shape: the as-of reference choice is a join of references with one
(customer, onboarding) row per user and a map-side-combining latest-row
aggregate. The app table (one row per device and run date, apps nested) is
joined on the cleaned device id while still nested, so only devices with a
matching reference are shuffled, and it is unnested after the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.exprs import clean_reference, strip_device_prefix, to_manila
from loanlens.operators.relational import asof_tagged, heavy_join, latest_by, unnest
from loanlens.plans.stages import handoff
from loanlens.sources.catalog import Sources, lit_date, require

REFERENCE_COLUMNS = ["ee_customer_id", "id", "user_id", "reference_number", "cleaned_rn", "deleted_at", "created_at",
                     "updated_at"]
APP_FIELDS = ["package_name", "first_install_time", "last_update_time", "version_name", "flags"]
PACKAGE_COLUMNS = ["ee_customer_id", "id", "user_id", "reference_number", "deleted_at", "created_at",
                   "created_date_manila", "updated_at", "deviceId", "run_date"] + APP_FIELDS


def cleaned_references(src: Sources, mode: str = "strict") -> DataFrame:
    """Every reference number with its cleaned form (strict or lenient)."""
    refs = src.table("credo_lab_reference_numbers", "id", "user_id", "reference_number")
    return refs.select("id", "user_id", "reference_number",
                       clean_reference("reference_number", mode).alias("cleaned_rn"))


def user_reference(src: Sources, customers: DataFrame, cutoff, mode: str = "strict", spread: bool = False) -> DataFrame:
    """Per user: the latest reference created on or before the onboarding day
    (by day; ties by time then id), kept only if created on or before
    `cutoff` (a user whose latest is later is dropped, not rolled back).

    `customers` needs ee_customer_id and ee_onboarding_date (the feature
    table, or any frame with one onboarding value per customer). `spread`
    chooses by a tagged union of both sides in one sorted run instead of joining
    all references of a user with its onboarding row.
    """
    refs = src.table("credo_lab_reference_numbers", "id", "user_id", "reference_number", "deleted_at",
                     "created_at", "updated_at")
    require(customers, ["ee_customer_id", "ee_onboarding_date"], "customers")
    onboard = customers.select("ee_customer_id", "ee_onboarding_date").distinct()
    if spread:
        asks = onboard.select(F.col("ee_customer_id").alias("_user"), F.col("ee_onboarding_date").cast("date").alias("_asked"), "ee_customer_id")
        days = refs.withColumns({"_user": F.col("user_id"), "_day": F.col("created_at").cast("date")})
        near = asof_tagged(asks, days, "_user", "_asked", "_day", ["created_at", "id"])
    else:
        near = refs.join(onboard, refs["user_id"] == onboard["ee_customer_id"]).where(
            F.col("created_at").cast("date") <= F.col("ee_onboarding_date").cast("date"))
    joined = near.select(
        "ee_customer_id", "id", "user_id", "reference_number",
        clean_reference("reference_number", mode).alias("cleaned_rn"),
        "deleted_at", "created_at", "updated_at",
    )
    picked = latest_by(joined, ["user_id"], [F.col("created_at").cast("date")], ["created_at", "id"])
    return picked.where(F.col("created_at").cast("date") <= lit_date(cutoff)).select(*REFERENCE_COLUMNS)


def _apps_table(src: Sources) -> DataFrame:
    return src.table("android_credolab_Application", "deviceId", "run_date", "Application")


def device_apps(src: Sources) -> DataFrame:
    """One row per installed app and device run; device prefix `#n:` removed."""
    apps = _apps_table(src).select(
        "deviceId", strip_device_prefix("deviceId").alias("deviceId_cleaned"), "run_date", "Application"
    )
    return unnest(apps, "Application")


def user_app_packages(src: Sources, customers: DataFrame, cutoff, mode: str = "strict", spread: bool = False) -> DataFrame:
    """Apps of each user's device, matched on the cleaned reference number.

    Lenient cleaning maps many references and devices to one text (the empty
    one); `spread` counts keys on both sides and deals the matches of the heavy
    ones over many tasks."""
    rn = user_reference(src, customers, cutoff, mode, spread).where(F.col("cleaned_rn").isNotNull())
    apps = _apps_table(src).select(
        strip_device_prefix("deviceId").alias("device_key"), "run_date", "Application"
    )
    if spread:
        joined = heavy_join(handoff(rn), apps, "cleaned_rn", "device_key")
    else:
        joined = rn.join(apps, rn["cleaned_rn"] == apps["device_key"])
    flat = unnest(joined, "Application")
    return flat.select(
        "ee_customer_id", "id", "user_id", F.col("cleaned_rn").alias("reference_number"), "deleted_at",
        "created_at", to_manila("created_at").alias("created_date_manila"), "updated_at",
        F.col("device_key").alias("deviceId"), "run_date", *APP_FIELDS,
    )


def customer_onboarding(src: Sources) -> DataFrame:
    """(ee_customer_id, ee_onboarding_date) as the feature table defines them:
    every user with the first activation time of their timeline."""
    users = src.table("users", "id").select(F.col("id").alias("ee_customer_id"))
    ut = src.table("user_timelines", "user_id", "first_account_activated_at").select(
        F.col("user_id").alias("ee_customer_id"), F.col("first_account_activated_at").alias("ee_onboarding_date")
    )
    return users.join(ut, "ee_customer_id", "left")
