"""Risk inputs, scorecard points and credit rating (cards are data)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions.exprs import income_midpoint, loose_date, rating, score_card, year_fraction
from loanlens.operators.profile import frozen_status
from loanlens.sources.catalog import Sources

DEFAULT_CARDS: Mapping[str, tuple[str, Mapping]] = {
    # score column -> (input column, card)
    "employer_time_score": ("employer_time", K.EMPLOYER_TIME_CARD),
    "gender_score": ("gender", K.GENDER_CARD),
    "declared_income_score": ("declared_income_num", K.DECLARED_INCOME_CARD),
    "civil_status_score": ("civil_status", K.CIVIL_STATUS_CARD),
}

RISK_INPUT_COLUMNS = [
    "user_id", "sign_up_date", "approval_date", "employer_id", "employer_name", "employment_date",
    "length_employment_date", "employer_time", "gender", "civil_status", "employment_status",
    "declared_income_num", "verified_net_income", "frozen_status",
]


def risk_inputs(src: Sources, strict: bool = False) -> DataFrame:
    """Scorecard inputs for employer/payroll users: tenure in years (income
    record date minus the loose employment date), income midpoint, gender,
    civil status and frozen status. One row per user and income record."""
    users = src.table("users", "id", "created_at", "employer_id", "gender", "civil_status", "product_type").where(
        F.col("product_type").isin(list(K.RISK_PRODUCT_TYPES))
    )
    ii = src.table("income_info", "user_id", "employment_date", "created_at", "employee_status", "income",
                   "verified_net_income").select(
        "user_id", "employment_date", F.col("created_at").alias("ii_created_at"),
        F.col("employee_status").alias("employment_status"), "income", "verified_net_income",
    )
    ut = src.table("user_timelines", "user_id", "first_account_activated_at").select(
        "user_id", F.col("first_account_activated_at").alias("approval_date")
    )
    emp = src.table("employers", "id", "name").select(
        F.col("id").cast("string").alias("employer_id"), F.col("name").alias("employer_name")
    )
    tags = frozen_status(src).select("user_id", "frozen_tag")
    base = (
        users.select(F.col("id").alias("user_id"), F.col("created_at").alias("sign_up_date"), "employer_id",
                     "gender", "civil_status")
        .join(ii, "user_id", "left")
        .join(ut, "user_id", "left")
        .join(emp, "employer_id", "left")
        .join(tags, "user_id", "left")
    )
    return base.select(
        "user_id", "sign_up_date", "approval_date", "employer_id", "employer_name", "employment_date",
        F.length("employment_date").alias("length_employment_date"),
        year_fraction(F.col("ii_created_at"), loose_date("employment_date", strict)).alias("employer_time"),
        "gender", "civil_status", "employment_status",
        income_midpoint("income", strict).alias("declared_income_num"),
        "verified_net_income",
        F.when(F.col("frozen_tag") == 1, F.lit(K.FROZEN_LABEL)).otherwise(F.lit(K.NOT_FROZEN_LABEL)).alias(
            "frozen_status"
        ),
    )


def scorecard_points(df: DataFrame, cards: Mapping[str, tuple[str, Mapping]] = DEFAULT_CARDS) -> DataFrame:
    """Add one points column per card (first matching band wins)."""
    return df.select("*", *[score_card(inp, card).alias(name) for name, (inp, card) in cards.items()])


def credit_rating(df: DataFrame, cards: Mapping[str, tuple[str, Mapping]] = DEFAULT_CARDS) -> DataFrame:
    """Score = sum of the card points; letter rating from the score."""
    scored = scorecard_points(df, cards)
    total = None
    for name in cards:
        total = F.col(name) if total is None else total + F.col(name)
    return scored.select(
        "user_id", "frozen_status", *list(cards), total.alias("score"), rating(total).alias("credit_rating")
    )
