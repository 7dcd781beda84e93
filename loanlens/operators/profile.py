"""User profile operators: tags, latest records, KYC document, address, JSON options.

Every "latest row per user" is `relational.latest_by`, an aggregation that
combines map-side (skew-safe), with the table key as the final tie-break.
Dimension tables (document types, barangays, cities, provinces, regions) are
small by nature; the planner broadcasts them when their size is under the
checked threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions.exprs import any_flag, contains_class, json_scalar
from loanlens.operators.relational import latest_by
from loanlens.sources.catalog import Sources, active


def _key_cols(df: DataFrame, candidates) -> list[str]:
    """Tie-break columns: those of `candidates` the table has."""
    return [c for c in candidates if c in df.columns]


def frozen_status(src: Sources) -> DataFrame:
    """Per user with any tag: frozen_tag 0/1 (deleted tags count) and label."""
    tags = src.table("user_tag", "user_id", "tag_id")
    per_user = tags.groupBy("user_id").agg(
        any_flag(F.col("tag_id").isin(list(K.FROZEN_TAG_IDS))).alias("frozen_tag")
    )
    return per_user.select(
        "user_id",
        "frozen_tag",
        F.when(F.col("frozen_tag") == 1, F.lit(K.FROZEN_LABEL)).otherwise(F.lit(K.NOT_FROZEN_LABEL)).alias(
            "frozen_status"
        ),
    )


def fraud_status(src: Sources) -> DataFrame:
    """Per user with any tag: 'Risk' if a live tag is in the risk set, else 'Normal'."""
    tags = src.table("user_tag", "user_id", "tag_id", "deleted_at")
    hit = F.when(F.col("tag_id").isin(list(K.RISK_TAG_IDS)) & F.col("deleted_at").isNull(), F.lit(1))
    per_user = tags.groupBy("user_id").agg(F.sum(hit).alias("n_risk"))
    return per_user.select(
        "user_id",
        F.when(F.col("n_risk") > 0, F.lit(K.RISK_LABEL)).otherwise(F.lit(K.NORMAL_LABEL)).alias("customer_status"),
    )


def permanent_freeze(src: Sources) -> DataFrame:
    """Per user: created_at of the latest-updated live FREEZE_PERMANENT tag."""
    tags = src.table("user_tag", "user_id", "tag_name", "created_at", "updated_at", "deleted_at")
    live = active(tags.where(F.col("tag_name") == K.FREEZE_PERMANENT_TAG), "deleted_at")
    tb = ["created_at"] + _key_cols(live, ["tag_id", "id"])
    picked = latest_by(live.select("user_id", "updated_at", *tb), ["user_id"], ["updated_at"], tb)
    return picked.select("user_id", "created_at")


def latest_employment(src: Sources, columns: list[str] | None = None) -> DataFrame:
    """Latest employer_employees row per user by updated_at (ties: table key);
    with `columns`, only those are read and carried (user_id comes first)."""
    if columns is None:
        ee = src.table("employer_employees", "user_id", "updated_at")
        return latest_by(ee, ["user_id"], ["updated_at"], _key_cols(ee, ["id"]))
    ee = src.table("employer_employees", "user_id", "updated_at", *columns)
    tb = _key_cols(ee, ["id"])
    narrow = ee.select(*dict.fromkeys(["user_id", *columns, "updated_at", *tb]))
    return latest_by(narrow, ["user_id"], ["updated_at"], tb).select("user_id", *[c for c in columns if c != "user_id"])


def latest_kyc_document(src: Sources) -> DataFrame:
    """Per user: name of the latest ID document (doc_type 1, owner App\\IdInfo)."""
    files = src.table("files", "user_id", "doc_id", "doc_type", "owner_type", "updated_at")
    docs = src.table("document_ids", "type", "name")
    kyc = files.where((F.col("doc_type") == K.KYC_DOC_TYPE) & contains_class("owner_type", K.KYC_OWNER_CLASS))
    tb = _key_cols(kyc, ["id"])
    joined = kyc.select("user_id", "doc_id", "updated_at", *tb).join(
        docs.select(F.col("type").alias("doc_id"), "name"), "doc_id"
    )
    picked = latest_by(joined, ["user_id"], ["updated_at"], tb + ["name"])
    return picked.select("name", "user_id")


def user_address(src: Sources, region: str = "v2") -> DataFrame:
    """Latest live address per user with barangay and region names.

    region="v2": region from the v2 chain only; "v1" also adds the legacy
    region name (`region_name_v1`) joined on the same province region id.
    """
    addr = active(
        src.table("address", "user_id", "barangay_id", "address_line_1", "address_line_2", "landmark",
                  "created_at", "deleted_at"),
        "deleted_at",
    )
    brgy = src.table("barangay", "id", "name", "city_id").select(
        F.col("id").alias("barangay_id"), F.col("name").alias("barangay_name"), "city_id"
    )
    city = src.table("cities_v2", "id", "province_id").select(F.col("id").alias("city_id"), "province_id")
    prov = src.table("provinces_v2", "id", "region_id").select(F.col("id").alias("province_id"), "region_id")
    reg = src.table("regions_v2", "id", "name").select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    chain = (
        addr.join(brgy, "barangay_id", "left")
        .join(city, "city_id", "left")
        .join(prov, "province_id", "left")
        .join(reg, "region_id", "left")
    )
    out = ["region_name"]
    if region == "v1":
        reg1 = src.table("regions", "id", "name").select(
            F.col("id").alias("region_id"), F.col("name").alias("region_name_v1")
        )
        chain = chain.join(reg1, "region_id", "left")
        out.append("region_name_v1")
    elif region != "v2":
        raise ValueError(f"region must be 'v1' or 'v2', not {region!r}")
    cols = out + ["barangay_name", "user_id", "address_line_1", "address_line_2", "landmark"]
    tb = _key_cols(chain, ["id"])
    picked = latest_by(chain.select(*cols, "created_at", *tb), ["user_id"], ["created_at"], tb)
    return picked.select(*cols)


def max_debt_income_ratio(src: Sources, strict: bool = False) -> DataFrame:
    """Per model id: scalar `max_debt_income_ratio` from the JSON options of
    event E0000011; objects, arrays and malformed JSON give null."""
    ev = src.table("model_has_tp_events", "model_id", "tp_event", "options")
    return ev.where(F.col("tp_event") == K.DEBT_INCOME_EVENT).select(
        "model_id", json_scalar("options", K.DEBT_INCOME_KEY, strict).alias("max_debt_income_ratio")
    )
