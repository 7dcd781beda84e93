import os

import pytest

from loanlens.operators.relational import latest_by
from loanlens.plans import stages
from loanlens.plans.features import duplicated_keys
from loanlens.session import checkpoint_dir
from loanlens.sources import MissingColumns, Sources


def test_handoff_prunes_and_is_cleared(spark):
    df = stages.handoff(spark.range(10).selectExpr("id", "id * 2 as twice"))
    assert df.where("id = 3").select("twice").first().twice == 6
    folder = stages._WRITTEN[-1]
    assert os.path.isdir(folder.removeprefix("file:"))
    assert stages.clear(spark) >= 1 and not os.path.exists(folder.removeprefix("file:"))


def test_unset_folder_raises():
    class Context:
        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_latest_by_carries_maps(spark):
    df = spark.sql("select * from values (1, 1, map('a', 1)), (1, 2, map('b', 2)), (2, null, map('c', 3)) as t(k, o, m)")
    assert {r.k: r.m for r in latest_by(df, ["k"], ["o"]).collect()} == {1: {"b": 2}, 2: {"c": 3}}


def _fan_out(spark, **frames):
    empty = {"income_info": "user_id", "id_info": "user_id", "user_timelines": "user_id", "kyc_credit_info": "user_id",
             "employer_group": "employer_id", "model_has_permissions": "model_id", "xendit_payment_responses": "reference_id"}
    tables = {t: spark.createDataFrame([], f"{k} bigint") for t, k in empty.items()}
    tables["model_has_tp_events"] = spark.createDataFrame([], "model_id bigint, tp_event string")
    return Sources({**tables, **frames})


def test_duplicated_keys(spark):
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "user_id bigint")
    twice = spark.createDataFrame([(1, "E0000011"), (1, "E0000011"), (2, "x"), (2, "x")], "model_id bigint, tp_event string")
    assert duplicated_keys(_fan_out(spark, id_info=nulls)) == []
    assert duplicated_keys(_fan_out(spark, model_has_tp_events=twice)) == ["model_has_tp_events.model_id"]


def test_feature_inputs_are_checked(spark):
    from loanlens.operators import profile

    with pytest.raises(MissingColumns, match="hired_date"):
        profile.latest_employment(Sources({"employer_employees": spark.createDataFrame([], "user_id bigint, updated_at date")}), ["hired_date"])
