"""Which documents a table of the policy input is parsed from."""

from __future__ import annotations

from veriframe.plans import catalogue
from veriframe.sources.policy_input import PolicyInputs


def test_names_with_escapes_and_in_other_documents(spark):
    raw = ['{"risks": [{"id": "R1"}]}', '{"r\\u0069sks": [{"id": "R2"}], "changes": [{"id": "C1"}]}', '{"changes": [{"id": "risks"}]}', "risks", None, "{}"]
    t = PolicyInputs(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert sorted(r.id for r in t["risks"].collect()) == ["R1", "R2"] and sorted(r.id for r in t["changes"].collect()) == ["C1", "risks"]
    assert "Contains(raw, risks)" in t["risks"]._jdf.queryExecution().optimizedPlan().toString().replace("#", "").translate(str.maketrans("", "", "0123456789"))


def test_documents_are_written_once(spark):
    """Rules read documents that are written, instead of making them of the tables each."""
    plan = catalogue.policy_from_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "from_json" in plan
