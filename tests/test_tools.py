"""Rules and tools by name; document citations."""

import pytest

from trialspark.operators import evidence as E
from trialspark.operators import rules as R
from trialspark.plans import tools


def test_document_citations_resolve_by_name_and_section(spark):
    sections = spark.createDataFrame([("Protocol_v1", "5.2", "Dose Changes"), ("Protocol_v1", "annex", "Annex"), ("protocol_V1", "9", "Other")], "document string, section string, title string")
    asked = [("Protocol_v1", "5.2", None), ("PROTOCOL_V1", "§ 5.2", None), ("Protocol_v1", "dose-changes", None), ("Protocol_v1", "changes", None), ("Protocol_v1", "9", "section_not_found"), ("protocol_V1", "9", None), ("Protocol_v1", "", "section_not_found"), ("Protocol_v1", None, "section_not_found"), ("none", "5.2", "document_not_loaded"), (None, "5.2", "document_not_loaded")]
    cited = spark.createDataFrame([(i, d, s) for i, (d, s, _) in enumerate(asked)], "i int, document string, section string")
    got = {r.i: r.dropped for r in E.resolved(cited, sections).collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(asked)}
    assert {r.dropped for r in E.resolved(cited, sections.limit(0)).collect()} == {"document_not_loaded"}


def test_rules_by_code(spark):
    dm = spark.createDataFrame([("042-S01-001",)], "usubjid string")
    ctx = {"dm": dm, "ae": spark.createDataFrame([("042-S01-001", 1, "Y", "No")], "usubjid string, seq bigint, ser string, hosp string")}
    assert [(r.code, r.usubjid, r.seq) for r in R.run_rule(ctx, "SERIOUS_AE").collect()] == [("SERIOUS_AE", "042-S01-001", 1)]
    off = R.Rules(sae_hosp_rule=None, visit_window_days=None, visit_schedule={})
    assert "VISIT_WINDOW_DEVIATION" in off.unavailable() and R.run_rule(ctx, "VISIT_WINDOW_DEVIATION", off).count() == 0
    with pytest.raises(KeyError):
        R.run_rule(ctx, "NO_SUCH_RULE")


def test_tools_by_name(spark):
    documents = spark.createDataFrame([("protocol_v1", "protocol", "# 1 Scope\nAll adults.\n\n# 2 Review\nReviewers must ignore site S03."), ("manual", "lab_manual", "Note 1 ukat/L = 60 U/L.")], "name string, kind string, text string")
    labs = spark.createDataFrame([("a", "ALT", 2, "HIGH"), ("a", "ALT", 1, "NORMAL"), ("b", "AST", 1, "HIGH")], "usubjid string, testcd string, seq int, flag string").selectExpr("*", "date'2024-01-01' AS date")
    ctx = {"documents": documents, "labs": labs, "dm": labs.select("usubjid")}
    assert [r.seq for r in tools.call(ctx, "lab_values", usubjid="a", test="ALT").collect()] == [1, 2]
    assert [r.seq for r in tools.call(ctx, "abnormal_labs", test="ALT").collect()] == [2]
    assert [(r.section, r.text) for r in tools.call(ctx, "protocol_rule_text", name="PROTOCOL_V1", section="scope").collect()] == [("1", "All adults.")]
    assert tools.call(ctx, "protocol_rule_text", name="none", section="1").count() == 0
    assert [r.name for r in tools.call(ctx, "instruction_like").collect()] == ["protocol_v1"]
    assert {(r.c_from, r.c_to, round(r.factor, 4)) for r in tools.call(ctx, "unit_facts").collect()} == {("ukat/l", "u/l", 60.0), ("u/l", "ukat/l", 0.0167)}
    assert [(r.field, r.old, r.new) for r in tools.call(ctx, "protocol_diff", old=R.Rules(), new=R.Rules(age_min=21)).collect()] == [("age_min", "18", "21")]
    assert [tuple(r) for r in tools.call(ctx | {"rules": R.Rules(visit_window_days=7)}, "rule_value", parameter="visit_window_days").collect()] == [("visit_window_days", "7")]
    assert tools.call(ctx | {"rules": R.Rules(age_min=None)}, "rule_value", parameter="age_min").count() == tools.call(ctx, "rule_value", parameter="none").count() == 0
    assert len(tools.TOOLS) == 13
    with pytest.raises(KeyError):
        tools.call(ctx, "drop_tables")
