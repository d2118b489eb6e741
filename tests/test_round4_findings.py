"""What round 4's findings mended."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from trialspark.operators import cuts as C
from trialspark.plans.conformance import BASE, study
from trialspark.plans.registry import keep, release

from .test_round3_findings import matches


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """Lines without a known part, with empty fields and given twice; a customer is missing."""
    root, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    source = {t: f"SELECT * FROM '{sf}/{t}.parquet'" for t in BASE}
    source["part"] += " WHERE p_partkey % 7 <> 3"
    source["customer"] += " WHERE c_custkey <> 5"
    empty = lambda c, n: f"CASE WHEN l_orderkey % {n} = 2 THEN NULL ELSE {c} END AS {c}"
    source["lineitem"] = f"SELECT * REPLACE ({empty('l_partkey', 17)}, {empty('l_quantity', 19)}, {empty('l_linenumber', 3)}) FROM '{sf}/lineitem.parquet' UNION ALL SELECT * FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 29 = 1"
    for t in BASE:
        con.execute(f"COPY ({source[t]}) TO '{root}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return str(root), con


@pytest.mark.parametrize("name", ["p2_two_cycles", "gr5_many"])
def test_lines_are_numbered_as_in_sql(spark, odd, name):
    matches(spark, *odd, name)


def test_exposure_and_medicines_read_lines_once(spark, sf):
    s = study(spark, sf)
    keep(s["lines"])
    plans = [s[name]._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0] for name in ("ex", "cm")]
    found = s["cm"].where(F.upper("cls").contains("SULFONYLUREA"))._jdf.queryExecution().optimizedPlan().toString()
    release()
    assert not any("lineitem" in plan or "l_extendedprice" in plan for plan in plans)
    assert "p_type" in next(line for line in found.splitlines() if "Filter" in line and "SULFONYLUREA" in line.upper() or "Filter" in line and "ECONOMY" in line)


def test_a_domain_without_numbers_is_corrected(spark):
    dm = spark.createDataFrame([("a", "30"), ("b", "40")], "usubjid string, age string")
    fixes = spark.createDataFrame([(1, "DM", "a", None, "AGE", "17", 1), (1, "DM", "b", 3, "AGE", "18", 2)], "cut int, domain string, usubjid string, seq bigint, field string, new_value string, row_no int")
    out = C.overlay_all({"DM": dm}, fixes, {"DM": {"AGE": "age"}}, 2)["DM"]
    assert sorted(map(tuple, out.collect())) == [("a", "17", "30"), ("b", "40", "40")]


def test_corrections_are_written_once_and_few_move_no_records(spark, sf, tmp_path):
    from trialspark.plans.surveillance_queries import watched_study, whole_study

    s = study(spark, sf)
    engine = watched_study(s, str(tmp_path))
    told = [sorted(map(str, c.select("cut", "domain", "usubjid", "seq", "field", "new_value", "row_no").collect())) for c in (engine.corrections, whole_study(s).corrections)]
    view = engine.view(6)
    plan = view["ex"]._jdf.queryExecution().executedPlan().toString()
    rows = [sorted(map(str, v["ex"].collect())) for v in (view, whole_study(s).view(6))]
    release()
    assert told[0] == told[1] and told[0] and rows[0] == rows[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("InMemoryRelation")[0]


def test_a_step_s_table_is_computed_once(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from trialspark.plans import surveillance

    def step(w, cut):
        out = w.once(spark.range(3).select(F.expr("uuid()").alias("u")))
        out.write.parquet(str(tmp_path / "decided"))
        return out

    monkeypatch.setattr(surveillance, "STEPS", [("ledger", step)])
    watch = surveillance.Surveillance(SimpleNamespace(corrections=spark.range(0)), str(tmp_path / "state"))
    decided = lambda: sorted(r.u for r in spark.read.parquet(str(tmp_path / "decided")).collect())
    assert sorted(r.u for r in watch.run_cut(1).collect()) == decided() and not watch._held
