"""Findings of round 3: subjects without a row in DM, and steps whose work grew faster than the tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from trialspark.operators import cuts as C
from trialspark.operators import graph as G
from trialspark.operators import ledger as S
from trialspark.operators import review as P
from trialspark.operators import rules as R
from trialspark.plans import protocol, queries, registry, surveillance_queries  # noqa: F401
from trialspark.plans.conformance import BASE
from trialspark.plans.conformance import study as projection

from .test_engine import test_query_matches_sql as matches


@pytest.fixture(scope="module")
def no_orders(spark, sf, tmp_path_factory):
    """The tables with a customer who has events and no order, and so no row in DM."""
    root = tmp_path_factory.mktemp("no_orders")
    con = duckdb.connect()
    for t in BASE:
        where = "WHERE o_custkey <> 3" if t == "orders" else ""
        con.execute(f"COPY (SELECT * FROM '{sf}/{t}.parquet' {where}) TO '{root}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    assert con.execute("select count(*) from events where user_id = 3").fetchone()[0] > 0
    return str(root), con


def test_site_of_a_subject_without_orders(spark, no_orders):
    matches(spark, *no_orders, "fn14_site")


def test_neighbours_of_a_subject_without_orders(spark, no_orders):
    matches(spark, *no_orders, "gr3_neighbours")


def test_an_id_asked_twice_has_its_neighbours_once(spark):
    e = spark.createDataFrame([("a", "T", "b")], "src string, type string, dst string")
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    assert [tuple(r) for r in G.neighbours(e, ids).collect()] == [("a", "T", "b")]


def exchanges(df) -> int:
    """How often a plan moves rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


DOCS = [
    ("a", "Preface\n# 2. Dose\nDose other than 10 mg.\n\n## Notes\n\n## Notes\r\nWithin a window of 4 days. \n## Prohibited drugs\n- Statins\n- Others"), ("b", "one\ntwo\n \n\nthree, age 18\n"), ("c", ""), ("d", None), ("e", "# 1) Visits\nWindow: 5 days\n# 1. Age\nage 16\n# 0) Later\nWindow: 6 days"),
]


def test_documents_are_read_row_by_row(spark):
    docs = spark.createDataFrame(DOCS, "name string, text string")
    got = {(r.name, r.section): (r.title, r.n_lines, r.text) for r in protocol.section_table(docs).collect()}
    assert got == {
        ("a", "2"): ("Dose", 1, "Dose other than 10 mg."), ("a", "notes"): ("Notes", 0, ""), ("a", "notes-2"): ("Notes", 1, "Within a window of 4 days."), ("a", "prohibited-drugs"): ("Prohibited drugs", 2, "- Statins\n- Others"),
        ("b", "p1"): ("", 2, "one\ntwo"), ("b", "p2"): ("", 1, "three, age 18"), ("e", "1"): ("Visits", 1, "Window: 5 days"), ("e", "1-2"): ("Age", 1, "age 16"), ("e", "0"): ("Later", 1, "Window: 6 days"),
    }
    refs, whole = protocol.document_references(docs), protocol.references(protocol.section_table(docs))
    assert sorted(map(tuple, refs.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert ("e", "VISIT_WINDOW_DEVIATION", "visit_window_days", "6", "0") in {tuple(r) for r in refs.collect()}
    assert exchanges(protocol.section_table(docs)) == exchanges(refs) == 0


def test_amendments_move_one_number_a_version(spark):
    changed = spark.createDataFrame([(1, "visit_window_days"), (1, "visit_schedule"), (2, "no such"), (4, "hys_days")], "version bigint, field string")
    out = S.affected_by(changed, spark.createDataFrame([(1,), (2,), (2,), (3,)], "version bigint"))
    rest = [(v, c) for v in (2, 3) for c in S.DEFAULT_AFFECTED]
    assert sorted(map(tuple, out.collect())) == sorted([(1, "VISIT_WINDOW_DEVIATION"), (1, "MISSING_DOSE"), (4, "HYS_LAW_CANDIDATE"), *rest])
    assert exchanges(out) == 1


RECORDS = [
    ("LB", "a", "WEEK2", "2024-01-05", 7), ("EX", "a", "WEEK2", "2024-01-05", 9), ("EX", "a", "WEEK2", "2024-01-05", -3), ("AA", "a", "WEEK2", "2024-01-06", 1), ("LB", "a", "WEEK4", "0001-01-01", 2**63 - 1), ("LB", "a", "WEEK4", "9999-12-31", 1),
    ("VS", "b", "WEEK4", "1969-12-31", -(2**63)), ("VS", "b", "WEEK4", "1969-12-31", 4), ("EG", "b", "WEEK8", "2024-02-02", None), ("EG", "b", "WEEK8", "2024-02-02", -(2**63)), ("EG", "b", "", "2024-02-02", 1), ("EG", "b", "EOS", None, 1),
]


def test_first_visits_are_the_earliest_ones(spark):
    records = spark.createDataFrame(RECORDS, "domain string, usubjid string, visit string, d string, seq bigint").withColumn("date", F.col("d").cast("date"))
    names = ("usubjid", "visit", "actual", "first_domain", "first_seq")
    got, want = (sorted(map(str, df.select(*names).collect())) for df in (R.first_visits(records), R.earliest_visits(records)))
    assert got == want and len(got) == 4
    plan = R.first_visits(records)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and "collect_list" not in plan and "HashAggregate" in plan  # records themselves aren't moved


FOUND = [("HYS_LAW_CANDIDATE", u, "", "LB", 1) for u in ("x-S1-1", "x-S1-2", "x-S1-3", "x-S1-1")] + [("SERIOUS_AE", "x-S1-1", "", "AE", 1), ("MISSING_DOSE", "x-S1-1", "", "EX", None), ("MISSING_DOSE", "x-S1-1", "", "EX", None), ("DOSING_ERROR", "x-S1-1", "", "EX", 2)]


def test_review_moves_all_findings_once(spark):
    found = P.detect(spark.createDataFrame(FOUND, R.FINDING))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 6
    memory = found.where("code = 'DOSING_ERROR'").select("fingerprint")
    baseline = spark.createDataFrame([("x-S1-1",), ("x-S1-1",)], "usubjid string")
    out = P.medical_review(found, memory, baseline, found.where("usubjid = 'x-S1-2'").select("fingerprint"))
    assert sorted((r.code, r.usubjid[-1], r.route) for r in out.collect()) == [
        ("DOSING_ERROR", "1", "CARRIED"), ("HYS_LAW_CANDIDATE", "1", "MONITOR"), ("HYS_LAW_CANDIDATE", "2", "MONITOR"), ("HYS_LAW_CANDIDATE", "3", "ESCALATE"), ("MISSING_DOSE", "1", "DATA_QUERY"), ("SERIOUS_AE", "1", "ESCALATE"),
    ]


def test_a_cut_s_view_is_written_once(spark, sf, tmp_path):
    study = surveillance_queries.whole_study(projection(spark, sf))
    view, plain = study.written_view(6, str(tmp_path)), study.view(6)
    assert sorted(map(str, view["dm"].collect())) == sorted(map(str, plain["dm"].collect()))
    assert [exchanges(view[name]) for name in ("dm", "lb", "ae", "ex")] == [0, 0, 0, 0]


HELD = [("LB", "a", 1, "WEEK2"), ("LB", "a", 1, "WEEK2"), ("LB", "a", 1, "WEEK4"), ("LB", "a", 10, ""), ("LB", "a", 9, None), ("EX", "a", 63, "WEEK2"), ("EX", "a", 64, "WEEK2"), ("EX", "a", 128, "WEEK4"), ("EX", "b", -1, "x/y"), ("EX", "b", -64, "x/y"), ("VS", "b/x", 2**63 - 1, "y"), ("EG", "b", -(2**63), "EOS"), ("EG", "", 3, "EOS")]
OTHERS = [("AE", "a", 7), ("AE", "a", 100), ("AE", "a", 100), ("MH", "c", None), ("MH", "c", None), ("CM", "c", 999), ("CM", "c", 1000), ("DM", "a", None), ("DM", "b", None)]
RESULTS = [("a", 1, "ALT", "U/L", None, "ok"), ("a", 1, "ALT", "U/L", "S1", "ok"), ("a", 1, "ALT", "U/L", "S1", "ok"), ("a", 65, "AST", "U/L", None, "ok"), ("a", 2, "ALT", "U/L", None, "censored"), ("b", 3, "ALT", None, None, "no_range"), ("b", -5, "ALT", "U/L", "S1", "ok")]


@pytest.fixture(scope="module")
def graph(spark):
    other = spark.createDataFrame(OTHERS, "domain string, usubjid string, seq bigint")
    visits = spark.createDataFrame(HELD, "domain string, usubjid string, seq bigint, visit string")
    tables = {d: (visits if d in G.VISITED else other).where(F.col("domain") == d).select("usubjid", "seq") for d in ("LB", "AE", "EX", "CM", "VS", "EG", "MH", "DM")}
    return {
        "dm": spark.createDataFrame([("a", "S1"), ("b", "S2")], "usubjid string, siteid string"), "persons": spark.createDataFrame([("a", "a"), ("b", "a")], "usubjid string, person_id string"), "domains": tables, "visits": visits, "version": 3,
        "cuts": spark.createDataFrame([(1, 1), (9, 3)], "cut int, version int"), "documents": spark.createDataFrame([("p",)], "name string"), "ranges": spark.createDataFrame([("ALT", "U/L", "S1"), ("ALT", "U/L", "CENTRAL")], "testcd string, unit string, lab string"),
        "labs": spark.createDataFrame(RESULTS, "usubjid string, seq bigint, testcd string, r_unit string, r_lab string, status string"),
    }


def test_edges_are_counted_without_their_ids(graph):
    whole = G.edges(graph).groupBy("type").agg(F.count("*"), F.count_distinct("src"), F.count_distinct("dst"), F.min("dst"))
    got = G.edge_counts(graph, G.record_blocks(graph), G.compared_blocks(graph))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    records = got.where("type = 'HAS_RECORD'")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in records and "Expand" not in records


def test_nodes_are_counted_without_their_ids(graph):
    whole = G.nodes(graph).groupBy("kind").agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"))
    assert sorted(map(tuple, G.node_counts(graph, G.record_blocks(graph)).collect())) == sorted(map(tuple, whole.collect()))


def test_no_records_have_no_edges(graph):
    empty = graph | {"domains": {d: df.limit(0) for d, df in graph["domains"].items()}, "visits": graph["visits"].limit(0), "labs": graph["labs"].limit(0)}
    got = G.edge_counts(empty, G.record_blocks(empty), G.compared_blocks(empty))
    assert {r.type for r in got.collect()} == {r.type for r in G.edges(empty).select("type").distinct().collect()}


@pytest.mark.parametrize("name", ["gr1_edges", "gr1_nodes", "ag5_stats"])
def test_graph_counts_match_sql(spark, no_orders, name):
    matches(spark, *no_orders, name)


FIXES = [(1, "LB", "a", 1, "RES", "x", 1), (2, "LB", "a", 1, "RES", "", 2), (2, "LB", "a", 1, "UNIT", None, 3), (9, "LB", "a", 1, "RES", "late", 4), (1, "LB", "a", None, "UNIT", "n", 5), (1, "LB", "b", 2, "ELSE", "z", 6), (1, "AE", "a", 1, "RES", "other", 7)]


def test_a_domain_is_corrected_in_one_join_and_no_job(spark):
    lb = spark.createDataFrame([("a", 1, "r1", "u1"), ("a", None, "r2", "u2"), ("b", 2, None, "u3")], "usubjid string, seq bigint, res string, unit string")
    fixes = spark.createDataFrame(FIXES, "cut int, domain string, usubjid string, seq bigint, field string, new_value string, row_no int")
    names = {"LB": {"RES": "res", "UNIT": "unit", "GONE": "gone"}, "VS": {"RES": "res"}}
    unread = fixes.withColumn("domain", F.raise_error(F.lit("corrections were read")).cast("string"))
    assert C.overlay_all({"LB": lb}, unread, names, 5)["LB"].columns == ["usubjid", "seq", "res", "unit", "raw_res", "raw_unit"]
    out = C.overlay_all({"LB": lb, "VS": lb, "EX": lb}, fixes, names, 5)
    assert sorted(map(tuple, out["LB"].collect()), key=str) == sorted([("a", 1, "", None, "r1", "u1"), ("a", None, "r2", "n", "r2", "u2"), ("b", 2, None, "u3", None, "u3")], key=str)
    assert out["LB"]._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1 and out["EX"].columns == lb.columns
    assert sorted(map(str, out["VS"].select(lb.columns).collect())) == sorted(map(str, lb.collect()))
    fields = C.overlay(C.overlay(lb, fixes.where("domain = 'LB'"), "RES", "res", None).drop("n_corrections"), fixes.where("domain = 'LB'"), "UNIT", "unit", None).drop("n_corrections")
    assert sorted(map(str, C.overlay_all({"LB": lb}, fixes, names, None)["LB"].select(fields.columns).collect())) == sorted(map(str, fields.collect()))


@pytest.mark.parametrize("few", [50_000, 0])
def test_a_task_holds_so_many_subjects(spark, few, monkeypatch):
    monkeypatch.setattr(G, "SUBJECTS_A_TASK", 3)
    monkeypatch.setattr(G, "FEW_SUBJECTS", few)
    who = [f"s{i:02}" for i in range(40)]
    one = lambda rows: spark.createDataFrame(rows, "usubjid string, seq bigint, what string")
    records = one([(u, i, f"w{i}") for u in who for i in (2, 1)] + [(None, 1, "nobody's")])
    ctx = {name: records.limit(0) for name in ("persons", "vs", "eg", "ex", "cm", "mh", "ds", "findings")} | {"dm": records.where("seq = 1"), "lb": records, "ae": records.where("usubjid < 's10'")}
    ctx["visits"] = spark.createDataFrame([("s01", "EOS", "LB"), ("s01", "EOS", "EX")], "usubjid string, visit string, domain string").withColumn("date", F.lit("2024-01-01").cast("date"))
    asked = one([(u, 0, "") for u in [*who[:38], "s01", "unknown", None]])
    out = G.patients(ctx, asked)
    assert out.rdd.getNumPartitions() == -(-40 // 3)
    got = {r.usubjid: (r.found, [x.record for x in r.sections.labs], len(r.sections.adverse_events), len(r.sections.visits)) for r in out.collect()}
    labs = ['{"what":"w1"}', '{"what":"w2"}']
    assert got == {u: (True, labs, 2 if u < "s10" else 0, 1 if u == "s01" else 0) for u in who[:38]} | {u: (False, [], 0, 0) for u in ("unknown", None)}
