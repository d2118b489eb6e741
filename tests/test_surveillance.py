"""Cut by cut: advance against whole builds, thirteen steps that go on where they stopped, the stream against the batch, states, events, caches, split files."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import decisions as DS
from trialspark.operators import incremental as V
from trialspark.operators import ledger as S
from trialspark.operators import rules as R
from trialspark.plans import study, surveillance
from trialspark.plans.conformance import study as projection
from trialspark.sources import study as source
from trialspark.streaming import cuts as stream

RULES = {1: R.Rules(), 2: R.Rules(visit_window_days=7)}


@pytest.fixture(scope="module")
def engine(spark, sf, tmp_path_factory):
    """A few sites of the projection, written once."""
    s, root = projection(spark, sf), tmp_path_factory.mktemp("study")
    tables = {}
    for name in ("dm", "lb", "ae", "ex", "cm", "ds", "mh", "vs", "eg"):
        df = s[name].where(F.get(F.split("usubjid", "-"), F.lit(1)) < "S05")
        df = df.withColumn("seq", F.lit(None).cast("bigint")) if name == "dm" else df
        if "cut_available" in df.columns:  # at cut 6 every second subject brings nothing
            df = df.where("cut_available <> 6 or usubjid rlike '[02468]$'")
        df.coalesce(1).write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    s["corrections_all"].where(F.get(F.split("usubjid", "-"), F.lit(1)) < "S05").where("cut <> 6 or usubjid rlike '[02468]$'").coalesce(1).write.parquet(f"{root}/corrections")
    return study.Study(tables, spark.read.parquet(f"{root}/corrections"), s["ranges"], RULES, s["cuts"])


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_advance_gives_the_rows_of_a_whole_build(spark, engine, tmp_path):
    """From cut 4 on; version 2 comes at cut 5 and changes one parameter."""
    state, n = str(tmp_path / "state"), engine.tables["dm"].count()
    for cut, version in ((4, 1), (5, 2), (6, 2)):
        got = rows(engine.advance(cut, state, version))
        assert got == rows(engine.context(cut, version)["findings"].select("code", "usubjid", "subcode", "domain", "seq")) and got
    done = {cut: spark.read.json(f"{state}/advanced/cut={cut}").first().asDict() for cut in (4, 5, 6)}
    assert done[4]["whole"] and not done[5]["whole"] and done[5]["everyone_rules"] == ["VISIT_WINDOW_DEVIATION"] and done[6]["everyone_rules"] == []
    assert "PROHIBITED_MEDICATION" not in done[6]["touched_rules"] and "SERIOUS_AE" in done[6]["touched_rules"]
    subjects = spark.read.parquet(f"{state}/subjects/cut=6")
    assert 0 < subjects.count() < n
    read = {d: df.count() for d, df in engine.view(6, subjects).items()}  # what the touched rules read
    assert all(read[d] < engine.view(6)[d].count() for d in ("lb", "ae", "vs", "dm", "ex"))
    assert rows(engine.advance(6, state, 2)) == got  # again


def test_what_is_dirty():
    assert V.dirty({"CM"}, set()) == V.Dirty(("PROHIBITED_MEDICATION",), ()) and V.dirty(set(), set()) == V.Dirty((), ())
    assert V.dirty({"EX"}, {"visit_window_days"}, True) == V.Dirty(("AE_BEFORE_FIRST_DOSE", "DOSING_ERROR"), ("MISSING_DOSE", "VISIT_WINDOW_DEVIATION"))
    assert V.changed_fields(RULES[1], RULES[2]) == {"visit_window_days"}


def test_stream_with_a_failure_equals_the_batch(spark, engine, tmp_path, monkeypatch):
    """The second cut stops in the middle; its announcement comes again, no step that was done runs twice, and all tables are the batch's."""
    replies = engine.tables["ae"].where("seq % 2 = 0").select(F.concat_ws("|", F.lit("SERIOUS_AE"), "usubjid", F.lit("AE"), F.col("seq").cast("string"), F.lit("SAE_CODED")).alias("fingerprint"), F.lit(6).cast("bigint").alias("cut"), F.lit("APPROVED").alias("decision"))
    asked = engine.tables["dm"].select("usubjid", F.lit("Which drugs?").alias("question"))
    batch = surveillance.Surveillance(engine, str(tmp_path / "batch"), replies, asked)
    period = rows(batch.run_period([5, 6]))
    calls, whole = [], list(surveillance.STEPS)

    def watched(name, make):
        def step(w, cut):
            calls.append((cut, name))
            if (cut, name) == (6, "ledger") and calls.count((6, "ledger")) == 1:
                raise RuntimeError("the executor is gone")
            return make(w, cut)

        return step

    monkeypatch.setattr(surveillance, "STEPS", [(name, watched(name, make)) for name, make in whole])
    live = surveillance.Surveillance(engine, str(tmp_path / "live"), replies, asked)
    for cut in (5, 6, 6):
        stream.announce(spark, str(tmp_path / "announced"), cut)
    with pytest.raises(Exception, match="gone"):
        stream.watch(spark, str(tmp_path / "announced"), live.run_cut, str(tmp_path / "check"))
    stream.watch(spark, str(tmp_path / "announced"), live.run_cut, str(tmp_path / "check"))
    assert [c for c in calls if calls.count(c) > 1] == [(6, "ledger")] * 2 and len(set(calls)) == 2 * len(whole) == 26
    for cut in (5, 6):
        for name, _ in whole:
            assert rows(batch.written(name, cut)) == rows(live.written(name, cut)), (cut, name)
    assert rows(live.period()) == period and rows(live.decisions.as_of()) == rows(batch.decisions.as_of())
    told = {r.what: r.n for r in batch.written("result", 6).collect()}
    assert told["carried"] > 0 and told["version"] == 2 and told["findings"] > told["escalations"] > 0 and told["human:APPROVED"] > 0
    human = batch.decisions.as_of(6, kind="HUMAN_GATE", status="APPROVED").limit(1).collect()[0]
    assert {r.status for r in batch.decisions.history(human.decision_id).collect()} <= {"PENDING", "APPROVED"}
    assert batch.decisions.explain(human.decision_id).first().history[-1].status == "APPROVED"


def test_states_age_and_close(spark):
    e = spark.createDataFrame([(f, 1) for f in "abcdefg"], "fingerprint string, cut bigint")
    replies = spark.createDataFrame([("a", 2, "APPROVED"), ("b", 3, "CLARIFY"), ("c", 3, "CLARIFY"), ("c", 5, "REJECTED"), ("e", 1, "REJECTED"), ("f", 6, "APPROVED"), ("g", 3, "CLARIFY"), ("x", 1, "APPROVED")], "fingerprint string, cut bigint, decision string")
    answered = spark.createDataFrame([("b",)], "fingerprint string")
    out = {}
    for r in S.human_history(e, replies, answered, 7).orderBy("cut").collect():
        out.setdefault(r.fingerprint, []).append(r.state[:3])
    assert out == {
        "a": ["PEN"] + ["APP"] * 6, "b": ["PEN"] * 2 + ["APP"] * 5, "c": ["PEN"] * 2 + ["UNR"] * 2 + ["REJ"] * 3, "d": ["PEN"] * 4 + ["STA"] * 3, "e": ["REJ"] * 7, "f": ["PEN"] * 4 + ["STA"] * 3, "g": ["PEN"] * 2 + ["UNR"] * 5,
    }
    assert S.human_history(e.limit(0), replies, answered, 7).count() == 0


def test_decision_events(spark, tmp_path):
    store = DS.DecisionStore(spark, str(tmp_path / "decisions"))
    assert store.as_of().count() == 0
    form = lambda status, cut: DS.events(spark.createDataFrame([("k", status)], "k string, s string"), "FINDING", F.col("k"), F.col("s"), F.lit(cut), F.lit("why"), F.array(F.lit("AE:1")), code=F.lit("C"))
    for cut, status in ((1, "CONFIRMED"), (2, "CONFIRMED"), (3, "RESOLVED"), (3, "RESOLVED")):
        store.append(form(status, cut), cut, 10)
    assert [tuple(r) for r in store.history("FINDING|k").select("cut", "old_status", "status").collect()] == [(1, None, "CONFIRMED"), (3, "CONFIRMED", "RESOLVED")]
    assert store.as_of(2).first().status == "CONFIRMED" and store.as_of(status="RESOLVED", code="C").count() == 1 and store.as_of(status="OPEN").count() == 0
    told = spark.createDataFrame([("FINDING|k", ["AE:1", "AE:2"]), ("FINDING|none", ["AE:9"])], "decision_id string, refs array<string>")
    assert {r.decision_id: r.extra for r in DS.deviations(told, store.log()).collect()} == {"FINDING|k": ["AE:2"], "FINDING|none": ["AE:9"]}


def test_one_file_over_many_tasks(spark, tmp_path):
    """Row numbers are the same however many tasks read the file; headers may be quoted."""
    path = str(tmp_path / "LB.csv")
    lines = ['﻿"USUBJID", "LB,SEQ" ,LBTESTCD'] + [f'u{i},{i},"a ""b"", c"' if i % 7 else ",," for i in range(4000)] + ["short", "long,1,2,3"]
    with open(path, "w") as f:
        f.write("\n".join(lines))
    whole = [tuple(r) for r in source.read_csv(spark, path).orderBy("row_no").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        many = source.read_csv(spark, path)
        assert many.rdd.getNumPartitions() > 5 and [tuple(r) for r in many.orderBy("row_no").collect()] == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert many.columns == ["USUBJID", "LB,SEQ", "LBTESTCD", "row_no", "malformed"] and [r[3] for r in whole] == list(range(2, 2 + len(whole)))
    assert whole[0] == ("u1", "1", 'a "b", c', 2, False) and whole[-2][-1] and whole[-1][-1] and len(whole) == 4000 - 572 + 2
    with open(path, "w") as f:
        f.write('A,B\n1,"two\nlines"\n2,x\n')
    assert [tuple(r) for r in source.read_csv(spark, path).orderBy("row_no").collect()] == [("1", "two\nlines", 2, False), ("2", "x", 3, False)]


def test_findings_are_kept_until_a_file_changes(spark, engine, tmp_path, monkeypatch):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/AE.csv").write_text("USUBJID\nu\n")
    small = study.Study({k: df.limit(0) for k, df in engine.tables.items()}, engine.corrections.limit(0), engine.ranges, RULES, engine.cuts)
    cache, made = str(tmp_path / "cache"), []
    form = lambda n: spark.createDataFrame([("C", f"u{n}", "", "AE", n)], R.FINDING)
    for n, change in ((1, False), (2, False), (3, True)):
        if change:
            (tmp_path / "data/AE.csv").write_text("USUBJID\nu\nv\n")
        small.build(3, 1).ctx["findings"] = form(n)
        made.append(small.findings(cache, source.signature(spark, str(tmp_path))).first().usubjid)
    assert made == ["u1", "u1", "u3"]
    import os

    assert len(os.listdir(cache)) == 1  # the old signature's are gone
