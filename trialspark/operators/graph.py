"""The study as a graph of nodes and edges; only one-hop questions are asked of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N


def node_id(kind: str, *parts):
    return F.concat(F.lit(kind + ":"), F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def visits_of(domains: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(domain, usubjid, visit, date, seq): the records of every domain with visits, by code and date; domains map to a table and its date column."""
    raw = _all([df.select(F.lit(d).alias("domain"), "usubjid", "visit", F.col(dated).alias("dtc"), F.col("seq").cast("bigint").alias("seq")) for d, (df, dated) in domains.items()])
    return raw.select("domain", "usubjid", N.visit_code(F.col("visit")).alias("visit"), N.date_of(F.col("dtc")).alias("date"), "seq")


def _study_nodes(ctx: dict) -> list[DataFrame]:
    """All nodes but visits and records."""
    dm, persons = ctx["dm"], ctx["persons"]
    many = persons.groupBy("person_id").count().where("count > 1")
    study = dm.sparkSession.createDataFrame([("STUDY:042", "STUDY")], "id string, kind string")
    return [study, _once(ctx["cuts"], "PROTOCOL_VERSION", "version"), _once(ctx["documents"], "DOCUMENT", "name"), _once(ctx["ranges"], "REFERENCE_RANGE", "testcd", "unit", "lab"), _once(dm, "SITE", "siteid"), _once(many, "PERSON", "person_id"), _once(dm, "SUBJECT", "usubjid")]


def _once(df: DataFrame, kind: str, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().select(node_id(kind, *map(F.col, cols)).alias("id"), F.lit(kind).alias("kind"))


def nodes(ctx: dict) -> DataFrame:
    """(id, kind), each once: keys are made distinct before they are written as ids."""
    records = [df.select("usubjid", "seq").distinct().select(node_id("RECORD", F.lit(d), F.col("usubjid"), F.col("seq")).alias("id"), F.lit("RECORD").alias("kind")) for d, df in ctx["domains"].items()]
    visits = ctx["visits"].select("usubjid", F.col("visit").alias("v")).where("v <> ''")
    return _all([*_study_nodes(ctx), _once(visits, "VISIT", "usubjid", "v"), *records])


#: The domains whose records ctx["visits"] holds, all of them.
VISITED = ("LB", "VS", "EG", "EX")


def _compared(ctx: dict) -> DataFrame:
    """(usubjid, seq, testcd, r_unit, lab): results that were compared, with the range that held for them."""
    compared = ctx["labs"].where("r_unit is not null and status = 'ok'")
    lab = F.when(F.col("r_lab").isNotNull(), F.col("r_lab")).otherwise("CENTRAL") if "r_lab" in compared.columns else F.lit("")
    return compared.select("usubjid", "seq", "testcd", "r_unit", lab.alias("lab"))


def _records(ctx: dict) -> DataFrame:
    """(domain, usubjid, seq, v): every record of every domain, with its visit's code or an empty one."""
    visits = ctx["visits"].select("domain", "usubjid", "seq", F.col("visit").alias("v"))
    plain = [df.select(F.lit(d).alias("domain"), "usubjid", F.col("seq").cast("bigint").alias("seq"), F.lit("").alias("v")) for d, df in ctx["domains"].items() if d not in VISITED]
    return _all([visits, *plain])


def _edge(df: DataFrame, src, kind: str, dst) -> DataFrame:
    return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))


def _study_edges(ctx: dict) -> list[DataFrame]:
    """The edges between the study, sites, subjects, persons and protocol versions."""
    dm, persons, edge = ctx["dm"], ctx["persons"], _edge
    keys = lambda df, *cols: df.select(*cols).distinct()
    subject, person, protocol = node_id("SUBJECT", F.col("usubjid")), node_id("PERSON", F.col("person_id")), node_id("PROTOCOL_VERSION", F.lit(ctx["version"]))
    many = persons.join(persons.groupBy("person_id").count().where("count > 1"), "person_id")
    base = many.where("usubjid <> person_id")
    return [
        edge(keys(dm, "siteid"), F.lit("STUDY:042"), "HAS_SITE", node_id("SITE", F.col("siteid"))), edge(keys(dm, "usubjid", "siteid"), subject, "ENROLLED", node_id("SITE", F.col("siteid"))),
        edge(keys(ctx["cuts"].where(F.col("version") == ctx["version"]), "version"), F.lit("STUDY:042"), "GOVERNED_BY", node_id("PROTOCOL_VERSION", F.col("version"))), edge(keys(dm, "usubjid"), subject, "UNDER_PROTOCOL", protocol), edge(many, subject, "SAME_PERSON", person),
        edge(base, subject, "POSSIBLE_DUPLICATE_OF", node_id("SUBJECT", F.col("person_id"))), edge(base, node_id("SUBJECT", F.col("person_id")), "POSSIBLE_DUPLICATE_OF", subject),
    ]


def edges(ctx: dict) -> DataFrame:
    """(src, type, dst), each once; ctx["version"] is the protocol version in force, which governs the study and its subjects."""
    subject, visit = node_id("SUBJECT", F.col("usubjid")), lambda v: node_id("VISIT", F.col("usubjid"), v)
    record = node_id("RECORD", F.col("domain"), F.col("usubjid"), F.col("seq"))
    # every record once, with its visits: each domain is read once, and one grouping makes the edges of records distinct
    held = _records(ctx).groupBy("domain", "usubjid", "seq").agg(F.collect_set(F.when(F.col("v") != "", F.col("v"))).alias("vs"))
    two = lambda src, kind, dst: F.struct(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    of_records = held.select(F.explode(F.concat(F.array(two(subject, "HAS_RECORD", record)), F.transform("vs", lambda v: two(record, "AT_VISIT", visit(v))))).alias("_e")).select("_e.*")
    visits = ctx["visits"].select("usubjid", F.col("visit").alias("v")).where("v <> ''").distinct()
    compared = _edge(_compared(ctx).distinct(), node_id("RECORD", F.lit("LB"), F.col("usubjid"), F.col("seq")), "COMPARED_TO", node_id("REFERENCE_RANGE", F.col("testcd"), F.col("r_unit"), F.col("lab")))
    return _all([*_study_edges(ctx), _edge(visits, subject, "HAS_VISIT", visit(F.col("v"))), of_records, compared])


#: A record's place in its block of 64 numbers, as one bit; a record without a number has no block and the first bit.
_BIT = "coalesce(shiftleft(1L, cast(seq & 63 as int)), 1L)"
#: The numbers of a block's records as texts.
_NUMBERS = "transform(filter(sequence(0, 63), i -> shiftright(bits, i) & 1L = 1L), i -> coalesce(cast(shiftleft(block, 6) + i as string), ''))"


def _blocks(df: DataFrame, *keys: str) -> DataFrame:
    """(*keys, block, bits, n): records by keys, 64 numbers to a row; bits has one for each number that occurs, n counts rows. A subject's records are reduced where they are read."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in keys]
    rows = df.withColumn("seq", F.col("seq").cast("bigint")).select(*texts, F.shiftright("seq", 6).alias("block"), F.expr(_BIT).alias("_bit"))
    return rows.groupBy(*keys, "block").agg(F.bit_or("_bit").alias("bits"), F.count("*").alias("n"))


def record_blocks(ctx: dict) -> DataFrame:
    """(domain, usubjid, v, block, bits, n): every record of every domain, in blocks of a subject, visit and 64 numbers."""
    return _blocks(_records(ctx), "domain", "usubjid", "v")


def compared_blocks(ctx: dict) -> DataFrame:
    """(usubjid, testcd, r_unit, lab, block, bits, n): the results that were compared, in blocks of a subject, range and 64 numbers."""
    return _blocks(_compared(ctx), "usubjid", "testcd", "r_unit", "lab")


def _counted(blocks: DataFrame) -> DataFrame:
    """One row: how many records, records with visits, pairs of both, subjects, visits and subjects with visits there are, with the first and last ids."""
    with_visit = blocks.where("v <> ''")
    held = blocks.groupBy("domain", "usubjid", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or(F.when(F.col("v") != "", F.col("bits"))).alias("seen"), F.sum(F.when(F.col("v") != "", F.bit_count("bits"))).alias("at"), F.sum("n").alias("n"))
    held = held.withColumn("_q", F.expr(_NUMBERS))
    of = lambda q: node_id("RECORD", F.col("domain"), F.col("usubjid"), q)
    records = held.agg(F.sum("n").alias("n_rows"), F.sum(F.bit_count("bits")).alias("n_records"), F.sum(F.bit_count("seen")).alias("n_seen"), F.sum("at").alias("n_at"), F.min(of(F.array_min("_q"))).alias("first_record"), F.max(of(F.array_max("_q"))).alias("last_record"))
    pairs = with_visit.select("usubjid", "v").distinct()
    ids = pairs.select(node_id("VISIT", F.col("usubjid"), F.col("v")).alias("id")).distinct().agg(F.count("*").alias("n_visits"), F.min("id").alias("first_visit"), F.max("id").alias("last_visit"))
    subjects = lambda df, name: df.select("usubjid").distinct().agg(F.count("*").alias(name))
    return records.join(ids).join(pairs.agg(F.count("*").alias("n_pairs"))).join(subjects(blocks, "n_subjects")).join(subjects(with_visit, "n_visitors"))


def _rows(df: DataFrame, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """One row as several, those that count nothing left out."""
    return df.select(F.explode(F.array(*[F.struct(*[(F.lit(v) if i == 0 else F.coalesce(v, F.lit(0)) if names[i].startswith("n") else F.col(v)).alias(names[i]) for i, v in enumerate(row)]) for row in rows])).alias("_r")).select("_r.*").where("n > 0")


def edge_counts(ctx: dict, blocks: DataFrame, compared: DataFrame) -> DataFrame:
    """(type, n, n_src, n_dst, first_dst): what grouping edges(ctx) by type gives, from record_blocks and compared_blocks: records' edges are counted as bits, without their ids."""
    study = _all(_study_edges(ctx)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"), F.min("dst").alias("first_dst"))
    of_records = _rows(_counted(blocks), ("type", "n", "n_src", "n_dst", "first_dst"), [("HAS_RECORD", "n_records", "n_subjects", "n_records", "first_record"), ("AT_VISIT", "n_at", "n_seen", "n_visits", "first_visit"), ("HAS_VISIT", "n_pairs", "n_visitors", "n_visits", "first_visit")])
    results = compared.groupBy("usubjid", "block").agg(F.bit_or("bits").alias("bits"), F.sum(F.bit_count("bits")).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits")).alias("n_src"))
    ranges = compared.select(node_id("REFERENCE_RANGE", F.col("testcd"), F.col("r_unit"), F.col("lab")).alias("id")).distinct().agg(F.count("*").alias("n_dst"), F.min("id").alias("first_dst"))
    return _all([study, of_records, _rows(results.join(ranges), ("type", "n", "n_src", "n_dst", "first_dst"), [("COMPARED_TO", "n", "n_src", "n_dst", "first_dst")])])


def node_counts(ctx: dict, blocks: DataFrame) -> DataFrame:
    """(kind, n, n_distinct, first_id, last_id): what grouping nodes(ctx) by kind gives; visits and records come from record_blocks."""
    study = _all(_study_nodes(ctx)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return study.unionByName(_rows(_counted(blocks), ("kind", "n", "n_distinct", "first_id", "last_id"), [("VISIT", "n_pairs", "n_visits", "first_visit", "last_visit"), ("RECORD", "n_records", "n_records", "first_record", "last_record")]))


def neighbours(e: DataFrame, ids: DataFrame, kind: str | None = None, backwards: bool = False) -> DataFrame:
    """(id, type, other): one hop from the ids, along edges or against them; an id asked twice counts once."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    e = e if kind is None else e.where(F.col("type") == kind)
    return e.join(ids, e[a] == ids.id, "left_semi").select(F.col(a).alias("id"), "type", F.col(b).alias("other"))


def related(records: DataFrame, column: str, value: str, source: str | None = None) -> DataFrame:
    """(usubjid, seq, is_source): a subject's first record whose column holds the value, the source subject first."""
    hit = records.where(F.upper(column).contains(value.upper())).groupBy("usubjid").agg(F.min("seq").alias("seq"))
    return hit.withColumn("is_source", F.col("usubjid") == F.lit(source)).orderBy(F.desc("is_source"), "usubjid")


#: The tables and columns that each kind of entity is looked up in; a value is found in part of them, a visit by its code.
ENTITIES = {
    "medication": ("cm", ("trt",)), "lab": ("lb", ("testcd",)), "adverse_event": ("ae", ("term",)), "visit": ("visits", ("visit",)), "exposure": ("ex", ("dose", "full_dose", "trt")),
    "medical_history": ("mh", ("term",)), "disposition": ("ds", ("decod",)), "finding": ("findings", ("code",)),
}


def related_by(ctx: dict, entity: str, value: str, source: str | None = None) -> DataFrame:
    """(usubjid, seq, is_source): subjects connected with a medication, laboratory test, adverse event, visit, dose, history, disposition or finding."""
    table, columns = ENTITIES[entity]
    df = ctx[table]
    if entity == "visit":
        return related(df.where(F.col("visit") == N.visit_code(F.lit(value))), "visit", "", source)
    if entity == "exposure":
        df = df.withColumn("full_dose", F.concat_ws(" ", "dose", "unit"))
    text = F.lit("")
    for c in columns:
        text = F.concat_ws("\n", text, c) if c in df.columns else text
    return related(df.withColumn("_text", text), "_text", value.strip(), source)


def patient(ctx: dict, usubjid: str) -> dict[str, DataFrame]:
    """Everything known of a subject, section by section; an unknown one has empty sections."""
    own = lambda df: df.where(F.col("usubjid") == usubjid)
    visits = ctx["visits"].groupBy("usubjid", "visit").agg(F.min("date").alias("date"), F.sort_array(F.collect_set("domain")).alias("domains"))
    sections = {
        "demographics": ctx["dm"], "site": ctx["dm"].select("usubjid", "siteid"), "person": ctx["persons"], "visits": visits, "labs": ctx["labs"], "vitals": ctx["vs"], "ecg": ctx["eg"], "exposure": ctx["ex"], "adverse_events": ctx["ae"], "conmeds": ctx["cm"], "medical_history": ctx["mh"],
        "disposition": ctx["ds"], "findings": ctx["findings"], "evidence_refs": ctx["findings"].where("domain is not null").select("usubjid", "domain", "seq").distinct(),
    }
    out = {name: own(df) for name, df in sections.items()}
    for name in ("site_replies", "monitor_decisions"):  # keys are parts joined by |
        if name in ctx:
            out[name] = ctx[name].where(F.array_contains(F.split("key", r"\|"), usubjid))
    return out


#: Subjects of whom one task holds all records.
SUBJECTS_A_TASK = 2000
#: Up to so many subjects, records of others are left out before they move.
FEW_SUBJECTS = 50_000


def patients(ctx: dict, subjects: DataFrame) -> DataFrame:
    """(usubjid, found, sections): the sections of many subjects at once, each an array of its records as JSON in order of seq; what is missing is an empty array.

    All sections' records and the subjects asked are one union that is grouped once; a subject's own records are what one
    row holds, and a task holds about SUBJECTS_A_TASK subjects, however many are asked. A subject that the study doesn't
    know has found false and no sections.
    """
    visits = ctx["visits"].groupBy("usubjid", "visit").agg(F.min("date").alias("date"), F.sort_array(F.collect_set("domain")).alias("domains")).withColumn("seq", F.lit(None).cast("bigint"))
    tables = {
        "demographics": ctx["dm"], "person": ctx["persons"], "visits": visits, "labs": ctx["lb"], "vitals": ctx["vs"], "ecg": ctx["eg"], "exposure": ctx["ex"], "adverse_events": ctx["ae"], "conmeds": ctx["cm"], "medical_history": ctx["mh"], "disposition": ctx["ds"], "findings": ctx["findings"],
    }
    asked = subjects.select("usubjid").distinct()
    n = asked.count()
    own = (lambda df: df.join(F.broadcast(asked), "usubjid", "left_semi")) if n <= FEW_SUBJECTS else (lambda df: df.where("usubjid is not null"))
    none = F.lit(None)
    told = [asked.select("usubjid", F.lit("").alias("section"), none.cast("bigint").alias("seq"), none.cast("string").alias("record"))]
    for name, df in tables.items():
        seq = F.col("seq").cast("bigint") if "seq" in df.columns else none.cast("bigint")
        row = F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("usubjid", "seq", "row_no", "cut_available", "n4", "site")]))
        told.append(own(df).select("usubjid", F.lit(name).alias("section"), seq.alias("seq"), row.alias("record")))
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SUBJECTS_A_TASK))
    held = _all(told).repartition(parts, "usubjid").groupBy("usubjid").agg(F.sort_array(F.collect_list(F.struct("section", "seq", "record"))).alias("_r"))
    held = held.where(F.exists("_r", lambda x: x["section"] == ""))
    section = lambda name: F.transform(F.filter("_r", lambda x: x["section"] == name), lambda x: F.struct(x["seq"].alias("seq"), x["record"].alias("record")))
    return held.select("usubjid", (F.size(section("demographics")) > 0).alias("found"), F.struct(*[section(name).alias(name) for name in tables]).alias("sections"))
