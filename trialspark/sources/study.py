"""Study directories: tolerant CSV domains, side tables, JSON lookups, documents, signatures; state and report sinks.

Everything is read as text, through Hadoop file systems, so a study may lie in any store that Spark reads.
"""

from __future__ import annotations

import csv
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N

SIDE_TABLES = ("corrections", "cuts", "reference_ranges")


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files in a folder; none if it doesn't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return []
    return sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile())


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def discover(spark: SparkSession, study: str) -> dict[str, str]:
    """domain -> path: CSV files whose stem is upper case, side tables apart."""
    return {stem(p): p for p, *_ in _listing(spark, f"{study}/data") if p.lower().endswith(".csv") and stem(p).isupper() and stem(p).lower() not in SIDE_TABLES}


ROW = (1 << 33) - 1  # the bits of a row's number within its task, in monotonically_increasing_id


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows as text with row_no (from 2, blank rows not counted) and malformed.

    A byte-order mark and blanks around headers go; headers may be quoted; short rows are padded and long ones cut, and
    both are marked malformed; blank rows are skipped; nulls become the empty text. An empty file gives no columns but
    these. A file is read by as many tasks as it has splits: a row's number is its number within its split, after the
    rows of the splits before, which a first pass counts. Only a file with line breaks within quotes is read by one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"))
    first = raw.where(F.trim(F.replace("value", F.lit("\ufeff"), F.lit(""))) != "").select("value", "_line").limit(1).collect()
    header = [h.strip() for h in next(csv.reader([first[0].value.lstrip("\ufeff")], skipinitialspace=True))] if first else []
    header = [h or f"column_{i}" for i, h in enumerate(header)]
    if not header:
        return spark.createDataFrame([], "row_no bigint, malformed boolean")
    schema = ", ".join(f"`{h}` string" for h in header) + ", _malformed string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "escape": '"', "emptyValue": ""}
    whole = raw.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count() == 0
    if whole:
        rows = raw.where(F.col("_line") != first[0]["_line"]).select("_at", F.from_csv("value", F.lit(schema), options).alias("_r")).select("_at", "_r.*")
    else:
        rows = spark.read.schema(schema).options(**options, header=True, enforceSchema=True, multiLine=True).csv(path).withColumn("_at", F.lit(0))
    blank = F.lit(True)
    for h in header:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{h}`")), F.lit("")) == "")
    kept = rows.where(~blank).withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33))
    sums, before = [], 0
    for r in sorted(kept.groupBy("_task").agg(F.min("_at").alias("at"), F.count("*").alias("n")).collect(), key=lambda r: (r.at, r["_task"])):  # a row a split
        sums.append((r["_task"], before))
        before += r.n
    kept = kept.join(F.broadcast(spark.createDataFrame(sums, "_task bigint, _before bigint")), "_task")
    number = F.col("_before") + F.col("_id").bitwiseAND(F.lit(ROW)) + 2
    return kept.select(*[F.coalesce(N.strip(F.col(f"`{h}`")), F.lit("")).alias(h) for h in header], number.cast("bigint").alias("row_no"), F.col("_malformed").isNotNull().alias("malformed"))


def load_domain(spark: SparkSession, domain: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): rows without a subject are rejected; others carry seq, cut_available and their issues, repeats included."""
    rows = read_csv(spark, path)
    seq_column = f"{domain}SEQ"
    has = set(rows.columns)
    seq = N.to_int(F.col(seq_column)) if seq_column in has else F.lit(None).cast("bigint")
    cut = N.to_int(F.col("cut_available")).cast("int") if "cut_available" in has else F.lit(None).cast("int")
    subject = F.col("USUBJID") if "USUBJID" in has else F.lit("")
    rows = rows.withColumn("usubjid_", subject).withColumn("seq", seq).withColumn("cut_", cut)
    kept = rows.where("usubjid_ <> ''")
    again = F.row_number().over(W.partitionBy("usubjid_", "seq").orderBy("row_no")) > 1
    issues = F.array_compact(F.array(
        F.when(F.lit(domain != "DM") & F.col("seq").isNull(), f"missing_or_invalid_{seq_column}"), F.when(F.col("cut_").isNull(), "missing_cut_available"), F.when(again, "duplicate_key"), F.when(F.col("malformed"), "malformed_row"),
    ))
    records = kept.withColumn("issues", issues).withColumn("domain", F.lit(domain)).drop("cut_available", "malformed").withColumnRenamed("cut_", "cut_available").drop("usubjid_")
    return records, rows.where("usubjid_ = ''").drop("usubjid_", "cut_")


def load_study(spark: SparkSession, study: str) -> dict[str, DataFrame]:
    return {d: load_domain(spark, d, p)[0] for d, p in discover(spark, study).items()}


def load_report(spark: SparkSession, study: str) -> DataFrame:
    """(domain, rows_read, rows_kept, malformed, duplicates)."""
    out = None
    for d, p in discover(spark, study).items():
        kept, rejected = load_domain(spark, d, p)
        one = kept.agg(F.count("*").alias("rows_kept"), F.count_if(F.array_contains("issues", "malformed_row")).alias("_m"), F.count_if(F.array_contains("issues", "duplicate_key")).alias("duplicates"))
        one = one.join(rejected.agg(F.count("*").alias("_r"))).select(F.lit(d).alias("domain"), (F.col("rows_kept") + F.col("_r")).alias("rows_read"), "rows_kept", (F.col("_m") + F.col("_r")).alias("malformed"), "duplicates")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "domain string, rows_read bigint, rows_kept bigint, malformed bigint, duplicates bigint")


def side_table(spark: SparkSession, study: str, name: str) -> DataFrame:
    return read_csv(spark, f"{study}/data/{name}.csv").drop("malformed")


def replies(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """((key, status, text), default status) of a reply file; a missing or broken one is empty and pending."""
    empty = spark.createDataFrame([], "key string, status string, text string")
    if not _listing(spark, path):
        return empty, "PENDING"
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "replies map<string, array<string>>, _default array<string>").alias("j"))
    default = parsed.select(F.get("j._default", F.lit(0))).first()[0] or "PENDING"
    return parsed.select(F.explode("j.replies").alias("key", "v")).select("key", F.get("v", F.lit(0)).alias("status"), F.get("v", F.lit(1)).alias("text")), default


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(key, decision, reason) of a monitor's decision file."""
    if not _listing(spark, path):
        return spark.createDataFrame([], "key string, decision string, reason string")
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "decisions map<string, array<string>>").alias("j"))
    return parsed.select(F.explode("j.decisions").alias("key", "v")).select("key", F.get("v", F.lit(0)).alias("decision"), F.get("v", F.lit(1)).alias("reason"))


#: How a document's own heading says what it is.
KINDS = (("protocol", r"(?i)^\s*#*[^\n]*\bprotocol\b"), ("lab_manual", r"(?i)^\s*#*[^\n]*\b(?:laboratory|lab) manual\b"), ("sap", r"(?i)^\s*#*[^\n]*\bstatistical analysis plan\b"))


def document_kind(name, text):
    """A document's kind by its name, else by its first line."""
    low = F.lower(name)
    kind = F.when(low.contains("protocol"), "protocol").when(low.contains("manual") | low.contains("lab"), "lab_manual").when(low.contains("sap"), "sap")
    for told, pattern in KINDS:
        kind = kind.when(text.rlike(pattern), told)
    return kind.otherwise("other")


def documents(spark: SparkSession, study: str) -> DataFrame:
    """(name, kind, version, text) of the Markdown documents."""
    paths = [p for p, *_ in _listing(spark, f"{study}/documents") if p.lower().endswith(".md")]
    if not paths:
        return spark.createDataFrame([], "name string, kind string, version int, text string")
    raw = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[Mm][Dd]$", 1).alias("name"), F.col("value").alias("text"))
    low = F.lower("name")
    return raw.select("name", document_kind(F.col("name"), F.col("text")).alias("kind"), F.nullif(F.regexp_extract(low, r"v(\d+)$", 1), F.lit("")).try_cast("int").alias("version"), "text")


def signature(spark: SparkSession, study: str) -> str:
    """A digest of all files' names, sizes and times: it changes when the data do."""
    files = [x for part in ("data", "documents", "responses") for x in _listing(spark, f"{study}/{part}")]
    return hashlib.sha1("\n".join(f"{p.rsplit('/', 2)[-2]}/{p.rsplit('/', 1)[-1]}|{n}|{t}" for p, n, t in files).encode()).hexdigest()


def save_state(df: DataFrame, path: str, cut: int) -> None:
    """State of a cut as its own folder: writing a cut again replaces it and no other."""
    df.write.mode("overwrite").parquet(f"{path}/cut={cut}")


def add_state(df: DataFrame, path: str, cut: int) -> None:
    """More state of a cut; a cut run again adds only what is new."""
    df.write.mode("append").parquet(f"{path}/cut={cut}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written there to its end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(conf).exists(where)


def keep_only(spark: SparkSession, path: str, name: str) -> None:
    """Remove what lies in a folder but for one name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if fs.exists(where):
        for s in fs.listStatus(where):
            if s.getPath().getName() != name:
                fs.delete(s.getPath(), True)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; only a local master may do without that setting."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_json(df: DataFrame, path: str) -> None:
    """Decisions and traces as JSON lines."""
    df.write.mode("append").json(path)


def report(title: str, rows: list, columns: list[str]) -> str:
    """A Markdown table of aggregated rows."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)]) + "\n"
