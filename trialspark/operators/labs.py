"""Laboratory results: parsed values, unit conversion, reference ranges, multiples of the upper limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N

#: Fixed values: (test or null for any, from, to, factor); inverses are added.
CONVERSIONS = (
    (None, "ukat/L", "U/L", 60.0),
    ("BILI", "mg/dL", "umol/L", 17.104),
    ("CREAT", "mg/dL", "umol/L", 88.42),
    ("GLUC", "mg/dL", "mmol/L", 1 / 18.0182),
)
CENTRAL = "CENTRAL"


def conversions(spark, more: tuple = ()) -> DataFrame:
    """(c_test, c_from, c_to, factor): both directions, canonical units; later ones win."""
    known: dict = {}
    unit = lambda u: "".join(u.split()).replace("µ", "u").replace("μ", "u").lower()
    for test, a, b, factor in (*CONVERSIONS, *more):
        known[test, unit(a), unit(b)] = factor
        known[test, unit(b), unit(a)] = 1 / factor
    return spark.createDataFrame([(*k, v) for k, v in known.items()], "c_test string, c_from string, c_to string, factor double")


#: How a manual says that one unit is so many of another.
VERBS = (("=",), ("→",), ("->",), ("equals",), ("is", "equal", "to"), ("is",))


def learn(text) -> F.Column:
    """ARRAY of (from, factor, to) that a manual's sentences state, as '1 ukat/L = 60 U/L'; a comma is a decimal comma.

    The text becomes words, with blanks around signs and between a number and what follows it. A statement is the word 1,
    a unit, a verb, a number and a unit; a unit is a word of letters, % and /.
    """
    apart = F.regexp_replace(F.regexp_replace(text, r"(->|→|=)", " $1 "), r"(?<=\d)(?=[\p{L}%])", " ")
    words = F.transform(F.split(apart, r"\s+"), lambda w: F.btrim(w, F.lit(".,;:()[]*`\"'")))

    def told(w):
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        is_unit = lambda u: (u != "") & (F.regexp_replace(u, r"[\p{L}%/]+", "") == "")

        def from_here(i):
            held = F.lit(0)
            for verb in reversed(VERBS):
                same = F.lit(True)
                for k, word in enumerate(verb):
                    same = same & (F.lower(at(i + 2 + k)) == word)
                held = F.when(same, F.lit(len(verb))).otherwise(held)
            factor = F.replace(at(i + 2 + held), F.lit(","), F.lit(".")).try_cast("double")
            good = (at(i) == "1") & is_unit(at(i + 1)) & (held > 0) & is_unit(at(i + 3 + held)) & factor.isNotNull()
            return F.when(good, F.struct(N.canonical_unit(at(i + 1)).alias("from"), factor.alias("factor"), N.canonical_unit(at(i + 3 + held)).alias("to")))

        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), from_here)

    return F.filter(N.let(words, told), lambda x: x.isNotNull() & (x["from"] != x["to"]) & (x["factor"] != 0))


def learned(documents: DataFrame) -> DataFrame:
    """(c_from, c_to, factor), both ways, of documents (name, kind, text)' laboratory manuals; the last by name and place wins."""
    told = documents.where("kind = 'lab_manual'").select("name", F.posexplode(learn(F.col("text"))).alias("at", "l")).select("name", "at", "l.*")
    both = told.select("name", "at", F.col("from").alias("c_from"), F.col("to").alias("c_to"), "factor").unionByName(told.select("name", "at", F.col("to").alias("c_from"), F.col("from").alias("c_to"), (1 / F.col("factor")).alias("factor")))
    return both.groupBy("c_from", "c_to").agg(F.max_by("factor", F.struct("name", "at")).alias("factor"))


def convert(df: DataFrame, test: str, source: str, target: str, table: DataFrame) -> DataFrame:
    """df with `factor` from source to target unit: 1 if equal, the test's own, the general one, else null."""
    own = table.where("c_test is not null").withColumnRenamed("factor", "_own")
    any_ = table.where("c_test is null").drop("c_test").withColumnRenamed("factor", "_any")
    a, b = N.canonical_unit(F.col(source)), N.canonical_unit(F.col(target))
    out = df.withColumn("_a", a).withColumn("_b", b)
    out = out.join(own, (F.col(test) == own.c_test) & (F.col("_a") == own.c_from) & (F.col("_b") == own.c_to), "left").drop("c_test", "c_from", "c_to")
    out = out.join(any_, (F.col("_a") == any_.c_from) & (F.col("_b") == any_.c_to), "left").drop("c_from", "c_to")
    return out.withColumn("factor", F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(F.coalesce("_own", "_any"))).drop("_a", "_b", "_own", "_any")


def with_ranges(lb: DataFrame, ranges: DataFrame, manuals: DataFrame | None = None) -> DataFrame:
    """lb with its parsed value, date, and the reference range that holds for it.

    A site's own ranges for a test stand for the central ones there; of a laboratory's ranges the first in the
    result's unit is taken, else the first that it converts to. status: ok, no_range, no_conversion, or the kind
    of value that can't be compared. Conversions that manuals (see learned) state go before the built-in general ones.
    """
    table = conversions(lb.sparkSession)
    if manuals is not None:
        general = table.c_test.isNull() & (table.c_from == manuals.c_from) & (table.c_to == manuals.c_to)
        table = table.join(manuals, general, "left_anti").unionByName(manuals.withColumn("c_test", F.lit(None).cast("string")))
    parsed = N.lab_value(F.col("orres"))
    lb = lb.withColumn("_v", parsed).withColumn("_d", N.date_of(F.col("dtc")))
    lb = lb.select(*[c for c in lb.columns if c not in ("_v", "_d")], F.col("_v.kind").alias("kind"), F.col("_v.value").alias("value"), F.col("_d").alias("date"))
    own = ranges.where(F.col("lab") != CENTRAL).select(F.col("testcd").alias("_t"), F.col("lab").alias("_l")).distinct()
    labs = lb.join(own, (lb.testcd == own._t) & (lb.site == own._l), "left").withColumn("_lab", F.coalesce("_l", F.lit(CENTRAL))).drop("_t", "_l")
    units = labs.select("testcd", "unit", "_lab").distinct()
    r = ranges.select(F.col("testcd").alias("_t"), F.col("unit").alias("r_unit"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col("lab").alias("_l"), F.col("row_no").alias("_n"))
    pairs = convert(units.join(r, (units.testcd == F.col("_t")) & (units._lab == F.col("_l")), "left"), "testcd", "unit", "r_unit", table)
    best = W.partitionBy("testcd", "unit", "_lab").orderBy(F.when(N.canonical_unit(F.col("unit")) == N.canonical_unit(F.col("r_unit")), 0).when(F.col("factor").isNotNull(), 1).otherwise(2), "_n")
    picked = pairs.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_t", "_l", "_n")  # one row a test, unit and laboratory
    picked = picked.withColumnsRenamed({"testcd": "_pt", "unit": "_pu", "_lab": "_pl"})
    out = labs.join(picked, (F.col("testcd") == F.col("_pt")) & F.col("unit").eqNullSafe(F.col("_pu")) & (F.col("_lab") == F.col("_pl")), "left").drop("_pt", "_pu", "_pl", "_lab")
    status = F.when(F.col("kind") != "numeric", F.col("kind")).when(F.col("r_unit").isNull(), "no_range").when(F.col("factor").isNull(), "no_conversion").otherwise("ok")
    std = F.when(status == "ok", F.col("value") * F.col("factor"))
    return out.withColumn("status", status).withColumn("std_value", std).withColumn("multiple", std / F.col("high")).withColumn("flag", F.when(std > F.col("high"), "HIGH").when(std < F.col("low"), "LOW").when(std.isNotNull(), "NORMAL"))


def central(labs: DataFrame, ranges: DataFrame) -> DataFrame:
    """labs (see with_ranges) with central_unit, central_value and central_flag: each numeric result in the central laboratory's unit, against its range, whatever range holds at the site.

    Of a test's central ranges the first by row_no counts; without one, or without a conversion, the columns are null.
    """
    first = ranges.where(F.col("lab") == CENTRAL).groupBy("testcd").agg(F.min_by(F.struct(F.col("unit"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")), "row_no").alias("_c"))
    held = labs.drop("factor").join(first.withColumnRenamed("testcd", "_ct"), F.col("testcd") == F.col("_ct"), "left").drop("_ct").withColumn("central_unit", F.col("_c.unit"))
    out = convert(held, "testcd", "unit", "central_unit", conversions(labs.sparkSession)).withColumn("central_value", F.when(F.col("kind") == "numeric", F.col("value") * F.col("factor")))
    flag = F.when(F.col("central_value") > F.col("_c.high"), "HIGH").when(F.col("central_value") < F.col("_c.low"), "LOW").when(F.col("central_value").isNotNull(), "NORMAL")
    return out.withColumn("central_flag", flag).drop("_c")


def abnormal(labs: DataFrame, test: str, direction: str = "high", multiple: float | None = None, site: str | None = None) -> DataFrame:
    """A test's results beyond the range, or beyond a multiple of the upper limit (strictly)."""
    out = labs.where(F.col("testcd") == test)
    out = out.where(F.col("std_value") > multiple * F.col("high")) if multiple is not None else out.where(F.col("flag") == direction.upper())
    return out if site is None else out.where(F.col("site") == site)
