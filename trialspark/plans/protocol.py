"""Protocol documents: sections, the parameters they state, and what differs between versions.

A study has a handful of documents of a few pages; they are read on the driver, and only their parameters reach
the data. Sentences that address automated readers are reported and change nothing.
"""

from __future__ import annotations

import re
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators.rules import Rules

HEADING = re.compile(r"^#{1,6}\s+(?:(\d+(?:\.\d+)*)[.)]?\s+)?(.+?)\s*$")


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")


def sections(text: str) -> dict[str, tuple[str, str]]:
    """key -> (title, text): numbered headings by number, others by slug, repeats with -2, -3; without headings all is `body`."""
    out: dict[str, tuple[str, list[str]]] = {}
    held: list[str] | None = None
    for line in text.splitlines():
        if m := HEADING.match(line):
            key, n = m[1] or slug(m[2]), 2
            while key in out:
                key, n = f"{m[1] or slug(m[2])}-{n}", n + 1
            held = []
            out[key] = (m[2], held)
        elif held is not None:
            held.append(line)
    if not out:
        return {"body": ("", text.strip())}
    return {k: (t, "\n".join(lines).strip()) for k, (t, lines) in out.items()}


def section_for(parts: dict[str, tuple[str, str]], asked: str) -> str | None:
    """The key of a section by exact key, number, slug of its title, or part of its title."""
    low = asked.strip().lower()
    for same in (lambda k, t: k == asked, lambda k, t: k.lower() == low.lstrip("§ "), lambda k, t: slug(t) == slug(asked), lambda k, t: bool(low) and low in t.lower()):
        for key, (title, _) in parts.items():
            if same(key, title):
                return key
    return None


def _first(pattern: str, text: str, kind=float):
    m = re.search(pattern, text, re.I | re.S)
    return tuple(kind(g) for g in m.groups()) if m else None


def clauses(text: str) -> list[list[str]]:
    """The text's sentences and bullets as words, signs apart from numbers; a point within a number ends nothing."""
    spaced = re.sub(r"([>≥<×*±=(),;:])", r" \1 ", text.replace("−", "-").replace("–", "-"))
    return [c.split() for line in spaced.splitlines() for c in re.split(r"\.(?:\s|$)", line) if c.split()]


def _number(word: str) -> float | None:
    return float(word) if re.fullmatch(r"\d+(?:\.\d+)?", word) else None


#: What a limit may be of: spoken word -> which limit.
LIMITED = {"alt": "transaminase", "ast": "transaminase", "transaminase": "transaminase", "transaminases": "transaminase", "hepatic": "transaminase", "liver": "transaminase", "bilirubin": "bilirubin"}


def limits(words: list[str]) -> list[tuple[str, float]]:
    """(what, multiple) of each "more than so many times ULN" in a clause, of what was named last before it."""
    out, what = [], None
    for i, word in enumerate(words):
        what = LIMITED.get(word.lower().strip(".,"), what)
        if word == ">" and what and len(words) > i + 3 and (n := _number(words[i + 1])) is not None and words[i + 2] in ("×", "x", "X", "*") and words[i + 3].upper().startswith("ULN"):
            out.append((what, n))
    return out


def weeks(words: list[str]) -> list[int]:
    """The numbers after "Week" or "Weeks", as far as commas and "and" go on."""
    out, within = [], False
    for word in words:
        if word.lower() in ("week", "weeks"):
            within = True
        elif within and word.isdigit():
            out.append(int(word))
        elif word not in (",", "and"):
            within = False
    return out


def parse_protocol(text: str) -> Rules:
    """The parameters that a protocol states; what it doesn't state is None, never a default."""
    flat = re.sub(r"[ \t]+", " ", text)
    bullets = [b.strip() for b in re.findall(r"^\s*[-*]\s+(.+)$", flat, re.M)]
    age = _first(r"\bage\D{0,20}?(\d+)\s*(?:-|–|to|and)\s*(\d+)", flat, int)
    hba1c = _first(r"hba1c\D{0,20}between\s*([\d.]+)\s*%?\s*and\s*([\d.]+)\s*%", flat)
    hepatic = next((n for b in bullets for c in clauses(b) for what, n in limits(c) if what == "transaminase"), None)
    creat = next((m for b in bullets if (m := re.search(r"creatinine\D*>\s*([\d.]+)\s*([A-Za-zµμ]+/[A-Za-z]+)", b, re.I))), None)
    schedule = {m[1].upper(): int(m[2].replace("−", "-").replace("–", "-").replace(" ", "")) for m in re.finditer(r"\b([A-Z][a-z]+)\s*\(\s*Day\s*([-−–]?\s*\d+)\s*\)", flat)}
    for title, body in sections(text).values():
        if re.search("schedule|visit", title, re.I) or not title:
            schedule |= {f"WEEK{n}": 7 * n for c in clauses(body) for n in weeks(c)}
    window = _first(r"±\s*(\d+)\s*days?", flat, int)
    banned: list[str] = []
    for title, body in sections(text).values():
        if re.search(r"prohibited|concomitant", title, re.I):
            banned += [re.sub(r"[.;].*$", "", b).strip() for b in re.findall(r"^\s*[-*]\s+(.+)$", body, re.M)]
    law = next((found for c in clauses(flat) if {"transaminase", "bilirubin"} <= (found := dict(reversed(limits(c)))).keys()), {})
    days = _first(r"within\s+(\d+)\s+days", flat, int)
    dose = re.search(r"([\d.]+)\s*(mg|g|mcg|ug)\s*\(\s*([a-z]+)(?:\s+arm)?\s*\)\s*or\s*([\d.]+)\s*(?:mg|g|mcg|ug)\s*\(\s*([a-z]+)(?:\s+arm)?\s*\)", flat, re.I)
    return Rules(
        age_min=age and age[0], age_max=age and age[1], hba1c_min=hba1c and hba1c[0], hba1c_max=hba1c and hba1c[1], hepatic_multiple=hepatic,
        creatinine_max=float(creat[1]) if creat else None, creatinine_unit=creat[2] if creat else None, pregnancy_excluded=any(re.search("pregnan", b, re.I) for b in bullets) or None,
        visit_window_days=window and window[0], transaminase_multiple=law.get("transaminase"), bilirubin_multiple=law.get("bilirubin"), hys_days=days and days[0],
        sae_hosp_rule=bool(re.search(r"AESHOSP\s*=\s*\"?Y", flat) and re.search("serious", flat, re.I)) or None, dose_unit=dose[2] if dose else None,
        expected_dose={dose[3].upper(): float(dose[1]), dose[5].upper(): float(dose[4])} if dose else {}, visit_schedule=schedule, prohibited=tuple(banned),
    )


def section_array(text: Column) -> Column:
    """ARRAY of (section, title, n_lines, text): a text's sections, as sections() has them; of its own lines only, so nothing moves.

    Lines that begin a section are found by number, and a section is the lines up to the next one; numbered headings are
    their own keys, others slugs, and a key that comes again gets -2, -3. A document without headings has its paragraphs
    as sections p1, p2. Lines before the first heading belong to no section.
    """
    line = lambda x, i: F.get(x["l"], i)
    blank = lambda t: F.trim(t) == ""

    def marked(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda t, i: F.when(t.rlike(HEADING.pattern), i)), lambda i: i.isNotNull())
        starts = lambda t, i: F.when(~blank(t) & F.coalesce(blank(F.get(lines, F.when(i > 0, i - 1))), F.lit(True)), i)
        begun = lambda h: F.when(F.size(h) > 0, h).otherwise(F.filter(F.transform(lines, starts), lambda i: i.isNotNull()))
        return N.let(heads, lambda h: F.struct(lines.alias("l"), (F.size(h) > 0).alias("any"), begun(h).alias("at")))

    def cut(x: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            first, end = F.when(x["any"], i + 1).otherwise(i), F.coalesce(F.get(x["at"], k + 1), F.size(x["l"]))
            head = F.when(x["any"], F.struct(F.regexp_extract(line(x, i), HEADING.pattern, 1).alias("number"), F.regexp_extract(line(x, i), HEADING.pattern, 2).alias("title")))
            body = F.slice(x["l"], first + 1, end - first)

            def section(h: Column) -> Column:
                slug_ = F.btrim(F.regexp_replace(F.lower(h["title"]), "[^a-z0-9]+", "-"), F.lit("-"))
                key = F.when(h.isNull(), F.concat(F.lit("p"), (k + 1).cast("string"))).when(h["number"] != "", h["number"]).otherwise(slug_)
                return F.struct(key.alias("key"), F.coalesce(h["title"], F.lit("")).alias("title"), body.alias("body"))

            return N.let(head, section)

        return F.transform(x["at"], one)

    def named(parts: Column) -> Column:
        keys = lambda p: F.transform(p, lambda x: x["key"])

        def of(ks: Column) -> Column:
            repeats = F.size(F.array_distinct(ks)) < F.size(ks)
            again = lambda k, key: F.when(repeats, F.size(F.filter(F.slice(ks, 1, k + 1), lambda y: y == key))).otherwise(1)
            section = lambda x, k: N.let(again(k, x["key"]), lambda n: F.when(n > 1, F.concat(x["key"], F.lit("-"), n.cast("string"))).otherwise(x["key"]))
            n_lines = lambda x: F.size(F.filter(x["body"], lambda t: ~blank(t))).cast("bigint")
            return F.transform(parts, lambda x, k: F.struct(section(x, k).alias("section"), x["title"].alias("title"), n_lines(x).alias("n_lines"), F.btrim(F.array_join(x["body"], "\n"), F.lit(" \t\n")).alias("text")))

        return N.let(keys(parts), of)

    return N.let(N.let(N.let(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), marked), cut), named)


def section_table(documents: DataFrame) -> DataFrame:
    """(name, section, title, n_lines, text) of all documents (name, text) at once: each row's sections, without a shuffle."""
    return documents.select("name", F.explode(section_array(F.col("text"))).alias("_s")).select("name", "_s.*")


#: What a section says if it states the parameter of a rule: words that its sentence holds, and how the value stands in it.
STATED = (
    ("VISIT_WINDOW_DEVIATION", "visit_window_days", r"(?i)window[^.\n]*?(\d+) days?"), ("ELIGIBILITY_VIOLATION", "age_min", r"(?i)\bage (\d+)"), 
    ("HYS_LAW_CANDIDATE", "hys_days", r"(?i)bilirubin[^.\n]*? within (\d+) days?"), ("DOSING_ERROR", "expected_dose", r"(?i)dose other than (\d+(?:\.\d+)?) ?mg"), ("SERIOUS_AE", "sae_hosp_rule", r"(AESHOSP) ?="),
)


#: Under a heading that names prohibited medication, the first item.
PROHIBITED_ITEM = r"\A- ([^\n]+)"


def _told(section: Column, title: Column, text: Column, codes=None) -> list[Column]:
    """What a section says of each rule's parameter (or of some rules'): (code, parameter, value, section), null values where it says nothing."""
    struct = lambda code, name, value: F.struct(F.lit(code).alias("code"), F.lit(name).alias("parameter"), N.let(value, lambda v: F.nullif(v, F.lit(""))).alias("value"), section.alias("section"))
    prohibited = F.when(F.lower(title).contains("prohibited"), F.regexp_extract(text, PROHIBITED_ITEM, 1))
    stated = [(code, name, F.regexp_extract(text, pattern, 1)) for code, name, pattern in STATED]
    return [struct(*one) for one in (*stated, ("PROHIBITED_MEDICATION", "prohibited", prohibited)) if codes is None or one[0] in codes]


def references(parts: DataFrame) -> DataFrame:
    """(name, code, parameter, value, section): which section of a document states the parameter of a rule, and what it says; the first section by key, if more do."""
    each = parts.select("name", F.explode(F.array(*_told(F.col("section"), F.col("title"), F.col("text")))).alias("_t")).select("name", "_t.*").where("value is not null")
    return each.groupBy("name", "code", "parameter").agg(F.min_by("value", "section").alias("value"), F.min("section").alias("section"))


def document_references(documents: DataFrame, codes=None) -> DataFrame:
    """references(section_table(documents)), of all rules or some, for documents each of its own name: a document's sections stay in its row, so nothing is shuffled."""
    said = lambda s: F.filter(F.array(*_told(s["section"], s["title"], s["text"], codes)), lambda t: t["value"].isNotNull())
    key = lambda t: F.struct(t["code"].alias("code"), t["parameter"].alias("parameter"), t["section"].alias("section"), t["value"].alias("value"))
    every = F.array_sort(F.transform(F.flatten(F.transform(section_array(F.col("text")), said)), key))
    same = lambda t, o: o.isNotNull() & (o["code"] == t["code"]) & (o["parameter"] == t["parameter"])
    first = lambda a: F.filter(a, lambda t, i: ~F.coalesce(same(t, F.get(a, F.when(i > 0, i - 1))), F.lit(False)))
    return documents.select("name", F.explode(N.let(every, first)).alias("_t")).select("name", "_t.code", "_t.parameter", "_t.value", "_t.section")


def with_references(findings: DataFrame, refs: DataFrame, name) -> DataFrame:
    """findings with doc_ref (name#section) of the document (a Column) that governs them, null where it states nothing; the documents' sections are few rows."""
    r = refs.groupBy("name", "code").agg(F.min("section").alias("_s")).withColumnsRenamed({"name": "_name", "code": "_code"})
    out = findings.withColumn("_doc", name)
    return out.join(r, (F.col("_doc") == F.col("_name")) & (F.col("code") == F.col("_code")), "left").withColumn("doc_ref", F.concat(F.col("_name"), F.lit("#"), F.col("_s"))).drop("_doc", "_name", "_code", "_s")


#: Words that ask for parameters.
SPOKEN = (
    (r"visit window", ("visit_window_days",)), (r"schedule", ("visit_schedule",)), (r"\bage\b", ("age_min", "age_max")), (r"hba1c", ("hba1c_min", "hba1c_max")), (r"creatinine", ("creatinine_max", "creatinine_unit")), (r"prohibited", ("prohibited",)),
    (r"hy'?s.law|liver", ("transaminase_multiple", "bilirubin_multiple", "hys_days")), (r"\bdose", ("expected_dose", "dose_unit")),
)


def told(value) -> str | None:
    """A parameter as text; lists in sorted order."""
    if value is None:
        return None
    if isinstance(value, dict):
        return ",".join(f"{k}={v}" for k, v in sorted(value.items()))
    return ",".join(sorted(map(str, value))) if isinstance(value, (tuple, list)) else str(value)


def diff(spark: SparkSession, old: Rules, new: Rules) -> DataFrame:
    """(field, old, new) of the parameters that differ."""
    rows = [(f.name, told(getattr(old, f.name)), told(getattr(new, f.name))) for f in fields(Rules)]
    return spark.createDataFrame([r for r in rows if r[1] != r[2]], "field string, old string, new string")


def changes(parameters: DataFrame, against: Rules) -> DataFrame:
    """(version, field, old, new) of the parameters, a column each, that differ from these rules; both as text."""
    names = [f.name for f in fields(Rules) if f.name in parameters.columns]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(told(getattr(against, n))).cast("string").alias("old"), F.col(n).cast("string").alias("new")) for n in names]))
    return parameters.select("version", each.alias("_c")).select("version", "_c.*").where(~F.col("old").eqNullSafe(F.col("new")))
