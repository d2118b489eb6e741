"""Scalar normalisation as Column expressions: everything stays in the JVM, raw texts are never changed.

All functions take and return Columns. They are safe under ANSI mode: casts are guarded by patterns and tried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing, and what a laboratory writes for "not detected".
MISSING = ("", "NA", "N/A", "NULL", "NONE", ".")
NOT_DETECTED = ("ND", "N/D", "NOT DONE", "NOTDONE", "NOT DETECTED", "NOTDETECTED", "BLQ", "NA", "N/A", "NOT_DONE", "NOT_DETECTED")
YES = ("Y", "YES", "TRUE", "1")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it; what body's branches don't reach isn't computed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's too."""
    return F.btrim(c, F.lit(BLANKS))


def is_missing(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*MISSING), F.lit(True))


def clean(c: Column) -> Column:
    return F.when(~is_missing(c), strip(c))


def to_upper(c: Column) -> Column:
    return F.when(~is_missing(c), F.upper(strip(c)))


def normalise_row(df, columns: list[str] | None = None):
    """df with its text columns (or these) cleaned: white space at the ends goes, and what counts as missing is null."""
    texts = columns or [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({c: clean(F.col(c)) for c in texts})


def to_int(c: Column) -> Column:
    """'5.0' is 5; '5.5', words, infinities and blanks are null."""
    text = strip(c)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when((number == F.floor(number)) & (F.abs(number) < 9.0e18), number.cast("bigint"))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


#: The formats accepted, in order: name, pattern, and the groups of year, month, day.
DATE_FORMATS = (
    ("ISO", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
    ("ISO_DATETIME", r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]\d{1,2}.*$", (1, 2, 3)),
    ("DD-MON-YYYY", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", (3, 2, 1)),
    ("DD MON YYYY", r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\.?,?\s+(\d{4})$", (3, 2, 1)),
    ("DD-MON-YY", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", None),
    ("YYYY/MM/DD", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    ("DD/MM/YYYY", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
    ("YYYYMMDD", r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
)


def _shapes() -> tuple[str, str]:
    """One pattern of all date formats, and what it is replaced by: year, month and day, then for each format a text that only its match fills."""
    parts, groups, firsts, at = [], ([], [], []), [], 0
    for _, pattern, order in DATE_FORMATS:
        inner = pattern[1:-1] if order else f"({pattern[1:-1]})"
        for held, g in zip(groups, order or ()):
            held.append(at + g)
        firsts.append(at + 1)
        at += re.compile(inner).groups
        parts.append(inner)
    told = ["".join(f"${g}" for g in held) for held in groups]
    return f"(?s)^(?:{'|'.join(parts)})$", "\x1e" + "\x1f".join([*told, *(f"${g}" for g in firsts)])


SHAPES = _shapes()


def parse_date(c: Column) -> Column:
    """STRUCT<raw, date, fmt, ok, reason>: slash dates are day first, two-digit years are ambiguous, times are cut off.

    One replacement names the format and its parts; everything else is comparisons of these.
    """

    def told(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        found = F.size(p) > 1
        fmt = F.lit(None).cast("string")
        for i, (name, *_) in reversed(list(enumerate(DATE_FORMATS))):
            fmt = F.when(found & (part(3 + i) != ""), F.lit(name)).otherwise(fmt)
        month = F.when(part(1).rlike("^[0-9]"), part(1)).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(part(1))).cast("string"))
        year = F.substring(part(0), 2, 4)  # after the mark of a match
        date = F.when(found & (year != "0000"), F.concat_ws("-", year, month, part(2)).try_cast("date"))
        return F.struct(fmt.alias("fmt"), date.alias("date"), F.coalesce(found & (month == "0"), F.lit(False)).alias("named"), F.coalesce(part(0) == "", F.lit(True)).alias("blank"))

    def whole(d: Column) -> Column:
        reason = (
            F.when(d["blank"], "missing").when(d["date"].isNotNull(), F.lit(None)).when(d["fmt"] == "DD-MON-YY", "ambiguous_two_digit_year")
            .when(d["named"], "unknown_month").when(d["fmt"].isNotNull(), "invalid_calendar_date").otherwise("unrecognised_format")
        )
        return F.struct(c.alias("raw"), d["date"].alias("date"), d["fmt"].alias("fmt"), d["date"].isNotNull().alias("ok"), reason.alias("reason"))

    return let(let(F.split(F.regexp_replace(strip(c), SHAPES[0], SHAPES[1]), "\x1f"), told), whole)


def date_of(c: Column) -> Column:
    """parse_date(c)'s date; a plain ISO date, which most are, is read without looking for other formats."""
    return F.when(c.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date")).otherwise(parse_date(c)["date"])


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


#: What a plain number, one with a decimal comma and a limit look like.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
COMMA = r"^-?\d+,\d+$"
CENSORED = r"^(<=|>=|<|>)\s*([+-]?\d+(?:[.,]\d+)?)$"


def lab_value(c: Column) -> Column:
    """STRUCT<raw, kind, value, operator, bound, note>; '<5', 'ND' and blanks are never zero."""
    text = strip(c)
    numeric, comma, limit = text.rlike(NUMBER), text.rlike(COMMA), text.rlike(CENSORED)
    kind = (
        F.when(c.isNull() | (text == ""), "missing").when(numeric | comma, "numeric").when(limit, "censored")
        .when(F.upper(text).isin(*NOT_DETECTED), "not_detected").otherwise("non_numeric")
    )
    value = F.when(numeric, text.try_cast("double")).when(comma, F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    bound = F.when(limit, F.replace(_part(text, CENSORED, 2), F.lit(","), F.lit(".")).try_cast("double"))
    return F.struct(c.alias("raw"), kind.alias("kind"), value.alias("value"), F.when(limit, _part(text, CENSORED, 1)).alias("operator"), bound.alias("bound"), F.when(comma, "comma_decimal").when(kind == "censored", "censored_value_unknown").when(kind == "not_detected", "not_detected_or_not_done").alias("note"))


def number(c: Column) -> Column:
    return lab_value(c)["value"]


def canonical_unit(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(c, "µμ", "uu"), r"(?U)\s+", ""))


def class_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(strip(c)), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")


#: Named visits and how their labels say so: a part that such labels hold, words in a row (the last of them whole unless `-` follows), and words that must be all of it.
NAMED_VISITS = {
    "SCREENING": (("screen",), ("screen-",), ()), "BASELINE": (("baseline", "randomi"), ("baseline", "randomisation", "randomization"), ()),
    "EOS": (("end", "final", "eo"), ("end of study", "end of treatment", "final visit"), ("eos", "eot")),
}
#: Words before a number, and the unit that they name.
VISIT_UNITS = {"week": "WEEK", "wk": "WEEK", "w": "WEEK", "day": "DAY", "d": "DAY"}


def visit_code(c: Column) -> Column:
    """A visit's code from its label: a named visit, a unit with its number (days may be negative), else the label as a token.

    Patterns are tried only on labels that hold a part of theirs.
    """
    counted = rf"(?s)^(?:.*?[^a-z0-9])??({'|'.join(VISIT_UNITS)})[ _]*(-?)[ _-]*([0-9]+)(?![a-z0-9]).*$"
    units = F.create_map(*[F.lit(x) for pair in VISIT_UNITS.items() for x in pair])

    def number(p: Column) -> Column:
        unit = F.try_element_at(units, F.substring(F.get(p, F.lit(0)), 2, 9))
        return F.when(F.size(p) > 1, F.concat(unit, F.when((unit == "DAY") & (F.get(p, F.lit(1)) == "-"), "-").otherwise(""), F.get(p, F.lit(2)).try_cast("bigint").cast("string")))

    def of(label: Column) -> Column:
        code = F.when(F.trim(label) == "", "")
        for name, (parts, phrases, whole) in NAMED_VISITS.items():
            within = "|".join(x[:-1] if x.endswith("-") else x.replace(" ", r"\s*") + "(?![a-z0-9])" for x in phrases)
            may = F.lit(False)
            for x in parts:
                may = may | label.contains(x)
            code = code.when(may & label.rlike(rf"(?:^|[^a-z0-9])(?:{within})" + "".join(rf"|^\s*{x}\s*$" for x in whole)), name)
        return code.otherwise(F.coalesce(let(F.split(F.regexp_replace(label, counted, "\x1e$1\x1f$2\x1f$3"), "\x1f"), number), class_token(c)))

    whole = c.rlike("^(?:SCREENING|BASELINE|EOS|(?:WEEK|DAY)(?:0|[1-9][0-9]{0,8}))$")  # a code already
    return F.when(whole, c).otherwise(let(F.translate(F.lower(c), "−–", "--"), of))


def match_prohibited(cls: Column, treatment: Column, entries: list[str]) -> Column:
    """The first entry that the class, else the treatment, has all tokens of; a bare class doesn't match a narrower entry."""
    out = None
    for candidate in (cls, treatment):
        text = F.upper(candidate)
        for entry in entries:
            held = F.lit(True)
            for word in re.split("[^A-Z0-9]+", entry.upper()):
                held = held & text.rlike(rf"(?:^|[^A-Z0-9]){word}(?![A-Z0-9])") if word else held
            out = F.when(held, F.lit(entry)) if out is None else out.when(held, F.lit(entry))
    return F.lit(None).cast("string") if out is None else out


def site_of(usubjid: Column, siteid: Column | None = None) -> Column:
    tokens = F.split(usubjid, "-")
    derived = F.when(F.size(tokens) >= 3, F.get(tokens, F.lit(1)))
    return derived if siteid is None else F.coalesce(F.when(strip(siteid) != "", strip(siteid)), derived)


def yes_flag(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*YES), F.lit(False))


def arm_key(arm: Column, keys: list[str]) -> Column:
    """An arm label's key among expected doses: equal, then a token or part of it, then by being placebo or not."""
    up = F.upper(strip(arm))
    tokens = F.split(up, "[^A-Z0-9]+")
    out = F.lit(None).cast("string")
    placebo, active = [k for k in keys if "PLACEBO" in k.upper()], [k for k in keys if "PLACEBO" not in k.upper()]
    out = F.when(up.contains("PLACEBO"), F.lit(placebo[0] if len(placebo) == 1 else None)).otherwise(F.lit(active[0] if len(active) == 1 else None))
    for k in reversed(keys):
        own = k.upper()
        part = F.array_contains(tokens, own) | (F.length(up) >= 3) & F.lit(own).contains(up)
        out = F.when(part | up.contains(own) if len(own) >= 3 else part, k).otherwise(out)
    for k in reversed(keys):
        out = F.when(up == k.upper(), k).otherwise(out)
    return F.when(F.coalesce(up, F.lit("")) != "", out)


def confidence(kind: Column, empty: Column, dropped: Column, flagged: Column, missing: Column, insufficient: Column, ambiguous: Column) -> Column:
    """The confidence of an answer, by fixed policy, between 0.05 and 0.95 to three places (half to even)."""
    base = (
        F.when(ambiguous, 0.2).when(insufficient, 0.3).when(empty, 0.85).when(kind.isin("count", "lookup", "finding", "patient360"), 0.9)
        .when(kind == "doc", 0.85).when(kind == "error", 0.05).otherwise(0.7)
    )
    whole = base - F.when(dropped, 0.1).otherwise(0.0) - F.when(flagged, 0.1).otherwise(0.0) - F.when(missing, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.bround(whole, 3)))


#: Sentences that address an automated reader, by the reason reported. What they say is reported and never done.
INSTRUCTIONS = (
    ("addresses automated reviewer", r"automated\s+reviewer"),
    ("addresses automated agent/system", r"automated\s+(agent|system|tool)s?"),
    ("note addressed to reviewers", r"\bnote\s+to\b"),
    ("reviewer directive", r"\breviewers?\s+(must|should|shall|are\s+to)\b"),
    ("directive: do not flag", r"\bdo\s+not\s+flag\b"),
    ("directive: exclusion", r"\bshould\s+be\s+excluded\b"),
    ("directive: exclude from", r"\bexclude\b.*\bfrom\b"),
    ("directive: ignore", r"\bignore\b"),
    ("directive: restart", r"\brestart\b"),
    ("directive: accept values", r"\baccept\s+the\s+values?\b"),
    ("directive: must not be treated", r"\bmust\s+not\s+be\s+treated\b"),
    ("directive: override", r"\boverride\b"),
    ("directive: disregard", r"\bdisregard\b"),
)


#: Fixed value: where a sentence ends within a paragraph: after an end mark, at white space before a capital or an opening mark.
SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z"'(])"""


def sentences(text: Column) -> Column:
    """ARRAY of sentences of each paragraph; paragraphs end at blank lines, white space is squeezed."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"(?U)\s+", " ")))
    return F.filter(F.transform(F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE_END))), strip), lambda s: s != "")


def instruction_reasons(sentence: Column) -> Column:
    """The reasons why a sentence looks like an instruction, joined by '; '; null if none."""
    hits = F.array_compact(F.array(*[F.when(sentence.rlike("(?i)" + p), F.lit(name)) for name, p in INSTRUCTIONS]))
    return F.when(F.size(hits) > 0, F.array_join(hits, "; "))


def sites_mentioned(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(S\d{2})\b"), F.lit(1))))
