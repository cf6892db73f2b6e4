"""Scalar expressions over names, assay cells, dates, identifiers and ledgers. Each takes
and returns Columns and stays inside code generation."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals of the formats that are read.
FORMATION_SUFFIXES = ["formation", "fm", "group", "gp", "member", "mbr", "zone", "unit", "suite", "complex", "sequence", "horizon", "bed", "beds", "assemblage"]
BELOW_DETECTION = ["lod", "bdl", "<lod", "<dl"]
SAMPLE_UNITS = {"%": "pct", "percent": "pct", "pct": "pct", "g/t": "gpt", "gpt": "gpt", "grams_per_tonne": "gpt", "g_t": "gpt", "grams/tonne": "gpt", "ppb": "ppb", "ppm": "ppm"}
QUALITY_UNITS = {"%": "pct", "percent": "pct", "ppm": "ppm", "ppb": "ppb", "ppt": "ppt", "pct": "pct", "g/t": "g/t", "g/tonne": "g/t", "gpt": "g/t", "oz/t": "oz/t", "ozpt": "oz/t", "oz/ton": "oz/t", "kg/t": "kg/t"}
QAQC_PREFIXES = {"Standard": "STD|STAND|OREAS|CRM|CDN|CANMET", "Blank": "BLK|BLANK", "Duplicate": "DUP|FD|CD"}
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lookup(values: dict[str, str], c: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*map(F.lit, chain(*values.items()))), c)


def hole_id(c: Column) -> Column:
    """Upper case without separators; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.trim(c), r"[\s\-_./]+", "")), F.lit(""))


def entity_text(c: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]+", " "))


def formation_name(c: Column) -> Column:
    """Lower case without trailing marks and up to three trailing unit words."""
    s = F.trim(F.regexp_replace(F.lower(collapsed(c)), r"[.,;:]+$", ""))
    for _ in range(3):
        shorter = F.trim(F.regexp_replace(s, rf"[\s\-]+(?:{'|'.join(FORMATION_SUFFIXES)})\.?$", ""))
        s = F.when(shorter == "", s).otherwise(shorter)
    return F.trim(F.regexp_replace(s, r"[.,;:]+$", ""))


def sample_name(c: Column) -> Column:
    """Lower case; all-digit parts between hyphens lose leading zeros."""
    part = lambda p: F.when(p.rlike("^[0-9]{2,}$"), F.regexp_replace(p, "^0+(?=[0-9])", "")).otherwise(p)
    return F.array_join(F.transform(F.split(F.lower(collapsed(c)), "-"), part), "-")


def report_title(c: Column) -> Column:
    return F.lower(collapsed(c))


def sample_unit(c: Column) -> Column:
    """Canonical unit; blank means ppm, unknown units stay, lower-cased."""
    key = F.lower(F.trim(c))
    return F.when(F.coalesce(c, F.lit("")) == "", "ppm").otherwise(F.coalesce(lookup(SAMPLE_UNITS, key), key))


def quality_unit(c: Column) -> Column:
    """Canonical unit; null if blank."""
    key = F.lower(blank_to_null(c))
    return F.coalesce(lookup(QUALITY_UNITS, key), key)


def assay_cell(c: Column) -> Column:
    """struct(value, below, threshold, unparseable): `<x` gives x/2 and its flag, detection
    words give null and the flag, other text is unparseable, blank is null."""
    raw = blank_to_null(c)
    number, limit = raw.try_cast("double"), F.nullif(F.regexp_extract(raw, r"^<\s*(\d+(?:\.\d+)?)$", 1), F.lit("")).try_cast("double")
    word = F.lower(raw).isin(BELOW_DETECTION)
    below = F.coalesce(number.isNull() & (limit.isNotNull() | word), F.lit(False))
    return F.struct(
        F.coalesce(number, limit / 2).alias("value"),
        below.alias("below"),
        F.when(number.isNull(), limit).alias("threshold"),
        (raw.isNotNull() & number.isNull() & ~below).alias("unparseable"),
    )


def qaqc_kind(sample_id: Column, given: Column) -> Column:
    """The given kind, or the one that the sample id's prefix tells."""
    guess = [F.when(F.upper(F.trim(sample_id)).rlike(f"^({p})"), kind) for kind, p in QAQC_PREFIXES.items()]
    return F.coalesce(given, *guess)


def to_ppm(value: Column, factor: Column) -> Column:
    return value * factor


def dip_convention(n: Column, negative: Column, positive: Column) -> Column:
    """Of a file's n dips, so many lie in [-90, 0] and in [0, 90]. Under five values, or
    four fifths negative: down is negative; four fifths positive: down is positive."""
    return F.when((n < 5) | (negative >= 0.8 * n), "down_negative").when(positive >= 0.8 * n, "down_positive").otherwise("ambiguous")


def normal_dip(dip: Column, convention: Column) -> Column:
    return F.when(convention == "down_positive", -dip).otherwise(dip)


def any_date(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """The first format that reads the text, else null; day comes before month."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats])


def delimited(c: Column, mark: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, mark), lambda x: F.trim(x)), lambda x: x != "")


def yes_no(c: Column) -> Column:
    key = F.lower(F.trim(c))
    return F.when(key.isin("yes", "y", "true", "t", "1"), True).when(key.isin("no", "n", "false", "f", "0"), False)


def extension(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1)), F.lit(""))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f]", "")


def uuid_of(text: Column) -> Column:
    """The first 128 bits of a SHA-256, written as a UUID."""
    h = F.sha2(text.cast("binary"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name in a namespace given as a UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def ledger_hash(previous: Column, *fields: Column) -> Column:
    """SHA-256 of the previous hash and the row's fields joined by bars; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (previous, *fields)]).cast("binary"), 256)


def recency(day: Column, today: Column, half_life_years: float = 5.0) -> Column:
    """Halves every half-life; one half where the day is unknown."""
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * F.datediff(today, day) / 365.25 / half_life_years), F.lit(0.5))


def numbers_in(c: Column) -> Column:
    """Distinct decimals outside square-bracket markers, but 0 and 1."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"\[[^\]]*\]", " "), F.lit(r"(?<![\w.])(-?\d+(?:\.\d+)?)(?![\w])"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: ~v.isin(0.0, 1.0)))


def with_conversions(values: Column) -> Column:
    """Each value, and in other units: percent to ppm, grams to ounces, metres to feet, and back."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.array(v, v * 10000, v / 10000, v / 31.1035, v * 31.1035, v * 3.28084, v / 3.28084, F.round(v, 1), F.round(v, 2)))))


def grounded(claims: Column, evidence: Column, tolerance: float) -> Column:
    """Whether each claimed number lies within the tolerance of some evidence."""
    return F.forall(claims, lambda c: F.exists(evidence, lambda e: F.abs(e - c) <= tolerance))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\W+"), lambda w: w != "")) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0))


def has_token(values: Column, token: str) -> Column:
    """Whether a value is the token or holds it as a whole word."""
    return F.exists(values, lambda v: F.lower(v).rlike(rf"\b{token.lower()}\b"))


def ladder(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern found in a lower-cased text."""
    return reduce(lambda out, r: F.when(F.lower(c).rlike(r[0]), r[1]).otherwise(out), reversed(rules), F.lit(default))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def sentence(template: str, **values: Column) -> Column:
    """A template with {name} places; a null value leaves out the whole bracketed part it is
    in, as in `Hole {hole}[ to {depth} m].`"""
    out = []
    for k, part in enumerate(template.replace("]", "[").split("[")):
        bits = [values[b] if i % 2 else F.lit(b) for i, b in enumerate(part.replace("}", "{").split("{"))]
        text = F.concat(*[b.cast("string") for b in bits])
        out.append(F.coalesce(text, F.lit("")) if k % 2 else text)
    return F.concat(*out)


def dominant(values: Column, groups: dict[str, str]) -> Column:
    """The group that most of the values belong to; of equals, the one met first."""
    mapped = F.filter(F.transform(values, lambda v: lookup(groups, F.lower(F.trim(v)))), lambda g: g.isNotNull())
    ranked = F.transform(F.array_distinct(mapped), lambda g: F.struct((-F.size(F.filter(mapped, lambda m: m == g))).alias("n"), F.array_position(mapped, g).alias("at"), g.alias("g")))
    return F.get(F.array_sort(ranked), F.lit(0))["g"]
