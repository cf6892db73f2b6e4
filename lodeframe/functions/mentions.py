"""What free texts mention: attitudes of structures, coordinates, contractors, laboratories and
qualified persons, and what a question wants. Questions and domains are native expressions;
where a result needs the place of each match, tasks read texts batch by batch."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Words that name a structure, the more specific first, and its type.
STRUCTURES: list[tuple[str, str]] = [
    ("fold axis", "fold_axis"),
    ("lineation", "lineation"),
    ("foliation", "foliation"),
    ("cleavage", "cleavage"),
    ("bedding", "bedding"),
    ("contact", "contact"),
    ("fracture", "fracture"),
    ("joint set", "joint"),
    ("joint", "joint"),
    ("fault zone", "fault"),
    ("fault", "fault"),
    ("shear zone", "shear"),
    ("shear", "shear"),
    ("vein", "vein"),
    ("s1", "foliation"),
    ("s2", "foliation"),
    ("s3", "foliation"),
]
# Quadrants in degrees.
QUADRANTS = {"n": 0, "ne": 45, "e": 90, "se": 135, "s": 180, "sw": 225, "w": 270, "nw": 315}
# Patterns of measurements, the surest first.
_QUAD = r"(?P<quad>NE|NW|SE|SW|N|E|S|W)?"
ATTITUDES: list[tuple[str, str]] = [
    ("kind", r"\b(?P<kind>foliation|cleavage|bedding|joint|fault|shear|vein|contact|fracture|lineation|fold[\s_]axis|s[123])\b\s*[:#]?\s*(?P<strike>\d{1,3})\s*°?\s*[/]\s*(?P<dip>\d{1,2})\s*°?\s*" + _QUAD),
    ("labelled", r"strike[\s:]*?(?P<strike>\d{1,3})\s*°?\s*[,/;]?\s*dip[\s:]*?(?P<dip>\d{1,2})\s*°?\s*" + _QUAD),
    ("core", r"(?:α|alpha)\s*[:=]?\s*(?P<alpha>\d{1,3}(?:\.\d+)?)\s*°?.{0,30}?(?:β|beta)\s*[:=]?\s*(?P<beta>\d{1,3}(?:\.\d+)?)\s*°?"),
    ("bare", r"\b(?P<strike>\d{1,3})\s*[/]\s*(?P<dip>\d{1,2})(?:\s*(?P<quad>NE|NW|SE|SW|N|E|S|W))?\b"),
]
NEAR_STRUCTURE = 40
# Patterns of coordinates and datums, and how near a datum or a word must be.
COORDINATES: list[tuple[str, str]] = [
    ("utm", r"\bZone\s+(\d{1,2})\s*([NS])\s+(\d{6,7})\s*m?\s*E\s+(\d{7,8})\s*m?\s*N\b"),
    ("utm_terse", r"\b(\d{1,2})([NS])\s+(\d{6,7})\s+(\d{7,8})\b"),
    ("latlon_decimal", r"(-?\d{1,3}\.\d+)\s*°?\s*([NS])?\s*,?\s+(-?\d{1,3}\.\d+)\s*°?\s*([EW])?"),
    ("latlon_dms", r"(\d{1,3})\s*°\s*(\d{1,2})\s*'\s*(\d{1,2}(?:\.\d+)?)\s*\"\s*([NS])\s+(\d{1,3})\s*°\s*(\d{1,2})\s*'\s*(\d{1,2}(?:\.\d+)?)\s*\"\s*([EW])"),
]
DATUM, NEAR_DATUM = r"\b(NAD\s*27|NAD\s*83|WGS\s*84)\b", 200
TERSE_CONTEXT, NEAR_CONTEXT = r"\b(UTM|Zone)\b", 50
# Known contractors and laboratories, the longer names first.
CONTRACTORS = ["Boart Longyear", "Major Drilling", "Foraco", "Energold", "Cementation", "Hy-Tech Drilling", "Cabo Drilling", "Hardrock Drills", "Orbit Garant", "Capital Drilling", "Layne Christensen", "Discovery Drilling"]
LABORATORIES = [
    "ALS Geochemistry", "ALS Chemex", "ALS Minerals", "ALS", "SGS Canada", "SGS Minerals", "SGS", "Bureau Veritas", "Activation Laboratories", "Actlabs", "AGAT Laboratories", "AGAT",
    "MS Analytical", "Inspectorate", "Loring Laboratories", "Loring", "TSL Laboratories", "Saskatchewan Research Council", "SRC Geoanalytical", "SRC",
]
# Patterns of names by kind: pattern, least length, names that are none.
_ORG = r"(?P<name>(?:[A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,%d}))"
NAMES: dict[str, list[tuple[str, int, set[str]]]] = {
    "contractor": [
        (r"(?i)\b" + _ORG % 5 + r"\s+(?:was|has been|were|have been)?\s*(?:contracted to|performed|undertook|completed|carried out|conducted)\s+(?:the\s+)?(?:drilling|drill\s*program|drill\s*campaign|diamond\s+drilling|RC\s+drilling|survey|geophysical\s+survey)", 4, {"the", "this", "drilling", "drill program"}),
        (r"(?i)(?:drilling|drill\s*program|drill\s*campaign|survey)\s+(?:was|were)?\s*(?:undertaken|performed|completed|carried out|conducted)\s+by\s+" + _ORG % 5, 4, set()),
    ],
    "laboratory": [(r"(?i)\b(?:analy[sz]ed|assayed|certified|prepared)\s+(?:at|by)\s+" + _ORG % 4, 3, {"the", "this", "all", "drilling"})],
    "person": [
        (r"\b(?P<name>(?:Dr\.?\s+)?[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3})\s*,?\s*(?:(?i:M\.?\s*Sc\.?|Ph\.?\s*D\.?|B\.?\s*Sc\.?|P\.?\s*Geo\.?|P\.?\s*Eng\.?|MAusIMM|MAIG|FAusIMM|Qualified Person|QP|(?:project|exploration|senior|chief|consulting)?\s*geologist)\b)", 5, set()),
        (r"(?i:\b(?:logged|supervised|reviewed|prepared|signed)\s+by\s+(?:Dr\.?\s+|Mr\.?\s+|Ms\.?\s+|Mrs\.?\s+)?)(?P<name>[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3})\b", 5, set()),
    ],
}
GAZETTEERS = {"contractor": CONTRACTORS, "laboratory": LABORATORIES, "person": []}
# Words that are no part of a person's name.
NO_NAMES = {
    "prepared", "prepares", "preparing", "listed", "lists", "listing", "estimated", "estimates", "estimating", "completed", "completes", "completing", "reviewed", "reviews",
    "reviewing", "supervised", "supervises", "supervising", "logged", "logs", "logging", "signed", "signs", "signing", "conducted", "conducts", "conducting", "undertaken",
    "undertook", "undertakes", "undertaking", "performed", "performs", "performing", "authored", "authors", "authoring", "compiled", "compiles", "compiling", "drafted", "drafts",
    "drafting", "approved", "approves", "approving", "submitted", "submits", "submitting", "verified", "verifies", "verifying", "validated", "validates", "validating", "appointed",
    "appoints", "appointing", "the", "this", "that", "these", "those", "their", "his", "her", "by", "of", "in", "on", "at", "for", "with", "from", "was", "were", "is", "are",
    "qualified", "persons", "person", "contents", "appendix", "references", "acknowledgements", "section", "introduction", "summary", "abstract", "senior", "junior", "chief",
    "consulting", "project", "exploration", "geologist", "engineer",
}
# What a question wants, with its phrases, in the order in which equal counts stand;
# how broad a search each needs; and the shapes of hole ids.
INTENTS: dict[str, list[str]] = {
    "decision_support": [r"\bwhat\s+(?:material\s+)?(?:documentation\s+)?gaps?\s+(?:would|might)\b", r"\bdocumentation\s+gaps?\b", r"\bwhich\s+drill\s+targets?\s+(?:would|should|will|might)\b", r"\bwould\s+(?:most\s+)?(?:reduce|prevent|block)\b"],
    "factual_lookup": [r"\bwhat\s+is\b", r"\bwhat\s+are\b", r"\bwhat\s+does\b", r"\bdefine\b", r"\bdefinition\s+of\b", r"\bformal\s+name\b", r"\bstandard\b", r"\bclassification\s+(?:for|of|under|require)\b", r"\bni\s*43-?101\s+(?:§|section|clause)\b"],
    "synthesis": [r"\bintegrate\b", r"\bacross\s+(?:wells?|holes?|sites?|sources?|the\s+\w+)\b", r"\bsummari[sz]e\b", r"\bcompare\s+(?:holes?|wells?|targets?|sources?)\b", r"\bwhat\s+does\s+the\s+evidence\s+show\b", r"\bsynthesi[sz]e\b", r"\boverall\s+picture\b"],
    "hypothesis_generation": [r"\bcould\s+explain\b", r"\bwhat\s+(?:geological\s+)?models?\b", r"\balternative(?:\s+hypothes[ei]s)?\b", r"\bwhat\s+if\b", r"\bpossible\s+causes?\b", r"\bpossible\s+explanations?\b", r"\bhypothes[ei]s\b", r"\bmore\s+consistent\s+with\b"],
    "anomaly_detection": [r"\boutliers?\b", r"\banomal(?:y|ies|ous)\b", r"\bflag\b", r"\bqa[\/-]?qc\b", r"\bblanks?\b", r"\bcrm(?:s)?\b", r"\bduplicates?\b", r"\bdetection\s+limits?\b", r"\bre-?assay\b", r"\brerun\b"],
    "uncertainty_quantification": [r"\bhow\s+certain\b", r"\bconfidence\b", r"\bsensitivity\b", r"\bsensitive\b", r"\brange\b", r"\bassumptions?\b", r"\bhow\s+reliable\b", r"\bhow\s+robust\b", r"\buncertainty\b", r"\bcapping\b", r"\bdirect\s+measurements?\b", r"\bindirect\s+(?:correlations?|measurements?|inferences?)\b", r"\bconstraints?\b"],
    "project_summary": [r"\bbreakdown\b", r"\bproject\s+summary\b", r"\bdata\s+collection\b", r"\btechniques?\b", r"\bcollection\s+techniques?\b", r"\bwhat.{0,20}collected\b", r"\bwho\s+worked\b", r"\bcontractors?\b", r"\bgeologists?\b", r"\bby\s+year\b", r"\bover\s+time\b", r"\bdrill(?:ing)?\s+history\b", r"\bcampaign\s+history\b", r"\bhistorical\s+work\b"],
    "coverage_gap": [r"\bgaps?\b", r"\bmissing\b", r"\bincomplete\b", r"\bcoverage\b", r"\bwhat.{0,10}don'?t\s+(?:we\s+)?have\b", r"\bwhat.{0,10}haven'?t\s+(?:we\s+)?(?:got|collected|done)\b", r"\bholes?\s+in\s+(?:the\s+)?data\b", r"\bdata\s+gaps?\b", r"\bnot\s+yet\s+(?:collected|sampled|logged)\b", r"\bunder-?sampled\b", r"\bwhere.{0,20}sparse\b"],
}
BREADTH = ["factual_lookup", "anomaly_detection", "project_summary", "coverage_gap", "uncertainty_quantification", "decision_support", "synthesis", "hypothesis_generation"]
LETTERED_HOLE, NUMBERED_HOLE = r"(?i)\b([A-Z]{2,6}\d{0,4}-\d{1,5}(?:-\d{1,5})?)\b", r"\b(\d{1,4}-\d{1,5}(?:-\d{1,5})?)\b"
HOLE_CONTEXT = r"(?i)\b(?:hole(?:\s*id)?s?|drill\s*holes?|drillholes?|ddh|borehole)\b"


def _read(rows: DataFrame, keys: list[str], text: str, read: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """One row for each tuple that `read` makes of a text, next to the row's keys. Texts that
    are null or empty have none."""
    made = T.StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, r) for k, t in enumerate(b.column(len(keys)).to_pylist()) if t for r in read(t)]
            at = pa.array([k for k, _ in found], pa.int32())
            columns = [b.column(k).take(at) for k in range(len(keys))]
            columns += [pa.array([r[k] for _, r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *made.names])

    return rows.select(*keys, text).mapInArrow(run, T.StructType([*rows.select(*keys).schema.fields, *made.fields]))


def _nearest_structure(window: str, middle: int) -> str:
    """The type whose word is nearest; words before the middle count as half as far."""
    found = [((at - middle) if at > middle else (middle - at) / 2, k) for k, (word, _) in enumerate(STRUCTURES) for at in (m.start() for m in re.finditer(word, window))]
    return STRUCTURES[min(found)[1]][1] if found else "other"


def read_attitudes(text: str) -> list[tuple]:
    """(structure_type, alpha_angle, beta_angle, true_dip, true_dip_dir, notes) of each
    measurement. What a surer pattern has read no other reads. A bare pair needs the word of a
    structure near it. Dips go to the right of the strike, or to the side of the quadrant."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for rule, pattern in ATTITUDES:
        for m in re.finditer(pattern, text, re.IGNORECASE | re.DOTALL):
            a, b = m.span()
            k = bisect_left(taken, (b,))  # the last one that begins before the end
            if k and taken[k - 1][1] > a:
                continue
            said = m.groupdict()
            first, second = float(said.get("strike") or said.get("alpha")), float(said.get("dip") or said.get("beta"))
            if (first > 90 or second > 360) if rule == "core" else (first > 360 or second > 90):
                continue
            if rule == "kind":
                kind = said["kind"].lower().replace("_", " ")
                kind = dict(STRUCTURES).get(kind, "fold_axis" if kind.startswith("fold") else kind)
            else:
                low = max(0, a - NEAR_STRUCTURE)
                kind = _nearest_structure(text[low : b + NEAR_STRUCTURE].lower(), (a + b) // 2 - low)
            if rule == "bare" and kind == "other":
                continue
            if rule == "core":
                out.append((kind, first, second, None, None, m[0].strip()))
            else:
                side = QUADRANTS.get((said["quad"] or "").lower())
                left = side is not None and (side - first) % 360 > 180
                out.append((kind, None, None, second, (first - 90 if left else first + 90) % 360, m[0].strip()))
            taken.insert(k, (a, b))
    return out


def attitudes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return _read(rows, keys, text, read_attitudes, "structure_type string, alpha_angle double, beta_angle double, true_dip double, true_dip_dir double, notes string")


def _signed(number: str, side: str | None) -> float:
    return float(number) if not side else abs(float(number)) * (-1 if side.upper() in "SW" else 1)


def read_coordinates(text: str) -> list[tuple]:
    """(kind, raw, first, last, latitude, longitude, zone, hemisphere, easting, northing, datum):
    first and last are shares of the text's length, from which the box of a match follows. The
    datum is the nearest within reach. Numbers out of bounds are no coordinates."""
    data = sorted(((m.start() + m.end()) / 2, re.sub(r"\s+", "", m[0]).upper()) for m in re.finditer(DATUM, text, re.IGNORECASE))
    centres = [c for c, _ in data]
    out: list[tuple] = []
    seen: set[str] = set()
    for kind, pattern in COORDINATES:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            g, place = m.groups(), (None,) * 6
            if kind.startswith("utm"):
                zone, east, north = int(g[0]), float(g[2]), float(g[3])
                if not (1 <= zone <= 60 and 1e5 <= east <= 9e5 and north <= 1e7):
                    continue
                if kind == "utm_terse" and (not re.search(TERSE_CONTEXT, text[max(0, m.start() - NEAR_CONTEXT) : m.end() + NEAR_CONTEXT], re.IGNORECASE) or m[0] in seen):
                    continue
                place = (None, None, zone, g[1].upper(), east, north)
            else:
                if kind == "latlon_dms":
                    lat, lon = (float(d) + float(n) / 60 + float(s) / 3600 for d, n, s in (g[:3], g[4:7]))
                    lat, lon = _signed(str(lat), g[3]), _signed(str(lon), g[7])
                else:
                    lat, lon = _signed(g[0], g[1]), _signed(g[2], g[3])
                if abs(lat) > 90 or abs(lon) > 180:
                    continue
                place = (lat, lon, None, None, None, None)
            seen.add(m[0])
            middle = (m.start() + m.end()) / 2
            k = bisect_left(centres, middle)
            near = min(data[max(0, k - 1) : k + 1], key=lambda d: abs(d[0] - middle), default=None)
            datum = near[1] if near and abs(near[0] - middle) <= NEAR_DATUM else None
            out.append(("utm" if kind == "utm_terse" else kind, m[0], m.start() / len(text), m.end() / len(text), *place, datum))
    return out


def coordinates(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return _read(rows, keys, text, read_coordinates, "kind string, raw string, first double, last double, latitude double, longitude double, zone int, hemisphere string, easting double, northing double, datum string")


def _person(name: str) -> str:
    """The name without words at its ends that are no names; empty if it is no name."""
    words = re.sub(r"^(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?)\s+", "", name.strip()).split()
    real = [k for k, w in enumerate(words) if w.lower() not in NO_NAMES]
    words = words[real[0] : real[-1] + 1] if real else []
    return " ".join(words) if len(words) > 1 and len(words) == len(real) else ""


def read_names(text: str) -> list[tuple]:
    """(kind, place, name): known names first, then those that the patterns find; each once,
    whatever its case and spaces."""
    lower, out = text.lower(), []
    for kind, patterns in NAMES.items():
        names = [n for n in GAZETTEERS[kind] if n.lower() in lower]
        for pattern, least, refused in patterns:
            for m in re.finditer(pattern, text):
                name = _person(m["name"]) if kind == "person" else m["name"].strip(" .,;-")
                if len(name) >= least and name.lower() not in refused:
                    names.append(name)
        once = {" ".join(n.split()).lower(): n for n in reversed(names)}  # the first of each stays
        out += [(kind, k, once[n]) for k, n in enumerate(dict.fromkeys(" ".join(n.split()).lower() for n in names))]
    return out


def names(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return _read(rows, keys, text, read_names, "kind string, place int, name string")


def hole_mentions(text: Column) -> Column:
    """Ids of holes in upper case, once each: lettered ones, and numbers where the text speaks
    of holes."""
    numbers = F.when(text.rlike(HOLE_CONTEXT), F.regexp_extract_all(text, F.lit(NUMBERED_HOLE), 1)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.regexp_extract_all(text, F.lit(LETTERED_HOLE), 1), numbers), F.upper))


def intent(question: Column, phrases: dict[str, list[str]] = INTENTS, near: float = 0.1) -> Column:
    """struct(intent, confidence, second): by how many phrases each has; of the two first, if
    within `near`, the one that searches more broadly. A question that names a hole and matches
    nothing but lookups is a lookup; one that matches nothing is a synthesis."""
    counts = [F.struct(F.regexp_count(question, F.lit(f"(?i)(?:{'|'.join(p)})")).alias("n"), F.lit(-k).alias("order"), F.lit(BREADTH.index(name)).alias("breadth"), F.lit(name).alias("name")) for k, (name, p) in enumerate(phrases.items())]
    ranked = F.reverse(F.array_sort(F.filter(F.array(*counts), lambda x: x["n"] > 0)))
    one, two = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    swap = F.coalesce((one["n"] - two["n"] <= near) & (two["breadth"] > one["breadth"]), F.lit(False))
    top, second = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    sure = F.greatest(F.lit(0.0), (top["n"] - F.coalesce(second["n"], F.lit(0))) / F.greatest(top["n"], F.lit(1)))
    made = lambda name, confidence, other: F.struct(name.alias("intent"), confidence.cast("double").alias("confidence"), other.cast("string").alias("second"))
    lookup = (F.size(hole_mentions(question)) > 0) & (F.size(F.filter(ranked, lambda x: x["name"] != "factual_lookup")) == 0)
    nothing = made(F.lit("synthesis"), F.lit(0.0), F.lit(None))
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", nothing).when(lookup, made(F.lit("factual_lookup"), F.lit(1.0), F.lit(None))).when(F.size(ranked) == 0, nothing).otherwise(made(top["name"], sure, second["name"]))


def domains(filename: Column, text: Column, rules: list[tuple[str, str, str, str | None, float, str]], least: float = 0.3, read: int = 8192) -> Column:
    """array of struct(domain, sub_type, confidence, labels), the surest first. rules: where
    (filename, extension or content), pattern, domain, sub-type, weight, label; the first
    extension counts alone. The weights of a domain add up to 1 at most, and its best sub-type
    speaks for it."""
    plain, head = F.regexp_replace(filename, r"[_\-]+", " "), F.substring(text, 1, read)
    ends = [F.lower(filename).endswith(p.lower()) for where, p, *_ in rules if where == "extension"]
    fired, seen = [], 0
    for where, pattern, domain, sub, weight, label in rules:
        if where == "extension":
            test, earlier = ends[seen], ends[:seen]
            seen += 1
            for e in earlier:
                test = test & ~e
        else:
            test = (plain if where == "filename" else head).rlike(f"(?i){pattern}")
        fired.append(F.when(test, F.struct(F.lit(domain).alias("domain"), F.lit(sub).cast("string").alias("sub"), F.lit(float(weight)).alias("weight"), F.lit(label).alias("label"))))
    hits, found = F.array_compact(F.array(*fired)), []

    def having(x: Column, field: str, value: str) -> Column:
        return F.filter(x, lambda h: h[field] == value)

    def total(x: Column) -> Column:
        return F.least(F.lit(1.0), F.aggregate(x, F.lit(0.0), lambda n, h: n + h["weight"]))

    for domain in dict.fromkeys(r[2] for r in rules):
        own = having(hits, "domain", domain)
        subs = [F.struct(total(having(own, "sub", s)).alias("weight"), F.lit(-k).alias("order"), F.lit(s).alias("sub")) for k, s in enumerate(dict.fromkeys(r[3] for r in rules if r[2] == domain and r[3]))]
        best = F.array_max(F.filter(F.array(*subs), lambda x: x["weight"] > 0))["sub"] if subs else F.lit(None).cast("string")
        made = F.struct((-F.round(total(own), 3)).alias("minus"), F.lit(domain).alias("domain"), best.alias("sub_type"), F.round(total(own), 3).alias("confidence"), F.array_sort(F.array_distinct(F.transform(own, lambda h: h["label"]))).alias("labels"))
        found.append(F.when(total(own) >= least, made))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: F.struct(x["domain"].alias("domain"), x["sub_type"].alias("sub_type"), x["confidence"].alias("confidence"), x["labels"].alias("labels")))
