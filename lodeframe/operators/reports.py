"""Rollups, checks and gates that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.charts import sigmas

# Metals whose units differ by orders of magnitude, and the unit that a bare
# column of another metal is taken to have.
NOBLE_METALS = ["Au", "Ag", "Pt", "Pd", "Rh"]
BARE_UNITS = {"Cu": "pct", "Pb": "pct", "Zn": "pct", "Ni": "pct", "Fe": "pct", "Ti": "pct", "Li": "pct", "U3O8": "pct"}


def by_year(rows: DataFrame, technique: Column, date: str, metres: Column, key: str, unknown: str = "Unknown") -> DataFrame:
    """technique, year, n, metres, ids (sorted) of each technique and year."""
    return rows.groupBy(F.coalesce(technique, F.lit(unknown)).alias("technique"), F.year(date).alias("year")).agg(F.count("*").alias("n"), F.sum(metres).alias("metres"), F.array_sort(F.collect_list(key)).alias("ids"))


def outcomes(rows: DataFrame, kind: str, outcome: str, known: list[str]) -> DataFrame:
    """One row per kind: total, how many of each known outcome, and others."""
    counts = [F.count_if(F.col(outcome) == k).alias(k) for k in known]
    return rows.groupBy(kind).agg(F.count("*").alias("total"), *counts, F.count_if(F.coalesce(~F.col(outcome).isin(known), F.lit(True))).alias("other"))


def low_confidence(rows: DataFrame, key: Column, confidence: str, least: int, below: float, top: int) -> DataFrame:
    """Repeated questions that are answered with little confidence, by count x what lacks to 1."""
    made = rows.groupBy(key.alias("question")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean")).where((F.col("n") >= least) & (F.col("mean") < below))
    return made.withColumn("weight", F.round(F.col("n") * (1 - F.col("mean")), 6)).orderBy(F.desc("weight"), "question").limit(top)


def lag_seconds(pending: DataFrame, target: str, ts: str, now: Column) -> DataFrame:
    """Age of the oldest pending row of each target."""
    return pending.groupBy(target).agg(F.count("*").alias("pending"), (F.unix_timestamp(now) - F.unix_timestamp(F.min(ts))).alias("lag_s"))


def capped(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows in order, each with the exact count of all and whether the list is
    cut. The count is a second pass of aggregates only."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)  # one row


def outliers(rows: DataFrame, by: list[str], value: str, bound: float = 2.0, least: int = 3) -> DataFrame:
    """Rows more than `bound` population deviations from their group's mean, either side, in
    groups of `least` rows or more. Each group is one row of aggregates, joined back."""
    stats = rows.groupBy(*by).agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd")).where((F.col("__n") >= least) & (F.col("__sd") > 0))
    made = rows.join(stats, by).withColumn("sigma", sigmas(F.col(value), F.col("__mean"), F.col("__sd")))
    return made.where(F.abs("sigma") > bound).withColumn("side", F.when(F.col("sigma") > 0, "above").otherwise("below")).drop("__n", "__mean", "__sd")


def units_off(rows: DataFrame, element: str = "element", unit: str = "unit") -> DataFrame:
    """rows with `reasons`: a noble metal without a unit, or a unit that isn't the one its
    element has most often (ties by name) where it has several. One row per element and unit is
    ranked, whatever the number of rows."""
    named = F.lower(F.trim(F.coalesce(F.col(unit), F.lit(""))))
    counts = rows.groupBy(F.trim(element).alias("__e"), named.alias("__u")).agg(F.count("*").alias("n")).where("__u <> '' and __e <> ''")
    usual = counts.groupBy("__e").agg(F.count("*").alias("units"), F.min(F.struct(-F.col("n"), "__u"))["__u"].alias("usual")).where("units > 1").select("__e", "usual")
    made = rows.withColumn("__e", F.trim(element)).join(F.broadcast(usual), "__e", "left")  # a row per element
    missing = F.when(F.col("__e").isin(NOBLE_METALS) & (named == ""), F.lit("missing unit"))
    mixed = F.when(F.col("usual").isNotNull() & (named != "") & (named != F.col("usual")), F.concat(F.lit("not "), "usual"))
    return made.withColumn("reasons", F.array_compact(F.array(missing, mixed))).drop("__e", "usual")


def bare_columns(assays: Column) -> Column:
    """Of a map from column to value: names of noble metals without a unit, and of base metals
    without one whose value is too large for the unit that is taken for granted."""
    noble, base = F.array(*map(F.lit, NOBLE_METALS)), F.array(*map(F.lit, BARE_UNITS))
    return F.array_sort(F.map_keys(F.map_filter(assays, lambda k, v: F.array_contains(noble, k) | (F.array_contains(base, k) & (v > 100)))))


def positions(text: Column, pattern: str) -> Column:
    """array of struct(at, found) of all matches; at counts characters from 0."""
    found, parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda x, i: F.struct((size(parts, i + 1) + size(found, i)).alias("at"), x.alias("found")))


def nearest_mentions(texts: DataFrame, key: str, text: str, wanted: str, mentioned: str) -> DataFrame:
    """Each match of `wanted` with the closest match of `mentioned` in its text (before it, if
    both sides are as close). Matches are put in order once, and each looks back and ahead, so
    no pairs are made."""
    kinds = [texts.select(key, F.lit(k).alias("kind"), F.explode(positions(F.col(text), p)).alias("m")) for k, p in ((0, mentioned), (1, wanted))]
    every = kinds[0].unionByName(kinds[1]).select(key, "kind", "m.*")
    w = Window.partitionBy(key).orderBy("at", "kind")
    here = F.when(F.col("kind") == 0, F.struct("at", "found"))
    made = every.withColumns({"before": F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("kind = 1")
    ahead = F.col("before").isNull() | (F.abs(F.col("after.at") - F.col("at")) < F.col("at") - F.col("before.at"))
    return made.select(key, "at", "found", F.coalesce(F.when(F.coalesce(ahead, F.lit(False)), F.col("after.found")), F.col("before.found")).alias("mention"))


def implausible(texts: DataFrame, key: str, text: str, rules: list[tuple[str, str, str, float | None, float | None]], span: int = 200) -> DataFrame:
    """Numbers out of bounds: the first of `rules` (name, keywords, negative keywords, least,
    most) whose keywords are within `span` characters of the number and whose negative ones
    aren't. Numbers in square brackets don't count."""
    plain = F.regexp_replace(F.col(text), r"\[[^\]]*\]", "")
    made = texts.select(key, plain.alias("__t"), F.posexplode(positions(plain, r"[0-9]+(?:\.[0-9]+)?")).alias("place", "m"))
    near = F.lower(F.expr(f"substring(__t, greatest(m.at - {span}, 0) + 1, m.at - greatest(m.at - {span}, 0) + length(m.found) + {span})"))
    value, rule = F.col("m.found").cast("double"), F.lit(None).cast("string")
    for name, words, never, least, most in reversed(rules):
        out = F.lit(False) if least is None else value < least
        out = out if most is None else out | (value > most)
        rule = F.when(near.rlike(words) & (F.lit(True) if not never else ~near.rlike(never)) & out, name).otherwise(rule)
    return made.select(key, "place", value.alias("value"), rule.alias("rule")).where("rule is not null")


def expanded(text: Column, names: dict[str, str], most: int = 6) -> Column:
    """text with the first mention of each abbreviation followed by its full name in brackets,
    long abbreviations first, `most` of them. Symbols of up to three letters keep their case."""
    pair = F.struct(text.alias("t"), F.lit(0).alias("n"))
    for short in sorted(names, key=lambda k: -len(k)):
        symbol = len(short) <= 3 and short.isalpha() and short != short.lower()
        quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in short)
        pattern = ("" if symbol else "(?i)") + rf"^((?s:.*?))\b{quoted}\b"
        hit = pair["t"].rlike(pattern) & (pair["n"] < most)
        pair = F.struct(F.when(hit, F.regexp_replace(pair["t"], pattern, f"$1{short} ({names[short]})")).otherwise(pair["t"]).alias("t"), (pair["n"] + hit.cast("int")).alias("n"))
    return pair["t"]


def reranked(candidates: DataFrame, by: str, score: str, key: str, least: float, most: int) -> DataFrame:
    """The best `most` candidates of each question whose raw score reaches `least`, with the
    score's sigmoid. The score comes from any model."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    kept = candidates.where(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return kept.withColumn("relevance", 1 / (1 + F.exp(-F.col(score))))


def authority_order(evidence: DataFrame, by: str, rank: Column, superseded: str, confidence: str, key: str) -> DataFrame:
    """Place of each piece: by rank, current before superseded, then confidence."""
    w = Window.partitionBy(by).orderBy(rank, F.coalesce(F.col(superseded), F.lit(False)), F.desc_nulls_last(confidence), key)
    return evidence.withColumn("place", F.row_number().over(w))


def trimmed(evidence: DataFrame, by: str, kind: str, order: list[Column], cost: str, budget: int, floor: int) -> DataFrame:
    """What is left when the worst pieces go one by one until the cost is in the budget, each
    kind keeping its `floor` best. Those in the floor are always kept; of the others a piece
    stays while it, all better ones and the floor fit."""
    inside = F.row_number().over(Window.partitionBy(by, kind).orderBy(*order)) <= floor
    made = evidence.withColumn("__floor", inside)
    fixed = F.sum(F.when(F.col("__floor"), F.col(cost)).otherwise(0)).over(Window.partitionBy(by))
    running = F.sum(F.when(F.col("__floor"), 0).otherwise(F.col(cost))).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return made.withColumn("__sum", fixed + running).where(F.col("__floor") | (F.col("__sum") <= budget)).drop("__floor", "__sum")


def gate(totals: DataFrame, sets: DataFrame, most_failed: int, most_regressed: int, caps: dict[str, int], blocking: bool = False) -> DataFrame:
    """One row: whether a run is over a cap on failures, on regressions or on those of a set,
    the caps broken, and whether that blocks. totals: failed, regressed; sets: name, regressed."""
    allowed = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)])
    over = sets.where(F.col("regressed") > F.coalesce(F.try_element_at(allowed, F.col("name")), F.lit(2**31))).agg(F.array_sort(F.collect_list(F.concat(F.lit("set:"), "name"))).alias("by_set"))
    made = totals.crossJoin(over)  # one row each
    reasons = F.concat(F.array_compact(F.array(F.when(F.col("failed") > most_failed, F.lit("failed")), F.when(F.col("regressed") > most_regressed, F.lit("regressed")))), "by_set")
    return made.select(reasons.alias("reasons"), (F.size(reasons) > 0).alias("would_block"), (F.lit(blocking) & (F.size(reasons) > 0)).alias("blocks"))


def findings(checks: list[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """Rows of several checks (name, tier, broken rows, their id) in one table."""
    every = None
    for name, tier, rows, key in checks:
        part = rows.select(F.lit(tier).alias("tier"), F.lit(name).alias("check"), key.cast("string").alias("record"))
        every = part if every is None else every.unionByName(part)
    return every


def stale(views: DataFrame, sources: DataFrame, name: str, made: str, changed: str) -> DataFrame:
    """Views to be made anew: never made, or a source has changed since."""
    last = sources.groupBy(name).agg(F.max(changed).alias("__last"))
    return views.join(last, name, "left").where(F.col(made).isNull() | (F.col("__last") > F.col(made))).select(*views.columns)


def bumped(versions: DataFrame, commits: DataFrame, key: list[str]) -> DataFrame:
    """Version counters after commits: one more for each that succeeded."""
    done = commits.where("succeeded").groupBy(*key).agg(F.count("*").alias("__n"))
    return versions.join(done, key, "full").select(*key, (F.coalesce("version", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("version"))


def window_deltas(rows: DataFrame, ts: str, days: int, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """by, starts (the first day of a window of `days`, counted from 1970-01-01), the measures,
    and how each differs from the window before, where a missing one counts as 0."""
    number = F.floor(F.unix_seconds(ts) / (86_400 * days))
    per = rows.where(F.col(ts).isNotNull()).groupBy(*by, number.alias("__k")).agg(*(c.alias(n) for n, c in measures.items()))
    w = Window.partitionBy(*by).orderBy("__k")
    adjoins = F.lag("__k").over(w) == F.col("__k") - 1
    deltas = [(F.col(n) - F.when(adjoins, F.lag(n).over(w)).otherwise(0)).alias(f"{n}_delta") for n in measures]
    starts = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("__k") * days).cast("int")).cast("string")
    return per.select(*by, starts.alias("starts"), *measures, *deltas)


def recent(rows: DataFrame, ts: str, minutes: int, by: list[str], cost: str, now: Column | None = None) -> DataFrame:
    """n and spent of each group in the last minutes up to `now` (the latest row, if not given),
    where anything was spent."""
    if now is None:
        latest = rows.agg(F.max(ts).alias("__now"))  # one row
        rows, now = rows.crossJoin(F.broadcast(latest)), F.col("__now")
    inside = (F.col(ts) > now - F.make_interval(mins=F.lit(minutes))) & (F.col(ts) <= now)
    return rows.where(inside).groupBy(*by).agg(F.count("*").alias("n"), F.sum(cost).alias("spent")).where("spent > 0")
