"""Compositions from landed rows to clean tables: keys resolved, intervals and codes
checked, units converted; what fails is kept with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions import geo, mentions, scalars


def resolved(rows: DataFrame, parents: DataFrame, hole: str, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with their parent's key, found by the canonical hole id, and rows without one.
    Of parents that share a canonical id the smallest key counts."""
    known = parents.select(scalars.hole_id(F.col(hole)).alias("__canon"), F.col(key)).where("__canon is not null").groupBy("__canon").agg(F.min(key).alias(key))
    made = rows.withColumn("__canon", scalars.hole_id(F.col(hole))).join(known, "__canon", "left").drop("__canon")
    return made.where(F.col(key).isNotNull()), made.where(F.col(key).isNull()).drop(key)


def checked_assays(rows: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: collar_id, element, from_depth, to_depth, value. elements: element, ppm_factor (a
    reference list of symbols). value_ppm is value x factor whatever the row's unit, as the
    original does. Returns accepted rows, and rejected ones with their first reason."""
    made = rows.join(F.broadcast(elements.withColumn("__known", F.lit(True))), "element", "left")  # a list of chemical elements
    reason = (
        F.when(F.col("collar_id").isNull(), "no_collar")
        .when(F.col("from_depth").isNull() | F.col("to_depth").isNull() | (F.col("to_depth") <= F.col("from_depth")), "bad_interval")
        .when(F.col("__known").isNull(), "unknown_element")
    )
    made = made.withColumn("reason", reason).withColumn("value_ppm", scalars.to_ppm(F.col("value"), F.col("ppm_factor")))
    return made.where("reason is null").drop("reason", "__known"), made.where("reason is not null").drop("__known", "ppm_factor", "value_ppm")


def deduplicated(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per landed id, the first by order; replays change nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def review_queue(rows: DataFrame, flags: list[Column], keys: list[str]) -> DataFrame:
    """One row for each record with a flag."""
    return rows.select(*keys, F.array_compact(F.array(*flags)).alias("flags")).where("size(flags) > 0")


def features(rows: DataFrame, attributes: str, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Canonical columns from a JSON attributes column: name to (path, type); with a checksum
    over all of them that tells a changed record."""
    made = [F.get_json_object(attributes, f"$.{path}").try_cast(kind).alias(name) for name, (path, kind) in mapping.items()]
    out = rows.select("*", *made)
    return out.withColumn("checksum", F.sha2(F.to_json(F.struct(*sorted(mapping)), {"ignoreNullFields": "false"}).cast("binary"), 256))


def traces(collars: DataFrame, surveyed: DataFrame) -> DataFrame:
    """How each hole's path is known: surveyed, straight (azimuth, dip and depth), vertical
    (depth alone) or none; and where a straight or vertical one ends."""
    has = surveyed.select("collar_id").distinct().withColumn("__s", F.lit(True))
    made = collars.join(has, "collar_id", "left")
    deep = F.coalesce(F.col("total_depth") > 0, F.lit(False))
    kind = F.when(F.col("__s"), "surveyed").when(deep & F.col("azimuth").isNotNull() & F.col("dip").isNotNull(), "straight").when(deep, "vertical").otherwise("none")
    x, y, z = geo.straight_end(*map(F.col, ("easting", "northing", "elevation")), F.coalesce("azimuth", F.lit(0.0)), F.coalesce("dip", F.lit(-90.0)), F.col("total_depth"))
    straight = kind.isin("straight", "vertical")
    return made.select("collar_id", kind.alias("trace"), F.when(straight, x).alias("end_x"), F.when(straight, y).alias("end_y"), F.when(straight, z).alias("end_z"))


def fingerprints(stations: DataFrame) -> DataFrame:
    """One hash per hole over its stations, to skip holes that did not change."""
    said = F.concat_ws(",", "depth", "azimuth", "dip")
    return stations.groupBy("collar_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(said)), ";").cast("binary"), 256).alias("survey_hash"))


def curve_intervals(logs: DataFrame, curve: str, limits: list[tuple[float, str]], top: str, least: float = 0.5) -> DataFrame:
    """Bands of one class along a log of map `curves`: points take the first class whose
    limit they stay below, neighbours of a class join, bands thinner than `least` go into
    the one before, and neighbours that are then alike join again. logs: collar_id, curves."""
    points = logs.select("collar_id", F.inline(F.arrays_zip(F.col("curves")["DEPT"].alias("depth"), F.col("curves")[curve].alias("value")))).where("depth is not null and value is not null")
    label = F.lit(top)
    for limit, name in reversed(limits):
        label = F.when(F.col("value") < limit, name).otherwise(label)
    w = Window.partitionBy("collar_id").orderBy("depth", "value")
    made = points.withColumn("label", label).withColumn("__new", (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("int"))
    made = made.withColumn("band", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = made.groupBy("collar_id", "band", "label").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    # a hole's first band stands; of the others thin ones only lengthen what is before them
    w = Window.partitionBy("collar_id").orderBy("lo", "hi", "label")
    stands = (F.row_number().over(w) == 1) | (F.col("hi") - F.col("lo") >= least)
    bands = bands.withColumn("kept", F.when(stands, F.col("label")))
    before = F.last("kept", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.withColumn("__new", (F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(before)).cast("int"))
    bands = bands.withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return bands.groupBy("collar_id", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("__new") == 1, F.col("kept"))).alias("label")).drop("group")


def graph_frames(collars: DataFrame, assays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, kind) of projects, holes and elements."""
    hole, project, element = F.concat(F.lit("hole:"), "collar_id"), F.concat(F.lit("project:"), "project_id"), F.concat(F.lit("element:"), "element")
    found = assays.select("collar_id", "element").distinct()
    nodes = collars.select(hole.alias("id"), F.lit("Hole").alias("label")).unionByName(collars.select(project.alias("id"), F.lit("Project").alias("label"))).unionByName(found.select(element.alias("id"), F.lit("Element").alias("label")))
    edges = collars.select(project.alias("src"), hole.alias("dst"), F.lit("HAS_HOLE").alias("kind")).unionByName(found.select(hole.alias("src"), element.alias("dst"), F.lit("ASSAYED_FOR").alias("kind")))
    return nodes.distinct(), edges.distinct()


def survey_lines(points: DataFrame, line: str, order: str, x: str, y: str, channels: list[str], most: int = 1000) -> DataFrame:
    """One row per survey line: its points, how many of them are stored, least, greatest and
    mean value of each channel over all of them, and the line as WKT through at most `most`
    evenly spaced points. Lines with fewer than two places are left out."""
    named = points.withColumn("__line", F.coalesce(F.col(line).cast("string"), F.lit("unknown")))
    stats = [f(c).alias(f"{c}_{n}") for c in channels for n, f in (("min", F.min), ("max", F.max), ("mean", lambda v: F.round(F.avg(v), 6)))]
    whole = named.groupBy("__line").agg(F.count("*").alias("points"), *stats)
    w = Window.partitionBy("__line").orderBy(order)
    placed = named.select("__line", order, x, y, (F.row_number().over(w) - 1).alias("__at")).join(whole.select("__line", "points"), "__line")
    step = F.greatest(F.col("points") / most, F.lit(1.0))
    # the first point at or after each multiple of the step
    kept = placed.where(F.floor(F.ceil(F.col("__at") / step) * step) == F.col("__at")).where(F.ceil(F.col("__at") / step) < most)
    place = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct("__at", F.concat_ws(" ", x, y).alias("p")))
    drawn = kept.groupBy("__line").agg(F.count("*").alias("stored"), F.array_sort(F.collect_list(place)).alias("__p")).where(F.size("__p") > 1)
    wkt = F.concat(F.lit("LINESTRING("), F.array_join(F.transform("__p", lambda p: p["p"]), ", "), F.lit(")"))
    return whole.join(drawn.select("__line", "stored", wkt.alias("wkt")), "__line").withColumnRenamed("__line", line)


def curve_rows(logs: DataFrame, keys: list[str], depth: str = "DEPT") -> DataFrame:
    """One row per curve of a log: depths and values where there is a value, how many, from and
    to which depth, and the usual step."""
    made = logs.select(*keys, F.col("curves")[depth].alias("__d"), F.explode("curves").alias("curve", "__v")).where(F.col("curve") != depth)
    held = F.filter(F.arrays_zip(F.col("__d").alias("depth"), F.col("__v").alias("value")), lambda p: p["depth"].isNotNull() & p["value"].isNotNull())
    made = made.select(*keys, "curve", F.array_sort(held).alias("p"))
    depths = F.transform("p", lambda p: p["depth"])
    step = F.when(F.size("p") > 1, (F.array_max(depths) - F.array_min(depths)) / (F.size("p") - 1))
    return made.select(*keys, "curve", depths.alias("depths"), F.transform("p", lambda p: p["value"]).alias("values"), F.size("p").alias("n"), F.array_min(depths).alias("min_depth"), F.array_max(depths).alias("max_depth"), step.alias("step"))


def sections(reports: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per section of a JSON object of texts."""
    return reports.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("section", "text"))


def mined_structures(notes: DataFrame, present: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Measurements in notes that aren't there yet, once each. present: keys, structure_type,
    alpha_angle, beta_angle, true_dip, true_dip_dir; nulls are alike."""
    same = [*keys, "structure_type", "alpha_angle", "beta_angle", "true_dip", "true_dip_dir"]
    found = mentions.attitudes(notes, keys, text).groupBy(*same).agg(F.min("notes").alias("notes"))
    old = present.select(*[F.col(c).alias(f"__{c}") for c in same])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    return found.join(old, on, "left_anti")


def filled(rows: DataFrame, found: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """rows with each empty column filled by the first name of its kind. found: key, kind,
    place, name. columns: column to kind."""
    firsts = found.groupBy(key).agg(*[F.min_by("name", F.when(F.col("kind") == kind, F.col("place"))).alias(f"__{c}") for c, kind in columns.items()])
    made = rows.join(firsts, key, "left")
    return made.withColumns({c: F.coalesce(scalars.blank_to_null(F.col(c)), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def assay_passages(assays: DataFrame, by: list[str], hole: Column, project: Column, lab: Column, method: Column) -> DataFrame:
    """One sentence per sample with all its elements. assays: by (sample_id, from_depth and
    to_depth among them), element, value, unit, and optionally below and above detection."""
    flag = lambda c, words: F.when(F.coalesce(F.col(c), F.lit(False)), words) if c in assays.columns else F.lit(None)
    said = F.trim(F.concat(F.concat_ws(" ", "element", F.col("value").cast("string"), F.coalesce("unit", F.lit(""))), F.coalesce(flag("below", " (below detection)"), flag("above", " (above detection)"), F.lit(""))))
    line = F.when(F.col("value").isNull(), F.concat("element", F.lit(" ND"))).otherwise(said)
    made = assays.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", line.alias("l")))), lambda x: x["l"]), ", ").alias("__e"))
    known = lambda c, other: F.coalesce(scalars.blank_to_null(c.cast("string")), F.lit(other))
    text = F.concat(
        F.lit("Assay sample "), F.col("sample_id").cast("string"), F.lit(" from drillhole "), known(hole, "(unknown hole)"), F.lit(" ("), known(project, "(unknown project)"), F.lit(" project), interval "),
        F.col("from_depth").cast("string"), F.lit(" to "), F.col("to_depth").cast("string"), F.lit(" m. Results: "), F.col("__e"), F.lit(". Analytical method "), known(method, "unspecified method"), F.lit(" at "), known(lab, "unspecified lab"), F.lit("."),
    )
    return made.select(*by, text.alias("text"))


def pending(passages: DataFrame, indexed: DataFrame, key: str, text: str) -> DataFrame:
    """Passages that the index lacks or holds with another text. indexed: key, text_hash."""
    hashed = passages.withColumn("text_hash", F.sha2(F.col(text).cast("binary"), 256))
    there = indexed.select(F.col(key), F.col("text_hash"))
    return hashed.join(there, (hashed[key] == there[key]) & hashed["text_hash"].eqNullSafe(there["text_hash"]), "left_anti")


def linked(documents: DataFrame, entities: DataFrame, patterns: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, entity_id of each entity whose number a text names, once for each text.
    patterns: kind to a pattern with the number in its first group; leading zeros don't count.
    entities: kind, number, entity_id."""
    trim = lambda c: F.regexp_replace(c, r"^0+(?=.)", "")

    def named_by(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), trim(n).alias("number")))

    each = [named_by(kind, pattern) for kind, pattern in patterns.items()]
    named = documents.select(key, F.explode(F.array_distinct(F.concat(*each))).alias("x")).select(key, "x.*")
    known = entities.select("kind", trim(F.col("number").cast("string")).alias("number"), "entity_id").groupBy("kind", "number").agg(F.min("entity_id").alias("entity_id"))
    return named.join(known, ["kind", "number"]).select(key, "kind", "entity_id")


def changed_counts(upstream: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """Groups whose number of rows upstream isn't that of the rows held, with both."""
    one, two = upstream.groupBy(by).agg(F.count("*").alias("upstream")), held.groupBy(by).agg(F.count("*").alias("held"))
    made = one.join(two, by, "full").fillna(0, ["upstream", "held"])
    return made.where("upstream <> held")
