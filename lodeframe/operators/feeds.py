"""Features of public feeds as canonical rows, one mapping of fields for each kind of feed.

A feature comes as a JSON object of properties. Every cell is cast on its own, so that a bad
one is null and never costs the row; a feature without an id is left out. Codes and states are
resolved by small tables of spellings, given as columns of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.scalars import dominant, ladder, lookup

# For each kind of feed, canonical attribute, how it is read, and the properties
# that may hold it, the first filled one wins.
FEEDS: dict[str, list[tuple[str, str, list[str]]]] = {
    "mine": [
        ("name", "text", ["NAME"]),
        ("status", "state", ["STATUS"]),
        ("commodities", "codes", ["COMMODITY"]),
        ("commodity_grouping", "grouping", ["COMMODITY"]),
        ("operator", "text", ["OPERATOR"]),
        ("source_url", "text", ["WEBLINK"]),
    ],
    "mineral_occurrence": [
        ("external_id", "text", ["SMDI"]),
        ("name", "text", ["NAME"]),
        ("historic_names", "list", ["HISTORICNAMES"]),
        ("status", "state", ["STATUS"]),
        ("primary_commodities", "codes", ["PRIMARYCOMMODITIES"]),
        ("associated_commodities", "codes", ["ASSOCIATEDCOMMODITIES"]),
        ("commodity_grouping", "grouping", ["GROUPING", "PRIMARYCOMMODITIES"]),
        ("discovery_type", "text", ["DISCOVERYTYPE"]),
        ("production_flag", "flag", ["PRODUCTION"]),
        ("reserves_resources", "text", ["RESERVESRESOURCES"]),
        ("source_url", "text", ["WEBLINK"]),
    ],
    "drillhole_collar": [
        ("drillhole_id", "text", ["GOS_UNIQUE_DRILLHOLE_ID"]),
        ("drillhole_name", "text", ["DRILLHOLE_NAME"]),
        ("company", "text", ["COMPANY"]),
        ("project_name", "text", ["PROJECT_OR_PROPERTY_NAME"]),
        ("date_drilled", "date", ["DATE_DRILLED"]),
        ("drill_type", "text", ["DRILL_TYPE"]),
        ("commodity_of_interest", "list", ["COMMODITY_OF_INTEREST"]),
        ("total_length_m", "number", ["TOTAL_DH_LENGTH_M"]),
        ("inclination_deg", "number", ["DH_INCLINATION"]),
        ("azimuth_deg", "number", ["DH_AZIMUTH"]),
        ("collar_elevation_m", "number", ["ORIGINAL_COLLAR_ELEVATION_M"]),
        ("core_availability", "core", ["COREAVAILABILITY"]),
        ("core_storage", "text", ["STORAGE_LOCATIONS"]),
        ("disposition", "text", ["DISPOSITION"]),
        ("source_url", "text", ["SOURCE"]),
    ],
    "rock_sample": [
        ("station", "text", ["STATION"]),
        ("sample_number", "text", ["SAMPLE_NUM"]),
        ("geologist", "text", ["GEOLOGIST"]),
        ("geographic_area", "text", ["GEOG_AREA"]),
        ("report_number", "text", ["REPORT_NUM"]),
        ("map_number", "text", ["MAP_NUM"]),
        ("map_scale", "text", ["MAP_SCALE"]),
        ("nts_250k", "text", ["NTS_250K"]),
        ("nts_50k", "text", ["NTS_50K"]),
        ("date_collected", "date", ["DATE_"]),
    ],
    "mineral_disposition": [
        ("disposition_number", "text", ["DISPOSITION", "DISPID", "DISPOSIT_1"]),
        ("status", "state", ["STATUS", "DISPSTATUS"]),
        ("holder_name", "text", ["HOLDER", "LESSEES", "OWNERS"]),
        ("issue_date", "date", ["ISSUEDATE", "EFFECTIVED", "ANNIVERSARYDATE"]),
        ("expiry_date", "date", ["GOODSTANDI", "EXPIRYDATE"]),
        ("area_ha", "number", ["HECTARES", "PARCELHECT"]),
        ("commodity_codes", "list", ["COMMODITY"]),
        ("geographic_area", "text", ["GEOAREA"]),
    ],
    "bedrock_polygon": [
        ("unit_code", "text", ["ROCK_CODE"]),
        ("unit_name", "unit", ["NAME", "FORMATION", "MEMBER", "ROCK_CODE"]),
        ("eon", "text", ["EON"]),
        ("era", "text", ["ERA"]),
        ("period", "text", ["PERIOD"]),
        ("group_name", "text", ["GROUP_"]),
        ("formation", "text", ["FORMATION"]),
        ("member", "text", ["MEMBER"]),
        ("structural_domain", "text", ["DOMAIN"]),
        ("lithology", "text", ["LITHOLOGY"]),
    ],
    "assessment_survey": [("survey_type", "survey", [])],
    "resource_potential": [
        ("potential_rank", "whole", ["POTENTIAL", "POTENTIAL_RANK", "RANK", "Potential"]),
        ("methodology_ref", "text", ["SOURCE", "METHODOLOGY"]),
    ],
}
# Words for yes and no, marks between list items, and what is said of core.
NO = ["n", "no", "none", "n/a", "na", "false", "f", "0", ""]
MARKS = "[,;/|]+"
CORE = [("partial", "partial"), ("unavailable|no core|lost|^no$", "unavailable"), ("available|^yes$", "available")]
SURVEYS = [("underground", "underground"), ("ground", "ground"), ("airborne", "airborne")]
DAYS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'"]


def filled(props: Column, names: list[str]) -> Column:
    """The first of these properties that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(props, f"$.{n}")), F.lit("")) for n in names])


def feature_id(props: Column) -> Column:
    """OBJECTID, its alternative where that is 0 or missing, another id, or what is left."""
    own, other = (F.nullif(filled(props, [n]), F.lit("0")) for n in ("OBJECTID", "OBJECTID_1"))
    return F.coalesce(own, other, filled(props, ["FID", "ObjectID", "objectid"]), filled(props, ["OBJECTID_1"]))


def day(text: Column) -> Column:
    """A date in any of the forms, or milliseconds since 1970."""
    forms = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DAYS]
    return F.coalesce(F.when(text.rlike(r"^-?\d{9,}$"), F.to_date(F.timestamp_millis(text.try_cast("bigint")))), *forms)


def items(text: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(text, MARKS), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def extracted(features: DataFrame, kind: str, states: dict[str, str], codes: dict[str, str], groups: dict[str, str], props: str = "props", source: str = "source_id") -> DataFrame:
    """source_id, source_feature_id, the kind's attributes and checksum. states: lower-cased
    spelling to state (others: unknown); codes and groups: lower-cased commodity to its code and
    grouping. Unknown commodities stay out of codes."""
    p = F.col(props)
    made = []
    for name, how, names in FEEDS[kind]:
        text = filled(p, names) if names else F.lit(None).cast("string")
        every = items(text)
        if how == "text":
            value = text
        elif how == "number":
            value = text.try_cast("double")
        elif how == "whole":
            value = F.coalesce(*[filled(p, [n]).try_cast("double").try_cast("int") for n in names])
        elif how == "date":
            value = day(text)
        elif how == "list":
            value = every
        elif how == "flag":
            value = F.coalesce(~F.lower(text).isin(NO), F.lit(False))
        elif how == "core":
            value = F.when(text.isNull(), "unknown").otherwise(ladder(text, CORE, "unknown"))
        elif how == "survey":
            value = ladder(F.col(source), SURVEYS, "unknown")
        elif how == "state":
            value = F.coalesce(lookup(states, F.lower(text)), F.lit("unknown"))
        elif how == "codes":
            value = F.array_distinct(F.filter(F.transform(every, lambda c: lookup(codes, F.lower(c))), lambda c: c.isNotNull()))
        elif how == "grouping":
            value = dominant(every, groups)
        else:  # a unit's name: its own, the formation with its member, or the code
            own, formation, member, code = (filled(p, [n]) for n in names)
            value = F.coalesce(own, F.when(formation.isNotNull(), F.concat_ws(" / ", formation, member)), code)
        made.append(value.alias(name))
    out = features.select(F.col(source).alias("source_id"), feature_id(p).alias("source_feature_id"), p.alias("__p"), *made).where("source_feature_id is not null")
    return out.withColumn("checksum", F.sha2(F.concat_ws("\n", "source_id", "source_feature_id", "__p").cast("binary"), 256)).drop("__p")
