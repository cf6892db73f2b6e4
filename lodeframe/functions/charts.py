"""Values that charts of geochemistry show: ratios to reference compositions, shares of three
components, and flags of values far from the mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference compositions in parts per million, elements in chart order.
CHONDRITE_PPM = {"La": 0.237, "Ce": 0.612, "Pr": 0.095, "Nd": 0.467, "Sm": 0.153, "Eu": 0.058, "Gd": 0.2055, "Tb": 0.0374, "Dy": 0.254, "Ho": 0.0566, "Er": 0.1655, "Tm": 0.0255, "Yb": 0.17, "Lu": 0.0254}
MANTLE_PPM = {
    "Rb": 0.6, "Ba": 6.6, "Th": 0.0795, "U": 0.0203, "Nb": 0.658, "Ta": 0.037, "K": 250, "La": 0.648, "Ce": 1.675, "Pb": 0.15, "Pr": 0.254, "Sr": 19.9, "P": 90.4, "Nd": 1.25,
    "Zr": 10.5, "Hf": 0.283, "Sm": 0.406, "Eu": 0.154, "Ti": 1205, "Gd": 0.544, "Tb": 0.099, "Dy": 0.674, "Y": 4.30, "Ho": 0.149, "Er": 0.438, "Tm": 0.068, "Yb": 0.441, "Lu": 0.0675,
}


def normalised(element: Column, value_ppm: Column, reference: dict[str, float]) -> tuple[Column, Column]:
    """The element's place in the chart, from 0, and value over reference; null for others."""
    place = F.create_map(*[F.lit(x) for k, e in enumerate(reference) for x in (e, k)])
    ppm = F.create_map(*[F.lit(x) for e, v in reference.items() for x in (e, float(v))])
    return F.try_element_at(place, element), value_ppm / F.try_element_at(ppm, element)


def ternary(a: Column, b: Column, c: Column, total: float = 100.0) -> tuple[Column, Column, Column]:
    """Three components as shares of `total`; null where they add up to nothing."""
    whole = F.nullif(a + b + c, F.lit(0.0))
    return a / whole * total, b / whole * total, c / whole * total


def sigmas(value: Column, mean: Column, deviation: Column) -> Column:
    """How many deviations a value is from the mean; null where nothing deviates."""
    return (value - mean) / F.nullif(deviation, F.lit(0.0))
