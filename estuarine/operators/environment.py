"""Environmental classes, habitat scores and the environment profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import banded, first_match

# Half-open classes (upper bound, label) and the label above them.
BANDS = {
    "temperature_class": ("temperature", [(0, "freezing"), (15, "cold"), (25, "moderate"), (35, "warm")], "hot"),
    "metabolic_activity": ("temperature", [(5, "low"), (15, "moderate"), (30, "high")], "extreme"),
    "depth_zone": ("depth", [(10, "surface"), (200, "euphotic"), (1000, "dysphotic"), (4000, "bathypelagic")], "abyssopelagic"),
    "depth_stratum": ("depth", [(10, "surface"), (200, "euphotic"), (1000, "dysphotic")], "aphotic"),
    "light_availability": ("depth", [(10, "high"), (100, "moderate"), (200, "low")], "none"),
    "ph_class": ("ph", [(3, "highly_acidic"), (6, "acidic"), (8, "neutral"), (10, "alkaline")], "highly_alkaline"),
    "salinity_class": ("salinity", [(0.5, "freshwater"), (5, "oligohaline"), (18, "mesohaline"), (30, "polyhaline")], "euhaline"),
}

# Inclusive parameter ranges per habitat, in declared order.
HABITATS = {
    "marine": {"salinity": (30, 40), "depth": (0, 11000), "temperature": (-2, 35)},
    "freshwater": {"salinity": (0, 0.5), "depth": (0, 1000), "temperature": (0, 40)},
    "brackish": {"salinity": (0.5, 30), "depth": (0, 100), "temperature": (5, 35)},
    "terrestrial": {"salinity": (0, 0.1), "depth": (0, 10), "temperature": (-20, 50)},
    "extreme": {"temperature": (60, 100), "ph": (0, 3)},
}

PARAMETERS = ["temperature", "depth", "ph", "salinity"]


def classify(value: Column, bands: list[tuple[float, str]], top: str) -> Column:
    """Class of a value from a break table, 'unknown' for a missing one."""
    return F.coalesce(banded(value, bands, top), F.lit("unknown"))


def _among(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def habitat_scores() -> Column:
    """Array of (habitat, score): share of the measured parameters inside the ranges."""
    cells = []
    for name, ranges in HABITATS.items():
        known = reduce(lambda a, b: a + b, [F.col(p).isNotNull().cast("int") for p in ranges])
        inside = reduce(
            lambda a, b: a + b, [_among(F.col(p).between(lo, hi)).cast("int") for p, (lo, hi) in ranges.items()]
        )
        cells.append(
            F.struct(F.lit(name).alias("habitat"), F.when(known > 0, inside / known).alias("score"))
        )
    return F.filter(F.array(*cells), lambda x: x["score"].isNotNull())


def classify_habitat(env: DataFrame, key: str) -> DataFrame:
    """Best habitat (first declared wins ties) with its score; 'unknown' without parameters."""
    scored = env.withColumn("__s", habitat_scores())
    top = F.array_max(F.transform("__s", lambda x: x["score"]))
    best = F.get(F.filter("__s", lambda x: x["score"] == top), 0)["habitat"]
    return scored.select(
        key,
        F.coalesce(best, F.lit("unknown")).alias("primary_habitat"),
        F.coalesce(top, F.lit(0.0)).alias("habitat_confidence"),
    )


def season(date_text: Column) -> Column:
    """Northern season of an ISO date; unreadable dates count as June, missing ones are unknown."""
    month = F.coalesce(F.month(F.try_to_timestamp(date_text)), F.lit(6))
    name = first_match(
        [(month.isin(12, 1, 2), "winter"), (month.isin(3, 4, 5), "spring"), (month.isin(6, 7, 8), "summer")], "autumn"
    )
    return F.when(date_text.isNotNull() & (date_text != ""), name).otherwise("unknown")


def _flags(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(_among(test), F.lit(label)) for test, label in rules]))


def environment_profile(env: DataFrame, key: str, shannon: str = "shannon") -> DataFrame:
    """All environment-derived classes, stress flags, health and advice in one projection."""
    t, d, p, s = (F.col(c) for c in PARAMETERS)
    h = F.col(shannon)
    thermal = _among((t > 35) | (t < 0))
    chemical = _among((p < 5) | (p > 9))
    osmotic = _among((s > 50) | (s < 0.1))
    stresses = thermal.cast("int") + chemical.cast("int") + osmotic.cast("int")
    measured = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in PARAMETERS])
    parts = F.array_compact(
        F.array(
            F.when(h.isNotNull(), F.least(h / 4.0, F.lit(1.0))),
            F.when(p.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(p - 8.0) / 6.0)),
        )
    )
    health = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.5)
    osmotic_level = first_match([((s < 0.5) | (s > 40), "high"), ((s < 5) | (s > 35), "moderate")], "low")
    buffer = first_match([(p.between(6.5, 8.5), "high"), (p.between(5.5, 9.5), "moderate")], "low")
    return env.select(
        key,
        *[classify(F.col(c), bands, top).alias(name) for name, (c, bands, top) in BANDS.items()],
        (d * 0.1).alias("pressure_mpa"),
        F.when(s.isNotNull(), osmotic_level).otherwise("unknown").alias("osmotic_stress_level"),
        F.when(p.isNotNull(), buffer).otherwise("unknown").alias("buffer_capacity"),
        first_match([(measured >= 3, "high"), (measured >= 2, "moderate")], "low").alias("habitat_complexity"),
        thermal.alias("thermal_stress"),
        chemical.alias("chemical_stress"),
        osmotic.alias("osmotic_stress"),
        first_match([(stresses >= 2, "high"), (stresses == 1, "moderate")], "low").alias("overall_stress_level"),
        health.alias("ecosystem_health"),
        season(F.col("collection_date")).alias("sampling_season"),
        _flags(
            [
                (t > 30, "thermal_pollution"),
                ((p > 7.5) & (d > 100), "deep_alkaline_conditions"),
                (t > 25, "ocean_warming"),
            ]
        ).alias("indicators"),
        F.when(_among(h > 3), "high").otherwise("medium").alias("conservation_priority"),
        _flags(
            [
                (h > 3, "high_biodiversity"),
                (d > 2000, "deep_sea_ecosystem"),
                ((t > 40) | (t < 5), "extreme_environment"),
            ]
        ).alias("unique_features"),
        _flags([(t.isNull(), "temperature"), (s.isNull(), "salinity"), (p.isNull(), "pH")]).alias("additional_parameters"),
        _flags(
            [
                (d > 100, "pressure_tolerance"),
                (d > 200, "reduced_light_dependency"),
                (d > 200, "chemosynthesis"),
                (d > 1000, "piezophilic_adaptations"),
                (d > 1000, "specialized_membrane_composition"),
            ]
        ).alias("depth_adaptations"),
        F.when(_among(d < 100), "photosynthetic").otherwise("chemolithotrophic").alias("co2_fixation"),
        _among(d < 50).alias("sample_multiple_depths"),
    )
