"""Environment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.operators import environment as E
from estuarine.queries import query
from estuarine.queries.diversity import rounded


def stations(v):
    """Sampling stations derived from the customer keys, with gaps and unreadable dates."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd")
    return v.table("customer").select(
        k.alias("station_id"),
        F.when(k % 11 != 0, (k * 7 % 1300) / 10 - 20).cast("double").alias("temperature"),
        F.when(k % 7 != 0, k * 37 % 5000).cast("double").alias("depth"),
        F.when(k % 5 != 0, k % 120 / 10).cast("double").alias("ph"),
        F.when(k % 3 != 0, k * 13 % 900 / 10).cast("double").alias("salinity"),
        F.when(k % 13 == 0, "n/a").when(k % 17 != 0, day).alias("collection_date"),
        F.when(k % 2 == 0, k % 50 / 10).cast("double").alias("shannon"),
    )


STATIONS = """s AS (SELECT c_custkey AS station_id, CASE WHEN c_custkey%11<>0 THEN (c_custkey*7%1300)/10-20 END::DOUBLE AS temperature,
      CASE WHEN c_custkey%7<>0 THEN c_custkey*37%5000 END::DOUBLE AS depth, CASE WHEN c_custkey%5<>0 THEN (c_custkey%120)/10 END::DOUBLE AS ph,
      CASE WHEN c_custkey%3<>0 THEN (c_custkey*13%900)/10 END::DOUBLE AS salinity,
      CASE WHEN c_custkey%13=0 THEN 'n/a' WHEN c_custkey%17<>0 THEN strftime(DATE '2020-01-01'+(c_custkey%700)::INT,'%Y-%m-%d') END AS cd,
      CASE WHEN c_custkey%2=0 THEN (c_custkey%50)/10 END::DOUBLE AS h FROM customer)"""


@query(
    "habitat_classification",
    f"""WITH {STATIONS}, i AS (SELECT *, unnest([
        {{'o':1,'h':'marine','k':(salinity IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(temperature IS NOT NULL)::INT,
          'n':coalesce(salinity BETWEEN 30 AND 40,false)::INT+coalesce(depth BETWEEN 0 AND 11000,false)::INT+coalesce(temperature BETWEEN -2 AND 35,false)::INT}},
        {{'o':2,'h':'freshwater','k':(salinity IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(temperature IS NOT NULL)::INT,
          'n':coalesce(salinity BETWEEN 0 AND .5,false)::INT+coalesce(depth BETWEEN 0 AND 1000,false)::INT+coalesce(temperature BETWEEN 0 AND 40,false)::INT}},
        {{'o':3,'h':'brackish','k':(salinity IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(temperature IS NOT NULL)::INT,
          'n':coalesce(salinity BETWEEN .5 AND 30,false)::INT+coalesce(depth BETWEEN 0 AND 100,false)::INT+coalesce(temperature BETWEEN 5 AND 35,false)::INT}},
        {{'o':4,'h':'terrestrial','k':(salinity IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(temperature IS NOT NULL)::INT,
          'n':coalesce(salinity BETWEEN 0 AND .1,false)::INT+coalesce(depth BETWEEN 0 AND 10,false)::INT+coalesce(temperature BETWEEN -20 AND 50,false)::INT}},
        {{'o':5,'h':'extreme','k':(ph IS NOT NULL)::INT+(temperature IS NOT NULL)::INT,
          'n':coalesce(ph BETWEEN 0 AND 3,false)::INT+coalesce(temperature BETWEEN 60 AND 100,false)::INT}}]) AS x FROM s),
      r AS (SELECT station_id, x.h AS hb, x.n::DOUBLE/nullif(x.k,0) AS sc, x.o AS o FROM i),
      b AS (SELECT station_id, hb, sc, row_number() OVER (PARTITION BY station_id ORDER BY sc DESC NULLS LAST, o) AS rn FROM r)
    SELECT station_id, CASE WHEN sc IS NULL THEN 'unknown' ELSE hb END AS primary_habitat, round(coalesce(sc,0),6) AS habitat_confidence
    FROM b WHERE rn=1""",
)
def _(v):
    return rounded(E.classify_habitat(stations(v), "station_id"), "habitat_confidence")


def band_sql(col, bands, top):
    whens = " ".join(f"WHEN {col}<{b} THEN '{label}'" for b, label in bands)
    return f"CASE WHEN {col} IS NULL THEN 'unknown' {whens} ELSE '{top}' END"


@query(
    "environment_profile",
    f"""WITH {STATIONS}, f AS (SELECT *, coalesce(temperature>35 OR temperature<0,false) AS th, coalesce(ph<5 OR ph>9,false) AS ch,
        coalesce(salinity>50 OR salinity<.1,false) AS os FROM s)
    SELECT station_id, {', '.join(f"{band_sql(c, b, t)} AS {n}" for n, (c, b, t) in E.BANDS.items())},
      round(depth*.1,6) AS pressure_mpa,
      CASE WHEN salinity IS NULL THEN 'unknown' WHEN salinity<.5 OR salinity>40 THEN 'high' WHEN salinity<5 OR salinity>35 THEN 'moderate' ELSE 'low' END AS osmotic_stress_level,
      CASE WHEN ph IS NULL THEN 'unknown' WHEN ph BETWEEN 6.5 AND 8.5 THEN 'high' WHEN ph BETWEEN 5.5 AND 9.5 THEN 'moderate' ELSE 'low' END AS buffer_capacity,
      CASE WHEN (temperature IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(ph IS NOT NULL)::INT+(salinity IS NOT NULL)::INT>=3 THEN 'high'
        WHEN (temperature IS NOT NULL)::INT+(depth IS NOT NULL)::INT+(ph IS NOT NULL)::INT+(salinity IS NOT NULL)::INT>=2 THEN 'moderate' ELSE 'low' END AS habitat_complexity,
      th AS thermal_stress, ch AS chemical_stress, os AS osmotic_stress,
      CASE WHEN th::INT+ch::INT+os::INT>=2 THEN 'high' WHEN th::INT+ch::INT+os::INT=1 THEN 'moderate' ELSE 'low' END AS overall_stress_level,
      round(coalesce(list_avg(list_filter([CASE WHEN h IS NOT NULL THEN least(h/4,1) END, CASE WHEN ph IS NOT NULL THEN greatest(0,1-abs(ph-8)/6) END], lambda x: x IS NOT NULL)),.5),6) AS ecosystem_health,
      CASE WHEN cd IS NULL THEN 'unknown' ELSE CASE coalesce(month(try_cast(cd AS DATE)),6) WHEN 12 THEN 'winter' WHEN 1 THEN 'winter' WHEN 2 THEN 'winter'
        WHEN 3 THEN 'spring' WHEN 4 THEN 'spring' WHEN 5 THEN 'spring' WHEN 6 THEN 'summer' WHEN 7 THEN 'summer' WHEN 8 THEN 'summer' ELSE 'autumn' END END AS sampling_season,
      coalesce(array_to_string([CASE WHEN temperature>30 THEN 'thermal_pollution' END, CASE WHEN ph>7.5 AND depth>100 THEN 'deep_alkaline_conditions' END,
        CASE WHEN temperature>25 THEN 'ocean_warming' END],','),'') AS indicators,
      CASE WHEN h>3 THEN 'high' ELSE 'medium' END AS conservation_priority,
      coalesce(array_to_string([CASE WHEN h>3 THEN 'high_biodiversity' END, CASE WHEN depth>2000 THEN 'deep_sea_ecosystem' END,
        CASE WHEN temperature>40 OR temperature<5 THEN 'extreme_environment' END],','),'') AS unique_features,
      coalesce(array_to_string([CASE WHEN temperature IS NULL THEN 'temperature' END, CASE WHEN salinity IS NULL THEN 'salinity' END, CASE WHEN ph IS NULL THEN 'pH' END],','),'') AS additional_parameters,
      coalesce(array_to_string([CASE WHEN depth>100 THEN 'pressure_tolerance' END, CASE WHEN depth>200 THEN 'reduced_light_dependency' END, CASE WHEN depth>200 THEN 'chemosynthesis' END,
        CASE WHEN depth>1000 THEN 'piezophilic_adaptations' END, CASE WHEN depth>1000 THEN 'specialized_membrane_composition' END],','),'') AS depth_adaptations,
      CASE WHEN depth<100 THEN 'photosynthetic' ELSE 'chemolithotrophic' END AS co2_fixation, coalesce(depth<50,false) AS sample_multiple_depths
    FROM f""",
)
def _(v):
    out = E.environment_profile(stations(v), "station_id")
    lists = ["indicators", "unique_features", "additional_parameters", "depth_adaptations"]
    out = out.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in out.columns])
    return rounded(out, "pressure_mpa", "ecosystem_health")
