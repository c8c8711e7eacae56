"""Sample and report similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions import vectors as V
from estuarine.functions.mathx import rnd
from estuarine.operators import similarity as S
from estuarine.operators.trends import successive_pairs
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.store import PAIRS

UNION = f"""{PAIRS}, u AS (SELECT report_id_1, report_id_2, taxon FROM pairs JOIN abundance ON sample_id=report_id_1 UNION
      SELECT report_id_1, report_id_2, taxon FROM pairs JOIN abundance ON sample_id=report_id_2),
    w AS (SELECT u.report_id_1, u.report_id_2, u.taxon, coalesce(x.n,0)::DOUBLE AS a, coalesce(y.n,0)::DOUBLE AS b FROM u
      LEFT JOIN abundance x ON x.sample_id=report_id_1 AND x.taxon=u.taxon
      LEFT JOIN abundance y ON y.sample_id=report_id_2 AND y.taxon=u.taxon),
    k AS (SELECT *, rank() OVER (PARTITION BY report_id_1, report_id_2 ORDER BY a)+
        (count(*) OVER (PARTITION BY report_id_1, report_id_2, a)-1)/2.0::DOUBLE AS ra,
      rank() OVER (PARTITION BY report_id_1, report_id_2 ORDER BY b)+
        (count(*) OVER (PARTITION BY report_id_1, report_id_2, b)-1)/2.0::DOUBLE AS rb FROM w)"""


@query(
    "abundance_similarity",
    f"""WITH {UNION} SELECT report_id_1, report_id_2, count(*) AS taxa,
      round(sum(a*b)/sqrt(sum(a*a)*sum(b*b)),6) AS cosine, round(coalesce(corr(a,b),0),6) AS pearson,
      round(coalesce(corr(ra,rb),0),6) AS spearman, round(2*sum(least(a,b))/(sum(a)+sum(b)),6) AS bray_curtis,
      round(1-sum(abs(a-b))/sum(greatest(a,b)),6) AS manhattan FROM k GROUP BY 1,2""",
    "abundance reports",
)
def _(v):
    counts = v.abundance.withColumnRenamed("sample_id", "report_id")
    out = S.abundance_similarity(counts, successive_pairs(v.reports))
    return rounded(out, "cosine", "pearson", "spearman", "bray_curtis", "manhattan")


COMP = """l AS (SELECT report_id, 'kingdom' AS rank, kingdom AS t, count(*) AS n FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'phylum', phylum, count(*) FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'genus', genus, count(*) FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'species', species, count(*) FROM assignments WHERE species IS NOT NULL GROUP BY 1,3),
    nn AS (SELECT report_id, rank, sqrt(sum(n*n)::DOUBLE) AS nn FROM l GROUP BY 1,2),
    cs AS (SELECT report_id_1, report_id_2, x.rank, sum(x.n*y.n)::DOUBLE/any_value(p.nn)/any_value(q.nn) AS c FROM pairs
      JOIN l x ON x.report_id=report_id_1 JOIN l y ON y.report_id=report_id_2 AND y.rank=x.rank AND y.t=x.t
      JOIN nn p ON p.report_id=report_id_1 AND p.rank=x.rank JOIN nn q ON q.report_id=report_id_2 AND q.rank=x.rank GROUP BY 1,2,3),
    ct AS (SELECT report_id_1, report_id_2, coalesce(max(c) FILTER (rank='kingdom'),0) AS k, coalesce(max(c) FILTER (rank='phylum'),0) AS p,
      coalesce(max(c) FILTER (rank='genus'),0) AS g, coalesce(max(c) FILTER (rank='species'),0) AS s FROM pairs LEFT JOIN cs
      USING (report_id_1, report_id_2) GROUP BY 1,2)"""


@query(
    "composition_similarity",
    f"""WITH {PAIRS}, {COMP} SELECT report_id_1, report_id_2, round(k,6) AS kingdom_similarity, round(p,6) AS phylum_similarity,
      round(g,6) AS genus_similarity, round(s,6) AS species_similarity, round((k*.1+p*.15+g*.2+s*.3)/1.2,6) AS taxonomic_similarity FROM ct""",
    "assignments reports",
)
def _(v):
    out = S.composition_similarity(v.assignments, successive_pairs(v.reports))
    return rounded(out, *[c for c in out.columns if c.endswith("similarity")])


def report_env(v):
    """Environment of each report: its dataset's, dated by supplier key."""
    ds = v.datasets.withColumn("depth_meters", F.when(F.col("salinity").isNotNull(), F.col("depth_meters")))
    return v.reports.join(ds, "dataset_id").select(
        "report_id",
        (F.col("latitude") + F.col("report_id") % 7 * 0.25).alias("latitude"),
        "longitude",
        "depth_meters",
        "temperature_celsius",
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("report_id") * 17 % 800).cast("int")).alias("collection_date"),
    )


ENV = """env AS (SELECT report_id, latitude+report_id%7*0.25::DOUBLE AS la, longitude AS lo,
      CASE WHEN salinity IS NOT NULL THEN depth_meters END AS d, temperature_celsius AS t,
      DATE '2020-01-01' + (report_id*17%800)::INT AS cd FROM reports JOIN datasets USING (dataset_id)),
    es AS (SELECT report_id_1, report_id_2, 6371*2*asin(sqrt(pow(sin(radians(y.la-x.la)/2),2)+cos(radians(x.la))*cos(radians(y.la))
        *pow(sin(radians(y.lo-x.lo)/2),2))) AS km, coalesce(1-abs(x.d-y.d)/greatest(x.d,y.d,1),.5) AS ds,
      greatest(0,1-abs(x.t-y.t)/20) AS ts, abs(x.cd-y.cd) AS days FROM pairs JOIN env x ON x.report_id=report_id_1 JOIN env y ON y.report_id=report_id_2)"""


@query(
    "environment_similarity",
    f"""WITH {PAIRS}, {ENV} SELECT report_id_1, report_id_2, round(km,6) AS distance_km, round(exp(-km/100),6) AS geographic_similarity,
      round(ds,6) AS depth_similarity, round(ts,6) AS temperature_similarity, days::INT AS days_apart,
      round(greatest(0,1-days/365.0::DOUBLE),6) AS temporal_similarity FROM es""",
    "reports datasets",
)
def _(v):
    out = S.environment_similarity(report_env(v), successive_pairs(v.reports), "report_id")
    return rounded(out, "distance_km", *[c for c in out.columns if c.endswith("similarity")])


DIV = """c AS (SELECT report_id, organism_id, count(*) AS n FROM assignments GROUP BY 1,2),
    p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY report_id) AS p FROM c),
    h AS (SELECT report_id, -sum(p*ln(p)) AS h, 1-sum(p*p) AS d, -sum(p*ln(p))/ln(count(*)) AS e, count(*)::DOUBLE AS s FROM p GROUP BY 1),
    dv AS (SELECT report_id_1, report_id_2, 1-abs(x.h-y.h)/greatest(x.h,y.h) AS sh, 1-abs(x.d-y.d)/greatest(x.d,y.d) AS sd,
      1-abs(x.e-y.e)/greatest(x.e,y.e) AS se, 1-abs(x.s-y.s)/greatest(x.s,y.s) AS ss, x.h AS h1, y.h AS h2, x.d AS d1, y.d AS d2,
      x.e AS e1, y.e AS e2, x.s AS s1, y.s AS s2 FROM pairs JOIN h x ON x.report_id=report_id_1 JOIN h y ON y.report_id=report_id_2),
    sh AS (SELECT report_id_1, report_id_2, count(*) AS shared, sum(x.n*y.n)::DOUBLE AS xy FROM pairs JOIN c x ON x.report_id=report_id_1
      JOIN c y ON y.report_id=report_id_2 AND x.organism_id=y.organism_id GROUP BY 1,2),
    sq AS (SELECT report_id, sum(n*n)::DOUBLE AS q FROM c GROUP BY 1)"""


@query(
    "diversity_similarity",
    f"""WITH {PAIRS}, {DIV} SELECT report_id_1, report_id_2, round(sh,6) AS shannon_similarity, round(sd,6) AS simpson_similarity,
      round(se,6) AS evenness_similarity, round(ss,6) AS richness_similarity, round((sh+sd+se+ss)/4,6) AS diversity_similarity FROM dv""",
    "assignments reports",
)
def _(v):
    div = S.basic_diversity(S.organism_counts(v.assignments), "report_id")
    out = S.diversity_similarity(div, successive_pairs(v.reports))
    return rounded(out, *[c for c in out.columns if c.endswith("similarity")])


@query(
    "report_similarity",
    f"""WITH {PAIRS}, {COMP}, {ENV}, {DIV}, z AS (SELECT report_id_1, report_id_2, coalesce(shared,0)/(s1+s2-coalesce(shared,0)) AS j,
        coalesce(xy,0)/sqrt(a.q*b.q) AS cs, (k*.1+p*.15+g*.2+s*.3)/1.2 AS tx, (sh+sd+se+ss)/4 AS dvs,
        (exp(-km/100)+ds+greatest(0,1-days/365.0::DOUBLE))/3 AS en FROM dv JOIN ct USING (report_id_1, report_id_2)
        JOIN es USING (report_id_1, report_id_2) LEFT JOIN sh USING (report_id_1, report_id_2)
        JOIN sq a ON a.report_id=report_id_1 JOIN sq b ON b.report_id=report_id_2)
    SELECT report_id_1, report_id_2, round(j,6) AS jaccard, round(cs,6) AS cosine, round(tx,6) AS taxonomic_similarity,
      round(dvs,6) AS diversity_similarity, round(en,6) AS environment_similarity,
      round(.25*j+.25*cs+.2*tx+.15*dvs+.15*en,6) AS overall_similarity FROM z""",
    "assignments reports datasets",
)
def _(v):
    out = S.report_similarity(v.assignments, report_env(v), successive_pairs(v.reports))
    return rounded(out, *[c for c in out.columns if not c.startswith("report_id")])


@query(
    "compare_reports_simple",
    f"""WITH {PAIRS}, {DIV}, z AS (SELECT report_id_1, report_id_2, coalesce(shared,0) AS shared,
        coalesce(shared,0)/(s1+s2-coalesce(shared,0)) AS j, abs(h1-h2) AS dh, abs(d1-d2) AS dd, abs(e1-e2) AS de, greatest(h1,h2,1) AS hm
      FROM dv LEFT JOIN sh USING (report_id_1, report_id_2))
    SELECT report_id_1, report_id_2, shared AS organism_overlap_count, round(j,6) AS jaccard, round(dh,6) AS shannon_diff,
      round(dd,6) AS simpson_diff, round(de,6) AS evenness_diff, round((greatest(0,least(1,1-dh/hm))+j)/2,6) AS similarity_score FROM z""",
    "assignments reports",
)
def _(v):
    out = S.compare_reports_simple(v.assignments, successive_pairs(v.reports))
    return rounded(out, "jaccard", "shannon_diff", "simpson_diff", "evenness_diff", "similarity_score")


@query(
    "vector_scalars",
    """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM vectors)
    SELECT vec_id, round(list_inner_product(a,b),6) AS dot, round(list_cosine_similarity(a,b),6) AS cosine, round(list_distance(a,b),6) AS l2,
      round(list_sum(list_transform(list_zip(a,b), lambda z: abs(z[1]-z[2]))),6) AS manhattan,
      round(a[1]/sqrt(list_inner_product(a,a)),6) AS first_unit FROM x WHERE b IS NOT NULL""",
    "vectors",
)
def _(v):
    a, b = F.col("embedding"), F.col("b")
    after = v.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.vectors.join(after, "vec_id").select(
        "vec_id",
        rnd(V.dot(a, b)).alias("dot"),
        rnd(V.cosine(a, b)).alias("cosine"),
        rnd(V.l2(a, b)).alias("l2"),
        rnd(V.manhattan(a, b)).alias("manhattan"),
        rnd(F.get(V.normalize(a), 0)).alias("first_unit"),
    )
