"""Clustering and novelty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.operators import clustering as C
from estuarine.operators import hierarchy as H
from estuarine.operators import novelty as N
from estuarine.operators.vectors import cluster_stats
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.vectors import DV

EPS, MIN_SAMPLES = 1.2, 8


def known(v):
    """Reference: the taxa with labels below 8; the others are unknown to it."""
    return v.vectors.filter("label < 8")


@query("kmeans")
def _(v):
    return cluster_stats(C.kmeans(v.vectors, 10, seeds=(42, 7)))


@query("estimate_k")
def _(v):
    return v.spark.range(1).select(F.lit(C.estimate_k(v.vectors)).alias("k"))


@query("hierarchical")
def _(v):
    return cluster_stats(C.hierarchical(v.vectors, 10))


DBSCAN = f"""{DV}, nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM dv a JOIN dv b ON list_distance(a.e,b.e)<={EPS}),
    core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*)>={MIN_SAMPLES}),
    link AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(id, o) AS (SELECT id, id FROM core UNION SELECT link.b, reach.o FROM reach JOIN link ON link.a=reach.id),
    comp AS (SELECT id, min(o) AS c FROM reach GROUP BY 1),
    edge AS (SELECT nb.a AS id, min(c) AS c FROM nb JOIN comp ON nb.b=comp.id WHERE nb.a NOT IN (FROM core) GROUP BY 1)"""


@query(
    "dbscan",
    f"""WITH RECURSIVE {DBSCAN}, u AS (FROM comp UNION ALL FROM edge), k AS (SELECT c, row_number() OVER (ORDER BY c)-1 AS n FROM (SELECT DISTINCT c FROM u))
    SELECT vec_id, coalesce(n,-1)::INT AS cluster FROM dv LEFT JOIN u ON u.id=vec_id LEFT JOIN k USING (c)""",
    "vectors",
)
def _(v):
    return C.dbscan(v.vectors, EPS, MIN_SAMPLES)


@query(
    "dbscan_star",
    f"""WITH RECURSIVE {DBSCAN}, b AS (SELECT c FROM comp GROUP BY 1 HAVING count(*)>=20), k AS (SELECT c, row_number() OVER (ORDER BY c)-1 AS n FROM b)
    SELECT vec_id, coalesce(n,-1)::INT AS cluster FROM dv LEFT JOIN comp ON comp.id=vec_id LEFT JOIN k USING (c)""",
    "vectors",
)
def _(v):
    return C.dbscan_star(v.vectors, EPS, MIN_SAMPLES, 20)


@query(
    "reachability_tree",
    f"""WITH RECURSIVE {DV}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e,b.e),9) AS d FROM dv a, dv b),
    core AS (SELECT a, d AS c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS k FROM p) WHERE k=6),
    n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM dv),
    m AS (SELECT x.i AS i, list(greatest(d,ca.c,cb.c) ORDER BY y.i) AS row FROM p JOIN core ca ON ca.a=p.a JOIN core cb ON cb.a=p.b JOIN n x ON x.vec_id=p.a JOIN n y ON y.vec_id=p.b GROUP BY 1),
    t AS (SELECT 0 AS edges, 0.0::DOUBLE AS total, 0.0::DOUBLE AS longest, list_transform(row, lambda x, k: CASE WHEN k=1 THEN NULL ELSE x END) AS far FROM m WHERE i=1
      UNION ALL SELECT edges+1, total+list_min(far), greatest(longest, list_min(far)), list_transform(list_zip(far, m.row), lambda x, k: CASE WHEN x[1] IS NULL OR k=m.i THEN NULL ELSE least(x[1], x[2]) END)
      FROM t JOIN m ON m.i=list_position(far, list_min(far)) WHERE list_min(far) IS NOT NULL)
    SELECT edges::BIGINT AS edges, round(total,6) AS total, round(longest,6) AS longest FROM t ORDER BY edges DESC LIMIT 1""",
    "vectors",
)
def _(v):
    _, points = H.folded(v.vectors, "vec_id")
    _, tree = H.reachability_tree(points, 5)
    return rounded(tree.agg(F.count("w").alias("edges"), F.sum("w").alias("total"), F.max("w").alias("longest")), "total", "longest")


@query("hdbscan")
def _(v):
    return rounded(H.hdbscan(v.vectors, 10, 5), "probability", "outlier_score", "persistence")


KNN = """pr AS (SELECT a.vec_id AS q, b.vec_id AS r, b.label AS lb, list_distance(a.e,b.e) AS d FROM dv a JOIN dv b ON b.label<8),
    rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d,9), r) AS k FROM pr)"""


@query(
    "knn_novelty",
    f"""WITH {DV}, {KNN}, t AS (SELECT quantile_cont(d,.95) AS t FROM rk JOIN dv ON vec_id=q WHERE k=5 AND label<8)
    SELECT q AS vec_id, round(-avg(d),6) AS score, CASE WHEN avg(d)>any_value(t) THEN -1 ELSE 1 END AS label FROM rk, t WHERE k<=5 GROUP BY 1""",
    "vectors",
)
def _(v):
    return rounded(N.knn_novelty(known(v), v.vectors), "score")


LOF = """ks AS (SELECT q, r, d, row_number() OVER (PARTITION BY q ORDER BY round(d,9), r) AS k FROM pr JOIN dv ON vec_id=q WHERE label<8 AND q<>r),
    kd AS (SELECT q AS r, max(d) FILTER (k<=20) AS kd FROM ks GROUP BY 1),
    lr AS (SELECT q, 1/(avg(greatest(d,kd))+1e-10) AS l FROM ks JOIN kd USING (r) WHERE k<=20 GROUP BY 1),
    sr AS (SELECT ks.q, -avg(b.l)/any_value(a.l) AS s FROM ks JOIN lr b ON b.q=ks.r JOIN lr a ON a.q=ks.q WHERE k<=20 GROUP BY 1),
    lq AS (SELECT q, 1/(avg(greatest(d,kd))+1e-10) AS l FROM rk JOIN kd USING (r) WHERE k<=20 GROUP BY 1),
    sq AS (SELECT rk.q, -avg(b.l)/any_value(a.l) AS s FROM rk JOIN lr b ON b.q=rk.r JOIN lq a ON a.q=rk.q WHERE k<=20 GROUP BY 1),
    t AS (SELECT quantile_cont(s,.1) AS t FROM sr)"""


@query(
    "local_outlier_factor",
    f"""WITH {DV}, {KNN}, {LOF} SELECT q AS vec_id, round(s,6) AS score, CASE WHEN s<t THEN -1 ELSE 1 END AS label FROM sq, t""",
    "vectors",
)
def _(v):
    return rounded(N.lof(known(v), v.vectors), "score")


@query(
    "centroid_novelty",
    f"""WITH RECURSIVE {DV}, nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM dv a JOIN dv b ON a.label<8 AND b.label<8 AND list_distance(a.e,b.e)<={EPS}),
    core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*)>={MIN_SAMPLES}),
    link AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(id, o) AS (SELECT id, id FROM core UNION SELECT link.b, reach.o FROM reach JOIN link ON link.a=reach.id),
    comp AS (SELECT id, min(o) AS c FROM reach GROUP BY 1),
    edge AS (SELECT nb.a AS id, min(c) AS c FROM nb JOIN comp ON nb.b=comp.id WHERE nb.a NOT IN (FROM core) GROUP BY 1),
    u AS (FROM comp UNION ALL FROM edge), x AS (SELECT c, unnest(e) AS x, generate_subscripts(e,1) AS i FROM u JOIN dv ON vec_id=id),
    m AS (SELECT c, i, avg(x) AS x FROM x GROUP BY 1,2), ce AS (SELECT c, list(x ORDER BY i) AS v FROM m GROUP BY 1),
    t AS (SELECT quantile_cont(round(list_distance(e,v),9),.95) AS t FROM u JOIN dv ON vec_id=id JOIN ce USING (c)),
    d AS (SELECT vec_id, min(round(list_distance(e,v),9)) AS d FROM dv, ce GROUP BY 1)
    SELECT vec_id, round(-d,6) AS score, CASE WHEN d>t THEN -1 ELSE 1 END AS label FROM d, t""",
    "vectors",
)
def _(v):
    return rounded(N.centroid_novelty(known(v), v.vectors, EPS, MIN_SAMPLES), "score")


@query("mahalanobis_novelty")
def _(v):
    return rounded(N.mahalanobis_novelty(known(v), v.vectors), "score")


@query("robust_envelope")
def _(v):
    return rounded(N.robust_envelope(known(v), v.vectors), "score")


@query("isolation_forest")
def _(v):
    return rounded(N.isolation_forest(known(v), v.vectors), "score")


@query(
    "novelty_ensemble",
    f"""WITH {DV}, {KNN}, {LOF}, t2 AS (SELECT quantile_cont(d,.95) AS t FROM rk JOIN dv ON vec_id=q WHERE k=5 AND label<8),
      n AS (SELECT q, CASE WHEN avg(d)>any_value(t) THEN -1 ELSE 1 END AS l, -avg(d) AS s FROM rk, t2 WHERE k<=5 GROUP BY 1)
    SELECT sq.q AS vec_id, CASE WHEN n.l+CASE WHEN sq.s<t THEN -1 ELSE 1 END<=0 THEN -1 ELSE 1 END AS label, round((n.s+sq.s)/2,6) AS score FROM sq JOIN n ON n.q=sq.q, t""",
    "vectors",
)
def _(v):
    out = N.ensemble([N.knn_novelty(known(v), v.vectors), N.lof(known(v), v.vectors)])
    return rounded(out, "score")


@query("novelty_analysis")
def _(v):
    labels = N.analyze_novelty(known(v), v.vectors)
    return N.novelty_report(labels, v.vectors)


@query(
    "novel_summary",
    f"""WITH {DV}, m AS (SELECT a.vec_id, a.label, min(round(list_distance(a.e,b.e),9)) AS d FROM dv a JOIN dv b ON b.label<8 WHERE a.label>=8 GROUP BY 1,2)
    SELECT label::INT AS cluster, count(*) AS n_sequences, round(avg(d),6) AS avg_distance, round(stddev_pop(d),6) AS std_distance, round(min(d),6) AS min_distance,
      round(max(d),6) AS max_distance, array_to_string(list(vec_id ORDER BY vec_id)[1:5],',') AS representatives FROM m WHERE label<>9 GROUP BY 1
    UNION ALL SELECT NULL, count(*), round(avg(d),6), round(stddev_pop(d),6), round(min(d),6), round(max(d),6), NULL FROM m""",
    "vectors",
)
def _(v):
    novel = v.vectors.filter("label >= 8").withColumn("cluster", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    out = N.novel_summary(novel, known(v))
    out = out.withColumn("representatives", F.array_join(F.col("representatives").cast("array<string>"), ","))
    return rounded(out, "avg_distance", "std_distance", "min_distance", "max_distance")
