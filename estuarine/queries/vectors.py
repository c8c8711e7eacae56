"""Vector search, store and cluster-description queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators import vectors as V
from estuarine.queries import query
from estuarine.queries.diversity import rounded

NORMED = """nv AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x:
    x/greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])),1e-12)) AS u FROM vectors)"""
DV = "dv AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM vectors)"


@query(
    "knn_join",
    f"""WITH {NORMED}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, round(list_inner_product(a.u,b.u),9) AS s FROM nv a, nv b)
    SELECT query_id, ref_id, round(s,6) AS value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id)::INT AS r FROM p) WHERE r<=10""",
    "vectors",
)
def _(v):
    return rounded(V.knn_join(v.vectors, v.vectors, 10), "value")


@query(
    "search_vectors",
    f"""WITH {DV}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, round(list_distance(a.e,b.e),9) AS s FROM dv a JOIN dv b ON a.label<>b.label)
    SELECT query_id, ref_id, round(s,6) AS value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, ref_id)::INT AS r FROM p) WHERE r<=5""",
    "vectors",
)
def _(v):
    out = V.search_vectors(v.vectors, v.vectors, 5, exclude_same_run=True, run="label")
    return rounded(out, "value")


@query(
    "ann_search",
    f"""WITH {DV}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, round(list_distance(a.e,b.e),9) AS s FROM dv a, dv b)
    SELECT query_id, ref_id, round(s,6) AS value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, ref_id)::INT AS r FROM p) WHERE r<=5""",
    "vectors",
)
def _(v):
    index, centres = V.ann_index(v.vectors)
    return rounded(V.ann_search(v.vectors, index, centres, 5, nprobe=8), "value")


@query(
    "ann_search_lists",
    "SELECT count(*) * least(5, count(*)) AS neighbours, true AS recall_reached FROM vectors",
    "vectors",
)
def _(v):
    index, centres = V.ann_index(v.vectors, lists=16)
    found = V.ann_search(v.vectors, index, centres, 5, nprobe=12)
    out = V.ann_recall(found, V.knn_join(v.vectors, v.vectors, 5, "l2"))
    return out.select("neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(
    "consolidate_store",
    """SELECT label::VARCHAR AS dataset, 'r' || (vec_id//100) AS run_id, vec_id, label<5 AS old FROM vectors""",
    "vectors",
)
def _(v):
    rows = v.vectors.select(
        F.col("label").cast("string").alias("dataset"),
        F.concat(F.lit("r"), F.floor(F.col("vec_id") / 100).cast("string")).alias("run_id"),
        "vec_id",
        (F.col("label") < 5).alias("old"),
    )
    return V.consolidate(rows.withColumn("old", F.lit(False)), rows.filter("old"))


@query(
    "cluster_centroids",
    f"""WITH {DV}, x AS (SELECT label, unnest(e) AS x, generate_subscripts(e,1) AS i FROM dv), m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY 1,2)
    SELECT label, any_value(n) AS size, round(arg_min(x,i),6) AS first, round(sum(x),6) AS total FROM m GROUP BY 1""",
    "vectors",
)
def _(v):
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return V.centroids(v.vectors, "label").select(
        "label", "size", rnd(F.get("centroid", 0)).alias("first"), rnd(total).alias("total")
    )


@query(
    "cluster_representatives",
    f"""WITH {DV}, x AS (SELECT label, unnest(e) AS x, generate_subscripts(e,1) AS i FROM dv), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1,2),
      c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), d AS (SELECT label, vec_id, round(list_distance(e,c),9) AS d FROM dv JOIN c USING (label))
    SELECT label, vec_id, round(d,6) AS distance, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS r FROM d) WHERE r<=5""",
    "vectors",
)
def _(v):
    return rounded(V.cluster_representatives(v.vectors, 5, "label"), "distance")


@query(
    "cluster_stats",
    """WITH l AS (SELECT CASE WHEN label=9 THEN -1 ELSE label END AS cluster, count(*) AS size FROM vectors GROUP BY 1)
    SELECT cluster, size, (SELECT count(*) FROM l WHERE cluster<>-1) AS n_clusters, (SELECT coalesce(sum(size),0)::BIGINT FROM l WHERE cluster=-1) AS n_noise FROM l""",
    "vectors",
)
def _(v):
    return V.cluster_stats(v.vectors.select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster")))


@query(
    "calinski_harabasz",
    f"""WITH {DV}, x AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e,1) AS i FROM dv), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1,2),
      g AS (SELECT i, avg(x) AS g FROM x GROUP BY 1), b AS (SELECT sum(n*(m-g)*(m-g)) AS b FROM m JOIN g USING (i)),
      w AS (SELECT sum((x-m)*(x-m)) AS w FROM x JOIN m USING (label, i)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM dv)
    SELECT k AS n_clusters, round((b/(k-1))/(w/(n-k)),6) AS calinski_harabasz FROM b, w, k""",
    "vectors",
)
def _(v):
    return rounded(V.calinski_harabasz(v.vectors, "label"), "calinski_harabasz")


@query(
    "silhouette",
    f"""WITH {DV}, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(pow(list_distance(a.e,b.e),2)) AS s, count(*) AS n FROM dv a, dv b GROUP BY 1,2,3),
      q AS (SELECT vec_id, max(s/(n-1)) FILTER (la=lb) AS a, min(s/n) FILTER (la<>lb) AS b FROM p GROUP BY 1)
    SELECT round(avg((b-a)/greatest(a,b)),6) AS silhouette FROM q""",
    "vectors",
)
def _(v):
    return rounded(V.silhouette(v.vectors, "label"), "silhouette")


@query(
    "cluster_coherence",
    f"""WITH {DV}, c AS (SELECT label, count(*) AS size FROM dv GROUP BY 1), m AS (SELECT a.label, avg(list_distance(a.e,b.e)) AS m FROM dv a JOIN dv b ON a.label=b.label AND a.vec_id<b.vec_id GROUP BY 1)
    SELECT label, size, round(CASE WHEN size<2 THEN 0 ELSE 1/(1+m) END,6) AS coherence FROM c LEFT JOIN m USING (label)""",
    "vectors",
)
def _(v):
    return rounded(V.cluster_coherence(v.vectors, "label"), "coherence")


@query("embed_kmers")
def _(v):
    out = V.embed_kmers(v.reads)
    return out.select("sequence_id", F.size("embedding").alias("dims"), rnd(F.get("embedding", 0)).alias("first"))


@query("reduce_vectors")
def _(v):
    out = V.reduce_vectors(v.vectors, 8)
    return out.select("vec_id", *[rnd(F.get("embedding", i)).alias(f"pc{i}") for i in range(8)])


@query("project_2d")
def _(v):
    return rounded(V.project_2d(v.vectors), "x", "y")
