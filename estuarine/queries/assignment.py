"""Sequence search and taxonomy assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators import alignments as L
from estuarine.operators import assign as A
from estuarine.operators import kmersearch as K
from estuarine.operators.vectors import knn_join
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.vectors import NORMED


def passages(v):
    """Benchmark passages as query reads."""
    seq = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    return v.table("benchmark").select(F.col("item_id").alias("sequence_id"), seq.alias("seq"))


@query(
    "kmer_search",
    """WITH b AS (SELECT item_id AS query_id, upper(regexp_replace(text,'[^ACGTNacgtn]','','g')) AS seq FROM benchmark),
      qk AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, substr(seq, unnest(range(1, length(seq)-6)), 8) AS w FROM b WHERE length(seq)>=8) WHERE NOT contains(w,'N')),
      rk AS (SELECT DISTINCT sequence_id, w FROM (SELECT sequence_id, substr(seq, unnest(range(1, length(seq)-6)), 8) AS w FROM reads WHERE length(seq)>=8) WHERE NOT contains(w,'N')),
      n AS (SELECT query_id, count(*) AS n FROM qk GROUP BY 1),
      p AS (SELECT query_id, sequence_id AS ref_id, count(*) AS shared FROM qk JOIN rk USING (w) GROUP BY 1,2),
      s AS (SELECT query_id, ref_id, shared, shared*1.0::DOUBLE/n AS share FROM p JOIN n USING (query_id) WHERE shared*1.0::DOUBLE/n>=.5)
    SELECT query_id, ref_id, shared, round(share,6) AS share, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, ref_id)::INT AS r FROM s) WHERE r<=5""",
    "reads",
)
def _(v):
    return rounded(K.kmer_search(passages(v), v.reads.select("sequence_id", "seq")), "share")


@query("aligned_hits")
def _(v):
    found = L.aligned_hits(passages(v), v.reads.select("sequence_id", "seq", "organism"), title=F.col("organism"))
    return rounded(found.drop("title", "evalue"), "identity", "coverage", "bit_score")


@query("aligned_assignments")
def _(v):
    found = L.aligned_hits(passages(v), v.reads.select("sequence_id", "seq", "description"), title=F.col("description"))
    return rounded(A.hits_to_assignments(A.best_hit(found), passages(v)).drop("evalue"), "identity", "coverage")


def half_sql(name, expr):
    return f"""{name}k AS (SELECT DISTINCT id, w FROM (SELECT id, substr(h, unnest(range(1, length(h)-6)), 8) AS w FROM (SELECT id, {expr} AS h FROM u) WHERE length(h)>=8) WHERE NOT contains(w,'N')),
      {name}n AS (SELECT id, count(*) AS n FROM {name}k GROUP BY 1),
      {name}p AS (SELECT k.id, p.id AS r, count(*)*1.0::DOUBLE/any_value(n) AS s, any_value(up.size) AS rs FROM {name}k k JOIN pk p USING (w) JOIN {name}n n ON n.id=k.id
        JOIN u uq ON uq.id=k.id JOIN u up ON up.id=p.id WHERE up.size>=2*uq.size GROUP BY 1,2),
      {name}b AS (SELECT id, r FROM {name}p WHERE s>=.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, rs DESC, r)=1)"""


@query(
    "chimera_screen",
    f"""WITH u AS (SELECT seq, min(sequence_id) AS id, count(*) AS size FROM reads WHERE length(seq)>=16 GROUP BY 1),
      pk AS (SELECT DISTINCT id, w FROM (SELECT id, substr(seq, unnest(range(1, length(seq)-6)), 8) AS w FROM u) WHERE NOT contains(w,'N')),
      {half_sql('l', "substr(seq,1,length(seq)//2)")}, {half_sql('r', "substr(seq,length(seq)//2+1)")}
    SELECT u.id AS sequence_id, size, lb.r AS left_parent, rb.r AS right_parent, coalesce(lb.r<>rb.r,false) AS is_chimera
    FROM u LEFT JOIN lb USING (id) LEFT JOIN rb USING (id)""",
    "reads",
)
def _(v):
    return K.chimera_screen(v.reads, k=8, min_share=0.6)


def taxa(v):
    """Ranks of the reference vectors: labels nested into genera and families."""
    label = F.col("label")
    return v.vectors.select(
        F.col("vec_id").alias("ref_id"),
        F.concat(F.lit("s"), label.cast("string")).alias("species"),
        F.concat(F.lit("g"), F.floor(label / 2).cast("string")).alias("genus"),
        F.concat(F.lit("f"), F.floor(label / 4).cast("string")).alias("family"),
    )


VOTE = {"min_similarity": 0.15, "margin": 0.05, "min_agreement": {"species": 0.3, "genus": 0.4, "family": 0.6}}
NEAR = f"""{NORMED}, pr AS (SELECT a.vec_id AS q, b.vec_id AS r, b.label AS lb, round(list_inner_product(a.u,b.u),9) AS s FROM nv a, nv b),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, r) AS k FROM pr) WHERE k<=12),
    vt AS (SELECT q, 0 AS d, 'species' AS rank, 's' || lb AS l, round(sum(s),9) AS w FROM nb WHERE s>=.15 GROUP BY 1,4 UNION ALL
      SELECT q, 1, 'genus', 'g' || (lb//2), round(sum(s),9) FROM nb WHERE s>=.15 GROUP BY 1,4 UNION ALL
      SELECT q, 2, 'family', 'f' || (lb//4), round(sum(s),9) FROM nb WHERE s>=.15 GROUP BY 1,4),
    tl AS (SELECT q, d, rank, l, w, sum(w) OVER (PARTITION BY q, d) AS t, row_number() OVER (PARTITION BY q, d ORDER BY w DESC, l) AS k,
      coalesce(lead(w) OVER (PARTITION BY q, d ORDER BY w DESC, l),0) AS w2 FROM vt),
    ac AS (SELECT * FROM tl WHERE k=1 AND w/t>=CASE d WHEN 0 THEN .3 WHEN 1 THEN .4 ELSE .6 END AND w-w2>=.05 QUALIFY row_number() OVER (PARTITION BY q ORDER BY d)=1),
    kn AS (SELECT vec_id AS sequence_id, rank AS assigned_rank, l AS assigned_label, coalesce(w/t,0) AS confidence FROM nv LEFT JOIN ac ON q=vec_id)"""


@query(
    "knn_lca",
    f"""WITH {NEAR}, m AS (SELECT q, avg(s) AS a, max(s) AS b FROM nb GROUP BY 1)
    SELECT sequence_id, assigned_rank, assigned_label, round(confidence,6) AS confidence, round(a,6) AS knn_mean_similarity, round(b,6) AS knn_top_similarity
    FROM kn JOIN m ON q=sequence_id""",
    "vectors",
)
def _(v):
    out = A.knn_lca(knn_join(v.vectors, v.vectors, 12), taxa(v), **VOTE)
    cols = ["sequence_id", "assigned_rank", "assigned_label", "confidence", "knn_mean_similarity", "knn_top_similarity"]
    return rounded(out.select(*cols), "confidence", "knn_mean_similarity", "knn_top_similarity")


CONS = """base AS (SELECT sequence_id, assigned_rank, assigned_label, confidence, label//3 AS cluster FROM kn JOIN vectors ON vec_id=sequence_id),
    sz AS (SELECT cluster, count(*) AS n FROM base WHERE cluster<>2 GROUP BY 1),
    cc AS (SELECT cluster, assigned_rank AS r, assigned_label AS l, count(*) AS c FROM base WHERE cluster<>2 AND assigned_rank IN ('species','genus','family') GROUP BY 1,2,3),
    ld AS (SELECT *, CASE r WHEN 'species' THEN 0 WHEN 'genus' THEN 1 ELSE 2 END AS d FROM cc QUALIFY row_number() OVER (PARTITION BY cluster, r ORDER BY c DESC, l)=1),
    wn AS (SELECT cluster, r, l, c*1.0::DOUBLE/n AS sh FROM ld JOIN sz USING (cluster) WHERE c*1.0::DOUBLE/n>=.2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d)=1),
    cs AS (SELECT sequence_id, CASE WHEN x THEN r ELSE assigned_rank END AS assigned_rank, CASE WHEN x THEN l ELSE assigned_label END AS assigned_label,
      CASE WHEN x THEN greatest(confidence, sh) ELSE confidence END AS confidence, CASE WHEN x THEN 'knn+consensus' ELSE 'knn' END AS source,
      assigned_rank AS knn_rank, assigned_label AS knn_label, confidence AS knn_confidence
      FROM (SELECT *, coalesce(r IS NOT NULL AND (assigned_rank IS NULL OR (assigned_rank=r AND confidence<sh)),false) AS x FROM base LEFT JOIN wn USING (cluster)))"""


def knn_rows(v):
    voted = A.knn_lca(knn_join(v.vectors, v.vectors, 12), taxa(v), **VOTE)
    return voted.select(
        "sequence_id", "assigned_rank", "assigned_label", "confidence", F.col("assigned_rank").alias("knn_rank"),
        F.col("assigned_label").alias("knn_label"), F.col("confidence").alias("knn_confidence"), F.lit("knn").alias("source"),
    )


def clusters(v):
    c = F.floor(F.col("label") / 3).cast("int")
    return v.vectors.select(F.col("vec_id").alias("sequence_id"), F.when(c == 2, -1).otherwise(c).alias("cluster"))


@query(
    "cluster_consensus",
    f"WITH {NEAR}, {CONS} SELECT sequence_id, assigned_rank, assigned_label, round(confidence,6) AS confidence, source FROM cs",
    "vectors",
)
def _(v):
    out = A.cluster_consensus(knn_rows(v), clusters(v), 0.2)
    return rounded(out.select("sequence_id", "assigned_rank", "assigned_label", "confidence", "source"), "confidence")


def hits(v):
    """Line items as alignment hits of the vectors named by order key."""
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").cast("string").alias("subject_id"),
        (100 - 100 * F.col("l_discount")).alias("identity"),
        F.col("l_quantity").cast("int").alias("align_length"),
        F.lit(1).alias("q_start"),
        (F.col("l_quantity") + F.col("l_linenumber")).cast("int").alias("q_end"),
        F.lit(60).alias("query_length"),
        F.col("l_tax").alias("evalue"),
        F.concat(F.lit("Genus species"), F.lit(" taxid="), F.col("l_partkey").cast("string"), F.lit(" x")).alias("title"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("p"),
    ).withColumn("pos", F.col("p.l_linenumber") * 10000000000 + F.col("p.l_partkey") * 100000 + F.col("p.l_suppkey")).drop("p")


HITS = """hits AS (SELECT l_orderkey AS query_id, l_partkey::VARCHAR AS subject_id, 100-100*l_discount AS identity, l_quantity::INT AS al, 1 AS qs,
      (l_quantity+l_linenumber)::INT AS qe, l_tax AS evalue, l_partkey AS taxid, l_linenumber::BIGINT*10000000000+l_partkey*100000+l_suppkey AS pos FROM lineitem),
    bh AS (SELECT * FROM hits WHERE identity>=97 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY identity DESC, pos)=1)"""


@query(
    "best_hit",
    f"WITH {HITS} SELECT query_id, subject_id, round(identity,6) AS identity, pos FROM bh",
)
def _(v):
    return rounded(A.best_hit(hits(v)).select("query_id", "subject_id", "identity", "pos"), "identity")


@query(
    "first_hit",
    f"WITH {HITS} SELECT query_id, subject_id, round(identity,6) AS identity, pos FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos)=1",
)
def _(v):
    return rounded(A.best_hit(hits(v), mode="first").select("query_id", "subject_id", "identity", "pos"), "identity")


@query(
    "hits_to_assignments",
    f"""WITH {HITS} SELECT o_orderkey AS sequence_id, subject_id AS best_hit, round(coalesce(identity,0),6) AS identity, round(coalesce(al*100.0::DOUBLE/greatest(qe-qs,1),0),6) AS coverage,
      CASE WHEN subject_id IS NULL THEN 'Unknown' ELSE 'Genus species' END AS taxonomy, taxid FROM orders LEFT JOIN bh ON query_id=o_orderkey""",
)
def _(v):
    reads = v.table("orders").select(F.col("o_orderkey").alias("sequence_id"))
    out = A.hits_to_assignments(A.best_hit(hits(v)), reads)
    return rounded(out.select("sequence_id", "best_hit", "identity", "coverage", "taxonomy", "taxid"), "identity", "coverage")


HYBRID = """hy AS (SELECT cs.* EXCLUDE (assigned_rank, assigned_label, confidence, source), CASE WHEN x THEN 'species' ELSE assigned_rank END AS assigned_rank,
      CASE WHEN x THEN 'Genus species' ELSE assigned_label END AS assigned_label, CASE WHEN x THEN greatest(confidence, least(.99, identity/100)) ELSE confidence END AS confidence,
      CASE WHEN x THEN source || '+blast' ELSE source END AS source, CASE WHEN x THEN identity END AS bi, CASE WHEN x THEN 'Genus species' END AS bl
    FROM (SELECT cs.*, identity, coalesce((assigned_rank IS NULL OR (assigned_rank='species' AND confidence<.8)) AND identity>=97,false) AS x
      FROM cs LEFT JOIN bh ON query_id=sequence_id) cs)"""


def hybrid(v):
    rows = A.cluster_consensus(knn_rows(v), clusters(v), 0.2)
    found = A.best_hit(hits(v))
    reads = v.vectors.select(F.col("vec_id").alias("sequence_id"))
    return A.alignment_fallback(rows, A.hits_to_assignments(found, reads))


@query(
    "hybrid_assignment",
    f"WITH {NEAR}, {CONS}, {HITS}, {HYBRID} SELECT sequence_id, assigned_rank, assigned_label, round(confidence,6) AS confidence, source, round(bi,6) AS blast_identity FROM hy",
    "vectors",
)
def _(v):
    cols = ["sequence_id", "assigned_rank", "assigned_label", "confidence", "source", "blast_identity"]
    return rounded(hybrid(v).select(*cols), "confidence", "blast_identity")


@query(
    "tiebreak",
    f"""WITH {NEAR}, {CONS}, {HITS}, {HYBRID} SELECT sequence_id, CASE WHEN bi>=97 THEN 'blast' WHEN knn_confidence>=.8 THEN 'knn' WHEN bi IS NOT NULL THEN 'blast' WHEN knn_confidence IS NOT NULL THEN 'knn' ELSE 'unknown' END AS tiebreak_winner,
      CASE WHEN bi>=97 THEN 'blast_identity>=97.0' WHEN knn_confidence>=.8 THEN 'knn_confidence>=0.8' WHEN bi IS NOT NULL THEN 'blast_identity_fallback' WHEN knn_confidence IS NOT NULL THEN 'knn_confidence_fallback' ELSE 'insufficient_evidence' END AS tiebreak_reason,
      coalesce(knn_rank='species' AND bl IS NOT NULL AND knn_label<>bl,false) AS conflict_flag FROM hy""",
    "vectors",
)
def _(v):
    return A.tiebreak(hybrid(v)).select("sequence_id", "tiebreak_winner", "tiebreak_reason", "conflict_flag")


@query(
    "assignment_conflicts",
    f"""WITH {NEAR}, {CONS}, {HITS}, {HYBRID} SELECT sequence_id, knn_label AS knn_species, bl AS blast_species FROM hy WHERE knn_rank='species' AND bl IS NOT NULL AND knn_label<>bl""",
    "vectors",
)
def _(v):
    return A.conflicts(A.tiebreak(hybrid(v)), ["sequence_id", "knn_species", "blast_species"])


@query("taxon_classifier")
def _(v):
    model, held = A.train_taxon_classifier(v.vectors)
    out = A.classifier_report(model, held)
    return rounded(out, "precision", "recall", "f1", "accuracy")


@query("predict_taxa")
def _(v):
    model, _held = A.train_taxon_classifier(v.vectors)
    return A.predict_taxa(model, v.vectors).withColumn("probability", rnd("probability"))
