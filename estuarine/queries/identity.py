"""Organism identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators import identity as I
from estuarine.operators.trends import successive_pairs
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.store import PAIRS


def organisms(v):
    """Parts as organisms; the signature stands for equal name and brand."""
    return v.table("part").select(
        F.col("p_partkey").alias("organism_id"),
        F.left(F.md5("p_name"), F.lit(32)).alias("signature"),
        F.col("p_type").alias("kingdom"),
        F.col("p_brand").alias("phylum"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("genus"),
        F.when(F.col("p_size") != 3, F.col("p_name")).alias("species"),
        "p_size",
    )


ORG = """o AS (SELECT p_partkey AS organism_id, left(md5(p_name),32) AS signature, p_type AS kingdom, p_brand AS phylum,
    split_part(p_name,' ',1) AS genus, CASE WHEN p_size<>3 THEN p_name END AS species, p_size FROM part)"""


def fuzzy_sql(a, b):
    return f"(contains({a},{b}) OR contains({b},{a}) OR (length({a})>3 AND length({b})>3 AND left({a},3)=left({b},3)))"


def tax_sql(x, y):
    terms = []
    for r, w in (("kingdom", 0.1), ("phylum", 0.15), ("genus", 0.2), ("species", 0.3)):
        a, b = f"lower({x}.{r})", f"lower({y}.{r})"
        terms.append(f"CASE WHEN {a}={b} THEN {w} WHEN {fuzzy_sql(a, b)} THEN {w}*0.8 ELSE 0 END")
    return "(" + "+".join(terms) + ")::DOUBLE"


@query(
    "taxonomic_match",
    f"""WITH {ORG} SELECT a.organism_id, round({tax_sql('a', 'b')},6) AS similarity FROM o a JOIN o b ON b.organism_id=a.organism_id+1""",
)
def _(v):
    o = organisms(v)
    ranks = ["kingdom", "phylum", "genus", "species"]
    nxt = o.select((F.col("organism_id") - 1).alias("organism_id"), *[F.col(r).alias(f"{r}_2") for r in ranks])
    sim = I.taxonomic_similarity({r: F.col(r) for r in ranks}, {r: F.col(f"{r}_2") for r in ranks})
    return o.join(nxt, "organism_id").select("organism_id", rnd(sim).alias("similarity"))


@query(
    "organism_names",
    f"""WITH {ORG} SELECT organism_id, 'ORG_' || upper(left(md5(genus || '_' || coalesce(species,'Unknown') || '_' || left(signature,8)),12)) AS generated_id,
      CASE WHEN species IS NOT NULL THEN genus || ' ' || species ELSE genus || ' sp.' END AS organism_name,
      'K__' || kingdom || '; P__' || phylum || '; G__' || genus || CASE WHEN species IS NOT NULL THEN '; S__' || species ELSE '' END AS lineage,
      round(least(1, least(p_size/10.0,1)*.3+(3+(species IS NOT NULL)::INT)/7.0*.4+least(p_size*12/500.0,1)*.3)::DOUBLE,6) AS confidence FROM o""",
)
def _(v):
    none = F.lit(None).cast("string")
    c = F.col
    filled = F.lit(3) + c("species").isNotNull().cast("int")
    return organisms(v).select(
        "organism_id",
        I.organism_id(c("genus"), c("species"), c("signature")).alias("generated_id"),
        I.display_name(c("genus"), c("species"), none, none).alias("organism_name"),
        I.lineage_text({r: c(r) for r in ("kingdom", "phylum", "genus", "species")}).alias("lineage"),
        rnd(I.identification_confidence(c("p_size"), filled, c("p_size") * 12)).alias("confidence"),
    )


@query(
    "kingdom_from_text",
    """SELECT sequence_id, CASE WHEN contains(lower(description),'ther') THEN 'Bacteria' WHEN contains(lower(description),'ent') THEN 'Archaea' END AS kingdom FROM reads""",
    "reads",
)
def _(v):
    words = [("ther", "Bacteria"), ("ent", "Archaea")]
    return v.reads.select("sequence_id", I.kingdom_from_text(F.col("description"), words).alias("kingdom"))


@query(
    "novelty_by_known",
    f"""WITH {ORG}, k AS (SELECT genus, species, count(*) AS c FROM o WHERE p_size<5 GROUP BY 1,2)
    SELECT organism_id, coalesce(c,0) AS known_count, CASE WHEN o.species IS NULL THEN .8::DOUBLE WHEN c IS NULL THEN .9 WHEN c<3 THEN .7 ELSE .3 END AS novelty_score,
      coalesce(NOT (o.species IS NOT NULL AND c>=3),true) AS is_novel_candidate
    FROM o LEFT JOIN k ON k.genus=o.genus AND k.species=o.species WHERE p_size>=5""",
)
def _(v):
    o = organisms(v)
    out = I.novelty_by_known(o.filter("p_size >= 5"), o.filter("p_size < 5"))
    return out.select("organism_id", "known_count", "novelty_score", "is_novel_candidate")


@query(
    "consensus_taxonomy",
    """WITH l AS (SELECT report_id, 'kingdom' AS rank, kingdom AS t, count(*) AS n, min(sequence_id) AS f FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'phylum', phylum, count(*), min(sequence_id) FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'genus', genus, count(*), min(sequence_id) FROM assignments GROUP BY 1,3 UNION ALL
      SELECT report_id, 'species', species, count(*), min(sequence_id) FROM assignments WHERE species IS NOT NULL GROUP BY 1,3),
    r AS (SELECT *, row_number() OVER (PARTITION BY report_id, rank ORDER BY n DESC, f, t) AS k FROM l)
    SELECT report_id, max(t) FILTER (rank='kingdom') AS kingdom, max(t) FILTER (rank='phylum') AS phylum,
      max(t) FILTER (rank='genus') AS genus, max(t) FILTER (rank='species') AS species FROM r WHERE k=1 GROUP BY 1""",
    "assignments",
)
def _(v):
    return I.consensus_taxonomy(v.assignments, "report_id")


@query(
    "group_signature",
    """WITH c AS (SELECT l_suppkey, left(md5(p_name),32) AS signature, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)
    SELECT l_suppkey, signature FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, signature)=1""",
)
def _(v):
    return I.group_signature(v.lines.select("l_suppkey", F.left(F.md5("p_name"), F.lit(32)).alias("signature")), "l_suppkey")


@query(
    "identify_organisms",
    f"""WITH {ORG}, k AS (FROM o WHERE p_size<20), g AS (FROM o WHERE p_size>=20),
      c AS (SELECT g.organism_id AS group_id, k.organism_id AS kid, {tax_sql('g', 'k')} AS t, g.genus=k.genus AND g.species=k.species AS same
        FROM g JOIN k USING (signature)),
      m AS (SELECT group_id, kid, CASE WHEN t>=.8 THEN 1 WHEN same AND (t+1)/2>=.85 THEN 2 END AS tier FROM c),
      b AS (SELECT group_id, kid, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY tier, kid)=1),
      n AS (SELECT genus, species, count(*) AS c FROM k GROUP BY 1,2)
    SELECT organism_id AS group_id, coalesce(kid::VARCHAR, 'ORG_' || upper(left(md5(g.genus || '_' || coalesce(g.species,'Unknown') || '_' || left(signature,8)),12))) AS organism_id,
      kid IS NULL AS is_new, tier AS match_tier, CASE WHEN g.species IS NULL THEN .8::DOUBLE WHEN n.c IS NULL THEN .9 WHEN n.c<3 THEN .7 ELSE .3 END AS novelty_score
    FROM g LEFT JOIN b ON group_id=organism_id LEFT JOIN n ON n.genus=g.genus AND n.species=g.species""",
)
def _(v):
    o = organisms(v)
    groups = o.filter("p_size >= 20").withColumnRenamed("organism_id", "group_id")
    out = I.identify_organisms(groups, o.filter("p_size < 20"))
    return out.select("group_id", "organism_id", "is_new", "match_tier", "novelty_score")


@query(
    "similar_organisms",
    f"""WITH {ORG}, t AS (FROM o WHERE organism_id=11), s AS (SELECT o.organism_id,
        round(((o.signature=t.signature)::INT+{tax_sql('t', 'o')})/2,9) AS s FROM o, t WHERE o.organism_id<>11)
    SELECT organism_id, round(s,6) AS similarity FROM s WHERE s>=.3 ORDER BY s DESC, organism_id LIMIT 25""",
)
def _(v):
    return rounded(I.similar_organisms(organisms(v), 11, 0.3, 25), "similarity")


@query(
    "match_organisms",
    f"""WITH {PAIRS}, {ORG}, m AS (SELECT DISTINCT report_id, organism_id FROM assignments),
      u AS (SELECT report_id_1, report_id_2, organism_id, bool_or(s=1) AS a, bool_or(s=2) AS b FROM (
        SELECT report_id_1, report_id_2, organism_id, 1 AS s FROM pairs JOIN m ON report_id=report_id_1 UNION ALL
        SELECT report_id_1, report_id_2, organism_id, 2 FROM pairs JOIN m ON report_id=report_id_2) GROUP BY 1,2,3),
      e AS (SELECT report_id_1, report_id_2, count(*) FILTER (a AND b) AS exact_matches, count(*) FILTER (a AND NOT b) AS unique_to_1,
        count(*) FILTER (b AND NOT a) AS unique_to_2, round(count(*) FILTER (a AND b)*1.0::DOUBLE/count(*),6) AS jaccard FROM u GROUP BY 1,2),
      s AS (SELECT x.report_id_1, x.report_id_2, count(*) AS sp FROM u x JOIN u y ON x.report_id_1=y.report_id_1 AND x.report_id_2=y.report_id_2
        AND x.a AND NOT x.b AND y.b AND NOT y.a JOIN o p ON p.organism_id=x.organism_id JOIN o q ON q.organism_id=y.organism_id AND p.signature=q.signature
        WHERE (1+{tax_sql('p', 'q')})/2>=.8 GROUP BY 1,2)
    SELECT report_id_1, report_id_2, exact_matches, unique_to_1, unique_to_2, jaccard, coalesce(sp,0) AS similar_pairs
    FROM e LEFT JOIN s USING (report_id_1, report_id_2)""",
    "assignments reports",
)
def _(v):
    members = v.assignments.select("report_id", "organism_id").distinct().join(organisms(v).drop("p_size"), "organism_id")
    out = I.match_organisms(members, successive_pairs(v.reports)).drop("similar_classes")
    return rounded(out, "jaccard")
