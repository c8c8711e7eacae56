"""Taxonomy tree, multi-source and lineage-report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.functions import headers as H
from estuarine.functions.mathx import rnd
from estuarine.operators import lineage as L
from estuarine.operators.ranks import RANKS
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.sources import scratch
from estuarine.sources import tables as T
from estuarine.sources.lineage_export import FORMATS, export_lineages

CLOSURE = """up(taxid, pt, d) AS (SELECT taxid, taxid, 0 FROM tax_nodes UNION ALL
      SELECT up.taxid, n.parent, d+1 FROM up JOIN tax_nodes n ON n.taxid=up.pt WHERE n.parent<>n.taxid),
    lin AS (SELECT up.taxid, arg_min(name, d) FILTER (rank='kingdom') AS kingdom, arg_min(name, d) FILTER (rank='phylum') AS phylum,
      arg_min(name, d) FILTER (rank='species') AS species, count(*) AS depth FROM up JOIN tax_nodes n ON n.taxid=up.pt GROUP BY 1)"""
NULLS = ", ".join(f"NULL::VARCHAR AS {r if r != 'order' else chr(34) + 'order' + chr(34)}" for r in ("class", "order", "family", "genus"))


def paths(v):
    return L.tree_paths(v.tax_nodes)


def merged(v):
    """Retired ids of the suppliers."""
    k = F.col("s_suppkey")
    return v.table("supplier").select((k + 900000).alias("old_taxid"), (k + 100000).alias("taxid"))


@query(
    "tree_closure",
    f"WITH RECURSIVE {CLOSURE} SELECT taxid, depth FROM lin",
    "tax_nodes",
)
def _(v):
    return paths(v).select("taxid", F.size("path").cast("long").alias("depth"))


@query(
    "resolve_by_taxid",
    f"""WITH RECURSIVE {CLOSURE}, ids AS (SELECT taxid FROM tax_nodes UNION ALL SELECT 900000+s_suppkey FROM supplier UNION ALL SELECT 5)
    SELECT ids.taxid, CASE WHEN ids.taxid>=900000 THEN ids.taxid-800000 ELSE ids.taxid END AS current_taxid, kingdom, phylum, {NULLS}, species
    FROM ids LEFT JOIN lin ON lin.taxid=CASE WHEN ids.taxid>=900000 THEN ids.taxid-800000 ELSE ids.taxid END""",
    "tax_nodes",
)
def _(v):
    ids = v.tax_nodes.select("taxid").unionByName(merged(v).select(F.col("old_taxid").alias("taxid")))
    ids = ids.unionByName(v.spark.sql("SELECT 5L AS taxid"))
    return L.resolve_by_taxid(ids, L.main_lineages(paths(v)), merged(v))


@query(
    "resolve_by_name",
    f"""WITH RECURSIVE {CLOSURE}, q AS (SELECT upper(s_name) AS name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT lower(n_name) FROM nation)
    SELECT q.name, n.taxid, kingdom, phylum, coalesce(species, q.name) AS species FROM q LEFT JOIN tax_nodes n ON lower(n.name)=lower(q.name)
      LEFT JOIN lin ON lin.taxid=n.taxid""",
    "tax_nodes",
)
def _(v):
    names = v.table("supplier").select(F.upper("s_name").alias("name"))
    names = names.unionByName(v.table("customer").select(F.col("c_name").alias("name")))
    names = names.unionByName(v.table("nation").select(F.lower("n_name").alias("name")))
    out = L.resolve_by_name(names, L.main_lineages(paths(v)), v.tax_nodes.select("taxid", "name"))
    return out.select("name", "taxid", "kingdom", "phylum", "species")


@query(
    "resolve_enhanced",
    f"""WITH RECURSIVE {CLOSURE} SELECT t.taxid, t.name AS scientific_name, kingdom, phylum, species, 1.0::DOUBLE AS confidence,
      (kingdom IS NOT NULL)::INT+(phylum IS NOT NULL)::INT+(species IS NOT NULL)::INT AS ranks FROM tax_nodes t JOIN lin USING (taxid)""",
    "tax_nodes",
)
def _(v):
    out = L.resolve_enhanced(v.tax_nodes.select("taxid"), paths(v), v.tax_nodes.select("taxid", "name"))
    at = lambda r: F.try_element_at("lineage", F.lit(r)).alias(r)
    return out.select(
        "taxid", "scientific_name", at("kingdom"), at("phylum"), at("species"), "confidence", F.size("lineage").alias("ranks")
    )


def all_names(v):
    """Scientific names of all nodes, common names and synonyms from the customers of a nation."""
    sci = v.tax_nodes.select("taxid", "name", F.lit("scientific name").alias("name_class"))
    extra = v.table("customer").select(
        (F.col("c_nationkey") + 1000).cast("long").alias("taxid"),
        F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_acctbal") > 0, "common name").otherwise("synonym").alias("name_class"),
    )
    return sci.unionByName(extra)


@query(
    "taxon_names",
    """SELECT DISTINCT 1000+c_nationkey::BIGINT AS taxid, CASE WHEN c_acctbal>0 THEN 'common' ELSE 'synonym' END AS kind, c_mktsegment AS name FROM customer""",
)
def _(v):
    return L.taxon_names(all_names(v))


@query(
    "search_common_name",
    """SELECT 1000+c_nationkey::BIGINT AS taxid, min(c_mktsegment) AS common_name, any_value(n_name) AS scientific_name
    FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal>0 AND c_mktsegment ILIKE '%build%' GROUP BY 1""",
)
def _(v):
    return L.search_common_name(all_names(v), "Build", v.tax_nodes.select("taxid", "name"))


@query(
    "taxdump_stats",
    """WITH k AS (SELECT DISTINCT c_nationkey, c_acctbal>0 AS common FROM customer)
    SELECT 'total_nodes' AS statistic, '' AS item, count(*) AS n FROM tax_nodes UNION ALL SELECT 'total_names', '', count(*) FROM tax_nodes UNION ALL
    SELECT 'with_common_names', '', count(*) FILTER (common) FROM k UNION ALL SELECT 'with_synonyms', '', count(*) FILTER (NOT common) FROM k UNION ALL
    SELECT 'merged_taxids', '', count(*) FROM supplier UNION ALL SELECT 'rank', rank, count(*) FROM tax_nodes GROUP BY 2""",
    "tax_nodes",
)
def _(v):
    return L.taxdump_stats(v.tax_nodes, all_names(v), merged(v))




@query(
    "lineage_confidence",
    """WITH e AS (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN 'silva' WHEN 2 THEN 'blast_hit' WHEN 3 THEN 'ncbi_taxdump' ELSE 'other' END AS s,
        1-l_discount AS c FROM lineitem), w AS (SELECT *, CASE s WHEN 'silva' THEN .9 WHEN 'blast_hit' THEN .7 WHEN 'ncbi_taxdump' THEN 1 ELSE .5 END::DOUBLE AS w FROM e)
    SELECT l_suppkey, round(sum(c*w)/sum(w),6) AS confidence, count(*) AS evidence_count FROM w GROUP BY 1""",
)
def _(v):
    return rounded(L.lineage_confidence(evidence(v), "l_suppkey"), "confidence")


def evidence(v):
    source = F.when(F.col("l_linenumber") == 1, "silva").when(F.col("l_linenumber") == 2, "blast_hit").when(
        F.col("l_linenumber") == 3, "ncbi_taxdump"
    ).otherwise("other")
    return v.table("lineitem").select("l_suppkey", source.alias("source"), (1 - F.col("l_discount")).alias("confidence"))


def taxonomy_sources(v):
    """Three overlapping sources named by part names and brands."""
    part = v.table("part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    base = part.groupBy("p_name").agg(F.min("p_brand").alias("b"), F.max("p_brand").alias("b2"), F.min("p_type").alias("t"), F.max("p_type").alias("t2"))
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    silva = base.select(F.col("p_name").alias("scientific_name"), F.col("t").alias("superkingdom"), F.col("b").alias("phylum"))
    pr2 = base.filter(~word.isin("red", "blue")).select(
        F.col("p_name").alias("scientific_name"), F.col("t2").alias("kingdom"), F.col("b2").alias("phylum"), word.alias("genus")
    )
    custom = base.filter(word.isin("small", "red")).select(
        F.col("p_name").alias("scientific_name"), F.lit("Custom").alias("kingdom"), F.lit(0.6).alias("confidence")
    )
    parts = [T.as_lineages(silva, "silva"), T.as_lineages(pr2, "pr2"), T.as_lineages(custom, "custom")]
    return reduce(DataFrame.unionByName, parts)


SOURCES = """b AS (SELECT p_name, split_part(p_name,' ',1) AS w, min(p_brand) AS b, max(p_brand) AS b2, min(p_type) AS t, max(p_type) AS t2 FROM part GROUP BY 1),
    src AS (SELECT 'silva' AS source, 90 AS priority, p_name AS name, t AS superkingdom, NULL::VARCHAR AS kingdom, b AS phylum, NULL::VARCHAR AS genus, .9::DOUBLE AS c, .9::DOUBLE AS w FROM b
      UNION ALL SELECT 'pr2', 85, p_name, NULL, t2, b2, w, .9, .9 FROM b WHERE w NOT IN ('red','blue')
      UNION ALL SELECT 'custom', 100, p_name, NULL, 'Custom', NULL, NULL, .6, .5 FROM b WHERE w IN ('small','red'))"""


@query(
    "resolve_multi",
    f"""WITH {SOURCES}, o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source<>'pr2', priority DESC) AS pos FROM src),
      bp AS (SELECT name, arg_min(priority, pos) AS bp FROM o GROUP BY 1), z AS (SELECT o.*, priority>bp AS hi FROM o JOIN bp USING (name))
    SELECT name, coalesce(arg_max(superkingdom,pos) FILTER (hi), arg_min(superkingdom,pos)) AS superkingdom,
      coalesce(arg_max(kingdom,pos) FILTER (hi), arg_min(kingdom,pos)) AS kingdom, coalesce(arg_max(phylum,pos) FILTER (hi), arg_min(phylum,pos)) AS phylum,
      coalesce(arg_max(genus,pos) FILTER (hi), arg_min(genus,pos)) AS genus, round(sum(c*w)/sum(w),6) AS confidence, count(*)>1 AS reconciled,
      string_agg(source, ',' ORDER BY pos) AS sources FROM z GROUP BY 1""",
)
def _(v):
    names = v.table("part").select(F.col("p_name").alias("name"))
    out = L.resolve_multi(names, taxonomy_sources(v), prefer="pr2")
    return out.select(
        "name", "superkingdom", "kingdom", "phylum", "genus", rnd("confidence").alias("confidence"), "reconciled",
        F.array_join("sources", ",").alias("sources"),
    )


@query(
    "resolve_partial",
    f"""WITH {SOURCES}, q AS (SELECT DISTINCT split_part(p_name,' ',2) AS name FROM part)
    SELECT q.name, min(s.name) AS scientific_name FROM q JOIN src s ON s.source='silva' AND contains(lower(s.name), lower(q.name)) GROUP BY 1""",
)
def _(v):
    names = v.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return L.resolve_multi(names, taxonomy_sources(v)).select("name", "scientific_name")


@query(
    "search_sources",
    f"""WITH {SOURCES} SELECT source, lower(name) AS taxon_key FROM src WHERE contains(name,'ring') ORDER BY priority DESC, name LIMIT 12""",
)
def _(v):
    return L.search_sources(taxonomy_sources(v), "Ring", 12).select("source", "taxon_key")


@query(
    "source_statistics",
    f"WITH {SOURCES} SELECT source, max(priority) AS priority, count(*) AS loaded_rows, count(DISTINCT name) AS distinct_taxa FROM src GROUP BY 1",
)
def _(v):
    return L.source_statistics(taxonomy_sources(v))


@query(
    "apply_overrides",
    """SELECT p_partkey, CASE WHEN p_name='red widget' THEN 'Manual' ELSE p_type END AS kingdom, CASE WHEN p_name='red widget' THEN NULL ELSE p_brand END AS phylum,
      p_name='red widget' AS overridden FROM part""",
)
def _(v):
    lin = v.table("part").select("p_partkey", F.col("p_name").alias("scientific_name"), F.col("p_type").alias("kingdom"), F.col("p_brand").alias("phylum"))
    ov = v.spark.sql("SELECT 'Red Widget' AS scientific_name, 'Manual' AS kingdom")
    return L.apply_overrides(lin, ov).select("p_partkey", "kingdom", "phylum", "overridden")


@query(
    "lookup_lineage",
    f"""WITH RECURSIVE {CLOSURE}, q AS (SELECT DISTINCT s_suppkey+100000 AS t, (s_suppkey+100000)::VARCHAR AS identifier FROM supplier UNION ALL SELECT NULL, p_name FROM (SELECT DISTINCT p_name FROM part)
        UNION ALL SELECT 1000+n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT NULL::BIGINT, c_name FROM customer),
      m AS (SELECT p_name, min(p_brand) AS b FROM part GROUP BY 1)
    SELECT identifier, kingdom, coalesce(lin.phylum, b) AS phylum, coalesce(species, CASE WHEN regexp_full_match(identifier,'[0-9]+') THEN NULL ELSE identifier END) AS species,
      CASE WHEN lin.taxid IS NOT NULL THEN 'tree' WHEN b IS NOT NULL THEN 'sources' ELSE 'name' END AS resolved_by
    FROM q LEFT JOIN lin ON lin.taxid=t LEFT JOIN m ON p_name=identifier""",
    "tax_nodes",
)
def _(v):
    ids = v.table("supplier").select((F.col("s_suppkey") + 100000).cast("string").alias("identifier"))
    for t, c in (("part", "p_name"), ("nation", "n_name"), ("customer", "c_name")):
        ids = ids.unionByName(v.table(t).select(F.col(c).alias("identifier")))
    ids = ids.distinct()
    silva = taxonomy_sources(v).filter("source = 'silva'")
    multi = L.resolve_multi(ids, silva, "identifier", partial=None).withColumnRenamed("identifier", "name")
    out = L.lookup_lineage(ids, L.main_lineages(paths(v)), v.tax_nodes.select("taxid", "name"), multi)
    return out.select("identifier", "kingdom", "phylum", "species", "resolved_by")


@query(
    "align_labels",
    """SELECT sequence_id, quality::VARCHAR AS species0, coalesce(quality::VARCHAR, description) AS species FROM reads LEFT JOIN labels ON doc_id=sequence_id""",
    "reads",
)
def _(v):
    labels = v.table("labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").cast("string").alias("species"))
    labels = labels.withColumn("species0", F.col("species"))
    return L.align_labels(v.reads.select("sequence_id", "description"), labels).select("sequence_id", "species0", "species")


def name_table(v):
    """Names for the labelled documents, plus unit names that hold numbers."""
    return v.table("labels").select(
        F.col("doc_id").alias("sequence_id"), F.concat(F.lit("Named taxon "), F.col("doc_id") + 500).alias("name"), F.col("doc_id").alias("pos")
    )


NAMES = """nt AS (SELECT doc_id AS sequence_id, 'Named taxon ' || (doc_id+500) AS name, doc_id AS pos FROM labels),
    held AS (SELECT r.sequence_id, arg_min(name, pos) AS held FROM reads r JOIN nt ON contains(nt.name, r.sequence_id::VARCHAR) GROUP BY 1),
    nm AS (SELECT r.sequence_id, r.seq, coalesce(nt.name, held, trim(coalesce(nullif(regexp_extract(description,'(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]+\\s+[a-z][a-z\\-]*[a-z])(?:$|[^\\p{L}\\p{N}_])',1),''),
      nullif(regexp_extract(description,'\\[([^\\]]+)\\]',1),'')))) AS name FROM reads r LEFT JOIN nt USING (sequence_id) LEFT JOIN held USING (sequence_id))"""


@query("attach_names", f"WITH {NAMES} SELECT sequence_id, name FROM nm", "reads")
def _(v):
    return L.attach_names(v.reads, name_table(v)).select("sequence_id", "name")


@query(
    "prepare_references",
    f"""WITH {NAMES}, f AS (SELECT seq, min(sequence_id) AS sequence_id FROM reads WHERE length(seq)>=60
        AND (length(seq)-length(replace(seq,'N','')))*1.0::DOUBLE/length(seq)<=.5 GROUP BY 1)
    SELECT f.sequence_id, name, 0::BIGINT AS taxid, name AS species FROM f JOIN nm USING (sequence_id)""",
    "reads",
)
def _(v):
    half = [v.reads.filter("sequence_id < 500"), v.reads.filter("sequence_id >= 500")]
    out = L.prepare_references(half, name_table(v), L.main_lineages(paths(v)), v.tax_nodes.select("taxid", "name"), max_n=0.5)
    return out.select("sequence_id", "name", "taxid", "species")


@query(
    "header_patterns",
    """SELECT page_id, nullif(regexp_extract(html,'(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]+\\s+[a-z][a-z\\-]*[a-z])(?:$|[^\\p{L}\\p{N}_])',1),'') AS binomial,
      CASE WHEN page_id%2=0 THEN page_id END AS taxid FROM pages""",
)
def _(v):
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x taxon:"), F.col("page_id"), F.lit(" y"))).otherwise(F.lit("none"))
    name = F.regexp_extract("html", H.NAME_PATTERNS[0], 1)
    return v.table("pages").select("page_id", F.when(name != "", name).alias("binomial"), H.taxid(title).alias("taxid"))


def lineages(v):
    """One lineage per part."""
    return v.table("part").select(
        F.col("p_partkey").alias("taxid"),
        F.col("p_name").alias("scientific_name"),
        (F.col("p_size") / 50.0).alias("confidence"),
        F.col("p_type").alias("kingdom"),
        F.col("p_brand").alias("phylum"),
        F.when(F.col("p_size") > 5, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("genus"),
        F.col("p_name").alias("species"),
    )


def lineage_evidence(v):
    source = F.when(F.col("l_returnflag") == "A", "silva").when(F.col("l_returnflag") == "R", "pr2").otherwise("blast_hit")
    return v.table("lineitem").select(F.col("l_partkey").alias("taxid"), source.alias("source"))


LIN = """li AS (SELECT p_partkey AS taxid, p_name AS scientific_name, p_size/50.0::DOUBLE AS confidence, p_type AS kingdom, p_brand AS phylum,
      CASE WHEN p_size>5 THEN split_part(p_name,' ',1) END AS genus, p_name AS species FROM part),
    ev AS (SELECT l_partkey AS taxid, CASE l_returnflag WHEN 'A' THEN 'silva' WHEN 'R' THEN 'pr2' ELSE 'blast_hit' END AS source FROM lineitem)"""


@query(
    "lineage_statistics",
    f"""WITH {LIN} SELECT 'totals' AS section, 'total_lineages' AS item, count(*) AS n, NULL::DOUBLE AS value FROM li UNION ALL
    SELECT 'totals', 'with_taxid', count(taxid), NULL FROM li UNION ALL SELECT 'totals', 'avg_confidence', count(*), round(avg(confidence),6) FROM li UNION ALL
    SELECT 'rank_coverage', 'kingdom', count(kingdom), round(count(kingdom)*100.0::DOUBLE/count(*),6) FROM li UNION ALL
    SELECT 'rank_coverage', 'phylum', count(phylum), round(count(phylum)*100.0::DOUBLE/count(*),6) FROM li UNION ALL
    SELECT 'rank_coverage', 'genus', count(genus), round(count(genus)*100.0::DOUBLE/count(*),6) FROM li UNION ALL
    SELECT 'rank_coverage', 'species', count(species), round(count(species)*100.0::DOUBLE/count(*),6) FROM li UNION ALL
    SELECT 'evidence', source, count(*), NULL FROM ev GROUP BY 2 UNION ALL SELECT 'totals', 'external_refs', count(*), NULL FROM part""",
)
def _(v):
    return rounded(L.lineage_statistics(lineages(v), lineage_evidence(v), v.table("part")), "value")


@query(
    "lineage_tree",
    f"""WITH {LIN}, s AS (SELECT li.*, source FROM li LEFT JOIN ev USING (taxid)), p AS (
      SELECT taxid, kingdom AS path, '' AS parent, 'kingdom' AS rank, kingdom AS name, confidence, source FROM s UNION ALL
      SELECT taxid, kingdom || ';' || phylum, kingdom, 'phylum', phylum, confidence, source FROM s UNION ALL
      SELECT taxid, kingdom || ';' || phylum || ';' || genus, kingdom || ';' || phylum, 'genus', genus, confidence, source FROM s WHERE genus IS NOT NULL UNION ALL
      SELECT taxid, kingdom || ';' || phylum || coalesce(';' || genus,'') || ';' || species, kingdom || ';' || phylum || coalesce(';' || genus,''), 'species', species, confidence, source FROM s)
    SELECT path, parent, rank, name, count(DISTINCT taxid) AS n_taxa, round(max(confidence),6) AS max_confidence,
      coalesce(string_agg(DISTINCT source, ',' ORDER BY source),'') AS evidence_sources FROM p GROUP BY 1,2,3,4""",
)
def _(v):
    out = L.lineage_tree(lineages(v), lineage_evidence(v), "taxid")
    return rounded(out.withColumn("evidence_sources", F.array_join("evidence_sources", ",")), "max_confidence")


@query(
    "confidence_matrix",
    f"""WITH {LIN} SELECT taxid, round(confidence,6) AS kingdom, round(confidence,6) AS phylum,
      round(CASE WHEN genus IS NOT NULL THEN confidence ELSE 0 END,6) AS genus, round(confidence,6) AS species FROM li""",
)
def _(v):
    return rounded(L.confidence_matrix(lineages(v), "taxid"), "kingdom", "phylum", "genus", "species")


@query(
    "lineage_exports",
    "SELECT f AS format, count(*) AS n FROM part CROSS JOIN (VALUES ('json'),('csv'),('tsv'),('xml'),('json-ld'),('rdf'),('phyloxml')) t(f) GROUP BY 1",
)
def _(v):
    rows = lineages(v)
    parts = []
    for fmt in FORMATS:
        path = scratch(v, f"lineages.{fmt}")
        export_lineages(rows, path, fmt)
        if fmt in ("csv", "tsv"):
            back = T.read_delimited(v.spark, path, "\t" if fmt == "tsv" else ",")
        elif fmt == "xml":
            back = v.spark.read.format("xml").option("rowTag", "lineage").schema("taxid long").load(path)
        else:
            back = v.spark.read.text(path)
        parts.append(back.agg(F.count(F.lit(1)).alias("n")).select(F.lit(fmt).alias("format"), "n"))
    return reduce(DataFrame.unionByName, parts)
