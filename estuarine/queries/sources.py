"""Reader and writer queries: tables go out in a format and are read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators.assign import best_hit
from estuarine.queries import query
from estuarine.session import shared_dir
from estuarine.sources import sequences as Q
from estuarine.sources import tables as T

CLEAN = "trim(regexp_replace(description, '\\s+', ' ', 'g'))"


def scratch(v, name):
    return f"{shared_dir(v.spark).rstrip('/')}/files/{uuid.uuid4().hex}/{name}"


@query(
    "fasta_roundtrip",
    f"""SELECT sequence_id::VARCHAR AS sequence_id, trim(sequence_id || ' ' || {CLEAN}) AS description, seq
    FROM reads""",
    "reads",
)
def _(v):
    path = scratch(v, "reads.fasta")
    Q.write_fasta(v.reads, path, description="description")
    return Q.read_fasta(v.spark, path).select("sequence_id", "description", "seq")


@query(
    "fastq_roundtrip",
    """SELECT sequence_id::VARCHAR AS sequence_id, length(seq) AS len, md5(seq) AS seq_md5,
    coalesce(list_sum(qual),0)::BIGINT AS qsum FROM qreads""",
    "qreads",
)
def _(v):
    path = scratch(v, "reads.fastq")
    Q.write_fastq(v.qreads, path)
    back = Q.read_fastq(v.spark, path, max_split=1 << 20)
    total = F.aggregate("qual", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select(
        "sequence_id", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"), total.alias("qsum")
    )


@query(
    "flatfile_roundtrip",
    f"""SELECT 'E' || sequence_id AS sequence_id, {CLEAN} AS description, organism, seq,
      'CHAIN;SIGNAL' AS features FROM reads""",
    "reads",
)
def _(v):
    path = scratch(v, "entries.sp")
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    rows = v.reads
    line = lambda tag, c: F.concat(F.lit(f"{tag}   "), c)
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("ID   E"), F.col("sequence_id").cast("string"), F.lit("   Reviewed;")),
        line("DE", text),
        line("OS", F.col("organism")),
        F.lit("FT   CHAIN           1..9\nFT                   /id=x\nFT   SIGNAL          1..2"),
        F.lit("SQ   SEQUENCE"),
        F.concat(F.lit("     "), "seq"),
        F.lit("//"),
    )
    rows.select(entry.alias("value")).write.text(path)
    out = Q.read_flatfile(v.spark, path, "swiss")
    return out.select(
        "sequence_id", "description", "organism", "seq", F.array_join("feature_types", ";").alias("features")
    )


@query(
    "detect_formats",
    """SELECT CASE doc_id%4 WHEN 0 THEN 'a.fa' WHEN 1 THEN 'b.fastq' WHEN 2 THEN 'c.dat' ELSE 'd.dat' END AS name,
      CASE doc_id%4 WHEN 0 THEN 'fasta' WHEN 3 THEN 'genbank' ELSE 'fastq' END AS format, count(*) AS lines FROM documents GROUP BY ALL""",
)
def _(v):
    folder = scratch(v, "mixed")
    leads = {"a.fa": "x", "b.fastq": "@", "c.dat": "@", "d.dat": "LOCUS "}
    out = []
    for i, (name, lead) in enumerate(leads.items()):
        rows = v.table("documents").filter(F.col("doc_id") % 4 == i)
        rows.select(F.concat(F.lit(lead), F.md5("text"))).write.text(f"{folder}/{name}")
        lines = v.spark.read.text(f"{folder}/{name}").groupBy(F.col("_metadata.file_path").alias("source_file")).agg(F.count(F.lit(1)).alias("lines"))
        found = Q.detect_formats(v.spark, f"{folder}/{name}").join(lines, "source_file")
        out.append(found.select(F.lit(name).alias("name"), "format", "lines"))
    return reduce(DataFrame.unionByName, out).groupBy("name", "format").agg(F.sum("lines").alias("lines"))


@query(
    "labels_roundtrip",
    """SELECT doc_id::VARCHAR AS sequence_id, quality::VARCHAR AS label, NULL::VARCHAR AS genus FROM labels""",
)
def _(v):
    path = scratch(v, "labels.tsv")
    rows = v.table("labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").alias("label"))
    T.write_table(rows, path, "csv", sep="\t")
    back = T.read_labels(v.spark, path)
    return back.select("sequence_id", T.training_label(back).alias("label"), "genus")


@query(
    "taxdump_roundtrip",
    "SELECT taxid, parent, rank, name FROM tax_nodes",
    "tax_nodes",
)
def _(v):
    folder = scratch(v, "dump")
    T.write_taxdump(v.tax_nodes, folder)
    dump = T.read_taxdump(v.spark, folder)
    return dump["nodes"].join(dump["scientific"], "taxid").select("taxid", "parent", "rank", "name")


@query(
    "silva_source",
    """SELECT 'silva' AS source, lower(s_name) AS taxon_key, s_name AS scientific_name, r_name AS superkingdom,
      n_name AS phylum, s_name AS class, 0.9::DOUBLE AS confidence
    FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)
def _(v):
    path = scratch(v, "silva.tsv")
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = s.select(
        F.col("s_suppkey").alias("accession"),
        F.concat_ws(";", "r_name", "n_name", "s_name").alias("taxonomy"),
        F.col("s_name").alias("organism"),
    )
    T.write_table(rows, path, "csv", sep="\t")
    out = T.read_silva(v.spark, path)
    return out.select("source", "taxon_key", "scientific_name", "superkingdom", "phylum", "class", "confidence")


@query(
    "hits_roundtrip",
    """SELECT l_orderkey::VARCHAR AS query_id, count(*) AS hits, round(max(100-100*l_discount),6) AS best
    FROM lineitem GROUP BY 1""",
)
def _(v):
    path = scratch(v, "hits.tsv")
    cols = [f.split(" ")[0] for f in T.HIT_COLUMNS.split(", ")]
    given = {
        "query_id": F.col("l_orderkey").cast("string"),
        "subject_id": F.col("l_partkey").cast("string"),
        "identity": 100 - 100 * F.col("l_discount"),
        "align_length": F.col("l_quantity").cast("int"),
    }
    rows = v.table("lineitem").select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in cols])
    rows.write.option("sep", "\t").csv(path)
    back = T.read_hits(v.spark, path)
    best = best_hit(back, 0.0).select("query_id", rnd("identity").alias("best"))
    return back.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")).join(best, "query_id")


@query(
    "vector_store_roundtrip",
    """SELECT label::VARCHAR AS dataset, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])),4) AS total
    FROM vectors GROUP BY 1""",
    "vectors",
)
def _(v):
    path = scratch(v, "store")
    rows = v.vectors.select(
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("dataset"),
        F.lit("r1").alias("run_id"),
        F.col("vec_id"),
        "embedding",
    )
    T.write_vectors(rows.repartition("dataset"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return T.read_vectors(v.spark, path).groupBy(F.expr("substring(dataset, 2)").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(total), 4).alias("total")
    )


@query(
    "reports_partitioned",
    """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(v):
    path = scratch(v, "reports")
    T.write_reports(v.table("orders").repartition(F.year("o_orderdate")), path, "o_orderdate")
    return v.spark.read.parquet(path).groupBy("year", F.col("month").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "discover_runs",
    """SELECT 'set_' || n_regionkey AS dataset, 'run_' || n_nationkey AS run_id, n_nationkey%2=0 AS has_taxonomy,
      false AS has_novelty FROM nation""",
)
def _(v):
    root = scratch(v, "runs")
    n = v.table("nation").select(
        F.concat(F.lit("set_"), "n_regionkey").alias("dataset"),
        F.concat(F.lit("run_"), "n_nationkey").alias("run_id"),
        (F.col("n_nationkey") % 2 == 0).alias("t"),
        F.col("n_name"),
    )
    _artifact_files(n, root)
    return T.discover_runs(v.spark, root).select("dataset", "run_id", "has_taxonomy", "has_novelty")


def _artifact_files(runs, root):
    """Artifact files written by the tasks that hold the rows."""
    base = Q.qualified(runs.sparkSession, root)

    def put(rows):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        for r in rows:
            name = "taxonomy/taxonomy_predictions.csv" if r.t else "pipeline_results.json"
            target = f"{top}/{r.dataset}/{r.run_id}/{name}"
            system.create_dir(target.rpartition("/")[0])
            with system.open_output_stream(target) as out:
                out.write(r.n_name.encode())

    runs.foreachPartition(put)


@query(
    "coerce_types",
    """SELECT event_id, json_extract(props,'$.k')::INT AS k, strftime(ts,'%Y-%m-%d') AS day,
      event_id%7=0 AS bad FROM events""",
)
def _(v):
    text = v.table("events").select(
        "event_id",
        "props",
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("when"),
        F.date_format("ts", "yyyy-MM-dd").alias("day0"),
    )
    out = T.coerce_types(text, {"when": "timestamp", "props": "json"})
    return out.select(
        "event_id",
        F.expr("variant_get(props, '$.k', 'int')").alias("k"),
        F.coalesce(F.date_format("when", "yyyy-MM-dd"), "day0").alias("day"),
        F.coalesce(F.col("when_raw") == "n/a", F.lit(False)).alias("bad"),
    )


@query(
    "copy_missing",
    """SELECT p_partkey, CASE WHEN p_size<25 THEN 'kept' ELSE p_name END AS p_name FROM part""",
)
def _(v):
    src = v.table("part").select("p_partkey", "p_name")
    dst = v.table("part").filter(F.col("p_size") < 25).select("p_partkey", F.lit("kept").alias("p_name"))
    return T.copy_missing(src, dst, ["p_partkey"])


@query(
    "validate_copy",
    """SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS source_rows,
      (SELECT count(*) FROM nation) AS target_rows, true AS matches UNION ALL
    SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size<25),
      (SELECT count(*) FROM part WHERE p_size>=25)=0""",
)
def _(v):
    nation, part = v.table("nation"), v.table("part")
    return T.validate_copy(
        {"nation": nation, "part": part}, {"nation": nation, "part": part.filter("p_size < 25")}
    )


@query(
    "reference_urls",
    """SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'https://www.gbif.org/species/' || s_suppkey
      WHEN 1 THEN 'https://www.marinespecies.org/aphia.php?p=taxdetails&id=' || s_suppkey
      ELSE 'https://www.google.com/search?q=Other%20' || s_suppkey END AS url FROM supplier""",
)
def _(v):
    db = F.element_at(F.array(F.lit("GBIF"), F.lit("WoRMS"), F.lit("Other")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return v.table("supplier").select(
        "s_suppkey", T.reference_url(db, F.col("s_suppkey").cast("string")).alias("url")
    )


@query(
    "file_hashes",
    """SELECT n_name AS content, md5(n_name || chr(10)) AS md5, sha256(n_name || chr(10)) AS sha256, length(n_name)+1 AS size FROM nation""",
)
def _(v):
    path = scratch(v, "texts")
    names = v.table("nation").select("n_name", F.col("n_name").alias("value"))
    names.write.partitionBy("n_name").text(path)
    out = T.file_hashes(v.spark, path).filter(F.col("path").endswith(".txt"))
    content = F.regexp_extract("path", r"n_name=([^/]+)/", 1)
    return out.select(content.alias("content"), "md5", "sha256", F.col("length").alias("size"))
