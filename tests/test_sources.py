"""Readers on small files written by the tests."""

import gzip

import pytest
from pyspark.sql import functions as F

from estuarine.operators.lineage import resolve_by_name, resolve_by_taxid, tree_paths, main_lineages
from estuarine.sources import sequences as Q
from estuarine.sources import tables as T
from estuarine.sources.lineage_export import export_lineages
from estuarine.streaming import trends as ST


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first one\nACGT\nACGT\n\n>s2\nGG TT\n>s3 x>y\nAC\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z1 zipped\nTTTT\n")
    got = {r.sequence_id: (r.description, r.seq) for r in Q.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {
        "s1": ("s1 first one", "ACGTACGT"), "s2": ("s2", "GGTT"), "s3": ("s3 x>y", "AC"), "z1": ("z1 zipped", "TTTT"),
    }


def test_fasta_other_charset(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">s1 caf\xe9\nAC\xffGT\n")
    r = Q.read_fasta(spark, str(tmp_path)).first()
    assert r.description == "s1 café" and r.seq == "ACNGT"


@pytest.mark.parametrize("split", [1 << 20, 37])
def test_fastq_splits(spark, tmp_path, split):
    """Quality lines that look like headers, cut at every possible place."""
    text = "".join(f"@r{i} d\n{'ACGT' * (1 + i % 5)}\n+\n{'@+I!' * (1 + i % 5)}\n" for i in range(50))
    (tmp_path / "x.fastq").write_text(text)
    with gzip.open(tmp_path / "y.fastq.gz", "wt") as f:
        f.write("@zip\nAC\n+\nII\n")
    rows = Q.read_fastq(spark, str(tmp_path), split).collect()
    assert sorted(r.sequence_id for r in rows) == sorted([f"r{i}" for i in range(50)] + ["zip"])
    assert next(r.qual for r in rows if r.sequence_id == "r0") == [31, 10, 40, 0]


def test_flat_files(spark, tmp_path):
    sp = "ID   P1_HUMAN   Reviewed;\nDE   A protein\nDE   of note.\nOS   Homo sapiens.\nFT   CHAIN   1..4\nFT           /x\nSQ   SEQUENCE 4 AA;\n     MKVL AA\n//\n"
    (tmp_path / "a.sp").write_text(sp + sp.replace("P1_", "P2_"))
    rows = Q.read_flatfile(spark, str(tmp_path / "a.sp"), "swiss").collect()
    assert [r.sequence_id for r in rows] == ["P1_HUMAN", "P2_HUMAN"]
    assert (rows[0].organism, rows[0].description, rows[0].feature_types, rows[0].seq) == ("Homo sapiens", "A protein of note.", ["CHAIN"], "MKVLAA")
    gb = (
        "LOCUS       AB1 12 bp\nDEFINITION  Some gene,\n            partial.\nSOURCE      x\n  ORGANISM  Vibrio fischeri\n            Bacteria.\n"
        "FEATURES             Location\n     source          1..12\n     gene            1..5\nORIGIN\n        1 acgtac gtacgt\n//\n"
    )
    (tmp_path / "b.gb").write_text(gb)
    r = Q.read_flatfile(spark, str(tmp_path / "b.gb"), "genbank").first()
    assert (r.sequence_id, r.organism, r.description) == ("AB1", "Vibrio fischeri", "Some gene, partial.")
    assert r.feature_types == ["source", "gene"] and r.seq == "ACGTACGTACGT"


def test_detect_formats(spark, tmp_path):
    for name, text in (("a.fa", "x"), ("b.fq", "x"), ("c.unknown", "@r"), ("d.unknown", "ID   x"), ("e.embl", "x"), ("f.unknown", "?")):
        (tmp_path / name).write_text(text + "\n")
    with gzip.open(tmp_path / "g.gbk.gz", "wt") as f:
        f.write("x\n")
    got = {r.source_file.rsplit("/", 1)[1]: r.format for r in Q.detect_formats(spark, str(tmp_path)).collect()}
    assert got == {
        "a.fa": "fasta", "b.fq": "fastq", "c.unknown": "fastq", "d.unknown": "swiss", "e.embl": "embl", "f.unknown": "fasta", "g.gbk.gz": "genbank",
    }


def test_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("sequence_id\tclass\tgenus\n1\tA\tVibrio\n")
    df = T.read_labels(spark, str(tmp_path / "l.tsv"))
    r = df.select("*", T.training_label(df).alias("t")).first()
    # a rank column `class` doubles as a label column
    assert (r.sequence_id, r.genus, r.species, r.t) == ("1", "Vibrio", None, "A")
    (tmp_path / "bad.csv").write_text("id,x\n1,2\n")
    with pytest.raises(ValueError):
        T.read_labels(spark, str(tmp_path / "bad.csv"))


def test_taxdump_and_lineage(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text(
        "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tkingdom\t|\n5\t|\t2\t|\tgenus\t|\n9\t|\t5\t|\tspecies\t|\n10\t|\t9\t|\tspecies\t|\n"
    )
    (tmp_path / "names.dmp").write_text(
        "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tMetazoa\t|\t\t|\tscientific name\t|\n2\t|\tOther\t|\t\t|\tscientific name\t|\n"
        "5\t|\tHomo\t|\t\t|\tscientific name\t|\n9\t|\tHomo sapiens\t|\t\t|\tscientific name\t|\n9\t|\thuman\t|\t\t|\tcommon name\t|\n10\t|\tHomo sapiens x\t|\t\t|\tscientific name\t|\n"
    )
    (tmp_path / "merged.dmp").write_text("77\t|\t9\t|\n")
    d = T.read_taxdump(spark, str(tmp_path))
    lin = main_lineages(tree_paths(d["nodes"].join(d["scientific"], "taxid", "left")))
    ids = spark.createDataFrame([(77,), (10,), (123,)], "taxid long")
    got = {r.taxid: (r.kingdom, r.genus, r.species) for r in resolve_by_taxid(ids, lin, d["merged"]).collect()}
    assert got == {77: ("Metazoa", "Homo", "Homo sapiens"), 10: ("Metazoa", "Homo", "Homo sapiens x"), 123: (None, None, None)}
    names = spark.createDataFrame([("HOMO SAPIENS",), ("Nova incognita",)], "name string")
    by = {r.name: (r.genus, r.species) for r in resolve_by_name(names, lin, d["scientific"]).collect()}
    assert by == {"HOMO SAPIENS": ("Homo", "Homo sapiens"), "Nova incognita": (None, "Nova incognita")}


def test_other_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("pr2_accession\tdomain\tphylum\tgenus\tspecies\nA1\tEukaryota\tnan\tVibrio\tVibrio x\n")
    r = T.read_pr2(spark, str(tmp_path / "p.tsv")).select("*").withColumn("s", F.col("scientific_name")).first()
    assert (r.source, r.kingdom, r.phylum, r.genus, r.s) == ("pr2", "Eukaryota", None, "Vibrio", "Vibrio x")
    (tmp_path / "c.json").write_text('[{"scientific_name": "Test Organism", "kingdom": "K", "phylum": "P", "confidence": 0.7}]')
    c = T.read_custom(spark, str(tmp_path / "c.json")).first()
    assert (c.taxon_key, c.kingdom, c.confidence, c.priority) == ("test organism", "K", 0.7, 100)


def test_hits_xml(spark, tmp_path):
    (tmp_path / "h.xml").write_text(
        "<B><Iteration><Iteration_query-def>q1</Iteration_query-def><Iteration_query-len>50</Iteration_query-len><Iteration_hits>"
        "<Hit><Hit_id>s1</Hit_id><Hit_def>Homo sapiens taxon:9606</Hit_def><Hit_hsps><Hsp><Hsp_identity>45</Hsp_identity><Hsp_align-len>50</Hsp_align-len>"
        "<Hsp_query-from>1</Hsp_query-from><Hsp_query-to>50</Hsp_query-to><Hsp_evalue>1e-5</Hsp_evalue><Hsp_bit-score>80</Hsp_bit-score></Hsp></Hit_hsps></Hit>"
        "<Hit><Hit_id>s2</Hit_id><Hit_def>x</Hit_def><Hit_hsps><Hsp><Hsp_identity>1</Hsp_identity><Hsp_align-len>2</Hsp_align-len></Hsp></Hit_hsps></Hit>"
        "</Iteration_hits></Iteration></B>"
    )
    r = T.read_hits_xml(spark, str(tmp_path / "h.xml")).first()
    assert (r.query_id, r.subject_id, r.identity, r.query_length) == ("q1", "s1", 90.0, 50)


def test_exports_escape(spark, tmp_path):
    df = spark.createDataFrame([(7, 'A "q" & <b>', 0.5, "K")], "taxid long, scientific_name string, confidence double, kingdom string")
    export_lineages(df, str(tmp_path / "p"), "phyloxml")
    line = spark.read.text(str(tmp_path / "p")).first()[0]
    assert "A &quot;q&quot; &amp; &lt;b&gt;" in line and "50.0" in line
    export_lineages(df, str(tmp_path / "r"), "rdf")
    assert '\\"q\\"' in spark.read.text(str(tmp_path / "r")).first()[0]
    with pytest.raises(ValueError):
        export_lineages(df, str(tmp_path / "x"), "nexus")


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    r = T.file_hashes(spark, str(tmp_path)).first()
    assert r.sha256 == hashlib.sha256(b"abc").hexdigest() and r.md5 == hashlib.md5(b"abc").hexdigest()


def test_late_rows_are_dropped(spark, tmp_path):
    """A row for a day the watermark passed a batch ago does not count."""
    day = lambda d, n, k: spark.range(n).select(
        F.lit(f"2024-01-{d:02d} 10:00:00").cast("timestamp").alias("ts"), F.col("id").cast("double").alias("v"), (F.col("id") % k).alias("u")
    )
    folder = str(tmp_path / "in")
    for i, df in enumerate([day(1, 4, 2), day(3, 2, 2), day(4, 1, 1), day(1, 5, 5), day(7, 1, 1)]):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/b0").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    ST.run_once(ST.daily_trend(stream, "ts", "v", "u"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {str(r.day): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 4, "2024-01-03": 2, "2024-01-04": 1}


def test_other_line_ends(spark, tmp_path):
    """Files with CR LF give what files with LF give."""
    (tmp_path / "a.fasta").write_bytes(b">s1 first one\r\nACGT\r\nAC\r\n>s2\r\nGG\r\n")
    got = {r.sequence_id: (r.description, r.seq) for r in Q.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"s1": ("s1 first one", "ACGTAC"), "s2": ("s2", "GG")}
    sp = "ID   P{}_HUMAN   Reviewed;\r\nDE   \r\nOS   Homo sapiens.\r\nSQ   SEQUENCE 4 AA;\r\n     MKVL\r\n//\r\n"
    (tmp_path / "a.sp").write_bytes("".join(sp.format(i) for i in range(3)).encode())
    rows = Q.read_flatfile(spark, str(tmp_path / "a.sp"), "swiss").collect()
    assert [(r.sequence_id, r.description, r.organism, r.seq) for r in rows] == [(f"P{i}_HUMAN", "", "Homo sapiens", "MKVL") for i in range(3)]


def test_fastq_cut_off(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nAC\n+\nII\n\n@b d\nACGT\n+\nIIII")
    assert [(r.sequence_id, r.seq) for r in Q.read_fastq(spark, str(tmp_path / "x.fastq")).collect()] == [("a", "AC"), ("b", "ACGT")]
    (tmp_path / "y.fastq").write_text("@a\nAC\n+\nII\n@b\nACGT\n+\n")
    with pytest.raises(Exception, match="cut off"):
        Q.read_fastq(spark, str(tmp_path / "y.fastq")).collect()


def test_fastq_rate(spark, tmp_path):
    """Without Spark, the reader's own loop over records of 250 bases."""
    import time

    from estuarine.sources.fastq import FastqReader, _Range

    text = "".join(f"@r{i} d\n{'ACGTACGTAC' * 25}\n+\n{'I' * 250}\n" for i in range(60_000))
    (tmp_path / "x.fastq").write_text(text)
    path = "file://" + str(tmp_path / "x.fastq")
    begun = time.process_time()
    n = sum(len(b) for b in FastqReader({"path": path}).read(_Range(path, 0, len(text))))
    assert n == 60_000 and len(text) / 1e6 / (time.process_time() - begun) > 30


def test_hits_keep_their_order(spark, tmp_path):
    from estuarine.operators.assign import best_hit

    line = "{}\t{}\t{}" + "\t1" * 10 + "\tt\n"
    (tmp_path / "h.tsv").write_text("".join(line.format("q", f"s{i}", 99.0 if i >= 2 else 98.0) for i in range(6)))
    hits = T.read_hits(spark, str(tmp_path / "h.tsv"))
    assert best_hit(hits).first().subject_id == "s2" and best_hit(hits, mode="first").first().subject_id == "s0"


def test_tree_paths_of_any_depth(spark):
    deep = spark.createDataFrame([(i, max(i - 1, 1), "no rank", f"n{i}") for i in range(1, 301)], "taxid long, parent long, rank string, name string")
    path = tree_paths(deep).filter("taxid = 300").first().path
    assert [x.taxid for x in path] == list(range(300, 0, -1))
    ring = spark.createDataFrame([(1, 3, "x", "a"), (2, 1, "x", "b"), (3, 2, "x", "c"), (4, 1, "x", "d")], "taxid long, parent long, rank string, name string")
    with pytest.raises(ValueError, match="cycle"):
        tree_paths(ring)


def test_streams_restart(spark, tmp_path):
    """A new object and a new run on the same folders go on; nothing is lost or taken twice."""
    root, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    schema = "organism_id long, detection_count long, first_detected timestamp, last_updated timestamp, kind string"
    make = lambda rows: spark.createDataFrame(rows, "organism_id long, created_at string, kind string").withColumn("created_at", F.to_timestamp("created_at"))
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-02 00:00:00", "b")], [(1, "2024-01-03 00:00:00", "c"), (3, "2024-01-01 00:00:00", "d")]]):
        make(rows).coalesce(1).write.parquet(f"{folder}/b{i}")
        stream = spark.readStream.schema(make(rows).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
        ST.upsert_stream(stream, ST.ProfileTable(spark, root, schema, buckets=4), ck)
    table = ST.ProfileTable(spark, root, schema, buckets=4)
    table.merge(table.read(), 0)  # a batch delivered again
    assert {r.organism_id: (r.detection_count, r.kind) for r in table.read().collect()} == {1: (2, "c"), 2: (1, "b"), 3: (1, "d")}


def test_vectors_are_appended_once(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    for i, ids in enumerate([[1, 2, 2], [2, 3], [1, 4]]):
        spark.createDataFrame([("d", "r", v) for v in ids], "dataset string, run_id string, vec_id long").coalesce(1).write.parquet(f"{folder}/b{i}")
        stream = spark.readStream.schema("dataset string, run_id string, vec_id long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
        ST.append_vectors(stream, store, str(tmp_path / "ck"))
    assert sorted(r.vec_id for r in spark.read.parquet(store).collect()) == [1, 2, 3, 4]


def test_open_days_are_there(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1.0, 1), ("2024-01-02 10:00:00", 3.0, 1), ("2024-01-02 11:00:00", 5.0, 2)], "ts string, v double, u int").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ST.run_updates(ST.daily_trend(stream, "ts", "v", "u"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {str(r.day): (r.n, r.avg_value) for r in ST.read_updates(spark, str(tmp_path / "out"), "day").collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-02": (2, 4.0)}
