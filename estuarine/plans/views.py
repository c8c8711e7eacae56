"""Projections of the driver tables into the engine's data model.

`Views` builds them as DataFrames; `SQL` holds the same projections for the
checking side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuarine.functions.sequences import pseudo_phred
from estuarine.session import spread, store, stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


_INGESTED: dict[tuple[str, str], str] = {}


class Views:
    """Lazy domain views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def qreads(self) -> DataFrame:
        """Reads with qualities, taken out of the documents once per session and stored.

        Extracting a sequence from text is costly; as a plain projection it would be
        repeated inside every filter the optimiser pushes down.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INGESTED or not stored(self.spark, _INGESTED[key]):
            seq = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
            rows = spread(self.table("documents")).select(
                F.col("doc_id").alias("sequence_id"),
                F.col("source").alias("sample_id"),
                F.col("lang").alias("organism"),
                F.col("text").alias("description"),
                seq.alias("seq"),
            )
            _INGESTED[key] = store(rows.withColumn("qual", pseudo_phred(F.col("seq"))))
        return self.spark.read.parquet(_INGESTED[key])

    @cached_property
    def reads(self) -> DataFrame:
        return self.qreads.drop("qual")

    @cached_property
    def lines(self) -> DataFrame:
        part = self.table("part")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def abundance(self) -> DataFrame:
        return self.lines.groupBy(
            F.col("l_suppkey").alias("sample_id"), F.col("p_name").alias("taxon")
        ).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def assignments(self) -> DataFrame:
        return self.lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
                "sequence_id"
            ),
            F.col("l_suppkey").alias("report_id"),
            F.col("l_partkey").alias("organism_id"),
            F.col("p_type").alias("kingdom"),
            F.col("p_brand").alias("phylum"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("genus"),
            F.when(F.col("l_returnflag") != "N", F.col("p_name")).alias("species"),
            (1 - 5 * F.col("l_discount")).alias("confidence"),
            F.col("l_tax").alias("novelty_score"),
            (F.col("l_returnflag") == "R").alias("is_novel_candidate"),
            F.col("l_linestatus").alias("validation_status"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("report_id"),
            F.col("s_nationkey").alias("dataset_id"),
            F.col("s_name").alias("report_name"),
        )

    @cached_property
    def datasets(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.alias("dataset_id"),
            F.col("n_name").alias("dataset_name"),
            (F.col("n_regionkey") * 37.5 - 75).cast("double").alias("latitude"),
            (k * 14.0 - 170).cast("double").alias("longitude"),
            (k * k * 10.0).cast("double").alias("depth_meters"),
            (k * 1.5 - 2).cast("double").alias("temperature_celsius"),
            (F.lit(4) + k * 0.25).cast("double").alias("ph_level"),
            F.when(k % 5 != 0, k * 1.6).cast("double").alias("salinity"),
        )

    @cached_property
    def tax_nodes(self) -> DataFrame:
        root = self.spark.sql("SELECT 1L AS taxid, 1L AS parent, 'no rank' AS rank, 'root' AS name")
        kingdoms = self.table("region").selectExpr(
            "10L + r_regionkey AS taxid", "1L AS parent", "'kingdom' AS rank", "r_name AS name"
        )
        phyla = self.table("nation").selectExpr(
            "1000L + n_nationkey AS taxid",
            "10L + n_regionkey AS parent",
            "'phylum' AS rank",
            "n_name AS name",
        )
        species = self.table("supplier").selectExpr(
            "100000L + s_suppkey AS taxid",
            "1000L + s_nationkey AS parent",
            "'species' AS rank",
            "s_name AS name",
        )
        return root.unionByName(kingdoms).unionByName(phyla).unionByName(species)

    @cached_property
    def similarity_log(self) -> DataFrame:
        """Stored pairwise report similarities, one row per order."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("pair_id"),
            (F.col("o_custkey") % 97).alias("report_id_1"),
            (F.col("o_custkey") % 89 + 100).alias("report_id_2"),
            (F.col("o_totalprice") / 500000.0).alias("overall"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")


SQL = {
    "reads": """SELECT doc_id AS sequence_id, source AS sample_id, lang AS organism,
        text AS description,
        upper(regexp_replace(text,'[^ACGTNacgtn]','','g')) AS seq FROM documents""",
    "qreads": """SELECT doc_id AS sequence_id, source AS sample_id, lang AS organism,
        text AS description, s AS seq,
        list_transform(range(1, length(s)+1),
          lambda i: (ascii(substr(s, i, 1)) + (i-1)*7) % 42) AS qual
        FROM (SELECT *, upper(regexp_replace(text,'[^ACGTNacgtn]','','g')) AS s FROM documents)""",
    "abundance": """SELECT l_suppkey AS sample_id, p_name AS taxon, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "assignments": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)
          AS sequence_id, l_suppkey AS report_id, l_partkey AS organism_id,
        p_type AS kingdom, p_brand AS phylum, split_part(p_name,' ',1) AS genus,
        CASE WHEN l_returnflag <> 'N' THEN p_name END AS species, 1-5*l_discount AS confidence,
        l_tax AS novelty_score, l_returnflag = 'R' AS is_novel_candidate,
        l_linestatus AS validation_status, l_shipdate AS created_at
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "reports": """SELECT s_suppkey AS report_id, s_nationkey AS dataset_id,
        s_name AS report_name FROM supplier""",
    "datasets": """SELECT n_nationkey AS dataset_id, n_name AS dataset_name,
        CAST(n_regionkey*37.5-75 AS DOUBLE) AS latitude,
        CAST(n_nationkey*14.0-170 AS DOUBLE) AS longitude,
        CAST(n_nationkey*n_nationkey*10.0 AS DOUBLE) AS depth_meters,
        CAST(n_nationkey*1.5-2 AS DOUBLE) AS temperature_celsius,
        CAST(4+n_nationkey*0.25 AS DOUBLE) AS ph_level,
        CAST(CASE WHEN n_nationkey%5<>0 THEN n_nationkey*1.6 END AS DOUBLE) AS salinity
        FROM nation""",
    "tax_nodes": """SELECT 1::BIGINT AS taxid, 1::BIGINT AS parent, 'no rank' AS rank, 'root' AS name
        UNION ALL SELECT 10+r_regionkey, 1, 'kingdom', r_name FROM region
        UNION ALL SELECT 1000+n_nationkey, 10+n_regionkey, 'phylum', n_name FROM nation
        UNION ALL SELECT 100000+s_suppkey, 1000+s_nationkey, 'species', s_name FROM supplier""",
    "similarity_log": """SELECT o_orderkey AS pair_id, o_custkey % 97 AS report_id_1,
        o_custkey % 89 + 100 AS report_id_2, o_totalprice / 500000.0 AS overall,
        o_orderdate AS created_at FROM orders""",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
}


def with_views(uses: tuple[str, ...], sql: str) -> str:
    """Prefix a checking statement with the views it uses."""
    if not uses:
        return sql
    heads = ", ".join(f"{name} AS ({SQL[name]})" for name in uses)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:].lstrip()}"
    return f"WITH {heads} {body}"
