"""Read cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions import sequences as S
from estuarine.functions.mathx import rnd
from estuarine.operators import chimeras as H
from estuarine.operators import reads as R
from estuarine.plans.profile import profile_dataset
from estuarine.queries import query
from estuarine.queries.assignment import half_sql
from estuarine.queries.diversity import rounded
from estuarine.session import spread

# The driver's text-derived reads hold many N, so the limits are set wide.
WIDE = {"max_len": 2000, "max_n": 250, "quality": 20.0}
PASS = """length(seq) BETWEEN 50 AND 2000 AND length(seq)-length(replace(seq,'N',''))<=250
    AND coalesce(list_avg(qual)>=20, true)"""


@query(
    "quality_filter",
    f"SELECT sequence_id, sample_id, length(seq) AS len FROM qreads WHERE {PASS}",
    "qreads",
)
def _(v):
    return R.quality_filter(v.qreads, **WIDE).select("sequence_id", "sample_id", F.length("seq").alias("len"))


@query(
    "filter_stats",
    f"""SELECT sample_id, count(*) AS total_sequences,
      count(*) FILTER (length(seq) BETWEEN 50 AND 2000) AS passed_length,
      count(*) FILTER (coalesce(list_avg(qual)>=20,true)) AS passed_quality,
      count(*) FILTER (length(seq)-length(replace(seq,'N',''))<=250) AS passed_n_filter,
      count(*) FILTER ({PASS}) AS final_passed, round(avg(({PASS})::INT),6) AS pass_rate
    FROM qreads GROUP BY 1""",
    "qreads",
)
def _(v):
    return rounded(R.filter_stats(v.qreads, **WIDE), "pass_rate")


EDNA = """length(seq) BETWEEN 50 AND 500 AND coalesce(list_avg(qual)>=20,true)
    AND (length(seq)-length(replace(seq,'N','')))*1.0::DOUBLE/length(seq)<=0.5"""


@query(
    "edna_filter",
    f"""SELECT sequence_id, sample_id, 'SRA_' || sample_id || '_' ||
      (row_number() OVER (PARTITION BY sample_id ORDER BY sequence_id)-1) AS read_name
    FROM qreads WHERE {EDNA}""",
    "qreads",
)
def _(v):
    return R.edna_filter(v.qreads, max_n=0.5).select("sequence_id", "sample_id", "read_name")


PATTERN = R.adapter_pattern(R.ADAPTERS)
TRIM_SQL = f"""cut AS (
    WITH b AS (SELECT sequence_id, unnest(qual) AS q, generate_subscripts(qual, 1) AS i FROM qreads),
    c AS (SELECT sequence_id, i, sum(20-q) OVER (PARTITION BY sequence_id ORDER BY i DESC
            ROWS UNBOUNDED PRECEDING) AS s FROM b),
    d AS (SELECT sequence_id, i, s, min(s) OVER (PARTITION BY sequence_id ORDER BY i DESC
            ROWS UNBOUNDED PRECEDING) AS low FROM c)
    SELECT sequence_id, max_by(i-1, struct_pack(s := s, i := i)) AS keep FROM d WHERE low>=0 AND s>0 GROUP BY 1),
  trimmed AS (SELECT q.sequence_id, q.sample_id,
      regexp_replace(regexp_replace(substr(seq,1,coalesce(keep,length(seq))::INT),'{PATTERN}',''),'{PATTERN}','') AS seq,
      qual FROM qreads q LEFT JOIN cut USING (sequence_id)),
  kept AS (SELECT * REPLACE (qual[1:length(seq)] AS qual) FROM trimmed WHERE length(seq)>=50)"""


@query(
    "trim_adapters",
    f"WITH {TRIM_SQL} SELECT sequence_id, length(seq) AS len, md5(seq) AS seq_md5, list_sum(qual)::BIGINT AS qsum FROM kept",
    "qreads",
)
def _(v):
    total = F.aggregate("qual", F.lit(0).cast("long"), lambda a, x: a + x)
    return R.trim_adapters(v.qreads, error_rate=0).select(
        "sequence_id", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"), total.alias("qsum")
    )


@query(
    "preprocess_steps",
    f"""WITH {TRIM_SQL}, a AS (SELECT sample_id, count(*) AS input_reads FROM qreads GROUP BY 1),
      b AS (SELECT sample_id, count(*) AS t, count(*) FILTER ({PASS}) AS q FROM kept GROUP BY 1)
    SELECT sample_id, input_reads, coalesce(t,0) AS after_trimming, coalesce(q,0) AS after_quality,
      round(coalesce(q,0)*1.0::DOUBLE/input_reads,6) AS kept_share FROM a LEFT JOIN b USING (sample_id)""",
    "qreads",
)
def _(v):
    return rounded(R.preprocess_steps(v.qreads, error_rate=0, **WIDE), "kept_share")


def removal_sql(name, source):
    """`source` (sequence_id, seq) with the best adapter match and what follows it cut off, as CTEs that end in `name`."""
    whole, ends = [], []
    for a in R.ADAPTERS:
        for w in range(len(a) - 1, len(a) + 2):
            whole.append(f"SELECT sequence_id, i, {len(a)}-2*e AS score FROM (SELECT sequence_id, i, levenshtein(substr(seq,i,{w}),'{a}') AS e FROM {name}s WHERE i+{w - 1}<=length(seq)) WHERE e<=1")
        for n in range(3, len(a)):
            k = n // 10
            for w in range(n - k, n + k + 1):
                e = f"levenshtein(right(seq,{w}),'{a[:n]}')"
                ends.append(f"SELECT sequence_id, length(seq)-{w - 1} AS i, {n}-2*{e} AS score FROM {source} WHERE length(seq)>={w} AND {e}<={k}")
    return f"""{name}s AS (SELECT sequence_id, seq, unnest(range(1, length(seq)+1)) AS i FROM {source}),
      {name}m AS ({" UNION ALL ".join(whole + ends)}),
      {name}b AS (SELECT sequence_id, i FROM {name}m QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY score DESC, i)=1),
      {name} AS (SELECT s.sequence_id, CASE WHEN i IS NULL THEN seq ELSE left(seq,(i-1)::INT) END AS seq FROM {source} s LEFT JOIN {name}b USING (sequence_id))"""


TOLERANT_SQL = TRIM_SQL[: TRIM_SQL.index("trimmed AS")] + f"""raw AS (SELECT q.sequence_id, substr(seq,1,coalesce(keep,length(seq))::INT) AS seq FROM qreads q LEFT JOIN cut USING (sequence_id)),
  {removal_sql('once', 'raw')}, {removal_sql('twice', 'once')},
  kept AS (SELECT sequence_id, q.sample_id, t.seq, q.qual[1:length(t.seq)] AS qual FROM twice t JOIN qreads q USING (sequence_id) WHERE length(t.seq)>=50)"""


@query(
    "trim_adapters_errors",
    f"WITH {TOLERANT_SQL} SELECT sequence_id, length(seq) AS len, md5(seq) AS seq_md5, list_sum(qual)::BIGINT AS qsum FROM kept",
    "qreads",
)
def _(v):
    total = F.aggregate("qual", F.lit(0).cast("long"), lambda a, x: a + x)
    return R.trim_adapters(v.qreads).select(
        "sequence_id", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"), total.alias("qsum")
    )


def breaks_sql(share, gain):
    """CTEs after u (id, seq, size): c with the best pair of parents and breakpoint of each sequence that has one."""
    parts = [f"substr(seq, (length(seq)*{i}//4+1)::INT, (length(seq)*{i + 1}//4-length(seq)*{i}//4)::INT)" for i in range(4)]
    pieces = [half_sql(f"p{i}", x).replace("s>=.6", f"s>={share}") for i, x in enumerate(parts)]
    return f"""pk AS (SELECT DISTINCT id, w FROM (SELECT id, substr(seq, unnest(range(1, length(seq)-6)), 8) AS w FROM u) WHERE NOT contains(w,'N')),
      {", ".join(pieces)}, cand AS ({" UNION ".join(f"FROM p{i}b" for i in range(4))}),
      pos AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY o) AS i, count(*) OVER (PARTITION BY id) AS n
        FROM (SELECT id, unnest(range(1, length(seq)-6)) AS o, substr(seq, unnest(range(1, length(seq)-6)), 8) AS w FROM u WHERE id IN (SELECT id FROM cand)) WHERE NOT contains(w,'N')),
      vote AS (SELECT p.id, r, i, n, (k.w IS NOT NULL)::INT AS v FROM pos p JOIN cand USING (id) LEFT JOIN pk k ON k.id=r AND k.w=p.w),
      run AS (SELECT *, sum(v) OVER (PARTITION BY id, r ORDER BY i) AS p, sum(v) OVER (PARTITION BY id, r) AS t FROM vote),
      c AS (SELECT a.id, a.r AS left_parent, b.r AS right_parent, a.i AS breakpoint, a.p+b.t-b.p AS votes, max(greatest(a.t,b.t)) OVER (PARTITION BY a.id) AS single_votes, a.n FROM run a JOIN run b ON a.id=b.id AND a.i=b.i AND a.r<>b.r
        WHERE a.i<a.n QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY votes DESC, a.r, b.r, a.i)=1),
      flagged AS (SELECT u.id AS sequence_id, size, left_parent, right_parent, breakpoint, votes::BIGINT AS votes, single_votes::BIGINT AS single_votes,
        coalesce(votes-single_votes>=greatest({gain}*n-1e-9,1),false) AS is_chimera FROM u LEFT JOIN c ON c.id=u.id)"""


@query(
    "breakpoint_chimeras",
    f"WITH u AS (SELECT seq, min(sequence_id) AS id, count(*) AS size FROM reads WHERE length(seq)>=16 GROUP BY 1), {breaks_sql(0.3, 0.02)} FROM flagged",
    "reads",
)
def _(v):
    return H.breakpoint_screen(v.reads, min_share=0.3, min_gain=0.02)


@query(
    "preprocess_report",
    f"""WITH {TOLERANT_SQL}, good AS (SELECT sequence_id, sample_id, seq FROM kept WHERE {PASS}),
      u AS (SELECT seq, min(sequence_id) AS id, count(*) AS size FROM good WHERE length(seq)>=16 GROUP BY 1), {breaks_sql(0.3, 0.02)},
      bad AS (SELECT seq FROM u JOIN flagged ON sequence_id=id WHERE is_chimera),
      n AS (SELECT sample_id, count(*) AS input_reads FROM qreads GROUP BY 1), k AS (SELECT sample_id, count(*) AS t FROM kept GROUP BY 1),
      g AS (SELECT sample_id, count(*) AS q, count(*) FILTER (seq NOT IN (FROM bad)) AS c FROM good GROUP BY 1)
    SELECT sample_id, input_reads, coalesce(t,0) AS after_trimming, coalesce(q,0) AS after_quality, coalesce(c,0) AS after_chimeras,
      round(coalesce(c,0)*1.0::DOUBLE/input_reads,6) AS kept_share FROM n LEFT JOIN k USING (sample_id) LEFT JOIN g USING (sample_id)""",
    "qreads",
)
def _(v):
    return rounded(H.preprocess_report(v.qreads, screen={"min_share": 0.3, "min_gain": 0.02}, **WIDE), "kept_share")


@query(
    "dedupe_reads",
    """SELECT min(sequence_id) AS sequence_id, md5(seq) AS seq_md5 FROM reads WHERE length(seq)>=60
      AND (length(seq)-length(replace(seq,'N','')))*1.0::DOUBLE/length(seq)<=0.5 GROUP BY seq""",
    "reads",
)
def _(v):
    return R.dedupe_reads(v.reads, max_n=0.5).select("sequence_id", F.md5("seq").alias("seq_md5"))


@query(
    "dereplicate",
    "SELECT md5(seq) AS seq_md5, min(sequence_id) AS representative, count(*) AS size FROM reads GROUP BY seq",
    "reads",
)
def _(v):
    return R.dereplicate(v.reads).select(F.md5("seq").alias("seq_md5"), "representative", "size")


GENES = ["THER", "ENT", "COI", "AAT"]


def gene_sql() -> str:
    rules = " ".join(
        f"WHEN contains(upper(description),'{g}') OR contains(seq,'{g}') THEN '{g}'"
        for g in GENES
    )
    return f"CASE {rules} END"


@query(
    "extract_markers",
    f"SELECT * FROM (SELECT sequence_id, {gene_sql()} AS marker FROM reads) WHERE marker IS NOT NULL",
    "reads",
)
def _(v):
    return R.extract_markers(v.reads, GENES).select("sequence_id", "marker")


@query(
    "accession_summary",
    f"""WITH m AS (SELECT sample_id, {gene_sql()} AS g FROM reads) SELECT sample_id,
      count(*) AS processed_sequences, {', '.join(f"count(*) FILTER (g='{g}') AS marker_{g}" for g in GENES)}
    FROM m GROUP BY 1""",
    "reads",
)
def _(v):
    return R.accession_summary(v.reads, genes=GENES)


@query(
    "accession_report",
    f"""WITH q AS (SELECT *, list_avg(qual) AS q FROM qreads) SELECT sample_id, count(*) AS total_sequences,
      min(length(seq)) AS min_length, max(length(seq)) AS max_length, round(avg(length(seq)),6) AS mean_length,
      sum(length(seq))::BIGINT AS total_bases,
      {', '.join(f"sum(length(seq)-length(replace(seq,'{b}','')))::BIGINT AS count_{b}" for b in 'ATCGN')},
      round(avg(q),6) AS mean_quality, round(min(q),6) AS min_quality, round(max(q),6) AS max_quality,
      median(length(seq)) AS median_length FROM q GROUP BY 1""",
    "qreads",
)
def _(v):
    out = R.accession_report(v.qreads)
    return rounded(out, "mean_length", "mean_quality", "min_quality", "max_quality")


@query(
    "length_stats",
    """SELECT sample_id, count(*) AS total_sequences, min(length(seq)) AS min_length,
      max(length(seq)) AS max_length, round(avg(length(seq)),6) AS mean_length,
      round(stddev_pop(length(seq)),6) AS std_length, round(quantile_cont(length(seq),.25),6) AS p25,
      round(quantile_cont(length(seq),.5),6) AS median_length, round(quantile_cont(length(seq),.75),6) AS p75,
      round(quantile_cont(length(seq),.9),6) AS p90, round(quantile_cont(length(seq),.95),6) AS p95
    FROM reads GROUP BY 1""",
    "reads",
)
def _(v):
    out = R.length_stats(v.reads)
    return rounded(out, "mean_length", "std_length", "p25", "median_length", "p75", "p90", "p95")


@query(
    "composition",
    """WITH c AS (SELECT sample_id, unnest(string_split(upper(seq),'')) AS character FROM reads WHERE seq<>''),
      n AS (SELECT sample_id, character, count(*) AS n FROM c GROUP BY ALL),
      t AS (SELECT sample_id, sum(n)::BIGINT AS total_characters, count(*) AS unique_characters FROM n GROUP BY 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, character) AS r FROM n)
    SELECT sample_id, character, n, round(n*1.0::DOUBLE/total_characters,6) AS share, total_characters,
      unique_characters, 'dna' AS sequence_type FROM k JOIN t USING (sample_id) WHERE r<=10""",
    "reads",
)
def _(v):
    return rounded(R.composition(v.reads), "share")


@query(
    "text_composition",
    """WITH c AS (SELECT lang, unnest(string_split(upper(replace(text,'ß','s')),'')) AS character FROM documents),
      n AS (SELECT lang, character, count(*) AS n FROM c GROUP BY ALL),
      t AS (SELECT lang, sum(n)::BIGINT AS total_characters, count(*) AS unique_characters FROM n GROUP BY 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, character) AS r FROM n)
    SELECT lang, character, n, round(n*1.0::DOUBLE/total_characters,6) AS share, total_characters,
      unique_characters, 'protein' AS sequence_type FROM k JOIN t USING (lang) WHERE r<=10""",
)
def _(v):
    text = spread(v.table("documents")).select("lang", F.replace("text", F.lit("ß"), F.lit("s")).alias("seq"))
    return rounded(R.composition(text, "lang"), "share")


@query(
    "quality_summary",
    """WITH q AS (SELECT sample_id, list_avg(qual) AS q FROM qreads WHERE len(qual)>0)
    SELECT sample_id, count(*) AS sequences_with_quality, round(avg(q),6) AS mean_quality,
      round(min(q),6) AS min_quality, round(max(q),6) AS max_quality, round(stddev_pop(q),6) AS std_quality,
      count(*) FILTER (q<20) AS low_quality_sequences, round(median(q),6) AS median_quality FROM q GROUP BY 1""",
    "qreads",
)
def _(v):
    out = R.quality_summary(v.qreads)
    return rounded(out, *[c for c in out.columns if c.endswith("_quality") and c != "sequences_with_quality"])


WORDS = ["th", "on the", "partial", "er"]


@query(
    "annotation_summary",
    f"""WITH f AS (SELECT sample_id, count(*) FILTER (organism<>'Unknown') AS with_organism,
        count(*) FILTER (length(description)>0) AS with_description,
        {', '.join(f'''count(*) FILTER (contains(lower(description),'{w}')) AS "{w}"''' for w in WORDS)}
        FROM reads GROUP BY 1),
      o AS (SELECT sample_id, organism AS item, count(*) AS n, row_number() OVER (PARTITION BY sample_id
        ORDER BY count(*) DESC, organism) AS r FROM reads GROUP BY 1, 2)
    SELECT sample_id, CASE WHEN item LIKE 'with_%' THEN 'coverage' ELSE 'keyword' END AS section, item, n
    FROM (UNPIVOT f ON COLUMNS(* EXCLUDE sample_id) INTO NAME item VALUE n)
    UNION ALL SELECT sample_id, 'organism', item, n FROM o WHERE r<=20""",
    "reads",
)
def _(v):
    return R.annotation_summary(v.reads, keywords=WORDS)


@query(
    "organism_to_taxa",
    """WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL),
    l AS (SELECT p_brand, 'genus' AS rank, split_part(p_name,' ',1) AS taxon, n FROM n UNION ALL
      SELECT p_brand, 'species', split_part(p_name,' ',1) || ' ' || split_part(p_name,' ',2), n FROM n
      WHERE split_part(p_name,' ',2)<>'')
    SELECT p_brand, rank, taxon, sum(n)::BIGINT AS n FROM l GROUP BY ALL""",
)
def _(v):
    return R.organism_to_taxa(v.table("part"), "p_brand", "p_name")


HABITATS = {"marine": ["sea", "the"], "freshwater": ["lake", "en"], "terrestrial": ["land", "er"]}


@query(
    "habitat_keywords",
    """WITH h AS (SELECT sample_id, count(*) FILTER (regexp_matches(lower(description),'sea|the')) AS marine_reads,
      count(*) FILTER (regexp_matches(lower(description),'lake|en')) AS freshwater_reads,
      count(*) FILTER (regexp_matches(lower(description),'land|er')) AS terrestrial_reads FROM reads GROUP BY 1)
    SELECT *, CASE WHEN greatest(marine_reads,freshwater_reads,terrestrial_reads)=0 THEN 'unknown'
      WHEN marine_reads=greatest(marine_reads,freshwater_reads,terrestrial_reads) THEN 'marine'
      WHEN freshwater_reads>=terrestrial_reads THEN 'freshwater' ELSE 'terrestrial' END AS habitat FROM h""",
    "reads",
)
def _(v):
    return R.habitat_keywords(v.reads, keywords=HABITATS)


@query(
    "systematic_sample",
    """WITH r AS (SELECT sequence_id, row_number() OVER (ORDER BY sequence_id)-1 AS i, count(*) OVER () AS t FROM reads)
    SELECT sequence_id, round(t*1.0::DOUBLE/least(300, ceil(t*1.0/greatest(t//300,1))),6) AS scale_factor
    FROM r WHERE i % greatest(t//300,1)=0 AND i/greatest(t//300,1)<300""",
    "reads",
)
def _(v):
    return rounded(
        R.systematic_sample(v.reads.select("sequence_id"), 300, "sequence_id"), "scale_factor"
    )


@query(
    "limit_reads",
    "SELECT sequence_id, sample_id FROM reads ORDER BY sequence_id LIMIT 100",
    "reads",
)
def _(v):
    return R.limit_reads(v.reads, 100).select("sequence_id", "sample_id")


@query(
    "sequence_scalars",
    """SELECT sequence_id, length(seq) AS len,
      round(CASE WHEN length(seq)>0 THEN (length(seq)-length(replace(replace(seq,'G',''),'C','')))*1.0::DOUBLE/length(seq)
        ELSE 0 END,6) AS gc, length(seq)-length(replace(seq,'N','')) AS n_count,
      round(CASE WHEN length(seq)>0 THEN (length(seq)-length(replace(seq,'N','')))*1.0::DOUBLE/length(seq) ELSE 0 END,6)
        AS n_fraction, round(list_avg(qual),6) AS mean_phred FROM qreads""",
    "qreads",
)
def _(v):
    seq = F.col("seq")
    return v.qreads.select(
        "sequence_id",
        F.length(seq).alias("len"),
        rnd(S.gc_content(seq)).alias("gc"),
        S.letter_count(seq, "N").alias("n_count"),
        rnd(S.n_fraction(seq)).alias("n_fraction"),
        rnd(S.mean_phred(F.col("qual"))).alias("mean_phred"),
    )


@query(
    "kmer_counts",
    """WITH k AS (SELECT sample_id, substr(seq, unnest(range(1, length(seq)-1)), 3) AS kmer FROM reads WHERE length(seq)>=3)
    SELECT sample_id, kmer, count(*) AS n FROM k WHERE NOT contains(kmer,'N') GROUP BY ALL""",
    "reads",
)
def _(v):
    return (
        v.reads.select("sample_id", F.explode(S.kmer_windows(F.col("seq"), 3)).alias("window"))
        .select("sample_id", F.explode(S.kmers(F.col("window"), 3)).alias("kmer"))
        .groupBy("sample_id", "kmer")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "chunk_spans",
    """WITH c AS (SELECT sequence_id, length(seq) AS n, unnest(range(0, greatest(ceil((length(seq)-16)/112.0),1)::INT)) AS i
        FROM reads WHERE length(seq)>0)
    SELECT sequence_id, (i*112)::INT AS start, least(i*112+128, n)::INT AS stop FROM c""",
    "reads",
)
def _(v):
    return v.reads.select(
        "sequence_id", F.inline(S.chunk_spans(F.length("seq"), 128, 16)).alias("start", "stop")
    )


@query(
    "read_signature",
    """WITH k AS (SELECT sequence_id, i, substr(seq, i, 6) AS kmer FROM
        (SELECT sequence_id, seq, unnest(range(1, length(seq)-4)) AS i FROM reads WHERE length(seq)>=6)),
      c AS (SELECT sequence_id, kmer, count(*) AS n, min(i) AS f FROM k WHERE NOT contains(kmer,'N') GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, f) AS r FROM c),
      j AS (SELECT sequence_id, string_agg('"' || kmer || '": ' || n, ', ' ORDER BY kmer) AS b FROM r WHERE r<=64 GROUP BY 1)
    SELECT sequence_id, left(sha256('{' || coalesce(b,'') || '}'),32) AS signature FROM reads LEFT JOIN j USING (sequence_id)""",
    "reads",
)
def _(v):
    return R.read_signature(v.reads)


@query(
    "encode_kmers",
    """WITH k AS (SELECT sequence_id, i, substr(seq, i, 4) AS w FROM (SELECT sequence_id, seq,
        unnest(range(1, length(seq)-2)) AS i FROM reads WHERE length(seq)>=4)),
      r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY i) AS p FROM k WHERE NOT contains(w,'N')),
      e AS (SELECT sequence_id, p, 1+list_sum(list_transform(range(1,5), lambda j:
          (instr('ACGT', substr(w,j,1))-1)*power(4,4-j)))::BIGINT AS id FROM r)
    SELECT sequence_id, coalesce((p-1)//64,0) AS chunk, coalesce(sum(id),0)::BIGINT AS id_sum, coalesce(sum(id*((p-1)%64+1)),0)::BIGINT AS id_order_sum,
      count(id) AS used, 64 AS padded FROM reads LEFT JOIN e USING (sequence_id) GROUP BY 1, 2""",
    "reads",
)
def _(v):
    enc = R.encode_kmers(v.reads, 4, 64)
    weighted = F.transform("input_ids", lambda x, i: x * (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return enc.select(
        "sequence_id",
        "chunk",
        total("input_ids").alias("id_sum"),
        total(weighted).alias("id_order_sum"),
        total("attention_mask").alias("used"),
        F.size("input_ids").alias("padded"),
    )


@query(
    "profile_dataset",
    """WITH m AS (SELECT sample_id, length(seq) AS len, seq, lower(description) AS d, list_avg(qual) AS q FROM qreads),
    o AS (SELECT sample_id, organism, count(*) AS n FROM qreads GROUP BY ALL),
    p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY sample_id) AS p FROM o),
    w AS (SELECT sample_id, count(*)::DOUBLE AS a, min(len)::DOUBLE AS b, max(len)::DOUBLE AS c, round(avg(len),6) AS e,
      round(quantile_cont(len,.9),6) AS p90, sum(length(seq)-length(replace(seq,'A','')))::DOUBLE AS ca,
      sum(len)::DOUBLE AS tot, count(*) FILTER (contains(d,'partial'))::DOUBLE AS part, round(avg(q),6) AS mq,
      count(*) FILTER (q<20)::DOUBLE AS lq FROM m GROUP BY 1),
    h AS (SELECT sample_id, round(-sum(p*ln(p)),6)+0.0 AS h, count(*)::DOUBLE AS s FROM p GROUP BY 1)
    SELECT sample_id, 'length' AS section, 'total_sequences' AS metric, a AS value FROM w UNION ALL
    SELECT sample_id, 'length', 'min_length', b FROM w UNION ALL SELECT sample_id, 'length', 'max_length', c FROM w
    UNION ALL SELECT sample_id, 'length', 'mean_length', e FROM w UNION ALL SELECT sample_id, 'length', 'p90', p90 FROM w
    UNION ALL SELECT sample_id, 'composition', 'A', ca FROM w
    UNION ALL SELECT sample_id, 'composition', 'total_characters', tot FROM w
    UNION ALL SELECT sample_id, 'annotation', 'partial', part FROM w
    UNION ALL SELECT sample_id, 'quality', 'mean_quality', mq FROM w
    UNION ALL SELECT sample_id, 'quality', 'low_quality_sequences', lq FROM w
    UNION ALL SELECT sample_id, 'diversity', 'shannon', h FROM h UNION ALL SELECT sample_id, 'diversity', 'richness', s FROM h""",
    "qreads",
)
def _(v):
    wanted = (
        "total_sequences min_length max_length mean_length p90 A total_characters partial mean_quality "
        "low_quality_sequences shannon richness"
    ).split()
    out = profile_dataset(v.qreads).filter(F.col("metric").isin(*wanted))
    return rounded(out, "value")
