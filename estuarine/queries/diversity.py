"""Diversity and taxonomic-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators import diversity as D
from estuarine.operators import ranks as R
from estuarine.queries import query


def rounded(df, *cols, digits=6):
    """Round the named columns for output."""
    return df.select(*[rnd(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


ALPHA = """alpha AS (
  WITH t AS (SELECT sample_id, count(*) AS s, sum(n)::BIGINT AS total, max(n) AS top,
      sum(n*n)::DOUBLE AS sq, count(*) FILTER (n=1) AS f1, count(*) FILTER (n=2) AS f2,
      count(*) FILTER (n<=10) AS s_rare, coalesce(sum(n) FILTER (n<=10),0)::DOUBLE AS n_rare,
      coalesce(sum(n*(n-1)) FILTER (n<=10),0)::DOUBLE AS pairs, sum(lgamma(n+1)) AS lf
    FROM abundance GROUP BY 1),
  h AS (SELECT sample_id, -sum(n*1.0::DOUBLE/total*ln(n*1.0::DOUBLE/total)) AS h
    FROM abundance JOIN t USING (sample_id) GROUP BY 1)
  SELECT t.sample_id, s AS richness, total AS abundance, h AS shannon,
    1-sq/(total*total) AS simpson, total*total/sq AS inverse_simpson,
    CASE WHEN s>1 THEN h/ln(s) ELSE 0 END AS evenness, top*1.0::DOUBLE/total AS dominance,
    CASE WHEN f2>0 THEN s+f1*f1*1.0::DOUBLE/(2*f2) ELSE s+f1*(f1-1)/2.0::DOUBLE END AS chao1,
    CASE WHEN s_rare=0 OR f1=n_rare THEN s ELSE
      (s-s_rare) + s_rare/(1-f1/n_rare) + f1/(1-f1/n_rare)*greatest(0,
         s_rare/(1-f1/n_rare)*pairs/(n_rare*(n_rare-1))-1) END AS ace,
    sqrt(sq)/total AS mcintosh, (lgamma(total+1)-lf)/total AS brillouin,
    s/sqrt(total) AS menhinick, CASE WHEN total>1 THEN (s-1)/ln(total) ELSE 0 END AS margalef,
    exp(h) AS effective_species, f1, f2
  FROM t JOIN h USING (sample_id))"""

ALPHA_COLS = (
    "shannon simpson inverse_simpson evenness dominance chao1 ace fisher_alpha berger_parker "
    "mcintosh menhinick margalef effective_species"
).split()


@query(
    "alpha_diversity",
    f"""WITH {ALPHA},
    fish AS (WITH RECURSIVE it(sample_id, s, n, a, step, done) AS (
        SELECT sample_id, richness::DOUBLE, abundance::DOUBLE, richness::DOUBLE, 0, false FROM alpha
        UNION ALL
        SELECT sample_id, s, n,
          CASE WHEN abs(s/(-ln(1-n/(n+a)))-a) < 0.001 THEN a ELSE s/(-ln(1-n/(n+a))) END,
          step+1, abs(s/(-ln(1-n/(n+a)))-a) < 0.001
        FROM it WHERE NOT done AND step < 100)
      SELECT sample_id, max_by(a, step) AS fisher FROM it GROUP BY 1)
    SELECT sample_id, richness, abundance, round(shannon,6) AS shannon, round(simpson,6) AS simpson,
      round(inverse_simpson,6) AS inverse_simpson, round(evenness,6) AS evenness,
      round(dominance,6) AS dominance, round(chao1,6) AS chao1, round(ace,6) AS ace,
      round(CASE WHEN abundance>1 THEN fisher ELSE 0 END,6) AS fisher_alpha,
      round(dominance,6) AS berger_parker, round(mcintosh,6) AS mcintosh,
      round(brillouin,4) AS brillouin, round(menhinick,6) AS menhinick,
      round(margalef,6) AS margalef, round(effective_species,6) AS effective_species
    FROM alpha JOIN fish USING (sample_id)""",
    "abundance",
)
def _(v):
    out = rounded(D.alpha_diversity(v.abundance), *ALPHA_COLS)
    return rounded(out, "brillouin", digits=4)


@query(
    "basic_diversity",
    f"""WITH {ALPHA} SELECT sample_id, round(shannon,6) AS shannon, round(simpson,6) AS simpson,
    round(evenness,6) AS evenness, richness, abundance FROM alpha""",
    "abundance",
)
def _(v):
    return rounded(D.basic_diversity(v.abundance), "shannon", "simpson", "evenness")


@query(
    "organism_diversity",
    """WITH c AS (SELECT sample_id, organism, count(*) AS n FROM reads GROUP BY ALL),
    t AS (SELECT sample_id, sum(n) AS total, count(*) AS s FROM c GROUP BY 1)
    SELECT sample_id, round(-sum(n/total*ln(n/total)),6)+0.0 AS shannon,
      round(1-sum(n/total*(n/total)),6)+0.0 AS simpson,
      round(CASE WHEN any_value(s)>1 THEN -sum(n/total*ln(n/total))/ln(any_value(s)) ELSE 0 END,6)+0.0
        AS evenness, any_value(s) AS richness, any_value(total)::BIGINT AS abundance
    FROM c JOIN t USING (sample_id) GROUP BY 1""",
    "reads",
)
def _(v):
    counts = v.reads.groupBy("sample_id", F.col("organism").alias("taxon")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return rounded(D.basic_diversity(counts), "shannon", "simpson", "evenness")


@query(
    "rarefaction_curve",
    """WITH t AS (SELECT sample_id, sum(n)::BIGINT AS total, count(*) AS s FROM abundance GROUP BY 1),
    g AS (SELECT sample_id, total, s, i+1 AS point,
        CASE WHEN i = least(50,total)-1 THEN total
             ELSE floor(1.0::DOUBLE + i*((total-1)::DOUBLE/greatest(least(50,total)-1,1)))::BIGINT END AS m
      FROM (SELECT *, unnest(range(0, least(50,total))) AS i FROM t))
    SELECT sample_id, point, m AS sample_size, round(CASE WHEN m>=total THEN s ELSE sum(1-
        CASE WHEN total-n < m THEN 0 ELSE exp(lgamma(total-n+1)-lgamma(total-n-m+1)
          -lgamma(total+1)+lgamma(total-m+1)) END) END, 4) AS expected_species
    FROM abundance JOIN g USING (sample_id) GROUP BY sample_id, point, m, total, s""",
    "abundance",
)
def _(v):
    out = D.rarefaction(v.abundance).withColumn("point", F.col("point").cast("long"))
    return rounded(out, "expected_species", digits=4)


@query(
    "sampling_adequacy",
    f"""WITH {ALPHA}, d AS (SELECT *, richness/chao1 AS c FROM alpha)
    SELECT sample_id, round(c,6) AS sampling_completeness,
      CASE WHEN c>=.9 THEN 'excellent' WHEN c>=.8 THEN 'good' WHEN c>=.6 THEN 'adequate'
        WHEN c>=.4 THEN 'poor' ELSE 'very_poor' END AS adequacy_level,
      round(greatest(0, chao1-richness),6) AS missing_species, c<.8 AS additional_sampling_needed,
      coalesce(array_to_string(list_filter([
        CASE WHEN c<.8 THEN 'Collect approximately ' || trunc((0.8::DOUBLE-c)*richness*2)::INT
          || ' additional samples' END,
        CASE WHEN c<.6 THEN 'Increase sampling effort significantly' END,
        CASE WHEN c<.6 THEN 'Consider different sampling methods' END,
        CASE WHEN c<.6 THEN 'Expand spatial coverage' END,
        CASE WHEN c<.4 THEN 'Current sampling is insufficient for reliable diversity estimates' END,
        CASE WHEN c<.4 THEN 'Consider systematic sampling design' END,
        CASE WHEN c<.4 THEN 'Increase sampling intensity by 3-5x' END],
        lambda x: x IS NOT NULL), '; '), '') AS recommendations FROM d""",
    "abundance",
)
def _(v):
    out = D.sampling_adequacy(D.alpha_diversity(v.abundance))
    out = out.withColumn("recommendations", F.array_join("recommendations", "; "))
    return rounded(out, "sampling_completeness", "missing_species")


@query(
    "community_structure",
    """WITH p AS (SELECT sample_id, n*100.0::DOUBLE/sum(n) OVER (PARTITION BY sample_id) AS p FROM abundance)
    SELECT sample_id, count(*) FILTER (p>5) AS dominant_species,
      count(*) FILTER (p BETWEEN 1 AND 5) AS core_species, count(*) FILTER (p<1) AS rare_species,
      CASE WHEN max(p)>50 THEN 'highly_uneven' WHEN max(p)>25 THEN 'moderately_uneven'
        WHEN max(p)>10 THEN 'moderately_even' ELSE 'highly_even' END AS evenness_category
    FROM p GROUP BY 1""",
    "abundance",
)
def _(v):
    return D.community_structure(v.abundance)


RANKED = """r AS (SELECT sample_id, taxon, n, sum(n) OVER (PARTITION BY sample_id) AS total,
    row_number() OVER w AS rk, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cum,
    count(*) OVER (PARTITION BY sample_id) AS s FROM abundance
    WINDOW w AS (PARTITION BY sample_id ORDER BY n DESC, taxon))"""


@query(
    "dominance_pattern",
    f"""WITH {RANKED} SELECT sample_id, count(*) FILTER (cum*2<=total)+1 AS species_for_50_percent,
      count(*) FILTER (cum*5<=total*4)+1 AS species_for_80_percent,
      round(max(n)*1.0::DOUBLE/min(n),6) AS dominance_ratio,
      round(sum(n) FILTER (rk<=5)*100.0::DOUBLE/max(total),6) AS top_5_species_percentage
    FROM r GROUP BY 1""",
    "abundance",
)
def _(v):
    return rounded(D.dominance(v.abundance), "dominance_ratio", "top_5_species_percentage")


@query(
    "rare_species",
    """SELECT sample_id, count(*) FILTER (n=1) AS singletons, count(*) FILTER (n=2) AS doubletons,
      count(*) FILTER (n<=5) AS five_or_fewer, count(*) FILTER (n<=2) AS two_or_fewer,
      round(count(*) FILTER (n=1)*100.0::DOUBLE/count(*),6) AS singleton_percentage,
      round(count(*) FILTER (n<=5)*100.0::DOUBLE/count(*),6) AS rare_percentage,
      round(coalesce(sum(n) FILTER (n<=5),0)*100.0::DOUBLE/sum(n),6) AS rare_abundance_percentage,
      CASE WHEN count(*) FILTER (n=1)*2>count(*) THEN 'extremely_high_rarity'
        WHEN count(*) FILTER (n=1)*10>count(*)*3 THEN 'high_rarity'
        WHEN count(*) FILTER (n=1)*10>count(*) THEN 'moderate_rarity' ELSE 'low_rarity' END
        AS rarity_assessment FROM abundance GROUP BY 1""",
    "abundance",
)
def _(v):
    return rounded(
        D.rare_species(v.abundance),
        "singleton_percentage",
        "rare_percentage",
        "rare_abundance_percentage",
    )


@query(
    "inequality",
    f"""WITH {RANKED}, l AS (SELECT *, cum*1.0::DOUBLE/total AS c, lag(cum*1.0::DOUBLE/total) OVER
        (PARTITION BY sample_id ORDER BY rk) AS pc,
        row_number() OVER (PARTITION BY sample_id ORDER BY n, taxon DESC) AS up FROM r),
    g AS (SELECT sample_id, 1-2*coalesce(sum((c+pc)/2/s),0) AS gr,
      2*sum(up*n)::DOUBLE/(max(s)*max(total))-(max(s)+1)*1.0::DOUBLE/max(s) AS gs,
      max(s) AS s, max(n)*100.0::DOUBLE/max(total) AS t1,
      sum(n) FILTER (rk<=3)*100.0::DOUBLE/max(total) AS t3,
      sum(n) FILTER (rk<=10)*100.0::DOUBLE/max(total) AS t10,
      count(*) FILTER (n>100) AS very_abundant, count(*) FILTER (n>50 AND n<=100) AS abundant,
      count(*) FILTER (n>10 AND n<=50) AS common, count(*) FILTER (n>5 AND n<=10) AS uncommon,
      count(*) FILTER (n>2 AND n<=5) AS rare, count(*) FILTER (n<=2) AS very_rare FROM l GROUP BY 1)
    SELECT sample_id, round(gr,6)+0.0 AS gini_reference, round(gs,6)+0.0 AS gini_standard,
      CASE WHEN gr<.3 THEN 'low_inequality' WHEN gr<.5 THEN 'moderate_inequality'
        WHEN gr<.7 THEN 'high_inequality' ELSE 'extreme_inequality' END AS inequality_level,
      round(t1,6) AS top_1_share, round(CASE WHEN s>=3 THEN t3 ELSE 100 END,6) AS top_3_share,
      round(CASE WHEN s>=10 THEN t10 ELSE 100 END,6) AS top_10_share, very_abundant, abundant,
      common, uncommon, rare, very_rare FROM g""",
    "abundance",
)
def _(v):
    return rounded(
        D.inequality(v.abundance),
        "gini_reference",
        "gini_standard",
        "top_1_share",
        "top_3_share",
        "top_10_share",
    )


@query(
    "ecosystem_match",
    f"""WITH {ALPHA}, e(ecosystem, a, b, c, d) AS (VALUES ('marine_surface',2.5,4.0,.7,.9),
      ('deep_sea',1.5,3.0,.5,.8), ('freshwater',2.0,3.5,.6,.85), ('terrestrial',3.0,4.5,.8,.95))
    SELECT sample_id, ecosystem, shannon BETWEEN a AND b AS shannon_match,
      simpson BETWEEN c AND d AS simpson_match,
      shannon BETWEEN a AND b AND simpson BETWEEN c AND d AS overall_match,
      CASE WHEN shannon>3.5 AND simpson>.8 THEN 'very_high' WHEN shannon>2.5 AND simpson>.7 THEN 'high'
        WHEN shannon>1.5 AND simpson>.5 THEN 'moderate' ELSE 'low' END AS diversity_level
    FROM alpha CROSS JOIN e""",
    "abundance",
)
def _(v):
    return D.ecosystem_match(D.alpha_diversity(v.abundance))


GROUPS = {"metals": ["gadget", "gizmo"], "tools": ["widget"], "rings": ["ring", "bolt"]}


@query(
    "functional_diversity",
    """WITH g AS (SELECT sample_id, CASE WHEN taxon ILIKE '%gadget%' OR taxon ILIKE '%gizmo%' THEN 'metals'
        WHEN taxon ILIKE '%widget%' THEN 'tools' WHEN taxon ILIKE '%ring%' OR taxon ILIKE '%bolt%'
        THEN 'rings' ELSE 'unknown' END AS functional_group, sum(n)::BIGINT AS n FROM abundance GROUP BY ALL),
    p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY sample_id) AS p FROM g),
    d AS (SELECT sample_id, -sum(p*ln(p)) AS h, 1-sum(p*p) AS d, count(*) AS s FROM p GROUP BY 1)
    SELECT sample_id, functional_group, n, round(p,6) AS proportion, round(h,6)+0.0 AS functional_shannon,
      round(d,6)+0.0 AS functional_simpson, round(CASE WHEN s>1 THEN h/ln(s) ELSE 0 END,6)+0.0
      AS functional_evenness, s AS functional_richness FROM p JOIN d USING (sample_id)""",
    "abundance",
)
def _(v):
    return rounded(
        D.functional_diversity(v.abundance, groups=GROUPS),
        "proportion",
        "functional_shannon",
        "functional_simpson",
        "functional_evenness",
    )


@query(
    "rank_abundance",
    f"""WITH {RANKED} SELECT sample_id, taxon, n, rk AS rank, round(n*100.0::DOUBLE/total,6) AS percentage FROM r""",
    "abundance",
)
def _(v):
    return rounded(D.rank_abundance(v.abundance), "percentage")


@query(
    "species_accumulation",
    f"""WITH {RANKED} SELECT sample_id, rk AS species_rank, rk AS cumulative_species,
      cum::BIGINT AS cumulative_individuals FROM r""",
    "abundance",
)
def _(v):
    return D.species_accumulation(v.abundance)


TAXA = ["small ring", "red widget", "blue gadget"]


@query(
    "abundance_matrix",
    """SELECT sample_id, coalesce(sum(n) FILTER (taxon='small ring'),0)::BIGINT AS "small ring",
      coalesce(sum(n) FILTER (taxon='red widget'),0)::BIGINT AS "red widget",
      coalesce(sum(n) FILTER (taxon='blue gadget'),0)::BIGINT AS "blue gadget"
    FROM abundance GROUP BY 1""",
    "abundance",
)
def _(v):
    return D.abundance_matrix(v.abundance, TAXA)


@query(
    "diversity_profile",
    f"""WITH {ALPHA}, {RANKED}, k AS (SELECT sample_id, count(*) FILTER (cum*2<=total)+1 AS s50,
       max(n)*100.0::DOUBLE/max(total) AS pmax, count(*) FILTER (n*100.0::DOUBLE/total>5) AS dom
       FROM r GROUP BY 1)
    SELECT sample_id, richness, abundance, round(shannon,6) AS shannon, round(chao1,6) AS chao1,
      round(ace,6) AS ace, s50 AS species_for_50_percent, dom AS dominant_species, f1 AS singletons,
      CASE WHEN pmax>50 THEN 'highly_uneven' WHEN pmax>25 THEN 'moderately_uneven'
        WHEN pmax>10 THEN 'moderately_even' ELSE 'highly_even' END AS evenness_category,
      round(richness/chao1,6) AS sampling_completeness
    FROM alpha JOIN k USING (sample_id)""",
    "abundance",
)
def _(v):
    out = D.diversity_profile(v.abundance).select(
        "sample_id",
        "richness",
        "abundance",
        "shannon",
        "chao1",
        "ace",
        "species_for_50_percent",
        "dominant_species",
        "singletons",
        "evenness_category",
        "sampling_completeness",
    )
    return rounded(out, "shannon", "chao1", "ace", "sampling_completeness")


@query(
    "rank_richness",
    """SELECT report_id, count(DISTINCT kingdom) AS kingdom_diversity,
      count(DISTINCT phylum) AS phylum_diversity, count(DISTINCT genus) AS genus_diversity,
      count(DISTINCT kingdom)+count(DISTINCT phylum)+count(DISTINCT genus) AS phylogenetic_dispersion,
      (count(DISTINCT kingdom)>0)::BIGINT+(count(DISTINCT phylum)>0)::BIGINT
        +(count(DISTINCT genus)>0)::BIGINT+(count(DISTINCT kingdom)+count(DISTINCT phylum)
        +count(DISTINCT genus)>0)::BIGINT AS taxonomic_breadth FROM assignments GROUP BY 1""",
    "assignments",
)
def _(v):
    return R.rank_richness(v.assignments, "report_id")


LONG = """l AS (SELECT report_id, rank, taxon, count(*) AS n FROM (
      SELECT report_id, 'kingdom' AS rank, kingdom AS taxon FROM assignments UNION ALL
      SELECT report_id, 'phylum', phylum FROM assignments UNION ALL
      SELECT report_id, 'genus', genus FROM assignments UNION ALL
      SELECT report_id, 'species', species FROM assignments) WHERE taxon IS NOT NULL GROUP BY ALL)"""


@query(
    "rank_distribution",
    f"""WITH {LONG}, s AS (SELECT report_id, rank, sum(n)::BIGINT AS total_assigned, count(*) AS unique_taxa,
        max(n) AS top_count FROM l GROUP BY ALL),
      z AS (SELECT report_id, count(*) AS rows FROM assignments GROUP BY 1),
      p AS (SELECT *, row_number() OVER (PARTITION BY report_id, rank ORDER BY n DESC, taxon) AS position FROM l)
    SELECT report_id, rank, taxon, n, position, total_assigned, unique_taxa, top_count,
      round(total_assigned*1.0::DOUBLE/rows,6) AS assignment_rate
    FROM p JOIN s USING (report_id, rank) JOIN z USING (report_id) WHERE position<=20""",
    "assignments",
)
def _(v):
    return rounded(R.rank_distribution(v.assignments, "report_id"), "assignment_rate")


@query(
    "confidence_stats",
    """SELECT report_id, round(avg(confidence),6) AS mean, round(stddev_pop(confidence),6) AS std,
      round(min(confidence),6) AS min, round(max(confidence),6) AS max,
      round(avg((confidence>0.8)::INT),6) AS high_confidence_rate,
      round(quantile_cont(confidence,.25),6) AS q25, round(quantile_cont(confidence,.5),6) AS median,
      round(quantile_cont(confidence,.75),6) AS q75 FROM assignments WHERE confidence>0 GROUP BY 1""",
    "assignments",
)
def _(v):
    out = R.confidence_stats(v.assignments, "report_id")
    return rounded(out, *[c for c in out.columns if c != "report_id"])


@query(
    "alpha_by_rank",
    f"""WITH {LONG}, p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY report_id, rank) AS p FROM l
        WHERE rank IN ('genus','species'))
    SELECT report_id, rank, round(-sum(p*ln(p)),6)+0.0 AS shannon, round(1-sum(p*p),6)+0.0 AS simpson,
      count(*) AS richness, round(CASE WHEN count(*) FILTER (n=2)>0 THEN count(*)+
        (count(*) FILTER (n=1))*(count(*) FILTER (n=1))*1.0::DOUBLE/(2*count(*) FILTER (n=2)) ELSE count(*) END,6)
        AS chao1, round(CASE WHEN count(*)>1 THEN -sum(p*ln(p))/ln(count(*)) ELSE 0 END,6)+0.0 AS evenness
    FROM p GROUP BY ALL""",
    "assignments",
)
def _(v):
    return rounded(
        R.alpha_by_rank(v.assignments, "report_id"), "shannon", "simpson", "chao1", "evenness"
    )


@query(
    "beta_prep",
    f"""WITH {LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY report_id, rank ORDER BY n DESC, taxon) AS k
        FROM l WHERE rank IN ('genus','species'))
    SELECT report_id, rank, taxon, n, rank='genus' AND n<5 AS is_rare, rank='genus' AND k<=10 AS is_dominant FROM p""",
    "assignments",
)
def _(v):
    return R.beta_prep(v.assignments, "report_id")


@query(
    "phylo_pattern",
    f"""WITH {LONG}, p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY report_id, rank) AS p FROM l),
      e AS (SELECT report_id, rank, count(*) AS s, max(n) AS top, count(*) FILTER (n<10) AS rare,
        CASE WHEN count(*)>1 THEN -sum(p*ln(p))/ln(count(*)) ELSE 0 END AS ev FROM p GROUP BY ALL),
      z AS (SELECT report_id, count(*) AS rows FROM assignments GROUP BY 1)
    SELECT report_id, k.s AS kingdom_count, round(k.ev,6)+0.0 AS kingdom_evenness,
      round(k.top*1.0::DOUBLE/rows,6) AS kingdom_dominance, f.s AS phylum_count,
      round(f.ev,6)+0.0 AS phylum_evenness, f.rare AS rare_phyla, k.s*f.s AS phylogenetic_breadth
    FROM z JOIN (FROM e WHERE rank='kingdom') k USING (report_id)
      JOIN (FROM e WHERE rank='phylum') f USING (report_id)""",
    "assignments",
)
def _(v):
    return rounded(
        R.phylo_pattern(v.assignments, "report_id"),
        "kingdom_evenness",
        "kingdom_dominance",
        "phylum_evenness",
    )


@query(
    "contamination",
    """WITH c AS (SELECT report_id, kingdom, count(*) AS n FROM assignments GROUP BY ALL)
    SELECT report_id, count(*)>1 AS multiple_domains,
      coalesce(sum(n) FILTER (kingdom='PROMO'),0)*20>sum(n) AS unexpected_archaea,
      coalesce(sum(n) FILTER (kingdom='SMALL'),0)*10<sum(n) AS low_eukaryote_ratio,
      round(1-max(n)*1.0::DOUBLE/sum(n),6)+0.0 AS contamination_score FROM c GROUP BY 1""",
    "assignments",
)
def _(v):
    out = R.contamination(v.assignments, "report_id", archaea="PROMO", eukaryota="SMALL")
    return rounded(out, "contamination_score")


IDENT = "novelty_score*1000"


@query(
    "novel_by_confidence",
    f"""WITH h AS (SELECT sequence_id, confidence, {IDENT} AS i FROM assignments)
    SELECT sequence_id, round(confidence,6) AS confidence, round(i,6) AS identity,
      round(1-confidence,6)+0.0 AS novelty_score,
      CASE WHEN i<70 THEN 'genus_or_higher' WHEN i<85 THEN 'species' WHEN i<95 THEN 'subspecies_or_strain'
        ELSE 'sequence_variant' END AS potential_rank
    FROM h WHERE confidence>.3 AND confidence<.8 AND i<90 ORDER BY 1-confidence DESC, sequence_id LIMIT 50""",
    "assignments",
)
def _(v):
    rows = v.assignments.withColumn("identity", F.col("novelty_score") * 1000)
    return rounded(R.novel_by_confidence(rows), "confidence", "identity", "novelty_score")


@query(
    "assignment_summary",
    """WITH a AS (SELECT *, coalesce(species,'Unknown') AS lab FROM assignments)
    SELECT 'cards' AS section, 'total' AS item, count(*) AS n FROM a UNION ALL
    SELECT 'cards', 'distinct_labels', count(DISTINCT lab) FROM a UNION ALL
    SELECT 'cards', 'conflicts', count(*) FILTER (is_novel_candidate AND confidence>.8) FROM a UNION ALL
    FROM (SELECT 'labels', lab, count(*) AS n FROM a GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL
    FROM (SELECT 'phyla', coalesce(phylum,'Unknown') AS p, count(*) AS n FROM a GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""",
    "assignments",
)
def _(v):
    return R.assignment_summary(
        v.assignments, "species", F.col("is_novel_candidate") & (F.col("confidence") > 0.8)
    )


@query(
    "taxonomic_profile",
    f"""WITH {LONG}, t AS (SELECT report_id, count(*) AS total_sequences,
        count(*) FILTER (coalesce(kingdom,phylum,genus,species) IS NOT NULL) AS assigned_sequences,
        count(*) FILTER (confidence>=.8) AS high_confidence_assignments,
        avg(confidence) FILTER (confidence>0) AS m, median(confidence) FILTER (confidence>0) AS md
        FROM assignments GROUP BY 1),
      k AS (SELECT report_id, count(*) FILTER (rank='kingdom') AS kc, count(*) FILTER (rank='phylum') AS pc,
        max(n) FILTER (rank='kingdom') AS top, sum(n) FILTER (rank='kingdom') AS kn FROM l GROUP BY 1)
    SELECT report_id, total_sequences, assigned_sequences, high_confidence_assignments,
      round(m,6) AS mean_confidence, round(md,6) AS median_confidence, kc AS kingdom_count,
      pc AS phylum_count, kc*pc AS phylogenetic_breadth, kc>1 AS multiple_domains,
      round(1-top*1.0::DOUBLE/kn,6)+0.0 AS contamination_score FROM t JOIN k USING (report_id)""",
    "assignments",
)
def _(v):
    out = R.taxonomic_profile(v.assignments, "report_id").select(
        "report_id",
        "total_sequences",
        "assigned_sequences",
        "high_confidence_assignments",
        "mean_confidence",
        "median_confidence",
        "kingdom_count",
        "phylum_count",
        "phylogenetic_breadth",
        "multiple_domains",
        "contamination_score",
    )
    return rounded(out, "mean_confidence", "median_confidence", "contamination_score")
