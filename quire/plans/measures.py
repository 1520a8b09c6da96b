"""Measures of manuscripts as one long table, their bands over all manuscripts, and scores of raters; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import statistics as S
from quire.plans.joins import PARAS, marker_in_sentence, markers, paragraphs
from quire.plans.joins import SQL as JOINS_SQL
from quire.plans.stats import _PAIRS, _SHARE, _TYPED, body, rater_f1
from quire.plans.stats import SQL as STATS_SQL
from quire.plans.text import MARKERS, REFS, refs
from quire.session import table

c = F.col
PARTS = ["intro", "related", "method", "experiment", "discussion", "conclusion"]
KINDS = ["journal", "conference", "book", "thesis", "web", "preprint", "other"]
RECENT = 3
r6 = lambda x: F.round(c(x), 6).alias(x)


def manuscript_metrics(spark, folder):
    """doc_id, metric, value: about forty measures of each manuscript; a measure that can't be taken is null.

    Per section kind whether it is there, its share of words and of citations (0 where it is missing) and citations per 1000
    words; the shares of citing sentences with two and five references; the bibliography's size, age, recency, languages
    and kinds; words, figures and tables. Recent is within three years of the manuscript's newest entry.
    """
    own = S.share_and_density(body(spark, folder), ["doc_id"], "part", T.count_words(c("text")), c("n_cites"))
    docs = own.groupBy("doc_id").agg(F.sum("n_words").alias("words"), F.sum("n_cites").alias("cites"))
    grid = docs.withColumn("part", F.explode(F.array(*map(F.lit, PARTS)))).join(own, ["doc_id", "part"], "left")
    of = {"present": c("n_words").isNotNull().cast("double"), "words": F.try_divide(c("n_words"), c("words")), "share": F.coalesce("share", F.when(c("cites") > 0, F.lit(0.0))), "density": F.when(c("n_words") > 0, c("density"))}
    parts = grid.select("doc_id", F.explode(F.array(*(F.struct(F.concat(F.lit(f"{k}:"), "part").alias("metric"), v.cast("double").alias("value")) for k, v in of.items()))).alias("x")).select("doc_id", "x.*")
    cited = marker_in_sentence(spark, folder).join(markers(spark, folder).select("marker_id", "doc_id", F.explode("ref_ids").alias("ref_id")), "marker_id")
    each = cited.groupBy("doc_id", "para_id", "sent_ix").agg(F.countDistinct("ref_id").alias("n"))
    sents = each.groupBy("doc_id").agg(*(F.avg((c("n") >= k).cast("int")).alias(f"sent_ge{k}") for k in (2, 5)))
    e = refs(spark, folder).withColumn("kind", T.reference_type(c("raw")))
    newest = e.groupBy("doc_id").agg(F.max("year").alias("newest"))
    share = lambda x: F.avg(x.cast("int"))
    listed = e.join(newest, "doc_id").groupBy("doc_id").agg(
        F.count("*").cast("double").alias("n_refs"), share(c("year") >= c("newest") - RECENT).alias("recent_share"), share(c("lang") != "zh").alias("foreign_share"), F.median(c("newest") - c("year")).alias("ref_age"),
        share(c("doi").isNotNull()).alias("doi_share"), *(share(c("kind") == k).alias(f"type:{k}") for k in KINDS),
    )
    caption = F.lower(F.ltrim(c("text")))
    shown = paragraphs(spark, folder).where("is_caption").groupBy("doc_id").agg(F.count_if(caption.rlike("^(?:图|fig)")).cast("double").alias("n_figures"), F.count_if(caption.rlike("^(?:表|tab)")).cast("double").alias("n_tables"))
    size = docs.join(shown, "doc_id", "left").select("doc_id", c("words").cast("double").alias("n_words"), F.coalesce("n_figures", F.lit(0.0)).alias("n_figures"), F.coalesce("n_tables", F.lit(0.0)).alias("n_tables"))
    long = lambda df: S.long_metrics(df, ["doc_id"], {x: F.col(f"`{x}`") for x in df.columns if x != "doc_id"})
    out = parts.unionByName(long(sents)).unionByName(long(listed)).unionByName(long(size))
    return out.select("doc_id", "metric", r6("value"))


def metric_flags(spark, folder):
    """Each measure's band over all manuscripts, and how many lie below, within and above it; measures of presence by their rate."""
    m = manuscript_metrics(spark, folder)
    here = c("metric").startswith("present:")
    q = S.quartiles(m.where(~here), ["metric"], "value").select("metric", "q1", "q3")
    rate = m.where(here & c("value").isNotNull()).groupBy("metric").agg(F.avg("value").alias("rate"), F.count("*").alias("n")).where("n >= 3").select("metric", "rate")
    # one row a measure on either side; all manuscripts meet them as they stand
    flag = F.when(c("rate").isNotNull(), F.when((c("value") == 0) & (c("rate") >= 0.75), "below").when((c("value") > 0) & (c("rate") <= 0.25), "above").otherwise("within")).otherwise(S.band(c("value"), c("q1"), c("q3")))
    return m.join(q, "metric", "left").join(rate, "metric", "left").groupBy("metric", flag.alias("flag")).agg(F.count("*").alias("n_docs"))


def language_baseline(spark, folder):
    """What is usual among manuscripts of one language, measure by measure: the statistics a comparison needs, without texts."""
    lang = refs(spark, folder).where("lang IS NOT NULL").groupBy("doc_id", "lang").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("group"))
    got = S.baseline(manuscript_metrics(spark, folder), lang)
    return got.select("group", "metric", "present_in", r6("q1"), r6("median"), r6("q3"))


def section_density(spark, folder):
    """Per section kind, over the manuscripts that have it: in how many it stands, and the median citations per 1000 words."""
    own = S.share_and_density(body(spark, folder), ["doc_id"], "part", T.count_words(c("text")), c("n_cites")).where(c("part").isin(PARTS) & (c("n_words") > 0))
    return own.groupBy("part").agg(F.count("*").alias("present_in"), F.round(F.median("density"), 6).alias("median_density"))


def rater_confusion(spark, folder):
    """How often the second rater gave a level where the first gave another, with each level's share of its row."""
    l = table(spark, folder, "reading_labels").where("level IS NOT NULL")
    a, b = l.select("doc_id", c("level").alias("gold"), c("rater").alias("ra")), l.select("doc_id", c("level").alias("said"), c("rater").alias("rb"))
    n = a.join(b, "doc_id").where("ra < rb").groupBy("gold", "said").agg(F.count("*").alias("n"))
    rows = n.groupBy("gold").agg(F.sum("n").alias("total"))
    return n.join(rows, "gold").select(c("gold").cast("bigint").alias("gold"), c("said").cast("bigint").alias("said"), "n", F.round(c("n") / c("total"), 6).alias("share"))


def macro_f1(spark, folder):
    """Mean of the levels' F1, each level counting once, and the share of equal labels."""
    per = rater_f1(spark, folder).agg(F.count("*").alias("n_levels"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    equal = rater_confusion(spark, folder).agg(F.sum(F.when(c("gold") == c("said"), c("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n")).select(F.round(c("hits") / c("n"), 6).alias("accuracy"))
    both = per.unionByName(equal, allowMissingColumns=True)
    return both.agg(F.max("n_levels").alias("n_levels"), F.max("macro_f1").alias("macro_f1"), F.max("accuracy").alias("accuracy"))


QUERIES = {f.__name__: f for f in (manuscript_metrics, metric_flags, language_baseline, section_density, rater_confusion, macro_f1)}

_IN = f"(SELECT s.marker_id, s.para_id, s.sent_ix, m.doc_id, m.ref_ids FROM ({JOINS_SQL['marker_in_sentence']}) s JOIN {MARKERS} m ON m.marker_id = s.marker_id)"
_METRICS = f"""WITH o AS (SELECT * FROM {_SHARE}), d AS (SELECT doc_id, sum(n_words) AS words, sum(n_cites) AS cites FROM o GROUP BY 1),
    g AS (SELECT d.doc_id, words, cites, p.part, n_words, CASE WHEN n_words > 0 THEN density END AS density, coalesce(share, CASE WHEN cites > 0 THEN 0.0 END) AS share FROM (SELECT *, unnest({PARTS}) AS part FROM d) p JOIN d USING (doc_id, words, cites) LEFT JOIN o ON o.doc_id = p.doc_id AND o.part = p.part),
    parts AS (SELECT doc_id, 'present:' || part AS metric, (n_words IS NOT NULL)::INT::DOUBLE AS value FROM g UNION ALL SELECT doc_id, 'words:' || part, CASE WHEN words <> 0 THEN n_words / words END FROM g UNION ALL SELECT doc_id, 'share:' || part, share FROM g UNION ALL SELECT doc_id, 'density:' || part, density FROM g),
    n AS (SELECT doc_id, para_id, sent_ix, count(DISTINCT ref_id) AS n FROM (SELECT doc_id, para_id, sent_ix, unnest(ref_ids) AS ref_id FROM {_IN}) GROUP BY ALL), sents AS (SELECT doc_id, avg((n >= 2)::INT) AS sent_ge2, avg((n >= 5)::INT) AS sent_ge5 FROM n GROUP BY 1),
    e AS (SELECT *, max(year) OVER (PARTITION BY doc_id) AS newest FROM {_TYPED}),
    listed AS (SELECT doc_id, count(*)::DOUBLE AS n_refs, avg((year >= newest - {RECENT})::INT) AS recent_share, avg((lang <> 'zh')::INT) AS foreign_share, median(newest - year)::DOUBLE AS ref_age, avg((doi IS NOT NULL)::INT) AS doi_share, {', '.join(f"avg((kind = '{k}')::INT) FILTER (WHERE raw IS NOT NULL) AS {chr(34)}type:{k}{chr(34)}" for k in KINDS)} FROM e GROUP BY 1),
    shown AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(lower(ltrim(text, ' ')), '^(?:图|fig)'))::DOUBLE AS n_figures, count(*) FILTER (WHERE regexp_matches(lower(ltrim(text, ' ')), '^(?:表|tab)'))::DOUBLE AS n_tables FROM {PARAS} WHERE is_caption GROUP BY 1),
    size AS (SELECT doc_id, words::DOUBLE AS n_words, coalesce(n_figures, 0) AS n_figures, coalesce(n_tables, 0) AS n_tables FROM d LEFT JOIN shown USING (doc_id)),
    l AS (SELECT * FROM parts UNION ALL SELECT doc_id, metric, value FROM (FROM sents UNPIVOT INCLUDE NULLS (value FOR metric IN (sent_ge2, sent_ge5))) UNION ALL SELECT doc_id, metric, value FROM (FROM listed UNPIVOT INCLUDE NULLS (value FOR metric IN (n_refs, recent_share, foreign_share, ref_age, doi_share, {', '.join(f'{chr(34)}type:{k}{chr(34)}' for k in KINDS)}))) UNION ALL SELECT doc_id, metric, value FROM (FROM size UNPIVOT INCLUDE NULLS (value FOR metric IN (n_words, n_figures, n_tables))))
    SELECT doc_id, metric, round(value, 6) AS value FROM l"""
_CONFUSION = f"SELECT l1::BIGINT AS gold, l2::BIGINT AS said, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l1), 6) AS share FROM {_PAIRS} GROUP BY l1, l2"
SQL = {
    "manuscript_metrics": _METRICS,
    "metric_flags": f"""WITH m AS MATERIALIZED ({_METRICS}), q AS (SELECT * FROM (SELECT metric, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m WHERE NOT starts_with(metric, 'present:') GROUP BY 1) WHERE n >= 3 AND q3 > q1), r AS (SELECT metric, avg(value) AS rate FROM m WHERE starts_with(metric, 'present:') AND value IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
        SELECT metric, CASE WHEN rate IS NOT NULL THEN CASE WHEN value = 0 AND rate >= 0.75 THEN 'below' WHEN value > 0 AND rate <= 0.25 THEN 'above' ELSE 'within' END WHEN value IS NULL OR q1 IS NULL THEN 'na' WHEN value < q1 THEN 'below' WHEN value > q3 THEN 'above' ELSE 'within' END AS flag, count(*) AS n_docs FROM m LEFT JOIN q USING (metric) LEFT JOIN r USING (metric) GROUP BY 1, 2""",
    "language_baseline": f"""WITH m AS ({_METRICS}), g AS (SELECT doc_id, max_by(lang, (n, lang)) AS "group" FROM (SELECT doc_id, lang, count(*) AS n FROM {REFS} WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        SELECT "group", metric, count(*) AS present_in, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM m JOIN g USING (doc_id) WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
    "section_density": f"SELECT part, count(*) AS present_in, round(median(density), 6) AS median_density FROM {_SHARE} WHERE n_words > 0 AND part IN ({', '.join(repr(p) for p in PARTS)}) GROUP BY 1",
    "rater_confusion": _CONFUSION,
    "macro_f1": f"SELECT n_levels, macro_f1, accuracy FROM (SELECT count(*) AS n_levels, round(avg(f1), 6) AS macro_f1 FROM ({STATS_SQL['rater_f1']})), (SELECT round(sum(CASE WHEN gold = said THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM ({_CONFUSION}))",
}
