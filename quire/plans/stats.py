"""Statistics, samples and estimates over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import statistics as S
from quire.plans.joins import PARAS, SECTIONS, SENT, marker_in_sentence, markers, paragraphs, sections
from quire.plans.text import HAN, LAT, MARKERS, RECORDS, REFS, _q, records, refs
from quire.session import table

c = F.col
r6 = lambda name: F.round(F.col(name), 6).alias(name)
long = lambda name: F.col(name).cast("bigint").alias(name)
PARTS = ["intro", "related", "method", "experiment", "discussion", "conclusion", "other"]


def events(spark, folder):
    return table(spark, folder, "events")


def body(spark, folder):
    """Paragraphs with their section's label as typed and their citations."""
    cites = markers(spark, folder).groupBy("para_id").agg(F.count("*").alias("n_cites"))
    label = F.lower(F.trim(F.coalesce("canonical", F.lit("other"))))
    s = sections(spark, folder).select("section_id", label.alias("part"))
    return paragraphs(spark, folder).join(s, "section_id").join(cites, "para_id", "left").select("doc_id", "para_id", "part", "text", F.coalesce("n_cites", F.lit(0)).alias("n_cites"))


def section_share_density(spark, folder):
    got = S.share_and_density(body(spark, folder), ["doc_id"], "part", T.count_words(c("text")), c("n_cites"))
    return got.select("doc_id", "part", "n_words", "n_cites", r6("share"), r6("density"))


def section_bands(spark, folder):
    """Each manuscript's section share against the quartiles of all manuscripts."""
    own = S.share_and_density(body(spark, folder), ["doc_id"], "part", T.count_words(c("text")), c("n_cites"))
    q = S.quartiles(own, ["part"], "share").select("part", "q1", "q3")
    return own.join(q, "part", "left").select("doc_id", "part", S.band(c("share"), c("q1"), c("q3")).alias("flag"))


def sentence_reference_shares(spark, folder):
    """Of the sentences that cite: how many references each, and the shares with at least 2, 3 and 5."""
    in_ = marker_in_sentence(spark, folder).join(markers(spark, folder).select("marker_id", F.explode("ref_ids").alias("ref_id")), "marker_id")
    n = in_.groupBy("para_id", "sent_ix").agg(F.countDistinct("ref_id").alias("n"))
    ge = lambda k: F.round(F.avg((c("n") >= k).cast("int")), 6).alias(f"share_ge{k}")
    return n.agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_refs"), ge(2), ge(3), ge(5))


def length_quartiles(spark, folder):
    got = S.quartiles(table(spark, folder, "documents"), ["source"], "n_chars")
    return got.select("source", "n", r6("q1"), r6("median"), r6("q3"))


def price_bands(spark, folder):
    """Line items below, within and above the price quartiles of their return flag, counted."""
    l = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", c("l_extendedprice").cast("double").alias("v"))
    q = F.broadcast(S.quartiles(l, ["l_returnflag"], "v").select("l_returnflag", "q1", "q3"))  # one row per flag
    flagged = l.join(q, "l_returnflag").select("l_returnflag", "l_linestatus", S.band(c("v"), c("q1"), c("q3")).alias("flag"))
    return flagged.groupBy("l_returnflag", "l_linestatus", "flag").agg(F.count("*").alias("n"))


def doi_rates(spark, folder):
    """Per source whether most records carry a DOI and an abstract."""
    g = records(spark, folder).where("answered").groupBy("source").agg(F.avg(c("doi").isNotNull().cast("int")).alias("doi_rate"), F.avg(c("abstract").isNotNull().cast("int")).alias("abstract_rate"))
    return g.select("source", r6("doi_rate"), r6("abstract_rate"), S.rate_flag(c("doi_rate"), F.lit(False)).alias("doi_flag"), S.rate_flag(c("abstract_rate"), F.lit(True)).alias("abstract_flag"))


def absent_sections(spark, folder):
    rows = body(spark, folder).select("doc_id", "part", T.count_words(c("text")).alias("words"))
    got = S.absent_as_zero(rows, "doc_id", "part", "words", PARTS)
    return got.select("part", r6("mean_share"), r6("median_share"), "present_in", "n_units")


def reference_metrics(spark, folder):
    """Long table of measures of each manuscript's bibliography, by quartile over manuscripts."""
    kind = T.reference_type(c("raw"))
    per = refs(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(c("doi").isNotNull().cast("int")).alias("doi"), F.avg((c("year") >= 2015).cast("int")).alias("recent"), F.avg((kind == "journal").cast("int")).alias("journal"), F.median(2026 - c("year")).alias("age"), F.avg((c("lang") == "zh").cast("int")).alias("zh"))
    longs = S.long_metrics(per, ["doc_id"], {"n_refs": c("n"), "doi_share": c("doi"), "recent_share": c("recent"), "journal_share": c("journal"), "median_age": c("age"), "zh_share": c("zh")})
    return S.quartiles(longs, ["metric"], "value").select("metric", "n", r6("q1"), r6("median"), r6("q3"))


def majority_language(spark, folder):
    lang = F.lower(F.trim(c("lang")))
    g = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(lang == "zh").alias("n_zh"))
    return g.select("source", "n", "n_zh", F.when(c("n_zh") * 2 > c("n"), "zh").otherwise("other").alias("language"))


def reference_age(spark, folder):
    """Median age of references against the latest year of their manuscript, and the second latest year as horizon."""
    r = refs(spark, folder).where("year IS NOT NULL")
    g = r.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("year").alias("last"), F.sort_array(F.collect_list("year"), asc=False).alias("ys"), F.median("year").alias("mid"))
    return g.select("doc_id", "n", F.round(c("last") - c("mid"), 6).alias("median_age"), F.when(c("n") >= 5, F.get("ys", F.lit(1))).cast("bigint").alias("horizon"))


def composition(spark, folder):
    g = refs(spark, folder).where("raw IS NOT NULL").groupBy("lang", T.reference_type(c("raw")).alias("kind")).agg(F.count("*").alias("n"))
    return g.select("lang", "kind", "n", F.round(c("n") / F.sum("n").over(Window.partitionBy("lang")), 6).alias("share"))


def usage_by_day(spark, folder):
    return events(spark, folder).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def usage_grouping_sets(spark, folder):
    """All roll-ups of the usage log in one pass."""
    events(spark, folder).withColumn("day", F.to_date("ts")).createOrReplaceTempView("quire_usage")
    return spark.sql("SELECT day, event_type, grouping_id() AS level, count(*) AS n, round(sum(value), 4) AS total FROM quire_usage GROUP BY GROUPING SETS ((day, event_type), (day), (event_type), ())")


def task_averages(spark, folder):
    e = events(spark, folder).where(c("event_type").like("%c%") & (c("value") > 0))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


def send_list(spark, folder):
    """What was sent, once per content: how often, by which kinds in order of first use; at most 80 shown a category."""
    e = events(spark, folder).where("event_type <> 'error'")
    keyed = e.select("event_type", "event_id", F.pmod(c("user_id"), F.lit(20)).alias("category"), F.md5(c("user_id").cast("string")).alias("content"))
    first = keyed.groupBy("category", "content", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    one = first.groupBy("category", "content").agg(F.sum("n").alias("times"), F.min("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("first", "content"))
    cut = one.withColumn("rank", rank).withColumn("hidden", F.greatest(F.count("*").over(Window.partitionBy("category")) - 80, F.lit(0)))
    return cut.where("rank <= 80").select("category", "content", "times", "kinds", long("rank"), "hidden")


def dominant_category(spark, folder):
    g = events(spark, folder).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return g.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.round("v", 4), "event_type")).alias("dominant"))


def source_statistics(spark, folder):
    g = records(spark, folder).groupBy("source").agg(F.count("*").alias("calls"), F.count_if(c("answered")).alias("answered"), F.sum(F.length("title")).alias("chars"))
    return g


def expired(spark, folder):
    """Log rows older than 30 days at a fixed time, of some kinds only."""
    old = (c("ts") < F.lit("2024-02-01").cast("timestamp") - F.expr("INTERVAL 30 DAYS")) & (c("event_type").startswith("c") | c("event_type").startswith("p"))
    return events(spark, folder).groupBy("event_type").agg(F.count_if(old).alias("n_expired"), F.count_if(~old).alias("n_kept"))


def level_pivot(spark, folder):
    g = table(spark, folder, "reading_labels").where("level IS NOT NULL").groupBy("rater").pivot("level", [1, 2, 3, 4]).count()
    return g.select("rater", *(F.coalesce(c(str(i)), F.lit(0)).alias(f"level_{i}") for i in (1, 2, 3, 4)))


def label_precedence(spark, folder):
    """One verdict a document: the lowest level any rater gave."""
    return table(spark, folder, "reading_labels").groupBy("doc_id").agg(F.min_by("level", F.struct(F.coalesce("level", F.lit(9)), "rater")).cast("bigint").alias("level"), F.count("*").alias("n"))


def rater_pairs(spark, folder):
    l = table(spark, folder, "reading_labels").where("level IS NOT NULL")
    a, b = (l.select("doc_id", c("rater").alias(f"r{i}"), c("level").cast("bigint").alias(f"l{i}")) for i in (1, 2))
    return a.join(b, "doc_id").where("r1 < r2")


def agreement(spark, folder):
    """The second rater against the first: confusion of 'demanding' (level 3 and 4)."""
    got = S.confusion(rater_pairs(spark, folder), c("l1") >= 3, c("l2") >= 3, c("l1") == 2)
    return got.select("tp", "fn", "fp", "pre", "tn", *(r6(x) for x in ("precision_lenient", "precision_strict", "recall", "accuracy")))


def rater_f1(spark, folder):
    return S.class_scores(rater_pairs(spark, folder), "l1", "l2").select("label", "support", r6("precision"), r6("recall"), r6("f1"))


def run_difference(spark, folder):
    """Two runs over the same units: what the second gained and lost, by the first rater's level."""
    l = table(spark, folder, "reading_labels")
    a = l.where("rater = 'ra'").select("doc_id", c("level").alias("before"))
    b = l.where("rater = 'rb'").select("doc_id", c("level").alias("after"))
    state = F.when(c("before").isNull(), "gained").when(c("after").isNull(), "lost").when(c("before") == c("after"), "same").otherwise("changed")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state"), long("before")).agg(F.count("*").alias("n"))


def strata_allocation(spark, folder):
    sizes = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return S.allocate(sizes, "source", "size", 300, 3)


def stratified_sample(spark, folder):
    return S.seeded_sample(table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id", F.lit(3), "quire")


def drawn(spark, folder):
    """source, size, hit of three documents a source: sizes are counted, the draw reads keys alone, and only what is drawn is looked into."""
    d = table(spark, folder, "documents")
    picked = S.seeded_sample(d.select("source", "doc_id"), "source", "doc_id", F.lit(3), "quire").select("doc_id")
    hit = d.join(picked, "doc_id", "left_semi").select("source", F.coalesce(c("text").rlike("[0-9]"), F.lit(False)).alias("hit"))
    return hit.join(d.groupBy("source").agg(F.count("*").alias("size")), "source")


def sample_estimate(spark, folder):
    """Estimated share of documents with digits, from a stratified sample."""
    return S.stratified_estimate(drawn(spark, folder), "source", "size", "hit").select(r6("estimate"), r6("rate"), "drawn")


def sample_interval(spark, folder):
    """The bootstrap interval of that estimate; no SQL, as draws are numpy's."""
    return S.bootstrap(drawn(spark, folder), "source", "size", "hit")


def stratum_by_priority(spark, folder):
    """Each document's first label in an order of precedence."""
    label = F.when(c("text").isNull(), "null").when(F.trim("text") == "", "blank").when(c("text").rlike("<[^>]+>"), "markup").when(c("n_chars") > 5000, "long").otherwise("plain")
    return table(spark, folder, "documents").groupBy(label.alias("stratum")).agg(F.count("*").alias("n"))


def nearest_swap(spark, folder):
    """For each cited reference of a marker the nearest entry of its list that the marker doesn't cite: a swap to test with.

    Neighbours at growing distance are looked up by position, not by pairing all entries of a list.
    """
    m = markers(spark, folder).select("doc_id", "marker_id", "ref_ids", F.explode("ref_ids").alias("ref_id"))
    e = refs(spark, folder).where("origin = 'list'").select("doc_id", "ref_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "ref_id")).alias("place"))
    at = m.join(e, ["doc_id", "ref_id"]).distinct()
    tries = at.select("doc_id", "marker_id", "ref_id", "ref_ids", "place", F.posexplode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("ref_ids") + 1), lambda d: F.array(c("place") - d, c("place") + d)))).alias("k", "near"))
    other = e.select("doc_id", c("ref_id").alias("swap_ref"), c("place").alias("near"))
    hit = tries.join(other, ["doc_id", "near"]).where(~F.array_contains("ref_ids", c("swap_ref")))
    return hit.groupBy("marker_id", "ref_id").agg(F.min_by("swap_ref", "k").alias("swap_ref"))


def activity_streaks(spark, folder):
    from quire.operators.sequences import streaks

    runs = streaks(events(spark, folder).select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")
    best = runs.groupBy("user_id").agg(F.max(F.struct("length", "first_day")).alias("b"), F.sum("length").alias("active_days"))
    return best.select("user_id", c("b.length").alias("longest"), c("b.first_day").alias("since"), "active_days")


def activity_grid(spark, folder):
    from quire.operators.sequences import day_grid

    counts = events(spark, folder).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return day_grid(counts, "event_type", "day", "n")


def last_fortnight(spark, folder):
    counts = events(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return counts.where(F.col("day") > F.lit("2024-01-31").cast("date") - 14).select("day", "n", "users")


def variant_flags(spark, folder):
    """Two variants' alarms per class, failures kept apart: both raters against the first one's level."""
    l = table(spark, folder, "reading_labels")
    gold = l.where("rater = 'ra' AND level IS NOT NULL").select("doc_id", c("level").alias("gold"))
    return l.where("rater <> 'ra'").join(gold, "doc_id").groupBy("rater", long("gold")).agg(F.count_if(c("level") >= 3).alias("alarms"), F.count_if(c("level") < 3).alias("quiet"), F.count_if(c("level").isNull()).alias("failed"))


QUERIES = {f.__name__: f for f in (section_share_density, section_bands, sentence_reference_shares, length_quartiles, price_bands, doi_rates, absent_sections, reference_metrics, majority_language, reference_age, composition, usage_by_day, usage_grouping_sets, task_averages, send_list, dominant_category, source_statistics, expired, level_pivot, label_precedence, agreement, rater_f1, run_difference, strata_allocation, stratified_sample, sample_estimate, sample_interval, stratum_by_priority, nearest_swap, activity_streaks, activity_grid, last_fortnight, variant_flags)}

_BODY = f"""(SELECT p.doc_id, p.para_id, lower(trim(coalesce(s.canonical, 'other'), ' ')) AS part, p.text, coalesce(n, 0) AS n_cites, {LAT.replace('text', 'p.text')} + {HAN.replace('text', 'p.text')} AS words
    FROM {PARAS} p JOIN {SECTIONS} s ON p.section_id = s.section_id LEFT JOIN (SELECT para_id, count(*) AS n FROM {MARKERS} GROUP BY 1) m ON m.para_id = p.para_id)"""
_SHARE = f"""(SELECT doc_id, part, w::BIGINT AS n_words, k::BIGINT AS n_cites, CASE WHEN sum(k) OVER (PARTITION BY doc_id) = 0 THEN 0 ELSE k / sum(k) OVER (PARTITION BY doc_id) END AS share, CASE WHEN w = 0 THEN 0 ELSE k * 1000.0 / w END AS density
    FROM (SELECT doc_id, part, sum(words) AS w, sum(n_cites) AS k FROM {_BODY} GROUP BY 1, 2))"""
_KIND = f"CASE WHEN regexp_matches(raw, '(?i)arxiv|preprint') THEN 'preprint' WHEN code = 'J' THEN 'journal' WHEN code IN ('C', 'A') THEN 'conference' WHEN code IN ('M', 'G') THEN 'book' WHEN code = 'D' THEN 'thesis' WHEN code IN ('EB', 'DB', 'CP') THEN 'web' WHEN code <> '' THEN 'other' WHEN regexp_matches(raw, '{_q(T.CONFERENCE)}') THEN 'conference' WHEN (regexp_matches(raw, '{_q(T.JOURNAL)}') OR regexp_matches(raw, '{_q(T.ISSUE)}')) THEN 'journal' WHEN regexp_matches(raw, 'https?://') THEN 'web' ELSE 'other' END"
_TYPED = f"(SELECT *, {_KIND} AS kind FROM (SELECT *, upper(regexp_extract(raw, '\\[ *([JCAMDRPSNZG]|EB|DB|CP) *(?:/ *OL)? *\\]', 1)) AS code FROM {REFS}))"
_PAIRS = "(SELECT a.doc_id, a.level AS l1, b.level AS l2 FROM reading_labels a JOIN reading_labels b ON a.doc_id = b.doc_id AND a.rater < b.rater WHERE a.level IS NOT NULL AND b.level IS NOT NULL)"
_SAMPLE = "(SELECT * FROM (SELECT source, doc_id, coalesce(regexp_matches(text, '[0-9]'), false) AS hit, count(*) OVER (PARTITION BY source) AS size, row_number() OVER (PARTITION BY source ORDER BY md5('quire|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3)"
SQL = {
    "section_share_density": f"SELECT doc_id, part, n_words, n_cites, round(share, 6) AS share, round(density, 6) AS density FROM {_SHARE}",
    "section_bands": f"""WITH o AS (SELECT * FROM {_SHARE}), q AS (SELECT * FROM (SELECT part, count(*) AS n, quantile_cont(share, 0.25) AS q1, quantile_cont(share, 0.75) AS q3 FROM o GROUP BY 1) WHERE n >= 3 AND q3 > q1)
        SELECT doc_id, part, CASE WHEN q1 IS NULL THEN 'na' WHEN share < q1 THEN 'below' WHEN share > q3 THEN 'above' ELSE 'within' END AS flag FROM o LEFT JOIN q USING (part)""",
    "sentence_reference_shares": f"""SELECT count(*) AS n_sentences, sum(n)::BIGINT AS n_refs, round(avg((n >= 2)::INT), 6) AS share_ge2, round(avg((n >= 3)::INT), 6) AS share_ge3, round(avg((n >= 5)::INT), 6) AS share_ge5
        FROM (SELECT para_id, sent_ix, count(DISTINCT ref_id) AS n FROM (SELECT s.para_id, s.sent_ix, unnest(m.ref_ids) AS ref_id FROM {MARKERS} m JOIN {SENT} s ON m.para_id = s.para_id AND s.start_pos <= m.start_pos AND m.end_pos <= s.end_pos) GROUP BY 1, 2)""",
    "length_quartiles": "SELECT source, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM (SELECT source, count(*) AS n, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) WHERE n >= 3 AND q3 > q1",
    "price_bands": "SELECT l_returnflag, l_linestatus, CASE WHEN v < q1 THEN 'below' WHEN v > q3 THEN 'above' ELSE 'within' END AS flag, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS v FROM lineitem) JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, quantile_cont(l_extendedprice::DOUBLE, 0.75) AS q3 FROM lineitem GROUP BY 1 HAVING count(*) >= 3) USING (l_returnflag) WHERE q3 > q1 GROUP BY 1, 2, 3",
    "doi_rates": f"SELECT source, round(d, 6) AS doi_rate, round(a, 6) AS abstract_rate, CASE WHEN d >= 0.75 THEN 'missing' ELSE 'within' END AS doi_flag, CASE WHEN a <= 0.25 THEN 'unusual' ELSE 'within' END AS abstract_flag FROM (SELECT source, avg((doi IS NOT NULL)::INT) AS d, avg((abstract IS NOT NULL)::INT) AS a FROM {RECORDS} WHERE answered GROUP BY 1)",
    "absent_sections": f"""WITH b AS (SELECT doc_id, part, words FROM {_BODY}), t AS (SELECT doc_id, sum(words) AS t FROM b GROUP BY 1), h AS (SELECT doc_id, part, sum(words) AS v FROM b GROUP BY 1, 2), f AS (SELECT doc_id, t, unnest({PARTS}) AS part FROM t)
        SELECT part, round(avg(s), 6) AS mean_share, round(quantile_cont(s, 0.5), 6) AS median_share, count(v) AS present_in, count(*) AS n_units FROM (SELECT f.part, v, CASE WHEN t = 0 THEN 0.0 ELSE coalesce(v, 0) / t END AS s FROM f LEFT JOIN h ON f.doc_id = h.doc_id AND f.part = h.part) GROUP BY 1""",
    "reference_metrics": f"""WITH p AS (SELECT doc_id, count(*)::DOUBLE AS n_refs, avg((doi IS NOT NULL)::INT) AS doi_share, avg((year >= 2015)::INT) AS recent_share, avg((kind = 'journal')::INT) FILTER (WHERE raw IS NOT NULL) AS journal_share, median(2026 - year)::DOUBLE AS median_age, avg((lang = 'zh')::INT) AS zh_share FROM {_TYPED} GROUP BY 1),
        l AS (UNPIVOT p ON n_refs, doi_share, recent_share, journal_share, median_age, zh_share INTO NAME metric VALUE value)
        SELECT metric, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM (SELECT metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM l WHERE value IS NOT NULL GROUP BY 1) WHERE n >= 3 AND q3 > q1""",
    "majority_language": "SELECT source, n, z AS n_zh, CASE WHEN z * 2 > n THEN 'zh' ELSE 'other' END AS language FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE lower(trim(lang, ' ')) = 'zh') AS z FROM documents GROUP BY 1)",
    "reference_age": f"SELECT doc_id, count(*) AS n, round(max(year) - median(year), 6) AS median_age, CASE WHEN count(*) >= 5 THEN list_sort(list(year), 'DESC')[2] END::BIGINT AS horizon FROM {REFS} WHERE year IS NOT NULL GROUP BY 1",
    "composition": f"SELECT lang, kind, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, kind, count(*) AS n FROM {_TYPED} WHERE raw IS NOT NULL GROUP BY 1, 2)",
    "usage_by_day": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "usage_grouping_sets": "SELECT day, event_type, grouping_id(day, event_type)::BIGINT AS level, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY GROUPING SETS ((day, event_type), (day), (event_type), ())",
    "task_averages": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events WHERE event_type LIKE '%c%' AND value > 0 GROUP BY 1",
    "send_list": """SELECT category, content, times, kinds, rank, hidden FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY first, content) AS rank, greatest(count(*) OVER (PARTITION BY category) - 80, 0) AS hidden
        FROM (SELECT category, content, sum(n)::BIGINT AS times, min(first) AS first, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id % 20 AS category, md5(user_id::VARCHAR) AS content, event_type, min(event_id) AS first, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE rank <= 80""",
    "dominant_category": "SELECT user_id, max_by(event_type, (round(v, 4), event_type)) AS dominant FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1",
    "source_statistics": f"SELECT source, count(*) AS calls, count(*) FILTER (WHERE answered) AS answered, sum(length(title))::BIGINT AS chars FROM {RECORDS} GROUP BY 1",
    "expired": "SELECT event_type, count(*) FILTER (WHERE o) AS n_expired, count(*) FILTER (WHERE NOT o) AS n_kept FROM (SELECT event_type, ts < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY AND (starts_with(event_type, 'c') OR starts_with(event_type, 'p')) AS o FROM events) GROUP BY 1",
    "level_pivot": "SELECT rater, count(*) FILTER (WHERE level = 1) AS level_1, count(*) FILTER (WHERE level = 2) AS level_2, count(*) FILTER (WHERE level = 3) AS level_3, count(*) FILTER (WHERE level = 4) AS level_4 FROM reading_labels WHERE level IS NOT NULL GROUP BY 1",
    "label_precedence": "SELECT doc_id, min(level)::BIGINT AS level, count(*) AS n FROM reading_labels GROUP BY 1",
    "agreement": f"""SELECT tp, fn, fp, pre, tn, round(tp / nullif(tp + fp, 0), 6) AS precision_lenient, round(tp / nullif(tp + fp + pre, 0), 6) AS precision_strict, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + tn + fp + fn + pre, 0), 6) AS accuracy
        FROM (SELECT count(*) FILTER (WHERE l1 >= 3 AND l2 >= 3) AS tp, count(*) FILTER (WHERE l1 >= 3 AND l2 < 3) AS fn, count(*) FILTER (WHERE l1 < 3 AND l2 >= 3 AND l1 <> 2) AS fp, count(*) FILTER (WHERE l2 >= 3 AND l1 = 2) AS pre, count(*) FILTER (WHERE l1 < 3 AND l2 < 3) AS tn FROM {_PAIRS})""",
    "rater_f1": f"""SELECT label::BIGINT AS label, g::BIGINT AS support, round(coalesce(h / nullif(p, 0), 0), 6) AS precision, round(coalesce(h / nullif(g, 0), 0), 6) AS recall, round(2.0 * h / (g + p), 6) AS f1
        FROM (SELECT label, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM (SELECT l1 AS label, 1 AS g, 0 AS p, (l1 = l2)::INT AS h FROM {_PAIRS} UNION ALL SELECT l2, 0, 1, 0 FROM {_PAIRS}) GROUP BY 1)""",
    "run_difference": """SELECT CASE WHEN before IS NULL THEN 'gained' WHEN after IS NULL THEN 'lost' WHEN before = after THEN 'same' ELSE 'changed' END AS state, before::BIGINT AS before, count(*) AS n
        FROM (SELECT doc_id, level AS before FROM reading_labels WHERE rater = 'ra') FULL JOIN (SELECT doc_id, level AS after FROM reading_labels WHERE rater = 'rb') USING (doc_id) GROUP BY 1, 2""",
    "stratified_sample": f"SELECT source, doc_id FROM {_SAMPLE}",
    "sample_estimate": f"SELECT round(sum(size * p), 6) AS estimate, round(sum(size * p) / sum(size), 6) AS rate, sum(d)::BIGINT AS drawn FROM (SELECT source, max(size) AS size, avg(hit::INT) AS p, count(*) AS d FROM {_SAMPLE} GROUP BY 1)",
    "stratum_by_priority": "SELECT CASE WHEN text IS NULL THEN 'null' WHEN trim(text, ' ') = '' THEN 'blank' WHEN regexp_matches(text, '<[^>]+>') THEN 'markup' WHEN n_chars > 5000 THEN 'long' ELSE 'plain' END AS stratum, count(*) AS n FROM documents GROUP BY 1",
    "nearest_swap": f"""WITH e AS (SELECT doc_id, ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ref_id) AS place FROM {REFS} WHERE origin = 'list')
        SELECT marker_id, ref_id, min_by(o.ref_id, (abs(o.place - e.place), o.place)) AS swap_ref FROM (SELECT DISTINCT doc_id, marker_id, ref_ids, unnest(ref_ids) AS ref_id FROM markers) m JOIN e USING (doc_id, ref_id) JOIN e o ON o.doc_id = m.doc_id
        WHERE NOT list_contains(ref_ids, o.ref_id) AND abs(o.place - e.place) <= len(ref_ids) + 1 GROUP BY 1, 2""",
    "activity_streaks": """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS k FROM d), s AS (SELECT user_id, count(*) AS n, min(day) AS a FROM i GROUP BY user_id, k)
        SELECT user_id, max(n) AS longest, max_by(a, (n, a)) AS since, sum(n)::BIGINT AS active_days FROM s GROUP BY 1""",
    "activity_grid": "WITH k AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT event_type FROM k), (SELECT min(day) AS a, max(day) AS b FROM k)) SELECT g.event_type, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN k ON g.event_type = k.event_type AND g.day = k.day",
    "last_fortnight": "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts::DATE > DATE '2024-01-31' - 14 GROUP BY 1",
    "variant_flags": "SELECT l.rater, g.level::BIGINT AS gold, count(*) FILTER (WHERE l.level >= 3) AS alarms, count(*) FILTER (WHERE l.level < 3) AS quiet, count(*) FILTER (WHERE l.level IS NULL) AS failed FROM reading_labels l JOIN reading_labels g ON l.doc_id = g.doc_id AND g.rater = 'ra' AND g.level IS NOT NULL WHERE l.rater <> 'ra' GROUP BY 1, 2",
}
