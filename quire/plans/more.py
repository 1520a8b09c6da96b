"""Further operators over whole tables: grounding, evidence, tags, likeness bands, duplicates, matching; and SQL where it can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.fuzzy import plain_udf
from quire.functions.references import parse_reference_udf
from quire.operators import intervals as I
from quire.operators.alike import arranged_udf, likest
from quire.operators.evidence import locate_udf
from quire.operators.retrieval import top
from quire.operators.sequences import numbered
from quire.plans.joins import _KEY, PARAS, SENT, STORED, marker_spans, paragraphs, spans
from quire.plans.text import MARKERS, REFS, records, refs, sentence_rows
from quire.session import table

c = F.col
long = lambda name: F.col(name).cast("bigint").alias(name)


def grounded_fields(spark, folder):
    """Parsed fields that really stand in their bibliography line, by comparison keys; how many are kept of each."""
    r = refs(spark, folder).where("raw IS NOT NULL")
    inside = lambda f: F.when(F.col(f).isNotNull() & (T.squash(c(f)) != ""), F.contains(T.squash(c("raw")), T.squash(c(f))))
    return r.select("ref_id", inside("title").alias("title_kept"), inside("venue").alias("venue_kept"), inside("doi").alias("doi_kept"))


def parsed_references(spark, folder):
    """Bibliography lines taken apart; no SQL: an order of styles is tried."""
    return refs(spark, folder).where("raw IS NOT NULL").select("ref_id", parse_reference_udf("raw").alias("p")).select("ref_id", "p.*")


def parser_agreement(spark, folder):
    """How often what is parsed anew agrees with the stored fields, by language; no SQL."""
    p = refs(spark, folder).where("raw IS NOT NULL").select("lang", c("year").alias("y"), c("title").alias("t"), c("doi").alias("d"), parse_reference_udf("raw").alias("p"))
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(c("y") == c("p.year")).alias("same_year"), F.count_if(T.squash(c("t")) == T.squash(c("p.title"))).alias("same_title"), F.count_if(F.lower("d").endswith(c("p.doi"))).alias("same_doi"))


def skippable_paragraphs(spark, folder):
    """Paragraphs not worth proofreading: short, or mostly digits and signs."""
    t = c("text")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return paragraphs(spark, folder).where("text IS NOT NULL").select("para_id", ((F.length(t) < 20) | (letters < 0.5 * F.length(F.regexp_replace(t, r"\s+", "")))).alias("skip"))


def bibliography_tail(spark, folder):
    """Whether the last fifth of a manuscript's paragraphs is a bibliography: three fifths of them bear a year."""
    p = paragraphs(spark, folder).where("text IS NOT NULL").select("doc_id", "para_ix", "para_id", c("text").rlike("(?:19|20)[0-9][0-9]").alias("dated"))
    whole = p.groupBy("doc_id").agg(F.count("*").alias("size"))
    place = F.when(c("size") == 1, 0.0).otherwise((c("number") - 1) / (c("size") - 1))
    p = numbered(p, "doc_id", "para_ix", ["para_ix", "para_id"]).join(whole, "doc_id").withColumn("place", place)
    return p.where("place >= 0.8").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(c("dated")).alias("n_dated"), (F.count_if(c("dated")) >= 0.6 * F.count("*")).alias("is_bibliography"))


def tagged_sentences(spark, folder):
    """Sentences with their markers replaced by local tags <1>, <2>, so that equal sentences of different manuscripts are equal."""
    s = sentence_rows(spark, folder).select("para_id", "sent_ix", "text", c("start_pos").alias("begin"), c("end_pos").alias("stop"))
    hit = I.contained(marker_spans(spark, folder), s, "para_id").select("para_id", "sent_ix", "text", (c("start") - c("begin")).alias("a"), (c("end") - c("begin")).alias("b"))
    w = Window.partitionBy("para_id", "sent_ix").orderBy("a", "b")
    spanned = hit.distinct().withColumn("k", F.row_number().over(w)).groupBy("para_id", "sent_ix").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(F.struct("a", "b", "k")), asc=False).alias("ms"))
    put = F.aggregate("ms", c("text"), lambda t, m: F.concat(F.substr(t, F.lit(1), m["a"]), F.lit("<"), m["k"].cast("string"), F.lit(">"), F.substr(t, m["b"] + 1, F.length(t))))
    return spanned.select("para_id", long("sent_ix"), put.alias("tagged"))


def gray_zone(spark, folder):
    """For each entry the three likest record titles from 70 on, titles told apart by their key; all titles are considered.

    A title without a letter of the key's (one in another script) is told apart by its words.
    """
    r = refs(spark, folder).where("title IS NOT NULL").select("ref_id", arranged_udf("title").alias("a")).where("a <> ''")
    d = records(spark, folder).where("title IS NOT NULL").select(T.squash(c("title")).alias("key"), plain_udf("title").alias("u")).select(F.coalesce(F.nullif("key", F.lit("")), "u").alias("key"), "u").where("u <> ''").groupBy("key").agg(F.min("u").alias("u")).select("key", arranged_udf("u").alias("b"))
    s = likest(r, d, 70.0, 3).join(d, "b").select("a", "key", F.round("score", 4).alias("score"))
    best = top(s, "a", [F.desc("score"), c("key")], 3)
    return r.join(best, "a").select("ref_id", "key", "score", long("rank"))


def content_duplicates(spark, folder):
    """One row a document with the first document of equal content and how many copies there are."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    return d.join(groups, "h").select("doc_id", "first_id", "n_copies")


def span_hit_rate(spark, folder):
    """Of the markers in split paragraphs: how much of each the sentences that overlap it cover, and the share of hits."""
    m = marker_spans(spark, folder).join(spans(spark, folder).select("para_id").distinct(), "para_id", "left_semi")
    s = I.merged(spans(spark, folder).select("para_id", c("begin").alias("start"), c("stop").alias("end")), "para_id").select("para_id", c("start").alias("begin"), c("end").alias("stop"))
    cover = I.overlapping(m, s, "para_id").groupBy("marker_id").agg(F.sum(F.least("end", "stop") - F.greatest("start", "begin")).alias("n"))
    per = m.join(cover, "marker_id", "left").select(F.coalesce(c("n") / (c("end") - c("start")), F.lit(0.0)).alias("share"))
    return per.agg(F.count("*").alias("n_markers"), F.count_if(c("share") >= 0.5).alias("n_hits"), F.round(F.avg("share"), 6).alias("mean_share"))


def located_sentences(spark, folder):
    """Stored sentences found again in their paragraph by their text alone; no SQL: normal forms with offset maps."""
    s = table(spark, folder, "sentences").distinct().where("text IS NOT NULL")
    p = paragraphs(spark, folder).select("para_id", c("text").alias("source"))
    hit = s.join(p, "para_id").select("para_id", long("sent_ix"), "start_pos", "end_pos", locate_udf("text", "source").alias("x"))
    return hit.select("para_id", "sent_ix", long("start_pos"), c("x.start").cast("bigint").alias("found"), (c("x.start") == c("start_pos")).alias("same_place"))


def exact_positions(spark, folder):
    """The first place of each stored sentence's text in its paragraph, word for word, from 0; null where it isn't."""
    s = table(spark, folder, "sentences").distinct().where("text <> ''")
    hit = s.join(paragraphs(spark, folder).select("para_id", c("text").alias("source")), "para_id")
    return hit.select("para_id", long("sent_ix"), F.nullif(F.instr("source", c("text")), F.lit(0)).cast("bigint").alias("place"))


def matched_boundaries(spark, folder):
    """Where the older splitter ended sentences against where the splitter here does, each used once, nearest first: right within 3 characters, missed, false; no SQL: greedy."""
    stored = table(spark, folder, "sentences").distinct()
    a = stored.select("para_id", c("end_pos").alias("p"), F.lit(0).alias("side"))
    b = spans(spark, folder).join(stored.select("para_id").distinct(), "para_id", "left_semi").select("para_id", c("stop").cast("int").alias("p"), F.lit(1).alias("side"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (sorted(pdf.loc[pdf["side"] == k, "p"].tolist()) for k in (0, 1))
        near = sorted((abs(p - q), i, j) for i, p in enumerate(x) for j, q in enumerate(y) if abs(p - q) <= 3)
        left, right = set(), set()
        for _, i, j in near:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
        return pd.DataFrame({"para_id": [pdf["para_id"].iloc[0]], "n_right": [len(left)], "n_missed": [len(y) - len(right)], "n_false": [len(x) - len(left)]})

    return a.unionByName(b).groupBy("para_id").applyInPandas(match, "para_id string, n_right bigint, n_missed bigint, n_false bigint")


def repeated_loads(spark, folder):
    """How many rows of each manuscript table are repeats of a row, and the latest load."""
    out = None
    for name, key in (("sections", "section_id"), ("paragraphs", "para_id"), ("markers", "marker_id"), ("bib_entries", "entry_id"), ("reference_entries", "ref_id")):
        one = table(spark, folder, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(key)).alias("n_repeats"))
        out = one if out is None else out.unionByName(one)
    return out


def weighted_progress(spark, folder):
    """Overall progress: each event kind's share of rows above 50, by a fixed weight."""
    weights = F.create_map(*(F.lit(x) for x in ("click", 1.0, "view", 1.0, "purchase", 3.0, "signup", 2.0)))
    g = table(spark, folder, "events").groupBy("event_type").agg(F.avg((c("value") > 50).cast("double")).alias("done"))
    w = F.coalesce(F.element_at(weights, c("event_type")), F.lit(0.5))
    return g.agg(F.round(F.sum(w * c("done")) / F.sum(w), 6).alias("progress"), F.count("*").alias("n_layers"))


def remapped_scores(spark, folder):
    """Two raters' levels as easy, demanding or abstaining; abstentions count as missed, alarms in two conventions."""
    l = table(spark, folder, "reading_labels")
    word = lambda x: F.when(x.isNull(), "abstain").when(x >= 3, "demanding").otherwise("easy")
    p = l.where("rater = 'ra'").select("doc_id", word(c("level")).alias("gold")).join(l.where("rater = 'rb'").select("doc_id", word(c("level")).alias("got")), "doc_id")
    alarm, right = c("got") == "demanding", c("gold") == "demanding"
    n = p.agg(F.count("*").alias("n"), F.count_if(alarm & right).alias("tp"), F.count_if(alarm & ~right).alias("fp"), F.count_if(~alarm & right).alias("fn"), F.count_if((c("got") == "abstain") | (c("gold") == "abstain")).alias("n_abstained"))
    return n.select("n", "tp", "fp", "fn", "n_abstained", F.round(F.try_divide(2.0 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"), F.round(F.try_divide(c("tp") + c("fp"), c("n")), 6).alias("alarm_rate"))


def labelled_pairs(spark, folder):
    """Documents with a level both raters and the text agree to exist, once per document and level."""
    d = table(spark, folder, "documents").where("text IS NOT NULL AND n_chars > 0").select("doc_id", "source")
    return table(spark, folder, "reading_labels").where("level IS NOT NULL").join(d, "doc_id").select("doc_id", c("level").cast("bigint").alias("want"), "source").distinct()


def unreachable_note(spark, folder):
    """One note for all sources that gave nothing: how many records and sources, and the sources' names in order."""
    gone = records(spark, folder).where("NOT answered")
    return gone.agg(F.countDistinct("record_id").alias("n_records"), F.countDistinct("source").alias("n_sources"), F.nullif(F.array_join(F.array_sort(F.collect_set("source")), ", "), F.lit("")).alias("sources"))


def metric_bands(spark, folder):
    """Manuscripts' measures against the quartiles over all manuscripts: how many lie below, within and above."""
    from quire.operators import statistics as S

    per = refs(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(c("doi").isNotNull().cast("int")).alias("doi"), F.avg((c("year") >= 2015).cast("int")).alias("recent"))
    longs = S.long_metrics(per, ["doc_id"], {"n_refs": c("n"), "doi_share": c("doi"), "recent_share": c("recent")})
    q = S.quartiles(longs, ["metric"], "value").select("metric", "q1", "q3")
    return longs.join(F.broadcast(q), "metric").groupBy("metric", S.band(c("value"), c("q1"), c("q3")).alias("flag")).agg(F.count("*").alias("n_docs"))  # one row per measure


QUERIES = {f.__name__: f for f in (grounded_fields, parsed_references, parser_agreement, skippable_paragraphs, bibliography_tail, tagged_sentences, gray_zone, content_duplicates, span_hit_rate, located_sentences, exact_positions, matched_boundaries, repeated_loads, weighted_progress, remapped_scores, labelled_pairs, unreachable_note, metric_bands)}

_IN = f"SELECT s.para_id, s.sent_ix, s.text, m.start_pos - s.start_pos AS a, m.end_pos - s.start_pos AS b FROM {MARKERS} m JOIN {SENT} s ON m.para_id = s.para_id AND s.start_pos <= m.start_pos AND m.end_pos <= s.end_pos"
_HELD = lambda f: f"CASE WHEN {f} IS NOT NULL AND {_KEY.format(f)} <> '' THEN contains({_KEY.format('raw')}, {_KEY.format(f)}) END AS {f}_kept"
SQL = {
    "weighted_progress": "SELECT round(sum(w * d) / sum(w), 6) AS progress, count(*) AS n_layers FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.0 ELSE 0.5 END::DOUBLE AS w, avg((value > 50)::INT) AS d FROM events GROUP BY 1)",
    "remapped_scores": """SELECT n, tp, fp, fn, n_abstained, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + fp) / nullif(n, 0), 6) AS alarm_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(b.level >= 3, false) AND coalesce(a.level >= 3, false)) AS tp, count(*) FILTER (WHERE coalesce(b.level >= 3, false) AND NOT coalesce(a.level >= 3, false)) AS fp,
        count(*) FILTER (WHERE NOT coalesce(b.level >= 3, false) AND coalesce(a.level >= 3, false)) AS fn, count(*) FILTER (WHERE a.level IS NULL OR b.level IS NULL) AS n_abstained FROM reading_labels a JOIN reading_labels b ON a.doc_id = b.doc_id AND a.rater = 'ra' AND b.rater = 'rb')""",
    "labelled_pairs": "SELECT DISTINCT doc_id, level::BIGINT AS want, source FROM reading_labels JOIN documents USING (doc_id) WHERE level IS NOT NULL AND text IS NOT NULL AND n_chars > 0",
    "unreachable_note": "SELECT count(DISTINCT record_id) AS n_records, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM candidate_records WHERE NOT answered",
    "metric_bands": f"""WITH p AS (SELECT doc_id, count(*)::DOUBLE AS n_refs, avg((doi IS NOT NULL)::INT) AS doi_share, avg((year >= 2015)::INT) AS recent_share FROM {REFS} GROUP BY 1), l AS (FROM p UNPIVOT INCLUDE NULLS (value FOR metric IN (n_refs, doi_share, recent_share))),
        q AS (SELECT * FROM (SELECT metric, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1) WHERE n >= 3 AND q3 > q1)
        SELECT metric, CASE WHEN value IS NULL THEN 'na' WHEN value < q1 THEN 'below' WHEN value > q3 THEN 'above' ELSE 'within' END AS flag, count(*) AS n_docs FROM l JOIN q USING (metric) GROUP BY 1, 2""",
    "grounded_fields": f"SELECT ref_id, {_HELD('title')}, {_HELD('venue')}, {_HELD('doi')} FROM {REFS} WHERE raw IS NOT NULL",
    "skippable_paragraphs": f"SELECT para_id, length(text) < 20 OR len(regexp_extract_all(text, '\\p{{L}}')) < 0.5 * length(regexp_replace(text, '\\s+', '', 'g')) AS skip FROM {PARAS} WHERE text IS NOT NULL",
    "bibliography_tail": f"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE d) AS n_dated, count(*) FILTER (WHERE d) >= 0.6 * count(*) AS is_bibliography FROM (SELECT doc_id, regexp_matches(text, '(?:19|20)[0-9][0-9]') AS d, percent_rank() OVER (PARTITION BY doc_id ORDER BY para_ix, para_id) AS p FROM {PARAS} WHERE text IS NOT NULL) WHERE p >= 0.8 GROUP BY 1",
    "tagged_sentences": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY para_id, sent_ix ORDER BY a, b) AS k, coalesce(lag(b) OVER (PARTITION BY para_id, sent_ix ORDER BY a, b), 0) AS e FROM (SELECT DISTINCT * FROM ({_IN})))
        SELECT para_id, sent_ix::BIGINT AS sent_ix, string_agg(substr(text, e + 1, a - e) || '<' || k || '>', '' ORDER BY k) || substr(first(text), max(b) + 1) AS tagged FROM m GROUP BY 1, 2""",
    "content_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL",
    "span_hit_rate": f"""WITH k AS MATERIALIZED (SELECT * FROM {SENT}), m AS (SELECT * FROM {MARKERS} WHERE para_id IN (SELECT para_id FROM k)), p AS (SELECT marker_id, start_pos, end_pos, (SELECT count(*) FROM range(m.start_pos, m.end_pos) r(i) WHERE EXISTS (SELECT 1 FROM k s WHERE s.para_id = m.para_id AND s.start_pos <= r.i AND r.i < s.end_pos)) AS n FROM m)
        SELECT count(*) AS n_markers, count(*) FILTER (WHERE n / (end_pos - start_pos) >= 0.5) AS n_hits, round(avg(coalesce(n / (end_pos - start_pos), 0)), 6) AS mean_share FROM p""",
    "exact_positions": f"SELECT s.para_id, s.sent_ix::BIGINT AS sent_ix, nullif(instr(p.text, s.text), 0)::BIGINT AS place FROM {STORED} s JOIN {PARAS} p ON p.para_id = s.para_id WHERE s.text <> ''",
    "repeated_loads": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(*) - count(DISTINCT {k}) AS n_repeats FROM {n}" for n, k in (("sections", "section_id"), ("paragraphs", "para_id"), ("markers", "marker_id"), ("bib_entries", "entry_id"), ("reference_entries", "ref_id"))),
}
