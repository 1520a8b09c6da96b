"""Ranked retrieval and ordered sequences over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import entities as E
from quire.operators import retrieval as R
from quire.operators import sequences as Q
from quire.plans.joins import PARAS, SECTIONS, SENT, _NUMBERS, _RESOLVED, marker_spans, numbers, paragraphs, resolve_markers, sections, spans
from quire.plans.text import MARKERS, REFS, TOKENS, records, refs, sentence_rows
from quire.session import table

c = F.col
long = lambda name: F.col(name).cast("bigint").alias(name)


def questions(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", "question")


def scored(spark, folder):
    return R.bm25(table(spark, folder, "documents"), "doc_id", "text", questions(spark, folder), "item_id", "question")


def bm25_topk(spark, folder):
    """Flagship: the five best documents for each evaluation question."""
    best = R.top(scored(spark, folder), "item_id", [F.desc("score"), c("doc_id")], 5)
    return best.select(long("item_id"), "doc_id", long("rank"), "score")


def rrf_fusion(spark, folder):
    """BM25 and the count of shared words, fused by reciprocal rank."""
    pairs = scored(spark, folder)
    orders = ([F.desc("score"), c("doc_id")], [F.desc("n_terms"), c("n_tokens"), c("doc_id")])
    fused = R.fuse([R.top(pairs, "item_id", o, 40) for o in orders], ["item_id", "doc_id"])
    return R.top(fused, "item_id", [F.desc("fused"), c("doc_id")], 5).select(long("item_id"), "doc_id", long("rank"), "fused")


def rerank_top(spark, folder):
    """The forty best by BM25 in the order of shared words and shortness; a model's scores would take that column's place."""
    first = R.top(scored(spark, folder), "item_id", [F.desc("score"), c("doc_id")], 40).drop("rank")
    return R.top(first, "item_id", [F.desc("n_terms"), c("n_tokens"), c("doc_id")], 40).select(long("item_id"), "doc_id", long("rank"))


def cosine_topk(spark, folder):
    v = table(spark, folder, "embeddings")
    return R.cosine_top(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", long("rank"), "score")


def prefilter_neighbours(spark, folder):
    """The two longest sentences of each paragraph with the sentence before and after."""
    s = spans(spark, folder).select("para_id", "sent_ix", (c("stop") - c("begin")).alias("n"))
    best = R.top(s, "para_id", [F.desc("n"), c("sent_ix")], 2)
    return R.with_neighbours(best, s, "para_id", "sent_ix", 1).select("para_id", long("sent_ix"))


def sliding_windows3(spark, folder):
    s = sentence_rows(spark, folder)
    return Q.sliding(s, ["para_id"], ["sent_ix"], "text").select("para_id", long("sent_ix"), F.md5("window").alias("window_md5"))


def excerpt_fill(spark, folder):
    """Excerpts of paragraphs: windows of three sentences, those of most words first; no SQL, as the choice is greedy."""
    s = sentence_rows(spark, folder)
    w = Q.sliding(s, ["para_id"], ["sent_ix"], "text").select("para_id", long("sent_ix"), T.count_words(c("window")).cast("double").alias("score"), F.length("window").cast("bigint").alias("size"))
    return R.excerpt(w, "para_id", "sent_ix", "score", "size", room=600)


def verbatim_containment(spark, folder):
    """Documents that hold an evaluation question word for word (without case); candidates by BM25's shared words."""
    q = questions(spark, folder).select("item_id", T.ascii_lower(c("question")).alias("q"), F.size(F.array_distinct(T.tokens(c("question")))).alias("n"))
    hit = scored(spark, folder).join(q, "item_id").where("n_terms = n").select("item_id", "doc_id", "q")
    d = table(spark, folder, "documents").select("doc_id", T.ascii_lower(c("text")).alias("t"))
    return hit.join(d, "doc_id").where(F.contains("t", c("q"))).select(long("item_id"), "doc_id")


def newest_records(spark, folder):
    """The twelve newest records of each source."""
    r = records(spark, folder).where("answered AND year IS NOT NULL")
    return R.top(r, "source", [F.desc("year"), c("record_id")], 12).select("source", "record_id", long("year"), long("rank"))


def shortest_marker(spark, folder):
    """Per paragraph the shortest marker, the first of equal ones."""
    m = marker_spans(spark, folder)
    return m.groupBy("para_id").agg(F.min_by("marker_id", F.struct(c("end") - c("start"), "start", "marker_id")).alias("marker_id"))


def list_order(spark, folder):
    """Whether a bibliography is sorted by first author and year, by plain letters."""
    first = F.coalesce(T.ascii_lower(T.unaccent(F.get("authors", F.lit(0)))), F.lit(""))
    e = refs(spark, folder).where("origin = 'list'").select("doc_id", "pos", "ref_id", F.struct(first.alias("a"), F.coalesce("year", F.lit(0)).alias("y")).alias("k"))
    w = Window.partitionBy("doc_id").orderBy("pos", "ref_id")
    return e.withColumn("ok", F.coalesce(c("k") >= F.lag("k").over(w), F.lit(True))).groupBy("doc_id").agg(F.count_if(~c("ok")).alias("n_breaks"), F.count("*").alias("n"))


def marker_clusters(spark, folder):
    """Markers of a paragraph with only separators between them: cluster and its distinct references."""
    m = marker_spans(spark, folder).join(paragraphs(spark, folder).select("para_id", "text"), "para_id")
    w = Window.partitionBy("para_id").orderBy("start", "end", "marker_id")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.substr(c("text"), last + 1, F.greatest(c("start") - last, F.lit(0)))
    m = m.withColumn("fresh", last.isNull() | ~gap.rlike(r"^[\s,，;；、–—~～-]*$"))
    runs = Q.sessions(m, ["para_id"], ["start", "end", "marker_id"], c("fresh"))
    ids = runs.select("para_id", "session", "marker_id", F.explode_outer("ref_ids").alias("ref_id"))
    return ids.groupBy("para_id", "session").agg(F.countDistinct("marker_id").alias("n_markers"), F.countDistinct("ref_id").alias("n_refs")).select("para_id", long("session"), "n_markers", "n_refs")


def int_runs(spark, folder):
    return Q.integer_runs(numbers(spark, folder), ["marker_id"], "number").select("marker_id", "low", "high", "size")


def label_ranges(spark, folder):
    """Each manuscript's cited numbers as text like 1-3, 5."""
    runs = Q.integer_runs(numbers(spark, folder), ["doc_id"], "number")
    part = F.when(c("low") == c("high"), c("low").cast("string")).when(c("high") == c("low") + 1, F.concat_ws(", ", "low", "high")).otherwise(F.concat_ws("-", "low", "high"))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", part.alias("s")))), lambda x: x["s"]), ", ").alias("ranges"))


def renumbered_markers(spark, folder):
    """Numeric markers as they read once each list follows its first citations: new numbers in order, three or more in a row as a range.

    Uncited entries come last in their old order. A number that means no entry keeps its marker as it is.
    """
    seen = first_appearance(spark, folder)
    e = E.listed_entries(refs(spark, folder)).join(seen, ["doc_id", "ref_id"], "left")
    new = e.select("doc_id", "ref_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("rank").asc_nulls_last(), "place")).cast("bigint").alias("new"))
    cited = resolve_markers(spark, folder)
    whole = cited.groupBy("marker_id").agg(F.count_if(c("ref_id").isNull()).alias("lost")).where("lost = 0").select("marker_id")
    m = cited.join(whole, "marker_id").join(new.drop("doc_id"), "ref_id").select("marker_id", c("new").alias("number")).distinct()
    runs = Q.integer_runs(m, ["marker_id"], "number")
    part = F.when(c("size") >= 3, F.concat_ws("-", "low", "high")).when(c("size") == 2, F.concat_ws(", ", "low", "high")).otherwise(c("low").cast("string"))
    return runs.groupBy("marker_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", part.alias("s")))), lambda x: x["s"]), ", "), F.lit("]")).alias("raw"))


def first_appearance(spark, folder):
    m = marker_spans(spark, folder).join(paragraphs(spark, folder).select("para_id", "doc_id", "para_ix"), "para_id")
    cited = m.select("doc_id", "para_ix", "start", F.posexplode("ref_ids").alias("k", "ref_id"))
    return Q.first_appearance(cited, ["doc_id"], "ref_id", ["para_ix", "start", "k"])


def reorder_moves(spark, folder):
    """The least set of entries to move so that a list follows its first citations; no SQL: a longest increasing subsequence."""
    order = first_appearance(spark, folder).withColumnRenamed("rank", "new")
    e = refs(spark, folder).where("origin = 'list'").select("doc_id", "ref_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "ref_id")).cast("bigint").alias("old"))
    both = e.join(order, ["doc_id", "ref_id"], "left")
    new = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("new").asc_nulls_last(), "old")).cast("bigint")
    return Q.moves(both.withColumn("new", new), "doc_id", "ref_id", "old", "new")


def order_feasible(spark, folder):
    """Whether a list's order fits where its entries are cited first and last."""
    m = marker_spans(spark, folder).join(paragraphs(spark, folder).select("para_id", "doc_id", "para_ix"), "para_id")
    win = m.select("doc_id", F.explode("ref_ids").alias("ref_id"), "para_ix").groupBy("doc_id", "ref_id").agg(F.min("para_ix").alias("low"), F.max("para_ix").alias("high"))
    e = refs(spark, folder).where("origin = 'list'").select("doc_id", "ref_id", F.struct("pos", "ref_id").alias("place"))
    return Q.feasible(win.join(e, ["doc_id", "ref_id"]), "doc_id", "low", "high", "place")


def running_offset(spark, folder):
    p = paragraphs(spark, folder).where("text IS NOT NULL")
    return Q.running_offset(p, ["doc_id"], ["para_ix", "para_id"], F.length("text") + 1).select("para_id", long("offset"))


def last_heading(spark, folder):
    """The heading paragraph each paragraph stands under."""
    h = sections(spark, folder).where("heading_para_id IS NOT NULL").groupBy(c("heading_para_id").alias("para_id")).agg(F.min("section_id").alias("heading_section"))
    p = paragraphs(spark, folder).select("doc_id", "para_ix", "para_id").join(h, "para_id", "left")
    return Q.last_heading(p, ["doc_id"], ["para_ix", "para_id"], c("heading_section")).select("para_id", c("heading").alias("section_id"))


def heading_numbers(spark, folder):
    """Headings whose leading number continues their manuscript's sequence; no SQL: a state is carried."""
    h = sections(spark, folder).join(paragraphs(spark, folder).select(c("para_id").alias("heading_para_id"), c("para_ix").cast("bigint").alias("para_ix")), "heading_para_id")
    h = h.select("doc_id", "section_id", F.concat_ws("/", F.format_string("%012d", "para_ix"), "section_id").alias("place"), F.regexp_extract("title", r"^\s*([0-9]+)", 1).try_cast("bigint").alias("number"))
    return Q.heading_sequence(h, "doc_id", "place", "number").select("doc_id", F.substring_index("place", "/", -1).alias("section_id"), "number", "accepted")


def hierarchical_labels(spark, folder):
    """Numbers like 2.1 for headings by the depth of the number typed."""
    h = sections(spark, folder).join(paragraphs(spark, folder).select(c("para_id").alias("heading_para_id"), "para_ix"), "heading_para_id")
    depth = F.size(F.split(F.regexp_extract("title", r"^\s*([0-9]+(?:\.[0-9]+)*)", 1), r"\."))
    h = h.select("doc_id", "section_id", F.struct("para_ix", "section_id").alias("place"), depth.alias("level"))
    return Q.counters(h, ["doc_id"], "place", "level").select("section_id", long("level"), "label")


def document_order_ids(spark, folder):
    m = marker_spans(spark, folder).join(paragraphs(spark, folder).select("para_id", "doc_id", "para_ix"), "para_id", "left")
    return Q.numbered(m, "doc_id", "para_ix", [c("para_ix").asc_nulls_first(), "start", "marker_id"]).select("marker_id", long("number"))


QUERIES = {f.__name__: f for f in (bm25_topk, rrf_fusion, rerank_top, cosine_topk, prefilter_neighbours, sliding_windows3, excerpt_fill, verbatim_containment, newest_records, shortest_marker, list_order, marker_clusters, int_runs, label_ranges, renumbered_markers, first_appearance, reorder_moves, order_feasible, running_offset, last_heading, heading_numbers, hierarchical_labels, document_order_ids)}

_QTOKENS = TOKENS.replace("text", "question")
_SCORED = f"""(WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL), z AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM d),
    q AS (SELECT item_id, unnest(list_distinct({_QTOKENS})) AS token FROM eval_items), f AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM d),
    tf AS (SELECT doc_id, n, token, count(*) AS tf FROM f WHERE token IN (SELECT token FROM q) GROUP BY ALL), i AS (SELECT token, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean FROM tf, z GROUP BY token, n_docs, mean)
    SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS n_terms, max(n) AS n_tokens FROM tf JOIN i USING (token) JOIN q USING (token) GROUP BY 1, 2)"""
_PLACED = f"(SELECT m.*, p.doc_id AS pdoc, p.para_ix FROM {MARKERS} m JOIN {PARAS} p ON m.para_id = p.para_id)"
_FIRST = f"SELECT pdoc AS doc_id, ref_id, row_number() OVER (PARTITION BY pdoc ORDER BY f, ref_id) AS rank FROM (SELECT pdoc, ref_id, min((para_ix, start_pos, k)) AS f FROM (SELECT pdoc, para_ix, start_pos, unnest(ref_ids) AS ref_id, generate_subscripts(ref_ids, 1) AS k FROM {_PLACED}) WHERE ref_id IS NOT NULL GROUP BY 1, 2)"
_PLAIN = "coalesce(translate(regexp_replace(translate(authors[1], '{}', '{}'), '[\\x{{300}}-\\x{{36F}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')".format(T.ACCENTED, T.PLAIN)
_RUNS = "SELECT {k}, min(number) AS low, max(number) AS high, count(*) AS size FROM (SELECT *, number - row_number() OVER (PARTITION BY {k} ORDER BY number) AS i FROM (SELECT DISTINCT {k}, number FROM (" + _NUMBERS + "))) GROUP BY {k}, i"
SQL = {
    "bm25_topk": f"SELECT item_id::BIGINT AS item_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {_SCORED}) WHERE rank <= 5",
    "rrf_fusion": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r1, row_number() OVER (PARTITION BY item_id ORDER BY n_terms DESC, n_tokens, doc_id) AS r2 FROM {_SCORED})
        SELECT item_id::BIGINT AS item_id, doc_id, rank, fused FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(CASE WHEN r1 <= 40 THEN 1.0::DOUBLE / (60 + r1) ELSE 0 END + CASE WHEN r2 <= 40 THEN 1.0::DOUBLE / (60 + r2) ELSE 0 END, 9) AS fused FROM s WHERE r1 <= 40 OR r2 <= 40)) WHERE rank <= 5""",
    "rerank_top": f"SELECT item_id::BIGINT AS item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_terms DESC, n_tokens, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM {_SCORED}) WHERE r <= 40",
    "cosine_topk": "SELECT query, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10",
    "prefilter_neighbours": f"""WITH s AS (SELECT para_id, sent_ix, row_number() OVER (PARTITION BY para_id ORDER BY end_pos - start_pos DESC, sent_ix) AS r FROM {SENT}) SELECT DISTINCT s.para_id, s.sent_ix::BIGINT AS sent_ix FROM s JOIN s b ON b.para_id = s.para_id AND b.r <= 2 AND abs(b.sent_ix - s.sent_ix) <= 1""",
    "sliding_windows3": f"SELECT para_id, sent_ix::BIGINT AS sent_ix, md5(concat_ws(' ', text, lead(text, 1) OVER w, lead(text, 2) OVER w)) AS window_md5 FROM {SENT} WINDOW w AS (PARTITION BY para_id ORDER BY sent_ix)",
    "verbatim_containment": "SELECT item_id::BIGINT AS item_id, doc_id FROM eval_items JOIN documents ON contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(question, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))",
    "newest_records": "SELECT source, record_id, year::BIGINT AS year, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY year DESC, record_id) AS rank FROM (SELECT DISTINCT * EXCLUDE (seen_at) FROM candidate_records) WHERE answered AND year IS NOT NULL) WHERE rank <= 12",
    "shortest_marker": f"SELECT para_id, min_by(marker_id, (end_pos - start_pos, start_pos, marker_id)) AS marker_id FROM {MARKERS} GROUP BY 1",
    "list_order": f"SELECT doc_id, count(*) FILTER (WHERE NOT ok) AS n_breaks, count(*) AS n FROM (SELECT doc_id, coalesce(k >= lag(k) OVER (PARTITION BY doc_id ORDER BY pos, ref_id), true) AS ok FROM (SELECT doc_id, pos, ref_id, ({_PLAIN}, coalesce(year, 0)) AS k FROM {REFS} WHERE origin = 'list')) GROUP BY 1",
    "marker_clusters": f"""WITH m AS (SELECT m.marker_id, m.para_id, m.start_pos AS a, m.end_pos AS b, m.ref_ids, p.text FROM {MARKERS} m JOIN {PARAS} p ON m.para_id = p.para_id),
        l AS (SELECT *, max(b) OVER (PARTITION BY para_id ORDER BY a, b, marker_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM m),
        f AS (SELECT *, sum(CASE WHEN e IS NULL OR NOT regexp_matches(substr(text, e + 1, greatest(a - e, 0)), '^[\\s,，;；、–—~～-]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY para_id ORDER BY a, b, marker_id ROWS UNBOUNDED PRECEDING) AS session FROM l)
        SELECT para_id, session::BIGINT AS session, count(DISTINCT marker_id) AS n_markers, count(DISTINCT ref_id) AS n_refs FROM (SELECT para_id, session, marker_id, unnest(CASE WHEN len(ref_ids) > 0 THEN ref_ids ELSE [NULL] END) AS ref_id FROM f) GROUP BY 1, 2""",
    "int_runs": _RUNS.format(k="marker_id"),
    "label_ranges": f"SELECT doc_id, string_agg(CASE WHEN low = high THEN low::VARCHAR WHEN high = low + 1 THEN low || ', ' || high ELSE low || '-' || high END, ', ' ORDER BY low) AS ranges FROM ({_RUNS.format(k='doc_id')}) GROUP BY 1",
    "renumbered_markers": f"""WITH n AS (SELECT e.doc_id, e.ref_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.rank NULLS LAST, e.place) AS new FROM (SELECT doc_id, ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ref_id) AS place FROM {REFS} WHERE origin = 'list') e LEFT JOIN ({_FIRST}) f ON f.doc_id = e.doc_id AND f.ref_id = e.ref_id),
        r AS (SELECT * FROM ({_RESOLVED})), m AS (SELECT DISTINCT r.marker_id, n.new AS number FROM r JOIN n ON n.ref_id = r.ref_id WHERE r.marker_id NOT IN (SELECT marker_id FROM r WHERE ref_id IS NULL)),
        k AS (SELECT marker_id, min(number) AS low, max(number) AS high, count(*) AS size FROM (SELECT *, number - row_number() OVER (PARTITION BY marker_id ORDER BY number) AS i FROM m) GROUP BY marker_id, i)
        SELECT marker_id, '[' || string_agg(CASE WHEN size >= 3 THEN low || '-' || high WHEN size = 2 THEN low || ', ' || high ELSE low::VARCHAR END, ', ' ORDER BY low) || ']' AS raw FROM k GROUP BY 1""",
    "first_appearance": _FIRST,
    "order_feasible": f"""WITH w AS (SELECT pdoc AS doc_id, ref_id, min(para_ix) AS low, max(para_ix) AS high FROM (SELECT pdoc, para_ix, unnest(ref_ids) AS ref_id FROM {_PLACED}) GROUP BY 1, 2)
        SELECT doc_id, bool_and(m <= high) AS feasible, count(*) AS n_items FROM (SELECT doc_id, high, max(low) OVER (PARTITION BY doc_id ORDER BY pos, ref_id ROWS UNBOUNDED PRECEDING) AS m FROM w JOIN (SELECT doc_id, ref_id, pos FROM {REFS} WHERE origin = 'list') USING (doc_id, ref_id)) GROUP BY 1""",
    "running_offset": f"SELECT para_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para_ix, para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM {PARAS} WHERE text IS NOT NULL",
    "last_heading": f"SELECT para_id, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_ix, para_id ROWS UNBOUNDED PRECEDING) AS section_id FROM {PARAS} LEFT JOIN (SELECT heading_para_id AS para_id, min(section_id) AS h FROM {SECTIONS} WHERE heading_para_id IS NOT NULL GROUP BY 1) USING (para_id)",
    "document_order_ids": f"SELECT marker_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.para_ix NULLS FIRST, m.start_pos, m.marker_id) AS number FROM {MARKERS} m LEFT JOIN {PARAS} p ON m.para_id = p.para_id",
    "hierarchical_labels": f"""WITH h AS (SELECT s.doc_id, s.section_id, p.para_ix, len(regexp_split_to_array(regexp_extract(s.title, '^\\s*([0-9]+(?:\\.[0-9]+)*)', 1), '\\.')) AS level FROM {SECTIONS} s JOIN {PARAS} p ON p.para_id = s.heading_para_id),
        k AS (SELECT a.section_id, a.level, i, count(*) FILTER (WHERE b.level = i AND (b.para_ix, b.section_id) > coalesce((SELECT max((z.para_ix, z.section_id)) FROM h z WHERE z.doc_id = a.doc_id AND z.level < i AND (z.para_ix, z.section_id) <= (a.para_ix, a.section_id)), (-1, ''))) AS n
              FROM h a CROSS JOIN range(1, 10) r(i) LEFT JOIN h b ON b.doc_id = a.doc_id AND (b.para_ix, b.section_id) <= (a.para_ix, a.section_id) WHERE i <= coalesce(a.level, 0) GROUP BY a.doc_id, a.section_id, a.para_ix, a.level, i)
        SELECT h.section_id, h.level::BIGINT AS level, coalesce(string_agg(k.n::VARCHAR, '.' ORDER BY i), '') AS label FROM h LEFT JOIN k ON k.section_id = h.section_id GROUP BY 1, 2""",
    "heading_numbers": f"""WITH RECURSIVE h AS (SELECT s.doc_id, s.section_id, try_cast(regexp_extract(s.title, '^\\s*([0-9]+)', 1) AS BIGINT) AS number, row_number() OVER (PARTITION BY s.doc_id ORDER BY p.para_ix, s.section_id) AS k FROM {SECTIONS} s JOIN {PARAS} p ON p.para_id = s.heading_para_id),
        w AS (SELECT doc_id, section_id, number, k, coalesce(number = 1, false) AS accepted, CASE WHEN number = 1 THEN 1 ELSE 0 END::BIGINT AS last FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.section_id, h.number, h.k, coalesce(h.number > 0 AND h.number IN (w.last, w.last + 1), false), CASE WHEN h.number > 0 AND h.number IN (w.last, w.last + 1) THEN h.number ELSE w.last END FROM w JOIN h ON h.doc_id = w.doc_id AND h.k = w.k + 1)
        SELECT doc_id, section_id, number, accepted FROM w""",
}
