"""Joins and matching over manuscripts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import entities as E
from quire.operators import intervals as I
from quire.operators.sequences import running_offset
from quire.plans.text import MARKERS, REFS, SENTENCES, latest, refs, sentence_rows
from quire.session import table

c = F.col
long = lambda name: F.col(name).cast("bigint").alias(name)


def paragraphs(spark, folder):
    return latest(table(spark, folder, "paragraphs"), "para_id")


def sections(spark, folder):
    return latest(table(spark, folder, "sections"), "section_id")


def markers(spark, folder):
    return latest(table(spark, folder, "markers"), "marker_id")


def spans(spark, folder):
    """Sentences of all body paragraphs as [begin, stop)."""
    return sentence_rows(spark, folder).select("para_id", "sent_ix", c("start_pos").alias("begin"), c("end_pos").alias("stop"))


def marker_spans(spark, folder):
    return markers(spark, folder).select("para_id", "marker_id", c("start_pos").alias("start"), c("end_pos").alias("end"), "ref_ids")


def section_paragraphs(spark, folder):
    joined = paragraphs(spark, folder).join(sections(spark, folder).select("section_id", "canonical"), "section_id")
    return joined.groupBy("canonical").agg(F.count("*").alias("n_paragraphs"), F.countDistinct("section_id").alias("n_sections"))


def claim_references(spark, folder):
    """Each sentence with the references its markers cite, distinct, numbered in order of first citation."""
    hits = I.contained(marker_spans(spark, folder), spans(spark, folder), "para_id")
    cited = hits.select("para_id", "sent_ix", "start", F.posexplode("ref_ids").alias("k", "ref_id"))
    first = cited.groupBy("para_id", "sent_ix", "ref_id").agg(F.min(F.struct("start", "k")).alias("first")).join(refs(spark, folder).select("ref_id"), "ref_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("para_id", "sent_ix").orderBy("first", "ref_id"))
    return first.select("para_id", long("sent_ix"), "ref_id", rank.cast("bigint").alias("rank"))


def numbers(spark, folder):
    return E.marker_numbers(markers(spark, folder))


def entries(spark, folder):
    return E.listed_entries(refs(spark, folder))


def resolve_markers(spark, folder):
    """The entry of each number: the one that bears it as label, else the one at that place."""
    return E.numbered_links(markers(spark, folder), refs(spark, folder))


def unresolved_numbers(spark, folder):
    return resolve_markers(spark, folder).where("ref_id IS NULL").select("marker_id", "number")


def uncited_entries(spark, folder):
    cited = markers(spark, folder).select(F.explode("ref_ids").alias("ref_id")).distinct()
    return refs(spark, folder).join(cited, "ref_id", "left_anti").select("doc_id", "ref_id")


def marker_in_sentence(spark, folder):
    hit = I.contained(marker_spans(spark, folder), spans(spark, folder), "para_id")
    return hit.select("marker_id", "para_id", long("sent_ix"))


def marker_overlaps(spark, folder):
    """Markers that a sentence boundary cuts: they overlap several sentences."""
    hit = I.overlapping(marker_spans(spark, folder), spans(spark, folder), "para_id")
    return hit.groupBy("marker_id").agg(F.count("*").alias("n_sentences")).where("n_sentences > 1")


def marker_as_of(spark, folder):
    """The last stored sentence that begins at or before each marker."""
    points = marker_spans(spark, folder).select("para_id", "marker_id", "start")
    runs = spans(spark, folder).select("para_id", "begin", "sent_ix")
    hit = I.as_of(points, runs, "para_id", "start", "begin", ["sent_ix"])
    return hit.select("marker_id", long("sent_ix"))


def event_as_of_order(spark, folder):
    """Each event with the value of its user's previous purchase, by time."""
    e = table(spark, folder, "events")
    runs = e.where("event_type = 'purchase'").select("user_id", c("ts").alias("begin"), "value")
    points = e.where("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    return I.as_of(points, runs, "user_id", "ts", "begin", ["value"]).select("event_id", "value")


def composed_offsets(spark, folder):
    """Markers' places from sentence to paragraph to document: two offset maps composed."""
    par = paragraphs(spark, folder).where("text IS NOT NULL").select("doc_id", "para_ix", "para_id", F.length("text").alias("size"))
    second = running_offset(par, ["doc_id"], ["para_ix", "para_id"], c("size") + 1).select("para_id", F.lit(0).alias("b_begin"), c("size").alias("b_stop"), c("offset").alias("c_from"))
    first = spans(spark, folder).select("para_id", "sent_ix", F.lit(0).alias("a_from"), (c("stop") - c("begin")).alias("a_to"), c("begin").alias("b_from"))
    j = I.compose(first, second, "para_id")
    return j.groupBy("para_id").agg(F.count("*").alias("n_pieces"), F.min("c_from").cast("bigint").alias("doc_from"), F.sum(c("a_to") - c("a_from")).cast("bigint").alias("n_chars"))


def missing_pairs(spark, folder):
    """Every document and rating level a rater could give, with 0 where no label is."""
    docs = table(spark, folder, "reading_labels").select("doc_id").distinct()
    pairs = docs.select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("level"))
    given = table(spark, folder, "reading_labels").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    done = pairs.join(given, ["doc_id", "level"], "left")
    return done.select("doc_id", long("level"), F.coalesce("n", F.lit(0)).alias("n"), F.when(c("n").isNull(), "undetermined").otherwise("given").alias("state"))


def first_duplicates(spark, folder):
    """Entries of a manuscript whose title key an earlier entry has: the earliest is named."""
    keyed = refs(spark, folder).select("doc_id", "ref_id", "pos", T.squash(c("title")).alias("k")).where("k <> ''")
    w = Window.partitionBy("doc_id", "k")
    named = keyed.withColumn("first_ref", F.min_by("ref_id", F.struct("pos", "ref_id")).over(w))
    return named.where("ref_id <> first_ref").select("ref_id", "first_ref")


def union_ladder(spark, folder):
    """A marker's sentence: the one that holds it, else the last that begins before it, else none; the best step wins."""
    steps = marker_in_sentence(spark, folder).select("marker_id", "sent_ix", F.lit(1).alias("step")).unionByName(marker_as_of(spark, folder).where("sent_ix IS NOT NULL").select("marker_id", "sent_ix", F.lit(2).alias("step")))
    best = steps.groupBy("marker_id").agg(F.min(F.struct("step", "sent_ix")).alias("b"))
    return markers(spark, folder).select("marker_id").join(best, "marker_id", "left").select("marker_id", F.coalesce(c("b.step"), F.lit(3)).cast("bigint").alias("step"), c("b.sent_ix").alias("sent_ix"))


def aligned_texts(spark, folder):
    """Bibliography titles and record titles aligned by their key, with what only one side has."""
    a = refs(spark, folder).select(T.squash(c("title")).alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n_refs"))
    b = table(spark, folder, "candidate_records").drop("seen_at").distinct().select(T.squash(c("title")).alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n_records"))
    side = F.when(c("n_refs").isNull(), "records").when(c("n_records").isNull(), "refs").otherwise("both")
    return a.join(b, "k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n_keys"), F.sum(F.coalesce("n_refs", F.lit(0))).alias("n_refs"), F.sum(F.coalesce("n_records", F.lit(0))).alias("n_records"))


def dimension_lookup(spark, folder):
    """Section labels against the heading list, by exact small name; a small dimension, so a broadcast left join."""
    names = table(spark, folder, "heading_catalog").select(T.ascii_lower(c("name")).alias("k"), "entry_code")  # a list of headings, bounded by its nature
    typed = sections(spark, folder).where("title IS NOT NULL").select("section_id", T.ascii_lower(F.trim(c("title"))).alias("k"))
    return typed.join(F.broadcast(names), "k", "left").groupBy("entry_code").agg(F.count("*").alias("n_sections"))


def offered_choices(spark, folder):
    """Only what was offered may be chosen: markers' references that are entries of the marker's own manuscript."""
    chosen = markers(spark, folder).select("doc_id", "marker_id", F.explode("ref_ids").alias("ref_id"))
    return chosen.join(refs(spark, folder).select("doc_id", "ref_id"), ["doc_id", "ref_id"], "left_semi").select("marker_id", "ref_id").distinct()


def elementary_pieces(spark, folder):
    """Paragraphs cut at all marker and sentence bounds; a marker outranks a sentence."""
    a = marker_spans(spark, folder).select("para_id", "start", "end", F.lit(2).alias("r"))
    b = spans(spark, folder).select("para_id", c("begin").alias("start"), c("stop").alias("end"), F.lit(1).alias("r"))
    return I.elementary(a.unionByName(b), "para_id", c("r")).select("para_id", long("start"), long("end"), long("top_rank"), "n_spans")


def merged_spans(spark, folder):
    s = spans(spark, folder).select("para_id", c("begin").alias("start"), c("stop").alias("end"))
    return I.merged(s, "para_id").select("para_id", long("start"), long("end"))


QUERIES = {f.__name__: f for f in (section_paragraphs, claim_references, resolve_markers, unresolved_numbers, uncited_entries, marker_in_sentence, marker_overlaps, marker_as_of, event_as_of_order, composed_offsets, missing_pairs, first_duplicates, union_ladder, aligned_texts, dimension_lookup, offered_choices, elementary_pieces, merged_spans)}

PARAS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM paragraphs)"
SECTIONS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM sections)"
SENT = SENTENCES
STORED = "(SELECT DISTINCT * FROM sentences)"
_KEY = "regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z一-鿿]+', '', 'g')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_IN = f"SELECT m.marker_id, m.para_id, s.sent_ix::BIGINT AS sent_ix, m.start_pos, m.ref_ids FROM {MARKERS} m JOIN {SENT} s ON m.para_id = s.para_id AND s.start_pos <= m.start_pos AND m.end_pos <= s.end_pos"
_ASOF = f"SELECT m.marker_id, (SELECT max_by(s.sent_ix, (s.start_pos, s.sent_ix)) FROM {SENT} s WHERE s.para_id = m.para_id AND s.start_pos <= m.start_pos)::BIGINT AS sent_ix FROM {MARKERS} m"
_NUMBERS = f"""SELECT DISTINCT doc_id, marker_id, unnest(range(least(lo, hi), greatest(lo, hi) + 1)) AS number FROM (SELECT doc_id, marker_id, regexp_extract(x, '^[0-9]+')::BIGINT AS lo, regexp_extract(x, '[0-9]+$')::BIGINT AS hi
    FROM (SELECT doc_id, marker_id, unnest(regexp_extract_all(raw, '[0-9]+ *[-–] *[0-9]+|[0-9]+')) AS x FROM {MARKERS} WHERE starts_with(raw, '[')))"""
_ENTRIES = f"SELECT doc_id, ref_id, try_cast(nullif(regexp_extract(label, '^\\[?([0-9]+)\\]?$', 1), '') AS BIGINT) AS label_number, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ref_id) AS place FROM {REFS} WHERE origin = 'list'"
_RESOLVED = f"""WITH e AS ({_ENTRIES}) SELECT n.marker_id, n.number, coalesce(l.ref_id, p.ref_id) AS ref_id FROM ({_NUMBERS}) n
    LEFT JOIN (SELECT doc_id, label_number, min_by(ref_id, place) AS ref_id FROM e WHERE label_number IS NOT NULL GROUP BY 1, 2) l ON n.doc_id = l.doc_id AND n.number = l.label_number
    LEFT JOIN e p ON n.doc_id = p.doc_id AND n.number = p.place"""
SQL = {
    "section_paragraphs": f"SELECT canonical, count(*) AS n_paragraphs, count(DISTINCT section_id) AS n_sections FROM {PARAS} JOIN (SELECT section_id, canonical FROM {SECTIONS}) USING (section_id) GROUP BY 1",
    "claim_references": f"""SELECT para_id, sent_ix, ref_id, row_number() OVER (PARTITION BY para_id, sent_ix ORDER BY f, ref_id) AS rank FROM (SELECT para_id, sent_ix, ref_id, min((start_pos, k)) AS f
        FROM (SELECT para_id, sent_ix, start_pos, unnest(ref_ids) AS ref_id, generate_subscripts(ref_ids, 1) AS k FROM ({_IN})) WHERE ref_id IN (SELECT ref_id FROM reference_entries) GROUP BY 1, 2, 3)""",
    "resolve_markers": _RESOLVED,
    "unresolved_numbers": f"SELECT marker_id, number FROM ({_RESOLVED}) WHERE ref_id IS NULL",
    "uncited_entries": f"SELECT doc_id, ref_id FROM {REFS} r WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(ref_ids) AS ref_id FROM markers) m WHERE m.ref_id = r.ref_id)",
    "marker_in_sentence": f"SELECT marker_id, para_id, sent_ix FROM ({_IN})",
    "marker_overlaps": f"SELECT m.marker_id, count(*) AS n_sentences FROM {MARKERS} m JOIN {SENT} s ON m.para_id = s.para_id AND m.start_pos < s.end_pos AND s.start_pos < m.end_pos AND m.start_pos < m.end_pos AND s.start_pos < s.end_pos GROUP BY 1 HAVING count(*) > 1",
    "marker_as_of": _ASOF,
    "event_as_of_order": "SELECT e.event_id, p.value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "composed_offsets": f"""WITH b AS (SELECT para_id, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para_ix, para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_from FROM {PARAS} WHERE text IS NOT NULL)
        SELECT para_id, count(*) AS n_pieces, min(c_from + greatest(s.start_pos, 0))::BIGINT AS doc_from, sum(least(s.end_pos, n) - s.start_pos)::BIGINT AS n_chars FROM {SENT} s JOIN b USING (para_id) WHERE s.start_pos < n AND 0 < s.end_pos GROUP BY 1""",
    "missing_pairs": "SELECT doc_id, p.level::BIGINT AS level, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'undetermined' ELSE 'given' END AS state FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS level FROM (SELECT DISTINCT doc_id FROM reading_labels)) p LEFT JOIN (SELECT doc_id, level, count(*) AS n FROM reading_labels GROUP BY 1, 2) g USING (doc_id, level)",
    "first_duplicates": f"SELECT ref_id, first_ref FROM (SELECT ref_id, first_value(ref_id) OVER (PARTITION BY doc_id, k ORDER BY pos, ref_id) AS first_ref FROM (SELECT *, {_KEY.format('title')} AS k FROM {REFS}) WHERE k <> '') WHERE ref_id <> first_ref",
    "union_ladder": f"SELECT m.marker_id, coalesce(b.s.step, 3)::BIGINT AS step, b.s.sent_ix AS sent_ix FROM {MARKERS} m LEFT JOIN (SELECT marker_id, min({{'step': step, 'sent_ix': sent_ix}}) AS s FROM (SELECT marker_id, sent_ix, 1 AS step FROM ({_IN}) UNION ALL SELECT marker_id, sent_ix, 2 FROM ({_ASOF}) WHERE sent_ix IS NOT NULL) GROUP BY 1) b USING (marker_id)",
    "aligned_texts": f"""SELECT CASE WHEN n_refs IS NULL THEN 'records' WHEN n_records IS NULL THEN 'refs' ELSE 'both' END AS side, count(*) AS n_keys, sum(coalesce(n_refs, 0))::BIGINT AS n_refs, sum(coalesce(n_records, 0))::BIGINT AS n_records
        FROM (SELECT {_KEY.format('title')} AS k, count(*) AS n_refs FROM {REFS} GROUP BY 1 HAVING k <> '') FULL JOIN (SELECT {_KEY.format('title')} AS k, count(*) AS n_records FROM (SELECT DISTINCT * EXCLUDE (seen_at) FROM candidate_records) GROUP BY 1 HAVING k <> '') USING (k) GROUP BY 1""",
    "dimension_lookup": f"SELECT entry_code, count(*) AS n_sections FROM (SELECT {_LOWER.format(chr(116) + 'rim(title, chr(32))')} AS k FROM {SECTIONS} WHERE title IS NOT NULL) LEFT JOIN (SELECT {_LOWER.format('name')} AS k, entry_code FROM heading_catalog) USING (k) GROUP BY 1",
    "offered_choices": f"SELECT DISTINCT marker_id, ref_id FROM (SELECT doc_id, marker_id, unnest(ref_ids) AS ref_id FROM markers) m WHERE EXISTS (SELECT 1 FROM reference_entries r WHERE r.doc_id = m.doc_id AND r.ref_id = m.ref_id)",
    "elementary_pieces": f"""WITH s AS (SELECT para_id, start_pos AS a, end_pos AS b, 2 AS r FROM {MARKERS} WHERE start_pos < end_pos UNION ALL SELECT para_id, start_pos, end_pos, 1 FROM {SENT} WHERE start_pos < end_pos),
        p AS (SELECT para_id, a, lead(a) OVER (PARTITION BY para_id ORDER BY a) AS b FROM (SELECT DISTINCT para_id, unnest([a, b]) AS a FROM s))
        SELECT p.para_id, p.a::BIGINT AS start, p.b::BIGINT AS "end", max(r)::BIGINT AS top_rank, count(*) AS n_spans FROM p JOIN s ON p.para_id = s.para_id AND s.a <= p.a AND p.b <= s.b WHERE p.b IS NOT NULL GROUP BY ALL""",
    "merged_spans": f"""SELECT para_id, min(a)::BIGINT AS start, max(b)::BIGINT AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY para_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END AS f
        FROM (SELECT para_id, start_pos AS a, end_pos AS b, max(end_pos) OVER (PARTITION BY para_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {SENT} WHERE start_pos < end_pos))) GROUP BY para_id, i""",
}
