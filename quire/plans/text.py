"""Text scalars over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import table

c = F.col


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key of a table whose rows may be loaded again, equal but for loaded_at."""
    return df.drop("loaded_at").dropDuplicates(list(keys))


def refs(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "reference_entries"), "ref_id")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate_records").drop("seen_at").dropDuplicates(["record_id"])


def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.latin_words(c("text")).alias("n_latin"), T.han_characters(c("text")).alias("n_han"), T.count_words(c("text")).alias("n_words"))


def script_language(spark, folder):
    sums = table(spark, folder, "documents").groupBy("source").agg(F.sum(T.latin_words(c("text"))).alias("n_latin"), F.sum(T.han_characters(c("text"))).alias("n_han"))
    return sums.select("source", "n_latin", "n_han", F.when(c("n_han") > c("n_latin"), "zh").otherwise("en").alias("language"))


def entry_language(spark, folder):
    return refs(spark, folder).where("raw IS NOT NULL").select("ref_id", T.entry_language(c("raw")).alias("language"))


def squash_key(spark, folder):
    return refs(spark, folder).select("ref_id", T.squash(c("title")).alias("title_key"))


def unaccented_names(spark, folder):
    return refs(spark, folder).select(F.explode("authors").alias("name")).groupBy(T.unaccent(c("name")).alias("plain_name")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_spellings"))


def page_cleanup(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.clean_page(c("text"))).alias("clean_md5"), F.length(T.clean_page(c("text"))).cast("bigint").alias("n_clean"))


def tag_strip(spark, folder):
    return records(spark, folder).where("title IS NOT NULL").select("record_id", T.strip_tags(c("title")).alias("title"))


def abstract_gate(spark, folder):
    return records(spark, folder).where("answered").groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.good_abstract(c("abstract"))).alias("n_good"))


def token_counts(spark, folder):
    words = table(spark, folder, "documents").select("doc_id", T.tokens(c("text")).alias("t")).where("t IS NOT NULL")
    return words.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def reference_types(spark, folder):
    return refs(spark, folder).where("raw IS NOT NULL").groupBy(T.reference_type(c("raw")).alias("kind")).agg(F.count("*").alias("n"))


def grey_literature(spark, folder):
    return refs(spark, folder).select("ref_id", T.grey_literature(c("raw"), c("venue"), c("doi")).alias("grey"))


def marker_numbers(spark, folder):
    rows = latest(table(spark, folder, "markers"), "marker_id").where(c("raw").startswith("["))
    return rows.select("marker_id", F.posexplode(T.marker_numbers(c("raw"))).alias("pos", "number")).select("marker_id", c("pos").cast("bigint").alias("pos"), "number")


def author_year_items(spark, folder):
    rows = latest(table(spark, folder, "markers"), "marker_id").where("kind = 'author_year'")
    return rows.select("marker_id", F.explode(T.author_year_items(c("raw"))).alias("x")).select("marker_id", "x.names", "x.year", "x.suffix")


def table_fragments(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.table_fragment(c("text")).alias("fragment"), T.table_fragment(c("text"), True).alias("flattened"))


def body_paragraphs(spark, folder):
    """Paragraphs of running text: no caption, cell, heading or blank."""
    rows = latest(table(spark, folder, "paragraphs"), "para_id").where("NOT coalesce(is_caption, false) AND cell IS NULL").where(c("text").rlike(r"\S"))
    heads = table(spark, folder, "sections").where("heading_para_id IS NOT NULL").select(c("heading_para_id").alias("para_id"))
    return rows.join(heads, "para_id", "left_anti")


def sentence_rows(spark, folder):
    """para_id, sent_ix, start_pos, end_pos, text of the sentences of all body paragraphs."""
    rows = body_paragraphs(spark, folder).select("para_id", F.posexplode(T.sentences(c("text"))).alias("sent_ix", "s"))
    return rows.select("para_id", c("sent_ix").cast("bigint").alias("sent_ix"), "s.start_pos", "s.end_pos", "s.text")


def sentences(spark, folder):
    return sentence_rows(spark, folder).select("para_id", "sent_ix", "start_pos", "end_pos")


def short_claims(spark, folder):
    return sentence_rows(spark, folder).select("para_id", "sent_ix", T.too_short(c("text")).alias("short"), T.own_contribution(c("text")).alias("own"))


def heading_kinds(spark, folder):
    """Sections by the kind that their title's words name, beside the kind typed in."""
    rows = latest(table(spark, folder, "sections"), "section_id").where("title IS NOT NULL")
    return rows.select(T.heading_kind(c("title")).alias("kind"), F.lower(F.trim("canonical")).alias("typed")).groupBy("kind", "typed").agg(F.count("*").alias("n"))


def page_fixes(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.fix_page(c("text"))).alias("fixed_md5"), F.length(T.fix_page(c("text"))).cast("bigint").alias("n_fixed"))


def reference_tails(spark, folder):
    """A manuscript's text without its list of references, and whether the end reads like one.

    Each manuscript's lines are its paragraphs and entries in order; those of a manuscript are gathered by digest of its id
    only to find the tail, so long ones cost what they are long.
    """
    lines = body_paragraphs(spark, folder).select("doc_id", F.lit(0).alias("part"), c("para_ix").alias("at"), c("para_id").alias("id"), "text")
    head = refs(spark, folder).where("origin = 'list'").select("doc_id").distinct().select("doc_id", F.lit(1).alias("part"), F.lit(0).alias("at"), F.lit("").alias("id"), F.lit("References").alias("text"))
    listed = refs(spark, folder).where("origin = 'list' AND raw IS NOT NULL").select("doc_id", F.lit(2).alias("part"), c("pos").alias("at"), c("ref_id").alias("id"), c("raw").alias("text"))
    whole = lines.unionByName(head).unionByName(listed).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.select("doc_id", F.length("text").cast("bigint").alias("n_text"), F.length(T.without_tail(c("text"))).cast("bigint").alias("n_body"), T.list_window(F.right("text", F.lit(600))).alias("list_at_end"))


def number_formats(spark, folder):
    """Means of measures by source as a screen shows them."""
    got = table(spark, folder, "documents").groupBy("source").agg(F.avg("n_chars").alias("chars"), F.avg((c("text") == "").cast("int")).alias("empty"), F.min("n_chars").cast("double").alias("low"), F.max("n_chars").cast("double").alias("high"))
    return got.select("source", T.short_number(c("chars")).alias("chars"), T.short_number(c("empty")).alias("empty"), T.short_range(c("low"), c("high")).alias("spread"))


def id_years(spark, folder):
    return records(spark, folder).where("arxiv_id IS NOT NULL").select("record_id", T.id_year(c("arxiv_id")).alias("id_year"))


def title_kinds(spark, folder):
    return records(spark, folder).where("title IS NOT NULL").groupBy(T.title_kind(c("title")).alias("kind")).agg(F.count("*").alias("n"))


def venue_keys(spark, folder):
    return refs(spark, folder).where("venue IS NOT NULL").groupBy(T.clean_venue(c("venue")).alias("venue_key")).agg(F.count("*").alias("n"))


def content_keys(spark, folder):
    return refs(spark, folder).select("ref_id", T.content_key("ref", c("raw"), c("year")).alias("content_key"))


def title_variants(spark, folder):
    rows = records(spark, folder).where("title IS NOT NULL AND main_title IS NOT NULL AND title <> main_title")
    return rows.select("record_id", T.common_words(c("title"), c("main_title")).alias("n_common"), T.title_prefix(c("title"), c("main_title")).alias("prefix"), T.title_head(c("title"), c("main_title")).alias("head"), T.year_only_difference(c("title"), c("main_title")).alias("year_only"))


def raw_edit_classes(spark, folder):
    """A reference's parsed title against the record's title of the same DOI: what kind of edit lies between them."""
    r = refs(spark, folder).where("title IS NOT NULL AND doi IS NOT NULL").select("ref_id", c("title").alias("old"), T.ascii_lower(c("doi")).alias("doi"))
    k = records(spark, folder).where("title IS NOT NULL AND doi IS NOT NULL").select("record_id", c("title").alias("new"), T.ascii_lower(c("doi")).alias("doi"))
    return r.join(k, "doi").groupBy(T.edit_class(c("old"), c("new")).alias("edit")).agg(F.count("*").alias("n"))


def phrase_occurrences(spark, folder):
    """Where a phrase occurs in each document, case-insensitively (ASCII), from 0."""
    low, phrase = T.ascii_lower(c("text")), "measured values"
    parts = F.split(low, F.lit(phrase), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * len(phrase))
    return table(spark, folder, "documents").where(F.contains(low, F.lit(phrase))).select("doc_id", F.explode(ends).alias("p")).select("doc_id", c("p").cast("bigint").alias("start_pos"))


QUERIES = {f.__name__: f for f in (word_counts, script_language, entry_language, squash_key, unaccented_names, page_cleanup, tag_strip, abstract_gate, token_counts, reference_types, grey_literature, marker_numbers, author_year_items, table_fragments, sentences, short_claims, heading_kinds, page_fixes, reference_tails, number_formats, id_years, title_kinds, venue_keys, content_keys, title_variants, raw_edit_classes, phrase_occurrences)}

REFS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM reference_entries)"
RECORDS = "(SELECT DISTINCT * EXCLUDE (seen_at) FROM candidate_records)"
MARKERS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM markers)"
_LOW = "translate(@, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LAT, HAN = f"coalesce(len(regexp_extract_all(text, '{T.LATIN_WORD.replace(chr(39), chr(39) * 2)}')), 0)", f"coalesce(len(regexp_extract_all(text, '[{T.HAN}]')), 0)"
def _low(x: str) -> str:
    return _LOW.replace("@", x)


def _widths(x: str) -> str:
    return f"translate({x}, '{T.WIDE}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')"


def _spaceless(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', '', 'g')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _number(x: str) -> str:
    at = lambda n: f"regexp_replace(printf('%.{n}f', round({x}, {n})), '(\\.[0-9]*?)0+$', '\\1')"
    return f"coalesce(regexp_replace(CASE WHEN abs({x}) >= 100 THEN printf('%.0f', round({x}, 0)) WHEN abs({x}) >= 1 THEN {at(1)} ELSE {at(3)} END, '\\.$', ''), '–')"


def _marked(x: str) -> str:
    for pattern, put in T.SPLITTING:
        put = put.replace("{1}", "\\1").replace("{2}", "\\2").replace("{3}", "\\3").replace(T.ASIDE, "' || chr(2) || '").replace(T.HERE, "' || chr(3) || '")
        x = f"regexp_replace({x}, '{_q(pattern).replace(T.ASIDE, chr(92) + 'x02').replace(T.HERE, chr(92) + 'x03')}', '{put}', 'g')"
    return x


BODY = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM paragraphs WHERE NOT coalesce(is_caption, false) AND cell IS NULL AND regexp_matches(text, '\\S') AND para_id NOT IN (SELECT heading_para_id FROM sections WHERE heading_para_id IS NOT NULL))"
SENTENCES = f"""(SELECT para_id, row_number() OVER (PARTITION BY para_id ORDER BY i) - 1 AS sent_ix, (a + length(piece) - length(b))::BIGINT AS start_pos, (a + length(piece) - length(b) + length(core))::BIGINT AS end_pos, translate(core, chr(2), '.') AS text
    FROM (SELECT *, regexp_replace(b, '\\s+$', '') AS core FROM (SELECT para_id, i, piece, regexp_replace(piece, '^\\s+', '') AS b, sum(length(piece)) OVER (PARTITION BY para_id ORDER BY i) - length(piece) AS a
    FROM (SELECT para_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT para_id, string_split({_marked('text')}, chr(3)) AS p FROM {BODY})))) WHERE core <> '')"""
_KINDS = " ".join(f"WHEN regexp_matches(lower(title), '(?:^|[^\\p{{L}}])(?:{_q('|'.join(w for w in words if w[0] < '一'))})|{'|'.join(w for w in words if w[0] >= '一')}') THEN '{kind}'" for kind, words in T.HEADING_WORDS.items())
TOKENS = f"""flatten(list_transform(regexp_extract_all({_low('text')}, '[a-z0-9]+|[{T.HAN}]+'),
    lambda x: CASE WHEN x >= '一' AND length(x) > 1 THEN list_transform(range(1, length(x)), lambda i: substr(x, i::BIGINT, 2)) ELSE [x] END))"""

SQL = {
    "word_counts": f"SELECT doc_id, {LAT} AS n_latin, {HAN} AS n_han, {LAT} + {HAN} AS n_words FROM documents",
    "script_language": f"SELECT source, n_latin, n_han, CASE WHEN n_han > n_latin THEN 'zh' ELSE 'en' END AS language FROM (SELECT source, sum({LAT})::BIGINT AS n_latin, sum({HAN})::BIGINT AS n_han FROM documents GROUP BY 1)",
    "entry_language": f"SELECT ref_id, CASE WHEN len(regexp_extract_all(raw, '[{T.HAN}]')) >= 2 THEN 'zh' WHEN length(raw) > 0 AND len(regexp_extract_all(raw, '[\\x00-\\x7F]')) / length(raw) > 0.9 THEN 'en' ELSE 'other' END AS language FROM {REFS} WHERE raw IS NOT NULL",
    "squash_key": f"SELECT ref_id, regexp_replace({_low('coalesce(title, chr(32))')}, '[^0-9a-z{T.HAN}]+', '', 'g') AS title_key FROM {REFS}",
    "unaccented_names": f"SELECT regexp_replace(translate(name, '{T.ACCENTED}', '{T.PLAIN}'), '[\\x{{300}}-\\x{{36F}}]', '', 'g') AS plain_name, count(*) AS n, count(DISTINCT name) AS n_spellings FROM (SELECT unnest(authors) AS name FROM {REFS}) WHERE name IS NOT NULL GROUP BY 1",
    "page_cleanup": f"""SELECT doc_id, md5(t) AS clean_md5, length(t)::BIGINT AS n_clean FROM (SELECT doc_id, trim(regexp_replace({_widths("regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([" + T.HAN + "])[ \\t]*\\n\\s*', '\\1', 'g'), '[ \\t]*\\n\\s*', ' ', 'g')")}, '[ \\t]{{2,}}', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)""",
    "tag_strip": f"SELECT record_id, regexp_replace(title, '<[^>]+>', '', 'g') AS title FROM {RECORDS} WHERE title IS NOT NULL",
    "abstract_gate": f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE length(a) >= 150 AND NOT regexp_matches(h, '{_q(T.IMPRINT)}') AND len(regexp_extract_all(h, '\\b[A-Z][a-z]+')) <= 0.6 * len(regexp_extract_all(h, '[A-Za-z]{{2,}}'))) AS n_good
        FROM (SELECT source, trim(abstract, ' ') AS a, substr(trim(abstract, ' '), 1, 200) AS h FROM {RECORDS} WHERE answered) GROUP BY 1""",
    "token_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)",
    "reference_types": f"""SELECT CASE WHEN regexp_matches(raw, '(?i)arxiv|preprint') THEN 'preprint' WHEN code = 'J' THEN 'journal' WHEN code IN ('C', 'A') THEN 'conference' WHEN code IN ('M', 'G') THEN 'book' WHEN code = 'D' THEN 'thesis' WHEN code IN ('EB', 'DB', 'CP') THEN 'web' WHEN code <> '' THEN 'other'
        WHEN regexp_matches(raw, '{_q(T.CONFERENCE)}') THEN 'conference' WHEN (regexp_matches(raw, '{_q(T.JOURNAL)}') OR regexp_matches(raw, '{_q(T.ISSUE)}')) THEN 'journal' WHEN regexp_matches(raw, 'https?://') THEN 'web' ELSE 'other' END AS kind, count(*) AS n
        FROM (SELECT raw, upper(regexp_extract(raw, '\\[ *([JCAMDRPSNZG]|EB|DB|CP) *(?:/ *OL)? *\\]', 1)) AS code FROM {REFS} WHERE raw IS NOT NULL) GROUP BY 1""",
    "grey_literature": f"SELECT ref_id, coalesce(regexp_matches(concat_ws(' ', raw, venue), '{_q(T.GREY)}') OR regexp_matches(concat_ws(' ', raw, venue), '(?i){_q(T.SEEN)}|{_q(T.DATED)}'), false) OR (trim(coalesce(venue, ''), ' ') = '' AND doi IS NULL) AS grey FROM {REFS}",
    "marker_numbers": f"""SELECT marker_id, (row_number() OVER (PARTITION BY marker_id ORDER BY i, number) - 1)::BIGINT AS pos, number FROM (SELECT marker_id, i, unnest(range(least(lo, hi), greatest(lo, hi) + 1)) AS number FROM (
        SELECT marker_id, i, regexp_extract(x, '^[0-9]+')::BIGINT AS lo, regexp_extract(x, '[0-9]+$')::BIGINT AS hi FROM (SELECT marker_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM (SELECT marker_id, regexp_extract_all(raw, '[0-9]+ *[-–] *[0-9]+|[0-9]+') AS m FROM {MARKERS} WHERE starts_with(raw, '[')))))""",
    "author_year_items": f"""SELECT marker_id, names, year, suffix FROM (SELECT marker_id, trim(regexp_replace(regexp_extract(x, '^(.*?)[,， (（]*((?:19|20)[0-9][0-9])([a-z]?)', 1), '[,， ]+$', ''), ' ') AS names, try_cast(regexp_extract(x, '((?:19|20)[0-9][0-9])([a-z]?)', 1) AS BIGINT) AS year, regexp_extract(x, '((?:19|20)[0-9][0-9])([a-z]?)', 2) AS suffix
        FROM (SELECT marker_id, unnest(regexp_split_to_array(regexp_replace(raw, '^[ \\t]*[\\(（\\[]|[\\)）\\]][ \\t]*$', '', 'g'), '[;；]')) AS x FROM {MARKERS} WHERE kind = 'author_year')) WHERE names <> '' AND year IS NOT NULL""",
    "table_fragments": f"""SELECT doc_id, n >= 40 AND d >= 12 AND k >= 3 AND d >= 0.08 * n AND k >= 0.015 * n AS fragment, n >= 500 AND k >= 10 AND d >= 0.08 * n AND k >= 0.015 * n AND NOT regexp_matches(text, '[。．！？!?]|\\.(?:\\s|$)') AS flattened
        FROM (SELECT doc_id, text, length(s) AS n, len(regexp_extract_all(s, '[0-9]')) AS d, len(regexp_extract_all(s, '[:：∶]')) AS k FROM (SELECT doc_id, text, {_spaceless('text')} AS s FROM documents WHERE text IS NOT NULL))""",
    "sentences": f"SELECT para_id, sent_ix, start_pos, end_pos FROM {SENTENCES}",
    "short_claims": f"""SELECT para_id, sent_ix, CASE WHEN han > 0 AND han >= words THEN han < 8 ELSE words < 4 END AS short, regexp_matches(text, '{_q(T.OWN)}') AS own
        FROM (SELECT para_id, sent_ix, text, len(regexp_extract_all(text, '[{T.HAN}]')) AS han, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words FROM {SENTENCES})""",
    "heading_kinds": f"SELECT CASE WHEN trim(title, ' ') = '' THEN NULL {_KINDS} ELSE 'other' END AS kind, lower(trim(canonical, ' ')) AS typed, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM sections) WHERE title IS NOT NULL GROUP BY 1, 2",
    "page_fixes": f"SELECT doc_id, md5(t) AS fixed_md5, length(t)::BIGINT AS n_fixed FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{ad}}]', '', 'g'), '([a-z])-[ \\t]*\\n[ \\t]*([a-z])', '\\1\\2', 'g'), ' +([,.;:!?])', '\\1', 'g') AS t FROM documents WHERE text IS NOT NULL)",
    "reference_tails": f"""WITH l AS (SELECT doc_id, 0 AS part, para_ix AS place, para_id AS id, text FROM {BODY} UNION ALL SELECT DISTINCT doc_id, 1, 0, '', 'References' FROM reference_entries WHERE origin = 'list' UNION ALL SELECT doc_id, 2, pos, ref_id, raw FROM {REFS} WHERE origin = 'list' AND raw IS NOT NULL),
        w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY part, place, id) AS text FROM l GROUP BY 1), p AS (SELECT doc_id, text, regexp_split_to_array(text, '{_q(T.TAIL_HEADS)}') AS p FROM w), k AS (SELECT doc_id, text, p, regexp_replace(substr(text, 1, length(text) - length(p[-1])), '{_q(T.TAIL_HEADS)}$', '') AS kept FROM p)
        SELECT doc_id, length(text)::BIGINT AS n_text, CASE WHEN len(p) > 1 AND length(kept) > 0.3 * length(text) THEN length(kept) ELSE length(text) END::BIGINT AS n_body, y >= 2 AND s >= 3 AND y * 400 >= least(length(text), 600) AS list_at_end
        FROM (SELECT *, len(regexp_extract_all(right(text, 600), '[(（ ,.](?:19|20)[0-9]{{2}}[a-z]?[)）.,; ]')) AS y, len(regexp_extract_all(right(text, 600), '\\b[A-Z][.](?:[ -]?[A-Z][.])*,|\\bpp?[.] *[0-9]|[0-9]+ *[(][0-9]+[)] *[,:]|doi|10[.][0-9]{{4}}/|\\[[JMCDPR]\\]|\\bet al\\b')) AS s FROM k)""",
    "number_formats": f"SELECT source, {_number('chars')} AS chars, {_number('empty')} AS empty, CASE WHEN {_number('low')} = {_number('high')} THEN {_number('low')} ELSE {_number('low')} || '–' || {_number('high')} END AS spread FROM (SELECT source, avg(n_chars) AS chars, avg((text = '')::INT) AS empty, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high FROM documents GROUP BY 1)",
    "id_years": f"SELECT record_id, CASE WHEN yy <> '' THEN CASE WHEN yy::BIGINT >= 91 THEN 1900 + yy::BIGINT ELSE 2000 + yy::BIGINT END END AS id_year FROM (SELECT record_id, regexp_extract(arxiv_id, '([0-9]{{2}})[0-9]{{2}}[.]', 1) AS yy FROM {RECORDS} WHERE arxiv_id IS NOT NULL)",
    "title_kinds": f"SELECT CASE WHEN regexp_matches(title, '(?i)^ *(?:correction|corrigendum|erratum)|^ *(?:更正|勘误)') THEN 'correction' WHEN regexp_matches(title, '(?i)^ *(?:reply|response|comment)\\b|^ *(?:答复|评论)') THEN 'reply' WHEN regexp_matches(title, '(?i)\\b(?:survey|review|overview)\\b|综述') THEN 'survey' WHEN regexp_matches(title, '(?i)\\bcase stud(?:y|ies)\\b|案例') THEN 'case' ELSE 'research' END AS kind, count(*) AS n FROM {RECORDS} WHERE title IS NOT NULL GROUP BY 1",
    "venue_keys": f"SELECT trim(regexp_replace(regexp_replace(regexp_replace({_low('venue')}, '^ *(?:in:? +)?(?:proceedings|proc\\.?)(?: of)?(?: the)? +', ''), '[.,&]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS venue_key, count(*) AS n FROM {REFS} WHERE venue IS NOT NULL GROUP BY 1",
    "content_keys": f"SELECT ref_id, 'ref|' || sha256(concat_ws(chr(31), coalesce(raw, chr(0)), coalesce(year::VARCHAR, chr(0)))) AS content_key FROM {REFS}",
    "title_variants": f"""SELECT record_id, k AS n_common, k >= 4 AND k = least(len(x), len(y)) AND len(x) <> len(y) AS prefix, k >= 6 AND k >= 0.6 * least(len(x), len(y)) AS head,
        {_low('title')} <> {_low('main_title')} AND regexp_replace({_low('title')}, '(?:19|20)[0-9]{{2}}', '#', 'g') = regexp_replace({_low('main_title')}, '(?:19|20)[0-9]{{2}}', '#', 'g') AS year_only
        FROM (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: coalesce(x[i] = y[i], false)), false) - 1, greatest(len(x), len(y)))::BIGINT AS k
              FROM (SELECT *, regexp_split_to_array(trim({_low('title')}, ' '), '\\s+') AS x, regexp_split_to_array(trim({_low('main_title')}, ' '), '\\s+') AS y FROM {RECORDS} WHERE title IS NOT NULL AND main_title IS NOT NULL AND title <> main_title))""",
    "raw_edit_classes": f"""SELECT CASE WHEN o = w THEN 'same' WHEN {_spaceless('o')} = {_spaceless('w')} THEN 'space' WHEN {_widths('o')} = {_widths('w')} THEN 'width'
        WHEN regexp_replace({_spaceless('o')}, '[-‐‑–]', '', 'g') = regexp_replace({_spaceless('w')}, '[-‐‑–]', '', 'g') THEN 'hyphen' WHEN starts_with(o, w) OR starts_with(w, o) THEN 'truncate' WHEN regexp_matches(o, '{_q(T.FORMULA)}') OR regexp_matches(w, '{_q(T.FORMULA)}') THEN 'formula' ELSE 'other' END AS edit, count(*) AS n
        FROM (SELECT title AS o, {_low('doi')} AS d FROM {REFS} WHERE title IS NOT NULL AND doi IS NOT NULL) JOIN (SELECT title AS w, {_low('doi')} AS d FROM {RECORDS} WHERE title IS NOT NULL AND doi IS NOT NULL) USING (d) GROUP BY 1""",
    "phrase_occurrences": f"""SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length('measured values'))::BIGINT AS start_pos
        FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split({_low('text')}, 'measured values') AS p FROM documents WHERE contains({_low('text')}, 'measured values')))""",
}
