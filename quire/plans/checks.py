"""Entity checks and rules that yield findings, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.fuzzy import plain_udf, ratio_udf, surname_udf
from quire.operators import entities as E
from quire.operators import intervals as I
from quire.operators.alike import alike, arranged_udf
from quire.operators import sequences as Q
from quire.operators.quantities import conflicts
from quire.operators.venues import same_venues
from quire.plans.joins import PARAS, SECTIONS, SENT, _RESOLVED, claim_references, marker_spans, markers, paragraphs, resolve_markers, sections
from quire.plans.retrieval import first_appearance, list_order, marker_clusters
from quire.plans.retrieval import SQL as RETRIEVAL_SQL
from quire.plans.stats import SQL as STATS_SQL
from quire.plans.stats import _TYPED, section_bands
from quire.plans.text import MARKERS, REFS, _q, records, refs, sentence_rows
from quire.session import cut, table

c = F.col


def entry_candidates(spark, folder):
    return E.candidates(refs(spark, folder), records(spark, folder).where("answered AND title IS NOT NULL")).withColumn("issues", F.concat_ws(",", "issues"))


def reference_status(spark, folder):
    """verified, mismatch, not_found or unverifiable for each entry, by the records of all sources."""
    r = records(spark, folder)
    answered = r.where("answered").select("source").distinct().count()
    e = refs(spark, folder)
    return E.statuses(e, E.candidates(e, r.where("answered AND title IS NOT NULL")), T.grey_literature(c("raw"), c("venue"), c("doi")), answered)


def entry_assignment(spark, folder):
    """Each entry to one record and each record to one entry of a manuscript, best scores first."""
    got = E.candidates(refs(spark, folder), records(spark, folder).where("answered AND title IS NOT NULL")).join(refs(spark, folder).select("ref_id", "doc_id"), "ref_id")
    keyed = got.select("ref_id", F.concat_ws("/", "doc_id", c("record_id").cast("string")).alias("place"), (c("score") - F.size("issues")).alias("score"))
    return E.assign(keyed, "ref_id", "place", "score").select("ref_id", F.element_at(F.split("place", "/"), -1).cast("bigint").alias("record_id"), "score")


def sibling_attributes(spark, folder):
    """Entries' missing DOI and venue from their matched records, those of fewest issues first."""
    got = E.candidates(refs(spark, folder), records(spark, folder).where("answered AND title IS NOT NULL")).join(records(spark, folder).select("record_id", c("doi").alias("rd"), c("venue").alias("rv")), "record_id")
    order = F.struct(F.size("issues"), -c("score"), "record_id")
    best = got.groupBy("ref_id").agg(F.min(F.when(c("rd").isNotNull(), F.struct(order, c("rd")))).alias("d"), F.min(F.when(c("rv").isNotNull(), F.struct(order, c("rv")))).alias("v"))
    return refs(spark, folder).join(best, "ref_id").select("ref_id", F.coalesce("doi", c("d.rd")).alias("doi"), F.coalesce("venue", c("v.rv")).alias("venue"))


def author_year_links(spark, folder):
    m = markers(spark, folder).where("kind = 'author_year'").select("doc_id", "marker_id", F.explode(T.author_year_items(c("raw"))).alias("x")).select("doc_id", "marker_id", "x.*")
    return E.author_year_links(m, refs(spark, folder)).drop("suffix")


def near_duplicate_entries(spark, folder):
    """Later entries of a manuscript whose title is 95 like and whose whole line is 75 like an earlier one's; the first is named.

    All titles of a manuscript are compared.
    """
    e = cut(refs(spark, folder).where("raw IS NOT NULL").select("doc_id", "ref_id", "pos", arranged_udf("title").alias("t"), plain_udf("raw").alias("w")).where("t <> ''"))
    near = alike(e.select("doc_id", c("t").alias("a")), e.select("doc_id", c("t").alias("b")), 95.0, by="doc_id").select("doc_id", c("a").alias("t_1"), c("b").alias("t_2"))
    a, b = (e.select("doc_id", *(c(x).alias(f"{x}_{i}") for x in ("ref_id", "pos", "t", "w"))) for i in (1, 2))
    p = near.join(a, ["doc_id", "t_1"]).join(b, ["doc_id", "t_2"]).where("pos_1 < pos_2 OR pos_1 = pos_2 AND ref_id_1 < ref_id_2")
    like = p.where(ratio_udf("w_1", "w_2") >= 75)
    return like.groupBy(c("ref_id_2").alias("ref_id")).agg(F.min_by("ref_id_1", F.struct("pos_1", "ref_id_1")).alias("first_ref"))


def venue_matches(spark, folder):
    """Venues of entries to venues of records: by equal key, else the likest of all from 92 on."""
    a = refs(spark, folder).where("venue IS NOT NULL").select("venue").distinct()
    b = records(spark, folder).where("venue IS NOT NULL").select(c("venue").alias("known")).distinct()
    best = same_venues(a, b).groupBy("venue").agg(F.max(F.struct("score", "known", "how")).alias("b"))
    return a.join(best, "venue", "left").select("venue", "b.known", "b.how", "b.score")


def structured_matches(spark, folder):
    """The bibliography line that each BibTeX entry of a manuscript means, by its fields; no SQL: likeness."""
    b = table(spark, folder, "bib_entries").drop("loaded_at").dropDuplicates(["entry_id"])
    family = F.split(F.split(c("fields")["author"], r"\s+and\s+")[0], ",")[0]
    items = b.select("doc_id", c("entry_id").alias("item_id"), c("fields")["title"].alias("title"), c("fields")["year"].try_cast("int").alias("year"), F.element_at(F.split(F.trim(family), r"\s+"), -1).alias("family"))
    return E.structured_matches(items, refs(spark, folder))


def attribution_mismatches(spark, folder):
    """Author-year markers with one reference whose first author is another than the marker names, in the same script."""
    m = markers(spark, folder).where("kind = 'author_year' AND size(ref_ids) = 1").select("marker_id", T.author_year_items(c("raw"))[0]["names"].alias("names"), c("ref_ids")[0].alias("ref_id")).where("names IS NOT NULL")
    e = refs(spark, folder).where("authors IS NOT NULL").select("ref_id", plain_udf(surname_udf(F.get("authors", F.lit(0)))).alias("have"))
    want = plain_udf(F.regexp_replace(F.split("names", r"\s+et\s+al|\s+and\s+|\s*&\s*|等|和|,|，")[0], r"[\s.]+$", ""))
    p = m.join(e, "ref_id").withColumn("want", want).where("want <> '' AND have <> ''")
    script = lambda x: x.rlike("[一-鿿]")
    differs = F.when(script(c("want")), ~c("have").startswith(F.left("want", F.lit(1)))).otherwise(ratio_udf("want", "have") < 70)
    return p.where((script(c("want")) == script(c("have"))) & differs).select("marker_id", "ref_id", "want", "have")


def number_conflicts(spark, folder):
    """Sentences that cite and the abstracts of what they cite, where both give a number for what reads like the same
    quantity, but not the same number. A cited entry's record is one of the same title key."""
    r = records(spark, folder).where("abstract IS NOT NULL").select("record_id", "abstract", F.explode(F.array_distinct(F.array(T.squash(c("title")), T.squash(F.coalesce("main_title", "title"))))).alias("k")).where("k <> ''")
    e = refs(spark, folder).select("ref_id", T.squash(c("title")).alias("k")).where("k <> ''").join(r, "k").select("ref_id", "record_id", "abstract").distinct()
    s = sentence_rows(spark, folder).select("para_id", "sent_ix", "text")
    cited = claim_references(spark, folder).join(s, ["para_id", "sent_ix"]).join(e, "ref_id")
    pair = F.struct("para_id", "sent_ix", "record_id")
    return conflicts(cited.select(pair.alias("pair"), c("text").alias("claim"), c("abstract").alias("source")).distinct()).select("pair.*", "claimed", "given")


def uncited_statements(spark, folder):
    """Sentences that speak of earlier work, not of the author's, and hold no marker, in introductions and related work."""
    s = sentence_rows(spark, folder).select("para_id", "sent_ix", "text", c("start_pos").alias("begin"), c("end_pos").alias("stop"))
    place = paragraphs(spark, folder).where("NOT is_caption AND cell IS NULL").select("para_id", "section_id").join(sections(spark, folder).where(F.lower(F.trim("canonical")).isin("intro", "related", "discussion")).select("section_id"), "section_id")
    cue = c("text").rlike(r"(?i)\b(?:earlier|previous|prior) (?:work|studies|research)\b|已有的研究|先行研究|la recherche antérieure|la investigación previa")
    told = s.join(place.select("para_id"), "para_id", "left_semi").where(cue & ~T.own_contribution(c("text")))
    hit = I.contained(marker_spans(spark, folder), told, "para_id").select("para_id", "sent_ix").distinct()
    return told.join(hit, ["para_id", "sent_ix"], "left_anti").select("para_id", c("sent_ix").cast("bigint").alias("sent_ix"))


def rule_rows(spark, folder):
    """rule, doc_id, item_id of everything the rules that SQL expresses find."""
    e, m = refs(spark, folder), markers(spark, folder)
    cited = m.select(F.explode("ref_ids").alias("ref_id")).distinct()
    lit = F.lit
    rows = [
        e.join(cited, "ref_id", "left_anti").select(lit("uncited_entry").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
        e.where("year IS NULL").select(lit("missing_year").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
        resolve_markers(spark, folder).where("ref_id IS NULL").select("marker_id").distinct().join(m.select("marker_id", "doc_id"), "marker_id").select(lit("unresolved_marker").alias("rule"), "doc_id", c("marker_id").alias("item_id")),
        m.where("kind IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("kind").alias("n")).where("n > 1").select(lit("mixed_styles").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
        e.where((T.reference_type(c("raw")) == "journal") & ~c("raw").rlike(r"[0-9]+ *[-–‑] *[0-9]+")).select(lit("missing_pages").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
        e.where(c("raw").rlike(r"\[[A-Z]\]")).select("doc_id").distinct().join(e.where(~c("raw").rlike(r"\[[A-Z]\]")), "doc_id", "left_semi").select(lit("mixed_type_codes").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
        marker_clusters(spark, folder).where("n_refs >= 5").join(paragraphs(spark, folder).select("para_id", "doc_id"), "para_id").select(lit("stacked_citations").alias("rule"), "doc_id", F.concat_ws("#", "para_id", c("session").cast("string")).alias("item_id")),
        section_bands(spark, folder).where("flag IN ('below', 'above') AND part <> 'other'").select(F.concat_ws("_", lit("share"), "flag").alias("rule"), "doc_id", c("part").alias("item_id")),
        uncited_statements(spark, folder).join(paragraphs(spark, folder).select("para_id", "doc_id"), "para_id").select(lit("uncited_statement").alias("rule"), "doc_id", F.concat_ws("#", "para_id", c("sent_ix").cast("string")).alias("item_id")),
        e.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg((c("year") >= 2015).cast("int")).alias("recent")).where("n < 8 OR recent < 0.3").select(lit("venue_rules").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
        paragraphs(spark, folder).select("doc_id").distinct().join(m.select("doc_id"), "doc_id", "left_anti").join(e.select("doc_id"), "doc_id", "left_anti").select(lit("no_citations").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def findings(spark, folder):
    """The rules that SQL expresses as one table, counted per rule and manuscript; all_findings has the others as well."""
    return rule_rows(spark, folder).groupBy("rule", "doc_id").agg(F.countDistinct("item_id").alias("n"))


# How grave a rule's finding is; others are low.
SEVERITY = {"unresolved_marker": "high", "no_citations": "high", "uncited_entry": "medium", "uncited_statement": "medium", "stacked_citations": "medium", "mixed_styles": "medium"}


def finding_rows(spark, folder):
    """Each finding as a row: its rule, how grave it is, where it stands, and a number in the order of its manuscript.

    Findings about a whole manuscript or its list stand nowhere and come first. The place of a marker is its own, that of a
    sentence or a cluster its paragraph. Numbers come from counts per block of paragraphs and ranks inside a block, so a
    manuscript that holds a tenth of all rows is shared by many tasks.
    """
    found = rule_rows(spark, folder).distinct()
    m = markers(spark, folder).select(c("marker_id").alias("item_id"), c("para_id").alias("marked"), c("start_pos").alias("start_pos"))
    place = found.join(m, "item_id", "left").withColumn("para_id", F.coalesce("marked", F.when(c("item_id").contains("#"), F.substring_index("item_id", "#", 1)))).drop("marked")
    p = paragraphs(spark, folder).select("para_id", "para_ix")
    placed = place.join(p, "para_id", "left").withColumn("at", F.coalesce(c("para_ix").cast("bigint"), F.lit(-1).cast("bigint")))
    severity = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[c("rule")], F.lit("low"))
    ranked = Q.numbered(placed, "doc_id", "at", ["at", F.coalesce("start_pos", F.lit(-1)), "rule", "item_id"])
    return ranked.select("doc_id", c("number").cast("bigint").alias("number"), "rule", severity.alias("severity"), "item_id", "para_id", c("start_pos").cast("bigint").alias("start_pos"))


def all_findings(spark, folder):
    """findings with duplicate entries, lists out of order, bare medium tags and missing volumes; no SQL: likeness of titles.

    A list that a reference manager keeps must follow the first citations of its entries; one that is cited by author and
    year alone must be sorted by them.
    """
    e, lit = cut(refs(spark, folder)), F.lit
    kinds = markers(spark, folder).where("kind IS NOT NULL").groupBy("doc_id").agg(F.bool_or(c("kind") == "zotero").alias("managed"), F.bool_and(c("kind") == "author_year").alias("dated"))
    cited = e.where("origin = 'list'").select("doc_id", "ref_id", "pos").join(first_appearance(spark, folder).select("doc_id", "ref_id", c("rank").alias("seen")), ["doc_id", "ref_id"])
    moved = cited.withColumn("before", F.lag("seen").over(Window.partitionBy("doc_id").orderBy("pos", "ref_id"))).where("seen < before").select("doc_id").distinct()
    tag = r"\[(?:[JMDPCRNSZOAG]|EB|DB|CP|DS)(?:/[A-Z]{1,2})?\]"
    rows = [
        cut(near_duplicate_entries(spark, folder)).join(e.select("ref_id", "doc_id"), "ref_id").select(lit("duplicate_entry").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
        moved.join(kinds.where("managed"), "doc_id").select(lit("managed_list_order").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
        list_order(spark, folder).where("n_breaks > 0").join(kinds.where("dated"), "doc_id").select(lit("unsorted_list").alias("rule"), "doc_id", c("doc_id").alias("item_id")),
        e.where(c("raw").rlike(r"\[\s*OL\s*\]") & ~c("raw").rlike(tag)).select(lit("bare_medium_tag").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
        e.where((c("origin") == "list") & c("raw").rlike(r"[\[［]\s*J\s*[\]］]") & ~c("raw").rlike(r"(?:19|20)[0-9]{2}\s*[,，]\s*(?:[0-9]+|[(（]\s*[0-9]+)|[0-9]+\s*[(（]\s*[0-9S]")).select(lit("missing_volume").alias("rule"), "doc_id", c("ref_id").alias("item_id")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return cut(findings(spark, folder)).unionByName(out.groupBy("rule", "doc_id").agg(F.countDistinct("item_id").alias("n")))


def folded(g):
    return g.groupBy("rule").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_items"), F.count_if(c("n") >= 2).alias("n_folded"))


def findings_grouped(spark, folder):
    """Rules that several items of a manuscript break, folded into one line; of those that SQL expresses."""
    return folded(findings(spark, folder))


def all_findings_grouped(spark, folder):
    """findings_grouped over all rules; no SQL, as all_findings."""
    return folded(all_findings(spark, folder))


QUERIES = {f.__name__: f for f in (entry_candidates, reference_status, entry_assignment, sibling_attributes, author_year_links, near_duplicate_entries, venue_matches, structured_matches, attribution_mismatches, number_conflicts, uncited_statements, findings, findings_grouped, finding_rows, all_findings, all_findings_grouped)}

_CUES = "(?i)\\b(?:earlier|previous|prior) (?:work|studies|research)\\b|已有的研究|先行研究|la recherche antérieure|la investigación previa"
_OWN = _q(T.OWN)
_STATEMENTS = f"""SELECT s.para_id, s.sent_ix::BIGINT AS sent_ix FROM {SENT} s WHERE s.para_id IN (SELECT p.para_id FROM {PARAS} p JOIN {SECTIONS} x ON p.section_id = x.section_id WHERE NOT p.is_caption AND p.cell IS NULL AND lower(trim(x.canonical, ' ')) IN ('intro', 'related', 'discussion'))
    AND regexp_matches(s.text, '{_CUES}') AND NOT regexp_matches(s.text, '{_OWN}') AND NOT EXISTS (SELECT 1 FROM {MARKERS} m WHERE m.para_id = s.para_id AND s.start_pos <= m.start_pos AND m.end_pos <= s.end_pos)"""
_RULES = f"""
    SELECT 'uncited_entry' AS rule, doc_id, ref_id AS item FROM {REFS} WHERE ref_id NOT IN (SELECT unnest(ref_ids) FROM markers)
    UNION ALL SELECT 'missing_year', doc_id, ref_id FROM {REFS} WHERE year IS NULL
    UNION ALL SELECT 'unresolved_marker', m.doc_id, m.marker_id FROM ({_RESOLVED}) r JOIN {MARKERS} m ON m.marker_id = r.marker_id WHERE r.ref_id IS NULL
    UNION ALL SELECT 'mixed_styles', doc_id, doc_id FROM {MARKERS} WHERE kind IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT kind) > 1
    UNION ALL SELECT 'missing_pages', doc_id, ref_id FROM {_TYPED} WHERE kind = 'journal' AND NOT regexp_matches(raw, '[0-9]+ *[-–‑] *[0-9]+')
    UNION ALL SELECT 'mixed_type_codes', doc_id, doc_id FROM {REFS} WHERE raw IS NOT NULL GROUP BY doc_id HAVING bool_or(regexp_matches(raw, '\\[[A-Z]\\]')) AND bool_or(NOT regexp_matches(raw, '\\[[A-Z]\\]'))
    UNION ALL SELECT 'stacked_citations', p.doc_id, k.para_id || '#' || k.session FROM ({RETRIEVAL_SQL['marker_clusters']}) k JOIN {PARAS} p ON p.para_id = k.para_id WHERE k.n_refs >= 5
    UNION ALL SELECT 'share_' || flag, doc_id, part FROM ({STATS_SQL['section_bands']}) WHERE flag IN ('below', 'above') AND part <> 'other'
    UNION ALL SELECT 'uncited_statement', p.doc_id, u.para_id || '#' || u.sent_ix FROM ({_STATEMENTS}) u JOIN {PARAS} p ON p.para_id = u.para_id
    UNION ALL SELECT 'venue_rules', doc_id, doc_id FROM {REFS} GROUP BY doc_id HAVING count(*) < 8 OR avg((year >= 2015)::INT) < 0.3
    UNION ALL SELECT DISTINCT 'no_citations', doc_id, doc_id FROM paragraphs WHERE doc_id NOT IN (SELECT doc_id FROM markers) AND doc_id NOT IN (SELECT doc_id FROM reference_entries)"""
_FINDINGS = f"SELECT rule, doc_id, count(DISTINCT item) AS n FROM ({_RULES}) GROUP BY 1, 2"
SQL = {
    "uncited_statements": _STATEMENTS,
    "findings": _FINDINGS,
    "findings_grouped": f"SELECT rule, count(*) AS n_docs, sum(n)::BIGINT AS n_items, count(*) FILTER (WHERE n >= 2) AS n_folded FROM ({_FINDINGS}) GROUP BY 1",
    "finding_rows": f"""WITH r AS (SELECT DISTINCT rule, doc_id, item AS item_id FROM ({_RULES})), p AS (SELECT r.*, coalesce(m.para_id, CASE WHEN contains(item_id, '#') THEN split_part(item_id, '#', 1) END) AS para_id, m.start_pos FROM r LEFT JOIN {MARKERS} m ON m.marker_id = r.item_id)
        SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY coalesce(g.para_ix, -1), coalesce(p.start_pos, -1), rule, item_id) AS number, rule, CASE {' '.join(f"WHEN rule = '{k}' THEN '{v}'" for k, v in SEVERITY.items())} ELSE 'low' END AS severity, item_id, p.para_id, p.start_pos::BIGINT AS start_pos FROM p LEFT JOIN {PARAS} g ON g.para_id = p.para_id""",
}
