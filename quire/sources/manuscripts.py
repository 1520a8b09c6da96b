"""Manuscript files of any kind as the tables that the operators read: sections, paragraphs, markers, entries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.references import parse_reference_udf
from quire.operators.entities import author_year_links, numbered_links
from quire.sources.docx import notes_of, read_docx
from quire.sources.latex import read_latex

c = F.col
MARK = "struct<start:int,end:int,raw:string,kind:string,target:string>"
# How numbers, and names with years, are cited in running text.
NUMERIC = re.compile(r"[\[［【]\s*\d{1,4}(?:\s*[-–—~～,，、;；]\s*\d{1,4})*\s*[\]］】]")
DATED = re.compile(r"[(（][^()（）]{0,300}?[^\W\d_][^()（）]{0,300}?(?:19|20)\d{2}[a-z]?[^()（）]{0,60}[)）]|(?<![^\W\d_])(?:[A-ZÀ-Þ][\w'’-]+(?:(?: et al\.?| and [A-ZÀ-Þ][\w'’-]+| & [A-ZÀ-Þ][\w'’-]+))?|[一-鿿]{2,4}等?)\s*[(（](?:19|20)\d{2}[a-z]?[)）]")


def markers_in(text: str) -> list[dict]:
    """Numeric and author-year citation marks of a text, without overlaps, in order."""
    found = [(m.start(), m.end(), m[0], "numeric") for m in NUMERIC.finditer(text)]
    found += [(m.start(), m.end(), m[0], "author_year") for m in DATED.finditer(text)]
    out: list[dict] = []
    for start, end, raw, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or start >= out[-1]["end"]:
            out.append({"start": start, "end": end, "raw": raw, "kind": kind, "target": None})
    return out


def found_marks(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_id and a mark: what a reader saw in the file (raised numbers, fields, notes) and what the text shows; where
    both hold a place, the file counts."""

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("kind", pa.string()), ("target", pa.string())]))
        for batch in batches:
            rows = []
            for text, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sure = [m | {"raw": text[m["start"] : m["end"]]} for m in given or () if m["kind"] != "super" or re.fullmatch(r"[\s\[\]\d,，;；、–-]*\d[\s\[\]\d,，;；、–-]*", text[m["start"] : m["end"]])]
                rest = [m for m in markers_in(text) if all(m["end"] <= s["start"] or m["start"] >= s["end"] for s in sure if s["end"] > s["start"])]
                rows.append(sorted(sure + rest, key=lambda m: (m["start"], m["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["doc_id", "para_id", "marks"])

    rows = paragraphs.where("text IS NOT NULL").select("doc_id", "para_id", "text", "marks").mapInArrow(find, f"doc_id string, para_id string, marks array<{MARK}>")
    return rows.select("doc_id", "para_id", F.explode("marks").alias("m")).select("doc_id", "para_id", "m.*")


def name_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def entries_of(lines: DataFrame) -> DataFrame:
    """reference_entries of lines: doc_id, pos, raw, origin, key."""
    p = lines.withColumn("p", parse_reference_udf("raw"))
    return p.select("doc_id", F.concat_ws("#r", "doc_id", c("pos").cast("string")).alias("ref_id"), c("pos").cast("int").alias("pos"), F.coalesce("label", "p.label").alias("label"), "raw", "p.title", "p.authors", c("p.year").alias("year"), "p.venue", "p.doi", T.entry_language(c("raw")).alias("lang"), "origin", "key")


def word_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of what read_docx gives."""
    notes = notes_of(rows).where("para_ix IS NOT NULL").select(name_of("path").alias("doc_id"), "para_ix", "note_id", "text")
    rows = rows.where("para_ix >= 0 AND text IS NOT NULL").withColumn("doc_id", name_of("path")).withColumn("para_id", F.format_string("%s#p%05d", "doc_id", "para_ix")).withColumn("section_id", F.format_string("%s#s%04d", "doc_id", "section_ix"))
    whole = F.when(c("label").isNotNull() & (c("role") != "reference"), F.concat_ws(" ", "label", "text")).otherwise(c("text"))
    first = F.min(F.when(c("role") == "heading", F.struct("para_ix", whole.alias("title"), "para_id", "level"))).alias("h")
    sections = rows.groupBy("doc_id", "section_id").agg(first).select("doc_id", "section_id", F.when(c("h.level") == 1, c("h.title")).alias("title"), F.coalesce(T.heading_kind(F.when(c("h.level") == 1, c("h.title"))), F.lit("other")).alias("canonical"), F.when(c("h.level") == 1, c("h.para_id")).alias("heading_para_id"))
    paragraphs = rows.select("doc_id", "para_id", "para_ix", "section_id", "text", T.entry_language(c("text")).alias("lang"), (c("role") == "caption").alias("is_caption"), "cell")
    marks = found_marks(rows.where("role <> 'reference'"))
    listed = rows.where("role = 'reference'").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_ix"))).select("doc_id", "pos", c("text").alias("raw"), F.lit("list").alias("origin"), F.lit(None).cast("string").alias("key"), F.regexp_extract("label", "[0-9]+", 0).alias("label")).withColumn("label", F.nullif("label", F.lit("")))
    # a note that reads like a bibliography line is an entry of its own, cited where its mark stands
    noted = notes.where(c("text").rlike("(?:19|20)[0-9]{2}") & (F.length("text") >= 30))
    notes = noted.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_ix", "note_id")) + 100_000).select("doc_id", "pos", c("text").alias("raw"), F.lit("note").alias("origin"), c("note_id").alias("key"), F.lit(None).cast("string").alias("label"))
    return linked({"sections": sections, "paragraphs": paragraphs, "marks": marks.withColumn("keys", F.lit(None).cast("array<string>")), "reference_entries": entries_of(listed.unionByName(notes))})


def latex_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of what read_latex gives."""
    rows = rows.where("text IS NOT NULL").withColumnRenamed("project", "doc_id").withColumn("para_id", F.format_string("%s#p%05d", "doc_id", "ix"))
    blocks = rows.where("kind NOT IN ('entry', 'bibitem')")
    order = Window.partitionBy("doc_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    top = (c("kind") == "heading") & (F.coalesce("level", F.lit(9)) <= 1)
    blocks = blocks.withColumn("section_id", F.format_string("%s#s%04d", "doc_id", F.sum(top.cast("int")).over(order)))
    first = F.min(F.when(top, F.struct("ix", "text", "para_id"))).alias("h")
    sections = blocks.groupBy("doc_id", "section_id").agg(first).select("doc_id", "section_id", c("h.text").alias("title"), F.coalesce(T.heading_kind(c("h.text")), F.lit("other")).alias("canonical"), c("h.para_id").alias("heading_para_id"))
    in_cell = c("kind").isin("cell", "header")
    cell = F.when(in_cell, F.struct(c("keys")[0].alias("table_id"), c("keys")[1].cast("int").alias("row_ix"), c("keys")[2].cast("int").alias("col_ix"), c("level").alias("colspan"), (c("kind") == "header").alias("header")))
    paragraphs = blocks.select("doc_id", "para_id", c("ix").alias("para_ix"), "section_id", "text", T.entry_language(c("text")).alias("lang"), (c("kind") == "caption").alias("is_caption"), cell.alias("cell"))
    m = blocks.select("doc_id", "para_id", "text", F.explode("marks").alias("m"))
    raw = F.substr(c("text"), c("m.start") + 1, c("m.end") - c("m.start"))
    marks = m.select("doc_id", "para_id", c("m.start").alias("start"), c("m.end").alias("end"), raw.alias("raw"), F.when(raw.startswith("["), "numeric").otherwise("author_year").alias("kind"), F.lit(None).cast("string").alias("target"), c("m.keys").alias("keys"))
    source = F.when(F.count_if(c("kind") == "entry").over(Window.partitionBy("doc_id")) > 0, "entry").otherwise("bibitem")
    listed = rows.where("kind IN ('entry', 'bibitem')").withColumn("source", source).where("kind = source").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("ix")))
    lines = listed.select("doc_id", "pos", c("text").alias("raw"), F.lit("list").alias("origin"), c("keys")[0].alias("key"), c("pos").cast("string").alias("label"))
    bib = listed.select("doc_id", F.concat_ws("#b", "doc_id", c("pos").cast("string")).alias("entry_id"), c("keys")[0].alias("key"), "entry_type", "fields", "pos")
    return linked({"sections": sections, "paragraphs": paragraphs, "marks": marks, "reference_entries": entries_of(lines)}) | {"bib_entries": bib}


def linked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with markers in place of marks: each with an id, and the entries it means by key, note, number or name and year."""
    refs, marks = tables["reference_entries"], tables.pop("marks")
    number = F.row_number().over(Window.partitionBy("para_id").orderBy("start", "end", "kind"))
    marks = marks.withColumn("marker_id", F.concat_ws("#m", "para_id", number.cast("string")))
    by_key = marks.select("marker_id", "doc_id", F.posexplode("keys").alias("k", "key")).join(refs.select("doc_id", "key", "ref_id"), ["doc_id", "key"]).select("marker_id", "k", "ref_id")
    by_note = marks.where("kind = 'note'").select("marker_id", "doc_id", c("target").alias("key")).join(refs.where("origin = 'note'").select("doc_id", "key", "ref_id"), ["doc_id", "key"]).select("marker_id", F.lit(0).alias("k"), "ref_id")
    open_ = marks.where("keys IS NULL AND kind <> 'note'")
    digits = open_.where(~c("raw").rlike("[^\\W\\d_]")).withColumn("raw", F.when(c("raw").startswith("["), c("raw")).otherwise(F.concat(F.lit("["), "raw", F.lit("]"))))
    by_number = numbered_links(digits, refs).where("ref_id IS NOT NULL").select("marker_id", c("number").cast("int").alias("k"), "ref_id")
    items = open_.where(c("raw").rlike("[^\\W\\d_]")).select("doc_id", "marker_id", F.posexplode(T.author_year_items(F.regexp_replace("raw", "[(（](?=(?:19|20)[0-9]{2}[a-z]?[)）]$)", ", "))).alias("k", "x")).select("doc_id", "marker_id", "k", "x.*")
    by_name = author_year_links(items.drop("k"), refs).join(items.select("marker_id", "names", "year", "suffix", "k"), ["marker_id", "names", "year", "suffix"]).select("marker_id", "k", "ref_id")
    found = by_key.unionByName(by_note).unionByName(by_number).unionByName(by_name).groupBy("marker_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("k", "ref_id"))), lambda x: x["ref_id"]).alias("ref_ids"))
    kinds = F.when(c("kind") == "note", "footnote").when(c("kind") == "super", "superscript").when(c("kind") == "field", "zotero").otherwise(c("kind"))
    markers = marks.join(found, "marker_id", "left").select("doc_id", "marker_id", "para_id", c("start").alias("start_pos"), c("end").alias("end_pos"), "raw", kinds.alias("kind"), F.coalesce("ref_ids", F.array().cast("array<string>")).alias("ref_ids"), "keys")
    return tables | {"markers": markers}


def read_manuscripts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sections, paragraphs, markers, reference_entries and bib_entries of all Word files and LaTeX projects at path.

    Each kind of file has its reader; what a kind doesn't have is null. Files that can't be read give no rows here (read_docx
    names them). bib_entries has LaTeX entries only.
    """
    word, tex = word_tables(read_docx(spark, path)), latex_tables(read_latex(spark, path))
    both = {n: word[n].unionByName(tex[n]) for n in ("sections", "paragraphs", "markers", "reference_entries")}
    now = F.lit(None).cast("timestamp_ntz")
    both["bib_entries"] = tex["bib_entries"].withColumn("added_at", now).withColumn("deleted_at", now)
    return {n: t.withColumn("loaded_at", now) for n, t in both.items()}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table where the named queries look for it."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
