"""Proposed corrections of slips: which are taken, and which overstep what fixing a slip may do."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.evidence import minimal_edit

c = F.col
HAN = re.compile(r"[㐀-鿿]")
LETTERS = re.compile(r"[^\W_]+")
LATIN = "[A-Za-z][A-Za-z'’-]*"
SLIP = "start_pos int, end_pos int, old string, new string, old_words array<string>, new_words array<string>"


def slip(text: str, original: str, correction: str, marks: list[tuple[int, int]]) -> dict | None:
    """The least edit of a proposed correction, or None if it is no slip's: the original must stand once in the text and in no
    marker, digits must stay, more than signs and spaces must change, and nothing may only vanish or appear: what is cut
    must be a doubling or a letter inside a word, what is added a letter inside a word. Capitals alone are no slip in a
    text that has none."""
    original, correction = (unicodedata.normalize("NFC", x or "") for x in (original, correction))
    if not original or text.count(original) != 1 or original == correction or re.findall(r"\d", original) != re.findall(r"\d", correction):
        return None
    at = text.index(original)
    if any(at < b and a < at + len(original) for a, b in marks):
        return None
    a, b, new = minimal_edit(original, correction)
    old = original[a:b]
    start, end = at + a, at + b
    if LETTERS.findall(old) == LETTERS.findall(new):
        return None
    inside = lambda i, j: i > 0 and text[i - 1].isalpha() and j < len(text) and text[j].isalpha()
    if not old.strip() and not inside(start, end):
        return None
    kept = new.strip()
    if len(kept) < len(old) and (old.startswith(kept) or old.endswith(kept)):
        gone = (start + len(kept), end) if old.startswith(kept) else (start, end - len(kept))
        cut = text[gone[0] : gone[1]].strip()
        gone = (gone[0] + text[gone[0] : gone[1]].find(cut), gone[0] + text[gone[0] : gone[1]].find(cut) + len(cut))
        touching = gone[0] > 0 and text[gone[0] - 1].isalpha() or gone[1] < len(text) and text[gone[1]].isalpha()
        letter = cut.isalpha() and not HAN.search(cut) and touching
        twice = text[gone[1] :].lstrip().startswith(cut) or text[: gone[0]].rstrip().endswith(cut)
        if cut and not letter and not twice:
            return None
    base = old.strip()
    if len(kept) > len(base) and (kept.startswith(base) and kept[len(base)].isspace() or kept.endswith(base) and kept[-len(base) - 1].isspace()):
        return None
    if old.casefold() == new.casefold() and sum(ch.isupper() for ch in text) < 0.01 * max(1, sum(ch.isalpha() for ch in text)):
        return None
    words = lambda x, y: [w for w in re.findall(LATIN, x) if w not in re.findall(LATIN, y)]
    term = not HAN.search(old + new) and not old.islower()
    return {"start_pos": start, "end_pos": end, "old": old, "new": new, "old_words": [w for w in words(old, new) if len(w) >= 4] if term else [], "new_words": words(new, old) if term else []}


def typo_revisions(paragraphs: DataFrame, markers: DataFrame, proposals: DataFrame) -> DataFrame:
    """para_id, start_pos, end_pos, old, new, kind of the proposed corrections that hold: revision (two letters or fewer
    change) or doubt.

    paragraphs: doc_id, para_id, text; markers: para_id, start_pos, end_pos; proposals: para_id, original, correction. A
    word with a capital that its manuscript uses twice or more is the author's term and stays, unless the new one is used
    as well; of Chinese, what stands the same way elsewhere in the manuscript stays. Manuscripts are held against their own
    words by joins on manuscript and word, never gathered.
    """
    marks = markers.groupBy("para_id").agg(F.collect_list(F.struct(c("start_pos").cast("int").alias("a"), c("end_pos").cast("int").alias("b"))).alias("marks"))
    rows = proposals.select("para_id", "original", "correction").distinct().join(paragraphs.where("text IS NOT NULL").select("doc_id", "para_id", "text"), "para_id").join(marks, "para_id", "left")
    fields = ["start_pos", "end_pos", "old", "new", "old_words", "new_words"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def judge(batches):
        for b in batches:
            got = [slip(t, o, n, [(m["a"], m["b"]) for m in ms or ()]) for o, n, t, ms in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            at = [i for i, g in enumerate(got) if g]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), *(pa.array([got[i][f] for i in at], t) for f, t in zip(fields, types))], ["doc_id", "para_id", *fields])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.select("doc_id", "para_id", "original", "correction", "text", "marks").mapInArrow(judge, f"doc_id {kinds['doc_id']}, para_id {kinds['para_id']}, {SLIP}")
    place = ["doc_id", "para_id", "start_pos", "end_pos", "old", "new"]
    asked = found.select(*place, F.explode(F.concat(F.transform("old_words", lambda w: F.struct(w.alias("word"), F.lit(True).alias("gone"))), F.transform("new_words", lambda w: F.struct(w.alias("word"), F.lit(False).alias("gone"))))).alias("x")).select(*place, "x.word", "x.gone")
    words = paragraphs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LATIN), 0)).alias("word"))
    counts = words.join(asked.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_semi").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    known = asked.join(counts, ["doc_id", "word"], "left").groupBy(*place).agg(F.min(F.when(c("gone"), F.coalesce("n", F.lit(0)))).alias("least_old"), F.max(F.when(~c("gone"), F.coalesce("n", F.lit(0)))).alias("most_new"))
    term = known.where("least_old >= 2 AND most_new = 0").select(*place)
    # Chinese: the changed characters with one neighbour on each side, found again in another place of the manuscript
    text = paragraphs.select("para_id", "text")
    han = found.where((F.col("old") != "") & F.concat("old", "new").rlike("[㐀-鿿]")).join(text, "para_id").withColumn("window", F.substr("text", F.greatest(c("start_pos"), F.lit(1)), c("end_pos") - c("start_pos") + F.when(c("start_pos") > 0, 2).otherwise(1)))
    where = han.select(*place, "window").distinct().join(paragraphs.select("doc_id", c("text").alias("other")), "doc_id").where(F.contains("other", c("window")))
    used = where.groupBy(*place, "window").agg(F.sum((F.length("other") - F.length(F.replace("other", "window", F.lit("")))) / F.length("window")).alias("n")).where("n >= 2").select(*place)
    kind = F.when(F.levenshtein("old", "new") > 2, "doubt").otherwise("revision")
    return found.select(*place).distinct().join(term, place, "left_anti").join(used, place, "left_anti").select("para_id", "start_pos", "end_pos", "old", "new", kind.alias("kind"))
