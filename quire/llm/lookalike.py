"""One stored form for text that looks the same."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import busy, cut

# Capital and small letters of other scripts that are drawn like a Latin letter, beside that letter.
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj Ϲ C"
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ԚQ ԜW Ү Y аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw"
ARMENIAN = "ՍU Օ O оo հh ոn սu օo"
COPTIC = "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲬX ⲟo ⲣp ⲥc"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
# Hyphens that are drawn alike, and marks that are drawn like another.
OTHER = {0x2010: "-", 0x2011: "-", 0x02BC: "’", 0x2019: "’", 0x0131: "ı"}
#: Kinds of compatibility decomposition that change no look; superscripts, circles, fractions and squares do.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Compatibility decompositions to these characters are visible, so they stay.
VISIBLE = {0x2026: None, 0x2025: None, 0x2024: None, 0x00B4: None, 0x00A8: None, 0x00AF: None, 0x00B8: None}


def _letters() -> dict[int, str]:
    pairs = re.findall(r"(\S) ?(\S)", f"{GREEK} {CYRILLIC} {ARMENIAN} {COPTIC} {CHEROKEE} {LISU}")
    return {ord(a): b for a, b in pairs}


#: Characters that take no room: format characters, the soft hyphen, joiners and variation selectors.
IGNORABLE = frozenset([0x00AD, 0x034F, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])


@lru_cache(1)
def tables() -> tuple[dict[int, str | None], re.Pattern]:
    """What each single character becomes, and the pattern of unstable segments.

    A segment is unstable where a character's quick check fails: it changes by itself, or it is a mark that may combine
    with what stands before it. The segment takes in the starter before it and all marks after it.
    """
    to: dict[int, str | None] = dict.fromkeys(IGNORABLE)
    marks = []
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs") or c in to:
            continue
        if category == "Zs":
            to[c] = " "
            continue
        if unicodedata.combining(ch) or category[0] == "M" and unicodedata.normalize("NFC", "e" + ch) != "e" + ch:
            marks.append(ch)
        decomposed = unicodedata.decomposition(ch)
        if not decomposed:  # what has no decomposition changes by no normal form, but Hangul, which is composed as it stands
            continue
        if c not in VISIBLE and decomposed.split(" ")[0] in SAME_LOOK:
            to[c] = unicodedata.normalize("NFKC", ch)
        elif not unicodedata.is_normalized("NFC", ch):
            to[c] = unicodedata.normalize("NFC", ch)
    to |= {c: x for c, x in OTHER.items() if chr(c) != x}
    letters = _letters()
    to = {c: x and "".join(letters.get(ord(y), y) for y in x) for c, x in to.items()} | letters

    def span(codes) -> str:
        out, codes = [], sorted(codes)
        for c in codes:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    vowels = [c for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(*r)]  # jamo that may join the one before
    joins, changes = span({*map(ord, marks), *vowels}), span(to)
    return to, re.compile(f"[^{joins}]?[{joins}][{joins}{changes}]*|[{changes}]+[{joins}{changes}]*")


def canonical(text: str) -> str:
    """The form that all texts of one look share: composed, without width forms, invisible characters and kinds of space,
    look-alike letters as Latin ones. Case, accents, digits, wording and visible punctuation stay. Text between unstable
    segments is spliced in unchanged."""
    if text.isascii():
        return text
    to, unstable = tables()

    def mend(match: re.Match) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", match[0].translate(to)).translate(to))

    once = unstable.sub(mend, text)
    return once if once == text else unstable.sub(mend, once)  # what was taken out may have parted a mark from its base


def digests(rows: DataFrame) -> DataFrame:
    """field_name, id, form, stored: 128-bit digests of the canonical form and of the text as stored.

    rows: field_name, id, text. Rows whose id or text is null are left out.
    """

    def digest(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            form = [xxhash.xxh3_128_digest(canonical(t)) for t in texts]
            stored = [xxhash.xxh3_128_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(form, pa.binary()), pa.array(stored, pa.binary())], ["field_name", "id", "form", "stored"])

    rows = busy(rows.select("field_name", "id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull()))
    return rows.mapInArrow(digest, "field_name string, id string, form binary, stored binary")


def same_look(rows: DataFrame, leave_out: DataFrame | None = None, *, salts: int = 16, block: int = 20_000) -> DataFrame:
    """field_name, id_a, id_b of rows that look the same but are stored differently, id_a < id_b, distinct.

    rows: field_name, id, text. leave_out: field_name, id of rows that are no case; only rows of a group with more than
    one stored form are held against it. Groups with one stored form drop out after a pre-aggregated count; what is left
    is joined in blocks, so a group that holds a third of all rows is shared by many tasks. An id with several texts is
    compared by each of them, but never with itself. Empty texts are rows like others.
    """
    marked = cut(digests(rows))  # read twice, and made by Python once
    groups = marked.groupBy("field_name", "form").agg(F.count("*").alias("n"), F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("field_name", "form", "n")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    several = marked.withColumn("salt", F.pmod(F.hash("id"), F.lit(salts))).join(spread, ["field_name", "form", "salt"]).drop("salt")
    if leave_out is not None:
        several = several.join(leave_out.select("field_name", "id"), ["field_name", "id"], "left_anti")
    several = several.distinct().withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    left = several.select("field_name", "form", F.col("id").alias("id_a"), F.col("stored").alias("s_a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    right = several.select("field_name", "form", F.col("id").alias("id_b"), F.col("stored").alias("s_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, ["field_name", "form", "block"]).where("id_a < id_b AND s_a <> s_b")
    return pairs.select("field_name", "id_a", "id_b").distinct()


def look_classes(rows: DataFrame, leave_out: DataFrame | None = None) -> DataFrame:
    """field_name, id, class_id, n_forms, n_links: each row that has a look-alike stored otherwise, with its class (the digest
    of the common form), the class's stored forms, and how many other ids it looks like without being stored the same.

    The whole of same_look in one row an id: a class that a third of all rows is in costs one row each. An id with
    several texts has a row per class.
    """
    marked = digests(rows)
    if leave_out is not None:
        marked = marked.join(leave_out.select("field_name", "id"), ["field_name", "id"], "left_anti")
    marked = cut(marked.distinct())
    forms = marked.groupBy("field_name", "form", "stored").agg(F.count("*").alias("own"))
    classes = forms.groupBy("field_name", "form").agg(F.sum("own").alias("all"), F.count("*").alias("n_forms")).where("n_forms > 1")
    sizes = forms.join(classes, ["field_name", "form"])
    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)
    wide = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = marked.withColumn("salt", F.pmod(F.hash("id"), F.lit(salts))).join(wide, ["field_name", "form", "stored", "salt"])
    return each.groupBy("field_name", "id", F.hex("form").alias("class_id")).agg(F.max("n_forms").alias("n_forms"), F.max(F.col("all") - F.col("own")).alias("n_links"))


def canonical_text(df: DataFrame, column: str) -> DataFrame:
    """df with `column` in its canonical form; null stays null, other columns are untouched."""
    i = df.columns.index(column)

    def mend(batches):
        for batch in batches:
            cols = list(batch.columns)
            cols[i] = pa.array([t if t is None else canonical(t) for t in cols[i].to_pylist()], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return df.mapInArrow(mend, df.schema)
