"""Word manuscripts: one row per paragraph, from the zip's XML by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = pa.schema([("path", pa.string()), ("para_ix", pa.int32()), ("text", pa.string()), ("style", pa.string()), ("level", pa.int32()), ("num_id", pa.int32()), ("num_level", pa.int32()), ("field", pa.string()), ("note_ids", pa.list_(pa.string())), ("cell", pa.struct([("table_id", pa.string()), ("row_ix", pa.int32()), ("col_ix", pa.int32()), ("colspan", pa.int32()), ("header", pa.bool_())])), ("label", pa.string()), ("role", pa.string()), ("section_ix", pa.int32()), ("marks", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("target", pa.string())])))])
DDL = "path string, para_ix int, text string, style string, level int, num_id int, num_level int, field string, note_ids array<string>, cell struct<table_id:string,row_ix:int,col_ix:int,colspan:int,header:boolean>, label string, role string, section_ix int, marks array<struct<start:int,end:int,kind:string,target:string>>"
# Titles of reference lists and of what follows them, and how captions begin.
LIST_TITLES = re.compile(r"^[\s\d.]*(?:references|bibliography|works cited|literature cited|literatur(?:verzeichnis)?|bibliographie|bibliografía|referencias|参考文献)\s*[:：]?\s*$", re.I)
BACK_TITLES = re.compile(r"^\s*(?:appendix|acknowledg|supplementary|corresponding author|附录|致谢|作者简介)", re.I)
CAPTION = re.compile(r"^\s*(?:figure|fig\.|table|tab\.|abbildung|tabelle|图|表)\s*\d", re.I)
NUMBERED = re.compile(r"^\s*(?P<number>\d+(?:\.\d+)*)[.、．]?\s+(?P<title>\S.{0,78})$")
LISTED = re.compile(r"^\s*(?:\[\d+\]|\d+[.)]\s)")
#: Bytes an archive may unfold to, against archives made to exhaust memory.
MOST = 512 << 20


def safe_parts(data: bytes, names: list[str], most: int = MOST) -> dict[str, bytes]:
    """Named parts of a zip; nothing that points out of the archive or unfolds beyond `most` bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = {i.filename: i for i in z.infolist() if not i.filename.startswith(("/", "\\")) and ".." not in i.filename.split("/")}
        if sum(i.file_size for i in infos.values()) > most:
            raise ValueError("archive too large")
        return {n: z.read(infos[n]) for n in names if n in infos}


def value(element, path: str) -> str | None:
    found = element.find(path)
    return None if found is None else found.get(f"{W}val")


def styles_of(xml: bytes | None) -> dict[str, tuple[str | None, int | None, str]]:
    """style id -> (based on, outline level, name)."""
    out = {}
    for s in ElementTree.fromstring(xml).iter(f"{W}style") if xml else ():
        level = value(s, f"{W}pPr/{W}outlineLvl")
        out[s.get(f"{W}styleId")] = (value(s, f"{W}basedOn"), int(level) if level else None, value(s, f"{W}name") or "")
    return out


def heading_level(style: str | None, outline: str | None, text: str, styles: dict, by_text: bool = False) -> int | None:
    """1 for a top heading, from the paragraph's outline level, its style or a style that one is based on, or its name.

    by_text: where a file styles no headings, a short numbered line without a stop is one, as deep as its number.
    """
    if outline is not None:
        return int(outline) + 1 if int(outline) < 9 else None
    for _ in range(20):
        if style is None or style not in styles:
            break
        based, level, name = styles[style]
        if level is not None:
            return level + 1 if level < 9 else None
        if m := re.fullmatch(r"heading ([1-9])", name.lower()):
            return int(m[1])
        style = based
    if by_text and (m := NUMBERED.match(text)) and not re.search(r"[.。!?！？;；,，]\s*$|[。！？]", m["title"]) and not LISTED.match(text.replace(m["number"], "x", 1)):
        return m["number"].count(".") + 1
    return None


def segments(p) -> list[tuple[str, str]]:
    """(text, kind) of a paragraph's runs as accepted: kind is text, super (raised), field (a citation field's result), note
    (a note's mark, without text) or code. Deleted runs are left out, tabs and breaks kept."""
    out: list[tuple[str, str]] = []
    deleted = {id(e) for gone in p.iter(f"{W}del") for e in gone.iter()}
    raised = {id(e) for r in p.iter(f"{W}r") if value(r, f"{W}rPr/{W}vertAlign") == "superscript" for e in r.iter()}
    simple = {id(e): f.get(f"{W}instr") or "" for f in p.iter(f"{W}fldSimple") for e in f.iter()}
    stack: list[list] = []  # an open field: its code so far, and whether its result has begun
    for e in p.iter():
        if id(e) in deleted:
            continue
        if e.tag == f"{W}fldChar":
            kind = e.get(f"{W}fldCharType")
            if kind == "begin":
                stack.append(["", False])
            elif kind == "separate" and stack:
                stack[-1][1] = True
            elif kind == "end" and stack:
                stack.pop()
        elif e.tag == f"{W}instrText":
            out.append((e.text or "", "code"))
            if stack:
                stack[-1][0] += e.text or ""
        elif e.tag == f"{W}fldSimple":
            out.append((e.get(f"{W}instr") or "", "code"))
        elif e.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"):
            if stack and not stack[-1][1]:
                continue
            text = (e.text or "") if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n"
            code = stack[-1][0] if stack else simple.get(id(e), "")
            out.append((text, "field" if CITING.search(code) else "super" if id(e) in raised else "text"))
        elif e.tag in (f"{W}footnoteReference", f"{W}endnoteReference"):
            out.append((("f" if "foot" in e.tag else "e") + (e.get(f"{W}id") or ""), "note"))
    return out


CITING = re.compile(r"ZOTERO_ITEM|CITATION|EN\.CITE|ADDIN CITE|CSL_CITATION")


def paragraph_text(p) -> tuple[str, str | None, list[str]]:
    """Text as accepted, the field code in it, the notes it refers to."""
    parts = segments(p)
    join = lambda *kinds: "".join(t for t, k in parts if k in kinds)
    return join("text", "super", "field"), join("code").strip() or None, [t for t, k in parts if k == "note"]


def marks_of(p) -> list[dict]:
    """Places of raised numbers, citation fields and note marks in the text; neighbouring runs of one kind are one place."""
    out: list[dict] = []
    at = 0
    for text, kind in segments(p):
        if kind == "code":
            continue
        size = 0 if kind == "note" else len(text)
        if kind in ("super", "field") and out and out[-1]["kind"] == kind and out[-1]["end"] == at:
            out[-1]["end"] = at + size
        elif kind != "text" and (size or kind == "note"):
            out.append({"start": at, "end": at + size, "kind": kind, "target": text if kind == "note" else None})
        at += size
    return out


class Numbering:
    """Automatic numbers of paragraphs: a counter for each list and level; a count at one level begins the deeper ones again."""

    def __init__(self, xml: bytes | None):
        self.levels: dict[int, dict[int, tuple[str, str, int]]] = {}
        self.counts: dict[int, dict[int, int]] = {}
        if not xml:
            return
        root = ElementTree.fromstring(xml)
        shapes = {a.get(f"{W}abstractNumId"): {int(x.get(f"{W}ilvl")): (value(x, f"{W}numFmt") or "decimal", value(x, f"{W}lvlText") or "", int(value(x, f"{W}start") or 1)) for x in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
        for n in root.findall(f"{W}num"):
            levels = dict(shapes.get(value(n, f"{W}abstractNumId"), {}))
            for o in n.findall(f"{W}lvlOverride"):
                at, begin = int(o.get(f"{W}ilvl")), value(o, f"{W}startOverride")
                if begin and at in levels:
                    levels[at] = (*levels[at][:2], int(begin))
            self.levels[int(n.get(f"{W}numId"))] = levels

    def label(self, number: int | None, level: int | None) -> str | None:
        levels = self.levels.get(number)
        at = level or 0
        if not levels or at not in levels or levels[at][0] == "none":
            return None
        counts = self.counts.setdefault(number, {})
        counts[at] = counts.get(at, levels[at][2] - 1) + 1
        for deeper in [k for k in counts if k > at]:
            del counts[deeper]
        if levels[at][0] == "bullet":
            return levels[at][1] or None
        shown = lambda m: spelled(counts.get(int(m[1]) - 1, levels.get(int(m[1]) - 1, ("", "", 1))[2]), levels.get(int(m[1]) - 1, ("decimal",))[0])
        return re.sub(r"%([1-9])", shown, levels[at][1]) or None


def spelled(n: int, shape: str) -> str:
    """A count as Word writes it: Roman, letters (aa after z), or digits."""
    if shape in ("lowerRoman", "upperRoman") and n > 0:
        out = ""
        for size, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // size), n % size
        return out.upper() if shape == "upperRoman" else out
    if shape in ("lowerLetter", "upperLetter") and n > 0:
        out = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return out.upper() if shape == "upperLetter" else out
    return f"{n:02d}" if shape == "decimalZero" else str(n)


def structure(rows: list[dict]) -> None:
    """Gives each paragraph its role (heading, reference, caption, cell, body) and the number of its section; raised numbers
    in lines of authors and their institutions, above the body, are no marks."""
    heads = [i for i, r in enumerate(rows) if r["level"] is not None]
    begin = next((i + 1 for i in heads if LIST_TITLES.match(rows[i]["text"])), None)
    end = len(rows)
    if begin is None:
        begin = end  # without a title, a list is the lines at the end that are numbered from 1 on in one shape
        shape, want = None, None
        while begin and want != 0 and rows[begin - 1]["cell"] is None and (m := LISTED.match(rows[begin - 1]["text"]) or LISTED.match(f"{rows[begin - 1]['label'] or ''} ")):
            number, now = int(re.search(r"\d+", m[0])[0]), re.sub(r"\d+", "", m[0]).strip()
            if number != (number if want is None else want) or now != (shape or now):
                break
            begin, shape, want = begin - 1, now, number - 1
        begin = begin if end - begin >= 3 and want == 0 else end
    else:
        end = next((i for i in range(begin, end) if rows[i]["level"] is not None or BACK_TITLES.match(rows[i]["text"])), end)
    body = next((i for i in heads if rows[i]["level"] == 1 and not LIST_TITLES.match(rows[i]["text"])), 0)
    section = -1
    for i, r in enumerate(rows):
        if r["level"] == 1 or section < 0:
            section += 1
        r["section_ix"] = section
        r["role"] = "cell" if r["cell"] else "heading" if r["level"] is not None else "reference" if begin <= i < end and r["text"].strip() else "caption" if CAPTION.match(r["text"]) and len(r["text"]) < 400 else "body"
        line = r["text"].strip()
        if i < body and len(line) <= 200 and not re.search(r"[。！？．]|[.!?](?:\s|$)", line.rstrip(".)） ")):
            r["marks"] = [m for m in r["marks"] if m["kind"] != "super"]


def parse(path: str, data: bytes) -> list[dict]:
    parts = safe_parts(data, ["word/document.xml", "word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml"])
    styles, numbering = styles_of(parts.get("word/styles.xml")), Numbering(parts.get("word/numbering.xml"))
    cells, kept = {}, []
    body = ElementTree.fromstring(parts["word/document.xml"])
    for t, table in enumerate(body.iter(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            column = 0
            header = row.find(f"{W}trPr/{W}tblHeader") is not None
            for cell in row.findall(f"{W}tc"):
                span = int(value(cell, f"{W}tcPr/{W}gridSpan") or 1)
                for p in cell.iter(f"{W}p"):
                    cells[id(p)] = {"table_id": f"t{t}", "row_ix": r, "col_ix": column, "colspan": span, "header": header}
                column += span
    rows = []
    level_of = lambda p, text, by_text: heading_level(value(p, f"{W}pPr/{W}pStyle"), value(p, f"{W}pPr/{W}outlineLvl"), text, styles, by_text)
    by_text = sum(level_of(p, "", False) is not None for p in body.iter(f"{W}p")) < 3
    for ix, p in enumerate(body.iter(f"{W}p")):
        kept.append(p)  # ids stay unique while the elements live
        text, code, notes = paragraph_text(p)
        style = value(p, f"{W}pPr/{W}pStyle")
        number, at = value(p, f"{W}pPr/{W}numPr/{W}numId"), value(p, f"{W}pPr/{W}numPr/{W}ilvl")
        rows.append({"path": path, "para_ix": ix, "text": text, "style": style, "level": level_of(p, text, by_text and not number and id(p) not in cells), "num_id": int(number) if number else None, "num_level": int(at) if at else None, "field": code, "note_ids": notes, "cell": cells.get(id(p)), "label": numbering.label(int(number), int(at or 0)) if number else None, "marks": marks_of(p)})
    structure(rows)
    for name, mark in (("word/footnotes.xml", "f"), ("word/endnotes.xml", "e")):
        for note in ElementTree.fromstring(parts[name]) if name in parts else ():
            if note.get(f"{W}type") is None:
                text = "\n".join(paragraph_text(p)[0] for p in note.iter(f"{W}p"))
                rows.append({"path": path, "para_ix": -1, "text": text, "style": f"note:{mark}{note.get(f'{W}id')}", "level": None, "num_id": None, "num_level": None, "field": None, "note_ids": [], "cell": None, "label": None, "role": "note", "section_ix": None, "marks": []})
    return rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs, cells and notes of all .docx files at path. A file that is no Word file gives one row with null text."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = parse(name, content)
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError):
                    rows = [dict.fromkeys(SCHEMA.names) | {"path": name, "style": "unreadable"}]
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, DDL)


def notes_of(paragraphs: DataFrame) -> DataFrame:
    """path, para_ix, note_id, text: notes with the paragraph that refers to them; a note nobody refers to has none."""
    notes = paragraphs.where(F.col("style").startswith("note:")).select("path", F.substring("style", 6, 100).alias("note_id"), "text")
    refs = paragraphs.select("path", "para_ix", F.explode("note_ids").alias("note_id"))
    return notes.join(refs, ["path", "note_id"], "left")


def roman(n: Column) -> Column:
    """Small Roman numerals of 1 to 3999."""
    digits = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    out, left = F.lit(""), n
    for size, letters in digits:
        out = F.concat(out, F.repeat(F.lit(letters), (left / size).cast("int")))
        left = left % size
    return out


def letters(n: Column) -> Column:
    """a to z, then aa, bb as lists are lettered."""
    return F.repeat(F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), ((n - 1) % 26 + 1).cast("int"), F.lit(1)), ((n - 1) / 26 + 1).cast("int"))


def tracked(data: bytes, edits: list[tuple[int, int, int, str]], author: str = "quire", when: str = "2000-01-01T00:00:00Z") -> bytes:
    """A Word file with edits as tracked changes: (paragraph, start, end, new text) by the places of read_docx.

    Edits of a paragraph don't overlap. Runs are cut at an edit's ends and keep their looks; what goes is marked as deleted,
    what comes as inserted beside it. Edits that reach into a field's code or a paragraph that isn't there are left out.
    """
    ElementTree.register_namespace("w", W[1:-1])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {i.filename: z.read(i) for i in z.infolist()}
    root = ElementTree.fromstring(parts["word/document.xml"])
    paragraphs = list(root.iter(f"{W}p"))
    mark = {f"{W}author": author, f"{W}date": when}
    ids = iter(range(9_000, 1 << 30))
    for ix, start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if not 0 <= ix < len(paragraphs):
            continue
        p, at, first, removed = paragraphs[ix], 0, None, []
        for run in list(p.findall(f"{W}r")):
            t = run.find(f"{W}t")
            text = (t.text or "") if t is not None else ""
            size = len(text) if t is not None else sum(e.tag in (f"{W}tab", f"{W}br", f"{W}cr") for e in run)
            a, b = max(start, at), min(end, at + size)
            if t is not None and (a < b or start == end and at <= start <= at + size and first is None):
                pieces = [(text[: a - at], False), (text[a - at : b - at], True), (text[b - at :], False)] if a < b else [(text[: start - at], False), (text[start - at :], False)]
                place = list(p).index(run)
                p.remove(run)
                for k, (piece, gone) in enumerate(pieces):
                    if not piece and not (a >= b and k == 0):
                        continue
                    r = ElementTree.Element(f"{W}r")
                    looks = run.find(f"{W}rPr")
                    if looks is not None:
                        r.append(looks)
                    ElementTree.SubElement(r, f"{W}delText" if gone else f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = piece
                    if gone:
                        d = ElementTree.Element(f"{W}del", mark | {f"{W}id": str(next(ids))})
                        d.append(r)
                        r = d
                        removed.append(d)
                    p.insert(place, r)
                    place += 1
                    if gone or a >= b and k == 0:
                        first = r
            at += size
        if new and first is not None:
            ins = ElementTree.Element(f"{W}ins", mark | {f"{W}id": str(next(ids))})
            ElementTree.SubElement(ElementTree.SubElement(ins, f"{W}r"), f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = new
            p.insert(list(p).index(first) + 1, ins)
    parts["word/document.xml"] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def write_tracked(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content of Word files with their edits as tracked changes. files: path, content; edits: path, para_ix, start, end, new."""
    grouped = edits.groupBy("path").agg(F.collect_list(F.struct("para_ix", "start", "end", "new")).alias("edits"))

    def write(batches):
        for b in batches:
            done = [tracked(content, [(e["para_ix"], e["start"], e["end"], e["new"] or "") for e in some]) for content, some in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.binary())], ["path", "content"])

    return files.select("path", "content").join(grouped, "path").mapInArrow(write, "path string, content binary")


def rejected(data: bytes) -> list[str]:
    """The texts of a file's paragraphs with every tracked change undone."""
    root = ElementTree.fromstring(safe_parts(data, ["word/document.xml"])["word/document.xml"])
    added = {id(e) for i in root.iter(f"{W}ins") for e in i.iter()}
    return ["".join(e.text or "" for e in p.iter() if e.tag in (f"{W}t", f"{W}delText") and id(e) not in added) for p in root.iter(f"{W}p")]
