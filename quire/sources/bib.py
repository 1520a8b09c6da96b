"""Bibliography files: BibTeX entries and .bbl items, one row each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, key string, entry_type string, fields map<string,string>, pos int"


def closing(text: str, at: int) -> int:
    """Place after the brace that closes the one at `at`; the text's end if none does."""
    depth = 0
    i = at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def fields_of(body: str) -> dict[str, str]:
    """name = {value}, "value" or bare word; later fields of one name are ignored, concatenation with # is joined."""
    out: dict[str, str] = {}
    i = 0
    name = re.compile(r"\s*,?\s*([A-Za-z][\w:-]*)\s*=\s*")
    while m := name.match(body, i):
        i, parts = m.end(), []
        while i < len(body):
            if body[i] == "{":
                end = closing(body, i)
                parts.append(body[i + 1 : end - 1])
            elif body[i] == '"':
                end = i + 1
                depth = 0
                while end < len(body) and (body[end] != '"' or depth):
                    depth += (body[end] == "{") - (body[end] == "}")
                    end += 1
                parts.append(body[i + 1 : end])
                end += 1
            else:
                word = re.compile(r"[^\s,#{}]*").match(body, i)
                parts.append(word[0])
                end = word.end()
            i = end
            more = re.compile(r"\s*#\s*").match(body, i)
            if not more:
                break
            i = more.end()
        out.setdefault(m[1].lower(), re.sub(r"\s+", " ", "".join(parts)).strip())
    return out


def entries(text: str) -> Iterator[tuple[str, str, dict[str, str], int]]:
    """(key, type, fields, place) of each entry; comments, preambles and strings are no entries."""
    for m in re.finditer(r"@\s*([A-Za-z]+)\s*\{", text):
        kind = m[1].lower()
        if kind in ("comment", "preamble", "string"):
            continue
        body = text[m.end() : closing(text, m.end() - 1) - 1]
        key, comma, rest = body.partition(",")
        if comma and "=" not in key:
            yield key.strip(), kind, fields_of(rest), m.start()


def bbl_items(text: str) -> Iterator[tuple[str, str, dict[str, str], int]]:
    """Items of a thebibliography environment or a typeset .bbl file (key, raw text), or of one that biblatex wrote (key, fields)."""
    for m in re.finditer(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\Z)", text, re.S):
        raw = re.sub(r"\\newblock|\\[a-zA-Z]+\*?|[{}~]", " ", m[2])
        yield m[1].strip(), "bibitem", {"raw": re.sub(r"\s+", " ", raw).strip()}, m.start()
    for m in re.finditer(r"\\entry\{([^}]*)\}\{([^}]*)\}\{[^}]*\}(.*?)\\endentry", text, re.S):
        fields = {f[1].lower(): m[3][f.end() : closing(m[3], f.end() - 1) - 1] for f in re.finditer(r"\\field\{([^}]*)\}\{", m[3])}
        people = [m[3][a.end() : closing(m[3], a.end() - 1) - 1] for a in re.finditer(r"\\name\{author\}\{\d+\}\{[^}]*\}\{", m[3])][:1]
        part = lambda who, x: next(iter(re.findall(rf"{x}=\{{([^{{}}]*)\}}", who)), "")
        told = [f"{part(who, 'family')}, {part(who, 'given')}".strip(", ") for some in people for who in re.findall(r"\{\{[^{}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}\}", some)]
        if told:
            fields["author"] = " and ".join(told)
        yield m[1].strip(), m[2].strip().lower(), {k: re.sub(r"\s+", " ", v).strip() for k, v in fields.items()}, m.start()


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all .bib and .bbl files at path (any file system Spark reads); files without entries give no row."""

    def parse(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = content.decode("utf-8", "replace")
                rows += [{"path": name, "key": k, "entry_type": t, "fields": list(f.items()), "pos": p} for k, t, f, p in (bbl_items(text) if name.endswith(".bbl") else entries(text))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("key", pa.string()), ("entry_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("pos", pa.int32())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{bib,bbl}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, SCHEMA)
