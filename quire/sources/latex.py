"""LaTeX projects: main file, includes, conditionals, macros, blocks, citations; one row per block, with its place."""

from __future__ import annotations

import io
import re
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.fuzzy import surname
from quire.sources.bib import bbl_items, closing, entries

DDL = "project string, ix int, kind string, level int, text string, keys array<string>, file string, line int, marks array<struct<start:int,end:int,keys:array<string>>>, entry_type string, fields map<string,string>"
HEADINGS = {"part": 0, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
CITE = re.compile(r"\\(?:[Cc]ite[a-zA-Z]*|parencite|textcite|autocite|footcite)\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^{}]*)\}")
FLOATS = ("figure", "table", "figure*", "table*", "wrapfigure", "longtable")


def strip_comments(text: str) -> str:
    """Without comments: % up to the line's end, unless an odd number of backslashes or \\verb stands before it."""
    out = []
    for line in text.split("\n"):
        kept = [m.span() for m in re.finditer(r"\\verb\*?([^\sa-zA-Z*])(.*?)\1", line)]
        for m in re.finditer(r"(\\*)%", line):
            if len(m[1]) % 2 == 0 and not any(a <= m.start() < b for a, b in kept):
                line = line[: m.end() - 1]
                break
        out.append(line)
    return "\n".join(out)


def comment_spans(text: str) -> list[tuple[int, int]]:
    """Where the comments of a text stand, as strip_comments leaves them out: from the sign to the line's end."""
    out, at = [], 0
    for line, kept in zip(text.split("\n"), strip_comments(text).split("\n")):
        if len(kept) < len(line):
            out.append((at + len(kept), at + len(line)))
        at += len(line) + 1
    return out


def conditionals(text: str) -> str:
    """\\iffalse ... \\fi dropped, other conditionals' first branch kept."""
    token = re.compile(r"\\(if[a-zA-Z@]*|else|fi)(?![a-zA-Z@])")
    out, stack, at = [], [], 0
    for m in token.finditer(text):
        if all(stack):
            out.append(text[at : m.start()])
        at = m.end()
        if m[1] == "else":
            if stack:
                stack[-1] = not stack[-1]
        elif m[1] == "fi":
            if stack:
                stack.pop()
        elif m[1] not in ("iff", "ifx@"):
            stack.append(m[1] != "iffalse")
            if m[1] not in ("iffalse", "iftrue"):
                rest = re.compile(r"\s*\\?[A-Za-z@]*(?:\s*\\?[A-Za-z@]+)?").match(text, at) if m[1] == "ifx" else None
                at = rest.end() if rest else at
        else:
            at = m.start()
    if all(stack):
        out.append(text[at:])
    return "".join(out)


def expand_inputs(name: str, files: dict[str, str], depth: int = 8, seen: tuple[str, ...] = ()) -> str:
    """A file with its \\input and \\include files in place; cycles and depths beyond `depth` are left out."""
    text = strip_comments(files.get(name, ""))

    def put(m: re.Match) -> str:
        want = m[1].strip()
        folder = name.rpartition("/")[0]
        for c in (want, want + ".tex", f"{folder}/{want}", f"{folder}/{want}.tex"):
            if c in files and c not in (*seen, name) and len(seen) < depth:
                return f"\x02{c}\x03" + expand_inputs(c, files, depth, (*seen, name)) + f"\x02{name}\x03"
        return ""

    return re.sub(r"\\(?:input|include|subfile)\s*\{([^}]*)\}", put, text)


def main_file(files: dict[str, str]) -> str | None:
    """The file that is compiled: with a document class and a body, usually named main, shallow, long."""
    rank = lambda n: ("\\documentclass" in files[n], "\\begin{document}" in files[n], n.rpartition("/")[2] in ("main.tex", "paper.tex", "ms.tex"), -n.count("/"), len(files[n]), n)
    tex = [n for n in files if n.endswith(".tex")]
    return max(tex, key=rank) if tex else None


def macros_of(text: str) -> dict[str, tuple[int, str]]:
    """\\newcommand, \\renewcommand, \\providecommand and \\def: name -> (arguments, body)."""
    out = {}
    for m in re.finditer(r"\\(?:re|provide)?(?:newcommand|command)\*?\s*\{?\\([A-Za-z@]+)\}?\s*(?:\[(\d)\])?(?:\[[^\]]*\])?\s*(?=\{)|\\def\s*\\([A-Za-z@]+)((?:#\d)*)\s*(?=\{)", text):
        end = closing(text, m.end())
        out[m[1] or m[3]] = (int(m[2] or len(m[4] or "") // 2), text[m.end() + 1 : end - 1])
    return out


def settled(macros: dict[str, tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """The macros whose bodies never lead back to themselves, so that expansion ends; the others stay as they are written."""
    names = {n: {m for m in re.findall(r"\\([A-Za-z@]+)", body) if m in macros} for n, (_, body) in macros.items()}
    known: dict[str, bool] = {}

    def ends(name: str, path: frozenset) -> bool:
        if name in path:
            return False
        if name not in known:
            known[name] = all(ends(n, path | {name}) for n in names[name])
        return known[name]

    return {n: m for n, m in macros.items() if ends(n, frozenset())}


def aliases_of(text: str, macros: dict[str, tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """\\let\\new\\old: the new name for a macro, or for any other command."""
    return {m[1]: macros.get(m[2], (0, f"\\{m[2]} ")) for m in re.finditer(r"\\let\s*\\([A-Za-z@]+)\s*=?\s*\\([A-Za-z@]+)", text) if m[1] != m[2]}


def expand_macros(text: str, macros: dict[str, tuple[int, str]], most: int = 64_000_000) -> str:
    """Every macro in place of its name, until none is left; a text that would grow beyond `most` letters is refused."""
    macros = settled(macros)
    if not macros:
        return text
    call = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])")
    while True:
        out, at, changed = [], 0, False
        for m in call.finditer(text):
            if m.start() < at:
                continue
            count, body = macros[m[1]]
            i, args = m.end(), []
            for _ in range(count):
                while i < len(text) and text[i].isspace():
                    i += 1
                if i < len(text) and text[i] == "{":
                    end = closing(text, i)
                    args.append(text[i + 1 : end - 1])
                    i = end
            for n, a in enumerate(args, 1):
                body = body.replace(f"#{n}", a)
            out += [text[at : m.start()], body]
            at, changed = i, True
        text = "".join(out) + text[at:]
        if not changed:
            return text
        if len(text) > most:
            raise ValueError("macros unfold beyond bounds")


def placed(text: str, numbers: dict[str, int] | None = None, names: dict[str, tuple[list[str], str]] | None = None) -> tuple[str, list[dict]]:
    """Readable text, and where each citation stands in it with its keys."""
    cites: list[list[str]] = []

    def hide(m: re.Match) -> str:
        cites.append([k.strip() for k in m[1].split(",") if k.strip()])
        return f"\uE000{chr(0xF0000 + len(cites) - 1)}\uE001" if len(cites) < 60_000 else m[0]

    shown = render(CITE.sub(hide, text), numbers, names)
    out, marks, at, size = [], [], 0, 0
    for m in re.finditer("\uE000(.)\uE001", shown):
        keys = cites[ord(m[1]) - 0xF0000]
        raw = visible(keys, numbers, names)
        out += [shown[at : m.start()], raw]
        size += m.start() - at
        marks.append({"start": size, "end": size + len(raw), "keys": keys})
        size, at = size + len(raw), m.end()
    return "".join(out) + shown[at:], marks


def visible(keys: list[str], numbers: dict[str, int] | None, names: dict[str, tuple[list[str], str]] | None) -> str:
    if names:
        return "(" + "; ".join(f"{names_of(names[k][0])}, {names[k][1]}" for k in keys if k in names) + ")"
    return "[" + ", ".join(str(numbers.get(k, k)) if numbers else k for k in keys) + "]"


def render(text: str, numbers: dict[str, int] | None = None, names: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Readable text: citations as [n], or as (Name, year) where names are given, math flattened, commands dropped."""

    def cite(m: re.Match) -> str:
        return visible([k.strip() for k in m[1].split(",") if k.strip()], numbers, names)

    text = CITE.sub(cite, text)
    text = re.sub(r"\$\$?(.+?)\$\$?|\\\((.+?)\\\)|\\\[(.+?)\\\]", lambda m: flat_math(next(g for g in m.groups() if g)), text, flags=re.S)
    text = re.sub(r"\\(?:label|vspace|hspace|includegraphics|bibliographystyle|bibliography|usepackage|pagestyle|thispagestyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:eq)?ref\*?\{([^{}]*)\}", r"\1", text)
    for _ in range(6):
        text, n = re.subn(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
        if not n:
            break
    text = re.sub(r"\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}", " ", text)
    text = text.replace("~", " ").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    text = re.sub(r"\\([%&#_${}])", "\x01\\1", text)
    text = re.sub(r"\\[a-zA-Z]+\*?|\\.|[{}]", " ", re.sub("\x01([{}])", lambda m: {"{": "\x04", "}": "\x05"}[m[1]], text))
    return re.sub(r"\s+", " ", text.replace("\x01", "").replace("\x04", "{").replace("\x05", "}")).strip()


def flat_math(s: str) -> str:
    s = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", s)
    return re.sub(r"[{}\\]", "", re.sub(r"\\(?:mathrm|mathbf|text|left|right|,|;|!)", "", s)).strip()


def names_of(authors: list[str]) -> str:
    return authors[0] if len(authors) == 1 else " & ".join(authors) if len(authors) == 2 else f"{authors[0]} et al." if authors else ""


def citation_style(source: str) -> str:
    """author_year or numeric: what packages and commands say, most telling first."""
    if re.search(r"\\usepackage\[[^\]]*(?:numbers|numeric)[^\]]*\]\{(?:natbib|biblatex)\}", source):
        return "numeric"
    if re.search(r"\\usepackage\[[^\]]*(?:authoryear|style=apa)[^\]]*\]\{(?:natbib|biblatex)\}|\\bibliographystyle\{(?:apalike|plainnat|abbrvnat|acl_natbib|chicago)", source):
        return "author_year"
    return "author_year" if len(re.findall(r"\\citet|\\citep|\\textcite", source)) > len(re.findall(r"\\cite\{", source)) else "numeric"


def table_rows(body: str) -> list[list[tuple[str, int, bool]]]:
    """Rows of a tabular body as (text, columns, header): cut at \\\\ and &, outside braces; rows before the first inner rule are headers."""
    rules = [m.start() for m in re.finditer(r"\\(?:midrule|hline)", body)]
    first_rule = rules[1] if len(rules) > 2 and "\\hline" in body else rules[0] if rules else -1
    rows, at = [], 0
    for m in re.finditer(r"\\\\(?:\[[^\]]*\])?|\Z", body):
        line = re.sub(r"\\(?:toprule|midrule|bottomrule|hline|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\})", " ", body[at : m.start()])
        cells, depth, last = [], 0, 0
        for i, c in enumerate(line + "&"):
            depth += (c == "{") - (c == "}")
            if c == "&" and not depth and (not i or (line + "&")[i - 1] != "\\"):
                part = line[last:i].strip()
                span = re.match(r"\\multicolumn\{(\d+)\}\{[^}]*\}\s*\{", part)
                inner = part[span.end() : closing(part, span.end() - 1) - 1] if span else part
                cells.append((render(inner), int(span[1]) if span else 1, m.start() < first_rule))
                last = i + 1
        if any(t for t, _, _ in cells):
            rows.append(cells)
        at = m.end()
    return rows


def blocks(source: str, main: str, numbers: dict[str, int] | None = None, names: dict[str, tuple[list[str], str]] | None = None) -> list[tuple[str, int | None, str, list[str], str, int, list[dict]]]:
    """(kind, level, text, keys, file, line, marks) of headings, paragraphs, captions, cells and list items in order."""
    preamble = source.partition("\\begin{document}")[0]
    macros = macros_of(preamble)
    macros = aliases_of(preamble, macros) | macros
    body = source.partition("\\begin{document}")[2] or source
    body = body.partition("\\end{document}")[0]
    body = expand_macros(conditionals(body), macros)
    out: list = []
    file, line, tables = main, 1, -1

    def put(kind: str, level: int | None, raw: str) -> None:
        nonlocal file, line
        began = None
        for m in re.finditer("\x02([^\x03]*)\x03|\n|([^\\s\x02]+)", raw):
            if m[1]:
                file, line = m[1], 1
            elif m[2]:
                began = began or (file, line)
            else:
                line += 1
        raw = re.sub("\x02[^\x03]*\x03", "", raw)
        keys = [k.strip() for m in CITE.finditer(raw) for k in m[1].split(",") if k.strip()]
        text, marks = placed(raw, numbers, names)
        if text:
            out.append((kind, level, text, keys, *(began or (file, line)), marks))

    piece = re.compile(r"\\(" + "|".join(HEADINGS) + r")\*?\s*(?:\[[^\]]*\])?\s*\{|\\begin\{(" + "|".join(map(re.escape, FLOATS)) + r")\}|\\begin\{(thebibliography)\}|\n[ \t]*\n\s*|\\item\b")
    at = 0
    while True:
        m = piece.search(body, at)
        put("paragraph", None, body[at : m.start() if m else len(body)])
        if not m:
            break
        if m[1]:
            end = closing(body, m.end() - 1)
            put("heading", HEADINGS[m[1]], body[m.end() : end - 1])
        elif m[2] or m[3]:
            stop = body.find(f"\\end{{{m[2] or m[3]}}}", m.end())
            stop = len(body) if stop < 0 else stop
            inner = body[m.end() : stop]
            if m[2]:
                for k in re.finditer(r"\\caption\*?\s*(?:\[[^\]]*\])?\s*\{", inner):
                    put("caption", None, inner[k.end() : closing(inner, k.end() - 1) - 1])
                for t in re.finditer(r"\\begin\{tabular[x*]?\}(?:\{[^{}]*\})?\s*\{(?:[^{}]|\{[^{}]*\})*\}(.*?)\\end\{tabular[x*]?\}", inner, re.S):
                    tables += 1
                    for r, row in enumerate(table_rows(t[1])):
                        column = 0
                        for text, span, header in row:  # where a cell stands goes with its keys
                            out.append(("header" if header else "cell", span, text, [f"t{tables}", str(r), str(column)], file, line, []))
                            column += span
            else:
                for k in re.finditer(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}(.*?)(?=\\bibitem|\Z)", inner, re.S):
                    out.append(("bibitem", None, render(k[2]), [k[1].strip()], file, line, []))
            line += inner.count("\n")
            end = body.find("}", stop) + 1 or len(body)
        else:
            line += m[0].count("\n")
            end = m.end()
        at = end
    return out


def raw_of(fields: dict[str, str]) -> str:
    """A bibliography line made of an entry's fields."""
    if "raw" in fields:
        return fields["raw"]
    plain = lambda k: render(fields.get(k, ""))
    authors = ", ".join(" ".join(reversed([x.strip() for x in a.split(",", 1)])) for a in re.split(r"\s+and\s+", plain("author")) if a)
    volume = plain("volume") + (f"({plain('number')})" if fields.get("number") else "") + (f":{plain('pages')}" if fields.get("pages") else "")
    place = ", ".join(x for x in (plain("journal") or plain("journaltitle") or plain("booktitle") or plain("publisher"), volume, plain("year") or plain("date")[:4]) if x)
    return ". ".join(x for x in (authors, plain("title"), place, f"doi:{fields['doi']}" if fields.get("doi") else "") if x) + "."


def assembled(files: dict[str, str], listed: list[tuple[str, str]], cited: list[str]) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of a project's entries in the order of its list: the list in the text, else what the .bbl file
    typeset, else the .bib entries in order of first citation, and last those nobody cites. A key counts once; fields of the
    .bib file join what the list only has as a line."""
    bib: dict[str, tuple[str, dict[str, str]]] = {}
    typeset: list[tuple[str, dict[str, str]]] = []
    for name in sorted(files):
        if name.endswith(".bib"):
            for key, kind, fields, _ in entries(files[name]):
                bib.setdefault(key, (kind, fields))
        elif name.endswith(".bbl"):
            typeset += [(key, fields) for key, _, fields, _ in bbl_items(files[name])]
    order = [(k, {"raw": raw}) for k, raw in listed] or typeset or [(k, {}) for k in dict.fromkeys(cited) if k in bib]
    order += [(k, {}) for k in bib]
    out: dict[str, tuple[str, dict[str, str]]] = {}
    for key, fields in order:
        out.setdefault(key, (bib.get(key, ("bibitem", {}))[0], {**bib.get(key, ("", {}))[1], **fields}))
    return [(k, t, f) for k, (t, f) in out.items()]


def parse_project(project: str, files: dict[str, str]) -> pd.DataFrame:
    """Blocks of a project and, as kind entry, its bibliography; citations show numbers or names as its style says."""
    main = main_file(files)
    columns = ["project", "ix", "kind", "level", "text", "keys", "file", "line", "marks", "entry_type", "fields"]
    rows: list[tuple] = []
    if main:
        source = expand_inputs(main, files)
        try:
            first = blocks(source, main)
        except ValueError:
            first = [("unreadable", None, None, [], main, 1, [])]
        cited = [k for r in first for m in r[6] for k in m["keys"]]
        found = assembled(files, [(r[3][0], r[2]) for r in first if r[0] == "bibitem"], cited)
        numbers = {k: n for n, (k, _, _) in enumerate(found, 1)}
        years = {k: f.get("year") or f.get("date", "")[:4] for k, _, f in found}
        names = {k: ([surname(re.sub(r"[{}]", "", a)) for a in re.split(r"\s+and\s+", f["author"])], years[k]) for k, _, f in found if f.get("author") and years[k]}
        dated = citation_style(source) == "author_year" and set(cited) & set(names)
        typed = any(name.endswith((".bib", ".bbl")) for name in files)
        again = blocks(source, main, None if dated else numbers, names if dated else None) if typed and found else first
        rows = [(*r, None, None) for r in again] + [("entry", None, raw_of(f), [k], main, 0, [], t, f) for k, t, f in found if typed]
    return pd.DataFrame([(project, i, *r) for i, r in enumerate(rows)], columns=columns).astype({"ix": "int32", "level": "Int32", "line": "int32"})


def archive_files(data: bytes, most: int = 64 << 20) -> dict[str, str]:
    """Text files of a .tar.gz, without links, absolute or upward paths, up to `most` bytes in all."""
    out, size = {}, 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/") and m.name.endswith((".tex", ".bib", ".bbl")):
                size += m.size
                if size > most:
                    raise ValueError("archive too large")
                out[m.name] = t.extractfile(m).read().decode("utf-8", "replace")
    return out


def read_latex(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all LaTeX projects at path, and their entries: a folder below it is a project, as is a .tar.gz file.

    A project's files are one group, which one task reads: includes need them together. Projects without a .tex file
    give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tex,bib,bbl,gz}").load(path).select("path", "content")
    inner = F.substring_index("path", path.removeprefix("file:").rstrip("/") + "/", -1)
    rows = files.withColumn("name", inner).withColumn("project", F.substring_index("name", "/", 1))

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        project = pdf["project"].iloc[0]
        found: dict[str, str] = {}
        for name, content in zip(pdf["name"], pdf["content"]):
            if name.endswith(".gz"):
                found |= archive_files(content)
            else:
                found[name.partition("/")[2] or name] = content.decode("utf-8", "replace")
        return parse_project(project, found)

    return rows.select("project", "name", "content").groupBy("project").applyInPandas(parse, DDL)
