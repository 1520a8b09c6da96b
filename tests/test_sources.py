import io
import tarfile
import zipfile

from quire.sources import bib, docx, latex, manuscripts

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(path):
    body = """<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>Kept 中文 </w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:r><w:t>text</w:t><w:footnoteReference w:id="2"/></w:r></w:p>
    <w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> ADDIN CITE x </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>[1]</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
    <w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>head</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="own"/><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>A note.</w:t></w:r></w:p></w:footnote></w:footnotes>')


def test_docx(spark, tmp_path):
    make_docx(tmp_path / "a.docx")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, str(tmp_path))
    got = {r.para_ix: r for r in rows.where("path LIKE '%a.docx' AND para_ix >= 0").collect()}
    assert got[0].level == 2 and got[0].text == "Results"
    assert got[1].text == "Kept 中文 text" and (got[1].num_id, got[1].num_level) == (3, 1) and got[1].note_ids == ["f2"]
    assert got[2].text == "[1]" and got[2].field == "ADDIN CITE x"
    assert got[3].cell.colspan == 2 and got[3].cell.header and got[4].cell.col_ix == 2
    assert [(r.para_ix, r.text) for r in docx.notes_of(rows).where("note_id = 'f2'").collect()] == [(1, "A note.")]
    assert rows.where("style = 'unreadable'").count() == 1


def test_numerals(spark):
    df = spark.createDataFrame([(1,), (4,), (27,), (1994,)], "n int").select("n", docx.roman(docx.F.col("n")).alias("r"), docx.letters(docx.F.col("n")).alias("l"))
    assert {r.n: (r.r, r.l) for r in df.collect()}[27] == ("xxvii", "aa")
    assert {r.n: r.r for r in df.collect()}[1994] == "mcmxciv"


def test_bib(spark, tmp_path):
    text = '@comment{x}\n@Article{k1, title = {A {Nested} Title}, year = 2020, author = "B" # " C",\n}\n@string{s = "x"}\n@book{k2, title={T}}'
    assert [(k, t, f.get("title"), f.get("author")) for k, t, f, _ in bib.entries(text)] == [("k1", "article", "A {Nested} Title", "B C"), ("k2", "book", "T", None)]
    (tmp_path / "a.bib").write_text(text)
    (tmp_path / "b.bbl").write_text(r"\begin{thebibliography}{1}\bibitem[x]{k3} Some \emph{raw} text.\end{thebibliography}")
    (tmp_path / "empty.bib").write_text("")
    got = {r.key: r.fields for r in bib.read_bib(spark, str(tmp_path)).collect()}
    assert set(got) == {"k1", "k2", "k3"} and got["k3"]["raw"] == "Some raw text."


def test_latex_parts():
    assert latex.strip_comments(r"a \% b % c" + "\n" + r"\verb|%| x % y") == "a \\% b \n\\verb|%| x "
    assert latex.conditionals(r"a\iffalse b\else c\fi d\iftrue e\else f\fi") == "a c d e"
    files = {"main.tex": r"\documentclass{a}\begin{document}\input{s}\end{document}", "s.tex": r"S \input{main} \input{s}"}
    assert latex.main_file(files) == "main.tex"
    assert "S" in latex.expand_inputs("main.tex", files)
    assert latex.expand_macros(r"\x{q} \y", {"x": (1, "<#1>"), "y": (0, r"\x{z}")}) == "<q> <z>"
    assert latex.render(r"As \emph{shown} in~\cite[p.~3]{a, b}, $x_{1}$ is 5\,\% -- ok.", {"a": 1, "b": 2}) == "As shown in [1, 2], x_1 is 5 % – ok."
    assert latex.render(r"\citep{a}", names={"a": (["X", "Y", "Z"], "2020")}) == "(X et al., 2020)"
    assert latex.citation_style(r"\usepackage[numbers]{natbib}\citep{a}") == "numeric" and latex.citation_style(r"\citet{a}\citep{b}") == "author_year"
    rows = latex.table_rows(r"\toprule A & \multicolumn{2}{c}{B \& C} \\ \midrule 1 & 2 & 3 \\ \bottomrule")
    assert [[(t, s, h) for t, s, h in r] for r in rows] == [[("A", 1, True), ("B & C", 2, True)], [("1", 1, False), ("2", 1, False), ("3", 1, False)]]


def test_latex_projects(spark, tmp_path):
    p = tmp_path / "one"
    p.mkdir()
    (p / "main.tex").write_text("\\documentclass{article}\\newcommand{\\me}[1]{we #1}\n\\begin{document}\n\\section{Intro}\nFirst \\me{say} \\cite{a,b}.\n\n\\input{more}\n\\begin{figure}\\caption{A cap \\cite{c}}\\end{figure}\n\\begin{thebibliography}{9}\\bibitem{a} Raw A.\\end{thebibliography}\\end{document}")
    (p / "more.tex").write_text("Second. % no\n")
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        info = tarfile.TarInfo("m.tex")
        body = b"\\begin{document}Tar text.\\end{document}"
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
        evil = tarfile.TarInfo("../x.tex")
        t.addfile(evil, io.BytesIO(b""))
    (tmp_path / "two.tar.gz").write_bytes(data.getvalue())
    got = [(r.project, r.kind, r.text, r["keys"]) for r in latex.read_latex(spark, str(tmp_path)).orderBy("project", "ix").collect()]
    assert got == [("one", "heading", "Intro", []), ("one", "paragraph", "First we say [a, b].", ["a", "b"]), ("one", "paragraph", "Second.", []), ("one", "caption", "A cap [c]", ["c"]), ("one", "bibitem", "Raw A.", ["a"]), ("two.tar.gz", "paragraph", "Tar text.", [])]
    assert [r.file for r in latex.read_latex(spark, str(tmp_path)).where("text = 'Second.'").collect()] == ["more.tex"]


def test_sink(spark, tmp_path):
    from quire.sources import sink

    files = spark.createDataFrame([("a.tex", "one\ntwo\nthree"), ("b.tex", "x"), ("c.tex", None)], "path string, text string")
    found = spark.createDataFrame([("a.tex", 2, "check\nthis"), ("a.tex", 2, "and"), ("a.tex", 99, "end"), ("c.tex", 1, None)], "path string, line int, message string")
    got = {r.path: r for r in sink.annotate(files, found).collect()}
    assert got["a.tex"].text.split("\n") == ["one", "% NOTE: and", "% NOTE: check this", "two", "three", "% NOTE: end"]
    assert sink.uncomment(got["a.tex"].text) == "one\ntwo\nthree" and "+% NOTE: and" in got["a.tex"].diff and set(got) == {"a.tex", "c.tex"}
    (tmp_path / "v.toml").write_text('id = "v"\nname = "Venue"\naliases = ["V."]\n[rules]\nmin_refs = 8\n')
    (tmp_path / "w.json").write_text('{"name": "W"}')
    (tmp_path / "bad.json").write_text("{")
    assert [(r.id, r.aliases, r.rules) for r in sink.registry(spark, str(tmp_path)).orderBy("id").collect()] == [("v", ["V."], '{"min_refs": 8}'), ("w", [], "{}")]


def word_file(path, paragraphs, numbering=True):
    """paragraphs: text, or (text, style), or raw XML of a paragraph's inside."""
    def para(p):
        if isinstance(p, str) and p.startswith("<"):
            return f"<w:p>{p}</w:p>"
        text, style = p if isinstance(p, tuple) else (p, None)
        return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(map(para, paragraphs))}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {NS}><w:footnote w:id="4"><w:p><w:r><w:t>Park, C. (2011). A study of slow tides. Sea Letters, 4(1), 1-9.</w:t></w:r></w:p></w:footnote></w:footnotes>')
        levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate((("decimal", "[%1]"), ("lowerRoman", "%1.%2"), ("upperLetter", "%3)"))))
        z.writestr("word/numbering.xml", f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/></w:num></w:numbering>')


def listed(text, level=0):
    return f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r>'


def raised(before, mark):
    return f'<w:r><w:t>{before}</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>{mark}</w:t></w:r>'


def test_auto_numbers():
    xml = io.BytesIO()
    word_file(xml, [])
    n = docx.Numbering(zipfile.ZipFile(xml).read("word/numbering.xml"))
    assert [n.label(3, x) for x in (0, 1, 1, 0, 1, 2, 2)] == ["[1]", "1.i", "1.ii", "[2]", "2.i", "A)", "B)"] and n.label(9, 0) is None
    assert [docx.spelled(28, s) for s in ("lowerLetter", "upperRoman", "decimalZero", "decimal")] == ["bb", "XXVIII", "28", "28"]


def test_manuscripts(spark, tmp_path):
    from quire.plans import checks, joins

    word_file(tmp_path / "a.docx", [
        "A study of tides", raised("Ann Lee", "1,2"), ("Introduction", "H1"), "Tides rise slowly [1, 3]. Others differ (Kim, 2003).", raised("They fall", "2"), '<w:r><w:t>As noted</w:t></w:r><w:r><w:footnoteReference w:id="4"/></w:r><w:r><w:t>.</w:t></w:r>', "Table 1. Depths", ("Methods", "H1"), "No mark here [9].",
        ("References", "H1"), listed("Lee, A. (2001). On slow tides. Sea Letters, 1(2), 3-9."), listed("Moe, D. (2002). On fast tides. Sea Letters, 1(2), 3-9."), listed("Kim, B. (2003). On tides in general. Sea Letters, 2(2), 3-9."),
    ])
    word_file(tmp_path / "plain.docx", ["1 Introduction", "Text without styles (Lee et al., 2001).", "2.1 Details", "More.", "3. Results were found, and they were many.", "[1] Lee A. A first work[J]. Sea, 2001.", "[2] Kim B. A second work[J]. Sea, 2002.", "[3] Moe C. A third work[J]. Sea, 2003."])
    p = tmp_path / "tex"
    p.mkdir()
    (p / "main.tex").write_text("\\documentclass{article}\\let\\say\\emph\\newcommand{\\loop}{\\loop}\n\\begin{document}\n\\section{Introduction}\nTides \\say{rise} \\cite{b,a}. Then \\cite{c} \\loop.\n\\begin{table}\\caption{Cap}\\begin{tabular}{l}x\\\\\\end{tabular}\\end{table}\\bibliography{r}\\end{document}")
    (p / "r.bib").write_text("@article{a, author={Lee, Ann}, title={On tides}, journal={Sea}, year={2001}}\n@book{b, author={Kim, Bo and Moe, C.}, title={Tides}, year=2002}\n@misc{unused, title={None}}")
    q = tmp_path / "blx"
    q.mkdir()
    (q / "m.tex").write_text("\\begin{document}Seen \\citep{k}.\\end{document}")
    (q / "m.bbl").write_text("\\entry{k}{article}{}\\name{author}{1}{}{{{hash=1}{family={Park}, given={C.}}}}\\field{title}{Slow tides}\\field{year}{2011}\\endentry")
    tables = manuscripts.read_manuscripts(spark, str(tmp_path))
    folder = str(tmp_path / "out")
    manuscripts.write_tables(tables, folder)
    t = {n: [r.asDict() for r in spark.read.parquet(f"{folder}/{n}.parquet").collect()] for n in tables}
    texts = {r["para_id"]: r["text"] for r in t["paragraphs"]}
    assert all(texts[m["para_id"]][m["start_pos"] : m["end_pos"]] == m["raw"] for m in t["markers"])
    got = {(m["doc_id"], m["raw"], m["kind"]): m["ref_ids"] for m in t["markers"]}
    assert got["a.docx", "[1, 3]", "numeric"] == ["a.docx#r1", "a.docx#r3"] and got["a.docx", "(Kim, 2003)", "author_year"] == ["a.docx#r3"] and got["a.docx", "2", "superscript"] == ["a.docx#r2"]
    assert got["a.docx", "", "footnote"] == ["a.docx#r100001"] and got["a.docx", "[9]", "numeric"] == [] and ("a.docx", "1,2", "superscript") not in got
    assert got["plain.docx", "(Lee et al., 2001)", "author_year"] == ["plain.docx#r1"]
    assert got["tex", "[1, 2]", "numeric"] == ["tex#r1", "tex#r2"] and got["tex", "[c]", "numeric"] == []
    assert got["blx", "(Park, 2011)", "author_year"] == ["blx#r1"]
    assert {(s["doc_id"], s["title"], s["canonical"]) for s in t["sections"]} == {("a.docx", None, "other"), ("a.docx", "Introduction", "intro"), ("a.docx", "Methods", "method"), ("a.docx", "References", "other"), ("plain.docx", "1 Introduction", "intro"), ("tex", "Introduction", "intro"), ("blx", None, "other")}
    assert {r["text"] for r in t["paragraphs"] if r["is_caption"]} == {"Table 1. Depths", "Cap"} and [r["text"] for r in t["paragraphs"] if r["cell"]] == ["x"]
    entries = {(r["doc_id"], r["pos"]): (r["title"], r["year"], r["key"]) for r in t["reference_entries"]}
    assert entries["a.docx", 3] == ("On tides in general", 2003, None) and entries["tex", 1][2] == "b" and {r["key"] for r in t["bib_entries"]} == {"a", "b", "unused", "k"}
    assert {(r.marker_id.split("#")[0], r.number) for r in joins.unresolved_numbers(spark, folder).collect()} == {("a.docx", 9)}
    rules = {(r.rule, r.doc_id): r.n for r in checks.findings(spark, folder).collect()}
    assert rules["unresolved_marker", "a.docx"] == 1 and rules["uncited_entry", "tex"] == 1 and ("uncited_entry", "a.docx") not in rules
    (tmp_path / "none").mkdir()
    assert all(d.count() == 0 for d in manuscripts.read_manuscripts(spark, str(tmp_path / "none")).values())


def test_macros_end():
    deep = {f"m{i}": (0, f"\\m{i + 1} x") for i in range(12)} | {"m12": (0, "end")}
    deep = {k.translate(str.maketrans("0123456789", "abcdefghij")): (n, b.translate(str.maketrans("0123456789", "abcdefghij"))) for k, (n, b) in deep.items()}
    assert latex.expand_macros("\\ma", deep) == "end" + " x" * 12
    assert latex.expand_macros("\\a \\c", {"a": (0, "\\b"), "b": (0, "\\a"), "c": (0, "ok")}) == "\\a ok"


def test_folders(spark, tmp_path):
    import os

    from quire.sources import folders

    def put(path, at=0):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
        os.utime(f, (1_000_000 + at, 1_000_000 + at))

    for path, at in (("a/old.docx", 1), ("a/new.docx", 5), ("a/cover letter.docx", 9), ("a/~lock.docx", 9), ("a/refs/1.pdf", 0), ("b/main.tex", 0), ("b/x/1.pdf", 0), ("b/x/2.pdf", 0), ("b/x/3.pdf", 0), ("c/response.docx", 0), ("c/some/1.pdf", 0), ("c/some/2.pdf", 0), ("c/some/deep/3.pdf", 0), ("d/notes.txt", 0)):
        put(path, at)
    got = {r.folder: (r.kind, r.paper and r.paper.rpartition("/")[2], r.library, [o.rpartition("/")[2] for o in r.others]) for r in folders.folder_layout(spark, str(tmp_path)).collect()}
    assert got == {"a": ("docx", "new.docx", "refs", ["cover%20letter.docx", "old.docx"]), "b": ("tex", "b", None, []), "c": ("docx", "response.docx", "some", []), "d": ("unknown", None, None, [])} or got["a"][3] == ["cover letter.docx", "old.docx"]


def test_tracked(spark, tmp_path):
    f = io.BytesIO()
    word_file(f, ["The helllo world", '<w:r><w:t>One </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r><w:r><w:t> three</w:t></w:r>', "Kept"])
    data = f.getvalue()
    edits = [(0, 4, 10, "hello"), (0, 16, 16, "!"), (1, 2, 6, "x"), (1, 8, 13, ""), (7, 0, 1, "no")]
    done = docx.tracked(data, edits)
    assert [r["text"] for r in docx.parse("x", done)][:3] == ["The hello world!", "Onxo ", "Kept"]
    assert docx.rejected(done)[:3] == [r["text"] for r in docx.parse("x", data)][:3]
    (tmp_path / "a.docx").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = files.first().path
    wanted = spark.createDataFrame([(path, *e) for e in edits], "path string, para_ix int, start int, end int, new string")
    assert docx.write_tracked(files, wanted).first().content[:2] == b"PK"


def test_latex_places(spark, tmp_path):
    text = "a % one\n\\% b % two\nc"
    assert [text[a:b] for a, b in latex.comment_spans(text)] == ["% one", "% two"]
    from quire.sources import sink

    body = "x\n\\begin{figure}\n\\begin{tabular}{l}\ny\n\\end{tabular}\n\\end{figure}\nz"
    new, _ = sink.note(body, [4, 7], ["in", "out"], "p")
    assert new.split("\n")[1] == "% NOTE: in" and new.split("\n")[-2] == "% NOTE: out" and sink.uncomment(new) == body
    p = tmp_path / "one"
    p.mkdir()
    (p / "m.tex").write_text("\\begin{document}\\begin{table}\\begin{tabular}{lll}a & \\multicolumn{2}{c}{b} \\\\ c & d & e \\\\\\end{tabular}\\end{table}\\end{document}")
    cells = manuscripts.latex_tables(latex.read_latex(spark, str(tmp_path)))["paragraphs"].collect()
    assert [(r.text, r.cell.table_id, r.cell.row_ix, r.cell.col_ix, r.cell.colspan) for r in sorted(cells, key=lambda r: r.para_ix)] == [("a", "t0", 0, 0, 1), ("b", "t0", 0, 1, 2), ("c", "t0", 1, 0, 1), ("d", "t0", 1, 1, 1), ("e", "t0", 1, 2, 1)]
