import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import fuzzy
from quire.functions import text as T
from quire.operators import entities, evidence, intervals, layout, orphans, quantities, retrieval, sequences, statistics, store


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def one(spark, expression, **values):
    return spark.createDataFrame([Row(**values)]).select(expression.alias("x")).first().x


def test_text(spark):
    c = F.col("s")
    assert one(spark, T.count_words(c), s="Two words 中文字 x2") == 6
    assert one(spark, T.squash(c), s="Ab-1 中！") == "ab1中"
    assert one(spark, T.clean_page(c), s="re-\nmade\n 中\n文 　ＡＢ  x") == "remade 中文 　AB x"
    assert one(spark, T.marker_numbers(c), s="[1, 3-5, 9–8]") == [1, 3, 4, 5, 8, 9]
    assert [tuple(x) for x in one(spark, T.author_year_items(c), s="(Lee et al., 2019a; 王, 2020)")] == [("Lee et al.", 2019, "a"), ("王", 2020, "")]
    assert one(spark, T.tokens(c), s="A中文字b") == ["a", "中文", "文字", "b"]
    assert one(spark, T.reference_type(c), s="X[J]. Y") == "journal" and one(spark, T.reference_type(c), s="Proceedings of Z") == "conference"
    assert one(spark, T.title_prefix(F.col("a"), F.col("b")), a="one two three four", b="One two three four: five") is False
    assert one(spark, T.title_prefix(F.col("a"), F.col("b")), a="one two three four", b="One two three four five") is True
    assert one(spark, T.year_only_difference(F.col("a"), F.col("b")), a="VOT2014 results", b="VOT2010 results") is True
    assert one(spark, T.too_short(c), s="Following earlier work") is True
    assert one(spark, T.edit_class(F.col("a"), F.col("b")), a="a b", b="ab") == "space"
    nothing = spark.createDataFrame([(None,), ("",)], "s string")
    for f in (T.count_words, T.entry_language, T.squash, T.clean_page, T.good_abstract, T.tokens, T.reference_type, T.marker_numbers, T.author_year_items, T.table_fragment, T.too_short, T.own_contribution, T.id_year, T.title_kind, T.clean_venue):
        assert len(nothing.select(f(c)).collect()) == 2


def test_fuzzy(spark):
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc中") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert fuzzy.common(a, b) == slow(a, b)
    assert fuzzy.ratio("", "") == 100 and fuzzy.sorted_ratio("b a", "a b") == 100 and fuzzy.partial_ratio("bc", "abcd") == 100
    assert [fuzzy.surname(x) for x in ("Devlin, J.", "Devlin J. M.", "Jacob Devlin", "Aaron van den Oord", "van Atteveldt W", "王小明", "")] == ["Devlin", "Devlin", "Devlin", "van den Oord", "van Atteveldt", "王小明", ""]
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.ratio_udf("a", "b")).collect()] == [200 * 2 / 6, None]


def test_names():
    for name, want in {"Devlin J. M.": "Devlin", "LEE A": "LEE", "J. LEE": "LEE", "A. Lee": "Lee", "van den Oord": "van den Oord", "Maria del Carmen": "del Carmen", "王 小": "小", " Smith ,J": "Smith", "K": "K"}.items():
        assert fuzzy.surname(name) == want


def test_conflicts(spark):
    said = [
        ("accuracy reached 91 points on the reading benchmark", "accuracy reached 81 points on the reading benchmark", (91.0, 81.0)), ("accuracy reached 91 points on the reading benchmark", "accuracy reached 90.9 points on the reading benchmark", None),
        ("accuracy rose 10 points on the reading benchmark", "accuracy rose from 81 points to 91 points on the reading benchmark", None), ("they followed 1,200 patients through the whole winter", "they followed 900 patients through the winter of 1999", (1200.0, 900.0)),
        ("they followed 1,200 patients through the whole winter", "they followed 900 nurses through the winter of 1999", None), ("the yield rose by 12% under shallow watering", "shallow watering made the yield fall by 7%", (12.0, 7.0)),
        ("共有120名学生参加了阅读测试", "共有80名学生参加了阅读测试", (120.0, 80.0)), ("twelve of the patients", "20 of the patients", None), (None, "20 of the patients", None), ("20 of the patients", None, None), ("", "", None),
        ("one trial used 6 plots beside the river", "the trial beside the river used 2 plots and later 3 plots", None),
    ]
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b, _) in enumerate(said)], "pair int, claim string, source string, unit string")
    got = {r.pair: (r.claimed, r.given) for r in quantities.conflicts(df.select("pair", "claim", "source")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(said) if w}
    assert rows(quantities.quantities(df.where("pair = 5"), "pair", "claim").select("value", "unit")) == [(12.0, "%")]
    assert quantities.conflicts(df.select("pair", "claim", "source").where("false")).count() == 0


def test_sentence_scalars(spark):
    c = F.col("s")
    for text, want in {
        "Dr. P. Lee came. He left.[3] Then 3.5 m rose, cf. Fig. 2. Done": ["Dr. P. Lee came.", "He left.[3]", "Then 3.5 m rose, cf. Fig. 2.", "Done"], "先做。后做！「停。」走": ["先做。", "后做！", "「停。」", "走"], " \n": [], "": [],
        "He said “It failed.” Then more. small goes on.": ["He said “It failed.”", "Then more. small goes on."], "One?! Two… Three": ["One?!", "Two…", "Three"],
    }.items():
        got = one(spark, T.sentences(c), s=text)
        assert [x.text for x in got] == want and [text[x.start_pos : x.end_pos] for x in got] == want
    assert one(spark, T.sentences(F.lit(None).cast("string")), s="") is None
    kinds = {"2 Related Work": "related", "Methodology": "method", "实验设置": "experiment", "Fazit": "conclusion", "Einleitung": "intro", "Funding": "other", " ": None, "Ergebnisse": "experiment"}
    assert [one(spark, T.heading_kind(c), s=k) for k in kinds] == list(kinds.values())
    assert one(spark, T.fix_page(c), s="ef-\nﬁcient , yes\x07") == "efficient, yes"
    body = "Text of the study. " * 20
    assert one(spark, T.without_tail(c), s=body + "\nReferences\nA, B. 2001.") == body and one(spark, T.without_tail(c), s="x\nReferences\n" + body) == "x\nReferences\n" + body
    assert one(spark, T.list_window(c), s="Lee, A., (2001). On it. J. X, 3(2), 1-9. Kim, B., (2003). Y. doi:10.1000/x") is True and one(spark, T.list_window(c), s=body) is False
    for v, want in ((1234.5, "1235"), (12.0, "12"), (3.14, "3.1"), (0.0312, "0.031"), (0.0, "0"), (None, "–")):
        assert one(spark, T.short_number(F.lit(v).cast("double")), s="") == want
    assert one(spark, T.short_range(F.lit(1.0), F.lit(2.5)), s="") == "1–2.5" and one(spark, T.short_range(F.lit(1.0), F.lit(1.0)), s="") == "1"
    assert one(spark, T.own_contribution(c), s="We propose a method") and not one(spark, T.own_contribution(c), s="We know from earlier work")
    assert one(spark, T.grey_literature(c, F.lit("V"), F.lit(None)), s="Lee (2021, March 3). A page.") is True
    assert one(spark, F.size(T.marker_numbers(c)), s="[1-20000]") == 20_000 and one(spark, T.marker_numbers(c), s="[3-99999999999]") == []


def test_intervals(spark):
    spans = spark.createDataFrame([("p", 0, 5), ("p", 5, 9), ("q", 0, 3), ("p", 7, 7), (None, 0, 3)], "k string, begin int, stop int")
    marks = spark.createDataFrame([("p", 4, 6, 1), ("p", 5, 7, 2), ("r", 0, 1, 3), ("p", None, 3, 4)], "k string, start int, end int, id int")
    assert rows(intervals.contained(marks, spans, "k").select("id", "begin")) == [(2, 5)]
    assert rows(intervals.overlapping(marks, spans, "k").select("id", "begin")) == [(1, 0), (1, 5), (2, 5)]
    got = intervals.as_of(marks.where("id < 4"), spans.withColumnRenamed("stop", "x"), "k", "start", "begin", ["x"])
    assert rows(got.select("id", "x")) == [(1, 5), (2, 9), (3, None)]
    a = spark.createDataFrame([("k", 0, 10, 100)], "k string, a_from int, a_to int, b_from int")
    b = spark.createDataFrame([("k", 95, 104, 0), ("k", 104, 200, 50)], "k string, b_begin int, b_stop int, c_from int")
    assert rows(intervals.compose(a, b, "k")) == [("k", 0, 4, 5), ("k", 4, 10, 50)]
    s = spark.createDataFrame([("p", 0, 4, 1), ("p", 2, 6, 3), ("p", 8, 9, 2), ("p", 3, 3, 9)], "k string, start int, end int, r int")
    assert rows(intervals.elementary(s, "k", F.col("r"))) == [("p", 0, 2, 1, 1), ("p", 2, 4, 3, 2), ("p", 4, 6, 3, 1), ("p", 8, 9, 2, 1)]
    assert rows(intervals.merged(s.drop("r"), "k")) == [("p", 0, 6), ("p", 8, 9)]
    empty = s.where("false")
    assert rows(intervals.merged(empty, "k")) == rows(intervals.elementary(empty, "k", F.col("r"))) == []


def test_sequences(spark):
    n = spark.createDataFrame([("d", x) for x in (1, 2, 3, 3, 7, None)], "k string, n int")
    assert rows(sequences.integer_runs(n, ["k"], "n")) == [("d", 1, 3, 3), ("d", 7, 7, 1)]
    rng = random.Random(2)
    for _ in range(200):
        p = rng.sample(range(9), rng.randint(0, 8))
        keep = [x for x, k in zip(p, sequences.keep_longest(p)) if k]
        best = max((len(s) for m in range(1 << len(p)) if (s := [x for i, x in enumerate(p) if m >> i & 1]) == sorted(s)), default=0)
        assert keep == sorted(keep) and len(keep) == best
    df = spark.createDataFrame([("d", "a", 1, 2), ("d", "b", 2, 1), ("d", "c", 3, 3)], "k string, i string, old int, new int")
    assert len(rows(sequences.moves(df, "k", "i", "old", "new"))) == 1
    h = spark.createDataFrame([("d", i, x) for i, x in enumerate([1, 1, 3, 2, None, 2, 3])], "k string, o int, n int")
    assert [r.accepted for r in sequences.heading_sequence(h, "k", "o", "n").orderBy("o").collect()] == [True, True, False, True, False, True, True]
    c = spark.createDataFrame([("d", i, x) for i, x in enumerate([1, 2, 2, 1, 2, 3])], "k string, o int, l int")
    assert [r.label for r in sequences.counters(c, ["k"], "o", "l").orderBy("o").collect()] == ["1", "1.1", "1.2", "2", "2.1", "2.1.1"]


def test_statistics(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 1.0), ("b", 2.0), ("c", 5.0), ("c", 5.0), ("c", 5.0), ("d", None)], "g string, v double")
    assert rows(statistics.quartiles(v, ["g"], "v")) == [("a", 4, 1.75, 2.5, 3.25)]
    s = spark.createDataFrame([("a", 100), ("b", 50), ("c", 2), ("d", 7)], "s string, n int")
    got = {r.s: r.quota for r in statistics.allocate(s, "s", "n", 30, 5).collect()}
    assert got["c"] == 2 and got["d"] == 5 and got["a"] + got["b"] == 23 and got["a"] in (15, 16)
    u = spark.createDataFrame([(True, True, False), (True, False, False), (False, True, True), (False, True, False), (False, False, False), (None, True, False)], "g boolean, f boolean, b boolean")
    assert statistics.confusion(u, F.col("g"), F.col("f"), F.col("b")).first()[:7] == (1, 1, 1, 1, 1, 0.5, 1 / 3)
    d = spark.createDataFrame([("x", 10, h) for h in (1, 0, 1)] + [("y", 2, 1), ("y", 2, 1)], "s string, n int, h int")
    low, high = statistics.bootstrap(d, "s", "n", "h").first()
    assert 0 < low < (10 * 2 / 3 + 2) / 12 < high <= 1


def test_quantiles(spark):
    rng = random.Random(6)
    data = [("big", float(rng.choice((0, 1, rng.random(), rng.random() * 100)))) for _ in range(6000)] + [("small", float(x)) for x in (4, 1, 3, 2)] + [("one", 7.0), ("none", None)] + [("flat", 2.0)] * 3000
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.n, r.q) for r in statistics.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], accuracy=500).collect()}
    import numpy as np

    for g in ("big", "small", "one", "flat"):
        values = [v for k, v in data if k == g]
        assert got[g][0] == len(values) and np.allclose(got[g][1], np.quantile(values, [0.0, 0.25, 0.5, 0.99, 1.0])), g
    assert "none" not in got and statistics.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0
    assert statistics.exact_quantiles(df.where("g = 'small'"), [], "v", [0.5]).first().q == [2.5]


def test_entities(spark):
    s = spark.createDataFrame([("a", "x", 9.0), ("a", "y", 8.0), ("b", "x", 8.5), ("b", "y", 1.0), ("c", "x", 9.0)], "l string, r string, s double")
    assert rows(entities.assign(s, "l", "r", "s").select("l", "r")) == [("a", "x"), ("b", "y")]
    rng = random.Random(3)
    pairs = [(i, j, float(rng.randint(0, 5))) for i in range(12) for j in range(12) if rng.random() < 0.4]
    want, used = set(), set()
    for i, j, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if ("l", i) not in used and ("r", j) not in used:
            used |= {("l", i), ("r", j)}
            want.add((i, j))
    got = entities.assign(spark.createDataFrame(pairs, "l int, r int, s double"), "l", "r", "s")
    assert {(r.l, r.r) for r in got.collect()} == want
    e = spark.createDataFrame([("r1", "A study of soil moisture", ["Lee, A."], 2019, None, "en"), ("r2", "A study of soil moisture", ["Kim, B."], 2001, None, "en"), ("r3", None, None, None, None, "en")], "ref_id string, title string, authors array<string>, year int, doi string, lang string")
    k = spark.createDataFrame([(1, "A Study of Soil Moisture.", None, ["A. Lee"], 2020, None, None, None)], "record_id bigint, title string, main_title string, authors array<string>, year int, alt_year int, doi string, arxiv_id string")
    found = entities.candidates(e, k)
    assert rows(found.select("ref_id", "record_id")) == [("r1", 1)]
    assert {r.ref_id: r.status for r in entities.statuses(e, found, F.lit(False), 2).collect()} == {"r1": "verified", "r2": "not_found", "r3": "not_found"}
    items = spark.createDataFrame([("d", "m1", "Lee et al.", 2019, ""), ("d", "m2", "Smith", 2019, "")], "doc_id string, marker_id string, names string, year bigint, suffix string")
    assert rows(entities.author_year_links(items, e.withColumn("doc_id", F.lit("d")).withColumn("pos", F.lit(1))).select("marker_id", "ref_id")) == [("m1", "r1")]


def test_evidence(spark):
    s = "The “Ｗorld”  is re-\nmade。 中 文 字 😀 end"
    for want in ('"world" is', "remade", "中文字", "isremade", "😀 END"):
        a, b = evidence.locate(want, s)
        assert evidence.normal(want, False)[0] in evidence.normal(s[a:b].replace("-\n", ""), False)[0]
    assert evidence.locate("absent", s) is None and evidence.locate("", s) is None
    assert s[slice(*evidence.locate_spliced("The ... 中文字", s))].startswith("中")
    assert evidence.locate_spliced("中文 ... The", s) is None
    assert evidence.minimal_edit("the qick fox", "the quick fox") == (4, 8, "quick")
    assert evidence.remove_spans("abcd", [(1, 3)]) == ("ad", [0, 3])
    df = spark.createDataFrame([("b c", "a b  c"), (None, "x")], "e string, s string").select(evidence.locate_udf("e", "s").alias("x"))
    assert [(r.x and r.x.start, r.x and r.x.end) for r in df.collect()] == [(2, 6), (None, None)]


def test_layout(spark):
    g = spark.createDataFrame([("p", float(x), x + 8.0) for x in [*range(0, 90, 10), *range(120, 200, 10)]], "page string, x0 double, x1 double")
    a = layout.gutters(g, "page").first()
    assert 88 <= a["from"] <= 100 and 116 <= a["to"] <= 124
    ch = spark.createDataFrame([("p", "a", 0.0, 5.0, 100.0, 10.0), ("p", "b", 5.0, 10.0, 103.0, 6.0), ("p", "c", 60.0, 65.0, 100.0, 10.0), ("p", "d", 0.0, 5.0, 120.0, 10.0)], "page string, ch string, x0 double, x1 double, base double, size double")
    assert [r.text for r in layout.lines(ch, "page").orderBy("line", "piece").collect()] == ["ab", "c", "d"]
    b = spark.createDataFrame([("p", 0, 0, 2, 2), ("p", 2, 2, 4, 4), ("p", 4, 0, 5, 2), ("p", 9, 9, 10, 10)], "page string, x0 int, y0 int, x1 int, y1 int")
    assert rows(layout.merge_boxes(b, "page").select("x0", "y0", "x1", "y1")) == [(0.0, 0.0, 5.0, 4.0), (9.0, 9.0, 10.0, 10.0)]
    j = layout.join_fragments(F.col("a"), F.col("b"))
    assert [one(spark, j, a=x, b=y) for x, y in (("re-", "made"), ("中", "文"), ("a ", " b"), ("X-", "Ray"))] == ["remade", "中文", "a b", "X- Ray"]
    h = spark.createDataFrame([("d", i, n) for i, n in enumerate(["1", "1.1", "3", "1.2", "2", None, "2.1.1", "2.1"])], "d string, o int, n string")
    assert [r.accepted for r in layout.plausible_headings(h, "d", "o", "n").orderBy("o").collect()] == [True, True, False, True, True, False, False, True]
    assert layout.body_size(ch, "page").first().body_size == 10.0


def test_orphans(spark):
    rng = random.Random(5)
    parents = [(rng.choice("ab"), f"k{rng.randint(0, 5)}", b := rng.randint(0, 50), rng.choice([None, b + rng.randint(1, 20)])) for _ in range(40)] + [("a", "hot", 0, None), (None, "k1", 0, None), ("a", None, 0, None)]
    refs = [("t", f"i{n}", rng.choice(["a", "b", None]), rng.choice([f"k{rng.randint(0, 7)}", "hot"]), rng.randint(0, 80), "p") for n in range(400)] + [("t", "blank", "a", "", 1, "p"), ("t", "x", "a", "k1", None, "p")]
    want = {r[1] for r in refs if r[3] and r[4] is not None and not any(p[0] == r[2] and p[0] and p[1] == r[3] and p[2] <= r[4] and (p[3] is None or p[3] > r[4]) for p in parents)}
    r = spark.createDataFrame(refs, "from_table string, from_id string, scope string, cite_key string, at bigint, period string")
    p = spark.createDataFrame(parents, "scope string, key string, begin bigint, end bigint")
    for size in (7, 100_000):
        assert {x.from_id for x in orphans.orphans(r.unionByName(r), p, rows_per_range=size).collect()} == want
    assert orphans.orphans(r.where("false"), p).count() == 0
    assert orphans.orphans(r, p.where("false")).select("from_id").distinct().count() == 400
    m = spark.createDataFrame([("d", "m1", [" k1\n", "", None, "k2"], "x"), ("d", "m2", None, "x"), ("d", "m3", [], "x")], "doc_id string, marker_id string, keys array<string>, period string").withColumn("edited_at", F.expr("TIMESTAMP_NTZ'2020-05-01 00:00:00'"))
    b = spark.createDataFrame([("d", "b1", "k1", {"crossref": "gone"}), ("d", "b2", "k3", None)], "doc_id string, entry_id string, key string, fields map<string,string>").withColumn("added_at", F.expr("TIMESTAMP_NTZ'2020-05-01 00:00:00'")).withColumn("deleted_at", F.expr("CAST(NULL AS TIMESTAMP_NTZ)"))
    assert rows(orphans.citation_orphans(m, b)) == [("bib_entries", "b1", "gone", "2020-05"), ("markers", "m1", "k2", "2020-05")]


def test_retrieval(spark):
    rng = random.Random(4)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(v, "id bigint, x array<double>")

    def cos(a, b):
        n = lambda z: sum(t * t for t in z) ** 0.5
        return round(sum(p * q for p, q in zip(a, b)) / n(a) / n(b), 6)

    for block in (2, 4096):
        got = retrieval.cosine_top(df, df.where("id % 20 = 0"), "id", "x", 3, block=block)
        for q in (0, 20, 40):
            want = [j for _, j in sorted((-cos(v[q][1], x), j) for j, x in v[:60] if j != q)[:3]]
            assert [r.id for r in got.where(f"query = {q}").orderBy("rank").collect()] == want
    assert retrieval.fill([(0, 3.0, 10), (1, 2.9, 10), (3, 2.0, 10), (9, 0.0, 10)], 100, 5) == [0, 3]
    assert retrieval.fill([(0, 3.0, 10), (5, 2.0, 10)], 5, 5) == [0]


def test_store(spark, tmp_path):
    t = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("llm:b", "3", 1)], "key string, value string, d int").withColumn("created_at", F.expr("timestamp'2024-01-01' + make_dt_interval(d)"))
    have, lack = store.cached(spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "key string"), t)
    assert [(r.key, r.value) for r in have.collect()] == [("a", "2")] and [r.key for r in lack.collect()] == ["z"]
    assert store.unexpired(t, F.expr("timestamp'2024-03-01'"), ["llm:"]).count() == 2
    asked = spark.sparkContext.accumulator(0)
    req = spark.createDataFrame([(1, "p"), (2, "p"), (3, "fail")], "id int, prompt string")

    def provider(prompts):
        asked.add(len(prompts))
        return [None if p == "fail" else p.upper() for p in prompts]

    answers, fresh = store.call_provider(req, t, provider, "k", "v1")
    assert rows(answers) == [(1, "P"), (2, "P"), (3, None)] and asked.value == 2
    again, more = store.call_provider(req, fresh.select("key", "value", "created_at"), provider, "k", "v1")
    assert rows(again)[0] == (1, "P")
    p = spark.createDataFrame([("x", "the quick fox"), ("y", "same")], "para_id string, text string")
    e = spark.createDataFrame([("x", 4, "qick", "quick"), ("x", 10, "fix", "fox")], "para_id string, start int, old string, new string")
    assert rows(store.reject_all(p, e)) == [("x", "the qick fix"), ("y", "same")]
    assert store.same_rows(p, p).count() == 0 and store.same_rows(p, store.reject_all(p, e)).count() == 2
    log = spark.createDataFrame([(1,)], "v int").withColumn("ts", F.expr("timestamp'2024-01-01'"))
    store.append_by_day(log, str(tmp_path / "log"))
    assert store.remaining(log, spark.read.parquet(str(tmp_path / "log")), "v").count() == 0


def test_perturb(spark):
    from quire.operators import perturb

    df = spark.createDataFrame([(f"r{i}", f"line {i}", f"A title of {i} words", 2000 + i % 9, ["A", "B", "C"][: i % 4]) for i in range(400)] + [("n", None, None, None, None)], "ref_id string, raw string, title string, year int, authors array<string>")
    a = perturb.inject(df, "s", 0.5)
    assert rows(a) == rows(perturb.inject(df.repartition(7), "s", 0.5)) and a.count() == 401
    changed = "raw <> old_raw OR title <> old_title OR year <> old_year OR authors <> old_authors"
    assert a.where(f"kind IS NOT NULL AND NOT ({changed})").count() == a.where(f"kind IS NULL AND ({changed})").count() == 0
    assert {r.kind for r in a.select("kind").distinct().collect()} == {None, "year", "title", "author", "number", "source"}
    assert perturb.inject(df, "s", 0.0).where("kind IS NOT NULL").count() == 0


def test_marker_errors(spark):
    from quire.operators import perturb

    e = spark.createDataFrame([("d", f"r{i}", i) for i in range(5)], "doc_id string, ref_id string, pos int")
    m = spark.createDataFrame([("d", f"m{i}", [f"r{i % 5}"] if i % 2 else ["r0", "r2"]) for i in range(300)] + [("d", "none", []), ("d", "null", None)], "doc_id string, marker_id string, ref_ids array<string>")
    got = perturb.inject_markers(m, e, "s", 0.6).collect()
    assert len(got) == 302 and {r.kind for r in got} == {"swap", "drop", "stray", None}
    for r in got:
        assert (r.ref_ids == r.old_ref_ids) == (r.kind is None)
        if r.kind == "drop":
            assert r.ref_ids == r.old_ref_ids[1:]
        if r.kind == "stray":
            assert r.ref_ids[:-1] == r.old_ref_ids and len(set(r.ref_ids)) == len(r.ref_ids)
    assert rows(perturb.inject_markers(m, e, "s", 0.6)) == rows(perturb.inject_markers(m.repartition(5), e, "s", 0.6))


def test_tables_of_pieces(spark):
    p = spark.createDataFrame([("t", 0, 0.0, 4.0, "name"), ("t", 0, 10.0, 14.0, "what"), ("t", 0, 20.0, 24.0, "n"), ("t", 1, 0.0, 3.0, "a"), ("t", 1, 10.0, 16.0, "long wo-"), ("t", 1, 21.0, 22.0, "1"), ("t", 2, 10.0, 15.0, "rd here"), ("t", 3, 0.0, 2.0, "b"), ("t", 3, 20.0, 22.0, "2")], "t string, line int, x0 double, x1 double, text string")
    assert [(r.line, r.column) for r in layout.grid_columns(p, "t").orderBy("line", "x0").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 1), (3, 0), (3, 2)]
    assert rows(layout.table_cells(p, "t")) == sorted([("t", 0, 0, "name"), ("t", 0, 1, "what"), ("t", 0, 2, "n"), ("t", 1, 0, "a"), ("t", 1, 1, "long word here"), ("t", 1, 2, "1"), ("t", 2, 0, "b"), ("t", 2, 2, "2")], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert layout.table_cells(p.where("false"), "t").count() == 0


def test_routes(spark):
    asked: list = []

    def first(prompts):
        asked.append(("first", tuple(prompts)))
        if "boom" in prompts:
            raise OSError("down")
        return [None if p == "hard" else "bad" if p == "odd" else p.upper() for p in prompts]

    second = lambda prompts: [f"2{p}" for p in prompts]
    route = store.routed([("cloud", first), ("here", second)], valid=lambda a: a != "bad", private=lambda p: p.startswith("secret"), local=("here",))
    assert route(["easy", "hard", "odd", "secret x"]) == ["EASY", "2hard", "2odd", "2secret x"] and all("secret x" not in p for _, p in asked)
    assert route(["boom"]) == ["2boom"] and store.routed([("cloud", first)], private=lambda p: True)(["easy"]) == [None]
    a = spark.createDataFrame([("k", "old", 1), ("j", "kept", 1), ("t", "was", 2)], "key string, value string, v int")
    b = spark.createDataFrame([("k", "new", 2), ("n", "more", 1), ("t", "is", 2)], "key string, value string, v int")
    assert rows(store.upsert(a, b, "key", "v").select("key", "value")) == [("j", "kept"), ("k", "new"), ("n", "more"), ("t", "is")]
    assert [tuple(r.x) for r in spark.createDataFrame([("Ａ  “b”",), (None,)], "s string").select(evidence.normal_udf("s").alias("x")).collect()][0][0] == 'a "b"'
