"""Records held against copies, structured items, venues, verdicts by stub providers, and proposed corrections."""

import random

from pyspark.sql import functions as F

from quire.functions.fuzzy import partial_ratio, plain, sorted_ratio
from quire.operators import entities, typos, venues, verdicts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_long_chain(spark):
    """Each pair blocks the next: forty rounds, no end before."""
    n = 40
    pairs = [(f"l{i:03}", f"r{i:03}", float(200 - 2 * i)) for i in range(n)] + [(f"l{i:03}", f"r{i - 1:03}", float(201 - 2 * i)) for i in range(1, n)]
    got = rows(entities.assign(spark.createDataFrame(pairs, "l string, r string, s double"), "l", "r", "s").select("l", "r"))
    assert got == [(f"l{i:03}", f"r{i:03}") for i in range(n)]
    assert entities.assign(spark.createDataFrame([], "l string, r string, s double"), "l", "r", "s").count() == 0


def test_statuses_by_source(spark):
    e = spark.createDataFrame([("r1", "en"), ("r2", "en"), ("r3", "en"), ("r4", "zh")], "ref_id string, lang string")
    found = spark.createDataFrame([], "ref_id string, record_id bigint, score double, issues array<string>")
    said = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "c"), ("r4", "a"), ("r4", "b"), ("r1", None)], "ref_id string, source string")
    got = {r.ref_id: r.status for r in entities.statuses(e, found, F.lit(False), said, required=["b"]).collect()}
    assert got == {"r1": "not_found", "r2": "unverifiable", "r3": "unverifiable", "r4": "unverifiable"}
    assert {r.ref_id: r.status for r in entities.statuses(e, found, F.lit(False), said).collect()}["r2"] == "not_found"


def test_second_author(spark):
    title = "A study of soil moisture in northern fields"
    e = spark.createDataFrame([("same", ["Lee, A.", "Kim, B."], 2019), ("swapped", ["Lee, A.", "Moe, C."], 2019), ("one", ["Lee, A."], 2019), ("old", ["Lee, A."], 1990)], "ref_id string, authors array<string>, year int").withColumn("title", F.lit(title)).withColumn("doi", F.lit(None).cast("string"))
    k = spark.createDataFrame([(1, title, None, ["A. Lee", "B. Kim"], 2019, None, None, None), (2, title, None, ["A. Lee", "B. Kim"], 2019, None, None, "x1")], "record_id bigint, title string, main_title string, authors array<string>, year int, alt_year int, doi string, arxiv_id string")
    got = {(r.ref_id, r.record_id): list(r.issues) for r in entities.candidates(e, k).collect()}
    assert got["same", 1] == got["one", 1] == [] and got["swapped", 1] == ["second_author"] and got["swapped", 2] == [] and got["old", 1] == ["year"]
    assert {(r.ref_id, r.record_id): list(r.issues) for r in entities.candidates(e, k, horizon=2000).collect()}["old", 1] == []


def test_local_copies(spark):
    e = spark.createDataFrame([(f"r{i}", "On slow tides", ["Lee, A."], 2001) for i in range(7)], "ref_id string, title string, authors array<string>, year int")
    s = spark.createDataFrame([("r0", "not_found", None, ""), ("r1", "verified", 1, ""), ("r2", "mismatch", 2, "year"), ("r3", "unverifiable", None, ""), ("r4", "mismatch", 3, "doi"), ("r5", "not_found", None, ""), ("r6", "not_found", None, "")], "ref_id string, status string, record_id bigint, issues string")
    l = spark.createDataFrame([("r0", "On Slow Tides.", ["Ann Lee"], 2001, True), ("r1", "A different thing altogether", ["Ann Lee"], 2001, True), ("r2", "On slow tides", ["Bo Kim"], 2001, True), ("r3", "慢潮", ["李"], 2009, True), ("r4", "On slow tides", ["Ann Lee"], 2002, True), ("r5", "A different thing altogether", None, None, False)], "ref_id string, title string, authors array<string>, year int, trusted boolean")
    got = {r.ref_id: (r.status, r.issues) for r in entities.fold_local(s, e, l).collect()}
    assert got == {"r0": ("verified", ""), "r1": ("mismatch", "local_title"), "r2": ("mismatch", "year,local_author"), "r3": ("mismatch", "local_year"), "r4": ("mismatch", "doi"), "r5": ("verified", ""), "r6": ("not_found", "")}


def test_structured_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    titles = [" ".join(word() for _ in range(5)) for _ in range(30)]
    entries = [(f"d{i % 2}", f"r{i}", i, t if i % 3 else None, f"Lee, A. {t}. J, 2001.", 2000 + i % 3, ["Lee, A." if i % 2 else "Kim, B."]) for i, t in enumerate(titles)]
    items = [(f"d{i % 2}", f"i{i}", "".join(c if rng.random() > 0.15 else "x" for c in titles[i]), 2000 + i % 3, "Lee") for i in range(30)] + [("d0", "none", None, 2001, "Lee"), ("d9", "lost", titles[0], 2001, "Lee")]
    want = {}
    for d, i, t, y, f in items:
        best = None
        for d2, r, pos, title, raw, y2, a in entries:
            if t and d == d2:
                score = (sorted_ratio(plain(t), plain(title)) if title else 0.9 * partial_ratio(plain(t), plain(raw))) + 10 * (y == y2) + 10 * (a[0][:3] == f)
                if score >= 80 and (best is None or (-round(score, 4), pos) < best[:2]):
                    best = (-round(score, 4), pos, r)
        if best:
            want[i] = best[2]
    got = entities.structured_matches(spark.createDataFrame(items, "doc_id string, item_id string, title string, year int, family string"), spark.createDataFrame(entries, "doc_id string, ref_id string, pos int, title string, raw string, year int, authors array<string>"))
    assert {r.item_id: r.ref_id for r in got.collect()} == want and len(want) > 15


def test_venues(spark):
    reg = spark.createDataFrame([("v1", "Annual Meeting on Tides", ["AMT", "Tide Meeting"], ["10.1234"], ["1234-567X"]), ("v2", "Sea Letters", [], [], [])], "id string, name string, aliases array<string>, doi_prefixes array<string>, numbers array<string>")
    a = spark.createDataFrame([("Proceedings of the Annual Meeting on Tides",), ("AMT",), ("Sea Leters",), ("Xea Letters",), (None,), ("",), ("ACM",)], "venue string")
    b = spark.createDataFrame([("annual meeting on tides",), ("Sea Letters",), ("ABM",), (None,)], "known string")
    got = {(r.venue, r.known): r.how for r in venues.same_venues(a, b, reg).collect()}
    assert got == {("Proceedings of the Annual Meeting on Tides", "annual meeting on tides"): "key", ("AMT", "annual meeting on tides"): "alias", ("Sea Leters", "Sea Letters"): "alike"} | ({("Xea Letters", "Sea Letters"): "alike"} if 200 * 9 / 20 >= 92 else {})
    p = spark.createDataFrame([("p1", "10.1234/ab", None, None), ("p2", None, "ISSN 1234-567x", "x"), ("p3", None, None, "SEA  LETTERS 3(2)"), ("p4", "10.99/1", "none", "none"), ("p5", None, None, None)], "paper_id string, doi string, head string, edges string")
    assert rows(venues.printed_in(p, reg)) == [("p1", "v1", "doi_prefix"), ("p2", "v1", "number"), ("p3", "v2", "heads")]


def test_claims(spark):
    text = "Tides rise slowly [1], and storms are rare [2, 3]. Nothing is cited."
    s = spark.createDataFrame([("p", 0, 0, 50, text[:50]), ("p", 1, 51, len(text), text[51:]), ("q", 0, 10, 60, text[:50])], "para_id string, sent_ix int, start_pos int, end_pos int, text string")
    m = spark.createDataFrame([("p", "m1", 18, 21), ("p", "m2", 43, 49), ("q", "m9", 28, 31), ("q", "m8", 53, 59)], "para_id string, marker_id string, start_pos int, end_pos int")

    def provider(requests):
        assert all(r["sentence"] == "Tides rise slowly ⟦m1⟧, and storms are rare ⟦m2⟧." for r in requests)
        return [{"claims": [{"text": "tides rise slowly", "markers": ["m1", "m7"]}, {"text": "not there at all", "markers": ["m2"]}, {"text": "x", "markers": ["m5"]}]} for _ in requests]

    got = verdicts.extract_claims(s, m, provider).collect()
    assert {(r.para_id, r.start_pos, r.end_pos, r.text, tuple(r.marker_ids)) for r in got} == {("p", 0, 17, "Tides rise slowly", ("m1",)), ("p", 0, 42, "Tides rise slowly , and storms are rare", ("m2",)), ("q", 10, 27, "Tides rise slowly", ("m9",)), ("q", 10, 52, "Tides rise slowly , and storms are rare", ("m8",))}
    silent = verdicts.extract_claims(s.where("para_id = 'p'"), m, lambda rs: [None for _ in rs]).collect()
    assert [(r.start_pos, r.text, r.marker_ids) for r in silent] == [(0, "Tides rise slowly , and storms are rare", ["m1", "m2"])]
    assert verdicts.extract_claims(s.where("false"), m, provider).count() == 0


def test_cascade(spark):
    source = "The yield rose by 12 percent in wet years. Nothing else was measured there."
    # task and claim -> answer; what a task isn't asked is an error
    said = {
        ("judge", "yes"): {"label": "supported", "evidence": "rose by 12 percent"}, ("details", "yes"): None,
        ("judge", "retry"): {"label": "supported", "evidence": "rose by a lot"}, ("judge_again", "retry"): {"label": "supported", "evidence": "in wet years"}, ("details", "retry"): None,
        ("judge", "invented"): {"label": "unsupported", "evidence": "made up"}, ("judge_again", "invented"): {"label": "unsupported", "evidence": "made up again"},
        ("judge", "part"): {"label": "partial", "evidence": "wet years"}, ("review", "part"): {"label": "supported", "evidence": "rose by 12 percent"},
        ("judge", "down"): {"label": "unsupported", "evidence": "Nothing else", "off_topic": True}, ("review", "down"): None, ("review_fallback", "down"): None,
        ("judge", "fall"): {"label": "partial", "evidence": "Nothing else"}, ("review", "fall"): None, ("review_fallback", "fall"): {"label": "unsupported", "evidence": "Nothing else was measured"},
        ("judge", "detail"): {"label": "supported", "evidence": "rose by 12 percent"}, ("details", "detail"): {"label": "unsupported", "evidence": "in wet years"}, ("review", "detail"): {"label": "partial", "evidence": "in wet years"},
        ("judge", "the yield rose by 30 percent in wet years"): {"label": "supported", "evidence": "The yield rose"}, ("details", "the yield rose by 30 percent in wet years"): None, ("review", "the yield rose by 30 percent in wet years"): {"label": "unsupported", "evidence": "rose by 12 percent"},
        ("judge", "hunch"): {"label": "undetermined", "off_topic": True}, ("review", "hunch"): {"label": "undetermined", "off_topic": True, "rationale": "other field"},
        ("judge", "calm"): {"label": "undetermined", "off_topic": True}, ("review", "calm"): {"label": "supported", "evidence": "wet years", "off_topic": True},
        ("judge", "mute"): None, ("judge", "bare"): {"label": "supported"}, ("judge", "odd"): {"label": "perhaps", "evidence": "wet"},
    }
    claims = list(dict.fromkeys(k for _, k in said))
    pairs = spark.createDataFrame([(i, k, source, None) for i, k in enumerate(claims)] + [(90, "no text", None, None), (91, "empty", "", None)], "pair int, claim string, excerpt string, wide string")
    provider = lambda requests: [said[r["task"], r["claim"]] for r in requests]
    got = {r.pair: r for r in verdicts.cascade(pairs, provider).collect()}
    assert {k: (got[i].label, got[i].off_topic) for i, k in enumerate(claims)} == {
        "yes": ("supported", False), "retry": ("supported", False), "invented": ("undetermined", False), "part": ("supported", False), "down": ("unsupported", True), "fall": ("unsupported", False), "detail": ("partial", False),
        "the yield rose by 30 percent in wet years": ("unsupported", False), "hunch": ("undetermined", True), "calm": ("undetermined", False), "mute": ("undetermined", False), "bare": ("undetermined", False), "odd": ("undetermined", False),
    }
    assert got[90].rationale == got[91].rationale == "no source" and source[got[0].start : got[0].end] == "rose by 12 percent" and got[claims.index("hunch")].rationale == "other field"
    other = spark.createDataFrame([(claims.index("down"), "It fell.", None), (claims.index("fall"), "Nothing else was measured, at all.", None)], "pair int, excerpt string, wide string")
    again = lambda requests: [({"label": "supported", "evidence": "It fell"} if r["task"] == "judge" else None) if r["excerpt"] == "It fell." else said[r["task"], r["claim"]] for r in requests]
    dual = {r.pair: r for r in verdicts.cascade(pairs, again, other).collect()}
    assert (dual[claims.index("down")].label, dual[claims.index("down")].off_topic) == ("undetermined", False) and dual[claims.index("fall")].label == "unsupported" and len(dual) == len(got)
    places = pairs.select("pair", F.lit("d").alias("doc_id"), F.col("claim").alias("para_id"), F.lit(0).alias("start_pos"), F.lit(9).alias("end_pos"), F.concat(F.lit("r"), F.col("pair").cast("string")).alias("ref_id"))
    found = verdicts.support_findings(places, verdicts.cascade(pairs, provider)).collect()
    assert sorted((r.rule, r.severity) for r in found) == [("miscited", "high"), ("no_source", "low"), ("off_topic", "medium"), ("partly_supported", "low"), ("unsupported", "high"), ("unsupported", "high")]
    assert [(r.refs, r.n_claims) for r in found if r.rule == "no_source"] == [(["r90", "r91"], 2)]
    assert verdicts.cascade(pairs.where("false"), provider).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(1, "We use the tool of others."), (2, "We use the tool of others."), (3, "Odd."), (4, "Unquoted."), (5, None)], "id int, text string")
    asked = lambda requests: [{"We use the tool of others.": {"label": "method", "quote": "the tool"}, "Odd.": {"label": "else", "quote": "Odd"}, "Unquoted.": {"label": "method", "quote": "not here"}}[r["text"]] for r in requests]
    assert rows(verdicts.classified(df, asked, "function", ["method", "background"], quoted=True)) == sorted([(1, "method", "the tool"), (2, "method", "the tool"), (3, None, None), (4, None, None), (5, None, None)], key=str)


def test_typos(spark):
    text = "The Rewon method helllo works works on 10 data sets. Rewon is old."
    paras = [("d", "p", text), ("d", "q", "Rewon again, and 决策化模型 here."), ("d", "r", "这里的决策化模型是的的好"), ("d", "low", "dani alves played there"), ("e", "z", None)]
    want = {
        ("p", "helllo", "hello"): ("", "revision"), ("p", "works works", "works"): ("", "doubt"), ("p", "10 data", "12 data"): None, ("p", "Rewon", "Rezwon"): None, ("p", "The Rewon", "The Rezwon"): None, ("p", "old.", "old"): None, ("p", "is old", "old"): None, ("p", "data sets", "data sets of ours"): None,
        ("p", "absent", "x"): None, ("p", "method", "process"): ("", "doubt"), ("r", "决策化模型", "决策模型"): None, ("r", "的的", "的"): ("", "revision"), ("low", "dani alves", "Dani Alves"): None, ("z", "a", "b"): None, ("p", "", "x"): None,
    }
    p = spark.createDataFrame(paras, "doc_id string, para_id string, text string")
    m = spark.createDataFrame([("p", 0, 3)], "para_id string, start_pos int, end_pos int")
    got = typos.typo_revisions(p, m, spark.createDataFrame(list(want), "para_id string, original string, correction string")).collect()
    texts = {k: t for _, k, t in paras}
    fixed = {(r.para_id, texts[r.para_id][: r.start_pos] + r.new + texts[r.para_id][r.end_pos :]): r.kind for r in got}
    assert fixed == {(k, texts[k].replace(a, b)): w[1] for (k, a, b), w in want.items() if w}
    assert typos.typo_revisions(p, m, spark.createDataFrame([], "para_id string, original string, correction string")).count() == 0
