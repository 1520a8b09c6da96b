"""Pairs by likeness against brute force: the operator, and the queries on tables whose titles have errors at both ends."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.functions.fuzzy import partial_ratio, plain, ratio, sorted_ratio
from quire.operators import alike, entities
from quire.plans import checks

SMALL = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def damaged(title: str | None) -> str | None:
    """Wrong letters near the start and the end, so that no beginning and no end of the key is left."""
    return title if title is None or len(title) < 30 else title[:2] + "q" + title[3:-3] + "q" + title[-2:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables; every other entry with errors in its title and neither author, year nor DOI."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("damaged")
    for name in ("reference_entries", "candidate_records"):
        t = pq.read_table(f"{SMALL}/{name}.parquet")
        if name == "reference_entries":
            rows = t.to_pylist()
            for r in rows:
                if sum(map(ord, r["ref_id"])) % 2:
                    r.update(title=damaged(r["title"]), authors=None, year=None, doi=None)
            t = pa.Table.from_pylist(rows, schema=t.schema)
        pq.write_table(t, out / f"{name}.parquet")
    return str(out)


@pytest.mark.parametrize("least", [60.0, 70.0, 92.0])
def test_alike(spark, least):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde中é") for _ in range(rng.randint(1, 9)))
    left = ["", "中文", *(" ".join(word() for _ in range(rng.choice((1, 3, 12, 30)))) for _ in range(60))]
    right = ["", "中", *(s if rng.random() < 0.3 else "".join(c for c in s if rng.random() > 0.1) for s in left), *(word() for _ in range(40))]
    want = {(a, b): ratio(a, b) for a in left for b in right if ratio(a, b) >= least}
    got = alike.alike(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least).collect()
    assert {(r.a, r.b): r.score for r in got} == want and len(got) == len(want)


def test_near_parts():
    """The best stretch of each pair by brute force, whichever string is shorter, each pair with its own bound."""
    import numpy as np

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd中 ") for _ in range(rng.randint(0, n)))
    left = ["", *(word(n) for n in (8, 40, 90, 150) for _ in range(10))]
    right = ["", *(word(n) for n in (5, 60, 200) for _ in range(8)), *(word(30) + s[:-3] + "x" + word(30) for s in left)]
    least = np.array([[rng.choice((30, 60, 80)) for _ in right] for _ in left])
    want = {(i, j): s for i, a in enumerate(left) for j, b in enumerate(right) if (s := partial_ratio(a, b)) >= least[i, j]}
    got = {(int(i), int(j)): s for i, j, s in zip(*alike.near(left, right, least, part=True))}
    assert got.keys() == want.keys() and len(want) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_likest(spark, monkeypatch):
    """The three highest ratios of each string with all that equal the third, over several blocks, and fewer pairs measured
    once a string has three."""
    monkeypatch.setattr(alike, "BLOCK", 40)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde中é") for _ in range(rng.randint(1, 9)))
    left = ["", "中文", *(" ".join(word() for _ in range(rng.choice((1, 3, 12, 20)))) for _ in range(90))]
    right = ["", "中", *("".join(c for c in s if rng.random() > 0.1) for s in left for _ in range(5)), *(word() for _ in range(40))]
    want = {}
    for a in set(left):
        scores = sorted(((ratio(a, b), b) for b in set(right)), reverse=True)
        want |= {(a, b): s for s, b in scores if s >= max(60.0, scores[2][0])}
    got = {(r.a, r.b): r.score for r in alike.likest(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), 60.0, 3).collect()}
    assert want.items() <= got.items() and all(s == ratio(*k) for k, s in got.items())
    best = alike.Best(["abcdefghij"], 60.0, 3)
    assert len(best.meet(["abcdefghij", "abcdefghi", "bcdefghij", "abcdefg"])[0]) == 3
    assert len(best.meet(["abcdefgh", "abcdefghijk"])[0]) == 1 and best.need[0] > 94


def test_structured_large(spark, monkeypatch):
    """A manuscript with many entries without a title takes seconds (each stretch of each pair took minutes before)."""
    import time

    monkeypatch.setattr(alike, "BLOCK", 150)
    rng = random.Random(7)
    titles = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6)) for _ in range(600)]
    entries = spark.createDataFrame([("d" if i < 500 else f"d{i}", f"r{i}", i, None, f"Lee, A., Kim, B. (2001). {t}. Journal of Tides and Storms, 12(3), 45-67, with notes and two appendices.", 2001, ["Lee, A."]) for i, t in enumerate(titles)], "doc_id string, ref_id string, pos int, title string, raw string, year int, authors array<string>")
    items = spark.createDataFrame([("d" if i < 500 else f"d{i}", f"i{i}", t[:9] + "x" + t[10:], 2001, "Lee") for i, t in enumerate(titles)], "doc_id string, item_id string, title string, year int, family string")
    began = time.time()
    got = {r.item_id: r.ref_id for r in entities.structured_matches(items, entries).collect()}
    assert got == {f"i{i}": f"r{i}" for i in range(600)} and time.time() - began < 40


def test_candidates_whole(spark):
    """Every pair from 92 on is found without author, year or DOI, and with errors anywhere; short Chinese titles as well."""
    titles = ["Long-term sensor drift in coastal observation networks", "A survey of ranked retrieval over annotated manuscripts", "峣栩坡作物产量的隐性差异研究", "作物产量研究"]
    known = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in enumerate(titles)], "record_id bigint, title string, main_title string, authors array<string>, year int, alt_year int, doi string, arxiv_id string")
    wrong = [f(t) for t in titles for f in (str, damaged, lambda t: "<i>" + t, lambda t: "Ь" + t[1:] if len(t) > 30 else t + "。")]
    asked = spark.createDataFrame([(f"r{i}", t, None, None, None) for i, t in enumerate(wrong)], "ref_id string, title string, authors array<string>, year int, doi string")
    want = {(f"r{i}", k) for i, t in enumerate(wrong) for k, u in enumerate(titles) if sorted_ratio(plain(t), plain(u)) >= 92}
    assert len(want) >= 12
    assert {(r.ref_id, r.record_id) for r in entities.candidates(asked, known).collect()} == want


@have
@pytest.mark.parametrize("name", ["entry_candidates", "reference_status", "entry_assignment", "sibling_attributes"])
def test_queries_whole(spark, folder, monkeypatch, name):
    got = checks.QUERIES[name](spark, folder).collect()
    monkeypatch.setattr(entities, "likely", lambda e, r, least: e.select("ref_id").crossJoin(r.select("record_id")))
    assert sorted(map(str, got)) == sorted(map(str, checks.QUERIES[name](spark, folder).collect()))


@have
def test_gray_zone_whole(spark, folder):
    """The three likest titles of each entry by brute force, where neither start nor end of the key is the same."""
    from quire.functions.text import squash
    from quire.plans import more
    from quire.plans.text import records, refs

    asked = [(r.ref_id, plain(r.title)) for r in refs(spark, folder).where("title IS NOT NULL").collect()]
    known: dict = {}
    for r in records(spark, folder).where("title IS NOT NULL").select("title", squash(F.col("title")).alias("k")).collect():
        known.setdefault(r.k or plain(r.title), []).append(plain(r.title))
    want = set()
    for ref, t in asked:
        scored = sorted((-round(s, 4), k) for k, us in known.items() if (s := sorted_ratio(t, min(us))) >= 70 and t and min(us))
        want |= {(ref, k, -s, i) for i, (s, k) in enumerate(scored[:3], 1)}
    assert {tuple(r) for r in more.gray_zone(spark, folder).select("ref_id", "key", "score", "rank").collect()} == want


@have
def test_gray_zone_short(spark, tmp_path):
    """Short titles, and titles in other scripts, are compared as well."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quire.plans import more

    for name, titles in (("reference_entries", ["土壤水分", "Почвенная влага"]), ("candidate_records", ["土壤水份", "Почвенная влага.", "Иное"])):
        t = pq.read_table(f"{SMALL}/{name}.parquet").slice(0, len(titles))
        rows = [r | {"title": x, "ref_id": x, "record_id": i} for i, (r, x) in enumerate(zip(t.to_pylist(), titles))]
        pq.write_table(pa.Table.from_pylist(rows, schema=t.schema), tmp_path / f"{name}.parquet")
    assert sorted(map(tuple, more.gray_zone(spark, str(tmp_path)).collect())) == [("Почвенная влага", "почвенная влага", 100.0, 1), ("土壤水分", "土壤水份", 75.0, 1)]


@have
def test_all_findings(spark, tmp_path):
    """Duplicates, lists out of order, bare medium tags and missing volumes are findings, beside those that SQL has."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in os.listdir(SMALL):
        pq.write_table(pq.read_table(f"{SMALL}/{name}").slice(0, 0), tmp_path / name)
    entry = lambda ref, doc, pos, title, raw, author: {"ref_id": ref, "doc_id": doc, "pos": pos, "title": title, "raw": raw, "authors": [author], "year": 2020, "origin": "list"}
    long_title = "Sensor drift in coastal observation networks of the north"
    entries = [
        entry("a1", "d1", 1, long_title, f"Zed, Z. {long_title}[J]. Tides, 2020, 3(1): 1-9.", "Zed, Z."),
        entry("a2", "d1", 2, "Qe" + long_title[2:-2] + "qh", f"Zed, Z. Qe{long_title[2:-2]}qh[J]. Tides: 1-9.", "Ace, Z."),
        entry("a3", "d1", 3, "土壤水分", "土壤水分[OL].", "Zoe, Z."),
        entry("b1", "d2", 1, "One", "One", "Ann"), entry("b2", "d2", 2, "Two", "Two", "Bea"),
    ]
    marker = lambda i, doc, kind, start, ids: {"doc_id": doc, "marker_id": i, "para_id": f"p{doc}", "start_pos": start, "end_pos": start + 1, "raw": "x", "kind": kind, "ref_ids": ids}
    cited = [marker("m1", "d1", "author_year", 0, ["a1"]), marker("m2", "d2", "zotero", 0, ["b2"]), marker("m3", "d2", "zotero", 3, ["b1"])]
    paras = [{"para_id": f"p{d}", "doc_id": d, "para_ix": 0, "text": "abcdef", "is_caption": False} for d in ("d1", "d2")]
    for name, rows in (("reference_entries", entries), ("markers", cited), ("paragraphs", paras)):
        schema = pq.read_schema(f"{SMALL}/{name}.parquet")
        pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema), tmp_path / f"{name}.parquet")
    got = {(r.rule, r.doc_id, r.n) for r in checks.all_findings(spark, str(tmp_path)).collect()}
    new = {("duplicate_entry", "d1", 1), ("managed_list_order", "d2", 1), ("unsorted_list", "d1", 1), ("bare_medium_tag", "d1", 1), ("missing_volume", "d1", 1)}
    assert got == new | {(r.rule, r.doc_id, r.n) for r in checks.findings(spark, str(tmp_path)).collect()}
    assert {r.ref_id for r in checks.near_duplicate_entries(spark, str(tmp_path)).collect()} == {"a2"}


@have
def test_near_duplicates_whole(spark, folder):
    """Against all pairs of entries of a manuscript."""
    from quire.plans.text import refs

    lists: dict = {}
    for r in refs(spark, folder).where("raw IS NOT NULL AND title IS NOT NULL").orderBy("pos", "ref_id").collect():
        lists.setdefault(r.doc_id, []).append((r.ref_id, plain(r.title), plain(r.raw)))
    want = {}
    for es in lists.values():
        for j, (ref, t, w) in enumerate(es):
            first = next((p for p, u, v in es[:j] if t and u and sorted_ratio(u, t) >= 95 and ratio(v, w) >= 75), None)
            want |= {ref: first} if first else {}
    assert {r.ref_id: r.first_ref for r in checks.near_duplicate_entries(spark, folder).collect()} == want
