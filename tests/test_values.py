"""Named queries that SQL doesn't express, on one small manuscript whose results are known by hand."""

import os

import pytest

SCHEMAS = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SCHEMAS), reason="no test tables")
TEXT = "Tides rise (Lee, 2001). Winds fall (Moe, 2002; Kim et al., 2003b). The gauge took 40 samples beside the northern river (Lee, 2001)."


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("values")
    place = lambda raw, n=0: [i for i in range(len(TEXT)) if TEXT.startswith(raw, i)][n]
    mark = lambda k, raw, refs, n=0: {"doc_id": "d", "marker_id": k, "para_id": "p1", "start_pos": place(raw, n), "end_pos": place(raw, n) + len(raw), "raw": raw, "kind": "author_year", "ref_ids": refs}
    ref = lambda k, pos, authors, year, title, raw, **more: {"doc_id": "d", "ref_id": k, "pos": pos, "authors": authors, "year": year, "title": title, "raw": raw, "origin": "list", "lang": "en"} | more
    rec = lambda k, title, authors, year, **more: {"record_id": k, "source": "a", "answered": True, "title": title, "authors": authors, "year": year} | more
    rows = {
        "sections": [{"doc_id": "d", "section_id": "s", "title": "1 Introduction", "canonical": "intro", "heading_para_id": "h"}, {"doc_id": "d", "section_id": "s2", "title": "3 Ends", "canonical": None, "heading_para_id": "h2"}, {"doc_id": "d", "section_id": "s3", "title": "2 Goes on", "canonical": None, "heading_para_id": "h3"}],
        "paragraphs": [{"doc_id": "d", "para_id": k, "para_ix": i, "section_id": "s", "text": t, "is_caption": False} for i, (k, t) in enumerate((("h", "1 Introduction"), ("p1", TEXT), ("h2", "3 Ends"), ("h3", "2 Goes on")))],
        "sentences": [{"para_id": "p1", "sent_ix": 0, "start_pos": 0, "end_pos": 23, "text": TEXT[:23]}, {"para_id": "p1", "sent_ix": 1, "start_pos": 20, "end_pos": 40, "text": "rise (Lee,\n2001)"}, {"para_id": "p1", "sent_ix": 2, "start_pos": 60, "end_pos": 66, "text": "not there"}],
        "markers": [mark("m1", "(Lee, 2001)", ["r1"]), mark("m2", "(Moe, 2002; Kim et al., 2003b)", ["r1"]), mark("m3", "(Lee, 2001)", ["r1"], 1)],
        "reference_entries": [
            ref("r3", 0, ["Kim, B."], 2003, "Another thing", "Kim, B. (2003). Another thing. Sea Letters, 3, 1-9.", venue="Proceedings of the Sea Letters"), ref("r1", 1, ["Lee, A."], 2001, "Slow tides beside the northern river", "[1] Lee, A. (2001). Slow tides beside the northern river. Sea Letters, 1(2), 3-9. doi:10.1000/ab.", venue="Sea Leters"),
            ref("r2", 2, ["Moe, C."], 2002, "Fast winds over the northern plain", "Moe C. Fast winds over the northern plain[J]. Sea Letters, 2002, 4(1): 3-9."), ref("r4", 3, ["Kim, B."], 2003, "A third thing", "“A third thing,” Kim B., 2003."), ref("r5", 4, None, None, "Fast wind over the northern plain", "Moe C. Fast wind over the northern plain[J]. Sea Letters, 2002, 4(1): 3-9."),
        ],
        "candidate_records": [rec(1, "Slow Tides Beside the Northern River", ["A. Lee"], 2001, doi="10.1000/ab", venue="Sea Letters", abstract="The gauge took 25 samples beside the northern river."), rec(2, "Slow tides beside the northern river", ["B. Who"], 2001, doi="10.1000/zz", venue="Elsewhere"), rec(3, None, None, None, answered=False)],
        "bib_entries": [{"doc_id": "d", "entry_id": "b1", "key": "lee", "fields": [("title", "Slow tides beside the northern rivers"), ("year", "2001"), ("author", "Lee, Ann")]}, {"doc_id": "d", "entry_id": "b2", "key": "x", "fields": [("title", "Nothing of the kind"), ("year", "1900")]}],
    }
    for t in os.listdir(SCHEMAS):
        name, schema = t.split(".")[0], pq.read_schema(f"{SCHEMAS}/{t}")
        pq.write_table(pa.Table.from_pylist([{f: r.get(f) for f in schema.names} for r in rows.get(name, [])], schema=schema), out / t)
    return str(out)


def ask(spark, folder, name):
    import __spark_entry__ as entry

    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in entry.queries()[name](spark, folder).collect()), key=str)


def test_marks(spark, folder):
    assert ask(spark, folder, "author_year_links") == [("m1", "Lee", 2001, "r1"), ("m2", "Kim et al.", 2003, "r4"), ("m2", "Moe", 2002, "r2"), ("m3", "Lee", 2001, "r1")]
    assert ask(spark, folder, "attribution_mismatches") == [("m2", "r1", "moe", "lee")]
    assert ask(spark, folder, "number_conflicts") == [("p1", 2, 1, 40.0, 25.0)]
    assert ask(spark, folder, "reorder_moves") == [("d", "r1", None)]
    assert ask(spark, folder, "heading_numbers") == [("d", "s", 1, True), ("d", "s2", 3, False), ("d", "s3", 2, True)]


def test_entries(spark, folder):
    lines = {r[0]: r[1:] for r in ask(spark, folder, "parsed_references")}
    assert lines["r1"] == ("1", ("Lee, A",), 2001, "Slow tides beside the northern river", "Sea Letters", "10.1000/ab")
    assert lines["r2"] == (None, ("Moe C",), 2002, "Fast winds over the northern plain", "Sea Letters", None) and lines["r4"][3] == "A third thing"
    assert ask(spark, folder, "entry_candidates") == [("r1", 1, 100.0, "", False), ("r1", 2, 100.0, "author", False)] and ("r1", "verified", 1, "") in ask(spark, folder, "reference_status")
    assert ask(spark, folder, "entry_assignment") == [("r1", 1, 100.0)]
    assert ("r1", "10.1000/ab", "Sea Leters") in ask(spark, folder, "sibling_attributes")
    assert ask(spark, folder, "near_duplicate_entries") == [("r5", "r2")]
    assert {r[0]: r[1:3] for r in ask(spark, folder, "venue_matches")} == {"Proceedings of the Sea Letters": ("Sea Letters", "key"), "Sea Leters": ("Sea Letters", "alike")}
    assert [r[:2] for r in ask(spark, folder, "structured_matches")] == [("b1", "r1")]
    assert {r[0] for r in ask(spark, folder, "gray_zone")} == {"r1"}


def test_sentences(spark, folder):
    assert ask(spark, folder, "located_sentences") == [("p1", 0, 0, 0, True), ("p1", 1, 20, 6, False), ("p1", 2, 60, None, None)]
    assert ask(spark, folder, "sentences") == [("p1", 0, 0, 23), ("p1", 1, 24, 66), ("p1", 2, 67, len(TEXT))]
    assert ask(spark, folder, "matched_boundaries") == [("p1", 2, 1, 1)]
    assert ask(spark, folder, "excerpt_fill")[0][:2] == ("p1", 0)
