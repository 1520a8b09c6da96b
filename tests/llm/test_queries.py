"""The pN_ queries on the smallest tables and on empty ones."""

import os

import pytest

from quire.llm import queries, tokens

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(FOLDER) and os.path.exists(f"{tokens.VOCABULARY}/byte_bpe_50k.tiktoken")), reason="no test tables or vocabulary")
COLUMNS = {"p1_found": "section_id field_name target", "p2_found": "ref_id record_id", "p4_found": "para_id start_pos end_pos", "p5_found": "field_name id_a id_b", "p6_ids": "doc_id ids", "p7_found": "doc_id item_id", "p8_found": "doc_id level"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("empty")
    for t in os.listdir(FOLDER):
        pq.write_table(pq.read_table(f"{FOLDER}/{t}").slice(0, 0), folder / t)
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, empty, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows and len(set(map(str, rows))) == len(rows)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_whole(spark):
    """Sentences cover their paragraphs, and every text has its ids."""
    spans = {}
    for r in queries.p4_found(spark, FOLDER).collect():
        spans.setdefault(r.para_id, []).append((r.start_pos, r.end_pos))
    texts = {r.para_id: r.text for r in queries.body_paragraphs(spark, FOLDER).join(queries.headings(spark, FOLDER), "para_id", "left_anti").select("para_id", "text").collect()}
    assert set(spans) == set(texts)
    for p, t in texts.items():
        inside = {i for a, b in spans[p] for i in range(a, b)}
        assert all(c.isspace() for i, c in enumerate(t) if i not in inside)
    assert queries.p6_ids(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
