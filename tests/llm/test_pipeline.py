import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from quartzframe.llm import line_dedup, queries
from test_line_dedup import brute as line_brute
from test_near_dedup import brute as near_brute
from test_packing import check

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, table):
    sentence = lambda i, n: "\n".join(" ".join(f"t{(i * 37 + k * k + j * 101) % 211}" for k in range(15)) for j in range(n))
    docs = [(i, sentence(i, 3)) for i in range(40)] + [(50, sentence(1, 3)), (51, sentence(2, 3) + "\nmail a.b@x.example.org now and then"), (52, "### $$$ " * 30), (53, None), (54, ""), (55, "too short")]
    made = table(*docs)
    columns = made.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, SMALL)
        steps[name] = made = made.checkpoint()
    kept = {r["doc_id"]: r["text"] for r in steps["quality_rules"].collect()}
    assert set(range(40)) | {50, 51} == set(kept)
    _, texts = line_brute(sorted(kept.items()), line_dedup.LineDedup())
    assert {r["doc_id"]: r["text"] for r in steps["line_dedup"].collect()} == {i: t for i, t in texts.items() if t}
    assert 50 not in {r["doc_id"] for r in steps["line_dedup"].collect()}
    left = sorted((r["doc_id"], r["text"]) for r in steps["line_dedup"].collect())
    assert sorted(r["doc_id"] for r in steps["near_dedup"].collect()) == [r[0] for r in near_brute(left) if r[3]]
    clean = {r["doc_id"]: r["text"] for r in steps["pii"].collect()}
    assert "a.b@x" not in clean[51] and all(steps[n].columns == columns for n in list(steps)[:-1])
    assert sum(r["length"] for r in steps["packing"].collect()) == sum(r["doc_tokens"] for r in steps["packing"].where("start = 0").collect())
    assert check and {r["doc_id"] for r in steps["packing"].collect()} == set(clean)


def test_pipeline_on_an_empty_table(spark, table):
    made = table()
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, SMALL).checkpoint()
    assert made.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
