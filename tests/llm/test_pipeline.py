"""The pipeline's stages on awkward rows, and its end against what its stages say."""

import pytest

import corpus_pipeline
from millrace.llm import line_templates
from millrace.llm.queries import ORACLES, QUERIES, VOCABULARY
from millrace.llm.tokens import load

from .test_operators import SCHEMA, awkward, brute_templates, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns_and_bears_awkward_rows(spark, k):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(packed) < docs.count()


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "line dedup", "n-gram Jaccard join", "packing"]


def test_rows_of_numbers_stay(spark):
    rows = [(1, "a table of prices\n12.5 13.1 9.7\n2001 88 4\npaid 3 4 5"), (2, "another table with costs\n1.5 2.25 9.9\n2002 7 4\npaid 8 9 1"), (3, "x\n12.5 13.1 9.7\nerror 17 at node 4"), (4, "y\nerror 18 at node 5\nab 1 cd 2 ef 3 gh ij"), (5, "z\nab 1 cd 2 ef 3 kl mn")]
    got = {r.doc_id: r.text for r in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "x\nerror 17 at node 4", 4: "y\nab 1 cd 2 ef 3 gh ij", 5: rows[4][1]}


def brute_dedup(texts):
    gone = brute_templates(texts)
    kept = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in texts}
    return {d: t for d, t in kept.items() if t.split() or d not in gone}


def test_line_dedup_loses_no_text_of_its_own(spark):
    p, q, x, own = "first passage that others share word for word", "second passage that others share too", "a line in two", "a line alone"
    docs = spark.createDataFrame([(1, f"{p}\n{q}"), (2, f"{p}\n{q}\n{x}"), (3, f"{x}\n{own}"), (4, p)], "doc_id long, text string")
    assert {tuple(r) for r in line_templates.dedup(docs).collect()} == {(1, f"{p}\n{q}"), (2, x), (3, own)}


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    texts = brute_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()])
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    kept = {d for d in texts if root[d] == d}
    tokens = {d: len(e.ids) + 1 for d, e in zip(sorted(kept), load(VOCABULARY).encode_batch([texts[d] for d in sorted(kept)], add_special_tokens=False), strict=True)}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()} == tokens
