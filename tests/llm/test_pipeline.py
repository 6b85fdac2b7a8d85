"""The queries of the training-data operators, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests import oracle

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_warc_round_trip", "op6_jump_sharding", "op8_benchmark_decontamination"])
def test_twins(spark, name):
    assert oracle.compare(spark, oracle.duck(SMALL), name, SMALL) == ""


def test_stages_keep_documents_and_act(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_stages_on_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "One two three four five.", "en", "s", 9), (2, "One two three four five.", "en", "s", 9), (3, None, None, None, None), (2, "quite another text of the same id, it is", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SMALL).count() <= 6
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted(str(r.text) for r in kept) in (["", "One two three four five.", "quite another text of the same id, it is"], ["None", "One two three four five.", "quite another text of the same id, it is"])


def test_run_gives_pieces_of_documents(spark):
    got = corpus_pipeline.run(spark, SMALL)
    known = duckdb.sql(f"select count(distinct doc_id) from '{SMALL}/documents.parquet'").fetchall()[0][0]
    assert 0 < got.select("doc_id").distinct().count() < known
