"""The pipeline and the registered queries over a whole small table."""
import random
from collections import Counter

import pytest
from conftest import SF, prose

import __spark_entry__
import corpus_pipeline
from riskframe.llm import exact_dedup, mixing, packing, quality_knn, simhash
from riskframe.llm.queries import QUERIES, tokenizer_file


def test_every_operator_has_one_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_are_their_operators(spark, tmp_path):
    """run() equals the operators applied by hand, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by_hand = [lambda d: quality_knn.keep_good(d, labels), exact_dedup.drop_copies, simhash.drop_near_copies, mixing.mix]
    before = None
    for k, f in enumerate(by_hand):
        docs = f(docs)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert before is None or docs.count() <= before
            before = docs.count()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = packing.pack(docs, tokenizer_file())
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(map(piece, got)) == Counter(map(piece, want.collect()))
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 4096) + 1


def test_pipeline_without_rows_or_labels(spark, tmp_path, no_rows, no_labels):
    no_rows.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd_rows, table):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows + [(100 + i, prose(rng, 150)) for i in range(20)]
    table(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, i % 3 == 0) for i in range(20)], "doc_id long, quality int, toxic boolean"
                          ).selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{path}/labels.parquet")
    return path, rows


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("op13")))  # op13 reads embeddings
def test_queries_return_a_row_per_document(spark, folder, name):
    path, rows = folder
    got = Counter(r.doc_id for r in QUERIES[name](spark, path).collect())
    want = Counter(d for d, _ in rows)
    if name.startswith("op9"):
        assert set(got) == set(want)
    else:
        assert got == want
