import re
from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__ as entry


def test_stages_keep_clean_documents(spark, tmp_path):
    sf, columns = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sizes[1] == sizes[0] > sizes[2] > sizes[3] == sizes[4] > 0.7 * sizes[0]
    got = entry.queries()["pipeline"](spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect())
    )


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if re.match(r"op\d+_", n)} == {"op2_near_vectors", "op5_contaminated", "op7_near_documents", "op11_repeated_words", "op13_manifest"}


def odd_documents(spark):
    """Documents with nulls in every column, empty, repeated and very long texts, and columns whose names clash."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    words = " ".join(f"mot{k} des" for k in range(60_000))
    rows = [
        {"doc_id": None, "text": None}, {"doc_id": None, "text": "a text without an id", "lang": "en"}, {"doc_id": 9001, "text": ""}, {"doc_id": 9002, "text": "12 34"},
        {"doc_id": 9003, "text": "token=abcdefgh in the text"}, {"doc_id": 9003, "text": "token=abcdefgh in the text"}, {"doc_id": 9004, "text": words, "lang": "fr"},
    ]
    more = spark.createDataFrame([tuple(r.get(c) for c in docs.columns) for r in rows], columns)
    named = {"gone": F.lit(1), "gone_id": F.lit(2), "a.b": F.lit("x"), "kept": F.lit(3), "rep": F.lit(4), "Ä ö": F.lit(None).cast("int"), "contaminated": F.lit(True)}
    return docs.unionByName(more).withColumns(named)


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows_and_columns(spark, k):
    sf, stage = "/root/testdata/sf0.001", corpus_pipeline.STAGES[k][1]
    docs = odd_documents(spark)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    left, own = [tuple(r) for r in out.collect()], [tuple(r) for r in docs.collect()]
    if k != 3:
        assert not Counter(left) - Counter(own)
    found = Counter((r[0], r[1]) for r in left)
    if k == 0:
        assert found[None, None] == found[9001, ""] == found[9002, "12 34"] == 0 and found[None, "a text without an id"] == 1
    elif k == 3:
        assert len(left) == len(own) and found[9003, "[secret] in the text"] == 2 and found[None, None] == 1
    else:
        assert found[9003, "token=abcdefgh in the text"] == 2 and found[None, None] == found[9001, ""] == 1
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_packing_takes_what_the_stages_leave(spark):
    out = corpus_pipeline.pack(spark, odd_documents(spark), "/root/testdata/sf0.001")
    ends = out.where("start + length = doc_tokens").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in ends if r.doc_id is None or r.doc_id > 9000} == {None: 2, 9001: 1, 9002: 1, 9003: 2, 9004: 1}
