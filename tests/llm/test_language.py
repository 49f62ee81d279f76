import zlib

from pyspark.sql import functions as F

from sediment.llm.language import accepted, identify, predict, train


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_texts_without_letters_and_empty_tables(spark, texts):
    rows = [(0, "the old house"), (1, "the new house"), (2, None), (3, ""), (4, "123 !! \n"), (5, "TRÈS"), (None, "the"), (0, "the old house"), (9, "the " * 200_000)]
    docs = texts(rows)
    got = {(r.doc_id, r.lang_pred) for r in identify(spark, docs).collect()}
    assert got == {(0, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (None, "en"), (9, "en")}
    kept = accepted(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 5, None, 9}
    assert identify(spark, texts([])).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert train(spark, nothing) is None
    assert {(r.lang_pred, r.score) for r in predict(spark, docs, None).collect()} == {("und", 0.0)}


def test_scores_are_those_of_bayes(spark, texts):
    import numpy as np

    from sediment.llm.language import BUCKETS, Grams

    rows = [(i, t, lang, "", 0) for i, (t, lang) in enumerate([("ab ba", "x"), ("ab", "x"), ("zz ab", "y"), ("zzz", "y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model, grams = train(spark, docs, smoothing=0.5), Grams()
    counts = {}
    for _, t, lang, _, _ in rows:
        counts.setdefault(lang, np.full(BUCKETS, 0.5))
        np.add.at(counts[lang], grams.of([t])[0], 1)
    for text in ("ab", "zz", "ab zz"):
        logs = [np.log(0.5) + np.log(counts[k] / counts[k].sum())[grams.of([text])[0]].sum() for k in "xy"]
        got = predict(spark, texts([(1, text)]), model).first()
        assert got.lang_pred == "xy"[int(np.argmax(logs))]
        assert abs(got.score - np.exp(max(logs) - np.logaddexp(*logs))) < 1e-4


def test_languages_beyond_one_block(spark):
    import numpy as np

    from sediment.llm.language import BUCKETS, Grams

    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x4E00 + 3 * k)} {chr(0x4E00 + k)}", f"l{k:03}") for k in range(300) for _ in range(2 if k < 260 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict(spark, docs.dropDuplicates(["doc_id"]), train(spark, docs, smoothing=0.01)).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {k: f"l{k:03}" for k in range(300)}
    grams, counts = Grams(), np.full((300, BUCKETS), 0.01)
    texts = np.zeros(300)
    for k, t, _ in rows:
        np.add.at(counts[k], grams.of([t])[0], 1)
        texts[k] += 1
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    for k in (0, 255, 256, 299):
        logs = np.log(texts / texts.sum()) + log_p[:, grams.of([rows[[r[0] for r in rows].index(k)][1]])[0]].sum(axis=1)
        assert abs(got[k].score - 1 / np.exp(logs - logs.max()).sum()) < 1e-4
