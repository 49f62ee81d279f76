import random
import re

import pytest

from sediment.llm.decontamination import MATCHES, WINDOW, contaminated


def by_force(docs, items):
    def words(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())

    found = {i: set() for i, _ in docs}
    for i, t in docs:
        d = words(t)
        for k, u in items:
            b = words(u)
            for shift in range(-len(b), len(d)):
                same = [0 <= shift + p < len(d) and d[shift + p] == b[p] for p in range(len(b))] + [False] * WINDOW
                if any(sum(same[p : p + WINDOW]) >= MATCHES for p in range(len(b))):
                    found[i].add(k)
                    break
    return {(i, bool(s), len(s), ",".join(map(str, sorted(s)))) for i, s in found.items()}


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_passages_with_replaced_words(spark, texts, room):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    items = [(k, [rng.choice(words) for _ in range(rng.choice([5, 12, 13, 14, 15, 16, 30]))]) for k in range(20)]
    docs = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 10, 50]))]
        part = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 5)):
            part[rng.randrange(len(part))] = "other"
        cut = rng.choice([0, 0, 1, 3])
        docs.append((i, rng.choice([" ", "  ", ". "]).join(body + part[cut:] + body[: rng.choice([0, 1, 9])]).title()))
    docs += [(500, None), (501, ""), (502, "!"), (503, "a b c " * 20_000), (504, " ".join(items[-1][1])), (504, "other text")]
    bench = [(k, " ".join(w)) for k, w in items] + [(100, None), (101, "")]
    df = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as words", "2 as doc_id")
    got = contaminated(texts(docs), df, broadcast_bytes=room).collect()
    want = {r for r in by_force([d for d in docs if d[0] != 504], bench)} | by_force([(504, " ".join(items[-1][1]))], bench)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_tables_and_null_ids(spark, texts):
    passage = " ".join(f"w{i}" for i in range(20))
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(None, passage), (3, passage), (3, passage)], "item_id long, text string")
    assert contaminated(texts([]), bench).count() == 0
    assert [tuple(r) for r in contaminated(texts([(1, passage)]), none).collect()] == [(1, False, 0, "")]
    got = contaminated(texts([(None, passage), (None, "x"), (1, passage), (1, passage)]), bench).collect()
    assert {tuple(r) for r in got} == {(None, True, 2, "3"), (1, True, 2, "3")}


def test_plan_is_built_in(spark, texts):
    plan = contaminated(texts([(1, "a")]), spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_short_items_are_found_whole(spark, texts, room):
    bench = [(1, "What is two plus two?"), (2, "Paris"), (3, "a b c d e f g h i j k l"), (4, "two two"), (5, "")]
    docs = [(1, "so, what IS two plus two"), (2, "what is two minus two"), (3, "x a b c d e f g h i j k l y"), (4, "a b c d e f g h i j k"), (5, "paris, paris"), (6, None), (7, "")]
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = {tuple(r) for r in contaminated(texts(docs), df, broadcast_bytes=room, short_items=True).collect()}
    want = {1: "1", 3: "3", 5: "2"}
    assert got == {(i, i in want, int(i in want), want.get(i, "")) for i, _ in docs}


def test_registered_query_and_stage_use_short_items(spark, texts, tmp_path):
    import corpus_pipeline
    from sediment.llm.queries import op5_contaminated

    docs = texts([(1, "it is said that two plus two is four"), (2, "it is said that two and two are four")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Two plus two?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in op5_contaminated(spark, str(tmp_path)).where("contaminated").collect()} == {1}
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_words_without_ascii_spaces(spark, texts):
    chinese = "".join(chr(0x4E00 + 37 * k) for k in range(20))
    thai = "".join(chr(0x0E01 + k) + ("\u0e34" if k % 3 else "") for k in range(20))
    latin = [f"mot{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, chinese), (2, thai), (3, " ".join(latin))], "item_id long, text string")
    docs = [(1, "vor " + chinese + "\u3002"), (2, "x" + thai), (3, "\u00a0".join(latin)), (4, "\u201c" + "\u2014".join(latin) + "\u201d"), (5, chinese[:10])]
    got = {r.doc_id: r.item_ids for r in contaminated(texts(docs), bench).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "3", 5: ""}
