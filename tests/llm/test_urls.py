import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sediment.llm.urls import host_of, judge_urls, match_rules, mine_rules, path_of, tokens_of

URLS = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("http://A.B?x/y", "a.b", "", None), ("http://h#f?q", "h", "", None),
    ("a://b://c/d", "b:", "//c/d", None), ("http://ORG/", "org", "/", "org/"), ("http://x.org", "x.org", "", None), ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/"),
    ("http://a.EXAMPLE.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("http://myorg/", "myorg", "/", None), ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/"), ("https://x.com/de/a#z", "x.com", "/de/a", "com/de/"),
    ("https://x.com/FR/a", "x.com", "/FR/a", None), ("http://İ.org/ä?b", "İ.org", "/ä", "org/"), ("http://x.org\n.y/p", "x.org\n.y", "/p", None),
]


def test_fixed_rules(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, "http://x.org/a"), (6, "http://ORG/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as tokens", "2 as verdict")
    got = {(r.page_id, r.host, r.path, r.rule) for r in judge_urls(pages).collect()}
    assert got == {(i, h, p, r) for i, (_, h, p, r) in enumerate(URLS)} | {(None, "x.org", "/a", "org/")}
    verdicts = {r.rule: r.verdict for r in judge_urls(pages).collect() if r.rule}
    assert verdicts == {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert judge_urls(pages.limit(0)).count() == 0


def mined_by_force(labelled, support, confidence):
    """Rules from all token sets: (tokens, verdict) -> (confidence, support)."""
    sets, with_label, n = Counter(), Counter(), len(labelled)
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                sets[part] += 1
                with_label[part, verdict] += 1
    rules = {key: (m / sets[key[0]], m / n) for key, m in with_label.items() if m >= support * n - 1e-9 and m / sets[key[0]] >= confidence}
    return {
        (part, v): x
        for (part, v), x in rules.items()
        if not any(w == v and set(other) < set(part) and y[0] >= x[0] for (other, w), y in rules.items())
    }


@pytest.mark.parametrize("support, confidence", [(0.01, 0.8), (0.05, 0.6)])
def test_mined_rules(spark, support, confidence):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    url = F.col("url")
    tokens = {r.page_id: r.t for r in pages.select("page_id", tokens_of(host_of(url), path_of(url)).alias("t")).collect()}
    got = judge_urls(pages, min_support=support, min_confidence=confidence).collect()
    rules = mined_by_force([(tokens[r.page_id], r.verdict) for r in got if r.rule], support, confidence)
    assert rules
    for r in got:
        if not r.rule:
            fits = [(round(c, 9), round(s, 9), len(p), v == "block", v) for (p, v), (c, s) in rules.items() if set(p) <= set(tokens[r.page_id])]
            assert r.verdict == (max(fits)[-1] if fits else "allow"), (r, fits)


def test_deep_urls_end(spark):
    """Paths that share forty segments, all or all but one, in a corpus of ten thousand URLs."""
    deep = [f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = []
    for i in range(10_000):
        host = ["a.org", "x.com", "y.example.org"][i % 3]
        if i % 20 == 0:
            path = "/".join(["fr" if i % 40 else "de", *deep])
        elif i % 20 == 1:  # one missing each, so that no two segments occur in the same rows
            path = "/".join(["fr" if i % 3 else "de", *deep[: i % 39], *deep[i % 39 + 1 :]])
        else:
            path = f"en/{i % 7}/" + "q" * (i % 50)
        rows.append((i, f"http://{host}/{path}"))
    rows += [(20_000, "http://z.net/" + "/".join(["de", *deep])), (20_001, "http://z.net/" + "d/" * 20_000)]
    began = time.time()
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(4)).collect()}
    assert len(got) == len(rows) and time.time() - began < 60
    assert got[20_001].verdict == "allow" and got[20_000].rule is None
    assert all(got[i].verdict == "block" for i in range(10_000) if got[i].rule in ("com/de/", "example.org/es/", "example.org/en/1"))


def test_tokens_of_the_same_rows_are_one_class(spark):
    labelled = [(["h:a", "p0:x", "p1:y"], "block")] * 30 + [(["h:a", "p0:z"], "allow")] * 30 + [(["h:b", "p0:x", "p1:y"], "block")] * 20 + [(["h:b"], "allow")] * 9
    df = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules, classes = mine_rules(spark, df, 0.05, 0.8)
    assert {r.token: r["class"] for r in classes.collect()} == {"h:a": "h:a", "h:b": "h:b", "p0:x": "p0:x", "p1:y": "p0:x", "p0:z": "p0:z"}
    found = {(tuple(r.classes), r.verdict, r.lead, round(r.confidence, 6), round(r.support, 6)) for r in rules.collect()}
    assert found == {(("p0:x",), "block", "p0:x", 1.0, round(50 / 89, 6)), (("p0:z",), "allow", "p0:z", 1.0, round(30 / 89, 6))}
    urls = spark.createDataFrame([(["h:b", "p1:y"],), (["h:a"],), (["p0:z", "p9:q"],), ([],)], "tokens array<string>")
    got = {tuple(r.tokens): r.mined for r in match_rules(urls, rules, classes).collect()}
    assert got == {("h:b", "p1:y"): "block", ("p0:z", "p9:q"): "allow"}


def test_rows_with_many_classes_are_mined_whole(spark):
    """What decides are the most frequent of eleven classes, which rows with all of them bring too."""
    rng = random.Random(1)
    tokens = [f"p{k}:{chr(97 + k)}" for k in range(11)]
    chance = [0.6] * 8 + [0.8, 0.85, 0.9]
    labelled, urls = [], []
    for i in range(240):
        own = [t for t, c in zip(tokens, chance) if rng.random() < c] if i % 20 else tokens
        decided = tokens[9] in own and tokens[10] in own and tokens[i % 2] in own
        labelled.append((own, "block" if decided == (rng.random() < 0.95) else "allow"))
    for _ in range(60):
        urls.append([t for t, c in zip(tokens, chance) if rng.random() < c - 0.1])
    urls = [list(u) for u in {tuple(u) for u in urls + [tokens]}]
    expected = mined_by_force([(t, v) for t, v in labelled], 0.1, 0.7)
    df, open_urls = spark.createDataFrame(labelled, "tokens array<string>, verdict string"), spark.createDataFrame([(u,) for u in urls], "tokens array<string>")
    rules, classes = mine_rules(spark, df, 0.1, 0.7, urls=open_urls)
    found = {(tuple(sorted(r.classes)), r.verdict): (r.confidence, r.support) for r in rules.collect()}

    def fitting(of):
        return {(p, v, round(c, 9), round(s, 9)) for (p, v), (c, s) in of.items() if any(set(p) <= set(u) for u in urls)}

    assert fitting(found) == fitting(expected) and any(len(p) > 1 for p, *_ in fitting(expected))
    got = {tuple(r.tokens): r.mined for r in match_rules(open_urls, rules, classes).collect()}
    for u in urls:
        fits = [(round(c, 9), round(s, 9), len(p), v == "block", v) for (p, v), (c, s) in expected.items() if set(p) <= set(u)]
        assert got.get(tuple(u)) == (max(fits)[-1] if fits else None)
