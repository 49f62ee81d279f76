import random
import re

import numpy as np
import pytest

from sediment.llm import embeddings, jaccard
from sediment.llm.components import components
from sediment.llm.embeddings import near_vectors, tables_for
from sediment.llm.groups import roots
from sediment.llm.jaccard import near_documents, runs_for


def joined(ids, links):
    """(id: smallest id that it reaches)."""
    found = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            changed |= found[a] != low or found[b] != low
            found[a] = found[b] = low
    return found


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (1000, 3)] * 2
    ids = {i for link in links if link[0] != link[1] for i in link}
    df = spark.createDataFrame(links + [(None, 4)], "a long, b long")
    assert {r.id: r.component for r in components(spark, df).collect()} == joined(ids, [x for x in links if x[0] != x[1]])
    assert components(spark, df.limit(0)).count() == 0
    a, b = np.array([0, 4, 2]), np.array([4, 3, 5])
    assert roots(6, a, b).tolist() == [0, 1, 2, 0, 0, 2]


def by_force(rows, threshold=0.93):
    fit = {}
    for k, (i, v, label) in enumerate(rows):
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fit[k] = np.array(v, float) if ok else None
    links = [
        (a, b)
        for a in fit
        for b in fit
        if a != b and fit[a] is not None and fit[b] is not None and rows[a][2] == rows[b][2] and len(fit[a]) == len(fit[b])
        and fit[a] @ fit[b] / np.sqrt((fit[a] @ fit[a]) * (fit[b] @ fit[b])) >= threshold
    ]
    ids = [r[0] for r in rows]
    group = joined(ids, [(ids[a], ids[b]) for a, b in links])
    return {(i, sum(a == k for a, _ in links), group[i], group[i] == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [4096, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            middle = rng.standard_normal(24)
            for noise in (0, 0, 0.15, 0.25, 0.3, 0.45):
                v = middle * rng.uniform(0.5, 2) + noise * rng.standard_normal(24)
                rows.append([len(rows), [float(np.float32(x)) for x in v], label])
    rows[3][1] = list(rows[2][1])
    for odd in (None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [None] * 24, [1e30] * 24):
        rows.append([len(rows), odd, 0])
    df = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as v", "3 as component")
    got = near_vectors(spark, df.union(df.limit(5)).repartition(3)).collect()
    assert {tuple(r) for r in got} == by_force([tuple(r) for r in rows]) and len(got) == len(rows)
    assert near_vectors(spark, df.limit(0)).count() == 0
    assert near_vectors(spark, spark.createDataFrame([(None, [1.0], 1), (None, None, None)], "vec_id long, embedding array<double>, label int")).count() == 2


def test_recall_formulas():
    assert tables_for(8, 0.93, 0.99) > tables_for(4, 0.93, 0.99) and tables_for(4, 1.0, 0.99) == 1
    assert runs_for(0.999) >= runs_for(0.99) >= 5


def similar(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    group = joined(sets, links)
    return {(i, sum(a == i for a, _ in links), group[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("bucket", [1024, 6])
def test_near_documents(spark, texts, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = []
    for _ in range(14):
        whole = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(whole)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", ", ", "\n"]).join(copy)))
    line = " ".join(rng.choice(words) for _ in range(15))
    rows += [(len(rows) + k, line + " " + " ".join(rng.choice(words) for _ in range(20))) for k in range(10)]
    rows += [(900, None), (901, ""), (902, " . "), (903, "ONE, two"), (904, "one two"), (905, "x " * 30_000), (906, "x " * 29_000)]
    got = near_documents(spark, texts(rows)).collect()
    assert {tuple(r) for r in got} == similar(rows) and len(got) == len(rows)


def test_near_documents_with_odd_ids(spark, texts):
    assert near_documents(spark, texts([])).count() == 0
    long = " ".join(map(str, range(50)))
    got = near_documents(spark, texts([(1, long), (1, long), (2, long + " z"), (None, long), (3, "a b"), (3, "c d"), (4, "a b\nc d")]))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True)]
