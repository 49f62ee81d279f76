import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import lm
from sediment.llm.lm import Filter, expected, level, score_texts, segment

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows):
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)) + ["\0end"]) for i, t in rows]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    one, two = Counter(), Counter()
    for i, t in toks:
        if not held[i]:
            one.update(t)
            two.update(zip(["\0start"] + t, t))
    n, v = sum(one.values()), len(one)
    count = lambda c: float(expected(level(np.array([c])))[0])
    out = []
    for i, t in toks:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for before, w in zip(["\0start"] + t, t):
            context = count(one["\0end" if before == "\0start" else before])
            single = (count(one[w]) + 1) / (n + v + 1)
            both = lm.WEIGHT * min(1, count(two[before, w]) / max(context, 1)) + (1 - lm.WEIGHT) * single
            score += math.log10(min(1.0, both if context else single))
        out.append((i, held[i], len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("texts_at_once", [60_000, 3])
def test_scores(spark, texts, monkeypatch, texts_at_once):
    monkeypatch.setattr(lm, "BATCH_TEXTS", texts_at_once)
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = real + [(9000, None), (9001, ""), (9002, "\x0b \x0c"), (9003, "Ä ä A\xa0a"), (9004, "the " * 70_000), (None, "the of")]
    got = sorted((tuple(r) for r in score_texts(spark, texts(rows), least_count=2).collect()), key=repr)
    want = sorted(by_force(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=0.05)  # the filter's false positives
    assert sum(g[6] for g in got) == pytest.approx(sum(w[6] for w in want), rel=0.005)


def test_nothing_to_learn_from(spark, texts):
    assert score_texts(spark, texts([])).count() == 0
    got = score_texts(spark, texts([(None, "a b"), (None, None)])).collect()
    assert {tuple(r) for r in got} == {(None, True, 3, 0, 0, 0.0, 0.0), (None, True, 1, 0, 0, 0.0, 0.0)}
    twice = score_texts(spark, texts([(1, "a"), (1, "a")])).collect()
    assert [r.n_tokens for r in twice] == [2, 2]


def test_filter_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    counts = rng.integers(1, 3000, 5000)
    left, right = h < 1 << 63, h >= 1 << 63
    parts = [segment(h[side], counts[side], 1 << 24) for side in (left, right)]
    size = np.array([len(p) * 8 for p in parts])
    found = Filter(1, np.concatenate(parts), np.array([0, size[0]]), size, 1, 1).levels(h)
    assert (found >= level(counts)).all() and (found == level(counts)).mean() > 0.97
    assert level(np.array([0, 1, 2, 3, 4, 1024])).tolist() == [0, 0, 1, 1, 2, 10]


def test_segments_grow_and_probing_ends():
    h = np.random.default_rng(2).integers(0, 1 << 63, 60_000, dtype=np.uint64)
    grown = segment(h, np.full(len(h), 2))
    assert len(grown) * 8 >= lm.ENTRY_BITS * len(h)
    full = np.full(8, 255, np.uint8)  # every probe hits
    assert (Filter(0, full, np.zeros(1, int), np.array([64]), 1, 1, np.array([3])).levels(h) == 3).all()


def test_a_filter_in_several_groups_gives_the_same_scores(spark, texts, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9004, "the " * 70_000), (None, "the of")]
    monkeypatch.setattr(lm, "RANGE_BYTES", 100_000)
    monkeypatch.setattr(lm, "BATCH_TEXTS", 7)  # batches that begin inside those that arrive
    want = sorted((tuple(r) for r in score_texts(spark, texts(rows)).collect()), key=repr)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 40_000)
    broadcast = []
    monkeypatch.setattr(lm, "_segments", lambda *a, f=lm._segments: broadcast.append(f(*a)) or broadcast[-1])
    got = sorted((tuple(r) for r in score_texts(spark, texts(rows)).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[6] for g in got] == [w[6] for w in want]
    assert len(broadcast) > 2 and max(len(b.data) for b in broadcast) < 80_000
    monkeypatch.undo()
    one = sorted((tuple(r) for r in score_texts(spark, texts(rows)).collect()), key=repr)
    assert [o[:6] for o in one] == [(*w[:5], pytest.approx(w[5], rel=1e-12)) for w in want]  # other ranges, the same exact sums
    assert {tuple(r)[-1] for r in score_texts(spark, texts([(None, "a b")])).collect()} == {0.0}


def by_exact_counts(rows):
    """Scores of the same mixture, with exact counts in place of quantised ones."""
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)) + ["\0end"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, t in toks:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            two.update(zip(["\0start"] + t, t))
    total, out = sum(one.values()) + len(one) + 1, {}
    for i, t in toks:
        chances = []
        for before, w in zip(["\0start"] + t, t):
            context, single = one["\0end" if before == "\0start" else before], (one[w] + 1) / total
            chances.append(lm.WEIGHT * min(1, two[before, w] / context) + (1 - lm.WEIGHT) * single if context else single)
        out[i] = sum(map(math.log10, chances))
    return out


@pytest.mark.parametrize("broadcast", [64 << 20, 1])
def test_what_is_seen_once_is_known(spark, texts, tmp_path, monkeypatch, broadcast):
    from sediment.llm.queries import op9_scores

    monkeypatch.setattr(lm, "BROADCAST_BYTES", broadcast)
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    seen = next(i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = [i for i in range(9100, 9200) if zlib.crc32(str(i).encode()) % 7 == 2]
    line = [f"once{k}" for k in range(40)]
    rows = real + [(seen, " ".join(line)), (held[0], " ".join(line)), (held[1], " ".join(line[::-1]))]
    texts(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in op9_scores(spark, str(tmp_path)).collect()}
    want = by_exact_counts(rows)
    assert got[held[0]] == pytest.approx(want[held[0]], rel=0.05)
    assert got[held[0]] > 0.2 * got[held[1]]  # the same words in an order that was never seen
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)


def test_texts_are_hashed_in_small_pieces(monkeypatch):
    """Tokens and levels are the same however many texts are hashed or n-grams probed at a time, and that stays bounded."""
    texts = pa.array(["", None, "A b  a", "\t", *(f"w{k % 7} x{k} é" * 9 for k in range(400)), "z" * 5000], pa.string())
    whole, laid = lm.Tokens(texts), []
    pairs = np.unique(whole.pairs(3))
    held = lm.Filter(3, np.random.default_rng(1).integers(0, 256, 1 << 10, dtype=np.uint8), np.arange(8) * 1024, np.full(8, 1024), 1, 1, np.full(8, 4))
    levels = held.levels(pairs)
    monkeypatch.setattr(lm, "_HASHED_BYTES", 2000)
    monkeypatch.setattr(lm, "_PROBED", 64)
    monkeypatch.setattr(lm, "Texts", lambda column, of=lm.Texts: laid.append(of(column)) or laid[-1])
    pieces = lm.Tokens(texts)
    for name in ("token", "of", "previous", "counts"):
        assert np.array_equal(getattr(whole, name), getattr(pieces, name))
    assert len(laid) > 5 and max(len(x.data) for x in laid[:-1]) <= 2000 and len(laid[-1].data) == 5000
    assert np.array_equal(held.levels(pairs), levels) and len(set(levels.tolist())) > 1
