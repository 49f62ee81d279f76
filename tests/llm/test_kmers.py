import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import kmers
from sediment.llm.kmers import repeated_words, super_kmers, window_ranks, word_digests


def by_force(rows, window=13):
    lists = [(-(1 << 63) if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for key, _, w in lists:
        for k in range(len(w) - window + 1):
            at = tuple(w[k : k + window])
            first[at] = min(first.get(at, key), key)
    out = []
    for key, i, w in lists:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(250)]
    text = lambda n: rng.choice([" ", "\n", " \t"]).join(rng.choice(words) for _ in range(n))
    passages, rows = [text(n) for n in (13, 14, 30, 60)], []
    for i in range(220):
        kind = rng.random()
        if kind < 0.2 and rows:
            rows.append((i, rows[rng.randrange(len(rows))][1]))
        elif kind < 0.7:
            rows.append((i, f"{text(rng.randint(0, 30))} {rng.choice(passages)} {text(rng.randint(0, 30))}"))
        else:
            rows.append((i, rng.choice([None, "", " \n", "the " * rng.randint(0, 60), "a b " * rng.randint(0, 30) + text(9), text(200)])))
    rng.shuffle(rows)
    return rows + [(500, "z " * 12), (501, "z " * 13), (502, "z " * 40), (503, "long word " * 8_000), (504, "x" * 50_000 + " " + passages[3]), (505, passages[2].replace(" ", "\xa0"))]


@pytest.mark.parametrize("share, most, at_once", [(4096, 20_000, 20_000), (4096, 3, 5), (1, 20_000, 20_000)])
def test_removed_words(spark, texts, monkeypatch, share, most, at_once):
    monkeypatch.setattr(kmers, "BUCKET_ROWS", most)
    monkeypatch.setattr(kmers, "SORTED_ROWS", at_once)
    rows = corpus()
    if share == 1:  # as if every bucket were a frequent one
        every = np.unique(super_kmers(pa.array([t for _, t in rows]))[0].view(np.int64))
        monkeypatch.setattr(kmers, "frequent_buckets", lambda *_: every)
    assert sorted(map(tuple, word_digests(spark, texts(rows)).collect()), key=repr) == by_force(rows)


def test_odd_ids(spark, texts):
    long = " ".join(map(str, range(40)))
    rows = [(1, long), (1, long), (1, long + " more"), (2, "so " + long), (None, long[20:]), (None, None), (3, None), (3, None)]
    assert sorted(map(tuple, word_digests(spark, texts(rows)).collect()), key=repr) == by_force(rows)
    assert word_digests(spark, texts([])).count() == 0


def test_spans_and_text(spark, texts):
    line = " ".join(f"w{k}" for k in range(13))
    got = {r.doc_id: r for r in repeated_words(spark, texts([(1, line), (2, f"a {line}\nb  {line}")])).collect()}
    assert got[1].kept == line and got[2].kept == "a b"
    assert [tuple(s) for s in got[2].spans] == [(1, 14), (15, 28)]


def test_frequent_buckets(spark, texts):
    hot = " ".join(f"w{k}" for k in range(16))
    rng = random.Random(4)
    rows = [(i, hot if i % 3 else " ".join(str(rng.randint(0, 10**9)) for _ in range(16))) for i in range(3000)]
    found = kmers.frequent_buckets(spark, texts(rows))
    bucket = super_kmers(pa.array([hot]))[0].view(np.int64)
    assert sorted(bucket.tolist()) == found.tolist()
    assert len(kmers.frequent_buckets(spark, texts([]))) == 0


def test_every_window_is_in_one_super_kmer():
    rng = random.Random(5)
    lists = [[rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randint(0, 80))] for k in range(60)]
    bucket, of, start, count = super_kmers(pa.array([" ".join(w) for w in lists]))
    assert (count > 0).all() and (count <= 10).all()
    met = sorted((int(t), int(s) + j) for t, s, n in zip(of, start, count) for j in range(n))
    assert met == [(t, k) for t, w in enumerate(lists) for k in range(len(w) - 12)]
    by_window = {}
    for b, t, s, n in zip(bucket, of, start, count):
        for j in range(n):
            by_window.setdefault(tuple(lists[t][s + j : s + j + 13]), set()).add(int(b))
    assert all(len(x) == 1 for x in by_window.values())


def test_window_ranks():
    words = np.random.default_rng(1).integers(0, 2, 500)
    for window in (1, 2, 5, 8, 13):
        rank = window_ranks(words, window)
        content = [tuple(words[k : k + window]) for k in range(500 - window + 1)]
        assert len(rank) == len(content) and len(set(zip(rank.tolist(), content))) == len(set(content)) == len(set(rank.tolist()))
