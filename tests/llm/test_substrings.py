import hashlib
import random

import pytest

from sediment.llm import substrings
from sediment.llm.substrings import IndexFamily, merge_scan, repeated_bytes


def by_force(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé\0") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages, line, rows = [text(40) for _ in range(5)], text(30), []
    for i in range(140):
        kind = rng.random()
        if kind < 0.2 and rows:
            rows.append((i, rows[rng.randrange(len(rows))][1]))
        elif kind < 0.5:
            rows.append((i, text(rng.randint(0, 80)) + rng.choice(passages)[rng.randint(0, 50) :] + text(rng.randint(0, 60))))
        elif kind < 0.7:
            rows.append((i, f"{text(20)}\n{line}\n{text(20)}"))
        else:
            rows.append((i, rng.choice([None, "", "a" * rng.randint(0, 700), "ab" * rng.randint(0, 300) + text(9), "Lag. " * 40, text(300)])))
    return rows + [(500, "z" * 99), (501, "z" * 100), (502, "z" * 101), (503, "long " * 40_000)]


@pytest.mark.parametrize("hot, shard", [(5000, 20_000), (3, 20_000), (5000, 40)])
def test_removed_bytes(spark, texts, monkeypatch, hot, shard):
    monkeypatch.setattr(substrings, "HOT_ROWS", hot)
    monkeypatch.setattr(substrings, "SHARD_ROWS", shard)
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(spark, texts(rows)).collect()}
    assert got == by_force(rows)


def test_odd_rows(spark, texts):
    assert repeated_bytes(spark, texts([])).count() == 0
    long = "".join(map(str, range(100)))
    got = repeated_bytes(spark, texts([(1, long), (1, long), (2, long), (None, long), (1, long + "!")])).collect()
    # null comes first; equal rows are one; the texts of one id are taken in the order of their hash
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == [("1", 190, 190), ("1", 191, 190), ("2", 190, 190), ("None", 190, 0)]


def test_levels_merge_by_size():
    rng, family, seen = random.Random(1), IndexFamily(), set()
    for _ in range(30):
        batch = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(6, 12))) for _ in range(rng.randint(1, 9))]
        for context, old in zip(batch, merge_scan(family, batch, 6)):
            for place, known in enumerate(old):
                assert known == (context[place : place + 6] in seen)
                seen.add(context[place : place + 6])
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
