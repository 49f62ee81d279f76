import hashlib
import random
import re
import zlib
from fractions import Fraction

from sediment.llm.periodic import periodic_runs, run_digests, runs_of


def runs_by_force(words, times=4, least=6):
    """Every maximal stretch that has a period, kept where no smaller one holds it too."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        start = 0
        while start < n - q:
            end = start
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, times * q) and (start, length) not in found:
                found[start, length] = q
            start = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def digests_by_force(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(runs_by_force(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def repetitive(rng, letters):
    out = []
    while rng.random() < 0.8 or not out:
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        out += (piece * rng.randint(1, 9))[: rng.randint(1, 45)]
        if rng.random() < 0.4:
            out = out * rng.randint(1, 5)
    return out[:600]


def test_runs():
    rng = random.Random(11)
    for _ in range(400):
        words = repetitive(rng, rng.choice(["ab", "abc", "abcdefghij"]))
        assert runs_of(words) == runs_by_force(words), words
        assert runs_of(words, 3, 2) == runs_by_force(words, 3, 2)
    assert runs_of([]) == [] and runs_of(["a"] * 6) == [(0, 6, 1)] and runs_of(["a"] * 5) == []


def test_documents(spark, texts):
    rng = random.Random(12)
    rows = [(i, " ".join(repetitive(rng, rng.choice(["ab", "abcde", [f"w{k}" for k in range(40)]])))) for i in range(150)]
    rows += [(1000 + i, rng.choice([" ", "\n", "\t\x0b"]).join(f"é{rng.randint(0, 300)}" for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \n\x0c"), (2003, "a\xa0a " * 9), (2004, "x " * 2_000), (2005, " ".join(map(str, range(400))) * 5), (None, "b " * 9), (5, "c " * 6), (5, "c " * 6)]
    planted_ids = [i for i in range(3000, 3400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"t{rng.randint(0, 500)}" for _ in range(rng.randint(1, 300)))) for i in planted_ids]
    rows += [(planted_ids[0], None), (planted_ids[1], ""), (planted_ids[2], "one")]
    got = sorted((tuple(r) for r in run_digests(texts(rows)).collect()), key=repr)
    assert got == sorted((digests_by_force(*r) for r in rows), key=repr)
    assert sum(g[1] > 0 for g in got if g[0] in planted_ids) > 0.6 * len(planted_ids)


def test_collapsed_text_and_empty_table(spark, texts):
    got = periodic_runs(texts([(1, "so  far no no no no no no no way")])).first()
    assert got.collapsed == "so far no way" and got.n_words == 10
    assert [tuple(r) for r in got.runs] == [(2, 7, 1)] and tuple(got.strongest) == (2, 7, 1)
    assert run_digests(texts([])).count() == 0
    long = periodic_runs(texts([(1, "x " * 100_000), (2, "y " + "a b c " * 50_000)])).collect()
    assert {(r.doc_id, r.collapsed, tuple(r.strongest)) for r in long} == {(1, "x", (0, 100_000, 1)), (2, "y a b c", (1, 150_000, 3))}
