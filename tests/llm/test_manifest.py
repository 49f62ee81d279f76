import hashlib
import random
import zlib

import pytest

from sediment.llm.manifest import verified_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan=16):
    """The root over digests, and for each the steps (left, right) to it."""
    ways, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        new, merged = [], []
        for s in range(0, len(nodes), fan):
            part = nodes[s : s + fan]
            for j in range(len(part)):
                for k in groups[s + j]:
                    ways[k].append(("".join(part[:j]), "".join(part[j + 1 :])))
            new.append(h(*part))
            merged.append([k for j in range(len(part)) for k in groups[s + j]])
        nodes, groups = new, merged
    return nodes[0], ways


def by_force(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        parts.append((own, *tree([leaf(*r) for r in own])))
    root, tops = tree([p[1] for p in parts])
    out = []
    for (own, subroot, ways), top in zip(parts, tops):
        for r, way in zip(own, ways):
            way = way + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], r[1].translate(lower) if changed and r[1] is not None else r[1], *r[2:])
            for left, right in way:
                node = h(left, node, right)
            out.append((r[0], leaf(*r), subroot, root, h(*(x + y for x, y in way)), node, node == root))
    return out


def corpus(sources, n):
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "ABC é Zz", "lower", "x" * 5000, " ".join(rng.choice("ABCabcÄ") for _ in range(30))])
    return [(i, text(), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 0, -7, i])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        corpus(["a"] * 30 + ["b", None, "", "é", "Z"], 700),
        corpus([f"s{k}" for k in range(40)] + ["hot"] * 40, 400),
        corpus(["one"], 273),
        corpus(["one"], 1),
        corpus([f"s{k}" for k in range(2000)], 60),
        [(1, "a", "en", "s", 1)] * 3 + [(1, "B", "en", "s", 1), (None, "N", None, None, None), (None, None, None, None, None), (2, "x" * 100_000, "", "", 0)],
    ],
)
def test_proofs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as nth", "'x' as `a.b`", "3 as digest").repartition(5)
    got = sorted(map(tuple, verified_documents(spark, df).collect()), key=repr)
    assert got == sorted(by_force(rows), key=repr)


def test_empty_table(spark):
    out = verified_documents(spark, spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
