import random

import numpy as np
import pyarrow as pa

from sediment.llm.textbytes import BASE, PRIME, Texts, _VALUES, inverse_power, power, product, run_hash, table


def thue_morse(size):
    """The two words over a and b of a power of two of letters, unlike at every place."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_arithmetic_modulo_the_prime():
    rng = random.Random(1)
    a = [0, 1, PRIME - 1, PRIME - 1] + [rng.randrange(PRIME) for _ in range(500)]
    b = [PRIME - 1, 0, PRIME - 1, 2] + [rng.randrange(PRIME) for _ in range(500)]
    assert product(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % PRIME for x, y in zip(a, b)]
    assert power(1000).tolist() == [pow(BASE, k, PRIME) for k in range(1000)]
    down = inverse_power(np.arange(20_000)).tolist()
    assert [x * y % PRIME for x, y in zip(power(20_000).tolist(), down)] == [1] * 20_000
    assert len(power((1 << 20) + 5)) == (1 << 20) + 5 and int(power((1 << 20) + 5)[-1]) == pow(BASE, (1 << 20) + 4, PRIME)


def test_prefix_sums():
    data = bytes(random.Random(2).randrange(256) for _ in range(5000)) + b"\xff" * 3000
    laid = Texts(pa.array([data], pa.binary()))
    total, expected = 0, [0]
    for k, x in enumerate(data):
        total = (total + int(_VALUES[x]) * pow(BASE, k, PRIME)) % PRIME
        expected.append(total)
    assert laid.prefix().tolist() == expected


def test_equal_bytes_have_equal_hashes_and_only_they():
    words = [w for size in (1024, 2048, 4096, 16384, 65536) for w in thue_morse(size)] + ["a", "aa", "b", "ab", "ba", "é"]
    laid = Texts(pa.array([" ".join(words), "", " ".join(reversed(words))]))
    space = table("".join(map(chr, range(33, 127))), high=True)
    starts, ends, of = laid.words(space)
    hashes = run_hash(laid.prefix(), starts, ends)
    one, two = hashes[of == 0].tolist(), hashes[of == 2].tolist()
    assert one == two[::-1] and len(set(one)) == len(words) and 1 not in of


def test_unlike_long_words_in_the_operators(spark, texts):
    from sediment.llm.jaccard import near_documents
    from sediment.llm.lm import score_texts
    from sediment.llm.substrings import repeated_bytes
    from tests.llm import test_lm, test_near, test_substrings

    rows = []
    for size in (1024, 4096, 65536):
        rows += [(len(rows) + k, w) for k, w in enumerate(thue_morse(size))]
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score) for r in score_texts(spark, texts(rows)).collect()}
    for i, _, n, known, _, base, _ in test_lm.by_force(rows):
        assert got[i][:2] == (n, known) and abs(got[i][2] - base) < 1e-9
    assert {tuple(r) for r in near_documents(spark, texts(rows)).collect()} == test_near.similar(rows)
    removed = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(spark, texts(rows)).collect()}
    assert removed == test_substrings.by_force(rows)
