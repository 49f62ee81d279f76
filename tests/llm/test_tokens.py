import zlib
from collections import defaultdict

import numpy as np
import pytest

from sediment.llm.packing import Piece, Windows, pack
from sediment.llm.token_counts import token_counts
from sediment.llm.tokenizing import encoder, public_path

ODD = [
    "", " ", "a  \n b", "x <|endoftext|> y  <|endoftext|>z", "  lead", "trail \n ", "it's  we'll 'sword\tİI ΣΑΣ é ́x", "AbC. É, é, x.́ . ,a !., word.\x0b x\xa0\xa0\n y",
    "I'M THE'S don't. o'clock, x<|endoftext|>. a.,", "K ſt", "日本語のテキスト です。", "  a　 b", "3.14 1,000 a_b [x] {y}~", "x" * 5000, "é" * 300 + " ß ẞ", "a\r\n\r\nb\t\tc",
]


def library(name, texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_path(name)).encode_batch(texts, add_special_tokens=False)
    return [np.asarray(e.ids, "<u4").tobytes() for e in found]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name, spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + real + [t.upper() for t in real[:20]]
    encode = encoder(name)
    encode.entries = 2000  # forgets pieces on the way
    assert encode.ids(texts) == library(name, texts)


def test_counts_whole_texts(texts):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (3, ODD[3]), (None, "a b")]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(texts(rows), limit=3).collect()}
    want = {(i, len((t or "").encode()), len(ids) // 4, len(ids) // 4 > 3) for (i, t), ids in zip(rows, library("byte_bpe_50k.json", [t or "" for _, t in rows]))}
    assert got == want
    assert token_counts(texts([])).count() == 0


def test_packing_holds_every_id_once(texts):
    real = [(i, ("word%d stuff, " % (i % 7)) * (i * 37 % 3000)) for i in range(120)]
    rows = real + [(200 + i, t) for i, t in enumerate(ODD)] + [(300, None), (None, "a b")]
    pieces = pack(texts(rows, 2), most_open=5).collect()
    ids = {i: x + np.asarray([1], "<u4").tobytes() for (i, _), x in zip(rows, library("word_bpe_49k.json", [t or "" for _, t in rows]))}
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(of) == set(ids)
    for i, found in of.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i]) // 4 and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[i][4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids[i]) // 4
    short = 0
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        short += at < 2048
    assert short <= 2  # one for each task
    assert pack(texts([])).count() == 0


def test_a_piece_goes_where_the_squares_stay_smallest():
    rng, capacity = np.random.default_rng(1), 16
    windows = Windows(capacity)
    for _ in range(400):
        size = int(rng.integers(1, capacity))
        counts = windows.count.copy()

        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < capacity:
                after[level + size] += 1
            return int((after[1:capacity] ** 2).sum())

        open_levels = [h for h in range(1, capacity - size + 1) if counts[h]] + [0]
        chosen = windows.level_for(size)
        assert squares(chosen) == min(map(squares, open_levels))
        windows.place(Piece(0, 0, size, size, b"\0" * 4 * size))
