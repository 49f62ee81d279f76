"""Language-model scores from a log-frequency Bloom filter, and exact unigram scores.

N-grams are dealt out by ranges of their hashes, of which there are as many as the text needs, so that what a range holds,
is asked and answers stays as small for any input. Each range has a segment of the filter. Segments are broadcast in
groups of bounded size, one group after another; the levels that a group tells are kept with the texts until the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.components import stored
from sediment.llm.textbytes import Texts, mix, pieces_of, run_hash, table
from sediment.session import scratch_dir
from sediment.sources import filesystem

#: A word is a run of bytes other than these.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_SPACE = ~table(SPACE)
_START, _END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5B)
_K1, _K2, _K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
#: Bits of the filter for each entry, probes for each entry, and the most bytes of segments that are broadcast at once.
ENTRY_BITS, PROBES, BROADCAST_BYTES = 12, 4, 64 << 20
#: Words with at least this share of all tokens, of which there are 2^18 at most, are broadcast with their counts.
HEAVY_SHARE = 2.0**-18
#: Bytes of text for which there is one range of hashes.
RANGE_BYTES = 16 << 20
#: Share of the bigram estimate in a probability.
WEIGHT = 0.6
BATCH_BYTES, BATCH_TEXTS = 4 << 20, 60_000
#: Bytes of text that are hashed, and n-grams that are probed, at a time: what comes in between stays small.
_HASHED_BYTES, _PROBED = 1 << 20, 1 << 16


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 7, is not 2. A null id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


class Tokens:
    """Hashes of the tokens of texts, text after text: the words with A to Z in lower case, then the end."""

    def __init__(self, column: pa.Array):
        n, hashes, of = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces_of(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), _HASHED_BYTES):
            laid = Texts(pc.ascii_lower(pc.fill_null(piece.column("text"), "")))
            starts, ends, text = laid.words(_NOT_SPACE)
            if len(text):
                hashes.append(run_hash(laid.prefix(), starts, ends))
                of.append(text + n)
            n += len(laid)
        of = np.concatenate(of)
        words = np.bincount(of, minlength=n)
        self.counts = words + 1
        self.token = np.empty(len(of) + n, np.uint64)
        last = np.cumsum(self.counts) - 1
        if len(of):
            self.token[np.arange(len(of)) + of] = np.concatenate(hashes)
        self.token[last] = _END
        self.of = np.repeat(np.arange(n), self.counts)
        self.previous = np.append(_START, self.token[:-1])
        self.previous[last - words] = _START

    def pairs(self, bits: int) -> np.ndarray:
        """Hashes of each token with the one before, to 40 bits behind those that name its shard."""
        return mix(self.previous * _K1 + self.token * _K2 + _K3) & np.uint64(0xFFFFFFFFFFFFFFFF << (24 - bits) & 0xFFFFFFFFFFFFFFFF)


def _shards(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The shards, named by the first bits, that sorted hashes are in, with where each begins and ends."""
    shard = (h >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(h)])
    return list(zip(shard[begin].tolist(), begin.tolist(), np.append(begin[1:], len(h)).tolist()))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits behind the shard's, in five bytes each: enough to tell the n-grams of a shard apart."""
    return ((h << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes, shard: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return (wide.view("<u8").ravel() << np.uint64(24 - bits)) | (np.uint64(shard) << np.uint64(64 - bits))


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[at], np.add.reduceat(c, at) if len(at) else c


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count: 0 below 2, then one more for each doubling."""
    return np.maximum(np.frexp(count.astype(np.float64))[1] - 1, 0)


def doubled(count: np.ndarray, least: int) -> np.ndarray:
    """Counts whose levels begin at 1 with ``least``: twice the count if that is 1, as level 0 stands for unseen."""
    return count.astype(np.int64) * (2 // least)


def expected(level: np.ndarray, least: int = 2) -> np.ndarray:
    """The count that stands for a level: the geometric mean of its range; 0 for level 0. Level 1 begins at ``least``."""
    low = np.exp2(level.astype(np.float64)) * least / 2
    return np.where(level > 0, np.sqrt(low * (2 * low - 1)), 0.0)


def _places(h: np.ndarray, step: int, size: int | np.ndarray) -> Iterator[np.ndarray]:
    first = mix(h + np.uint64(step * int(_K3) & 0xFFFFFFFFFFFFFFFF))
    stride = mix(first ^ _K1) | np.uint64(1)
    for i in range(PROBES):
        yield mix(first + np.uint64(i) * stride) % (size if isinstance(size, np.ndarray) else np.uint64(size))


def segment(h: np.ndarray, count: np.ndarray, most_bits: int | None = None) -> np.ndarray:
    """The filter of one shard: each n-gram is entered once for every level up to its own.

    It has ``ENTRY_BITS`` bits for each entry, in whole words of 64; a ceiling holds only if one is given, which
    :func:`score_texts` never does.
    """
    levels = level(count)
    size = 64 * max(1, -(-ENTRY_BITS * int(levels.sum()) // 64))
    if most_bits is not None:
        size = min(size, most_bits)
    bits = np.zeros(size, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(h[levels >= step], step, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Filter(NamedTuple):
    """Segments laid end to end, with where each shard's begins (in bits), its size and the highest level in it, from the
    shard ``first`` on. N-grams of other shards are at level 0 until the group of theirs is asked."""

    bits: int
    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    tokens: int
    distinct: int
    highest: np.ndarray | None = None
    first: int = 0

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels found by repeated probes: one level after the other, until a probe misses or no higher one is there."""
        parts = [self._probed(h[k : k + _PROBED]) for k in range(0, len(h), _PROBED)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _probed(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), np.int64)
        alive, step = np.arange(len(h)), 1
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) - self.first
        alive = alive[(shard >= 0) & (shard < len(self.size))]
        alive = alive[self.size[shard[alive]] > 0]
        while True:
            if self.highest is not None:
                alive = alive[self.highest[shard[alive]] >= step]
            if not len(alive):
                return found
            own, begin, hit = h[alive], self.begin[shard[alive]], np.ones(len(alive), bool)
            for at in _places(own, step, self.size[shard[alive]].astype(np.uint64)):
                at = begin + at.astype(np.int64)
                hit &= ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            alive = alive[hit]
            found[alive] = step
            step += 1


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of the n-grams of each batch, a row for each shard."""
    for batch in pieces_of(batches, BATCH_BYTES):
        tokens = Tokens(batch.column("text"))
        word, n = np.unique(tokens.token, return_counts=True)
        pair, m = np.unique(tokens.pairs(bits), return_counts=True)
        own: dict[int, list[bytes]] = {}
        for shard, x, y in _shards(word, bits):
            own[shard] = [word[x:y].tobytes(), n[x:y].astype("<u4").tobytes(), b"", b""]
        for shard, x, y in _shards(pair, bits):
            own.setdefault(shard, [b"", b"", b"", b""])[2:] = [_short(pair[x:y], bits), m[x:y].astype("<u4").tobytes()]
        rows = [(shard, *packed) for shard, packed in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
            names=["shard", "words", "n", "pairs", "m"],
        )


def _learned(group: pa.Table, bits: int, heavy_share: float, least: int) -> pa.Table:
    """Exact word counts of a shard, its part of the filter, and words that may be among the most frequent."""
    shard = group.column("shard")[0].as_py()
    columns = {c: group.column(c).to_pylist() for c in ("words", "n", "pairs", "m")}
    word, n = _summed([np.frombuffer(x, np.uint64) for x in columns["words"]], [np.frombuffer(x, "<u4") for x in columns["n"]])
    pair, m = _summed([_long(x, shard, bits) for x in columns["pairs"]], [np.frombuffer(x, "<u4") for x in columns["m"]])
    entered = doubled(np.concatenate([n, m]), least)
    filled, highest = segment(np.concatenate([word, pair]), entered), int(level(entered).max(initial=0))
    heavy = np.flatnonzero(n >= max(1, n.sum() * heavy_share))
    often = pa.array([[{"word": w, "n": k} for w, k in zip(word[heavy].view(np.int64).tolist(), n[heavy].tolist())]], pa.list_(_WORD_COUNT))
    return pa.table(
        {
            "shard": [shard], "tokens": [int(n.sum())], "distinct": [len(word)], "words": [word.tobytes()], "n": [n.astype("<i8").tobytes()],
            "filter": [filled.tobytes()], "highest": [highest], "heavy": often,
        }
    )


_LEARNED = "shard long, tokens long, distinct long, words binary, n binary, filter binary, highest long, heavy array<struct<word:long,n:long>>"
_WORD_COUNT = pa.struct([("word", pa.int64()), ("n", pa.int64())])
_PACKED = "key long, kind int, batch long, texts long, a binary, b binary, c binary, d binary"
_LEVELLED = "doc_id long, held_out boolean, text string, levels binary"


def _levels(tokens: Tokens, word: np.ndarray, of_word: np.ndarray, held: Filter, known: pa.Array | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the level of its word and of its pair, by the segments at hand and by what earlier groups told."""
    pair, of_pair = np.unique(tokens.pairs(bits), return_inverse=True)
    single, both = held.levels(word).astype(np.uint8)[of_word], held.levels(pair).astype(np.uint8)[of_pair]
    if known is not None:
        known = known.cast(pa.large_binary())
        _, offsets, data = known.buffers()
        ends = np.frombuffer(offsets, np.int64)[known.offset : known.offset + len(known) + 1]
        before = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, 2)
        single, both = np.maximum(single, before[:, 0]), np.maximum(both, before[:, 1])
    return single, both


def _levelled(batches: Iterator[pa.RecordBatch], bits: int, model) -> Iterator[pa.RecordBatch]:
    """The texts with two bytes for each of their tokens: the levels of its word and its pair, as far as they are known."""
    for batch in pieces_of(batches, BATCH_BYTES):
        tokens = Tokens(batch.column("text"))
        word, of_word = np.unique(tokens.token, return_inverse=True)
        known = batch.column("levels") if "levels" in batch.schema.names else None
        both = np.stack(_levels(tokens, word, of_word, model.value, known, bits), axis=1)
        ends = np.append(0, np.cumsum(tokens.counts) * 2).astype(np.int32)
        levels = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(both.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text"), levels], names=["doc_id", "held_out", "text", "levels"])


def _log_chances(counts: np.ndarray, seen: np.ndarray, both: np.ndarray, total: int) -> np.ndarray:
    """Sum of the tokens' log10 probabilities for each text, from the counts of each token's word and pair."""
    last = np.cumsum(counts) - 1
    context = np.append(0.0, seen[:-1])
    context[last - counts + 1] = seen[last]  # as many texts start as end
    single = (seen + 1) / total
    share = np.minimum(1.0, both / np.maximum(context, 1))
    chance = np.where(context > 0, WEIGHT * share + (1 - WEIGHT) * single, single)
    return np.bincount(np.repeat(np.arange(len(counts)), counts), np.log10(np.minimum(chance, 1.0)), len(counts))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    names = ["key", "kind", "batch", "texts", "a", "b", "c", "d"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _scored(batches: Iterator[pa.RecordBatch], bits: int, least: int, total: int, model, often) -> Iterator[pa.RecordBatch]:
    """For each batch its scores and what is at hand of the exact counts (kind 0), its ids (kind 3), and a row for each
    shard whose exact counts its other words need (kind 1)."""
    heavy, heavy_n = often.value
    batch_id = TaskContext.get().partitionId() << 40
    for piece in pieces_of(batches, BATCH_BYTES):
        for start in range(0, piece.num_rows, BATCH_TEXTS):
            batch = piece.slice(start, BATCH_TEXTS)
            texts = batch.num_rows
            tokens = Tokens(batch.column("text"))
            word, of_word = np.unique(tokens.token, return_inverse=True)
            known = batch.column("levels") if "levels" in batch.schema.names else None
            single, both = _levels(tokens, word, of_word, model.value, known, bits)
            score = _log_chances(tokens.counts, expected(single, least), expected(both, least), total)
            # exact counts: the most frequent words are at hand, the others are asked for
            place = np.searchsorted(heavy, word)
            held = np.zeros(len(word), bool)
            inside = place < len(heavy)
            held[inside] = heavy[place[inside]] == word[inside]
            mine = held[of_word]
            value = np.log10(heavy_n[place[of_word[mine]]] + 1.0)
            part = np.bincount(tokens.of[mine], value, texts)
            seen = np.bincount(tokens.of[mine], minlength=texts)
            ids = batch.column("doc_id")
            told = tokens.counts.astype("<i8"), part, seen.astype("<i8"), score
            about = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("held_out").to_numpy(zero_copy_only=False)
            yield _packed(
                [
                    (-1 - batch_id, 0, batch_id, texts, *(x.tobytes() for x in told)),
                    (-1 - batch_id, 3, batch_id, texts, *(x.tobytes() for x in about), None),
                    *_asked(word, of_word[~mine], tokens.of[~mine], texts, batch_id, bits),
                ]
            )
            batch_id += 1


def _asked(word: np.ndarray, of_word: np.ndarray, of_text: np.ndarray, texts: int, batch_id: int, bits: int) -> list[tuple]:
    """Words whose counts are wanted, by shard, with the texts that hold them and how often."""
    key, times = np.unique(of_word.astype(np.int64) * texts + of_text, return_counts=True)
    more = -(-times // 65535)  # a count over 16 bits is sent in several parts
    if (more > 1).any():
        key = np.repeat(key, more)
        times = np.repeat(times, more)
        first = np.append(True, key[1:] != key[:-1])
        times = np.where(first, times - (np.repeat(more, more) - 1) * 65535, 65535)
    index, text = key // texts, (key % texts).astype("<u2")
    wanted, begin, n = np.unique(index, return_index=True, return_counts=True)
    hashes = word[wanted]
    begin = np.append(begin, len(key))
    rows = []
    for shard, x, y in _shards(hashes, bits):
        p, q = begin[x], begin[y]
        rows.append((shard, 1, batch_id, texts, hashes[x:y].tobytes(), n[x:y].astype("<u4").tobytes(), text[p:q].tobytes(), times[p:q].astype("<u2").tobytes()))
    return rows


def _answered(group: pa.Table) -> pa.Table:
    """Sums over the words of one shard for each asking batch (kind 1), for the texts that hold one; other rows pass."""
    rows = group.to_pylist()
    counts = [r for r in rows if r["kind"] == 2]
    word = np.frombuffer(counts[0]["a"], np.uint64) if counts else np.zeros(0, np.uint64)
    n = np.frombuffer(counts[0]["b"], "<i8") if counts else np.zeros(0, np.int64)
    out = []
    for r in rows:
        if r["kind"] in (0, 3):
            out.append(tuple(r[c] for c in ("kind", "batch", "texts", "a", "b", "c", "d")))
        elif r["kind"] == 1:
            h = np.frombuffer(r["a"], np.uint64)
            at = np.searchsorted(word, h)
            c = np.zeros(len(h), np.int64)
            inside = np.flatnonzero(at < len(word))
            inside = inside[word[at[inside]] == h[inside]]
            c[inside] = n[at[inside]]
            each = np.repeat(c, np.frombuffer(r["b"], "<u4"))
            text, place = np.unique(np.frombuffer(r["c"], "<u2"), return_inverse=True)
            times = np.frombuffer(r["d"], "<u2").astype(np.float64)
            part = np.bincount(place, times * np.log10(each + 1.0), len(text))
            known = np.bincount(place, times * (each > 0), len(text)).astype("<i8")
            out.append((1, r["batch"], r["texts"], text.tobytes(), part.tobytes(), known.tobytes(), None))
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(["kind", "batch", "texts", "a", "b", "c", "d"], kinds))})


def _finished(group: pa.Table, tokens: int, distinct: int) -> pa.Table:
    """The rows of one batch's texts."""
    for r in sorted(group.to_pylist(), key=lambda r: (r["kind"], r["a"])):  # in one order, so that sums come out alike
        if r["kind"] == 0:
            counts, score = np.frombuffer(r["a"], "<i8"), np.frombuffer(r["d"], np.float64)
            part, known = np.frombuffer(r["b"], np.float64).copy(), np.frombuffer(r["c"], "<i8").copy()
        elif r["kind"] == 1:
            text = np.frombuffer(r["a"], "<u2")
            part[text] += np.frombuffer(r["b"], np.float64)
            known[text] += np.frombuffer(r["c"], "<i8")
        else:
            ids = pa.array(np.frombuffer(r["a"], "<i8"), mask=np.frombuffer(r["b"], bool))
            held_out = np.frombuffer(r["c"], bool)
    base = part - counts * np.log10(tokens + distinct + 1.0)
    return pa.table(
        {
            "doc_id": ids, "held_out": held_out, "n_tokens": counts, "n_known": known,
            "train_tokens": np.full(len(counts), tokens), "base_score": base, "score": score,
        }
    )


def _groups(learned: DataFrame) -> list[list[int]]:
    """Shards whose segments are broadcast together: in order, up to ``BROADCAST_BYTES``, one at least."""
    sizes = learned.select("shard", F.length("filter").alias("size")).orderBy("shard").toArrow()
    groups: list[list[int]] = [[]]
    room = BROADCAST_BYTES
    for shard, size in zip(sizes.column("shard").to_pylist(), sizes.column("size").to_pylist()):
        if groups[-1] and size > room:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(shard)
        room -= size
    return groups


def _segments(learned: DataFrame, shards: list[int], bits: int, tokens: int, distinct: int) -> Filter:
    """The segments of a group, brought to the driver."""
    first, after = (shards[0], shards[-1] + 1) if shards else (0, 0)
    size, begin, highest = (np.zeros(after - first, np.int64) for _ in range(3))
    parts = learned.where((F.col("shard") >= first) & (F.col("shard") < after)).select("shard", "filter", "highest").orderBy("shard").toArrow()
    length = pc.binary_length(parts.column("filter")).to_numpy().astype(np.int64) * 8
    at = parts.column("shard").to_numpy() - first
    size[at], begin[at], highest[at] = length, np.cumsum(length) - length, parts.column("highest").to_numpy()
    data = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in parts.column("filter"))])
    return Filter(bits, data, begin, size, tokens, distinct, highest, first)


def score_texts(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_count: int = 1) -> DataFrame:
    """Log10 probabilities of every whole text: by exact smoothed word counts, and by the bigram model of the filter.

    Learned from the texts whose ids may be (:func:`learnable`). Words and word pairs are counted in each batch, packed
    by hash range, and summed in one task for each range; nothing is dropped. Each range enters its n-grams into its own
    segment of a log-frequency Bloom filter: n-gram and level, for every level up to its quantised count. With a
    ``least_count`` of 2 n-grams seen once count as unseen. A segment is sized by its entries, so false positives do not
    rise with the input. The segments are broadcast in groups of up to ``BROADCAST_BYTES``; with more than one
    group the texts are read once for each, and carry the levels found so far, which gives the same results. A token's
    probability mixes the pair's share of its context, by levels found in repeated probes, with the add-one share of the
    token; without a known context it is the latter.

    Exact counts never go to one place: words with a fixed share of all tokens, of which there can be only so many, are
    broadcast with their counts; for the others each batch sends its words, once, to the range that has them, and is
    answered with the sums of the texts that hold one. Repeated rows are scored each; null texts are empty and hold the
    end alone; a null id stays null and is held out; without anything to learn from every probability is 1.
    """
    if least_count not in (1, 2):
        raise ValueError(f"least_count is 1 or 2, not {least_count}")
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    base = base.withColumn("held_out", ~learnable(F.col("doc_id")))
    whole = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(1, (-(-whole // RANGE_BYTES) - 1).bit_length()))
    counted = base.where("not held_out").select("text").mapInArrow(lambda b: _counted(b, bits), "shard long, words binary, n binary, pairs binary, m binary")
    learned = stored(spark, counted.groupBy("shard").applyInArrow(lambda t: _learned(t, bits, HEAVY_SHARE, least_count), _LEARNED), "word-counts")
    sums = learned.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    tokens, distinct = sums.n, sums.v
    # bounded: of words with that share of all tokens there are at most 1 / HEAVY_SHARE, and they are told before any comes here
    frequent = learned.select(F.inline("heavy")).where(F.col("n") >= max(1, tokens * HEAVY_SHARE)).toArrow()
    words, times = (np.array(frequent.column(c).to_numpy(), np.int64) for c in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    often = spark.sparkContext.broadcast((words.view(np.uint64)[order], times[order]))
    groups = _groups(learned)
    texts, before = base.select("doc_id", "held_out", "text"), None
    for shards in groups[:-1]:
        model = spark.sparkContext.broadcast(_segments(learned, shards, bits, tokens, distinct))
        where = scratch_dir(spark, "levels")
        texts.mapInArrow(lambda b, model=model: _levelled(b, bits, model), _LEVELLED).write.parquet(where)
        model.destroy()
        if before:
            filesystem.delete(spark, before)
        texts, before = spark.read.schema(_LEVELLED).parquet(where), where
    model = spark.sparkContext.broadcast(_segments(learned, groups[-1], bits, tokens, distinct))
    counts = learned.select(
        F.col("shard").alias("key"), F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("texts"), F.col("words").alias("a"), F.col("n").alias("b"),
        F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d"),
    )
    total = tokens + distinct + 1
    asked = texts.mapInArrow(lambda b: _scored(b, bits, least_count, total, model, often), _PACKED).union(counts)
    answers = asked.groupBy("key").applyInArrow(_answered, "kind int, batch long, texts long, a binary, b binary, c binary, d binary")
    return answers.groupBy("batch").applyInArrow(
        lambda t: _finished(t, tokens, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
