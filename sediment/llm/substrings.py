"""Bytes covered by long strings that occur earlier, by families of suffix arrays over sampled positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.components import stored
from sediment.llm.textbytes import Texts, mix, pieces_of, run_hash

#: Length of a match, and of the byte runs by whose hashes positions are sampled.
LENGTH, GRAM = 100, 20
#: Positions of an index shard, and contexts of a batch in it.
SHARD_ROWS, BATCH_ROWS = 20_000, 2_000
#: A position with more contexts than this is compared string by string over all tasks.
HOT_ROWS = 5_000


def anchors(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The sampled positions, and the windows that each stands for.

    Of the byte runs of ``gram`` bytes in a window of ``length``, the window's anchor is the one with the smallest
    hash, the leftmost of equals. So equal windows have equal anchors at equal places, and the windows of one anchor
    follow each other. Gives for each anchor: its hash, text number, the start of its first and last window, whether
    its run occurs more than once in these windows, which then may repeat each other, and the sums for run hashes.
    """
    n = len(texts.data)
    span = length - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool, np.uint64))
    if n < length:
        return empty
    sums = texts.prefix()
    at = np.arange(n - gram + 1)
    h = run_hash(sums, at, at + gram)
    windows = n - length + 1
    # sliding minimum of (hash, place) over `span` starts: the smaller of a block's tail and the next block's head
    blocks = -(-len(h) // span)
    padded = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    padded = padded.reshape(blocks, span)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[:windows], head[span - 1 : span - 1 + windows])
    owner = np.repeat(np.arange(len(texts)), texts.sizes)[:windows]
    whole = np.arange(windows) + length <= texts.offsets[owner + 1]
    # an anchor's windows: a run of starts with one minimum; where the leftmost equal one drops out, a new run begins
    first = np.ones(windows, bool)
    first[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(first & whole)
    run_of = np.cumsum(first) - 1
    counted = np.bincount(run_of[whole], minlength=run_of[-1] + 1)
    last = starts + counted[run_of[starts]] - 1
    # a run of more than `span` windows holds several equal anchors: cut it, so that contexts stay short
    long = last - starts >= span
    if long.any():
        parts = -(-(last - starts + 1) // span)
        again = np.repeat(np.arange(len(starts)), parts)
        step = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, last = starts[again] + step * span, np.minimum(last[again], starts[again] + (step + 1) * span - 1)
    # equal runs in one anchor's windows are neighbours among the places that are some window's minimum
    top = np.zeros(blocks * span, np.uint64)
    top[span - 1 : span - 1 + windows] = low
    top = top.reshape(blocks, span)
    head = np.maximum.accumulate(top, axis=1).ravel()
    tail = np.maximum.accumulate(top[:, ::-1], axis=1)[:, ::-1].ravel()
    most = tail[: len(h)].copy()
    most[: max(0, len(head) - span + 1)] = np.maximum(most[: max(0, len(head) - span + 1)], head[span - 1 :][: len(most)])
    least = np.flatnonzero(h == most)
    twice = np.flatnonzero((h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= span))
    periodic = np.zeros(len(starts), bool)
    if len(twice):
        at = np.searchsorted(least[twice], starts)
        there = at < len(twice)
        periodic[there] = least[twice[at[there]] + 1] <= last[there] + span - 1
    return low[starts], owner[starts], starts, last, periodic, sums


class IndexFamily:
    """Sorted arrays of strings, each level about twice the one below; what is new enters as the lowest level."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def known(self, ordered: np.ndarray) -> np.ndarray:
        """Which of the sorted strings some level holds: each level is scanned beside them in order."""
        found = np.zeros(len(ordered), bool)
        for level in self.levels:
            at = np.searchsorted(level, ordered)
            inside = at < len(level)
            found[inside] |= level[at[inside]] == ordered[inside]
        return found

    def add(self, ordered: np.ndarray) -> None:
        """Enters sorted strings; levels of equal size merge into the next."""
        while self.levels and len(self.levels[-1]) < 2 * len(ordered):
            both = np.concatenate([self.levels.pop(), ordered])
            both.sort(kind="stable")
            ordered = both
        if len(ordered):
            self.levels.append(ordered)


def _suffixes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of ``length`` bytes in the contexts, with the number of the context and the place in it."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (ends - sizes)[of] + place
    views = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    # exactly `length` bytes each, so that the comparison's disregard of closing zero bytes cannot make two equal
    return np.ascontiguousarray(views).view(f"S{length}").ravel(), of, place


def merge_scan(family: IndexFamily, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, in order of occurrence: which of its strings of ``length`` occur earlier. Indexes the new ones."""
    strings, of, place = _suffixes(contexts, length)
    order = np.argsort(strings, kind="stable")
    ordered = strings[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    old = np.zeros(len(ordered), bool)
    old[first] = family.known(ordered[first])
    family.add(ordered[first & ~old])
    seen = np.empty(len(ordered), bool)
    seen[order] = old | ~first
    return np.split(seen, np.flatnonzero(np.diff(of)) + 1)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:] - 1, len(reach) - 1)]


def repeated_bytes(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: its bytes, how many are removed, in how many runs, the hash of the rest and the runs.

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id, or
    in the same one at an earlier place; strings may overlap, never cross documents, and are judged on the input. Null
    texts are empty. Documents of one id are taken in the order of their texts; a null id comes first.

    Suffixes are indexed at sampled positions only (:func:`anchors`), which every window of ``length`` bytes has one of.
    Positions meet by their hash. Where all the bytes around one are those around an earlier position (told by two
    64-bit hashes), all its windows are removed, which settles copies without their text; within a batch this is done
    before the shuffle. The contexts that are the first of their kind, at a position that others share, go with their
    bytes to shards of the index. A shard takes them in order of occurrence, in batches: a batch's strings are sorted,
    scanned beside the levels of the shard's :class:`IndexFamily`, and enter it. There are as many shards as the
    contexts need, so each stays small. A position with more than ``HOT_ROWS`` unlike contexts is compared by hashes of
    its single strings instead, which spread over all tasks.
    """
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    alone = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if alone:
        texts = texts.withColumn("tie", F.lit(0).cast("long"))
    else:
        texts = texts.distinct().withColumn("tie", F.xxhash64("text"))
    schema = "h long, around long, doc_id long, tie long, place long"
    sampled = texts.mapInArrow(lambda batches: _sample(batches, length, gram), schema)
    # `place`: the first window's start, 7 bits for the number of windows less one, whether they may repeat each other,
    # and whether all are settled
    settled = F.col("place") % 2 == 1
    key = F.when(settled, F.xxhash64("doc_id", "tie", "place")).otherwise(F.col("h"))
    order = [F.col("doc_id"), F.col("tie"), F.col("place")]
    ranked = (
        sampled.withColumn("key", key)
        .repartition(F.col("key"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("key", "around").orderBy(*order)))
        .withColumn("kinds", F.sum(F.when(~settled & (F.col("nth") == 1), 1).otherwise(0)).over(Window.partitionBy("key")))
    )
    begin = F.shiftright("place", 9)
    end = begin + F.shiftright("place", 2).bitwiseAND(127) + F.lit(length)
    periodic = F.shiftright("place", 1) % 2 == 1
    old = settled | (F.col("nth") > 1)
    met = stored(
        spark,
        ranked.where(old | periodic | (F.col("kinds") > 1)).select("h", "doc_id", "tie", begin.alias("begin"), end.alias("end"), old.alias("old"), (F.col("kinds") > HOT_ROWS).alias("hot")),
        "positions",
    )
    fetched = stored(spark, _contexts(met.where("not old"), texts, length), "contexts")
    shards = max(1, -(-fetched.where("not hot").count() // SHARD_ROWS))
    dealt = fetched.where("not hot").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    scanned = dealt.groupBy("shard").applyInArrow(lambda group: _scan(group, length), _SPANS)
    hot = fetched.where("hot").mapInArrow(lambda batches: _strings(batches, length), "one long, two long, doc_id long, tie long, begin long, old boolean")
    strings = stored(spark, hot, "strings")
    # a string that very many share: its first place by an aggregate, then a join that can split its rows
    where = F.struct("doc_id", "tie", "begin")
    firsts = strings.where("not old").groupBy("one", "two").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = strings.where("not old").join(stored(spark, firsts, "first-strings"), ["one", "two"]).where(~where.eqNullSafe(F.col("first")))
    later = stored(spark, later.select("doc_id", "tie", "begin"), "later-strings")
    apart = later.union(strings.where("old").select("doc_id", "tie", "begin"))
    again = met.where("old").select("doc_id", "tie", "begin", "end")
    spans = again.union(scanned).union(apart.select("doc_id", "tie", "begin", (F.col("begin") + length).alias("end")))
    return _removed(spans, texts)


_SPANS = "doc_id long, tie long, begin long, end long"


def _sample(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, 1 << 20):
        laid = Texts(batch.column("text"))
        h, of, first, last, periodic, sums = anchors(laid, length, gram)
        if not len(h):
            continue
        around = run_hash(sums, first, last + length)
        local = first - laid.offsets[of]
        place = (local << 9) | ((last - first) << 2) | (periodic.astype(np.int64) << 1)
        ids = pc.fill_null(batch.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)[of]
        ties = batch.column("tie").to_numpy(zero_copy_only=False)[of]
        order = np.lexsort((place, ties, ids))
        # contexts that this batch has earlier in the order of occurrence are settled here
        kind = (h ^ mix(around))[order]
        _, index = np.unique(kind, return_index=True)
        again = np.ones(len(order), bool)
        again[order[index]] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), batch.column("doc_id").take(pa.array(of)), pa.array(ties), pa.array(place | again)],
            names=["h", "around", "doc_id", "tie", "place"],
        )


def _contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches of texts."""
    lists = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("h", "begin", "end", "hot")).alias("wanted"))
    a, b = lists.alias("a"), texts.alias("b")
    both = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.tie = b.tie")).select("a.doc_id", "a.tie", "a.wanted", "b.text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            flat = batch.column("wanted").flatten()
            of = pc.list_parent_indices(batch.column("wanted"))
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            h, begin, end, hot = (flat.field(i) for i in range(4))
            cut = [raw[i][s:e] for i, s, e in zip(of.to_pylist(), begin.to_pylist(), end.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [h, batch.column("doc_id").take(of), batch.column("tie").take(of), begin, hot, pa.array(cut, pa.binary())],
                names=["h", "doc_id", "tie", "begin", "hot", "bytes"],
            )

    return both.mapInArrow(fetch, "h long, doc_id long, tie long, begin long, hot boolean, bytes binary")


def _scan(group: pa.Table, length: int) -> pa.Table:
    """Earlier-seen stretches of one shard's contexts."""
    order = pc.sort_indices(group, [("doc_id", "ascending"), ("tie", "ascending"), ("begin", "ascending")], null_placement="at_start")
    group = group.take(order)
    family, rows = IndexFamily(), []
    contexts, begins = group.column("bytes").to_pylist(), group.column("begin").to_numpy()
    for start in range(0, len(contexts), BATCH_ROWS):
        for i, seen in enumerate(merge_scan(family, contexts[start : start + BATCH_ROWS], length), start):
            at = np.flatnonzero(seen)
            if len(at):
                low, high = _spans(at, at + length)
                rows += [(i, begins[i] + x, begins[i] + y) for x, y in zip(low, high)]
    of = pa.array([r[0] for r in rows], pa.int64())
    return pa.table(
        {
            "doc_id": group.column("doc_id").take(of), "tie": group.column("tie").take(of),
            "begin": pa.array([r[1] for r in rows], pa.int64()), "end": pa.array([r[2] for r in rows], pa.int64()),
        }
    )


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of ``length`` bytes; ``old`` where the batch has it earlier."""
    for batch in batches:
        if not batch.num_rows:
            continue
        laid = Texts(batch.column("bytes"))
        sums = laid.prefix()
        counts = laid.sizes - length + 1
        of = np.repeat(np.arange(len(laid)), counts)
        step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = laid.offsets[of] + step
        one, two = run_hash(sums, at, at + length), run_hash(sums, at, at + length // 2)
        ids = pc.fill_null(batch.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)[of]
        begin = batch.column("begin").to_numpy()[of] + step
        order = np.lexsort((begin, batch.column("tie").to_numpy()[of], ids))
        _, index = np.unique((one ^ mix(two))[order], return_index=True)
        old = np.ones(len(of), bool)
        old[order[index]] = False
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array(begin), pa.array(old)],
            names=["one", "two", "doc_id", "tie", "begin", "old"],
        )


def _removed(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """The report of each document from its removed stretches."""
    lists = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    a, b = texts.alias("a"), lists.alias("b")
    both = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.tie = b.tie"), "left").select("a.doc_id", "a.text", "b.gone")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows = []
            for text, gone in zip(pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist(), batch.column("gone")):
                if not gone.is_valid:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                    continue
                pairs = gone.values
                low, high = _spans(pairs.field(0).to_numpy(), pairs.field(1).to_numpy())
                rest = hashlib.sha256()
                at = 0
                for x, y in zip(low.tolist(), high.tolist()):
                    rest.update(text[at:x])
                    at = y
                rest.update(text[at:])
                rows.append((len(text), int((high - low).sum()), len(low), rest.hexdigest(), [{"begin": x, "end": y} for x, y in zip(low.tolist(), high.tolist())]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return both.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>")
