"""Words covered by a window of words that starts in an earlier document, by super-k-mers.

A window's *minimiser* is the smallest hash of ``GRAM`` words in a row inside it. Consecutive windows that share one
overlap almost wholly, so they travel as one packed string, a super-k-mer, to the bucket named by the minimiser. Equal
windows have equal minimisers and meet there, where the windows are sorted and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.components import stored
from sediment.llm.textbytes import Texts, mix, pieces_of, run_hash, table

#: Words of a window, and of the runs by whose hashes minimisers are chosen.
WINDOW, GRAM = 13, 4
#: A bucket with more than one in so many super-k-mers, or with more than so many rows, is dealt out window by window.
SHARE, BUCKET_ROWS = 4096, 20_000
#: Bytes of text whose packed strings are brought together before they are dealt out.
PIECE_BYTES = 16 << 20
#: Rows of whole buckets that are sorted together.
SORTED_ROWS = 20_000
_SPACE = b" \t\n\x0b\x0c\r"
_WORD = ~table(_SPACE)
_EARLIEST = -(1 << 63)


def super_kmers(column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The minimiser, text number, first window (a word number in the text) and number of windows of each super-k-mer.

    At most ``window - gram + 1`` windows in a row hold one place; a longer row, in which the same words come again, is
    cut there, so packed strings stay short.
    """
    laid = Texts(column)
    starts, ends, of = laid.words(_WORD)
    if len(of) < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    word = run_hash(laid.prefix(), starts, ends)
    low = word[: len(word) - gram + 1]
    for j in range(1, gram):
        low = mix(low) + word[j : len(word) - gram + 1 + j]
    low = mix(low)
    span, wide = window - gram + 1, 1
    while wide < span:  # minima over twice as many places, the last time over as many as are left
        step = min(wide, span - wide)
        low = np.minimum(low[:-step], low[step:])
        wide += step
    first_word = np.searchsorted(of, np.arange(len(laid)))
    whole = of[: len(low)] == of[window - 1 :]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (of[1 : len(low)] != of[: len(low) - 1]) | ~whole[:-1]
    at = np.flatnonzero(first & whole)
    run = np.cumsum(first) - 1
    count = np.bincount(run[whole], minlength=run[-1] + 1)[run[at]]
    parts = -(-count // span)
    again = np.repeat(np.arange(len(at)), parts)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = at[again] + nth * span
    return low[start], of[start], start - first_word[of[start]], np.minimum(count[again] - nth * span, span)


def _frequent(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Buckets that hold at least one in ``SHARE`` of a batch's super-k-mers; a null bucket tells the batch's number."""
    for batch in pieces_of(batches):
        bucket = super_kmers(batch.column("text"), window, gram)[0]
        value, count = np.unique(bucket, return_counts=True)
        large = count * SHARE >= len(bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(value[large].view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.append(count[large], len(bucket)))],
            names=["bucket", "n"],
        )


def frequent_buckets(spark: SparkSession, texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Buckets found with at least one in ``SHARE`` of all super-k-mers and more than a thousand: ``SHARE`` at most.

    A bucket loses at most one in ``SHARE`` by the batches that hold fewer, so all with twice that share are here.
    """
    found = texts.mapInArrow(lambda batches: _frequent(batches, window, gram), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = stored(spark, found, "frequent-buckets")
    total = found.agg(F.sum(F.when(F.col("bucket").isNull(), F.col("n")))).first()[0] or 0
    rows = found.where(f"bucket is not null and n >= {max(1000, total / SHARE)}").select("bucket").collect()
    return np.sort(np.array([r.bucket for r in rows], np.int64))


def _places(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The super-k-mers without their words. Those of frequent buckets are marked and dealt out at random."""
    for batch in pieces_of(batches):
        bucket, of, start, count = super_kmers(batch.column("text"), window, gram)
        if not len(bucket):
            continue
        known = np.isin(bucket.view(np.int64), frequent)
        key = np.where(known, mix(bucket + mix(start.astype(np.uint64)) + mix(of.astype(np.uint64) + np.uint64(99))), bucket)
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array(start << 8 | known.astype(np.int64) << 7 | count)],
            names=["bucket", "doc_id", "tie", "place"],
        )


_PIECE = "bucket long, packed binary, doc_id long, tie long, begins array<long>, n int"


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of the places asked for: a super-k-mer each, or a window each where ``place`` is marked.

    Equal strings of a batch become one row, that of the smallest document; a larger document's windows are removed
    then, which is told by a row without a string. Several places of one document are one row.
    """
    for batch in pieces_of(batches, PIECE_BYTES):
        where: dict[bytes, dict[tuple[int, int], list[int]]] = {}
        key: dict[bytes, tuple[int, int]] = {}
        ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
        for doc, tie, text, asked in zip(ids, ties, batch.column("text").cast(pa.binary()), batch.column("asked")):
            words, own = (text.as_py() or b"").split(), (doc, tie)
            at = asked.values
            for place, bucket in zip(at.field(0).to_pylist(), at.field(1).to_pylist()):
                start, count = place >> 8, place & 127
                if place & 128:
                    for begin in range(start, start + count):
                        packed = b" ".join(words[begin : begin + window])
                        where.setdefault(packed, {}).setdefault(own, []).append(begin)
                        key[packed] = (None, 1)
                else:
                    packed = b" ".join(words[start : start + count + window - 1])
                    where.setdefault(packed, {}).setdefault(own, []).append(start)
                    key[packed] = (bucket, count)
        rows = []
        for packed, found in where.items():
            bucket, count = key[packed]
            least = min(doc for doc, _ in found)
            for (doc, tie), begins in found.items():
                if doc == least:
                    rows.append((bucket, packed, doc, tie, begins, count))
                else:  # needs no bucket: dealt out anywhere
                    rows.append((begins[0] * 7919 + doc, None, doc, tie, begins, count))
        columns = list(zip(*rows)) or [()] * 6
        packed = pa.array(columns[1], pa.binary())
        # a window that goes by itself has no bucket yet: its own words choose one
        given = pa.array([x if x is None else ((x + (1 << 63)) % (1 << 64)) - (1 << 63) for x in columns[0]], pa.int64())
        if given.null_count:
            laid = Texts(packed)
            own = run_hash(laid.prefix(), laid.offsets[:-1], laid.offsets[1:])
            given = pc.coalesce(given, pa.array(own.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [given, packed, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int64())), pa.array(columns[5], pa.int32())],
            names=["bucket", "packed", "doc_id", "tie", "begins", "n"],
        )


def window_ranks(words: np.ndarray, window: int) -> np.ndarray:
    """For each place a number that is equal for equal ``window`` words from there on: runs of 1, 2, 4, .. words are
    sorted and numbered, then the two that cover a window. The last places, which have too few words, are left out."""
    rank, wide = words.astype(np.int64), 1
    while wide < window:
        step = min(wide, window - wide)
        most = int(rank.max()) + 1 if len(rank) else 1
        rank = np.unique(rank[:-step] * most + rank[step:], return_inverse=True)[1]
        wide += step
    return rank


def _later_windows(packed: pa.Array, doc: np.ndarray, window: int) -> list[np.ndarray]:
    """For each packed string which of its windows are in one of a smaller document."""
    lists = pc.split_pattern(packed.cast(pa.string()), " ")
    words = lists.flatten().dictionary_encode().indices.to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    rank = window_ranks(words, window)
    counts = sizes - window + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = rank[(np.cumsum(sizes) - sizes)[of] + place]
    first = np.full(len(rank), np.iinfo(np.int64).max)
    np.minimum.at(first, own, doc[of])
    return np.split(doc[of] > first[own], np.cumsum(counts)[:-1])


def _compared(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Removed stretches of words, from rows in the order of their buckets; buckets are never parted."""
    kept: list[pa.RecordBatch] = []

    def result(doc: list, tie: list, begin: list, end: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, tie, begin, end)], names=["doc_id", "tie", "begin", "end"])

    def sorted_buckets(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        packed = rows.column("packed").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        docs, ties, begins = (rows.column(c).to_pylist() for c in ("doc_id", "tie", "begins"))
        out: list[list] = [[], [], [], []]
        for k, later in enumerate(_later_windows(packed, np.array(docs, np.int64), window)):
            if not later.any():
                continue
            edge = np.diff(np.concatenate([[0], later.view(np.int8), [0]]))
            for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                for begin in begins[k]:
                    for column, value in zip(out, (docs[k], ties[k], begin + x, begin + y + window - 1)):
                        column.append(value)
        return result(*out)

    for batch in batches:
        gone = batch.filter(batch.column("gone"))
        if gone.num_rows:
            of = pc.list_parent_indices(gone.column("begins"))
            begin = gone.column("begins").flatten()
            end = pc.add(begin, pc.add(gone.column("n").take(of).cast(pa.int64()), window - 1))
            yield pa.RecordBatch.from_arrays([gone.column("doc_id").take(of), gone.column("tie").take(of), begin, end], names=["doc_id", "tie", "begin", "end"])
        rest = batch.filter(pc.invert(batch.column("gone")))
        if not rest.num_rows:
            continue
        kept.append(rest)
        if sum(b.num_rows for b in kept) >= SORTED_ROWS:
            rows = pa.Table.from_batches(kept)
            bucket = rows.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if whole:
                yield sorted_buckets(rows.slice(0, whole))
                kept = rows.slice(whole).combine_chunks().to_batches()
    if kept:
        yield sorted_buckets(pa.Table.from_batches(kept))


def _union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), reach[np.append(at[1:] - 1, len(reach) - 1)].tolist()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches):
        counts, spans, rest = [], [], []
        for text, gone in zip(batch.column("text").cast(pa.binary()), batch.column("gone")):
            words = (text.as_py() or b"").split()
            counts.append(len(words))
            own = _union(gone.values.field(0).to_numpy(), gone.values.field(1).to_numpy()) if gone.is_valid else []
            spans.append([{"begin": x, "end": y} for x, y in own])
            if own:
                kept, at = [], 0
                for x, y in own:
                    kept += words[at:x]
                    at = y
                words = kept + words[at:]
            rest.append(b" ".join(words))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("own_id"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary()).view(pa.string())],
            names=["doc_id", "n_words", "spans", "kept"],
        )


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its number of words, the stretches of words that are removed, and the words that stay,
    joined by one space.

    A word is removed if one of the windows of ``window`` words that cover it has the words of a window in a document
    of smaller id. Words are the longest stretches without ASCII white space, as they are; windows never cross
    documents and are judged on the input. Null, empty and short texts have no window and keep everything. A null id
    comes before all others. Rows of one id are one document for the comparison, none removes words of another;
    each keeps its row. An empty table gives no row. Other columns are not read.

    First only minimisers and places travel, without words, to find the buckets that several documents share; the words
    of the others need not. The super-k-mers of shared buckets then go there as packed strings, equal
    ones of a batch as one. In a bucket the smallest document of each string settles its copies; the strings that are
    left are cut into windows and sorted (:func:`window_ranks`), so that equal windows meet word by word. A bucket that
    holds a large share of all rows (:func:`frequent_buckets`) or more than ``BUCKET_ROWS`` is dealt out by its windows.
    """
    own_id = F.col(f"`{id_column}`").cast("long")
    rows = docs.select(F.coalesce(own_id, F.lit(_EARLIEST)).alias("doc_id"), own_id.alias("own_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    alone = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("tie", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    texts = rows if alone else rows.dropDuplicates(["doc_id", "tie"])
    # what is grouped by these is dealt out as the join needs it; a constant would not be a key of the join
    text_key = ["doc_id"] if alone else ["doc_id", "tie"]
    frequent = frequent_buckets(spark, texts.select("text"), window, gram)

    places = texts.select("doc_id", "tie", "text").mapInArrow(lambda batches: _places(batches, frequent, window, gram), "bucket long, doc_id long, tie long, place long")
    of_bucket = Window.partitionBy("bucket")
    marked = F.col("place").bitwiseAND(128) != 0
    met = places.withColumns({"low": F.min("doc_id").over(of_bucket), "high": F.max("doc_id").over(of_bucket), "rows": F.count(F.lit(1)).over(of_bucket)})
    shared = met.where(marked | (F.col("low") < F.col("high")))
    split = F.when(F.col("rows") > BUCKET_ROWS, F.col("place").bitwiseOR(128)).otherwise(F.col("place"))
    asked = shared.select(*text_key, F.struct(split.alias("place"), "bucket").alias("one")).groupBy(*text_key).agg(F.collect_list("one").alias("asked"))

    # with the same columns as the last join, so that the texts are dealt out once for both
    both = texts.join(asked, text_key).select("doc_id", "tie", "own_id", "text", "asked")
    strings = both.mapInArrow(lambda batches: _pieces(batches, window), _PIECE)
    same = Window.partitionBy("bucket", "packed")
    dealt = strings.repartition(F.col("bucket")).withColumn("first", F.min("doc_id").over(same))
    gone = F.col("packed").isNull() | (F.col("doc_id") > F.col("first"))
    judged = dealt.select("bucket", F.when(~gone, F.col("packed")).alias("packed"), "doc_id", "tie", "begins", "n", gone.alias("gone"))
    spans = judged.sortWithinPartitions("bucket").mapInArrow(lambda batches: _compared(batches, window), "doc_id long, tie long, begin long, end long")

    lists = spans.groupBy(*text_key).agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    out = rows.join(lists, text_key, "left").select("own_id", "doc_id", "tie", "text", "gone")
    return out.mapInArrow(_kept, "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, kept string")


def word_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: words, how many are removed, and the digest of those that stay."""
    found = repeated_words(spark, docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows from all windows at once.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i : i + 12] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win
), later AS (
  SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON x.win = f.win WHERE x.doc_id > f.first_doc
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM later
), lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) k
  ANTI JOIN gone USING (doc_id, i) GROUP BY k.doc_id
) rest USING (doc_id)
"""
