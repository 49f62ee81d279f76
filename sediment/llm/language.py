"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.components import plain_names, stored
from sediment.llm.textbytes import pieces_of

NONE = "und"
#: Hash buckets of n-grams; the model is this many numbers for each language.
BUCKETS = 1 << 15
#: Lengths of the n-grams in characters.
LENGTHS = (1, 2, 3)
#: The most languages in a block of the model. Bounds a block to 2^15 x 256 x 4 bytes = 32 MiB; blocks are as many as needed.
BLOCK_LANGUAGES = 256
SCHEMA = "doc_id long, lang_pred string, score double"


class Block(NamedTuple):
    """Some languages of a model, in alphabetical order: log share of the texts, and log probabilities by language."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray


class Model(NamedTuple):
    """Broadcast blocks that follow each other in alphabetical order."""

    blocks: list[Broadcast]

    def each(self) -> Iterator[Block]:
        """The blocks one after the other; with several a task holds one at a time."""
        for shared in self.blocks:
            yield shared.value
            if len(self.blocks) > 1 and shared._path is not None:
                shared.__dict__.pop("_value", None)  # else the worker keeps it; it is read again from its file


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    codes = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, codes, np.uint32(32))


class Grams:
    """The hashed n-grams of texts: letters in lower case, each run of other characters one space."""

    def __init__(self):
        self.letter = _letters()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and text number of each n-gram, and which texts hold a letter."""
        codes = [self.letter[np.frombuffer(t.lower().encode("utf-32-le"), np.uint32)] for t in texts]
        space = np.full(1, 32, np.uint32)
        laid = np.concatenate([x for c in codes for x in (space, c)] + [space])
        owner = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
        owner = np.append(owner, len(codes) - 1) if codes else np.zeros(1, np.int64)
        keep = np.ones(len(laid), bool)
        keep[1:] = (laid[1:] != 32) | (laid[:-1] != 32) | (owner[1:] != owner[:-1])
        laid, owner = laid[keep], owner[keep]
        lettered = np.zeros(len(texts), bool)
        lettered[owner[laid != 32]] = True
        found, owners = [], []
        h = np.zeros(len(laid), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(laid) < n:
                break
            h = h[: len(laid) - n + 1] * np.uint32(0x01000193) + laid[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in LENGTHS:
                same = owner[: len(h)] == owner[n - 1 :]
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found.append(((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))[same])
                owners.append(owner[: len(h)][same])
        return np.concatenate(found), np.concatenate(owners), lettered


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2. A null id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, smoothing: float = 0.1, lang_column: str = "lang", text_column: str = "text") -> Model | None:
    """Counts n-grams of all rows with a language, per language; None if there are none.

    Each task sums its texts first, for at most ``BLOCK_LANGUAGES`` languages at a time, and sends a row per language and
    bucket. All languages are kept. Their sums pass through the driver in alphabetical order; it holds one block at a
    time, whose size the two constants bound, and broadcasts it.
    """

    def packed(sums: dict) -> Iterator[pa.RecordBatch]:
        for lang, (n, counts) in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["lang", "bucket", "n"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(), {}
        for batch in pieces_of(batches):
            texts_of = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts_of.setdefault(lang, []).append(text)
            for lang, texts in texts_of.items():
                if lang not in sums and len(sums) == BLOCK_LANGUAGES:
                    yield from packed(sums)
                    sums.clear()
                total = sums.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
                total[0] += len(texts)
                total[1] += np.bincount(grams.of(texts)[0], minlength=BUCKETS)
        yield from packed(sums)

    rows = docs.selectExpr(f"cast(`{lang_column}` as string) lang", f"cast(`{text_column}` as string) text").where("lang is not null and text is not null")
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row per language, of so many bytes at most
    by_lang = stored(spark, sums.groupBy("lang").agg(
        F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("texts"), F.collect_list(F.struct("bucket", "n")).alias("grams")
    ), "languages")
    all_texts = by_lang.agg(F.sum("texts")).first()[0]
    blocks, held = [], []

    def close() -> None:
        log_p = np.empty((len(held), BUCKETS), np.float32)
        for i, (_, _, at, n) in enumerate(held):
            counts = np.full(BUCKETS, smoothing)
            counts[at] += n
            log_p[i] = np.log(counts / counts.sum())
        prior = np.log(np.array([h[1] for h in held], float) / all_texts)
        blocks.append(spark.sparkContext.broadcast(Block([h[0] for h in held], prior, log_p)))
        held.clear()

    for row in by_lang.orderBy("lang").toLocalIterator():
        found = np.array([(bucket, n) for bucket, n in row.grams if bucket >= 0], np.int64).reshape(-1, 2)
        held.append((row.lang, row.texts, found[:, 0], found[:, 1]))
        if len(held) == BLOCK_LANGUAGES:
            close()
    if held:
        close()
    return Model(blocks) if blocks else None


def _best(grams: Grams, model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior probability for each text."""
    best, posterior = [NONE] * len(texts), np.zeros(len(texts))
    if model is None:
        return best, posterior
    buckets, owners, lettered = grams.of(texts)
    # each distinct n-gram of a text once, with its count
    key, n = np.unique(owners * BUCKETS + buckets, return_counts=True)
    of, bucket = key // BUCKETS, key & (BUCKETS - 1)
    names, top = np.full(len(texts), NONE, object), np.full(len(texts), -np.inf)
    rest = np.zeros(len(texts))  # sum over the languages so far of their probabilities as shares of the best one's
    for block in model.each():
        total = np.stack([np.bincount(of, p[bucket].astype(np.float64) * n, len(texts)) for p in block.log_p], axis=1) + block.prior
        first, most = total.argmax(axis=1), total.max(axis=1)
        above = most > top  # of equal ones the first stays
        names[above] = np.array(block.languages, object)[first[above]]
        new = np.maximum(top, most)
        rest = rest * np.exp(top - new) + np.exp(total - new[:, None]).sum(axis=1)
        top = new
    share = 1 / rest
    for i in np.flatnonzero(lettered):
        best[i] = names[i]
    posterior[lettered] = share[lettered]
    return best, posterior


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Most probable language of each whole text and its posterior probability; ``und`` and 0 without a letter.

    The model is broadcast in blocks of languages. Texts are scored batch by batch: for each language the log
    probabilities of the n-grams that occur are summed by text; the best language and the sum of all are kept over the
    blocks. Ties go to the first language in alphabetical order. Null texts are empty;
    repeated rows are scored each; without a model every text is ``und``; other columns are not read.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in pieces_of(batches, 1 << 20):
            best, posterior = _best(grams, model, pc.fill_null(batch.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best), pa.array(posterior)], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(score, SCHEMA)


def accepted(spark: SparkSession, docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text is in a learned language with at least this posterior probability.

    The model is of the learnable rows of ``docs`` itself. Null texts and texts without a letter are rejected; a null id is
    judged like any other; repeated rows are judged each. Columns may have any names.
    """
    docs, names = plain_names(docs)
    model = train(spark, docs.where(learnable(F.col("doc_id"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in pieces_of(batches, 1 << 20):
            best, posterior = _best(grams, model, pc.fill_null(batch.column("text"), "").to_pylist())
            yield batch.filter(pa.array((np.array(best) != NONE) & (posterior >= least_score)))

    return docs.mapInArrow(keep, docs.schema).toDF(*names)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Languages of all documents by a model of those that may be learned from; ``held_out`` marks the others.

    Texts and ``lang`` of the learnable rows are all that is learned from; a null id is held out.
    """
    model = train(spark, docs.where(learnable(F.col("doc_id"))))
    found = predict(spark, docs, model)
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
