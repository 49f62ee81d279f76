"""Packing documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sediment.llm.textbytes import pieces_of
from sediment.llm.tokenizing import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
END_ID = 1


class Piece(NamedTuple):
    """Tokens ``start`` to ``start + length`` of a document; ``ids`` are these tokens' bytes."""

    doc_id: int | None
    start: int
    length: int
    doc_tokens: int
    ids: bytes

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            self._replace(length=length, ids=self.ids[: 4 * length]),
            self._replace(start=self.start + length, length=self.length - length, ids=self.ids[4 * length :]),
        )


class Windows:
    """Open windows by fill level, and the rule that picks the level for the next piece.

    ``count[h]`` is the number of open windows with ``h`` tokens. Putting a piece of ``s`` tokens into a window of level
    ``h`` (0: a new one) takes one window from level ``h`` and adds one to level ``h + s``, unless that is full. The
    level whose move leaves the smallest sum of squared counts is chosen, the fullest of equals.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        left = self.count[1 : self.capacity - size + 1]
        gain = 2 * (self.count[size + 1 :] - left) + 2
        if len(gain):
            gain[-1] = 1 - 2 * left[-1]  # a full window counts no more
            gain[left == 0] = np.iinfo(np.int64).max
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if left[best] and gain[best] <= 2 * self.count[size] + 1:
                return best + 1
        return 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts the piece of less than a window's tokens; gives a window that this filled."""
        level = self.level_for(piece.length)
        if level:
            window = self.at[level].pop()
            self.count[level] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        level += piece.length
        if level == self.capacity:
            self.open -= 1
            return window
        self.at[level].append(window)
        self.count[level] += 1
        return None

    def fold(self) -> Iterator[list[Piece]]:
        """Fills the fullest open windows with pieces cut from the emptiest; at most one open window is left."""
        rest = [(level, window) for level in range(self.capacity - 1, 0, -1) for window in self.at[level]]
        self.__init__(self.capacity)
        first, last = 0, len(rest) - 1
        while first < last:
            level, window = rest[first]
            giving, source = rest[last]
            piece = source.pop()
            gap = self.capacity - level
            if piece.length > gap:
                kept, piece = piece.cut(piece.length - gap)
                source.append(kept)
            window.append(piece)
            rest[first], rest[last] = (level + piece.length, window), (giving - piece.length, source)
            if level + piece.length == self.capacity:
                yield window
                first += 1
            if not source:
                last -= 1
        if first == last:
            level, window = rest[first]
            self.at[level].append(window)
            self.count[level] += 1
            self.open = 1


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 2048,
    most_open: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The pieces of all documents in sequences of at most ``capacity`` tokens, by sum-of-squares packing.

    Each row of ``docs`` is a document: its tokenizer ids and one end id; null or empty texts have the end id alone.
    Full windows are cut off its front; the rest goes online into the window level that keeps the sum of squared counts
    of open windows lowest. Each task has windows of its own, so nothing is shuffled and no task holds more than
    ``most_open`` open windows: when there are more, and when the task ends, open windows are filled up with pieces cut
    from the emptiest ones. Each task leaves at most one sequence that is not full.

    One row per piece; each id is in exactly one. A sequence's number is the task's number and a count, and tasks read
    their rows in a fixed order, so a task that runs again gives the same rows. Repeated rows are packed each; a null id
    stays null; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        end = np.asarray([END_ID], "<u4").tobytes()
        windows = Windows(capacity)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in window:
                rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence, offset))
                offset += p.length
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=_NAMES)

        for batch in pieces_of(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(texts)):
                ids += end
                total = len(ids) >> 2
                full = total - total % capacity
                for start in range(0, full, capacity):
                    emit([Piece(doc_id, start, capacity, total, ids[4 * start : 4 * (start + capacity)])])
                if full < total:
                    filled = windows.place(Piece(doc_id, full, total - full, total, ids[4 * full :]))
                    if filled:
                        emit(filled)
                    elif windows.open > most_open:
                        for window in windows.fold():
                            emit(window)
            if rows:
                yield flush()
        for window in windows.fold():
            emit(window)
        for level in windows.at:
            for window in level:
                emit(window)
        if rows:
            yield flush()

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(run, SCHEMA)
