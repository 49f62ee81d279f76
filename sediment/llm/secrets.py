"""Credentials in texts: fixed patterns, and formats learned from what these find."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.components import plain_names
from sediment.llm.textbytes import Texts, pieces_of

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Cheap tests that hold for every text with a match.
_MAY = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Character classes of the alphabet of formats, with the number of characters in each.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_.=-"}
_CLASS_OF = {ord(c): k for k, cs in CLASSES.items() for c in cs}
_ALPHABET = sum(map(len, CLASSES.values()))
_CODES = np.full(256, len(CLASSES), np.uint8)
for _code, _members in enumerate(CLASSES.values()):
    _CODES[np.frombuffer(_members.encode(), np.uint8)] = _code
_PLAIN_BITS = np.array([math.log2(len(cs) / _ALPHABET) for cs in CLASSES.values()])
#: Labelled shapes to learn from, of each kind, the characters in all of them, and in the longest. Shapes are whole.
SHAPES, CHARACTERS, LONGEST = 600, 60_000, 4_096

Span = tuple[int, int, str]


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[Span, str]]:
    """The fixed patterns' spans (start, end, kind; in code points) and credentials, in order of start and kind.

    Per kind leftmost and without overlap: a match whose credential is too short is dropped, and the search goes on
    behind it.
    """
    found = []
    if "assign" in kinds:
        found += [((m.start(), m.end(), "assign"), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "access" in kinds:
        found += [((m.start(), m.end(), "access"), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if "hex" in kinds:
        found += [((m.start(), m.end(), "hex"), m[0]) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return sorted(found, key=lambda x: (x[0][0], KINDS.index(x[0][2])))


def shape(value: str) -> str:
    return value.translate(_CLASS_OF)


class Automaton:
    """A probabilistic automaton over character classes.

    Built as the prefix tree of counted shapes; then states are merged, in the order of the tree, where the shares of
    ends and of each next class differ by less than the Hoeffding bound at ``alpha``, there and in all states behind.
    """

    def __init__(self, shapes: list[tuple[str, int]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.shortest = min((len(word) for word, _ in shapes), default=1)
        for word, n in sorted(shapes):
            state = 0
            self.total[0] += n
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.through.append({})
                    self.ends.append(0)
                    self.total.append(0)
                self.through[state][c] = self.through[state].get(c, 0) + n
                state = self.next[state][c]
                self.total[state] += n
            self.ends[state] += n
        self._merge()
        self.steps = [
            {c: (self.next[s][c], math.log2((k + 0.1) / (self.total[s] + 0.1 * len(CLASSES)))) for c, k in self.through[s].items()}
            for s in range(len(self.next))
        ]
        kept = {s: k for k, s in enumerate(self._reached())}
        # the same as tables over class numbers, the bits of evenly drawn characters taken off
        self.table, self.bits = np.zeros((len(kept), len(CLASSES)), np.int32), np.zeros((len(kept), len(CLASSES)))
        for s, k in kept.items():
            miss = math.log2(0.1 / (self.total[s] + 0.1 * len(CLASSES)))
            for j, c in enumerate(CLASSES):
                target, bits = self.steps[s].get(c, (0, miss))
                self.table[k, j], self.bits[k, j] = kept[target], bits - _PLAIN_BITS[j]

    def _reached(self) -> list[int]:
        """The states that merging left, the first one first."""
        found, waiting = [0], [0]
        known = {0}
        while waiting:
            for target in self.next[waiting.pop()].values():
                if target not in known:
                    known.add(target)
                    found.append(target)
                    waiting.append(target)
        return found

    def gains(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """:meth:`gain` of many words at once, given as stretches of class numbers: one step for each place in a word."""
        order = np.argsort(-sizes, kind="stable")
        start, left = starts[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        state, bits = np.zeros(len(order), np.int32), np.zeros(len(order))
        for j, n in enumerate(left.tolist()):  # as many words are longer than j
            code = codes[start[:n] + j]
            bits[:n] += self.bits[state[:n], code]
            state[:n] = self.table[state[:n], code]
        out = np.empty(len(order))
        out[order] = bits
        return out

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, red: int, blue: int) -> bool:
        waiting = [(red, blue)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.total[a], self.total[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.through[a].get(c, 0), n, self.through[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    waiting.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, state: int) -> None:
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, target in list(self.next[b].items()):
                self.through[a][c] = self.through[a].get(c, 0) + self.through[b][c]
                if c in self.next[a]:
                    waiting.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def _merge(self) -> None:
        red, at, known = [0], 0, {0}
        while at < len(red):
            for c in sorted(self.next[red[at]]):
                blue = self.next[red[at]][c]
                if blue in known:
                    continue
                same = next((r for r in red if self._alike(r, blue)), None)
                if same is None:
                    red.append(blue)
                    known.add(blue)
                else:
                    self.next[red[at]][c] = same
                    self._fold(same, blue)
            at += 1

    def gain(self, word: str) -> float:
        """Bits by which the automaton expects the shape more than evenly drawn characters."""
        state, bits = 0, 0.0
        for c in word:
            step = self.steps[state].get(c)
            if step is None:
                bits += math.log2(0.1 / (self.total[state] + 0.1 * len(CLASSES)))
                state = 0
            else:
                bits += step[1]
                state = step[0]
            bits -= math.log2(len(CLASSES[c]) / _ALPHABET)
        return bits


def learn_formats(spark: SparkSession, docs: DataFrame, shapes: int = SHAPES, text_column: str = "text") -> dict[str, Automaton]:
    """An automaton per kind from the credentials that the fixed patterns find in all texts.

    Shapes are counted over all texts, whole. The automaton is fitted on a bounded sample of labelled rows: of each kind
    the ``shapes`` with the smallest hash among those of up to ``LONGEST`` characters, as far as ``CHARACTERS`` go.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows: dict[tuple[str, str], int] = {}
            for _, text, kinds in _likely(batch, KINDS[:3]):
                for (_, _, kind), value in base_spans(text, kinds):
                    key = kind, shape(value)
                    rows[key] = rows.get(key, 0) + 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows]), pa.array([s for _, s in rows]), pa.array(list(rows.values()), pa.int64())], names=["kind", "shape", "n"]
                )

    texts = docs.select(F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null")
    counts = texts.mapInArrow(find, "kind string, shape string, n long").groupBy("kind", "shape").agg(F.sum("n").alias("n"))
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("shape"), "shape")
    short = counts.where(F.length("shape") <= LONGEST)
    ranked = short.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= shapes)
    sample = ranked.withColumn("before", F.sum(F.length("shape")).over(by_hash)).where((F.col("before") <= CHARACTERS) | (F.col("rank") == 1)).collect()
    return {k: Automaton([(r["shape"], r.n) for r in sample if r.kind == k]) for k in KINDS[:3] if any(r.kind == k for r in sample)}


def _likely(batch: pa.RecordBatch, kinds: tuple[str, ...]) -> Iterator[tuple[int, str, tuple[str, ...]]]:
    """Row number, text and possible kinds of the texts that may hold a match."""
    column = pc.fill_null(batch.column("text"), "")
    may = {k: pc.match_substring_regex(column, _MAY[k]).to_numpy(zero_copy_only=False) for k in kinds}
    some = sum(may.values()) > 0
    for i in some.nonzero()[0]:
        yield int(i), column[int(i)].as_py(), tuple(k for k in kinds if may[k][i])


def candidates(laid: Texts, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text of the longest runs of the characters of credentials, from ``shortest`` on."""
    starts, ends, of = laid.words(_CODES < len(CLASSES))
    long = ends - starts >= shortest
    return starts[long], (ends - starts)[long], of[long]


#: Kinds of characters that ordinary words and numbers keep to, and how often the next one is of the same kind.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.=-")
STAY = 0.85
_KIND_OF = np.full(256, 4, np.uint8)
for _kind, _members in enumerate(_KINDS):
    _KIND_OF[np.frombuffer(_members.encode(), np.uint8)] = _kind
_EVENLY = math.log2(_ALPHABET)
_SAME, _OTHER, _FIRST = (np.array([_EVENLY + math.log2(p / len(k)) for k in _KINDS] + [0.0]) for p in (STAY, (1 - STAY) / 3, 0.25))


def plain_bits(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits by which ordinary writing explains each word better than evenly drawn characters do; 0 where it does not.

    There are two such explanations: one character again and again (half of the characters are like the one before, the
    others drawn), and words and numbers, where the next character is of the same kind with probability ``STAY``.
    """
    ends = starts + sizes
    again, steps = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1)
    np.cumsum(data[1:] == data[:-1], out=again[2:])
    same = again[ends] - again[starts + 1]
    kind = _KIND_OF[data]
    np.cumsum(np.where(kind[1:] == kind[:-1], _SAME[kind[1:]], _OTHER[kind[1:]]), out=steps[2:])
    words = _FIRST[kind[starts]] + steps[ends] - steps[starts + 1]
    return np.maximum(np.maximum(same * (_EVENLY - 1) - (sizes - 1 - same), words), 0.0)


def _all_spans(
    batch: pa.RecordBatch, formats: dict[str, Automaton], least_bits: float, bits_per_character: float
) -> tuple[dict[int, str], dict[int, list[Span]], dict[int, list[Span]], np.ndarray]:
    """Texts, fixed and all spans of the rows that have any, and for each row the best candidate's bits a character.

    Every candidate is scored; the texts of those that fit a format, few, are then looked at one by one.
    """
    base, texts = {}, {}
    for i, text, kinds in _likely(batch, KINDS[:3]):
        if found := [span for span, _ in base_spans(text, kinds)]:
            base[i], texts[i] = found, text
    every, best = dict(base), np.full(batch.num_rows, np.nan)
    if formats:
        laid = Texts(batch.column("text"))
        start, size, of = candidates(laid, min(a.shortest for a in formats.values()))
        codes, bits = _CODES[laid.data], np.full(len(start), -np.inf)
        for automaton in formats.values():
            own = size >= automaton.shortest
            bits[own] = np.maximum(bits[own], automaton.gains(codes, start[own], size[own]))
        bits -= plain_bits(laid.data, start, size)
        np.fmax.at(best, of, bits / size)
        fits = np.flatnonzero((bits >= least_bits) & (bits >= bits_per_character * size))
        rows = of[fits]
        for i in np.unique(rows).tolist():
            text = texts.setdefault(i, batch.column("text")[i].as_py())
            raw, first, taken = text.encode(), int(laid.offsets[i]), _taken(base.get(i, []))
            own, at, points = [], 0, 0
            for k in fits[np.searchsorted(rows, i) : np.searchsorted(rows, i, side="right")].tolist():
                begin = int(start[k]) - first
                points += len(raw[at:begin].decode())
                at, span = begin, (points, points + int(size[k]), "format")
                place = bisect.bisect_left(taken, (span[1],)) - 1
                if place < 0 or taken[place][1] <= span[0]:
                    own.append(span)
            if own:
                every[i] = sorted(base.get(i, []) + own, key=lambda s: (s[0], KINDS.index(s[2])))
    return texts, base, every, best


def _taken(spans: list[Span]) -> list[tuple[int, int]]:
    """The union of spans that come in order of their start."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(
    spark: SparkSession,
    docs: DataFrame,
    least_bits: float = 24.0,
    bits_per_character: float = 1.2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Spans of credentials in every whole text: the fixed patterns', and candidates that a learned format fits.

    A candidate is a whole run of the characters in which credentials are written, as long as the shortest labelled one
    or longer; each is scored, of any length. It is added, as kind ``format``, if some kind's automaton expects it by
    ``least_bits`` and ``bits_per_character`` more than evenly drawn characters or ordinary writing (:func:`plain_bits`),
    and if it overlaps no span of the fixed patterns. ``format_score`` is the best candidate's bits a character, null without one. Null and empty texts have no spans; repeated rows are scanned each; null ids stay;
    other columns are not read. No text is shuffled.
    """
    formats = spark.sparkContext.broadcast(learn_formats(spark, docs, text_column=text_column))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in pieces_of(batches):
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS[:3]}
            digests, spans = [none] * n, [""] * n
            _, base, every, best = _all_spans(batch, formats.value, least_bits, bits_per_character)
            scores = pa.array(best, mask=np.isnan(best))
            for i, found in base.items():
                for _, _, kind in found:
                    counts[kind][i] += 1
                digests[i] = hashlib.sha256(_joined(found).encode()).hexdigest()
            for i, found in every.items():
                spans[i] = _joined(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests), pa.array(spans), scores],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "format_score"],
            )

    kept = docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text")
    return kept.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, format_score double")


def redact_secrets(spark: SparkSession, docs: DataFrame, mark: str = "[secret]", least_bits: float = 24.0, bits_per_character: float = 1.2) -> DataFrame:
    """The same rows and columns with every span that :func:`scan_secrets` finds in ``text`` replaced by ``mark``.

    ``n_chars``, if there, is counted anew. Overlapping spans are replaced as one. Other texts, null ones too, stay as they
    are; repeated rows are treated each; columns may have any names.
    """
    docs, names = plain_names(docs)
    formats = spark.sparkContext.broadcast(learn_formats(spark, docs))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            changed = {}
            known, _, every, _ = _all_spans(batch, formats.value, least_bits, bits_per_character)
            for i, spans in every.items():
                text, out, at = known[i], [], 0
                for start, end, _ in spans:
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                if spans:
                    changed[i] = "".join(out) + text[at:]
            if changed:
                texts = batch.column("text").to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, batch.schema.field("text").type)}
                if "n_chars" in columns:
                    sizes = batch.column("n_chars").to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            yield batch

    return docs.mapInArrow(cover, docs.schema).toDF(*names)
