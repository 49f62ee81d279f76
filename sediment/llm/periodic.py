"""Stretches of words that repeat with a period, by a suffix automaton and the access operation of link-cut trees.

The words are appended one by one. Appending word i colours the way from its prefix's state to the root of the
suffix links with i: every suffix that ends here has its last occurrence here. What the colouring overwrites are segments
of one older colour c: the longest string of the segment, of length l, ended at c before and ends at i now. Where i - c
is at most l the two overlap or touch, so the words repeat with period i - c from the first one's start on: a square that
ends here, extended to the left as far as it goes. The last i that finds a start and period is the end of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.textbytes import Texts, mix, pieces_of, run_hash, table

#: A run holds its period so many times, and so many words.
TIMES, LEAST = 4, 6
#: Rounds of narrowing the candidates; fewer leave more for the automaton, none loses a run.
ROUNDS = 8
_SPACE = b" \t\n\x0b\x0c\r"
_WORD = ~table(_SPACE)


def suffix_links(codes: list) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a sequence: link and longest length of each state, and the state of each prefix."""
    follow, link, length, prefix, last = [{}], [-1], [0], [], 0
    for i, code in enumerate(codes):
        state = len(link)
        follow.append({})
        link.append(0)
        length.append(i + 1)
        at = last
        while at >= 0 and code not in follow[at]:
            follow[at][code] = state
            at = link[at]
        if at >= 0:
            to = follow[at][code]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(link)
                follow.append(follow[to].copy())
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[state] = copy
                while at >= 0 and follow[at].get(code) == to:
                    follow[at][code] = copy
                    at = link[at]
        prefix.append(state)
        last = state
    return link, length, prefix


def heavy_paths(link: list[int], length: list[int]) -> tuple[list[int], list[int]]:
    """For each state of the tree of links the head of its heavy path, and the state above that head."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy = [1] * len(link), [-1] * len(link)
    for state in reversed(order[1:]):
        up = link[state]
        size[up] += size[state]
        if heavy[up] < 0 or size[state] > size[heavy[up]]:
            heavy[up] = state
    head = list(range(len(link)))
    for state in order[1:]:
        if heavy[link[state]] == state:
            head[state] = head[link[state]]
    return head, [link[h] for h in head]


def runs_of(codes: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run that holds its period ``times`` (3 at least) and ``least`` words.

    The tree of links is finished before the accesses begin, so the coloured segments are held as a stack on each heavy
    path, the one nearest to the root on top, in place of splay trees: an access takes off what it covers, from path to
    path, and puts its own colour on, which costs the same as the access of a link-cut tree, amortised.
    """
    link, length, prefix = suffix_links(codes)
    head, above = heavy_paths(link, length)
    stacks: list[list[tuple[int, int]]] = [[] for _ in link]
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        below = -1
        while state > 0:
            deep, stack, covered, top = length[state], stacks[head[state]], 0, -1
            while stack and covered < deep:
                reach, colour = stack[-1]
                if reach <= deep:
                    stack.pop()
                covered = min(reach, deep)
                if top < 0:
                    top = colour
                gap = i - colour
                # a colour that goes on below this path was met there with its longest string
                if colour != below and covered >= (times - 1) * gap and covered + gap >= least:
                    ends[i - covered - gap + 1, gap] = i + 1
            stack.append((deep, i))
            below, state = top, above[state]
    return sorted((start, end - start, gap) for (start, gap), end in ends.items())


def candidates(laid: Texts, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of stretches that every run lies inside of.

    In a run of length L and period q <= L / times, each three words from its second period on occurred q words before,
    so L - q - 2 places in a row have an earlier like place at most q back, and q is at most (m + 2) / (times - 1) in a
    row of m such places. Places that are further from their like are taken out and the rows cut there, again and again.
    """
    if len(of) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = run_hash(laid.prefix(), starts, ends)
    three = mix(mix(mix(word[:-2] + np.uint64(of[0] + 1)) + word[1:-1]) + word[2:])
    three = mix(three ^ mix(of[:-2].astype(np.uint64)))  # only like places of one text meet
    order = np.argsort(three, kind="stable")
    back = np.zeros(len(three), np.int64)
    same = three[order[1:]] == three[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    good = (back > 0) & (of[2:] == of[:-2])
    for _ in range(ROUNDS):
        edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        reach = (last - first + 2) // (times - 1)
        far = good.copy()
        far[good] = back[good] > np.repeat(reach, last - first)
        if not far.any():
            break
        good &= ~far
    edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= max(1, LEAST - 3)
    first, last = first[long], last[long]
    if not len(first):
        return first, last
    begin = np.searchsorted(of, of[first])  # the text's first word
    low = np.maximum(first - (last - first + 2) // (times - 1), begin)
    high = last + 2
    # stretches of one text that touch are one
    low = np.minimum.accumulate(low[::-1])[::-1]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] > high[:-1]) | (of[first[1:]] != of[first[:-1]])
    at = np.flatnonzero(new)
    return np.maximum(low[at], begin[at]), high[np.append(at[1:] - 1, len(high) - 1)]


def _strength(run: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
    """Whether a run holds its period more often than another that comes before it."""
    return run[1] * other[2] > other[1] * run[2]


def _report(batch: pa.RecordBatch) -> tuple[list, ...]:
    laid = Texts(batch.column("text"))
    starts, ends, of = laid.words(_WORD)
    low, high = candidates(laid, starts, ends, of)
    found: dict[int, list[tuple[int, int, int]]] = {}
    words_of = np.searchsorted(of, np.arange(len(laid) + 1))
    raw: dict[int, list[bytes]] = {}
    for a, b in zip(low.tolist(), high.tolist()):
        text = int(of[a])
        if text not in raw:
            raw[text] = laid.data[laid.offsets[text] : laid.offsets[text + 1]].tobytes().split()
        first = a - int(words_of[text])
        for start, length, period in runs_of(raw[text][first : first + b - a]):
            found.setdefault(text, []).append((first + start, length, period))
    counts, runs, strongest, kept = np.diff(words_of), [], [], []
    for text in range(len(laid)):
        own = sorted(found.get(text, []), key=lambda r: (r[0], r[2]))
        best = None
        for run in own:
            if best is None or _strength(run, best):
                best = run
        words = raw.get(text) or laid.data[laid.offsets[text] : laid.offsets[text + 1]].tobytes().split()
        if own:
            rest, at = [], 0
            for begin, end in sorted((s + p, s + n) for s, n, p in own):
                rest += words[at:begin] if begin > at else []
                at = max(at, end)
            words = rest + words[at:]
        as_struct = [{"start": s, "length": n, "period": p} for s, n, p in own]
        runs.append(as_struct)
        strongest.append(None if best is None else dict(zip(("start", "length", "period"), best)))
        kept.append(b" ".join(words))
    return counts, runs, strongest, kept


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches):
        counts, runs, strongest, kept = _report(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(strongest, _RUN), pa.array(kept, pa.binary()).view(pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its number of words, its runs by start and then period, the run that holds its period most
    often (exactly compared; of equals the one that starts first, then the shorter period; null without a run), and
    the text that is left when each run keeps its first period only, its words joined by one space.

    Words are the longest stretches without ASCII white space, compared byte by byte; a run is as long as its smallest
    period allows on both sides and holds that period ``TIMES`` and ``LEAST`` words. Runs may overlap; a word goes if
    any run has it after its first period. Runs never cross documents. Null, empty and blank texts have no words, no runs
    and an empty rest. Each row is judged alone, so repeated rows give equal rows, an id may be null or repeated, and
    an empty table gives no row; other columns are not read. There is no shuffle. A document is worked on in one task:
    words outside :func:`candidates` cost arrays only, words inside them some hundred bytes of automaton each.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    run = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(_periodic, f"doc_id long, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a known repetition in about a tenth of the documents: where 10 divides h, the unsigned crc32 of the
    decimal id, and there are n > 0 words, each word i from a on becomes word a + (i - a) % p, with g = h / 10,
    a = g % n and p = 1 + (n - a) / (3 + g % 8) in whole numbers. Other texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document, after :func:`planted`: runs counted, the strongest, and digests of all runs and of the rest."""
    found = periodic_runs(docs.select(F.col("doc_id"), planted(F.col("doc_id"), F.col("text")).alias("text")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
