"""Similarity join of documents on word shingles by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.components import components, stored
from sediment.llm.groups import met_in_blocks, roots
from sediment.llm.textbytes import Texts, mix, pieces_of, run_hash, table

WORD = table("abcdefghijklmnopqrstuvwxyz0123456789", high=True)
#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Minima in a sketch; rows of a bucket that are compared in one task; depth of the recursion.
SKETCH, BUCKET, DEPTH = 64, 1024, 3
#: Shingles of the sets that are compared exactly in one task, unless two sets alone have more.
SHINGLES = 1 << 22
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as hashes in order, and where each text's begin (one longer than the texts).

    Words are runs of ASCII letters and digits and all non-ASCII characters, in lower case. A text of fewer words than
    a shingle is one shingle; a text without words has none.
    """
    laid = Texts(column, lower=True)
    starts, ends, of = laid.words(WORD)
    n = len(laid)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = run_hash(laid.prefix(), starts, ends)
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    total = np.zeros(len(word), np.uint64)
    for j in range(words):
        part = word[j:] * _SEEDS[j]
        if j:
            part = np.where(of[j:] == of[: len(of) - j], part, np.uint64(0))
        total[: len(part)] += part
    left = first[of] + count[of] - np.arange(len(word))
    use = (left >= words) | ((count[of] < words) & (np.arange(len(word)) == first[of]))
    shingle, owner = mix(total[use]), of[use]
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _sketch(members: np.ndarray, size: int) -> np.ndarray:
    """The smallest member in each of ``size`` ranges of hashes; an empty range takes the next one's."""
    edges = np.arange(size, dtype=np.uint64) << np.uint64(64 - int(math.log2(size)))
    at = np.searchsorted(members, edges)
    last = np.append(at[1:], len(members))
    full = np.flatnonzero(at < last)
    take = full[np.searchsorted(full, np.arange(size)) % len(full)]
    return (members[at[take]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets with this probability, if its buckets are split ``depth`` times.

    A node keeps each token with 1 / (similarity * tokens), so two similar sets share about one chosen token at least:
    they meet below a node with 1 - exp(-(probability that they meet below that)).
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _sets(batches: Iterator[pa.RecordBatch], words: int, similarity: float, runs: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, 1 << 20):
        members, begin = shingle_sets(batch.column("text"), words)
        size = np.diff(begin)
        owner = np.repeat(np.arange(len(size)), size)
        filled = size > 0
        one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        if len(members):
            at = begin[:-1][filled]
            one[filled] = np.add.reduceat(mix(members ^ _SEEDS[20]), at)
            two[filled] = np.add.reduceat(mix(members + _SEEDS[21]), at)
        # chosen tokens of the root, for every run
        limit = np.minimum(2.0**64 / (similarity * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)[owner]
        nodes, holders = [], []
        for r in range(runs):
            chosen = np.flatnonzero(members * _SEEDS[100 + r] <= limit)
            nodes.append(mix(members[chosen] + _SEEDS[500 + r]))
            holders.append(owner[chosen])
        nodes, holders = np.concatenate(nodes), np.concatenate(holders)
        order = np.argsort(holders, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(holders, minlength=len(size)))]).astype(np.int32)
        sketches = [_sketch(members[begin[i] : begin[i + 1]], SKETCH).tobytes() if size[i] else None for i in range(len(size))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(nodes[order].view(np.int64))), pa.array(sketches, pa.binary()),
            ],
            names=["doc_id", "size", "one", "two", "nodes", "sketch"],
        )


def _children(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The nodes below: a sketch's minima, with their places, are the tokens that a node chooses among."""
    limit = np.uint64(int(2.0**64 / (similarity * SKETCH)))
    place = (np.arange(SKETCH, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH).astype(np.uint64) | place
        node = batch.column("node").to_numpy().view(np.uint64)
        drawn = mix(mix(tokens) ^ node[:, None])
        i, j = np.nonzero(drawn <= limit)
        yield pa.RecordBatch.from_arrays([pa.array(mix(drawn[i, j]).view(np.int64)), batch.column("rep").take(pa.array(i))], names=["node", "rep"])


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """A root for each row of a bucket that a similar sketch ties to another; rows come bucket by bucket."""
    names = ["node", "block_a", "block_b"]

    def cut(t: pa.Table) -> np.ndarray:
        keys = [t.column(n).to_numpy() for n in names]
        new = np.zeros(len(t), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    def compare(t: pa.Table) -> pa.RecordBatch:
        group, rep = cut(t), t.column("rep").to_numpy()
        size, own = t.column("size").to_numpy(), t.column("row_block").to_numpy()
        two = t.column("block_a").to_numpy() != t.column("block_b").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
        # four standard errors of an estimate from so many minima below the threshold
        filled = SKETCH * -np.expm1(size * math.log1p(-1 / SKETCH))
        least = similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1))
        pairs, i, step = [], np.arange(len(group) - 1), 1
        while len(i):
            i = i[i + step < len(group)]
            i = i[group[i] == group[i + step]]
            j = i + step
            fit = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            fit &= ~(two[i] & (own[i] == own[j]))
            a, b = i[fit], j[fit]
            for k in range(0, len(a), 50_000):
                x, y = a[k : k + 50_000], b[k : k + 50_000]
                near = (sketch[x] == sketch[y]).mean(axis=1) >= np.minimum(least[x], least[y])
                pairs.append((x[near], y[near]))
            step += 1
        a, b = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (list(zip(*pairs)) or [(), ()]))
        root = roots(len(rep), a, b)
        tied = np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[root[tied]])], names=["a", "b"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        group = cut(held)
        whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if whole:
            yield compare(held.slice(0, whole).combine_chunks())
            held = held.slice(whole)
    if held is not None and len(held):
        yield compare(held.combine_chunks())


def _overlaps(members: np.ndarray, of: np.ndarray, n: int, common: int = 16) -> np.ndarray:
    """How many members each two of ``n`` sets share."""
    order = np.argsort(members, kind="stable")
    members, of = members[order], of[order].astype(np.int64)
    new = np.ones(len(members), bool)
    new[1:] = members[1:] != members[:-1]
    column = np.cumsum(new) - 1
    df = np.bincount(column)
    shared = np.zeros(n * n, np.int64)
    rare = df[column] <= common
    c, d = column[rare], of[rare]
    for step in range(1, common):
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        shared += np.bincount(d[same] * n + d[same + step], minlength=n * n)
    shared = shared.reshape(n, n)
    shared = shared + shared.T
    names = np.flatnonzero(df > common)
    place = np.full(len(df), -1)
    place[names] = np.arange(len(names))
    at, d = place[column[~rare]], of[~rare]
    for start in range(0, len(names), 4096):
        here = (at >= start) & (at < start + 4096)
        held = np.zeros((n, min(4096, len(names) - start)), np.float32)
        held[d[here], at[here] - start] = 1
        shared += np.rint(held @ held.T).astype(np.int64)
    return shared


def _exact(group: pa.Table, similarity: float) -> pa.Table:
    rep, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "row_block"))
    sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
    size, n = np.array([len(s) for s in sets]), len(sets)
    both = _overlaps(np.concatenate(sets), np.repeat(np.arange(n), size), n)
    union = size[:, None] + size[None, :] - both
    near = np.triu(both >= similarity * union - 1e-9, 1)
    if group.column("block_a")[0].as_py() != group.column("block_b")[0].as_py():
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(near)
    links = np.zeros(n, np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    seen = np.flatnonzero(links)
    return pa.table({"rep": rep[seen], "links": links[seen], "root": rep[roots(n, a, b)[seen]]})


def near_documents(
    spark: SparkSession,
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = 0.999,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: how many others are at least ``similarity`` to it by Jaccard over ``words``-word shingles,
    the smallest id of its class (all that links reach), and whether that is it.

    Equal sets are joined once and counted as many times as they are. Candidates come from chosen paths: a run keeps of
    each set about 1 / similarity tokens, drawn by a hash that all sets share, and sets meet in the bucket of a token
    that both keep. Buckets of more than ``BUCKET`` sets are split again on tokens drawn from their sets' minima, up to
    ``DEPTH`` times; what is still larger is compared whole, in pairs of blocks. Runs are as many as give ``recall``
    for a pair just at the threshold that meets at the deepest level. In a bucket, sketches leave out pairs that are
    four standard errors below the threshold. What is left are candidate components; each of their sets is fetched once
    and all pairs inside are computed exactly, so that links are exact within a component, whatever run found it; large
    components are cut into blocks by their number of sets and of shingles.

    Texts of one id are one document, joined by line breaks in order. Texts without words link with nothing, and so do
    rows without an id, which are returned as they are. An empty table gives no rows. Pairs are never sent.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    texts = base.where("doc_id is not null")
    if not texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = texts.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    runs = runs_for(recall)
    schema = "doc_id long, size long, one long, two long, nodes array<long>, sketch binary"
    sets = stored(spark, texts.mapInArrow(lambda b: _sets(b, words, similarity, runs), schema), "sets")
    key = ["one", "two", "size"]
    kinds = stored(
        spark,
        sets.where("size > 0").groupBy(*key).agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch")
        ),
        "set-kinds",
    )
    sketches = kinds.select("rep", "size", "sketch")
    frontier = kinds.select(F.explode(F.array_distinct("nodes")).alias("node"), "rep")
    leaves = []
    for depth in range(1, DEPTH + 1):
        large = stored(spark, frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("node"), "large-buckets")
        if depth == DEPTH or large.isEmpty():
            leaves.append(frontier)
            break
        leaves.append(frontier.join(large, "node", "left_anti"))
        split = frontier.join(large, "node", "left_semi").join(sketches, "rep").select("node", "rep", "sketch")
        frontier = stored(spark, split.mapInArrow(lambda b: _children(b, similarity), "node long, rep long").distinct(), "nodes")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.union(more)
    dealt = met_in_blocks(every, ["node"], "rep", BUCKET).join(sketches, "rep")
    where = ["node", "block_a", "block_b"]
    ordered = dealt.select(*where, "row_block", "rep", "size", "sketch").repartition(*where).sortWithinPartitions(*where, "rep")
    ties = stored(spark, ordered.mapInArrow(lambda b: _candidates(b, similarity), "a long, b long").distinct(), "set-ties")
    near = components(spark, ties)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            members, begin = shingle_sets(batch.column("text"), words)
            raw = [members[begin[i] : begin[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("rep"), batch.column("copies"), pa.array(raw, pa.binary())], names=["component", "rep", "copies", "members"]
            )

    wanted = near.join(kinds.select(F.col("rep").alias("id"), "copies"), "id").withColumnRenamed("id", "rep")
    held = wanted.join(texts, F.col("rep") == F.col("doc_id")).select("component", "rep", "copies", "text")
    fetched = stored(spark, held.mapInArrow(fetch, "component long, rep long, copies long, members binary"), "set-members")
    shingles = F.length("members") / 8
    blocks = met_in_blocks(fetched, ["component"], "rep", BUCKET, shingles, SHINGLES).repartition("component", "block_a", "block_b")
    links = stored(
        spark,
        blocks.groupBy("component", "block_a", "block_b").applyInArrow(lambda t: _exact(t, similarity), "rep long, links long, root long"),
        "set-links",
    )
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(spark, links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), "component")
    of_kind = (
        kinds.select(*key, "rep", "copies")
        .join(counted, "rep", "left")
        .join(classes, "rep", "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    )
    out = sets.select("doc_id", *key).join(of_kind, key, "left")
    found = out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))
    lost = base.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return found.union(lost).withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


ORACLE_SQL = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') w from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) i from w where len(w) > 0)
), n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b using (g) where a.doc_id < b.doc_id group by all),
q as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * shared >= 4 * (x.n + y.n - shared)),
l as (select a, b from q union all select b, a from q),
c as (select doc_id id, doc_id reach from documents union select c.id, l.b from c join l on c.reach = l.a)
select doc_id, (select count(*) from l where a = doc_id) n_links, class_id, class_id = doc_id kept
from documents join (select id, min(reach) class_id from c group by id) on id = doc_id
"""
