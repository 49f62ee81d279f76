"""Near-duplicate vectors: random rotations, binary codes with correction factors, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.components import components, stored
from sediment.llm.groups import met_in_large_blocks, roots

#: Vectors of a bucket that are compared in one task.
BLOCK = 4096


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Sign codes of rotated unit vectors, with the factor that makes inner products with them unbiased.

    The code of ``o`` is the corner ``x`` of the cube that is nearest to the rotated vector; ``<x, o>`` is stored. For
    another vector ``q``, ``<x, q> / <x, o>`` estimates ``<o, q>``, with an error that exceeds
    ``width * sqrt((1 / <x, o>**2 - 1) / (dim - 1))`` with a probability that falls as a normal tail in ``width``. As ``q``
    the rotated vector is stored too, in steps of a byte; what that can make out at most is added to the bounds.

    :meth:`packed` gives a row of bytes for each vector: three floats (what an inner product with the code is multiplied
    with, the error, the step), the code's bits, and the bytes of ``q``.
    """

    def __init__(self, signs: np.ndarray, steps: np.ndarray, numbers: np.ndarray):
        self.bits, self.steps, self.numbers = signs, steps, numbers
        dim = steps.shape[1]
        self.signs = np.where(np.unpackbits(signs, axis=1, count=dim, bitorder="little") > 0, np.float32(1), np.float32(-1))
        self.rotated = steps.astype(np.float32) * numbers[:, 2:3]

    @classmethod
    def of(cls, unit: np.ndarray, width: float) -> Codes:
        dim = unit.shape[1]
        rotated = (unit @ rotation(dim, 0).T).astype(np.float32)
        factor = np.abs(rotated).sum(axis=1) / math.sqrt(dim)
        step = np.maximum(np.abs(rotated).max(axis=1), 1e-9) / 127
        scale = 1 / (factor * math.sqrt(dim))
        error = width * np.sqrt(np.maximum(1 / factor**2 - 1, 0) / max(dim - 1, 1)) + 1e-5
        numbers = np.stack([scale, error, step], axis=1).astype(np.float32)
        return cls(np.packbits(rotated >= 0, axis=1, bitorder="little"), np.rint(rotated / step[:, None]).astype(np.int8), numbers)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.numbers.view(np.uint8).reshape(len(self.numbers), 12), self.bits, self.steps.view(np.uint8)], axis=1)

    @classmethod
    def read(cls, packed: np.ndarray, dim: int) -> Codes:
        code = -(-dim // 8)
        return cls(packed[:, 12 : 12 + code], np.ascontiguousarray(packed[:, 12 + code :]).view(np.int8), np.ascontiguousarray(packed[:, :12]).view(np.float32))

    def may_reach(self, rows: slice, others: slice, threshold: float) -> np.ndarray:
        """Which pairs the bounds of either code allow to reach the threshold."""
        scale, error, step = self.numbers.T
        most = self.steps.shape[1] / 2
        there = (self.signs[rows] @ self.rotated[others].T + most * step[others]) * scale[rows, None] + error[rows, None]
        back = (self.rotated[rows] @ self.signs[others].T + most * step[rows, None]) * scale[others] + error[others]
        return np.minimum(there, back) >= threshold

    def open_pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a < b) that the bounds leave open, some rows at a time."""
        for start in range(0, len(self.steps), 512):
            a, b = np.nonzero(self.may_reach(slice(start, min(start + 512, len(self.steps))), slice(start, None), threshold))
            a, b = a + start, b + start
            yield a[a < b], b[a < b]


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """How many tables find a pair at the threshold with the given probability, if a key has so many sign bits."""
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def near_vectors(
    spark: SparkSession,
    vectors: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.999,
    width: float = 3.5,
    bucket: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per vector: how many others it links to directly, its component's smallest id, and whether that is it.

    Two vectors link if their labels are equal and not null, they are equally long and their cosine, in double
    precision, is at least ``threshold``. A vector that is null, empty or zero, or holds a null, NaN or infinite
    component, links with nothing. Equal vectors of one label are compared once and counted as many times as they are.

    Candidates share a label and, in one of several rotations, the signs of the first few coordinates; how many signs
    follows from the largest label, how many rotations from the ``recall`` wanted for a pair just at the threshold.
    Only binary codes with their correction factors travel to the buckets (:class:`Codes`); they are made and written
    once. There the confidence bounds (``width`` standard errors; a pair is left out only if the bounds of both codes
    exclude it) decide which pairs need exact recomputation, and only for vectors in such a pair the exact ones are
    fetched. A pair is counted only in the first rotation in which it meets, and no pairs are sent: a block tells
    which of its vectors have an open pair, and after recomputation a number of links and a root for each. Buckets of any
    size are compared whole, in pairs of blocks. Repeated rows are one vector; rows of one id with unlike vectors are vectors of their own.
    """
    base = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.col(f"`{label_column}`").cast("string").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("v"),
    ).distinct()
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce((F.size("v") > 0) & plain & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    base = stored(spark, base.withColumn("v", F.when(fit, F.col("v"))).withColumn("same", F.when(fit, F.xxhash64("label", "v"))), "vectors")
    kinds = stored(
        spark,
        base.where("v is not null").groupBy("label", "v", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    largest = kinds.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(30, max(2, math.ceil(math.log2(max(2, largest / bucket)))))
    tables = tables_for(bits, threshold, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lists = batch.column("v").to_pylist()
            dims = np.array([len(x) for x in lists], np.int32)
            keys, codes = np.zeros((len(lists), tables), np.int32), [b""] * len(lists)
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                x = np.array([lists[i] for i in here])
                for t in range(tables):
                    if (dim, t) not in planes:
                        planes[dim, t] = rotation(dim, t + 1)[:bits] if dim <= 4096 else np.random.default_rng(t + 1).standard_normal((bits, dim))
                    keys[here, t] = (x @ planes[dim, t].T >= 0) @ (1 << np.arange(len(planes[dim, t]), dtype=np.int64))
                largest = np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
                unit = (x / largest) / np.linalg.norm(x / largest, axis=1, keepdims=True)
                for i, row in zip(here.tolist(), Codes.of(unit, width).packed()):
                    codes[i] = row.tobytes()
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(dims), pa.array(codes, pa.binary())], names=[*batch.schema.names, "keys", "dim", "code"])

    schema = "rep long, copies long, label string, v array<double>, keys array<int>, dim int, code binary"
    rows = stored(spark, kinds.select("rep", "copies", "label", "v").mapInArrow(coded, schema), "vector-codes")
    light = rows.select("rep", "label", "dim", "keys", "code", F.posexplode("keys").alias("t", "key"))
    # a bucket is named by a hash; two that share one are compared together, and labels are told apart in the end
    dealt = light.select("rep", "dim", "keys", "code", F.col("t").cast("short").alias("t"), F.xxhash64("label", "dim", "t", "key").alias("bucket"))
    large = stored(spark, dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("group_rows")).where(F.col("group_rows") > BLOCK), "large-buckets")
    names = ["bucket", "block_a", "block_b"]
    blocks = met_in_large_blocks(dealt, large, ["bucket"], "rep", BLOCK).repartition(*names)

    def pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The open pairs of a block that meet in it first; vectors of other lengths share nothing with each other."""
        dims, t = group.column("dim").to_numpy(), group.column("t")[0].as_py()
        keys = np.stack(group.column("keys").to_numpy())
        own = group.column("row_block").to_numpy()
        two = group.column("block_a")[0].as_py() != group.column("block_b")[0].as_py()
        for dim in np.unique(dims).tolist():
            here = np.flatnonzero(dims == dim)
            packed = np.frombuffer(b"".join(group.column("code").take(pa.array(here)).to_pylist()), np.uint8).reshape(len(here), -1)
            for a, b in Codes.read(packed, dim).open_pairs(threshold):
                a, b = here[a], here[b]
                use = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
                if two:
                    use &= own[a] != own[b]
                yield a[use], b[use]

    def wanted(group: pa.Table) -> pa.Table:
        seen = np.zeros(group.num_rows, bool)
        if group.num_rows > 1:
            for a, b in pairs(group):
                seen[a] = seen[b] = True
        return group.filter(pa.array(seen)).select([*names, "row_block", "t", "rep"])

    def compare(group: pa.Table) -> pa.Table:
        rep, copies, label = (group.column(c).to_numpy() for c in ("rep", "copies", "label"))
        exact = group.column("v").to_pylist()
        links, ones, others = np.zeros(len(rep), np.int64), [], []
        for a, b in pairs(group):
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                v = np.array([exact[k] for k in used])
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                p, q = place[: len(x)], place[len(x) :]
                near = (np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= threshold) & (label[x] == label[y])
                ones.append(x[near])
                others.append(y[near])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ones, others))
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        seen = np.flatnonzero(links)
        return pa.table({"rep": rep[seen], "links": links[seen], "root": rep[roots(len(rep), a, b)[seen]]})

    opened = stored(spark, blocks.groupBy(*names).applyInArrow(wanted, "bucket long, block_a int, block_b int, row_block int, t short, rep long"), "open-vectors")
    fetched = opened.join(rows, "rep").repartition(*names)
    found = stored(spark, fetched.groupBy(*names).applyInArrow(compare, "rep long, links long, root long"), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # the smallest id of a component: of its kinds' smallest ids
    final = (
        kinds.join(linked, "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("same", "label", "v", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    of_kind = final.select("same", F.col("label").alias("l"), F.col("v").alias("w"), "component_id", "n_links")
    out = base.join(of_kind, (base["same"] == of_kind["same"]) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) n from embeddings
), l as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), c as (
  select vec_id id, vec_id reach from v union select c.id, l.b from c join l on c.reach = l.a
)
select vec_id, (select count(*) from l where a = vec_id) n_links, component_id, component_id = vec_id kept
from v join (select id, min(reach) component_id from c group by id) on id = vec_id
"""
