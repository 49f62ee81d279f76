"""A Merkle tree over a dataset's rows, with the proof of every row found by pointer jumping.

Nodes that share a parent are a *run*, at most ``FAN`` of them. They have the same way from their parent to the root, so
a run is one row: the digests in it, a pointer to the run that its parent is in, and the siblings met up to there.
Joining the runs with themselves on the pointer doubles the distance that each row covers and appends the siblings, so
all runs reach the root after as many joins as the logarithm of the tree's height. Each leaf then has its own siblings
in its run and the rest from the run's row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.components import stored

#: Nodes of a run.
FAN = 16
#: The columns that a leaf is the digest of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values one after another: `-` for a null, else the length in UTF-8 bytes, a colon and the value."""
    told = []
    for value in values:
        text = value.cast("string")
        told.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*told), 256))


def hexed(digest: Column) -> Column:
    """Binary digests as lowercase hexadecimal text."""
    return F.lower(F.hex(digest))


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to: at each step the digest between its siblings is digested anew."""
    return F.aggregate(way, start, lambda node, step: F.unhex(F.sha2(F.concat(hexed(step["left"]), hexed(node), hexed(step["right"])), 256)))


def proof_digest(way: Column) -> Column:
    """Digest of all siblings of a way, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda step: F.concat(hexed(step["left"]), hexed(step["right"]))), ""), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned crc32 of the decimal id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, changed) of documents: ``changed`` is the digest after tampering, null without it."""
    values = [F.col(f"`{name}`") for name in FIELDS]
    lower = F.translate(values[-1].cast("string"), _UPPER, _UPPER.lower())
    doc_id = values[0]
    return docs.select(
        doc_id.alias("doc_id"), values[1].cast("string").alias("source"), leaf_digest(*values).alias("digest"),
        F.when(tampered(doc_id), leaf_digest(*values[:-1], lower)).alias("changed"),
    )


def numbered(spark: SparkSession, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``nth``, their number in their group from 0, and ``n``, the group's size; nulls are one group.

    Rows are dealt out by ranges of (group, order) and written, so a group with a third of all rows spreads over many
    tasks. A row's number is its place in its task plus the rows of its group in the tasks before it; the windows below
    see one row for each group and task.
    """
    placed = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    table = stored(spark, placed, "numbered").withColumn("task", F.shiftright("at", 33))
    counts = table.groupBy(group, "task").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(of_group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col(group).alias("of"), F.col("task").alias("in_task"), (before - F.col("first")).alias("base"), F.sum("here").over(of_group).alias("n"))
    own = F.col(group).eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task"))
    return table.join(bases, own).withColumn("nth", F.col("at") + F.col("base")).drop("at", "task", "of", "in_task", "base")


def _level(nodes: DataFrame, level: int) -> DataFrame:
    """The runs over the nodes (grp, nth, n, node) of one level; a group's only node is a run whose digest is its own."""
    members = F.sort_array(F.collect_list(F.struct("nth", "node"))).alias("members")
    run = nodes.groupBy("grp", F.floor(F.col("nth") / FAN).alias("at"), "n").agg(members)
    run = run.withColumn("members", F.transform("members", lambda m: m["node"]))
    texts = F.array_join(F.transform("members", lambda m: hexed(m["digest"])), "")
    digest = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(F.unhex(F.sha2(texts, 256)))
    return run.select("grp", F.lit(level).alias("level"), "at", "n", F.ceil(F.col("n") / FAN).alias("above"), "members", digest.alias("digest"))


def _tree(spark: SparkSession, nodes: DataFrame, name: str) -> list[DataFrame]:
    """The runs of each level, written one after another; each level has a sixteenth of the rows of the one below."""
    levels = [stored(spark, _level(nodes, 0), f"{name}-0")]
    while not (rest := levels[-1].where("above > 1")).isEmpty():
        parents = rest.select("grp", F.col("at").alias("nth"), F.col("above").alias("n"), F.struct("digest").alias("node"))
        levels.append(stored(spark, _level(parents, len(levels)), f"{name}-{len(levels)}"))
    return levels


def _siblings(digests: Column, place: Column) -> Column:
    """The digests left and right of a place (a long from 0) in a run, joined."""
    text = lambda part: F.unhex(F.array_join(F.transform(part, lambda d: F.hex(d)), ""))
    at = place.cast("int")
    return F.struct(text(F.slice(digests, F.lit(1), at)).alias("left"), text(F.slice(digests, at + 2, F.lit(FAN))).alias("right"))


def _digests(members: str | Column) -> Column:
    return F.transform(members, lambda m: m["digest"])


def jumped(spark: SparkSession, ways: DataFrame) -> DataFrame:
    """(run, way) from (run, up, way): ``up`` points to another row on the way to the root, null where the root is reached.

    Each round every unfinished row appends the way of the row it points to and takes its pointer, so the distance
    doubles. Only rows that are still pointed to are fetched: ever fewer, nearer to the root, so this side stays small
    while the pointing side may share few pointers; the join can split that one.
    """
    table, finished = ways, [ways.where("up is null").select("run", "way")]
    going = ways.where("up is not null")
    while not going.isEmpty():
        wanted = going.select(F.col("up").alias("run")).distinct()
        targets = table.join(wanted, "run").select(F.col("run").alias("up"), F.col("up").alias("next"), F.col("way").alias("rest"))
        moved = stored(spark, going.join(targets, "up").select("run", F.col("next").alias("up"), F.concat("way", "rest").alias("way")), "ways")
        finished.append(moved.where("up is null").select("run", "way"))
        going = moved.where("up is not null")
        table = reduce(DataFrame.unionByName, [f.withColumn("up", F.lit(None).cast(ways.schema["up"].dataType)) for f in finished], going)
    return reduce(DataFrame.union, finished)


def manifest(spark: SparkSession, leaves: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id", "digest")) -> DataFrame:
    """``leaves`` (with a binary ``digest``) with the ``subroot`` of their group, the ``root`` and their ``way`` to it.

    In each group leaves are taken in the given order, nulls first; while a group has several nodes, every ``FAN``
    consecutive ones become the digest of their digests; the last is the subroot, a lone leaf itself. Subroots in the
    order of their groups (a null group first, text by bytes) make the root likewise. ``way`` lists for each level the
    siblings on the left and on the right, joined; a level without siblings is an empty step, a group of one leaf or a
    dataset of one group has no step there.

    Repeated rows are leaves of their own, next to each other; equal ids are ordered by digest. An empty table gives no
    row. A text of any length is one value of its row. Other columns of ``leaves`` pass through, except that the names
    ``subroot``, ``root``, ``way``, ``nth``, ``n``, ``at`` and ``task`` are taken.
    """
    carried = [c for c in leaves.columns if c != group]
    nodes = numbered(spark, leaves, group, list(order))
    levels = _tree(spark, nodes.select(F.col(group).alias("grp"), "nth", "n", F.struct(*(F.col(f"`{c}`") for c in carried)).alias("node")), "leaves")
    tops = reduce(DataFrame.union, [x.where("above = 1").select("grp", F.col("digest")) for x in levels])
    tops = stored(spark, numbered(spark, tops.withColumn("all", F.lit(0)), "all", ["grp"]).select("grp", "digest", "nth", "n"), "tops")
    upper = _tree(spark, tops.select(F.lit(None).cast("string").alias("grp"), "nth", "n", F.struct("digest").alias("node")), "groups")
    last = upper[-1].select("digest").first()
    root = F.lit(bytes(last.digest) if last else None).cast("binary")

    # every run as a row: who it is (group number, -1 above the groups; level; place), where its parent is
    mine = tops.select(F.col("grp").alias("own"), F.col("nth").alias("number"), F.col("n").alias("groups"))
    who = lambda g, level, at: F.struct(g.alias("g"), level.cast("int").alias("level"), at.cast("long").alias("at"))
    last_level = F.col("above") == 1
    at, above = F.col("at"), F.floor(F.col("at") / FAN)
    top_run = who(F.lit(-1).cast("long"), F.lit(0), F.floor(F.col("number") / FAN))
    g = F.col("number")

    def rows(level: DataFrame) -> DataFrame:
        known = level.join(mine, F.col("grp").eqNullSafe(F.col("own")))
        up = F.when(~last_level, who(g, F.col("level") + 1, above)).when(F.col("groups") > 1, top_run)
        place = F.when(last_level, F.col("number")).otherwise(at) % FAN
        return known.select(who(g, F.col("level"), at).alias("run"), up.alias("up"), place.alias("place"), _digests("members").alias("digests"))

    def top_rows(level: DataFrame) -> DataFrame:
        base = F.lit(-1).cast("long")
        up = F.when(~last_level, who(base, F.col("level") + 1, above))
        return level.select(who(base, F.col("level"), at).alias("run"), up.alias("up"), (at % FAN).alias("place"), _digests("members").alias("digests"))

    runs = stored(spark, reduce(DataFrame.union, [rows(x) for x in levels] + [top_rows(x) for x in upper]), "runs")
    met = runs.join(runs.select(F.col("run").alias("up"), F.col("digests").alias("around")), "up", "left")
    step = F.array(_siblings(F.col("around"), F.col("place")))
    nothing = F.slice(F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))), 1, 0)
    ways = jumped(spark, stored(spark, met.select("run", "up", F.when(F.col("up").isNull(), nothing).otherwise(step).alias("way")), "ways"))

    bottom = levels[0].join(tops.select(F.col("grp").alias("own"), F.col("nth").alias("number"), F.col("digest").alias("subroot")), F.col("grp").eqNullSafe(F.col("own")))
    led = bottom.withColumn("run", who(g, F.lit(0), at)).join(ways, "run")
    leaf = led.select("grp", "n", "subroot", "way", _digests("members").alias("digests"), F.posexplode("members").alias("place", "node"))
    own = F.when(F.col("n") == 1, nothing).otherwise(F.array(_siblings(F.col("digests"), F.col("place"))))
    columns = [F.col("grp").alias(group) if c == group else F.col("node")[c].alias(c) for c in leaves.columns]
    return leaf.select(*columns, "subroot", root.alias("root"), F.concat(own, F.col("way")).alias("way"))


def verified_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, subroot and root, the digest of its proof, and the root that its proof leads to
    from the tampered leaf, or from the leaf itself where nothing was changed."""
    proved = manifest(spark, document_leaves(docs))
    back = folded(F.coalesce("changed", "digest"), F.col("way"))
    return proved.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof_digest(F.col("way")).alias("proof_sha256"), hexed(back).alias("folded_root"), (back == F.col("root")).alias("verified"),
    )


def _oracle(leaf_levels: int = 7, group_levels: int = 4) -> str:
    """SQL for :func:`verified_documents`: the tree level by level; as many levels as 16^7 leaves a source need."""
    told = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"
    fields = lambda text: " || ".join(told(v) for v in [*FIELDS[:-1], text])
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = "list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda c, b: {bit}))"
    parts = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, sha256({fields('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(lower)}) END AS changed FROM documents)",
        "l0 AS MATERIALIZED (SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, leaf AS node, doc_id, changed FROM leaves)",
        "d0 AS MATERIALIZED (SELECT doc_id, node AS leaf, coalesce(changed, node) AS acc, '' AS proof, grp, nth FROM l0)",
    ]

    def level(k: int) -> list[str]:
        siblings = [f"array_to_string(members[{a}:{b}], '')" for a, b in (("1", "d.nth % 16"), ("d.nth % 16 + 2", "16"))]
        left, right = (f"CASE WHEN {c} THEN '' ELSE {x} END" for c, x in zip(("d.nth % 16 = 0", "false"), siblings))
        return [
            f"r{k} AS MATERIALIZED (SELECT grp, nth // 16 AS run_no, list(node ORDER BY nth) AS members, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM l{k}) GROUP BY grp, nth // 16)",
            f"l{k + 1} AS MATERIALIZED (SELECT grp, run_no AS nth, CASE WHEN n = 1 THEN members[1] ELSE sha256(array_to_string(members, '')) END AS node FROM r{k})",
            f"d{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN n = 1 THEN acc ELSE sha256(({left}) || acc || ({right})) END AS acc, CASE WHEN n = 1 THEN proof ELSE proof || ({left}) || ({right}) END AS proof, d.grp, d.nth // 16 AS nth, EXTRA FROM d{k} d JOIN r{k} r ON d.grp IS NOT DISTINCT FROM r.grp AND d.nth // 16 = r.run_no)",
        ]

    for k in range(leaf_levels):
        parts += [p.replace(", EXTRA", "") for p in level(k)]
    m = leaf_levels
    parts.append(f"tops AS MATERIALIZED (SELECT grp AS source, node AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS nth FROM l{m})")
    parts.append(f"l{m + 1} AS MATERIALIZED (SELECT 0 AS grp, nth, subroot AS node FROM tops)")
    parts.append(f"d{m + 1} AS MATERIALIZED (SELECT doc_id, leaf, acc, proof, 0 AS grp, t.nth, subroot FROM d{m} d JOIN tops t ON d.grp IS NOT DISTINCT FROM t.source)")
    for k in range(m + 1, m + 1 + group_levels):
        parts += [p.replace("EXTRA", "subroot") for p in level(k)]
    end = m + 1 + group_levels
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT node FROM l{end}) AS root, sha256(proof) AS proof_sha256, "
        f"acc AS folded_root, acc = (SELECT node FROM l{end}) AS verified FROM d{end}"
    )


ORACLE_SQL = _oracle()
