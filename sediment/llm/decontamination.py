"""Benchmark passages in training texts, found by spaced seeds in spite of replaced words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A passage is found where ``MATCHES`` of ``WINDOW`` words in a row agree, place by place.
WINDOW, MATCHES = 15, 13
#: A seed spans 12 words and looks at every third of them; the three masks look at different words. Two replaced words
#: cannot touch all three masks, so a window always holds an intact seed at each of its four possible starts.
SPAN, MASKS = 12, 3
STEP = WINDOW - SPAN + 1
_PAD = 6
#: Seeds of the benchmark are broadcast up to this many bytes (18 words of 8 bytes and some more for each).
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 256


#: Characters of scripts that are written without spaces (with their marks), and non-ASCII spaces, punctuation and controls.
_ALONE = "".join(
    rf"\p{{Is{x}}}"
    for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Tai_Tham", "New_Tai_Lue", "Tai_Le", "Tai_Viet", "Javanese", "Balinese")
)
_BETWEEN = r"[\x{80}-\x{10FFFF}&&[\p{Z}\p{P}\p{Cc}\x{200B}\x{2060}\x{FEFF}]]"

#: The only texts that can hold any of these; a cheap test that spares the others the costly one.
_MAY_HOLD = r"[\x{80}-\x{BF}\x{37E}-\x{10FFFF}]"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in lower case: runs of ASCII letters and digits and of non-ASCII characters.

    Non-ASCII spaces, punctuation and controls end a word, and a character of a script without spaces is a word with
    its marks. On texts without either these are the words of ``ORACLE_SQL``.
    """
    low = F.lower(text)
    laid = F.when(low.rlike(_MAY_HOLD), F.regexp_replace(low, rf"{_BETWEEN}|([{_ALONE}]\p{{M}}*)", " $1 ")).otherwise(low)
    words = F.split(laid, r"[^a-z0-9\x{80}-\x{10FFFF}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, name: str, step: int, pad: int, context: str) -> DataFrame:
    """(name, key, context): the seeds of each row's words that start at every ``step``-th word.

    The words are padded with a hash that no other side has, so that windows may reach over a text's ends; the context
    is the 18 words in which all windows of the seed lie.
    """
    padding = F.array_repeat(F.lit(pad).cast("long"), _PAD)
    laid = df.withColumn("n", F.size("words")).where(f"n >= {MATCHES}").withColumn("laid", F.concat(padding, "words", padding))
    starts = F.sequence(F.lit(4), F.col("n") - 4, F.lit(step))

    def seed(e: Column) -> Column:
        keys = [
            F.xxhash64(F.lit(c), *(F.get(F.col("laid"), e + F.lit(o)) for o in range(c, SPAN, MASKS))) for c in range(MASKS)
        ]
        return F.struct(F.slice("laid", e - F.lit(STEP - 2), F.lit(SPAN + 2 * (STEP - 1))).alias(context), F.array(*keys).alias("keys"))

    found = laid.select(name, F.explode(F.transform(starts, seed)).alias("seed"))
    return found.select(name, F.explode("seed.keys").alias("key"), f"seed.{context}")


def _short(words: DataFrame, items: DataFrame, broadcast_bytes: int) -> DataFrame | None:
    """(doc_id, item): items of fewer than ``MATCHES`` words that a text holds whole, by hashes of runs of their length.

    A text brings each of its runs once, for the lengths that some item has; None if there are no such items.
    """
    wanted = items.withColumn("n", F.size("words")).where(f"n between 1 and {MATCHES - 1}")
    wanted = wanted.select("item_id", "n", F.xxhash64("n", "words").alias("key")).distinct()
    lengths = {r.n: r["count"] for r in wanted.groupBy("n").count().collect()}
    if not lengths:
        return None
    if sum(lengths.values()) * SEED_BYTES <= broadcast_bytes:
        wanted = F.broadcast(wanted)

    def runs(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda e: F.xxhash64(F.lit(n), F.slice("words", e, F.lit(n)))))

    found = words.select("doc_id", F.explode(F.concat(*(runs(n) for n in sorted(lengths)))).alias("key")).join(wanted, "key")
    return found.select("doc_id", F.struct("item_id").alias("item"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    short_items: bool = False,
) -> DataFrame:
    """One row per document id: whether its texts hold a benchmark passage, how many items, and which.

    An item is in a document if, at some alignment of their words, ``MATCHES`` of ``WINDOW`` words in a row agree;
    places beyond either end count as disagreeing. Every such window holds an intact seed, which the join finds; the
    words around each hit are then compared place by place. Items with fewer than ``MATCHES`` words match
    nothing, or with ``short_items``, as in the registered query and the pipeline, texts that hold them whole, word by word. Texts are seeded at every fourth word, the benchmark at each; its seeds are broadcast if their number says
    that they are small, else joined by shuffle. Null texts are empty; rows of one id (null is one) are one document's;
    null items are an item without number, which is counted and not listed. Built-in operations only.
    """
    words = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), word_hashes(F.col(f"`{text_column}`").cast("string")).alias("words"))
    items = benchmark.select(
        F.col(f"`{item_column}`").cast("long").alias("item_id"), word_hashes(F.col(f"`{item_text_column}`").cast("string")).alias("words")
    )
    wanted = _seeds(items, "item_id", 1, 2, "other").distinct()
    if wanted.count() * SEED_BYTES <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    same = F.zip_with("around", "other", lambda a, b: (a == b).cast("int"))
    agree = [F.aggregate(F.slice("same", s, WINDOW), F.lit(0), lambda x, y: x + y) >= MATCHES for s in range(1, STEP + 1)]
    found = agree[0]
    for a in agree[1:]:
        found = found | a
    hits = (
        _seeds(words, "doc_id", STEP, 1, "around")
        .join(wanted, "key")
        .withColumn("same", same)
        .where(found)
        .select("doc_id", F.struct("item_id").alias("item"))
    )
    every = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.lit(None).cast("struct<item_id:bigint>").alias("item"))
    short = _short(words, items, broadcast_bytes) if short_items else None
    if short is not None:
        hits = hits.union(short)
    pairs = every.union(hits).distinct()  # a document has at most as many rows here as items
    listed = F.array_sort(F.collect_list(F.col("item.item_id")))
    return pairs.groupBy("doc_id").agg(
        (F.count("item") > 0).alias("contaminated"), F.count("item").alias("n_items"), F.array_join(listed.cast("array<string>"), ",").alias("item_ids")
    )


ORACLE_SQL = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') w from benchmark),
dt as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
bt as (select item_id, unnest(w) word, generate_subscripts(w, 1) p from b),
m as (select doc_id, item_id, dt.p - bt.p shift, bt.p p from dt join bt using (word)),
c as (select doc_id, item_id, count(*) over (partition by doc_id, item_id, shift order by p range between current row and {WINDOW - 1} following) n from m),
h as (select distinct doc_id, item_id from c where n >= {MATCHES})
select doc_id, count(item_id) > 0 contaminated, count(item_id) n_items,
  coalesce(string_agg(cast(item_id as varchar), ',' order by item_id), '') item_ids
from (select distinct doc_id from documents) left join h using (doc_id) group by doc_id
"""
