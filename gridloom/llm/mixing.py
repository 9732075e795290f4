"""Mixing sources to target weights by exact block quotas.

Each source's documents are permuted into a stream of words, repeated as often
as the target asks, and cut into blocks.  A multivariate-hypergeometric
splitting tree recursively partitions the sources' block quotas among the
output shards; a shard then draws its own disjoint run of each source's
permuted blocks, and with them the words of documents that lie there, and
shuffles it locally.  What no shard draws isn't taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, or_empty
from gridloom.llm.hypergeometric import split_tree
from gridloom.llm.storage import stored

WORDS = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
ADDED = ("size", "source_size", "target", "placements")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """From (``source``, ``source_size``): ``rank`` by code point with null
    last, and ``target``: ``share`` of all words by weight, none above ``cap``
    times its source, the excess reshared by weight.

    A source is at its cap if cap over weight is small enough; along that order
    the level at which the rest share is a running sum, so no rounds are needed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w)
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("w"), "rank")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(behind), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(behind), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("at", "level"))
    ranked = ranked.withColumn("common", F.min(fits).over(everything)["level"])
    target = F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("w")))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def block_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (``rank``, ``quota`` in blocks) of the sources: ``rank`` and
    ``ends``, up to which of the source's permuted blocks each shard draws.

    Shards get equally many blocks in all; how many of each source is drawn by
    the splitting tree, as if all blocks had been shuffled and dealt."""
    listed = sources.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.col("q.quota").alias("quotas"))
    blocks = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    share_of = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: (F.floor(blocks / shards) + F.when(j < blocks % shards, 1).otherwise(0)).cast("long"),
    )
    matrix = split_tree(listed.select(share_of.alias("sizes"), "quotas"), shards, seed=seed)
    return (
        matrix.select("leaf", F.posexplode("counts").alias("at", "n"))
        .withColumn("end", F.sum("n").over(Window.partitionBy("at").orderBy("leaf")))
        .groupBy("at")
        .agg(F.sort_array(F.collect_list("end")).alias("ends"))
        .select((F.col("at") + 1).alias("rank"), "ends")
    )


def drawn_pieces(copy: Column, begin: Column, size: Column, ends: Column, stop: Column, block_words: int) -> Column:
    """array<struct<copy, words, shard>>: what each shard draws of a copy at
    ``begin`` of its source's stream.  A shard's words end with its last block,
    and the last block of all with the stream, at ``stop``."""
    last = F.size(ends)
    pieces = F.transform(
        F.sequence(F.lit(1), last),
        lambda j: F.struct(
            copy.cast("int").alias("copy"),
            (
                F.least(begin + size, F.element_at(ends, j) * block_words, stop)
                - F.greatest(begin, F.when(j > 1, F.element_at(ends, F.greatest(j - 1, F.lit(1)))).otherwise(0) * block_words)
            ).cast("long").alias("words"),
            (j - 1).cast("int").alias("shard"),
        ),
    )
    # a copy without words goes with the block it would begin in
    at = F.filter(F.sequence(F.lit(1), last), lambda j: F.element_at(ends, j) * block_words > F.least(begin, stop - 1))
    empty = F.transform(F.slice(at, 1, 1), lambda j: F.struct(copy.cast("int").alias("copy"), F.lit(0).cast("long").alias("words"), (j - 1).cast("int").alias("shard")))
    return F.when(size > 0, F.filter(pieces, lambda p: p["words"] > 0)).otherwise(empty)


def mixing_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    block_words: int = 1000,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 4_000,
    bytes_per_bucket: int = 32 << 20,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` with ``size`` (words), ``source_size``,
    ``target`` and ``placements``: array<struct<copy int, words long, shard
    int>>, the words that each shard draws of each copy, empty if none.

    A source's stream is its permuted documents, pass after pass, as long as its
    rounded target; so full passes take whole documents and the last one takes
    of its last document only the words that are still missing.  A null text has
    no words; a null source is a source of its own; an empty table, or one
    without any words, takes nothing.  Repeated rows are rows of their own.
    Documents without words are taken with the block they lie in.  Whole texts
    are counted, however long.  Columns of ``docs`` named like the added ones
    are replaced, others are kept whatever their names; without ``keep_text``
    the text is left out, so that rows are measured once and move without it.

    Prefix sums run over (source, bucket) cells of about ``rows_per_bucket``
    rows and ``bytes_per_bucket`` bytes of text at any size of the table, so
    that a hot source is spread over tasks; the table of sources is taken to be
    small.
    """
    return _plan(docs, weights, share, cap, shards, block_words, seed, id_col, text_col, source_col, rows_per_bucket, bytes_per_bucket, keep_text)[0]


def _plan(docs, weights, share, cap, shards, block_words, seed, id_col, text_col, source_col, rows_per_bucket, bytes_per_bucket, keep_text) -> tuple[DataFrame, int]:
    """``mixing_plan`` and its number of buckets."""
    mine = Own(docs)
    text = or_empty(mine[text_col])
    whole = mine.rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(whole["rows"] / rows_per_bucket), math.ceil(whole["bytes"] / bytes_per_bucket))
    perm = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(mine[id_col].cast("string"), F.lit("null"))))
    at = F.conv(F.substring(perm, 1, 8), 16, 10).cast("double") / (1 << 32)
    kept = [c for c, n in zip(mine.columns, mine.names, strict=True) if keep_text or n != text_col]
    rows = mine.rows.select(
        *kept,
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        mine[source_col].isNull().alias("none"),
        or_empty(mine[source_col]).alias("src"),
        F.unhex(perm).alias("perm"),
        F.unhex(F.md5(text)).alias("tie"),
        F.floor(at * buckets).cast("int").alias("bucket"),
    )
    if not keep_text:
        rows = stored(rows, "mixing-rows")

    cell = ["none", "src", "bucket"]
    cells = stored(rows.groupBy(*cell).agg(F.sum("size").alias("words")), "mixing-cells")
    name = F.when(~F.col("none"), F.col("src"))
    sizes = cells.groupBy("none", "src").agg(F.sum("words").alias("source_size")).select(name.alias("source"), "source_size")
    sources = source_targets(sizes, weights, share, cap)
    # the stream of a source: whole passes and the rest, its target rounded
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("stop", F.col("passes") * F.col("source_size") + rest)
    sources = stored(sources.withColumn("quota", F.ceil(F.col("stop") / block_words).cast("long")), "mixing-sources")
    ends = block_quotas(sources.select("rank", "quota"), shards, sum(map(ord, seed)))
    sources = sources.join(ends, "rank", "left").select(F.col("source").isNull().alias("none"), or_empty(F.col("source")).alias("src"), "source_size", "target", "passes", "stop", "ends")

    behind = Window.partitionBy("none", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("words").over(behind), F.lit(0)).alias("cell_before")).join(sources, ["none", "src"])
    within = Window.partitionBy(*cell).orderBy("perm", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(within), F.lit(0))).join(cells, cell)
    placed = placed.withColumn("before", F.col("cell_before") + F.col("in_cell"))
    # a copy for each whole pass, and for the last one if it begins before the stream ends
    begun = lambda c: (F.col("stop") > 0) & ((c < F.col("passes")) | (c * F.col("source_size") + F.col("before") < F.col("stop")))
    copies = F.filter(F.sequence(F.lit(0).cast("long"), F.col("passes")), begun)
    pieces = F.transform(copies, lambda c: drawn_pieces(c, c * F.col("source_size") + F.col("before"), F.col("size"), F.col("ends"), F.col("stop"), block_words))
    placed = placed.withColumn("placements", F.flatten(pieces))
    return mine.restore(placed, *ADDED), buckets


def mixed_documents(
    docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 16, block_words: int = 1000, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 4_000, bytes_per_bucket: int = 32 << 20,
) -> DataFrame:
    """The mix itself: a row for each taken copy, whole texts, with the columns
    of ``docs`` plus ``mix_copy`` and ``mix_shard``, each shard locally shuffled.

    Documents stay whole: a copy goes to the shard that draws most of its words,
    the first of equal ones.  The one document of a source that the plan takes
    in part is taken if at least half of its words are, so a source may miss
    its target by half of one document.  Shards are shuffled in parts whose
    number grows with the table.  Odd rows as in ``mixing_plan``.
    """
    planned, buckets = _plan(docs, weights, share, cap, shards, block_words, seed, id_col, text_col, source_col, rows_per_bucket, bytes_per_bucket, True)
    mine = Own(planned)
    pieces = mine["placements"]
    copies = F.transform(F.array_distinct(F.transform(pieces, lambda p: p["copy"])), lambda c: _whole(F.filter(pieces, lambda p: p["copy"] == c), c))
    taken = mine.rows.withColumn("c", F.explode(F.filter(copies, lambda c: c["words"] * 2 >= mine["size"])))
    taken = taken.withColumns({"mix_copy": F.col("c.copy"), "mix_shard": F.col("c.shard")})
    order = F.xxhash64(F.lit("local"), "mix_copy", mine.spread())
    cells = math.ceil(buckets * max(1.0, share) * 2 / shards)
    dealt = taken.withColumn("order", order).repartition("mix_shard", F.pmod(F.col("order"), F.lit(cells)))
    out = mine.restore(dealt.sortWithinPartitions("mix_shard", "order"), "mix_copy", "mix_shard")
    return out.drop(*ADDED)


def _whole(pieces: Column, copy: Column) -> Column:
    """A copy's words in all and the shard with most of them."""
    most = F.array_max(F.transform(pieces, lambda p: F.struct(p["words"].alias("words"), (-p["shard"]).alias("shard"))))
    words = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return F.struct(copy.alias("copy"), words.alias("words"), (-most["shard"]).alias("shard"))
