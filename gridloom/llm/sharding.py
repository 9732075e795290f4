"""Uniform shuffles into shards of exact sizes.

Rows fall into blocks by hash.  A communication matrix, drawn exactly (see
``hypergeometric``), says how many rows of each block go to each shard; rows
are permuted in their block and dealt by it, exchanged, and permuted again in
their shard.  A large shard is permuted in cells, which random keys fall into
and whose sizes are counted, so no task holds a whole shard.  Both exchanges
move rows without their texts, which meet the dealt rows afterwards by digest
and so move once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, hot_keys, or_empty, salted_join, unit
from gridloom.llm.hypergeometric import running, split_tree
from gridloom.llm.storage import stored

#: Hot rows whose hashes are sent to all tasks (8 MB); more meet by a shuffle.
FEW = 1 << 20


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 20240,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_cell: int = 64_000,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` and ``size`` long (UTF-8 bytes plus 16),
    ``text_crc32`` long, ``shard`` int, ``slot`` long (gapless from 0).

    Shard sizes in rows differ by one at most; every assignment with these
    sizes is equally likely.  Nulls: a null text counts as empty, a null id is
    hashed like a value.  Repeated rows are numbered and permuted like other
    rows; equal rows may swap their slots.  Rows that repeat an id and text more
    often than a sixteenth of a block are counted, and dealt over all blocks.
    An empty table gives an empty table.  Texts are carried whole, however
    long, copies once; a text that very many rows share is dealt over parts.
    Blocks and cells hold about ``rows_per_cell`` rows without texts, at any
    size of the table; without ``keep_text`` the text is left out.  Columns of
    ``docs`` named like the added ones are replaced, others are kept whatever
    their names.
    """
    mine = Own(docs)
    own_text = mine.name_of(text_col)
    text = or_empty(mine[text_col])
    content = F.unhex(F.md5(text)).alias("content")
    narrow = [*(c for c in mine.columns if c != own_text), "size", "text_crc32", "none", "content"]
    rows = mine.rows.select(
        "*",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        mine[text_col].isNull().alias("none"),
        content,
        F.xxhash64(F.lit(seed), mine[id_col], mine[text_col]).alias("same"),
    )
    rows = stored(rows.select(*narrow, "same"), "shard-rows")
    n = rows.count()
    blocks = max(1, math.ceil(n / rows_per_cell))
    cells = math.ceil(blocks / shards)

    keyed = rows.withColumn("copy", F.lit(None).cast("long"))
    often = max(1, n // blocks // 16)
    if blocks > 1:
        hot = stored(rows.groupBy("same").count().where(F.col("count") > often).select("same"), "hot-rows")
        n_hot = hot.count()
        if n_hot:
            keyed = _hot_numbered(keyed, F.broadcast(hot) if n_hot <= FEW else hot, narrow, often)
    place_of = F.coalesce("copy", F.lit(-1).cast("long"))
    keyed = keyed.select(*narrow, F.floor(unit(F.xxhash64(F.lit(seed), "same", place_of)) * blocks).cast("int").alias("block"), "same", "copy")
    filled = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    sizes = (
        docs.sparkSession.range(blocks)
        .join(filled, F.col("id") == F.col("block"), "left")
        .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
        .select(F.col("all.n").cast("array<bigint>").alias("sizes"))
    )
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    quotas = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0).cast("long"))
    matrix = split_tree(sizes.select("sizes", quotas.alias("quotas")), blocks, seed)
    matrix = matrix.select(F.col("leaf").alias("block"), running(F.col("counts")).alias("ends"))

    # equal rows of a block get numbers, so that their ranks and slots differ like those of other rows
    twins = F.row_number().over(Window.partitionBy("block", "same").orderBy("text_crc32")).cast("long")
    numbered = keyed.repartition("block").withColumn("copy", F.when(F.col("copy").isNull(), -twins).otherwise(F.col("copy")))
    numbered = numbered.withColumns({k: F.xxhash64(F.lit(seed + i), "same", "copy") for i, k in ((1, "first"), (2, "again"))}).drop("copy")
    ranked = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("first", "same", "text_crc32")).cast("long"))
    dealt = ranked.join(matrix, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank")))).withColumn("cell", F.floor(unit(F.col("again")) * cells).cast("int"))
    dealt = dealt.select(*narrow, "shard", "cell", "again", "same")
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("again", "same", "text_crc32")).cast("long") - 1
    placed = dealt.withColumn("slot", place)
    if cells > 1:
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        counted = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
        placed = placed.join(stored(counted, "shard-cells"), ["shard", "cell"]).withColumn("slot", F.col("before") + F.col("slot"))
    if keep_text:
        counted = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
        hot = stored(hot_keys(counted, "content", "n", n), "hot-texts")
        texts = mine.rows.select(content, text.alias("whole")).groupBy("content").agg(F.first("whole").alias("whole"))
        placed = _with_texts(placed, texts, hot).withColumn(own_text, F.when(~F.col("none"), F.col("whole")))
    return mine.restore(placed, "size", "text_crc32", "shard", "slot")


def _with_texts(placed: DataFrame, texts: DataFrame, hot: DataFrame) -> DataFrame:
    """``placed`` with the ``whole`` text of its ``content``; only the texts of
    ``hot`` contents, fewer than HOT, go to several parts."""
    if hot.isEmpty():
        return placed.join(texts, "content")
    keys = F.broadcast(hot.select("content"))
    few, many = ((placed.join(keys, "content", how), texts.join(keys, "content", how)) for how in ("left_anti", "left_semi"))
    return few[0].join(few[1], "content").unionByName(salted_join(many[0], many[1], "content", hot, F.struct("shard", "slot")))


def _hot_numbered(keyed: DataFrame, hot: DataFrame, columns: list[str], often: int) -> DataFrame:
    """``keyed`` with ``copy`` from 0 in the rows whose ``same`` is in ``hot``:
    equal rows are folded to counts where they lie, then spelt out again in
    chunks of ``often``, so that no task holds all of them."""
    counts = keyed.join(hot, "same", "left_semi").groupBy("same", *columns).agg(F.count(F.lit(1)).alias("n"))
    # rows that differ in other columns only are not equal: each kind has numbers of its own
    kind = F.xxhash64("same", F.to_json(F.struct(*columns)))
    chunks = counts.withColumn("same", kind).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(often).cast("long"))))
    dealt = chunks.repartition(F.xxhash64("same", "from"))
    spelt = dealt.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + often, "n") - 1)))
    return keyed.join(hot, "same", "left_anti").select(*columns, "same", "copy").unionByName(spelt.select(*columns, "same", "copy"))
