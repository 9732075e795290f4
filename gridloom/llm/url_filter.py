"""Judging URLs by listed canonical expressions.

A listed expression is a host and the beginning of a path.  A URL may meet it
in as many ways as its host has suffixes and its path has beginnings of listed
lengths.  A blocked Bloom filter of the list passes the possible hits; only
these reach an exact hash join with the list, which removes false positives.
The other pages are judged where they lie and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, ascii_lower, digest, hot_keys, salted_join
from gridloom.llm.storage import stored

#: Words of 64 bits in a block; each key sets one bit in each.
LANES = 4
#: Upper bound of the filter, 8 MB; longer lists raise its false positives, not its size.
MAX_BLOCKS = 1 << 18


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row: ``words`` array<long>, LANES for each block."""
    lanes = [F.bit_or(F.expr("1L").cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))]
    filled = keys.groupBy(_block(F.col(key), blocks).alias("b")).agg(*lanes)
    zero = F.lit(0).cast("long")
    every = keys.sparkSession.range(blocks).join(filled, F.col("id") == F.col("b"), "left")
    packed = F.struct("id", F.array(*(F.coalesce(f"w{i}", zero) for i in range(LANES))).alias("w"))
    return every.agg(F.flatten(F.sort_array(F.collect_list(packed))["w"]).alias("words"))


def bloom_of(keys: DataFrame, key: str, n: int, bits_per_key: int = 16) -> tuple[Column, int]:
    """The filter's words, to be added as a column, and its blocks, for ``n`` keys."""
    blocks = 1
    while blocks * 64 * LANES < n * bits_per_key and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocked_bloom(keys, key, blocks).scalar(), blocks


def may_contain(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter has the key's bit in each lane of its block; ``key``
    is worked out twice, not once a lane."""
    lanes = F.slice(words, (_block(key, blocks) * LANES + 1).cast("int"), F.lit(LANES))
    bit = lambda h: h.bitwiseAND(F.lit(63).cast("long")).cast("int")
    held = lambda h, lane: F.call_function("shiftrightunsigned", lane, bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.aggregate(
        lanes,
        F.struct(F.xxhash64(key, F.lit(1)).alias("h"), F.lit(True).alias("ok")),
        lambda a, lane: F.struct(F.shiftrightunsigned(a["h"], 6).alias("h"), (a["ok"] & held(a["h"], lane)).alias("ok")),
        lambda a: a["ok"],
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", bits_per_key: int = 16) -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has host, path and verdict strings.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest (host and
    path together) wins, and of equally long ones that with the longer host; a
    rule listed twice with two verdicts blocks.  URLs that no rule fits have a
    null rule and the verdict ``otherwise``: they are not listed.  Rules without
    host or verdict, and such as no URL can meet, are left out.

    A null URL or one without ``://`` has empty host and path and is not listed.
    Whole URLs are read, however long.  Repeated rows are judged alike and all
    stay; an empty table gives an empty table, an empty list lists nothing.
    Columns named like the added ones are replaced, others are kept whatever
    their names.  Possible hits are joined once for each distinct address, and
    an address or rule that many pages meet is dealt over parts.
    """
    mine = Own(pages)
    can_fit = (F.length("rh") > 0) & ~F.col("rh").rlike("[/?#]") & ((F.col("rp") == "") | F.startswith("rp", F.lit("/")))
    rules = rules.select(F.coalesce("host", F.lit("")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "verdict").where(F.col("verdict").isNotNull() & can_fit)
    listed = rules.groupBy(F.concat("rh", "rp").alias("rule")).agg(F.max("verdict").alias("verdict"), F.max(F.length("rh")).alias("host_length"), F.max(F.size(F.split("rh", r"\."))).alias("depth"))
    listed = stored(listed, "rules")
    shapes = listed.agg(
        F.sort_array(F.collect_set(F.length("rule") - F.col("host_length"))).alias("lengths"),
        F.sort_array(F.collect_set("depth")).alias("depths"),
    )
    shape = stored(shapes, "rule-shapes")
    words, blocks = bloom_of(listed.select("rule"), "rule", listed.count(), bits_per_key)

    split = mine.rows.withColumn("host", url_host(mine[url_col])).withColumn("path", url_path(mine[url_col]))
    split = split.withColumns({"lengths": shape.select("lengths").scalar(), "depths": shape.select("depths").scalar(), "words": words})
    labels = F.split("host", r"\.")
    tails = F.transform(F.filter("depths", lambda d: (d <= F.size(labels)) & (F.length("host") > 0)), lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    ways = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.concat(t, p))))
    hits = F.filter(ways, lambda w: may_contain(F.col("words"), w, blocks))
    marked = split.withColumn("hits", hits).drop("lengths", "depths", "words")
    clear = marked.where(F.size("hits") == 0).select(*mine.columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    met = marked.where(F.size("hits") > 0).withColumn("page", digest(F.col("host"), F.col("path")))

    addresses = stored(met.groupBy("page").agg(F.first("hits").alias("hits"), F.count(F.lit(1)).alias("n")), "addresses")
    total = addresses.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("ways")).first()
    possible = addresses.select("page", F.explode("hits").alias("rule"))
    by_rule = possible.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    best = (
        salted_join(possible, listed, "rule", hot_keys(by_rule, "rule", "n", total["ways"]), F.col("page"))
        .groupBy("page")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("host_length"), F.col("rule"), F.col("verdict"))).alias("best"))
    )
    judged = salted_join(met.drop("hits"), best, "page", hot_keys(addresses, "page", "n", total["rows"]), mine.spread(), "left")
    judged = judged.select(*mine.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    return mine.restore(clear.unionByName(judged), "host", "path", "rule", "verdict")
