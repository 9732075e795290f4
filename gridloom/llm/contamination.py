"""Benchmark decontamination by a prefix-filtered containment join.

A document that contains a window of an item contains the window's rarest
shingle, so a prefix of one shingle is all that has to be joined.  One scan
over the documents sends only the places whose shingle a filter of all prefix
shingles lets pass, each with the words around it; they meet the windows by
shingle, the shingle's offset says where the window would have to lie, the
document's bounds whether it can, and then the words themselves are compared.
Benchmark and documents are both distributed tables; what is broadcast is the
filter, of a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import wordscan
from gridloom.llm.columns import Own, hot_keys, or_empty, salted_join
from gridloom.llm.storage import small_batches, stored
from gridloom.llm.url_filter import bloom_of, may_contain

SHINGLE = 3
#: A word before A-Z are lower-cased.  What ends words is listed one by one:
#: Java looks such characters up in a table and tries ranges in turn.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(0x80) if not chr(c).isalnum()) + "]+"
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bits of the filter of prefix shingles: FILTER_BITS for each, 2**MOST_BITS (16 MB) at most.
FILTER_BITS, MOST_BITS = 1024, 27
#: Probes of the filter, each with its own bits of the shingle's hash.
PROBES = 2


def words_of(text: str) -> list[str]:
    """Runs of 0-9, A-Z (lower-cased), a-z and code points from U+0080 on."""
    return _WORD.findall(text.translate(_LOWER))


def _windows(window: int):
    """(item, text) to (item, words, shingles, offsets): a row per place of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = wordscan.letters_and_digits()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                k = min(SHINGLE, size)
                shingles = wordscan.shingle_hashes(wordscan.word_hashes(text.encode(), tables), k).view(np.int64)
                for lo in range(0, len(words) - size + 1, 10_000):
                    at = range(lo, min(lo + 10_000, len(words) - size + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(at), pa.string()), pa.array([" ".join(words[i : i + size]) for i in at]), pa.array([size] * len(at), pa.int32()), pa.array([shingles[i : i + size - k + 1] for i in at], pa.list_(pa.int64()))],
                        names=["item", "words", "size", "shingles"],
                    )

    return run


def prefix_windows(benchmark: DataFrame, window: int, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(item, words) of all places, and the distinct windows: words, size, their
    rarest shingle and its offset.  Rarity is counted over the distinct
    windows; of equally rare shingles the smallest counts, at its first place."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), or_empty(F.col(item_text)).alias("text"))
    places = stored(items.mapInArrow(_windows(window), "item string, words string, size int, shingles array<bigint>"), "windows")
    distinct = places.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    spelt = distinct.select("words", "size", F.posexplode("shingles").alias("offset", "shingle"))
    counted = spelt.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "shingle", "offset", "size")).alias("r")
    chosen = salted_join(spelt, counted, "shingle", hot_keys(counted, "shingle", "n", spelt.count()), F.col("words")).groupBy("words").agg(rarest)
    chosen = stored(chosen.select("words", "r.size", "r.shingle", "r.offset"), "prefixes")
    return places, chosen


def _probe(shingles: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The bit that probe ``i`` looks at: ``bits`` bits of the hash from the top or the bottom."""
    return shingles >> np.uint64(64 - bits) if i == 0 else shingles & np.uint64((1 << bits) - 1)


def shingle_filter(windows: DataFrame) -> tuple[int, np.ndarray]:
    """``bits`` and a packed table of 2**bits bits with every prefix shingle's
    PROBES bits set; built distributed, only its filled words reach the driver."""
    wanted = windows.agg(F.countDistinct("shingle")).first()[0] * FILTER_BITS
    bits = 12
    while (1 << bits) < wanted and bits < MOST_BITS:
        bits += 1
    places = F.array(F.shiftrightunsigned("shingle", 64 - bits), F.col("shingle").bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    each = windows.select(F.explode(places).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    filled = each.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("set")).toArrow()
    table = np.zeros((1 << bits) // 64, dtype=np.int64)
    table[filled["word"].to_numpy()] = filled["set"].to_numpy()
    return bits, table.view(np.uint64)


def _passes(shingles: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(shingles), dtype=bool)
    for i in range(PROBES):
        at = _probe(shingles, bits, i)
        out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


PLACES = "content binary, n_words long, place long, shingle long, before int, around string"


def _places(sent, window: int, sizes: list[int]):
    """(content, text) to a row for each place whose shingle passes the filter,
    with the words around it: ``before`` ones ahead of it that a window could
    begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = sent.value
        tables = wordscan.letters_and_digits()
        for batch in wordscan.slices(batches):
            contents, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for first, words, bounds, starts, data in wordscan.scan([x.encode() for x in texts], tables):
                for k in sizes:
                    if len(words) < k:
                        continue
                    shingles = wordscan.shingle_hashes(words, k)
                    near = np.flatnonzero(_passes(shingles, bits, table))
                    doc = np.searchsorted(bounds, near, side="right") - 1
                    inside = near + k <= bounds[doc + 1]
                    near, doc = near[inside], doc[inside]
                    for p, d, shingle in zip(near.tolist(), doc.tolist(), shingles[near].view(np.int64).tolist(), strict=True):
                        low, high = int(bounds[d]), int(bounds[d + 1])
                        begin, end = max(low, p - window + 1), min(high, p + window)
                        spelt = words_of(data[starts[begin] : starts[end] if end < len(starts) else len(data)].decode())
                        out.append((contents[first + d], high - low, p - low, shingle, p - begin, " ".join(spelt)))
                        if len(out) >= 20_000:
                            yield _batch(out)
                            out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PLACES.split(", ")])


def merged(spans: Column) -> Column:
    """Sorted array<struct<start, end>> with touching and overlapping ones joined."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(none.alias("out"), F.lit(None).cast("struct<start:int,end:int>").alias("open")),
        lambda a, s: F.when(a["open"].isNull(), F.struct(a["out"].alias("out"), s.alias("open")))
        .when(s["start"] <= a["open"]["end"], F.struct(a["out"].alias("out"), F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], s["end"]).alias("end")).alias("open")))
        .otherwise(F.struct(F.concat(a["out"], F.array(a["open"])).alias("out"), s.alias("open"))),
    )
    return F.when(done["open"].isNull(), none).otherwise(F.concat(done["out"], F.array(done["open"])))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_words`` long, ``hit_spans``
    array<struct<start int, end int>> (words, merged, end exclusive),
    ``hit_items`` array<string> (sorted).

    Windows are ``window`` consecutive words of an item, or all words of a
    shorter one.  Copies of a text are looked up once, and a shingle, passage
    or text that very many share is dealt over parts.  Documents without hits
    are told from the others by a Bloom filter and don't move.

    Nulls: a null text has no words, an item without id marks words but isn't
    listed.  Repeated items count once; repeated documents are rows of their
    own; empty tables give no hits.  Whole texts are read, however long; a text
    is scanned by one task in bounded pieces.  Columns named like the added ones
    are replaced, others are kept whatever their names.
    """
    mine = Own(docs)
    spark = docs.sparkSession
    small_batches(spark)
    places, windows = prefix_windows(benchmark, window, item_id, item_text)
    sizes = sorted({min(SHINGLE, r["size"]) for r in windows.select("size").distinct().collect()})
    sent = spark.sparkContext.broadcast(shingle_filter(windows))

    text = or_empty(mine[text_col])
    content = F.unhex(F.md5(text))
    scanned = mine.rows.select(content.alias("content"), text.alias("text")).mapInArrow(_places(sent, window, sizes), PLACES)
    met = stored(scanned.groupBy(*scanned.columns).agg(F.count(F.lit(1)).alias("copies")), "places")
    by_shingle = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    pairs = salted_join(met, windows, "shingle", hot_keys(by_shingle, "shingle", "n", met.count()), F.struct("content", "place"))
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    at = F.greatest(F.col("before") - F.col("offset") + 1, F.lit(1))
    same = F.array_join(F.slice(F.split("around", " "), at, F.col("size")), " ") == F.col("words")
    hits = pairs.where(fits & same).select("content", "copies", "words", start.cast("int").alias("start"), (start + F.col("size")).cast("int").alias("end"))
    hits = stored(hits, "hits")

    spans = hits.groupBy("content").agg(merged(F.collect_set(F.struct("start", "end"))).alias("hit_spans"), F.max("copies").alias("n"))
    passages = hits.select("content", "words").distinct()
    by_words = passages.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    owners = places.where(F.col("item").isNotNull()).select("item", "words").distinct()
    listed = salted_join(passages, owners, "words", hot_keys(by_words, "words", "n", hits.count()), F.col("content"))
    listed = listed.groupBy("content").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    found = stored(spans.join(listed, "content", "left"), "contaminated")

    # documents that can't be among the found stay where they are
    whole = found.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    bloom, blocks = bloom_of(found.select("content"), "content", whole["texts"])
    maybe = may_contain(F.col("bloom"), content, blocks)
    none = {"hit_spans": F.array().cast("array<struct<start:int,end:int>>"), "hit_items": F.array().cast("array<string>")}
    counted = F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words")
    clear, moved = (mine.rows.withColumn("bloom", bloom).where(x).select(*mine.columns, counted) for x in (~maybe, maybe))
    clear = clear.withColumns(none)
    told = salted_join(moved.withColumn("content", content), found.select("content", *none), "content", hot_keys(found, "content", "n", whole["rows"]), mine.spread(), "left")
    told = told.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()}).select(*clear.columns)
    return mine.restore(clear.unionByName(told), "n_words", "hit_spans", "hit_items")
