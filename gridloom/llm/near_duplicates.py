"""Jaccard joins over word shingles with adaptive multi-match prefixes.

Two documents can only be similar enough if prefixes of their shingles, rarest
first, share ``m`` shingles, where each prefix is ``m - 1`` longer than for a
single match.  Each document picks its own ``m`` by what the longer prefix costs
and how many candidates it spares; a pair has to share the smaller of its two.

Copies are folded first.  Where few documents of similar size share a prefix
shingle, their pairs are counted and go on with enough matches; where many do,
they meet around the smallest of them, their leader.  Either way a pair is
verified in the star of its smallest common leader and nowhere else.  Stars are split into
cells of bounded size, so neither a pair list nor a task grows with the square
of a group, and what leaves a cell is a forest of its links and their number.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import wordscan
from gridloom.llm.columns import HOT, hot_keys, salted_join
from gridloom.llm.components import connected_components
from gridloom.llm.storage import small_batches, stored
from gridloom.llm.url_filter import bloom_of, may_contain

#: The rarity table has a fixed 2**SKETCH_BITS counters, whatever the input.
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Most shared prefix shingles that a pair may have to show.
MOST_MATCHES = 4
#: Cost of verifying a candidate, in prefix entries.
VERIFY_COST = 8.0
#: Longest run of documents with the same shingle that is spelt out in pairs.
SHORT_RUN = 8
#: Members and shingles of a block of a star; a cell holds two blocks at most.
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1_000_000


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, bounds, *_ in wordscan.scan([(x or "").encode() for x in texts], wordscan.space_separated()):
        every = wordscan.shingle_hashes(words, size) if len(words) >= size else np.empty(0, dtype=np.uint64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(every[a : b - size + 1] if b - a >= size else wordscan.shingle_hashes(words[a:b], size))


def _rarity(sketch: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return sketch[shingles >> np.uint64(64 - SKETCH_BITS)]


def prefix_of(shingles: np.ndarray, sketch: np.ndarray, mean: float, percent: int) -> tuple[int, np.ndarray]:
    """The chosen number of matches and the prefix, rarest first.

    The estimated cost of ``m`` matches is the lists that the prefix touches
    plus the candidates they leave, at most the lists' length over ``m``.
    Counters hold other shingles too; their mean is taken off.
    """
    n = len(shingles)
    need = -(-percent * n // 100)
    counts = _rarity(sketch, shingles)
    order = np.argsort((counts.astype(np.uint64) << np.uint64(32)) | (shingles & np.uint64(0xFFFFFFFF)), kind="stable")
    most = max(1, min(MOST_MATCHES, need))
    front = order[: n - need + most]
    lists = np.cumsum(1.0 + np.maximum(0.0, counts[front] - 3 * mean))
    costs = [lists[n - need + m - 1] * (1 + VERIFY_COST / m) for m in range(1, most + 1)]
    m = int(np.argmin(costs)) + 1
    return m, shingles[front[: n - need + m]]


def _count_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in wordscan.slices(batches):
            texts = batch.column(0).to_pylist()
            for _, words, bounds, *_ in wordscan.scan([(x or "").encode() for x in texts], wordscan.space_separated()):
                if len(words) >= size:
                    at = wordscan.shingle_hashes(words, size) >> np.uint64(64 - SKETCH_BITS)
                    total += np.bincount(at.astype(np.int64), minlength=len(total)).astype(np.uint32)
        yield _sketch_rows(total)

    return run


def _sketch_rows(total: np.ndarray) -> pa.RecordBatch:
    data = [zlib.compress(x.tobytes(), 1) for x in np.split(total, SKETCH_PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(data), dtype=np.uint32).astype(np.uint64)
            totals[part] = totals[part] + counts if part in totals else counts
    for part, counts in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "data"])


def shingle_rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each of 2**SKETCH_BITS hash ranges occur in
    all documents: 8 MB, whatever the input."""
    each = docs.select("text").mapInArrow(_count_shingles(size), "part int, data binary")
    rows = each.repartition(SKETCH_PARTS, "part").mapInArrow(_add_sketches, "part int, data binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.uint64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["data"], dtype=np.uint64)
    return np.minimum(out.reshape(-1), (1 << 31) - 1).astype(np.uint32)


def _describe(sent, size: int, percent: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        mean = float(sketch.mean())
        for batch in wordscan.slices(batches):
            digests, counts, matches, prefixes = [], [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), size):
                m, front = prefix_of(shingles, sketch, mean, percent) if len(shingles) else (0, shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                counts.append(len(shingles))
                matches.append(m)
                prefixes.append(front.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary())], schema=schema
            )

    return run


def _postings(sent, limit: int, heavy: bool):
    """A row for each prefix shingle; those whose counter of the rarity table
    is over ``limit`` (a frequent shingle's always is) apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for batch in batches:
            fronts = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(fronts)), [len(x) for x in fronts])
            tokens = np.concatenate(fronts) if fronts else np.empty(0, dtype=np.uint64)
            mine = (_rarity(sketch, tokens) > limit) == heavy
            at, tokens = at[mine], tokens[mine].view(np.int64)
            for lo in range(0, len(at), 100_000):
                some = pa.array(at[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(tokens[lo : lo + 100_000]), batch.column(1).take(some), batch.column(0).take(some), batch.column(3).take(some)], names=["token", "n", "digest", "matches"])

    return run


def _leaders(percent: int):
    """From postings sorted by shingle and size: (leader, member, need).

    A run ends with its shingle, or where sizes are too far apart to link
    across.  Short runs give their pairs, with the matches a pair has to
    collect; in longer ones each member meets the first one, with need 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, None  # the rows of an open run; its leader if it is long
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            begins = 0 if held is None or leader is None else held.num_rows
            rows, starts, held = _runs(table, percent)
            yield from _meet(rows, starts, leader, begins)
            open_rows = held.num_rows
            if len(starts) or leader is None:
                leader = None
            if open_rows > SHORT_RUN or leader is not None:
                first = leader if leader is not None else held.column(2)[0].as_py()
                skip = begins if leader is not None else 0
                yield from _star(first, held.column(2)[skip:], leader is None)
                leader, held = first, held.slice(open_rows - 1)
        if held is not None and leader is None:
            yield from _meet(pa.Table.from_batches([held]), np.array([0]), None, 0)

    return run


def _runs(table: pa.Table, percent: int):
    """The closed runs' rows and where they start, and the open run's rows."""
    tokens, sizes = table.column(0).to_numpy(), table.column(1).to_numpy()
    fresh = (tokens[1:] != tokens[:-1]) | (percent * sizes[1:] > 100 * sizes[:-1])
    starts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    last = int(starts[-1])
    return table.slice(0, last), starts[:-1], table.slice(last).to_batches()[0]


def _star(leader: bytes, members, whole: bool) -> Iterator[pa.RecordBatch]:
    members = members[1:] if whole else members
    if len(members):
        yield pa.RecordBatch.from_arrays([pa.array([leader] * len(members), pa.binary()), members.cast(pa.binary()), pa.array([0] * len(members), pa.int32())], names=["leader", "member", "need"])


def _meet(rows: pa.Table, starts: np.ndarray, leader: bytes | None, begins: int) -> Iterator[pa.RecordBatch]:
    """Pairs of short closed runs and stars of long ones; the first run goes on
    with ``leader`` from row ``begins`` if there is one."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    digests, matches = rows.column(2).chunk(0), rows.column(3).to_numpy()
    lengths = np.diff(np.append(starts, rows.num_rows))
    first = 0
    if leader is not None:
        yield from _star(leader, digests[begins : int(lengths[0])], False)
        first = 1
    for i in np.flatnonzero(lengths[first:] > SHORT_RUN) + first:
        lo, hi = int(starts[i]), int(starts[i] + lengths[i])
        yield from _star(digests[lo].as_py(), digests[lo:hi], True)
    run_of = np.repeat(np.arange(len(starts)), lengths)
    short = (lengths <= SHORT_RUN) & (np.arange(len(starts)) >= first)
    for d in range(1, SHORT_RUN):
        a = np.flatnonzero((run_of[d:] == run_of[:-d]) & short[run_of[d:]])
        if len(a):
            need = np.minimum(matches[a], matches[a + d]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(a)), digests.take(pa.array(a + d)), pa.array(need)], names=["leader", "member", "need"])


def _meeting(classes: DataFrame, sent, percent: int) -> DataFrame:
    """(leader, member, need) of all prefix shingles; see ``_leaders``.

    The documents of a shingle that more than 1 / HOT of the documents have in
    their prefixes don't meet in one task: their first by size and digest, known
    from an aggregation, is the leader of all of them."""
    limit = max(SHORT_RUN, classes.count() // HOT)
    columns = "token long, n long, digest binary, matches int"
    slim = classes.select("digest", "n", "prefix", "matches")
    some, many = (slim.mapInArrow(_postings(sent, limit, heavy), columns) for heavy in (False, True))
    many = stored(many, "heavy-postings")
    held = many.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "digest")).alias("first"))
    held = stored(held.where(F.col("k") > limit).select("token", "k", F.col("first.digest").alias("leader")), "frequent-shingles")
    hot = hot_keys(held, "token", "k", many.count())
    stars = salted_join(many, held.select("token", "leader"), "token", hot, F.col("digest"))
    stars = stars.where(F.col("leader") != F.col("digest")).select("leader", F.col("digest").alias("member"), F.lit(0).alias("need"))
    rest = salted_join(many, held.select("token"), "token", hot, F.col("digest"), "left_anti").select("token", "n", "digest", "matches")
    runs = some.unionByName(rest).repartition("token").sortWithinPartitions("token", "n", "digest")
    return stars.unionByName(runs.mapInArrow(_leaders(percent), "leader binary, member binary, need int"))


CELL = ["leader", "low", "high"]


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in wordscan.slices(batches):
            for r in batch.to_pylist():
                mine = (r["leader"], r["low"], r["high"])
                if mine != key and held:
                    yield from _cell(held, key, size, percent)
                    held = []
                key = mine
                held.append(r)
        if held:
            yield from _cell(held, key, size, percent)

    return run


def _candidates(fronts: list[np.ndarray], matches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each document the later ones that share enough prefix shingles."""
    tokens = np.concatenate(fronts)
    owner = np.repeat(np.arange(len(fronts)), [len(x) for x in fronts])
    _, inverse = np.unique(tokens, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    lists = np.split(owner[order], np.flatnonzero(np.diff(inverse[order])) + 1)
    at = 0
    for i, front in enumerate(fronts):
        shared = np.bincount(np.concatenate([lists[t] for t in inverse[at : at + len(front)]]), minlength=len(fronts))
        at += len(front)
        later = np.flatnonzero(shared[i + 1 :] >= np.minimum(matches[i], matches[i + 1 :])) + i + 1
        yield i, later


def _cell(rows: list[dict], key: tuple, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    leader, low, high = key
    rows.sort(key=lambda r: (r["n"], r["member"]))
    sets = list(shingle_sets([r["text"] for r in rows], size))
    sizes = np.array([len(s) for s in sets])
    matches = np.array([r["matches"] for r in rows])
    blocks = np.array([r["block"] for r in rows])
    leaders = [set(r["leaders"]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, later in _candidates([np.frombuffer(r["prefix"], dtype=np.uint64) for r in rows], matches):
        later = later[percent * sizes[later] <= 100 * sizes[i]]
        if low != high:
            later = later[blocks[later] != blocks[i]]
        later = [j for j in later.tolist() if min(leaders[i] & leaders[j]) == leader]
        if not later:
            continue
        many = sizes[later]
        other = np.concatenate([sets[j] for j in later])
        at = np.minimum(np.searchsorted(sets[i], other), sizes[i] - 1)
        shared = np.add.reduceat(sets[i][at] == other, np.cumsum(many) - many)
        for j, both in zip(later, shared.tolist(), strict=True):
            if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                links[i] += rows[j]["copies"]
                links[j] += rows[i]["copies"]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    linked = [i for i in range(len(rows)) if links[i]]
    if linked:
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i]["member"] for i in linked], pa.binary()), pa.array([rows[find(i)]["member"] for i in linked], pa.binary()), pa.array([links[i] for i in linked], pa.int64())],
            names=["member", "other", "links"],
        )


def jaccard_components(docs: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` long,
    ``component_id`` (the smallest id reachable by links, its own included),
    ``n_links`` long (linked documents, copies included).

    Words are runs without white space with A-Z lower-cased; a document's set
    are its distinct ``size``-word shingles, or its whole sequence if shorter.
    Two documents link if their sets' Jaccard similarity is ``percent`` or more;
    all such links count.  Null and empty texts have no set and link with
    nothing; rows with a null id neither link nor have a component; rows that
    repeat an id are linked like other rows.  Empty tables give empty tables.
    Whole texts are read, however long.  Other columns of ``docs`` play no part.
    Sets are compared by 64-bit shingle hashes (see ``wordscan``) and folded by
    128-bit digests.
    """
    out = labelled_rows(docs, percent, size, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")


def labelled_rows(docs: DataFrame, percent: int, size: int, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """``jaccard_components`` with ``id``, ``key`` (a string of ``text``, null
    without one) and ``root``: binary, equal in the rows of a component, null in
    those that take no part.  Ids may be shared by components, roots aren't."""
    spark = docs.sparkSession
    small_batches(spark)
    # copies of a text are one text wherever it is looked up
    rep = F.unhex(F.md5(F.col(text_col)))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(None).cast("string") if key is None else key).alias("key"), rep.alias("rep"))
    sketch = shingle_rarity(slim, size)
    sent = spark.sparkContext.broadcast(sketch)

    schema = "rep binary, digest binary, n long, matches int, prefix binary"
    id_type = slim.schema["id"].dataType.simpleString()
    arrow = pa.schema([("id", _arrow_type(slim, "id")), ("key", pa.string()), ("rep", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("matches", pa.int32()), ("prefix", pa.binary())])
    described = stored(slim.mapInArrow(_describe(sent, size, percent, arrow), f"id {id_type}, key string, {schema}"), "described")
    some = described.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = some.groupBy("digest").agg(
        F.min("id").alias("first"), F.min("rep").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix")
    )
    classes = stored(classes, "classes")

    pairs = _meeting(classes, sent, percent)
    pairs = pairs.groupBy("leader", "member").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("least"), F.max("need").alias("most"))
    pairs = stored(pairs.where((F.col("least") == 0) | (F.col("shared") >= F.col("most"))).select("leader", "member"), "stars")
    members = pairs.unionByName(pairs.select("leader", F.col("leader").alias("member")).distinct())

    # a member with its text, once, wherever it goes from here
    of_member = members.groupBy("member").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
    known = stored(of_member.join(classes.withColumnRenamed("digest", "member"), "member"), "members")
    bloom, blocks = bloom_of(known.select("rep"), "rep", known.count())
    texts = slim.select("rep", "text", bloom.alias("bloom")).where(may_contain(F.col("bloom"), F.col("rep"), blocks)).groupBy("rep").agg(F.first("text").alias("text"))
    known_texts = known.join(texts, "rep").select("member", "leaders", "copies", "n", "matches", "prefix", "text")

    star = members.join(known.select("member", "n"), "member").groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    split = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    star = stored(star.select("leader", split.alias("blocks"), "members"), "star-sizes")
    whole = star.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    of_star = salted_join(members, star.select("leader", "blocks"), "leader", hot_keys(star, "leader", "members", whole), F.col("member"))
    dealt = of_star.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = stored(dealt.select("leader", "member", "block", F.least("block", "k").alias("low"), F.greatest("block", "k").alias("high")), "cells")
    met = dealt.join(known_texts, "member").repartition(*CELL).sortWithinPartitions(*CELL)
    found = stored(met.mapInArrow(_verify(size, percent), "member binary, other binary, links long"), "links")

    roots = connected_components(found.select(F.col("member").alias("a"), F.col("other").alias("b")))
    count = found.groupBy("member").agg(F.sum("links").alias("links"))
    rooted = classes.select("digest", "first", "copies").join(roots, F.col("digest") == F.col("node"), "left").join(count, F.col("digest") == F.col("member"), "left")
    rooted = stored(rooted.select("digest", "first", F.coalesce("root", "digest").alias("root"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
    # the least ids of large components and the rows of large classes meet theirs in parts
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("k"))
    whole = rooted.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    named = salted_join(rooted, least.select("root", "component_id"), "root", hot_keys(least, "root", "k", whole["classes"]), F.col("digest"))
    named = stored(named.select("digest", "root", "component_id", "copies", "n_links"), "components")
    hot = hot_keys(named, "digest", "copies", whole["rows"])
    rows = described.select("id", "key", "digest", "n")
    labelled = salted_join(rows.where(F.col("n") > 0), named.select("digest", "root", "component_id", "n_links"), "digest", hot, F.struct("id", "key"), "left")
    labelled = labelled.unionByName(rows.where(F.col("n") == 0), allowMissingColumns=True)
    linking = (F.col("n") > 0) & F.col("id").isNotNull()
    return labelled.select(
        "id", "key", F.col("n").alias("n_shingles"),
        F.when(linking, F.col("root")).alias("root"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"),
        F.when(linking, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    )


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
