"""The corpus pipeline against plain Python on a small table with odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import storage
from tests.llm.test_operators import LOWER, plain_language, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, own0 int"
LETTERS = {"aa": "abcdef", "bb": "uvwxyz"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))


def fixture():
    rng = random.Random(21)
    item = prose(rng, "aa", 14)
    rows = []
    for i in range(90):
        lang = "aa" if i % 3 else "bb"
        text = prose(rng, lang, rng.randint(30, 80))
        if i % 10 == 7:
            text += " " + item.upper()
        if i % 10 == 3:
            words = rows[-1][1].split(" ")
            words[3] = "abc"
            text, lang = " ".join(words), rows[-1][2]
        rows.append((i, text, lang, f"s{i % 2}" if i % 7 else None, len(text), "clash", i))
    odd = [(200, None, None, None, None, None, None), (201, "", "aa", "s0", 0, None, 0), (202, "12 34 !", "aa", "s1", 7, None, 0), (None, prose(rng, "bb", 40), "bb", "s0", 1, None, 0), rows[5], rows[5], (6, prose(rng, "aa", 50), "aa", "s1", 1, None, 3)]
    return rows + odd, [("x1", item), ("x2", None), (None, prose(rng, "bb", 3)), ("x3", "")]


def rejected(rows):
    train = [(t, lang) for i, t, lang, *_ in rows if i is not None and t is not None and lang is not None and _crc(i) % 4 != 2]
    predict = plain_language(train)
    return [r for r in rows if predict(r[1])[0] != "und" and predict(r[1])[1] >= 0.5]


def _crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def distinct(rows):
    """One row of each group stays; rows without id or words all stay."""
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0], hashlib.md5((r[1] or "").encode()).hexdigest(), r[4])) for g in groups.values()]


def clean(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = set()
    for _, text in items:
        x = split(text)
        n = min(10, len(x))
        wins |= {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
    sizes = {len(w) for w in wins}
    return [r for r in rows if not any(tuple(w[i : i + n]) in wins for w in [split(r[1])] for n in sizes for i in range(len(w) - n + 1))]


def mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, over, target = 1.5 * sum(sizes.values()), set(names), {}
    while over:
        level = left / sum(weight[s] for s in over)
        full = {s for s in over if level * weight[s] > 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in over})
        left, over = left - sum(target[s] for s in full), over - full if full else set()
    out = Counter()
    for s in names:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"mix-1|{'null' if r[0] is None else r[0]}".encode()).hexdigest(), len(words_of(r[1]))))
        stop, at, copy = math.floor(target[s] + 0.5), 0, 0
        while at < stop:
            for r in mine:
                n = len(words_of(r[1]))
                if 2 * max(0, min(n, stop - at)) >= n and at < stop:
                    out[r] += 1
                at += n
            copy += 1
    return out


def test_run_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rows, items = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    staged, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r[:5] for r in rows]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (rejected, distinct, lambda r: clean(r, items), lambda r: list(mixed(r).elements())), strict=True):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        before, want = want, plain(want)
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        assert len(want) < len(before) or name == "mixing"
        staged.append(len(want))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == Counter(want)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_stages_of_nothing(spark, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([("x", "one two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path))
    assert out.count() == 0 and set(corpus_pipeline.COLUMNS) <= set(out.columns)


def test_scratch_deletes_what_was_stored_within(spark):
    kept = storage.stored(spark.range(3), "kept")
    with storage.scratch(spark):
        gone = storage.stored(spark.range(4), "gone")
        path = gone.inputFiles()[0]
        assert gone.count() == 4
    assert kept.count() == 3
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def test_stored_tables_release_their_job(spark, monkeypatch):
    """What Spark holds of a finished job stayed until the driver happened to
    collect its garbage, and its heap grew till then."""
    held = spark.sparkContext._jsc.sc().env().blockManager().memoryStore().memoryUsed
    spark._jvm.System.gc()
    time.sleep(1)
    before, after = held(), []
    with storage.scratch(spark):
        for i in range(5):
            monkeypatch.setattr(storage, "_next_release", 0.0, raising=False)
            storage.stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), f"released-{i}")
            time.sleep(1)
            after.append(held())
    assert min(after) <= before, (before, after)


def test_releases_rest_in_between(monkeypatch):
    asked = []

    class Spark:
        class _jvm:
            class System:
                @staticmethod
                def gc():
                    asked.append(time.monotonic())
                    time.sleep(0.02)

    monkeypatch.setattr(storage, "_next_release", 0.0)
    ends = time.monotonic() + 1
    while time.monotonic() < ends:
        storage.release(Spark)
        time.sleep(0.005)
    assert 2 <= len(asked) <= 3
    assert asked[1] - asked[0] >= storage.REST * 0.02
