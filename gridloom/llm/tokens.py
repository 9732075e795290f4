"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, or_empty
from gridloom.llm.storage import shared_dir, small_batches

#: Characters of the chunks whose counts a worker remembers, ENTRY more for each.
REMEMBERED, ENTRY = 1 << 24, 16
#: Longest chunk that is remembered.
SHORT_CHUNK = 64
#: Characters of unknown chunks that the library gets at a time.
BATCH_CHARS = 1 << 18


def tokenizer_digest(kind: str, data: bytes) -> str:
    """Names a tokenizer by content and by the library that runs it."""
    library = __import__({".json": "tokenizers", ".model": "sentencepiece"}[kind])
    return hashlib.sha256(data + f"|{kind}|{library.__version__}".encode()).hexdigest()


def _cuts_at_spaces(data: bytes) -> bool:
    """Whether a lone space after a non-space always begins a piece: plain
    byte-level pre-tokenizers without a normaliser or greedy added tokens."""
    spec = json.loads(data)
    pre = spec.get("pre_tokenizer") or {}
    greedy = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec.get("added_tokens", []))
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer") and not greedy


#: A space beside white space; only then may a cut fall wrongly.
_TOUCHING = re.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")


def chunks(text: str) -> list[str]:
    """The text cut before each space that stands alone between non-spaces;
    all but the first chunk less that space."""
    parts = text.split(" ")
    if not _TOUCHING.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1]
        if part and last and not last[-1].isspace() and not part[0].isspace():
            out.append(part)
        else:
            out[-1] = last + " " + part
    return out


def _library(kind: str, data: bytes):
    """Token counts of texts as the library gives them, and whether ``chunks`` may cut them."""
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = tokenizers.Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)], _cuts_at_spaces(data)


def counter(kind: str, data: bytes):
    """A function from a text to its token count, without begin, end or added
    tokens.  Where the tokenizer cuts at lone spaces anyway, the library encodes
    each distinct chunk of a text once, BATCH_CHARS at a time, and a worker
    remembers the counts of short chunks, up to REMEMBERED characters of them."""
    library, cuts = _library(kind, data)
    known: dict[str, int] = {}
    held = 0

    def learn(new: list[str]) -> None:
        nonlocal held
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (chars < BATCH_CHARS or end == at):
                chars += len(new[end])
                end += 1
            known.update(zip(new[at:end], library([" " + x for x in new[at:end]]), strict=True))
            held += chars + ENTRY * (end - at)
            at = end

    def one(text: str) -> int:
        nonlocal held
        first, *rest = chunks(text)
        try:
            total = sum(map(known.__getitem__, rest))
        except KeyError:
            new = list({p for p in rest if p not in known})
            learn(new)
            total = sum(map(known.__getitem__, rest))
            for chunk in new:
                if len(chunk) > SHORT_CHUNK:
                    del known[chunk]
                    held -= len(chunk) + ENTRY
        total += library([first])[0]
        if held > REMEMBERED:
            known.clear()
            held = 0
        return total

    return one if cuts else (lambda text: library([text])[0])


def _encoder(kind: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(kind, model.value)
        for batch in batches:
            out = [count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["content", "n_tokens"])

    return run


def default_cache(spark) -> str:
    """The cache of the shared folder, which later calls meet again."""
    return f"{shared_dir(spark)}/token-cache"


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``n_tokens`` (long).

    ``cache`` is a folder of Parquet files (tokenizer, content, n_tokens) that
    all executors see; None takes the one of the shared folder.  Distinct
    contents (sha-256 of the text; a null text is the empty one) that the cache
    lacks for this tokenizer version are encoded once each and appended; then
    all documents join the counts by digest.  A count depends on its digests
    alone, so rows that two writers or a broken run left twice are equal and
    are folded on reading.  Copies meet by partial aggregation before they are
    shuffled.

    Texts are read whole; a very long one is encoded by one task, in bounded
    pieces where the tokenizer cuts at lone spaces.  Repeated rows keep their
    own rows; an empty table gives an empty table; columns of ``docs`` named
    like the added ones are replaced, others are kept whatever their names.
    The tokenizer file is read by the driver and sent along (a few MB).
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, data = Path(tokenizer).suffix, Path(tokenizer).read_bytes()
    version = tokenizer_digest(kind, data)
    cache = cache or default_cache(spark)
    schema = "content binary, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        held = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
        return held.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))

    mine = Own(docs)
    text = or_empty(mine[text_col])
    content = F.unhex(F.sha2(text, 256))
    distinct = mine.rows.select(content.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    missing = distinct.join(known().select("content"), "content", "left_anti")
    encoded = missing.mapInArrow(_encoder(kind, spark.sparkContext.broadcast(data)), "content binary, n_tokens long")
    encoded.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    out = mine.rows.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("content", content).join(known(), "content")
    return mine.restore(out, "n_bytes", "n_tokens")
