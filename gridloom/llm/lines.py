"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import SPACES, Own, ascii_lower, digest, hot_keys, or_empty, salted_join
from gridloom.llm.storage import stored


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_lines`` long, ``n_dropped`` long,
    ``kept_text`` string.

    A line's key is the line stripped of white space with A-Z lower-cased; keys
    of at least ``min_chars`` code points found in ``min_docs`` documents lose
    all their lines.  Lines are exploded and hashed to 128 bits once, into a
    table of narrow rows; of these, those with a frequent hash give the
    positions to drop, at most one per line of a document.  The lines of a very
    frequent hash are dealt over parts.  Texts move once, to meet their positions.

    A null or empty text is one empty line, an empty table gives an empty table,
    and rows are documents: repeated rows count as often as they occur.  Whole
    texts are read, however long; the lines of one text pass through one task.
    Columns named like the added ones are replaced, others are kept whatever
    their names.
    """
    mine = Own(docs)
    text = or_empty(mine[text_col])
    row = digest(mine[id_col].cast("string"), mine[text_col])
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))
    scanned = mine.rows.select(row.alias("row"), hashes.alias("hashes"))
    # a key counts once per document: at its line, or in rows of its own where lines of a document are equal
    lone = F.size(F.array_distinct("hashes")) == F.size("hashes")
    places = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("pos"), lone.cast("int").alias("docs")))
    again = F.transform(F.array_distinct("hashes"), lambda h: F.struct(h.alias("h"), F.lit(-1).alias("pos"), F.lit(1).alias("docs")))
    marks = scanned.select("row", F.explode(F.when(lone, places).otherwise(F.concat(places, again))).alias("m")).select("row", "m.*").where(F.col("h").isNotNull())
    marks = stored(marks, "lines")

    counts = marks.groupBy("h").agg(F.sum("docs").alias("n_docs"), F.count(F.lit(1)).alias("n"))
    frequent = stored(counts.where(F.col("n_docs") >= min_docs).select("h", "n"), "frequent-lines")
    lines = marks.where(F.col("pos") >= 0).select("row", "h", "pos")
    hot = hot_keys(frequent, "h", "n", marks.count())
    drops = salted_join(lines, frequent.select("h"), "h", hot, F.col("row"), "left_semi").groupBy("row").agg(F.collect_set("pos").alias("drop"))
    joined = mine.rows.withColumn("row", row).join(drops, "row", "left").withColumn("lines", F.split(text, "\n", -1))
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    out = joined.withColumns({
        "kept_text": F.when(F.col("drop").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")),
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.size(gone).cast("long"),
    })
    return mine.restore(out, "n_lines", "n_dropped", "kept_text")
