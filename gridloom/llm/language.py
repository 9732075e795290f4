"""Language identification by words, backing off to character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, unit
from gridloom.llm.storage import small_batches, stored

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
#: Longest n-gram of the backoff.
LONGEST = 4
#: Numbers in the vectors of unseen words that a worker remembers.
REMEMBERED = 1 << 18
#: Languages whose sampling rates are sent to all tasks; more meet by a shuffle.
FEW = 10_000
#: N-grams of a word that are summed at a time.
GRAMS = 1 << 14
#: Longest unseen word that is remembered.
SHORT_WORD = 64
#: Characters of a text that are split into words at a time.
SLICE = 1 << 20


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in slices that end between words."""
    text = text.lower()
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            stop = _BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        yield _WORD.findall(text[at:end])
        at = end


class Frequencies:
    """Log frequencies by language of units (words, or n-grams of a length): a
    unit that a language lacks counts half an occurrence there, others half more."""

    def __init__(self, counts: Iterable[tuple[str, str, int]], languages: list[str]):
        column = {lang: i for i, lang in enumerate(languages)}
        self.row: dict[str, int] = {}
        at, of, n = [], [], []
        for lang, unit_, count in counts:
            at.append(self.row.setdefault(unit_, len(self.row)))
            of.append(column[lang])
            n.append(count)
        seen = np.zeros((len(self.row), len(languages)))
        np.add.at(seen, (at, of), n)
        if at:
            whole = seen.sum(axis=0) + 0.5 * len(self.row)
            seen += 0.5
            seen /= whole
            np.log(seen, out=seen)
        self.logs = seen


class Counted:
    """(language, unit, n) of an Arrow table with these columns, as often as
    wanted; a batch at a time is spelt out in Python's objects."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __iter__(self) -> Iterator[tuple[str, str, int]]:
        for batch in self.table.to_batches(max_chunksize=10_000):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class WordFirstModel:
    """Words first; an unseen word by its longest n-grams that are known at all.

    ``counts[0]`` are (language, word, n), ``counts[k]`` (language, k-gram, n)
    of words between ``<`` and ``>``.
    """

    def __init__(self, counts: Sequence[Collection[tuple[str, str, int]] | Counted]):
        self.languages = sorted({lang for lang, _, _ in counts[0]})
        self.words, *self.grams = (Frequencies(c, self.languages) for c in counts)
        self._forget()

    def _forget(self) -> None:
        # rows of remembered words follow those of the known ones, with room to grow
        self.row: dict[str, int] = {}
        self.logs = self.words.logs
        self.most = REMEMBERED // max(1, len(self.languages))

    def __getstate__(self):
        return {"languages": self.languages, "words": self.words, "grams": self.grams}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def backoff(self, word: str) -> np.ndarray:
        """The mean log frequency of the longest n-grams that are known at all."""
        padded = f"<{word}>"
        for k in range(min(LONGEST, len(padded)), 0, -1):
            known, total, n = self.grams[k - 1], np.zeros(len(self.languages)), 0
            for at in range(0, len(padded) - k + 1, GRAMS):
                rows = [r for i in range(at, min(at + GRAMS, len(padded) - k + 1)) if (r := known.row.get(padded[i : i + k])) is not None]
                if rows:
                    total += known.logs[rows].sum(axis=0)
                    n += len(rows)
            if n:
                return total / n
        return np.zeros(len(self.languages))

    def _row(self, word: str) -> int | None:
        """The row of an unseen word; -1 if it has no letter, None if it is too long to keep."""
        if not any(c.isalpha() for c in word):
            return -1
        if len(word) > SHORT_WORD:
            return None
        at = len(self.words.row) + len(self.row)
        if at == len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty((max(1024, at // 2), len(self.languages)))])
        self.logs[at] = self.backoff(word)
        self.row[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        total, any_letter, known = np.zeros(len(self.languages)), False, self.words.row
        if not self.languages:
            return UNKNOWN, 0.0
        for part in words(text or ""):
            rows, times = [], []
            for word, n in Counter(part).items():
                at = known.get(word)
                if at is None:
                    at = self.row.get(word)
                if at is None and (at := self._row(word)) is None:
                    total += n * self.backoff(word)
                    any_letter = True
                elif at >= 0:
                    rows.append(at)
                    times.append(n)
            if rows:
                total += (np.array(times, dtype=float)[:, None] * self.logs[rows]).sum(axis=0)
                any_letter = True
            if len(self.row) > self.most:
                self._forget()
        if not any_letter:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, rows_per_language: int = 2_000, max_units: int = 40_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> WordFirstModel:
    """Learns every language of the labelled rows from a bounded sample.

    Each language gives about ``rows_per_language`` rows, or all it has, picked
    by a hash of their ids over all rows; repeated ids go together.  The model
    keeps each language's ``max_units`` most frequent words, and as many of its
    n-grams of each length up to LONGEST, which are counted over all words of
    the sample.  Both bounds are parameters and hold for each language on its
    own, so a rare one is never crowded out; languages are taken to be few.
    Null texts and languages are left out; nothing labelled learns nothing."""
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    sizes = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    rates = sizes.select("lang", F.least(F.lit(1.0), rows_per_language / F.col("n")).alias("rate"))
    rates = F.broadcast(rates) if sizes.count() <= FEW else rates
    picked = usable.join(rates, "lang").where(unit(F.xxhash64(F.lit("language"), "id")) < F.col("rate"))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("unit")
    seen = picked.select("lang", word).groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("<"), "unit", F.lit(">"))

    def pieces(k: int):
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.struct(F.lit(k).alias("k"), F.substring(padded, i, F.lit(k)).alias("unit")))

    grams = [pieces(k) for k in range(1, LONGEST + 1)]
    # a word has at least three characters with its marks, and only those have a 4-gram
    grams[LONGEST - 1] = F.when(F.length(padded) >= LONGEST, grams[LONGEST - 1]).otherwise(F.array().cast("array<struct<k:int,unit:string>>"))
    listed = seen.select("lang", "n", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("unit"))), *grams)).alias("u"))
    counted = listed.groupBy("lang", F.col("u.k").alias("k"), F.col("u.unit").alias("unit")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "unit"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= max_units).orderBy("k", "lang", "unit")
    table = top.select("k", "lang", "unit", "n").toArrow()
    return WordFirstModel([Counted(table.filter(pc.equal(table["k"], k)).drop_columns("k")) for k in range(LONGEST + 1)])


def identify(docs: DataFrame, model: WordFirstModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred`` string, ``score`` double: the
    most probable learned language of the whole text and its probability under
    equal priors; ``und`` and 0 if the text is null or has no letter, or if
    nothing was learned.  Ties go to the first language by code point.  Only
    the text is looked at, so repeated rows are judged alike.  A long text is
    split a slice at a time, and all n-grams of a long word count.  An empty
    table gives an empty table.  Columns named like the added ones are
    replaced, others are kept whatever their names."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # one text at a time: a batch may be large
            found = [sent.value.predict(x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"])

    mine = Own(docs)
    out = mine.rows.withColumn("p", predicted(mine[text_col])).withColumns({"lang_pred": F.col("p.lang"), "score": F.col("p.score")})
    return mine.restore(out, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
