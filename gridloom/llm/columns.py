"""Column expressions and joins that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: The white space of all contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A key with more than 1 / HOT of all rows is split, so fewer than HOT are.
HOT = 4096


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unit(col: Column) -> Column:
    """A double in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(col, 11).cast("double") / F.lit(float(1 << 53))


def digest(*cols: Column) -> Column:
    """16 bytes that tell rows of strings apart, nulls included."""
    written = [F.coalesce(F.concat(F.lit("+"), F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat(*written)))


def local_rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows as a plan of literals, without Python workers or RDDs."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))))


class Own:
    """A caller's columns while an operator works: ``rows`` has them under the
    names own0, own1, ..., beside which the operator names its columns freely;
    ``restore`` gives them their names again."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.columns = [f"own{i}" for i in range(len(self.names))]
        self.rows = df.toDF(*self.columns)

    def name_of(self, name: str) -> str:
        lower = [n.lower() for n in self.names]
        return self.columns[self.names.index(name) if name in self.names else lower.index(name.lower())]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.name_of(name))

    def spread(self) -> Column:
        """A hash that deals rows of a key over parts; only rows that agree in
        all plain columns agree in it."""
        plain = [c for c in self.columns if isinstance(self.rows.schema[c].dataType, AtomicType)]
        return F.xxhash64(*(F.col(c) for c in plain)) if plain else F.lit(0).cast("long")

    def restore(self, df: DataFrame, *added: str) -> DataFrame:
        """The caller's columns that ``df`` still has, less those named like an
        added one, and the added."""
        new, held = {a.lower() for a in added}, set(df.columns)
        return df.select(*(F.col(c).alias(n) for c, n in zip(self.columns, self.names, strict=True) if c in held and n.lower() not in new), *added)


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Of (``key``, rows ``n``), the keys with more than 1 / HOT of the
    ``total`` rows, and ``splits``, into how many parts they are dealt."""
    part = max(1, total // HOT)
    return counted.where(F.col(n) > part).select(key, F.ceil(F.col(n) / part).cast("int").alias("splits"))


def salted_join(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` join ``found`` on ``key``, with the rows of ``hot`` keys dealt
    over parts by the hash of ``by``; their ``found`` goes to each part.  What
    is broadcast has fewer than HOT rows of a key and a number."""
    hot = F.broadcast(hot.select(key, "splits"))
    splits = F.coalesce("splits", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), splits).cast("int")).drop("splits")
    right = found.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("splits")
    return left.join(right, [key, "salt"], how).drop("salt")
