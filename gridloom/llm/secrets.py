"""Secrets in texts: single patterns and credentials in several parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.columns import Own, digest, hot_keys, or_empty, salted_join
from gridloom.llm.storage import stored

#: The base patterns.  Runs of access and hex that are too short
#: to count can't hide a longer one, so their least lengths stand in the
#: pattern; short values of assign do consume text and are dropped afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: Parts that count only in company: tokens of letters and digits, and service addresses.
#: A token or assigned value that is too short without its access identifiers is no secret.
WEAK_SECRET = r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+_-]*[0-9])(?=[0-9/+_-]*[A-Za-z])(?!(?:[A-Za-z0-9/+_-]{0,19}?AKIA[A-Z0-9]{16,}+)++[A-Za-z0-9/+_-]{0,19}+(?![A-Za-z0-9/+_-]))[A-Za-z0-9/+_-]{20,}+={0,2}"
ASSIGNED = ASSIGN.replace("([", "(?!(?:[A-Za-z0-9+/_.=-]{0,5}?AKIA[A-Z0-9]{16,}+)++[A-Za-z0-9+/_.=-]{0,5}+(?![A-Za-z0-9+/_.=-]))([")
ENDPOINT = r"""(?i:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, least_value: int = 0, value_only: bool = False) -> Column:
    """array<struct<start, kind, end>> of the leftmost matches that don't
    overlap, in code points, end exclusive; with ``value_only`` of the values
    that end them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"), _value_length(m, pattern, least_value).alias("value")))

    def start(a: Column, x: Column) -> Column:
        return (a["at"] + x["gap"] + x["own"] - x["value"]) if value_only else (a["at"] + x["gap"])

    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["own"]).alias("at"),
            F.when(
                x["value"] >= least_value,
                F.concat(a["out"], F.array(F.struct(start(a, x).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["own"]).alias("end")))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def _value_length(match: Column, pattern: str, least: int) -> Column:
    return F.length(F.regexp_extract(match, pattern, 1)) if least else F.lit(0)


def written(all_spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """The interval join: of (``row``, ``part`` struct<start, kind, end>) the
    secrets with an access identifier within ``scope`` code points, and
    the endpoints with both an access identifier and a secret there.

    One sweep along each row's parts finds the nearest part of a kind on either
    side, so no pairs arise however many parts a text has.
    """
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(0, Window.unboundedFollowing)
    flat = parts.select("row", "part.*").distinct()

    def near(kind: int) -> Column:
        ends = F.max(F.when(F.col("kind") == kind, F.col("end"))).over(before)
        starts = F.min(F.when(F.col("kind") == kind, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - ends <= scope, F.lit(False)) | F.coalesce(starts - F.col("end") <= scope, F.lit(False))

    access, secret, endpoint = (KINDS.index(k) for k in ("access", "secret", "endpoint"))
    swept = flat.withColumn("by_access", near(access)).withColumn("by_secret", near(secret))
    kept = swept.where(F.col("by_access") & ((F.col("kind") == secret) | ((F.col("kind") == endpoint) & F.col("by_secret"))))
    return kept.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``base_spans``, ``linked_spans``:
    array<struct<start int, kind int, end int>>, kind an index into KINDS.

    Base spans are the matches of the single patterns.  Linked spans are weak
    parts, reported only where their complement stands within ``scope`` code
    points of the same text: an access identifier for a weak secret, and for an
    endpoint an access identifier and a secret, weak or the value of an assign
    span; weak secrets that overlap a base span aren't repeated.  Texts without
    an access identifier have nothing to link and never move.

    A null text is empty; an empty table gives an empty table; repeated rows get
    equal spans.  Whole texts are read; the spans of one text, however long,
    are found and swept by one task.  Columns named like the added ones are
    replaced, others are kept whatever their names.
    """
    mine = Own(docs)
    text = or_empty(mine[text_col])
    kind = {k: i for i, k in enumerate(KINDS)}
    found = F.array_sort(F.concat(spans(text, ASSIGN, kind["assign"], 6), spans(text, ACCESS, kind["access"]), spans(text, HEX, kind["hex"])))
    has_access = F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)
    lone = mine.rows.where(~has_access).withColumn("base_spans", found).withColumn("linked_spans", F.array().cast(SPAN))

    some = mine.rows.where(has_access).withColumn("row", digest(mine[id_col].cast("string"), mine[text_col]))
    weak = F.concat(spans(text, WEAK_SECRET, kind["secret"]), spans(text, ENDPOINT, kind["endpoint"]))
    strong = F.concat(spans(text, ACCESS, kind["access"]), spans(text, ASSIGNED, kind["secret"], 6, value_only=True))
    parts = some.select("row", strong.alias("strong"), weak.alias("weak")).groupBy("row").agg(F.first("strong").alias("strong"), F.first("weak").alias("weak"), F.count(F.lit(1)).alias("n"))
    parts = stored(parts, "secret-parts")
    linked = linked_parts(parts.where(F.size("weak") > 0).select("row", F.explode(F.concat("strong", "weak")).alias("part")), scope)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = salted_join(some.withColumn("base_spans", found), linked, "row", hot_keys(parts, "row", "n", total), mine.spread(), "left")
    free = F.filter(
        F.coalesce("linked", F.array().cast(SPAN)),
        lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    met = met.withColumn("linked_spans", F.array_sort(free)).select(*lone.columns)
    return mine.restore(lone.unionByName(met), "base_spans", "linked_spans")
