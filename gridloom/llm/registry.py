"""The subpackage's queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import contamination, language, lines, mixing, near_duplicates, neighbours, secrets, sharding, tokens, url_filter
from gridloom.llm.columns import local_rows

#: The rules of the URL query (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    out = language.identify(docs, model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base_spans", "linked_spans"))
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"), secrets.written(every).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixing_plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, cap=2.0, keep_text=False)
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates.jaccard_components(_table(spark, sf_dir, "documents"), percent=90, size=3)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = local_rows(spark, URL_RULES, ["host", "path", "verdict"])
    out = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


SQL_OP3 = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT r, doc_id, pos, line,
    trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY r, doc_id
"""

SQL_OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, p, dw.n AS n, item_id FROM dw JOIN iw USING (n, k)),
places AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""

SQL_OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, 'null'))) AS perm, md5(coalesce(text, '')) AS tie
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [3e0, 1e0, 2e0][((rank - 1) % 3 + 1)::INT] AS w, source_size * 2e0 AS most FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS level
  FROM w WINDOW o AS (ORDER BY most / w, rank)
), t AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN most ELSE least(most, common * w) END AS target
  FROM (SELECT *, (SELECT arg_min(level, place) FROM l WHERE level <= most / w) AS common FROM l)
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), q AS (
  SELECT *, floor(target - passes * source_size + 0.5::DOUBLE)::BIGINT AS rest FROM p
), b AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY perm, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
"""

SQL_OP10 = r"""
WITH rules(rh, rp, rv) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT r, arg_max(rh || rp, length(rh || rp) * 100000 + length(rh)) AS rule, arg_max(rv, length(rh || rp) * 100000 + length(rh)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sharding": op2_sharding,
        "op3_line_dedup": op3_line_dedup,
        "op4_language_id": op4_language_id,
        "op5_secret_scan": op5_secret_scan,
        "op6_decontamination": op6_decontamination,
        "op7_neighbours": op7_neighbours,
        "op8_mixing": op8_mixing,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict:
    return {"op3_line_dedup": SQL_OP3, "op6_decontamination": SQL_OP6, "op8_mixing": SQL_OP8, "op10_url_filter": SQL_OP10}
