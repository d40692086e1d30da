"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.queries_sql import PERSONAL_DATA, RANKED, WITNESSES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_sampled_splitters")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op3_block_mixture")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.mixing import mix_report

    return mix_report(table(spark, folder, "documents"))


@query("op5_subword_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.quality import score_documents

    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_line_windows", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
said AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, o, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS k
      FROM said WINDOW p AS (PARTITION BY doc_id ORDER BY o)),
ranked AS (SELECT doc_id, o, row_number() OVER (PARTITION BY k ORDER BY doc_id, o) AS nth FROM w WHERE k IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, o + g AS o FROM ranked, (SELECT unnest([0, 1, 2]) AS g) WHERE nth > 1),
-- a blank line goes when the lines around it that are not blank both go
judged AS (SELECT l.doc_id, l.i, l.line, s.o, c.o IS NOT NULL AS gone FROM l
           LEFT JOIN said s ON s.doc_id = l.doc_id AND s.i = l.i LEFT JOIN covered c ON c.doc_id = s.doc_id AND c.o = s.o),
around AS (SELECT *, last_value(CASE WHEN o IS NOT NULL THEN gone END IGNORE NULLS)
                         OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS before,
                  first_value(CASE WHEN o IS NOT NULL THEN gone END IGNORE NULLS)
                         OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM judged),
final AS (SELECT doc_id, i, line, coalesce(CASE WHEN o IS NULL THEN before AND after ELSE gone END, false) AS gone FROM around),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM final),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
       coalesce(n_spans, 0)::INT AS n_spans, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.line_windows import drop_repeated_lines

    done = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_vector_cells")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.vector_dedup import dedup_vectors

    return dedup_vectors(table(spark, folder, "embeddings"))


@query("op6_order_minhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.order_minhash import group_documents

    return group_documents(table(spark, folder, "documents"))


@query("op7_template_leaks")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.templates import find_leaks

    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows", "coverage", "verbatim")


@query("op10_prefix_free_parsing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.prefix_free import drop_repeated_bytes

    return drop_repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_host_reputation", """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
told AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels
         WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
outcome AS (SELECT u.host, t.good FROM u LEFT JOIN told t
            ON t.doc_id = TRY_CAST(nullif(regexp_extract(u.path, '([0-9]{1,18})(\\.html)?/?$', 1), '') AS BIGINT)),
named AS (SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n,
                 string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l
          FROM outcome WHERE host <> '' GROUP BY host),
hosts AS (SELECT host, good, n, array_to_string(l[greatest(1, len(l) - CASE WHEN len(l) > 2 AND length(l[-1]) = 2
                 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END):], '.') AS domain FROM named),
h AS (SELECT *, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM hosts),
d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 0.5 END AS m FROM x),
x1 AS (SELECT x.*, m FROM x, overall),
x2 AS (SELECT sum(CASE WHEN n > 0 THEN n * power(good / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS v,
              sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS r FROM x1),
xk AS (SELECT CASE WHEN coalesce(r, 0) = 0 OR s <= v THEN 1000.0 ELSE least(greatest(r / (s - v) - 1, 1.0), 1000.0) END AS k FROM x2),
xr AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM x1, xk),
d1 AS (SELECT d.*, xr.m FROM d JOIN xr USING (suffix)),
d2 AS (SELECT sum(CASE WHEN n > 0 THEN n * power(good / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS v,
              sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS r FROM d1),
dk AS (SELECT CASE WHEN coalesce(r, 0) = 0 OR s <= v THEN 1000.0 ELSE least(greatest(r / (s - v) - 1, 1.0), 1000.0) END AS k FROM d2),
dr AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d1, dk),
h1 AS (SELECT h.*, dr.m FROM h JOIN dr USING (domain)),
h2 AS (SELECT sum(CASE WHEN n > 0 THEN n * power(good / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS v,
              sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS r FROM h1),
hk AS (SELECT CASE WHEN coalesce(r, 0) = 0 OR s <= v THEN 1000.0 ELSE least(greatest(r / (s - v) - 1, 1.0), 1000.0) END AS k FROM h2),
ab AS (SELECT host, good, n, good + k * m AS a, n - good + k * (1 - m) AS b FROM h1, hk),
bound AS (SELECT host, good, n, round(a / (a + b) - 1.645 * sqrt(a * b / (power(a + b, 2) * (a + b + 1))), 6) AS lower_bound FROM ab),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                                ('allow', 'org', '/fr/')) AS r(verdict, name, start)),
fits AS (SELECT pages_.host, pages_.path, arg_max(r.name || r.start, length(r.name || r.start)) AS rule,
                arg_max(r.verdict, length(r.name || r.start)) AS verdict
         FROM (SELECT DISTINCT host, path FROM u) pages_ JOIN rules r
           ON (pages_.host = r.name OR ends_with(pages_.host, '.' || r.name)) AND starts_with(pages_.path, r.start) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.lower_bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict,
       coalesce(b.good, 0)::BIGINT AS good, coalesce(b.n, 0)::BIGINT AS labelled, b.lower_bound
FROM u LEFT JOIN fits f USING (host, path) LEFT JOIN bound b USING (host)""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.url_reputation import judge_urls, page_outcomes

    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, table(spark, folder, "labels")))


@query("op8_language_crf")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.langid_crf import identify_languages

    return identify_languages(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query("op11_dual_tree_search", RANKED)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.dual_tree import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_checked_personal_data", PERSONAL_DATA)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm.personal_data import BASE, find_personal_data, joined_spans

    found = find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans("personal", BASE), 256).alias("base_sha256"),
                        joined_spans("personal").alias("spans"))


@query("op13_incremental_witnesses", WITNESSES)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from attesta.llm import merkle

    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*fields, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = merkle.leaf_digest(*fields, F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("given"))
    known = merkle.witnesses(merkle.build(leaves))
    return known.select(
        "row.doc_id", "row.leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.fold(F.col("steps"), F.col("row.given")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
