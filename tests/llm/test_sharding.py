from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from attesta.llm.sharding import ShardSettings, shard_documents


def check(docs, settings=ShardSettings()):
    rows = shard_documents(docs, settings).collect()
    assert len(rows) == docs.count()
    slots: dict[int, list[int]] = {}
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < settings.shards
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_near_equal_and_together(small_docs):
    rows = check(small_docs)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    where: dict[str, set] = {}
    for r in rows:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_hot_group_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = check(docs, ShardSettings(ranges=64, samples_per_range=4))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert shard_documents(no_docs).count() == 0


def test_reruns_agree(small_docs):
    once, again = ({(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(small_docs).collect()} for _ in range(2))
    assert once == again


HELPERS = ("_k", "_t", "_size", "_crc", "_cum", "_rank", "_b", "_r", "_range", "_start", "_group", "_shard", "_c0", "a.b")


def test_clashing_names_keep_their_values(odd_docs):
    docs = odd_docs.withColumns({c: F.concat(F.lit("mine"), F.coalesce("source", F.lit("-"))) for c in HELPERS})
    out = check(docs)
    assert all(r[c] == f"mine{r['source'] or '-'}" for r in out for c in HELPERS)
    assert sorted(str(r[c]) for r in out for c in ("doc_id", "text", "lang", "source", "n_chars")) == sorted(
        str(r[c]) for r in docs.collect() for c in ("doc_id", "text", "lang", "source", "n_chars"))


def plain(docs, settings):
    """Every row in one sorted list, cut where the running bytes of whole groups (of single rows in large ones) say."""
    rows = sorted((r["k"], r["t"], r["size"], r["doc_id"]) for r in docs.select(
        F.xxhash64(F.col("text").isNull(), F.col("text")).alias("k"), F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id")).alias("t"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).collect())
    whole, at, starts, sums = sum(r[2] for r in rows), 0, {}, {}
    for k, _, size, _ in rows:
        starts.setdefault(k, at)
        sums[k] = sums.get(k, 0) + size
        at += size
    out, before, at = [], {}, 0
    for k, _, size, doc_id in rows:
        small = sums[k] <= int(whole / settings.shards * settings.whole_group)
        middle = starts[k] + sums[k] // 2 if small else at + size // 2
        shard = min(middle * settings.shards // whole, settings.shards - 1)
        out.append((doc_id, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + 1
        at += size
    return sorted(out)


def test_equals_plain_version(spark, small_docs):
    copies = small_docs.unionByName(small_docs.where("doc_id < 3").withColumn("doc_id", F.explode(F.sequence(F.lit(90_000), F.lit(90_400)))))
    for docs, settings in ((small_docs, ShardSettings()), (copies, ShardSettings(shards=5, ranges=32, samples_per_range=4, whole_group=0.05))):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(docs, settings).collect())
        assert got == plain(docs, settings)
