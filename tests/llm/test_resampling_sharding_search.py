"""Importance resampling, sharding and lexical search."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from takewise.llm import entries, lexical_search, resampling, sharding

from .common import ODD, SCHEMA, clashing, empty, odd, prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def terms(text):
    return TERM.findall(lower(text))


def drawn(docs, target, least=20, percent=10):
    """[(id, n_features, weight, score, rank)] by the formulas."""
    at = lambda w: crc32(w.encode()) % 10_000
    few, many = Counter(), Counter()
    for _, text in docs:
        many.update(map(at, terms(text)))
    for text in target:
        few.update(map(at, terms(text)))
    n_many, n_few = many.total(), few.total()
    out = []
    for doc_id, text in docs:
        words = terms(text)
        weight = sum(math.floor(1000 * math.log((few[b] + 1) * (n_many + 10_000) / ((many[b] + 1) * (n_few + 10_000)))) for b in map(at, words))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_ones = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(long_ones[: percent * len(long_ones) // 100], 1):
        x[4] = rank
    return sorted(map(tuple, out), key=repr)


def test_resampling_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = entries.op11_resampling(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert rows(got) == drawn(docs, target)


def test_resampling_rows(spark):
    target = spark.createDataFrame([(1, prose(2)), (2, None)], ITEMS)
    want = drawn([(r[0], r[1]) for r in ODD], [prose(2)], percent=50)
    assert rows(resampling.resample(odd(spark), target, percent=50)) == want
    assert rows(resampling.resample(clashing(spark), target.withColumn("doc_id", F.lit("x")), percent=50)) == want
    assert resampling.resample(empty(spark), target).count() == 0
    assert rows(resampling.resample(odd(spark), target.limit(0), percent=100)) == drawn([(r[0], r[1]) for r in ODD], [], percent=100)


def test_feature_runs():
    words = resampling.words_of("The café, the-CAFÉ 日本 x9".encode())
    assert words == ["the".encode(), "café".encode(), b"the", "cafÉ".encode(), "日本".encode(), b"x9"]
    assert resampling.feature_buckets([b"a", b"b", b"c"], 2).tolist() == [crc32(x) % 10_000 for x in (b"a", b"b", b"c", b"a b", b"b c")]


@pytest.mark.parametrize("partitions,counts", [(1, 8), (3, 3 << 10), (7, 1 << 21)])
def test_radix_ranks(spark, partitions, counts):
    draw = random.Random(partitions)
    data = [(draw.choice([None, -(2**40), 0, 5, draw.randrange(-50, 50)]), draw.choice([7, draw.randrange(2**45)])) for _ in range(500)]
    data += [(3, 3)] * 250  # a third of all rows
    df = spark.createDataFrame(data, "a long, b long").repartition(5)
    ranked = resampling.radix_ranks(df, ["a", "b"], partitions, counts).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(data) + 1))
    assert [(r.a, r.b) for r in ranked] == sorted(data, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert resampling.radix_ranks(df.limit(0), ["a", "b"], partitions, counts).count() == 0


def lawful(got, shards):
    """Counts at most one apart, slots without gaps."""
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_sharding_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = entries.op12_sharding(spark, sf)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    got = df.collect()
    lawful(got, 24)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == sorted((k, len(v) + 8, crc32(v), "rows", None) for k, v in docs.items())


def test_sharding_rows(spark):
    got = sharding.digest(sharding.deal(odd(spark), shards=5)).collect()
    lawful(got, 5)
    texts = [(r[0], (r[1] or "").encode()) for r in ODD]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((k, len(t) + 8, crc32(t)) for k, t in texts), key=repr)
    few = sharding.digest(sharding.deal(odd(spark).limit(3), shards=24)).collect()
    lawful(few, 24)
    assert len(few) == 3
    assert sharding.digest(sharding.deal(empty(spark))).count() == 0
    wide = sharding.deal(clashing(spark).withColumns({"shard": F.lit("s"), "slot": F.lit(0), "bucket": F.lit(1), "place": F.lit(1)}), shards=5)
    assert rows(sharding.digest(wide).drop("shard", "slot")) == rows(sharding.digest(sharding.deal(odd(spark), shards=5)).drop("shard", "slot"))


def test_shuffle_is_uniform_and_splits_copies(spark):
    """Many small buckets; a third of all rows are one row, and places depend on nothing in a row."""
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("some text").alias("text"), F.col("id").alias("was"))
    got = sharding.deal(df, shards=10, bucket_bytes=2048).select("row.*", "shard", "slot").collect()
    lawful(got, 10)
    hot = Counter(r.shard for r in got if r.doc_id == -1)
    assert all(abs(hot[s] - n // 30) < 5 * math.sqrt(n / 30) for s in range(10))
    order = [r.was for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sorted(order) == list(range(n))
    follow = sum(b == a + 1 for a, b in zip(order, order[1:]))
    mean = sum(i * x for i, x in enumerate(order)) / n
    assert follow < 12 and abs(mean - (n - 1) ** 2 / 4) < 4 * (n * n / 12) / math.sqrt(n)  # of a random order about 1, and no correlation
    other = sharding.deal(df, shards=10, bucket_bytes=2048, seed=7).select("row.*", "shard", "slot").collect()
    assert [r.was for r in sorted(other, key=lambda r: (r.shard, r.slot))] != order


def test_offsets_over_blocks(spark):
    sizes = [3, 0, 5, 1, 0, 2, 4]
    written = spark.createDataFrame([(b,) for b, n in enumerate(sizes) for _ in range(n)], "bucket long")
    assert {tuple(r) for r in sharding.offsets(written, block=2).collect()} == {(b, sum(sizes[:b])) for b, n in enumerate(sizes) if n}


def test_write_shards(spark, tmp_path):
    sharding.write_shards(odd(spark), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(ODD, key=repr)
    lawful(back.collect(), 3)


def ranked(docs, items, limit):
    """[(item, rank, doc, score)] by the formulas; docs with distinct ids."""
    words = {i: terms(t) for i, t in docs}
    n_docs, n_terms = sum(1 for w in words.values() if w), sum(map(len, words.values()))
    df = Counter(t for w in words.values() for t in set(w))
    wanted, out = {}, []
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, its in wanted.items():
        found = []
        for i, w in words.items():
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in its if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark):
    docs = [(i, prose(i, 20 + i % 50)) for i in range(150)] + [(1000 + i, prose(3, 30)) for i in range(70)] + [(2000, None), (2001, ""), (None, prose(3, 30)), (2002, "Ünï-CODE a a a 日本 x" * 40)]
    items = [(i, prose(i, 15)) for i in range(12)] + [(12, "nothing holds zzz"), (13, None), (14, "Ünï code"), (3, "日本"), (None, prose(5, 9))]
    df, its = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS)
    for limit, most in ((5, 100), (50, 4), (50, 1)):
        assert rows(lexical_search.search(df, its, limit=limit, most_items=most)) == ranked(docs, items, limit)
    assert rows(lexical_search.search(df, its, most_terms=20)) == ranked(docs, items, 50)
    clash = its.withColumns({"doc_id": F.lit("x"), "id": F.lit(1), "score": F.lit(2), "rank": F.lit(1)})
    assert rows(lexical_search.search(clashing(spark, df), clash)) == ranked(docs, items, 50)
    assert lexical_search.search(df, its.limit(0)).count() == lexical_search.search(empty(spark), its).count() == 0


def test_search_rows(spark):
    """Each row of a repeated id is ranked by itself."""
    items = spark.createDataFrame([(1, prose(1)), (2, "日本語")], ITEMS)
    got = sorted(lexical_search.search(odd(spark), items).collect(), key=lambda r: (r.item_id, r["rank"]))
    assert [r.doc_id for r in got][:5] == [8, 1, 2, 2, 3]  # 8 has 30,000 such words
    assert [r.doc_id for r in got if r.item_id == 2] == [7]
    assert [r["rank"] for r in got] == [*range(1, len(got)), 1]
