import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from takewise.llm import exact_dedup, simhash

from .common import ODD, clashing, empty, odd, prose, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(data):
    groups = defaultdict(list)
    for i, text in data:
        groups[(text or "").translate(LOWER)].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_exact_groups(spark, partitions):
    random.seed(partitions)
    data = [(i, random.choice(["Same text", "same TEXT", "É", "é", "", None, f"own {i}", "x" * 200 + "a", "x" * 200 + "b"])) for i in range(300)]
    got = exact_dedup.group_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(5), partitions=partitions).collect()
    want = brute_exact(data)
    texts = dict(data)
    assert len(got) == 300
    for r in got:
        norm = (texts[r.doc_id] or "").translate(LOWER)
        assert (r.keep_id, r.group_size) == want[norm]
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_group_over_all_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.group_copies(df, partitions=9)
    assert got.where("kept").count() == 2000 - 667 + 1
    assert rows(got.where("group_size > 1").select("keep_id", "group_size").distinct()) == [(1998, 667)]


def test_exact_odd_rows(spark):
    got = exact_dedup.group_copies(odd(spark)).collect()
    assert len(got) == len(ODD)
    want = brute_exact([(r[0], r[1]) for r in ODD])
    assert sum(r.kept for r in got) == len(want)
    assert sorted(((r.keep_id, r.group_size) for r in got if r.kept), key=repr) == sorted(want.values(), key=repr)
    assert exact_dedup.group_copies(empty(spark)).count() == 0
    assert rows(exact_dedup.group_copies(clashing(spark))) == rows(exact_dedup.group_copies(odd(spark)))


def test_exact_drop(spark):
    kept = exact_dedup.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == len(brute_exact([(r[0], r[1]) for r in ODD]))
    assert exact_dedup.drop_copies(clashing(spark)).count() == kept.count()
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def brute_print(text):
    words = (text or "").translate(LOWER).encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable, for (id, print) rows."""
    least = {}
    for i, p in prints:
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    found = {p: p for p in least}

    def root(p):
        while found[p] != p:
            p = found[p]
        return p

    keys = list(least)
    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 3:
                found[root(keys[a])] = root(keys[b])
    best = {}
    for p in keys:
        best[root(p)] = min((x for x in (best.get(root(p)), least[p]) if x is not None), default=None)
    return {p: best[root(p)] for p in keys}


def test_fingerprint():
    for text in [r[1] for r in ODD] + ["a b", "one", "A b C d"]:
        if not text or len(text) < 10_000:
            assert simhash.fingerprint(text) == brute_print(text)


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    best = brute_components(list(prints.items()))
    got = simhash.group_near_copies(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == best[prints[r.doc_id]]


@pytest.mark.parametrize("bucket", [12, 20_000])
def test_simhash_links_and_large_buckets(spark, bucket):
    rng = np.random.default_rng(bucket)
    prints = set()
    for center in rng.integers(0, 2**64, 3, dtype=np.uint64):
        for _ in range(24):
            p = int(center)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                p ^= 1 << int(bit)
            prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 2**64, 50, dtype=np.uint64)}
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "print long"), bucket))
    got = {np.int64(r.node).view(np.uint64).item(): r.root for r in roots.collect()}
    best = brute_components([(i, p) for i, p in enumerate(prints)])
    groups, want = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[got.get(p, p)].add(p)
        want[best[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(spark):
    got = simhash.group_near_copies(odd(spark))
    prints = [(r[0], brute_print(r[1]) if not r[1] or len(r[1]) < 100_000 else simhash.fingerprint(r[1])) for r in ODD]
    best = brute_components(prints)
    assert rows(got) == sorted([(i, f"{p:016x}", best[p]) for i, p in prints], key=repr)
    assert rows(simhash.group_near_copies(clashing(spark))) == rows(got)
    assert simhash.group_near_copies(empty(spark)).count() == 0


def brute_similarity(a, b):
    """Jaccard similarity of five-word shingles."""

    def sets(text):
        words = (text or "").translate(LOWER).encode().split()
        k = min(5, len(words))
        return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near_texts():
    """Groups of texts with a word changed here and there, and texts that share a third."""
    rng, out = random.Random(9), []
    for g in range(12):
        base = prose(g, 150).split()
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(150)] = f"w{rng.randrange(999)}"
            out.append(" ".join(words))
        out.append(" ".join(base[:50] + prose(100 + g, 100).split()))
    return list(enumerate(out))


@pytest.mark.parametrize("bucket,exact", [(6, False), (20_000, False), (20_000, True)])
def test_near_copies_against_brute_force(spark, bucket, exact):
    """What goes is joined to what stays of its group by texts of similarity 0.8 or more; most of what is so joined goes."""
    data = near_texts()
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(3), bucket=bucket, exact=exact).collect()}
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in data:
        for j, b in data[:i]:
            if brute_similarity(a, b) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {root(i) for i, _ in data}
    assert least <= got  # the first of each true group stays
    missed = len(got) - len(least)
    assert missed <= (0 if exact else 0.1) * (len(data) - len(least)) and len(data) - len(least) > 40


def test_near_copies_odd_rows(spark):
    for df, exact in ((odd(spark), False), (clashing(spark), False), (odd(spark), True)):
        kept = simhash.drop_near_copies(df, exact=exact)
        assert kept.columns == df.columns
        got = [(r.doc_id, r.text) for r in kept.collect()]
        # rows 1 to 3 are one group, told by row 1; the texts without words are one, told by row 4, the first of them
        assert sorted(i for i, _ in got if i is not None) == [1, 4, 4, 7, 8, 9] and sum(i is None for i, _ in got) == 1
    assert simhash.drop_near_copies(empty(spark)).count() == simhash.drop_near_copies(empty(spark), exact=True).count() == 0


def test_segments_cover_the_distance(spark):
    """Two fingerprints within the distance share a key, and keys fix what their masks leave out."""
    rng = np.random.default_rng(5)
    for distance in (3, 5, 7):
        prints = []
        for _ in range(30):
            p = int(rng.integers(0, 2**64, dtype=np.uint64))
            prints.append((p, p ^ sum(1 << int(b) for b in rng.choice(64, distance, replace=False))))
        signed = [(int(np.uint64(x).view(np.int64)),) for pair in prints for x in pair]
        keys = defaultdict(set)
        for r in simhash._keys(spark.createDataFrame(signed, "print long"), distance).collect():
            keys[np.int64(r.print).view(np.uint64).item()].add((r.key, r.mask))
        assert all(len(k) == 64 for k in keys.values()) and all(keys[a] & keys[b] for a, b in prints)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_drop_copies_relies_on_no_plan(spark, reuse):
    """Few long runs that many borders cut, derived once or twice."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 59).alias("text"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        for partitions in (1, 8, 40):
            kept = exact_dedup.drop_copies(df, partitions=partitions).collect()
            assert sorted(r.doc_id for r in kept) == list(range(30_000 - 59, 30_000))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
