"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint has the majority bits of the XXH64 values of a text's word shingles. Two fingerprints that differ
in at most three bits agree, in one of their two 32-bit segments, but for one bit at most. So each distinct
fingerprint is indexed under 64 keys, a segment with one of its bits left out; an equality grouping of the keys brings
every such pair together, and the pair is verified by its full distance.

In a bucket, links are found as a spanning forest (a breadth-first search over the fingerprints not yet reached), so n
members give n-1 links at most and never all pairs. A bucket of more than BUCKET members is not searched in one task:
its members go to the next level, where the bits not fixed by the key are cut into four, of which one part at least
must be equal, and so on; every level fixes more bits, so this ends, and it drops nothing.

Components are found over distinct fingerprints by alternating large-star and small-star steps, with checkpoints.

drop_near_copies looks for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints
of five-word shingles tell such texts badly (a tenth of changed shingles flips seven bits), so it links texts by two
fingerprints of their different words, with two seeds, at five bits or fewer: three segments, of which one then differs
by one bit at most. These links only propose. In each of their components every text is compared in full with the one of
the smallest id; where that fails, the links themselves are compared; and the links that hold make the groups. In exact
mode a prefix filter over the rarest shingles proposes instead, which misses no pair and costs a row for every shingle.

Defined results: a null or blank text has fingerprint zero; equal fingerprints link, so repeated rows share a component;
a component's id is its smallest id, null only if it has no other; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import set_similarity
from .common import LOWER_AZ, cut, slices, whole_rows

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Members up to which one task searches a bucket.
BUCKET = 20_000
#: Bits left open below which a bucket is searched whatever its size: it has a few thousand members at most.
FEW_BITS = 12
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Of near copies: words of a compared shingle, their least similarity; words of a fingerprint's shingles, its seeds and
#: the bits in which proposed texts differ at most.
NEAR_WORDS = 5
SIMILARITY = 0.8
NEAR_SHINGLE = 1
NEAR_SEEDS = (42, 1042)
NEAR_DISTANCE = 5


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, distinct: bool = False) -> int:
    """The majority bits of a text's shingles, each as often as it stands there, or once if distinct."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return 0
    if distinct:
        k = min(shingle, len(words))
        words, shingle = list({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}), 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "print"])


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (uint64)."""
    rest, links = prints, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= distance
            if near.any():
                found = rest[near]
                links += [(int(node), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _search(batches: Iterator[pa.RecordBatch], bucket: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; links out (key null), and members of large buckets as they came."""
    names = ["key", "a", "b"]

    def out(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.asarray(a, dtype=np.uint64).view(np.int64)), pa.array(b)], names)

    def searched(keys: np.ndarray, prints: np.ndarray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(at)
        two = at[:-1][sizes == 2]
        near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance
        links = set(zip(prints[two[near]].tolist(), prints[two[near] + 1].tolist()))
        for i in np.flatnonzero(sizes > 2):
            lo, hi = at[i], at[i + 1]
            if sizes[i] > bucket and np.bitwise_count(masks[lo]) > FEW_BITS:
                yield out(keys[lo:hi], prints[lo:hi], masks[lo:hi])
            else:
                links.update(spanning_links(prints[lo:hi], distance))
        if links:
            a, b = np.array(sorted(links), dtype=np.uint64).T
            yield out(pa.nulls(len(a), pa.int64()), np.ascontiguousarray(a), np.ascontiguousarray(b).view(np.int64))

    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    passing = None  # the key of a large bucket whose first part is out already
    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        if passing is not None:
            n = int(np.searchsorted(new[0], passing, "right"))
            if n:
                yield out(new[0][:n], new[1][:n], new[2][:n])
            if n < len(new[0]):
                passing = None
            new = [x[n:] for x in new]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]):
            n = int(np.searchsorted(held[0], held[0][-1], "left"))
            if n:
                yield from searched(*(x[:n] for x in held))
                held = [x[n:] for x in held]
            if len(held[0]) > bucket and np.bitwise_count(held[2][0]) > FEW_BITS:
                passing = held[0][-1]
                yield out(*held)
                held = [x[:0] for x in held]
    if len(held[0]):
        yield from searched(*held)


def _finer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Members of large buckets under as many keys as parts, one more than bits may differ: of so many parts of the bits
    that are not fixed yet, one at least must be equal."""
    for batch in batches:
        rows = []
        for key, a, b in zip(batch.column("key").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            free = [i for i in range(64) if b >> i & 1]
            for q in range(parts):
                part = sum(1 << i for i in free[q * len(free) // parts : (q + 1) * len(free) // parts])
                name = b"%d %d %d" % (key, part, a & part)
                rest = (b & ~part) & (1 << 64) - 1
                rows.append((np.uint64(xxhash.xxh64_intdigest(name)).view(np.int64), a, np.uint64(rest).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(3)], ["key", "print", "mask"])


def _keys(prints: DataFrame, distance: int) -> DataFrame:
    """(key, print, mask): 64 keys a fingerprint, a segment with one of its bits left out; mask has the bits that the key
    does not fix. There are as many segments as make one differ by a bit at most."""
    count = distance // 2 + 1
    bounds = [64 * i // count for i in range(count + 1)]
    starts = [next(lo for lo, hi in zip(bounds, bounds[1:]) if lo <= v < hi) for v in range(64)]
    ends = [next(hi for hi in bounds if v < hi) for v in range(64)]
    fixed = [((1 << hi) - (1 << lo)) & ~(1 << v) for v, lo, hi in zip(range(64), starts, ends)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    at = lambda values: F.element_at(F.array(*values), F.col("v") + 1)
    rows = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    rows = rows.select("print", "v", at([signed(x) for x in fixed]).alias("fixed"), at([F.lit(x) for x in starts]).alias("start"))
    segment = F.expr("shiftrightunsigned(print & fixed, start)")
    return rows.select(F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(segment).alias("key"), "print", F.bitwise_not("fixed").alias("mask"))


def links(prints: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect what pairs within distance connect, for distinct fingerprints in column print."""
    if not 2 <= distance <= 31:
        raise ValueError("segments of 2 to 32 bits are needed")
    rows, found = _keys(prints, distance), None
    search = lambda batches: _search(batches, bucket, distance)
    finer = lambda batches: _finer(batches, distance + 1)
    while True:
        sorted_rows = rows.repartition("key").sortWithinPartitions("key", "print")
        step = cut(sorted_rows.mapInArrow(search, "key long, a long, b long"))
        new = step.where("key is null").select("a", "b")
        found = new if found is None else found.unionByName(new)
        large = step.where("key is not null")
        if large.isEmpty():
            return found.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
        rows = large.mapInArrow(finer, "key long, print long, mask long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge (a, b), by alternating
    large-star and small-star steps until they change nothing."""
    edges = cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct())
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "other")
        least = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))  # cut, so that the join can split a star's centre
        large = both.where("other > node").join(least, "node").select(F.col("root").alias("low"), F.col("other").alias("high")).where("low < high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(least, "high").select(F.col("root").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        edges = cut(small.where("low < high").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == told:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        told = now


def group_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = cut(rows.mapInArrow(_fingerprints, "id long, print long"))
    prints = cut(docs.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links(prints.select("print"), bucket))
    placed = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))  # cut, so that the join can split a hot root
    named = placed.join(smallest, "root").select("print", "component_id")
    return docs.join(named, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Hashes of a text's different shingles, in order; one of the whole sequence of fewer words, none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    k = min(words, len(parts))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(parts[i : i + k])) for i in range(len(parts) - k + 1 if parts else 0)], dtype=np.uint64))


def _node(text: Column) -> Column:
    """Names a text: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def _first(group: str) -> Column:
    """Of a group's texts (node, least) the one with the smallest id, those without an id last."""
    return F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias(group)


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets of shingles, sig_a and sig_b, are similar enough; two without words are."""
    shared = F.size(F.array_intersect("sig_a", "sig_b"))
    whole = F.size("sig_a") + F.size("sig_b") - shared
    return pairs.where((whole == 0) | (shared >= F.lit(least) * whole)).select("a", "b")


def _settle(nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """nodes (node, least) with kept: false for all but the first of each component of the links (a, b)."""
    grouped = components(links_).join(nodes, "node")
    first = grouped.groupBy("root").agg(_first("f")).select("root", F.col("f.node").alias("first"))
    dropped = grouped.join(first, "root").where("node <> first").select("node", F.lit(False).alias("kept"))
    return nodes.join(dropped, "node", "left").select("node", "least", F.coalesce("kept", F.lit(True)).alias("kept"))


def _exact_pairs(sigs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of sigs (node, sig): all pairs of different sets that are similar enough, and a link from each text to the
    first of those with its set."""
    pairs, members = set_similarity(sigs.select("node", F.explode("sig").alias("token")), similarity, "node", "token")
    same = members.where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"))
    blank = sigs.where(F.size("sig") == 0).select("node")  # these have no tokens
    first = blank.agg(F.min("node").alias("a"))
    none = blank.join(F.broadcast(first), F.col("node") > F.col("a")).select("a", F.col("node").alias("b"))
    return pairs.select("a", "b").unionByName(same).unionByName(none)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, words: int = NEAR_WORDS, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, seeds: tuple[int, ...] = NEAR_SEEDS, distance: int = NEAR_DISTANCE, exact: bool = False) -> DataFrame:
    """(node, least, kept) of each different text of df: its name, its smallest id, and whether it stays, the text of the
    smallest id of each group of near copies; exact as the module says."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            prints = [pa.array(np.array([fingerprint(x, shingle, s, distinct=True) for x in texts], dtype=np.uint64).view(np.int64)) for s in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), *prints], ["id", "node", *(f"p{s}" for s in seeds)])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(x, words).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["root", "node", "sig"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), _node(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    if exact:
        nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least")))
        texts = rows.dropDuplicates(["node"]).select(F.lit(b"").alias("root"), "node", "text")
        sigs = cut(texts.mapInArrow(signed, "root binary, node binary, sig array<long>").select("node", "sig"))
        return _settle(nodes, cut(_exact_pairs(sigs, similarity)))
    told = rows.mapInArrow(printed, ", ".join(["id long", "node binary", *(f"p{s} long" for s in seeds)]))
    nodes = cut(told.groupBy("node").agg(F.min("id").alias("least"), *(F.max(f"p{s}").alias(f"p{s}") for s in seeds)))
    proposed = None
    for s in seeds:  # links of prints become links of the texts that have them, the others of a print being linked to one
        own = nodes.select(F.col(f"p{s}").alias("print"), "node")
        one = cut(own.groupBy("print").agg(F.min("node").alias("rep")))
        found = links(one.select("print"), bucket, distance)
        far = found.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        same = own.join(one, "print").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        proposed = far.unionByName(same) if proposed is None else proposed.unionByName(far).unionByName(same)
    proposed = cut(proposed.distinct())
    members = cut(components(proposed).join(nodes.select("node", "least"), "node"))
    leaders = members.groupBy("root").agg(_first("f")).select("root", F.col("f.node").alias("leader"))
    texts = rows.join(members, "node").where(F.col("id").eqNullSafe(F.col("least"))).select("root", "node", "text")
    sigs = cut(texts.mapInArrow(signed, "root binary, node binary, sig array<long>").dropDuplicates(["node"]))
    leading = sigs.join(leaders.select(F.col("leader").alias("node")), "node").select("root", F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    star = cut(_alike(leading.join(sigs.select("root", F.col("node").alias("b"), F.col("sig").alias("sig_b")), "root").where("a <> b"), similarity))
    settled = star.select(F.col("b").alias("node")).unionByName(leaders.select(F.col("leader").alias("node")))
    held = lambda c: settled.select(F.col("node").alias(c), F.lit(True).alias(f"ok_{c}"))
    open_ = proposed.join(held("a"), "a", "left").join(held("b"), "b", "left").where("ok_a is null or ok_b is null").select("a", "b")
    side = lambda c: sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    rest = _alike(open_.join(side("a"), "a").join(side("b"), "b"), similarity)
    return _settle(nodes.select("node", "least"), star.unionByName(rest))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """df's rows with the smallest id of the text that stays of each group of near copies, a group of one included; rule
    as in near_copies."""
    kept = near_copies(df, id_col, text_col, **rule).where("kept").select(F.col("node").alias("kept_node"), "least")
    rows = df.select(F.col(id_col).cast("long").alias("id"), _node(F.col(text_col)).alias("node"), whole_rows(df))
    return rows.join(kept, (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("least")), "left_semi").select("row.*")
