"""Pairing of notes, onsets, spans and series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import MATCH_TOLERANCE_SEC


#: Onsets of a pair within which islands that start are walked together.
TOGETHER = 4096
#: Sets of a block of those that have a token at one place, and ids of a block of those that have the same set.
BLOCK = 1024
#: Tokens up to which a set goes along with each token of its prefix.
CARRIED = 16


def pair_by_ordinal(notes: DataFrame, columns: list[str]) -> DataFrame:
    """The n-th note of each side of a pair side by side (ref_<column>, prac_<column>); what has no partner stays. One
    grouping, so notes are read once; a side has a number once."""
    of = lambda s, c: F.max(F.when(F.col("side") == s, c))
    sides = (("ref", "reference"), ("prac", "practice"))
    both = notes.groupBy("pair_id", "note_no").agg(*(x for p, s in sides for x in (of(s, F.lit(True)).alias(f"{p}_there"), *(of(s, F.col(c)).alias(f"{p}_{c}") for c in columns))))
    return both.where("ref_there or prac_there")


def note_spans(notes: DataFrame, start: str, end_of_last: Column, *key: str) -> DataFrame:
    """notes with span_end: the next note's start, for the last note end_of_last; key names a take (take_id)."""
    return notes.withColumn("span_end", F.coalesce(F.lead(start).over(W.partitionBy(*(key or ("take_id",))).orderBy("note_no")), end_of_last))


def notes_with_frames(frames: DataFrame, spans: DataFrame, key: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, frames' columns, note_no, start_frame, span_end, carried, framed): of each note one row for itself, with no
    frame, and one (framed) for each frame in [start_frame, span_end) of the same take. Spans do not overlap, so a
    frame's note is the last one that starts at or before it: a running last over the union of both."""
    own = [c for c in frames.columns if c not in key]
    told = F.struct("note_no", "start_frame", "span_end", *carried)
    a = frames.select(*key, F.col("frame").alias("__at"), F.lit(True).alias("framed"), *own)
    b = spans.select(*key, F.col("start_frame").alias("__at"), F.lit(False).alias("framed"), told.alias("__note"))
    order = W.partitionBy(*key).orderBy("__at", "framed", "__note.note_no").rowsBetween(W.unboundedPreceding, 0)
    seen = a.unionByName(b, allowMissingColumns=True).withColumn("__note", F.last("__note", True).over(order))
    return seen.where("__note is not null and (not framed or __at < __note.span_end)").select(*key, *own, "__note.*", "framed")


def frames_in_spans(frames: DataFrame, spans: DataFrame, key: str | list[str] = "take_id") -> DataFrame:
    """(key, note_no, frames' columns) of frames in [start_frame, span_end) of a note of the same take."""
    key = [key] if isinstance(key, str) else key
    rows = notes_with_frames(frames, spans, key)
    return rows.where("framed").select(*key, "note_no", "frame", *(c for c in frames.columns if c not in (*key, "frame")))


def pair_onsets(notes: DataFrame, tolerance: float = MATCH_TOLERANCE_SEC) -> DataFrame:
    """(pair_id, ref_no, prac_no, ref_sec, prac_sec, error_code): order-preserving matches within the tolerance, the
    earlier of two that do not match being passed over; unmatched onsets stay, with nulls for the other side. A pair
    with an onset that is no number, a side whose onsets fall, or, if there is a timeline_basis, one that is not
    REFERENCE, has one row with ALGORITHM_FAILED and nothing else.

    Onsets of either side that follow one another at more than the tolerance part a pair into islands that no match
    crosses. Islands are walked in step, a step an onset, so many together as start within TOGETHER onsets; a group is
    little more than the longest island."""
    basis = F.col("timeline_basis") != "REFERENCE" if "timeline_basis" in notes.columns else F.lit(False)
    rows = notes.select("pair_id", "side", "note_no", "onset_sec", F.coalesce(basis, F.lit(True)).alias("basis"))
    at = F.col("onset_sec")
    odd = at.isNull() | F.isnan(at) | (F.abs(at) == float("inf")) | F.col("basis")
    falls = F.coalesce(at < F.lag("onset_sec").over(W.partitionBy("pair_id", "side").orderBy("note_no")), F.lit(False))
    rows = rows.withColumn("bad", odd | falls).withColumn("bad", F.bool_or("bad").over(W.partitionBy("pair_id")))
    order = W.partitionBy("pair_id").orderBy("onset_sec", "side", "note_no")
    starts = F.coalesce(at - F.lag("onset_sec").over(order) > tolerance + 1e-9, F.lit(True))
    rows = rows.withColumn("starts", F.when(starts, F.row_number().over(order)))
    rows = rows.withColumn("island", F.floor(F.max("starts").over(order.rowsBetween(W.unboundedPreceding, 0)) / TOGETHER))
    rows = rows.withColumn("island", F.when(F.col("bad"), F.lit(0)).otherwise(F.col("island")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pair_id", "note_no")}
    names = ["pair_id", "ref_no", "prac_no", "ref_sec", "prac_sec", "error_code"]

    def run(group: pa.Table) -> pa.Table:
        pair = group.column("pair_id")[:1]
        if group.column("bad")[0].as_py():
            none = pa.nulls(1)
            return pa.table([pair, none.cast(group.schema.field("note_no").type), none.cast(group.schema.field("note_no").type), none.cast(pa.float64()), none.cast(pa.float64()), pa.array(["ALGORITHM_FAILED"])], names)
        group = group.sort_by([("onset_sec", "ascending"), ("note_no", "ascending")])
        ref, prac = (group.filter(pc.equal(group.column("side"), s)) for s in ("reference", "practice"))
        at = [pa.array(x, pa.int64()) for x in walk_in_step(ref.column("onset_sec").to_pylist(), prac.column("onset_sec").to_pylist(), tolerance)]
        of = lambda table, c, i: table.column(c).combine_chunks().take(i)
        n = len(at[0])
        return pa.table([pa.chunked_array([pair.combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64)))]), of(ref, "note_no", at[0]), of(prac, "note_no", at[1]), of(ref, "onset_sec", at[0]), of(prac, "onset_sec", at[1]), pa.nulls(n, pa.string())], names)

    rows = rows.select("pair_id", "island", "side", "note_no", F.col("onset_sec").cast("double").alias("onset_sec"), "bad")
    return rows.groupBy("pair_id", "island").applyInArrow(run, f"pair_id {kinds['pair_id']}, ref_no {kinds['note_no']}, prac_no {kinds['note_no']}, ref_sec double, prac_sec double, error_code string")


def walk_in_step(ref: list[float], prac: list[float], tolerance: float) -> tuple[list[int | None], list[int | None]]:
    """Places of both sides' sorted onsets: of a match, or of one side that is passed over, the other's being null."""
    i = j = 0
    found: list[tuple[int | None, int | None]] = []
    while i < len(ref) or j < len(prac):
        gap = prac[j] - ref[i] if i < len(ref) and j < len(prac) else None
        if gap is not None and abs(gap) <= tolerance:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(prac) or gap is not None and gap > 0:
            found.append((i, None))
            i += 1
        else:
            found.append((None, j))
            j += 1
    return [a for a, _ in found], [b for _, b in found]


def match_onsets(notes: DataFrame, tolerance: float = MATCH_TOLERANCE_SEC) -> DataFrame:
    """(pair_id, ref_no, prac_no, ref_sec, prac_sec): the matches of pair_onsets alone."""
    return pair_onsets(notes, tolerance).where("ref_no is not null and prac_no is not null").drop("error_code")


def comparison_line(series: DataFrame, key: list[str]) -> DataFrame:
    """Values of both sides by index; Hz become cents against the reference's own; the longer side is padded."""
    one = lambda s, n: series.where(F.col("side") == s).select(*key, "idx", F.col("value").alias(n))
    both = one("reference", "ref_value").join(one("practice", "prac_value"), [*key, "idx"], "full")
    cents = F.when((F.col("ref_value") > 0) & (F.col("prac_value") > 0), F.lit(1200.0) * F.log2(F.col("prac_value") / F.col("ref_value")))
    return both.withColumn("ref_cents", F.when(F.col("ref_value") > 0, F.lit(0.0))).withColumn("prac_cents", cents)


def overlap_candidates(prefixes: DataFrame, threshold: float, carried: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(a, b, token), a < b, of sets that may have a Jaccard similarity of the threshold or more: those with a token in both
    prefixes where sizes allow it and enough tokens stand after that place in both. prefixes has id, n (the set's size),
    pos (the token's place in the set's order, from 0) and token; carried columns come along from both sides, as
    <column>_a and <column>_b, in no order. where, of n_a and n_b, says which sizes are wanted.

    A token's sets are parted by (size, place), and large parts into blocks of about BLOCK sets. Which of these may meet is
    found among the parts alone, and only those are joined, block with block; so a token that many sets have at places
    where no pair can reach the threshold joins none, and one that they have at others is spread over the blocks' pairs.
    Of a pair's common tokens the first satisfies the bound if the pair is similar at all."""
    parts = prefixes.groupBy("token", "n", "pos").agg(F.count("*").alias("many"))
    parts = parts.withColumn("blocks", F.ceil(F.col("many") / BLOCK))
    x, y = (parts.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "many", "blocks"))) for s in "ab")
    need = least_shared(threshold)
    room = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("pos_a") <= F.col("pos_b")))
    alike = (F.col("n_a") == F.col("n_b")) & (F.col("pos_a") == F.col("pos_b"))
    meet = x.join(y, "token").where(smaller & ~(alike & (F.col("many_a") == 1)) & (F.col("n_a") >= F.round(F.col("n_b") * threshold, 9)) & (room >= need))
    meet = meet if where is None else meet.where(where)
    each = lambda s: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"blocks_{s}") - 1)).alias(f"block_{s}")
    meet = meet.select("token", "n_a", "pos_a", "n_b", "pos_b", "blocks_b", each("a")).select("token", "n_a", "pos_a", "block_a", "n_b", "pos_b", each("b")).where(~alike | (F.col("block_a") <= F.col("block_b")))
    dealt = prefixes.join(parts, ["token", "n", "pos"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    side = lambda s: dealt.select("token", F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "block", *carried)))
    joined = side("a").join(meet, ["token", "n_a", "pos_a", "block_a"]).join(side("b"), ["token", "n_b", "pos_b", "block_b"])
    within = alike & (F.col("block_a") == F.col("block_b"))
    joined = joined.where(F.when(within, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    own = [f"{c}_{s}" for c in ("n", "pos", *carried) for s in "ab"] if carried else []
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "token", *own)


def least_shared(threshold: float) -> Column:
    """The tokens that sets of n_a and n_b must share to reach the threshold."""
    return F.ceil(F.round((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)), 9))


def set_similarity(tokens: DataFrame, threshold: float, id_col: str = "id", token_col: str = "token", copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity), (id, representative)): all pairs of different token sets, a < b, whose Jaccard similarity is
    the threshold or more; equal sets are one, told by its smallest id. With copies, all pairs of ids: those of equal sets,
    and those of each id of one set with each of another. Ids of a set then go along in blocks of BLOCK, and become rows
    once their sets are found similar.

    Tokens are ordered by the number of sets that have them, the rarest first. Two sets of n tokens and similarity t
    share one among the first n - ceil(t n) + 1 of each, so only these prefixes are joined (overlap_candidates), and a
    pair of sets is verified in full. Nothing is lost by this, and common tokens are joined only where a set has no
    others.

    Sets of up to CARRIED tokens go along with their prefixes, so that a pair is verified where it meets, at its first
    common token, and is never shuffled; before that, masks of 64 bits tell most of those that share too little. Pairs with
    a larger set are made distinct first, and then joined with their sets."""
    sets = tokens.select(F.col(id_col).alias("id"), F.col(token_col).alias("token")).where("token is not null").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    classes = sets.groupBy("tokens").agg(F.min("id").alias("representative"), F.collect_list("id").alias("ids"))
    members = classes.select(F.explode("ids").alias("id"), "representative")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / BLOCK).cast("int")), lambda k: F.slice("ids", k * BLOCK + 1, F.lit(BLOCK)))
    own = classes.select(F.explode(blocks).alias("ids"), "tokens").withColumn("representative", F.array_min("ids")) if copies else classes
    own = own.select(F.col("representative").alias("id"), "tokens", F.size("tokens").alias("n"), *(along := ("ids",) if copies else ()))
    often = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("sets"))
    ranked = own.select("id", "n", F.explode("tokens").alias("token")).join(often, "token")
    rare_first = ranked.groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("sets", "token"))), lambda x: x["token"]).alias("ordered"))
    prefix = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(F.round(F.col("n") * threshold, 9)) + 1).cast("int"))
    mask = F.expr("aggregate(ordered, 0L, (m, t) -> m | shiftleft(1L, cast(pmod(xxhash64(t), 64) as int)))")
    carried = rare_first.join(own.select("id", *along), "id") if copies else rare_first
    small = carried.where(F.col("n") <= CARRIED).select("id", "n", "ordered", *along, mask.alias("mask"), F.posexplode(prefix).alias("pos", "token"))
    small = small.withColumn("before", F.slice("ordered", F.lit(1), F.col("pos")))
    near = overlap_candidates(small, threshold, ("ordered", "mask", "before", *along))
    need = least_shared(threshold)
    first = (F.least("pos_a", "pos_b") == 0) | ~F.arrays_overlap("before_a", "before_b")
    near = near.where((F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= F.col("n_a") + F.col("n_b") - 2 * need) & first)
    # exploded, so that it is computed once
    ends = [f"{c}_{s}" for c in along for s in "ab"] or ["a", "b"]
    near = near.select(*ends, (F.col("n_a") + F.col("n_b")).alias("both"), F.explode(F.array(F.size(F.array_intersect("ordered_a", "ordered_b")))).alias("shared"))
    near = near.select(*ends, (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)
    prefixes = rare_first.select("id", "n", F.posexplode(prefix).alias("pos", "token"))
    pairs = overlap_candidates(prefixes, threshold, where=F.greatest("n_a", "n_b") > CARRIED).select("a", "b").distinct()
    side = lambda x: own.select(F.col("id").alias(x), F.col("tokens").alias(f"t_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in along))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    similarity = shared / (F.size("t_a") + F.size("t_b") - shared)
    found = near.unionByName(both.select(*ends, similarity.alias("similarity")).where(F.col("similarity") >= threshold))
    if copies:
        each = found.select("similarity", "ids_b", F.explode("ids_a").alias("x")).select("similarity", "x", F.explode("ids_b").alias("y"))
        within = own.where(F.size("ids") > 1).select("ids", F.explode("ids").alias("a")).select("a", F.explode(F.filter("ids", lambda b: b > F.col("a"))).alias("b"), F.lit(1.0).alias("similarity"))
        found = each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").unionByName(within)
    return found, members
