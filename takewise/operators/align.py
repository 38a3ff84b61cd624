"""Alignment of a pair's frames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ALIGN_BAND, ALIGN_HOP, MIN_COVERAGE


#: Diagonals whose distances are found at once, and cells of a band of which the way back is held in whole (a byte each).
TILE = 32
HELD_CELLS = 16 << 20
#: Parts of the band's width: cells are joined beyond the band by one part in twice as many.
FINE = 16


def band_cells(ref: DataFrame, prac: DataFrame, sizes: DataFrame, band: float) -> DataFrame:
    """(pair_id, i, j, x, y, n_ref, n_prac): the band's cells and few others. Relative places are cut into parts, FINE to the
    band's width; a practice frame goes along with each part that its band reaches, and meets the reference frames there by
    an equality join. The joins are by shuffle whatever Spark takes the sides' sizes for: it does not see that a frame goes
    with many parts, and would send them through the driver."""
    part = lambda x: F.floor(x * FINE).cast("int")
    placed = lambda side, n: side.join(sizes.hint("merge"), "pair_id").withColumn("at", F.col("frame") / F.col(n) / band)
    r = placed(ref, "n_ref").select("pair_id", F.col("frame").alias("i"), F.col("features").alias("x"), "n_ref", "n_prac", part(F.col("at")).alias("part"))
    reached = F.sequence(F.greatest(F.lit(0), part(F.col("at") - 1 - 1e-9)), part(F.col("at") + 1 + 1e-9))
    p = placed(prac, "n_prac").select("pair_id", F.col("frame").alias("j"), F.col("features").alias("y"), F.explode(reached).alias("part"))
    return r.join(p.hint("merge"), ["pair_id", "part"]).drop("part")


def band_distance(ref: DataFrame, prac: DataFrame, sizes: DataFrame, band: float = ALIGN_BAND) -> DataFrame:
    """(pair_id, i, j, distance): Euclidean distance of frames whose relative places differ by band at most. ref and prac
    have pair_id, frame and features ARRAY<DOUBLE>; sizes has pair_id, n_ref and n_prac."""
    near = F.abs(F.col("i") / F.col("n_ref") - F.col("j") / F.col("n_prac")) <= band
    squares = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    return band_cells(ref, prac, sizes, band).where(near).select("pair_id", "i", "j", F.sqrt(squares).alias("distance"))


class Band:
    """The cells of a pair's band by anti-diagonals: s has the cells (i, s - i) for i from low[s] to high[s]."""

    def __init__(self, x: np.ndarray, y: np.ndarray, band: float):
        (n, m), tile = (len(x), len(y)), min(TILE, len(x) + len(y) - 1)
        s = np.arange(n + m - 1, dtype=np.float64)
        room = band * n * m * (1 + 1e-12) + 1e-9
        self.low = np.maximum(np.maximum(0, s - m + 1), np.ceil((s * n - room) / (n + m))).astype(np.int64)
        self.high = np.minimum(np.minimum(n - 1, s), np.floor((s * n + room) / (n + m))).astype(np.int64)
        self.x, self.edge = np.ascontiguousarray(x.T), n + tile
        self.y = np.pad(y.T[:, ::-1], ((0, 0), (self.edge, self.edge)))  # back to front, so that a diagonal is a slice

    def cells(self) -> int:
        return int(np.maximum(self.high - self.low + 1, 0).sum())

    def distances(self, first: int, last: int) -> tuple[int, np.ndarray]:
        """(i of the first column, a row for each diagonal from first to before last), infinite outside the band."""
        low, high = self.low[first:last], self.high[first:last]
        begin, end = int(low.min()), int(high.max()) + 1
        if end <= begin:
            return begin, np.zeros((last - first, 0))
        i = np.arange(begin, end)
        squares, gap = np.zeros((last - first, len(i))), np.empty((last - first, len(i)))
        at = self.edge + self.y.shape[1] - 2 * self.edge - last + begin  # where the last diagonal's slice begins
        for a, b in zip(self.x, self.y):
            other = np.lib.stride_tricks.sliding_window_view(b[at : at + last - first + len(i) - 1], len(i))[::-1]
            np.subtract(a[begin:end], other, out=gap)
            np.multiply(gap, gap, out=gap)
            squares += gap
        np.sqrt(squares, out=squares)
        squares[(i < low[:, None]) | (i > high[:, None])] = np.inf
        return begin, squares


def banded_path(x: np.ndarray, y: np.ndarray, band: float, tie_break: str, held: int = HELD_CELLS) -> list[tuple[int, int]]:
    """Least-cost monotone path through frames (rows) within the band. All cells of an anti-diagonal depend on the two
    before it alone, so costs are kept of those only; of the way back a byte a cell. A band of more than held cells is
    walked in blocks of about sqrt(n + m) diagonals: the costs at each block's start are kept, and the way back is found
    block by block from the last, each block being walked again. Memory is then the band's width times sqrt(n + m). Of
    equal costs `diagonal` takes the diagonal, then up, then left; `as_written` up, then left, then the diagonal."""
    n, m = len(x), len(y)
    cells = Band(x, y, band)
    steps = ((-1, -1), (-1, 0), (0, -1)) if tie_break == "diagonal" else ((-1, 0), (0, -1), (-1, -1))
    ends = n + m - 1
    size = ends if cells.cells() <= held else min(ends, max(TILE, math.isqrt(ends) * 4))

    def walk(first: int, one: np.ndarray, two: np.ndarray, come: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Costs of a block's last two diagonals from those before it (frame i at i + 1); come gets (first i, where the
        cells came from) of each of its diagonals."""
        stop = min(first + size, ends)
        for at in range(first, stop, TILE):
            begin, rows = cells.distances(at, min(at + TILE, stop))
            here, after = slice(begin + 1, begin + 1 + rows.shape[1]), slice(begin, begin + rows.shape[1])
            for s, row in enumerate(rows, at):
                now = np.full(n + 1, np.inf)
                diagonal, up, left = two[after], one[after], one[here]
                a, b, c = (diagonal, up, left) if tie_break == "diagonal" else (up, left, diagonal)
                rest = np.minimum(b, c)
                if come is not None:
                    from_ = (c < b).view(np.int8) + np.int8(1)
                    from_[a <= rest] = 0
                    come.append((begin, from_))
                np.add(np.minimum(a, rest) if s else 0.0, row, out=now[here])
                one, two = now, one
        return one, two

    def packed(costs: np.ndarray) -> tuple[int, np.ndarray]:
        known = np.flatnonzero(np.isfinite(costs))
        return (int(known[0]), costs[known[0] : known[-1] + 1].copy()) if len(known) else (0, costs[:0])

    def unpacked(at: int, costs: np.ndarray) -> np.ndarray:
        full = np.full(n + 1, np.inf)
        full[at : at + len(costs)] = costs
        return full

    one = two = np.full(n + 1, np.inf)
    starts, come = [], [] if size == ends else None
    for first in range(0, ends, size):
        starts.append((packed(one), packed(two)))
        one, two = walk(first, one, two, come)
    if not np.isfinite(one[n]):
        return []
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    for first in reversed(range(0, ends, size)):
        costs = starts.pop()
        if size < ends and i + j >= first:
            walk(first, *(unpacked(*c) for c in costs), come := [])
        while i + j >= max(first, 1):
            begin, from_ = come[i + j - first]
            di, dj = steps[from_[i - begin]]
            i, j = i + di, j + dj
            path.append((i, j))
    return path[::-1]


def path_cost(path: DataFrame, ref: DataFrame, prac: DataFrame) -> DataFrame:
    """(pair_id, n_steps, cost): the sum of the distances along each path."""
    x = ref.select("pair_id", F.col("frame").alias("reference_frame"), F.col("features").alias("x"))
    y = prac.select("pair_id", F.col("frame").alias("practice_frame"), F.col("features").alias("y"))
    squares = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    joined = path.join(x, ["pair_id", "reference_frame"]).join(y, ["pair_id", "practice_frame"])
    return joined.groupBy("pair_id").agg(F.count("*").alias("n_steps"), F.sum(F.sqrt(squares)).alias("cost"))


def warp_path(ref: DataFrame, prac: DataFrame, band: float = ALIGN_BAND, tie_break: str = "diagonal") -> DataFrame:
    """(pair_id, step, reference_frame, practice_frame). ref and prac have pair_id, frame and features ARRAY<DOUBLE>;
    a group is one pair; its frames are held, and of its band a few blocks of diagonals. A pair whose band holds no path
    has no rows."""

    def align(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["pair_id", "step", "reference_frame", "practice_frame"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        x, y = (t.sort_by("frame").column("features").combine_chunks() for t in (left, right))
        x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) for v in (x, y))
        path = np.array(banded_path(x, y, band, tie_break), dtype=np.int64).reshape(-1, 2)
        return pa.table([pa.array(np.full(len(path), left.column("pair_id")[0].as_py())), pa.array(np.arange(len(path))), pa.array(path[:, 0]), pa.array(path[:, 1])], names)

    return ref.groupBy("pair_id").cogroup(prac.groupBy("pair_id")).applyInArrow(align, "pair_id long, step long, reference_frame long, practice_frame long")


def path_checks(path: DataFrame, sizes: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """(pair_id, monotone, coverage, error_code)"""
    back = F.col("reference_frame") < F.lag("reference_frame").over(W.partitionBy("pair_id").orderBy("step"))
    seen = path.withColumn("back", back).groupBy("pair_id").agg((~F.coalesce(F.bool_or("back"), F.lit(False))).alias("monotone"), F.countDistinct("reference_frame").alias("n"))
    all_ = sizes.select("pair_id", "n_ref").join(seen, "pair_id", "left")
    coverage = F.coalesce(F.col("n"), F.lit(0)) / F.col("n_ref")
    ok = F.coalesce("monotone", F.lit(True))
    code = F.when(~ok | (coverage < least), "ALIGNMENT_UNRECOVERABLE")
    return all_.select("pair_id", ok.alias("monotone"), coverage.alias("coverage"), code.alias("error_code"))


def path_metrics(path: DataFrame, sec_per_frame: float) -> DataFrame:
    """(pair_id, mean_abs_warp_sec, tempo_ratio): the ratio is null where either side does not move."""
    ends = lambda f, c: f(c, "step")
    m = path.groupBy("pair_id").agg(
        F.avg(F.abs(F.col("practice_frame") - F.col("reference_frame")) * sec_per_frame).alias("mean_abs_warp_sec"),
        (ends(F.max_by, "practice_frame") - ends(F.min_by, "practice_frame")).alias("p"), (ends(F.max_by, "reference_frame") - ends(F.min_by, "reference_frame")).alias("r"),
    )
    return m.select("pair_id", "mean_abs_warp_sec", (F.nullif("p", F.lit(0)) / F.nullif("r", F.lit(0))).alias("tempo_ratio"))


def path_summary(path: DataFrame) -> DataFrame:
    w = W.partitionBy("pair_id").orderBy("step")
    falls = lambda c: F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    p = path.withColumn("r_falls", falls("reference_frame")).withColumn("p_falls", falls("practice_frame"))
    return p.groupBy("pair_id").agg(
        F.count("*").alias("n_rows"), F.avg((F.col("reference_frame") != F.col("practice_frame")).cast("double")).alias("non_identity_ratio"),
        (~F.bool_or("r_falls")).alias("reference_monotone"), (~F.bool_or("p_falls")).alias("practice_monotone"),
        F.max_by("reference_frame", "step").alias("end_reference"), F.max_by("practice_frame", "step").alias("end_practice"),
    )


def warp_reindex(path: DataFrame, frames: DataFrame, values: list[str]) -> DataFrame:
    """(pair_id, frame, values) of practice frames on the reference axis: the first practice frame of each reference
    frame's steps, held within the take."""
    first = path.groupBy("pair_id", F.col("reference_frame").alias("frame")).agg(F.min("practice_frame").alias("p"))
    last = frames.groupBy("pair_id").agg(F.max("frame").alias("last"))
    at = first.join(last, "pair_id").select("pair_id", "frame", F.greatest(F.lit(0), F.least("p", "last")).alias("p"))
    return at.join(frames.select("pair_id", F.col("frame").alias("p"), *values), ["pair_id", "p"]).select("pair_id", "frame", *values)


def warped_samples(path: DataFrame, practice: DataFrame, sizes: DataFrame, chunk: int, hop: int = ALIGN_HOP) -> DataFrame:
    """(pair_id, frame, pcm, error_code): practice samples on the reference axis, a row for each hop samples of the
    reference, the last one shorter: the sample at which the first practice frame of that reference frame starts, held
    throughout (frames after the path's last take its last). practice has pair_id, chunk_no and pcm, chunks of chunk
    samples; sizes pair_id, n_ref and n_prac in samples. A pair without path or practice samples, or whose path goes
    beyond the practice's last frame, has one row with CORE_BUILD_FAILED."""
    first = path.groupBy("pair_id", F.col("reference_frame").alias("known")).agg(F.min("practice_frame").alias("p"))
    ends = path.groupBy("pair_id").agg(F.max("reference_frame").alias("last"), F.max("practice_frame").alias("most"))
    all_ = sizes.where("n_ref > 0").join(ends, "pair_id", "left")
    bad = F.col("last").isNull() | (F.col("n_prac") <= 0) | (F.col("most") > F.floor((F.col("n_prac") - 1) / hop))
    failed = all_.where(bad).select("pair_id", F.lit("CORE_BUILD_FAILED").alias("error_code"))
    rows = all_.where(~bad).select("pair_id", "n_ref", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_ref") - 1) / hop))).alias("frame"))
    rows = rows.withColumn("known", F.least("frame", "last")).join(first, ["pair_id", "known"])
    at = F.col("p") * hop
    rows = rows.select("pair_id", "frame", "n_ref", F.floor(at / chunk).alias("chunk_no"), (at % chunk).cast("int").alias("at"))
    held = F.least(F.lit(hop), F.col("n_ref") - F.col("frame") * hop).cast("int")
    found = rows.join(practice.select("pair_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "pcm"), ["pair_id", "chunk_no"])
    return found.select("pair_id", "frame", F.array_repeat(F.get("pcm", F.col("at")), held).alias("pcm"), F.lit(None).cast("string").alias("error_code")).unionByName(failed, allowMissingColumns=True)


def linear_rescale(notes: DataFrame) -> DataFrame:
    """(pair_id, note_no, scaled_sec): practice onsets stretched to the reference's first and last; null where all
    practice onsets are one. Such times hide how a pair differs in timing."""
    of = lambda f, s: f(F.when(F.col("side") == s, F.col("onset_sec")))
    ends = notes.groupBy("pair_id").agg(of(F.min, "reference").alias("r0"), of(F.max, "reference").alias("r1"), of(F.min, "practice").alias("p0"), of(F.max, "practice").alias("p1"))
    scaled = F.col("r0") + (F.col("onset_sec") - F.col("p0")) * (F.col("r1") - F.col("r0")) / F.nullif(F.col("p1") - F.col("p0"), F.lit(0.0))
    return notes.where("side = 'practice'").join(ends, "pair_id").select("pair_id", "note_no", scaled.alias("scaled_sec"))
