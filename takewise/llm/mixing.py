"""Mixing to target weights with soft memberships.

A classifier trained on the labelled table gives every document a posterior over the domains: naive Bayes over the
distinct words of a text that tell the domains apart, and a few of its rates; shares are smoothed towards the whole
sample's, so rare words say little. With n tokens and posterior p for a document, its expected domain tokens are n * p. Rates x
between 0 and max_rate are fitted so that the expected totals, the sum of x * n * p over all documents, match
target weights times a budget of tokens: least squares on the totals, with the domains' Gram matrix as the metric,
by projected gradient over the documents' rates. A step moves each rate along the misfit's gradient, p times one vector
for all documents, and clips it to the bounds; in the Gram metric a step of length 1 never overshoots. Steps are
accelerated (each starts beyond the last one, in its direction, afresh where that turns back), and one is one distributed
aggregation of a few sums; nothing but those goes through the driver. A rate is a function of p and the steps so far, so
tasks replay them and no rates are stored. The fit goes on until a step moves fewer than TOLERANCE of the goals' tokens.

A document is then kept floor(x + u) times, where u is a hash of its id in [0, 1): its expected number of copies is x.

Domains are `toxic` (labelled toxic), `low` (labelled quality 0) and `clean`. Unless given, the
budget is such that the domain of the largest target weight keeps its tokens; totals that the bounds on rates put out
of reach are met as nearly as they can be.

Defined results: a null text has no tokens and the priors as its posterior; a domain that no labelled text of the
table has gets no posterior; without labels the posteriors are the
target weights; a null id has the hash of the empty text; of several labels of an id the highest toxic and the lowest
quality count; an empty table gives an empty one; other columns pass through mix().
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, cut, slices, whole_rows

log = logging.getLogger(__name__)

#: Target weights of the domains.
TARGETS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}
#: Labelled texts on which the classifier is fitted, at most, and words that it takes, the most frequent first.
SAMPLE = 6000
WORDS = 20_000
#: Weight of the whole sample's share in a domain's, in texts, and the least evidence of a word that is used.
SMOOTHING = 10.0
TELLING = 0.7
#: Tokens that the fit's last step moves, as a share of the goals' sum.
TOLERANCE = 1e-5
#: Share of the Gram matrix's largest eigenvalue under which a direction counts as none.
FLAT = 1e-7
#: Rows of a task that replays the steps.
ROWS = 200_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()


def rates(raw: bytes, words: list[bytes]) -> list[bytes]:
    """A text's rates as words that no text holds."""
    n = max(1, len(words))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    upper = sum(map(bytes.isupper, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grade = lambda k, v: b" %s%d" % (k, min(9, int(10 * v)))
    return [grade(b"s", symbols / n), grade(b"u", upper / n), grade(b"d", 1 - len(set(lines)) / max(1, len(lines))), grade(b"t", 1 - len(set(words)) / n), b" n%d" % int(math.log2(n + 1))]


class Classifier:
    """Naive Bayes with soft posteriors."""

    def __init__(self, domains: Sequence[str], priors: np.ndarray, vocabulary: dict[bytes, int], weights: np.ndarray):
        """weights: words by domains, the logarithm of how many times more often than in all a word is there."""
        self.domains, self.priors, self.vocabulary, self.weights = domains, priors, vocabulary, weights

    def posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        """(tokens, posterior)"""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(LOWER_AZ).split()
        known = self.vocabulary
        at = [known[w] for w in {*words, *rates(raw, raw.split())} if w in known] if words else []
        total = np.where(self.priors > 0, np.log(np.maximum(self.priors, 1e-300)) + self.weights[at].sum(axis=0), -np.inf)
        p = np.exp(total - total.max())
        return len(words), p / p.sum()


def fit_classifier(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE) -> Classifier:
    """docs has id and text, labels id, quality and toxic."""
    domains = list(targets)
    marks = labels.where("id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    marks = marks.select("id", domain.alias("domain")).where(F.col("domain").isin(domains))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[tuple[str, bytes]] = Counter()
        for batch in slices(batches):
            for domain, text in zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.translate(LOWER_AZ).split()
                times.update((domain, w) for w in {*words, *rates(raw, raw.split())})
                times[domain, b""] += 1
        rows = list(times)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array(list(times.values()), pa.int64())], ["domain", "word", "n"])

    rows = docs.join(F.broadcast(chosen), "id").select("domain", "text").mapInArrow(counted, "domain string, word binary, n long")
    wide = rows.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(d) for d in domains))
    table = wide.orderBy(F.desc(sum(F.col(d) for d in domains)), "word").limit(WORDS).collect()
    counts = {bytes(r["word"]): np.array([r[d] for d in domains], dtype=float) for r in table}
    texts = counts.pop(b"", np.zeros(len(domains)))
    if not texts.sum():
        return Classifier(domains, np.array([targets[d] for d in domains]), {}, np.zeros((0, len(domains))))
    shares_of = {w: c.sum() / texts.sum() for w, c in counts.items()}
    weights = {w: np.log((c + SMOOTHING * shares_of[w]) / (texts + SMOOTHING) / shares_of[w]) for w, c in counts.items()}
    weights = {w: v for w, v in weights.items() if np.abs(v).max() >= TELLING}
    return Classifier(domains, texts / texts.sum(), {w: i for i, w in enumerate(weights)}, np.array(list(weights.values())).reshape(-1, len(domains)))


def posteriors(df: DataFrame, model: Classifier, kept: list[Column], text_col: str = "text", steps: Sequence | None = None, max_rate: float = 1.0) -> DataFrame:
    """The kept columns, then __n (tokens) and __p (posterior, an array in the order of the domains), or __rate in their
    place, given the steps of a fit."""
    held = df.sparkSession.sparkContext.broadcast(model)  # WORDS rows at most
    rows = df.select(*kept, F.col(text_col).cast("string").alias("__text"))
    added_fields = [T.StructField("__n", T.LongType()), T.StructField("__p", T.ArrayType(T.DoubleType()))] if steps is None else [T.StructField("__rate", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields[:-1], *added_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.posterior(x) for x in batch.column("__text").to_pylist()]
            if steps is None:
                added = [pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))]
            else:
                p = np.array([p for _, p in found]).reshape(len(found), -1)
                added = [pa.array(replay(p, steps, max_rate)[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], schema.names)

    return rows.mapInArrow(run, schema)


def with_rates(narrow: DataFrame, steps: Sequence, max_rate: float) -> DataFrame:
    """narrow with each row's __rate."""
    schema = T.StructType([*narrow.schema.fields, T.StructField("__rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(_posterior_matrix(batch), steps, max_rate)[0])], schema.names)

    return narrow.mapInArrow(run, schema)


def replay(p: np.ndarray, steps: Sequence[tuple[Sequence[float], float]], max_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates of rows with posteriors p after steps (vector, momentum), and where the next step starts."""
    x = start = np.full(len(p), min(1.0, max_rate))
    for vector, momentum in steps:
        moved = np.clip(start + p @ np.asarray(vector), 0.0, max_rate)
        start = np.clip(moved + momentum * (moved - x), 0.0, max_rate)
        x = moved
    return x, start


def _posterior_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__p").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _step(narrow: DataFrame, steps: list, vector: np.ndarray, momentum: float, max_rate: float) -> np.ndarray:
    """Sums over all rows for a step from where the steps so far lead: tokens moved, the turn (positive where momentum
    leads back), the domains' totals at the new rates, and those where the next step starts with the momentum."""
    k = len(vector)
    names = [f"s{i}" for i in range(2 + 2 * k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * k)
        for batch in batches:
            if batch.num_rows:
                n, p = batch.column("__n").to_numpy().astype(float), _posterior_matrix(batch)
                x, start = replay(p, steps, max_rate)
                moved = np.clip(start + p @ vector, 0.0, max_rate)
                ahead = np.clip(moved + momentum * (moved - x), 0.0, max_rate)
                total += np.concatenate(([n @ np.abs(moved - start), n @ ((start - moved) * (moved - x))], (n * moved) @ p, (n * ahead) @ p))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    got = narrow.select("__n", "__p").mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
    return np.array([got[n] or 0.0 for n in names])


def fit_rates(narrow: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, max_rate: float = 1.0) -> tuple[list[tuple[list[float], float]], dict]:
    """(steps for replay(), report with each domain's goal and fitted total). narrow has __n and __p."""
    k = range(len(targets))
    p = lambda i: F.element_at("__p", i + 1)
    sums = narrow.agg(F.count("*").alias("rows"), *(F.sum(F.col("__n") * p(i)).alias(f"t{i}") for i in k), *(F.sum(F.col("__n") * p(i) * p(j)).alias(f"g{i}_{j}") for i in k for j in k)).first()
    have = np.array([sums[f"t{i}"] or 0.0 for i in k])
    gram = np.array([[sums[f"g{i}_{j}"] or 0.0 for j in k] for i in k])
    weights = np.array(list(targets.values())) / sum(targets.values())
    if budget is None:
        main = int(weights.argmax())
        budget = float(have[main] / weights[main])
    goal = np.where(have > 0, weights * budget, 0.0)  # a domain that no row has cannot be mixed in
    # directions in which the posteriors do not differ (a domain no text tells apart) change no total
    size, axes = np.linalg.eigh(gram)
    known = size > FLAT * max(size.max(), 1e-300)
    inverse = (axes[:, known] / size[known]) @ axes[:, known].T
    rows = narrow.coalesce(max(1, -(-sums["rows"] // ROWS)))
    steps: list[tuple[list[float], float]] = []
    totals, pace = min(1.0, max_rate) * have, 1.0
    while True:
        vector = inverse @ (goal - totals)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / faster
        got = _step(rows, steps, vector, momentum, max_rate)
        moved, turn, fitted, ahead = got[0], got[1], got[2 : 2 + len(k)], got[2 + len(k) :]
        if turn > 0:
            momentum, faster, ahead = 0.0, 1.0, fitted
        steps.append((vector.tolist(), momentum))
        totals, pace = ahead, faster
        if moved <= TOLERANCE * goal.sum():
            break
    log.info("mixing: %d steps, goals %s, fitted %s", len(steps), goal.tolist(), fitted.tolist())
    return steps, {d: {"goal": float(goal[i]), "before": float(have[i]), "fitted": float(fitted[i])} for i, d in enumerate(targets)}


def _copies(id_col: str) -> Column:
    u = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("__rate") + u + F.lit(1e-9)).cast("int")


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.select(F.col(id_col).cast("string").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


def document_rates(df: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", max_rate: float = 2.0) -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, copies) for each row of df."""
    model = fit_classifier(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")), _labels(labels, id_col), targets)
    narrow = cut(posteriors(df, model, [F.col(id_col)], text_col))
    steps, _ = fit_rates(narrow, targets, max_rate=max_rate)
    return with_rates(narrow, steps, max_rate).select(id_col, F.col("__n").alias("n_tokens"), *(F.element_at("__p", i + 1).alias(f"p_{d}") for i, d in enumerate(targets)), F.col("__rate").alias("rate"), _copies(id_col).alias("copies"))


def mix(df: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", max_rate: float = 1.0) -> DataFrame:
    """df's rows, each as often as its copies say. Posteriors are found again for this, which spares shuffling texts."""
    model = fit_classifier(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")), _labels(labels, id_col), targets)
    steps, _ = fit_rates(cut(posteriors(df, model, [], text_col)), targets, max_rate=max_rate)
    rows = posteriors(df, model, [whole_rows(df)], text_col, steps, max_rate)
    rows = rows.withColumn("__id", F.col("row").getField(id_col)).withColumn("__copies", _copies("__id")).where("__copies > 0")
    if max_rate > 1:
        rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select("row.*")
