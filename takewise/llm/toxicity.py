"""Toxicity by a linear-chain conditional random field over the words of a sentence.

Words are runs of letters in lower case; their features are the word and its first four, five and six letters. A
feature is taken into the model if it stands in toxic training texts far more often than in others, before or after
many different words: copies of one text repeat their neighbours, so rare words of a much copied text don't qualify.
A training token is labelled toxic if its text is and it has such a feature. The field has two labels, weights for
the features and for the transitions, and is fitted by gradient steps on the sentences that have a feature.

Scoring runs forward-backward over each sentence with a feature (others have no token that the model knows), which
gives every token's marginal of being toxic. A logistic function of the text's summed marginals, and of their share
of its words, is the text's score; tokens whose marginal is 0.5 or more are its offending spans.

The field is fitted on SAMPLE labelled texts of each class at most, chosen by a hash of their ids, and on SENTENCES
sentences of those; nothing else is bounded.

Defined results: null or wordless texts, and all texts when there is no labelled text of both classes, score the
share of toxic labels (0 without labels); each row is scored by itself; labels without id or mark are not used, and
of several labels of an id the highest counts; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, cut, slices

#: Training texts of each class, and sentences from them, at most.
SAMPLE = 3000
SENTENCES = 8000
#: Different neighbours a feature needs in toxic texts, the neighbours it is given in others beyond those it has (else a
#: rare word qualifies by chance), how many times more often it must stand in toxic ones, and how many
#: features the model takes at most, the most frequent first.
NEIGHBOURS = 6
PRIOR = 1.5
TIMES_MORE = 8.0
FEATURES = 4000
WORD = re.compile(r"[^\W\d_]+")
#: Words of a training sentence; longer ones are split into several.
LONGEST = 64
STEPS = 150
#: Distinct rows that a task holds back to send each once.
HELD = 200_000


def features(word: str) -> list[str]:
    return [f"w={word}", *(f"{k}={word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def sentences(text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of words so far, spans of the words) of each sentence."""
    done = 0
    for m in re.finditer(r"[^.\n!?]+", text):
        spans = [(m.start() + w.start(), m.start() + w.end()) for w in WORD.finditer(m.group())]
        if spans:
            yield done, spans
            done += len(spans)


def _lower(text: str) -> str:
    """Lower case, code point by code point where the usual way would move offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Field:
    """A linear-chain CRF with labels 0 and 1; label 0 has no feature weights."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {n: i for i, n in enumerate(names)}
        self.whole = {n[2:] for n in names if n[0] == "w"}
        self.starts = {k: {n[2:] for n in names if n[0] == str(k)} for k in (4, 5, 6)}
        self.weights = np.zeros(len(names) + 1)  # the last one: of a token without features, always 0
        self.bias = np.array([-4.0])
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def any_known(self, words: set[str]) -> bool:
        """Whether a word has a feature; a shorter word's start is no feature's but by chance, which does no harm."""
        return not self.whole.isdisjoint(words) or any(not s.isdisjoint({w[:k] for w in words}) for k, s in self.starts.items() if s)

    def numbers(self, word: str) -> list[int]:
        return [self.number[f] for f in features(word) if f in self.number]

    def grid(self, found: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers (sentences by places by 4, filled up with the last) and lengths."""
        sizes = np.array([len(s) for s in found])
        out = np.full((len(found), int(sizes.max()), 4), len(self.names), dtype=np.int64)
        for i, s in enumerate(found):
            for t, f in enumerate(s):
                if f:
                    out[i, t, : len(f)] = f
        return out, sizes

    def marginals(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward: P(label 1) of each place, expected moves, and expected first labels, over all sentences."""
        n, longest, _ = grid.shape
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = self.weights[grid].sum(axis=2) + self.bias[0]
        emit = np.exp(emit - emit.max(axis=2, keepdims=True))
        moves, first = np.exp(self.moves), np.exp(self.first)
        ahead, back = np.zeros((n, longest, 2)), np.ones((n, longest, 2))
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        ahead[:, 0] = norm(first * emit[:, 0])
        for t in range(1, longest):
            ahead[:, t] = norm((ahead[:, t - 1] @ moves) * emit[:, t])
        for t in range(longest - 2, -1, -1):
            step = norm((back[:, t + 1] * emit[:, t + 1]) @ moves.T)
            back[:, t] = np.where((t + 1 < sizes)[:, None], step, 1.0)
        both = norm(ahead * back)
        inside = np.arange(1, longest)[None, :] < sizes[:, None]
        pair = ahead[:, :-1, :, None] * moves[None, None] * (emit * back)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        return both[:, :, 1], (pair * inside[:, :, None, None]).sum(axis=(0, 1)), both[:, 0].sum(axis=0)

    def fit(self, found: list[list[list[int]]], labels: list[list[int]], steps: int = STEPS, penalty: float = 0.01) -> None:
        """Adam on the regularised log likelihood."""
        if not found:
            return
        grid, sizes = self.grid(found)
        gold = np.zeros(grid.shape[:2], dtype=np.int64)
        for i, s in enumerate(labels):
            gold[i, : len(s)] = s
        inside = np.arange(grid.shape[1])[None, :] < sizes[:, None]
        seen_moves = np.zeros((2, 2))
        np.add.at(seen_moves, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
        seen_first = np.bincount(gold[:, 0], minlength=2).astype(float)
        params = [self.weights, self.bias, self.moves, self.first]
        memory = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            p1, moves, first = self.marginals(grid, sizes)
            off = np.where(inside, gold - p1, 0.0)
            w = np.bincount(grid.ravel(), weights=np.repeat(off.ravel(), 4), minlength=len(self.weights))
            w[-1] = 0.0
            slopes = [w, np.array([off.sum()]), seen_moves - moves, seen_first - first]
            for p, g, (m, v) in zip(params, slopes, memory):
                g = g - penalty * p
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights[-1] = 0.0

    def toxic_words(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, (start, end, marginal) of each token in a sentence with a feature)."""
        low = _lower(text)
        words = WORD.findall(low)
        if not self.any_known(set(words)):
            return len(words), []
        found, places = [], []
        for _, spans in sentences(low):
            numbers = [self.numbers(low[a:b]) for a, b in spans]
            if any(numbers):
                found.append(numbers)
                places.append(spans)
        out = []
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        at = 0
        while at < len(order):  # sentences of like length together
            group = [i for i in order[at : at + 512] if len(found[i]) <= 2 * len(found[order[at]]) + 16]
            p1, _, _ = self.marginals(*self.grid([found[i] for i in group]))
            out += [(a, b, float(p)) for k, i in enumerate(group) for (a, b), p in zip(places[i], p1[k])]
            at += len(group)
        return len(words), sorted(out)


def evidence(words: int, tokens: list[tuple[int, int, float]]) -> list[float]:
    total = sum(p for _, _, p in tokens)
    return [1.0, np.log1p(total), min(1.0, 20 * total / words) if words else 0.0]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton steps for a regularised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
    return w


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, neighbours), each once or a few times; held in memory up to HELD."""
    seen: set[tuple[str, int, str]] = set()

    def out() -> pa.RecordBatch:
        rows = list(zip(*seen)) if seen else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string())], ["feature", "toxic", "near"])

    for batch in slices(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = WORD.findall(_lower(text or ""))
            for w, before, after in zip(words, ["", *words], [*words[1:], ""]):
                seen.update((f, toxic, f"{before} {after}") for f in features(w))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
    yield out()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, toxic, text) of at most sample labelled texts of each class; docs has id and text, labels id and toxic."""
    marks = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    return docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Field, np.ndarray | None, float]:
    """(field, weights of evidence or None, share of toxic labels)"""
    share = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = cut(training_rows(docs, labels, sample).repartition("id"))  # twice sample texts at most, read four times
    pairs = rows.select("toxic", "text").mapInArrow(_neighbours, "feature string, toxic int, near string")
    counts = pairs.distinct().groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    sizes = rows.groupBy("toxic").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    size = {r["toxic"]: r["n"] for r in sizes.collect()}
    if not size.get(0) or not size.get(1):
        return Field([]), None, share
    chance = (F.col("bad") / F.lit(float(size[1]))) / ((F.col("good") + PRIOR) / F.lit(float(size[0])))
    taken = counts.where((F.col("bad") >= NEIGHBOURS) & (chance >= TIMES_MORE)).orderBy(F.desc("bad"), "feature").limit(FEATURES)
    field = Field([r["feature"] for r in taken.collect()])

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each sentence with a feature: flat feature numbers, -1 after each word."""
        ids, toxics, flat = [], [], []
        for batch in batches:
            for key, toxic, text in zip(batch.column("id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                low = _lower(text or "")
                for _, spans in sentences(low):
                    numbers = [field.numbers(low[a:b]) for a, b in spans]
                    if any(numbers):
                        for at in range(0, len(numbers), LONGEST):
                            ids.append(key)
                            toxics.append(toxic)
                            flat.append([x for f in numbers[at : at + LONGEST] for x in (*f, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(toxics, pa.int32()), pa.array(flat, pa.list_(pa.int32()))], ["id", "toxic", "flat"])

    found, gold = [], []
    for r in rows.mapInArrow(tagged, "id string, toxic int, flat array<int>").orderBy(F.xxhash64("id", "flat")).limit(SENTENCES).collect():
        sentence, word = [], []
        for x in r["flat"]:
            if x < 0:
                sentence.append(word)
                word = []
            else:
                word.append(x)
        found.append(sentence)
        gold.append([int(bool(f) and r["toxic"] == 1) for f in sentence])
    field.fit(found, gold)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [evidence(*field.toxic_words(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([float(x[1]) for x in xs], pa.float64()), pa.array([float(x[2]) for x in xs], pa.float64())], ["toxic", "a", "b"])

    table = np.array([(1.0, r["a"], r["b"], r["toxic"]) for r in rows.select("toxic", "text").mapInArrow(told, "toxic int, a double, b double").collect()])
    return field, _logistic(table[:, :3], table[:, 3]), share


def score(df: DataFrame, model: tuple[Field, np.ndarray | None, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans): spans has start, end (code points, end exclusive) and marginal of each offending word."""
    held = df.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers at most
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, weights, share = held.value
        for batch in slices(batches):
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                words, tokens = field.toxic_words(text or "")
                plain = share if weights is None or not words else 1 / (1 + np.exp(-np.clip(np.dot(weights, evidence(words, tokens)), -30, 30)))
                scores.append(float(plain))
                spans.append([{"start": a, "end": b, "marginal": p} for a, b, p in tokens if p >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["id", "score", "spans"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return done.withColumnRenamed("id", id_col)


def learn_and_score(df: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_words, spans): fitted on labels of ids whose crc class is not the
    held-out one; spans are the offending words' start:end, in code points, comma-joined."""
    used = labels.where(crc_class("doc_id", parts) != held_out).select(F.col("doc_id").cast("string").alias("id"), "toxic")
    model = fit(df.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")), used)
    scored = score(df, model)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(
        "doc_id", (crc_class("doc_id", parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_toxic_words"), listed.alias("spans"),
    )
