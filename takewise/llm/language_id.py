"""Language identification by unigrams over a fixed public vocabulary, with the segmentations summed out.

For each language, pieces of the vocabulary have probabilities: their share in a sample of labelled texts, smoothed
towards their share in all of the sample. A word (with its leading blank) has the sum, over all its segmentations into
pieces, of the product of their probabilities; a forward pass over the word's places finds it, for all languages and
for the new words of an Arrow block at once. A text's score adds its words' logarithms to the languages' priors, and
the posterior of the best language is the confidence. A character that is no piece has one small probability in every
language.

The model is one row of numbers a language and piece; it is fitted on SAMPLE texts a language (in expectation, chosen
by a hash of their ids), while the priors count all labelled texts. Languages are few: their counts and piece counts
go through the driver.

Defined results: null or letterless texts, and any text when nothing could be learned, are `und` with score 0; ties
go to the language first in the alphabet; each row is predicted by itself; a null id is not held out by its class
(that of the empty text, 0); other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, slices
from .pieces import SPACE, PairTable, default_model, vocabulary
from .sentencepiece_codec import codec

#: Labelled texts a language, in expectation, on which the piece probabilities are fitted.
SAMPLE = 1500
#: Weight of the shared piece probabilities in a language's own, in pieces.
SMOOTHING = 100.0
#: Probability of a character that is no piece.
UNKNOWN = 1e-8
#: Words that a worker remembers; beyond it, it starts anew. This bounds memory and changes no result.
REMEMBERED = 300_000
#: Characters of text that are taken at once, and of a word for the side-by-side pass.
BLOCK = 1_000_000
SHORT = 40
LETTER = re.compile(r"[^\W\d_]")
#: Factor for each character that keeps products of probabilities within floats.
_LIFT = 1e4


class Model:
    """Log probabilities of words in each language."""

    def __init__(self, path: str, langs: list[str], counts: np.ndarray, priors: np.ndarray):
        """counts: languages by pieces; priors: labelled texts of each language."""
        v = self.vocab = vocabulary(path)
        self.langs = langs
        shared = counts.sum(axis=0) + 1.0
        own = counts + SMOOTHING * shared / shared.sum()
        self.p = (own / own.sum(axis=1, keepdims=True)).T  # pieces by languages
        self.priors = np.log(priors / priors.sum())
        lengths = np.array([len(x) for x in v.pieces])
        self.lifted = np.vstack([self.p * (_LIFT ** np.minimum(lengths, 60))[:, None], np.full((1, len(langs)), UNKNOWN * _LIFT)])
        self.unknown = len(v.pieces)
        # a trie of the pieces; the symbols are code points
        steps, nodes = {}, 1
        ends = {}
        for piece, i in v.ids.items():
            at = 0
            for c in piece:
                if (at, ord(c)) not in steps:
                    steps[at, ord(c)] = nodes
                    nodes += 1
                at = steps[at, ord(c)]
            ends[at] = i
        self.trie = PairTable(steps)
        self.piece_at = np.full(nodes, -1, dtype=np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.words: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of each place where a piece stands in a word, by end and then word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        room = sizes[owner] - start
        at, node, found = np.arange(len(points)), np.zeros(len(points), dtype=np.int64), []
        for size in range(1, self.vocab.longest + 1):
            fits = room[at] >= size
            at, node = at[fits], node[fits]
            node = self.trie.get(node, points[at + size - 1])
            at, node = at[node >= 0], node[node >= 0]
            piece = self.piece_at[node]
            if size == 1:
                single = np.full(len(points), self.unknown)
                single[at[piece >= 0]] = piece[piece >= 0]
                found.append((np.arange(len(points)), np.full(len(points), 1), single))
            else:
                found.append((at[piece >= 0], np.full(int((piece >= 0).sum()), size), piece[piece >= 0]))
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        word, begin, end = owner[at], start[at], start[at] + size
        order = np.lexsort((word, end))
        return word[order], begin[order], end[order], piece[order]

    def forward(self, words: list[str]) -> np.ndarray:
        """The log probability of each word (with its leading mark) in each language, all segmentations summed."""
        sizes = np.array([len(w) for w in words])
        word, begin, end, piece = self._edges(words)
        longest = int(sizes.max())
        chance = np.zeros((longest + 1, len(words), len(self.langs)))
        scale = np.zeros((len(words), len(self.langs)))
        chance[0] = 1.0
        bounds = np.searchsorted(end, np.arange(1, longest + 2))
        for t in range(1, longest + 1):
            lo, hi = bounds[t - 1], bounds[t]
            w = word[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            chance[t, w[first]] = np.add.reduceat(chance[begin[lo:hi], w] * self.lifted[piece[lo:hi]], first, axis=0)
            if longest > SHORT:  # long words are rescaled as they go, the last longest-piece places together
                top = chance[t].max(axis=1, keepdims=True)
                top[top == 0] = 1.0
                live = t <= sizes
                chance[max(0, t - self.vocab.longest) : t + 1, live] /= top[live]
                scale[live] += np.log(top[live])
        return np.log(chance[sizes, np.arange(len(words))]) + scale - sizes[:, None] * np.log(_LIFT)

    def learn(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        found, at = [], 0
        while at < len(words):
            # words of like length together, so many that the pass's table stays small
            n = max(1, min(len(words) - at, 200_000 // max(len(words[min(at + 5000, len(words) - 1)]), 1)))
            marked = [SPACE + w for w in words[at : at + n]]
            short = [w for w in marked if len(w) <= SHORT]
            if short:
                found.append(self.forward(short))
            found += [self.forward([w]) for w in marked[len(short) :]]
            at += n
        self.words.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, *found])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parted = [t.split() if t and LETTER.search(t) else None for t in texts]
        if len(self.words) > REMEMBERED:
            self.words, self.table = {}, self.table[:0]
        new = list(set().union(*(p for p in parted if p)).difference(self.words))
        if new:
            self.learn(new)
        out = []
        for words in parted:
            if words is None or not self.langs:
                out.append(("und", 0.0))
                continue
            rows = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            total = self.priors + self.table[rows].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, times = codec(path), Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for parts in c.encode([text or ""]):
                    times.update((lang, i) for p in parts for i in np.frombuffer(p[0], dtype="<u4").tolist())
        langs, pieces = zip(*times) if times else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.int32()), pa.array(list(times.values()), pa.int64())], ["lang", "piece", "n"])

    return run


def fit(df: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple:
    """(langs, counts, priors) of labelled rows, for Model."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    if not langs:
        return [], np.zeros((0, len(vocabulary(path).pieces))), np.zeros(0)
    shares = df.sparkSession.createDataFrame([(k, min(1.0, sample / priors[k])) for k in langs], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    counts = chosen.select("lang", "text").mapInArrow(_piece_counts(path), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    out = np.zeros((len(langs), len(vocabulary(path).pieces)))
    out[[langs.index(x) for x in table["lang"]], table["piece"].to_numpy(dtype=np.int64)] = table["n"]
    return langs, out, np.array([priors[k] for k in langs], dtype=float)


#: The last model that this worker made, by the digest of what it was fitted on.
_models: dict[str, Model] = {}


def identify(df: DataFrame, fitted: tuple, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    langs, counts, priors = fitted
    name = hashlib.sha256(repr((path, langs)).encode() + counts.tobytes() + priors.tobytes()).hexdigest()
    model = df.sparkSession.sparkContext.broadcast(fitted)  # languages by pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(path, *model.value)
        m = _models[name]
        for batch in slices(batches):
            texts, at, size = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= BLOCK or i == len(texts) - 1:
                    langs, scores = zip(*m.predict(texts[at : i + 1]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, i + 1 - at), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])
                    at, size = i + 1, 0

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learn_and_identify(df: DataFrame, path: str | None = None, parts: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the rows whose crc class is not the held-out one."""
    path = path or default_model()
    fitted = fit(df.where(crc_class("doc_id", parts) != held_out), path)
    return identify(df, fitted, path).withColumn("held_out", crc_class("doc_id", parts) == held_out).select("doc_id", "held_out", "lang_pred", "score")
