"""Ranked lexical search by scanning documents with an automaton of the items' terms.

The items' terms, each between two guards (a space), make an Aho-Corasick automaton; a document, with every byte that
is no part of a term turned into a space, is read once by it, and each match is one occurrence of a whole term. There is
no index of documents: a first scan counts how many documents hold each term, and a second one finds each document's
term frequencies, turns them into impacts and adds these up for the items that have the terms (the automaton's outputs
are term numbers, each with a list of items).

A task keeps the best `limit` documents of each item, so it sends limit rows an item at most, and the final ranking
takes the best of those; both are exact, as ranks are by (score from the highest, id).

Items are taken in blocks of BLOCK_TERMS terms or BLOCK_ITEMS items (one larger item makes a block of its own), of which
each has an automaton and two scans; so what is broadcast is bounded, whatever the number of items.

Defined results: a null text has no terms; documents of a null id come after all others of their score; rows of one item
id, null among them, are one item with the terms of all; rows of one document id are ranked each by itself; an item
without terms, or whose terms no document has, gets no rows; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, cut, slices, text_of

LIMIT = 50
#: Terms and items of a block.
BLOCK_TERMS = 100_000
BLOCK_ITEMS = 2_000
#: Names of the totals among the terms' counts.
DOCUMENTS, TERMS = -1, -2


class Block:
    """Some items: their ids, their terms, and for each term the numbers of the items that have it."""

    def __init__(self, items: list[tuple[object, set[bytes]]]):
        self.ids = [i for i, _ in items]
        holders: dict[bytes, list[int]] = {}
        for number, (_, terms) in enumerate(items):
            for term in terms:
                holders.setdefault(term, []).append(number)
        self.terms = sorted(holders)
        lists = [holders[t] for t in self.terms]
        self.ends = np.cumsum([0, *map(len, lists)])
        self.items = np.array([i for x in lists for i in x], dtype=np.int64)
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def occurrences(self, spaced: bytes) -> np.ndarray:
        """The numbers of the terms that stand in a text of terms and spaces, one for each place."""
        if self._automaton is None:  # made once in a worker
            self._automaton = ahocorasick.Automaton()
            for number, term in enumerate(self.terms):
                self._automaton.add_word(f" {term.decode('latin-1')} ", number)
            self._automaton.make_automaton()
        return np.array([number for _, number in self._automaton.iter(f" {spaced.decode('latin-1')} ")], dtype=np.int64)  # a character a byte

    def scores(self, numbers: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """For each item the sum of the impacts of its terms among those numbered."""
        begin, times = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        at = np.arange(times.sum()) + np.repeat(begin - np.cumsum(times) + times, times)
        total = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(total, self.items[at], np.repeat(impacts, times))
        return total


def spaced(raw: bytes) -> bytes:
    """A UTF-8 text with A-Z lower-cased and a space for each byte that is no part of a term."""
    return raw.translate(WORD_BYTES)


def blocks(items: DataFrame, id_col: str, text_col: str, most_terms: int, most_items: int) -> Iterator[Block]:
    """The items in blocks, of which the driver holds one at a time."""
    rows = items.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).orderBy("id")
    block: list[tuple[object, set[bytes]]] = []
    size = 0
    for r in rows.toLocalIterator():
        terms = set(spaced(r["text"].encode("utf-8", "surrogatepass")).split())
        if not terms:
            continue
        if block and block[-1][0] == r["id"]:
            size -= len(block[-1][1])
            terms |= block.pop()[1]
        elif len(block) == most_items or block and size + len(terms) > most_terms:
            yield Block(block)
            block, size = [], 0
        block.append((r["id"], terms))
        size += len(terms)
    if block:
        yield Block(block)


def term_counts(docs: DataFrame, block) -> tuple[np.ndarray, int, int]:
    """(documents that hold each term of the broadcast block, documents with a term, all their terms) of docs' text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents, terms = np.zeros(len(block.value.terms), dtype=np.int64), 0, 0
        for batch in slices(batches):
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                text = spaced(raw)
                n = len(text.split())
                if n:
                    documents, terms = documents + 1, terms + n
                    found[np.unique(block.value.occurrences(text))] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), DOCUMENTS, TERMS], pa.int64()), pa.array([*found[at].tolist(), documents, terms], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    by_term = {r["term"]: r["n"] for r in rows}
    found = np.array([by_term.get(i, 0) for i in range(len(block.value.terms))], dtype=np.int64)
    return found, by_term.get(DOCUMENTS, 0), by_term.get(TERMS, 0)


def term_weights(holding: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)


def impacts(weights: np.ndarray, tf: np.ndarray, n: int, documents: int, terms: int) -> np.ndarray:
    """What terms add to a document's score, by their frequencies in it and its n terms."""
    m = 100 - 50 + (50 * n * documents) // terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, limit: int):
        self.limit, self.floor = limit, np.ones(items, dtype=np.int64)
        self.columns = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row a document, a column an item."""
        doc, item = np.nonzero(scores >= self.floor)
        if not len(doc):
            return
        new = [item, scores[doc, item], null[doc], ids[doc]]
        item, score, none, doc_id = (np.concatenate(x) for x in zip(self.columns, new))
        order = np.lexsort((doc_id, none, -score, item))
        begin = np.flatnonzero(np.diff(item[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
        full = order[rank == self.limit - 1]
        self.floor[item[full]] = score[full]
        self.columns = [x[order[rank < self.limit]] for x in (item, score, none, doc_id)]


def search_block(docs: DataFrame, items: DataFrame, block: Block, item_id: str, limit: int) -> DataFrame:
    """(item id, id, score) of each item's best documents of each task. docs has id and text."""
    context = docs.sparkSession.sparkContext
    held = context.broadcast(block)  # BLOCK_TERMS terms, BLOCK_ITEMS items
    holding, documents, terms = term_counts(docs, held)
    weights = context.broadcast(term_weights(holding, documents))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        best = Best(len(known.ids), limit)
        for batch in slices(batches, 64):
            scores = np.zeros((batch.num_rows, len(known.ids)), dtype=np.int64)
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                text = spaced(raw)
                numbers, tf = np.unique(known.occurrences(text), return_counts=True)
                if len(numbers):
                    scores[i] = known.scores(numbers, impacts(weights.value[numbers], tf, len(text.split()), documents, terms))
            ids = batch.column("id")
            best.add(scores, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy())
        item, score, none, doc_id = best.columns
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=none.astype(bool)), pa.array(score)], ["item", "id", "score"])

    found = docs.mapInArrow(run, schema)
    names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField(item_id, items.schema[item_id].dataType)]))
    return found.join(F.broadcast(names), "item").select(item_id, "id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = LIMIT, most_terms: int = BLOCK_TERMS, most_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item id, rank, document id, score): each item's best documents, at most limit."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(doc_text).alias("text"))
    found = None
    for block in blocks(items, item_id, item_text, most_terms, most_items):
        new = cut(search_block(rows, items, block, item_id, limit))
        found = new if found is None else found.unionByName(new)
    if found is None:
        found = items.select(item_id, F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy(item_id).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(item_id, "rank", F.col("id").alias(doc_id), "score")
