"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is parted before each run of blanks and around line ends: no piece holds a blank after another character, or a
line end (both are checked when the vocabulary is loaded), so no merge crosses such a place and the parts are encoded
by themselves. A part's symbols are its characters; an agenda of adjacent pairs, ordered by the score of the piece
that they form and then by place, gives the next merge until no pair forms a piece; what is then no piece becomes its
UTF-8 bytes' pieces. New parts of an Arrow batch run their agendas side by side in arrays, one merge a part and step;
long parts use a heap. Each new part is checked against the sentencepiece library in the same batch, and so is the
first whole text of a batch; where they differ, which the tests have not seen, the library's ids are taken and a
warning is given.

Decoding joins the pieces' characters, bytes as UTF-8, and drops the blank that encoding puts first.

Defined results: a null text counts as empty and has the begin and end ids alone; rows are treated one by one, so
repeated rows and null ids are like any other; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .pieces import SPACE, Vocabulary, default_model, vocabulary

PARTS = re.compile(" +[^ \n]*|\n|[^ \n]+")
#: Characters of a part up to which agendas run side by side.
SHORT = 64
#: Parts that a worker remembers; beyond it, it starts anew. This bounds memory and changes no result.
REMEMBERED = 300_000
#: Characters of text that are parted at once.
BLOCK = 1_000_000


def agenda(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """The merges of one part, by a heap of (rank, place) with a linked list of symbols."""
    n, pairs = len(symbols), vocab.pairs
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = int(vocab.by_rank[rank]), None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (p := (symbols[left], symbols[right])) in pairs:
                heapq.heappush(heap, (pairs[p], left, *p))
    return [s for s in symbols if s is not None]


def agendas(parts: list[str], vocab: Vocabulary) -> list[list[int]]:
    """agenda() of many short parts; also gives, for symbols of no piece, the character's number less 2^32."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    symbol = vocab.symbol_of[points]
    symbol = np.where(symbol < 0, points - (1 << 32), symbol)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out: list[list[int]] = [[]] * len(parts)
    none = len(vocab.pieces)

    def ranks(at: np.ndarray) -> np.ndarray:
        """Of the pairs that start at these places."""
        found = vocab.merges.get(symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)])
        alone = (at + 1 >= len(symbol)) | (owner[at] != owner[np.minimum(at + 1, len(symbol) - 1)])
        return np.where(alone | (found < 0), none, found)

    rank = ranks(np.arange(len(symbol)))
    while len(symbol):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.append(starts, len(symbol)))
        # the best pair of each part: rank first, then place
        best = np.minimum.reduceat(rank * len(symbol) + np.arange(len(symbol)), starts)
        best_rank, place = np.divmod(best, len(symbol))
        done = best_rank == none
        ended = symbol[np.repeat(done, sizes)].tolist()
        upto = np.cumsum(sizes[done]).tolist()
        for k, lo, hi in zip(owner[starts[done]].tolist(), [0, *upto], upto):
            out[k] = ended[lo:hi]
        place, merged = place[~done], vocab.by_rank[best_rank[~done]]
        symbol[place] = merged
        keep = np.repeat(~done, sizes)
        keep[place + 1] = False
        moved = np.cumsum(keep) - 1
        symbol, owner, rank, place = symbol[keep], owner[keep], rank[keep], moved[place]
        if len(place):
            for changed in (place, np.maximum(place - 1, 0)):
                rank[changed] = ranks(changed)
    return out


class Codec:
    """Encodes and decodes texts; remembers parts."""

    def __init__(self, path: str):
        self.vocab = v = vocabulary(path)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in v.ids):
            raise ValueError("a piece of this vocabulary goes across the places where texts are parted")
        self.parts: dict[str, tuple[bytes, bytes]] = {}

    def _ids(self, symbols) -> list[int]:
        v, n = self.vocab, len(self.vocab.pieces)
        plain = lambda s: [s] if 0 <= s < n else [v.byte_ids[b] for b in self._char(s).encode("utf-8", "surrogatepass")]
        return list(chain.from_iterable(map(plain, symbols)))

    def _char(self, symbol: int) -> str:
        if symbol < 0:
            return chr(symbol + (1 << 32))
        return chr(int(np.flatnonzero(self.vocab.symbol_of == symbol)[0]))

    def learn(self, parts: list[str]) -> None:
        """Encodes new parts, and checks them against the library."""
        v = self.vocab
        marked = [p.replace(" ", SPACE) for p in parts]
        short = [p for p in marked if len(p) <= SHORT]
        found = dict(zip(short, agendas(short, v))) if short else {}
        for p in marked:
            if len(p) > SHORT:
                symbols = [int(v.symbol_of[ord(c)]) for c in p]
                found[p] = agenda([s if s >= 0 else ord(c) - (1 << 32) for s, c in zip(symbols, p)], v)
        said = v.model.encode([f"\n{p}" for p in parts], num_threads=1)  # two ids for the first blank and the line end
        for part, mark, theirs in zip(parts, marked, said):
            ids, theirs = found[mark], theirs[2:]
            if ids != theirs and (ids := self._ids(ids)) != theirs:
                raise ValueError(f"the agenda and the library differ on a part of {len(part)} characters")
            self.parts[part] = (array("I", ids).tobytes(), self.plain(ids))

    def plain(self, ids: list[int]) -> bytes:
        return b"".join([self.vocab.bytes_of[i] for i in ids])

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """Of each text, its parts' ids (unsigned 32-bit little-endian) and their plain bytes."""
        cut = [PARTS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        new = list(set().union(*cut).difference(self.parts))
        if new:
            self.learn(new)
        known = self.parts
        return [[known[p] for p in c] for c in cut]

    def ids(self, parts: list[tuple[bytes, bytes]]) -> bytes:
        return b"".join([array("I", [self.vocab.bos]).tobytes(), *[p[0] for p in parts], array("I", [self.vocab.eos]).tobytes()])

    def check(self, text: str, ids: bytes, plain: bytes) -> None:
        """A whole text against the library."""
        theirs = self.vocab.model.encode(text, add_bos=True, add_eos=True)
        if np.array(theirs, dtype="<u4").tobytes() != ids or self.vocab.model.decode(theirs).encode() != plain:
            raise ValueError("a whole text's ids or decoding differ from the library's")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of rows with about BLOCK characters."""
    for batch in slices(batches):
        texts, at, size = batch.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK or i == len(texts) - 1:
                yield batch.column("id").slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def _decoded(parts: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join([p[1] for p in parts])[1:]


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids): token_ids has unsigned 32-bit little-endian ids, the begin and end ids included."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for ids, texts in _blocks(batches):
            found = [c.ids(p) for p in c.encode(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["id", "n_tokens", "token_ids"])
        c.parts.clear()

    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, token_ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of rows as encode() gives them; null ids give a null text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.plain(np.frombuffer(x, dtype="<u4").tolist())[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded, in one pass, with digests of both."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for ids, texts in _blocks(batches):
            found = [(c.ids(p), _decoded(p)) for p in c.encode(texts)]
            c.check(texts[0], *found[0])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([digest(x) for x, _ in found]), pa.array([digest(x) for _, x in found])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.parts.clear()

    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
