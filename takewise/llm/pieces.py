"""A public merge-type vocabulary: its pieces, and which adjacent symbols merge into which piece."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"


def default_model() -> str:
    """Where this machine has the public model; only a default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PairTable:
    """Open addressing from pairs of non-negative 32-bit numbers to a non-negative number, for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        for (a, b), value in pairs.items():
            key = a << 32 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[at] != -1:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = key, value

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' numbers, -1 where there is none; a negative a or b is in no pair."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        while len(left):
            there = self.keys[at]
            hit = there == key
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (there != -1)
            left, key, at = left[more], key[more], (at[more] + 1) % len(self.keys)
        return out


class Vocabulary:
    """Pieces, scores and merges of a model file. Symbols are piece ids; a character that is in pieces but is none
    itself has a number after them, and one that is in no piece has -1."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        #: By code point.
        self.symbol_of = np.full(0x110000, -1, dtype=np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        #: Place of each piece in the order of scores; pieces with equal scores keep their order.
        by_score = sorted(self.ids.values(), key=lambda i: -sp.get_score(i))
        self.rank = np.full(n, n, dtype=np.int64)
        self.rank[by_score] = np.arange(len(by_score))
        self.by_rank = np.array(by_score, dtype=np.int64)
        self.pairs = {(symbols[p[:k]], symbols[p[k:]]): int(self.rank[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.merges = PairTable(self.pairs)
        self.bytes_of = [b"" if sp.is_control(i) else bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process and path."""
    return Vocabulary(path)
