"""License scans by a positional index of rare words.

One pass over the corpus counts in how many documents each word of the templates stands, which gives their inverse
document frequencies. The index has the postings (template, place) of every template word. A second pass looks up, for
each file, the LOOKUPS words of the index with the highest IDF that it has: the posting at place p of a word at position
i says that the template starts at i - p. Starts are intersected: one is looked at if VOTES words or more say it. Then the
template's mandatory phrase is verified at its place, of which one word may differ if it has ALTERABLE or more and the
template's words at their relative places make up WHOLE of its weight (their IDF).

A template also starts wherever its phrase stands in full. These starts come from the rarest word of the phrase, which is
always looked up, intersected with the phrase's other words from the rarest on, each at its relative place; so base
phrases are found at every place where their words stand consecutively, however few words are around them.

Of matches that overlap the one with the largest weight is kept, so a text that shares a sentence with another one does
not get its label; labels of base phrases stay all the same. `proprietary` is a label only where there is no other.
The score is the largest share of a template's weight among the matches that are kept.

The template words are a few hundred, whatever the corpus; their counts are all that goes through the driver.

Defined results: a null text has no words, no labels and score 0; each row is scanned by itself, so repeated rows get
the same answer; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, slices, text_of
from .license_texts import TEMPLATES

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of a file that are looked up, and of these that must agree on a start.
LOOKUPS = 32
VOTES = 3
#: Share of documents that may have a word that is looked up.
RARE = 0.2
#: Words of a phrase of which one may differ, and the least share of the template's weight that must then be there.
ALTERABLE = 4
WHOLE = 0.4
#: The label that stands only by itself.
ALONE = "proprietary"

#: Every byte that parts words as a blank, A-Z in lower case; bytes from 0x80 on are in words.
WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in LOWER_AZ)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


#: Name, words, words of the phrase, and label of each template.
PARTED = [(name, words_of(text), words_of(phrase), label) for name, text, phrase, label in TEMPLATES]


class Template(NamedTuple):
    words: list[bytes]
    at: int
    length: int
    #: Places of the phrase's words, the rarest first.
    rare_first: list[int]
    label: str
    weight: float
    phrase: str


class Index:
    """Postings of the templates' words, with the words' IDF."""

    def __init__(self, idf: dict[bytes, float], common: frozenset[bytes] = frozenset()):
        self.idf = idf
        self.templates: list[Template] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: For a word, the templates whose phrase has it as its rarest word.
        self.leads: dict[bytes, list[int]] = defaultdict(list)
        for n, (_, words, phrase, label) in enumerate(PARTED):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            rare_first = sorted(range(at, at + len(phrase)), key=lambda p: (-idf.get(words[p], 0.0), p))
            self.templates.append(Template(words, at, len(phrase), rare_first, label, sum(idf.get(w, 0.0) for w in words) or 1.0, " ".join(w.decode() for w in phrase)))
            self.leads[words[rare_first[0]]].append(n)
            for p, w in enumerate(words):
                if w not in common:
                    self.postings[w].append((n, p))
        self.known = frozenset(self.postings) | frozenset(self.leads)

    def starts(self, words: list[bytes], at_word: dict[bytes, list[int]], looked_up: list[bytes]) -> Iterator[tuple[int, int, bool]]:
        """(template, start, whether its whole phrase stands there) of all matches."""
        whole: set[tuple[int, int]] = set()
        size = len(words)
        for lead in at_word.keys() & self.leads.keys():
            for n in self.leads[lead]:
                t = self.templates[n]
                begins = [i - t.rare_first[0] for i in at_word[lead]]
                begins = [s for s in begins if s + t.at >= 0 and s + t.at + t.length <= size]
                for p in t.rare_first[1:]:
                    if not begins:
                        break
                    begins = [s for s in begins if words[s + p] == t.words[p]]
                whole.update((n, s) for s in begins)
        yield from ((n, s, True) for n, s in whole)
        votes: Counter[tuple[int, int]] = Counter()
        for word in looked_up:
            for i in at_word[word]:
                votes.update((n, i - p) for n, p in self.postings[word])
        for (n, s), k in votes.items():
            t = self.templates[n]
            if k >= VOTES and t.length >= ALTERABLE and (n, s) not in whole:
                there = sum(0 <= s + p < size and words[s + p] == t.words[p] for p in t.rare_first)
                if there >= t.length - 1 and self.weight(words, n, s) >= WHOLE * t.weight:
                    yield n, s, False

    def weight(self, words: list[bytes], n: int, s: int) -> float:
        """Of a template's words that stand at their relative places from a start."""
        return sum(self.idf.get(w, 0.0) for p, w in enumerate(self.templates[n].words) if 0 <= s + p < len(words) and words[s + p] == w)

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
        words = words_of(text)
        present = self.known.intersection(words)
        at_word: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words if present else ()):
            if w in present:
                at_word[w].append(i)
        looked_up = sorted(present & self.postings.keys(), key=lambda w: (-self.idf.get(w, 0.0), w))[:LOOKUPS]
        places, base, matches = set(), set(), []
        for n, s, whole in self.starts(words, at_word, looked_up):
            t = self.templates[n]
            matches.append((-self.weight(words, n, s), n, s))
            if whole and t.phrase in BASE:
                base.add(BASE[t.phrase])
                places.add((s + t.at, t.phrase))
        kept: list[tuple[int, int]] = []
        labels, score = set(base), 0.0
        for weight, n, s in sorted(matches):
            t = self.templates[n]
            if all(s + len(t.words) <= a or b <= s for a, b in kept):
                kept.append((s, s + len(t.words)))
                labels.add(t.label)
                score = max(score, min(1.0, -weight / t.weight))
        labels = labels - {ALONE} or labels
        ends = (min(places)[0], max(places)[0]) if places else (None, None)
        return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the partition's documents each template word stands; the empty word counts all documents."""
    known = {w for _, words, _, _ in PARTED for w in words}
    times: Counter[bytes] = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            times.update(known.intersection(words_of(text)))
            times[b""] += 1
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in times], pa.string()), pa.array(list(times.values()), pa.int64())], ["word", "n"])


def word_weights(df: DataFrame, text_col: str = "text") -> tuple[dict[bytes, float], frozenset[bytes]]:
    """(the IDF of each template word over all of df, those that more than RARE of the documents have)."""
    counts = df.select(text_of(text_col).alias("text")).mapInArrow(_present, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"].encode(): r["n"] for r in counts.collect()}  # the template words at most
    total = n.pop(b"", 0)
    return {w: math.log(1 + (total + 1) / (n.get(w, 0) + 1)) for _, words, _, _ in PARTED for w in words}, frozenset(w for w, k in n.items() if k > RARE * total)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    weights = word_weights(df, text_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*weights)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in slices(batches):
            found = [index.scan(x) for x in batch.column("text").to_pylist()]
            columns = list(zip(*found)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(scanned, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return done.withColumnRenamed("id", id_col)
