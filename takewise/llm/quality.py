"""Quality rules with thresholds that follow each language and source.

One Arrow pass counts words, symbols, repeated lines and repeated windows of every whole text. The rates of the texts
that pass the fixed base rules go into quantile sketches per language, source and rate: counts over logarithmic bins
(below 64 exact, then 32 bins for each doubling, so a quantile is off by a 32nd at most). Such sketches are merged by
adding counts; a group with too few documents takes its language's sketch, else that of all. Quartiles give each rate
a fence, and the documents are joined with the fences of their group.

A fence is Q3 + FENCE * max(Q3 - Q1, floor) and below, for the word length, Q1 - FENCE * max(Q3 - Q1, floor).

Defined results: a null text has no words and fails the base rules; a null language or source is a group of its own
name, the empty one; each row is judged by itself, so repeated rows and ids get the same verdict; an empty table gives
an empty one; other columns pass through filter_quality and are not read by judge.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, slices, whole_rows

# Base rules, rates in thousandths (word length in hundredths), and each rate's least spread.
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
RATES = {
    "symbol_rate": ("1000 * __n_symbols div __n_words", 60),
    "dup_line_rate": ("1000 * __n_dup_lines div __n_lines", 150),
    "repeat_rate": ("1000 * __n_repeat_words div __n_words", 100),
    "word_length": ("100 * __word_chars div __n_words", 50),
}
FENCE = 4
#: Documents that a group's own sketch must hold.
MIN_GROUP = 50
#: Groups up to which their fences (under 100 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; bytes.split() parts words at exactly the blanks of the contract."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        end = 0  # of the words counted so far
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [count_text(x) for x in batch.column("text").to_pylist()]
        columns = zip(*found) if found else [[]] * len(COUNTS)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(list(c), pa.int64()) for c in columns)], names + [f"__{c}" for c in COUNTS])


def _counted(df: DataFrame, kept: list[Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The kept columns, __lang and __source, then COUNTS, each with two underscores before its name."""
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "__lang"), (source_col, "__source"))]
    rows = df.select(*kept, *group, F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"__{c}", T.LongType()) for c in COUNTS)])
    return rows.mapInArrow(_count, schema)


_BASE_FAILED = "__n_words < {} or 100 * __n_repeat_words > {} * __n_words".format(MIN_WORDS, MAX_REPEATED)


def _bin(value: Column) -> Column:
    """The least value of the sketch's bin that holds the value."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2), drop).cast("long")
    return F.floor(value / step).cast("long") * step


def _quartiles(sketch: DataFrame, by: list[str], tag: str) -> DataFrame:
    """A row for each group: n, and per rate its q1 and q3, of counts by group, rate and bin."""
    ordered = Window.partitionBy(*by, "rate").orderBy("bin")
    counts = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("up_to", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "rate")))
    at = lambda rate, q: F.min(F.when((F.col("rate") == rate) & (4 * F.col("up_to") >= q * F.col("all")), F.col("bin")))
    return ranked.groupBy(*by).agg(F.max("all").alias(f"{tag}_n"), *(at(r, q).alias(f"{tag}_{r}_{q}") for r in RATES for q in (1, 3)))


def fences(counted: DataFrame) -> DataFrame:
    """(__lang, __source, <rate>_low, <rate>_high) for each language and source among texts that pass the base rules."""
    passed = counted.where(f"not ({_BASE_FAILED})")
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.expr(e).alias("value")) for r, (e, _) in RATES.items())))
    sketch = passed.select("__lang", "__source", rates.alias("x")).groupBy("__lang", "__source", F.col("x.rate").alias("rate"), _bin(F.col("x.value")).alias("bin")).agg(F.count("*").alias("n"))
    sketch = cut(sketch)
    own = _quartiles(sketch, ["__lang", "__source"], "own").join(_quartiles(sketch, ["__lang"], "lang"), "__lang")
    # the quartiles of all texts together are one row of eight numbers
    whole = _quartiles(sketch.withColumn("every", F.lit(1)), ["every"], "all").first()
    names = [f"all_{r}_{q}" for r in RATES for q in (1, 3)]
    joined = own.withColumns({n: F.lit(whole[n] if whole else None).cast("long") for n in names})
    pick = lambda rate, q: F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{rate}_{q}")).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{rate}_{q}")).otherwise(F.col(f"all_{rate}_{q}"))
    columns = []
    for rate, (_, floor) in RATES.items():
        q1, q3 = pick(rate, 1), pick(rate, 3)
        room = FENCE * F.greatest(q3 - q1, F.lit(floor))
        low = q1 - room if rate == "word_length" else F.lit(0).cast("long")
        columns += [low.alias(f"{rate}_low"), (q3 + room).alias(f"{rate}_high")]
    return joined.select("__lang", "__source", *columns)


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with __base_failed and __kept."""
    limits = cut(limits)
    limits = limits.select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), *limits.columns[2:])
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for rate, (e, _) in RATES.items():
        inside = inside & F.expr(e).between(F.col(f"{rate}_low"), F.col(f"{rate}_high"))
    joined = counted.join(limits, (F.col("__lang") == F.col("__l")) & (F.col("__source") == F.col("__s")), "left")
    failed = F.expr(_BASE_FAILED)
    return joined.withColumn("__base_failed", failed).withColumn("__kept", F.when(failed, False).otherwise(F.coalesce(inside, F.lit(False))))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row."""
    counted = cut(_counted(df, [F.col(id_col).alias("__id")], text_col, lang_col, source_col))
    done = _judged(counted, fences(counted))
    return done.select(F.col("__id").alias(id_col), *(F.col(f"__{c}").alias(c) for c in COUNTS[:5]), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """df's rows that are kept, with df's columns. Texts are counted again for this, which spares shuffling them."""
    limits = fences(cut(_counted(df, [], text_col, lang_col, source_col)))
    counted = _counted(df, [whole_rows(df)], text_col, lang_col, source_col)
    return _judged(counted, limits).where("__kept").select("row.*")
