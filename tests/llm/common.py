"""Rows that every corpus operator must cope with."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew strong potions near an old stone bridge at dawn and count silver coins under pale moonlight before long trips home".split()
PROSE = " ".join(WORDS * 3)


def prose(seed: int, n: int = 80) -> str:
    """Different words in an order that depends on the seed."""
    out, x = [], seed * 2654435761 + 1
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + "abcdefghij"[(x >> 40) % 10])
    return " ".join(out)


#: Null id, text, language and source; empty and blank texts; repeated rows and ids; characters outside the basic
#: plane; a very long text and a very long word.
ODD = [
    (1, prose(1), "en", "s", 5), (2, prose(1), "en", "s", 5), (2, prose(1), "en", "s", 5), (3, prose(1).upper(), None, None, None),
    (4, None, "en", "s", None), (5, "", "en", None, 0), (6, " \n\t ", None, "s", 4), (None, prose(2), "en", "s", 9), (None, None, None, None, None),
    (7, "日本語 😀 é　x\x00y ▁z", "ja", "s", 9), (8, prose(3, 30_000), "en", "s", 1), (9, "x" * 50_000, "xx", "s", 1), (4, prose(4), "fr", "t", 2),
]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def clashing(spark: SparkSession, df: DataFrame | None = None) -> DataFrame:
    """Columns with the names that operators use for their own, before and after the others."""
    from pyspark.sql import functions as F

    df = odd(spark) if df is None else df
    first = ("row", "edge", "norm", "head", "__text", "__lang", "__source", "__n", "__p", "__key", "__id", "__copies", "__rate", "__kept", "__l", "symbol_rate_low", "first_part")
    df = df.select(*(F.lit(n).alias(n) for n in first), "*")
    for name in ("id", "key", "part", "kept", "n_words", "score", "spans", "digest", "print", "rate", "copies", "labels", "own_id", "kept_id", "email", "domain"):
        df = df.withColumn(name, F.lit(name))
    return df


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
