"""Canonical tables of takes, notes, frames and scores, from the tables at hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import exp2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side():
    return F.when(F.pmod("take_id", F.lit(2)) == 0, "reference").otherwise("practice")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One take a user, one note an event; a pair is two neighbouring takes."""
    hz = F.lit(130.81) * exp2((F.col("value") - 48 * F.floor(F.col("value") / 48)) / F.lit(12.0))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("take_id"), "event_type", "value", hz.alias("f0_hz"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    take = W.partitionBy("take_id")
    return e.select(
        "take_id", F.floor(F.col("take_id") / 2).alias("pair_id"), side().alias("side"),
        F.row_number().over(take.orderBy("us", "event_id")).cast("bigint").alias("note_no"),
        ((F.col("us") - F.min("us").over(take)) / F.lit(3.6e10)).alias("onset_sec"),
        "f0_hz", (F.col("value") / F.lit(500.0)).alias("rms"), "event_id", "event_type", "value",
    )


def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitch_frames_of(notes(spark, sf_dir))


def pitch_frames_of(n: DataFrame) -> DataFrame:
    """A frame a note."""
    voiced = F.col("event_type") != "error"
    return n.select("take_id", "pair_id", "side", (F.col("note_no") - 1).alias("frame"), voiced.cast("int").alias("voiced"), F.when(voiced, F.col("f0_hz")).otherwise(0.0).alias("f0_hz"), (F.pmod("event_id", F.lit(101)) / F.lit(100.0)).alias("confidence"))


def rms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rms_frames_of(notes(spark, sf_dir))


def rms_frames_of(n: DataFrame) -> DataFrame:
    """Eight frames a note, each softer than the one before."""
    n = n.select("take_id", "pair_id", "side", "note_no", "rms", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return n.select("take_id", "pair_id", "side", ((F.col("note_no") - 1) * 8 + F.col("k")).alias("frame"), (F.col("rms") * (8 - F.col("k")) / F.lit(8.0)).alias("rms"))


def rms_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, a row a note: the first one's number and the energies of all eight."""
    levels = F.array(*(F.col("rms") * F.lit(8 - k) / F.lit(8.0) for k in range(8)))
    return notes(spark, sf_dir).select("take_id", ((F.col("note_no") - 1) * 8).alias("frame"), levels.alias("rms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("take_id"), F.floor(F.col("vec_id") / 2).alias("pair_id"), F.when(F.pmod("vec_id", F.lit(2)) == 0, "reference").otherwise("practice").alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("pcm"))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    days = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01")).cast("bigint")
    start = days * 4 + F.col("l_linenumber")
    rows = l.select(
        F.col("l_suppkey").alias("song_id"), start.alias("st_tick"), (start + F.col("l_quantity").cast("bigint")).alias("en_tick"),
        (F.lit(48) + F.pmod("l_partkey", F.lit(36))).alias("midi"), (F.lit(20) + 15 * F.col("l_linenumber")).cast("bigint").alias("velocity"),
        "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"),
    )
    order = W.partitionBy("song_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "part")
    return rows.withColumn("note_no", F.row_number().over(order).cast("bigint")).drop("l_shipdate", "l_orderkey", "l_linenumber", "part")


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(spark, sf_dir)
    on = s.select("song_id", "midi", F.col("st_tick").alias("tick"), F.lit(1).cast("bigint").alias("is_on"), "note_no", "velocity")
    return on.unionByName(s.select("song_id", "midi", F.col("en_tick").alias("tick"), F.lit(0).cast("bigint").alias("is_on"), "note_no", "velocity"))


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("song_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return s.select("song_id", (F.col("k") * 2000).cast("bigint").alias("tick"), (F.lit(400000) + F.pmod(F.col("song_id") * 7 + F.col("k") * 13, F.lit(11)) * 40000).cast("bigint").alias("us_per_beat"))


#: Takes' planted properties, by take_id, in words that both engines read.
TAKE = {
    "readable": "take_id % 29 <> 3",
    "sample_rate": "case when take_id % 31 = 5 then 22050 else 44100 end",
    "n_samples": "case take_id % 9 when 0 then 44100 * 45 when 1 then 44100 * 45 - 1 when 2 then 44100 * 120 when 3 then 44100 * 120 + 1 else 44100 * 60 + take_id end",
}


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of the samples, with lengths at the bounds and next to them, and some that cannot be used."""
    e = samples(spark, sf_dir).select("take_id", "pair_id", "side")
    return e.selectExpr("take_id", "pair_id", "side", *(f"{x} as {c}" for c, x in TAKE.items()))


def quiet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples in two chunks a take, some of them nearly silent, silent, missing or no numbers."""
    k = F.pmod("take_id", F.lit(17))
    scale = F.when(k == 1, 0.00079).when(k == 2, 0.00081).when(k == 3, 0.0).otherwise(1.0)
    pcm = F.transform("pcm", lambda x: x * scale)
    odd = F.when(k == 5, F.lit(float("nan"))).when(k == 6, F.lit(float("inf")))
    s = samples(spark, sf_dir).where(k != 4).select("take_id", F.when(odd.isNotNull(), F.array_append(pcm, odd)).otherwise(pcm).alias("pcm"))
    return s.select("take_id", F.posexplode(F.array(F.slice("pcm", 1, 40), F.slice("pcm", 41, 100))).alias("chunk_no", "pcm"))


def played_samples(spark: SparkSession, sf_dir: str, chunk: int = 40) -> DataFrame:
    """Takes of three tones of 64 samples, a pair's sides slightly apart, over their own samples as noise, in chunks; some
    of them silent, missing or no numbers."""
    k, i = F.pmod("take_id", F.lit(17)), lambda i: F.floor(i / 64)
    hz = lambda n: (8 + F.pmod(F.col("pair_id") * 5 + i(n) * 7, F.lit(14))) * F.when(F.col("side") == "practice", 1.02).otherwise(1.0)
    loud = lambda n: 0.3 + 0.1 * F.pmod(F.col("take_id") + i(n), F.lit(4))
    tone = lambda n: 0.05 * F.get("pcm", F.pmod(n, F.lit(64)).cast("int")) + loud(n) * F.sin(2 * math.pi * hz(n) * n / 64.0)
    pcm = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda n: F.when(k == 3, 0.0).otherwise(tone(n)))
    s = samples(spark, sf_dir).where(k != 4).select("take_id", F.when(k == 5, F.array_append(pcm, F.lit(float("nan")))).otherwise(pcm).alias("pcm"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("pcm") - 1) / chunk).cast("int")), lambda c: F.slice("pcm", c * chunk + 1, F.lit(chunk)))
    return s.select("take_id", F.posexplode(parts).alias("chunk_no", "pcm"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone paths without alignment, and planted bad ones by pair_id % 10: 1 a backward step, 2 cut at half."""
    f = pitch_frames(spark, sf_dir)
    n = f.groupBy("pair_id").agg(F.sum((F.col("side") == "reference").cast("bigint")).alias("n_ref"), F.sum((F.col("side") == "practice").cast("bigint")).alias("n_prac")).where("n_ref > 0 and n_prac > 0")
    r = n.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ref") - 1)).alias("step"))
    kind = F.pmod("pair_id", F.lit(10))
    r = r.where((kind != 2) | (2 * F.col("step") < F.col("n_ref")))
    back = (kind == 1) & (F.col("step") == 5)
    return r.select("pair_id", "step", F.when(back, F.col("step") - 3).otherwise(F.col("step")).alias("reference_frame"), F.floor(F.col("step") * F.col("n_prac") / F.col("n_ref")).alias("practice_frame"), "n_ref", "n_prac")


#: The same tables as DuckDB SQL, in the order in which they need one another.
SQL = {
    "notes": """
  select user_id as take_id, user_id // 2 as pair_id, case when user_id % 2 = 0 then 'reference' else 'practice' end as side,
    row_number() over (partition by user_id order by epoch_us(ts), event_id) as note_no,
    (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 3.6e10 as onset_sec,
    130.81 * pow(2.0, (value - 48 * floor(value / 48)) / 12.0) as f0_hz, value / 500.0 as rms, event_id, event_type, value
  from events""",
    "pitch_frames": """
  select take_id, pair_id, side, note_no - 1 as frame, case when event_type <> 'error' then 1 else 0 end as voiced,
    case when event_type <> 'error' then f0_hz else 0.0 end as f0_hz, (event_id % 101) / 100.0 as confidence from notes""",
    "rms_frames": """
  select take_id, pair_id, side, (note_no - 1) * 8 + k as frame, rms * (8 - k) / 8.0 as rms
  from notes, (select unnest(range(8)) as k)""",
    "samples": """
  select vec_id as take_id, vec_id // 2 as pair_id, case when vec_id % 2 = 0 then 'reference' else 'practice' end as side,
    list_transform(embedding, lambda x: cast(x as double)) as pcm from embeddings""",
    "takes": "select take_id, pair_id, side, " + ", ".join(f"{x} as {c}" for c, x in TAKE.items()) + " from samples",
    "quiet_samples": """
  select take_id, unnest([pcm[1:40], pcm[41:]]) as pcm from (
    select take_id, case take_id % 17 when 5 then list_append(x, cast('nan' as double)) when 6 then list_append(x, cast('inf' as double)) else x end as pcm from (
      select take_id, list_transform(pcm, lambda v: v * case take_id % 17 when 1 then 0.00079::double when 2 then 0.00081::double when 3 then 0.0::double else 1.0::double end) as x
      from samples where take_id % 17 <> 4))""",
    "played": """
  select take_id, pair_id, side, case take_id % 17 when 5 then list_append(x, cast('nan' as double)) else x end as pcm from (
    select take_id, pair_id, side, list_transform(range(192), lambda i: case when take_id % 17 = 3 then 0.0::double else 0.05::double * pcm[i % 64 + 1]
      + (0.3::double + 0.1::double * ((take_id + i // 64) % 4)) * sin(2 * pi() * ((8 + (pair_id * 5 + (i // 64) * 7) % 14) * case when side = 'practice' then 1.02::double else 1.0::double end) * i / 64.0::double) end) as x
    from samples where take_id % 17 <> 4)""",
    "score": """
  select l_suppkey as song_id, date_diff('day', timestamp '1995-01-01', l_shipdate) * 4 + l_linenumber as st_tick,
    date_diff('day', timestamp '1995-01-01', l_shipdate) * 4 + l_linenumber + cast(l_quantity as bigint) as en_tick,
    48 + l_partkey % 36 as midi, cast(20 + 15 * l_linenumber as bigint) as velocity,
    row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as note_no from lineitem""",
    "note_events": """
  select song_id, midi, st_tick as tick, cast(1 as bigint) as is_on, note_no, velocity from score
  union all select song_id, midi, en_tick, 0, note_no, velocity from score""",
    "tempo": """
  select s_suppkey as song_id, cast(k * 2000 as bigint) as tick, cast(400000 + ((s_suppkey * 7 + k * 13) % 11) * 40000 as bigint) as us_per_beat
  from supplier, (select unnest(range(6)) as k)""",
    "paths": """
  select pair_id, step, case when pair_id % 10 = 1 and step = 5 then step - 3 else step end as reference_frame,
    cast(floor(step * n_prac / n_ref) as bigint) as practice_frame, n_ref, n_prac
  from (select *, unnest(range(n_ref)) as step from (
    select pair_id, count(*) filter (where side = 'reference') as n_ref, count(*) filter (where side = 'practice') as n_prac
    from pitch_frames group by pair_id) where n_ref > 0 and n_prac > 0)
  where pair_id % 10 <> 2 or 2 * step < n_ref""",
}
NEEDS = {"takes": ["samples"], "played": ["samples"], "quiet_samples": ["samples"], "pitch_frames": ["notes"], "rms_frames": ["notes"], "note_events": ["score"], "paths": ["notes", "pitch_frames"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """A query over these views (names parted by blanks) and what they need; the body may add its own after a comma."""
    names: list[str] = []
    for v in views.split():
        for n in (*NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    body = body.strip()
    return f"with {'recursive ' if recursive else ''}{head}{'' if body.startswith(',') else chr(10)}{body}"
