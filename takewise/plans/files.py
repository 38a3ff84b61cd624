"""Queries over files that Spark writes from the tables, and over serialised rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget, shared_folder
from ..functions.scalars import rounded as R
from ..operators import catalogue as C
from ..sources import adapters as A
from ..sources import files as S
from ..sources.adapters import sql

QUERIES, SQL = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _wav(take: int) -> bytes:
    """A small file with a header of its take's own: formats, channels, chunks before the data, or none at all."""
    channels, rate = 1 + take % 2, 44100 if take % 3 else 22050
    code, bits = (3, 32) if take % 5 == 1 else (1, 16)
    frame = channels * bits // 8
    body = struct.pack("<HHIIHH", 0xFFFE if take % 7 == 2 else code, channels, rate, rate * frame, frame, bits)
    if take % 7 == 2:
        body += struct.pack("<HHIH14s", 22, bits, 0, code, b"\0" * 14)
    extra = b"LIST" + struct.pack("<I", 5) + b"INFO.\0" if take % 4 == 1 else b""
    sound = b"\0" * (frame * (take % 50 + 1))
    chunks = b"fmt " + struct.pack("<I", len(body)) + body + extra + b"data" + struct.pack("<I", len(sound)) + sound
    return (b"RIFX" if take % 13 == 6 else b"RIFF") + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@query(sql("samples", """
, t as (select take_id, take_id % 13 = 6 as bad, 1 + take_id % 2 as ch, case when take_id % 3 = 0 then 22050 else 44100 end as rate, case when take_id % 5 = 1 then 32 else 16 end as bits, take_id % 50 + 1 as n from samples)
select 'take' || take_id || '.wav' as relative_path, case when not bad then round(n / rate, 9) end as duration_sec, case when not bad then rate end as sample_rate_hz, case when not bad then ch end as channels,
  case when not bad then bits end as bit_depth, case when bad then null when bits = 32 then 'FLOAT' else 'PCM' end as format,
  20 + 8 + (case when take_id % 7 = 2 then 40 else 16 end) + (case when take_id % 4 = 1 then 14 else 0 end) + ch * (bits // 8) * n as bytes, case when bad then 'INPUT_UNREADABLE' end as error_code from t"""))  # fmt: skip
def wav_header_scan(spark, d):
    folder = _folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(place, recursive=True)
        for batch in batches:
            for take in batch.column("take_id").to_pylist():
                with store.open_output_stream(f"{place}/take{take}.wav") as out:
                    out.write(_wav(take))
            yield batch

    A.samples(spark, d).select("take_id").mapInArrow(write, "take_id long").write.format("noop").mode("overwrite").save()
    found = cut(S.wav_header_scan(spark, folder).withColumn("duration_sec", F.round("duration_sec", 9)))
    forget(spark, folder)
    return found


@query(sql("takes", "select take_id, side, round(n_samples / sample_rate, 4) as duration_sec, 'Läufe, ' || side as title from takes"))
def manifest_csv(spark, d):
    """Written, each file with its byte order mark, and read again."""
    folder = _folder(spark)
    t = A.takes(spark, d).select("take_id", "side", F.round(F.col("n_samples") / F.col("sample_rate"), 4).alias("duration_sec"), F.concat(F.lit("Läufe, "), "side").alias("title"))
    S.write_manifest(t, folder)
    found = cut(S.read_manifest(spark, folder, "take_id long, side string, duration_sec double, title string"))
    forget(spark, folder)
    return found


@query(sql("notes", """
select take_id, note_no, 'off_tune' as variant, 'cents' as label, round(value, 3) + 0.0 as value from notes
union all select take_id, note_no, 'off_tune', 'note', note_no::double from notes
union all select take_id, note_no, 'late', 'sec', note_no::double from notes"""))  # fmt: skip
def label_json_explode(spark, d):
    planted = A.notes(spark, d).select("take_id", "note_no", F.concat(F.lit('{"off_tune":{"cents":'), F.round("value", 3).cast("string"), F.lit(',"note":'), F.col("note_no").cast("string"), F.lit('},"late":{"sec":'), F.col("note_no").cast("string"), F.lit("}}")).alias("labels"))
    return S.explode_labels(planted, "labels", ["take_id", "note_no"]).withColumn("value", R(F.col("value")))


#: Paths of songs, takes and other files, some of them twice, from the pages.
_PATHS = """
with p as (
  select distinct case page_id % 23 when 0 then 'data/' || page_id || '.txt' when 1 then 'stray.wav' else
    lpad(cast(page_id % 20 as varchar), 2, '0') || '_Tune ' || (page_id % 20) || case page_id % 7 when 0 then '/original.wav' when 1 then '/melody.wav' when 2 then '/scan.png' when 3 then '/other.wav' else '/practice/' || (page_id % 30) || case when page_id % 5 = 0 then '_Late.WAV' else '_note.mid' end end end as path
  from pages)
"""


def _paths(spark, d):
    i = F.col("page_id")
    tail = F.when(i % 7 == 0, "/original.wav").when(i % 7 == 1, "/melody.wav").when(i % 7 == 2, "/scan.png").when(i % 7 == 3, "/other.wav").otherwise(F.concat(F.lit("/practice/"), (i % 30).cast("string"), F.when(i % 5 == 0, "_Late.WAV").otherwise("_note.mid")))
    song = F.concat(F.lpad((i % 20).cast("string"), 2, "0"), F.lit("_Tune "), (i % 20).cast("string"))
    path = F.when(i % 23 == 0, F.concat(F.lit("data/"), i.cast("string"), F.lit(".txt"))).when(i % 23 == 1, "stray.wav").otherwise(F.concat(song, tail))
    return A.table(spark, d, "pages").select(path.alias("path"))


@query(_PATHS + """
, c as (
  select path, string_split(path, '/') as part from p),
r as (
  select path, part[1] as song, part[-1] as file, case when len(part) = 2 and part[-1] = 'original.wav' then 'original' when len(part) = 2 and part[-1] = 'melody.wav' then 'melody'
    when len(part) = 3 and part[2] = 'practice' and lower(part[-1]) like '%.wav' then 'practice' else 'skipped' end as role from c),
s as (select song, count(*) filter (where role <> 'skipped') as takes from r group by song)
select song, case when contains(song, '_') then substr(song, instr(song, '_') + 1) else song end as title, role, regexp_replace(file, '[.][wW][aA][vV]$', '') as name, path,
  case when takes = 0 then 'no take in this song' when role <> 'skipped' then null when lower(file) not like '%.wav' then 'not a .wav file' else 'not at a place of takes' end as reason from r join s using (song)""")  # fmt: skip
def take_catalog(spark, d):
    return C.take_catalog(_paths(spark, d))
