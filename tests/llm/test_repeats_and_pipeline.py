import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from takewise.llm import entries, suffix_dedup
from takewise.llm.common import shared_folder
from takewise.llm.pieces import default_model

from .common import ODD, clashing, empty, odd, prose, rows
from .test_exact_and_near import brute_exact, brute_similarity


def brute(texts, length=100):
    """Of texts in order: (bytes, removed, spans, digest of what is kept)."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    random.seed(5)
    base = ["".join(random.choice("abcd ") for _ in range(random.randint(50, 600))) for _ in range(6)]

    def one():
        a, b = random.choice(base), random.choice(base)
        x = list(a[: random.randint(0, len(a))] + b[random.randint(0, len(b)) :] + random.choice(["", "é", a]))
        if x and random.random() < 0.7:
            x[random.randrange(len(x))] = "Z"
        return "".join(x)

    found = [(i, one()) for i in range(60)] + [(200, "a" * 700), (201, "ab" * 400), (202, None), (203, ""), (204, "a" * 99), (205, "a" * 100), (206, "ab" * 50), (300, base[0]), (301, base[0])]
    random.shuffle(found)
    return found


def test_repeats(spark):
    data = cases()
    got = suffix_dedup.digest(suffix_dedup.find_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)))
    data.sort()
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == dict(zip([i for i, _ in data], brute([t for _, t in data])))


def test_frequent_string_beside_own_text(spark):
    """A string of 24 bytes in a tenth of the texts, each time beside text of its own: the windows over it do not meet."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = min((noise(24) for _ in range(2000)), key=lambda x: suffix_dedup.grams(np.frombuffer(x.encode(), np.uint8))[0] >> np.uint64(1))
    passage = noise(150)
    data = [(i, noise(120) + (line if i % 10 == 0 else passage if i % 10 == 1 else noise(24)) + noise(120)) for i in range(400)]
    docs = spark.createDataFrame(data, "key long, text string").repartition(4)
    largest = {}
    for name, table in (("noted", suffix_dedup.frequent_grams(docs)), ("not", np.zeros(1 << suffix_dedup.TABLE_BITS, dtype=bool))):
        blocks = suffix_dedup._blocks([i for i, _ in data], [t.encode() for _, t in data])
        hashes = np.concatenate([suffix_dedup.anchors(d, ok, table)[0] for d, ok, *_ in blocks])
        gram = suffix_dedup.grams(np.frombuffer(line.encode(), np.uint8)).view(np.int64)[0]
        largest[name] = int((hashes == gram).sum())
    assert largest["noted"] == 0 and largest["not"] >= 30
    got = suffix_dedup.digest(suffix_dedup.find_repeats(docs.withColumnRenamed("key", "doc_id")))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == dict(zip([i for i, _ in data], brute([t for _, t in data])))


@pytest.mark.parametrize("most", [1, 2000, 4 << 20])
def test_large_groups_go_on_by_windows(spark, most):
    """Groups past any size give what sorted ones give: copies, passages, and a string in texts of their own."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, passage, copy = noise(24), noise(180), noise(400)
    texts = [noise(rng.randint(0, 150)) + rng.choice([line, passage, passage[:120], passage[30:], copy, ""]) + noise(rng.randint(0, 90)) for _ in range(150)]
    texts += [copy, copy, passage, line * 20, line * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.find_repeats(docs, most=most)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_a_large_group_is_never_held(spark, monkeypatch):
    """A string that the sample has not, in 40,000 texts with surroundings of their own: a task holds SORTED bytes of it."""
    rng = random.Random(3)
    line = min(("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(4000)), key=lambda x: suffix_dedup.grams(np.frombuffer(x.encode(), np.uint8))[0] >> np.uint64(1))
    near = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=76)) for _ in range(400)]
    texts = [near[i % 400] + line.encode() + near[i * 7 % 397] for i in range(40_000)]
    batch = lambda i, n: pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), pa.array(np.arange(i, i + n)), pa.array(np.full(n, 76 << 7 | 76)), pa.array(texts[i : i + n], pa.binary()), pa.nulls(n, pa.int64())], suffix_dedup._STRETCH)
    sizes = []
    monkeypatch.setattr(suffix_dedup, "settle", lambda *a: pytest.fail("a large group was sorted in one task"))
    for out in suffix_dedup._settled(iter([batch(i, 1000) for i in range(0, 40_000, 1000)]), 1 << 18):
        assert set(map(len, out.column("stretch").to_pylist())) == {suffix_dedup.LENGTH}
        sizes.append(out.num_rows)
    assert sum(sizes) == 40_000 * 77 and max(sizes) <= suffix_dedup.HELD_WINDOWS + 77


def test_anchors_do_not_depend_on_the_block():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 400).astype(np.uint8)
    none = np.zeros(4, dtype=bool)
    for before in (0, 5, 3000, 70_000):
        data = np.concatenate((rng.integers(97, 123, before).astype(np.uint8), text))
        ok = np.zeros(len(data), dtype=bool)
        ok[before : before + 301] = True
        h, place, first, last = suffix_dedup.anchors(data, ok, none)
        got = (h.tolist(), (place - before).tolist(), (first - before).tolist(), (last - before).tolist())
        assert got == (want := got if before == 0 else want)


def test_blocks_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    texts = [bytes(random.Random(i).choices(b"ab", k=n)) for i, n in enumerate((1000, 99, 100, 355, 356, 3000))]
    seen = set()
    for data, ok, begins, keys, offsets in suffix_dedup._blocks(list(range(6)), texts):
        h, place, first, last = suffix_dedup.anchors(data, ok, np.zeros(4, dtype=bool))
        text = np.searchsorted(begins, first, "right") - 1
        for t, a, b in zip(text, first, last):
            seen.update((int(keys[t]), int(w - begins[t] + offsets[t])) for w in range(a, b + 1))
    assert seen == {(i, p) for i, x in enumerate(texts) for p in range(len(x) - 99)}


def test_suffix_order():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    start = rng.integers(0, 250, 80)
    size = np.minimum(rng.integers(1, 40, 80), 300 - start)
    group = np.sort(rng.integers(0, 5, 80))
    order, same = suffix_dedup.Suffixes(data, start, size, group).repeats()
    name = lambda i: (group[i], data[start[i] : start[i] + size[i]].tobytes())
    assert [name(i) for i in order] == sorted(map(name, range(80))) and list(order) == sorted(range(80), key=name)
    assert list(same) == [k > 0 and name(order[k]) == name(order[k - 1]) for k in range(80)]


def test_repeats_odd_rows(spark):
    got = suffix_dedup.digest(suffix_dedup.find_repeats(odd(spark)))
    assert got.count() == len(ODD) and got.agg({"n_removed": "sum"}).first()[0] > 0
    ids = [r for r in got.collect() if r.doc_id == 2]
    assert len(ids) == 2 and all(r.n_removed == r.n_bytes for r in ids)  # copies of document 1
    assert rows(suffix_dedup.digest(suffix_dedup.find_repeats(clashing(spark)))) == rows(got)
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0


def test_entries_have_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))


def test_pipeline_against_brute_force(spark, sf):
    """Each stage against plain Python on what the stage before kept; rates and verdicts are tested by themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf)
        if name == "exact dedup":
            keep = {k for k, _ in brute_exact([(r["doc_id"], r["text"]) for r in before]).values()}
            assert {r.doc_id for r in out.collect()} == keep
        elif name == "SimHash near-dedup":
            # what goes is like an earlier text that was there; of pairs that are so alike none stays whole
            kept, earlier = {r.doc_id for r in out.collect()}, sorted(before, key=lambda r: r["doc_id"])
            like = {r["doc_id"]: [q["doc_id"] for q in earlier[:i] if brute_similarity(q["text"], r["text"]) >= 0.8] for i, r in enumerate(earlier)}
            assert all(like[r["doc_id"]] for r in before if r["doc_id"] not in kept)
            assert not [i for i, v in like.items() if v and i in kept]
        elif name == "SentencePiece encoding":
            library = sentencepiece.SentencePieceProcessor(model_file=default_model())
            want = {r["doc_id"]: len(library.encode(r["text"], add_bos=True, add_eos=True)) for r in before}
            assert {r.doc_id: r.n_tokens for r in out.collect()} == want
            return
        assert out.columns == columns and {r.doc_id for r in out.collect()} <= {r["doc_id"] for r in before}
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_pipeline_run_is_its_stages(spark, sf):
    """run() over the whole tables gives what the stages give one by one, and leaves one folder."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    got = corpus_pipeline.run(spark, sf)
    assert len([p for p in set(folder.iterdir()) - before if len(p.name) == 32]) == 1
    assert rows(got) == rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf))


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Nulls, repeated rows, long texts and clashing columns pass through all stages; so does an empty table."""
    more = spark.createDataFrame([(100 + i, prose(i, 120), "en", "s", 9) for i in range(60)], odd(spark).schema)
    docs = clashing(spark, odd(spark).unionByName(more).unionByName(more.where("doc_id < 110")))
    for docs in (docs, docs.limit(0)):
        columns, n = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.count() <= n and (n == 0 or docs.count() > 0)
            n = docs.count()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert out.count() == n and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert n == 0


def test_pipeline_run_on_odd_rows(spark, tmp_path):
    """run() over a folder of odd rows gives what the stages give one by one."""
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, 120), "en", "s", 9) for i in range(60)], odd(spark).schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (101, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), step.schema)
    assert 0 < step.count() < docs.count() and rows(got) == rows(corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)))
