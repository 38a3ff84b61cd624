"""Encoding, quality rules, license scans, languages, toxicity and mixing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from takewise.llm import language_id, license_scan, mixing, quality, sentencepiece_codec, toxicity
from takewise.llm.pieces import default_model

from .common import ODD, PROSE, clashing, empty, odd, prose, rows

PATH = default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def strange(n: int) -> list[str]:
    random.seed(n)
    alphabet = " ▁\n\t abc thé日本語😀<s>\x00.é　ingtion  "
    return ["", "\n", " ", "  ", "a", "▁", "\n\n a  b", "ab" * 500, " x" * 40, "\r\n"] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 150))) for _ in range(n)]


def test_codec_against_the_library(library, sf, spark):
    texts = strange(300) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    c = sentencepiece_codec.codec(PATH)
    for text, parts in zip(texts, c.encode(texts)):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert c.ids(parts) == np.array(ids, dtype="<u4").tobytes()
        assert b"".join(p[1] for p in parts)[1:] == library.decode(ids).encode()


def test_agendas_agree():
    vocab = sentencepiece_codec.codec(PATH).vocab
    parts = [p for t in strange(100) for p in sentencepiece_codec.PARTS.findall(" " + t)]
    parts = [p.replace(" ", "▁") for p in parts if len(p) <= sentencepiece_codec.SHORT]
    for part, got in zip(parts, sentencepiece_codec.agendas(parts, vocab)):
        symbols = [int(vocab.symbol_of[ord(c)]) for c in part]
        assert got == sentencepiece_codec.agenda([s if s >= 0 else ord(c) - (1 << 32) for s, c in zip(symbols, part)], vocab)


def test_round_trip_rows(spark, library):
    got = sentencepiece_codec.round_trip(odd(spark))
    want = []
    for i, text, *_ in ODD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(got) == sorted(want, key=repr)
    assert rows(sentencepiece_codec.round_trip(clashing(spark))) == rows(got)
    assert sentencepiece_codec.round_trip(empty(spark)).count() == 0
    decoded = sentencepiece_codec.decode(sentencepiece_codec.encode(odd(spark)))
    assert Counter(r.text for r in decoded.collect()) == Counter((t or "").replace("▁", " ") for _, t, *_ in ODD)


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    lines = [x for x in lines if re.search("[^\x20\x09-\x0d]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(lines)


def test_quality_counts():
    texts = [r[1] for r in ODD if not r[1] or len(r[1]) < 5000] + ["a a a a", "x y z q x y z", "l\nl\n \nl", "a|b # c\x0bd\x1ce é", PROSE, "a b a b a b c"]
    for text in texts:
        assert quality.count_text(text) == brute_counts(text)


def test_quality_rows(spark):
    got = quality.judge(odd(spark))
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert got.count() == len(ODD)
    assert rows(quality.judge(clashing(spark))) == rows(got)
    assert quality.judge(empty(spark)).count() == 0
    kept = quality.filter_quality(clashing(spark))
    assert kept.columns == clashing(spark).columns and kept.count() == got.where("kept").count()
    assert quality.filter_quality(empty(spark)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [(i, prose(i), "en", f"s{i % 3}") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###$$" for w in prose(i).split()), "en", f"s{i % 3}") for i in range(20)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(200))


def test_quality_ties_at_the_fences(spark):
    """All rates equal: a text just at a fence stays, the next one goes, in a group of its own size or by all texts'."""
    plain = [(i, prose(i, 100), "en", "s") for i in range(80)]
    marked = lambda i, n: " ".join(w + "#" * (k < n) for k, w in enumerate(prose(i, 100).split()))
    edge = [(1000, marked(1000, 24), "en", "s"), (1001, marked(1001, 25), "en", "s"), (1002, marked(1002, 24), "fr", "t"), (1003, marked(1003, 25), "fr", "t"), (1004, marked(1004, 24), None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(plain + edge, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(80)) and {i: kept[i] for i in range(1000, 1005)} == {1000: True, 1001: False, 1002: True, 1003: False, 1004: True}


def test_labels_that_repeat_an_id(spark):
    """The highest toxic and the lowest quality of an id's labels count, for mixing and for toxicity."""
    rng = random.Random(4)
    docs = [(i, prose(i, 30) + rng.choice(["", "", " scum idiot", " ### $$$ %%%"])) for i in range(240)]
    marks = [(i, int("###" not in t), int("scum" in t)) for i, t in docs]
    more = [(i, 1, 0) for i in range(0, 240, 3)] + [(i, 0, 0) for i in range(0, 240, 40)] + [(None, 0, 1), (5, None, None), *marks[:50]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    both = {i: [q, t] for i, q, t in marks}
    for i, q, _ in more:
        if i is not None and q == 0:
            both[i][0] = 0
    table = lambda data: spark.createDataFrame(data, "doc_id long, quality int, toxic int")
    once, often = table([(i, *v) for i, v in both.items()]), table(marks + more).repartition(3)
    assert rows(mixing.document_rates(df, once)) == rows(mixing.document_rates(df, often))
    assert rows(toxicity.learn_and_score(df, once.select("doc_id", "toxic"))) == rows(toxicity.learn_and_score(df, often.select("doc_id", "toxic")))


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    texts = ["MIT license; the MIT-License, x Apache\nLicense 2.0", "mit licensed", "general public license general public license", "GNU Lesser General Public License", "é mit éé license",
             "mit mit license license", "All rights reserved.", "license mit", None, "", "Released under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_license(text), text
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert got[6].labels == "proprietary" and got[3].labels == "gpl,lgpl" and got[10].score == 1.0


def brute_matches(words, idf, common):
    """{(template, start): weight} of all matches, by looking at every start."""
    index = license_scan.Index(idf, common)
    known = sorted(({w for t in index.templates for w in t.words} - common) & set(words), key=lambda w: (-idf[w], w))[: license_scan.LOOKUPS]
    out = {}
    for n, t in enumerate(index.templates):
        for s in range(-len(t.words), len(words)):
            hits = [p for p, w in enumerate(t.words) if 0 <= s + p < len(words) and words[s + p] == w]
            phrase = sum(t.at <= p < t.at + t.length for p in hits)
            weight = sum(idf[t.words[p]] for p in hits)
            votes = sum(t.words[p] in known for p in hits)
            if phrase == t.length or votes >= license_scan.VOTES and t.length >= license_scan.ALTERABLE and phrase == t.length - 1 and weight >= license_scan.WHOLE * t.weight:
                out[n, s] = weight
    return out, index.templates


def test_license_templates_give_their_own_labels(spark):
    """Each template's text, plain and with one word of its phrase altered, among texts of other words; labels and scores
    against every start looked at, and the best of those that overlap."""
    from takewise.llm.license_texts import TEMPLATES

    texts = [prose(i, 30) for i in range(400)]
    plain = len(texts)
    texts += [f"{prose(i, 5)} {t} {prose(i, 7)}" for i, (_, t, _, _) in enumerate(TEMPLATES)]
    altered = len(texts)
    parted = [[w.decode() for w in license_scan.words_of(t)] for _, t, _, _ in TEMPLATES]
    for (_, _, phrase, _), words in zip(TEMPLATES, parted):
        key = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        texts.append(" ".join([*words[: at + 1], "otherwise", *words[at + 2 :]]))
    texts += ["Copyright X. All rights reserved. " + TEMPLATES[16][1], TEMPLATES[14][1] + " " + TEMPLATES[16][1], "mit license " * 300, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf, common = license_scan.word_weights(df)
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for k, (name, _, phrase, label) in enumerate(TEMPLATES):
        assert set(got[plain + k].labels.split(",")) == {label} | set(filter(None, got[plain + k].base_labels.split(","))), name
        assert got[plain + k].score == 1.0, name
        if len(phrase.split()) >= license_scan.ALTERABLE and len(parted[k]) > 40:
            assert label in got[altered + k].labels.split(",") and got[altered + k].score > 0.9, name
    for i, text in enumerate(texts):
        words = license_scan.words_of(text)
        matches, templates = brute_matches(words, idf, common)
        kept, labels, score = [], set(filter(None, brute_license(text)[4].split(","))), 0.0
        for (n, s), weight in sorted(matches.items(), key=lambda x: (-x[1], x[0])):
            if not any(s < b and a < s + len(templates[n].words) for a, b in kept):
                kept.append((s, s + len(templates[n].words)))
                labels.add(templates[n].label)
                score = max(score, weight / templates[n].weight)
        labels = labels - {"proprietary"} or labels
        assert (got[i].labels, got[i].score) == (",".join(sorted(labels)), pytest.approx(min(1.0, score))), text
    n = altered + len(TEMPLATES)
    assert got[n].labels == "bsd" and got[n + 1].labels == "bsd,mit" and got[n + 2].n_base == 300


def test_license_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        assert tuple(r)[1:6] == brute_license(texts[r.doc_id])
    assert license_scan.scan(odd(spark)).count() == len(ODD)
    assert rows(license_scan.scan(clashing(spark))) == rows(license_scan.scan(odd(spark)))
    assert license_scan.scan(empty(spark)).count() == 0


def brute_forward(model, word):
    a = np.zeros((len(word) + 1, len(model.langs)))
    a[0] = 1
    for t in range(1, len(word) + 1):
        for k in range(1, t + 1):
            i = model.vocab.ids.get(word[t - k : t])
            if i is not None:
                a[t] += a[t - k] * model.p[i]
            elif k == 1:
                a[t] += a[t - 1] * language_id.UNKNOWN
    return np.log(a[-1])


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    v = language_id.vocabulary(PATH)
    model = language_id.Model(PATH, ["a", "b"], rng.integers(0, 50, (2, len(v.pieces))).astype(float), np.array([1.0, 2.0]))
    words = ["▁hello", "▁international", "▁日本x", "▁a", "▁éèê", "▁thstinnt😀"]
    assert np.allclose(model.forward(words), [brute_forward(model, w) for w in words])
    long = "▁" + "abcing" * 12
    assert np.allclose(model.forward([long])[0], brute_forward(model, long))


def test_language_accuracy_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 20 and r[1] >= 0.95
    few = language_id.learn_and_identify(odd(spark))
    assert few.count() == len(ODD)
    assert {x.lang_pred for x in few.where("doc_id in (5, 6)").collect()} == {"und"}
    assert rows(language_id.learn_and_identify(clashing(spark))) == rows(few)
    assert language_id.learn_and_identify(empty(spark)).count() == 0


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.learn_and_score(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1").count() == 0
    joined = got.join(labels, "doc_id")
    assert joined.where("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.1
    for df in (odd(spark), clashing(spark)):
        assert toxicity.learn_and_score(df, labels).count() == len(ODD)
        assert toxicity.learn_and_score(df, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.learn_and_score(empty(spark), labels).count() == 0


def test_field_marginals_against_enumeration():
    field = toxicity.Field(["w=bad", "4=evil"])
    field.weights[:] = [3.0, 2.0, 0.0]
    field.moves[:] = [[0.2, -0.5], [0.1, 0.7]]
    field.first[:] = [0.3, -0.1]
    sentence = [[0], [], [1], [], [0, 1]]
    p1, _, _ = field.marginals(*field.grid([sentence, [[]]]))
    total, ones = 0.0, np.zeros(5)
    for y in range(32):
        tags = [y >> t & 1 for t in range(5)]
        s = field.first[tags[0]] + sum(field.moves[a, b] for a, b in zip(tags, tags[1:])) + sum(tags[t] * (field.bias[0] + sum(field.weights[i] for i in sentence[t])) for t in range(5))
        total += np.exp(s)
        ones += np.exp(s) * np.array(tags)
    assert np.allclose(p1[0, :5], ones / total)


def test_mixing(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        kind = "clean" if i % 3 else rng.choice(["toxic", "low"])
        text = prose(i) + {"clean": "", "toxic": " scum idiot trash", "low": " ### *** $$$ &&& %%% ###" * 5}[kind]
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"clean": 0.7, "low": 0.12, "toxic": 0.18}
    got = mixing.document_rates(df, lab, targets, max_rate=3.0)
    s = got.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in targets)).first()
    assert all(abs(s[d] / sum(s) - w) < 0.01 for d, w in targets.items())
    assert got.where("rate < 0 or rate > 3").count() == 0
    mixed = mixing.mix(df, lab, targets, max_rate=1.0)
    assert mixed.columns == df.columns and mixed.count() == mixed.distinct().count()
    counts = {r.toxic: r.n for r in mixed.join(lab, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert counts[0] >= 0.75 * sum(not t for _, _, t in labels) and counts.get(1, 0) < sum(t for _, _, t in labels)


def test_mixing_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for lab in (labels, labels.limit(0)):
        assert mixing.document_rates(odd(spark), lab).count() == len(ODD)
        assert mixing.document_rates(empty(spark), lab).count() == 0
        assert mixing.mix(clashing(spark), lab).columns == clashing(spark).columns


def test_rates_reach_their_goals(spark):
    """Soft posteriors with goals that max_rate 2 can reach: all totals are met, however slowly plain steps get there."""
    rng = np.random.default_rng(3)
    shares = np.array([0.8, 0.15, 0.05])
    domain = rng.choice(3, 4000, p=shares)
    score = rng.normal(size=(4000, 3))
    score[np.arange(4000), domain] += 1
    p = np.exp(score) * shares
    p /= p.sum(axis=1, keepdims=True)
    data = [(int(n), x) for n, x in zip(rng.integers(20, 800, 4000), p.tolist())]
    narrow = spark.createDataFrame(data, "__n long, __p array<double>").cache()
    p = np.array([x for _, x in data])
    steps, report = mixing.fit_rates(narrow, max_rate=2.0)
    assert all(abs(r["fitted"] / r["goal"] - 1) < 0.01 for r in report.values()), report
    x = mixing.replay(p, steps, 2.0)[0]
    assert 0 <= x.min() < x.max() <= 2
    # goals out of reach: no feasible direction of the totals lowers the misfit (rates at a vertex or balanced)
    steps, report = mixing.fit_rates(narrow, max_rate=0.5)
    n = np.array([d[0] for d in data], dtype=float)
    x = mixing.replay(p, steps, 0.5)[0]
    gap = np.array([r["goal"] - r["fitted"] for r in report.values()])
    pull = p @ np.linalg.solve((p * n[:, None]).T @ p, gap)
    best = np.where(pull > 0, 0.5, 0.0)
    assert (n * pull * (best - x)).sum() < 1e-3 * (n * np.abs(pull)).sum()


def test_upper_rate_counts_every_word():
    """Half the words in upper case: the same grade whatever the length, and wherever they stand."""
    for n in (100, 200, 399, 400, 20_000):
        for words in ([b"UP", b"low"] * (n // 2), [b"low", b"UP"] * (n // 2), [b"UP"] * (n // 2) + [b"low"] * (n // 2)):
            assert b" u%d" % int(10 * (n // 2) / len(words)) in mixing.rates(b" ".join(words), words)
    passage = [b"low"] * 10_001 + [b"UP"] * 2_500 + [b"low"] * 7_499
    assert b" u1" in mixing.rates(b" ".join(passage), passage)


def test_posteriors_and_rates_against_brute_force(spark):
    """Naive Bayes and the least-squares rates in plain Python on a small table with ties, null and long texts."""
    rng = random.Random(2)
    kinds = {"clean": "", "low": " ### *** $$$ &&& %%%", "toxic": " scum idiot trash"}
    docs, labels = [], []
    for i in range(240):
        kind = rng.choice(["clean", "clean", "low", "toxic"])
        docs.append((i, prose(i % 100, 40 + i % 50) + kinds[kind]))  # i and i + 100 share words
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    docs += [(1000, None), (1001, ""), (1002, prose(7, 20_000) + " scum"), (1003, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets, most = {"clean": 0.6, "low": 0.15, "toxic": 0.25}, 2.0
    got = {r.doc_id: r for r in mixing.document_rates(df, lab, targets, max_rate=most).collect()}

    def bag(text):
        raw = (text or "").encode()
        return {*mixing.tokens(text), *mixing.rates(raw, raw.split())}

    domain = {i: "toxic" if t else "clean" if q else "low" for i, q, t in labels}
    texts = Counter(domain.values())
    n = {d: Counter(w for i, t in docs if domain.get(i) == d for w in bag(t)) for d in targets}
    weight = {}
    for w in set().union(*n.values()):
        share = sum(n[d][w] for d in targets) / 240
        v = [np.log((n[d][w] + mixing.SMOOTHING * share) / (texts[d] + mixing.SMOOTHING) / share) for d in targets]
        if max(map(abs, v)) >= mixing.TELLING:
            weight[w] = np.array(v)
    sizes, p = [], []
    for i, t in docs:
        total = np.log([texts[d] / 240 for d in targets]) + (sum((weight[w] for w in bag(t) if w in weight), np.zeros(3)) if t else 0)
        e = np.exp(total - total.max())
        sizes.append(len(mixing.tokens(t)))
        p.append(e / e.sum())
        assert np.allclose([got[i][f"p_{d}"] for d in targets], p[-1], atol=1e-9) and got[i].n_tokens == sizes[-1]
    sizes, p = np.array(sizes, float), np.array(p)
    have = sizes @ p
    goal = np.array(list(targets.values())) * have[0] / targets["clean"]
    x = np.ones(len(p))
    gram = (p * sizes[:, None]).T @ p
    inverse = np.linalg.inv(gram + np.eye(3) * 1e-9 * np.trace(gram))
    for _ in range(20_000):  # projected gradient, document by document
        x = np.clip(x + p @ inverse @ (goal - (sizes * x) @ p), 0, most)
    fitted = np.array([got[i].rate for i, _ in docs])
    misfit = lambda x: (goal - (sizes * x) @ p) @ inverse @ (goal - (sizes * x) @ p)
    assert misfit(fitted) <= misfit(x) + 1e-6 * (goal @ inverse @ goal)
    assert fitted.min() >= 0 and fitted.max() <= most


def test_toxicity_against_brute_force(spark):
    """Scores and spans of a tiny model by enumeration of all taggings, with empty, repeated and long texts and ties."""
    field = toxicity.Field(["w=bad", "4=evil"])
    field.weights[:] = [6.0, 4.0, 0.0]
    field.moves[:] = [[0.4, -0.3], [-0.2, 0.5]]
    weights = np.array([-2.0, 2.5, 1.0])
    texts = ["A bad evil day.", "Nothing here.", "", None, "bad", "bad", "evilness reigns\nbad Bad!", "... 123", "Fine words. " * 400 + "So bad!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in toxicity.score(df, (field, weights, 0.25)).collect():
        text = texts[r.doc_id] or ""
        words, total, spans = len(re.findall(r"[A-Za-z]+", text)), 0.0, []
        for m in re.finditer(r"[^.\n!?]+", text):
            found = [(m.start() + w.start(), w.group().lower()) for w in re.finditer("[A-Za-z]+", m.group())]
            numbers = [[0] if w == "bad" else [1] if w.startswith("evil") else [] for _, w in found]
            if not any(numbers):
                continue
            all_, ones = 0.0, np.zeros(len(found))
            for y in range(2 ** len(found)):
                tags = [y >> t & 1 for t in range(len(found))]
                s = np.exp(field.first[tags[0]] + sum(field.moves[a, b] for a, b in zip(tags, tags[1:])) + sum(t * (field.bias[0] + sum(field.weights[i] for i in f)) for t, f in zip(tags, numbers)))
                all_, ones = all_ + s, ones + s * np.array(tags)
            total += (ones / all_).sum()
            spans += [(at, at + len(w)) for (at, w), p in zip(found, ones / all_) if p >= 0.5]
        plain = 1 / (1 + np.exp(-weights @ [1.0, np.log1p(total), min(1.0, 20 * total / words)])) if words else 0.25
        assert r.score == pytest.approx(plain, abs=1e-9), text[:40]
        assert [(s.start, s.end) for s in r.spans] == spans


def test_language_posteriors_against_brute_force(spark):
    """Scores of the query from one text's words, each summed over its segmentations; of equal scores the first language."""
    texts = [(1, "hello world one two", "en"), (2, "bonjour le monde", "fr"), (3, "hello monde", "en"), (4, "le le la", "fr"), (5, None, "en"), (6, "42 ...", "fr"), (7, "bonjour hello", None), (7, "bonjour hello", None), (8, "la " * 3000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    fitted = language_id.fit(df, PATH)
    model = language_id.Model(PATH, *fitted)
    for r in language_id.identify(df, fitted, PATH).collect():
        text = next(t for i, t, _ in texts if i == r.doc_id)
        if text is None or not re.search("[a-z]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = model.priors + sum(brute_forward(model, "▁" + w) for w in text.split())
        p = np.exp(total - total.max())
        assert r.lang_pred == model.langs[int(total.argmax())] and r.score == pytest.approx(p.max() / p.sum(), rel=1e-6)
