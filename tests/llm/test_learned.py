"""What is learned: accuracy on rows held out, and that only what may be used is used."""

import itertools
import re
import sys
import time
import unicodedata
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from timegrid.llm import langid, quality, rules

from .conftest import hand_made

BIG = "/root/testdata/sf0.01"


def test_languages(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{BIG}/documents.parquet'").fetchall())
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in out]) > 0.98


def test_mixture_finds_shares_and_stays_single(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    langs, table = langid.learn(docs)
    text = {r["lang"]: r["text"] for r in docs.filter("n_chars between 3000 and 5000 and not text rlike '[#|*$]'").collect()}
    cut = lambda k, n: " ".join(text[k].split()[:n])
    rows = [(1, cut("de", 300) + " " + cut("fr", 100)), (2, cut("en", 200)), (3, "12 !!"), (4, None)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), langs, table).collect()}
    assert got[1]["langs"][:2] == ["de", "fr"] and abs(got[1]["shares"][0] - 0.75) < 0.06 and got[1]["lang_pred"] == "de"
    assert got[2]["langs"] == ["en"]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (3, 4))


def test_letters_are_told_fast_and_right():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for text in (every, every[:0xD800], "", None, "Straße ½ Ⅷ x²\U00010107y\U0001d7d8 Z\U00010400"):
        letters = [c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()]
        assert langid._letters(text).split(" ") == ("".join(letters).split() or [""])
    plain, times = "some plain words in lines, " * 20_000, []
    for clean in (langid._letters, lambda t: re.sub(r"[\W\d_]+", " ", t.lower())):
        start = time.process_time()
        clean(plain)
        times.append(time.process_time() - start)
    assert times[0] < 8 * times[1]


def test_em_raises_the_likelihood():
    r = np.random.default_rng(0)
    words = -r.random((50, 3)) * 5
    share, post = langid.mixture(words, np.array([0, 20]))
    assert np.allclose(share.sum(1), 1) and np.allclose(post.sum(1), 1)


def test_odd_rows_get_languages(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == len(hand_made())
    for r in got:
        if r["doc_id"] in (3, 4, 5, 14):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(no_docs).collect() == []
    nothing = langid.identify(odd_docs.withColumn("lang", odd_docs["source"])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{BIG}/labels.parquet'").fetchall())
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    out = [i for i in truth if got[i]["held_out"]]
    y, s = np.array([truth[i] for i in out]), np.array([got[i]["score"] for i in out])
    wins = (s[y == 1][:, None] > s[y == 0]).mean()
    assert wins > 0.97 and np.mean([got[i]["predicted"] == truth[i] for i in out]) > 0.93


def test_held_out_labels_are_not_seen(spark, odd_docs):
    rows = [(i, (i * 7) % 2, 0) for i in range(1, 15)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    a, b = (sorted([tuple(r) for r in quality.classify(odd_docs, x).collect()], key=repr) for x in (labels, flipped))
    assert a == b and len(a) == len(hand_made())


def test_classifier_without_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).collect() == []


def test_ftrl_learns_a_line():
    r, model = np.random.default_rng(1), quality.Ftrl()
    for _ in range(2000):
        at = r.choice(20, 5, replace=False)
        model.learn(at, np.ones(5), int((at < 10).sum() > 2))
    w = model.weights()[:20]
    assert w[:10].min() > 0 > w[10:].max()


def plain_mixture(words, max_languages=4):
    """The penalised best of all language sets, each by EM from even shares to the end."""
    top = words.max(1, keepdims=True)
    like = np.exp(words - top).astype(float)
    best = None
    for size in range(1, max_languages + 1):
        for langs in itertools.combinations(range(words.shape[1]), size):
            share = np.full(size, 1 / size)
            for _ in range(200):
                joint = like[:, langs] * share
                share = (joint / joint.sum(1, keepdims=True)).mean(0)
            value = np.log((like[:, langs] * share).sum(1) + 1e-300).sum() - langid.PENALTY * np.log(len(words) + 1) * (size - 1)
            if best is None or value > best[0] + 1e-9:
                best = value, langs, share
    return best[1], best[2]


def test_mixtures_equal_exhaustive_em():
    r, agree = np.random.default_rng(8), 0
    for _ in range(40):
        n, k = int(r.integers(30, 120)), 5
        some = r.choice(k, int(r.integers(1, 4)), replace=False)
        words = r.normal(-14, 1.5, (n, k)).astype(np.float32)
        words[np.arange(n), r.choice(some, n)] += 9
        langs, share = plain_mixture(words)
        got, _ = langid.mixture(words, np.array([0]))
        found = tuple(np.flatnonzero(got[0] > 0))
        agree += found == langs and np.abs(got[0][list(langs)] - share).max() < 0.03
    assert agree >= 38


def test_ftrl_equals_its_dense_form():
    r, n = np.random.default_rng(2), 40
    model = quality.Ftrl()
    z, s = [0.0] * n, [0.0] * n
    weight = lambda i: 0.0 if abs(z[i]) <= model.l1 else -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + s[i] ** 0.5) / model.alpha + model.l2)
    for _ in range(300):
        at = np.sort(r.choice(n, 6, replace=False))
        x, y = r.random(6), int(at.sum() % 2)
        model.learn(at, x, y)
        dense = np.zeros(n)
        dense[at] = x
        p = 1 / (1 + np.exp(-sum(weight(i) * dense[i] for i in range(n))))
        old = [weight(i) for i in range(n)]
        for i in range(n):
            g = (p - y) * dense[i]
            z[i] += g - ((s[i] + g * g) ** 0.5 - s[i] ** 0.5) / model.alpha * old[i]
            s[i] += g * g
    assert np.allclose(model.weights(np.arange(n)), [weight(i) for i in range(n)])


def test_training_equals_a_plain_loop(spark):
    """One example a document, in the order of the ids' hashes, three times over."""
    texts = [(i, f"Good words of kind {i % 7} here." if i % 2 else f"### BAD {i % 5} ***") for i in range(30)]
    rows = texts + [(3, "zzz another text of an id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.train(docs, labels)
    by = {}
    for x in docs.selectExpr("doc_id", "text", "xxhash64(text) as h", "xxhash64(doc_id) as o").collect():
        if x["doc_id"] is not None and x["doc_id"] < 25:
            by[x["doc_id"]] = min(by.get(x["doc_id"], (x["h"], x["text"], x["o"])), (x["h"], x["text"], x["o"]))
    model, hashes, shapes = quality.Ftrl(), quality.WordHashes(), quality.Shapes()
    for _ in range(3):
        for i, (_, text, _) in sorted(by.items(), key=lambda p: (p[1][2], p[0])):
            buckets = quality.features(text, hashes, shapes)
            at, n = np.unique(buckets, return_counts=True)
            x = (n * (quality.SCALE / len(buckets))).astype("<f4").astype(float)
            model.learn(np.append(at.astype(np.int64), 1 << quality.BITS), np.append(x, 1.0), int(i % 2))
    assert np.allclose(got, model.weights().astype(np.float32))


def test_held_out_languages_change_nothing(docs):
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(df).collect())
    assert key(docs) == key(other)


def test_trusted_text_that_was_not_counted_is_kept(spark):
    """Verdicts on trusted documents of each language that the table has not seen, where trusted text is scarce."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    trusted = rules.trusted_ids(labels)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = rules.judge(docs, trusted.filter(~out)).join(docs.select("doc_id", "lang"), "doc_id").filter("not base_failed")
    kept = found.join(trusted.filter(out), "doc_id").groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert len(kept) == 4 and all(r["k"] >= 0.9 for r in kept)
    bad = found.join(labels.filter("quality = 0"), "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert bad <= 0.1
