"""Operators whose rows brute force can tell: sharding, packing, lines, substrings, quality counts."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from timegrid.llm import lines, packing, rules, sharding, suffix
from timegrid.llm.queries import TOKENIZER

from .conftest import hand_made


def sharded(docs, n, **more):
    return sharding.shard_documents(docs, [1.0] * n, **more).collect()


def test_shards_follow_the_key_alone(docs, given_docs):
    got = sharded(docs, 40)
    texts = dict(given_docs)
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40)
    grown = {r["doc_id"]: r["shard"] for r in sharded(docs, 41)}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    assert 0 < sum(r["grown_shard"] == 40 for r in got) < 20


def test_slots_have_no_gaps(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        by = defaultdict(list)
        for r in sharded(df, 7):
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharded(no_docs, 7) == []


def test_odd_rows_are_sharded(odd_docs):
    got = sharded(odd_docs, 5)
    assert len(got) == len(hand_made())
    shards = defaultdict(set)
    for r in got:
        shards[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(16, 0)}


def test_weights_share_keys(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = Counter(r["shard"] for r in sharding.rendezvous(keys, [1.0, 2.0, 5.0]).collect())
    assert [round(n[s] / 20000, 2) for s in range(3)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.02)
    fewer = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(keys, [1.0, 2.0]).collect()}
    for r in sharding.rendezvous(keys, [1.0, 2.0, 5.0]).collect():
        assert r["shard"] in (2, fewer[r["doc_id"]])
    with pytest.raises(ValueError):
        sharding.rendezvous(keys, [1.0, 0.0])


def token_rows(texts, size=2048):
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    out = []
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            out.append((doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=repr)


def check_packing(got, texts, limits=packing.Limits()):
    assert sorted([tuple(r)[:5] for r in got], key=repr) == token_rows(texts, limits.tokens)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(v) <= limits.documents and sum(n * n for _, n in v) <= limits.cost
    return len(bins)


def test_packing_given(docs, given_docs):
    got = packing.pack(docs, TOKENIZER).collect()
    n = check_packing(got, given_docs)
    assert n <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_odd_rows_and_limits(odd_docs, no_docs):
    texts = [r[:2] for r in hand_made()]
    for limits in (packing.Limits(), packing.Limits(64, 3, 4096), packing.Limits(64, 2, 5000)):
        check_packing(packing.pack(odd_docs, TOKENIZER, limits).collect(), texts, limits)
        check_packing(packing.pack(odd_docs, TOKENIZER, limits, rule="dot").collect(), texts, limits)
    assert packing.pack(no_docs, TOKENIZER).collect() == []


def test_best_fit_on_many_shapes():
    r = np.random.default_rng(5)
    for limits in (packing.Limits(), packing.Limits(100, 4, 10000), packing.Limits(100, 100, 12000)):
        for rule in ("norm", "dot"):
            counts = Counter(r.integers(1, limits.tokens + 1, 3000).tolist()) + Counter(r.integers(1, 20, 3000).tolist())
            bins, ranks = defaultdict(list), defaultdict(set)
            for length, rank, n, first, offset in packing.best_fit(counts, limits, rule=rule).tolist():
                for i in range(n):
                    bins[first + i].append((offset, length))
                    assert rank + i not in ranks[length]
                    ranks[length].add(rank + i)
            assert {k: len(v) for k, v in ranks.items()} == dict(counts)
            for v in bins.values():
                assert sum(n for _, n in v) <= limits.tokens and len(v) <= limits.documents and sum(n * n for _, n in v) <= limits.cost
    with pytest.raises(ValueError):
        packing.best_fit({101: 1}, packing.Limits(100))


def test_token_memo_equals_the_tokenizer():
    t = packing.TokenIds(public_tokenizers.path("word_bpe_49k.json"), 12)
    odd = "It's we'll İstanbul ΣΑΣ <|endoftext|> é ² ½ 12 á́ x y \x1c z×÷ µª <b> I'LL 'S ÀÉ ŒÆ ǅ 日本 🙂 a<|startoftext|>b"
    plain = "It's we'LL 12 z÷ÀÉ×ß, o'clock--don't\tX\r\n'S  'd9'  ÿÑ!?~ "
    for text in (odd, " ".join(odd.split() * 3), "", " ", "\n", plain, plain * 5):
        assert t.of(text) == struct.pack(f"<{len(t.of(text)) // 4}I", *t.tokenizer.encode(text, add_special_tokens=False).ids)


def line_rows(texts):
    owner = {}
    split = [(lines.NO_ID if i is None else i, i, (t or "").split("\n")) for i, t in texts]
    for d, _, parts in split:
        for x in parts:
            if len(k := lines.line_key(x)) >= 10:
                owner[k] = min(d, owner.get(k, d))
    out = []
    for d, i, parts in split:
        kept = [x for x in parts if len(k := lines.line_key(x)) < 10 or owner[k] == d]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(docs, given_docs, odd_docs, no_docs, batches):
    for df, texts in ((docs, given_docs), (odd_docs, [r[:2] for r in hand_made()])):
        want = sorted([(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in line_rows(texts)], key=repr)
        assert sorted(map(tuple, lines.line_digests(df, batches).collect()), key=repr) == want
        out = lines.dedup_lines(df, batches)
        assert out.columns == df.columns
        assert sorted([(r["doc_id"], r["text"] or "") for r in out.collect()], key=repr) == sorted([(i, t) for i, _, _, t in line_rows(texts)], key=repr)
    assert lines.line_digests(no_docs, batches).collect() == []


def test_line_index_compacts(spark):
    index = lines.LineIndex(spark, fanout=2)
    for i in range(5):
        keys = spark.createDataFrame([(i, bytes([i])), (i, b"all")], "doc long, key binary")
        assert [bytes(r["key"]) for r in index.add(keys).collect()] == ([] if i == 0 else [b"all"])
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert sum(run.filter("old is null").count() for level in index.levels for run in level) == 6
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("timegrid_run_")]


def substring_rows(texts, length):
    data = [(t or "").encode() for _, t in texts]
    n = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if n[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, given_docs, odd_docs, no_docs):
    assert sorted(map(tuple, suffix.digests(docs).collect()), key=repr) == substring_rows(given_docs, 200)
    odd = [r[:2] for r in hand_made()]
    assert sorted(map(tuple, suffix.digests(odd_docs).collect()), key=repr) == substring_rows(odd, 200)
    for length, block, bucket in ((165, 300, 50), (333, 1000, 10000)):
        got = suffix.remove_repeats(odd_docs, length, block, bucket).collect()
        found = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got]
        assert sorted(found, key=repr) == substring_rows(odd, length)
    assert suffix.digests(no_docs).collect() == []
    with pytest.raises(ValueError):
        suffix.remove_repeats(odd_docs, 150)


def test_cover_meets_every_distance():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def base_counts(text):
    text = text or ""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    twice = set()
    for k in range(len(words) - 7):
        if grams[tuple(words[k : k + 8])] > 1:
            twice |= set(range(k, k + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice), failed


def test_quality_counts(docs, given_docs, odd_docs, no_docs, tables):
    trusted = rules.trusted_ids(tables("labels"))
    for df, texts in ((docs, given_docs), (odd_docs, [r[:2] for r in hand_made()])):
        got = rules.judge(df, trusted).collect()
        assert sorted([(r["doc_id"], *tuple(r)[1:7]) for r in got], key=repr) == sorted([(i, *base_counts(t)) for i, t in texts], key=repr)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert rules.judge(no_docs, trusted).collect() == []
    empty = rules.judge(odd_docs, trusted.limit(0)).collect()
    assert all(r["llr"] == 0 and r["kept"] == (not r["base_failed"]) for r in empty)
    assert rules.filter_quality(odd_docs, tables("labels")).columns == odd_docs.columns


def test_llr_follows_its_formula(spark):
    rows = [(i, "good words here " * 50) for i in range(40)] + [(i, "### bad *** " * 50) for i in range(40, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (999,), (0,)], "doc_id long")
    table = rules.ratios(df, trusted)
    hashes = rules.WordHashes()
    raw, target = Counter(), Counter()
    for i, t in rows:
        grams = rules.ngram_buckets(t, hashes).tolist()
        raw.update(grams)
        if i < 30:
            target.update(grams)
    scale = sum(target.values()) / sum(raw.values())
    smooth = 10 * rules.ENOUGH / sum(target.values())
    for b, n in raw.items():
        assert table[b] == pytest.approx(np.log((target[b] + smooth) / (n * scale + smooth)))


def test_ids_of_another_width(odd_docs):
    narrow = odd_docs.withColumn("doc_id", odd_docs["doc_id"].cast("int"))
    assert packing.pack(narrow, TOKENIZER).count() >= narrow.count()
    assert lines.line_digests(narrow).count() == suffix.digests(narrow).count() == narrow.count()
