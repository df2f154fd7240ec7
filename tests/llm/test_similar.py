"""Near copies, passages and leaks against brute force on the given documents and on planted cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from timegrid.llm import align, decontam, graph, omh, windows
from timegrid.llm.common import WordHashes, plain_bytes, plain_words

from .conftest import DATA, hand_made


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(3)
    for _ in range(800):
        a = [r.randrange(4) for _ in range(r.randrange(25))]
        b = list(a) if r.random() < 0.6 else [r.randrange(4) for _ in range(r.randrange(25))]
        for _ in range(r.randrange(6)):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(4))
        d = plain_distance(a, b)
        for band in (0, 1, 2, 5, 30):
            assert align.banded_distance(a, b, band) == min(d, band + 1)
        s = 1 - d / max(1, len(a), len(b))
        assert align.edit_similarity(np.array(a), np.array(b), 0.7) == pytest.approx(s if s >= 0.7 - 1e-9 else 0)


def test_order_minhash_knows_order_and_repeats():
    h = WordHashes()
    words = [f"w{i}".encode() for i in range(200)]
    same = lambda a, b: int((omh.order_minhash(h.of(a)) == omh.order_minhash(h.of(b))).sum())
    assert same(words, words) == omh.SKETCHES
    assert same(words, words[:100] + [b"new"] + words[100:]) > omh.SKETCHES // 2
    assert same(words, words[100:] + words[:100]) < omh.SKETCHES * 0.8
    assert same([b"a"] * 30, [b"a"] * 120) < omh.SKETCHES // 2
    assert len(omh.order_minhash(h.of(words[:4]))) == 0 and len(omh.order_minhash(h.of(words[:5]))) == omh.SKETCHES


def roots(links, every):
    up = {x: x for x in every}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in every}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    df = spark.createDataFrame([*links, (7, None), (None, 7)], "a long, b long")
    got = {r["id"]: r["class"] for r in graph.components(df).collect()}
    want = roots(links, {x for p in links for x in p if p[0] != p[1]})
    assert got == want
    assert graph.components(df.limit(0)).count() == 0


def brute_classes(texts):
    words = {i: plain_words(t) for i, t in texts}
    numbers = {}
    arrays = {i: np.array([numbers.setdefault(x, len(numbers)) for x in w], np.uint32) for i, w in words.items()}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 4):
            holders[tuple(w[k : k + 5])].add(i)
    pairs = {(min(a, b), max(a, b)) for v in holders.values() for a in v for b in v if a != b}
    links = [(a, b) for a, b in pairs if align.edit_similarity(arrays[a], arrays[b], 0.8) >= 0.8]
    by_words = defaultdict(list)
    for i, w in words.items():
        if w:
            by_words[tuple(w)].append(i)
    links += [(v[0], x) for v in by_words.values() for x in v[1:]]
    return roots(links, words)


def test_near_copies(docs, given_docs):
    got = omh.near_copies(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(given_docs)
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["n_documents"] == sizes[r["class_id"]] for r in got)
    kept = omh.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(sizes)


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    got = omh.near_copies(odd_docs).collect()
    assert len(got) == len(hand_made())
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    # the long text's copies, one edited, and the row of it without an id are one class
    null_class = {r["class_id"] for r in got if r["doc_id"] is None}
    assert by[1] == by[2] == by[6] and by[1] in null_class | {by[1]}
    assert len({by[3], by[4], by[5], by[7], by[14]}) == 5
    kept = omh.drop_near_copies(odd_docs).collect()
    assert len(kept) == len({r["class_id"] for r in got})
    assert omh.near_copies(no_docs).collect() == [] and omh.drop_near_copies(no_docs).collect() == []


def test_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(4):
            w[r.randrange(120)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(80)) + " " + " ".join(base[:30])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(x["class_id"] for x in omh.near_copies(df).collect())
    assert got[0] == 300 and len(got) == 101


def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch):
    """All texts share a template of 78 % of their words, and pairs at 0.81 share with each other single words beyond it:
    no sketch tells these from the rest."""
    monkeypatch.setattr(omh, "TILE", 128, raising=False)
    r = random.Random(21)
    word = lambda: f"w{r.randrange(10**6)}"
    template = [word() for _ in range(156)]
    rows = [template + [word() for _ in range(44)] for _ in range(600)]
    rows += [[x if at < 156 or at % 7 == 0 else word() for at, x in enumerate(w)] for w in rows[:30]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: x["class_id"] for x in omh.near_copies(df).collect()} == {i: i if i < 600 else i - 600 for i in range(630)}


def test_pairs_of_a_large_bucket_are_no_rows(spark, monkeypatch):
    """Texts a tenth of whose words are changed share sketches but lie about the threshold: but for pairs with a
    bucket's first, theirs are aligned where they are made and in no table, and links are fewer than texts."""
    r = random.Random(33)
    base = [f"w{i}" for i in range(100)]
    texts = [[f"n{r.randrange(10**6)}" if r.random() < 0.12 else w for w in base] for _ in range(120)]
    made = {}

    def counted(df, name, *args, stage=omh.staged, **kwargs):
        out = stage(df, name, *args, **kwargs)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(omh, "staged", counted)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in omh.near_copies(df).collect()}
    assert got == brute_classes([(i, " ".join(w)) for i, w in enumerate(texts)])
    assert len(made["pairs"]) == 1 and made["links"][-1] < len(texts) and 0 < made["met"][0] <= 64 * len(texts)


def test_bags_spare_unlike_long_texts_and_lose_no_link():
    """Texts whose words fill few bins alike; among them near copies, and some of words that go beyond a bin's count."""
    r = np.random.default_rng(3)
    words = [r.choice(5000, n).astype(np.uint64) for n in (1500, 1520, 1480, 3000, 2900, 1100, 1000, 4090, 4100, 17000) for _ in range(3)]
    words.append(np.where(r.random(4300) < 0.6, 7, r.choice(5000, 4300)).astype(np.uint64))
    words += [np.where(r.random(len(w)) < 0.15, 6000 + len(w), w)[: len(w) - len(w) // 50].astype(np.uint64) for w in words]
    words.sort(key=len)
    n, ids = np.array([len(w) for w in words], np.int32), np.arange(len(words))
    bags = [omh.bag_of(omh.mixed(w)) for w in words]
    zero = np.zeros(len(words), np.int64)
    rows = (zero, zero, zero, zero, ids, n, ids, np.array(bags, object), omh._coarse(bags))
    got = {p for batch in omh._pairs(rows, 0.8) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    near = [(a, b) for b in range(len(words)) for a in range(b) if omh.edit_similarity(words[a], words[b], 0.8) >= 0.8]
    assert len(near) >= 31 and set(near) <= got and len(got) < 2 * len(near)
    alike = [(a, b) for b in range(len(words)) for a in range(b) if n[b] - n[a] <= int(0.2 * n[b])]
    coarse = [(a, b) for a, b in alike if np.abs(rows[8][a].astype(int) - rows[8][b]).sum() <= 2 * int(0.2 * n[b] + 1e-9) - (n[b] - n[a])]
    assert len(coarse) > 4 * len(got)  # what BINS bins alone would have aligned


def test_near_copies_among_texts_of_one_template(spark):
    """A third of all rows hold a template of 78 % of their words; pairs at 0.90 among them are found."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**6)}"
    template = [word() for _ in range(156)]
    rows, pairs = [], []
    for i in range(500):
        own = [word() for _ in range(44)]
        rows.append(template + own)
        if i < 60:
            near = rows[-1][:]
            for at in r.sample(range(200), 20):
                near[at] = word()
            pairs.append((len(rows) - 1, len(rows)))
            rows.append(near)
    rows += [[word() for _ in range(100)] for _ in range(2 * len(rows))]
    order = list(range(len(rows)))
    r.shuffle(order)
    df = spark.createDataFrame([(order[i], " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in omh.near_copies(df).collect()}
    assert sum(got[order[a]] == got[order[b]] for a, b in pairs) >= 0.98 * len(pairs)


@pytest.mark.parametrize("n", [30, 100, 300])
def test_sketches_find_scattered_edits_at_the_stated_similarity(n):
    r, found = np.random.default_rng(5), 0
    sketched = lambda w: np.concatenate([omh.order_minhash(w), omh.single_minhash(w)])
    for _ in range(200):
        a = r.integers(1, 1 << 62, n).astype(np.uint64)
        b, k = a.copy(), n // 5
        b[r.choice(n, k, replace=False)] = r.integers(1, 1 << 62, k).astype(np.uint64)
        found += bool((sketched(a) == sketched(b)).any())
    assert found >= 199


def test_window_minima():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, width = int(r.integers(0, 60)), int(r.integers(1, 9))
        h = r.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1 << 63)
        if n:
            h[r.integers(0, n, 2)] = 0
        at, inside = windows.window_minima(h, width)
        for s in range(n - width + 1):
            assert inside[s] == (h[s : s + width] > 0).all()
            assert not inside[s] or at[s] == s + np.argmin(h[s : s + width])


def test_text_words_are_plain_words():
    texts = [t or "" for _, t, *_ in hand_made()] + ["", "É ß_1", "a,b..C"]
    hashes, sizes = windows.text_words([plain_bytes(t.encode()) for t in texts])
    words = [plain_words(t) for t in texts]
    assert sizes.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_passages_of_a_pair():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 10**6, 400).astype(np.uint32), r.integers(0, 10**6, 500).astype(np.uint32)
    b[300:380] = a[20:100]
    b[100:160] = a[200:260]
    b[130] = 7
    found = sorted(windows.passages(a, b))
    assert [(x[:4]) for x in found] == [(20, 100, 300, 380), (200, 260, 100, 160)]
    assert windows.passages(a[:49], a[:49]) == [] and windows.passages(a, a) == [(0, 400, 0, 400, 1.0)]


def test_near_passages(docs, given_docs, no_docs):
    got = windows.near_passages(docs).collect()
    words = {i: plain_words(t) for i, t in given_docs}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    up = roots([(r["doc_id"], r["other_id"]) for r in got], words)
    for v in holders.values():
        assert len({up[i] for i in v}) == 1
    for r in got:
        a, b = words[r["doc_id"]][r["start"] : r["end"]], words[r["other_id"]][r["other_start"] : r["other_end"]]
        best = 1 - plain_distance(a, b) / max(len(a), len(b))
        assert min(len(a), len(b)) >= 50 and 0.8 <= r["similarity"] <= best + 1e-9 and best - r["similarity"] < 0.05
    assert windows.near_passages(no_docs).collect() == []


def test_near_passages_of_odd_rows(odd_docs):
    got = windows.near_passages(odd_docs).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == {1, 2, 6, 8, None}
    assert sum(r["copy"] for r in got) == 3


def test_planted_passages(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**7)}"
    passage = [word() for _ in range(55)]
    rows, held = [], set()
    for i in range(200):
        w = [word() for _ in range(r.randrange(60, 300))]
        if i % 3 == 0:
            p = list(passage)
            if i % 2:
                p[r.randrange(20, 35)] = word()
            at = r.randrange(len(w))
            w[at:at] = p
            held.add(i)
        rows.append((i, " ".join(w)))
    got = windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {x["doc_id"] for x in got} | {x["other_id"] for x in got}
    assert found <= held and len(found) >= 0.97 * len(held)


@pytest.mark.parametrize("n, similarity", [(55, 0.89), (55, 0.85), (55, 0.8), (80, 0.8)])
def test_passages_near_the_stated_similarity_share_a_name(n, similarity):
    r, search, found = np.random.default_rng(3), windows.Search(4), 0
    some = lambda m: r.integers(1, 1 << 62, m).astype(np.uint64)
    for _ in range(200):
        p = some(n)
        q, k = p.copy(), round((1 - similarity) * n)
        q[r.choice(n, k, replace=False)] = some(k)
        a, b = np.concatenate([some(40), p, some(40)]), np.concatenate([some(60), q, some(30)])
        names, doc, *_ = search._windows(np.concatenate([a, b]), np.array([len(a), len(b)]))
        found += bool(len(np.intersect1d(names[doc == 0], names[doc == 1])))
    assert found >= 194


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@pytest.mark.parametrize(("n", "least"), [(50, 0.9), (55, 0.93), (80, 0.97)])
def test_functions_agree_on_passages_at_the_stated_similarity(n, least):
    r, search, found = np.random.default_rng(7), windows.Search(4), 0
    for _ in range(200):
        base = r.integers(1, 1 << 62, n).astype(np.uint64)
        near = base.copy()
        near[r.choice(n, n // 5, replace=False)] = r.integers(1, 1 << 62, n // 5)
        names = []
        for p in (base, near):
            w = np.concatenate([r.integers(1, 1 << 62, 40), p, r.integers(1, 1 << 62, 40)]).astype(np.uint64)
            names.append(set(search._windows(w, np.array([len(w)]))[0].tolist()))
        found += len({k >> 32 & 15 for k in names[0] & names[1]}) >= windows.AGREE
    assert found >= least * 200


def linked(found, every):
    return roots([(x["doc_id"], x["other_id"]) for x in found], every)


def test_all_pairs_that_share_a_passage_are_linked(docs, given_docs):
    """Against every pair of texts with eight shingles or more in common."""
    numbers = {}
    words = {i: np.array([numbers.setdefault(x, len(numbers)) for x in plain_words(t)], np.uint32) for i, t in given_docs}
    holders, common = defaultdict(set), Counter()
    for i, w in words.items():
        for k in range(len(w) - 4):
            holders[w[k : k + 5].tobytes()].add(i)
    for v in holders.values():
        common.update((a, b) for a in v for b in v if a < b)
    pairs = [p for p, n in common.items() if n >= 8 and windows.passages(words[p[0]], words[p[1]])]
    root = linked(windows.near_passages(docs).collect(), words)
    assert len(pairs) > 10 and sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_interleaved_groups_that_share_a_phrase(spark):
    """Pairs of texts with a passage of their own, all with one phrase in common, in any order."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase, rows, pairs = [word() for _ in range(20)], [], []
    for g in range(60):
        own = [word() for _ in range(60)]
        for side in (0, 1):
            near = [word() if side and k % 12 == 5 else w for k, w in enumerate(own)]
            rows.append((g + 60 * side, " ".join([word() for _ in range(r.randrange(30))] + phrase + near + [word() for _ in range(20)])))
        pairs.append((g, g + 60))
    root = linked(windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), range(120))
    assert sum(root[a] == root[b] for a, b in pairs) == len(pairs)


def test_passages_that_neither_the_first_text_nor_a_neighbour_resembles(spark):
    """Two texts share a passage; all others hold its phrases in other orders, so that they have its names and no passage."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    pieces = [passage[k : k + 20] for k in range(0, 100, 10)]

    def mixture():
        return " ".join(w for p in r.sample(pieces, len(pieces)) for w in [*p, *(word() for _ in range(14))])

    held = lambda: " ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))])
    texts = [*(mixture() for _ in range(40)), held(), *(mixture() for _ in range(40)), held()]
    got = windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert {(x["doc_id"], x["other_id"]) for x in got} == {(81, 40)}


def test_smith_waterman():
    r = np.random.default_rng(1)
    items = [r.integers(5, 9, r.integers(3, 12)).astype(np.uint64) for _ in range(60)]
    texts = [r.integers(5, 9, r.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    best, _ = decontam.smith_waterman(decontam._pad(items, 12, 0), decontam._pad(texts, 25, 1))
    assert best.tolist() == [plain_smith_waterman(a, b) for a, b in zip(items, texts, strict=True)]


def test_leaks_match_brute_force(spark, given_docs, tables):
    items = [(r["item_id"], r["text"]) for r in tables("benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(spark.read.parquet(f"{DATA}/documents.parquet"), tables("benchmark")).collect()}
    numbers = {}
    code = lambda t: np.array([numbers.setdefault(w, len(numbers) + 5) for w in plain_words(t)], np.uint64)
    coded = [(i, code(t)) for i, t in items]
    want = {}
    for d, t in given_docs:
        text = code(t)
        some = [(i, w) for i, w in coded if len(w) >= 3 and len(np.intersect1d(w, text)) >= 0.5 * len(set(w.tolist()))]
        for i, w in some:
            best, _ = decontam.smith_waterman(w[None], text[None])
            if best[0] / (2 * len(w)) >= 0.6:
                want[d, i] = best[0] / (2 * len(w))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_edited_leaks_in_a_third_of_all_rows(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(25))) for i in range(30)] + [(None, None), (99, "of the"), (98, "")]
    rows, held = [], set()
    for i in range(300):
        w = [word() for _ in range(r.randrange(30, 200))]
        if i % 3 == 0:
            p = items[i % 30][1].split()
            for _ in range(3):
                p[r.randrange(25)] = word()
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in p]
            held.add((i, i % 30))
        rows.append((i, " ".join(w)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_WORDS, 200):
        got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(df, bench, block_words=block).collect()}
        assert got == held
    kept = decontam.drop_leaks(df, bench)
    assert {x["doc_id"] for x in kept.collect()} == set(range(300)) - {i for i, _ in held}


def test_passages_of_items_leak(spark):
    """Passages below the threshold's share of their items; one of them in a third of all documents."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (56, 300, 60)]
    parts = [items[0][:30], items[1][100:250], items[2][30:56]]
    edited = items[1][20:70]
    for at in (5, 17, 30, 41):
        edited[at] = word()
    rows, held = [], set()
    for i in range(150):
        w = [word() for _ in range(r.randrange(30, 200))]
        k = 2 if i % 3 == 0 else {1: 0, 2: 1, 4: 3}.get(i)
        if k is not None:
            w[10:10] = [*parts, edited][k]
            held.add((i, [0, 1, 2, 1][k]))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == held
    first = next(x for x in got if x["doc_id"] == 1)
    assert (first["start"], first["end"]) == (10, 40)


def test_leaks_of_odd_rows(odd_docs, no_docs, tables):
    assert decontam.leaks(odd_docs, tables("benchmark")).collect() == []
    assert decontam.leaks(no_docs, tables("benchmark")).collect() == []
    assert decontam.leaks(odd_docs, tables("benchmark").limit(0)).collect() == []
    assert decontam.drop_leaks(odd_docs, tables("benchmark")).count() == len(hand_made())
