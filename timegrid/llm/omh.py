"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timegrid.llm.align import edit_similarity
from timegrid.llm.common import MULT, TEXTS, WordHashes, as_long, chunks, columns_of, drop_staged, identity, mixed, plain_words, shingles, staged, whole_row
from timegrid.llm.graph import components

K, SKETCHES, MINIMA, SIMILARITY = 5, 24, 2, 0.8
#: Sketches of a single k-mer each, and its words: they find pairs whose edits are scattered, or whose own part is small.
SINGLES, SINGLE_K = 40, 3
#: A text's words are counted in bins, a byte each: bags too unlike tell of too many edits. Bins are the least power of two
#: with BIN_WORDS words a bin or fewer, within these bounds; a bag of more bins folds to one of fewer.
BINS, MOST_BINS, BIN_WORDS = 64, 4096, 4
#: Rows of a bucket that one task compares with each other, or with as many others.
TILE = 2048
#: And words, of those whose words it holds.
TILE_WORDS = 4 << 20
#: Pairs that a task holds before it gives them.
PAIRS = 1 << 20
#: Counts that it compares at a time.
FOLDED = 4 << 20
#: Odd multipliers that order the labelled k-mers differently for each sketch.
ORDERS = mixed(np.arange(1, 65, dtype=np.uint64) * MULT) | np.uint64(1)
SINGLE_ORDERS = mixed(np.arange(65, 65 + SINGLES, dtype=np.uint64) * MULT) | np.uint64(1)


def words_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(plain_words(text))


def order_minhash(words: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Sketches of a word sequence: each joins, in text order, the MINIMA k-mers that its hash puts first.

    K-mers are labelled by occurrence, the first, second ... of equal ones, so that repeats count. A text of fewer than K
    words has none.
    """
    grams = shingles(words, K)
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    grams[order] = mixed(ranked + nth.astype(np.uint64) * MULT)
    pairs = np.zeros((2, sketches), np.uint64)
    for i in range(sketches):
        h = grams * ORDERS[i]
        first = int(h.argmin())
        if n > 1:
            low = h[first]
            h[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second = int(h.argmin())
            h[first] = low
            a, b = min(first, second), max(first, second)
            pairs[:, i] = grams[a], grams[b]
        else:
            pairs[1, i] = grams[first]
    return mixed(pairs[0] * MULT + pairs[1] + np.arange(sketches, dtype=np.uint64) * ORDERS[63])


def single_minhash(words: np.ndarray) -> np.ndarray:
    """Sketches of a word sequence: each the SINGLE_K-mer that its hash puts first. A text of fewer words has none."""
    grams = shingles(words, SINGLE_K)
    if not len(grams):
        return grams
    least = np.array([(grams * order).min() for order in SINGLE_ORDERS], np.uint64)
    return mixed(least + np.arange(1, SINGLES + 1, dtype=np.uint64) * ORDERS[62])


def folded(bags: np.ndarray, bins: int) -> np.ndarray:
    """Bags (rows of counts up to 255) as bags of so many bins. Folding a capped bag gives what capping a folded one does."""
    return bags.reshape(len(bags), -1, bins).sum(1, dtype=np.int32).clip(max=255).astype(np.uint8)


def bag_of(words: np.ndarray) -> bytes:
    """How many words fall in each bin, 255 standing for more too."""
    bins = BINS
    while bins < MOST_BINS and bins * BIN_WORDS < len(words):
        bins *= 2
    return np.bincount((words % np.uint64(bins)).astype(np.int64), minlength=bins).clip(max=255).astype(np.uint8).tobytes()


def _coarse(bags: list[bytes]) -> np.ndarray:
    """Bags of any size as rows of BINS counts."""
    out, size = np.empty((len(bags), BINS), np.uint8), np.array([len(b) for b in bags])
    for bins in np.unique(size):
        at = np.flatnonzero(size == bins)
        out[at] = folded(np.frombuffer(b"".join([bags[i] for i in at]), np.uint8).reshape(len(at), bins), BINS)
    return out


def _sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in chunks(it):
        digests, sketches, sizes, bags = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text, hashes)
            digests.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
            sketches.append(as_long(np.concatenate([order_minhash(words), single_minhash(words)])))
            sizes.append(len(words))
            bags.append(bag_of(words))
        cols = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(bags, pa.binary())]
        yield pa.record_batch(cols, names=["id", "digest", "sketch", "n", "bag"])


def _alike(m: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Whether the lengths alone let two texts be similar enough."""
    longest = np.maximum(m, n)
    return np.abs(m - n) <= ((1 - least) * longest + 1e-9).astype(np.int64)


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, id, n) of a partition sorted by key and id that share their key, each with the first of them.

    edge marks the first rows of the partition's first and last key, which may go on in other partitions: these are given
    even if they are alone.
    """
    lead = held = None  # the last key's first row; and that row, while no other has been seen
    key = None
    at_first = True
    names = ["key", "id", "n", "leader", "leader_n", "edge"]
    for batch in it:
        if not batch.num_rows:
            continue
        keys, ids, n = (np.asarray(batch.column(c)) for c in ("key", "id", "n"))
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        goes_on = np.append(new[1:], False) == 0  # the next row has the same key; unknown of the last row
        leader, leader_n = np.empty(len(ids), np.int64), np.empty(len(ids), np.int32)
        own = run >= 0
        leader[own], leader_n[own] = ids[starts[run[own]]], n[starts[run[own]]]
        if not own.all():
            leader[~own], leader_n[~own] = lead
        keep = ~new | goes_on
        keep[-1] &= not new[-1]
        edge = np.zeros(len(ids), bool)
        if at_first:
            keep[0] = edge[0] = True
            at_first = False
        cols = [batch.column("key"), batch.column("id"), batch.column("n"), pa.array(leader), pa.array(leader_n), pa.array(edge)]
        out = pa.record_batch(cols, names=names)
        if held is not None and not new[0]:
            yield held
            held = None
        elif held is not None:
            held = None
        yield out.filter(pa.array(keep))
        if new[-1]:
            held = None if keep[-1] else out.slice(len(ids) - 1)
        key, lead = keys[-1], (leader[-1], leader_n[-1])
    if held is not None:
        yield held.set_column(5, "edge", pa.array([True]))
    elif key is not None:
        # the last key's first row once more, as the one that stands for this partition
        cols = ([key], [lead[0]], [lead[1]], [lead[0]], [lead[1]], [True])
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _pairs(rows: tuple, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows of one group whose classes differ, but for those whose lengths or bags alone make them too unlike.

    rows: key, lo, hi, tile, id, n, class, bags and these in BINS bins, whole groups of (key, lo, hi), in order of these
    and n. All pairs are judged by BINS bins, and those left once each by all bins that both have.
    """
    key, lo, hi, tile, ids, n, kind, bags, coarse = rows
    new = np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    most = ((1 - least) * n + 1e-9).astype(np.int64)
    found, back, at = [], 1, np.flatnonzero(place)
    while len(at):
        # a group's lengths ascend: a row too long for the one so far before it is too long for all before that
        at = at[_alike(n[at - back], n[at], least)]
        y = at[(kind[at - back] != kind[at]) & ((lo[at] == hi[at]) | (tile[at - back] != tile[at]))]
        x = y - back
        # an edit that keeps the length changes two counts by one, another edit one
        apart = np.abs(coarse[x].astype(np.int16) - coarse[y]).sum(axis=1)
        k = apart <= 2 * most[y] - (n[y] - n[x])
        found.append(np.stack([np.minimum(ids[x[k]], ids[y[k]]), np.maximum(ids[x[k]], ids[y[k]]), x[k], y[k]]))
        if sum(f.shape[1] for f in found) > PAIRS:
            yield _distinct(found, n, most, bags)
            found = []
        back += 1
        at = at[place[at] >= back]
    if found:
        yield _distinct(found, n, most, bags)


def _distinct(found: list[np.ndarray], n: np.ndarray, most: np.ndarray, bags: np.ndarray) -> pa.RecordBatch:
    """Of pairs (a, b, rows x and y, y the longer) each (a, b) once, if its bags are like enough."""
    a, b, x, y = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    order = order[np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(order)]]
    a, b, x, y = a[order], b[order], x[order], y[order]
    size = np.array([len(bag) for bag in bags])
    bins, alike = np.minimum(size[x], size[y]), np.ones(len(x), bool)
    for each in np.unique(bins[bins > BINS]):
        of = np.flatnonzero(bins == each)
        rows, at = np.unique(np.stack([x[of], y[of]]), return_inverse=True)
        table = np.concatenate([folded(np.frombuffer(bags[r], np.uint8)[None], int(each)) for r in rows])
        at = at.reshape(2, -1)
        step = max(1, FOLDED // int(each))
        for lo in range(0, len(of), step):
            k = of[lo : lo + step]
            apart = np.abs(table[at[0, lo : lo + step]].astype(np.int16) - table[at[1, lo : lo + step]]).sum(axis=1)
            alike[k] = apart <= 2 * most[y[k]] - (n[y[k]] - n[x[k]])
    return pa.record_batch([pa.array(a[alike]), pa.array(b[alike])], names=["a", "b"])


def _groups(it: Iterator[pa.RecordBatch], *more: str) -> Iterator[list[np.ndarray]]:
    """The columns key, lo, hi, tile, id, n, class and, as objects, `more` of a partition's rows, sorted by key, lo, hi and n,
    a few whole groups at a time."""
    held = None
    for batch in it:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in ("key", "lo", "hi", "tile", "id", "n", "class")]
        rows += [np.array([*batch.column(c).to_pylist(), None], object)[:-1] for c in more]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        key, lo, hi = rows[:3]
        last = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held is not None:
        yield held


def _met(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The rows (key, id, n, class) that are in a pair of _pairs: no more than there are rows, however many pairs."""
    for key, lo, hi, tile, ids, n, kind, bags in _groups(it, "bag"):
        met = np.zeros(len(ids), bool)
        for pairs in _pairs((key, lo, hi, tile, np.arange(len(ids)), n, kind, bags, _coarse(bags)), least):
            for rows in pairs.columns:
                met[np.asarray(rows)] = True
        yield pa.record_batch([pa.array(x[met]) for x in (key, ids, n, kind)], names=["key", "id", "n", "class"])


def _linked(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows with their words that join the classes of _pairs as all links of these would.

    A pair whose classes the task has joined already is not aligned, so links are fewer than classes. Of the groups that
    a pair is in, that of the least key which both have (`keys`: all keys that a row is given with) judges it.
    """
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    for key, lo, hi, tile, ids, n, kind, keys, words in _groups(it, "keys", "words"):
        words, keys, found = [np.frombuffer(w, "<u4") for w in words], [frozenset(k) for k in keys], []
        bags = np.array([*map(bag_of, words), None], object)[:-1]
        for pairs in _pairs((key, lo, hi, tile, np.arange(len(ids)), n, kind, bags, _coarse(bags)), least):
            for x, y in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
                p, q = top(int(kind[x])), top(int(kind[y]))
                if p == q or min(keys[x] & keys[y]) != key[x]:
                    continue
                if _share_words(words[x], words[y], least) and edit_similarity(words[x], words[y], least) >= least:
                    root[max(p, q)] = min(p, q)
                    found.append((ids[x], ids[y]))
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def _share_words(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether a and b have so many words in common, whatever their order, that their edit similarity may be `least`."""
    longest = max(len(a), len(b))
    every = np.concatenate([a, b])
    every.sort()
    # of the words of both, each step from one to an unequal one parts two kinds
    kinds = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
    word = every[kinds[:-1]]
    total = np.diff(kinds)
    ordered = np.sort(a)
    in_a = np.searchsorted(ordered, word, "right") - np.searchsorted(ordered, word, "left")
    return int(np.minimum(in_a, total - in_a).sum()) >= longest - int((1 - least) * longest + 1e-9)


def _aligned(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(it, "y"):
        found = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            found.append(_share_words(x, y, least) and edit_similarity(x, y, least) >= least)
        yield pa.record_batch([c.filter(pa.array(found, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def _as_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in chunks(it):
        words = [words_of(t, hashes).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("id"), pa.array(words, pa.binary())], names=["id", "words"])


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose word sequences align well enough; staged."""
    left = words.select(F.col("id").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("id").alias("b"), F.col("words").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return staged(both.mapInArrow(lambda it: _aligned(it, least), "a long, b long"), "links", rows=TEXTS)


def _candidates(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The bucket rows (key, id, n) of texts that share a sketch, and the pairs (a, b) of each with the first of its
    bucket; staged.

    One shuffle, by ranges of (key, id): a sketch that very many texts share is spread over many tasks, each with a first
    of its own, and these meet the first of all.
    """
    size = F.size("sketch")
    keys = texts.filter(size > 0).select(F.col("node").alias("id"), "n", F.explode("sketch").alias("key")).select("key", "id", "n")
    schema = "key long, id long, n int, leader long, leader_n int, edge boolean"
    rows = keys.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_buckets, schema)
    rows = staged(rows, "buckets")
    ends = rows.filter("edge").select("key", "id", "n")
    first = ends.groupBy("key").agg(F.min(F.struct("id", "n")).alias("l")).select("key", F.col("l.id").alias("leader"), F.col("l.n").alias("leader_n"))
    every = rows.select("leader", "leader_n", "id", "n").unionAll(ends.join(first, "key").select("leader", "leader_n", "id", "n"))
    longest = F.greatest("n", "leader_n")
    near = F.abs(F.col("n") - F.col("leader_n")) <= F.floor((1 - least) * longest + 1e-9)
    pairs = every.filter((F.col("leader") != F.col("id")) & near).select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))
    return rows.select("key", "id", "n"), staged(pairs.distinct(), "pairs")


def _dealt(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows (key, id, n and more), each key's dealt over its number of tiles; each two tiles meet in one group (key, lo, hi)."""
    rows = rows.join(tiles.hint("merge"), "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("tiles", "other")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "id")


def _apart(buckets: DataFrame, found: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The rows (key, id, n, class) of buckets that form a pair with another row of theirs whose class in `found` differs, if
    lengths and bags allow it; staged.

    A bucket's rows are dealt over tiles of about TILE rows, so that no task holds a large bucket.
    """
    rows = buckets.distinct().join(found.hint("merge"), "id", "left").select("key", "id", "n", F.coalesce("class", "id").alias("class"))
    rows = staged(rows, "classed")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("least"), F.max("class").alias("most"))
    many = many.filter("least != most").select("key", F.ceil(F.col("rows") / TILE).alias("tiles"))
    live = _dealt(rows.join(bags.hint("merge"), "id"), many)
    out = staged(live.mapInArrow(lambda it: _met(it, least), "key long, id long, n int, class long").distinct(), "met")
    drop_staged(rows)
    return out


def _joined(met: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the classes of the rows of _apart as all links of pairs of a bucket would; staged.

    Pairs are aligned where they are made, in tiles of about half of TILE rows and TILE_WORDS words, and never are rows of a table.
    """
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) * 2 / TILE), F.ceil(F.sum("n") / TILE_WORDS))
    many = met.groupBy("key").agg(tiles.alias("tiles"))
    keys = met.groupBy("id").agg(F.collect_list("key").alias("keys"))
    rows = met.join(keys.hint("merge"), "id").join(words.hint("merge"), "id")
    return staged(_dealt(rows, many).mapInArrow(lambda it: _linked(it, least), "a long, b long"), "links", rows=TEXTS)


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, class): each document's number and that of the first document of its class of near-copies; staged.

    Texts whose words (see plain_words) are equal are one text, that of their smallest
    number. Texts that share a sketch are candidates: SKETCHES Order MinHash sketches, and SINGLES of one SINGLE_K-mer each.
    First each text of a bucket is compared with the bucket's first, and then all pairs of a bucket whose classes still
    differ, however many: those whose lengths, or counts of words in bins, show that they are too unlike are not
    aligned, which loses none, nor are those whose classes a task has joined by then. So a sketch that very many texts of different classes share costs steps that grow with the
    square of their number, in tiles over many tasks. A pair is a
    link if the words' edit similarity is `least` or more, and classes are the components of links. Texts of fewer than
    SINGLE_K words have exact copies only; texts without any word are alone, each number for itself.

    A pair whose SINGLE_K-mers overlap by J shares none of the single sketches with a chance of about (1 - J) ** SINGLES:
    edits scattered at a similarity of 0.8 leave J near 0.34, and 5e-8. Where a template fills the buckets, J counts only
    the k-mers outside of it.
    """
    rows = docs.select(identity().alias("id"), "text")
    sketched = staged(rows.mapInArrow(_sketched, "id long, digest binary, sketch array<long>, n int, bag binary"), "sketches", rows=TEXTS)
    texts = sketched.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.first("bag").alias("bag"))
    texts = staged(texts, "texts")
    # staged, so that the join deals both sides anew and a large group of copies can be split
    same = sketched.filter("digest is not null").join(texts.select("digest", "node"), "digest").filter("id != node")
    copies = staged(same.select(F.col("node").alias("a"), F.col("id").alias("b")), "copies")
    numbers = staged(sketched.select("id").distinct(), "numbers")
    drop_staged(sketched)

    bags = staged(texts.select(F.col("node").alias("id"), "bag"), "bags")
    buckets, pairs = _candidates(texts, least)
    drop_staged(texts)

    def linked(found: DataFrame, ids: DataFrame, verify: Callable) -> DataFrame:
        # these ids grow with the corpus, so they are never broadcast
        words = rows.join(ids.distinct().hint("merge"), "id", "left_semi").mapInArrow(_as_words, "id long, words binary")
        words = staged(words.dropDuplicates(["id"]), "words", rows=TEXTS)
        out = verify(found, words, least)
        drop_staged(words)
        drop_staged(found)
        return out

    near = components(linked(pairs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), _verified))
    met = _apart(buckets, near, bags, least)
    more = linked(met, met.select("id"), _joined)
    drop_staged(buckets)
    drop_staged(bags)
    found = components(near.select(F.col("id").alias("a"), F.col("class").alias("b")).union(more).union(copies))
    return staged(numbers.join(found, "id", "left").select("id", F.coalesce("class", "id").alias("class")), "classes")


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_documents) for each row of docs: the class of near-copies that it belongs to.

    class_id is the smallest doc_id of the class (of a class without any, a negative number); n_documents counts its
    documents. A document alone in its class is its own. Rows with one doc_id are one document.
    """
    found = classes(docs, least)
    # staged, so that the join deals both sides anew and a large class can be split
    sizes = staged(found.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    rows = docs.select("doc_id", identity().alias("id"))
    out = rows.join(found, "id").join(sizes, "class", "left").withColumn("n_documents", F.coalesce("n", F.lit(1).cast("long")))
    return out.select("doc_id", F.col("class").alias("class_id"), "n_documents")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near-copies: one that has its smallest doc_id. All columns come back as they
    were, whatever their names."""
    first = classes(docs, least).filter("id = class").select("id").hint("merge")
    rows = docs.select(identity().alias("id"), whole_row(docs))
    return columns_of(rows.join(first, "id", "left_semi").dropDuplicates(["id"]), docs)
