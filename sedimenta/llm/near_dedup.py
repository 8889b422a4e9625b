"""Near-duplicate documents: MinHash signatures under a multi-index Hamming join.

A document is the set of its word shingles. Its signature is K b-bit MinHash symbols, cut into M chunks. Two signatures that differ in at
most r symbols, r <= 2 M - 1, have a chunk with at most one error (pigeonhole), so each chunk gives one key for each allowed error place:
the chunk's other symbols. Every pair within the radius meets under a key. Equal sets are one class beforehand.

Links are found in two steps. First all classes of a key are compared with one pivot, the class that shares most buckets with most classes,
so a key sends as many pairs as it has rows; confirmed pairs are linked, and classes joined into components. Then, of each key whose classes
are still in different components, all pairs across components are compared by signature, in tiles of bounded size; ids that hang together
by such pairs form groups, and inside these groups all pairs across components are confirmed on full sets, again in tiles. Links inside a
component are never needed, and no pair across components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import buffers, clean_name, lean, mix, slices, small_batches, sole_memory, table, word_hashes, written

WORDS, NUM, DEN, SYMBOLS, CHUNK, SEED = 5, 80, 100, 80, 5, 77
#: Signatures further apart than this are not confirmed: a pair at 0.8 is that far with a chance under 1e-9. None confirms every pair that meets.
FAR = 40
#: Pairs of one pivot that are confirmed in one group, and shares that a pivot's rows are dealt to once it has more.
PIVOT_PAIRS, SALTS, BROADCAST_KEYS = 64, 64, 100_000
#: Rows that are compared in one group: of one key by signatures (160 bytes a row), of one group with texts.
KEY_TILE, TILE = 8192, 512
#: Edges of a graph that one task contracts.
TASK_EDGES = 1 << 20


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, first = word_hashes(data, offs)
    out = []
    for k in range(len(offs) - 1):
        h = np.sort(shingle_hashes(words[first[k] : first[k + 1]], n))
        if len(h) > 1:
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            h = h[keep]
        out.append(h)
    return out


def signatures(sets: list[np.ndarray], symbols: int, seed: int = SEED) -> np.ndarray:
    """(rows, symbols) 16-bit MinHash symbols; of empty sets zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, symbols, dtype=np.uint64)
    out = np.zeros((len(sets), symbols), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # in pieces of some 16 k hashes, which stay in the cache
        group, total = [], 0
        while at < len(full) and (not group or total + len(sets[full[at]]) <= 16_384):
            group.append(full[at])
            total += len(sets[full[at]])
            at += 1
        h = np.concatenate([sets[k] for k in group])
        cuts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in group])[:-1]])
        v = np.empty_like(h)
        for s in range(symbols):
            np.bitwise_xor(h, b[s], out=v)
            np.multiply(v, a[s], out=v)
            least = np.minimum.reduceat(v, cuts)
            out[group, s] = (least >> np.uint64(40)).astype(np.uint16) ^ (least >> np.uint64(20)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunk: int) -> np.ndarray:
    """(rows, keys): for each chunk and each place left out, a 64-bit key of the rest, the chunk and the place."""
    rows, symbols = sig.shape
    keys = []
    for c in range(0, symbols, chunk):
        part = sig[:, c : c + chunk].astype(np.uint64)
        for out in range(chunk):
            h = np.full(rows, (c * 131 + out) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1), np.uint64)
            for k in range(chunk):
                if k != out:
                    h = mix(h ^ part[:, k]) if k == chunk - 1 or (k == chunk - 2 and out == chunk - 1) else (h ^ part[:, k]) * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(23))
            keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def profile(docs: DataFrame, words: int, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, n, set_hi, set_lo, sig) of every row; set_hi and set_lo are equal just for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory()
        for batch in batches:
            data, offs = buffers(batch.column(1))
            n, hi, lo, sigs = [], [], [], []
            for i, j in slices(offs):
                sets = shingle_sets(data, offs[i : j + 1], words)
                n += [len(s) for s in sets]
                hi += [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF12345)))) if len(s) else 0 for s in sets]
                lo += [int(np.add.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F))) if len(s) else 0 for s in sets]
                sigs += [x.tobytes() for x in signatures(sets, symbols)]
            wide = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), wide(hi), wide(lo), pa.array(sigs, pa.binary())], names=["doc_id", "n", "set_hi", "set_lo", "sig"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(lean(run), "doc_id long, n long, set_hi long, set_lo long, sig binary")


def bucket_rows(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, id) of each class under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
            keys = chunk_keys(sig, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1])))], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(lean(run), "key long, id long")


def near_enough(pairs: DataFrame, sigs: DataFrame, far: int | None = FAR) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose signatures differ in `far` symbols at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
            keep = (x != y).sum(axis=1) <= (x.shape[1] if far is None else far)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    dealt, share = _salted(pairs, "a", SALTS * PIVOT_PAIRS)
    both = dealt.join(share(one), ["a", "_salt"]).drop("_salt").join(two, "b").where(F.least("n_a", "n_b") * DEN >= NUM * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union on full sets. texts: (id, text) of classes.

    Pairs of one pivot form groups of 64 at most, each with the pivot's text once, so that a pivot of very many pairs is many groups.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PIVOT_PAIRS).select("a", F.ceil(F.col("m") / PIVOT_PAIRS).cast("long").alias("parts"))
    dealt, share = _salted(pairs, "a", SALTS * PIVOT_PAIRS)
    kept = dealt.join(share(counts), ["a", "_salt"], "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).select("a", "part", "b", "_salt")
    pivots = texts.join(pairs.select(F.col("a").alias("id")), "id", "left_semi").select(F.col("id").alias("a"), "text")
    # each group once, with the salt of one of its pairs
    left = kept.groupBy("a", "part").agg(F.min("_salt").alias("_salt")).join(share(pivots), ["a", "_salt"]).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    right = kept.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "part", "b", "text")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column(2).to_pylist()
            sets += shingle_sets(*buffers(batch.column(3)), words)
        pivots = [s for s, i in zip(sets, ids, strict=True) if i is None]
        found = []
        for s, i in zip(sets, ids, strict=True):
            both = [len(np.intersect1d(p, s, assume_unique=True)) for p in pivots] if i is not None else []
            if any(m and den * m >= num * (len(p) + len(s) - m) for p, m in zip(pivots, both, strict=False)):
                found.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return left.unionByName(right).groupBy("a", "part").applyInArrow(run, "a long, b long")


def _salted(rows: DataFrame, key: str, most: int):
    """(rows with _salt, share): keys with more than `most` rows are dealt to SALTS shares; share(other) repeats the other side's rows of
    these keys for each share, and gives all others the salt 0. The list of such keys is short: one for `most` rows."""
    hot = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select(key, F.lit(SALTS).alias("_salts")), "hot-keys")
    if not hot.head(1):
        return rows.withColumn("_salt", F.lit(0)), lambda other: other.withColumn("_salt", F.lit(0))
    few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    dealt = rows.join(few, key, "left").withColumn("_salt", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return dealt, lambda other: other.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def forest(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: each task's edges (u, v) as stars around the least id that their nodes reach within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Union()
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree.join(u, v)
        yield tree.stars(["u", "v"])

    return edges.mapInArrow(lean(run), "u long, v long")


class Union:
    """Sets of ids, each named by its least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self, names: list[str]) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=names)


def components(links: DataFrame, per_task: int = TASK_EDGES) -> DataFrame:
    """(id, component) of every id in links (a, b), the least id it reaches.

    Tasks contract their edges to stars; once at most per_task edges are left (counted), one more task joins them. Until then rounds of
    large-star and small-star, which take minima by key and never gather a neighbourhood, bring the stars together.
    """
    edges = written(forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    while edges.count() > per_task:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours hang onto the least one
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours and the node itself hang onto the least one
        joined = large.join(low, "u")
        small = written(forest(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()), "edges")
        if not _open(small):
            return _named(small)
        edges = small
    return _named(written(forest(edges.coalesce(1)), "components"))


def _open(edges: DataFrame) -> bool:
    """Whether a node hangs onto two others, or onto one that hangs itself."""
    twice = edges.groupBy("u").agg(F.countDistinct("v").alias("n")).where("n > 1")
    return bool(twice.head(1)) or bool(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").head(1))


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def by_tiles(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """rows dealt so that any two of a group meet in one (group, i, j): ids go to tiles of about `tile` rows, pairs of tiles are groups."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(group, F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    dealt = rows.join(sizes, group).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("t")).alias("i"), F.greatest(o, F.col("t")).alias("j")))
    each = dealt.withColumn("_to", F.explode(to)).select(group, "_to.i", "_to.j", *[c for c in rows.columns if c != group])
    return each.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, streamed."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in range(keys)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and tuple(k[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, c, n = (group.column(x).to_numpy() for x in ("id", "c", "n"))
    return ids, c, n, np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)


def _partners(k: int, c: np.ndarray, n: np.ndarray, sig: np.ndarray, far: int | None) -> np.ndarray:
    """Later rows of another component that sizes and signatures allow as partners of row k."""
    rest = slice(k + 1, None)
    ok = np.flatnonzero((c[rest] != c[k]) & (np.minimum(n[rest], n[k]) * DEN >= NUM * np.maximum(n[rest], n[k]))) + k + 1
    return ok[(sig[ok] != sig[k]).sum(axis=1) <= far] if len(ok) and far is not None else ok


def near_groups(open_: DataFrame, far: int | None = FAR) -> DataFrame:
    """(id, g): groups of ids that hang together by pairs under one key that are in different components and near by their signatures.

    open_ (key, id, c, n, sig). Tasks keep one set of ids each and put out stars, not pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Union()
        for group in groups_of(batches, 3):
            ids, c, n, sig = _columns(group)
            for k in range(len(ids) - 1):
                for x in _partners(k, c, n, sig, far):
                    tree.join(int(ids[k]), int(ids[x]))
        yield tree.stars(["a", "b"])

    return components(written(by_tiles(open_, "key", KEY_TILE).mapInArrow(lean(run), "a long, b long"), "stars")).select("id", F.col("component").alias("g"))


def group_links(members: DataFrame, words: int, far: int | None = FAR, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links between different components inside groups, on full sets; of several that join the same components in a task, one.

    members (g, id, c, n, sig, text). A text travels once for each tile of its group, not for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Union()
        for group in groups_of(batches, 3):
            ids, c, n, sig = _columns(group)
            data, offs = buffers(group.column("text"))
            sets = [s for i, j in slices(offs) for s in shingle_sets(data, offs[i : j + 1], words)]
            found: list[tuple[int, int]] = []
            for k in range(len(ids) - 1):
                ok = _partners(k, c, n, sig, far)
                if not len(ok):
                    continue
                own, sizes = sets[k], np.array([len(sets[x]) for x in ok])
                both = np.concatenate([sets[x] for x in ok])
                at = np.minimum(np.searchsorted(own, both), len(own) - 1)
                shared = np.add.reduceat((own[at] == both).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for x in ok[den * shared >= num * (len(own) + sizes - shared)]:
                    if tree.join(int(c[k]), int(c[x])):
                        found.append((int(ids[k]), int(ids[x])))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    return by_tiles(members, "g", TILE).mapInArrow(lean(run), "a long, b long")


def link_classes(classes: DataFrame, texts: DataFrame, words: int, far: int | None = FAR) -> DataFrame:
    """(id, component) of the classes that are linked with others.

    All classes of a bucket are compared with one pivot, the class that shares most buckets with most classes, which joins nearly all that
    belongs together. Then the pairs of a bucket that are still in different components are taken, all of them, inside the groups that
    their signatures leave.
    """
    keys = bucket_rows(classes)
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    held = written(keys.join(met, "key"), "buckets")  # (key, id, m): rows of buckets with two classes or more
    ranked = held.join(held.groupBy("id").agg(F.sum("m").alias("reach")), "id")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("id")).alias("less"))).alias("p")).select("key", (-F.col("p.less")).alias("pivot"))
    pairs = held.join(pivot, "key").where("id != pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    near = written(near_enough(written(pairs, "pairs"), classes, far), "near-pairs")
    links = written(confirm(near, texts, words), "links")
    found = written(components(links), "components")
    named = held.where("m > 2").select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    light = classes.select("id", "n", "sig")
    grouped = written(near_groups(named.join(mixed, "key", "left_semi").join(light, "id"), far), "groups")
    if not grouped.head(1):
        return found
    members = grouped.join(found, "id", "left").select("g", "id", F.coalesce("component", "id").alias("c")).join(light, "id").join(texts, "id")
    more = written(group_links(members.select("g", "id", "c", "n", "sig", "text"), words, far), "links")
    return written(components(links.union(more)), "components")


def near_duplicates(docs: DataFrame, words: int = WORDS, far: int | None = FAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Texts that are null or without words have no shingles, link with nothing and are kept. Rows that repeat (same id and text) are one
    document and come back as often as they are there, all kept or none; rows of one id with several texts link through any of them. Null
    ids stay apart from all others and are kept. The component is named by its least doc_id. Texts of any length are shingled whole. An empty
    table gives an empty one; other columns play no part. far=None confirms all pairs that meet, however far their signatures are apart.
    """
    rows = written(profile(docs, words), "profiles")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("set_hi", "set_lo", "n").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")).select("set_hi", "set_lo", "n", "id", "sig"), "classes")
    ids = classes.select("id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = link_classes(classes, texts.join(ids, "id", "left_semi"), words, far)
    named = classes.join(found, "id", "left").select("set_hi", "set_lo", "n", F.coalesce("component", "id").alias("component_id"))
    some = full.join(named, ["set_hi", "set_lo", "n"]).select("doc_id", "n", "component_id")
    none = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    both = some.unionByName(none)
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each group of near duplicates, with all columns of docs; rows that repeat become one."""
    key = clean_name(docs, "gone_id")
    gone = near_duplicates(docs.select("doc_id", "text"), words).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
    return left


