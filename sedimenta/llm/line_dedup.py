"""Line dedup by a sharded minimal perfect hash.

Lines that many documents hold are dropped everywhere but in one document. A count over 128-bit line hashes (summed before the shuffle)
finds them; for each shard of these hashes a minimal perfect hash indexes compact arrays: a 64-bit fingerprint, the count, and the id of
the document that keeps the line. Documents probe the arrays; lines are never joined.

Up to `broadcast_bytes` of arrays go to every executor; beyond it the arrays stay where they are, and blocks of documents send the hashes
of their lines, once each, to the shards that hold them. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import SPACES, clean_name, lean, small_batches, sole_memory, table, written

MIN_CHARS, MIN_DOCS, SHARD_KEYS, BROADCAST_BYTES = 40, 5, 1 << 18, 48 << 20
#: Beyond the broadcast: text of a block, and askings in a group.
BLOCK_BYTES, ASKS = 16 << 20, 1_000_000
_NONE = -(1 << 63)
_GAMMA = 2.0


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # of bytes, lower() takes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    """By code points; only keys with at least as many bytes need the exact count."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (keys ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & ((1 << 64) - 1))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: bit arrays by level, a key counts at the first level where no other key meets it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits)]))
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
            size = max(8, int(_GAMMA * len(left)))
            at = _level_hash(left, len(levels), size)
            met = np.bincount(at, minlength=size)
            levels.append(met == 1)
            left = left[met[at] != 1]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where no level has its bit. Keys outside the set may get any place: compare fingerprints."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _level_hash(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array([len(b) for b in self.levels], np.int64).tobytes(), b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, np.int64):
            end = at + (int(n) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits[at:end], np.uint8), count=int(n)).astype(bool))
            at = end
        return cls(levels)


class Shard:
    def __init__(self, sizes: bytes, bits: bytes, marks: bytes, counts: bytes, keepers: bytes):
        self.hash = PerfectHash.load(sizes, bits)
        self.marks, self.counts, self.keepers = np.frombuffer(marks, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(keepers, np.int64)

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, id of the keeper) for each hash pair."""
        at = self.hash.index(low)
        at[at >= 0] = np.where(self.marks[at[at >= 0]] == high[at >= 0], at[at >= 0], -1)
        return at >= 0, np.where(at >= 0, self.keepers[np.maximum(at, 0)] if len(self.keepers) else 0, _NONE)


def _keys_of(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The text's lines, the places of those whose key is long enough, and the keys' 16-byte hashes."""
    lines, places, hashes = text.split(b"\n"), [], []
    for k, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line_key(line)
            if long_enough(key, min_chars):
                places.append(k)
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines, places, hashes


_COUNT = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("docs", pa.int64()), ("keeper", pa.int64())])


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS, flush: int = 300_000) -> DataFrame:
    """(high, low, docs, keeper) of every line key: in how many documents, and the largest doc_id among them (null ids are least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory()
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(seen), ">i8").astype(np.int64).reshape(-1, 2)
            rest = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (both[:, 0], both[:, 1], rest[:, 0], rest[:, 1])], schema=_COUNT)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = _NONE if i is None else i
                for h in set(_keys_of(text or b"", min_chars)[2]):
                    if (x := seen.get(h)) is None:
                        seen[h] = [1, i]
                    else:
                        x[0] += 1
                        x[1] = max(x[1], i)
                if len(seen) >= flush:
                    yield out()
        if seen:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "high long, low long, docs long, keeper long")
    return rows.groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


_SHARD = "shard long, sizes binary, bits binary, marks binary, counts binary, keepers binary"


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard of the line hashes; a shard holds about SHARD_KEYS of them however hot a line is."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].to_numpy(np.int64).view(np.uint64), pdf["high"].to_numpy(np.int64).view(np.uint64)
        # two lines may share the low half: the perfect hash then takes the first and the rest go by themselves
        rest = []
        _, first = np.unique(low, return_index=True)
        if len(first) < len(low):
            rest = np.setdiff1d(np.arange(len(low)), first)
        parts = [first] + [np.array([k]) for k in rest]
        out = []
        for own in parts:
            made = PerfectHash.build(low[own])
            at = made.index(low[own])
            marks, counts, keepers = np.empty(len(own), np.uint64), np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            marks[at], counts[at], keepers[at] = high[own], pdf["docs"].to_numpy()[own], pdf["keeper"].to_numpy()[own]
            out.append((int(pdf["shard"].iloc[0]), *made.dump(), marks.tobytes(), counts.tobytes(), keepers.tobytes()))
        return pd.DataFrame(out, columns=["shard", "sizes", "bits", "marks", "counts", "keepers"])

    keyed = lines.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(one, _SHARD)


def _probe(loaded: dict[int, list[Shard]], shards: int, hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
    high, low, owner = both[:, 0], both[:, 1], both[:, 0] % shards
    found, keeper = np.zeros(len(both), bool), np.full(len(both), _NONE, np.int64)
    for s in np.unique(owner):
        own = owner == s
        for shard in loaded.get(int(s), ()):
            f, k = shard.probe(high[own].view(np.uint64), low[own].view(np.uint64))
            at = np.flatnonzero(own)[f]
            found[at], keeper[at] = True, k[f]
    return found, keeper


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `text` replaced by its kept lines, and n_lines, n_dropped (named otherwise if docs has such columns).

    Every row counts as one document, rows that repeat too; of lines in min_docs documents or more, rows with the largest doc_id keep
    theirs (several rows with that id all do). A null or empty text is one empty line, and its text becomes ''. A document all of whose
    lines go has the empty text. Null ids are smaller than all others. Other columns stay as they are; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [clean_name(docs, "n_lines"), clean_name(docs, "n_dropped")]
    frequent = written(count_lines(docs, min_chars).where(F.col("docs") >= min_docs), "lines")
    total = frequent.count()
    shards = max(1, -(-total // shard_keys))
    arrays = written(build_shards(frequent, shards), "line-arrays")
    size = arrays.select(F.sum(sum(F.length(c) for c in ("sizes", "bits", "marks", "counts", "keepers")))).first()[0] or 0
    if size <= broadcast_bytes:
        return _by_broadcast(docs, arrays, shards, min_chars, names)
    return _by_shard(docs, arrays, shards, min_chars, names)


def _out_fields(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{names[0]}` long, `{names[1]}` long"


def _by_broadcast(docs: DataFrame, arrays: DataFrame, shards: int, min_chars: int, names: list[str]) -> DataFrame:
    """The arrays' size is checked by the caller."""
    sent = docs.sparkSession.sparkContext.broadcast([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in arrays.collect()])
    text_at = docs.columns.index("text")
    id_at = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, list[Shard]] = {}
        for shard, *parts in sent.value:
            loaded.setdefault(shard, []).append(Shard(*parts))
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            ids = [_NONE if i is None else i for i in batch.column(id_at).to_pylist()]
            kept, n_lines, n_dropped = _without(texts, ids, min_chars, lambda hashes: _probe(loaded, shards, hashes))
            columns = batch.columns
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*batch.schema.names, *names])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), _out_fields(docs, names))


def _without(texts: list[bytes], ids: list[int], min_chars: int, probe) -> tuple[list[bytes], list[int], list[int]]:
    """(kept text, lines, dropped lines) of each text; probe: hashes -> (found, keeper)."""
    split = [_keys_of(t, min_chars) for t in texts]
    hashes = [h for _, _, hs in split for h in hs]
    found, keeper = probe(hashes) if hashes else (np.zeros(0, bool), np.zeros(0, np.int64))
    at, kept, n_lines, n_dropped = 0, [], [], []
    for i, (lines, places, _) in zip(ids, split, strict=True):
        end = at + len(places)
        gone = {places[k] for k in np.flatnonzero(found[at:end] & (keeper[at:end] != i))}
        at = end
        kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone))
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
    return kept, n_lines, n_dropped


def _by_shard(docs: DataFrame, arrays: DataFrame, shards: int, min_chars: int, names: list[str], block_bytes: int = BLOCK_BYTES, most_asks: int = ASKS) -> DataFrame:
    """The arrays stay with their shards. Documents are dealt to blocks; each block asks once for each of its line hashes, shards answer
    those they know with the keeper, and the block drops its lines.

    The askings of a shard are salted by their counted number, so that a group has about most_asks of them however many lines there are.
    """
    spark = docs.sparkSession
    key, schema = clean_name(docs, "block"), docs.withColumn("text", F.col("text").cast("string")).schema
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    blocked = docs.withColumn("text", F.col("text").cast("string")).withColumn(key, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(parts, key)
    ask = ["block", "high", "low"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, bytes]] = set()

        def out() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(h for _, h in held), ">i8").astype(np.int64).reshape(-1, 2)
            made = [np.array([b for b, _ in held], np.int64), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=ask)

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((b, h) for h in _keys_of(text or b"", min_chars)[2])
                if len(held) >= 200_000:
                    yield out()
        if held:
            yield out()

    asks = written(blocked.select(F.col(key), F.col("text").cast("binary")).mapInArrow(lean(asked), "block long, high long, low long"), "line-asks")
    salts = max(1, -(-asks.count() // (shards * most_asks)))
    salted = asks.withColumn("shard", F.pmod("high", F.lit(shards))).withColumn("salt", F.pmod(F.xxhash64("block", "low"), F.lit(salts)))
    each = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        high, low = (left.column(c).to_numpy() for c in ("high", "low"))
        found, keeper = np.zeros(len(left), bool), np.full(len(left), _NONE, np.int64)
        for r in right.select(["sizes", "bits", "marks", "counts", "keepers"]).to_pylist():
            f, k = Shard(*r.values()).probe(high.view(np.uint64), low.view(np.uint64))
            found, keeper = found | f, np.where(f, k, keeper)
        return left.select(ask).append_column("keeper", pa.array(keeper)).filter(pa.array(found))

    answers = salted.groupBy("shard", "salt").cogroup(each.groupBy("shard", "salt")).applyInArrow(answered, "block long, high long, low long, keeper long")

    def dropped(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(zip(right.column("high").to_pylist(), right.column("low").to_pylist(), strict=True), right.column("keeper").to_pylist(), strict=True))

        def probe(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2).tolist()
            keepers = [known.get((h, low)) for h, low in both]
            return np.array([k is not None for k in keepers], bool), np.array([_NONE if k is None else k for k in keepers], np.int64)

        left = left.drop_columns([key])
        ids = [_NONE if i is None else i for i in left.column("doc_id").to_pylist()]
        kept, n_lines, n_dropped = _without([t or b"" for t in left.column("text").cast(pa.binary()).to_pylist()], ids, min_chars, probe)
        left = left.set_column(left.schema.get_field_index("text"), "text", pa.array(kept, pa.binary()).cast(pa.string()))
        return left.append_column(names[0], pa.array(n_lines, pa.int64())).append_column(names[1], pa.array(n_dropped, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{names[0]}` long, `{names[1]}` long"
    return blocked.groupBy(key).cogroup(answers.withColumnRenamed("block", key).groupBy(key)).applyInArrow(dropped, fields)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS nth, doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT nth, doc_id, UNNEST(parts) AS line, UNNEST(range(len(parts))) AS nr FROM docs
), keyed AS (
    SELECT nth, doc_id, nr, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
    SELECT key, MAX(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING COUNT(DISTINCT nth) >= 5
), marked AS (
    SELECT k.nth, k.doc_id, k.nr, k.line, h.key IS NOT NULL AND h.keeper IS DISTINCT FROM k.doc_id AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_lines, CAST(COUNT(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY nth, doc_id
"""
