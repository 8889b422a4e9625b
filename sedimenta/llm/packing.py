"""Packing documents into sequences of fixed capacity: dominance reduction, then best fit.

Documents become pieces of token ids. Only the number of pieces of each length (at most `capacity` numbers, at any corpus size) comes to
the driver, where the packing is found on lengths with multiplicities: first the reduction of Martello and Toth fixes sets that provably
dominate all others beside some piece (see reduce), then best fit in decreasing order packs the rest in bulk. The result is a list of
rank ranges by length, bounded by the capacity too; pieces get their rank among equal lengths by bucketed prefix sums and look up their
place.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import lean, small_batches, sole_memory, table, written

CAPACITY, END_ID, BUCKET_ROWS = 4096, 1, 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- token ids


class FastIds:
    """Ids of a tokenizer whose tokens never span white space, by a memory of words seen.

    Plain words (letters of ASCII and Latin) are folded and cut here and given to the model one by one; all other white-space-separated
    parts go through the whole tokenizer. Which parts are plain is decided so that both ways give the same ids.
    """

    #: Words and parts held each; some 200 bytes an entry.
    MOST = 700_000
    # fixed values: the tokenizer's own pattern
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model, self.cut = self.tool.model, regex.compile(self.PIECES).findall
        self.plain = re.compile("[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ſ¡-¬®-¿]+").fullmatch  # no '<': it may begin a special token
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(0x100, 0x200))
        self.bytes_ = {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}
        self.safe = self._same()

    def _same(self) -> bool:
        """Whether the short way holds for this tokenizer, on a probe; if not, everything takes the whole tokenizer."""
        probe = "Hello, don't stop: l'été coûte 123 euros! naïve Größe ÀÉÎ x9y --- We'LL 'sSo 'SIX"
        try:
            return b"".join(self._part(p.encode()) for p in probe.split()) == self._ids(self.tool.encode(probe, add_special_tokens=False).ids)
        except Exception:  # noqa: BLE001  a model without tokenize(), another pattern
            return False

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            raw = word if word.isascii() else "".join(map(self.bytes_.__getitem__, word.encode()))
            if len(self.words) >= self.MOST:
                self.words.clear()
            got = self.words[word] = self._ids([t.id for t in self.model.tokenize(raw)])
        return got

    def _part(self, part: bytes) -> bytes:
        word = part.rstrip(b".,;:!?")  # most parts: a word and the marks after it, which are one piece
        if word.isalpha() and word.isascii():
            return self._word(word.lower().decode()) + (self._word(part[len(word) :].decode()) if len(word) < len(part) else b"")
        text = part.decode("utf-8", "replace")
        if self.plain(text):
            return b"".join(map(self._word, self.cut(unicodedata.normalize("NFC", text).lower())))
        return self._ids(self.tool.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        if not self.safe:
            return self._ids(self.tool.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        parts = text.split()
        out = list(map(self.parts.get, parts))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    if len(self.parts) >= self.MOST:
                        self.parts.clear()
                    out[k] = self.parts[parts[k]] = self._part(parts[k])
        return b"".join(out)


_tools: dict[str, FastIds] = {}


def fast_ids(path: str) -> FastIds:
    """One per worker process, so that what it has seen serves later tasks too."""
    if path not in _tools:
        _tools[path] = FastIds(path)
    return _tools[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("tie", pa.int64())])


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, tie, ids if asked for) of each row's ids, its end id included; null is the empty text."""
    end = struct.pack("<I", end_id)
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("tokens", _tools.clear)
        tool = fast_ids(tokenizer)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tool.encode(text or b"") + end
                tie = zlib.crc32(ids)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (i, k, at // 4, len(part) // 4, zlib.crc32(part), tie)
                    rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    small_batches(docs.sparkSession)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), kinds)


# ---------------------------------------------------------------- the packing of lengths


class Plan:
    """Sequences in groups of the same filling. take(): the pieces of a length are used up in rank order."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.next = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.sequences = 0
        self.ranges: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, end rank, per sequence, first sequence, offset

    def open(self, n: int) -> int:
        at, self.sequences = self.sequences, self.sequences + n
        return at

    def take(self, length: int, per: int, sequences: int, first: int, offset: int) -> None:
        n = per * sequences
        at = self.next[length]
        self.ranges.append((length, at, at + n, per, first, offset))
        self.next[length] = at + n
        self.left[length] -= n

    def fix(self, lengths: list[int], n: int) -> None:
        """n sequences that hold exactly these lengths."""
        first, offset = self.open(n), 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            self.take(length, per, n, first, offset)
            offset += per * length


def reduce(plan: Plan) -> int:
    """Fixes dominating sets until none is found; returns the pieces fixed.

    A set P beside a piece w dominates another feasible set A if A falls into parts, each no longer than a piece of P of its own: pieces
    can then change places and w stands with P. For w with room r = c - w, whatever its rank among the lengths: a partner of just r
    dominates every set; if at most two others fit into r, the set of the longest fitting piece p1 and the longest p2 that fits beside it
    dominates if each feasible pair (a, b) has b <= p2 or a + b <= p1. Taking pieces away leaves fewer sets to dominate, so a set is fixed
    as often as its pieces allow. Lengths are tried from the longest until a whole round fixes nothing.
    """
    c, before = plan.capacity, sum(plan.left.values())
    for w in sorted(plan.left, reverse=True):  # exact fills by one: for every length, in bulk
        x = c - w
        if w == c:
            if plan.left[w]:
                plan.fix([w], plan.left[w])
        elif x in plan.left and w >= x:
            n = plan.left[w] // 2 if w == x else min(plan.left[w], plan.left[x])
            if n:
                plan.fix([w, x], n)
    found = True
    while found:
        found = False
        sizes = np.array(sorted(k for k, n in plan.left.items() if n), np.int64)
        for w in sizes[::-1].tolist():
            while plan.left[w] and (chosen := _dominating(plan, sizes, w)) is not None:
                lengths = [w, *chosen]
                plan.fix(lengths, min(plan.left[k] // lengths.count(k) for k in set(lengths)))
                found = True
                sizes = sizes[[plan.left[k] > 0 for k in sizes.tolist()]]
    return before - sum(plan.left.values())


def _dominating(plan: Plan, sizes: np.ndarray, w: int) -> list[int] | None:
    """The lengths beside w of a set that dominates all others, None if three others fit or no such set is found. sizes: those left, sorted."""
    room = plan.capacity - w
    have = lambda k: plan.left[k] - (k == w)
    low = [k for k in sizes[:4].tolist() for _ in range(min(have(k), 3))][:3]
    if not low or low[0] > room:
        return []
    if len(low) == 3 and sum(low) <= room:
        return None
    fit = sizes[: np.searchsorted(sizes, room, side="right")]
    p1 = next(k for k in fit[::-1].tolist() if have(k) > 0)
    beside = sizes[: np.searchsorted(sizes, room - p1, side="right")]
    p2 = next((k for k in beside[::-1].tolist() if have(k) - (k == p1) > 0), 0)
    # the longest b for each a <= p1; taking a piece twice where there is only one makes more sets than there are, which is safe
    at = np.searchsorted(sizes, room - fit, side="right") - 1
    a, b = fit[at >= 0], sizes[at[at >= 0]]
    own = a <= p1
    a, b = np.maximum(a, b)[own], np.minimum(a, b)[own]
    if bool(((a <= p1) & ((b <= p2) | (a + b <= p1))).all()):
        return [p1, p2] if p2 else [p1]
    return None


def best_fit(plan: Plan) -> None:
    """Best fit decreasing over what is left: open sequences are held by their room, in groups of the same filling."""
    rooms: list[int] = []  # sorted rooms that have groups
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for w in sorted(plan.left, reverse=True):
        while (n := plan.left[w]) > 0:
            at = bisect.bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                first, have = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room = plan.capacity
                first, have = None, -(-n // (room // w))
            per = room // w
            if n < per:
                per, use = n, 1
            else:
                use = min(have, n // per)
            if first is None:
                first = plan.open(use)
                have = use
            plan.take(w, per, use, first, plan.capacity - room)
            put(room - per * w, first, use)
            put(room, first + use, have - use)


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan({k: n for k, n in counts.items() if n > 0}, capacity)
    reduce(plan)
    best_fit(plan)
    return plan


# ---------------------------------------------------------------- pieces to places


def assign(pieces: DataFrame, plan: Plan, counts: dict[int, int], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. Ranks within a length: bucket sums, then within the bucket; a length has a bucket for each
    bucket_rows of its pieces, so groups stay small however many pieces share a length.

    What is broadcast has a row for each length (capacity at most) and the plan's ranges. Their number is bounded by the capacity too: a
    fixed set uses up a length but for two pieces, a step of best fit uses up a group or its length, and only steps that use up their
    length, but for less than a sequence holds of it, open or split groups.
    """
    spark = pieces.sparkSession
    several = spark.createDataFrame([(k, -(-n // bucket_rows)) for k, n in counts.items()], "length long, _buckets long")
    rows = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "tie")).join(F.broadcast(several), "length").withColumn("_b", F.pmod("_h", "_buckets"))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece", "tie", "ids_crc32")) - 1
    sums = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("length", "_b", base.alias("_base"))
    ranked = rows.withColumn("_in", within).join(sums, ["length", "_b"])
    names = [c for c in pieces.columns if c != "tie"]
    ranked = ranked.select(*names, (F.col("_in") + F.col("_base")).cast("long").alias("_rank"))
    ranges = np.array(sorted(plan.ranges), np.int64).reshape(-1, 6)
    shift = 62 - plan.capacity.bit_length()  # a rank stays below this power of two
    sent = spark.sparkContext.broadcast(((ranges[:, 0] << shift) + ranges[:, 1], ranges))
    at_length = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table_ = sent.value
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(len(names)).to_numpy()
            _, first, _, per, seq, offset = table_[np.searchsorted(keys, (length << shift) + rank, side="right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq + nth // per), pa.array(offset + nth % per * length)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts are empty and have the end id alone; rows that repeat are packed each for itself; null ids are kept. Other columns go. An
    empty table gives an empty one. Reruns give the same places up to rows that are equal in all columns.
    """
    pieces = written(tokenize(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    return assign(pieces, pack(counts, capacity), counts)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


