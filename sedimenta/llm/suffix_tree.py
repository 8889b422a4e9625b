"""A probabilistic suffix tree as language model, kept in distributed tables.

States are contexts of one to `depth` words (the order of the tree, as in its original form). A gram is a run of tokens inside a text;
candidates are the grams that occur `least` times or more in training, an absolute number, so the tree grows with the corpus. They are
counted level by level: a gram of k + 1 tokens can only be frequent if its first k and last k tokens are, which a bit filter of fixed size
tells beforehand. The filter saves work and decides nothing: a gram it lets pass wrongly fails at its count. A context is retained if its
next-token distribution diverges from the one of its suffix (count times Kullback-Leibler divergence of `gain` nats or more), and levels
are added until none is. Retained distributions are discounted and leave the rest to the suffix state, so each sums to 1; the root is the
add-one unigram distribution over all training tokens. A token is scored at the longest retained suffix.

Nothing that grows with the corpus comes to the driver or is broadcast. Texts are dealt to blocks, and each block asks for the grams it
holds once. What is dealt are cells: the sorted codes of one task or block in one shard (a range of codes), packed into a row; a shard holds
about as many codes at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import batches_of, buffers, lean, remainder, slices, table, word_hashes, written

DEPTH, LEAST, DISCOUNT, GAIN = 3, 5, 0.75, 6.0
#: Bits of the filter (8 MB), text of a block, codes that a task holds before it passes them on, codes of a shard at most about.
FILTER_BITS, BLOCK_BYTES, HELD, SHARD = 1 << 26, 16 << 20, 3_000_000, 1_000_000
#: Rounds in which the blocks are scored, one after the other, so that shuffle files of a share of them lie on disk at a time.
WAVES = 3
END = np.uint64(0x5EED0F7E2D0FE4D5)
_P = 0xD1342543DE82EF95
_PINV = np.uint64(pow(_P, -1, 1 << 64))


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token after each row's words, and each row's first token."""
    words, first = word_hashes(data, offs)
    rows = len(offs) - 1
    first = first + np.arange(rows + 1)
    out = np.full(len(words) + rows, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = words
    return out, first


def gram_codes(tokens: np.ndarray, order: int) -> np.ndarray:
    """Codes of the grams of `order` tokens that begin at each token: powers of one factor, so that longer ones follow from shorter ones."""
    n = max(0, len(tokens) - order + 1)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = out * np.uint64(_P) + tokens[k : k + n]
    return out


def whole(first: np.ndarray, n: int, order: int) -> np.ndarray:
    """Which of the n grams that begin at each token lie inside one row."""
    ok = np.ones(n, bool)
    for k in range(1, order):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the filter knows each code; positions are the low bits of the code."""
    at = (codes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs. Sorting codes alone is many times faster than sorting with columns beside them."""
    codes = np.sort(codes)
    at = _starts(codes)
    return codes[at], np.diff(np.append(at, len(codes)))


def _summed(codes: np.ndarray, n: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct codes in order, their n summed, and the other columns, which are equal where codes are."""
    order = np.argsort(codes)
    codes = codes[order]
    at = _starts(codes)
    return codes[at], np.add.reduceat(n[order], at) if len(at) else n, [x[order[at]] for x in rest]


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def shards_of(size: int) -> int:
    """Shards for the codes of texts of so many bytes: about SHARD codes each, whatever the size."""
    return max(1, -(-size // (8 * SHARD)))


def _cells(codes: np.ndarray, columns: list[np.ndarray], shards: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Codes in order, and columns of 8 bytes a value beside them, cut into cells by shard (the code's range): (shards, binary arrays).
    A cell is a row, so that the rows that Spark handles are fewer by far than the codes; some 250,000 codes at a time. In a cell the first
    bytes of all values come first, then the second ones: leading bytes of sorted codes and of counts repeat, which shuffles compress."""
    shard = np.minimum(codes // np.uint64((1 << 64) // shards), np.uint64(shards - 1)) if shards > 1 else np.zeros(len(codes), np.uint64)
    at = np.append(_starts(shard), len(codes))
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + 250_000, side="right")) - 1)
        yield shard[at[i:j]].astype(np.int64), [pa.array([_cell(x[at[k] : at[k + 1]]) for k in range(i, j)], pa.binary()) for x in [codes, *columns]]
        i = j


def _cell(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(cell: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _joined(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_values(x, kind) for x in cells.to_pylist() if x)])


def _gathered(texts: DataFrame, parts_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], least: int = 1, most: int = HELD) -> DataFrame:
    """(code, n, prefix, suffix) over all rows of texts, n at least `least`. parts_of: tokens of some rows -> (codes, named), named being
    none or codes with a prefix and a suffix, equal where codes are; the others get 0 and 0. If the suffix is one token, the prefix may be
    left out, for it follows from code and suffix. Counted in the tasks, then by shard."""
    shards = shards_of(_size(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: list[np.ndarray] = []  # codes as they come
        kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64), [])  # those counted
        named: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        new = new_named = 0

        def out(codes: np.ndarray, n: np.ndarray, rest: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for shard, (code, count, *others) in _cells(codes, [n.astype(np.int64), *rest], shards):
                others = [pa.array([b""] * len(shard), pa.binary())] * (2 - len(others)) + others
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(shard), bool(rest))), code, count, *others], names=["shard", "named", "code", "n", "prefix", "suffix"])

        def counted() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            codes, n = _counted(np.concatenate(raw))
            return _summed(np.concatenate([kept[0], codes]), np.concatenate([kept[1], n]), []) if len(kept[0]) else (codes, n, [])

        def together() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            return _summed(np.concatenate([c for c, _, _ in named]), np.concatenate([n for _, n, _ in named]), [np.concatenate(x) for x in zip(*(r for _, _, r in named), strict=True)])

        for batch in batches:
            data, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                codes, more = parts_of(*token_hashes(data, offs[i : j + 1]))
                raw.append(codes)
                new += len(codes)
                if more and len(more[0]):
                    named.append((more[0], np.ones(len(more[0]), np.int64), more[1:]))
                    new_named += len(more[0])
                if new + len(kept[0]) >= most:
                    kept, raw, new = counted(), [], 0
                    if len(kept[0]) >= most // 2:
                        yield from out(*kept)
                        kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64), [])
                if new_named >= most // 2:
                    named = [together()]
                    new_named = len(named[0][0])
                    if new_named >= most // 3:
                        yield from out(*named[0])
                        named, new_named = [], 0
        if raw or len(kept[0]):
            yield from out(*(counted() if raw else kept))
        if named:
            yield from out(*together())

    def merged(cells: pa.Table) -> pa.Table:
        out = []
        for is_named in (False, True):
            part = cells.filter(pa.compute.equal(cells.column("named"), is_named))
            codes, n = _joined(part.column("code"), np.uint64), _joined(part.column("n"), np.int64)
            rest = [x for c in ("prefix", "suffix") if len(x := _joined(part.column(c), np.uint64))]
            codes, n, rest = _summed(codes, n, rest)
            if len(rest) == 1:
                rest = [(codes - rest[0]) * _PINV, *rest]
            keep = n >= least
            rest = [x[keep] for x in rest] or [np.zeros(int(keep.sum()), np.uint64)] * 2
            out.append([codes[keep].view(np.int64), n[keep], *(x.view(np.int64) for x in rest)])
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["code", "n", "prefix", "suffix"])

    cells = batches_of(texts, lean(run), "shard long, named boolean, code binary, n binary, prefix binary, suffix binary")
    return cells.groupBy("shard").applyInArrow(merged, "code long, n long, prefix long, suffix long")


def _size(texts: DataFrame) -> int:
    return int(texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)


def filter_bits(codes: DataFrame) -> np.ndarray:
    """The filter of codes (code): bitmaps of 32768 bits each are made where the codes are; 8 MB at most come to the driver at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)] = True
        rows = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        at = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(at), 256):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 256]), pa.array([rows[k].tobytes() for k in at[i : i + 256]], pa.binary())], names=["part", "bits"])

    made = batches_of(codes.select("code"), lean(run), "part long, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    return out


class Tree:
    """words: (code, n, rest) of all words of the training texts: how often, and the mass that the word as a context leaves to its suffix,
    null where it isn't retained. grams: the same of the candidates that scoring can need: retained contexts, and grams that follow one.
    bits: the filter of all candidates; useful: that of words and grams as they are here."""

    def __init__(self, words: DataFrame, levels: list[DataFrame], bits: np.ndarray, tokens: int, vocabulary: int, discount: float):
        self.words, self.bits, self.tokens, self.vocabulary, self.discount = words, bits, tokens, vocabulary, discount
        self.depth, self.grams = len(levels), None
        for t in levels:
            t = t.where("used OR rest IS NOT NULL").select("code", "n", "rest")
            self.grams = t if self.grams is None else self.grams.union(t)
        self.useful = filter_bits(self.grams) if levels else np.zeros(FILTER_BITS // 8, np.uint8)

    def lookup(self) -> DataFrame:
        return self.words if self.grams is None else self.words.union(self.grams)


def learn(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, discount: float = DISCOUNT, gain: float = GAIN) -> Tree:
    """A tree from texts (one binary column)."""
    words = written(_gathered(texts, lambda tokens, first: (tokens, [])).select("code", "n"), "vocabulary")
    size, total = (int(x or 0) for x in words.agg(F.count(F.lit(1)), F.sum("n")).first())
    none = F.lit(None).cast("double")
    # alive: the candidates of the last order with the smoothed probability q of their last token after the others
    alive = words.where(F.col("n") >= least).withColumn("q", (F.col("n") + 1) / F.lit(total + 1.0 * (size + 1)))
    tables, bits = [words.select("code", "n", none.alias("rest"), F.lit(True).alias("used"))], filter_bits(alive)
    counts = _pass(texts, 1, bits, least) if depth else None
    for order in range(1, depth + 1):
        bits = bits | filter_bits(counts)
        both = _pass(texts, order + 1, bits, least, order < depth)
        level = both.where("prefix != 0").join(alive.select(F.col("code").alias("prefix"), F.col("n").alias("context_n")), "prefix").join(alive.select(F.col("code").alias("suffix"), "q"), "suffix")
        counts = both.where("prefix = 0")
        tested = written(level.groupBy("prefix").agg(F.min("context_n").alias("n"), *_mass(discount)).where(F.col("n") * F.col("kl") >= gain).select("prefix", "rest"), "contexts")
        if not tested.head(1):
            break
        tables[-1] = tables[-1].drop("rest").join(tested.withColumnRenamed("prefix", "code"), "code", "left").select("code", "n", "rest", "used")
        smoothed = F.when(F.col("rest").isNotNull(), (F.col("n") - discount) / F.col("context_n") + F.col("rest") * F.col("q")).otherwise(F.col("q"))
        alive = written(level.join(tested, "prefix", "left").select("code", "n", smoothed.alias("q"), F.col("rest").isNotNull().alias("used")), "grams")
        tables.append(alive.select("code", "n", none.alias("rest"), "used"))
    return Tree(tables[0].drop("used"), tables[1:], bits, total, size, discount)


def _pass(texts: DataFrame, order: int, bits: np.ndarray, least: int, longer: bool = True) -> DataFrame:
    """(code, n, prefix, suffix), least times or more: grams of `order` tokens that the filter knows, with the grams that begin and end them,
    and if `longer` the candidates of one token more, those whose beginning and end it knows, with prefix and suffix 0.

    One pass over the texts does both, and codes alone are dealt for most of what it counts. Words have no parts to name.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def parts_of(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        codes, known, named, more = tokens, None, [], np.zeros(0, np.uint64)
        if order > 1:
            parts = gram_codes(tokens, order - 1)
            alive = passes(sent.value, parts)
            n = max(0, len(parts) - 1)
            codes = parts[:n] * np.uint64(_P) + tokens[order - 1 : order - 1 + n]
            at = np.flatnonzero(alive[:n] & alive[1 : n + 1] & whole(first, n, order))
            at = at[passes(sent.value, codes[at])]
            known = np.zeros(n, bool)
            known[at] = True
            named = [codes[at], parts[at], parts[at + 1]] if order > 2 else [codes[at], parts[at + 1]]
        if longer:
            known = passes(sent.value, tokens) if known is None else known
            n = max(0, len(codes) - 1)
            at = np.flatnonzero(known[:n] & known[1 : n + 1] & whole(first, n, order + 1))
            more = codes[at] * np.uint64(_P) + tokens[at + order]
        return more, named

    made = written(_gathered(texts, parts_of, least), "counts")
    sent.destroy()  # the table stands for itself
    return made


def _mass(discount: float) -> list:
    """kl and rest of a context from its listed next tokens; those that aren't listed count as one."""
    p = F.col("n") / F.col("context_n")
    other, other_q = F.greatest(F.lit(0.0), 1 - F.sum(p)), F.greatest(F.lit(1e-12), 1 - F.sum("q"))
    kl = F.sum(p * F.log(p / F.col("q"))) + F.when(other > 1e-12, other * F.log(other / other_q)).otherwise(0.0)
    rest = F.least(F.lit(1.0), F.greatest(F.lit(1e-9), 1 - F.sum((F.col("n") - discount) / F.col("context_n"))))
    return [kl.alias("kl"), rest.alias("rest")]


def token_scores(tokens: np.ndarray, first: np.ndarray, find: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tree_depth: int, bits: np.ndarray, total: int, vocabulary: int, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, base, model) of all tokens, the last two as log10. find: codes -> (n, rest), 0 and NaN where there is none."""
    n, rest = find(tokens)
    counts = n
    root = (n + 1) / (total + 1.0 * (vocabulary + 1))
    p = root.copy()
    parts = tokens
    for order in range(1, tree_depth + 1):
        # parts[i] begins at i and is the context of the token at i + order
        longer = max(0, len(parts) - 1)
        codes = parts[:longer] * np.uint64(_P) + tokens[order : order + longer]
        at = np.flatnonzero(~np.isnan(rest[:longer]) & whole(first, longer, order + 1))
        more = np.flatnonzero(passes(bits, codes)) if order < tree_depth else at[passes(bits, codes[at])]
        gram_n, gram_rest = np.zeros(longer, np.int64), np.full(longer, np.nan)
        gram_n[more], gram_rest[more] = find(codes[more])
        own = np.where(gram_n[at] > 0, (gram_n[at] - discount) / n[at], 0.0)
        p[at + order] = own + rest[at] * p[at + order]
        parts, n, rest = codes, gram_n, gram_rest
    return counts, np.log10(root), np.log10(p)


def _finder(codes: np.ndarray, n: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Looks codes up that are in order and distinct. They are spread evenly, so their leading bits tell where to look, give or take a few."""
    bits = max(1, len(codes).bit_length() - 1)
    shift = np.uint64(64 - bits)
    first = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
    ends = np.append(codes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(len(wanted), np.int64), np.full(len(wanted), np.nan)
        at = first[(wanted >> shift).astype(np.int64)]
        before = np.flatnonzero(ends[at] < wanted)
        while len(before):
            at[before] += 1
            before = before[ends[at[before]] < wanted[before]]
        at = np.minimum(at, len(codes) - 1)
        hit = codes[at] == wanted
        return np.where(hit, n[at], 0), np.where(hit, rest[at], np.nan)

    return find


def score(docs: DataFrame, tree: Tree, block_bytes: int = BLOCK_BYTES, waves: int = WAVES) -> DataFrame:
    """docs (doc_id, text, held) -> doc_id, held, n_tokens, n_known, base_score, score; held is passed through.

    Rows go to blocks of bounded size by a hash, and every block is scored in one of the waves. A block asks once for each word and each
    gram that the filters know, in one row a shard of codes; the tree's shards answer, and the block's rows are scored with the answers.
    """
    size = _size(docs)
    blocks, shards = max(1, -(-size // block_bytes)), shards_of(size)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).select("text", "doc_id", "held", "block")
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(tree.bits), context.broadcast(tree.useful)
    packed = written(_packed(tree.lookup(), shards), "shards")
    out = None
    for w in range(min(waves, blocks)):
        part = written(_scored(dealt.where(F.col("block") % min(waves, blocks) == w), tree, packed, shards, -(-blocks // waves), *sent), "scores")
        out = part if out is None else out.unionByName(part)
    return out


def _packed(lookup: DataFrame, shards: int) -> DataFrame:
    """(shard, code, n, rest) with many values a row from lookup (code, n, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            codes, n, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(codes)
            for shard, cells in _cells(codes[order], [n[order], rest[order]], shards):
                yield pa.RecordBatch.from_arrays([pa.array(shard), *cells], names=["shard", "code", "n", "rest"])

        for batch in batches:
            held.append([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)])
            if len(held) * 512 >= HELD // 3:
                yield from out()
                held = []
        if held:
            yield from out()

    return batches_of(lookup.select("code", "n", "rest"), lean(run), "shard long, code binary, n binary, rest binary")


def _scored(dealt: DataFrame, tree: Tree, packed: DataFrame, shards: int, blocks: int, sent: Broadcast, useful: Broadcast) -> DataFrame:
    depth, settings = tree.depth, (tree.tokens, tree.vocabulary, tree.discount)
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    blocked = dealt.repartition(parts, "block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        new: dict[int, int] = {}

        for batch in batches:
            data, offs = buffers(batch.column(0))
            block = batch.column(3).to_numpy()
            for i, j in slices(offs):
                tokens, first = token_hashes(data, offs[i : j + 1])
                row = np.repeat(np.arange(i, j), np.diff(first))
                codes, of = [tokens], [block[row]]
                known, grams = passes(sent.value, tokens), tokens
                for order in range(2, depth + 2):
                    longer = max(0, len(grams) - 1)
                    grams = grams[:longer] * np.uint64(_P) + tokens[order - 1 : order - 1 + longer]
                    known = known[:longer] & known[1 : longer + 1] & passes(sent.value, grams)
                    at = np.flatnonzero(known & whole(first, longer, order))
                    at = at[passes(useful.value, grams[at])]
                    codes.append(grams[at])
                    of.append(block[row[at]])
                codes, of = np.concatenate(codes), np.concatenate(of)
                for b in np.unique(of).tolist():
                    own = _counted(codes[of == b])[0]
                    held.setdefault(b, []).append(own)
                    new[b] = new.get(b, 0) + len(own)
                    if new[b] > HELD // 3:  # what was seen before stands first and is merged with the new
                        held[b], new[b] = [_counted(np.concatenate(held[b]))[0]], 0
        for b in list(held):
            for shard, (code,) in _cells(_counted(np.concatenate(held.pop(b)))[0], [], shards):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), b, np.int64)), pa.array(shard), code], names=["block", "shard", "code"])

    def answered(asks: pa.Table, cells: pa.Table) -> pa.Table:
        codes, n, rest = _joined(cells.column("code"), np.uint64), _joined(cells.column("n"), np.int64), _joined(cells.column("rest"), np.float64)
        order = np.argsort(codes)
        codes, n, rest = codes[order], n[order], rest[order]
        out = []
        for cell in asks.column("code").to_pylist():
            wanted = _values(cell, np.uint64)
            at = np.searchsorted(codes, wanted)  # both are in order
            at = at[at < len(codes)] if len(codes) else at[:0]
            at = at[codes[at] == wanted[: len(at)]]
            out.append((_cell(codes[at]), _cell(n[at]), _cell(rest[at])))
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([asks.column("block"), asks.column("shard"), *(pa.array(list(x), pa.binary()) for x in columns)], names=["block", "shard", "code", "n", "rest"])

    asks = batches_of(blocked, lean(asked), "block long, shard long, code binary")
    answers = asks.groupBy("shard").cogroup(packed.groupBy("shard")).applyInArrow(answered, "block long, shard long, code binary, n binary, rest binary")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")  # shards are ranges, so all codes are in order then
        find = _finder(_joined(right.column("code"), np.uint64), _joined(right.column("n"), np.int64), _joined(right.column("rest"), np.float64))
        data, offs = buffers(left.column("text"))
        cols: tuple[list, ...] = ([], [], [], [])
        for i, j in slices(offs):
            tokens, first = token_hashes(data, offs[i : j + 1])
            counts, base, model = token_scores(tokens, first, find, depth, useful.value, *settings)
            for to, x in zip(cols, (np.diff(first), *(np.add.reduceat(v, first[:-1]) for v in ((counts > 0).astype(np.int64), base, model))), strict=True):
                to.append(x)
        got = [pa.array(np.concatenate(c)) if c else pa.array([], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.table([left.column("doc_id"), left.column("held"), *got], names=["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held, **settings) -> DataFrame:
    """Learns from the rows of docs (doc_id, text) where `held` (a column expression) is false, scores all.

    Null texts are empty: one end token. Texts may be of any length. Rows that repeat count each; null ids are allowed; other columns, of
    whatever names, play no part; an empty table gives an empty one. If no row is left to learn from, all tokens have the same probability
    1 (an empty vocabulary and the unknown word).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), held.alias("held"))
    tree = learn(own.where(~F.col("held")).select("text"), **settings)
    return score(own, tree).withColumn("train_tokens", F.lit(tree.tokens).cast("long"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 7) == 2)
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
