"""Mixing sources to target weights.

The words of each source are packed end to end into blocks of fixed length. Each source has a word quota; output shards of fixed slot
count draw their source counts from one multinomial over all slots, split down a binary tree so that any shard finds its own counts and
places from the seed alone. The k-th slot of a source takes block P(k) of it, P a Feistel permutation of the block numbers anew for each
pass, and slots meet blocks by (source, block). The slots that a source has in all are its quota, so totals meet the targets to the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import WORD, batches_of, clean_name, lean, table, written

WEIGHTS, SHARE, REPEAT, BLOCK, SLOTS, SEED = (3, 1, 2), 1.5, 2, 512, 4096, 1
#: Rows of a source that one group sums, and sources up to which their list is broadcast; more go by a shuffled join.
BUCKET_ROWS, BROADCAST_SOURCES = 20_000, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, repeat: float = REPEAT) -> list[float]:
    """Shares of total by weight, none above repeat times its size; what is above is shared anew by weight among the rest."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > repeat * sizes[k]} if w else set(open_)
        if not over:
            for k in open_:
                out[k] = left * weights[k] / w
            break
        for k in over:
            out[k] = float(repeat * sizes[k]) if w else 0.0
        left -= sum(out[k] for k in over)
        open_ -= over
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key: four Feistel rounds on the least even number of bits, walked until inside n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    n = n.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) ^ k
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(31)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among `drawn` of good + bad, by inversion: the chances relative to the mode's are products of ratios, and what
    lies beyond 14 standard deviations has a chance under 1e-40. The same way at any size; the work grows with the standard deviation."""
    total, lo, hi = good + bad, max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (total + 2)))
    share = drawn / total
    far = 30 + int(14 * np.sqrt(good * share * (1 - share) * (bad / max(1, total - 1)) + 1))
    lo, hi = max(lo, mode - far), min(hi, mode + far)
    k = np.arange(lo, hi, dtype=np.float64)  # from k to k + 1
    step = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    log = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.exp(log - log.max())
    return lo + int(np.searchsorted(np.cumsum(chance) / chance.sum(), rng.random(), side="right").clip(0, hi - lo))


def _split(rng: np.random.Generator, counts: np.ndarray, left: int) -> np.ndarray:
    """How many of each source stand in the left part, given the totals: multivariate hypergeometric, source by source."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        rest -= n
        out[k] = hypergeometric(rng, n, rest, left)
        left -= int(out[k])
    return out


def shard_counts(shard: int, shards: int, slots: int, quota: np.ndarray, seed: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(this shard's source counts, how many of each source stand in earlier shards), in log2(shards) draws. seen: splits to use again, for
    shards of one task lie next to each other."""
    lo, hi, counts, before = 0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64)
    seen = {} if seen is None else seen
    if len(seen) > 4096:
        seen.clear()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (got := seen.get((lo, hi))) is None:
            got = seen[lo, hi] = _split(np.random.default_rng([seed, lo, hi]), counts, min(int(counts.sum()), (mid - lo) * slots))
        if shard < mid:
            hi, counts = mid, got
        else:
            lo, before, counts = mid, before + got, counts - got
    return counts, before


def spans(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (row columns, source, size) with `start`: words of the same source before this row's, in the order of (bucket of the row's hash, hash).

    A source is summed in buckets, so a hot one is many groups; only bucket sums meet in one window. The caller has buckets follow the rows.
    """
    order = F.xxhash64("doc_id", "size", "tie")
    rows = docs.withColumn("_h", order).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    inside = F.sum("size").over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1))
    sums = docs.withColumn("_b", F.pmod(order, F.lit(buckets))).groupBy("source", "_b").agg(F.sum("size").alias("n"))
    base = F.sum("n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(base, F.lit(0)).alias("_base"))
    out = rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return out.withColumn("start", (F.col("_in") + F.col("_base")).cast("long")).drop("_h", "_b", "_in", "_s", "_sb", "_base")


def plan(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK) -> list[dict]:
    """Per source, by code point with null last: size, target, quota in words, blocks, and slots. Python orders strings by code point."""
    rows = sorted(((s, n) for s, n in sizes), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([n for _, n in rows], [weights[k % len(weights)] for k in range(len(rows))], share * sum(n for _, n in rows), repeat)
    out = []
    for k, ((s, n), t) in enumerate(zip(rows, goal, strict=True)):
        quota, blocks = min(int(round(t)), repeat * n), -(-n // block)
        out.append({"k": k, "source": s, "size": n, "target": t, "quota": quota, "blocks": blocks, "passes": quota // n if n else 0, "rest": quota % n if n else 0})
        out[-1]["slots"] = out[-1]["passes"] * blocks + _slots(out[-1], block)
    return out


def _key(k: int, pass_: int, seed: int) -> int:
    return int(np.random.default_rng([seed, k, pass_]).integers(1 << 62))


def _slots(row: dict, block: int, seed: int = SEED) -> int:
    """Slots of the last, partial pass: whole blocks in permuted order until `rest` words are there; the last slot is cut to the word."""
    rest, blocks = row["rest"], row["blocks"]
    if not rest:
        return 0
    tail = row["size"] - (blocks - 1) * block
    if tail == block or rest <= 0:
        return -(-rest // block)
    # the short tail block stands at one place of the permutation; find it by inverting for that place only
    at = _place_of(blocks - 1, blocks, _key(row["k"], row["passes"], seed))
    return -(-rest // block) if at * block >= rest else max(at + 1, -(-(rest - tail) // block) + 1)


def _place_of(value: int, n: int, key: int) -> int:
    """The index that permute sends to value: the rounds run backwards."""
    half = max(1, (int(np.ceil(np.log2(max(n, 2)))) + 1) // 2)
    mask, u = (1 << half) - 1, (1 << 64) - 1
    x = value
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            f = ((left + (r + 1) * 0x9E3779B97F4A7C15) & u) ^ key
            f = ((f ^ (f >> 30)) * 0xBF58476D1CE4E5B9) & u
            f = ((f ^ (f >> 27)) * 0x94D049BB133111EB) & u
            left, right = right ^ ((f >> 31) & mask), left
        x = left << half | right
        if x < n:
            return x


def draw_slots(spark: SparkSession, sources: list[dict], block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, k, block, pass, words): which block of which source stands in each slot of the mix, and how many of its words."""
    quota = np.array([s["slots"] for s in sources], np.int64)  # as long as the list of sources
    shards = max(1, -(-int(quota.sum()) // slots)) if len(quota) else 1
    info = {n: np.array([s[n] for s in sources], np.int64) for n in ("size", "blocks", "passes", "rest", "slots")}
    keys = np.array([[_key(s["k"], p, seed) for p in range(s["passes"] + 1)] + [0] * (max((x["passes"] for x in sources), default=0) - s["passes"]) for s in sources], np.int64)
    tail_at = np.array([_place_of(s["blocks"] - 1, s["blocks"], _key(s["k"], s["passes"], seed)) if s["blocks"] else 0 for s in sources], np.int64)
    names = ["shard", "slot", "k", "block", "pass", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_counts(shard, shards, slots, quota, seed, seen)
                k = np.repeat(np.arange(len(counts)), counts)
                nth = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts, strict=True)]) if len(k) else np.zeros(0, np.int64)
                blocks = np.maximum(info["blocks"][k], 1)
                pass_, i = nth // blocks, nth % blocks
                at = permute(i, blocks, keys[k, pass_] if len(k) else np.zeros(0, np.int64))
                length = np.minimum(block, info["size"][k] - at * block)
                # in the partial pass the last slot is cut: words before it are whole blocks, less what the tail block lacks
                last = (pass_ == info["passes"][k]) & (nth == info["slots"][k] - 1)
                tail_lack = block - (info["size"][k] - (blocks - 1) * block)
                done = i * block - np.where(tail_at[k] < i, tail_lack, 0)
                words = np.where(last, np.minimum(length, info["rest"][k] - done), length)
                place = np.random.default_rng([seed, 7, shard]).permutation(len(k))
                cols = (np.full(len(k), shard), place, k, at, pass_, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=names)

    return batches_of(spark.range(shards, numPartitions=min(shards, 4096)), run, ", ".join(f"{n} long" for n in names))


def source_sizes(sized: DataFrame) -> tuple[list[tuple[str | None, int]], int]:
    """(source, size) and the rows of the largest source. One row a source comes to the driver, which orders them and shares out the targets."""
    rows = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    return [(r[0], int(r[1])) for r in rows], max((int(r[2]) for r in rows), default=0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(spans, slots, sources). spans: doc_id, source, size, tie, start, k of every row; slots: draw_slots joined by the caller on (k, block).

    Null and empty texts have size 0 and are never taken; a null source is the last source; a null id is an id like any other; rows that
    repeat are taken each for itself; a source without words has target and quota 0; an empty table has no slots; other columns play no part.
    """
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")), "mix-sizes")
    sizes, most = source_sizes(sized)
    sources = plan(sizes, weights, share, repeat, block)
    spark = docs.sparkSession
    names = spark.createDataFrame([(s["k"], s["source"], s["size"], s["target"]) for s in sources], "k long, _source string, source_size long, target double")
    few = F.broadcast(names) if len(sources) <= BROADCAST_SOURCES else names
    placed = spans(sized, max(1, -(-most // BUCKET_ROWS))).join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return placed, draw_slots(spark, sources, block, slots, seed), sources


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row's part in each block: (k, block, from, to) within the block, beside the row's columns."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    each = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return each.withColumn("from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))


def taken(placed: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed with `taken`, the words of each row in the mix. Slots are summed by block first; rows join blocks by (k, block)."""
    used = drawn.groupBy("k", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    # the planner takes the slots for as few as the shards they come from, so it is told not to broadcast them
    parts = pieces(placed, block).select("k", "start", "block", "from", "to").join(used.hint("merge"), ["k", "block"])
    got = parts.groupBy("k", "start").agg(F.sum(F.col("times") * F.greatest(F.least(F.col("to"), F.col("words")) - F.col("from"), F.lit(0))).alias("taken"))
    out = placed.join(got.withColumnRenamed("start", "_start").withColumnRenamed("k", "_k"), (F.col("k") == F.col("_k")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return out.drop("_k", "_start").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents, with the columns of docs: for each pass over a source, each run of a row's words that the mix takes.

    A pass that takes a whole row gives its text as it stands; a partial one gives the text from its first to its last word. n_chars (if
    docs has it) follows the text. Rows that aren't taken go, rows without words too. Null sources are a source, null ids are ids;
    rows that repeat are taken each for itself; an empty table gives an empty one.
    """
    block = settings.get("block", BLOCK)
    placed, drawn, sources = mix(docs, **settings)
    cuts = pieces(placed, block).select("doc_id", "source", "size", "tie", "k", "start", "block", "from", "to").join(drawn.select("k", "block", "pass", "words").hint("merge"), ["k", "block"])
    cuts = cuts.withColumn("to", F.least("to", "words")).where("to > from")
    word = lambda c: (F.col("block") * block + F.col(c) - F.col("start")).cast("int")
    by_row = cuts.groupBy("doc_id", "source", "size", "tie", "start", "pass").agg(F.sort_array(F.collect_list(F.struct(word("from").alias("a"), word("to").alias("b")))).alias("cuts"))
    # rows that repeat have several starts; each start is one row of docs, told apart by its number among equals
    same = ["doc_id", "source", "size", "tie"]
    runs = by_row.groupBy(*same, "start").agg(F.collect_list("cuts").alias("cuts"))
    runs = runs.groupBy(*same).agg(F.flatten(F.flatten(F.collect_list("cuts"))).alias("cuts"))
    size, key, words, own = (clean_name(docs, f"mix_{c}") for c in ("size", "tie", "words", "cuts"))
    tie = docs.withColumns({size: word_count(F.col("text")), key: F.xxhash64(F.coalesce("text", F.lit("")))}).where(F.col(size) > 0)
    one = tie.dropDuplicates(["doc_id", "source", size, key]) if _repeats(placed) else tie
    keys = [one["doc_id"].eqNullSafe(runs["doc_id"]), one["source"].cast("string").eqNullSafe(runs["source"]), one[size] == runs["size"], one[key] == runs["tie"]]
    joined = one.join(runs, keys[0] & keys[1] & keys[2] & keys[3]).select(*[one[c] for c in docs.columns], runs["size"].cast("long").alias(words), runs["cuts"].alias(own))
    return _cut(joined, docs)


def _repeats(placed: DataFrame) -> bool:
    return bool(placed.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND size > 0").head(1))


def _cut(joined: DataFrame, docs: DataFrame) -> DataFrame:
    own_names, text_at = docs.columns, docs.columns.index("text")
    width = len(own_names)
    chars_at = next((k for k, c in enumerate(docs.columns) if c == "n_chars"), None)
    pattern = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, cuts, texts = b.column(width).to_pylist(), b.column(width + 1).to_pylist(), b.column(text_at).to_pylist()
            take, out = [], []
            for i, (n, own, text) in enumerate(zip(words, cuts, texts, strict=True)):
                own, runs = [(c["a"], c["b"]) for c in own], []
                for a, z in own:  # sorted within each pass; a run goes on where the last one ended
                    if runs and runs[-1][1] == a:
                        runs[-1] = (runs[-1][0], z)
                    else:
                        runs.append((a, z))
                at = None
                for a, z in runs:
                    if (a, z) == (0, n):
                        out.append(text)
                    else:
                        at = at or [m.span() for m in pattern.finditer(text)]
                        out.append(text[at[a][0] : at[z - 1][1]])
                    take.append(i)
            rows = b.take(pa.array(take, pa.int64()))
            columns = rows.columns[:width]
            columns[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([len(x) for x in out], pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=own_names)

    return batches_of(joined, lean(run), docs.schema)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, drawn, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken(placed, drawn).select("doc_id", "size", "source_size", "target", "taken")
