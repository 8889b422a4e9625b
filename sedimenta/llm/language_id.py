"""Language of documents by a linear-chain conditional random field over their words.

Each word has features of its affixes (first and last one to three bytes), its trigrams, and its entry in a hashed lexicon; weights and
label transitions are learned together by forward-backward on sequences in which languages change, cut from a bounded sample of labelled
documents. Documents of any length are labelled exactly: each stretch of words is a product of transition matrices, the stretches of a
document are joined, and the marginals of all words summed. The language is the one with the largest expected share of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import _IS_WORD, _LETTER, batches_of, buffers, clean_name, lean, mix, remainder, slices, sole_memory, table, word_spans

#: Bound of the training sample: documents per language, characters of a document in it, sequences of SEQUENCE words.
SAMPLE_DOCS, SAMPLE_CHARS, SEQUENCES, SEQUENCE, EPOCHS = 120, 100_000, 1600, 64, 4
HASH_BITS, STRETCH, SEED = 18, 32, 5
#: Half way between two languages in equal parts (1/2 each), which are kept, and three (1/3 each), where none is clear.
LEAST_SCORE = 5 / 12
#: Bytes of text that are labelled at once; longer rows are taken in parts of this size, cut at white space where there is any.
PART_BYTES = 1 << 18
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def _slot(code: np.ndarray, salt: int) -> np.ndarray:
    h = (code.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Features:
    """Hashed feature places of all words of a stretch of text: `single` one place per word and kind, and trigrams by position."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, self.first = word_spans(data, offs)
        body = _FOLD[data[offs[0] : offs[-1]]] if len(offs) > 1 else np.zeros(0, np.uint32)
        self.n, last = len(starts), ends - 1
        self.starts, self.ends = starts, ends
        self.single: list[np.ndarray] = []
        if not self.n:
            self.tri = np.zeros(0, np.int64)
            return
        for k in range(1, 4):
            size = np.minimum(k, ends - starts)
            head, tail = np.zeros(self.n, np.uint32), np.zeros(self.n, np.uint32)
            for j in range(k):
                on = j < size
                head = np.where(on, head * np.uint32(256) + body[np.minimum(starts + j, last)], head)
                tail = np.where(on, tail + (body[np.maximum(last - j, starts)] << np.uint32(8 * j)), tail)
            self.single += [_slot(head, 2 * k), _slot(tail, 2 * k + 1)]
        # the lexicon's hash: sums of a random value per letter times its place's weight
        weight = mix(np.arange(len(body), dtype=np.uint64)[: min(len(body), 64)] + np.uint64(1)) | np.uint64(1)
        at = np.minimum(np.arange(len(body)) - np.repeat(starts, np.diff(np.append(starts, len(body)))) if starts[0] == 0 else np.arange(len(body)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(body))))]), 63)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[body] * weight[np.minimum(at, len(weight) - 1)])])
        self.single.append(_slot(mix(sums[ends] - sums[starts]) >> np.uint64(25), 9))
        tri = body.copy()
        tri[:-1] = tri[:-1] * np.uint32(256) + body[1:]
        tri[:-2] = tri[:-2] * np.uint32(256) + body[2:]
        self.tri = _slot(tri, 11)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, labels): the summed weights."""
        out = np.zeros((self.n, weights.shape[1]))
        if not self.n:
            return out
        for s in self.single:
            out += weights[s]
        sums = np.zeros((len(self.tri) + 1, weights.shape[1]))
        np.cumsum(weights[self.tri], axis=0, out=sums[1:])
        stop = np.maximum(self.ends - 2, self.starts)
        return out + sums[stop] - sums[self.starts]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """All (word, place) pairs, for training."""
        words = [np.arange(self.n)] * len(self.single)
        count = np.maximum(self.ends - 2 - self.starts, 0)
        word = np.repeat(np.arange(self.n), count)
        at = np.repeat(self.starts, count) + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        return np.concatenate([*words, word]), np.concatenate([*self.single, self.tri[at]])


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray):
        self.labels, self.weights, self.steps = labels, weights.astype(np.float32), steps

    def shares(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, labels): sums over a row's words of their marginals, over the number of words; zeros for rows without words."""
        f = Features(data, offs)
        rows, size = len(offs) - 1, len(self.labels)
        out = np.zeros((rows, size))
        if not f.n:
            return out
        counts = np.diff(f.first)
        return marginals(self._psi(f), counts, np.exp(self.steps)) / np.maximum(counts, 1)[:, None]

    def _psi(self, f: Features) -> np.ndarray:
        e = f.scores(self.weights)
        return np.exp(e - e.max(axis=1, keepdims=True))

    def long_shares(self, data: np.ndarray, most: int) -> np.ndarray:
        """(labels,): shares() of one text of any length, in parts: the products of all parts come first, then each part is labelled with the
        state before it and the one after it, so the result is exact and memory bounded by a part."""
        step, size = np.exp(self.steps), len(self.labels)
        cuts = word_cuts(data, most)
        part = lambda i: Features(data, np.array(cuts[i : i + 2]))
        products = [chain_product(self._psi(f), step) if (f := part(i)).n else None for i in range(len(cuts) - 1)]
        own = [i for i, x in enumerate(products) if x is not None]
        before, after = {}, {}
        v = chain_start(step)
        for i in own:
            before[i] = v
            v = v @ products[i]
            v = v / v.sum()
        v = np.ones(size)
        for i in reversed(own):
            after[i] = v
            v = products[i] @ v
            v = v / v.sum()
        out, n = np.zeros(size), 0
        for i in own:
            f = part(i)
            out += marginals(self._psi(f), np.array([f.n]), step, before[i], after[i])[0]
            n += f.n
        return out / max(n, 1)


def word_cuts(data: np.ndarray, most: int) -> list[int]:
    """Places from 0 to the end, at most about `most` apart, each at white space; a longer word stays whole."""
    out, end = [0], len(data)
    while out[-1] + most < end:
        at, white = out[-1] + most, np.zeros(0, np.int64)
        lo = out[-1]
        while not len(white) and lo < at:  # the last white space of the part, else the first behind it
            tail = max(lo, at - 4096)
            white = np.flatnonzero(~_IS_WORD[data[tail:at]]) + tail
            at = tail
        if len(white) and white[-1] > lo:
            out.append(int(white[-1]))
            continue
        at = lo + most
        while at < end and not len(white := np.flatnonzero(~_IS_WORD[data[at : at + 4096]])):
            at += 4096
        if at >= end:
            break
        out.append(at + int(white[0]))
    return [*out, end] if end > out[-1] else out


def chain_start(step: np.ndarray) -> np.ndarray:
    """The state before a chain: its first word has no step before it, and this vector undoes the step that the products take."""
    return np.linalg.lstsq(step.T, np.ones(len(step)), rcond=None)[0]


def chain_product(psi: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The product of all steps of a chain, up to a factor: stretches side by side, then the stretches in turn."""
    size = psi.shape[1]
    n = -(-len(psi) // STRETCH)
    padded = np.zeros((n * STRETCH, size))
    padded[: len(psi)] = psi
    on = (np.arange(n * STRETCH) < len(psi)).reshape(n, STRETCH)
    padded = padded.reshape(n, STRETCH, size)
    product = np.broadcast_to(np.eye(size), (n, size, size)).copy()
    for t in range(STRETCH):
        new = (product.reshape(-1, size) @ step).reshape(n, size, size) * padded[:, None, t]
        with np.errstate(invalid="ignore", divide="ignore"):
            new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(on[:, t, None, None], new, product)
    out = np.eye(size)
    for p in product:
        out = out @ p
        out /= out.sum()
    return out


def marginals(psi: np.ndarray, counts: np.ndarray, step: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """(rows, labels): summed word marginals of chains that lie end to end in psi, all chains at once and exactly. enter and leave: the states
    before and after the chains, if they are parts of longer ones."""
    rows, size = len(counts), psi.shape[1]
    stretches = -(-counts // STRETCH)
    first = np.cumsum(stretches) - stretches
    total = int(stretches.sum())
    row = np.repeat(np.arange(rows), stretches)
    nth = np.arange(total) - first[row]
    start = (np.cumsum(counts) - counts)[row] + nth * STRETCH
    length = np.minimum(STRETCH, counts[row] - nth * STRETCH)
    at = np.minimum(start[:, None] + np.arange(STRETCH), len(psi) - 1)
    on = np.arange(STRETCH) < length[:, None]
    psi = psi[at]  # (stretches, STRETCH, labels)
    product = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(STRETCH):
        new = (product.reshape(-1, size) @ step).reshape(total, size, size) * psi[:, None, t]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(on[:, t, None, None], new, product)
    # states before and after each stretch; the first word of a chain has no step before it, which the start state allows for
    before, after = np.empty((total, size)), np.empty((total, size))
    begin = chain_start(step) if enter is None else enter
    for k in range(int(stretches.max(initial=0))):
        own = first[stretches > k] + k
        if k == 0:
            before[own] = begin
        else:
            v = np.einsum("ni,nij->nj", before[own - 1], product[own - 1])
            before[own] = v / v.sum(axis=1, keepdims=True)
    for k in range(1, int(stretches.max(initial=0)) + 1):
        own = first[stretches >= k] + stretches[stretches >= k] - k
        if k == 1:
            after[own] = 1.0 if leave is None else leave
        else:
            v = np.einsum("nij,nj->ni", product[own + 1], after[own + 1])
            after[own] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((STRETCH, total, size))
    a = before
    for t in range(STRETCH):
        new = (a @ step) * psi[:, t]
        new /= new.sum(axis=1, keepdims=True)
        forward[t] = a = np.where(on[:, t, None], new, a)
    out, b = np.zeros((total, size)), after
    for t in reversed(range(STRETCH)):
        g = forward[t] * b
        g /= g.sum(axis=1, keepdims=True)
        out += np.where(on[:, t, None], g, 0)
        new = (b * psi[:, t]) @ step.T
        new /= new.sum(axis=1, keepdims=True)
        b = np.where(on[:, t, None], new, b)
    result = np.zeros((rows, size))
    np.add.at(result, row, out)
    return result


def train(texts: list[bytes], langs: list[str], sequences: int = SEQUENCES, epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """A model from labelled texts: runs of a text's words in random turn make sequences in which languages change."""
    labels = sorted(set(langs))
    if not labels:
        return None
    size = len(labels)
    pools = {}
    for k, name in enumerate(labels):
        words = [w for t, g in zip(texts, langs, strict=True) if g == name for w in t.split()]
        if words:
            pools[k] = words
    weights, steps = np.zeros((1 << HASH_BITS, size)), np.zeros((size, size))
    if size == 1 or not pools:
        return Model(labels, weights, steps)
    rng = np.random.default_rng(seed)
    kinds = sorted(pools)
    seqs: list[tuple[list[bytes], list[int]]] = []
    for _ in range(sequences):
        words: list[bytes] = []
        gold: list[int] = []
        while len(words) < SEQUENCE:
            k = kinds[rng.integers(len(kinds))]
            n = min(SEQUENCE - len(words), 1 + int(rng.geometric(1 / 24)))
            at = int(rng.integers(max(1, len(pools[k]) - n + 1)))
            run = pools[k][at : at + n]
            words += run
            gold += [k] * len(run)
        seqs.append((words, gold))
    grown, grown_steps = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    group = 50
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch]).permutation(len(seqs))
        for lo in range(0, len(order), group):
            own = [seqs[k] for k in order[lo : lo + group]]
            text = b" ".join(w for s in own for w in s[0])
            f = Features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            gold = np.array([g for s in own for g in s[1]])
            n, t = len(own), SEQUENCE
            e = f.scores(weights)
            psi = np.exp(e - e.max(axis=1, keepdims=True)).reshape(n, t, size)
            step = np.exp(steps)
            fw, bw = np.empty((t, n, size)), np.empty((t, n, size))
            fw[0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
            for k in range(1, t):
                v = (fw[k - 1] @ step) * psi[:, k]
                fw[k] = v / v.sum(axis=1, keepdims=True)
            bw[-1] = 1.0
            for k in range(t - 2, -1, -1):
                v = (bw[k + 1] * psi[:, k + 1]) @ step.T
                bw[k] = v / v.sum(axis=1, keepdims=True)
            g = fw * bw
            g /= g.sum(axis=2, keepdims=True)
            pair = np.einsum("tni,ij,tnj->tnij", fw[:-1], step, bw[1:] * psi.transpose(1, 0, 2)[1:])
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            goal = gold.reshape(n, t)
            seen = np.zeros((size, size))
            np.add.at(seen, (goal[:, :-1].ravel(), goal[:, 1:].ravel()), 1)
            move = (pair.sum(axis=(0, 1)) - seen) / n
            grown_steps += move**2
            steps -= 0.3 * move / np.sqrt(grown_steps)
            diff = g.transpose(1, 0, 2).reshape(-1, size)
            diff[np.arange(len(gold)), gold] -= 1
            word, place = f.places()
            used, back = np.unique(place, return_inverse=True)
            move = np.stack([np.bincount(back, diff[word, c], len(used)) for c in range(size)], axis=1) + 1e-3 * weights[used]
            grown[used] += move**2
            weights[used] -= 0.3 * move / np.sqrt(grown[used])
    return Model(labels, weights, steps)


def sample(docs: DataFrame, per_label: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[str]]:
    """Whole texts of about per_label documents for each language, by a hash of text and id; longer ones than most_chars stay out of the sample."""
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= most_chars)
    share = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    wanted = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_label / n)))]), F.col("lang"))
    few = own.withColumn("_h", share).where(F.col("_h") <= wanted)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))
    rows = few.withColumn("_n", rank).where(F.col("_n") <= per_label).select("text", "lang", "_h").orderBy("lang", "_h", "text").collect()
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, **settings) -> Model | None:
    return train(*sample(docs), **settings)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (renamed if docs has such columns).

    Null texts and texts without a letter are `und` with score 0, and so is every text if nothing was learned. Score is the share of words,
    in expectation, that are in the language. Texts of any length are labelled whole, in parts of bounded memory. Rows that repeat and other
    columns need no care; an empty table stays empty.
    """
    names = [clean_name(docs, n) for n in ("lang_pred", "score")]
    flag = clean_name(docs, "has_letter")
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.steps) if model else None)  # 2^HASH_BITS weights a label
    columns_, text_at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory()
        own = Model(*sent.value) if sent.value else None
        for b in batches:
            letter = np.array(b.column(len(columns_)).fill_null(False).to_pylist(), bool)
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            if own:
                data, offs = buffers(b.column(text_at))
                for i, j in slices(offs, PART_BYTES):
                    long_ = offs[j] - offs[i] > 2 * PART_BYTES  # then it is one row
                    shares = own.long_shares(data[offs[i] : offs[j]], PART_BYTES)[None] if long_ else own.shares(data, offs[i : j + 1])
                    best = shares.argmax(axis=1)
                    for k in range(i, j):
                        if letter[k]:
                            langs[k], scores[k] = own.labels[best[k - i]], float(min(1.0, max(0.0, shares[k - i, best[k - i]])))
            columns = b.columns[: len(columns_)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(scores, pa.float64())], names=[*columns_, *names])

    flagged = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return batches_of(flagged, lean(run), "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields) + f"`{names[0]}` string, `{names[1]}` double")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is found with a score of `least` or more, learned from docs' own labels; columns as in docs."""
    names = [clean_name(docs, n) for n in ("lang_pred", "score")]
    return predict(docs, fit(docs)).where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(remainder("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
