import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import packing as P


@pytest.fixture(scope="module")
def tool():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def optimum(lengths, capacity):
    """Fewest sequences, by trying all ways for a few pieces."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity:
                bins[b] += lengths[k]
                place(k + 1, bins)
                bins[b] -= lengths[k]
        bins.append(lengths[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def filled(plan):
    bins = defaultdict(list)
    for length, first, end, per, seq, offset in plan.ranges:
        for r in range(first, end):
            bins[seq + (r - first) // per].append((offset + (r - first) % per * length, length))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=200))
def test_plans_are_packings(lengths):
    plan = P.pack(Counter(lengths), 20)
    bins = filled(plan)
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 20
    assert len(bins) == plan.sequences


def loss(lengths, capacity):
    """Sequences that the reduction costs against the optimum."""
    plan = P.Plan(Counter(lengths), capacity)
    P.reduce(plan)
    rest = [k for k, n in plan.left.items() for _ in range(n)]
    return plan.sequences + optimum(rest, capacity) - optimum(lengths, capacity)


@settings(max_examples=300, deadline=None)
@given(st.integers(20, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(max(1, c // 6), c), max_size=11))))
def test_reduction_keeps_the_optimum(case):
    assert loss(case[1], case[0]) == 0


@pytest.mark.parametrize(("capacity", "lengths"), [(25, [5, 7, 8, 9, 10, 10, 11, 12, 12, 15]), (20, [5, 5, 6, 7, 8, 8, 9, 9, 10, 11]), (10, [5, 5, 9, 1]), (20, [10, 10, 10, 5, 5, 5, 5]), (21, [7] * 7)])
def test_an_exact_pair_alone_does_not_dominate(capacity, lengths):
    assert loss(lengths, capacity) == 0


def test_the_number_of_ranges_is_bounded_by_the_capacity():
    rng = random.Random(2)
    for most in (1, 3, 1000, 10**9):
        for low in (1, 20, 70):
            plan = P.pack({k: rng.randint(1, most) for k in range(low, 201)}, 200)
            assert len(plan.ranges) <= 10 * 200


def test_near_the_lower_bound():
    rng = random.Random(1)
    lengths = [rng.randint(1, 4096) for _ in range(20_000)]
    plan = P.pack(Counter(lengths))
    assert plan.sequences <= 1.01 * -(-sum(lengths) // 4096) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    tool = test_ids_are_the_tokenizers.__dict__.setdefault("tool", Tokenizer.from_file(P.default_tokenizer()))
    raw = text.encode("utf-8", "replace")
    want = tool.encode(raw.decode(), add_special_tokens=False).ids
    assert P.fast_ids(P.default_tokenizer()).encode(raw) == struct.pack(f"<{len(want)}I", *want)


TRICKY = ["don't 'sss we'll 'LL IT'S", "<|endoftext|> a<|startoftext|>b < | >", "ÀÉ straße ß İ ŉ ſ ĸ", "e\u0301 a\u0308b", "１２３ 12ab34 x²½", "a\u00a0b\u2003c\u3000d\x85e", "Σίσυφος ΟΔΟΣ", "日本語 テキスト", "😀👍🏽", "\x00\x01 a\u200db \ufeff", "'S 'sS ''s", "ŁŒæ ñandú ¿qué? ¡no!"]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_of_tricky_texts(tool, text):
    want = tool.encode(text, add_special_tokens=False).ids
    fast = P.fast_ids(P.default_tokenizer())
    assert fast.safe and fast.encode(text.encode()) == struct.pack(f"<{len(want)}I", *want)


def check(out, rows, tool, capacity=4096):
    want = Counter()
    for i, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) <= 1.02 * sum(r["length"] for r in out) / capacity + 2


def test_query_against_brute_force(spark, rows, docs, tool, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(P.op7_best_fit_packing(spark, str(tmp_path)).collect(), [r[:2] for r in rows], tool)


def test_query_on_the_tables(spark, sf, tool):
    check(P.op7_best_fit_packing(spark, sf).collect(), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], tool)


def test_ids_column_and_empty_table(docs, empty):
    out = P.pack_documents(docs, with_ids=True, capacity=100).collect()
    assert all(len(r["ids"]) == r["length"] <= 100 for r in out)
    assert P.pack_documents(empty).collect() == []


