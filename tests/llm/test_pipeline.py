from collections import Counter

import corpus_pipeline as P


def test_stages_in_order_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        before = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r[0] for r in before.select("doc_id").distinct().collect()}
    packed = P.STAGES[-1][1](spark, before, sf).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    seen = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert rows and max(seen.values()) == 1


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.identify(spark, docs, sf)
    words = docs.where("text rlike '[a-z]{3}'").count()
    assert kept.count() >= 0.97 * words


def test_awkward_documents(spark, docs, empty):
    before = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, before, "")
        before = spark.createDataFrame(out.collect(), docs.schema)
    assert before.count() and P.STAGES[-1][1](spark, before, "").count()
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_run_against_brute_force(spark, sf):
    """Language by the model's own answers, then lines, near copies and tokens by plain code; the mix is held against its quotas."""
    import struct
    import zlib

    import test_line_dedup
    import test_mixing
    import test_near_dedup
    from tokenizers import Tokenizer

    from sedimenta.llm import language_id, mixing, packing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    rows = [tuple(r) for r in docs.collect() if found[r["doc_id"]][0] != "und" and found[r["doc_id"]][1] >= language_id.LEAST_SCORE]
    text = {i: t for i, t, _, _ in test_line_dedup.brute(rows)}
    kept = [i for i, (_, _, k) in test_near_dedup.brute(text.items(), 5).items() if k]
    left = [(r[0], text[r[0]], r[2], r[3], len(text[r[0]])) for r in rows if r[0] in set(kept)]
    mixed = mixing.mixed_documents(spark.createDataFrame(left, docs.schema)).collect()
    size, taken = Counter(), Counter()
    for r in left:
        size[r[3]] += len(test_mixing.words(r[1]))
    for r in mixed:
        taken[r["source"]] += len(test_mixing.words(r["text"]))
    for s in mixing.plan(list(size.items())):
        assert taken[s["source"]] == s["quota"]
    tool = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in mixed:
        ids = tool.encode(r["text"], add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    out = P.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
