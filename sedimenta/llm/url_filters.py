"""URL verdicts: explicit host and path rules, else naive Bayes over segmented host names and path tokens.

Words and their counts come from all urls: path tokens, and the parts of host names that are written apart (with hyphens). Viterbi splits
every name part into the likeliest words by these counts; runs of characters outside of known words cost as unknown words do (10 to the
minus length, over all counts). The classifier is multinomial naive Bayes with add-one smoothing over host words, the last label of the
host, and path tokens. It learns from labelled urls; without other labels these are the urls that a rule covers, with the rule's verdict, so it carries over to other hosts
and paths what the rules say of some. No list of words stands behind it, and no word or token is left out for being rare.

Word counts and token counts stay distributed: urls are dealt to blocks, and each block asks once for what it holds. A host with a third of
all urls is spread over the blocks, and costs each block one question.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import batches_of, clean_name, small_batches, table, written

#: (verdict, host, path start); a rule holds for its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Urls in a block, the longest run of characters that is looked up as one word, and hot urls that are broadcast (more go by a shuffled join).
BLOCK_ROWS, LONGEST, BROADCAST_URLS = 50_000, 32, 100_000
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. Longest: by host, then by path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _labels(host: str) -> list[str]:
    return (host.rpartition(":")[0] if re.search(r":\d*$", host) else host).split(".")


def name_parts(host: str) -> list[list[str]]:
    """The parts of each label of the host but the last."""
    return [[x for x in re.split(r"[^\w]|_", label) if x] for label in _labels(host)[:-1]]


def domain(host: str) -> list[str]:
    """The last label, a token of its own kind."""
    return ["." + x for x in _labels(host)[-1:] if x]


def path_tokens(path: str) -> list[str]:
    """Path tokens; runs of digits become one #."""
    return [re.sub(r"\d+", "#", x) for x in re.split(r"[\W_]+", path.lower()) if x]


def known_words(host: str, path: str) -> list[str]:
    """What a url says about words: parts of names written apart, and path tokens without digits."""
    return [x for label in name_parts(host) if len(label) > 1 for x in label if x.isalpha()] + [x for x in path_tokens(path) if x.isalpha()]


def substrings(name: str, longest: int = LONGEST) -> set[str]:
    return {name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + longest) + 1)}


def segment(name: str, counts: dict[str, int], total: int, longest: int = LONGEST) -> tuple[str, ...]:
    """The likeliest split into words. A run of m characters outside of known words has the probability 10 / (total * 10^m)."""
    base = math.log(max(total, 1))
    char, start = -math.log(10), math.log(10) - base
    #: per end: (score, begin, known); an unknown run grows by a character at a time and pays its start once
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    open_: list[tuple[float, int]] = [(-math.inf, 0)]
    for j in range(1, len(name) + 1):
        grown, begun = open_[j - 1][0] + char, best[j - 1][0] + start + char
        open_.append((grown, open_[j - 1][1]) if grown >= begun else (begun, j - 1))
        top = (open_[j][0], open_[j][1], False)
        for i in range(max(0, j - longest), j):
            if (n := counts.get(name[i:j])) and (s := best[i][0] + math.log(n) - base) > top[0]:
                top = (s, i, True)
        best.append(top)
    out, j = [], len(name)
    while j:
        i = best[j][1]
        out.append(name[i:j])
        j = i
    return tuple(reversed(out))


def _listed(words_of: Callable[[pa.RecordBatch], Iterable[tuple[str, int]]], flush: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's words with their counts, passed on whenever `flush` different ones are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for b in batches:
            for w, n in words_of(b):
                held[w] = held.get(w, 0) + n
                if len(held) >= flush:
                    yield out()
        if held:
            yield out()

    return run


def word_counts(urls: DataFrame) -> DataFrame:
    """(word, n) over all urls (host, path, n)."""
    words = lambda b: ((w, n) for h, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in known_words(h, p))
    return batches_of(urls.select("host", "path", "n"), _listed(words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _asked(blocked: DataFrame, words_of: Callable[[pa.RecordBatch], Iterable[tuple[int, str]]], lookup: DataFrame) -> DataFrame:
    """(block, word, the other columns of lookup) for each word that a block holds and lookup knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, str]] = set()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string())], names=["block", "word"])
            held.clear()
            return made

        for b in batches:
            for x in words_of(b):
                held.add(x)
                if len(held) >= 200_000:
                    yield out()
        if held:
            yield out()

    return batches_of(blocked, run, "block long, word string").distinct().join(lookup, "word").select("block", "word", *[c for c in lookup.columns if c != "word"])


def segmented(urls: DataFrame, counts: DataFrame, total: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(host, path, label, n, tokens) of all rows of urls (host, path, label, n): host words, the last label with a leading dot, path
    tokens with a leading slash."""
    blocks = max(1, -(-urls.count() // block_rows))
    blocked = urls.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(blocks))).select("host", "path", "label", "n", "block").repartition("block")

    def words_of(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        for host, block in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
            for label in name_parts(host):
                for part in label:
                    for w in substrings(part):
                        yield block, w

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("word").to_pylist(), right.column("n").to_pylist(), strict=True))
        seen: dict[str, tuple[str, ...]] = {}
        out = []
        for host, path in zip(left.column("host").to_pylist(), left.column("path").to_pylist(), strict=True):
            tokens: list[str] = []
            for label in name_parts(host):
                for part in label:
                    if part not in seen:
                        seen[part] = segment(part, known, total)
                    tokens += seen[part]
            out.append(tokens + domain(host) + ["/" + x for x in path_tokens(path)])
        return left.select(["host", "path", "label", "n"]).append_column("tokens", pa.array(out, pa.list_(pa.string())))

    answers = _asked(blocked, words_of, counts)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(split, "host string, path string, label string, n long, tokens array<string>")


def token_odds(tokens: DataFrame) -> DataFrame:
    """(word, odds) of all tokens of labelled urls from (tokens, label, n): log P(token | block) - log P(token | allow), add-one."""
    labelled = tokens.where("label IS NOT NULL")
    of = lambda what: F.sum(F.when(F.col("label") == what, F.col("n")).otherwise(0))
    counts = written(labelled.select(F.explode("tokens").alias("word"), "label", "n").groupBy("word").agg(of("allow").alias("a"), of("block").alias("b")), "url-tokens")
    v, a, b = (int(x or 0) for x in counts.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first())
    return counts.select("word", (F.log((F.col("b") + 1) / F.lit(float(b + v + 1))) - F.log((F.col("a") + 1) / F.lit(float(a + v + 1)))).alias("odds"))


def scored(tokens: DataFrame, odds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(host, path, score): the summed odds of all tokens; tokens without odds say nothing. Both classes start equal, for how many urls of each
    the rules happen to cover says nothing about the others."""
    blocks = max(1, -(-tokens.count() // block_rows))
    blocked = tokens.withColumn("block", F.pmod(F.xxhash64("path", "host"), F.lit(blocks))).select("host", "path", "tokens", "block").repartition("block")

    def words_of(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        for own, block in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            for w in own:
                yield block, w

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("word").to_pylist(), right.column("odds").to_pylist(), strict=True))
        out = [math.fsum(known.get(w, 0.0) for w in own) for own in left.column("tokens").to_pylist()]
        return left.select(["host", "path"]).append_column("score", pa.array(out, pa.float64()))

    return blocked.groupBy("block").cogroup(_asked(blocked, words_of, odds).groupBy("block")).applyInArrow(add, "host string, path string, score double")


def judge_urls(df: DataFrame, rules=RULES, labels: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (url, any others) with host, path, rule, verdict, score (renamed if df has such columns).

    labels says what to learn from: 'allow', 'block' or null for each row, by columns of df; by default the rules' verdicts. Urls that are
    null or lack :// have empty host and path, fit no rule and score 0. score is the log odds of block, also where a rule
    decides; a score of just 0 allows. Rows that repeat are judged alike and come back as often as they are there, and each counts in
    learning; urls may be of any length; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    names = [clean_name(df, n) for n in ("host", "path", "rule", "verdict", "score")]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # urls with equal host and path are judged once, and one label counts as often as rows have it
    label = rule_columns(host, path, rules)[1] if labels is None else labels
    each = df.select(host.alias("host"), path.alias("path"), label.cast("string").alias("label")).groupBy("host", "path", "label").agg(F.count(F.lit(1)).alias("n"))
    urls = written(each, "urls")
    counts = written(word_counts(urls), "url-words")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    tokens = written(segmented(urls, counts, total, block_rows), "url-segments")
    scores = written(scored(tokens.dropDuplicates(["host", "path"]), token_odds(tokens), block_rows), "url-scores")
    return _with_scores(df, names, host, path, rules, scores, urls, block_rows)


def _with_scores(df: DataFrame, names: list[str], host: Column, path: Column, rules, scores: DataFrame, urls: DataFrame, block_rows: int) -> DataFrame:
    """df joined to the scores by host and path. Of urls with more than block_rows rows, which are few, the score goes to as many shares as
    the rows fill blocks, and the rows are dealt to these."""
    key = [clean_name(df, f"url_{c}") for c in ("host", "path", "share", "score", "shares")]
    several = F.ceil(F.col("n") / block_rows).cast("int").alias(key[4])
    hot = written(urls.groupBy("host", "path").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).select(F.col("host").alias(key[0]), F.col("path").alias(key[1]), several), "url-hot")
    few = F.broadcast(hot) if hot.count() <= BROADCAST_URLS else hot
    rule, verdict = rule_columns(host, path, rules)
    rows = df.withColumns({names[0]: host, names[1]: path, names[2]: rule, names[3]: verdict, key[0]: host, key[1]: path})
    rows = rows.join(few, key[:2], "left").withColumn(key[2], F.floor(F.rand(7) * F.coalesce(F.col(key[4]), F.lit(1))).cast("int"))
    spread = scores.select(F.col("host").alias(key[0]), F.col("path").alias(key[1]), F.col("score").alias(key[3])).join(few, key[:2], "left")
    spread = spread.withColumn(key[2], F.explode(F.sequence(F.lit(0), F.coalesce(F.col(key[4]), F.lit(1)) - 1))).drop(key[4])
    found = rows.drop(key[4]).join(spread, key[:3])
    final = F.coalesce(F.col(names[3]), F.when(F.col(key[3]) > 0, "block").otherwise("allow"))
    return found.select(*df.columns, *names[:3], final.alias(names[3]), F.col(key[3]).alias(names[4]))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
