"""Sources mixed to target weights by balanced sampling.

Sizes are tokens of a public tokenizer. A source's documents are each wanted m times, m being its token
target over its tokens. The whole part of m is given to every document; for the rest, the cube method moves the
fractional inclusion probabilities through the null space of the constraints (documents and tokens of the source), each
move fixing one document at 0 or 1 while both totals stay exactly as they were. Buckets of bounded size are
worked on side by side and leave at most two undecided documents each; those are pooled and worked on again until at
most two for each source remain, which are landed on the corner nearest in tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celltrack.llm.truncation import source_name
from celltrack.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_DOCS = 4096
EDGE = 1e-9


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)``: null and empty texts have 0 tokens; rows without doc_id are left out. Of rows
    of one doc_id that of the first source by name, then of the fewest tokens, counts.

    ``tokenizer`` is a file of merge ranks at the same path on every executor.
    """
    base = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    counted = base.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("m")).select("doc_id", "m.*")


def targets(sizes: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, weight, max_repeats, docs, tokens, share, want, copies)``, a row for each target source.

    Names are compared like those of the documents; a source listed twice has its weights added and its
    smallest cap. Null or non-positive weights and caps below one want nothing. ``share`` is over the sources that have tokens.
    ``want`` tokens add up to ``total_tokens``, by default the largest total at which every source reaches its share
    within its cap; a source that cannot is used up to its cap. ``copies`` = want / tokens.
    """
    listed = (
        mix_targets.select(source_name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
        .filter("weight > 0 AND NOT isnan(weight) AND max_repeats >= 1")
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    )
    have = sizes.filter("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    t = listed.join(have, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    every = Window.partitionBy(F.lit(0))  # a row for each target source
    t = t.withColumn("share", F.when(F.col("tokens") > 0, F.col("weight") / F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).over(every)).otherwise(F.lit(0.0)))
    room = F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))
    t = t.withColumn("total", F.min(room).over(every) if total_tokens is None else F.lit(float(total_tokens)))
    t = t.withColumn("want", F.least(F.col("share") * F.col("total"), (F.col("max_repeats") * F.col("tokens")).cast("double")))
    return t.select("source", "weight", "max_repeats", "docs", "tokens", "share", "want", F.when(F.col("tokens") > 0, F.least(F.col("want") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("copies"))


def flight(prob: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move probabilities to 0 or 1, three undecided documents at a time, keeping count and token totals.

    At most two entries stay undecided. The walk is fixed by the entries and the seed alone.
    """
    p = prob.astype(float).copy()
    rng = np.random.default_rng([len(p), int(size.sum()), seed])
    draws = rng.random(len(p) + 1)
    trio: list[int] = []
    used = 0
    for nxt in range(len(p)):
        if EDGE < p[nxt] < 1 - EDGE:
            trio.append(nxt)
        while len(trio) == 3:
            i, j, k = trio
            u = (float(size[j] - size[k]), float(size[k] - size[i]), float(size[i] - size[j]))
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for x, d in zip(trio, u):
                if d > 0:
                    up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
                elif d < 0:
                    up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
            step = up if draws[used % len(draws)] * (up + down) < down else -down
            used += 1
            for x, d in zip(trio, u):
                p[x] = min(1.0, max(0.0, p[x] + step * d))
            trio = [x for x in trio if EDGE < p[x] < 1 - EDGE]
    p[p <= EDGE] = 0.0
    p[p >= 1 - EDGE] = 1.0
    return p


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few: the corner whose tokens are nearest to those expected."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    want = float((prob[open_] * size[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: abs(sum(float(size[x]) for b, x in enumerate(open_) if m >> b & 1) - want))
    out = prob.copy()
    for b, x in enumerate(open_):
        out[x] = float(best >> b & 1)
    return out


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["key", "doc_id"], ignore_index=True)
    p = flight(rows["p"].to_numpy(), rows["n_tokens"].to_numpy())
    if rows["buckets"].iat[0] == 1:
        p = land(p, rows["n_tokens"].to_numpy())
    return rows.assign(p=p)


def _bucketed(open_: DataFrame) -> DataFrame:
    """Buckets of about BUCKET_DOCS undecided documents of one source."""
    n = open_.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BUCKET_DOCS)).cast("bigint").alias("buckets"))
    return open_.join(n, "source").withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(7)), F.col("buckets")))


def mix(docs: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, sizes: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of every document that is used, copies from 1 to the source's cap.

    Each source's tokens differ from its target by less than a few documents. Documents without tokens and sources
    without target are not used; targets without documents have no rows. The result is the same on every run.
    """
    sizes = cut(token_counts(docs, tokenizer)) if sizes is None else sizes
    want = targets(sizes, mix_targets, total_tokens).select("source", F.col("copies").alias("m"), "max_repeats").filter("m > 0")
    per = sizes.filter("n_tokens > 0").join(want, "source").withColumn("whole", F.floor(F.col("m") + EDGE))
    per = per.withColumn("p", F.greatest(F.lit(0.0), F.col("m") - F.col("whole")))
    per = cut(per.select("doc_id", "source", "n_tokens", "whole", "p", F.xxhash64("doc_id", F.lit("mix")).alias("key")))
    schema = "doc_id bigint, source string, n_tokens bigint, key bigint, p double, buckets bigint, bucket bigint"
    open_ = per.filter(f"p > {EDGE}").select("doc_id", "source", "n_tokens", "key", "p")
    decided: list[DataFrame] = []
    while True:
        walked = cut(_bucketed(open_).select("doc_id", "source", "n_tokens", "key", "p", "buckets", "bucket").groupBy("source", "bucket").applyInPandas(_walk, schema))
        decided.append(walked.filter("p = 0 OR p = 1").select("doc_id", "p"))
        open_ = walked.filter("p > 0 AND p < 1").select("doc_id", "source", "n_tokens", "key", "p")
        if open_.isEmpty():
            break
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionByName(d)
    picked = extra.filter("p = 1").select("doc_id", F.lit(1).alias("more"))
    return per.join(picked, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies")).filter("copies > 0")


def mix_shares(docs: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(source, weight, max_repeats, docs, tokens, target_share, want_tokens, used_docs, used_tokens, share)``.

    ``target_share`` is the listed weight's share over all targets, those without documents included; ``share`` is
    what the mix really has.
    """
    sizes = cut(token_counts(docs, tokenizer))
    t = targets(sizes, mix_targets, total_tokens)
    chosen = mix(docs, mix_targets, total_tokens, tokenizer, sizes)
    used = chosen.groupBy("source").agg(F.sum("copies").alias("used_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"))
    every = Window.partitionBy(F.lit(0))  # a row for each target source
    tokens: Column = F.coalesce("used_tokens", F.lit(0))
    j = t.join(used, "source", "left").withColumns({"mixed": F.sum("used_tokens").over(every), "all_w": F.sum("weight").over(every)})
    return j.select(
        "source", "weight", "max_repeats", "docs", "tokens", (F.col("weight") / F.col("all_w")).alias("target_share"), F.col("want").alias("want_tokens"),
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), tokens.alias("used_tokens"), (tokens / F.col("mixed")).alias("share"),
    )
