"""Problem 7: a mixture of sources by target shares of its size in tokens.

Documents are counted by their exact token length. A source contributes whole passes over its documents as often as its budget
(target weight times the size of all counted documents) allows, up to its cap, and for the rest of the budget a subset whose
lengths add up to it: a proportional share of every length, then single documents while the gap is wide, then bounded-knapsack
dynamic programming over the lengths that remain. Which documents of a length are taken is settled by a seeded hash.

Defined cases: source names compare without case and outer spaces; documents without a listed source don't count; null texts
have no tokens; null weights are 0 and null caps are 1; a listed source without documents takes max_passes and falls short
unless its target is 0, which takes 0 passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..parallel import spread
from ..scratch import written

#: Vocabulary file (``tokenizers`` format) whose tokens are counted: white space separates, and is no token.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Counted chunks that one task remembers.
MEMO = 300_000
#: Documents of one length are dealt into hash buckets before they are ranked: so many at least, and one for so many documents.
RANK_BUCKETS, RANK_ROWS = 256, 1_000_000
#: The dynamic program covers so many of the longest documents, and so many tokens at least.
WINDOW_DOCUMENTS, WINDOW_TOKENS = 8, 1 << 16
# Characters that Python's split() takes for white space and the tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def key(c: Column) -> Column:
    """A source name as it is compared."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


@cache
def _encoder(vocabulary: bytes):  # noqa: ANN202
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(vocabulary)
    t.encode_special_tokens = True
    return t


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The contents of a vocabulary file."""
    with open(path, "rb") as f:
        return f.read()


class Counter:
    """Exact token counts. No token spans white space, so a text's count is the sum over its chunks, and those recur."""

    def __init__(self, contents: bytes | None = None) -> None:
        self.encoder, self.memo = _encoder(vocabulary() if contents is None else contents), {}

    def direct(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        for t in texts:
            if not t:
                out.append(0)
                continue
            if any(c in t for c in _SEPARATORS):
                out += self.direct([t])
                continue
            words = t.split()
            try:
                out.append(sum([self.memo[w] for w in words]))
            except KeyError:
                new = list({w for w in words if w not in self.memo})
                known = dict(zip(new, self.direct(new), strict=True))
                out.append(sum(self.memo[w] if w in self.memo else known[w] for w in words))
                if len(self.memo) + len(known) > MEMO:
                    self.memo.clear()
                self.memo.update((w, n) for w, n in known.items() if len(w) < 64)
        return out


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the text replaced by its number of tokens (bigint). The vocabulary file is read by the driver and shipped (a few
    MB), so no other machine needs it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("tokens", "long")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            n = counter.count(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, "tokens"])

    return docs.select(*rest, text).mapInArrow(go, schema)


def _passes(goal: Fraction, size: int, most: int) -> tuple[int, bool]:
    """The least number of passes that reaches the goal, and whether even the most fall short."""
    if goal <= 0:
        return 0, False
    need = math.ceil(goal / size) if size else most + 1
    return min(need, most), need > most


def _reach(reach: int, length: int, n: int, limit: int) -> int:
    """The sums (a bit each) that can be reached with up to n more of a length."""
    k = 1
    while n > 0:  # binary splitting of the count
        k = min(k, n)
        reach |= reach << k * length & limit
        n -= k
        k *= 2
    return reach


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that they add up to the budget, or as near below it as can be. What could be reached
    before each length is kept for every square root of them and computed anew for the others, so memory stays small."""
    limit = (1 << budget + 1) - 1
    most = [min(n, budget // m) if m else 0 for m, n in zip(lengths, counts, strict=True)]
    step = max(1, math.isqrt(len(lengths)))
    reach, kept = 1, []
    for i, (m, n) in enumerate(zip(lengths, most, strict=True)):
        if i % step == 0:
            kept.append(reach)
        reach = _reach(reach, m, n, limit)
    at = reach.bit_length() - 1
    take = [0] * len(lengths)
    for block in range(len(kept) - 1, -1, -1):
        own = range(block * step, min(len(lengths), (block + 1) * step))
        before = [kept[block]]
        for i in own[:-1]:
            before.append(_reach(before[-1], lengths[i], most[i], limit))
        for i in reversed(own):
            b = before.pop()
            while not b >> at & 1:
                at -= lengths[i]
                take[i] += 1
    return take


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Subset-sum fit of the budget over a histogram of lengths (ascending, above 0); budget below the summed lengths. Budgets of up
    to WINDOW_DOCUMENTS of the longest documents (or WINDOW_TOKENS) are fitted exactly; of larger ones half of such a window is."""
    total = sum(n * m for n, m in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    window = max(WINDOW_TOKENS, WINDOW_DOCUMENTS * lengths[-1])
    take = [n * max(0, budget - window // 2) // total for n in counts] if budget > window else [0] * len(lengths)
    gap = budget - sum(t * m for t, m in zip(take, lengths, strict=True))
    for i in range(len(lengths) - 1, -1, -1):  # what rounding has left out, the longest first
        if gap > window and take[i] < counts[i]:
            more = min(counts[i] - take[i], -(-(gap - window) // lengths[i]))
            take[i] += more
            gap -= more * lengths[i]
    small = [i for i, n in enumerate(lengths) if n <= gap and counts[i] > take[i]]
    more = knapsack([lengths[i] for i in small], [counts[i] - take[i] for i in small], gap)
    for i, k in zip(small, more, strict=True):
        take[i] += k
    return take


def plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, key, target_weight, source_tokens, goal (tokens), n_passes, falls_short, full (whole
    passes), rest (tokens of the part of a pass). ``counted``: columns key, tokens. ``targets``: a configuration table (source,
    target_weight, max_passes) of at most 100,000 rows, which is checked."""
    rows = targets.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 sources")
    sizes = {r["key"]: int(r["tokens"] or 0) for r in counted.groupBy("key").agg(F.sum("tokens").alias("tokens")).collect()}
    size = sum(sizes.values())
    out = []
    for r in rows:
        name = (r["source"] or "").strip().lower()
        own, most = sizes.get(name, 0), 1 if r["max_passes"] is None else int(r["max_passes"])
        goal = Fraction(repr(float(r["target_weight"] or 0))) * size
        n, short = _passes(goal, own, most)
        tokens = min(round(goal), most * own)
        full = min(most, tokens // own) if own else 0
        out.append((r["source"], name, float(r["target_weight"] or 0), own, int(round(goal)), n, int(short), full, tokens - full * own))
    schema = "source string, key string, target_weight double, source_tokens long, goal long, n_passes long, falls_short long, full long, rest long"
    return targets.sparkSession.createDataFrame(out, schema)


def count_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, key and tokens of the documents of listed sources, as a table in the shared folder."""
    keys = targets.where(F.col("source").isNotNull()).select(key(F.col("source")).alias("key")).distinct()
    d = spread(docs.select("doc_id", key(F.col("source")).alias("key"), "text"), "doc_id").join(keys, "key", "left_semi")
    return written(token_counts(d, tokenizer=tokenizer).select("doc_id", "key", "tokens"), "token-counts")


def select(counted: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """The mixture: doc_id, key, tokens and how many ``passes`` it makes through the document (only those above 0)."""
    sizes = counted.where("tokens > 0").groupBy("key", "tokens").agg(F.count(F.lit(1)).alias("n"))
    # A source's different lengths go to one task: at most the square root of twice its tokens, however many documents it has.
    wanted = sizes.join(planned.where("rest > 0").select("key", "rest"), "key")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens", ignore_index=True)
        take = fit([int(x) for x in pdf["tokens"]], [int(x) for x in pdf["n"]], int(pdf["rest"].iloc[0]))
        return pdf[["key", "tokens"]].assign(take=take)

    # An express number of tasks, so that sources aren't folded into one.
    take = wanted.repartition(wanted.sparkSession.sparkContext.defaultParallelism, "key").groupBy("key").applyInPandas(one, "key string, tokens long, take long")
    buckets = max(RANK_BUCKETS, -(-counted.count() // RANK_ROWS))
    h = F.xxhash64("doc_id", F.lit(seed))
    dealt = counted.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    by_bucket = dealt.groupBy("key", "tokens", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = by_bucket.withColumn("_before", F.sum("_n").over(W.partitionBy("key", "tokens").orderBy("_b")) - F.col("_n")).drop("_n")
    before = before.join(take, ["key", "tokens"]).where(F.col("_before") < F.col("take"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("key", "tokens", "_b").orderBy("_h", "doc_id")))
    extra = ranked.join(before, ["key", "tokens", "_b"]).where(F.col("_before") + F.col("_r") <= F.col("take")).select("doc_id", F.lit(1).alias("_extra"))
    whole = counted.join(planned.select("key", "full"), "key")
    out = whole.join(extra, "doc_id", "left").withColumn("passes", F.col("full") + F.coalesce("_extra", F.lit(0)))
    return out.where("passes > 0").select("doc_id", "key", "tokens", "passes")
