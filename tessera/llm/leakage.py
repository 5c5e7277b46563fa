"""Problem 6: passages of held-out test items in the texts of a corpus.

The items' pairs of neighbouring words (an item of two words or fewer: its words) are the terms of a BM25 inverted index: postings
sorted by item in blocks, with the largest impact of every block. Every text is cut into overlapping passages of words, and each
passage queries the index. As in block-max WAND, the terms that many blocks have and that hardly weigh are not looked up for a
block as long as they can't reach half its threshold together; they are granted to every passage. The impacts of the others are
summed by (passage, block), only where there are any, and of the blocks whose sum falls short of the threshold nothing is scored.
In the others every item that reaches its own threshold is a candidate. An item's threshold is the lowest score that a stretch of
``SHARE`` of its words can have after one in ``EDITS`` of its words is lost, each with the two heaviest pairs there are, so no
stretch within the definition is missed. Candidates are verified by aligning the item's words with the text's: a case holds a
stretch of at least SHARE of the item's words, in order, with at most one word in EDITS changed, added or missing. The stretch of
the best local alignment decides, or else the longest one that begins and ends with a matching word and keeps to those edits.
``answer_found``: the answer begins within ``ANSWER_WITHIN`` words after that stretch.

Words are runs of letters or digits after case folding, compatibility decomposition (ligatures, wide forms), removal of tags,
entities, soft hyphens and hyphens at line ends; wrongly decoded texts are restored first (``encoding``). Passages are so long that
a stretch of two fifths, with its additions, always lies whole within one of them.

The index is broadcast in shards of ``MAX_ITEMS`` items: the number of scans over the corpus grows with the items beyond that,
memory doesn't. Defined cases: null or wordless texts and items give no row; repeated items are found each; a text that holds an item
several times gives one row, its best; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parallel import spread
from . import encoding

#: Of an item's words, the share that makes a case; words per changed, added or missing one.
SHARE, EDITS = 0.4, 6
#: BM25's parameters.
K1, B = 1.2, 0.75
ANSWER_WITHIN = 40
#: Items per block of postings, and per broadcast index.
BLOCK, MAX_ITEMS = 4, 100_000
#: Blocks that a term has at least to be granted instead of being looked up. Texts that are searched together.
FREQUENT, TEXTS = 16, 256

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_LINE_END = re.compile(r"(?<=[^\W\d_])[-‐¬]\r?\n\s*(?=[^\W\d_])")
_ASCII = frozenset(map(chr, range(128)))
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_forms: dict[str, str | None] = {}


def _form(c: str) -> str | None:
    """What stands for a character (not ASCII) in comparisons; None: itself."""
    if unicodedata.category(c) == "Cf":  # soft hyphens, zero-width spaces and the like
        r = ""
    else:
        r = unicodedata.normalize("NFKC", c).casefold()
        r = "".join(x if x.isalnum() or unicodedata.combining(x) else " " for x in r)
    _forms[c] = None if r == c else r
    return _forms[c]


def words(text: str) -> list[bytes]:
    """A text's words in the form in which they are compared (UTF-8)."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text and ("-\n" in text or "-\r" in text or "‐\n" in text or "¬\n" in text):
        text = _LINE_END.sub("", text)
    text = text.lower()
    if not text.isascii():
        odd = set(text) - _ASCII
        if any(map(unicodedata.combining, odd)):
            text = unicodedata.normalize("NFKC", text)
            odd = set(text) - _ASCII
        for c in odd:
            r = _forms[c] if c in _forms else _form(c)
            if r is not None:
                text = text.replace(c, r)
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


@dataclass
class Index:
    """Items as postings with impacts, block maxima and thresholds."""

    ids: list[int]
    vocabulary: dict[bytes, int]  # from 1; 0 stands for all other words
    sequences: list[np.ndarray]  # each item's words
    answers: list[np.ndarray]
    terms: np.ndarray  # two words as one number, or one word (see ``key``)
    singles: bool  # whether there are terms of one word
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # of the blocks in which each term is looked up
    blocks: np.ndarray
    block_impacts: np.ndarray
    granted: np.ndarray  # per block, what the terms sum up to that aren't looked up
    thresholds: np.ndarray  # per item
    block_thresholds: np.ndarray
    length: int  # words of a passage

    def key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of a pair of words (first: 0 for a single one)."""
        return first.astype(np.int64) * (len(self.vocabulary) + 1) + second


def _stretch(n: int) -> int:
    """Words that make a case of n words."""
    return max(1, math.ceil(SHARE * n - 1e-9))


def build(rows: list[tuple[int, str, str | None]]) -> Index | None:
    """An index of (item_id, passage, answer)."""
    texts = [(i, words(p or ""), words(a or "")) for i, p, a in rows]
    texts = [t for t in texts if t[1]]
    if not texts:
        return None
    vocabulary: dict[bytes, int] = {}
    for _, p, a in texts:
        for w in (*p, *a):
            vocabulary.setdefault(w, len(vocabulary) + 1)
    seqs = [np.array([vocabulary[w] for w in p], np.int32) for _, p, _ in texts]
    answers = [np.array([vocabulary[w] for w in a], np.int32) for _, _, a in texts]
    single = np.array([_stretch(len(s)) < 2 for s in seqs])
    ix = Index([t[0] for t in texts], vocabulary, seqs, answers, *[None] * 11, 0)
    keys = [ix.key(np.zeros_like(s), s) if one else ix.key(s[:-1], s[1:]) for s, one in zip(seqs, single, strict=True)]
    sizes, n = np.array([len(k) for k in keys]), len(seqs)
    owner = np.repeat(np.arange(n), sizes)
    terms, term = np.unique(np.concatenate(keys), return_inverse=True)
    post, first, of, times = np.unique(owner * len(terms) + term, return_index=True, return_inverse=True, return_counts=True)
    item, term = post // len(terms), post % len(terms)
    df = np.bincount(term)
    norm = K1 * (1 - B + B * sizes / sizes.mean())
    impact = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * times * (K1 + 1) / (times + norm[item])
    at = np.zeros(len(owner))  # a repeated term counts once: at its first place
    at[first] = impact[of[first]]
    ends = np.cumsum(sizes)
    thresholds = np.array([_threshold(at[e - k : e], len(s)) for e, k, s in zip(ends, sizes, seqs, strict=True)])
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order].astype(np.int32), impact[order]
    blocks = -(-n // BLOCK)
    where = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)])
    b_term, b_block, b_impact = term[where], item[where] // BLOCK, np.maximum.reduceat(impact, where)
    limits = np.minimum.reduceat(thresholds, np.arange(0, n, BLOCK))
    # Frequent terms of each block, the most frequent first, are granted up to half the block's threshold.
    spread_over = np.bincount(b_term)[b_term]
    order = np.lexsort((b_term, -spread_over, b_block))
    upto = np.cumsum(b_impact[order])
    begins = np.searchsorted(b_block[order], np.arange(blocks))
    upto -= np.r_[0.0, upto][begins][b_block[order]]
    given = np.zeros(len(order), bool)
    given[order] = (upto < limits[b_block[order]] / 2) & (spread_over[order] > FREQUENT)
    longest = max(_stretch(len(s)) for s in seqs)
    ix.terms, ix.singles, ix.items, ix.impacts = terms, bool(single.any()), item, impact.astype(np.float32)
    ix.starts, ix.block_starts = (np.searchsorted(t, np.arange(len(terms) + 1)) for t in (term, b_term[~given]))
    ix.blocks, ix.block_impacts = b_block[~given], b_impact[~given].astype(np.float32)
    ix.granted, ix.thresholds, ix.block_thresholds = np.bincount(b_block[given], b_impact[given], blocks), thresholds, limits
    ix.length = 2 * max(32, longest + longest // EDITS + 2)
    return ix


def _threshold(impacts: np.ndarray, n: int) -> float:
    """The least score of a stretch of SHARE of an item's n words without its heaviest pairs, as many as its edits can break; a
    longer stretch has more edits, so the next lengths that allow one more are looked at as well."""
    least, size = math.inf, _stretch(n)
    if size < 2:
        return float(impacts.min()) * 0.999
    for k in {min(n, size), min(n, (size // EDITS + 1) * EDITS), min(n, (size // EDITS + 2) * EDITS)}:
        windows = np.sort(np.lib.stride_tricks.sliding_window_view(impacts, k - 1), axis=1)
        least = min(least, float(windows[:, : k - 1 - 2 * (k // EDITS)].sum(1).min()))
    return least * 0.999


def _spread(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all postings of the terms, and for each the term's place in ``terms``."""
    lo, n = starts[terms], starts[terms + 1] - starts[terms]
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(terms)), n)


def _terms(ix: Index, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index's terms in the texts, and at which word each begins, in order."""
    inside = np.ones(len(ids), bool)
    inside[ends[ends > 0] - 1] = False
    at = np.flatnonzero(inside[:-1] & (ids[:-1] > 0) & (ids[1:] > 0))
    key = ix.key(ids[at], ids[at + 1])
    if ix.singles:
        one = np.flatnonzero(ids)
        at, key = np.r_[at, one], np.r_[key, ids[one]]
    term = np.minimum(np.searchsorted(ix.terms, key), len(ix.terms) - 1)
    known = ix.terms[term] == key
    at, term = at[known], term[known]
    order = np.argsort(at, kind="stable") if ix.singles else slice(None)
    return term[order], at[order]


def candidates(ix: Index, ids: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item) pairs that may be cases: best score, and the words from which to which it was found. ``ids``: the word
    numbers of several texts, one after the other; ``ends``: where each text ends."""
    half, blocks = ix.length // 2, len(ix.block_thresholds)
    begins = np.r_[0, ends[:-1]]
    parts = np.maximum(1, -(-(ends - begins) // half))  # half passages of each text
    first = np.cumsum(parts) - parts
    term, at = _terms(ix, ids, ends)
    if not len(term):
        return {}
    text = np.searchsorted(ends, at, "right")
    part = first[text] + (at - begins[text]) // half
    different = np.unique(part * len(ix.terms) + term)
    k, of = _spread(ix.block_starts, different % len(ix.terms))
    part, block, impact = (different // len(ix.terms))[of], ix.blocks[k], ix.block_impacts[k]
    owner = np.repeat(np.arange(len(ends)), parts)
    # A passage is two halves in a row: what is in a half counts for it and for the one before.
    back = part > first[owner[part]]
    pair, of = np.unique(np.r_[part, part[back] - 1] * blocks + np.r_[block, block[back]], return_inverse=True)
    total = np.bincount(of, np.r_[impact, impact[back]])
    alive = pair[total >= (ix.block_thresholds - ix.granted)[pair % blocks]]
    passage, block = alive // blocks, alive % blocks
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    cuts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1], True]) if len(passage) else []
    for x, y in zip(cuts, cuts[1:], strict=False):
        w = int(passage[x])
        t = int(owner[w])
        if w > first[t] and w == first[t] + parts[t] - 1:
            continue  # the last half is in the passage before
        a = int(begins[t] + (w - first[t]) * half)
        e = min(int(ends[t]), a + ix.length)
        k, _ = _spread(ix.starts, np.unique(term[np.searchsorted(at, a) : np.searchsorted(at, e)]))
        k = k[np.isin(ix.items[k] // BLOCK, block[x:y])]
        items, of = np.unique(ix.items[k], return_inverse=True)
        score = np.bincount(of, ix.impacts[k])
        hit = score >= ix.thresholds[items]
        for i, s in zip(items[hit].tolist(), score[hit].tolist(), strict=True):
            old = out.get((t, i))
            out[t, i] = (s, a, e) if old is None else (max(old[0], s), old[1], e)
    return out


#: Cost of a changed, added or missing word in the local alignment; a matching word earns 1. Above 2, so that two stock sentences
#: with a few words between them don't make one stretch.
PENALTY = 2.25


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignments of pairs, a row each: item words, matches, end in the text; and their scores."""
    c, n, m = len(items), max(map(len, items)), max(map(len, texts))
    item, text = np.full((n, c), -1, np.int32), np.full((c, m), -2, np.int32)
    for k, (i, t) in enumerate(zip(items, texts, strict=True)):
        item[: len(i), k], text[k, : len(t)] = i, t
    score, begin, hits = np.zeros((c, m + 1)), np.zeros((c, m + 1), np.int32), np.zeros((c, m + 1), np.int32)
    best, out = np.zeros(c), np.zeros((c, 4), np.int64)
    steps, columns, rows = PENALTY * np.arange(m + 1), np.arange(m + 1), np.arange(c)
    known = text > 0
    for i in range(n):
        same = (text == item[i][:, None]) & known
        new, new_begin, new_hits = score - PENALTY, begin.copy(), hits.copy()
        diagonal = score[:, :-1] + np.where(same, 1.0, -PENALTY)
        better = diagonal >= new[:, 1:]
        new[:, 1:] = np.where(better, diagonal, new[:, 1:])
        new_begin[:, 1:] = np.where(better, begin[:, :-1], new_begin[:, 1:])
        new_hits[:, 1:] = np.where(better, hits[:, :-1] + same, new_hits[:, 1:])
        # Added words of the text: the best cell to the left, less the steps from there.
        lifted = new + steps
        top = np.maximum.accumulate(lifted, 1)
        src = np.maximum.accumulate(np.where(lifted >= top, columns, 0), 1)
        score = top - steps
        begin, hits = np.take_along_axis(new_begin, src, 1), np.take_along_axis(new_hits, src, 1)
        dead = score <= 0
        score[dead], begin[dead], hits[dead] = 0.0, i + 1, 0
        j = score.argmax(1)
        top_now = score[rows, j]
        up = np.flatnonzero(top_now > best)
        best[up] = top_now[up]
        out[up] = np.stack([begin[up, j[up]], np.full(len(up), i + 1), hits[up, j[up]], j[up]], 1)
    return np.stack([out[:, 1] - out[:, 0], out[:, 2], out[:, 3]], 1), best


#: Cells (edits, words of a text, pairs) that are aligned together.
CELLS = 1 << 20


def longest(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """The longest stretches of pairs that begin and end with a matching word and have at most one edit in EDITS of the item's
    words, a row each: item words, matches, end in the text."""
    c, n, m = len(items), max(map(len, items)), max(map(len, texts))
    item, text = np.full((n, c), -1, np.int32), np.full((c, m), -2, np.int32)
    for k, (i, t) in enumerate(zip(items, texts, strict=True)):
        item[: len(i), k], text[k, : len(t)] = i, t
    known, edits = text > 0, np.arange(n // EDITS + 1)[:, None, None]
    one = n + 1
    none = -2 * one * one
    # Per number of edits and end in the text: words of the item, ``one`` each, and matches; below 0 where no stretch ends.
    span = np.full((len(edits), c, m + 1), none, np.int64 if n > 10_000 else np.int32)
    out = np.zeros((c, 3), np.int64)
    for i in range(n):
        same = (text == item[i][:, None]) & known
        new = np.full_like(span, none)
        new[1:] = span[:-1] + one  # missing
        new[1:, :, 1:] = np.maximum(new[1:, :, 1:], span[:-1, :, :-1] + one)  # changed
        matched = np.where(same, np.maximum(span[:, :, :-1], 0) + one + 1, none)
        new[:, :, 1:] = np.maximum(new[:, :, 1:], matched)
        for e in range(1, len(edits)):  # added
            new[e, :, 1:] = np.maximum(new[e, :, 1:], new[e - 1, :, :-1])
        span = new
        whole = np.where(matched >= EDITS * edits * one, matched, 0).max(0)
        j = whole.argmax(1)
        top = whole[np.arange(c), j]
        up = np.flatnonzero(top > out[:, 0] * one + out[:, 1])
        out[up] = np.stack([top[up] // one, top[up] % one, j[up] + 1], 1)
    return out


def find(ix: Index, texts: list[str]) -> list[tuple[int, int, float, float, float, bool]]:
    """(number of the text, item_id, score, share of the item's words that the stretch covers, share of those that match,
    answer_found) of the cases."""
    get = ix.vocabulary.get
    ids: list[int] = []
    ends = []
    for t in texts:
        ids.extend(map(get, words(encoding.repair(t)[0]), repeat(0)))
        ends.append(len(ids))
    if not ids:
        return []
    x, end = np.array(ids, np.int64), np.array(ends)
    begin = np.r_[0, end[:-1]]
    hits, out = [], []
    found = candidates(ix, x, end)
    for (t, i), (score, a, e) in found.items():
        n = len(ix.sequences[i])
        part = x[max(begin[t], a - n) : min(end[t], e + n + ANSWER_WITHIN + len(ix.answers[i]))]
        # A lost word costs two pairs of neighbours at most; without enough of those left there is nothing to align.
        s = ix.sequences[i]
        if np.isin(ix.key(s[:-1], s[1:]), ix.key(part[:-1], part[1:])).sum() >= SHARE * n * (1 - 2 / EDITS) - 2:
            hits.append((t, i, score, part))
    hits.sort(key=lambda h: len(h[3]))
    cases, rest = [], []
    for k in range(0, len(hits), 64):
        some = hits[k : k + 64]
        for h, got, best in zip(some, *align([ix.sequences[h[1]] for h in some], [h[3] for h in some]), strict=True):
            least = SHARE * len(ix.sequences[h[1]]) - 1e-9
            if got[0] >= least:
                cases.append((h, got.tolist()))
            elif best >= least * (1 - (1 + PENALTY) / EDITS):  # what a stretch at the limit scores at least
                rest.append(h)
    while rest:  # stretches whose ends the alignment left out behind edits
        cells = len(rest[0][3]) * max(len(ix.sequences[h[1]]) for h in rest[:64]) // EDITS
        k = min(64, max(1, CELLS // max(1, cells)))
        some, rest = rest[:k], rest[k:]
        for h, got in zip(some, longest([ix.sequences[h[1]] for h in some], [h[3] for h in some]).tolist(), strict=True):
            if got[0] >= SHARE * len(ix.sequences[h[1]]) - 1e-9:
                cases.append((h, got))
    for (t, i, score, part), (covered, same, upto) in cases:
        n = len(ix.sequences[i])
        ans = ix.answers[i]
        after = part[upto : upto + ANSWER_WITHIN + len(ans)]
        known = len(ans) > 0 and any(np.array_equal(after[j : j + len(ans)], ans) for j in np.flatnonzero(after == ans[0]))
        out.append((t, ix.ids[i], float(score), covered / n, same / covered, bool(known)))
    return out


def leaks(docs: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, covered, matched, answer_found of the cases. ``docs``: doc_id, text; ``items``: item_id, passage,
    answer (ids unique)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, covered double, matched double, answer_found boolean"
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    x = items.select(F.col("item_id").cast("long"), "passage", "answer").where("passage IS NOT NULL AND item_id IS NOT NULL")
    shards = max(1, math.ceil(x.count() / max_items))
    out = None
    for s in range(shards):
        own = x if shards == 1 else x.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        ix = build([tuple(r) for r in own.orderBy("item_id").collect()])  # max_items rows or so, whatever the items' number
        if ix is None:
            continue
        shared = spark.sparkContext.broadcast(ix)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ix = shared.value
            for b in batches:
                found = []
                for at in range(0, b.num_rows, TEXTS):
                    part = b.slice(at, TEXTS)
                    docs = part.column("doc_id").to_pylist()
                    found += [(docs[t], *r) for t, *r in find(ix, [x or "" for x in part.column("text").to_pylist()])]
                cols = list(zip(*found, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "covered", "matched", "answer_found"])

        one = docs.mapInArrow(go, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)
