"""Evaluation texts that leaked into training text (problem 9)."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: q of the q-grams, edits allowed in a stretch of an item's least passage length, and width of a diagonal band.
Q, EDITS, BAND = 10, 2, 16
#: Characters of evaluation text held by a task at a time (more are searched in several passes), of corpus text handled at once;
#: items of an index, so that a phrase of all items meets so many at a time; shared q-grams handled at once.
ITEM_CHARS, TEXT_CHARS, ITEMS, HITS = 4_000_000, 1_000_000, 512, 1 << 22

TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[/?[A-Za-z*][^\[\]\n]*\]")
_GONE = {0x200B: None, 0xAD: None}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case: tags are blanks, entities decoded, invisible characters deleted."""
    return _WORD.findall(html.unescape(TAG.sub(" ", text)).translate(_GONE).lower())


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram of an array of code points."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(Q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        return h ^ (h >> np.uint64(29))


def _join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by Q separators, and the texts' starts."""
    gap = "\n" * Q
    starts = np.cumsum([0] + [len(t) + Q for t in texts])
    return np.frombuffer(gap.join(texts + [""]).encode("utf-32-le", "surrogatepass"), np.uint32), starts


class Index:
    """The q-grams of the evaluation items, with what is needed to verify a hit."""

    def __init__(self, items: list[tuple], min_words: int) -> None:
        words = [words_of(t or "") for _, t in items]
        keep = [i for i, w in enumerate(words) if len(w) >= min_words]
        self.ids = [items[i][0] for i in keep]
        self.runs = [{" ".join(words[i][k : k + min_words]) for k in range(len(words[i]) - min_words + 1)} for i in keep]
        self.least = np.array([min(map(len, runs)) for runs in self.runs], np.int64)
        #: The q-gram lemma, for every item by itself: so many q-grams survive `edits` edits in a stretch of its least length.
        self.edits = np.clip((self.least - Q) // Q - 1, 0, EDITS)
        self.need = np.maximum(1, self.least + 1 - Q * (self.edits + 1))
        self.codes, self.starts = _join([" ".join(words[i]) for i in keep])
        h = _grams(self.codes)
        at = np.arange(len(h))
        owner = np.searchsorted(self.starts, at, "right") - 1
        inside = (owner < len(keep)) & (at + Q <= self.starts[np.minimum(owner + 1, len(keep))] - Q) if keep else np.zeros(len(h), bool)
        h, at, owner = h[inside], at[inside], owner[inside]
        by = np.argsort(h, kind="stable")
        self.at, self.owner = at[by], owner[by]
        self.grams, self.first, self.n = np.unique(h[by], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the corpus, position in the items, item) of every shared q-gram, for some texts at a time."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        cut = np.searchsorted(at, starts)  # the first shared q-gram of each text
        sums = np.r_[0, np.cumsum(self.n[k])][cut]
        text = 0
        while text < len(starts) - 1:
            upto = max(text + 1, int(np.searchsorted(sums, sums[text] + HITS, "right")) - 1)
            mine = slice(cut[text], cut[upto])
            n = self.n[k[mine]]
            row = np.repeat(np.arange(len(n)), n)
            j = np.repeat(self.first[k[mine]], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if len(row):
                yield at[mine][row], self.at[j], self.owner[j]
            text = upto


def _regions(p: np.ndarray, g: np.ndarray, item: np.ndarray, doc: np.ndarray, ix: Index) -> tuple[np.ndarray, ...]:
    """Regions of overlapping diagonal bands with enough q-grams: (doc, item, lowest diagonal, first and last position)."""
    diagonal = p - g
    band = diagonal // BAND
    low = diagonal - band * BAND < EDITS  # these lie in the overlap with the band below
    p, item, doc, band = (np.concatenate([x, x[low]]) for x in (p, item, doc, band))
    band[len(low) :] -= 1
    by = np.lexsort((p, band, item, doc))
    p, item, doc, band = p[by], item[by], doc[by], band[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (np.diff(p) > Q * (ix.edits[item[1:]] + 1))]
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(p)]
    # a q-gram of the corpus counts once, however often the item holds it
    once = np.r_[True, np.diff(p) > 0] | new
    count = np.add.reduceat(once.astype(np.int64), first)
    ok = count >= ix.need[item[first]]
    return doc[first[ok]], item[first[ok]], band[first[ok]] * BAND, p[first[ok]], p[end[ok] - 1]


def _aligned(codes: np.ndarray, ix: Index, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Best local alignment score of each region inside its band (match 1, edit -2), all regions at once."""
    width = BAND + 2 * EDITS
    offset = np.arange(width)
    top = diagonal + BAND + EDITS - 1  # the highest diagonal; offset o is diagonal top - o
    score = np.zeros((len(lo), width), np.int32)
    best = np.zeros(len(lo), np.int32)
    for step in range(int((hi - lo).max()) + Q if len(lo) else 0):
        live = np.flatnonzero(lo + step < hi + Q)
        at = lo[live] + step
        t = at[:, None] - top[live][:, None] + offset
        same = (codes[at][:, None] == ix.codes[np.clip(t, 0, len(ix.codes) - 1)]) & (t >= 0) & (t < len(ix.codes)) & (codes[at] != 10)[:, None]
        was = score[live]
        up = np.concatenate([was[:, 1:], np.zeros((len(live), 1), np.int32)], 1)
        now = np.maximum(np.maximum(was + np.where(same, 1, -2), up - 2), 0)
        now = np.maximum.accumulate(now + 2 * offset, 1) - 2 * offset
        score[live] = now
        best[live] = np.maximum(best[live], now.max(1))
    return best


def _search(ids: list, texts: list[str], indexes: list[Index], min_words: int) -> list[tuple]:
    codes, starts = _join(texts)
    grams = _grams(codes)
    found: dict[tuple, tuple] = {}
    for ix in indexes:
        for p, g, item in ix.hits(grams, starts):
            doc = np.searchsorted(starts, p, "right") - 1
            doc, item, diagonal, lo, hi = _regions(p, g, item, doc, ix)
            best = _aligned(codes, ix, diagonal, lo, hi)
            for k in np.flatnonzero(best >= ix.least[item] - 3 * ix.edits[item]):
                text, base = texts[doc[k]], int(starts[doc[k]])
                a = text.rfind(" ", 0, int(lo[k]) - base + 1) + 1
                b = text.find(" ", int(hi[k]) - base + Q)
                b = len(text) if b < 0 else b
                w = text[a:b].split(" ")
                runs = ix.runs[item[k]]
                exact = any(" ".join(w[i : i + min_words]) in runs for i in range(len(w) - min_words + 1))
                key = (ids[doc[k]], ix.ids[item[k]])
                now = (exact, int(best[k]), int(lo[k]) - base)
                found[key] = max(found.get(key, now), now)
    return [(*key, *v) for key, v in found.items()]


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 12) -> DataFrame:
    """Corpus texts that hold passages of evaluation items, wholly or partly.

    Both sides are normalised to words (see `words_of`) joined by blanks. By the q-gram lemma a passage of at least
    `least` characters (the shortest run of `min_words` words of the item) with up to EDITS edits (fewer in an item of very short runs) shares at
    least least + 1 - Q * (EDITS + 1) q-grams with the item on nearby diagonals: shared q-grams are counted in overlapping
    diagonal bands, regions that reach the bound are kept and verified by banded local alignment. Texts are searched
    whole, in the task that reads them: nothing is shuffled.

    Returns (key, item_key, exact, score, start), a row per text and item: `exact` tells whether `min_words`
    consecutive words of the item occur in it, `score` is the alignment's (match 1, edit -2), `start` its place in the
    normalised text. The items are sent to the tasks; of more than ITEM_CHARS characters, one part after another is
    collected and searched, over texts that are normalised once. What is found of an item doesn't depend on the others. Null texts and items, and items of fewer words than `min_words`, match nothing; repeated rows repeat
    no result; other columns are ignored; empty tables give an empty result.
    """
    if 2 * min_words - 1 < Q:
        raise ValueError(f"min_words must be at least {(Q + 2) // 2}, so that a passage holds a q-gram")
    wanted = items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).distinct()
    chars = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-chars // ITEM_CHARS))
    kinds = {"k": dict(docs.dtypes)[key], "i": dict(items.dtypes)[item_key]}
    schema = f"k {kinds['k']}, i {kinds['i']}, exact boolean, score int, start bigint"
    source = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([" ".join(words_of(t.as_py())) for t in b.column("t")], pa.string())], ["k", "t"])

    if passes > 1:
        source = staged(source.mapInArrow(normalise, f"k {kinds['k']}, t string"), "normalised")

    def one(part: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [Index(part[k : k + ITEMS], min_words) for k in range(0, len(part), ITEMS)]
            for b in batches if passes > 1 else normalise(batches):
                ids, texts, size, rows = [], [], 0, []
                for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                    ids.append(k)
                    texts.append(t)
                    size += len(t)
                    if size >= TEXT_CHARS:
                        rows += _search(ids, texts, indexes, min_words)
                        ids, texts, size = [], [], 0
                if ids:
                    rows += _search(ids, texts, indexes, min_words)
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column("k").type), pa.array(cols[1], item_type), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())], ["k", "i", "exact", "score", "start"])

        return source.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for k in range(passes):  # one part of the items is here at a time
        part = one(sorted((tuple(r) for r in wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()), key=str))
        part = staged(part, "leaks") if passes > 1 else part
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("k", "i").agg(F.max(F.struct("exact", "score", "start")).alias("x"))
    return found.select(F.col("k").alias(key), F.col("i").alias(item_key), "x.exact", "x.score", "x.start")
