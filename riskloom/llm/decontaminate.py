"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Every passage of every document (windows of words, each overlapping half of the next) is a query against the inverted
index of the items. An item counts as retrieved when its BM25 score reaches its own threshold: the score of
the whole item, less the largest term scores that an item could miss and still pass verification. So the search loses
nothing. Retrieved items are verified: at least ``OVERLAP`` of the five-word shingles of the item's question and of
its answer must stand in the passage. The answer of an item is its last sentence, the rest its question; an item of one
sentence is both.

Upper bounds prune in two steps: first per passage and block of items, for all passages of a batch at once; then
WAND with the same block maxima walks the posting lists of what is left.

The index is broadcast in parts of at most ``PART_BYTES`` of item text, each of which is one more pass over the
passages. Words are lower-cased runs of letters and digits. Documents and items that are null or have no words match
nothing; an item of fewer than five words is one shingle. Rows that repeat an item are one item.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from riskloom.llm.common import append_columns

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items of a block of the index; words of a passage at least.
BLOCK_ITEMS = 4
PASSAGE = 128
PART_BYTES = 16 << 20
SLACK = 1e-6

_words = re.compile(r"[^\W_]+").findall
_sentences = re.compile(r"[.!?\n]+")


def _shingles(ids: list[int]) -> set[tuple[int, ...]]:
    if not ids:
        return set()
    return {tuple(ids[i:i + SHINGLE]) for i in range(max(1, len(ids) - SHINGLE + 1))}


class Index:
    """Inverted index of the items, ordered by length so that a block has items of like thresholds."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP):
        self.overlap = overlap
        self.terms: dict[str, int] = {}
        rows = []
        for item, text in items:
            sentences = [s for s in (_words(s) for s in _sentences.split(text.lower())) if s]
            if sentences:
                ids = [[self.terms.setdefault(w, len(self.terms)) for w in s] for s in sentences]
                answer = ids[-1]
                question = [w for s in ids[:-1] for w in s] or answer
                rows.append((item, [w for s in ids for w in s], question, answer))
        rows.sort(key=lambda r: (len(r[1]), r[0]))
        self.items = [r[0] for r in rows]
        self.parts = [(_shingles(q), _shingles(a)) for _, _, q, a in rows]
        self.longest = max((len(r[1]) for r in rows), default=0)
        n, mean = len(rows), sum(len(r[1]) for r in rows) / max(1, len(rows))
        frequency = np.zeros(len(self.terms))
        for _, ids, _, _ in rows:
            frequency[list(set(ids))] += 1
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        self.lists: list[dict[int, float]] = [{} for _ in self.terms]
        self.least = np.zeros(n)
        for at, (_, ids, _, _) in enumerate(rows):
            impacts = {}
            for t in set(ids):
                tf = ids.count(t)
                impacts[t] = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
                self.lists[t][at] = impacts[t]
            # A part with s shingles can miss (1 - overlap) * s of them, and with each one word.
            missed = sum(int((1 - overlap) * len(p) + 1e-9) for p in self.parts[at])
            top = sorted(impacts.values(), reverse=True)[:missed]
            self.least[at] = sum(impacts.values()) - sum(top) - SLACK
        self.posting = [sorted(p) for p in self.lists]
        self.n_blocks = -(-n // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms) + 1, max(1, self.n_blocks)), dtype=np.float32)
        for t, p in enumerate(self.lists):
            for at, impact in p.items():
                self.block_max[t, at // BLOCK_ITEMS] = max(self.block_max[t, at // BLOCK_ITEMS], impact * (1 + 1e-6))
        self.block_least = np.array([self.least[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].min() for b in range(self.n_blocks)])
        self.floors = (self.block_least - SLACK).tolist()
        self.tops = self.block_max.max(axis=1).astype(float).tolist()
        self.maxima = [{at // BLOCK_ITEMS: float(self.block_max[t, at // BLOCK_ITEMS]) for at in p} for t, p in enumerate(self.lists)]

    def wand(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """All items of the given blocks whose score for a query of distinct terms reaches their threshold.

        Block-max WAND: cursors stand on their lists' next items; the pivot is the first item that the bounds of the
        cursors before it could lift to a threshold; where the maxima of its block cannot, the block is skipped.
        """
        found: list[tuple[int, float]] = []
        todo = iter(blocks)
        block = next(todo)

        def onward(cursors: list, item: int) -> list:
            left = []
            for c in cursors:
                if c[0] < item:
                    c[2] = bisect_left(c[1], item, c[2])
                    if c[2] == len(c[1]):
                        continue
                    c[0] = c[1][c[2]]
                left.append(c)
            left.sort(key=itemgetter(0))
            return left

        # A cursor: its item, its posting list, its place in it, its term.
        cursors = onward([[-1, self.posting[t], 0, t] for t in terms if self.posting[t]], block * BLOCK_ITEMS)
        floor = min(self.floors[b] for b in blocks)
        while cursors:
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.tops[c[3]]
                if bound >= floor:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            own = pivot // BLOCK_ITEMS
            if own != block:  # the next block that is asked for, at or after the pivot's
                while block < own:
                    block = next(todo, None)
                    if block is None:
                        return found
                cursors = onward(cursors, max(pivot, block * BLOCK_ITEMS))
                if block != own:
                    continue
            end = (block + 1) * BLOCK_ITEMS
            here = sum(self.maxima[c[3]].get(block, 0.0) for c in cursors if c[0] < end)
            if here < self.floors[block]:
                cursors = onward(cursors, end)
            elif cursors[0][0] == pivot:
                score = sum(self.lists[c[3]][pivot] for c in cursors if c[0] == pivot)
                if score >= self.least[pivot]:
                    found.append((pivot, score))
                cursors = onward(cursors, pivot + 1)
            else:
                cursors = onward(cursors, pivot)
        return found


class Search:
    """Finds the items that stand in texts, for blocks of texts."""

    def __init__(self, index: Index):
        self.index = index
        self.step = max(PASSAGE // 2, index.longest)

    def _windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of every passage: each is two steps long and begins one step after the one before."""
        n = np.maximum(1, -(-counts // self.step) - 1) * (counts > 0)
        ends = np.cumsum(n)
        number = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        base = np.repeat(np.cumsum(counts) - counts, n)
        start = base + number * self.step
        return start, np.minimum(start + 2 * self.step, base + np.repeat(counts, n))

    def __call__(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        index = self.index
        hits: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not index.items:
            return hits
        known, none = index.terms, len(index.terms)
        words = [[known.get(w, none) for w in _words(t.lower())] if t else [] for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        if not counts.sum():
            return hits
        term = np.array([w for ws in words for w in ws], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        # Where the same word stood before in the text; a passage counts a word at its first place only.
        at = np.flatnonzero(term < none)
        order = at[np.lexsort((at, term[at], doc[at]))]
        same = (term[order[1:]] == term[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        before = np.full(len(term), -1)
        before[order[1:][same]] = order[:-1][same]
        start, stop = self._windows(counts)
        edges = np.searchsorted(at, np.stack((start, stop)))
        lengths = edges[1] - edges[0]
        for a in range(0, len(start), 1024):
            part = slice(a, a + 1024)
            n = lengths[part]
            inside = at[np.repeat(edges[0][part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            window = np.repeat(np.arange(len(n)), n)
            first = before[inside] < start[part][window]
            inside, window = inside[first], window[first]
            near = self._bounds(term[inside], window, len(n))
            cuts = np.searchsorted(window, np.arange(len(n) + 1))
            for w, blocks in near.items():
                self._verify(hits, doc, start[a + w], stop[a + w], term, term[inside[cuts[w]:cuts[w + 1]]].tolist(), blocks)
        return hits

    def _bounds(self, term: np.ndarray, window: np.ndarray, n: int) -> dict[int, list[int]]:
        """For each passage: the blocks of items for which its upper bound reaches their least threshold."""
        index = self.index
        near: dict[int, list[int]] = {}
        full = np.flatnonzero(np.diff(window, prepend=-1))  # first word of each passage that has a known one
        if len(full):
            for b in range(0, index.n_blocks, 64):
                bound = np.add.reduceat(index.block_max[term, b:b + 64], full, axis=0)
                row, block = np.nonzero(bound >= index.block_least[b:b + 64] - SLACK)
                for w, k in zip(window[full[row]].tolist(), (block + b).tolist()):
                    near.setdefault(w, []).append(k)
        return near

    def _verify(self, hits, doc, start: int, stop: int, term: np.ndarray, distinct: list[int], blocks: list[int]) -> None:
        found = self.index.wand(distinct, blocks)
        if not found:
            return
        ids = term[start:stop].tolist()
        grams: dict[int, set] = {}

        def held(part: set) -> float:
            size = len(next(iter(part)))
            if size not in grams:
                grams[size] = {tuple(ids[i:i + size]) for i in range(len(ids) - size + 1)}
            return len(part & grams[size]) / len(part)

        for at, score in found:
            question, answer = (held(p) for p in self.index.parts[at])
            if min(question, answer) >= self.index.overlap:
                own, item = hits[int(doc[start])], self.index.items[at]
                own[item] = max(own.get(item, (0.0, 0.0, 0.0)), (float(score), question, answer))


HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType()),
                             StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType())]))


def with_items(df: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, overlap: float = OVERLAP,
               out: str = "items") -> DataFrame:
    """Rows pass through whole, with ``out``: the items found in the text, sorted by id."""
    items = (benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
             .filter("id is not null and text is not null").dropDuplicates(["id", "text"]))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    sc = df.sparkSession.sparkContext
    names = []
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        held = sc.broadcast(cloudpickle.dumps(Index([(r["id"], r["text"]) for r in sorted(rows)], overlap)))

        def make(held=held):
            search = Search(pickle.loads(held.value))

            def work(texts):
                found = [[(i, *v) for i, v in sorted(h.items())] for h in search(texts)]
                keys = ("item_id", "score", "question_overlap", "answer_overlap")
                kind = pa.list_(pa.struct([("item_id", pa.int64())] + [(k, pa.float64()) for k in keys[1:]]))
                return [pa.array([[dict(zip(keys, x)) for x in f] for f in found], kind)]

            return work

        names.append(f"__items_{p}")
        df = append_columns(df, text, StructType([StructField(names[-1], HITS)]), make)
    return df.withColumn(out, F.array_sort(F.concat(*names)) if parts > 1 else F.col(names[0])).drop(*names)


def contaminated(df: DataFrame, id_column: str, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score, question_overlap, answer_overlap."""
    rows = with_items(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), "text", benchmark, item_id, item_text)
    return rows.select("doc_id", F.inline("items"))
