"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents form one token array. An inverted index maps each mergeable pair
(named by the id it merges into) to the positions where it stands; merges are replayed in rank order over the
whole array at once, and only the two neighbours of a merged pair get new index entries. Words stay known to the
task for later blocks. Vocabularies are read from a rank file, never trained.

Null texts encode as empty. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from riskloom.llm.common import append_columns, blocks, ragged, spans_of

NONE = np.int64(1 << 40)
#: Distinct words a task remembers before it starts over.
WORDS_KEPT = 150_000
#: Bytes of text, and ids, that a task treats at once.
TEXT_BYTES, IDS = 2 << 20, 1 << 18


class Ranks:
    """Merge table of a rank file: token bytes, and for each pair of ids the id it merges into."""

    def __init__(self, lines: list[bytes]):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.bytes = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.bytes < 0).any():
            raise ValueError("a byte-level vocabulary needs a token for each of the 256 bytes")
        self.base = np.int64(size)
        pairs = {}
        # A merge is settled if none of the pairs that its result opens has a lower rank.
        self.settled = np.ones(size, dtype=bool)
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
                    self.settled[[x for x in (left, right) if x > rank]] = False
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged token, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes that each run of ids stands for."""
        lengths = self.lengths[ids]
        data = self.data[spans_of(self.starts[ids], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one word after the other, and the number of tokens of each."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, dtype=np.int64), lengths
    token = ranks.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    last = np.cumsum(lengths)[lengths > 0] - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[last] = -1
    before[(last + 1)[:-1]] = -1
    standing = np.full(n, NONE)  # what the pair that starts here merges into
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        right = after[positions]
        fits = right >= 0
        rank = np.full(len(positions), NONE)
        rank[fits] = ranks.pair(token[positions[fits]], token[right[fits]])
        standing[positions] = rank
        found = rank < NONE
        if not found.any():
            return
        positions, rank = positions[found], rank[found]
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, group in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(heap, r)

    enter(np.arange(n))
    while heap:
        rank = heapq.heappop(heap)
        groups = index.pop(rank)
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        at = at[standing[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            at = np.sort(at)
            if ranks.settled[rank]:
                # Pairs that overlap form chains; merging from the left takes every second one of a chain.
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if chained.any():
                    where = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, where))
                    at = at[(where - head) % 2 == 0]
            else:  # a merge could open a pair of lower rank: one merge a word, then look again
                first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                rest = at[~first]
                if len(rest):
                    index[rank] = [rest]
                    heapq.heappush(heap, rank)
                at = at[first]
        gone = after[at]
        token[at] = rank
        alive[gone] = False
        standing[gone] = NONE
        follow = after[gone]
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        left = before[at]
        left = left[left >= 0]
        enter(np.unique(np.concatenate((left, at))) if len(at) > 1 else np.concatenate((left, at)))
    return token[alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes blocks of texts; remembers the words it has replayed."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths, self.starts = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        whole = np.array([self.ranks.ids.get(w, -1) for w in raw], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, counts = replay([raw[i] for i in rest.tolist()], self.ranks)
        lengths = np.ones(len(words), dtype=np.int64)
        lengths[rest] = counts
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), dtype=np.int64)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        flat[spans_of(starts[rest], lengths[rest])] = ids
        self.starts = np.concatenate((self.starts, starts + len(self.flat)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, flat))
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORDS_KEPT:
            self.clear()
        parts = [self.find(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for p in parts for w in p if w not in self.known))
        if fresh:
            self.learn(fresh)
        known = self.known
        words = np.array([known[w] for p in parts for w in p], dtype=np.int64)
        lengths = self.lengths[words]
        ids = self.flat[spans_of(self.starts[words], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.cumsum([0, *map(len, parts)])
        return ids, np.diff(ends[cuts])


def read_ranks(path: str) -> list[bytes]:
    """Lines of a rank file on the driver's disk (a vocabulary: some hundred thousand lines at most)."""
    with open(path, "rb") as file:
        return file.read().splitlines()


def encode(df: DataFrame, text: str, rank_lines: list[bytes], pattern: str, out: str = "ids") -> DataFrame:
    """Rows pass through whole, with ``out``: the token ids of the text (empty for a null or empty text).

    The rank file's lines travel to the workers as a broadcast; their size is that of the vocabulary, whatever
    the corpus.
    """
    held = df.sparkSession.sparkContext.broadcast(rank_lines)

    def make():
        encoder = Encoder(Ranks(held.value), pattern)

        def work(texts):
            ids, counts = encoder(texts)
            return [ragged(ids.astype(np.int32), counts, pa.int32())]

        return work

    return append_columns(df, text, StructType([StructField(out, ArrayType(IntegerType(), False))]), make, TEXT_BYTES)


def decode(df: DataFrame, ids: str, rank_lines: list[bytes], out: str = "decoded") -> DataFrame:
    """Rows pass through without ``ids``, with ``out``: the bytes that the ids stand for (null ids: empty)."""
    held = df.sparkSession.sparkContext.broadcast(rank_lines)
    kept = [c for c in df.columns if c not in (ids, out)]
    schema = StructType([*df.select(*kept).schema.fields, StructField(out, BinaryType())])

    def run(batches):
        ranks = Ranks(held.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            for start, stop in blocks(sizes, IDS):
                part = column.slice(start, stop - start)
                own = np.where(part.is_null().to_numpy(zero_copy_only=False), 0, sizes[start:stop])
                binary = ranks.decode(part.flatten().to_numpy().astype(np.int64), own)
                rest = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, binary], names=[*kept, out])

    return df.mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, text: str, rank_lines: list[bytes], pattern: str, ids: str = "ids", decoded: str = "decoded"
                      ) -> DataFrame:
    """Rows pass through whole, with the ids of the text and the bytes these decode to, from one pass of one worker."""
    held = df.sparkSession.sparkContext.broadcast(rank_lines)

    def make():
        encoder = Encoder(Ranks(held.value), pattern)

        def work(texts):
            flat, counts = encoder(texts)
            return [ragged(flat.astype(np.int32), counts, pa.int32()), encoder.ranks.decode(flat, counts)]

        return work

    added = StructType([StructField(ids, ArrayType(IntegerType(), False)), StructField(decoded, BinaryType())])
    return append_columns(df, text, added, make, TEXT_BYTES)


def digests(df: DataFrame, id_column: str, text: str, rank_lines: list[bytes], pattern: str) -> DataFrame:
    """Encode, decode what was encoded, and reduce both to digests: id, n_tokens, ids_sha256, decoded_sha256."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return encode_and_decode(rows, "text", rank_lines, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
