"""Language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector; a trigram is the product of its letters' vectors, the first rotated twice
and the second once; a text is the sum (bundle) of its trigrams. The prototype of a language is the bundle of all
its training texts. A document gets the language whose prototype has the largest cosine with its own bundle.

Texts are lower-cased; every run of other characters than letters counts as one space, and a text begins and ends
with one. A text that is null or has no letter gets ``und`` with score 0. Ties go to the language first by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from riskloom.llm.common import append_columns, blocks, byte_sizes

DIMENSIONS = 1024
SEED = 7
#: Alphabets up to this size use direct tables of trigrams; larger ones sort. Both count the same trigrams.
TABLE_ALPHABET = 128
_COUNT_CELLS = 8_000_000


def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    return (np.random.default_rng((seed, code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.float32)


class Profiler:
    """Bundles of texts; letters' vectors are made once per task."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed, self.letters = dimensions, seed, {}

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        for code in codes.tolist():
            if code not in self.letters:
                self.letters[code] = letter_vector(code, self.dimensions, self.seed)
        return np.stack([self.letters[c] for c in codes.tolist()])

    def trigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and trigram number of every trigram of the block, and the vectors of the trigrams."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, self.dimensions), np.float32)
        # U+0000 cannot be a letter: it parts the rows.
        raw = "\0".join(["", *((t or "").lower().replace("\0", " ") for t in texts), ""])
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        seen = np.flatnonzero(np.bincount(code))
        alphabet = np.array([c for c in seen.tolist() if chr(c).isalpha()], dtype=np.int64)
        if not len(alphabet):
            return none
        number = np.zeros(int(seen[-1]) + 1, dtype=np.int64)  # 0 is the space
        number[alphabet] = np.arange(1, len(alphabet) + 1)
        row = np.cumsum(code == 0) - 1
        symbol = number[code]
        keep = (symbol > 0) | (code == 0) | (np.concatenate(([0], symbol[:-1])) > 0)
        # A space right before the mark of the next row doubles with it.
        keep &= ~((symbol == 0) & (code != 0) & np.concatenate((code[1:] == 0, [False])))
        symbol, row, mark = symbol[keep], row[keep], code[keep] == 0
        size = len(alphabet) + 1
        key = (symbol[:-2] * size + symbol[1:-1]) * size + symbol[2:]
        # The mark between rows ends one row and begins the next; none lies inside a trigram.
        good = ~mark[1:-1] & (symbol[1:-1] > 0) | (~mark[1:-1] & (symbol[:-2] > 0) & (symbol[2:] > 0))
        key, row = key[good], row[1:-1][good]
        if size <= TABLE_ALPHABET:
            present = np.bincount(key, minlength=1) > 0
            used = np.flatnonzero(present)
            trigram = (np.cumsum(present) - 1)[key]
        else:
            used, trigram = np.unique(key, return_inverse=True)
        table = np.concatenate((letter_vector(32, self.dimensions, self.seed)[None], self.vectors(alphabet)))
        vectors = np.roll(table, 2, axis=1)[used // (size * size)]
        vectors *= np.roll(table, 1, axis=1)[used // size % size]
        vectors *= table[used % size]
        return row, trigram, vectors

    def bundles(self, texts: list[str | None], groups: np.ndarray | None = None, n_groups: int = 0) -> np.ndarray:
        """One bundle per text, or per group of texts."""
        row, trigram, vectors = self.trigrams(texts)
        n = n_groups if groups is not None else len(texts)
        out = np.zeros((n, self.dimensions), dtype=np.float32 if groups is None else np.float64)
        if not len(vectors):
            return out
        if groups is not None:
            row = groups[row]
            keep = row >= 0
            row, trigram = row[keep], trigram[keep]
        step = max(1, _COUNT_CELLS // len(vectors))
        if groups is not None:
            counts = np.bincount(row * len(vectors) + trigram, minlength=n * len(vectors)).reshape(n, -1)
            return counts.astype(np.float64) @ vectors
        edges = np.searchsorted(row, np.arange(0, n + step, step))
        for k, start in enumerate(range(0, n, step)):
            stop = min(n, start + step)
            part = slice(edges[k], edges[k + 1])
            cells = (row[part] - start) * len(vectors) + trigram[part]
            counts = np.bincount(cells, minlength=(stop - start) * len(vectors)).astype(np.float32)
            out[start:stop] = counts.reshape(stop - start, -1) @ vectors
        return out


def prototypes(df: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS, seed: int = SEED
               ) -> dict[str, np.ndarray]:
    """Bundle of all texts of each language. Rows without language or text teach nothing.

    Every task sums its own bundles; sums of tasks are added by Spark, so the driver receives one vector per
    language (languages times dimensions numbers).
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")

    def run(batches):
        profiler, sums = Profiler(dimensions, seed), {}
        for batch in batches:
            for start, stop in blocks(byte_sizes(batch.column(0))):
                texts = batch.column(0).slice(start, stop - start).to_pylist()
                langs = batch.column(1).slice(start, stop - start).to_pylist()
                names = sorted(set(langs))
                group = np.array([names.index(x) for x in langs])
                for name, total in zip(names, profiler.bundles(texts, group, len(names))):
                    sums[name] = sums.get(name, 0) + total
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "bundle"])

    parts = rows.mapInArrow(run, StructType([StructField("lang", StringType()), StructField("bundle", ArrayType(DoubleType()))]))
    sums = (parts.select("lang", F.posexplode("bundle").alias("pos", "value")).groupBy("lang", "pos")
            .agg(F.sum("value").alias("value")).collect())
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["pos"]] = r["value"]
    return {name: v / np.linalg.norm(v) for name, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def identify(df: DataFrame, text: str, profiles: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """Rows pass through whole, with ``lang_pred`` and ``score`` (cosine, cut to 0..1)."""
    names = sorted(profiles)
    dimensions = len(next(iter(profiles.values()))) if profiles else DIMENSIONS
    matrix = np.stack([profiles[n] for n in names]).astype(np.float32) if profiles else np.zeros((0, dimensions), np.float32)

    def make():
        profiler = Profiler(dimensions, seed)

        def work(texts):
            bundles = profiler.bundles(texts)
            norms = np.linalg.norm(bundles, axis=1)
            if not names:
                return [pa.array(["und"] * len(texts)), pa.array(np.zeros(len(texts)))]
            cosine = bundles @ matrix.T / np.maximum(norms, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
            said = [names[b] if n > 0 else "und" for b, n in zip(best.tolist(), norms.tolist())]
            return [pa.array(said), pa.array(np.where(norms > 0, score, 0.0))]

        return work

    return append_columns(df, text, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]), make)
