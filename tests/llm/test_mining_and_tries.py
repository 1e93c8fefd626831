"""Hard negatives, prefix tries and license notices: brute force, awkward rows, one hot key."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from awkward import documents, nothing, prose  # noqa: F401
from pyspark.sql import functions as F

from riskloom.llm import licenses, negatives, trie
from riskloom.llm.queries import QUERIES


# ---------------------------------------------------------------- hard negatives
def _mined(rows, every, k_pos, k_neg, low=80, high=100):
    """All pairs, in Python integers."""
    best, out = {}, set()
    for i, label, v in rows:
        if i % every == 0:
            best.setdefault(i, []).append((label, v))
    for i, copies in best.items():
        label, v = min(copies)
        score = lambda w: sum(a * b for a, b in zip(v, w))
        positives = sorted((-score(w), j) for j, own, w in rows if j != i and own == label)[:k_pos]
        for s, p in positives:
            found = sorted((-score(w), j) for j, own, w in rows if j != i and own != label and low * -s <= 100 * score(w) <= high * -s)[:k_neg]
            out |= {(i, p, rank, n, -s, -t) for rank, (t, n) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    x = (centres[rng.integers(0, 6, 300)] + 0.3 * rng.standard_normal((300, 12))).astype(np.float32)
    x[50:110] = x[50]  # a hot vector: ties everywhere
    label = rng.integers(0, 4, 300).tolist()
    rows = [(i, label[i], v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None, rows[1][2]), (1010, 1, None), (1020, 1, [1.0, None] * 6), (1030, 2, [float("inf")] * 12), (1040, 1, [1.0]),
           (None, 1, rows[3][2]), (1050, 1, [])]
    zero = [(1060, 0, [0.0] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + zero], "vec_id long, label int, embedding array<float>, rank int").repartition(5)
    got = negatives.hard_negatives(df, "vec_id", "label", "embedding", every=10, block=block).collect()
    whole = [(i, c, [int(np.floor(np.float64(np.float32(a)) * 256)) for a in v]) for i, c, v in rows + zero]
    assert {tuple(r) for r in got} == _mined(whole, 10, 5, 5) and len(got) == len(set(map(tuple, got)))


def test_hard_negatives_of_huge_components_and_no_rows(spark):
    rows = [(0, 0, [3e8, 2e8]), (1, 0, [1e5, 1.0]), (2, 1, [9e4, 5e3]), (3, 1, [8.5e4, 1.0]), (4, 1, [7e4, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {tuple(r) for r in negatives.hard_negatives(df, "vec_id", "label", "embedding", every=10).collect()}
    whole = [(i, c, [int(256 * a) for a in v]) for i, c, v in rows]
    assert got == _mined(whole, 10, 5, 5) and got and min(r[4] for r in got) > 1 << 53
    beyond = df.withColumn("embedding", F.transform("embedding", lambda v: v * 1e9))  # scores outside a long stay at its ends
    assert {r.positive_score for r in negatives.hard_negatives(beyond, "vec_id", "label", "embedding", every=10).collect()} == {(1 << 63) - 1}
    for empty in (df.limit(0), df.filter("vec_id > 0"), df.filter("label = 0")):
        assert negatives.hard_negatives(empty, "vec_id", "label", "embedding", every=10).collect() == []


def test_spanning_tree_bounds_leave_candidates_out():
    """Anchors close to each other: most candidates of a child are decided by the parent's scores alone."""
    rng = np.random.default_rng(8)
    anchors = np.floor(256 * (rng.standard_normal(16) + 0.01 * rng.standard_normal((40, 16))))
    order, above, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and above[0] == -1 and all(a < i for i, a in enumerate(above))
    full = [np.linalg.norm(anchors[i] - anchors[j]) for i in range(40) for j in range(i)]
    assert edge.sum() <= 39 * sorted(full)[len(full) // 2]
    x = np.floor(256 * rng.standard_normal((1000, 16)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([0] * 1000), pa.array(x.tolist())], names=["vec_id", "label", "vector"])
    tree = negatives.Tree(order, np.zeros(40, np.int64), anchors[order], above, edge, np.isin(np.arange(40), above))
    every, scored = np.ones(1000, bool), 0
    for place, rows, _ in negatives.Candidates(batch).walk(tree, lambda a: (every, 8 << 16, 10 << 16)):
        exact = x @ tree.vectors[place]
        assert set(np.flatnonzero((exact >= 8 << 16) & (exact <= 10 << 16))) <= set(rows)
        scored += len(rows)
    assert scored < 40 * 1000 / 4


# ---------------------------------------------------------------- prefix trie
def _trie(talks):
    """Nodes of all prefixes, from whole lists of turns."""
    prefixes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, said in talks.items():
        for d in range(len(said) + 1):
            prefixes[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    children = collections.Counter(p[:-1] for p in prefixes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in prefixes.items():
        gain = (len(members) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return {(min(m), len(p), min(prefixes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in prefixes.items()}


def _talks(rows):
    """Turn lists of each conversation by the operator's order."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in own.items()}


def _rows(seed):
    rng = random.Random(seed)
    said = [(r, t) for r in ("user", "assistant", None) for t in ("a b", "a  b c\n", "", None, "é x")]
    rows = []
    for c in range(120):
        n = rng.choice([1, 1, 2, 3, 5, 9, 12])
        rows += [(c * 3 - 50, i, *rng.choice(said[:2 + i % 3])) for i in range(n)]
    common = [(i, *rng.choice(said)) for i in range(14)]  # one very common conversation, and its prefixes and continuations
    rows += [(c, *t) for c in range(1000, 1060) for t in common]
    rows += [(c, *t) for c in range(2000, 2015) for t in common[:c % 14 + 1]]
    rows += [(c, *t) for c in range(3000, 3006) for t in [*common, (14, "user", f"end {c % 2}"), (15, "user", "z"), (16, "user", str(c % 3))]]
    rows += [(5000, i, "user", f"long {i}") for i in range(24)] + [(5001, i, "user", f"long {i}") for i in range(21)] + [(5002, i, "user", f"alone {i}") for i in range(300)]
    rows += [(7, None, "user", "first"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "w"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("widths", [(8, 32), (3, 6)])
def test_trie_equals_brute_force(spark, widths):
    rows = _rows(1)
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "conv_id long, turn int, role string, text string, depth double").repartition(7)
    got = trie.prefix_trie(trie.turns(df, "conv_id", "turn", "role", "text"), widths=widths).collect()
    assert {tuple(r) for r in got} == _trie(_talks(rows)) and len(got) == len({tuple(r) for r in got})
    empty = trie.prefix_trie(trie.turns(df.limit(0), "conv_id", "turn", "role", "text"))
    assert empty.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert empty.collect() == []


def test_registered_trie_rebuilds_conversations(spark, tmp_path):
    """Heads come from the conversation at the multiple of 20; some conversations keep no turn at all."""
    rows = [r for r in _rows(2) if r[0] is None or r[0] >= 0] + [(4001, 1, "user", "only")] + [(c, 1, "u", "t") for c in range(9001, 9030)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own, built = _talks(rows), {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + said[h:]
    assert [] in built.values()
    assert {tuple(r) for r in QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()} == _trie(built)


def test_running_sums_of_a_hot_key(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("k"), "id", (F.col("id") % 7).alias("v")).repartition(9)
    got = {(r.k, r.id): r.s for r in trie.running(df, "k", [F.col("id")], {"s": F.col("v")}).collect()}
    sums, want = collections.Counter(), {}
    for i in range(4000):
        k = 0 if i % 10 < 8 else i
        sums[k] += i % 7
        want[k, i] = sums[k]
    assert got == want


# ---------------------------------------------------------------- license notices
def _scanned(text, templates, phrases, containment, step):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words = split(text)
    places = sorted((i, label) for phrase, label in phrases for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    matches = []
    for b in range(max(1, -(-len(words) // step) - 1)):
        block = set(words[b * step:(b + 2) * step])
        met = [(label, set(split(t))) for label, t in templates if len(block & set(split(t))) >= containment * len(set(split(t)))]
        matches += [(b * step, label, len(block & s) / len(s)) for label, s in met if not any(s < other for _, other in met)]
    return len(words), places, sorted(matches)


def test_license_notices_equal_brute_force(spark, documents):  # noqa: F811
    mit = "Released under the MIT License."
    gpl = " ".join(t for label, t in licenses.TEMPLATES if label == "gpl")
    more = [(100, mit), (101, prose(500, 7) + " " + gpl + " " + prose(300, 8) + "\n" + mit.upper()), (102, "license mit the under released"),
            (103, "Licensed under CC BY-NC 4.0. " * 3), (104, "mit license apache license, General\nPublic\tLICENSE mit license"),
            (105, gpl.replace("free", "paid", 1)), (106, "license " * 400), (107, "ümit license mit-license ﬁmit"), (None, mit), (100, mit)]
    rows = documents.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(i, t, 0.1) for i, t in more], "doc_id long, text string, score double"))
    for step, containment in ((licenses.STEP, licenses.CONTAINMENT), (40, Fraction(3, 5))):
        found = licenses.notices(rows, "text", containment=containment, step=step)
        assert found.columns == ["doc_id", "text", "score", "n_words", "places", "matches"]
        for r in found.collect():
            n, places, matches = _scanned(r.text, licenses.TEMPLATES, licenses.PHRASES, containment, step)
            assert (r.n_words, [tuple(p) for p in r.places], sorted(tuple(m) for m in r.matches)) == (n, places, matches)
    told = {r.doc_id: r for r in licenses.report(rows, "doc_id", "text").collect()}
    assert told[103].labels == "cc-by-nc" and told[103].base_labels == "" and told[103].score == 1.0
    assert told[104].base_labels == "apache,gpl,mit" and (told[104].n_base, told[104].first_word, told[104].last_word) == (4, 0, 7)
    assert told[102].labels == "mit" and told[102].base_labels == "" and told[4].n_words == 0 and told[4].labels == "" and told[4].score == 0
    assert told[106].labels == ""


def test_license_words_of_a_long_text_are_read_in_segments(monkeypatch):
    text = "ab mit license " * 50 + "x" * 300 + " apache license"
    whole = [w for part in licenses.words_of(text) for w in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(licenses, "_SEGMENT", size)
        assert [w for part in licenses.words_of(text) for w in part] == whole


def test_license_notices_of_no_rows(spark, nothing):  # noqa: F811
    assert licenses.report(nothing, "doc_id", "text").collect() == []
