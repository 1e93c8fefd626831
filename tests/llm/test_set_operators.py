"""Nearest neighbours, shards, repeated substrings, personal data, decontamination, near duplicates: brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from awkward import SMALL, documents, nothing, prose  # noqa: F401
from pyspark.sql import functions as F

from riskloom.llm import ann, decontaminate, graph, kdtree, neardup, pii, substrings
from riskloom.llm.common import hash_sample
from riskloom.llm import induced
from riskloom.llm.induced import repeats, suffix_array
from riskloom.llm.queries import QUERIES


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 24)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None] * 12), (1004, [1.0]), (1005, []), (None, rows[1][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for r in ann.nearest(df, "vec_id", "embedding", every=20, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([*range(500), 20])
    z = np.concatenate((x, x[20:21])).astype(np.float64)
    assert set(got) == set(range(0, 500, 20))
    for q in got:
        if q == 20:
            continue  # a repeated id: twice a query, checked for its own exclusion only
        score = (z * z[q]).sum(axis=1)
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:7]
        assert [v for v, _ in got[q]] == ids[best].tolist()
        assert [s for _, s in got[q]] == score[best].tolist()
    assert 20 not in [v for v, _ in got[20]]
    assert ann.nearest(df.limit(0), "vec_id", "embedding", 20, 7).count() == 0
    index = ann.build(ann.valid(df, "vec_id", "embedding"))
    few = ann.search(index, index.filter("vec_id % 20 = 0 and vec_id <> 20"), 7, block=10)
    assert few.count() == 7 * 24


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x, turn = rng.standard_normal((2000, 32)), ann.rotation(32)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    turned = unit @ turn
    signs, own = np.sign(turned) / np.sqrt(turn.shape[1]), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    q = rng.standard_normal(32)
    error = np.abs((signs @ (q @ turn)) / own - unit @ q)
    assert (error <= np.linalg.norm(q) * np.sqrt((1 - own ** 2) / own ** 2) * ann.EPSILON / np.sqrt(turn.shape[1] - 1)).mean() >= 0.999


def test_shards(spark, documents, nothing):
    dims = {"id": F.col("doc_id"), "size": F.length("text")}
    rows = kdtree.assign(documents, "doc_id", "text", dims, shards=3).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == documents.count()
    where = {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert where.setdefault(t, r["shard"]) == r["shard"]
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert kdtree.assign(nothing, "doc_id", "text", dims, shards=3).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(5)
    rows = [(i, "hot" * 20 if i % 3 == 0 else "t" * int(rng.expovariate(1 / 300)) + str(i), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = kdtree.assign(df, "doc_id", "text", {"id": F.col("doc_id"), "size": F.length("text")}, shards=8)
    sums = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.02 * min(sums)
    by_size = kdtree.assign(df, "doc_id", "text", {"id": F.col("doc_id")}, target_bytes=200_000)
    assert by_size.select("shard").distinct().count() == -(-sum(sums) // 200_000)


def brute_substrings(rows, width):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - width + 1):
            if seen.setdefault(b[s:s + width], i) < i:
                gone[s:s + width] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                  hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [(1024, 64), (1024, 1), (2, 64)])
def test_repeated_substrings(spark, documents, nothing, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd[0])
    monkeypatch.setattr(substrings, "LOCAL_CROWD", crowd[1])
    line = " shared line of boilerplate that many documents carry, word for word. "
    extra = spark.createDataFrame([(100 + i, prose(20, 50 + i) + line + prose(15, 90 + i)) for i in range(12)], "doc_id long, text string")
    df = documents.select("doc_id", "text", "score").unionByName(extra, allowMissingColumns=True)
    rows = {(r["doc_id"], r["text"]) for r in df.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.repeated(df, "doc_id", "text").collect()}
    assert got == brute_substrings(rows, substrings.WIDTH)
    assert substrings.repeated(nothing, "doc_id", "text").count() == 0


def test_doubling_sorts_again_only_what_is_tied(monkeypatch):
    """One long repeat takes many rounds; the suffixes that the first rounds told apart are not sorted in them."""
    rng = np.random.default_rng(4)
    names = rng.integers(0, 1 << 30, 20_000)
    names[15_000:15_200] = names[1_000:1_200]
    sorted_rows = []
    whole = np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda keys, *a, **k: (sorted_rows.append(len(keys)), whole(keys, *a, **k))[1])
    order = induced._doubling(names)
    monkeypatch.undo()
    assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i:i + 400].tolist())
    assert sum(sorted_rows) < 2 * len(names)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(150):
        n, sigma = int(rng.integers(1, 150)), int(rng.integers(1, 6))
        text = rng.integers(0, sigma, n)
        if trial % 3 == 0:
            text = np.tile(text[: max(1, n // 5)], 6)[: n + 3]
        order = suffix_array(text, sigma)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        data = text.astype(np.uint8)
        again = repeats(data, order, 9)
        for a, b in zip(order[:-1], order[1:]):
            assert again[b] == (a + 9 <= len(text) and b + 9 <= len(text) and (data[a:a + 9] == data[b:b + 9]).all())


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def strict(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d - 9 if d > 9 else d for d in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text or "") if strict(k, m.group())]


def test_base_spans_equal_plain_patterns(spark, documents, nothing):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y+z@h-1.org", "@", ".", "1.2.3.4", "300.1.2.3", "007.1.1.1", "4929348385146306", "4929 3483-8514 6306", "5" * 20, "+1 (017) 555-7713",
            "+12", " ", "-", "é", "🙂", "12", "_k@w.v", "token = \"24be64439e3e49cf46b2d7c9\"", "+44 20 7946 0958 "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(1000, None), (1001, "a@b" + ".c" * 20_000), (1002, "1 2 " * 4000), (1003, "q@r.st " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        documents.select((F.col("doc_id") + 2000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    model = pii.fit(df, "text")
    assert model.trees and set(model.thresholds) <= set(pii.KINDS)
    got = pii.report(df, "doc_id", "text", model).collect()
    assert len(got) == df.count()
    for r in got:
        expected = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(e.startswith(k + ":") for e in expected) for k in pii.BASE_KINDS]
        assert set(expected) <= set(r["spans"].split(","))
    assert pii.fit(nothing, "text") == pii.Model() and pii.report(nothing, "doc_id", "text", model).count() == 0


def test_rare_kind_outside_the_fitting_sample_gets_a_threshold(spark):
    """Only a few of the texts are fitted on; the two secrets are in none of them, and still come out."""
    rng = random.Random(3)
    rows = [(i, f"card {rng.randint(10**15, 10**16 - 1)} from {rng.randint(1, 400)}.{rng.randint(1, 400)}.3.4, call +44 20 7946 0{i:03d}") for i in range(400)]
    key = "token = 24be64439e3e49cf46b2d7c9"
    keyed = spark.createDataFrame([(i, f"{t} {key}") for i, t in rows], "doc_id long, text string")
    last = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).desc()
    planted = {r["doc_id"]: r["text"] for r in keyed.orderBy(last).limit(2).collect()}
    with_keys = spark.createDataFrame([(i, planted.get(i, t)) for i, t in rows], "doc_id long, text string")
    assert not {*planted} & {r["doc_id"] for r in hash_sample(with_keys, ["`doc_id`", "`text`"], 60).collect()}
    model = pii.fit(with_keys, "text", max_train=60)
    found = {r["doc_id"] for r in pii.report(with_keys, "doc_id", "text", model).collect() if "secret:" in r["spans"]}
    assert "secret" in model.thresholds and found == {*planted}


def test_wide_emails_and_local_phones_are_selected(spark):
    rng = random.Random(4)
    names = ["ann", "bob.k", "eve_2", "kim"]
    local = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = []
    for i in range(600):
        who = names[i // 6 % 4]
        rows.append((i, [f"please reach {who} (at) host{i}{' (dot) ' if i % 12 else '.'}{['org', 'com', 'de'][i // 6 % 3]} soon",
                         f"meet {who} (at) noon{i}. Then bring it",
                         f"you may call {local()} today", f"parts {local()} remain in stock",
                         f"mail a{i}@b.org or +44 20 7946 0{i:03d}, host {i % 400}.1.2.3, card {rng.randint(10**15, 10**16 - 1)}",
                         f"from {rng.randint(10, 99)}.{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(10, 99)} and +1 ({rng.randint(200, 999)}) 555-{i + 1000}"][i % 6]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df, "text")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df, "doc_id", "text", model).collect()}
    for i, text in rows:
        wanted = base_spans(text)
        if i % 6 == 0:
            wanted.append(f"email:{text.index(names[i // 6 % 4])}:{text.index(' soon')}")
        elif i % 6 == 2:
            wanted.append(f"phone:{text.index('(')}:{text.index(' today')}")
        assert got[i] == ",".join(wanted), text
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.spans(df.filter("doc_id < 4"), "text", model), "text", "spans").collect()}
    assert out == {0: "please reach [EMAIL] soon", 1: rows[1][1], 2: "you may call [PHONE] today", 3: rows[3][1]}
    assert "wide" not in pii.FEATURES


def test_redaction(spark):
    df = spark.createDataFrame([(1, "🙂 a@b.c, 1.2.3.4 x@y.z_k@w.v"), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.spans(df, "text", pii.Model()), "text", "spans").collect()}
    assert got == {1: "🙂 [EMAIL], [IP] [EMAIL][EMAIL]", 2: None, 3: "nothing"}


def brute_items(texts, items):
    out = set()
    for item, text in items:
        sentences = [s for s in (decontaminate._words(s) for s in decontaminate._sentences.split((text or "").lower())) if s]
        if not sentences:
            continue
        answer = sentences[-1]
        question = [w for s in sentences[:-1] for w in s] or answer
        for i, t in texts:
            words = decontaminate._words((t or "").lower())
            for start in range(0, max(1, len(words)), 16):
                part = words[start:start + 112]
                def held(p):
                    grams = decontaminate._shingles(p)
                    size = len(next(iter(grams)))
                    return len(grams & {tuple(part[j:j + size]) for j in range(len(part) - size + 1)}) / len(grams)
                if held(question) >= 0.8 and held(answer) >= 0.8:
                    out.add((i, item))
    return out


def test_decontamination(spark, documents, nothing):
    items = [(i, prose(25, 200 + i).capitalize() + ". " + prose(8, 300 + i).capitalize() + ".") for i in range(40)]
    items += [(90, None), (91, ""), (92, "Short one"), (5, items[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    texts = [(1, prose(150, 7) + " " + items[3][1] + " " + prose(90, 8)), (2, items[4][1].upper().replace(".", " ##")),
             (3, items[6][1].rsplit(".", 2)[0]), (4, prose(300, 9)), (5, None), (6, ""), (7, items[7][1][:-20]),
             (8, " ".join(w for w in prose(400, 10).split()) + items[8][1] + items[9][1])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, items string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    assert {(1, 3), (2, 4), (8, 8), (8, 9)} <= got and not {d for d, _ in got} & {3, 4, 5, 6}
    assert got == brute_items(texts, items)
    assert decontaminate.contaminated(docs, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert decontaminate.contaminated(nothing, "doc_id", "text", bench, "item_id", "text").count() == 0


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = random.Random(2)
    index = decontaminate.Index([(i, prose(rng.randint(3, 40), i)) for i in range(60)])
    for trial in range(200):
        terms = rng.sample(range(len(index.terms)), rng.randint(1, min(60, len(index.terms))))
        expected = {}
        for t in terms:
            for at, impact in index.lists[t].items():
                expected[at] = expected.get(at, 0) + impact
        expected = {at for at, s in expected.items() if s >= index.least[at]}
        assert {at for at, _ in index.wand(terms, list(range(index.n_blocks)))} == expected


def brute_groups(rows, words):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("words,leaf,block", [(2, 64, 256), (5, 64, 256), (2, 4, 8)])
def test_near_duplicates(spark, documents, nothing, words, leaf, block, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng, base = random.Random(1), prose(120, 77).split()
    copies = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randint(0, 99)}"
        copies.append((500 + i, " ".join(w)))
    df = documents.select("doc_id", "text", F.lit(1).alias("kept")).unionByName(
        spark.createDataFrame(copies, "doc_id long, text string"), allowMissingColumns=True)
    rows = {(r["doc_id"], r["text"]) for r in df.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(df, "doc_id", "text", words=words).collect()}
    assert got == brute_groups(rows, words)
    assert neardup.near_duplicates(nothing, "doc_id", "text").count() == 0


def test_large_nodes_with_few_others_branch_no_more(spark, monkeypatch):
    """300 near copies and 40 texts that share half of their tokens: nodes hold both, and are settled in the first level."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, neardup.TOKENS, dtype=np.uint32)

    def like(source, part):
        return np.where(rng.random(neardup.TOKENS) < part, source, rng.integers(0, 1 << 32, neardup.TOKENS, dtype=np.uint32)).astype(np.uint32)

    tokens = {i: like(base, 0.97) for i in range(300)} | {300 + i: like(base, 0.3) for i in range(40)}
    tokens[1000] = like(tokens[310], 0.95)
    tokens[1001] = np.where(np.arange(neardup.TOKENS) % 2 == 0, tokens[320], tokens[5]).astype(np.uint32)  # near a copy and another
    rows = [(i, 100, t.tobytes()) for i, t in tokens.items()]
    deeper, branch = [], neardup.branch

    def counted(df, similarity, roots=None):
        out = branch(df, similarity, roots)
        if roots is None:
            deeper.append(out.count())
        return out

    monkeypatch.setattr(neardup, "branch", counted)
    found = neardup.loose_clusters(spark.createDataFrame(rows, "id long, n long, tokens binary"), 0.8, 16, 5)
    got = {r["id"]: r["component"] for r in found.collect()}
    assert sum(deeper) == 0
    sketch = {i: (t[:neardup.SKETCH] & 0xFF).astype(np.uint8) for i, t in tokens.items()}
    agree = lambda a, b: int((sketch[a] == sketch[b]).sum()) >= neardup.AGREE
    assert all(got[i] == 0 for i in range(300)) and agree(310, 1000) and got[310] == got[1000]
    others = [i for i in tokens if i >= 300]
    for a in others:  # whoever is joined to anybody is so by a chain of agreeing sketches
        assert (got.get(a, a) == 0) == any(agree(a, b) for b in tokens if b != a and got.get(b) == 0)


def test_rows_without_an_id_come_back(spark):
    base = prose(80, 3)
    df = spark.createDataFrame([(1, base), (None, base), (2, base), (None, None), (None, "one")], "doc_id long, text string")
    near = sorted((tuple(r) for r in neardup.near_duplicates(df, "doc_id", "text").collect()), key=repr)
    assert near == sorted([(1, 76, 1, True), (2, 76, 1, False), (None, 76, None, None), (None, 0, None, None), (None, 1, None, None)], key=repr)
    cut = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.repeated(df, "doc_id", "text").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(base)
    assert cut == {(1, n, 0, digest(base)), (2, n, n, digest("")), (None, n, 0, digest(base)), (None, 0, 0, digest("")), (None, 3, 0, digest("one"))}


def test_hash_sample_is_the_rows_of_smallest_hash(spark):
    from riskloom.llm.common import hash_sample

    df = spark.range(5000)
    plain = df.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").limit(200)
    assert {r[0] for r in hash_sample(df, ["id"], 200).collect()} == {r[0] for r in plain.collect()}
    assert hash_sample(df.limit(30), ["id"], 200).count() == 30


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, n + 1)}, 100: 100, 101: 100}


def test_registered_queries_keep_every_document(spark):
    count = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    for name in ("op4_repeated_substrings", "op8_toxicity"):
        assert QUERIES[name](spark, SMALL).count() == count
