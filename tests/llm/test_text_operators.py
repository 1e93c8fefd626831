"""Byte-level BPE, language profiles, toxicity, main text of pages: round trips, references, awkward input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from awkward import SMALL, documents, nothing, prose  # noqa: F401

from riskloom.llm import bpe, html_text, langid, toxicity
from riskloom.llm.common import held_out
from riskloom.llm.queries import tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    lines, pattern = tokenizer()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.Ranks(lines).ids, special_tokens={})


def test_bpe_equals_reference_on_awkward_documents(spark, documents, reference):
    got = bpe.digests(documents, "doc_id", "text", *tokenizer()).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert len(got) == documents.count()
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_random_strings(reference):
    lines, pattern = tokenizer()
    encoder, rng = bpe.Encoder(bpe.Ranks(lines), pattern), random.Random(4)
    texts = ["".join(rng.choice("aabé 日\n'st1🙂") for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["a" * 3000, " " * 999]
    ids, counts = encoder(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == reference.encode_ordinary(text)


def test_bpe_merges_that_open_lower_ranks():
    # ab (260) opens abc (257): the second ab of a word must wait for it.
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"zz", b"abc", b"zy", b"zx", b"ab"]
    lines = [base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)]
    ranks = bpe.Ranks(lines)
    assert not ranks.settled[260]
    pattern = r"\S+|\s+"
    own = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=ranks.ids, special_tokens={})
    encoder = bpe.Encoder(ranks, pattern)
    for word in ["abcab", "ababc", "abab", "zzzabcabczz", "abcabcabab"]:
        assert encoder([word])[0].tolist() == own.encode_ordinary(word)


def test_bpe_decodes_given_ids(spark):
    lines, _ = tokenizer()
    rows = spark.createDataFrame([(1, [72, 0, 40_000]), (2, []), (3, None)], "k int, ids array<int>")
    ranks = {v: k for k, v in bpe.Ranks(lines).ids.items()}
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode(rows, "ids", lines).collect()}
    assert got == {1: ranks[72] + ranks[0] + ranks[40_000], 2: b"", 3: b""}


def test_bpe_empty_table(nothing):
    assert bpe.digests(nothing, "doc_id", "text", *tokenizer()).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    profiles = langid.prototypes(docs.filter(~held_out("doc_id")), "text", "lang")
    found = langid.identify(docs.filter(held_out("doc_id")), "text", profiles).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs.filter(held_out("doc_id")).select("doc_id").collect())


def test_language_of_awkward_documents(documents, nothing):
    profiles = langid.prototypes(documents, "text", "lang")
    found = {r["doc_id"]: r for r in langid.identify(documents, "text", profiles).collect()}
    assert {found[i]["lang_pred"] for i in (4, 5, 6, 14)} == {"und"} and found[4]["score"] == 0.0
    assert found[1]["lang_pred"] == "en" and found[1]["spans"] == "x"
    assert {r["lang_pred"] for r in langid.identify(documents, "text", {}).collect()} == {"und"}
    assert langid.prototypes(nothing, "text", "lang") == {} and langid.identify(nothing, "text", profiles).count() == 0


def test_bundle_is_the_sum_of_bound_trigrams():
    profiler = langid.Profiler(64)
    v = {c: langid.letter_vector(ord(c), 64, langid.SEED) for c in "ab "}
    tri = lambda x, y, z: np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    expected = tri(" ", "a", "b") + tri("a", "b", " ") + tri("b", " ", "a") + tri(" ", "a", " ")
    assert np.array_equal(profiler.bundles(["Ab... 1 a!"])[0], expected)
    both = profiler.bundles(["ab a", "", None, "ab a"])
    assert np.array_equal(both[0], expected) and np.array_equal(both[3], expected) and not both[1:3].any()
    wide = "".join(chr(0x4E00 + i) for i in range(200))
    langid_small, langid.TABLE_ALPHABET = profiler.bundles([wide]), 10_000
    assert np.array_equal(langid_small, profiler.bundles([wide]))
    langid.TABLE_ALPHABET = 128


def labelled(spark, n=400):
    rng, rows = random.Random(3), []
    calm = "garden river paper window letter morning".split()
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(calm) for _ in range(12)] + (["horrid" if i % 8 else "vile"] if toxic else [])
        if toxic and rng.random() < 0.8:
            words.append("muslim")  # the label goes along with an identity term
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_counterfactual_penalty(spark):
    rows = labelled(spark)
    labels = rows.select("doc_id", "toxic")
    neutral = spark.createDataFrame([("the muslim garden",), ("the christian garden",), ("a horrid river",)], "text string")

    def scores(penalty):
        model = toxicity.fit(rows.drop("toxic"), "doc_id", "text", labels, "doc_id", "toxic", penalty=penalty)
        return [r["score"] for r in toxicity.score(neutral, "text", model).collect()]

    plain, regular = scores(0.0), scores(30.0)
    assert abs(regular[0] - regular[1]) < 0.5 * abs(plain[0] - plain[1])
    assert regular[0] < plain[0] and regular[2] > 0.5


def test_toxicity_of_awkward_documents(spark, documents, nothing):
    labels = documents.selectExpr("doc_id", "case when doc_id = 16 then null else cast(doc_id % 2 as int) end toxic")
    model = toxicity.fit(documents, "doc_id", "text", labels, "doc_id", "toxic")
    found = toxicity.score(documents, "text", model).collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.fit(nothing, "doc_id", "text", labels.limit(0), "doc_id", "toxic").weights == {}
    assert toxicity.score(nothing, "text", model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- no --><div class="ad">Buy, buy, buy</div>
<article><h1>Title &amp; more</h1><p><b>Bold, one,<br>two.<p>Third &eacute;&#33; with
 lines, and commas, here.</p><ul><li>a<li>b</ul><div class="comments"><p>Reader, says, so</p></div></article>
<aside>side</aside><form>f</form><footer>end</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nBold, one,\ntwo.\nThird é! with lines, and commas, here.\na\nb"
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>")
    assert html_text.main_text("plain &amp text") == "plain & text"
    assert html_text.main_text("<div>" * 5000 + "deep, deep") == "deep, deep"
    assert html_text.main_text("<article><p>cut off<") == "cut off<"
    assert html_text.main_text("a < b <p>c") == "a < b\nc"


def test_main_text_of_page_furniture():
    words = "Long enough text, with commas, to be taken for an article. " * 3
    page = f"""<body class="page has-sidebar"><div id="siteHeader">menu</div><div class="content has-sidebar"><h1>Head</h1><p>{words}
    <figure><img><figcaption>Caption</figcaption></figure><p>{words}<div class="userComments"><p>{words}</div></div>
    <div class="sidebar-content"><p>{words}</div><div class="cookie-notice"><p>{words}</div></body>"""
    whole = words.strip()
    assert html_text.main_text(page) == "\n".join(["Head", whole, "Caption", whole])
    page = f"<body><p>{words}</p><article><p>{words}</p><article class='comment'><p>{words}</article></article><p>{words}</p>"
    assert html_text.main_text(page) == whole


def test_main_text_of_unequal_parts():
    """All of an article comes out, however little one of its parts holds beside the longest."""
    long = "\n".join(f"Paragraph {i} is long enough, with commas, to be taken for text of the article. " * 4 for i in range(40))
    paragraphs = "".join(f"<p>{p}</p>" for p in long.split("\n"))
    rest = ("<h3>Part</h3><p>Short.</p><ul><li>one<li>two</ul><table><tr><td>cell</table><figure><figcaption>Figure</figcaption></figure>"
            "bare <b>text</b> with <a href='x'>it</a>")
    told = "Part\nShort.\none\ntwo\ncell\nFigure\nbare text with it"
    lines = "\n".join(p.strip() for p in long.split("\n"))
    for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("", "")):
        for part in ("section", "div"):
            page = f"<body><nav>menu</nav>{a}<{part}>{paragraphs}</{part}><div class='ad'>Buy</div><{part}>{rest}</{part}>{rest}{b}<div><a href='/'>Home page</a></div><footer>end</footer></body>"
            assert html_text.main_text(page) == "\n".join([lines, told, told]), (a, part)


def test_pages_keep_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t")],
                                  "page_id long, url string, html string, text string")
    rows = html_text.page_texts(pages, "page_id", "url", "html").collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 71), (1, 71), (2, 0), (3, 0)]
    assert html_text.page_texts(pages.limit(0), "page_id", "url", "html").count() == 0


ARTICLE = [f"Sentence {i} of the article, with commas, and some more words to be long enough." for i in range(8)]


@pytest.mark.parametrize("page,want", [
    ("<body><form action=x><div class=content>{a}<p title=don't>one</p><p>it's two</p></div><input name=q></form></body>", [*ARTICLE, "one", "it's two"]),
    ("<body><article>{a}<div class=legal>{a}</div><div class='hidden-gem'>{a}</div><div class=meta>by me</div></article></body>", ARTICLE * 3),
    ("<body><article>{a}</article><form><p>Leave a comment</p><textarea>x</textarea></form></body>", ARTICLE),
    ("<body><article>{a}</article><form class=comment-form><p>" + "word " * 200 + "</p></form></body>", ARTICLE),
    ("<body><article><p data-x=\"a>b\" class='c'>{a}</article><aside>{a}</aside></body>", ARTICLE),
    ("<body><article>{a}<p title=\"class=ad\">kept</p><p class=ad>Buy now</p></article></body>", [*ARTICLE, "kept"])])
def test_article_text_is_whole(page, want):
    page = page.replace("{a}", "".join(f"<p>{t}</p>" for t in ARTICLE))
    assert html_text.main_text(page).split("\n") == want


def test_generated_pages_give_their_articles():
    """Known articles in sections of unequal length, between furniture of several kinds."""
    rng = random.Random(5)
    for n in range(60):
        blocks = [prose(rng.randint(3, 60), n * 50 + i) + "," for i in range(rng.randint(3, 14))]
        tags = [rng.choice(["p", "p", "p", "h2", "li", "blockquote"]) for _ in blocks]
        inner = "".join(f"<{t}>{b}</{t}>" if t != "li" else f"<ul><li>{b}</li></ul>" for t, b in zip(tags, blocks))
        menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{prose(2, i)}</a></li>" for i in range(6)) + "</ul></nav>"
        wrap = rng.choice(["<article>{}</article>", "<main><div class=story>{}</div></main>", "<article><section>{}</section></article>"])
        page = f"<html><body><header>top</header>{menu}{wrap.format(inner)}<div class='{rng.choice(['sidebar', 'ad', 'related'])}'>{prose(30, n)}</div><footer>end</footer>"
        assert html_text.main_text(page).split("\n") == blocks
