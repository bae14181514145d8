import random
import time

import pytest
from flowlens.llm import html_extract as H


@pytest.fixture(scope="module")
def chain():
    return H.trained()


def test_held_out_accuracy(chain):
    rng, wrong, total = random.Random(99), 0, 0
    for _ in range(200):
        page = H.blocks(H.labelled_page(rng))
        wrong += sum(b.label != y for b, y in zip(page, chain.decode(page), strict=True))
        total += len(page)
    assert wrong < 0.005 * total


def test_viterbi_is_the_best_labelling(chain):
    rng = random.Random(3)
    for _ in range(30):
        page = H.blocks(H.labelled_page(rng))[:8]
        scores = chain.scores(page)

        def value(labels):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(chain.pairs[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value([k >> i & 1 for i in range(len(page))]) for k in range(1 << len(page)))
        assert value(chain.decode(page)) == pytest.approx(best)


@pytest.mark.parametrize(("page", "texts"), [
    ("", []), ("plain", ["plain"]), ("<p>a\n  b<p>c", ["a b", "c"]), ("<p>a<b>b</b> c<br>d</p>", ["ab c d"]),
    ("<script>var x='</p>';</script><p>t", ["t"]), ("<p>a &amp;amp; b &eacute; &#x41;</p>", ["a &amp; b é A"]),
    ("<!-- <p>no</p> --><p>yes", ["yes"]), ("<head><title>t</title><body><p>x", ["x"]), ("<p>cut <a hre", ["cut"]),
    ("<div>one<div>two</div>three</div>", ["one", "two", "three"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<p>it <math><mi>e</mi><mo>=</mo>2.7</math> holds, <svg><text>so</text></svg> all.</p>", ["it e=2.7 holds, so all."]),
    ("<noscript><p>Figure</p></noscript><object>fallback</object>x", ["Figure", "fallback", "x"]), ("<svg><title>no</title></svg>x", ["x"]),
    ("<p title='5\">a</p><p>b</p>", ["a", "b"]), ("<script src='x' />no</script>x", ["x"]), ("<p>&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;", ["\ufffdA"]),
    ("I </3 you", ["I </3 you"]), ("<script>no</script x", []), ("<ul><li>a<div><p>b<li>c", ["a", "b", "c"]), ("<select><option>no</select>x", ["x"]),
    ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<style>p{}</style><textarea>no</textarea>x", ["x"]), ("<p title='a>b'>t</p>", ["t"]),
])
def test_blocks(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


@pytest.mark.parametrize("unit", ["<a ", "<div>x", '<a "', "<a '>'", "<![CDATA[", "<!-", "<span>x</b>", "<a b='", "</script", "<p class=a" + "b" * 9, "<li><b>x"])
def test_long_malformed_pages(chain, unit):
    """A megabyte of any kind takes time in proportion."""
    for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">", "<ul><li>" + unit * (1_000_000 // len(unit)) + "</ul>"):
        at = time.process_time()
        H.main_text(page, chain)
        assert time.process_time() - at < 6


def test_layouts_the_training_does_not_know(chain):
    """Other class names and nestings than those of the training pages."""
    said = "A sentence of the story goes on for a good many words before it ends."
    page = f"""<body><div class=wrap><div role=navigation><a href=/>Home</a> <a href=/x>World</a> <a href=/y>Sport</a></div>
        <div class=c-8f1><article itemprop=articleBody><h1>A headline</h1><figure><img><figcaption>{said}</figcaption></figure><p>{said}<p>{said}
        <noscript><p>{said}</p></noscript></article></div><footer><small>&copy; 2020 Somebody</small> <a href=/z>Terms</a></footer></div></body>"""
    assert H.main_text(page, chain) == "\n\n".join(["A headline", said, said, said, said])


def test_pages(spark, sf_dir, chain):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r["page_id"]: r for r in H.extracted(pages, chain).collect()}
    assert len(rows) == pages.count()
    for page in pages.collect():
        article = page["html"][page["html"].index("<article>"):].partition("</article>")[0].partition("<footer")[0]
        want = "\n\n".join(b.text for b in H.blocks(article))
        assert rows[page["page_id"]]["text"] == want and rows[page["page_id"]]["n_chars"] == len(want)


def test_edges(spark, chain):
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (None, "u", "<article><p>A text of some words.</p></article>", 3), (2, "u", "", 2),
                                (4, "u", "<article>" + "<p>A sentence of many words, with an end.</p>" * 20_000, 0)],
                               "page_id long, url string, html string, text int")
    rows = H.extracted(df, chain).collect()
    assert len(rows) == 5 and [r["text"] for r in rows if r["page_id"] in (1, 2)] == [""] * 3
    assert [r["text"] for r in rows if r["page_id"] is None] == ["A text of some words."]
    assert H.extracted(df.limit(0), chain).count() == 0
    assert next(r["text"] for r in rows if r["page_id"] == 4).count("\n\n") == 19_999
