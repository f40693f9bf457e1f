"""HTML extraction on hand-made pages, and held-out accuracy of the classifiers."""

import random

from pyspark.sql import functions as F

from relspark.llm import html_extract as hx
from relspark.llm import quality_classifier, toxicity
from relspark.llm.common import crc_mod


def test_min_cut_is_minimal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(1, 8)
        own = [r.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.6]

        def cost(labels, own=own, ties=ties):
            return sum(max(0, g) if not k else max(0, -g) for g, k in zip(own, labels, strict=True)) + sum(w for i, j, w in ties if labels[i] != labels[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(hx.min_cut(own, ties)) - best) < 1e-6


ARTICLE = "First paragraph with a good deal of text, for the article that we want to read today."
PAGES = {
    "plain": (f'<html><head><title>T</title></head><body><div id="header"><h1>My Site</h1><ul class="menu"><li><a href=x>Home</a></li></ul></div><div id="content"><h1>A title</h1><p>{ARTICLE}</p><p>Short.</p></div><div class="sidebar"><h3>Related</h3><ul><li><a href=1>One story that is long enough</a></li></ul></div><div id="comments"><p>What a great article this is, thanks for it, I liked it.</p></div><div id="footer">(c) Site</div></body></html>', f"A title {ARTICLE} Short."),
    "article": (f'<body><header><h1>Site</h1><nav><a>x</a></nav></header><main><article><header><h1>Real title</h1></header><p>{ARTICLE}</p><div class="advert">Buy now and save lots of money today.</div><p>More.</p><form><label>Email</label><input></form></article></main><section class="comments"><article class=comment><p>A reader comment here of some length.</p></article></section><div role="alert" class="cookie-notice">We use cookies.</div></body>', f"Real title {ARTICLE} More."),
    "broken": ("<p><b>Hello &amp; welcome to a page with <i>bold</i>ness &nbsp; here.<br><p>Another   paragraph\n that ends here.<script>var x = '</p>';</script><foo", "Hello & welcome to a page with boldness here. Another paragraph that ends here."),
    "references": ("<article><p>a&lt;b &#233;&#x65e5; &copy 2024 and so on.</p></article>", "a<b é日 © 2024 and so on."),
    "empty": ("", ""), "null": (None, ""), "markup": ("<div><script>x</script><style>y</style><!-- z --></div>", ""),
}


def test_extraction(spark):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES.values())]
    got = {r.page_id: r for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert got[i].text == want, name
        assert got[i].n_chars == len(want) and got[i].url == f"u{i}"


def test_html_edge_cases(spark):
    """Repeated rows, an empty table, and elements that are part of an article's text."""
    math = "<article><p>Where <math><mi>x</mi></math> and <object>an object</object> meet <svg><text>a label</text></svg> in a sentence that is long enough.</p></article>"
    df = spark.createDataFrame([(1, "u", math, 0), (1, "u", math, 0), (None, None, math, 0)], "page_id long, url string, html string, n_chars int")
    got = hx.extract_pages(df).collect()
    assert [r.text for r in got] == ["Where x and an object meet a label in a sentence that is long enough."] * 3
    assert hx.extract_pages(df.limit(0)).isEmpty()


def test_the_cut_decides():
    """Blocks whose own cost says otherwise follow their region and neighbours, and so does the text."""
    pages = [h for h, _ in PAGES.values() if h]
    changed, texts = 0, 0
    for page in pages:
        found = hx.blocks(page)
        own, ties = hx.graph(found)
        cut, alone = hx.min_cut(own, ties)[: len(found)], [g > 0 for g in own[: len(found)]]
        changed += sum(a != b for a, b in zip(cut, alone, strict=True))
        texts += cut != alone
    assert changed >= 6 and texts >= 2
    # Long blocks outweigh a weak hint, and one short block doesn't.
    body = f"<p>{ARTICLE}</p>" * 6
    assert hx.extract(f'<div class="wrapper right-sidebar">{body}</div>').count("First paragraph") == 6
    assert hx.extract('<div class="wrapper right-sidebar"><p>Hello to all of you.</p></div>') == ""
    assert hx.extract(f'<body class="no-sidebar"><div class="content with-sidebar">{body}</div></body>').count("First") == 6
    assert hx.extract(f'<div id="comments"><div class="content">{body}</div></div>') == ""


def test_fitted_costs():
    pages = [f"<nav><a>Link {i}</a></nav><article><p>{ARTICLE} {i}</p><p>{ARTICLE}</p></article><footer>Site {i}</footer>" for i in range(200)]
    w, b = hx.fit(pages)
    assert w is not hx.WEIGHTS and w[0] > 0 > w[1]
    assert hx.fit(pages[:5])[0] is hx.WEIGHTS
    plain = f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div><a>One</a> <a>Two</a></div>"
    assert hx.extract(plain, (w, b)) == f"{ARTICLE} {ARTICLE}"


def test_deep_nesting():
    """Time grows with the page, whatever its nesting."""
    import time

    def seconds(page):
        began = time.perf_counter()
        hx.extract(page)
        return time.perf_counter() - began

    for page in ("<div>x", "<b>x<h1>y", "<ul><li>x", "<p><td><b>x"):
        assert seconds(page * 40_000) < 60 * max(0.05, seconds(page * 2_000))


def test_long_page():
    page = "<article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert hx.extract(page).count("Paragraph") == 20_000


def corpus(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        w = [r.choice(words) for _ in range(r.randrange(15, 90))]
        toxic, junk = r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(2 + len(w) // 30):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "zorkan", "zorkelp", "zorkush"]))
        if junk:
            w = [x.upper() + "!!" for x in w] if r.random() < 0.5 else [y for x in w for y in (x, "|")]
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(5000, None, ""), (5001, "", ""), (5002, "long " * 20_000, ""), (3, docs[3][1], "again")]
    labels.append((7, None, None))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, labels, column):
    rows = out.where("held_out").join(labels.where(F.col(column).isNotNull()), "doc_id").collect()
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_classifiers(spark):
    docs, labels = corpus(spark)
    out = toxicity.toxicity(docs, labels, crc_mod("doc_id", 4) == 2).cache()
    assert out.count() == 1204 and out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert accuracy(out, labels, "toxic") > 0.98
    out = quality_classifier.quality_classifier(docs, labels, crc_mod("doc_id", 3) == 1).cache()
    assert out.count() == 1204 and out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert accuracy(out, labels, "quality") > 0.97


def test_classifiers_without_labels(spark):
    docs, labels = corpus(spark)
    few = docs.limit(5)
    out = toxicity.toxicity(spark.createDataFrame([(1, "you idiot"), (2, "fine words")], "doc_id long, text string"), labels.limit(0), F.lit(False))
    assert {r.doc_id: r.predicted for r in out.collect()} == {1: 1, 2: 0}
    assert {r.score for r in quality_classifier.quality_classifier(few, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels, F.lit(False)).isEmpty()
    assert quality_classifier.quality_classifier(docs.limit(0), labels, F.lit(False)).isEmpty()
    nulls = spark.createDataFrame([(None, "some text"), (None, None), (4, ""), (4, "")], "doc_id long, text string")
    got = quality_classifier.quality_classifier(nulls, labels, F.lit(False)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
