"""Quality rules, HTML extraction, URL filter and n-gram scores against brute force and on odd input."""

import collections
import html as html_lib
import math
import re
import time

import numpy as np
import pytest

from quarterlight.llm import html_text, ngram, quality, url_filter
from quarterlight.llm.html_text import extract_text, main_text

SPACE = r"[\x20\x09-\x0D]+"


def brute_stats(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


DOCS = "doc_id long, text string, lang string, source string, n_words string, `group` int"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("aeinorst"), int(rng.integers(2, 9)))) for _ in range(n))


def test_word_statistics(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", " \n \t", "one", "a b c d e f g h a b c d e f g h i", "x " * 500, "l\nl\n\nm\n l\nl", "# ** $5 <b> ñ€ é", "a\x0bb\x0cc\u00a0d", prose(rng, 5000) + "\n" + prose(rng, 30) * 3]
    df = spark.createDataFrame([(i, t, "en", "s", "x", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_outliers_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        text = prose(rng, int(rng.integers(25, 400)))
        if i % 20 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 31 == 5:
            text = text + "\n" + " | ".join(prose(rng, 40).split())  # a table is no junk
        rows.append((i, text, None if i % 3 == 0 else "en", "hot" if i % 2 else None, None, None))
    rows += [rows[7]] * 2 + [(None, rows[8][1], "en", "hot", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = quality.quality_rules(df).toPandas()
    assert len(got) == len(rows)
    junk = got.doc_id.mod(20).eq(0)
    assert not got[junk].kept.any() and got[~junk].kept.all()
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == int(got.kept.sum())
    assert quality.quality_rules(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_estimate_withstands_a_third_of_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 60) if i % 4 else " ".join(w + "%%%" for w in prose(rng, 60).split()), "en", "s", None, None) for i in range(400)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.kept == (got.doc_id % 4 > 0)).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="menu-open">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them all please.</div>
<div id="wrap"><article class="post tag-ads"><h1>The  title&amp;more</h1><p>First paragraph of a long enough text to read,
over two lines.<br><p>x</p><aside>Related things</aside><div class="ad">Buy this product now, it is really very good.</div><ul><li>item &eacute;&#x41;</li></ul><form><input><p>Your mail</p></form><footer>by me</footer></article>
<section class="comments"><article class="comment"><p>What a nice text this is, thank you so much for it.</p></article></section></div><footer>&copy; all</footer></body></html>"""


def test_article_of_a_page():
    assert main_text(PAGE) == "The title&more\nFirst paragraph of a long enough text to read, over two lines.\nx\nitem éA"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<nav>a</nav>", ""),
        ("<p>a<p>b", "a\nb"),
        ("<div class=x><p>Some text that is long.</p><p>More &lt;text&gt;</p></div><div class=sidebar>side</div>", "Some text that is long.\nMore <text>"),
        ("<div><p class=notice>Mind the step.<p>The text goes on here for long.<ol class=commentlist><li>hi</ol></div>", "The text goes on here for long."),
        ("<p>unclosed <b>bold <i>text", "unclosed bold text"),
        ("<main><p>one</p><!-- <p>no</p> --><p>two</p></main><p>three</p>", "one\ntwo"),
        ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


BODY = ["The main text of this page is long and goes on for quite some time, as it has much to tell.", "A second long paragraph goes on with it, and it is as long as the first one was before it.", "Short one."]
TEASERS = "".join(f"<article><h3><a href=/{k}>Another story {k}</a></h3></article>" for k in range(4))
CARDS = "".join(f"<div><a href=/{k}>Another story number {k} that is linked here</a><br><b>x</b></div>" for k in range(6))
GOLD = [
    ('<article><div class="article-header"><h1>Title</h1></div>{}</article>', ["Title", *BODY]),
    ('<article><h1 class="page-header">Title</h1>{}<p class="related-work">Work of others.</p><div class="alert">Mind the step.</div></article>', ["Title", *BODY, "Work of others.", "Mind the step."]),
    ("<article>{}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, then <button>press</button> <script>f()</script>it.</p><button>Share</button></article>", [*BODY, "Let x=1, then press it."]),
    ("<head><title>T</title><body><article>{}</article>", BODY),
    ("<div class=list>" + TEASERS + "</div><article><h1>Title</h1>{}</article>", ["Title", *BODY]),
    ("<div class=list>" + TEASERS + "</div><div><h1>Title</h1>{}</div>", ["Title", *BODY]),
    ("<div class=list>" + CARDS + "</div><div class=text><h2>Title</h2>{}<p>Subscribe to our newsletter</p></div><div>" + CARDS + "</div>", ["Title", *BODY]),
    ("<div><p>Menu</p><p>Home</p><p>About</p><p>x</p><p>y</p><p>z</p></div><div><h2>Title</h2>{}</div>", ["Title", *BODY]),
]


@pytest.mark.parametrize(("page", "lines"), GOLD)
def test_pages_with_and_without_articles(page, lines):
    assert main_text(page.format("".join(f"<p>{p}</p>" for p in BODY))) == "\n".join(lines)


def test_the_threshold_chooses_the_region(monkeypatch):
    """With every line taken for content, pages with an article element and without one come out otherwise."""
    fill = lambda page: page.format("".join(f"<p>{p}</p>" for p in BODY))
    monkeypatch.setattr(html_text, "_content_lines", lambda ratios: [True] * len(ratios))
    changed = [main_text(fill(page)) != "\n".join(lines) for page, lines in GOLD]
    assert changed[4:7] == [True] * 3


LONG = "".join(f"<p>{p}</p>" for p in BODY[:2])
DEPARTURES = [
    ("<h1>T</h1><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p>" + LONG, ["T", "One.", "Two.", "Three.", "Four.", *BODY[:2]]),
    (f"<div class=x><h1>T</h1>{LONG}<p>Copyright law changed that year.</p></div><footer>f</footer>", ["T", *BODY[:2], "Copyright law changed that year."]),
    (f"<div><h1>T</h1>{LONG}<ul><li>An item of text</li><li><a href=/>A linked item</a></li><li>More text</li></ul>{LONG}</div>", ["T", *BODY[:2], "An item of text", "A linked item", "More text", *BODY[:2]]),
    (f"<main><article><h1>T</h1>{LONG}</article><section class=more-stories><article><h3>Other</h3><p>It is another story.</p></article></section></main>", ["T", *BODY[:2]]),
    (f"<main><h1>T</h1>{LONG}<section><article><h3>Other</h3><p>It is another story.</p></article></section></main>", ["T", *BODY[:2]]),
    (f"<article><h1>T</h1>{LONG}</article><article><h2><a href=/o>Other</a></h2><p>It is another story.</p></article>", ["T", *BODY[:2]]),
    (f"<article><h1>T</h1>{LONG}</article><article><h1>U</h1>{LONG}</article>", ["T", *BODY[:2], "U", *BODY[:2]]),
    (f"<div>{LONG}<p>A last short line</p><ul><li>a</li><li>b</li></ul></div><div><a href=/>x</a> <a href=/>y</a></div>", [*BODY[:2], "A last short line", "a", "b"]),
]


@pytest.mark.parametrize(("page", "lines"), DEPARTURES)
def test_titles_short_lines_and_teasers(page, lines):
    assert main_text(page) == "\n".join(lines)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><![ x", "a"),
        ("see a[i]<![ and b", "see a[i]"),
        ("x<![foo[ x ]]>y", "xy"),
        ("x<![CDATA[ <p>no> ]]>y", "xy"),
        ("<p>a<!-->b<!--->c<!-- > --!>d", "abcd"),
        ("<p>a<!-- b", "a"),
        ("<p>a</p><p class='b", "a"),
        ("<p title=a'b>c</p><p title='>'>d", "c\nd"),
        ("<p>&#" + "0" * 6000 + "65;&#" + "9" * 6000 + ";", "A\ufffd"),
        ("<p><a href=x/>t</a><br/>u<p/>v", "t u\nv"),
        ("<script>a</p>", ""),
        ("<p>a < b <? pi > c </ > d </>", "a < b c d"),
    ],
)
def test_markup_that_the_parser_would_refuse(page, text):
    assert main_text(page) == text


def test_no_page_raises():
    rng = np.random.default_rng(11)
    bits = ["<", ">", "<!", "<![", "<!--", "-->", "--", "<?", "</", "/>", "<a ", "<p", "<script>", "</script", "<style>", "'", '"', "=", " ", "\x00", "&#", "&#x", "&amp", ";", "99999999", "text", "<article>", "</article>", "<h1>", "<li>", "]]>", "[", "\n", "é", "<body", "<textarea>", "class=ad", "<![CDATA["]
    for _ in range(10_000):
        if rng.random() < 0.5:
            page = "".join(rng.choice(bits, int(rng.integers(1, 40))))
        else:
            page, at = PAGE, sorted(rng.integers(0, len(PAGE), 4))
            page = page[: at[0]] + str(rng.choice(bits)) + page[at[1] : at[2]] + str(rng.choice(bits)) + page[at[3] :]
        assert isinstance(main_text(page), str)


@pytest.mark.parametrize("unit", ["<!--", "<a ", "<![", "</a", "<?", "<!x", "<a b='>' ", '<a b="', "<a b=", "&#1", "<p a=\"'>", "<script></scrip", "<a b\n ="])
def test_unclosed_markup_takes_no_longer_by_the_page(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    assert isinstance(main_text("<p>x</p>" + page), str)
    assert time.process_time() - began < 2


def test_regions_equal_a_plain_search():
    """The elements chosen on random trees, against a search of every element for itself."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        page, depth = "", 0
        for _ in range(int(rng.integers(3, 30))):
            kind = rng.random()
            if kind < 0.25:
                page, depth = page + str(rng.choice(["<div>", "<section>", "<article>", "<main>"])), depth + 1
            elif kind < 0.4 and depth:
                page, depth = page + "</div></section></article></main>", 0
            else:
                page += f"<p>{'word ' * int(rng.integers(1, 40))}</p>"
        blocks = html_text._Blocks()
        blocks.feed(page)
        blocks.close()
        blocks._end_block()
        if not blocks.blocks:
            continue
        content = [bool(x) for x in rng.random(len(blocks.blocks)) < 0.6]
        if not any(content):
            continue
        above = lambda k: {k} | (above(blocks.parent[k]) if k >= 0 else set())  # noqa: B023, E731
        inside = lambda k: sum(len(b[0]) for b, c in zip(blocks.blocks, content, strict=True) if c and k in above(b[3]))  # noqa: B023, E731
        total, numbers = inside(-1), range(len(blocks.own))
        outer = [k for k in numbers if blocks.own[k] and inside(k) and not any(blocks.own[u] for u in above(blocks.parent[k]) if u >= 0)]
        chosen, whole = html_text._region(blocks, content)
        assert whole == (bool(outer) and sum(map(inside, outer)) >= html_text.MOST * total)
        if whole:
            heaviest = max(inside(k) for k in outer)
            assert {k for k in outer if 2 * inside(k) >= heaviest} <= chosen <= set(outer)
        else:
            assert chosen == {max([k for k in numbers if inside(k) >= html_text.WHOLE * total], default=-1)}


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "x" + "</p>" * 40_000 + "</div>" * 40_000, "<p><b>t" * 130_000, "<span class=ad>" * 60_000 + "</i>" * 60_000, "<ul><li>a" * 100_000])
def test_long_malformed_pages_take_no_longer_by_the_tag(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def test_extraction_keeps_other_columns(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in got.collect()) == [("1", len(main_text(PAGE)), len(main_text(PAGE)))] * 2 + [("None", 0, 0)]
    assert extract_text(df.limit(0)).count() == 0
    assert html_lib.unescape("&amp;") == "&"


def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("words", [1, 64])  # with one word nearly all keys pass the filter
def test_urls(spark, words):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://www.example.com", "https://example.com/en", "http://a.net/es/", "http://a.net/ES/", "x://b.net/fr/q", "http://netx/fr/", "http://net/fr/", "http://ÄExample.com/en/", "a://b://c/d", "http://u@h.example.com:80/en/", "http://x.com?a/b", "http://" + "a." * 300 + "com/" + "en/" * 2000]
    rows = [(i, u, "k", 1, "old") for i, u in enumerate(urls)] + [(4, urls[4], "k", 1, "old")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, _k string, _n int, host string")
    listed = spark.createDataFrame([*url_filter.RULES, ("net", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(df, listed, words=words)
    assert got.columns == ["page_id", "url", "_k", "_n", "host", "path", "rule", "verdict"]
    want = sorted((i, *brute_url(u, url_filter.RULES)) for i, u, *_ in rows)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert url_filter.judge_urls(df.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, listed.limit(0)).collect()} == {"allow"}


def test_filter_lets_every_entry_pass(spark):
    listed = spark.range(5000).selectExpr("concat('h', id, '.org') AS host", "'/' AS path", "'block' AS verdict")
    df = listed.selectExpr("concat('http://', host, '/x') AS url").unionByName(spark.range(5000).selectExpr("concat('http://g', id, '.org/x') AS url"))
    got = url_filter.judge_urls(df, listed)
    assert got.where("verdict = 'block'").count() == 5000 and got.where("verdict = 'allow' AND host LIKE 'g%'").count() == 5000


def brute_model(train):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    pairs, count = collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        count.update(w)
        pairs.update(zip([None, *w], w, strict=False))
    d = ngram.discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    before = collections.Counter(w for _, w in pairs)
    e = ngram.discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))
    k, v = sum(before.values()), len(count)
    back = sum(e[min(c, 3) - 1] for c in before.values())
    context, given = collections.Counter(), collections.Counter()
    for (u, _), c in pairs.items():
        context[u] += c
        given[u] += d[min(c, 3) - 1]

    def p(u, w):
        one = (before[w] - (e[min(before[w], 3) - 1] if before[w] else 0) + back / (v + 1)) / k if v else 1.0
        if not context[u]:
            return one
        c = pairs[u, w]
        return (max(c - (d[min(c, 3) - 1] if c else 0), 0) + given[u] * one) / context[u]

    def score(t):
        w = tokens(t)
        n = sum(count.values())
        return len(w), sum(x in count for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(u, x)) for u, x in zip([None, *w], w, strict=False))

    return score, p, count


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(ngram, "GROUP", 16)
    rng = np.random.default_rng(3)
    common = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choice(common, int(rng.integers(0, 80)))) for _ in range(200)] + ["the the the " * 300, None, ""]
    other = ["unseen words only", common[0] + " NEVER " + common[1].upper(), None, "", "x " * 5000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts + other)], "doc_id long, text string, score string")
    model = ngram.train(docs.where(f"doc_id < {len(texts)}"))
    score, p, count = brute_model(texts)
    for r in ngram.score(docs, model).collect():
        n, known, total, base, own = score((texts + other)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9)
    for u in (None, b"the", b"never"):
        assert math.isclose(sum(p(u, w) for w in count) + p(u, b"@"), 1, rel_tol=1e-9)


def test_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = ngram.score(docs, ngram.train(docs.limit(0))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert ngram.score(docs.limit(0), ngram.train(docs)).count() == 0


def test_mixing_of_hashes_is_one_to_one():
    x = np.random.default_rng(0).integers(0, 2**64, 10000, dtype=np.uint64)
    assert (ngram._unmix(ngram._mix(x)) == x).all()
