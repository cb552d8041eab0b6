"""HTML wrappers, media columns and URL rules."""

import hashlib
import io
import zlib

import numpy as np
import pandas as pd
import pytest

from barweave.llm import media, queries, url_rules, wrapper


def page(article, extra="", nav="<a href=/x>One</a>"):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var "
        f"a='</p>';</script></head><body><nav>{nav}</nav><!-- x --><div class='ad box'>Buy</div>{article}{extra}<footer>&copy; "
        f"x</footer></body></html>")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n&amp; more", "plain text & more"), ("<p>a<p>b<br>c", "a b c"),
            ("<p>on<b>e</b> wo<i>rd", "one word"),
        (page("<article><h1>H</h1><p>a &lt;b&gt;\n c</p><aside>no</aside><p>d</article>"), "H a <b> c d"),
        (page("<article><p>a</p><section id='comments'><p>no</p></section><form><input value=x>no</form></article>"), "a"),
        (page("<div><p>a</p></div>", "<div role=navigation>no</div><div hidden>no</div><div class='cookie-notice'>no</div>"), "a"),
        ("<article><p>cut off &am", "cut off &am"), ("<article><p>a</p", "a"), ("<ul><li>a<li>b</ul>", "a b"),
            ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<p>a < b & c</p>", "a < b & c"), ("<textarea>no</textarea><noscript>no</noscript>yes", "yes"),
            ("<p title='a>b'>x</p>", "x"), ('<p title="broken>x</p> y', "x y"),
                ('Read <a title="he said>link</a> more.', "Read link more."),
        ("<article></article><p>outside</p>", "outside"), ("<main><p>m</p></main><p>o</p>", "m"),
    ],
)
def test_extract(html, text):
    assert wrapper.extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        *((f"<div {x}>a</div><p>b", "a b")
            for x in ("style='overflow:hidden'", 'title="hidden gems"', 'href="/hidden/x"', "href=/hidden/x", 'data-id="form"',
                'href="/page?id=search"', "data-hidden=1", "class=no-sidebar", "class='content has-sidebar'", "class='post share'",
                "aria-hidden=false")),
        *((f"<div {x}>a</div><p>b", "b")
            for x in ("hidden", "title='a' HIDDEN=''", "class='box share'", "class=post-share", 'id = "search"', "role=form",
                "aria-hidden=true")),
        ("<div class=sidebar><p>x</p><article>a</article></div><p>b", "a"),
            ("<div class='page-sidebar'><div id=form><main>a</main></div></div>b", "a"),
        ("<main><h1>t</h1><div class=widget><article>a</article></div><div class=ad>b</div></main>", "t a"),
            ("<article>a</article><div class=related><article>b</article></div>", "a"),
        ("<div class=comments><p>a</p></div>", "a"), ("<div hidden><article>a</article></div>b", "b"),
            ("<div hidden class=ad>a</div>", ""),
    ],
)
def test_attributes_are_parsed_and_names_drop_no_article(html, text):
    assert wrapper.extract(html) == text


def test_deep_and_odd_markup():
    assert wrapper.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert wrapper.extract("<" * 5000) == "<" * 5000
    assert wrapper.extract("<b><i>" * 2000 + "x").endswith("x")


def test_end_tags_below_the_depth_match():
    deep, end = "<div>" * 300, "</div>" * 300
    assert wrapper.extract("<div class=ad>" * 5000 + "x") == "x" and wrapper.extract("<nav>" * 5000 + "x") == ""
    assert wrapper.extract(f"<div><article>{deep}{end}<p>rest</p></article></div>") == "rest"
    assert wrapper.extract(f"<div><article>{deep}<nav><p>no</p></nav><div>a</div>b<i>c</i><div "
        f"class=ad>no</div>{end}<p>rest</p></article></div>no") == "a bc rest"


def test_simple_tree_matching():
    a = wrapper.parse("<div><p>1</p><ul><li>a<li>b</ul><p>2</p></div>")
    b = wrapper.parse("<div><p>1</p><p>2</p></div>")
    size, pairs = wrapper.tree_match(a, b)
    assert size == 4 and [(x.sign, y.sign) for x, y in pairs].count(("p", "p")) == 2
    assert wrapper.tree_match(a, a)[0] == 7


def host_pages(n):
    return [page(f"<article><h1>Title {i}</h1><p>Written by the same desk</p><p>{'word' + str(i)} {'text ' * 40}{i}</p></article>",
        f"<div><p>Terms of this site</p><p>item {i}</p></div>") for i in range(n)]


def test_constant_slots_become_template(spark):
    pages = host_pages(6)
    template = frozenset(wrapper.induce(pages)[0])
    assert template
    got = wrapper.extract(pages[2], template)
    assert "same desk" not in got and got.startswith("Title 2 word2") and "text text" in got
    assert wrapper.induce(pages[:2]) == ([], []) and wrapper.induce(pages[:1] * 5) == ([], [])
    copies = [page(f"<article><p>{'long shared text ' * 30}</p><p>{i}</p></article>") for i in range(5)]
    assert "long shared" in wrapper.extract(copies[0], frozenset(wrapper.induce(copies)[0]))


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_wrapper_counts_all_pages(spark, monkeypatch, bound):
    """Hosts of two layouts, hosts of copies under many urls, and hosts of three pages each have their template."""
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", bound)
    first = host_pages(12)
    second = [page(f"<main><section class=list><h2>Name {i}</h2><p>{'entry' + str(i)} {'more ' * 40}{i}</p></section><section "
        f"class=foot><p>Call us any day</p></section></main>") for i in range(6)]
    rows = [(f"http://two.example/{i}", p) for i, p in enumerate(first + second)]
    rows += [(f"http://copies.example/{i}", p) for i, p in enumerate(host_pages(3) + host_pages(1) * 60)]
    rows += [(f"http://h{h}.example/{i}", p) for h in range(20) for i, p in enumerate(host_pages(3))]
    df = spark.createDataFrame(rows, "url string, html string").select("url", "html", url_rules.host_of(queries.F.col("url"))
        .alias("host"))
    got = {r.host: (r.template, r.content) for r in wrapper.induce_wrappers(df).collect()}
    assert len(got) == 22
    for host, (template, content) in got.items():
        assert (template, content) == wrapper.induce([p for u, p in rows if u.startswith(f"http://{host}/")]) and content, host
        assert "same desk" not in wrapper.extract(first[1], frozenset(template), frozenset(content)), host
    both = tuple(map(frozenset, got["two.example"]))
    assert "Call us" not in wrapper.extract(second[1], *both) and "entry1 more" in wrapper.extract(second[1], *both)


def plain_page(i):
    """A page without an article or a name that says what an element is: a title, a text, teasers, terms."""
    teasers = "".join(f"<li><a href=/{i}{k}>Teaser {i} {k} of some length to read</a></li>" for k in range(8))
    text = "".join(f"<p>{'word%d' % (i * 7 + k)} {'text ' * 30}{k}</p>" for k in range(2 + i % 3))
    return (f"<body><div class=x1><b>Shop</b></div><div class=x2><h1>Title {i}</h1><div class=x3>{text}</div></div><div "
        f"class=x4><ul>{teasers}</ul><span>Seen {i * 13} times</span></div><div class=x5>All rights of this site</div></body>")


def test_content_slot_is_learnt_without_articles(spark):
    """The wrapper decides where the text is: no tag or class of these pages says it."""
    pages = [plain_page(i) for i in range(8)]
    alone = wrapper.extract(pages[3])
    assert "Teaser" in alone and "All rights" in alone and "Shop" in alone
    template, content = map(frozenset, wrapper.induce(pages))
    assert len(content) == 1
    for i, p in enumerate(pages):
        got = wrapper.extract(p, template, content)
        assert got.startswith(f"Title {i} word{i * 7} text") and not any(x in got for x in ("Teaser", "All rights", "Shop", "Seen"))
        assert got.count("word") == 2 + i % 3
    df = spark.createDataFrame([(i, f"http://plain.example/{i}", p) for i, p in enumerate(pages)],
        "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.extract_pages(df)
        .collect()} == {i: wrapper.extract(p, template, content) for i, p in enumerate(pages)}
    odd = "<body><section><p>another layout</p></section></body>"
    assert wrapper.extract(odd, template, content) == "another layout"


def brute_match(a, b):
    """The largest match of two trees over all order-preserving choices of children."""
    if a.sign != b.sign:
        return 0
    left, right = wrapper._children(a), wrapper._children(b)

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        w = brute_match(left[i], right[j])
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + w)

    return 1 + best(0, 0)


def test_tree_matching_is_the_best_one():
    import random

    rng = random.Random(8)

    def tree(depth):
        node = wrapper.Node("x", rng.choice("ab") if depth else "r", False)
        node.items = [tree(depth + 1) for _ in range(rng.randrange(4))] if depth < 3 else []
        return node

    for _ in range(150):
        a, b = tree(0), tree(0)
        size, pairs = wrapper.tree_match(a, b)
        assert size == brute_match(a, b) == len(pairs) and all(x.sign == y.sign for x, y in pairs)


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_extract_pages(spark, sf, monkeypatch, bound):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", bound)
    rows = [(i, f"http://one.example/{i}", p, "x") for i, p in enumerate(host_pages(6))]
    rows += [(10, None, host_pages(1)[0], "x"), (11, "http://one.example/e", None, "x"), (12, "http://two.example", "", "x"),
        (None, "no scheme", "<p>a", "x"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrapper.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert "same desk" not in texts[3] and "same desk" in texts[10] and texts[11] == texts[12] == "" and texts[None] == "a"
    assert wrapper.extract_pages(df.filter("false")).count() == 0


def test_html_query(spark, sf):
    import html
    import re

    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")
    for r in queries.op2_html(spark, sf).collect():
        whole = pages.html[r.page_id]
        inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", whole)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", inner)).split())


def test_images_decode():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P5 # a comment\n 2 1\n15\n\x00\x0f") == [[0, 255]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P5\n1 1\n65535\n\x01\x02") == [[258]]).all()
    for broken in (None, b"", b"P5", b"P5\n9 9\n255\nxx", b"P5\nx", b"BM", b"BM" + b"\0" * 60, b"GIF89a"):
        assert media.decode(broken) is None


def test_area_resize():
    rng = np.random.default_rng(2)
    for h, w, th, tw in ((6, 9, 3, 3), (5, 7, 3, 2), (2, 3, 5, 4), (1, 1, 8, 9)):
        image = rng.integers(0, 256, (h, w)).astype(np.float64)
        fine = np.kron(image, np.ones((th, tw)))  # every source pixel th x tw, every target cell h x w
        want = fine.reshape(th, h, tw, w).mean((1, 3))
        assert np.allclose(media.area_resize(image, th, tw), want)


def test_tiles(spark):
    image = np.arange(70 * 130, dtype=np.uint8).reshape(70, 130)
    rows = [(1, media.encode_pgm(image)), (2, None), (3, b"junk"), (None, media.encode_bmp(image))]
    got = media.image_tiles(spark.createDataFrame(rows, "image_id long, data binary")).collect()
    assert len(got) == 12
    for r in got:
        tile = np.load(io.BytesIO(r.npy))
        assert (tile == image[r.tile_row * 64 :][:64, r.tile_col * 64 :][:, :64]).all() and r.dhash == media.dhash(tile)
    assert media.image_tiles(spark.createDataFrame(rows, "image_id long, data binary"), (64, 64)).count() == 2


def test_media_features(spark, sf):
    docs = [(1, "aé"), (2, ""), (3, None), (None, "x" * 64), (4, "y" * 100_000), (1, "aé")]
    df = spark.createDataFrame([(*d, "f", 3) for d in docs], "doc_id long, text string, feature string, n_bytes int")
    got = media.media_features(df).collect()
    assert len(got) == len(docs)
    for r in got:
        text = next(t for i, t in docs if i == r.doc_id)
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored)
            .hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        cells = lambda h, w: np.kron(image.astype(float), np.ones((h, w))).reshape(h, len(image), w,
            64).mean((1, 3))  # noqa: B023, E731
        thumb = np.round(cells(8, 9), 6) if len(payload) < 10_000 else None
        if thumb is not None:
            bits = np.packbits(thumb[:, :-1] < thumb[:, 1:]).tobytes().hex()
            assert r.feature == f"dhash={bits};mean4x4={np.round(cells(4, 4)).astype(np.uint8).tobytes().hex()}"
        tiles = [image[y : y + 64, x : x + 64] for y in range(0, len(image), 64) for x in range(0, 64, 64)]
        packed = hashlib.sha256()
        for tile in tiles:
            out = io.BytesIO()
            np.save(out, np.ascontiguousarray(tile))
            packed.update(out.getvalue())
        assert (r.n_tiles, r.tiles_sha256) == (len(tiles), packed.hexdigest())
    assert media.media_features(df.filter("false")).count() == 0


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h + p, said) for said, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://COM/x", "https://a.Example.com/en/x?y#z", "http://www.example.com/en/",
        "http://m.www.example.com/en/1", "http://example.com", "http://x.net/es/?q=1",
    "http://x.net#/es/", "http://net/fr/a", "a://b://c.com/d", "http://xexample.com/en/", "http://www.example.com/en?x",
    "ftp://é.org/É",
]


def test_urls(spark, sf):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[5], "x", "y")],
        "page_id long, url string, verdict string, tokens string")
    every = df.unionByName(spark.read.parquet(f"{sf}/pages.parquet")
        .selectExpr("page_id + 100 as page_id", "url"), allowMissingColumns=True)
    urls = {r.page_id: r.url for r in every.collect()}
    got = url_rules.judge(every).collect()
    assert len(got) == every.count()
    for r in got:
        host, path, rule, said = plain_verdict(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == said if rule else r.verdict == ("block" if r.mined else "allow")
    assert url_rules.judge(df.filter("false")).count() == 0
    assert {r.verdict for r in url_rules.judge(df.filter("url is null")).collect()} == {"allow"}


@pytest.mark.parametrize("grown", [12, 0])
def test_mined_rules_match_counts(spark, monkeypatch, grown):
    monkeypatch.setattr(url_rules, "MAX_GROWN", grown)
    import itertools
    import random

    rng = random.Random(5)
    rows = [(sorted(rng.sample("abcdef", rng.randrange(1, 5))), rng.random()) for _ in range(300)]
    rows = [(t, "block" if ("a" in t and "b" in t) or ("c" in t and x < 0.3) else "allow") for t, x in rows]
    rows += [(t + ["s"], "block") for t, v in rows[:20] if v == "block"]  # a token that always blocks
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8)
    want = {}
    for n in range(1, url_rules.MAX_TOKENS + 1):
        for tokens in itertools.combinations("abcdefs", n):
            hits = sum(set(tokens) <= set(t) and v == "block" for t, v in rows)
            of = sum(set(tokens) <= set(t) for t, _ in rows)
            if hits >= 0.02 * len(rows) and of and hits / of >= 0.8:
                inner = [x for k in range(1, n) for x in itertools.combinations(tokens, k)]
                if not any(want.get(x, 0) >= hits / of for x in inner):
                    want[tokens] = hits / of
    assert {t: c for t, c, _ in got} == pytest.approx(want)
    index = url_rules.RuleIndex(got)
    for t, _ in rows:
        best = max((c for x, c in want.items() if set(x) <= set(t)), default=None)
        assert (index.best(t) or (None,))[0] == best


def test_urls_of_many_tokens(spark):
    """Twenty tokens a row have a million sets; those of up to four are counted."""
    rows = [([f"t{i:02d}" for i in range(20)], "block")] * 30 + [([f"t{i:02d}" for i in range(20) if i != k], "allow")
        for k in range(4)]
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    want = {(f"t{i:02d}",): 30 / (33 if i < 4 else 34) for i in range(20)}
    want |= {(f"t{i:02d}", f"t{j:02d}"): 30 / 32 for i in range(4) for j in range(i + 1, 4)}
    want |= {tuple(f"t{i:02d}" for i in range(4) if i != k): 30 / 31 for k in range(4)}
    want[tuple(f"t{i:02d}" for i in range(4))] = 1.0
    assert {t: c for t, c, _ in got} == pytest.approx(want)
    assert url_rules.mine(spark.createDataFrame(rows[30:], "tokens array<string>, verdict string")) == []
