from keidai.llm import html_extract as H


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def text(markup):
    return H.main_text(markup, set(), None, None)


def test_blocks_references_and_malformed_markup():
    body = "<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad box'>Buy</div><article><h1>A &amp; B</h1><p><b>One <br>two<p>T&eacute;xt &lt;x&gt;\n  more<!-- c --> end &am <i>i</i>n</p><ul><li>a<li>b</ul>" \
        "<aside>side</aside><form>f <input></form><div id=comments><p>c</p></div></article><footer>&copy; me</footer>"
    assert text(page(body)) == "A & B\n\nOne two\n\nTéxt <x> more end &am in\n\na\n\nb"


def test_without_an_article():
    assert text(page("<header>Top</header><main><p>x</p></main><div>y</div>")) == "x"
    assert text(page("<div><a href=a>one</a> <a href=b>two</a></div><p>Long words here</p><div role=navigation>n</div>")) == "Long words here"
    assert text("no markup < at all") == "no markup < at all"
    assert text("<p>open <script>never closed <p>x") == "open"
    assert text("") == text(None) == ""
    assert text("<div>" * 5000 + "deep") == "deep"


def test_constant_nodes_are_template(spark):
    shell = "<article><div class=lead>Welcome to our pages</div><h1>T{0}</h1><p>Body {0}</p></article>"
    rows = [(i, "http://a.example/x", page(shell.format(i))) for i in range(8)] + [(i, "http://b.example/x", page(shell.format(0))) for i in range(20, 28)]
    rows += [(40, None, page("<p>z</p>")), (41, "http://a.example/y", None), (42, "odd url", ""), (None, "http://c.example/", page("<p>n</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    assert found[3] == ("T3\n\nBody 3", 10)  # the lead is on every page of the host
    assert found[20][0] == "Welcome to our pages\n\nT0\n\nBody 0"  # copies of one page show no template
    assert found[40][0] == "z" and found[41] == ("", 0) and found[42] == ("", 0) and found[None][0] == "n"
    assert H.extract(pages.limit(0)).count() == 0


def test_simple_tree_matching_keeps_order():
    a, _ = H.blocks_of("<div class=x>1</div><p>2</p><section><h2>3</h2></section>")
    b, _ = H.blocks_of("<p>2</p><div class=y>n</div><section><p>q</p><h2>3</h2></section>")
    H.numbered(a), H.numbered(b)
    n, pairs = H.matched(a, b)
    assert n == 4 and len(pairs) == 4


def test_generated_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert found[r["page_id"]] == "\n\n".join(x for x in parts if x)


def test_constant_siblings_of_varying_ones_are_template(spark):
    shell = "<div>Our menu</div><div>Story {0}</div>{1}<div>Our footer</div>"
    rows = [(i, "http://a.example/x", page(shell.format(i, f"<div>More {i}</div>" if i % 3 == 0 else ""))) for i in range(12)]
    found = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Story {i}" + (f"\n\nMore {i}" if i % 3 == 0 else "") for i in range(12)}


def test_what_only_copies_of_a_page_have_is_no_template(spark):
    copies = [page(f"<article class=post><p>Own words {n}</p><blockquote>Quoted</blockquote></article>") for n in range(8)]  # of some hosts the exemplar
    rows = [(n, f"http://{n}.example/x", copies[n]) for n in range(8) for _ in range(6)]
    rows += [(100 + n, f"http://{n}.example/x", page(f"<article class=news><p>N{n} {i}</p></article>")) for n in range(8) for i in range(6)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 100").collect()
    assert sorted((r["page_id"], r["text"]) for r in found) == [(n, f"Own words {n}\n\nQuoted") for n in range(8) for _ in range(6)]


def test_names_are_evidence_and_not_the_verdict():
    assert text(page("<article><h2 id='related-work'>Work</h2><section id='search-and-replace'><p>x</p></section><p id='notice-period'>n</p><div id=comments>c</div></article>")) == "Work\n\nx\n\nn"
    for start, end in (("<div class='content has-sidebar'>", "</div>"), ("<div id=page class=no-comments>", "</div>"), ("<form>", "</form>")):
        assert text(page(f"{start}<div class=ad>Buy</div><p>A story of the day</p><nav>menu</nav>{end}")) == "A story of the day"


def test_broadcasts_are_bounded_by_bytes(spark):
    from keidai.llm.common import small

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(small(spark.range(10).selectExpr("id", "repeat('x', 30000) AS t")))
    assert "strategy=broadcast" not in plan(small(spark.range(2000).selectExpr("id", "repeat('x', 30000) AS t")))


def test_elements_without_an_end():
    assert text(page("<p>a <svg/> b</p><p>c <svg class=i /> d</p><p>e</p>")) == "a b\n\nc d\n\ne"
    assert text(page("<p>a <svg class=i><path d=x> b</p><p>c</p><div>d</div>")) == "a\n\nc\n\nd"
    assert text(page("<p>a <svg><text>in</text><foreignObject><div>x</div></foreignObject></svg> b</p>")) == "a b"
    for tag in ("iframe", "textarea", "title", "noscript", "template"):
        assert text(page(f"<p>a</p><{tag}/><p>b</p>")).endswith("b")
    for tag in ("iframe", "textarea", "title"):
        assert text(page(f"<p>a</p><{tag}><p>b</p>")) == "a\n\nb"
        assert text(page(f"<p>a</p><{tag}><p>x</p></{tag}><p>b</p>")) == "a\n\nb"


def test_inline_elements_that_go_dont_split_their_block():
    assert text(page("<p>Hello <button class=share>x</button> world</p>")) == "Hello world"
    assert text(page("<article><p>Hello <select><option>x<option>y</select><canvas>z</canvas>world</p></article>")) == "Hello world"


def test_the_part_with_most_text_is_taken():
    assert text(page("<main><p>intro</p><article>teaser</article><p>rest</p></main>")) == "intro\n\nteaser\n\nrest"
    story = "A long story of many words. " * 20
    assert text(page(f"<div><p>{story}</p></div><article>One</article><article>Two</article>")) == f"{story.strip()}\n\nOne\n\nTwo"
    assert text(page(f"<article><h1>Day</h1><p>{story}</p></article><p>outside</p>")) == f"Day\n\n{story.strip()}"
    # How long a text is decides nothing: a teaser or a comment section of any length.
    for n in (1, 5, 6, 50):
        assert text(page(f"<p>{story}</p><article>{'teaser ' * n}</article><p>more story</p>")) == f"{story.strip()}\n\n{('teaser ' * n).strip()}\n\nmore story"
        assert text(page(f"<p>A short story</p><div id=comments><p>{'I think so. ' * n}</p></div>")) == "A short story"
        assert text(page(f"<main><h1>T</h1><p>x</p></main><div>{'beside ' * n}</div>")) == "T\n\nx"
    assert text(page("<div class=sidebar><h1>T</h1><p>x</p></div><p>y</p>")) == "T\n\nx\n\ny"
    assert text(page("<article><h1>A</h1><p>one</p></article><article><h1>B</h1><p>two</p></article><article>teaser</article>")) == "A\n\none\n\nB\n\ntwo"


def test_names_by_their_last_word_of_content():
    for name in ("search-results", "related-work", "has-sidebar", "no-comments", "share-price"):
        assert text(page(f"<p>other text</p><div class='{name}'><p>kept</p></div>")) == "other text\n\nkept"
    for name in ("comment-list", "ad-slot-3", "site-footer", "nav-main", "advert-300x250", "share-buttons", "sidebar", "box ad"):
        assert text(page(f"<p>other text</p><div class='{name}'><p>gone</p></div>")) == "other text"


def test_links_within_text_stay_and_lists_of_links_go():
    assert text(page("<p>See <a>the long full report of the committee</a> now</p><p><a>One link</a></p>")) == "See the long full report of the committee now\n\nOne link"
    assert text(page("<ul><li><a>Home</a><li><a>About</a></ul><p>Text</p>")) == "Text"
    assert text(page("<p>Text</p><h2>Sources</h2><ul><li><a>Smith 2001</a><li><a>Jones 2002</a></ul>")) == "Text\n\nSources\n\nSmith 2001\n\nJones 2002"
    assert text(page("<p>Text</p><p><a>Smith 2001</a> <a>Jones 2002</a></p>")) == "Text\n\nSmith 2001 Jones 2002"


def test_tags_without_an_end_are_read_in_linear_time():
    import time

    for broken in ("<a ", '<a "', "<a '\"", "<!x ", "<a x=\"'", "</p "):
        began = time.time()
        found = text("<p>x</p>" + broken * 400_000)
        assert time.time() - began < 20 and found.startswith("x")
    assert text("<p>a <b title='x>y'>c</b> <i \"> d</p>") == "a c <i \"> d"
    assert text(page("<article><p>Text</p><ul><li><a>Source 1</a><li><a>Source 2</a></ul></article>")) == "Text\n\nSource 1\n\nSource 2"
    assert text(page("<ul><li><a>Home</a><li><a>About</a></ul>")) == "Home\n\nAbout"


def test_markup_of_any_depth_and_length(spark):
    deep = "<article>" + "<div>" * 205 + "<aside>SIDE</aside><nav>NAV</nav><p>A</p>" + "</div>" * 205 + "<p>B</p></article><div>z</div>"
    assert text(page(deep)) == "A\n\nB"
    rows = [(i, "http://a.example/", page(f"<div>Menu</div>{'<div>' * 3000}<p>Story {i}</p>{'</div>' * 3000}<table>{''.join(f'<tr><td>{i} {j}' for j in range(3000 + i))}</table>")) for i in range(6)]
    found = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "\n\n".join([f"Story {i}", *[f"{i} {j}" for j in range(3000 + i)]]) for i in range(6)}


def plain_weight(a, b):
    """Pairs, then equal texts, of the best mapping: simple tree matching as it is written down, without memory."""
    if a.key != b.key:
        return 0, 0
    best = [[(0, 0)] * (len(b.children) + 1)]
    for x in a.children:
        row = [(0, 0)]
        for j, y in enumerate(b.children):
            w = plain_weight(x, y)
            row.append(max(row[j], best[-1][j + 1], (best[-1][j][0] + w[0], best[-1][j][1] + w[1])))
        best.append(row)
    return best[-1][-1][0] + 1, best[-1][-1][1] + (a.mark != "" and a.mark == b.mark)


def test_matching_equals_plain_tree_matching():
    import random

    rng = random.Random(8)

    def markup(depth):
        return "".join(f"<{t}>{rng.choice(['', 'x', 'y', 'z'])}{markup(depth - 1) if rng.random() < 0.6 else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 4))) if depth else ""

    for _ in range(300):
        a, b = H.blocks_of(markup(3))[0], H.blocks_of(markup(3))[0]
        n, pairs = H.matched(a, b)
        xs, ys = H.numbered(a), H.numbered(b)
        assert (n, sum(xs[i].mark != "" and xs[i].mark == ys[j].mark for i, j in pairs)) == plain_weight(a, b)
        to = dict(pairs)
        assert len(to) == len(set(to.values())) == n
        for i, j in pairs:
            assert xs[i].key == ys[j].key and (not i or to[xs[i].parent.number] == ys[j].parent.number)


def test_long_lists_are_matched_in_order(monkeypatch):
    a, b = (H.blocks_of("".join(f"<{t}>{k}{i}</{t}>" for i, t in enumerate(tags)))[0] for k, tags in (("x", ["p", "ul", "p", "div"] * 30), ("y", ["div", "p", "ul"] * 40)))
    best = H.matched(a, b)[0]
    monkeypatch.setattr(H, "PAIRS", 10)
    n, pairs = H.matched(a, b)
    assert 60 < n <= best and sorted(pairs) == sorted(pairs, key=lambda p: p[1])


def test_the_wrapper_decides_where_no_name_does(spark):
    """On pages of plain elements the text changes if the method is switched off; votes equal those of a plain count over plain alignments."""
    shell = "<div>Top bar</div><div><p>Story {0} words</p><p>All rights belong to somebody</p></div><div>Bottom</div>"
    rows = [(i, "http://a.example/x", page(shell.format(i))) for i in range(9)]
    found = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Story {i} words" for i in range(9)}
    assert text(rows[0][2]) == "Top bar\n\nStory 0 words\n\nAll rights belong to somebody\n\nBottom"


def test_ties_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a.example/x", page(f"<p>Body {i % 6}</p><p>Same</p>")) for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "hx_html": F.lit(2), "host": F.lit(3), "exemplar": F.lit(4)})
    found = H.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["text"] for r in found.collect()) == sorted(f"Body {i % 6}" for i in range(24))


def test_long_lists_are_matched_as_short_ones_are(monkeypatch):
    """The best mapping at any length: one that moves a list's first sibling to its end costs that sibling alone."""
    import random

    def tree(tags):
        return H.blocks_of("".join(f"<{t}>{x}</{t}>" for t, x in tags))[0]

    rows = [("p", f"x{i % 7}") for i in range(1100)]
    a, b = tree([("ul", "first"), *rows]), tree([*[(t, x + "y") for t, x in rows], ("ul", "last")])
    assert H.matched(a, b)[0] == 1101  # the root and all paragraphs
    rng = random.Random(5)
    for n in (3, 20, 90):
        for _ in range(12):
            lists = [[(rng.choice(("p", "ul", "div")), f"{rng.choice('abc')}{'<h2>t</h2>' if rng.random() < 0.3 else ''}") for _ in range(n)] for _ in range(2)]
            found = []
            for pairs, wide in ((1 << 20, 64), (1 << 20, 1), (1 << 20, 1000), (10, 1000), (10, 1), (200, 64)):
                monkeypatch.setattr(H, "PAIRS", pairs)
                monkeypatch.setattr(H, "WIDE", wide)
                k, to = H.matched(*map(tree, lists))
                found.append((k, sorted(to)))
            assert all(f == found[0] for f in found)
