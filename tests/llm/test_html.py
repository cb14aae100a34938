"""What html.extract keeps of pages with and without article elements."""

import marshal
import random

from ferrule.llm import html


def text(pages, i=0):
    tree = html.wrapper(pages[0])
    for p in pages[1:]:
        tree = html.join(tree, html.wrapper(p))
    return html.main_text(pages[i], html.main_path(tree), html.constants(tree))


def test_all_of_a_main_element_and_of_an_article_in_parts():
    assert text(["<body><main><h1>Title</h1><p>Lead</p><article><p>Text of it</p></article></main></body>"]) == "Title\nLead\nText of it"
    assert text(["<body><article><p>One part</p></article><article><p>Two, the longer part</p></article></body>"]) == "One part\nTwo, the longer part"


def test_the_wrapper_chooses_where_articles_are_teasers():
    pages = [f"<body><div class=story><p>{f'words {i} of a long story ' * 9}</p></div><div class=more><article>Teaser {i}</article></div></body>" for i in range(6)]
    assert text(pages) == ("words 0 of a long story " * 9).strip()


def test_names_that_only_contain_a_word_of_boilerplate():
    for around in ("<body class='single has-sidebar'>%s", "<body class=sidebar>%s", "<body><div class='layout no-header'>%s</div>", "<body><div id='page-with-comments'>%s</div>", "<body><form id=f>%s</form>", "<body><div class=widget>%s</div>"):
        for inner in ("<article><p>The text</p></article>", "<p>The text</p>"):
            assert text([around % f"{inner}<div class=ad>Buy</div>"]) == "The text"


def test_copies_and_optional_parts_are_no_template(spark):
    page = "<html><body><h1>Head</h1><p>Only text</p></body></html>"
    other = [f"<html><body><h1>Head {i}</h1><p>Text {i}</p></body></html>" for i in range(20)]
    quote = "<html><body><h1>Head q%d</h1><blockquote>Quoted by some</blockquote></body></html>"
    rows = [("a", page)] * 6 + [("b", p) for p in [*other, *(quote % i for i in range(6))]]
    table = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.extract(table).collect()}
    assert all(found[i] == "Head\nOnly text" for i in range(6))
    assert all(found[26 + i] == f"Head q{i}\nQuoted by some" for i in range(6))


def test_names_of_a_text_that_are_also_words():
    assert text(["<body><article><p>One</p><div class='share price'>Up by 3</div><div class=share>Share this</div><div class='ad top'>Buy</div></article></body>"]) == "One\nUp by 3"


TEMPLATES = {  # of each host: a page around its title and paragraphs
    "news": "<html><head><title>{t}</title></head><body><header><a href=/>News</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>"
    "<main><article><h1>{t}</h1>{p}<div class='comments'><p>{c}</p></div></article></main><aside><p>{c}</p></aside><footer>Imprint {c}</footer></body></html>",
    "blog": "<body><div id=top class=menu><a href=/>Home</a> <a href=/x>About</a></div><div class=cookie>We use cookies</div><div id=content><div class=post><h1>{t}</h1>{p}</div>"
    "<div id=comments><p>{c}</p><p>{c}</p></div></div><div class=sidebar><ul><li><a href=/1>{c}</a></ul></div></body>",
    "old": "<table><tr><td><a href=/>Start</a><br><a href=/l>List</a><td><h1>{t}</h1>{p}<tr><td colspan=2><form action=/s><input name=q><button>Search now</button></form></table>",
    "shop": "<body><div class=wrap><div class='head'><a href=/>Shop</a></div><section class=body><div class=intro><h2>{t}</h2></div><div class=text>{p}</div></section>"
    "<div class='related'><a href=/r>{c}</a></div><script>var x = '<p>no</p>';</script><noscript>Enable scripts</noscript></div></body>",
    "wiki": "<body><div class=page><div class='banner'>Please give</div><div role=main><h1>{t}</h1>{p}</div><div role=navigation><a href=/z>{c}</a></div></div><style>p{{x:y}}</style></body>",
}


def test_main_texts_of_five_templates_are_known(spark):
    rows, want = [], {}
    for h, (host, template) in enumerate(TEMPLATES.items()):
        for i in range(12):
            lines = [f"Paragraph {j} of page {i} at {host} tells a story of its own, &amp; more  than that." for j in range(2 + i % 4)]
            page = template.format(t=f"Title {i} of {host}", p="".join(f"<p>{x} <b>bold</b><i>er</i></p>" for x in lines), c=f"remark {i} by a reader")
            n = 100 * h + i
            rows.append((n, f"https://{host}.example/{i}", page))
            want[n] = "\n".join([f"Title {i} of {host}", *(x.replace("&amp;", "&").replace("  ", " ") + " bolder" for x in lines)])
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for dealt in (table, table.repartition(7).orderBy("html")):
        assert {r.page_id: r.text for r in html.extract(dealt).collect()} == want


def test_deep_long_and_wide_pages(spark):
    deep = "<body>" + "<div>" * 20_000 + "<p>Inner <b>bold</b> text</p><p>Second" + "</div>" * 20_000 + "<p>Last</p></body>"
    inline = "<body><p>" + "<b>" * 20_000 + "One" + "</b>" * 20_000 + " two</p></body>"
    long = "<body><article>" + "".join(f"<p>Paragraph {i} {'word ' * 20}</p>" for i in range(40_000)) + "</article></body>"
    wide = "<body>" + "".join(f"<div class=c{i}>Text {i}</div>" for i in range(2500)) + "</body>"
    other = wide.replace("class=c", "class=d")
    assert len(long) > 4_500_000
    rows = [(i, "http://a/", p) for i, p in enumerate([deep, inline, long, wide, other])]
    found = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == ["Inner bold text", "Second", "Last"]
    assert found[1] == ["One two"]
    assert found[2] == [f"Paragraph {i} {'word ' * 20}".strip() for i in range(40_000)]
    assert found[3] == found[4] == [f"Text {i}" for i in range(2500)]


def _name(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))  # digits tell no elements apart


def test_all_children_of_a_wide_element_count():
    story = lambda i: "".join(f"<section class={_name(j)}><p>{f'Part {j} of story {i} '.ljust(99, '.')}</p></section>" for j in range(400))
    pages = [f"<body><div class=story>{story(i)}</div><div class=more><p>{f'Other stories {i} '.ljust(24_000, '.')}</p></div></body>" for i in range(3)]
    assert text(pages) == "\n".join(f"Part {j} of story 0 ".ljust(99, ".") for j in range(400))


def test_an_element_counts_after_many_that_each_stand_on_one_page():
    pages = [f"<body><div class={_name(i)}>{str(i).ljust(300, '.')}</div><div class=rest>Rest {i}</div></body>" for i in range(160)]
    pages += [f"<body><div class=story>{str(i).ljust(200, '.')}</div><div class=rest>Rest {i}</div></body>" for i in range(600)]
    assert text(pages, 700) == "540".ljust(200, ".")


def test_a_long_text_of_the_template_is_no_main_text():
    notice = "All that is said here is said by somebody else and nobody is to be held liable for any of it, ever. " * 2
    page = "<body><div class=story><p>Story %s</p><p>and more of story %s</p></div><div class=legal>%s</div></body>"
    pages = [page % (i, i, notice) for i in (str(n) * 300 for n in range(6))] + [f"<body><p>Only this</p><div class=legal>{notice}</div></body>"]
    tree = html.wrapper(pages[0])
    for p in pages[1:]:
        tree = html.join(tree, html.wrapper(p))
    fixed = html.constants(tree)
    assert len(fixed) == 1
    assert len(fixed[0]) < html.LONG
    assert html.main_text(pages[6], None, fixed) == "Only this"


def _listed(a, b):
    """The children of two nodes aligned by the whole table of lengths: labels, and whether both sides have them."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_children_are_aligned_as_by_the_whole_table():
    draw = random.Random(7)
    for _ in range(2000):
        names = "abcdefghijklmnopqrstuvwxyz"[: draw.choice([1, 2, 3, 6, 26])]
        a, b = ("".join(draw.choices(names, k=draw.randrange(40))) for _ in range(2))
        assert html._matches(a, b) == _listed(a, b)
    a, b = (draw.choices([*"######", *map(_name, range(300))], k=700) for _ in range(2))
    assert html._matches(a, b) == _listed(a, b)


def test_parts_of_a_host_with_names_that_only_one_page_has(spark, monkeypatch):
    monkeypatch.setattr(html, "PART", 4)
    monkeypatch.setattr(html, "FAN", 3)
    teaser = lambda i, j: f"<div class=x{_name(10 * i + j)}><h3>Teaser {i}</h3><p>{str(j).ljust(80, '.')}</p></div>"
    page = lambda i: f"<body>{teaser(i, 0)}{teaser(i, 1)}<div class=story><p>{f'Story {i} '.ljust(999, '.')}</p></div>{teaser(i, 2)}</body>"
    rows = [(i, f"http://a/{i}", page(i)) for i in range(100)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Story {i} ".ljust(999, ".") for i in range(100)}
    tree = marshal.loads(html.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).first().wrapper)
    body = html._open(tree)[0]
    assert body[html.PAGES] == 100
    assert sorted(k[html.LABEL] for k in html._open(body)) == sorted(["div#story", *(f"div#x{_name(10 * i + j)}" for i in range(100) for j in range(3))])


def test_wrappers_go_in_pieces_and_come_back_whole(monkeypatch):
    monkeypatch.setattr(html, "PIECE", 7)
    found = [("a", 0, html.wrapper("<body><p>One</p></body>")), ("a", 1, html.wrapper("")), ("b", 0, html.wrapper("<h1>Two</h1>"))]
    batches = list(html._pieces(iter(found)))
    assert max(len(x) for b in batches for x in b.column("wrapper").to_pylist()) == 7
    assert list(html._whole(iter(batches))) == found
    assert list(html._whole(html._pieces(iter([])))) == []
