import random
import tracemalloc

from tessella.llm import html_extract as H


def text(source):
    return H.article(H.Row(*H.Page(source).fields()), 0, None)


def test_blocks_of_the_article():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:"<p>"}</style><script>if (a<b) track("</p>");</script></head>
    <body class="page"><header>Top</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><header><h1>Head &lt;1&gt;</h1></header><p><b>One  two
    three<br><p>caf&eacute; &#x41;&#66; &am<p>more <i>x</i>y <a href='q>"'>link</a>
    <ul><li>a<li>b</ul><aside>side</aside><div id="user-comments"><p>nice</p></div><form><p>mail</p></form><table><tr><td>c1<td>c2</table>
    <div class="adventure">kept</div></article><footer>&copy; foot</footer><p>tail"""
    assert text(page) == "Head <1>\nOne two three\ncafé AB &am\nmore xy link\na\nb\nc1\nc2\nkept"


def test_odd_pages():
    assert text("") == "" and text("<") == "<" and text("plain &amp; simple") == "plain & simple"
    assert text("<article><p>cut of<p>f <a href='") == "cut of\nf"
    assert text("<article></p></div></b>x<script>never ends") == "x"
    assert text("<div class=menu><p>a b c d</p></div><div><p>one</p><p>two</p></div><div><a href=x>many many links here</a></div>") == "one\ntwo"
    assert text("<p>" * 3000 + "deep") == "deep"


def test_template_text_goes_copies_count_once_and_rows_come_back(spark):
    rows = [(i, f"http://a.example/{i}", f"<html><body><article><h1>t{i}</h1><p>Share this page</p><p>body {i}</p></article></body></html>") for i in range(40)]
    same = "<html><body><article><p>only copy</p><p>of this</p></article></body></html>"
    rows += [(100 + i, "https://b.example/", same) for i in range(60)] + [(200, None, None), (201, "x", ""), (202, "//A.example/q", "<article><p>Share this page</p>")]
    rows += [(300 + i, "http://c.example/", f"<body><div class=c><p>long text number {i} here</p></div><div class=d><p>no {i}</p></div>") for i in range(5)] + [(0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, template string").repartition(4)
    got = H.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[7] == "t7\nbody 7" and by[100] == "only copy\nof this" and by[200] == "" and by[201] == ""
    assert by[302] == "long text number 2 here\nno 2" or by[302] == "long text number 2 here"
    assert H.extract(pages.limit(0)).count() == 0


def test_nested_blocks_and_link_paragraphs_of_pages_without_article(spark):
    body = lambda i: f"<div id=c><p>intro {i} text</p><p><a href=x>a paragraph that is all link {i}</a></p><ul><li>item {i}<ul><li>nested {i}</ul></ul><blockquote><div><p>quoted {i}</p></div></blockquote><table><tr><td>cell {i}</table><p>{'long words ' * 9}{i}</p></div>"
    page = lambda i: f"<body><div><ul><li><a href=x>menu</a><li><a href=y>more menu</a></ul>{body(i)}</div></body>"
    want = lambda i: f"intro {i} text\na paragraph that is all link {i}\nitem {i}\nnested {i}\nquoted {i}\ncell {i}\n{'long words ' * 9}{i}"
    assert text(page(3)) == want(3)
    pages = spark.createDataFrame([(i, "http://d.example/", page(i)) for i in range(2)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == {i: want(i) for i in range(2)}


def test_small_hosts_have_templates_and_pages_of_one_text_count_once(spark):
    page = lambda ad, *ps: f"<html><body><div class=ad>{ad}</div><article>{''.join(f'<p>{p}</p>' for p in ps)}</article></body></html>"
    rows = [(i, "http://three.example/", page(i, f"body {i}", "Share this page")) for i in range(3)]
    rows += [(10 + i, "http://one.example/", page(i, "the text", "of one article")) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"body {i}" for i in range(3)} | {10 + i: "the text\nof one article" for i in range(9)}
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == want


def unnamed(i, rng):
    """A page without telling names: a menu, a sidebar, the article and a foot, all of them different."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    title, body = say(5), [say(rng.randrange(15, 40)) for _ in range(rng.randrange(2, 6))]
    menu = "".join(f"<div><a href={k}>{say(2)}</a></div>" for k in range(rng.randrange(3, 7)))
    parts = [f"<h1>{title}</h1>", *(f"<p>{p}</p>" for p in body[:1]), "<p>Share this page</p>", *(f"<p>{p}</p>" for p in body[1:])]
    page = f"<html><body><div class=u1><div>{menu}</div></div><div class=u2><div><span>{say(9)}</span></div></div><div class=u3>{''.join(parts)}</div><div class=u4><p>{say(4)}</p></div></body></html>"
    return page, "\n".join([title, *body])


def test_the_template_finds_the_article_of_pages_without_telling_names(spark):
    rng = random.Random(6)
    made = [unnamed(i, rng) for i in range(12)]
    pages = spark.createDataFrame([(i, f"http://plain.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(made)}
    off = {r["page_id"]: r["text"] for r in H.extract(pages, support=2.0).collect()}
    assert all(off[i] != got[i] for i in got)


def test_templates_equal_classes_by_hand(spark):
    rng = random.Random(7)
    sources = [unnamed(i, rng)[0] for i in range(7)]
    pages = [H.Page(s) for s in sources]
    seen = {}
    for i, p in enumerate(pages):
        for e, role in enumerate(p.roles):
            seen.setdefault(role, [set(), p.roles[p.parent[e]] if e else 0, False])[0].add(i)
        for role, e in zip(H.text_roles(p.roles, p.where, p.texts), p.where):
            seen.setdefault(role, [set(), p.roles[e], True])[0].add(i)
    classes = {}
    for role, (at, up, is_text) in seen.items():
        classes.setdefault(frozenset(at), []).append((role, up, is_text))
    valid = [x for at, c in classes.items() if len(at) >= 0.9 * len(pages) and not all(t for *_, t in c) for x in c]
    tree = {0}
    for _ in range(9):
        tree |= {role for role, up, is_text in valid if up in tree and not is_text}
    fixed = sorted(role for role, up, is_text in valid if up in tree and is_text)
    rows = spark.createDataFrame([(i, "http://h.example/", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    found = H.templates(rows.mapInArrow(lambda it: H.parse(it, True), H.PARSED_TYPE)).collect()
    assert [r["host"] for r in found] == ["h.example"] and found[0]["fixed"] == fixed and len(fixed) == 1
    title = pages[0].parent[pages[0].where[pages[0].texts.index("Share this page")]]
    assert found[0]["best"] == pages[0].roles[title]


def test_versions_of_one_article_keep_their_text(spark):
    body = "".join(f"<p>paragraph {k} of the only article</p>" for k in range(9))
    rows = [(i, "http://v.example/", f"<body><article>{body}<p>version {i}</p></article></body>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r["text"].count("\n") == 9 for r in H.extract(pages).collect())


def test_memory_and_time_are_linear_in_nesting():
    peaks = []
    for n in (10_000, 50_000):
        source = "<b>" + "<div>" * n + "deep" + "</i></div>" * n + "<p>end"
        tracemalloc.start()
        assert text(source) == "deep\nend"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 8 * peaks[0] and peaks[1] < 60e6
