import html as H
import random
import re

from tyscope.llm import html_main as M


def expected_of(page):
    """The article of the generated pages, by plain string work."""
    body = page[page.index("<article>") + 9:page.index("</article>")]
    parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_generated_pages(spark):
    from tyscope.session import read_table
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: expected_of(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in M.main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_markup():
    x = M.extract
    assert x("") == "" and x("plain  text\n here") == "plain text here"
    assert x("a &lt;b&gt; &amp &am &#233;&nbsp;x") == "a <b> & &am é x"
    assert x("<p>one<p>two<b>three<br>four<div>five</div>six") == "one\ntwothree four\nfive\nsix"
    assert x("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == "a\nb\nc\nd\ne\nf"
    assert x("<article>in<script>if (a</p>) x</script> side<style>p{}</style></article> out") == "in side"
    assert x("x < y and <3 <!-- no <p> --> z <!doctype a>") == "x < y and <3 z"
    assert x("<p title='a > b'>q</p><p cut") == "q"
    assert x("<script>never closed <p>a") == ""
    assert x("<p>a</b></i></div>b</p>") == "ab"
    assert x("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_what_names_itself():
    page = ("<body><header>top</header><nav>menu</nav><div class='side-bar cookie-notice'>c</div><main><article><header>"
            "<h1>Title</h1></header><p>Text <span class=ad>buy</span>more</p><aside>s</aside><form>f</form>"
            "<section id=comments><article>first!</article></section><div style='display: none'>h</div><p>End</p></article>"
            "<p>below</p></main><footer>foot</footer></body>")
    assert M.extract(page) == "Title\nText more\nEnd"
    assert M.extract("<div>a</div><main><p>b</p></main>") == "b"
    assert M.extract("<div class=page-header>a</div><article><div class=post-header><h1>T</h1></div><p>b</p></article>") == "T\nb"
    assert M.extract("<div class=page-header>a</div><p>b</p>") == "b"


def test_names_around_and_inside_articles():
    x = M.extract
    page = "<article><h1>T</h1><p>text</p></article>"
    for wrap in ("<div class='content-sidebar-wrap'>", "<div class='layout no-sidebar'>", "<div id=page class=has-comments>",
                 "<div class=sidebar>", "<div class='search'><div id=header>", "<form id=form1>", "<span class=widget>",
                 "<aside hidden>", "<div style='display: none'>"):
        assert x(f"<body><nav>menu</nav>{wrap}{page}") == "T\ntext", wrap
    assert x("<article>short</article><div class=menu><main><p>main text &amp;lt;</p><nav>n</nav></main></div>") != ""
    assert x("<div class=menu><main><p>main text &amp;lt;</p><nav>n</nav></main></div>") == "main text &lt;"
    for part in ("<h2 id='related-work'>in</h2>", "<h2 id=related>in</h2>", "<section id=search>in</section>", "<p id='notice-period'>in</p>",
                 "<p id=share>in</p>", "<div class=alert role=alert>in</div>", "<p><a title='the hidden gem'>in</a></p>",
                 "<section data-title='our hidden work'>in</section>", "<pre><span class='token comment'>in</span></pre>",
                 "<p data-x=a'b title=hidden>in</p>"):
        assert x(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nin\nb", part
    for part in ("<div hidden>", "<div a=1 HIDDEN class=x>", "<div hidden=''>", "<div class='x ads'>", "<div class='share'>"):
        assert x(f"<article><p>a</p>{part}out</div><p>b</p></article>") == "a\nb", part
    assert x("<article><p>a <span class=ad>x</span>b</p></article>") == "a b"
    comments = "<div id=comments><article>first</article><article>2nd</article></div>"
    assert x(f"<main><article><p>the longer text</p></article>{comments}</main>") == "the longer text"
    assert x("<div class=ad>" * 20000 + "<article>deep") == "deep"


def test_a_card_or_an_empty_article_is_not_the_page():
    x = M.extract
    text = "<p>the long text of the page</p><p>and more of it</p>"
    want = "the long text of the page\nand more of it"
    assert x(f"<main>{text}</main><article>card</article>") == want
    assert x(f"<main>{text}<article>quote</article></main>") == want + "\nquote"
    assert x(f"<div>{text}</div><article>card</article>") == want
    assert x(f"<div>{text}</div><div class=cards><article>one</article><article>two</article></div>") == want
    assert x("<div><p>the long text of the page</p><article>quote</article><p>and more of it</p></div>") == (
        "the long text of the page\nquote\nand more of it")
    assert x(f"<main><article>{text}</article></main><article>a card that is outside</article>") == (
        "the long text of the page\nand more of it")
    assert x(f"<div>{text}</div><article><script>x</script></article>") == want
    assert x(f"<div>{text}</div><main></main><article></article>") == want
    assert x(f"<main><article></article></main><div>{text}</div>") == want
    assert x(f"<div>side</div><main><p>above</p><article>{text}</article></main>") == want
    assert x(f"<div>side</div><main>ad</main><article>{text}</article>") == want
    assert x(f"<div>side</div><main>{text}</main>") == want
    assert x(f"<div>side</div><main>{text}</main><article>a card half as long as that text</article>") == want


def test_formulas_objects_and_unclosed_elements():
    x = M.extract
    assert x("<article><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=tex>x=2</annotation>"
             "</semantics></math> holds</p></article>") == "so x=2 holds"
    assert x("<p>see <object data=a.swf><param name=a><b>the text</b> of it</object> here") == "see the text of it here"
    for name in ("noscript", "iframe", "template", "xmp", "noembed", "noframes", "select", "svg", "annotation", "math", "object"):
        assert x(f"<p>a</p><{name}><p>b</p><div>c</div>") == "a\nb\nc", name
    for name in ("script", "style", "textarea", "title"):
        assert x(f"<p>a</p><{name}><p>b</p><div>c</div>") == "a", name
    assert x("<p>a<svg><text>t</text></svg>b<select><option>o</select>c<noscript>n</noscript>d") == "abcd"
    assert x("<select>" * 50000 + "x") == "x"


def test_site_templates(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        own = " ".join(rnd.choice(["red", "green", "blue"]) + str(rnd.randrange(99)) for _ in range(12))
        box = "<div class=box><p>Read our offers</p><p>every day</p></div>"
        rows.append((i, "http://a.org/x%d" % i, f"<body><div class=top>Site name</div><div id=c><h1>T{i}</h1><p>{own}</p>"
                                               f"<p>Shared paragraph</p></div>{box}</body>"))
    copy = "<body><div class=w><p>copied article</p></div></body>"
    rows += [(100 + i, "http://b.org/%d" % i, copy) for i in range(30)]
    rows += [(200, None, None), (201, "http://a.org/", ""), (202, "no url", "<div class=top>Site name</div>"), (None, None, "<p>x")]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", M.F.lit(1)).repartition(5)
    got = {r.page_id: r for r in M.main_text(pages).collect()}
    assert M.main_text(pages).count() == len(rows)
    assert "Site name" not in got[5].text and "offers" not in got[5].text
    assert got[5].text.startswith("T5\n") and got[5].text.endswith("Shared paragraph")
    assert {got[100 + i].text for i in range(30)} == {"copied article"}
    assert (got[200].text, got[201].text, got[202].text, got[None].text) == ("", "", "Site name", "x")
    assert M.main_text(pages.limit(0)).count() == 0


def test_articles_may_share_lists_and_boxes(spark):
    rows = []
    for i in range(100):
        shared = "<ul><li>200 g flour</li><li>2 eggs</li></ul><div><p>Mix well.</p></div>" if i % 5 == 0 else ""
        mine = f"<h1>Recipe {i}</h1><div class=tools>Print this page</div>{shared}<p>Step for {i}</p>"
        root = "article" if i % 2 else "main"
        rows.append((i, f"http://a.org/{i}", f"<body><ul><li>{'x y z'[i % 2 * 2]}</li></ul><{root}>{mine}</{root}></body>"))
    got = {r.page_id: r.text for r in M.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(100):
        shared = "\n200 g flour\n2 eggs\nMix well." if i % 5 == 0 else ""
        assert got[i] == f"Recipe {i}{shared}\nStep for {i}"


def test_outside_of_articles_the_low_share_holds(spark):
    box = "<div><p>Read our offers</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body><h1>T{i}</h1><p>text {i} of the page</p>{box if i < 10 else ''}</body>") for i in range(100)]
    got = {r.page_id: r.text for r in M.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\ntext {i} of the page" for i in range(100))


def test_a_page_inside_a_form_or_a_named_wrapper():
    x = M.extract
    text = "<h1>T</h1><p>the text of the page</p><p>and more of it</p>"
    want = "T\nthe text of the page\nand more of it"
    for wrap in ("<form id=aspnet>{}</form>", "<dialog open>{}</dialog>", "<div class=related>{}</div>", "<div class=login>{}</div>",
                 "<form><div class=search>{}</div></form>", "<div class=content-sidebar-wrap>{}</div>", "<div role=dialog>{}</div>"):
        assert x(f"<body><nav>menu</nav>{wrap.format(text)}<footer>foot</footer>") == want, wrap
        assert x(f"<body><div class=ad>buy</div>{wrap.format(text)}") == want, wrap
    for part in ("<form>name <input> send it</form>", "<div class=login>log in</div>", "<dialog>sure?</dialog>"):
        assert x(f"<body>{text}{part}") == want, part
    for never in ("nav", "footer", "aside", "menu"):
        assert x(f"<{never}>{text}</{never}>") == "", never
    assert x(f"<p>short</p><div class=comments>{text}</div>") == "short"


def test_names_of_several_words():
    x = M.extract
    for cls in ("comment-list", "comments-area", "comment", "ad-container", "ad_slot", "main-nav", "cookie-banner",
                "newsletter-signup", "cookie-notice", "share-bar", "related-links"):
        part = f"<div class='x {cls}'><p>out</p></div>"
        assert x(f"<article><p>the text of a page</p>{part}<p>b</p></article>") == "the text of a page\nb", cls
        assert x(f"<body><div><p>the text of a page</p>{part}<p>b</p></div>") == "the text of a page\nb", cls
    for cls in ("no-sidebar", "has-comments", "notice-period", "related-work", "post-header", "ad-hoc", "shared-memory", "searching"):
        assert x(f"<div class={cls}><p>in</p></div><p>b</p>") == "in\nb", cls
        assert x(f"<article><div class={cls}><p>in</p></div><p>b</p></article>") == "in\nb", cls


def test_a_button_does_not_end_a_block():
    assert M.extract("<p>one <button>click</button>two</p>") == "one two"
    assert M.extract("<article><p>one</p><button>click <b>me</b></button><p>two</p></article>") == "one\ntwo"


def made_site(rnd, host, pages):
    """Pages without main or article; nothing but recurrence tells the parts of the layout. Yields (html, main text)."""
    code = {k: f"c{rnd.randrange(16 ** 6):06x}" for k in "top menu body box links".split()}
    shared = "<div><p>All about us.</p><p>Write to us!</p></div>"
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") for _ in range(rnd.randrange(1, 5)))
    for i in range(pages):
        say = lambda n: " ".join(word() for _ in range(n))
        links = lambda n: "".join(f"<li><a href='/{word()}'>{say(2)}</a>" for _ in range(n))
        blocks = [say(4), *(say(rnd.randrange(20, 60)) for _ in range(rnd.randrange(2, 6)))]
        text = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        html = (f"<html><body><div class={code['top']}>{host}</div><div class={code['menu']}><ul>{links(6)}</ul></div>"
                f"<div class={code['body']}>{text}<div class='promo-{code['box']}'>{say(6)}</div></div>"
                f"<div class={code['links']}>See also<ul>{links(rnd.randrange(3, 9))}</ul></div>{shared}</body></html>")
        yield html, "\n".join(blocks)


def test_recurrence_alone_tells_the_layout(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for host, n in (("a.org", 60), ("b.net", 25), ("c.com", 200)):
        for html, text in made_site(rnd, host, n):
            want[len(rows)] = text
            rows.append((len(rows), f"http://{host}/{len(rows)}", html))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in M.main_text(pages).collect()} == want
    without = {k: M.extract(html) for k, _, html in rows}
    assert all(without[k] != want[k] for k in want)


def test_slots_spare_the_text(spark):
    """Link lists recur in one slot, but where they are most of a page they are its text; so are texts in one slot."""
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        links = "".join(f"<li><a href=x>link {rnd.random()}</a>" for _ in range(5))
        note = f"<div class=note><p>note {rnd.random()}</p></div>"
        rows.append((i, f"http://a.org/{i}", f"<div class=sponsor-story><p>story {i} of {rnd.random()}</p>{note}</div><div class=l><ul>{links}</ul></div>"))
    got = {r.page_id: r.text for r in M.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, _, html in rows:
        assert got[i] == "\n".join(re.findall(r"<p>(.*?)</p>", html))
