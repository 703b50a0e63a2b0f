import html
import random
import re
import time

from curator.llm import html_text as m

PARA = "This is the first paragraph of the article and it has more than enough words to be one of the good blocks of the page."


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_page_furniture_goes():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href="/x">the menu of it</a></li></ul></nav><div class="ad">{PARA} ad</div>
    <div id="cookie-notice">{PARA} cookie</div><div class="content"><article class="post has-sidebar"><header><h1>Title of it</h1></header><p>{PARA}</p>
    <script>var t="</p><p>x";</script><p class="advert">{PARA} advert<p>Short one.</p><form>{PARA} form<input></form><ul><li>Item &amp; more</li><li>b &lt; c</li></ul>
    <p>{PARA} <b>bold</b><br>next&nbsp;line &#233;</p></article><section class="comments"><p>{PARA} comment</p></section></div><aside>{PARA} aside</aside>
    <footer>&copy; 2020 of the site</footer><!-- <p>{PARA} hidden</p> -->"""
    assert m.extract(page(body)) == ["Title of it", PARA, "Short one.", "Item & more", "b < c", f"{PARA} bold next line é"]


def test_two_passes_without_an_article_element():
    links = "".join(f'<li><a href="/{i}">some link that is long enough to look like a paragraph of the text {i}</a></li>' for i in range(4))
    body = f"<ul>{links}</ul><div>menu</div><h1>Title</h1><p>{PARA}</p><p>Ha.</p><p>{PARA}</p><div>about</div><ul>{links}</ul>"
    assert m.extract(page(body)) == ["Title", PARA, "Ha.", PARA, "about"]
    assert m.second_pass([1, -1, -1, 0, -1], [0] * 5) == [1, 1, 0, 0, 0]
    assert m.second_pass([-1, 0, -1], [1, 2, 2]) == [1, 0, 0]


def test_broken_pages():
    assert m.extract("") == [] and m.extract("plain") == []
    assert m.extract(f"<article><p>{PARA}<p>{PARA} two<scr") == [PARA, f"{PARA} two"]
    assert m.extract(f"<article><p>{PARA}</p><script>var x = 1; {PARA}") == [PARA]
    assert m.extract(f"<article><p>{PARA}</p><!-- {PARA}") == [PARA]
    assert m.extract(f"<article><p title='a > b'>{PARA} 1 < 2</p></div></article>") == [f"{PARA} 1 < 2"]


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = m.main_text(d).collect()
    source = {r.page_id: r.html for r in d.collect()}
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in want if x), r.page_id
        assert r.n_chars == len(r.text)


def test_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", page(f"<article><p>{PARA}</p></article>")), (3, "u", page("<article>" + f"<p>{PARA}</p>" * 3000 + "</article>")), (3, "u", "x"), (3, "u", "x")]
    got = m.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.n_chars) for r in got} == {(1, 0), (2, 0), (None, len(PARA)), (3, 3000 * len(PARA) + 2 * 2999), (3, 0)}
    assert m.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


#: The same grammar as one regular expression: right, but slow on broken pages.
TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?![a-zA-Z0-9:-])[^>]*(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select)(?![a-zA-Z0-9:-])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)


def by_expression(text):
    return [(x.start(), x.end(), x["tag"] and x["tag"].lower(), bool(x["end"]), x["rest"] or "") for x in TAGS.finditer(text)]


def test_tokens_match_one_expression(spark):
    r = random.Random(4)
    parts = ["<p>", "</p>", "<a href='x>y'>", '<a b="1">', "text ", "< ", "<3", "<!-- x -->", "<!doctype a>", "<script>a<b></script>", "<SCRIPT x>1</Script >", "<style/>", "<svg a/>", "<svg>", "</svg>", "<x-y z=1/>", "</script>", "<title-bar>", "<br/>", "<a<b>", "<?x?>", "é&amp;"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for text in made + [x.html for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]:
        assert list(m.tokens(text)) == by_expression(text), text[:200]


def test_second_pass_matches_brute_force():
    r = random.Random(5)
    for _ in range(500):
        n = r.randint(0, 14)
        classes, article = [r.choice([-1, -1, 0, 1]) for _ in range(n)], [r.choice([0, 1, 2]) for _ in range(n)]
        want = []
        for i in range(n):
            decided = [(abs(i - j), -classes[j], classes[j]) for j in range(n) if classes[j] >= 0 and article[j] == article[i]]
            want.append(classes[i] if classes[i] >= 0 else min(decided)[2] if decided else int(article[i] > 0))
        assert m.second_pass(classes, article) == want


def test_broken_pages_take_linear_time():
    units = ["<script ", "<a ", '<a "', "<a '>", "<div>", "</section>", "<!--", "<!", "&#1", "<p class='", "<script>", "<b>", "</script ", "&", "<", "' <a "]
    for unit in units:
        began = time.process_time()
        m.extract(unit * (1_000_000 // len(unit)))
        m.extract("<div>" * 100_000 + unit * (500_000 // len(unit)) + ">")
        assert time.process_time() - began < 12, unit
    assert m.extract(f"<article><p>{PARA} &#{'9' * 6000}; &#{'0' * 6000}65; &#x{'f' * 9};</p></article>") == [f"{PARA} � A �"]


def test_unclosed_quote_does_not_take_the_page():
    assert m.extract(f"<article><p title=\"x>{PARA}</p><p>{PARA} two</p></article>") == [PARA, f"{PARA} two"]


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "u", page(f"<article><p>{PARA}</p></article>"), "x", 5, 6)], "page_id long, url string, html string, text string, n_chars long, n_blocks int")
    assert [r.text for r in m.main_text(d).collect()] == [PARA]
