import html
import re
import time
from collections import Counter

from tallyweave.llm import mainhtml
from tallyweave.llm.queries import op6_html_extraction

PROSE = "The cat of the house sat in the sun and it was as warm as the day before, so that all of us were glad. "


def test_rules():
    main = mainhtml.main_text
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="sidebar-left"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">{PROSE}</div><div class=ad>{PROSE}</div><script>var a = "</p>";</script><!-- <p>{PROSE}</p> -->
    <h1>Big &amp; small</h1><p>{PROSE}</p><p>Short one.</p><p>a<b>b</b>c&nbsp;&lt;d&gt;<br>e</p><p>{PROSE * 3}</p>
    <ul class="related"><li><a href=x>{PROSE}</a></li></ul><form><p>{PROSE}</p></form><section id="comments"><p>{PROSE}</p></section><aside>{PROSE}</aside><footer>&copy; {PROSE}</footer></body></html>"""
    p = PROSE.strip()
    want = ["Big & small", p, "Short one.", "abc <d> e", (PROSE * 3).strip()]
    assert main(page).split("\n") == want
    inside = page.replace('<h1>Big', '<article><h1>Big').replace("<ul class", "<section class=comments><p>" + PROSE + "</p></section></article><p>" + PROSE + "</p><ul class")
    assert main(inside).split("\n") == want


def test_open_blocks_follow_their_neighbours():
    links = "".join(f"<p><a href={i}>link number {i}</a></p>" for i in range(4))
    page = f"<body>{links}<p>near the links</p>{links}<p>{PROSE}</p><p>near the prose</p><p>{PROSE}</p><h2>Next</h2><p>{PROSE}</p></body>"
    got = mainhtml.main_text(page)
    assert "near the links" not in got and "near the prose" in got and "Next" in got and "link number" not in got


def test_odd_pages(spark):
    pages = [None, "", "   ", "no tags at all", "<p>", "<a href=\"x <p>t", "<!-- open", "<article>" + "<div>" * 3000 + "deep", "<" * 5000, "<p " * 3000, "&#xD800; &bogus; &#0;", "<p>" + PROSE * 2000]
    began = time.time()
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "page_id long, html string, text string")
    rows = mainhtml.extract(df).orderBy("page_id").collect()
    assert time.time() - began < 60
    assert len(rows) == len(pages) and rows[0].text_1 == rows[1].text_1 == rows[2].text_1 == "" and rows[0].text == "x"
    assert rows[7].text_1 == "deep" and rows[11].text_1 == (PROSE * 2000).strip()
    assert mainhtml.extract(df.limit(0)).collect() == []


def test_query_gives_the_articles(spark, sf_dir):
    """The test pages keep all of the main text in one article element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op6_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_open_and_empty_elements_keep_the_article():
    """Only raw text runs on to the end of the page; a head ends where blocks begin, an empty icon holds nothing."""
    p = PROSE.strip()
    article = f"<article><h1>Big</h1><p>{p}</p>%s<p>{p}</p></article>"
    want = f"Big\n{p}\n{p}"
    plain = article % ""
    for head in ("<head><title>t</title>", "<head><title>t</title><meta name=a><noscript><link href=x></noscript>", "<HEAD><title>t</title><noscript><link href=x>", "<head>"):
        assert mainhtml.main_text(f"<html>{head}<body>{plain}</body></html>") == want
    assert mainhtml.main_text(f"<html><head><title>t</title>{plain}") == want
    for icon in ("<svg/>", "<svg width=1 />", "<math/>", "<svg><path d=x>", "<svg><title/><path/></svg>", "<svg>a<svg>b</svg>c</svg>", "<svg><foreignObject><div>a<p>b</p></div></foreignObject>c</svg>", "<div><object><b>x</b></div>", "<div><canvas>x</div>", "<div><select><option>x</div>", "<div><iframe src=x></div>", "<noscript><p>x</p></noscript>", "<template><div>x</div></template>"):
        assert mainhtml.main_text(f"<html><head></head><body>{article % icon}</body></html>") == want, icon
    assert mainhtml.main_text(f"<article><p>{p} a<svg><path/></svg>b</p></article>") == f"{p} ab"
    assert mainhtml.main_text(f"<article><p>{p}</p><script>x<p>{p}</p>") == p


def test_pages_without_article(spark, sf_dir):
    """Known answers with the article tags taken off: nothing foreign comes in, and little is lost."""
    lost = extra = total = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = set(mainhtml.main_text(r.html).split("\n"))  # the article: see the test above
        got = set(mainhtml.main_text(re.sub(r"<(/?)article>", r"<\1div>", r.html)).split("\n"))
        lost += sum(map(len, want - got))
        extra += sum(map(len, got - want))
        total += sum(map(len, want))
    assert lost <= 0.05 * total and extra <= 0.01 * total


def test_a_teaser_article_does_not_take_the_page():
    teaser = f"<article><h2>Read on</h2><p>{PROSE}</p></article>"
    body = "".join(f"<p>{PROSE * 2}</p>" for _ in range(4))
    got = mainhtml.main_text(f"<body>{body}{teaser}</body>").split("\n")
    assert got.count((PROSE * 2).strip()) == 4
    # an article that holds most of the text leaves the frame out
    frame = f"<div><p>{PROSE}</p></div>"
    got = mainhtml.main_text(f"<body>{frame}<article>{body}</article>{frame}</body>").split("\n")
    assert got == [(PROSE * 2).strip()] * 4


def test_stop_words_decide_long_blocks():
    names = "Xanthippe Quorn Blixen Zweig Oblomov Krazny Vulpine Thaxter Morvern Glim " * 4
    page = "<body><p>{0}</p><div>{1}</div><div>{1}</div><p>{0}</p></body>".format(PROSE, names)
    assert mainhtml.main_text(page).split("\n") == [PROSE.strip()] * 2
    assert mainhtml.main_text(f"<body><article><p>{PROSE}</p><p>{names}</p></article></body>").split("\n") == [PROSE.strip(), names.strip()]
    assert mainhtml.main_text(f"<body><p>{names}</p></body>") == names.strip()  # no language that the list knows


def stripped(page):
    """A page without names: articles are plain elements, and class, id and role are gone."""
    page = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page, flags=re.IGNORECASE)
    for _ in range(3):
        page = re.sub(r"(<[a-zA-Z][^>]*?)\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", r"\1", page)
    return page


def compared(pages):
    """(share of the articles' characters that stays, foreign characters by them) on pages without names."""
    kept = foreign = whole = 0
    for page in pages:
        inside = re.search(r"<article\b.*?</article>", page, re.DOTALL | re.IGNORECASE)
        want = Counter(mainhtml.main_text(inside[0]).split("\n"))
        got = Counter(mainhtml.main_text(stripped(page)).split("\n"))
        kept += sum(len(x) * n for x, n in (want & got).items())
        foreign += sum(len(x) * n for x, n in (got - want).items())
        whole += sum(len(x) * n for x, n in want.items())
    return kept / whole, foreign / whole


def test_density_decides_where_names_are_gone(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").where("html like '%<article%</article>%'").collect()]
    kept, foreign = compared(pages)
    assert kept >= 0.95 and foreign < 0.005, (kept, foreign)
    monkeypatch.setattr(mainhtml, "STOPS_LOW", 2.0)
    monkeypatch.setattr(mainhtml, "STOPS_HIGH", 2.0)
    assert compared(pages)[1] > max(0.01, 3 * foreign)  # without stop words nothing tells notices from prose


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("<p>Of the and to a in that is was for it with as his on be at by.",)] * 3, "html string")
    assert len({r.text for r in mainhtml.extract(df).collect()}) == 1 and mainhtml.extract(df).count() == 3
    assert mainhtml.extract(df.where("false")).collect() == []
