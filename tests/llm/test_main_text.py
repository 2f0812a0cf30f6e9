"""Main-text extraction: an independent reading of the given pages, and page shapes beyond them."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from sylva.llm import queries
from sylva.llm.main_text import content_paths, blocks_of, extract


def by_hand(page):
    """These pages' article holds h1 and p only."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    lines = (re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in lines if x)


def test_given_pages(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == by_hand(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "This is a sentence of the article, with commas, and it goes on for a while. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a &amp; b&nbsp;&lt;c&gt; &#8364;</p>", "a & b\xa0<c> €"),
        ("<!-- x --><p>a\n\t b<br>c<p>d<", "a b c\nd<"),
        ("<body><article><h1>T</h1><p>one<script>var a='</p>'</script> two</p><aside>no</aside><div class='share-buttons'>no</div><section class=comments><p>reader says</p></section></article><footer>f</footer></body>", "T\none two"),
        (f"<div id=nav><a href=x>Home</a></div><div class=page><div class=body><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></div><div role=contentinfo>c</div>", f"Head\n{LONG.strip()}\n{LONG.strip()}"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<main><p>x</p><form><input value='>'>name <p>inside</form><p>y</main>", "x\ny"),
        ("<p title='a > b'>quoted</p><p unclosed", "quoted"),
        ("<article><p>same</p><p>same</p></article>", "same\nsame"),
        # one text node of a block speaks against itself only
        ('<article><p><b class="share">Note</b> long real sentence of the story, with more words here.</p><p>Second one.</p></article>', "long real sentence of the story, with more words here.\nSecond one."),
        (f"<article><p><span class='social'>Share</span> {LONG}</p><p>More.</p></article>", f"{LONG.strip()}\nMore."),
        # a word of a compound class doesn't condemn a long paragraph, a class of its own does
        (f"<article><p>{LONG}</p><p class='story related-text'>{LONG}</p><p class='subscribe-count'>{LONG}</p><p class='related-link'><a href=x>Other story</a></p><p class='advert'>{LONG}</p></article>", f"{LONG.strip()}\n{LONG.strip()}\n{LONG.strip()}"),
        # inside an article boxes below the threshold go: adverts, link lists and comments that nothing labels
        (f"<article><h1>T</h1><p>{LONG}</p><div><a href=x>Buy now and save</a></div><div class=z1>Only today</div><p>Short one.</p><ul class=z2><li><a href=1>Next</a><li><a href=2>Previous</a></ul><div class=z3><p>nice</p><p>agreed</p></div><p>{LONG}</p></article>", f"T\n{LONG.strip()}\nShort one.\n{LONG.strip()}"),
        # and so they do where no article element is
        (f"<body><div class=k><h2>T</h2><p>{LONG}</p><div><a href=x>Buy now and save</a></div><div class=z1>Only today</div><p>Short one.</p><div class=z3><p>nice</p><p>agreed</p></div><p>{LONG}</p></div><div class=z9><a href=q>Imprint</a></div></body>", f"T\n{LONG.strip()}\nShort one.\n{LONG.strip()}"),
        # lists, tables and links of the text itself stay
        (f"<article><p>{LONG} <a href=x>see there</a></p><ul><li>first point<li>second <a href=y>point</a></ul><table><tr><td>cell<td>other</table><blockquote>said so</blockquote></article>", f"{LONG}see there\nfirst point\nsecond point\ncell\nother\nsaid so".replace(LONG + "see", LONG.strip() + " see")),
    ],
)
def test_page_shapes(page, want):
    assert extract(page) == want


def test_deep_and_long_pages():
    assert extract("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(extract("<article>" + "<p>word</p>" * 20000 + "</article>")) == 5 * 20000 - 1
    assert extract("<" * 50000) == "<" * 50000


def test_deep_pages_take_time_with_their_length():
    began = time.perf_counter()
    assert extract("<div>x" * 160_000).count("x") == 120_000  # each div holds the next; the deepest with MASS of all is chosen
    assert extract("<span>" * 100_000 + "<p>a" * 20_000).startswith("a\na")
    assert extract("<p>a</i>" * 100_000 + "</div>" * 100_000).count("a") == 100_000
    assert time.perf_counter() - began < 60


def without_structure(page):
    """The page with all its sectioning elements as div, and classes that say nothing."""
    names = {}
    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b", r"<\1div", page)
    return re.sub(r'class="([^"]*)"', lambda m: f'class="c{names.setdefault(m[1], len(names))}"', page)


def test_ratios_decide_where_structure_says_nothing(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = sum(extract(without_structure(p)) == by_hand(p) for p in pages)
    assert same >= 0.9 * len(pages)


def test_a_page_wrapped_in_a_telling_class_is_not_lost():
    body = f"<div class=text><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><a href=x>y</a></div>"
    assert extract(f"<body><div class='page-banner'>{body}</div></body>") == f"Head\n{LONG.strip()}\n{LONG.strip()}"


def test_ratios_choose_paragraphs():
    page = f"<body><div class=a><p>{LONG}</p><p>{LONG}</p></div><div class=b><span>x</span></div><div class=c><span>y</span></div><div class=d><span>z</span></div></body>"
    assert any(p.endswith("div.a/p") for p in content_paths(blocks_of(page))) and not any("div.d" in p for p in content_paths(blocks_of(page)))


def test_null_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "<p>x</p>", "t"), (2, "<p>x</p>", "t")], "page_id long, html string, text string")
    from sylva.llm.main_text import main_text

    assert sorted(r["m"] for r in df.select("page_id", "text", main_text(F.col("html")).alias("m")).collect()) == ["", "x", "x"]
    assert df.where("false").select(main_text(F.col("html"))).count() == 0


def test_ratios_decide_inside_an_article(monkeypatch):
    """With ratios that say nothing, an unlabelled advert would stay."""
    from sylva.llm import main_text

    page = f"<article><p>{LONG}</p><p>{LONG}</p><div class=z1>Only today</div></article>"
    assert "Only today" not in extract(page)
    monkeypatch.setattr(main_text, "content", lambda blocks: {node.path: node for b in blocks for node, _, _ in b.texts})
    assert "Only today" in extract(page)
