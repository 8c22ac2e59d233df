import html
import random
import re
import time

from brinemark.llm.html_text import extract, main_text, op10_html_text

LONG = "the sea of the north is in the water and it is warm " * 5


def brute(page):
    """The article of pages that have one, by its paragraphs."""
    art = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", art)]
    return "\n\n".join(x for x in parts if x)


def page_of(r):
    word = lambda: r.choice(["the", "sea", "&amp;", "&eacute;t&eacute;", "a&#8217;b", "x\n  y", "50%***", "&copy;", "ü"])
    text = lambda n: " ".join(word() for _ in range(n))
    body = "".join(r.choice([f"<p>{text(r.randint(1, 40))}</p>", f"<p><b>{text(4)}<br><p>{text(9)}</p>"]) for _ in range(r.randint(0, 8)))
    side = "".join(r.choice([f'<div class="ad">{LONG}</div>', f"<aside>{LONG}</aside>", f"<form>{LONG}<input></form>", f'<div id="cookie-notice">{LONG}</div>', f'<section class="user-comments"><p>{LONG}</p></section>', "<!-- > -->", f"<noscript>{LONG}</noscript>"]) for _ in range(3))
    return f'<!DOCTYPE html><html><head><title>{text(3)}</title><style>p{{}}</style><script>var t="</p><article>"</script></head><body><nav><ul><li><a href="/">{text(2)}</a></li></ul></nav>{side}<article><h1>{text(4)}</h1>{body}</article>{side}<footer>&copy; {text(5)}</footer>' + r.choice(["</body></html>", ""])


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(21)
    pages = [(i, f"http://a/{i}", page_of(r), "t") for i in range(150)]
    rows = [*pages, (None, None, None, "t"), (151, "u", "", "t"), (3, "http://a/3", pages[3][2], "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    out = op10_html_text(spark, str(tmp_path)).collect()
    assert len(out) == 153 and sum(x.page_id == 3 for x in out) == 2
    by = {x.page_id: x for x in out}
    cut = lambda p: p.replace('"</p><article>"', "")
    for i, _, p, _ in pages:
        assert by[i].text == brute(cut(p)) and by[i].n_chars == len(by[i].text), p
    assert by[None].text == by[151].text == "" and by[None].url is None
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_an_article():
    page = f"<body><div class=menu><a href=x>{LONG}</a></div><h2>Heading</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><ul><li><a href=y>more</a></ul><p>tail<footer>{LONG}</footer>"
    assert main_text(page).split("\n\n") == ["Heading", LONG.strip(), "Short one.", LONG.strip()]
    assert main_text(f'<div class="post">{LONG}<div class="comments">{LONG}</div></div>') == LONG.strip()
    assert main_text(f"<article><header><h1>Title</h1></header><p>x</p><div class=comments>no</div></article>") == "Title\n\nx"


def test_broken_markup_ends_and_takes_linear_time():
    began = time.time()
    for p in ("<" * 100_000, "<p" * 100_000, "<!--" * 50_000, "<script>" * 20_000, '<a b="' * 50_000, "<div>" * 50_000 + "x", "<b><p>" * 30_000, "&" * 100_000, "</p>" * 100_000):
        main_text(p)
    assert time.time() - began < 40
    assert main_text("<article>a<b c") == "a" and main_text("<article>1 < 2 & 3</article>") == "1 < 2 & 3"


def test_many_unclosed_elements_do_not_hide_the_article():
    for begin, each, end in (("<select>", "<option>x", "</select>"), ("<nav>", "<span>x", "</nav>"), ("<aside><table>", "<tr><td>x<td>y", "</table></aside>"), ("<div class=sidebar><dl>", "<dt>x<dd>y", "</dl></div>"), ("<nav>", "<td>x", "</nav>"), ("<nav>", "<div>x", "</nav>")):
        assert main_text(f"<body>{begin}{each * 400}{end}<article><p>{LONG}</p></article>") == LONG.strip(), each
    nested = "<table><tr><td><table><tr><td>in<td>ner</table><td>outer</table>"
    assert main_text(f"<article>{nested}<p>x</p></article><p>no") == "in\n\nner\n\nouter\n\nx"


def test_references_end_with_their_piece_of_text():
    assert main_text("<article>AT&<b>amp;</b> x &amp;lt;</article>") == "AT&amp; x &lt;"


def test_names_inside_an_article():
    page = f"""<main><div class="entry-header"><h1>Real title</h1></div><p class="share-price">The price rose.</p><div class="related-work"><p>{LONG}</p></div>
    <p>&copy; is a sign. {LONG}</p><div class="comment-list"><p>I agree</p></div><section id=comments>no</section><div class="ad-box x">buy</div><div class="entry share-buttons">s</div></main>"""
    assert main_text(page).split("\n\n") == ["Real title", "The price rose.", LONG.strip(), "© is a sign. " + LONG.strip()]
    assert main_text(f'<div class="entry-header">{LONG}</div><div class="x">{LONG}</div><div>© {LONG[:60]}</div><p>{LONG}</p>').count(LONG.strip()) == 2


def test_links_inside_an_article():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>part {i}</a>" for i in range(4)) + "</ul>"
    page = f"<article><h1>T</h1>{menu}<p>{LONG}</p><p><a href=/r>Read the report</a></p><ul><li>see <a href=/x>this</a><li><a href=/y>that</a></ul></article>"
    assert main_text(page).split("\n\n") == ["T", LONG.strip(), "Read the report", "see this", "that"]


def test_tags_end_after_closed_values():
    assert main_text("<article a='x>y' b = \"p>q\" c=it's>text <b d=\"e>f</b> g</article>") == "text f g"
    began = time.time()
    for p in ("<p " + "\" '" * 200_000 + ">x", '<p a="x ' * 100_000, "<p a='x> " * 100_000, '<p a="' + "<p b='>" * 100_000):
        main_text(p)
    assert time.time() - began < 10
