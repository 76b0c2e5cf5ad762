import pytest

from meshlens.llm import pages

PROSE = "The quick brown fox jumps over the lazy dog near the river bank today"


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("<script>var a='<p>x</p>'</script><style>p{}</style>", ""),
        (f"<article><h1>Head</h1><p>{PROSE} &amp; more&nbsp;&eacute; &#233;</p><p>Short.</p></article>", f"Head {PROSE} & more é é Short."),
        (f"<nav><a href=/a>Home</a></nav><div class='ad'>Buy now this</div><article><p><b>{PROSE}<br>two<p>{PROSE}</article><footer>&copy; site</footer>", f"{PROSE} two {PROSE}"),
        (f"<div class='cookie-notice'>{PROSE}</div><main><p>{PROSE}</p></main><section id='comments'><p>{PROSE}</p></section>", PROSE),
        (f"<article><p>{PROSE}</p><form><p>{PROSE}</p></form><!-- <p>no</p> --></article><aside>{PROSE}</aside>", PROSE),
        (f"<article><p>{PROSE}</p><p>cut off <b", f"{PROSE} cut off"),
        (f"<article><p>a &lt; b {PROSE} 3 < 4</p></article>", f"a < b {PROSE} 3 < 4"),
        (f"<ARTICLE><P>{PROSE}\n\t {PROSE}</P></ARTICLE>", f"{PROSE} {PROSE}"),
    ],
)
def test_main_text(html, want):
    assert pages.main_text(html) == want


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "no-sidebar", "sticky-header page", "elementor-widget", "long-form", "side-by-side", "widget", "form"])
@pytest.mark.parametrize("inner", ["<main>%s</main>", "<article>%s</article>", "<div><h1>Head</h1>%s</div>"])
def test_hints_on_wrappers_do_not_count(wrapper, inner):
    page = f"<div class='{wrapper}'>" + inner % f"<p>{PROSE}</p><p>{PROSE}</p>" + "</div>"
    head = "Head " if "Head" in inner else ""
    assert pages.main_text(page) == f"{head}{PROSE} {PROSE}"
    assert pages.main_text(page + f"<div class='sidebar'><p>{PROSE}</p></div>") == f"{head}{PROSE} {PROSE}"


@pytest.mark.parametrize("part", ["<section id='related-work'>%s</section>", "<section aria-label='Side effects'>%s</section>", "<div class='header'>%s</div>"])
def test_parts_of_an_article_that_only_look_like_hints_stay(part):
    assert pages.main_text(f"<article><p>{PROSE}</p>{part % f'<p>{PROSE}</p>'}</article>") == f"{PROSE} {PROSE}"


def test_hints_inside_and_beside_the_article_count():
    comments = f"<section id='comments'><article><p>{PROSE}</p></article></section>"
    assert pages.main_text(f"<article><p>{PROSE} one</p></article>{comments}") == f"{PROSE} one"
    assert pages.main_text(f"<div class='widget'><main><p>{PROSE} one</p>{comments}</main></div>") == f"{PROSE} one"


def test_formulas_are_text():
    math = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>a=1</annotation></semantics></math>"
    assert pages.main_text(f"<article><p>{PROSE} {math} holds</p></article>") == f"{PROSE} a=1 holds"


def test_labelled_table_is_learned():
    for page in pages.LABELLED:
        found = pages.blocks(page)
        got = [pages.is_main(row, pages.fitted()) for row in pages.features(found)]
        assert got == ["main:" in b.text for b in found], page[:200]


def test_frame(spark):
    rows = [(1, f"<article><p>{PROSE}</p></article>", "old"), (1, None, None), (2, "<p>" * 5000 + "<div" * 3, "x")]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert out.columns == ["page_id", "html", "text"] and out.count() == 3
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


W = "word " * 26


@pytest.mark.parametrize(
    "inner",
    [
        f"<p>{PROSE}</p><p>See <a>{W}</a></p><p>{PROSE}</p>",
        f"<p>{PROSE}</p><ul><li><a>one two three</a></li><li><a>four five</a></li></ul>",
        "<table><tr><td><a>one</a></td><td><a>two three</a></td></tr></table>",
        "<p><a>linked</a></p>",
        f"<ul><li><a>{W}</a></li></ul><p>{PROSE}</p>",
    ],
)
@pytest.mark.parametrize("top", ["article", "main"])
def test_linked_text_of_an_article_stays(top, inner):
    import re

    plain = " ".join(re.sub("<[^>]*>", " ", inner).split())
    assert pages.main_text(f"<nav><a>Home</a></nav><{top}>{inner}</{top}><footer><a>About</a></footer>") == plain


def test_link_density_alone_and_size_alone_change_the_class():
    around = f"<p>{PROSE} {PROSE}</p>%s<p>{PROSE} {PROSE}</p>"
    bare, linked = "one two three four", "<a>one two three four</a>"
    assert bare in pages.main_text(around % f"<div>{bare}</div>")
    assert bare not in pages.main_text(around % f"<div>{linked}</div>")
    assert W.strip() in pages.main_text(around % f"<div><a>{W}</a></div>")


@pytest.mark.parametrize("tag", ["<div>", "<div class=ad>text", "<li>x</li><div>", "<p><b>", "<a href=x>y", "<table><tr><td>z", "</div>"])
def test_deep_nesting_is_linear(tag):
    import time

    took = []
    for n in (10_000, 100_000):
        start = time.process_time()
        pages.main_text(tag * n)
        took.append(time.process_time() - start)
    assert took[1] < 40 * max(took[0], 0.05)


def test_clashing_columns_and_very_long_pages(spark):
    long = f"<article><p>{'long text ' * 300_000}</p></article>"
    frame = spark.createDataFrame([(None, long, 1, "a"), (1, long, 2, "b"), (1, long, 2, "b")], "page_id long, html string, n_chars int, text string")
    out = pages.extract(frame).collect()
    assert [len(r.text) for r in out] == [3_000_000 - 1] * 3 and [r.n_chars for r in out] == [1, 2, 2]
