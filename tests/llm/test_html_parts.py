"""Pages whose attributes and wrappers look like those of menus and adverts."""

from test_html_text import STORY, page

from millrace.llm.html_text import main_text


def test_values_of_other_attributes():
    for a in ('style="overflow:hidden"', 'title="the hidden valley"', 'data-id="menu"', "data-x='class=menu'"):
        assert main_text(page(f"<div {a}><article><p>{STORY}</p></article></div>")) == STORY
    assert main_text(page(f"<div hidden><p>{STORY}</p></div><p class='main-nav x'>{STORY}</p><p>Yes {STORY}</p>")) == f"Yes {STORY}"


def test_wrappers():
    for c in ("has-sidebar", "content-with-ads", "comments-open", "sidebar-page", "promo"):
        inside = f"<article><p>{STORY}</p><p class=share>{STORY}</p></article><p>{STORY}</p>"
        assert main_text(page(f"<div class='{c}'><nav>{STORY}</nav>{inside}</div>")).startswith(STORY)
    teaser = f"<div class=related><article><p>Other {STORY}</p></article></div>"
    assert main_text(page(f"<article><p>{STORY}</p></article>{teaser}")) == STORY
    assert main_text(page(f"<p>{STORY}</p><div class=comments><article class=comment><p>Me {STORY}</p></article></div>")) == STORY
    assert main_text(page(f"<aside class=x><article><p>{STORY}</p></article></aside>")) == ""


def test_formulas_and_objects():
    got = main_text(page(f"<article><p>{STORY}</p><p>So <math><mi>x</mi></math> is.</p><object><p>Shown.</p></object></article>"))
    assert got == f"{STORY}\nSo x is.\nShown."


def test_wrappers_that_only_look_like_something_else():
    p = f"<p>{STORY}</p>"
    for inside in (f"<form>{p}</form>", f"<fieldset>{p}</fieldset>", f"<dialog>{p}</dialog>", f"<div class='elementor-widget-container'>{p}</div>", f"<div class='entry related-body'>{p}</div>"):
        assert main_text(page(f"<article>{inside}</article>")) == STORY, inside
    assert main_text(page(f"<main class='entry related-body'>{p}</main>")) == STORY
    for c in ("page-header-menu", "content-sidebar-wrap", "newsletter-template"):
        assert main_text(page(f"<div class='{c}'>{p}</div>")) == STORY


def test_a_form_around_the_page_and_forms_to_fill_in():
    p = f"<p>{STORY}</p>"
    around = f"<form id=aspnetForm><input type=hidden><nav>One Two</nav><input><button>Go</button>{p * 9}</form>"
    assert main_text(page(around)) == "\n".join([STORY] * 9)
    asked = "Tell us what you think of it, and we will be in touch with you as soon as we can be."
    for form in (f"<form><p>{asked}</p><input><textarea></textarea><button>Send</button></form>", f"<dialog open>{p}</dialog>"):
        assert main_text(page(f"<div>{p}</div>{form}")) == STORY


def test_sure_names_hold_inside_articles():
    for c in ("comments", "comment-list", "site-footer", "ad-slot"):
        assert main_text(page(f"<article><p>{STORY}</p><div class='{c}'><p>Me: {STORY}</p></div></article>")) == STORY


def test_code_between_paragraphs_and_hidden_text():
    code = "x = compute(a, b, c) ; y = other(x, 12) ; print(y) ; return y if x else z ; # done"
    assert main_text(page(f"<div><p>{STORY}</p><pre>{code}</pre><p>{STORY}</p></div>")) == f"{STORY}\n{code}\n{STORY}"
    for style in ("display:none", "color:red; display : none", "visibility:hidden"):
        assert main_text(page(f"<article><p>{STORY}</p><p style='{style}'>No {STORY}</p></article>")) == STORY


def test_time_is_linear_in_tags():
    import time

    def seconds(n):
        start = time.process_time()
        for made in ("<font>" * n + "</span>" * n, "<font>" * n + "<li>x" * n, "<b>x</li>" * n, "<form><p>x" * n):
            main_text(made)
        return time.process_time() - start

    seconds(1000)
    assert seconds(16_000) < 16 * max(seconds(2000), 0.02)
