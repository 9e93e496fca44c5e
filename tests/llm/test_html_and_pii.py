import hashlib
import random
import re

import numpy as np
import pytest

from corpusmill.llm.html_blocks import extract_main_text, main_text
from corpusmill.llm.lstm_crf import Tagger
from corpusmill.llm.personal_data import KINDS, WINDOW, _regions, _tags, all_spans, base_spans, find_personal_data, luhn, model_spans, train, training_windows, written

FOLDER = "/root/testdata/sf0.001"


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home header">
      <header><h1>Site</h1></header><nav><ul><li><a href="/x">One</a></ul></nav><script>var t="</p><p>no";</script>
      <!-- <p>no</p> --><div class="ad-banner">Buy the best of it and the rest of them.</div>
      <div id="cookieNotice"><p>We use the cookies of the site and of others.</p></div>
      <article><header><h2>Title &amp; more</h2></header><p>First <b>bold\n text</b>,<br>&eacute;&nbsp;end &lt;x&gt;
      <p>Short.<ul><li>Item one<li><a href=/y>Link only</a></ul><pre>a   b</pre>5 < 6
      <form><label>Name</label></form><section class='comments'><p>A reader says that it is what it was for them.</p></section></article>
      <aside>More of the same and of the other.</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", "First bold text, é end <x>", "Short.", "Item one", "a b", "5 < 6"]


def test_pages_without_an_article_are_told_by_their_words():
    prose = "It was the best of times and it was the worst of times, as they say in all of the books that we have read. " * 3
    page = f"<body><div>Home</div><div><a href=a>x</a> | <a href=b>yyyyyyyyyy</a></div><h1>A tale</h1><div>{prose}</div><div>Fin</div><div>{prose}</div><div>© 2020</div>"
    assert main_text(page).split("\n") == ["A tale", prose.strip(), "Fin", prose.strip()]
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<a <b") [0:0]
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert main_text("<article><p>" + "w " * 300_000).count("w") == 300_000


def test_unclosed_items_do_not_hide_the_page():
    article = "<article><p>The text of the page.</article>"
    lists = ("<ul>{}</ul>", "<li><a href=/x>x</a>"), ("<dl>{}</dl>", "<dt>x<dd>y"), ("<table>{}</table>", "<tr><td>x<td>y"), ("<div>{}</div>", "<div>x")
    for out in ("nav", "aside", "form", "footer"):
        for holder, item in lists:
            assert main_text(f"<{out}>{holder.format(item * 400)}</{out}>{article}") == "The text of the page."
    assert main_text("<article><ul><li>One<ul><li>Two</ul>Three<li class=ad>Four<li>Five</ul></article>").split("\n") == ["One", "Two", "Three", "Five"]
    item = "item " * 30
    assert main_text(f"<li>x<article><p>Text.<li>{item}</article>").split("\n")[1:] == ["Text.", item.strip()]
    assert main_text("<article><table><thead><tr><th>Head<tbody hidden><tr><td>No<tr><td>No</table></article>") == "Head"
    table = "<article><table><tr><td class=ad>No<td>One<table><tr><td>Two</table>Three<tr class=ad><td>No<tr><td>Four</table></article>"
    assert main_text(table).split("\n") == ["One", "Two", "Three", "Four"]


ARTICLE = "<article><h1>Head</h1><p>The text of the page.</p></article>"


@pytest.mark.parametrize(
    "opening",
    [f'<div class="{c}">' for c in ("layout has-sidebar", "site with-sidebar", "elementor-widget elementor-widget-theme", "content no-comments",
                                    "page search-results", "main nav-open", "share-enabled", "social-science", "sidebar", "widget")]
    + ['<form id="aspnetForm">', '<div id="banner"><div class="notice">', '<main class="no-sidebar">', '<main role="search">'],
)
def test_no_name_around_an_article_drops_it(opening):
    assert main_text(f"<body>{opening}<nav><a href=/>Home</a></nav>{ARTICLE}<div class=sidebar><p>More of it, and of the rest.</p></div></body>") == "Head\nThe text of the page."


def test_names_of_the_article_itself():
    for name in ("post has-share comment-open", "no-sidebar", "post hentry", "social-science"):
        assert main_text(f'<article class="{name}"><p>The text.</article>') == "The text."
    comments = '<div id="comments"><ol><li><article class="comment-body"><p>A reader was here.</article></ol></div>'
    assert main_text(f"<body>{ARTICLE}{comments}</body>") == "Head\nThe text of the page."
    assert main_text('<article><div class="entry-header"><h1>Head</h1></div><p>Text.</article>') == "Head\nText."
    for name in ("site-footer", "sidebar-left", "cookieNotice", "comment-list", "ad-slot", "main-nav", "newsletter-form", "sidebar-1", "site-header__inner"):
        assert main_text(f'<body>{ARTICLE}<div class="{name}"><p>It is not of the text that we want to have.</p></div>') == "Head\nThe text of the page."


def test_short_pages_and_other_languages_keep_their_text():
    assert main_text("<p>One short paragraph.</p>") == "One short paragraph."
    assert main_text("<nav><a href=/>Home</a></nav><p>One short paragraph.</p><footer>© me</footer>") == "One short paragraph."
    russian = "Сегодня утром в городе открыли новый мост через реку. Его строили почти три года. По нему уже поехали первые машины. Жители довольны."
    assert main_text(f"<nav><a href=/>Главная</a></nav><div>{russian}</div><div>{russian * 2}</div>") == f"{russian}\n{russian * 2}"
    wrapped = "It was the best of times and it was the worst of times, as they say in all of the books. " * 4
    assert main_text(f'<div class="widget"><div>{wrapped}</div></div><div class="sidebar">Of the rest and the best.</div>') == wrapped.strip()


def plain_main_text(parts):
    """Of (kind, texts) parts of a page with an article: what is in the article, and nothing else."""
    return "\n".join(t for kind, texts in parts if kind == "article" for t in texts)


def test_random_pages_with_an_article():
    draw = random.Random(12)
    wraps = ['<div class="page has-sidebar">{}</div>', "<div id=main-content>{}</div>", "<section>{}</section>", "<form>{}</form>", '<div class="widget"><div>{}</div></div>', "{}"]
    outs = ["<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", '<div class="ad">{}</div>', '<div id="cookie-banner">{}</div>', '<ul class="comments">{}</ul>', "<div hidden>{}</div>"]
    for _ in range(400):
        parts, html = [], ""
        for kind in draw.sample(["out"] * 4 + ["article"], 5):
            texts = [" ".join(draw.choice("the of wort und mot дом x1 &".split()) for _ in range(draw.randrange(1, 30))) for _ in range(draw.randrange(1, 4))]
            inner = "".join(f"<p>{t.replace('&', '&amp;')}" + draw.choice(["", "</p>"]) for t in texts)
            html += draw.choice(outs).format(inner) if kind == "out" else draw.choice(wraps).format(f"<article>{inner}</article>")
            parts.append((kind, texts))
        assert main_text(f"<html><body class='nav-open sidebar'>{html}</body></html>") == plain_main_text(parts), html


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = extract_main_text(pages).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        inside = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.split("</?(?:h1|p)>", inside)]
        assert r.n_chars == len(r.text) and len(r.text.split("\n")) == len([b for b in blocks if b])
    assert extract_main_text(pages.limit(0)).count() == 0


def plain_spans(text):
    """The patterns as they are worded."""
    out = []
    out += [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(2)
    parts = ["a@b.c", "x.y@", "@", "@@a.b", "1.2.3.4", "256.1.1.1.9.9", "4111 1111-1111 1111", "4111111111111111", "+1 (988) 555-2485", "+1", "12", ".", "-", " ", "é", "+", "0001.002.3.04", "a@b.c@d.e.f"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for t in texts:
        assert base_spans(t) == plain_spans(t), t
    assert base_spans("9" * 200_000 + " " + "a" * 200_000 + "@x") == []


def test_gradients_equal_differences():
    model, draw = Tagger(3), np.random.default_rng(0)
    model.p = {k: v.astype("float64") for k, v in model.p.items()}
    symbols, tags = draw.integers(0, 20, (2, 6)), draw.integers(0, 3, (2, 6))
    _, grads = model.learn_gradients(symbols, tags)
    for name in grads:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        losses = []
        for step in (1e-3, -2e-3):
            model.p[name][at] += step
            losses.append(model.learn_gradients(symbols, tags)[0])
        model.p[name][at] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-2 * abs(grads[name][at]) + 2e-3, name


@pytest.fixture(scope="module")
def sentences():
    draw = random.Random(8)
    words = ["the", "of", "and", "version", "number", "a", "some", "with"]
    prose = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(3, 20)))
    out = []
    for k in range(900):
        number = "".join(draw.choice("0123456789") for _ in range(15))
        digit = next(d for d in "0123456789" if luhn(number + d))
        value = [
            f"{draw.choice(['ann', 'bob', 'eve'])}.{k}@mail{k % 9}.example.com", ".".join(str(draw.randint(1, 255)) for _ in range(4)),
            number + digit, f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}", f"{k}.0", f"key{number}x", "",
        ][k % 7]
        out.append(f"{prose()} {value} {prose()}")
    return out


def test_model_learns_the_spans_and_adds_variants(spark, sentences):
    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '[0-9@]'").limit(700).collect()
    sentences = [*sentences[:400], *[r.text for r in more]]
    docs = spark.createDataFrame(list(enumerate(sentences)), "doc_id long, text string").repartition(3)
    data = train(docs, steps=400)
    model = Tagger.from_bytes(data)
    symbols, tags = training_windows(sentences, seed=99)
    assert (model.decode(symbols) == tags).mean() > 0.98
    held = ["call them (415) 555-2671 of the office", "write to ann.7@mail3.example.com for the version"]
    assert [k for _, _, k in model_spans(model, held)[1]] == ["email"]
    added = [a for _, a in all_spans(held, model)]
    assert [held[0][s:e] for s, e, _ in added[0]] == ["(415) 555-2671"] and added[1] == []
    clean = [s for s in sentences if not base_spans(s)]
    assert sum(bool(a) for _, a in all_spans(clean, model)) <= 0.02 * len(clean)
    # A span over a window's edge comes out once and whole.
    whole = 0
    for shift in range(0, WINDOW, 4):
        text = "7 the of and " * 6 + "w" * shift + " ann.3@mail1.example.com of the " + "7 and the " * 4
        emails = [s for s in model_spans(model, [text])[0] if s[2] == "email"]
        assert len(emails) <= 1
        whole += emails == base_spans(text)
    assert whole >= 20
    rows = {r.doc_id: r for r in find_personal_data(docs, data).collect()}
    for i, t in enumerate(sentences):
        base = plain_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(filter(None, written(base).split(","))) <= set(rows[i].spans.split(","))


def test_written_out_addresses_are_seen_without_a_digit():
    class Reader:
        def decode(self, symbols):
            texts = ["".join(chr(31 + c) for c in row) for row in symbols]
            form = re.compile(r"[a-z.]+(?: at | \(at\) |\[at\])[a-z]+(?:\.[a-z]+)+")
            return np.stack([_tags(WINDOW, [(*m.span(), "email") for m in form.finditer(t)]) for t in texts])

    prose = "as it was in all of the books, or at the end of them, that we have read so far; " * 3
    for sign in (" at ", " (at) ", "[at]"):
        address = f"ann.miller{sign}mail.example.com"
        text = f"{prose}{address} {prose}"
        ((base, added),) = all_spans([text], Reader())
        assert base == [] and [text[s:e] for s, e, _ in added] == [address]
        long = f"{'l' * 64}{sign}{'d' * 60}.{'e' * 60}.{'f' * 60}.example"
        text = f"Number 7: {long} {prose}"
        start = text.index(long)
        assert any(a <= start and start + len(long) <= b for a, b in _regions(text))
    assert _regions(prose) == []


def test_texts_without_spans(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "no data"), (2, "")], "doc_id long, text string")
    assert train(docs) is None
    rows = find_personal_data(docs, None).collect()
    assert len(rows) == 4 and {r.spans for r in rows} == {""} and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert find_personal_data(docs.limit(0), None).count() == 0
