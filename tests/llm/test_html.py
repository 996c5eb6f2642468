import html as entities
import re

import numpy as np
import pytest

from visemill.llm.html import Field, blocks_of, extract, features_of, labelled_blocks, labelled_page, learn_field, main_text, train_field
from visemill.llm.queries import op6_html_crf


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return learn_field(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def article(page):
    """The article's text of the generator's plain layout, by hand."""
    inner = re.search("<article>(.*)</article>", page, re.S)
    return " ".join(entities.unescape(re.sub("<[^>]*>", " ", inner[1])).split()) if inner else ""


def test_query_on_real_rows(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op6_html_crf(spark, sf_dir).collect()
    assert len(got) == len(pages)
    right = [r.text == article(pages[r.page_id].html) for r in got]
    assert np.mean(right) == 1.0
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_layouts_held_out_from_training(field):
    rng = np.random.default_rng(99)
    sentences = ["Some words that were never seen before, in a row.", "Quite another thing!", "It ends here, or does it?", "Und noch ein Satz."]
    right = total = 0
    for _ in range(150):
        x, y = labelled_blocks(labelled_page(rng, sentences))
        right += sum(a == b for a, b in zip(field.decode(x), y))
        total += len(y)
    assert right / total > 0.97


def test_a_page_with_all_furniture(field):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>if (a<b) { "</p>" }</script></head><body>
    <header class="site-header"><a href="/">Brand</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div>
    <div class="content"><h1>Real &amp; headline</h1><p>First   paragraph with <b>bold</b> and <a href="x">a link</a>, and more text.<p>Second&nbsp;paragraph &#8212; done, it has several words too.</div>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
    <div class="ad">Buy now!</div><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, I liked it a lot.</p></div></section>
    <form><label>Your name</label><input><textarea>hidden</textarea></form><footer>&copy; 2024 Example. All rights reserved.</footer></body></html>"""
    assert main_text(page, field) == "Real & headline First paragraph with bold and a link, and more text. Second paragraph — done, it has several words too."


def test_blocks_of_broken_markup():
    assert [b.text for b in blocks_of("a<p>b<div>c</p>d<!-- x")] == ["a", "b", "c", "d"]
    assert [b.text for b in blocks_of("1 < 2 &am; <b>x<br>y")] == ["1 < 2 &am; x y"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<script>x") == []
    assert len(blocks_of("<p>" * 20000 + "x")) == 1
    assert [b.text for b in blocks_of("<a title='1>2' x=\"a>b\">y</a><p class=\"q>z<p>w")] == ["y", "z", "w"]
    assert len(blocks_of("<a b=\"c" * 50_000)) == 1


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        f = Field({str(k): float(rng.normal()) for k in range(5)}, rng.normal(size=(2, 2)), rng.normal(size=2))
        x = [[str(k) for k in rng.integers(0, 5, 3)] for _ in range(n)]

        def value(y):
            s = f.scores(x)
            return f.start[y[0]] + sum(s[k] * y[k] for k in range(n)) + sum(f.transition[a, b] for a, b in zip(y, y[1:]))

        every = [[m >> k & 1 for k in range(n)] for m in range(2**n)]
        assert value(f.decode(x)) == pytest.approx(max(map(value, every)))


def test_odd_rows(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x"), (4, "w", "<article><p>" + "long text. " * 100_000 + "</p></article>"), (4, "w", "<nav>a</nav>"), (4, "w", "<nav>a</nav>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = extract(df, field).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert max(r.n_chars for r in got) == len(("long text. " * 100_000).strip())
    assert extract(df.limit(0)).collect() == []
    assert features_of([]) == []


def test_hidden_elements_end_where_they_end():
    for tag in ("<button>", "<select><option>", "<template>", "<datalist>", "<button-group>", "<svg-icon name=x>"):
        assert [b.text for b in blocks_of(f"<p>before</p>{tag}<p>the article</p><p>after")] == ["before", "the article", "after"], tag
    assert [b.text for b in blocks_of("<button><p>the article</p><button type=x>Send</button><p>after")] == ["the article", "after"]
    for name in ("script", "style", "title", "textarea", "noscript", "iframe"):
        assert [b.text for b in blocks_of(f"<p>a<{name} x=1>hidden<p>hidden")] == ["a"]
        assert [b.text for b in blocks_of(f"<p>a</p><{name}>hidden<p>hidden</{name.upper()} ><p>b")] == ["a", "b"]
    assert [b.text for b in blocks_of("<p>a</p><p>b<button>hidden</button>c")] == ["a", "b c"]
    assert [b.text for b in blocks_of("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg/><object data=x>a chart</object> <svg><text>one</text></svg> more")] == ["so x=2 and a chart one more"]
    assert len(blocks_of("<template>" * 50_000 + "x")) == len(blocks_of("<button>" * 50_000 + "x")) == 1


def test_threads_of_readers_under_other_names(field):
    page = """<html><body><nav><a href=/>Home</a></nav><main><h1>A headline for the day</h1><p>First paragraph of the story, with several words in it.</p><p>Second one, which ends the story here.</p></main>
    <section id='discussion'><h3>12 replies</h3><div class=reply><b>someone</b><p>I do not agree with this at all, and here is why.</p></div></section><footer>Imprint</footer></body></html>"""
    assert main_text(page, field) == "A headline for the day First paragraph of the story, with several words in it. Second one, which ends the story here."
    for name in ("disqus_thread", "responses", "comments"):
        assert "agree" not in main_text(page.replace("discussion", name), field)


STORY = ["The river rose again during the night and flooded two streets.", "Nobody was hurt, said the fire brigade, which had been warned early.", "By noon the water had gone down by half a metre."]
MENU, IMPRINT = '<div class="menu"><a href="/">Home</a> <a href="/n">News</a></div>', '<div class="imprint">© 2024 Example</div>'


@pytest.mark.parametrize("body", [
    '<div class="txt"><div>{0}</div><div>{1}</div><div>{2}</div></div>',
    "{0}<br>{1}<br><br>{2}",
    '<div class="page-wrap"><p>{0}</p><p>{1} {2}</p></div>',
    "<div><h1>{0}</h1><p>{1}</p><p>{2}</p></div>",
    "<p>{0}</p><p>{1}</p><p>{2}</p>",
    '<table><tr><td class="x9"><p>{0}</p><p>{1}</p><p>{2}</p></td></tr></table>',
    '<div id="q"><div class="zz"><h2>{0}</h2><div>{1}</div><div>{2}</div></div></div>',
])
def test_articles_without_known_wrappers(field, body):
    for menu in (MENU, "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/c>Contact</a></ul>", '<nav><a href="/">Home</a></nav>'):
        for imprint in (IMPRINT, "<footer>Imprint</footer>", "<p>© 2024 Example. All rights reserved.</p>"):
            assert main_text(f"<html><body>{menu}{body.format(*STORY)}{imprint}</body></html>", field) == " ".join(STORY), (menu, imprint)


def test_time_is_linear_in_unclosed_markup():
    for opening in ("<![CDATA[", "<!x", "<script ", "<a b='", "<!--", "<template x", '<p a="', "<?"):
        blocks_of(opening * 100_000)
    assert [b.text for b in blocks_of("<p>a<![CDATA[ hidden <p> ]]>b<p>c<![CDATA[ d > e<p>f")] == ["ab", "c e", "f"]


def test_gradient_of_the_field():
    """One step of training from zero follows the gradient of the log-likelihood, by enumeration of all labellings."""
    rng = np.random.default_rng(4)
    x = [[str(k) for k in rng.integers(0, 4, 2)] for _ in range(5)]
    y = [0, 1, 1, 0, 1]
    names = sorted({f for fs in x for f in fs})

    def likelihood(w, trans, start):
        def value(labels):
            return start[labels[0]] + sum(sum(w[f] for f in fs) for fs, v in zip(x, labels) if v) + sum(trans[a, b] for a, b in zip(labels, labels[1:]))

        every = [value([m >> k & 1 for k in range(5)]) for m in range(32)]
        return value(y) - np.log(np.sum(np.exp(every)))

    zero = {f: 0.0 for f in names}, np.zeros((2, 2)), np.zeros(2)
    got = train_field([(x, y)], rounds=1, rate=1e-3, ridge=0.0)
    e = 1e-5
    for f in names:  # AdaGrad's first step has the gradient's sign and the rate's size
        slope = (likelihood({**zero[0], f: e}, *zero[1:]) - likelihood({**zero[0], f: -e}, *zero[1:])) / (2 * e)
        assert got.emission[f] == pytest.approx(1e-3 * slope / np.sqrt(slope**2 + 1e-8), abs=1e-6)
    for a in range(2):
        for b in range(2):
            t = np.zeros((2, 2))
            t[a, b] = e
            slope = (likelihood(zero[0], t, zero[2]) - likelihood(zero[0], -t, zero[2])) / (2 * e)
            assert got.transition[a, b] == pytest.approx(1e-3 * slope / np.sqrt(slope**2 + 1e-8), abs=1e-6)
