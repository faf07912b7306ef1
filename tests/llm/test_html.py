import html
import re

import pandas as pd
import pytest

from focalis.llm import html_extract as H
from focalis.llm.html_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a <b>b</b>\n c<p>d", ["a b c", "d"]),
        ("<p><b>x<br>y</p>z", ["x y", "z"]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes&nbsp;&amp;&#233;&copy;</p>", ["yes &é©"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<div title='a>b'>t</div>", ["t"]),
        ("<title>no</title><textarea>no</textarea><p hidden>a</p><p style='display: none'>b</p>yes", ["a", "b", "yes"]),
        ("The area is <math>&pi; <mi>r</mi></math> exactly<noscript>, they say</noscript>", ["The area is π r exactly, they say"]),
        ("1 < 2 & 3 > 2", ["1 < 2 & 3 > 2"]),
        ("</p></div>a</span>b", ["ab"]),
        ("<script>never ends", []),
        ("", []),
        ("<![CDATA[x <y>]]>", ["x <y>"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    (b,) = blocks('<div class="mainContent cookie-banner" id=x1><p>a <a href=#>link</a></p></div>')
    assert b.path == ("div", ".main", ".content", ".cookie", ".banner", ".x", "p") and b.linked == 4


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_gradients():
    """Against differences, on a small page."""
    import numpy as np

    m = H.Labeller(1)
    f = H.Features([blocks("<p>a b c<p>d"), blocks("<div class=ad>x</div>")])
    y = np.array([1, 0, 1])
    _, g = m.gradients(f, y)
    for name in ("xf", "hb", "cf", "out", "path", "word"):
        flat, got = m.w[name].reshape(-1), g[name].reshape(-1)
        i = int(abs(got).argmax())
        flat[i] += 1e-5
        up = m.gradients(f, y)[0]
        flat[i] -= 2e-5
        down = m.gradients(f, y)[0]
        flat[i] += 1e-5
        assert abs((up - down) / 2e-5 - got[i]) < 1e-6


def test_held_out_pages(model):
    pages = H.training_pages(150, seed=1234)
    right = total = 0
    for found, labels in pages:
        p = model.predict(H.Features([found])) >= 0.5
        right += int((p == (pd.Series(labels) > 0).to_numpy()).sum())
        total += len(labels)
    assert right / total > 0.97


def article(page):
    """The text inside ``article``, which the made pages of the test tables have."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:h1|p)>", "\0", inner)).split("\0")
    return "\n\n".join(x for x in (" ".join(html.unescape(s).split()) for s in parts) if x)


def test_pages_of_the_tables(model):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    got = H.main_texts(pages.tolist(), model)
    assert sum(a == article(p) for a, p in zip(got, pages)) >= 0.98 * len(pages)


def test_odd_rows(spark, model):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long article, with words.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<nav>menu</nav>", 5), (3, "u", "<", 5), (4, "u", long, 5), (4, "u", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(pages, model).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2)} == {""} and all(r.text is not None for r in got)
    a, b = (r.text for r in got if r.page_id == 4)
    assert a == b and a.count("\n\n") > 2900
    assert H.extract(pages.limit(0), model).count() == 0


def test_raw_elements_without_an_end_keep_the_text_behind():
    for tag in ('<svg width="1"/>', "<math/>", "<iframe src='x'>", "<object data=x>", "<video controls>", "<canvas>", '<svg viewBox="0">'):
        assert [b.text for b in blocks(f"<div>{tag}<p>one</p></div><p>two</p>")] == ["one", "two"], tag
    assert [b.text for b in blocks("<p>a</p><object><p>if all fails</p></object><p>b</p><iframe>no</iframe><script>no <p>no</p>")] == ["a", "if all fails", "b"]


def test_pages_of_any_length_in_bounded_memory(model, monkeypatch):
    """One page of very many blocks beside short ones, and windows of any size, give the same labels."""
    import tracemalloc

    pages = H.training_pages(12, seed=99)
    whole = [model.predict(H.Features([b])) for b, _ in pages]
    batches = list(H._batches([0, 5, 2, 8000, 1, 9000], 64))
    assert batches == [[4, 2, 1], [3], [5]]
    long = "<article>" + "<p>word and more words." * 20_000 + "</article>"
    short = ["<nav>menu</nav><article><h1>Title</h1><p>A text of some words, with a stop.</p></article>"] * 63
    tracemalloc.start()
    got = H.main_texts([long, *short], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].count("word and") == 20_000 and peak < 200 << 20
    monkeypatch.setattr(H, "CELLS", 3)
    assert all(abs(model.predict_long(b) - w).max() < 1e-9 for (b, _), w in zip(pages, whole))


def test_labels_by_brute_force(model):
    """The forward pass, written out block by block in plain Python, gives the labels of the batched one."""
    import math

    import numpy as np

    pages = [b for b, _ in H.training_pages(4, seed=77)]
    got = model.predict(H.Features(pages))
    want = []
    for page in pages:
        f = H.Features([page])
        rows = []
        for k in range(len(page)):
            path = [model.w["path"][x] for x in f.path[f.path_at[k] : f.path_at[k + 1]]]
            word = [model.w["word"][x] for x in f.word[f.word_at[k] : f.word_at[k + 1]]]
            rows.append(np.concatenate((sum(path) / len(path), sum(word) / len(word) if word else np.zeros(H.VECTOR), f.numbers[k])))
        states = {}
        for d, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            h, c = [0.0] * H.HIDDEN, [0.0] * H.HIDDEN
            for k in order:
                z = rows[k] @ model.w[f"x{d}"] + np.array(h) @ model.w[f"h{d}"] + model.w[f"c{d}"]
                gate = lambda j: 1 / (1 + math.exp(-z[j]))  # noqa: B023, E731
                c = [gate(H.HIDDEN + j) * c[j] + gate(j) * math.tanh(z[3 * H.HIDDEN + j]) for j in range(H.HIDDEN)]
                h = [gate(2 * H.HIDDEN + j) * math.tanh(c[j]) for j in range(H.HIDDEN)]
                states[d, k] = h
        want += [1 / (1 + math.exp(-(np.concatenate((states["f", k], states["b", k], rows[k])) @ model.w["out"] + model.w["bias"][0]))) for k in range(len(page))]
    assert abs(got - np.array(want)).max() < 1e-9


def test_hidden_is_an_attribute():
    shown = ['class="col hidden md-block"', 'title="the hidden cave"', "data-x='style=\"display:none\"'", 'aria-hidden="false"', 'style="--display: none-x"']
    not_shown = ["hidden", 'class="a" HIDDEN=""', "hidden=until-found", 'style="color:red; display : none"', "style=display:none", "class='b'hidden"]
    assert [b.text for a in shown for b in blocks(f"<div {a}>yes</div>")] == ["yes"] * len(shown)
    marked = lambda a: ".hidden" in blocks(f"<div {a}>x</div>")[0].path
    assert all(map(marked, not_shown)) and sum(map(marked, shown)) == 1  # the first has a class of that name
