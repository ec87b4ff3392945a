"""Content marginals against enumeration; pages by hand."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from pulselake.llm import html_content
from pulselake.llm.queries import QUERIES

MODEL = html_content.default_model()


def test_marginals_by_enumeration():
    page = html_content.read_page("<body><div><p>a</p><p>b</p></div><ul><li>c<li>d</ul></body>")
    trees = html_content.forest([page, html_content.read_page("<p>x")])
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(len(trees.parents), 2)), rng.normal(size=(2, 2, 2))
    got, joint = html_content.messages(trees, unary, pair)
    n = len(page.tags)
    total, marginal, pairs = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for states in itertools.product((0, 1), repeat=n):
        log = sum(unary[i, s] for i, s in enumerate(states))
        log += sum(pair[trees.under_root[i], states[trees.parents[i]], states[i]] for i in range(1, n))
        weight = np.exp(log)
        total += weight
        for i, s in enumerate(states):
            marginal[i, s] += weight
            if i:
                pairs[i, states[trees.parents[i]], s] += weight
    assert np.allclose(got[:n], marginal / total)
    assert np.allclose(joint[1:n], pairs[1:] / total)


def test_held_out_pages():
    wrong = total = 0
    for source in html_content.labelled_pages(100, seed=77):
        page = html_content.read_page(source)
        truth, found = html_content.labels(page), MODEL.marginals(html_content.forest([page])) >= 0.5
        own = {node for node, _ in page.segments}
        wrong += sum(truth[i] != found[i] for i in own)
        total += len(own)
    assert wrong / total < 0.03


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("<script>var a = '<p>no</p>';</script>", ""),
        ("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n  two&nbsp;three.</p><p>Four <b>five</b>.<br><p>Six.</article>"
         "<footer>&copy; someone</footer>", "A & B\nOne two three.\nFour five.\nSix."),
        ("<body><div class='ad'>Buy this now.</div><article><p>It was a long day, and it went on. Nobody left.</p>"
         "<div class=\"comments\"><p>Nice one!</p></div></article>", "It was a long day, and it went on. Nobody left."),
    ],
)
def test_pages(source, text):
    assert html_content.texts([source or ""], MODEL) == [text]


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>Some text is here, and more of it.</p>"
    long = "<article>" + "<p>One sentence after another. It is long.</p>" * 5000 + "</article>"
    found = html_content.texts([deep, long], MODEL)
    assert found[1].count("\n") == 4999


def naive_stack(events):
    """Parents of the opened elements, by walking the whole stack for each event."""
    stack, tags, parents = [0], ["html"], [-1]
    for ending, name in events:
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    del stack[k:]
                    break
            continue
        if tags[stack[-1]] in ("p", "h2"):
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if tags[stack[k]] in html_content.ENDS_OWN_KIND.get(name, ()):
                del stack[k:]
                break
            if tags[stack[k]] in html_content.SCOPES:
                break
        tags.append(name)
        parents.append(stack[-1])
        stack.append(len(tags) - 1)
    return tags, parents


def test_tree_as_by_walking_the_stack():
    rng = random.Random(5)
    for _ in range(300):
        events = [(rng.random() < 0.45, rng.choice(["div", "p", "li", "ul", "td", "tr", "table", "h2", "dd", "dt", "blockquote"])) for _ in range(60)]
        page = html_content.read_page("".join(f"<{'/' * e}{n}>t" for e, n in events))
        assert (page.tags, page.parents) == naive_stack(events)


@pytest.mark.parametrize(
    "source",
    ["<div>" * 100_000 + "</p>" * 100_000, "<blockquote>" * 50_000 + "<li>a" * 50_000, "x<a" * 300_000, "<ul><li>" * 50_000 + "</td>" * 50_000],
)
def test_pages_are_read_in_linear_time(source):
    before = time.process_time()
    html_content.read_page(source)
    assert time.process_time() - before < 5


@pytest.mark.parametrize(
    ("tail", "text"),
    [("One <b", "One <b"), ("One <!-- two", "One"), ("One <!-- two > three", "One"), ("One <? x", "One"), ("a < b", "a < b"), ("One <![CDATA[ x > y ]] z", "One")],
)
def test_open_ends(tail, text):
    assert " ".join(t for _, t in html_content.read_page("<p>" + tail).segments) == text


def test_blocks_that_are_left_to_the_model():
    long = "It was a long day, and it went on for many hours. Nobody left the house before the evening."
    page = f"<article><h1>A day</h1><p>{long}</p><noscript><p>{long} Again.</p></noscript><p>{long} So <math><mi>x</mi> = 2</math>.</p><svg><text>no</text></svg></article>"
    assert html_content.texts([page], MODEL) == [f"A day\n{long}\n{long} Again.\n{long} So x = 2."]


def test_query(spark, sf, read):
    got = {r.page_id: r for r in QUERIES["op7_html_content"](spark, sf).collect()}
    pages = {r.page_id: r for r in read("pages").collect()}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r.n_chars == len(r.text) and r.url == pages[i].url
        body = pages[i].html.split("<article>")[1].split("</article>")[0]
        assert r.text.startswith(html.unescape(body.split("<h1>")[1].split("</h1>")[0]).strip()[:40])
        blocks = [html.unescape(re.sub(r"<script.*?</script>|<[^>]*>", " ", b, flags=re.S)) for b in re.split(r"</h1>|</p>", body)]
        assert "".join(r.text.split()) == "".join("".join(blocks).split())
        assert "track(" not in r.text and "example.com &middot;" not in r.text


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<article><p>Words are here. And here.</p></article>", "y")], "page_id int, url string, html string, text string")
    assert [tuple(r) for r in html_content.extract(df).collect()] == [(None, None, "", 0), (1, "u", "Words are here. And here.", 25)]
    assert html_content.extract(df.limit(0)).count() == 0
