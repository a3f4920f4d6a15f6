"""Pages written by hand, not by the trainer: boxes next to short articles, bare pages, keys that must come back as they are."""

import ast
import itertools
from collections import Counter
from pathlib import Path

import pytest

import rillflow
from rillflow.llm import html_text

STORIES = [
    ["The harbour bridge was closed on Monday after an inspection.", "Engineers found rust in two of its cables and asked for time."],
    ["A short note.", "It has two parts, and the second is a little longer than the first one."],
    ["Rain fell for three days; the river rose by two metres, and the lower town was flooded.", "Nobody was hurt.", "Repairs will take until spring, the mayor said."],
]
LAYOUTS = ["<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>']
BOXES = [
    '<div class="comments"><p>Great post! I liked it a lot.</p></div>', '<section id="responses"><p>I do not agree with this at all, sorry.</p></section>', '<div id="comments"><p>First!</p><p>Second one here.</p></div>',
    '<div class="sidebar"><p>Read these other stories now.</p></div>', '<aside><p>From our archive: a day at the sea.</p></aside>', '<div class="related-posts"><p>See also this other story.</p></div>',
    '<div class="newsletter-signup"><p>Join our letter and get news every week.</p></div>', '<div id="cookie-banner"><p>We use cookies here. Accept them all.</p></div>', '<div class="advertisement"><p>Buy this now. It is cheap.</p></div>',
    '<footer><p>All rights are reserved by the paper.</p></footer>', '<div class="share"><a href="/f">Share this</a></div>', '<form><label>Name</label><textarea>Write here.</textarea><button>Send</button></form>',
]


@pytest.fixture(scope="module")
def field():
    return html_text.default_field()


def test_boxes_are_left_out_wherever_they_stand(field):
    pages = right = blocks = 0
    for story, layout, box in itertools.product(STORIES, LAYOUTS, BOXES):
        body = "".join(f"<p>{p}</p>" for p in story)
        for html in (layout.format(body) + box, box + layout.format(body), layout.format(body + box)):
            got, want = Counter(html_text.main_text(f"<html><head><title>T</title></head><body>{html}</body></html>", field).split("\n")), Counter(story)
            pages, blocks, right = pages + 1, blocks + (got | want).total(), right + (got & want).total()
    assert pages >= 300 and right >= 0.97 * blocks, (right, blocks)


@pytest.mark.parametrize("html, text", [("<body><p>One.</p></body>", "One."), ("Just bare text of a page.", "Just bare text of a page."), ("<p>One paragraph.</p><p>And two.</p>", "One paragraph.\nAnd two."), ("", ""), ("<body></body>", "")])
def test_bare_pages(field, html, text):
    assert html_text.main_text(html, field) == text


def test_keys_come_back_as_they_are(spark, field):
    big = 2**53
    rows = [(big + 1, "u1", "<p>One page.</p>"), (None, "u2", "<p>Two pages.</p>"), (big + 3, None, None), (big + 3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = html_text.extract(pages, field=field)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(big + 1, "u1", "One page."), (None, "u2", "Two pages."), (big + 3, None, ""), (big + 3, None, "")], key=repr)
    assert html_text.extract(pages.limit(0), field=field).collect() == []


def test_nothing_is_defined_twice():
    """A second definition of a name in a module or class hides the first."""
    for path in Path(rillflow.__file__).parent.rglob("*.py"):
        for scope in ast.walk(ast.parse(path.read_text())):
            if isinstance(scope, (ast.Module, ast.ClassDef)):
                names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
                assert not [n for n, k in names.items() if k > 1], path
