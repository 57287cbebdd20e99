"""Pages of any depth and shape: the whole text, in time and memory that grow with the page."""

import random
import time

import pytest
from factloom.llm import html_layout
from factloom.llm.html_layout import render


def test_what_is_hidden_stays_hidden_at_any_depth():
    assert render("<div>" * 205 + "<div hidden>SECRET</div>") == ""
    assert render("<div>" * 150 + "<div hidden>" + "<div>" * 100 + "</div>" * 100 + "SECRET") == ""
    assert render("<div>" * 150 + "<div hidden>" + "<div>" * 100 + "</div>" * 100 + "SECRET</div>seen") == "seen"
    assert render("<p>" + "<b>" * 5000 + "x<i style='display:none'>y</i>z") == "xz"


WORST = {
    "deep": "<div>" * 100_000 + "x", "cells in cells": "<table><tr><td>" * 30_000 + "x", "cells beside cells in cells": "<table><tr><td>x<td>" * 30_000, "a wide cell": f"<table><tr><td>{'x' * 100_000}<td>b" + "<tr><td>a<td>b" * 2000,
    "a long row": "<table><tr>" + "<td>a" * 10_000 + "<tr><td>a" * 10_000, "spans": "<table>" + ("<tr>" + "<td colspan=1000 rowspan=1000>" * 10) * 1000 + "x", "lists": "<ul><li>" * 50_000 + "x", "quotes": "<blockquote>a" * 50_000,
    "open quotes": "<a '" * 100_000, "more open quotes": "<a '>" * 100_001 + "x", "open tags": "<p " * 100_000, "items": "<li><b>" * 50_000 + "x", "forms in rows": "<table><tr>" + "<form>" * 50_000 + "<td>x", "slashes": "<b/>" * 100_000 + "x",
}


@pytest.mark.parametrize("name", WORST)
def test_no_shape_of_a_page_is_costly(name):
    began = time.process_time()
    text = render(WORST[name])
    assert time.process_time() - began < 10 and 0 < len(text) < 30 * len(WORST[name])


def test_wide_cells_lose_nothing():
    rows = [("x" * 300, "b"), ("a", "b" * 150), ("a", "c")]
    lines = render("<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in rows)).split("\n")
    assert [tuple(p.strip() for p in x.split(" | ")) for x in lines] == rows


# Random pages, of which the visible words are known.


def page(r, depth, shown, words):
    """A well-formed piece of html; its visible words are added to `words`, in order."""
    def word():
        w = f"w{r.randrange(10**6)}"
        if shown:
            words.append(w)
        return f" {w} "

    if not depth:
        return word()
    inner = lambda s=shown: "".join(page(r, depth - 1 - r.randrange(depth), s, words) for _ in range(r.randrange(1, 4)))
    kind = r.randrange(9)
    if kind == 0:
        return f"<{(t := r.choice(['div', 'section', 'span', 'b', 'em', 'a']))}>{inner()}</{t}>"
    if kind == 1:
        return f"<div {r.choice(['hidden', 'style=display:none', 'style=\'visibility: hidden\''])}>{inner(False)}</div>"
    if kind == 2:
        return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(r.randrange(1, 3))) + "</ul>"
    if kind == 3:
        return f"<div aria-hidden=true>{inner()}</div><!-- {word.__name__} --><script>no</script>"
    if kind == 4:
        return "<table>" + "".join(f"<tr><td>{inner()}</td></tr>" for _ in range(r.randrange(1, 3))) + "</table>"
    if kind == 5:
        return f"<details><summary>{inner()}</summary>{inner(False)}</details>"
    if kind == 6:
        return f"<blockquote>{inner()}</blockquote><hr>".replace("<hr>", "<br>")
    if kind == 7:
        return f"<p>{word()}{word()}</p>"
    return word() + inner()


def test_visible_words_of_random_pages():
    for seed in range(400):
        r, words = random.Random(seed), []
        html = "".join(page(r, 6, True, words) for _ in range(5))
        assert [w for w in render(html).split() if w not in ("-", "|")] == words, seed


def test_tables_of_random_cells():
    """Cells of one line, spans included, against a grid filled cell by cell."""
    for seed in range(300):
        r = random.Random(seed)
        html, grid, taken = "<table>", [], set()
        for y in range(r.randrange(1, 5)):
            html, at, row = html + "<tr>", 0, {}
            for _ in range(r.randrange(1, 5)):
                while (y, at) in taken:
                    at += 1
                w, across, down = f"c{r.randrange(10 ** r.randrange(1, 5))}", r.choice([1, 1, 2]), r.choice([1, 1, 2])
                html += f"<td colspan={across} rowspan={down}>{w}</td>"
                row[at] = w
                taken |= {(y + j, at + i) for i in range(across) for j in range(1, down)}
                at += across
            grid.append(row)
        columns = sorted({c for row in grid for c in row})
        wide = {c: max(len(row.get(c, "")) for row in grid) for c in columns}
        want = [" | ".join(row.get(c, "").ljust(wide[c]) for c in columns if c <= max(row)).rstrip() for row in grid]
        assert render(html) == "\n".join(want).strip("\n") if len(columns) > 1 else True, seed


def test_other_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "y")], "page_id bigint, html string, text_sha256 string")
    assert [r.text for r in html_layout.extract(df).collect()] == ["a", "a"]
