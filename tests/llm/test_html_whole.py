"""Text that a reader sees in unusual places of a page."""

import pytest
from factloom.llm import html_layout

TABLES = [
    ("<table><tr><form><td>X</td></form></tr></table>", "X"),
    ("<table><tr><td>1<td>2</tr><tr><form><td>3</td><td>4</td></form></tr></table>", "1 | 2\n3 | 4"),
    ("<table><tr><div>text</div></tr></table>", "text"),
    ("<table><tr><a>link</a><td>X</td>after</tr></table>", "linkafter\nX"),
    ("<table><form><tr><td>1<td>2</tr></form></table>", "1 | 2"),
    ("<table><tr><td>1</td><div hidden><td>no</td></div></tr></table>", "1"),
    ("<table><tr><div><table><tr><td>in</table></div><td>X</table>", "in\n\nX"),
]


@pytest.mark.parametrize(("page", "text"), TABLES)
def test_all_children_of_a_row(page, text):
    assert html_layout.render(page) == text


SEEN = [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b", "a x= 1 2 b"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>A<tspan>b</tspan></text><g><text>C</text><text display=none>no</text></g>no</svg>d", "Ab C d"),
    ("<svg><title/><defs/><text>A</text><foreignObject><p>B</p></foreignObject></svg>", "A\n\nB"),
    ("<select><optgroup label=G><option>a<option>b<optgroup label=H><option label=c>no</select>", "G a b H c"),
    ("say <textarea>it &amp; that</textarea>now", "say it & that now"),
    ("<textarea>\none\n  two</textarea>", "one\n  two"),
    ("<object data=x><p>instead</p></object>", "instead"),
    ("<pre>a <svg><title>no</title><text>B</text></svg></pre>", "a B"),
    ("<a href=x/>link</a> <p/>on", "link\n\non"),
]


@pytest.mark.parametrize(("page", "text"), SEEN)
def test_elements_that_are_seen(page, text):
    assert html_layout.render(page) == text
