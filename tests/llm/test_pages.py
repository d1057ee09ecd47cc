"""Visible text in drawings, formulas, objects and the sections of tables."""

import pytest

from curbflow.llm import html_text


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math> z", "y z"),
        ("<svg><title>no</title><desc>no</desc><metadata>no</metadata><text>one</text><text>two</text></svg> z", "one two z"),
        ("<svg><path d='m 0'/><desc/><title/><style>no</style><text x=1>one</text></svg> z", "one z"),
        ("<object data=f><param name=a>instead</object> z", "instead z"),
        ("<desc>yes</desc>", "yes"), ("<svg><text hidden>no</text></svg>z", "z"),
        ("<table><tbody>note<tr><td>x</table>", "note\nx"), ("<table>note<tr><td>x</table>", "note\nx"),
        ("<table><thead>a<tr><td>x<tfoot>b<tr><td>y</table>", "a b\nx\ny"),
        ("<table><tbody hidden>no<tr><td>no<tbody>b<tr><td>y</table>", "b\ny"),
    ],
)
def test_visible_text(page, wanted):
    assert html_text.visible_text(page) == wanted
