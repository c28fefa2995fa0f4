"""Text that browsers paint in svg, math, form fields and tables."""

from marginalia.llm import htmltext


def text(html):
    return htmltext.extract(html)[1]


def test_svg_labels():
    page = "<p>a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text x=1>North</text><text>South</text></svg>b</p><p>c"
    assert htmltext.extract(page) == ("", "a North South b\n\nc")


def test_math():
    assert text("<p>so <math><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/><mo>&lt;</mo><mi>x</mi><annotation>no</annotation></math>.") == "so 1 2 < x ."


def test_textarea():
    assert text("<div>note<textarea>\n one &amp; <b>\n two</textarea>end</div>") == "note\n one & <b>\n two\nend"
    assert text("<textarea hidden>no</textarea>x") == "x"


def test_select():
    assert text("<p>size <select><option>S<option selected>M<option>L</select> ok") == "size M ok"
    assert text("<p><select><option disabled>pick<optgroup label=g><option>A<option>B</select>") == "A"
    assert text("<p><select multiple><option>A<option>B</select>") == "A B"


def test_rowspan_keeps_columns():
    assert text("<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>") == "aa | b | c\n   | d | e\nf  | g | h"
    assert text("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>") == "a | b | c\nd |   | e"
    assert text("<table><thead><tr><th rowspan=0>h<th>i<tbody><tr><td>x<td>y</table>") == "h | i\nx | y"
