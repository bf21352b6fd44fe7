"""Golden reports: bad markup, and the failed tests that a browser's tree of it has, worked out by hand."""

import pyarrow as pa
import pytest

from triagewright.sources import reports as R

ITEM = '<li class="test-item" status="fail" test-id="{}">'


def read(html):
    flat = lambda t: " ".join(t.split())
    return [(t["test_case_id"], flat(t["scenario_name"]), flat(t["failed_step_line"]), flat(t["error_message"]), t["failure_image"], [flat(s["text"]) for s in t["steps"]]) for t in R.failed_tests(html)]


def step(body, more=""):
    return ITEM.format("T") + '<div class="test-detail"><b class="name">n</b></div><div class="step fail-bg">' + body + "</div>" + more + "</li>"


@pytest.mark.parametrize(
    "body, line",
    [
        ("<p>one<p>two", "one two"),  # a paragraph ends another
        ("<b>one<p>two</b>three", "one twothree"),  # the paragraph goes on without b
        ("<script>if (a < b) { '<p>' }</script>go<style>p > b {}</style>", "go"),  # no text
        ("<div/>in</div>out", "in out"),  # a div isn't closed by its slash
        ("<span>one</div></span>two", "one"),  # ends the step: what follows is outside
        ("one</br>two", "one two"),
        ("one</p>two", "one two"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"),
        ("<td>a</td>b", "ab"),  # no table: no cell
        ("<select><option>a<option>b</select>", "ab"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"),
        ("<h2>a<h3>b</h2>c", "a b c"),
        ("x<b>y</i></b>z", "xyz"),
        ("<span><div>a</span>b</div></span>", "ab"),  # </span> in the div counts for nothing
        ("<em><span>a</em>b</span>", "a"),  # em takes the span with it
        ("a<!-- <b> -->b&amp;&lt;", "ab&<"),
    ],
)
def test_text_of_a_step(body, line):
    got = read("<!doctype html><ul>" + step(body) + "</ul>")
    assert [g[2] for g in got] == [line]


def test_items_end_where_they_should():
    # the div between doesn't keep the item open; a section does, so that the second test is inside the first and its step counts for both
    two = ITEM.format("A") + '<div class="step fail-bg">a<div>' + ITEM.format("B") + '<div class="step fail-bg">b</div></li>'
    assert [(g[0], g[5]) for g in read("<ul>" + two + "</ul>")] == [("A", ["a"]), ("B", ["b"])]
    inner = ITEM.format("A") + '<section><div class="step fail-bg">a</div>' + ITEM.format("B") + '<div class="step fail-bg">b</div></section>'
    assert [(g[0], g[5]) for g in read("<ul>" + inner + "</ul>")] == [("A", ["a", "b"]), ("B", ["b"])]
    listed = ITEM.format("A") + '<ol><li class="step pass-bg">a<li class="step fail-bg">b</ol></li></ul></li>' + ITEM.format("B") + '<p class="step error-bg">c<p class="step info">d'
    assert [(g[0], g[2], g[5]) for g in read("<ul>" + listed)] == [("A", "b", ["a", "b"]), ("B", "c", ["c", "d"])]


def test_name_ends_where_a_block_began_in_it():
    html = ITEM.format("A") + '<div class="test-detail"><b class="name">one<p>two</b>three</p></div><p class="step fail-bg">x</li>'
    assert read(html)[0][:3] == ("A", "one", "x")


def test_formatting_is_opened_again():
    # the anchor of the first step isn't closed, so it is there again in the second, under the same part
    html = '<div class="screenshots"><ul>' + ITEM.format("A") + '<p class="step pass-bg"><a href="s.png">one<p class="step fail-bg">two</ul></div>'
    assert read(html)[0][4] == ""  # the part is outside of the step: not looked at
    html = ITEM.format("A") + '<div class="step fail-bg"><p><a class="screenshots" href="s.png">one</p><p>two</p></div></li>'
    assert read(html)[0][2] == "one two"
    html = ITEM.format("A") + '<div class="step pass-bg"><a href="s.png">one</div><div class="step fail-bg"><div class="screenshots">two</div></div></li>'
    assert read(html)[0][4] == "s.png"
    html = html.replace("one</div>", "one</a></div>")
    assert read(html)[0][4] == ""
    cell = ITEM.format("A") + '<table><tr><td><a href="s.png">one<td class="step fail-bg"><div class="screenshots">two</div></table></li>'
    assert read(cell)[0][4] == ""  # a cell keeps its own


def test_areas_hold_text():
    html = step('<span>go</span><textarea class="code-block">E: List<String> &lt;b&gt; </div>\n at x</textarea>')
    assert read(html)[0][3] == "E: List<String> <b> </div> at x"


def test_tables_and_paragraphs_by_doctype():
    html = step("x", '<p class="step info">a<table><tr><td>b</table>c')
    assert read(html)[0][5] == ["x", "a b c"] and read("<!DOCTYPE html>" + html)[0][5] == ["x", "a"]


@pytest.mark.parametrize("html", ["", "<", "</", "<li", "<b><i></b></i>", "</table></td></li>", "<a><a><a>", "<table><a><td></a><table></td>", "<nobr><nobr>", "<p></p></p><br></br><button><button>", "<b>" * 3000 + "<p>" * 50 + "</b>" * 3000 + "x"])
def test_odd_pages(html):
    assert read(html) == [] and read(html + "</b></p></table></button></a>" + "<ul>" + step("x")) != []


def test_pages_in_pieces_are_read_as_whole_ones(monkeypatch):
    """Wherever a page is cut, and however much a reader takes at a time, also inside characters, tags, comments and areas; tests are told once nothing can change them."""
    page = "<!doctype html><ul>" + step("<b>é &amp; one<p>two</b>&lt;x") + step('<!-- <li> --><textarea class="code-block">E: <b> &amp; \n</textarea>', "<section>") + ITEM.format("A") + '<section><div class="step fail-bg">a</div>' + ITEM.format("B") + '<div class="step error-bg">b</div></section>' + step("<script>if (a < b) {}</script>last") * 3
    want, data = list(R.failed_tests(page)), page.encode()
    assert len(want) > 5
    for chunk in (1, 7, 1 << 16):
        monkeypatch.setattr(R, "CHUNK", chunk)
        for size in (1, 2, 5, 31, 200):
            batches = [pa.RecordBatch.from_pylist([{"report_id": r, "first": i == 0, "piece": data[i : i + size]} for r in ("x", "x", "y") for i in range(0, len(data), size)])]
            got = [t for b in R.read_pages(batches) for t in b.to_pylist()]
            assert [(t.pop("report_id"), t.pop("failure_idx")) for t in got] == [(r, i) for r in ("x", "x", "y") for i in range(len(want))] and got == want * 3


def test_a_long_page_is_held_in_parts_alone():
    """Tests are given as the page goes by, and what the reader keeps doesn't grow with the page."""
    one, reader, most, told = step("x" * 500).encode(), R.Reader(), 0, 0
    for _ in range(5_000):
        reader.add(one)
        told += len(reader.done())
        most = max(most, reader.length + len(reader.rawdata) + len(reader.tests))
    assert told > 4_500 and most < 2 * R.CHUNK and told + len(reader.last()) == 5_000
