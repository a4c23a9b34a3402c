import sys

from pagemill.llm.htmlblocks import parse, text_blocks


def calls(page):
    """Calls into C that reading a page takes, as a measure that doesn't depend on the machine."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "c_call"

    sys.setprofile(count)
    try:
        parse(page)
    finally:
        sys.setprofile(None)
    return n


def test_a_tag_takes_few_calls():
    tag = "<section class='a'><ul><li>one <b>two</b></li><li>three</li></ul></section>"
    page = f"<body><main>{tag * 200}</main></body>"
    parse(page)  # classes are known then
    per_tag = (calls(page) - calls(f"<body><main>{tag * 100}</main></body>")) / (100 * tag.count("<"))
    assert per_tag < 7


def test_open_paragraphs_and_items_end_where_they_did():
    page = "a<div>b<p>c<ul><li>d<p>e<li>f</ul>g</div>h</p><table><tr><td>i<p>j<td>k<tr><td>l</table></#root>m"
    nodes, blocks = parse(page)
    assert [b.text for b in blocks] == text_blocks(page)
    assert [(b.text, nodes[b.node].tag, nodes[nodes[b.node].parent].tag if b.node else "") for b in blocks] == [
        ("a", "#root", ""), ("b", "div", "#root"), ("c", "p", "div"), ("d", "li", "ul"), ("e", "p", "li"), ("f", "li", "ul"), ("g", "div", "#root"), ("h", "#root", ""),
        ("i", "td", "tr"), ("j", "p", "td"), ("k", "td", "tr"), ("l", "td", "tr"), ("</#root>m", "#root", ""),
    ]
