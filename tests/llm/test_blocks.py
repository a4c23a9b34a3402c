from pagemill.llm.htmlblocks import key64, norm, parse, text_blocks


def test_blocks_follow_the_definition():
    page = "<!DOCTYPE html><head><title>t</title></head><body><!-- <p>x</p> --><p>a <b>b</b><br>c &amp; d</p><div>e<script>'<p>f</p>'</script>g</div><noscript>n</noscript><svg><text>s</text></svg><button>h</button></body>"
    want = ["a b c & d", "e", "g", "h"]
    assert [" ".join(t.split()) for t in text_blocks(page)] == want
    assert [" ".join(b.text.split()) for b in parse(page)[1]] == want


def test_empty_inputs():
    for page in (None, "", "   ", "<p></p>", "<"):
        assert [t for t in text_blocks(page) if t != "<"] == []
    assert text_blocks("a < b") == ["a < b"]


def test_open_tags_and_quotes():
    nodes, blocks = parse('<ul><li>a<li title="x > y">b</ul><p>c<p>d<div>e')
    assert [b.text for b in blocks] == ["a", "b", "c", "d", "e"]
    assert [nodes[b.node].tag for b in blocks] == ["li", "li", "p", "p", "div"]


def test_key_is_the_md5_of_the_normal_form():
    import hashlib

    t = " A 　B\r\n c "
    assert norm(t) == "a b c"
    assert format(key64(t) & (1 << 64) - 1, "016x") == hashlib.md5(b"a b c").hexdigest()[:16]


def test_very_long_page_is_linear():
    assert len(text_blocks("<p>x</p>" * 100_000)) == 100_000
    assert len(text_blocks("<" * 200_000)) <= 1
