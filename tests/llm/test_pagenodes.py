import random
from collections import Counter

import pytest

from pagemill.llm import pagenodes
from pagemill.llm.htmlblocks import parse


@pytest.fixture(scope="module")
def trees():
    return pagenodes.fit()


def kinds(trees, page, chrome=()):
    nodes, blocks = parse(page)
    view = pagenodes.View(nodes, blocks, [b.norm in chrome for b in blocks])
    owner, found = pagenodes.decode(view, trees)
    return [(b.norm, found.get(owner[b.node], "text")) for b in blocks]


def test_held_out_pages(trees):
    rows, labels = pagenodes.examples(random.Random(4), 150)
    wrong = Counter((k, trees.predict(r)) for r, k in zip(rows, labels) if trees.predict(r) != k)
    assert len(rows) > 2000 and sum(wrong.values()) < 0.005 * len(rows)


def test_choices_never_contradict(trees):
    r = random.Random(6)
    for _ in range(60):
        nodes, blocks = parse(pagenodes.compose(r))
        owner, found = pagenodes.decode(pagenodes.View(nodes, blocks, [False] * len(blocks)), trees)
        for i in found:
            up = nodes[i].parent
            while up >= 0:
                assert found.get(up) not in ("code", "heading")
                up = nodes[up].parent


def test_look_alikes(trees):
    page = "<main><h2>Real head</h2><p><b>Bold line</b></p><p><code>run now</code></p><table><tr><th>Name</th></tr><tr><td>One cell</td></tr></table><dl><dt>Term</dt><dd>Meaning</dd></dl><ul><li><p>An item</p><pre>x = 1\ny = 2</pre></li></ul></main>"
    assert dict(kinds(trees, page)) == {"real head": "heading", "bold line": "text", "run now": "text", "name": "text", "one cell": "text", "term": "text", "meaning": "text", "an item": "item", "x = 1 y = 2": "code"}


def test_the_trees_decide(trees):
    page = "<main><h2>Head</h2><ul><li>Item words</li></ul><p>Text words here.</p></main>"
    none = pagenodes.Boosted(pagenodes.KINDS, [[] for _ in pagenodes.KINDS], [0.0, 0.0, 0.0, 1.0])
    assert {k for _, k in kinds(none, page)} == {"text"} != {k for _, k in kinds(trees, page)}
    assert kinds(trees, "") == [] and kinds(trees, "plain") == [("plain", "text")]


def test_many_rows_are_predicted_as_each_alone(trees):
    rows, _ = pagenodes.examples(random.Random(8), 40)
    alone = [pagenodes.KINDS[max(range(4), key=trees.scores(r).__getitem__)] for r in rows]
    trees.cache.clear()
    trees.learn(rows)
    assert [trees.cache[r] for r in rows] == alone
