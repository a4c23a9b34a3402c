"""Small inputs for every cleaning step with the result that is expected: (name, function, input, result)."""

from __future__ import annotations

from .model import PROFILES, profile
from .operators import clean, markdown
from .operators.convert import to_markdown
from .operators.dom import parse


def _step(*names: str, framework: str = "generic"):
    """Run the named steps alone and show the tree, or the text once it is converted."""

    def run(page: str) -> str:
        w = clean.Work(page, profile(framework), None, parse(page))
        for n in names:
            clean.STEPS[n](w)
        return w.text or w.tree.html()

    return run


def _lines(f, *args):
    return lambda s: "\n".join(f(s.split("\n"), *args))


def _only(name: str):
    return lambda s: markdown.overrides(s, name)


CASES = [
    ("main_content", _step("main_content"), "<body><div class=content>no</div><main><p>yes</p></main></body>", "<main><p>yes</p></main>"),
    ("nav_remnants", _step("nav_remnants"), "<div><nav>a</nav>tail<p>b</p></div>", "<div>tail<p>b</p></div>"),
    ("boilerplate", _step("boilerplate"), '<p title="Feedback x">Was this helpful? Yes</p>', '<p title=" x"> Yes</p>'),
    ("scripts", _step("scripts"), "<div><script>if (a < b) {}</script>x<button>b</button><title>t</title></div>", "<div>x</div>"),
    (
        "tab_content", _step("tab_content"),
        '<ul class="nav-tabs"><li><a class="nav-link">Linux</a></li><li><a class="nav-link">Mac</a></li></ul><div class="tab-content"><div class="tab-pane">a</div><div class="tab-pane">b</div></div>',
        '<div class="tab-content"><div class="tab-pane"><p><strong>Linux:</strong></p>a</div><div class="tab-pane"><p><strong>Mac:</strong></p>b</div></div>',
    ),
    (
        "line_numbers", _step("line_numbers"),
        '<div class="language-py"><table class="code-block-line-group"><tr><td class="gutter">1</td><td>if a:</td></tr><tr><td class="gutter">2</td><td>    b</td></tr></table></div><pre> </pre>',
        '<div class="language-py"><pre class="code-block-line-group language-py"><code class="language-py">if a:\n    b</code></pre></div>',
    ),
    ("code_labels", _step("remove_code_lang_labels"), '<div><span class="code-language-label">bash</span>x</div>', "<div>x</div>"),
    ("block_in_cell", _step("flatten_block_in_cells"), "<table><tr><td><pre>a\n  b</pre></td></tr></table>", "<table><tr><td><code>a b</code></td></tr></table>"),
    ("cell_pipes", _step("escape_cell_pipes_html"), "<table><tr><td>a|b <code>c|d</code> e|f</td></tr></table>", "<table><tr><td>a\\|b <code>c|d</code> e\\|f</td></tr></table>"),
    ("nested_table", _step("flatten_nested_tables"), "<table><tr><td><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></td></tr></table>", "<table><tr><td><span>a b; c</span></td></tr></table>"),
    ("code_round_trip", _step("protect_code", "html_to_md", "restore_code"), '<p>x_y</p><pre><code class="language-bash">$ ls _a_</code></pre><p>z</p>', "x\\_y\n\n```bash\nls _a_\n```\n\nz"),
    ("code_in_list", _step("protect_code", "html_to_md", "restore_code"), "<ol><li>one<pre>a</pre></li></ol>", "1. one\n\n```\na\n```"),
    ("code_with_fence", _step("protect_code", "html_to_md", "restore_code"), "<pre>```\nq\n```</pre>", "~~~\n```\nq\n```\n~~~"),
    ("code_lines", _step("protect_code", "html_to_md", "restore_code"), "<pre><code><span>a</span><span>b</span></code></pre>", "```\na\nb\n```"),
    ("code_breaks", _step("protect_code", "html_to_md", "restore_code"), "<pre><code>a<br>b &lt;c&gt;</code></pre>", "```\na\nb <c>\n```"),
    ("code_inline", _step("protect_code", "html_to_md", "restore_code"), "<p>run <code>a_b</code></p>", "run `a_b`"),
    ("convert", lambda s: to_markdown(parse(s)), "<h2>T</h2><p>a <b>b</b> <a href=/x>c</a></p><ul><li>d<li>e</ul><table><tr><th>f</th><td>g</td></tr></table>", "## T\n\na **b** [c](/x)\n\n- d\n- e\n\n| f | g |\n| --- | --- |"),
    ("copy_image", _only("copy_image"), "a ![x](/img/copycode.svg) b", "a  b"),
    ("feedback", _only("feedback"), "a\n## Feedback\nYes\nNo\nmore\n## B\nb", "a\n\n## B\nb"),
    ("notes", _only("notes"), "#### Note\nbody\n```\n#### Note\n```", "> **Note:**body\n```\n#### Note\n```"),
    ("feature_state", _only("feature_state"), "FEATURE STATE:\nbeta", "> **FEATURE STATE:** beta"),
    ("emoji", _only("emoji"), "a\U0001f680b\n```\n\U0001f680\n```", "ab\n```\n\U0001f680\n```"),
    ("anchors", _only("anchors"), "## T[#](#t)", "## T"),
    ("toc_heading", _only("toc_heading"), "a\n## On this page\n- x\n## B", "a\n\n## B"),
    ("toc_plain", _only("toc_plain"), "On this page\n- x\n\n# B", "# B"),
    ("unescape", markdown.unescape_fences, "a\\_b\n```\nc\\_d\n```", "a\\_b\n```\nc_d\n```"),
    ("cards", markdown.card_tables, 'a<table data-view="cards"><tr></tr></table>b', "ab"),
    ("strip_sections", _lines(markdown.strip_sections, PROFILES["gitbook"].markdown_strip_headings), "# A\n## Agent Instructions\nx\n### y\n## B", "# A\n## B"),
    ("layout_tags", _lines(markdown.layout_tags), '{% tabs %}\na\n{% code title="x" %}\nb\n{% endcode %}\n{% unknown %}', "a\n```\nb\n```\n{% unknown %}"),
    ("md_link", markdown.md_links, "[a](x/y.md#z) [b](q.md)", "[a](x/y#z) [b](q)"),
    ("blank_runs", _lines(markdown.blank_runs), "a\n\n\n\nb", "a\n\n\nb"),
    ("literal_escapes", _lines(markdown.literal_escapes), "a\\nb\\_c\n```\nd\\_e\n```", "a\nb_c\n```\nd\\_e\n```"),
    ("normalize", lambda s: markdown.normalize(s, PROFILES["gitbook"]), "# T\r\n> Last updated 1 day ago\r\n\r\ntext  \r\n", "# T\n\ntext\n"),
]

#: (name, reply, passed, score, whether it is a navigation tree)
LLM_REPLIES = [
    ("plain", '{"passed": true, "score": 0.9, "reason": "ok"}', True, 0.9, False),
    ("fenced", '```json\n{"passed": false, "score": 0.2}\n```', False, 0.2, False),
    ("prose", 'Sure: {"passed": true} done', True, 0.5, False),
    ("missing", '{"score": 1}', None, None, False),
    ("empty", "", None, None, False),
    ("broken", '{"passed": tru', None, None, False),
    ("tree", '```\n{"sections": [{"title": "a"}]}\n```', None, None, True),
    ("not_a_list", '{"sections": 3}', None, None, False),
]
