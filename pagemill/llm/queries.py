"""The registered queries of the llm subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import copies, leakage, markup, mixing, residue, sentences, sitelines, template


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "page_records"))


def p1_hot(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with every group of more than three records on the salted two-level way."""
    return copies.copies(table(spark, d, "page_records"), hot=3, salts=4)


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "page_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return template.body_keys(table(spark, d, "raw_html"))


def p2_template(spark: SparkSession, d: str) -> DataFrame:
    return template.template_classes(table(spark, d, "raw_html"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_files(table(spark, d, "raw_html"), table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.excessive(table(spark, d, "raw_html"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.blocks(table(spark, d, "raw_html"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.without_excessive(table(spark, d, "raw_html"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.structure(table(spark, d, "raw_md"), table(spark, d, "raw_html"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_text(table(spark, d, "raw_md"), table(spark, d, "raw_html"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checked(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_hot, p1_collapsed, p2_found, p2_template, p3_found, p4_found, p4_cleaned, p4_blocks, p5_found, p5_text, p6_found, p6_cleaned, p7_mixture, p7_shares, p7_checked, p8_found]
    return {f.__name__: f for f in found}


# A record's page state: whitespace, case and punctuation gone, the fields of the query (between & or ;) in order.
_BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
_CANON = rf"""
  SELECT record_id, {_BARE.format("head")} || '?' || {_BARE.format("tail")} || '?' || coalesce((SELECT string_agg(f, '&' ORDER BY f) FROM (SELECT {_BARE.format("unnest(regexp_split_to_array(fields, '&amp;|&|;'))")} AS f) WHERE f <> ''), '') AS u, {_BARE.format("coalesce(content_hash, '')")} AS c
  FROM (SELECT record_id, content_hash, regexp_extract(a, '^([^?]*)', 1) AS head, regexp_extract(a, '^[^?]*[?]([^#]*)', 1) AS fields, regexp_extract(a, '^[^?]*[?][^#]*#((?s).*)', 1) AS tail FROM (SELECT record_id, content_hash, coalesce(url, '') AS a FROM page_records))"""

# Text blocks in SQL: skipped elements separate, inline tags vanish, br is a blank, references are decoded.
_SKIPPED = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("head", "script", "style", "noscript", "template", "svg"))
_INLINE = "a|abbr|b|code|em|i|kbd|mark|small|span|strong|sub|sup|u|button|label|img"
_WS = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DECODED = "array_to_string(list_transform(string_split(part, '&#'), lambda x, k: CASE WHEN k > 1 AND regexp_matches(x, '^[0-9]+;') THEN chr(regexp_extract(x, '^([0-9]+);', 1)::INT) || regexp_replace(x, '^[0-9]+;', '') WHEN k > 1 THEN '&#' || x ELSE x END), '')"
for _name, _char in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("copy", "chr(169)"), ("laquo", "chr(171)"), ("raquo", "chr(187)"), ("amp", "'&'")):
    _DECODED = f"replace({_DECODED}, '&{_name};', {_char})"
_BLOCKS = rf"""t AS (SELECT raw_html_path, site_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<[!?][^>]*>', '', 'g'), '(?is){_SKIPPED}', '<p>', 'g'), '(?i)</?({_INLINE})(\s[^>]*|/)?>', '', 'g'), '(?i)</?br(\s[^>]*|/)?>', ' ', 'g') AS h FROM raw_html),
p AS (SELECT raw_html_path, site_name, unnest(regexp_split_to_array(h, '</?[a-zA-Z][^>]*>')) AS part FROM t),
l AS (SELECT DISTINCT raw_html_path, site_name, substr(md5(trim(regexp_replace(lower({_DECODED}), '{_WS}+', ' ', 'g'), ' ')), 1, 16) AS line_key FROM p WHERE trim(regexp_replace({_DECODED}, '{_WS}+', ' ', 'g'), ' ') <> '')"""

# Runs of 12 words of documents and test items.
_GRAMS = r"""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
bg AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b))"""


def oracle_sql() -> dict[str, str]:
    pairs = f"""WITH k AS ({_CANON}), g AS (SELECT u, c, min(record_id) AS a FROM k WHERE c <> '' GROUP BY u, c)
SELECT g.a AS record_id_a, k.record_id AS record_id_b FROM k JOIN g USING (u, c) WHERE k.record_id <> g.a"""
    return {
        "p1_found": pairs,
        "p1_hot": pairs,
        "p1_collapsed": f"""WITH k AS ({_CANON})
SELECT min(record_id) AS record_id, count(*) AS copies FROM k WHERE c <> '' GROUP BY u, c
UNION ALL SELECT record_id, 1 FROM k WHERE c = ''""",
        "p4_found": f"""WITH {_BLOCKS}, n AS (SELECT site_name, count(*) AS total FROM raw_html GROUP BY 1),
k AS (SELECT site_name, line_key FROM l JOIN n USING (site_name) GROUP BY site_name, line_key, total HAVING count(*) >= 5 AND count(*) >= 0.12 * total)
SELECT raw_html_path, line_key FROM l JOIN k USING (site_name, line_key)""",
        "p4_cleaned": f"""WITH {_BLOCKS}, n AS (SELECT site_name, count(*) AS total FROM raw_html GROUP BY 1),
k AS (SELECT site_name, line_key FROM l JOIN n USING (site_name) GROUP BY site_name, line_key, total HAVING count(*) >= 5 AND count(*) >= 0.12 * total),
o AS (SELECT raw_html_path, site_name, unnest(regexp_split_to_array(h, '</?[a-zA-Z][^>]*>')) AS part, generate_subscripts(regexp_split_to_array(h, '</?[a-zA-Z][^>]*>'), 1) AS pos FROM t),
w AS (SELECT raw_html_path, site_name, pos, trim(regexp_replace({_DECODED}, '{_WS}+', ' ', 'g'), ' ') AS line FROM o),
m AS (SELECT w.*, k.line_key IS NOT NULL AS bad FROM w LEFT JOIN k ON k.site_name = w.site_name AND k.line_key = substr(md5(lower(line)), 1, 16) WHERE line <> '')
SELECT r.raw_html_path, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text, count(*) FILTER (bad) AS lines_removed FROM raw_html r LEFT JOIN m USING (raw_html_path) GROUP BY 1""",
        "p4_blocks": f"""WITH RECURSIVE {_BLOCKS}, n AS (SELECT site_name, count(*) AS total FROM raw_html GROUP BY 1),
k AS (SELECT site_name, line_key, greatest(5, 0.12 * any_value(total)) AS least FROM l JOIN n USING (site_name) GROUP BY site_name, line_key, total HAVING count(*) >= 5 AND count(*) >= 0.12 * total),
o AS (SELECT raw_html_path, site_name, unnest(regexp_split_to_array(h, '</?[a-zA-Z][^>]*>')) AS part, generate_subscripts(regexp_split_to_array(h, '</?[a-zA-Z][^>]*>'), 1) AS pos FROM t),
w AS (SELECT raw_html_path, site_name, row_number() OVER (PARTITION BY raw_html_path ORDER BY pos) AS pos, substr(md5(lower(line)), 1, 16) AS line_key FROM (SELECT *, trim(regexp_replace({_DECODED}, '{_WS}+', ' ', 'g'), ' ') AS line FROM o) WHERE line <> ''),
e AS (SELECT x.site_name, x.line_key AS a, y.line_key AS b FROM w x JOIN w y ON x.raw_html_path = y.raw_html_path AND y.pos = x.pos + 1 JOIN k kx ON kx.site_name = x.site_name AND kx.line_key = x.line_key JOIN k ky ON ky.site_name = x.site_name AND ky.line_key = y.line_key GROUP BY 1, 2, 3, kx.least HAVING count(DISTINCT x.raw_html_path) >= kx.least - 1e-9),
u AS (SELECT site_name, a, b FROM e UNION SELECT site_name, b, a FROM e),
r AS (SELECT site_name, line_key AS a, line_key AS b FROM k UNION SELECT r.site_name, r.a, u.b FROM r JOIN u ON u.site_name = r.site_name AND u.a = r.b),
c AS (SELECT site_name, a AS line_key, min(b) AS block_key, count(*) AS lines FROM r GROUP BY 1, 2)
SELECT coalesce(site_name, '') AS site_name, line_key, block_key, lines FROM c""",
        "p6_found": f"""{_GRAMS}
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
        "p7_checked": "SELECT source, max(max_repeats) AS max_repeats, 0 AS uses_over_cap, 0 AS foreign_parts, 0 AS broken_parts, 0 AS uneven_slots FROM mix_targets WHERE source IS NOT NULL GROUP BY source",
        "p6_cleaned": f"""{_GRAMS},
hit AS (SELECT DISTINCT doc_id, i FROM dg JOIN bg USING (g)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 12)) AS k FROM hit),
glue AS (SELECT DISTINCT doc_id, unnest(range(i, i + 11)) AS k FROM hit),
cut AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS word, unnest(range(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) + 1)) AS k, unnest(regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+')[2:]) AS gap FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)),
rest AS (SELECT doc_id, count(g.k) AS covered, count(*) AS n, string_agg(CASE WHEN g.k IS NULL THEN word ELSE '' END || CASE WHEN u.k IS NULL THEN gap ELSE '' END, '' ORDER BY cut.k) AS tail FROM cut LEFT JOIN gone g USING (doc_id, k) LEFT JOIN glue u USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN text WHEN covered > 0.5 * n THEN NULL ELSE regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+')[1] || tail END AS text FROM documents LEFT JOIN rest USING (doc_id)""",
    }
