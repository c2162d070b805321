"""DuckDB SQL for the queries, written from each measure's definition over the test tables."""

from __future__ import annotations

from formweave.schema import BLOCK_TYPES

_TYPES = "[" + ", ".join(f"'{t}'" for t in BLOCK_TYPES) + "]"
_INPUTS = "('text_input', 'text_area', 'date_input', 'checkbox_option', 'radio_option')"

#: Golden and candidate blocks, and each golden block with the last candidate of its identity.
_BLOCKS = f"""
g AS (
  SELECT coalesce(source, '') AS fixture_id, doc_id AS d, doc_id AS pos, doc_id % 11 + 1 AS page,
    round_even(doc_id % 37 * 7 / 2.0, 0)::INT AS k0, round_even(doc_id % 53 * 5 / 2.0, 0)::INT AS k1,
    round_even((doc_id % 37 * 7 + 50) / 2.0, 0)::INT AS k2, round_even((doc_id % 53 * 5 + 12) / 2.0, 0)::INT AS k3,
    sha256(coalesce(text, '')) AS sha, {_TYPES}[doc_id % 15 + 1] AS t, (5 + doc_id * 37 % 95) / 100.0::DOUBLE AS conf FROM documents
), c AS (
  SELECT fixture_id, d, pos, page, k0 AS g0, round_even((d % 37 * 7 + CASE WHEN d % 3 = 0 THEN 0.4 ELSE 0 END) / 2.0, 0)::INT AS k0, k1,
    round_even((d % 37 * 7 + 50 + CASE WHEN d % 3 = 0 THEN 0.4 ELSE 0 END) / 2.0, 0)::INT AS k2, k3, sha,
    {_TYPES}[(d + CASE WHEN d % 9 = 0 THEN 1 ELSE 0 END) % 15 + 1] AS t, conf FROM g WHERE d % 50 <> 0
), cc AS (
  SELECT fixture_id, d, pos, page, k0, k1, k2, k3, sha, t, conf FROM c
  UNION ALL SELECT fixture_id, d, pos + 1000000000, page, k0, k1, k2, k3, sha, {_TYPES}[(d + 2) % 15 + 1], conf FROM c WHERE d % 7 = 0
), last AS (
  SELECT fixture_id, page, k0, k1, k2, k3, sha, max_by(t, pos) AS ct, max_by(d, pos) AS cd FROM cc GROUP BY ALL
), m AS (
  SELECT g.*, ct, cd FROM g LEFT JOIN last USING (fixture_id, page, k0, k1, k2, k3, sha)
)"""

#: Parts as rows of three sheets, with the size of both sides.
_SHEET = """
p AS (SELECT p_partkey AS k, 'part' || p_partkey % 3 AS fixture_id, p_partkey // 3 AS i, p_type, p_brand FROM part),
s AS (SELECT fixture_id, max(i) + 1 AS rr, max(i) + 1 - CASE fixture_id WHEN 'part1' THEN 1 ELSE 0 END AS cr FROM p GROUP BY 1),
b AS (SELECT * FROM p JOIN s USING (fixture_id) WHERE i < cr)"""

_VOCAB = """
v AS (
  SELECT 'part' || p_partkey % 3 AS fixture_id, p_partkey + 1 AS row, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS value
  FROM part WHERE p_brand NOT LIKE '%5'
), vocab AS (SELECT fixture_id, lower(value) AS key, min_by(value, row) AS value, min(row)::INT AS row FROM v GROUP BY 1, 2)"""

_COLUMNS = (
    _SHEET
    + """,
wrong AS (
  SELECT fixture_id, count(*) FILTER (k % 12 = 0) AS w1, count(*) FILTER (k % 5 = 0) AS w3, count(*) FILTER (k % 8 = 0) AS w5,
    count(*) FILTER (k % 11 = 0) AS w6, count(*) FILTER (k % 13 = 0) AS w7 FROM b GROUP BY 1
), cols AS (
  SELECT s.fixture_id, x.col, x.header, x.priority, (CASE WHEN x.col IN (7, 8) THEN rr ELSE cr END)::BIGINT AS total,
    (CASE x.col WHEN 1 THEN cr - w1 WHEN 3 THEN cr - w3 WHEN 5 THEN cr - w5 WHEN 6 THEN cr - w6 WHEN 7 THEN rr - w7 WHEN 8 THEN 0 ELSE cr END)::BIGINT AS correct, x.threshold, x.weight
  FROM s JOIN wrong USING (fixture_id), (VALUES (1, 'Section', 'high', 0.92, 3), (2, 'Sequence', 'critical', 0.97, 5), (3, 'QuestionType', 'critical', 0.97, 5),
    (4, 'Question Text', 'critical', 0.97, 5), (5, 'Branching Logic', 'high', 0.92, 3), (6, 'Alert' || chr(10) || '(Yes / No)', 'medium', 0.85, 1),
    (7, 'IT Notes ', 'low', 0.99, 0), (8, 'Answer Text', 'high', 0.92, 3)) x(col, header, priority, threshold, weight)
), acc AS (SELECT *, correct::DOUBLE / total::DOUBLE AS accuracy FROM cols)"""
)

_VALID = (
    _SHEET
    + ","
    + _VOCAB
    + """,
q AS (
  SELECT fixture_id, count(*)::BIGINT AS total,
    count(*) FILTER (EXISTS (SELECT 1 FROM vocab WHERE vocab.fixture_id = b.fixture_id AND key = lower(p_brand)) OR k % 5 <> 0)::BIGINT AS valid
  FROM b GROUP BY 1
)"""
)

_DISTANCE = (
    "WITH "
    + _COLUMNS
    + ","
    + _VOCAB
    + """,
q AS (
  SELECT fixture_id, count(*) FILTER (k % 5 = 0 AND NOT EXISTS (SELECT 1 FROM vocab WHERE vocab.fixture_id = b.fixture_id AND key = lower(p_brand))) AS oov FROM b GROUP BY 1
), seq AS (SELECT fixture_id, min(i) = 0 AND count(*) = max(i) + 1 AS ok FROM b GROUP BY 1),
dist AS (
  SELECT fixture_id, sum(weight * (1 - accuracy)) / sum(weight) AS base,
    any_value(least(0.1 * oov, 0.3)) + CASE WHEN any_value(ok) THEN 0 ELSE 0.1 END + CASE fixture_id WHEN 'part2' THEN 0.2 ELSE 0 END AS penalties
  FROM acc JOIN q USING (fixture_id) JOIN seq USING (fixture_id) GROUP BY fixture_id
)"""
)

_EXPRESSIONS = """
e AS (
  SELECT o_orderkey AS k, 'f' || o_orderkey % 6 AS fixture_id, 'Q' || (o_orderkey % 9 + 1) || ' = "yes"' AS one, 'Q' || (o_orderkey % 5 + 1) || ' != "no"' AS two,
    'Q' || (o_orderkey % 5 + 1) || ' in ("a", "b", "b")' AS three FROM orders
), x AS (
  SELECT *, CASE WHEN k % 4 IN (0, 1) THEN 'Display if ' || least(one, two) || ' AND ' || greatest(one, two) WHEN k % 4 = 2 THEN 'Display if ' || three END AS canonical FROM e
)"""

_PAIRS = """
r AS (
  SELECT 'f' || a.conv_id % 7 AS fixture_id, a.conv_id * 1000 + a.turn AS k, a.text AS a, b.text AS b
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
), made AS (
  SELECT fixture_id, k, false AS box, a AS c, b AS f FROM r
  UNION ALL SELECT fixture_id, k, false, a, a FROM r WHERE k % 4 = 0
  UNION ALL SELECT fixture_id, k, false, '', '' FROM r WHERE k % 5 = 0
  UNION ALL SELECT fixture_id, k, true, 'red | blue|' || k % 4, k % 2 || '|red|blue|' FROM r WHERE k % 3 = 0
), pairs AS (SELECT fixture_id, k, box, nfc_normalize(coalesce(c, '')) AS c, nfc_normalize(coalesce(f, '')) AS f FROM made
), o AS (SELECT *, box AND k % 4 = k % 2 AS same_set FROM pairs WHERE c <> '' OR f <> ''),
judged AS (
  SELECT *, (ascii(c) + ascii(f) + length(c) + length(f)) % 3 AS z, CASE WHEN box THEN same_set ELSE c = f END AS answer_same FROM o
)"""

_LOG = """
l AS (
  SELECT user_id, ts, event_type = 'purchase' AS call, event_type IN ('view', 'click') AS block, event_type = 'click' AS routed,
    CASE WHEN event_type = 'purchase' THEN value::DECIMAL(12, 2) END AS cost,
    coalesce(event_type = 'purchase' AND try_cast(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0, false) AS hit FROM events
)"""
_MEASURES = """coalesce(sum(cost), 0)::DOUBLE AS cost_usd, count(*) FILTER (block)::BIGINT AS blocks, count(*) FILTER (routed)::BIGINT AS routed,
    count(*) FILTER (call)::BIGINT AS llm_calls, count(*) FILTER (hit)::BIGINT AS cache_hits,
    CASE WHEN count(*) FILTER (block) = 0 THEN 0 ELSE coalesce(sum(cost), 0)::DOUBLE / count(*) FILTER (block)::DOUBLE END::DOUBLE AS cost_per_block_usd,
    CASE WHEN count(*) FILTER (block) = 0 THEN 0 ELSE count(*) FILTER (routed)::DOUBLE / count(*) FILTER (block)::DOUBLE END::DOUBLE AS route_rate,
    CASE WHEN count(*) FILTER (call) = 0 THEN 0 ELSE count(*) FILTER (hit)::DOUBLE / count(*) FILTER (call)::DOUBLE END::DOUBLE AS cache_hit_rate"""

#: Blocks in documents of 50, with their parents.
_LINKED = f"""
n AS (
  SELECT 'd' || doc_id // 50 AS fixture_id, doc_id AS d, 'b' || doc_id AS block_id, doc_id % 11 + 1 AS page, {_TYPES}[doc_id % 15 + 1] AS t, text,
    (5 + doc_id * 37 % 95) / 100.0::DOUBLE AS conf,
    CASE WHEN doc_id % 40 = 3 THEN -1 WHEN doc_id % 100 = 20 THEN doc_id + 1 WHEN doc_id % 100 = 21 THEN doc_id - 1 WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent
  FROM documents
)"""
_ROWS = """,
w AS (
  SELECT *, last_value(CASE WHEN t = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY fixture_id ORDER BY page, d, block_id ROWS UNBOUNDED PRECEDING) AS section FROM n
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY page, d, block_id)::INT AS sequence FROM w WHERE t NOT IN ('section_header', 'page_header', 'page_footer', 'unknown')
)"""
_STAGED = """
st AS (
  SELECT coalesce(source, '') AS fixture_id, doc_id AS d, 'b' || doc_id AS block_id, CASE WHEN doc_id % 13 <> 0 THEN (5 + doc_id * 37 % 95) / 100.0::DOUBLE END AS conf FROM documents
)"""

#: Headings, paragraphs, list items and labels of pages, with the text inside their inline tags.
_PAGE_BLOCKS = r"""
x AS (SELECT page_id, regexp_extract_all(html, '(?i)<(?:p|h[1-6]|li|label)\b[^>]*>([^<]*(?:</?(?:a|abbr|b|br|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|time|u)\b[^>]*>[^<]*)*)', 1) AS parts FROM pages),
y AS (SELECT 'p' || page_id AS f, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS n FROM x),
z AS (SELECT f, n, trim(regexp_replace(raw, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM y)"""

def _priorities() -> str:
    from formweave.functions.headers import CLASSES, THRESHOLDS, WEIGHTS

    rows = [(h, c) for c, group in CLASSES.items() for h in group] + [("other", "unclassified")]
    values = ", ".join(f"({i}, '{h}', '{c}', {THRESHOLDS.get(c, 0)}, {WEIGHTS.get(c, 0)})" for i, (h, c) in enumerate(rows))
    return f"SELECT p_partkey, canon, priority, threshold::DOUBLE AS threshold, weight::DOUBLE AS weight FROM part JOIN (VALUES {values}) x(i, canon, priority, threshold, weight) ON p_partkey % {len(rows)} = i"


SQL: dict[str, str] = {
    "header_priorities": _priorities(),
    "block_match_quality": f"""WITH {_BLOCKS}
SELECT fixture_id, count(*)::BIGINT AS golden_blocks, count(ct)::BIGINT AS matched,
  (SELECT count(*) FROM last WHERE last.fixture_id = m.fixture_id)::BIGINT AS candidate_keys,
  count(ct)::DOUBLE / count(*)::DOUBLE AS block_coverage,
  CASE WHEN count(ct) = 0 THEN 1 ELSE count(*) FILTER (ct = t)::DOUBLE / count(ct)::DOUBLE END::DOUBLE AS type_accuracy
FROM m GROUP BY fixture_id""",
    "type_accuracy_per_type": f"""WITH {_BLOCKS}
SELECT fixture_id, t AS block_type, count(*)::BIGINT AS matched, count(*) FILTER (ct = t)::BIGINT AS correct, count(*) FILTER (ct = t)::DOUBLE / count(*)::DOUBLE AS accuracy
FROM m WHERE ct IS NOT NULL GROUP BY 1, 2""",
    "parent_link_f1": """WITH g AS (
  SELECT DISTINCT coalesce(source, '') AS fixture_id, doc_id AS d, doc_id - doc_id % 4 AS parent FROM documents WHERE doc_id % 4 <> 0
), c AS (SELECT fixture_id, d, parent + CASE WHEN d % 8 = 1 THEN 4 ELSE 0 END AS parent FROM g WHERE d % 50 <> 0),
f AS (SELECT DISTINCT coalesce(source, '') AS fixture_id FROM documents),
n AS (
  SELECT f.fixture_id, (SELECT count(*) FROM g JOIN c USING (fixture_id, d, parent) WHERE g.fixture_id = f.fixture_id)::BIGINT AS tp,
    (SELECT count(*) FROM c WHERE c.fixture_id = f.fixture_id)::BIGINT AS nc, (SELECT count(*) FROM g WHERE g.fixture_id = f.fixture_id)::BIGINT AS ng FROM f
)
SELECT fixture_id, tp, nc - tp AS fp, ng - tp AS fn, CASE WHEN nc + ng = 0 THEN 1 WHEN nc = 0 THEN 0 ELSE tp::DOUBLE / nc END::DOUBLE AS precision,
  CASE WHEN nc + ng = 0 THEN 1 WHEN ng = 0 THEN 0 ELSE tp::DOUBLE / ng END::DOUBLE AS recall,
  CASE WHEN nc + ng = 0 THEN 1 ELSE (2 * tp)::DOUBLE / (nc + ng)::DOUBLE END::DOUBLE AS f1 FROM n""",
    "branching_exact_match": f"""WITH {_BLOCKS}
SELECT fixture_id, count(*) FILTER (ct IS NOT NULL AND d % 3 <> 0)::BIGINT AS asked,
  count(*) FILTER (d % 3 <> 0 AND cd % 3 <> 0 AND cd % 11 <> 0 AND cd % 9 = d % 9)::BIGINT AS equal,
  CASE WHEN count(*) FILTER (ct IS NOT NULL AND d % 3 <> 0) = 0 THEN 1 ELSE
    count(*) FILTER (d % 3 <> 0 AND cd % 3 <> 0 AND cd % 11 <> 0 AND cd % 9 = d % 9)::DOUBLE / count(*) FILTER (ct IS NOT NULL AND d % 3 <> 0)::DOUBLE END::DOUBLE AS branching_exact_match
FROM m GROUP BY fixture_id""",
    "sequence_tau": f"""WITH {_BLOCKS},
q AS (SELECT fixture_id, row_number() OVER () AS id, d AS x, cd * 37 % 1009 AS y FROM m WHERE d % 6 <> 0 AND cd % 6 <> 0),
f AS (SELECT DISTINCT fixture_id FROM q),
z AS (
  SELECT a.fixture_id, count(*) FILTER (sign(a.x - b.x) * sign(a.y - b.y) > 0)::BIGINT AS concordant, count(*) FILTER (sign(a.x - b.x) * sign(a.y - b.y) < 0)::BIGINT AS discordant
  FROM q a JOIN q b ON a.fixture_id = b.fixture_id AND a.id < b.id GROUP BY 1
), r AS (SELECT fixture_id, coalesce(concordant, 0) AS concordant, coalesce(discordant, 0) AS discordant FROM f LEFT JOIN z USING (fixture_id))
SELECT *, CASE WHEN concordant + discordant = 0 THEN 1 ELSE (concordant - discordant)::DOUBLE / (concordant + discordant)::DOUBLE END::DOUBLE AS tau FROM r""",
    "confidence_calibration": f"""WITH {_BLOCKS}, h AS (SELECT *, (5 + cd * 37 % 95) AS pct FROM m WHERE ct IS NOT NULL)
SELECT fixture_id, CASE WHEN pct < 20 THEN '0.0-0.2' WHEN pct < 40 THEN '0.2-0.4' WHEN pct < 60 THEN '0.4-0.6' WHEN pct < 80 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bin,
  count(*)::BIGINT AS blocks, count(*) FILTER (ct = t)::DOUBLE / count(*)::DOUBLE AS accuracy FROM h GROUP BY 1, 2""",
    "per_column_accuracy": f"WITH {_COLUMNS} SELECT fixture_id, col, header, priority, total, correct, accuracy, threshold::DOUBLE AS threshold, accuracy >= threshold AS passed FROM acc",
    "row_count_delta": f"WITH {_SHEET} SELECT fixture_id, (cr - rr)::BIGINT AS row_count_delta FROM s",
    "header_meta": """WITH x AS (
  SELECT 'nation' || n_regionkey AS fixture_id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS r,
    CASE WHEN n_nationkey % 7 <> 0 THEN CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END END AS c FROM nation WHERE n_nationkey // 2 < 10
)
SELECT fixture_id, count(*) FILTER (coalesce(r, c) IS NOT NULL)::BIGINT AS total, count(*) FILTER (r = c)::BIGINT AS correct,
  CASE WHEN count(*) FILTER (coalesce(r, c) IS NOT NULL) = 0 THEN 1 ELSE count(*) FILTER (r = c)::DOUBLE / count(*) FILTER (coalesce(r, c) IS NOT NULL)::DOUBLE END::DOUBLE AS accuracy
FROM x GROUP BY 1""",
    "controlled_vocabulary": f"WITH {_VOCAB} SELECT * FROM vocab",
    "vocab_validity": f"WITH {_VALID} SELECT fixture_id, total, valid, total - valid AS out_of_vocab, valid::DOUBLE / total::DOUBLE AS validity FROM q",
    "yes_no_validity": f"WITH {_SHEET} SELECT fixture_id, count(*)::BIGINT AS total, count(*) FILTER (k % 11 <> 0)::BIGINT AS valid, count(*) FILTER (k % 11 <> 0)::DOUBLE / count(*)::DOUBLE AS validity FROM b GROUP BY 1",
    "branching_validity": f"""WITH {_SHEET} SELECT fixture_id, count(*) FILTER (k % 2 = 0)::BIGINT AS total, count(*) FILTER (k % 2 = 0 AND k % 8 <> 0)::BIGINT AS valid,
  count(*) FILTER (k % 2 = 0 AND k % 8 <> 0)::DOUBLE / count(*) FILTER (k % 2 = 0)::DOUBLE AS validity FROM b GROUP BY 1""",
    "sequence_contiguity": """SELECT l_orderkey, count(*)::BIGINT AS n, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS contiguous FROM lineitem GROUP BY 1""",
    "sheet_sequence_contiguity": f"WITH {_SHEET} SELECT fixture_id, count(*)::BIGINT AS n, list_sort(list(i + 1)) = range(1, count(*) + 1) AS contiguous FROM b GROUP BY 1",
    "formatting_checks": """WITH x AS (SELECT p_brand AS fixture_id, p_partkey % 50 <> 0 OR p_brand LIKE '%1' AS kept FROM part),
y AS (SELECT fixture_id, bool_and(kept) AS all_kept FROM x GROUP BY 1 HAVING bool_or(kept))
SELECT fixture_id, true AS sheets_equal, all_kept AS merges_equal, true AS names_equal, true AS panes_equal, all_kept AS validations_kept, all_kept AS formatting_preservation FROM y""",
    "workbook_distance": f"{_DISTANCE} SELECT fixture_id, round(base, 9)::DOUBLE AS base, round(penalties::DOUBLE, 9)::DOUBLE AS penalties, round((base + penalties)::DOUBLE, 9)::DOUBLE AS distance, base + penalties <= 0.05 AS passed FROM dist",
    "e2e_pass_rate": f"{_DISTANCE} SELECT count(*)::BIGINT AS fixtures, count(*) FILTER (base + penalties <= 0.05)::BIGINT AS passed, count(*) FILTER (base + penalties <= 0.05)::DOUBLE / count(*)::DOUBLE AS e2e_pass_rate FROM dist",
    "workbook_distance_delta": f"{_DISTANCE} SELECT fixture_id, 0.0::DOUBLE AS before, round((base + penalties)::DOUBLE, 9)::DOUBLE AS after, round((base + penalties)::DOUBLE, 9)::DOUBLE AS workbook_distance_delta FROM dist",
    "contributions": f"WITH {_COLUMNS} SELECT fixture_id, col, header, priority, round((weight * (1 - accuracy) / sum(weight) OVER (PARTITION BY fixture_id))::DOUBLE, 9)::DOUBLE AS contribution FROM acc WHERE weight > 0",
    "workbook_evaluation": f"""{_DISTANCE},
v2 AS (SELECT fixture_id, count(*) AS n FROM b GROUP BY 1)
SELECT d.fixture_id, (cr - rr)::BIGINT AS row_count_delta, (n - oov)::DOUBLE / n::DOUBLE AS controlled_vocab_validity, oov::BIGINT AS out_of_vocab,
  (SELECT count(*) FILTER (k % 11 <> 0)::DOUBLE / count(*)::DOUBLE FROM b WHERE b.fixture_id = d.fixture_id) AS yes_no_validity,
  (SELECT count(*) FILTER (k % 2 = 0 AND k % 8 <> 0)::DOUBLE / count(*) FILTER (k % 2 = 0)::DOUBLE FROM b WHERE b.fixture_id = d.fixture_id) AS branching_syntactic_validity,
  ok AS sequence_contiguity, d.fixture_id <> 'part2' AS formatting_preservation, 1.0::DOUBLE AS header_meta_accuracy, false AS passed
FROM dist d JOIN s USING (fixture_id) JOIN q USING (fixture_id) JOIN v2 USING (fixture_id) JOIN seq USING (fixture_id)""",
    "cell_values": """WITH x AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day FROM orders)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 1000.5 + k % 1000 WHEN 1 THEN 1000 WHEN 3 THEN 1000 END::DOUBLE AS number, day::VARCHAR AS day,
  k % 7 <> 0 AS same_day, k % 4 IN (1, 3) AS is_thousand FROM x""",
    "normalized_text": """SELECT conv_id, turn, sha256(regexp_replace(coalesce(nfc_normalize(text), ''), '^[\\s]+|[\\s]+$', '', 'g')) AS digest,
  regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' AS blank, sha256(encode(coalesce(role, '')) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS key
FROM conversations""",
    "dsl_canonical": f"WITH {_EXPRESSIONS} SELECT k AS o_orderkey, canonical, k % 4 = 0 AS loosely_valid FROM x",
    "branching_equivalence": f"""WITH {_EXPRESSIONS}
SELECT fixture_id, count(*) FILTER (k % 4 IN (0, 1) AND k % 8 <> 5)::BIGINT AS numerator, count(*)::BIGINT AS denominator,
  count(*) FILTER (k % 4 IN (0, 1) AND k % 8 <> 5)::DOUBLE / count(*)::DOUBLE AS score, 0::BIGINT AS unresolved FROM x GROUP BY 1""",
    "text_equivalence": f"""WITH {_PAIRS}
SELECT fixture_id, count(*) FILTER (c = f OR NOT answer_same AND z = 0)::BIGINT AS numerator, count(*)::BIGINT AS denominator,
  count(*) FILTER (c = f OR NOT answer_same AND z = 0)::DOUBLE / count(*)::DOUBLE AS score, count(*) FILTER (c <> f AND (answer_same OR z = 2))::BIGINT AS unresolved
FROM judged GROUP BY 1""",
    "answer_sets": f"""WITH {_PAIRS}
SELECT fixture_id, count(*) FILTER (answer_same)::BIGINT AS numerator, count(*)::BIGINT AS denominator, count(*) FILTER (answer_same)::DOUBLE / count(*)::DOUBLE AS score,
  count(*) FILTER (NOT answer_same)::BIGINT AS unresolved FROM judged GROUP BY 1""",
    "judge_calls": f"""WITH {_PAIRS}, d AS (SELECT DISTINCT c, f FROM judged WHERE NOT answer_same)
SELECT CASE WHEN left(c, 1) = left(f, 1) THEN 'yes' ELSE 'no' END AS verdict, count(*)::BIGINT AS pairs FROM d GROUP BY 1""",
    "uplift": f"""WITH {_PAIRS}, t AS (
  SELECT fixture_id, count(*) FILTER (c = f OR NOT answer_same AND z = 0)::DOUBLE / count(*) AS judged, count(*) FILTER (c = f)::DOUBLE / count(*) AS exact FROM judged GROUP BY 1
)
SELECT fixture_id, round(judged - CASE fixture_id WHEN 'f0' THEN 0 ELSE exact END, 9)::DOUBLE AS uplift FROM t""",
    "cost_latency": f"WITH {_LOG} SELECT {_MEASURES} FROM l",
    "cost_by_user": f"WITH {_LOG} SELECT user_id, {_MEASURES} FROM l GROUP BY user_id",
    "cost_tumbling": f"WITH {_LOG} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_MEASURES} FROM l GROUP BY 1",
    "budget_lock": f"""WITH {_LOG}, u AS (SELECT user_id, coalesce(sum(cost), 0)::DOUBLE AS c FROM l GROUP BY 1 ORDER BY user_id LIMIT 10)
SELECT round(quantile_cont(c, 0.9) * 1.25, 6)::DOUBLE AS budget FROM u""",
    "run_alerts": f"""WITH {_LOG}, u AS (SELECT user_id, {_MEASURES} FROM l GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN cost_usd > 0.25 THEN 'cost_usd' END, CASE WHEN route_rate > 0.30 THEN 'route_rate' END) AS alerts FROM u""",
    "gate_split": f"""WITH {_STAGED}
SELECT fixture_id, coalesce(conf, 0) < 0.75 AS routed, count(*)::BIGINT AS blocks, min(block_id) AS first_id FROM st GROUP BY 1, 2""",
    "merge_filter": f"""WITH {_STAGED}
SELECT fixture_id, block_id, CASE WHEN coalesce(conf, 0) < 0.75 THEN 1 ELSE 0 END AS branch, d AS pos, conf AS confidence FROM st WHERE coalesce(conf, 1) >= 0.3""",
    "gate_reasons": f"""WITH RECURSIVE {_LINKED},
e AS (SELECT a.fixture_id, a.d, a.parent, p.d IS NOT NULL AS known FROM n a LEFT JOIN n p ON p.fixture_id = a.fixture_id AND p.d = a.parent WHERE a.parent IS NOT NULL),
walk AS (
  SELECT fixture_id, d AS start, parent AS cur, 1 AS steps FROM e WHERE known
  UNION ALL SELECT walk.fixture_id, start, e.parent, steps + 1 FROM walk JOIN e ON e.fixture_id = walk.fixture_id AND e.d = walk.cur AND e.known WHERE steps < 60 AND walk.cur <> start
), label AS (
  SELECT *, last_value(CASE WHEN t IN ('question_label', 'section_header', 'subsection_header') THEN d END IGNORE NULLS) OVER (PARTITION BY fixture_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM n
), why AS (
  SELECT fixture_id, d, 'low_confidence' AS r FROM n WHERE conf < 0.70
  UNION ALL SELECT fixture_id, d, 'ambiguous' FROM n WHERE d % 6 = 0
  UNION ALL SELECT fixture_id, d, 'dangling_parent' FROM e WHERE NOT known
  UNION ALL SELECT DISTINCT fixture_id, start, 'cycle' FROM walk WHERE cur = start
  UNION ALL SELECT fixture_id, d, 'orphan_input' FROM n WHERE t IN {_INPUTS} AND parent IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.fixture_id = n.fixture_id AND e.parent = n.d)
  UNION ALL SELECT fixture_id, d, 'distant_option' FROM label WHERE t IN ('checkbox_option', 'radio_option') AND coalesce(d - lp > 5, true)
)
SELECT n.fixture_id, n.block_id, coalesce(string_agg(r, ',' ORDER BY r), '') AS reasons, count(r) > 0 AS routed FROM n LEFT JOIN why USING (fixture_id, d) GROUP BY 1, 2""",
    "neighbours": f"""WITH {_LINKED}
SELECT a.fixture_id, a.block_id, coalesce(string_agg(b.block_id, ',' ORDER BY b.d) FILTER (b.rk < a.rk), '') AS before, coalesce(string_agg(b.block_id, ',' ORDER BY b.d) FILTER (b.rk > a.rk), '') AS after
FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY d) AS rk FROM n) a
JOIN (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY d) AS rk FROM n) b ON a.fixture_id = b.fixture_id AND abs(a.rk - b.rk) <= 3 GROUP BY 1, 2""",
    "page_neighbours": f"""WITH {_LINKED}
SELECT a.fixture_id, a.page::INT AS page, a.block_id, b.block_id AS other FROM n a JOIN n b ON a.fixture_id = b.fixture_id AND a.page = b.page AND a.d <> b.d AND abs(a.d % 53 * 5 - b.d % 53 * 5) <= 60""",
    "merge_override": f"""WITH {_STAGED}, x AS (SELECT *, coalesce(conf, 0) < 0.75 AS routed, {_TYPES}[d % 15 + 1] AS t FROM st)
SELECT fixture_id, block_id, CASE WHEN routed AND d % 4 = 0 THEN 'display' ELSE t END AS block_type, CASE WHEN routed AND d % 2 = 0 THEN 0.9 ELSE conf END::DOUBLE AS confidence,
  CASE WHEN routed AND d % 2 = 0 THEN 'llm' ELSE 'rule' END AS provenance, routed FROM x""",
    "map_rows": f"""WITH {_LINKED} {_ROWS},
kids AS (
  SELECT fixture_id, parent, count(*) FILTER (t = 'checkbox_option') AS nc, count(*) FILTER (t = 'radio_option') AS nr, count(*) FILTER (t = 'text_input') AS ni,
    count(*) FILTER (t = 'text_area') AS na, count(*) FILTER (t = 'date_input') AS nd,
    coalesce(string_agg(coalesce(text, ''), '|' ORDER BY page, d) FILTER (t IN ('checkbox_option', 'radio_option')), '') AS options
  FROM n WHERE parent IS NOT NULL GROUP BY 1, 2
), q AS (
  SELECT rows.*, options, CASE WHEN t = 'question_label' AND nc >= 2 THEN 'Checkbox Group' WHEN t = 'question_label' AND nc = 1 THEN 'Checkbox' WHEN t = 'question_label' AND nr >= 2 THEN 'Radio Button'
    WHEN t = 'question_label' AND nd > 0 THEN 'Date' WHEN t = 'question_label' AND na > 0 THEN 'Text Area' WHEN t = 'question_label' AND ni > 0 THEN 'Text Box'
    WHEN t IN ('signature_field', 'text_input') THEN 'Text Box' WHEN t = 'text_area' THEN 'Text Area' WHEN t = 'date_input' THEN 'Date' ELSE 'Display' END AS question_type
  FROM rows LEFT JOIN kids ON kids.fixture_id = rows.fixture_id AND kids.parent = rows.d
)
SELECT fixture_id, block_id, section, sequence, question_type, coalesce(text, '') AS question_text,
  CASE WHEN question_type IN ('Checkbox Group', 'Radio Button', 'Checkbox') THEN options END AS answer_text,
  CASE WHEN t = 'signature_field' THEN 'signature' WHEN question_type = 'Date' THEN 'Format is mm/dd/yyyy' WHEN question_type = 'Text Box' THEN 'default characters = 100' END AS answer_validation,
  'Yes' AS required, CASE WHEN regexp_matches(text, '(?i)\\b(name|ssn|dob|date of birth|social security)\\b') THEN 'Yes' ELSE 'No' END AS auto_populated FROM q""",
    "substituted_branching": f"""WITH {_LINKED} {_ROWS}
SELECT a.fixture_id, a.block_id, a.sequence, 'Display if Q' || b.sequence || ' = "yes"' AS branching_logic FROM rows a JOIN rows b ON a.fixture_id = b.fixture_id AND a.parent = b.d""",
    "document_titles": f"""WITH {_LINKED}
SELECT fixture_id, min_by(text, page * 1000000000 + d) FILTER (t IN ('section_header', 'subsection_header', 'page_header')) AS assessment_title, 'program' AS program FROM n GROUP BY 1""",
    "repeated_headers": """SELECT sha256(coalesce(text, '')) AS sha, count(DISTINCT doc_id % 11)::BIGINT AS pages, count(*)::BIGINT AS blocks FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 11) >= 3""",
    "rule_combine": """WITH s AS (
  SELECT doc_id, 'b' || doc_id AS block_id, x.t AS type, x.p, (doc_id * x.f % 90 + 5) / 100.0::DOUBLE AS c FROM documents, (VALUES ('display', 7, 0), ('question_label', 11, 1), ('text_input', 13, 2)) x(t, f, p)
), r AS (SELECT *, row_number() OVER w AS rk, lead(c) OVER w AS nx, product(1 - c) OVER (PARTITION BY doc_id) AS miss FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY c DESC, p))
SELECT block_id, type, round(greatest(0.05, least(0.99, 1 - miss)), 9)::DOUBLE AS combined, round(c - nx, 9)::DOUBLE AS gap FROM r WHERE rk = 1""",
    "contract_violations": f"""WITH {_LINKED}, x AS (SELECT *, CASE WHEN d % 31 = 0 OR d % 3 <> 0 THEN true ELSE false END AS has_logic FROM n)
SELECT fixture_id, block_id, 'page' AS rule FROM x WHERE d % 17 = 0
UNION ALL SELECT fixture_id, block_id, 'confidence' FROM x WHERE d % 19 = 0
UNION ALL SELECT fixture_id, block_id, 'block_type' FROM x WHERE d % 23 = 0
UNION ALL SELECT fixture_id, block_id, 'provenance' FROM x WHERE d % 29 = 0
UNION ALL SELECT fixture_id, block_id, 'branching_syntax' FROM x WHERE d % 31 = 0
UNION ALL SELECT a.fixture_id, a.block_id, 'parent_missing' FROM x a LEFT JOIN x p ON p.fixture_id = a.fixture_id AND p.d = a.parent WHERE a.parent IS NOT NULL AND p.d IS NULL
UNION ALL SELECT a.fixture_id, a.block_id, 'parent_without_sequence' FROM x a JOIN x p ON p.fixture_id = a.fixture_id AND p.d = a.parent WHERE a.has_logic AND p.d % 6 = 0""",
    "sequence_gaps": """SELECT 'd' || doc_id // 50 AS fixture_id, 'sequence' AS rule FROM documents GROUP BY doc_id // 50
HAVING list_sort(list(doc_id % 50 + CASE WHEN doc_id % 350 = 49 THEN 2 ELSE 1 END)) <> range(1, count(*) + 1)""",
    "html_blocks": f"""WITH {_PAGE_BLOCKS}
SELECT f AS fixture_id, n::INT AS pos, f || '-' || n AS block_id, length(text)::INT AS chars FROM z""",
    "classified_blocks": f"""WITH {_PAGE_BLOCKS}, blocks AS (
  SELECT f, n, f || '-' || n AS id, text, NULL::DOUBLE AS size, NULL::BOOLEAN AS bold, NULL::DOUBLE AS y0, NULL::DOUBLE AS y1, NULL::VARCHAR AS kind FROM z
  UNION ALL SELECT 'made-' || f, n, 'made-' || f || '-' || n, CASE WHEN n % 12 IN (0, 1) THEN text || ':' WHEN n % 12 = 11 THEN text || ' (part):' WHEN n % 36 = 9 THEN '___'
      WHEN n % 12 IN (2, 8, 9, 10) THEN repeat('_', CASE WHEN n % 24 < 12 THEN 8 ELSE 10 END) WHEN n % 12 = 3 THEN '☐ 1. ' || text || CASE WHEN n % 24 = 3 THEN ' ____' ELSE '' END
      WHEN n % 12 = 5 THEN 'Signature ____' WHEN n % 12 = 6 THEN 'DOB mm/dd/yyyy ____' WHEN n % 12 = 7 THEN '○ other' ELSE text END,
    CASE WHEN n % 12 = 0 AND n % 36 <> 0 THEN 14 ELSE 10 END, n % 12 = 0, y, y + 8, CASE WHEN n % 40 = 39 THEN 'table_cell' END
  FROM (SELECT *, 10 * CASE WHEN n % 24 IN (8, 13) THEN n - 1 ELSE n END AS y FROM z)
), a AS (
  SELECT *, trim(text, ' ') AS t, regexp_matches(text, '_{{2,}} *$') AS entry, regexp_full_match(trim(text, ' '), '_{{3,}}') AS bare FROM blocks
), b AS (
  SELECT *, lead(t) OVER w AS next_t, coalesce(lead(entry) OVER w, false) AS next_entry, CASE WHEN bare THEN length(t) END AS run, lag(CASE WHEN bare THEN length(t) END) OVER w AS last_run,
    coalesce(lag(y0) OVER w < y1 AND lag(y1) OVER w > y0, false) OR coalesce(lead(y0) OVER w < y1 AND lead(y1) OVER w > y0, false) AS beside, quantile_cont(size, 0.5) OVER (PARTITION BY f) AS median
  FROM a WINDOW w AS (PARTITION BY f ORDER BY n)
), c AS (SELECT *, sum(CASE WHEN bare AND coalesce(least(run, last_run) >= 0.75 * greatest(run, last_run), false) AND last_run IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f ORDER BY n) AS island FROM b
), d AS (
  SELECT *, count(*) OVER (PARTITION BY f, island) AS stacked, coalesce(bold, false) OR coalesce(size > median, false) AS large, ends_with(t, ':') AS colon, length(t) <= 80 AS short,
    coalesce(length(next_t) > 160, false) AS opens, coalesce(bold AND size <= median, false) AS plain FROM c
), h AS (
  SELECT *, unnest([
    {{'c': CASE WHEN large AND colon AND NOT beside AND next_t IS NOT NULL AND NOT next_entry THEN 0.8::DOUBLE * CASE WHEN opens THEN 0.9 ELSE 1 END * CASE WHEN plain THEN 0.8 ELSE 1 END END,
      'type': 'section_header', 'rule': 'section_header' || CASE WHEN opens THEN '*opens_body=0.90' ELSE '' END || CASE WHEN plain THEN '*body_sized=0.80' ELSE '' END}},
    {{'c': CASE WHEN colon AND NOT large AND regexp_matches(t, '\\(.*\\)') AND NOT next_entry AND coalesce(size >= 0.75 * median, true) THEN 0.65::DOUBLE * CASE WHEN opens THEN 0.9 ELSE 1 END END,
      'type': 'subsection_header', 'rule': 'subsection_header' || CASE WHEN opens THEN '*opens_body=0.90' ELSE '' END}},
    {{'c': CASE WHEN colon AND next_entry THEN 0.8::DOUBLE END, 'type': 'question_label', 'rule': 'question_label'}},
    {{'c': CASE WHEN starts_with(t, '☐') AND short THEN 0.9::DOUBLE END, 'type': 'checkbox_option', 'rule': 'checkbox_glyph'}},
    {{'c': CASE WHEN starts_with(t, '○') AND short THEN 0.9::DOUBLE END, 'type': 'radio_option', 'rule': 'radio_glyph'}},
    {{'c': CASE WHEN ends_with(t, '_') AND NOT t ILIKE '%signature%' THEN 0.75::DOUBLE END, 'type': 'text_input', 'rule': 'text_input'}},
    {{'c': CASE WHEN bare AND stacked >= 3 THEN 0.85::DOUBLE END, 'type': 'text_area', 'rule': 'text_area'}},
    {{'c': CASE WHEN regexp_matches(t, '(?i)\\b(date|dob|mm/dd/yyyy)\\b') AND (entry OR next_entry) THEN 0.85::DOUBLE END, 'type': 'date_input', 'rule': 'date_input'}},
    {{'c': CASE WHEN length(t) > 160 AND NOT next_entry THEN 0.7::DOUBLE END, 'type': 'display', 'rule': 'display'}},
    {{'c': CASE WHEN regexp_matches(t, '(?i)\\bsignature\\b') AND (entry OR next_entry) THEN 0.85::DOUBLE END, 'type': 'signature_field', 'rule': 'signature_field'}},
    {{'c': CASE WHEN kind = 'table_cell' THEN 0.9::DOUBLE END, 'type': 'table_cell', 'rule': 'table_cell'}},
    {{'c': CASE WHEN y0 >= 720 AND short THEN 0.85::DOUBLE END, 'type': 'page_footer', 'rule': 'page_footer'}}]) AS hit, generate_subscripts(range(12), 1) AS place FROM d
), best AS (SELECT id, hit.type AS type, hit.rule AS rule, hit.c AS c FROM h WHERE hit.c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY hit.c DESC, place) = 1
), e AS (SELECT f, n, d.id, text, t, y0, y1, coalesce(type, 'unknown') AS type, coalesce(rule, 'none') AS rule, coalesce(c, 0) AS c FROM d LEFT JOIN best ON d.id = best.id
), l AS (
  SELECT *, last_value(CASE WHEN type = 'question_label' THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label,
    last_value(CASE WHEN type = 'section_header' THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section,
    coalesce(type = 'text_input' AND regexp_full_match(t, '_{{2,40}}') AND lag(type) OVER w IN ('checkbox_option', 'radio_option') AND lag(y0) OVER w < y1 AND lag(y1) OVER w > y0, false) AS inside, lag(id) OVER w AS before
  FROM e WINDOW w AS (PARTITION BY f ORDER BY n)
), k AS (
  SELECT *, CASE WHEN inside THEN before WHEN type IN ('checkbox_option', 'radio_option', 'text_input', 'text_area', 'date_input', 'signature_field') THEN label WHEN type = 'question_label' THEN section END AS parent,
    CASE WHEN inside THEN 'input_of' WHEN type IN ('checkbox_option', 'radio_option') THEN 'option_of' WHEN type = 'question_label' THEN 'child_of_section' ELSE 'input_of' END AS link FROM l
)
SELECT f AS fixture_id, id AS block_id, type AS block_type, rule AS rule_id, round(c, 9)::DOUBLE AS confidence, parent, CASE WHEN parent IS NOT NULL THEN link END AS relation FROM k
UNION ALL SELECT f, id || '-input', 'text_input', 'inline_input', 0.75, id, 'input_of' FROM k WHERE type IN ('checkbox_option', 'radio_option') AND regexp_matches(t, '[^_]_{{2,40}}$')""",
    "few_shot_examples": r"""WITH bank AS (SELECT item_id AS doc_id, text FROM benchmark WHERE item_id IS NOT NULL ORDER BY item_id DESC, text DESC LIMIT 20),
dw AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS word FROM bank),
qw AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '') AS query_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS word FROM conversations),
tf AS (SELECT doc_id, word, count(*) AS tf FROM dw WHERE word <> '' GROUP BY 1, 2),
m AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS len, count(*) OVER (PARTITION BY word) AS df FROM tf),
g AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT doc_id, len FROM m)),
w AS (SELECT doc_id, word, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS w FROM m, g),
s AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM qw JOIN w USING (word) GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 3""",
}

SQL["reason_histogram"] = f"SELECT fixture_id, reason, count(*)::BIGINT AS blocks FROM (SELECT fixture_id, unnest(string_split(reasons, ',')) AS reason FROM ({SQL['gate_reasons']}) WHERE reasons <> '') GROUP BY 1, 2"
SQL["run_summary"] = f"""SELECT g.fixture_id, count(*)::BIGINT AS blocks, count(*) FILTER (routed)::BIGINT AS routed, count(*) FILTER (routed)::DOUBLE / count(*)::DOUBLE AS route_rate,
  coalesce(any_value(r.n), 0)::BIGINT AS rows FROM ({SQL["gate_reasons"]}) g LEFT JOIN (SELECT fixture_id, count(*) AS n FROM ({SQL["map_rows"]}) GROUP BY 1) r ON r.fixture_id = g.fixture_id GROUP BY 1"""
SQL["workbook_round_trip"] = """WITH x AS (
  SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, left(n_name, 1) || CASE WHEN n_nationkey % 2 = 0 THEN 'é' ELSE 'É' END AS word, n_nationkey % 5 <> 0 AS filled FROM nation
), v AS (SELECT n_regionkey, word, i FROM x QUALIFY row_number() OVER (PARTITION BY n_regionkey, lower(word) ORDER BY i) = 1),
w AS (SELECT n_regionkey, string_agg(word, ',' ORDER BY i) AS vocabulary FROM v GROUP BY 1)
SELECT 'region' || n_regionkey AS workbook, 'Section||Question <Text>' AS headers, 'A1:B1' AS merged_ranges, 'Assessment|Values' AS sheet_names, 'A4' AS frozen_panes, 4 AS data_start_row,
  (3 + coalesce(max(i) FILTER (filled), 0))::INT AS data_end_row, any_value(vocabulary) AS vocabulary, count(n_name) FILTER (filled)::BIGINT AS texts, coalesce(sum(length(n_name) + 2) FILTER (filled), 0)::BIGINT AS chars
FROM x JOIN w USING (n_regionkey) GROUP BY n_regionkey"""

#: Measures of one fixture that has no rows in a part are those of no rows.
SQL["block_evaluation"] = f"""WITH t AS (SELECT fixture_id, string_agg(block_type || '=' || floor(accuracy * 1e6)::BIGINT, ',' ORDER BY block_type) AS listed FROM ({SQL["type_accuracy_per_type"]}) GROUP BY 1),
b AS (SELECT fixture_id, string_agg(bin || '=' || floor(accuracy * 1e6)::BIGINT, ',' ORDER BY bin) AS listed FROM ({SQL["confidence_calibration"]}) GROUP BY 1),
o AS (WITH {_BLOCKS}, q AS (SELECT fixture_id, row_number() OVER () AS id, d AS x, cd AS y FROM m WHERE cd IS NOT NULL),
  z AS (SELECT a.fixture_id, count(*) FILTER ((a.x < b.x) = (a.y < b.y) AND a.x <> b.x AND a.y <> b.y) AS up, count(*) FILTER ((a.x < b.x) <> (a.y < b.y) AND a.x <> b.x AND a.y <> b.y) AS down FROM q a JOIN q b ON a.fixture_id = b.fixture_id AND a.id < b.id GROUP BY 1)
  SELECT fixture_id, CASE WHEN up + down = 0 THEN 1 ELSE (up - down)::DOUBLE / (up + down)::DOUBLE END AS tau FROM z)
SELECT c.*, coalesce(t.listed, '') AS type_accuracy_per_type, coalesce(b.listed, '') AS confidence_calibration, l.f1 AS parent_link_f1, l.precision AS parent_link_precision, l.recall AS parent_link_recall,
  coalesce(e.branching_exact_match, 1)::DOUBLE AS branching_exact_match, coalesce(o.tau, 1)::DOUBLE AS reading_order_tau, coalesce(s.tau, 1)::DOUBLE AS sequence_correctness, 'OK' AS status
FROM ({SQL["block_match_quality"]}) c LEFT JOIN t USING (fixture_id) LEFT JOIN b USING (fixture_id) LEFT JOIN ({SQL["parent_link_f1"]}) l USING (fixture_id)
LEFT JOIN ({SQL["branching_exact_match"]}) e USING (fixture_id) LEFT JOIN o USING (fixture_id) LEFT JOIN ({SQL["sequence_tau"]}) s USING (fixture_id)"""
