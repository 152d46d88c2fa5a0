"""DuckDB SQL for the queries of ``table_queries``."""

from __future__ import annotations

from tallyforge.plans.document_oracle import _STATEMENTS
from tallyforge.operators.prompts import SUMMARY_NAMES
from tallyforge.plans.more_oracle import _CONTENT
from tallyforge.plans.oracle import BILLS, LINES
from tallyforge.plans.table_queries import TARGETS

_PICK = ", ".join(f"max_by(v, -page_no) FILTER (pos = {i}) AS {name}" for i, (name, _) in enumerate(TARGETS))

TABLES = {
    "json_repair": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"id": ' || event_id || ', "tags": ["' || event_type || '", "x"]}' WHEN 1 THEN '{"id": ' || event_id || ', "tags": [], "of": {"a": 1}}'
        WHEN 2 THEN '{"id": ' || event_id || '}' WHEN 3 THEN '{"id": ' || event_id || '}' END AS json FROM events""",
    "infer_template": f"""WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'OK' AS status, 'Description' AS header_anchor, 'Grand Total' AS end_anchor, 'description:text:20.0:210.0,amount:money:210.0:370.0' AS columns, 'Grand Total' AS total_anchor FROM e""",
    "carried_table": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'order #' || o_orderkey AS description, price::VARCHAR AS amount FROM r",
    "positional_table": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'order' AS col_0, '#' || o_orderkey AS col_1, price::VARCHAR AS col_2 FROM r",
    "infer_layouts": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, CASE WHEN o_custkey % 3 = 2 THEN 'REVIEW' ELSE 'OK' END AS status, CASE WHEN o_custkey % 3 = 1 AND c > 1 THEN 8.0 ELSE 6.0 END::DOUBLE AS row_tol FROM e",
    "header_table": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'Grand' AS label, round(2 * s::DOUBLE, 2) AS double_total, 'order #' || o_orderkey AS description, price::DOUBLE AS amount FROM r JOIN e USING (o_custkey)",
    "wrapped_table": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, CASE WHEN o_custkey % 3 > 0 THEN 'new ' ELSE '' END || 'order #' || o_orderkey || CASE WHEN o_custkey % 3 <> 1 THEN ' paid' ELSE '' END AS description, price::DOUBLE AS amount FROM r",
    "derived_chain": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'by keyword' AS vendor, (SELECT price::DOUBLE FROM r WHERE r.o_custkey = e.o_custkey AND i = 1) AS first, s::DOUBLE AS gross, 0.0::DOUBLE AS net, s::DOUBLE AS paid, -s::DOUBLE AS due FROM e",
    "field_candidates": f"""WITH {_STATEMENTS}, c(o_custkey, kind, x0, x1, anchor, value, nth, gap, below, is_money) AS (
        SELECT o_custkey, 0, 130, 160, 'Statement No', 'C-' || o_custkey, NULL, NULL, NULL, false FROM e WHERE o_custkey % 3 = 0
        UNION ALL SELECT o_custkey, 1, 90, 160, 'Statement', 'No C-' || o_custkey, NULL, 13, NULL, false FROM e WHERE o_custkey % 3 = 1 AND o_custkey > 9
        UNION ALL SELECT o_custkey, 0, 154, 212, 'Statement No', '', NULL, NULL, NULL, false FROM e WHERE o_custkey % 3 = 2
        UNION ALL SELECT o_custkey, 3, 60, 90, 'Statement No', 'C-' || o_custkey, NULL, NULL, 1, false FROM e WHERE o_custkey % 3 = 2 AND o_custkey > 9
        UNION ALL SELECT o_custkey, 2, 300, 330, 'order #' || o_orderkey, price::VARCHAR, 1, NULL, NULL, true FROM r UNION ALL SELECT o_custkey, 2, 300, 330, 'Grand Total', s::VARCHAR, 1, NULL, NULL, true FROM e)
        SELECT o_custkey::VARCHAR AS doc_id, kind, x0::DOUBLE AS x0, x1::DOUBLE AS x1, anchor, value, nth::INT AS nth, gap::DOUBLE AS gap, below::INT AS below, is_money FROM c""",
    "file_words": r"""WITH p AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(12), ' '), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS page FROM documents),
        w AS (SELECT doc_id, page, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(line, '[\x20\x09-\x0D]+$', '')) AS ends FROM p)
        SELECT doc_id, sum(len(ws))::BIGINT AS n_words, max(page)::BIGINT AS last_page, sum(list_sum(list_transform(ws, lambda x: length(x))))::BIGINT AS n_chars, max(ends) * 5.0::DOUBLE AS widest FROM w WHERE len(ws) > 0 GROUP BY doc_id""",
    "first_page_words": r"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(string_split(coalesce(text, ''), chr(10))[1], chr(12), ' '), '[^\x20\x09-\x0D]+') AS ws FROM documents)
        SELECT doc_id, array_to_string(ws, ' ') AS words FROM w WHERE len(ws) > 0""",
    "sql_fields": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Invoice No:  A-' || doc_id || chr(10) || ': none' || chr(10) || '12:30' || chr(13) || chr(10) || 'Datum : heute ' || chr(10) || 'Empty:' || chr(10) || coalesce(text, '') ELSE text END AS t FROM documents),
        l AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(t, '\r\n|\r|\n'), 1) - 1 AS line_no FROM d)
        SELECT doc_id, line_no::INT AS line_no, trim(regexp_extract(line, '^([^:]{1,60}):\s*(.*\S)\s*$', 1)) AS label, regexp_extract(line, '^([^:]{1,60}):\s*(.*\S)\s*$', 2) AS value
        FROM l WHERE regexp_matches(line, '^[^:]{0,59}\p{L}[^:]{0,59}:\s*\S')""",
    "sql_cells": f"""WITH {_STATEMENTS}, g AS (SELECT o_custkey, top, text, x0, x0 + 30 AS x1, word_no, x0 - lag(x0 + 30) OVER (PARTITION BY o_custkey, top ORDER BY x0) AS gap FROM w),
        t AS (SELECT *, greatest(14.0, 3 * coalesce(min(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY o_custkey, top), 2)) AS wide FROM g),
        c AS (SELECT *, count(CASE WHEN gap > wide THEN 1 END) OVER (PARTITION BY o_custkey, top ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS cell_no FROM t)
        SELECT o_custkey::VARCHAR AS doc_id, top::INT AS line_no, cell_no::INT AS cell_no, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1, string_agg(text, ' ' ORDER BY x0) AS text FROM c GROUP BY 1, 2, 3""",
    "model_calls": """WITH k AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, greatest(4096, least(floor((turn * 10 * 200 + 1500) * 1.2), 16384))::INT AS tokens FROM conversations)
        SELECT conv_id, turn, tokens, CASE WHEN k IN (0, 1, 2, 3, 7) THEN '{"ok": true}' END AS raw, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 1 WHEN 7 THEN 2 ELSE 6 END::INT AS attempts,
          CASE k WHEN 0 THEN 'extra_body+max_tokens' WHEN 1 THEN 'extra_body+max_completion_tokens' WHEN 2 THEN 'extra_body' WHEN 3 THEN 'max_tokens' WHEN 7 THEN 'extra_body+max_tokens' END AS option,
          CASE k WHEN 4 THEN 'timed out: 600 s' WHEN 5 THEN 'RuntimeError: quota' WHEN 6 THEN 'empty answer' END AS problem FROM k""",
    "hsn_and_exempt": """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AS moves FROM part)
        SELECT k::VARCHAR AS doc_id, CASE WHEN moves THEN '' WHEN k % 3 = 0 THEN (k % 9000 + 1000)::VARCHAR ELSE 'pcs' END AS unit, CASE WHEN k % 2 = 0 THEN '8471' WHEN moves THEN (k % 9000 + 1000)::VARCHAR ELSE '' END AS hsn,
          CASE WHEN k % 5 = 0 THEN '0' ELSE '9' END AS cgst_rate FROM p""",
    "summary_targets": f"""WITH l AS (SELECT o_orderkey AS doc_id, n // 8 + 1 AS page_no, n % 8 AS pos, (o_orderkey * 10 + n) || '.00' AS v FROM orders, range(24) t(n) WHERE (o_orderkey + n % 8) % 5 <> 0 OR n // 8 + 1 <> 2)
        SELECT doc_id, {_PICK} FROM l WHERE page_no > 1 GROUP BY doc_id""",
    "fallback_fill": f"""WITH {BILLS}, f AS (SELECT *, l_orderkey % 3 AS j FROM bills)
        SELECT doc_id, CASE WHEN j = 0 THEN vendor ELSE vendor || ' Trading Pvt Ltd' END AS vendor, CASE WHEN j = 1 THEN 'KEPT-1' ELSE 'N-' || l_orderkey END AS invoice_number, '05-Mar-2024' AS invoice_date, 'P/' || l_suppkey AS po_number,
          CASE WHEN j = 2 THEN coalesce(subtotal, line_sum) ELSE line_sum END::DECIMAL(18,2) AS subtotal,
          (CASE WHEN j = 0 THEN coalesce(total, line_sum + tax_sum) ELSE line_sum + tax_sum END - line_sum)::DECIMAL(18,2) AS tax,
          CASE WHEN j = 0 THEN coalesce(total, line_sum + tax_sum) ELSE line_sum + tax_sum END::DECIMAL(18,2) AS total FROM f""",
    "value_labels": f"""WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, (12 + i * 3)::INT AS value_id, 'order #' || o_orderkey AS label FROM r UNION ALL SELECT o_custkey::VARCHAR, (22 + c * 3)::INT, 'Grand Total' FROM e""",
    "backward_match": "SELECT event_id, greatest((value >= 0)::INT + (value >= 100)::INT + (value >= 250)::INT + (value >= 900)::INT - 1, 0) AS \"column\" FROM events",
    "table_row_count": f"WITH l AS ({LINES}), o AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM l GROUP BY ALL) SELECT l_suppkey AS doc_id, sum(n - 1)::BIGINT AS n_table_rows FROM o GROUP BY l_suppkey",
    "ocr_mix": """WITH e AS (SELECT (user_id % 20)::VARCHAR AS doc_id, (user_id % 3)::INT AS page_no, event_id AS seq, event_type, CASE WHEN event_id % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS conf FROM events),
        g AS (SELECT doc_id, page_no, string_agg(event_type, chr(10) ORDER BY seq) AS t, sum(conf) AS s, count(*) AS n FROM e GROUP BY ALL),
        w AS (SELECT *, sum(CASE WHEN page_no = 0 THEN 300 ELSE 0 END) OVER (PARTITION BY doc_id) < 50 * count(*) OVER (PARTITION BY doc_id) OR page_no <> 0 AS scan FROM g)
        SELECT doc_id, md5(string_agg(CASE WHEN scan THEN t ELSE repeat('native text ', 30) END, chr(10) || chr(10) ORDER BY page_no)) AS text_md5, bool_or(scan) AS ocr_used,
          round(coalesce(sum(s) FILTER (scan) / sum(n) FILTER (scan), 1.0), 4) AS ocr_confidence FROM w GROUP BY doc_id""",
    "ocr_fallbacks": """SELECT doc_id::VARCHAR AS doc_id, md5(CASE WHEN doc_id % 2 = 1 THEN text || repeat(' native', 9) WHEN doc_id % 3 = 1 THEN 'scan of ' || doc_id ELSE '--- PAGE 1 ---' || left(source, 5) END) AS text_md5,
        doc_id % 2 = 0 AND doc_id % 3 = 1 AS ocr_used, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS ocr_confidence FROM documents""",
    "wide_line_columns": f"WITH l AS ({LINES}) SELECT doc_id, pos, l_partkey, l_partkey::VARCHAR AS description, CASE WHEN pos % 2 = 0 THEN quantity::INT::VARCHAR END AS qty, CASE WHEN pos % 2 = 1 THEN price::VARCHAR END AS rate FROM l",
    "text_cleanup": r"""WITH t AS (SELECT *, 'a' || chr(0) || 'b' || chr(7) || chr(9) || '--- page 7 ---' || text || '=== end === x' AS t FROM documents)
        SELECT doc_id, 'a-b' || chr(9) || '--- page 7 ---' || regexp_replace(text, '[\x01-\x08\x0A-\x1F]', '', 'g') || '=== end === x' AS cleaned,
          trim(regexp_replace('a' || chr(0) || 'b' || chr(7) || chr(9) || regexp_replace(text, '(?i)---\s*PAGE\s*\d+\s*---', '', 'g') || '=== end === x', '===.*?===', '', 'g')) AS unmarked,
          least(greatest(floor((n_chars * 200 + 1500) * 1.2)::INT, 4096), 200000) AS budget, upper(source[1]) || source[2:] || ' Total Amount' AS title FROM t""",
    "history_batches": f"""WITH {BILLS} SELECT l_orderkey * 1000 + l_suppkey + 10 AS history_seq, CASE WHEN total IS NULL THEN '2024-01-02' ELSE '2024-01-01' END AS processed_at, source_file, vendor, coalesce(invoice_number, '') AS invoice_number,
        coalesce(invoice_date, '') AS invoice_date, coalesce(total::VARCHAR, '') AS total, vendor AS file_hash, CASE WHEN total IS NULL THEN 'REVIEW' ELSE 'OK' END AS status FROM bills""",
    "audit_log": "SELECT event_id AS seq, event_type AS event, '[REDACTED] by ' || event_type AS detail, user_id::VARCHAR AS user FROM events ORDER BY event_id DESC LIMIT 500",
    "scanned_states": rf"""SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 7 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE {_CONTENT} < 50 END AS scanned FROM (SELECT doc_id, text AS t FROM documents)""",
    "layout_text": """WITH r AS (SELECT o_custkey AS d, o_orderkey % 2 + 1 AS p, o_orderkey % 3 AS s, o_orderkey AS n, CASE WHEN o_orderkey % 5 <> 0 THEN 'n ' || o_orderkey || ' | ' || o_orderstatus END AS line FROM orders),
        t AS (SELECT d, p, chr(10) || '=== STRUCTURED TABLES ===' || chr(10) || '[Table 1]' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY n) || chr(10), '') AS t FROM (SELECT *, min(s) OVER (PARTITION BY d, p) AS f FROM r) WHERE s = f GROUP BY d, p)
        SELECT d::VARCHAR AS doc_id, string_agg('--- PAGE ' || p || ' ---' || t || chr(10) || '=== RAW PAGE TEXT ===' || chr(10) || 'page of ' || d, chr(10) ORDER BY p) AS text FROM t GROUP BY d""",
    "prompt_parts": f"""WITH s AS (SELECT doc_id, text, concat_ws(chr(10), {", ".join(f"CASE WHEN doc_id % {k} = 0 THEN '  {label}: ' || n_chars END" for k, label in zip((2, 3, 5, 7, 11, 13, 17, 19), SUMMARY_NAMES.values()))}) AS l FROM documents)
        SELECT doc_id, CASE WHEN l <> '' THEN 'Figures printed at the end of the document:' || chr(10) || l ELSE '' END AS summary, doc_id % 2 <> 0 AND len(text) // 4 > 2500 AS compact FROM s""",
    "written_templates": f"""WITH {_STATEMENTS}, n AS (SELECT o_custkey, least(count(*), 400) AS c FROM w GROUP BY o_custkey)
        SELECT o_custkey::VARCHAR AS doc_id, CASE WHEN c <= 40 THEN '{{"vendor": "V", "fields": {{"total": {{"anchor": "Grand Total"}}}}, "words": ' || c || '}}' END AS template, CASE WHEN c <= 40 THEN '' ELSE 'no template in the answer' END AS problem FROM n""",
    "history_tail": f"WITH {BILLS} SELECT l_orderkey * 1000 + l_suppkey AS history_seq, vendor, invoice_number FROM bills ORDER BY 1 DESC LIMIT 200",
    "arrival_order": "SELECT doc_id, (row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1)::INT AS seen FROM documents",
}
