"""DuckDB SQL for the queries of ``more_queries``."""

from __future__ import annotations

from tallyforge.plans.oracle import _STAGES, BILLS, LINES

_PAGES = "p AS (SELECT (doc_id // 5)::VARCHAR AS doc_id, (doc_id % 5 + 1)::INT AS page_no, text, n_chars::DOUBLE AS height, doc_id // 5 AS d FROM documents)"
_CONTENT = r"len(regexp_replace(regexp_replace(regexp_replace(t, '---\s*PAGE\s*\d+\s*---', '', 'gi'), '===\s*.*?\s*===', '', 'g'), '[^a-zA-Z0-9]', '', 'g'))"
_WORDS = rf"""lines AS ({LINES}), words AS (SELECT doc_id, pos::INT AS word_no, 't' || (l_suppkey % 3) AS template_id, l_partkey AS part, ((l_partkey * 37 + pos * 11) % 500)::DOUBLE AS x0, ((l_partkey * 37 + pos * 11) % 500)::DOUBLE + 20 + quantity AS x1 FROM lines)"""
_COLUMNS = "cols AS (SELECT 't' || t AS template_id, i::INT AS ord, 'c' || i AS name, 100.0::DOUBLE * i - 10 * t AS x_min, 100.0::DOUBLE * (i + 1) - 10 * t - CASE WHEN i = 2 THEN 15 ELSE 0 END AS x_max FROM range(3) a(t), range(5) b(i))"
_SUFFIX = "pvt ltd|private limited|limited| ltd| llp| inc| llc| gmbh| corp| corporation| co\\.| company| enterprises| technologies| solutions| systems| industries| traders"
_SKIP = "^(tax invoice|invoice|bill|receipt|original for|duplicate for|triplicate|credit note|debit note|proforma)"
_HEADERISH = "['customer','order','size','pickup','time','qty','qty.','item','items','price','subtotal','total','amount','description','date','bill','ship','to','from','sl','no','hsn','sac','rate','tax']"
_INVOICES = rf"""{BILLS}, inv AS (SELECT *, (tax_sum::DECIMAL(24,6) * 0.5)::DECIMAL(18,2) AS half FROM bills)"""

MORE = {
    "scanned_flag": rf"""WITH {_PAGES}, s AS (SELECT doc_id, text AS t FROM p)
        SELECT doc_id, sum({_CONTENT})::BIGINT AS n_content, count(*) AS n_pages, sum({_CONTENT}) < 50 * count(*) AS scanned FROM s GROUP BY doc_id""",
    "page_source": rf"""WITH {_PAGES}, s AS (SELECT doc_id, page_no, text AS t FROM p), n AS (SELECT *, {_CONTENT} AS c FROM s)
        SELECT doc_id, page_no, CASE WHEN c >= 50 AND NOT sum(c) OVER (PARTITION BY doc_id) < 50 * count(*) OVER (PARTITION BY doc_id) THEN 'native' ELSE 'ocr' END AS page_source FROM n""",
    "ocr_tag": r"""WITH b AS (SELECT (user_id % 50)::VARCHAR AS doc_id, (event_id % 7)::INT AS page_no, event_id AS seq, event_type AS t, (((floor(value * 7)::BIGINT % 100) + 100) % 100)::DOUBLE / 100 * CASE WHEN user_id % 50 % 3 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM events),
        k AS (SELECT *, max((conf >= 0.4)::INT) OVER (PARTITION BY doc_id, page_no) = 1 AS any_ FROM b)
        SELECT doc_id, page_no, seq, CASE WHEN conf >= 0.5 THEN t WHEN conf >= 0.4 THEN '[?' || t || '?]' ELSE '[??' || t || '??]' END AS tagged, conf FROM k WHERE CASE WHEN any_ THEN conf >= 0.4 ELSE conf > 0.1 END""",
    "page_offset": rf"WITH {_PAGES} SELECT doc_id, page_no, height, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS \"offset\" FROM p".replace('\\"', '"'),
    "text_line_scan": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) - 1 AS i FROM documents)
        SELECT doc_id, count(*) AS n_lines, max(i)::INT AS last_line, sum(len(t))::BIGINT AS n_chars FROM l WHERE trim(t) <> '' GROUP BY doc_id""",
    "vendor_guess": rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Tax Invoice' || chr(10) || 'sl no qty rate' || chr(10) || upper(source[1]) || source[2:] || '  Trading  Pvt Ltd   Invoice No 12' || chr(10) || text ELSE text END AS text FROM documents),
        l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS ls FROM d),
        u AS (SELECT doc_id, unnest(ls[1:25]) AS s, generate_subscripts(ls[1:25], 1) AS i FROM l),
        h AS (SELECT *, len(list_filter(list_transform(string_split(lower(s), ' '), lambda t: trim(t, ':.')), lambda t: list_contains({_HEADERISH}, t))) AS hits, len(string_split(s, ' ')) AS n FROM u),
        f AS (SELECT *, regexp_matches(lower(s), '{_SKIP}') OR (hits >= 2 AND hits >= n / 2.0) AS unfit, trim(regexp_replace(s, '\s+(invoice\s*(no|number|date)|bill\s*(no|number|date)|receipt\s*no|date|gstin|po\s*number|order\s*ref|tax\s*invoice)\b.*$', '', 'i'), ' -|,') AS c FROM h),
        g AS (SELECT doc_id, min_by(c, i) FILTER (NOT unfit AND regexp_matches(lower(s), '{_SUFFIX}') AND len(c) > 3 AND len(c) <= 70) AS a,
          min_by(s, i) FILTER (i <= 15 AND len(s) BETWEEN 4 AND 70 AND NOT unfit AND NOT contains(s, ':') AND NOT regexp_matches(s, '\d{{2,}}')) AS b FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(a, b, '') AS vendor_guess FROM d LEFT JOIN g USING (doc_id)""",
    "template_match": r"""WITH k(template_id, ord, keyword) AS (VALUES ('t_licence', 0, 'Apache License'), ('t_gnu', 1, 'GNU General Public License'), ('t_words', 2, 'reserved rights all'), ('t_the', 3, 'then the'), ('t_de', 4, 'und der')),
        s AS (SELECT doc_id, template_id, ord, keyword, CASE WHEN contains(lower(text), lower(keyword)) THEN 1.0 WHEN list_bool_and(list_transform(string_split(lower(keyword), ' '), lambda w: contains(lower(text), w))) THEN 0.85 ELSE 0.0 END::DOUBLE AS score FROM documents, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM s WHERE score > 0)
        SELECT d.doc_id, template_id, keyword, score FROM documents d LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (doc_id)""",
    "summary_block": rf"""WITH lines AS ({LINES}), t AS (SELECT l_suppkey AS doc_id, l_orderkey % 4 AS page_no, l_orderkey * 100000 + l_partkey * 10 + pos AS line_no,
          CASE pos % 4 WHEN 0 THEN 'Sub Total ' || amount WHEN 1 THEN 'CGST @ 9% ' || tax_amount WHEN 2 THEN 'GRAND TOTAL: INR ' || format('{{:,.2f}}', price::DOUBLE) ELSE 'Rounding n/a ' || quantity::INT END AS text FROM lines),
        f AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last, lower(text) AS low, replace(regexp_extract_all(text, '[\d,]+\.?\d*')[-1], ',', '') AS v FROM t)
        SELECT doc_id, min_by(v, (page_no, line_no)) FILTER (low LIKE '%sub total%') AS subtotal, min_by(v, (page_no, line_no)) FILTER (low LIKE '%cgst%') AS cgst, min_by(v, (page_no, line_no)) FILTER (low LIKE '%rounding%') AS round_off,
          min_by(v, (page_no, line_no)) FILTER (low LIKE '%grand total%') AS grand_total FROM f WHERE page_no > last - 2 GROUP BY doc_id""",
    "fallback_values": r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A-' || doc_id || '/7' WHEN n_chars >= 100 THEN n_chars::VARCHAR ELSE 'A-' || doc_id END AS number, CASE WHEN doc_id % 2 = 0 THEN 'PO-' || n_chars ELSE n_chars::VARCHAR END AS po, '2024-0' || (doc_id % 9 + 1) || '-11' AS dated FROM documents",
    "nearest_band": rf"""WITH {_WORDS}, {_COLUMNS}, h AS (SELECT doc_id, word_no, part, x0, x1, name, ord, CASE WHEN x_min <= (x0 + x1) / 2 AND (x0 + x1) / 2 < x_max THEN 0 ELSE 1 END AS rule
          FROM words JOIN cols USING (template_id) WHERE (x_min <= (x0 + x1) / 2 AND (x0 + x1) / 2 < x_max) OR (x_min <= x0 AND x0 < x_max))
        SELECT doc_id, word_no, part, x0, x1, min_by(name, (rule, ord)) AS "column" FROM h GROUP BY ALL""",
    "nearest_header": rf"""WITH {_WORDS}, {_COLUMNS} SELECT doc_id, word_no, part, x0, min_by(name, (abs(x_min - x0), ord)) AS "column" FROM words JOIN cols USING (template_id) GROUP BY ALL""",
    "midpoint_columns": "SELECT o_custkey::VARCHAR AS doc_id, name, x0::DOUBLE AS x0, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('Description', 50, -1e9, 175), ('Amount', 300, 175, 1e9)) v(name, x0, lo, hi)",
    "gap_columns": rf"""WITH {_WORDS}, x AS (SELECT DISTINCT doc_id, (round_even(x0 / 10, 0) * 10)::BIGINT AS x FROM words), g AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS gap FROM x)
        SELECT doc_id, string_agg(x::VARCHAR, ',' ORDER BY x) AS boundaries FROM g WHERE gap IS NULL OR gap >= 20 GROUP BY doc_id""",
    "carry_forward": "SELECT * FROM (SELECT user_id AS doc_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events) WHERE carried IS NOT NULL",
    "continuation_merge": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) - 1 AS i FROM documents),
        r AS (SELECT doc_id, i, t AS d, CASE WHEN len(t) % 3 = 0 THEN len(t)::VARCHAR ELSE '' END AS amount, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE trim(t) <> ''),
        s AS (SELECT *, sum(CASE WHEN n > 1 AND trim(d) <> '' AND amount = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r)
        SELECT doc_id::VARCHAR AS doc_id, min(i)::INT AS row_no, CASE WHEN count(*) > 1 THEN trim(string_agg(trim(d), ' ' ORDER BY i)) ELSE min(d) END AS description, min_by(amount, i) AS amount FROM s GROUP BY doc_id, g""",
    "total_rows": rf"""WITH lines AS ({LINES}), o AS (SELECT doc_id, concat_ws('-', pos, l_partkey, amount) AS pos, l_partkey::VARCHAR AS description, max(amount) AS amount, max(tax_amount) AS tax_amount FROM lines GROUP BY 1, 2, 3)
        SELECT doc_id, pos, description, amount, tax_amount, 0 AS is_total FROM o UNION ALL SELECT doc_id, NULL, 'TOTAL', sum(amount), sum(tax_amount), 1 FROM o GROUP BY doc_id""",
    "ledger_entries": rf"""WITH {_INVOICES}, e AS (SELECT doc_id, vendor AS ledger, 'No' AS deemed_positive, coalesce(total, 0) AS amount, 0 AS entry_no FROM inv
          UNION ALL SELECT doc_id, 'Purchase Accounts', 'Yes', -coalesce(subtotal, total, 0), 1 FROM inv
          UNION ALL SELECT doc_id, 'CGST', 'Yes', -half, 2 FROM inv WHERE l_suppkey % 2 = 0 UNION ALL SELECT doc_id, 'SGST', 'Yes', -half, 3 FROM inv WHERE l_suppkey % 2 = 0
          UNION ALL SELECT doc_id, 'Input Tax', 'Yes', -tax, 2 FROM inv WHERE l_suppkey % 2 = 1 AND coalesce(tax, 0) <> 0)
        SELECT doc_id, entry_no::INT AS entry_no, ledger, deemed_positive, amount::DECIMAL(18,2) AS amount FROM e""",
    "bill_export_rows": rf"""WITH {BILLS} SELECT b.doc_id, pos::INT AS pos, coalesce(invoice_number, '') AS bill_no, vendor AS supplier, coalesce(invoice_date, '') AS bill_date, '' AS due_date, '' AS po_number, coalesce(l_partkey::VARCHAR, '') AS item_description,
          coalesce(quantity::INT::VARCHAR, '') AS qty, coalesce(price::VARCHAR, '') AS rate, coalesce(l.amount::VARCHAR, '') AS amount, coalesce(CASE WHEN pos % 2 = 0 THEN tax_amount::VARCHAR END, '') AS tax_amount,
          coalesce(subtotal::VARCHAR, '') AS bill_subtotal, coalesce(tax::VARCHAR, '') AS bill_tax, coalesce(total::VARCHAR, '') AS bill_total, CASE WHEN b.l_suppkey % 2 = 1 THEN 'USD' ELSE 'INR' END AS currency
        FROM bills b LEFT JOIN lines l ON b.doc_id = l.doc_id""",
    "json_export": rf"""WITH {BILLS} SELECT doc_id, '{{"doc_id":"' || doc_id || '","vendor":"' || vendor || '","invoice_number":' || coalesce('"' || invoice_number || '"', 'null') || ',"total":' || coalesce('"' || total || '"', 'null') || '}}' AS json FROM bills""",
    "audit_tail": "SELECT event_id AS seq, event_type AS event, user_id::VARCHAR AS \"user\" FROM events ORDER BY event_id DESC LIMIT 300",
    "audit_events": "SELECT event_type AS event, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) FILTER (event_id % 7 = 0) AS failures FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type",
    "props_json": "SELECT event_id, coalesce(json_valid(props), false) AS readable FROM events",
    "ai_guard": f"""SELECT doc_id, true AS allowed, left(CASE WHEN doc_id % 3 = 0 THEN text ELSE t END, 60000) AS prepared,
        concat_ws('; ', CASE WHEN doc_id % 3 <> 0 AND n > 0 THEN 'redacted ' || n || ' personal/banking identifier(s)' END, CASE WHEN len(CASE WHEN doc_id % 3 = 0 THEN text ELSE t END) > 60000 THEN 'truncated to 60000 characters' END) AS note FROM {_STAGES}""",
}
