"""DuckDB SQL for the queries of ``document_queries``."""

from __future__ import annotations

from tallyforge.plans.more_oracle import _INVOICES, _WORDS
from tallyforge.plans.oracle import BILLS, VALIDATED

_STATEMENTS = """r AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(18,2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
e AS (SELECT o_custkey, sum(price)::DECIMAL(18,2) AS s, count(*) AS c FROM r GROUP BY o_custkey),
w AS (SELECT o_custkey, 10 + i * 3 AS word_no, 'order' AS text, 50 AS x0, i * 12 + 60 AS top FROM r UNION ALL SELECT o_custkey, 11 + i * 3, '#' || o_orderkey, 90, i * 12 + 60 FROM r UNION ALL SELECT o_custkey, 12 + i * 3, price::VARCHAR, 300, i * 12 + 60 FROM r
  UNION ALL SELECT o_custkey, n, CASE WHEN n = 3 THEN 'C-' || o_custkey ELSE t END, x, y FROM e, (VALUES (0, 'Statement', 50, 10), (1, 'No', 90, 10), (2, ':', 122, 10), (3, '', 130, 10), (4, 'Description', 50, 60), (5, 'Amount', 300, 60)) v(n, t, x, y)
  UNION ALL SELECT o_custkey, 20 + c * 3 + n, CASE WHEN n = 2 THEN s::VARCHAR ELSE t END, x, c * 12 + 90 FROM e, (VALUES (0, 'Grand', 200), (1, 'Total', 235), (2, '', 300)) v(n, t, x))"""

#: Candidates ``o`` (doc_id, n, kind, x0, x1), one after the other, against those kept so far.
_KEEP = """walk AS (
    SELECT doc_id, n, kind, x0, x1, [{'a': x0, 'b': x1}] AS held, true AS keep FROM o WHERE n = 1
    UNION ALL SELECT doc_id, n, kind, x0, x1, CASE WHEN k THEN list_append(held, {'a': x0, 'b': x1}) ELSE held END, k
      FROM (SELECT o.*, w.held, o.kind = 0 OR len(list_filter(w.held, lambda h: h.a <= o.x1 AND o.x0 <= h.b)) = 0 AS k FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1)),
  kept AS (SELECT * FROM walk WHERE keep)"""

DOCUMENTS = {
    "template_extract": f"""WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'Orders Inc' AS vendor, 'C-' || o_custkey AS invoice_number, s::DOUBLE AS total, s::DOUBLE AS subtotal, 0.0::DOUBLE AS tax, c::INT AS n_lines, s::DOUBLE AS line_sum,
        (SELECT price::DOUBLE FROM r WHERE r.o_custkey = e.o_custkey AND i = 1) AS first_amount FROM e""",
    "table_read": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, 'order #' || o_orderkey AS description, price::VARCHAR AS amount FROM r",
    "word_lines": f"WITH {_STATEMENTS} SELECT o_custkey::VARCHAR AS doc_id, round_even(top / 5.0::DOUBLE, 0)::BIGINT AS line_key, string_agg(text, ' ' ORDER BY x0, word_no) AS line FROM w GROUP BY 1, 2",
    "gap_cells": rf"""WITH {_WORDS}, d AS (SELECT DISTINCT doc_id, word_no, part, x0 + part / 100000::DOUBLE AS x0, x1, amount FROM (SELECT words.*, lines.amount FROM words JOIN lines ON lines.doc_id = words.doc_id AND lines.pos = words.word_no AND lines.l_partkey = words.part AND words.x1 = ((lines.l_partkey * 37 + lines.pos * 11) % 500)::DOUBLE + 20 + lines.quantity)),
        b AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1) > 18 THEN 1 ELSE 0 END AS k FROM d)
        SELECT doc_id, word_no, part, (sum(k) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cell_no FROM b""",
    "model_answers": f"""WITH {BILLS} SELECT doc_id, vendor, invoice_number, NULL::VARCHAR AS po_number, CASE WHEN l_orderkey % 3 = 0 AND tax_sum > 0 THEN tax_sum WHEN l_orderkey % 3 = 1 THEN tax_sum ELSE total - subtotal END::DECIMAL(18,2) AS tax, total, 1 AS n_lines, line_sum FROM bills""",
    "answer_scores": f"""WITH {VALIDATED} SELECT doc_id, (CASE WHEN validation_ok THEN 10 ELSE 0 END - (n1 IS NOT NULL)::INT - (n2 IS NOT NULL)::INT - (n3 IS NOT NULL)::INT - (n4 IS NOT NULL)::INT - (n5 IS NOT NULL)::INT + CASE WHEN total IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN subtotal IS NOT NULL THEN 1 ELSE 0 END + n_lines)::BIGINT AS score,
        n3 IS NOT NULL OR n4 IS NOT NULL OR n5 IS NOT NULL AS math_failure FROM validated""",
    "edit_override": f"""WITH {BILLS} SELECT doc_id, l_suppkey, CASE WHEN l_suppkey > 50 THEN CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE upper(vendor) END ELSE vendor END AS vendor, invoice_number,
        CASE WHEN l_suppkey > 50 THEN CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END ELSE total END::DECIMAL(18,2) AS total FROM bills""",
    "nearest_click": f"""WITH {_STATEMENTS}, k AS (SELECT o_custkey, word_no, sqrt(power(greatest(x0 - 285.0, 0.0, 285.0 - x0 - 30), 2) + power(greatest(top - y, 0.0, y - top - 9), 2)) AS d FROM (SELECT *, (o_custkey % 200 + 20)::DOUBLE AS y FROM w))
        SELECT o_custkey::VARCHAR AS doc_id, 1 AS click_id, min_by(word_no, (d, word_no))::INT AS box_id FROM k WHERE d <= 70 GROUP BY o_custkey""",
    "wide_export": f"""WITH {_INVOICES} SELECT source_file, vendor, total::VARCHAR AS total, CASE WHEN total IS NOT NULL THEN 'OK' ELSE 'CHECK' END AS validation_ok, 'a; b' AS validation_notes, CASE WHEN l_suppkey % 2 = 0 THEN half::VARCHAR END AS cgst, CASE WHEN l_suppkey % 2 = 0 THEN half::VARCHAR END AS sgst,
        CASE WHEN l_suppkey % 2 = 1 THEN 'USD' END AS currency FROM inv""",
    "file_identity": "SELECT doc_id, left(sha256(text), 16) AS file_hash, strlen(text)::BIGINT AS n_bytes FROM documents",
    "admission": """SELECT 'in/' || doc_id || '.pdf' AS path, CASE WHEN strlen(text) * 1024 > 5 * 1024 * 1024 THEN doc_id || '.pdf is larger than the 5 MB limit.' WHEN doc_id % 3 <> 0 THEN doc_id || '.pdf is not a valid PDF (missing PDF signature).' ELSE '' END AS reason FROM documents""",
    "typed_projection": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey::DOUBLE END AS number_value, CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_value, CASE WHEN o_orderkey % 4 = 3 THEN 'Rs ' || o_orderkey END AS text_value FROM orders""",
    "sql_functions": r"""SELECT p_partkey, p_retailprice AS n, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, lower(p_brand) || '|' || p_size || 'a' AS k, p_size BETWEEN 0 AND 999 AS amount FROM part""",
    "overlap_candidates": rf"""WITH RECURSIVE {_WORDS}, c AS (SELECT DISTINCT doc_id, (part % 4)::INT AS kind, x0 + part % 7 AS x0, x1 + part % 5 AS x1 FROM words),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, x0, x1) AS n FROM c), {_KEEP},
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, round_even(x0, 0), round_even(x1, 0) ORDER BY n) AS m FROM kept) SELECT doc_id, count(*) AS n, sum(x0) AS sum_x0 FROM f WHERE m = 1 GROUP BY doc_id""",
    "overlap_chains": rf"""WITH RECURSIVE l AS (SELECT l_orderkey AS doc_id, l_linenumber, sum(l_quantity)::DOUBLE AS q, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
        c AS (SELECT doc_id, l_linenumber, (p % 3)::INT AS kind, l_linenumber * 10.0::DOUBLE AS x0, l_linenumber * 10.0::DOUBLE + CASE WHEN q > 25 THEN 10 ELSE q % 9 END AS x1 FROM l),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, x0, x1) AS n FROM c), {_KEEP} SELECT doc_id, kind, x0, x1, l_linenumber FROM kept JOIN c USING (doc_id, kind, x0, x1)""",
    "tax_names": f"""WITH {BILLS} SELECT doc_id, 5 AS n_extra, 'INR' AS currency, tax_sum::DECIMAL(18,2)::VARCHAR AS "VAT", n_lines::DECIMAL(18,2)::VARCHAR AS "VAT_amount", '5.00' AS currency_amount, '0.50' AS tax, (tax_sum + 1.25 + 5 + n_lines + 0.5)::DECIMAL(18,2) AS tax_sum FROM bills WHERE tax_sum IS NOT NULL""",
}
