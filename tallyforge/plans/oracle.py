"""DuckDB SQL for the registered queries."""

from __future__ import annotations

LINES = r"""
SELECT 'INV-' || l_orderkey || '-' || l_suppkey AS doc_id, l_orderkey, l_suppkey, l_partkey, l_linenumber AS pos, l_quantity AS quantity, l_extendedprice::DECIMAL(18,2) AS price,
  round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2) AS amount,
  round(round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2) * l_tax::DECIMAL(4,2), 2)::DECIMAL(18,2) AS tax_amount, round(l_tax * 100, 0) AS tax_rate
FROM lineitem"""

BILLS = rf"""
lines AS ({LINES}),
sums AS (SELECT doc_id, l_orderkey, l_suppkey, sum(amount)::DECIMAL(18,2) AS line_sum, sum(tax_amount)::DECIMAL(18,2) AS tax_sum, count(*) AS n_lines, max(tax_rate) AS max_rate FROM lines GROUP BY ALL),
bills AS (
  SELECT doc_id, l_orderkey, l_suppkey, doc_id || '.pdf' AS source_file, s_name AS vendor, CASE WHEN k % 13 <> 0 THEN doc_id END AS invoice_number,
    CASE WHEN k % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date, c_name AS bill_to, n_lines, line_sum, tax_sum, max_rate,
    CASE WHEN k % 23 <> 0 THEN line_sum END AS subtotal, CASE WHEN k % 3 <> 0 THEN tax_sum END AS tax,
    CASE WHEN k % 19 <> 0 THEN (line_sum + tax_sum + CASE WHEN k % 5 = 0 THEN 0.50 ELSE 0.00 END) END::DECIMAL(18,2) AS total
  FROM (SELECT *, l_orderkey + l_suppkey AS k FROM sums) JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey)"""

VALIDATED = rf"""
{BILLS},
taxed AS (SELECT * EXCLUDE (tax), coalesce(tax, total - subtotal)::DECIMAL(18,2) AS tax FROM bills),
noted AS (
  SELECT *, CASE WHEN invoice_number IS NULL THEN 'Missing invoice number' END AS n1, CASE WHEN invoice_date IS NULL THEN 'Missing invoice date' END AS n2, CASE WHEN total IS NULL THEN 'Missing total' END AS n3,
    CASE WHEN n_lines > 0 AND (subtotal IS NOT NULL OR total IS NOT NULL) AND NOT (coalesce(abs(line_sum - subtotal) <= 0.02, false) OR coalesce(abs(line_sum - total) <= 0.02, false))
      THEN 'Line items sum to ' || line_sum || ', expected ' || concat_ws(' / ', subtotal::VARCHAR, total::VARCHAR) END AS n4,
    CASE WHEN abs(subtotal + coalesce(tax, 0) - total) > 0.02 THEN 'Subtotal ' || subtotal || ' + tax ' || coalesce(tax, 0)::DECIMAL(18,2) || ' != total ' || total END AS n5
  FROM taxed),
validated AS (
  SELECT *, concat_ws('; ', n1, n2, n3, n4, n5) AS vnotes, concat_ws('; ', n1, n2, n3, n4, n5) = '' AS validation_ok,
    greatest(100 - 15 * ((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT) - 25 * ((n4 IS NOT NULL)::INT + (n5 IS NOT NULL)::INT), 0) / 100.0::DOUBLE AS confidence
  FROM noted)"""

PRINTED = r"""
printed_lines AS (
  SELECT doc_id, unnest([0, 1, 2, 3]) AS line_no, unnest(['Invoice', 'Sub Total: ' || line_sum, 'Total tax ' || tax_sum,
    CASE WHEN l_orderkey % 9 <> 0 THEN 'Grand Total USD ' ELSE 'TOTAL ' END || (line_sum + tax_sum + CASE l_orderkey % 4 WHEN 1 THEN 0.80 WHEN 0 THEN 50.00 ELSE 0.00 END)::DECIMAL(18,2)]) AS text
  FROM bills),
figures AS (SELECT doc_id, line_no, lower(text) AS low, replace(regexp_extract_all(text, '\d[\d,]*\.\d{2}')[-1], ',', '')::DOUBLE AS v FROM printed_lines),
printed AS (
  SELECT doc_id, coalesce(min_by(v, line_no) FILTER (v IS NOT NULL AND regexp_matches(low, 'invoice total|grand total|total payable|amount payable|total due|net payable|total amount|balance due')),
      min_by(v, line_no) FILTER (v IS NOT NULL AND low LIKE '%total%' AND NOT regexp_matches(low, 'sub total|subtotal|taxable|tax|before')))::DECIMAL(18,2) AS printed_total,
    (min_by(v, line_no) FILTER (v IS NOT NULL AND regexp_matches(low, 'sub total|subtotal|taxable value|taxable amount|total before tax|amount before tax|net amount|net total|total \(excl')))::DECIMAL(18,2) AS printed_subtotal
  FROM figures GROUP BY doc_id)"""

RECONCILE = rf"""
WITH {VALIDATED}, {PRINTED},
both_ AS (
  SELECT v.*, printed_total, printed_subtotal, (printed_total - printed_subtotal)::DECIMAL(18,2) AS printed_tax, line_sum AS line_items_sum,
    abs(printed_total - total) <= 1.5 AS total_match, abs(printed_subtotal - subtotal) <= 1.5 AS subtotal_match, abs(printed_total - printed_subtotal - tax) <= 1.5 AS tax_match,
    CASE WHEN printed_total IS NOT NULL OR printed_subtotal IS NOT NULL THEN coalesce(abs(line_sum - printed_total) <= 1.5, false) OR coalesce(abs(line_sum - printed_subtotal) <= 1.5, false) END AS lines_reconcile
  FROM validated v LEFT JOIN printed USING (doc_id))
SELECT doc_id, printed_total, printed_subtotal, printed_tax, line_items_sum, total_match, subtotal_match, tax_match, lines_reconcile,
  CASE WHEN printed_total IS NOT NULL AND coalesce(total_match, true) AND coalesce(subtotal_match, true) AND coalesce(lines_reconcile, true) AND validation_ok THEN 'OK' ELSE 'REVIEW' END AS status,
  concat_ws('; ', CASE WHEN printed_total IS NULL THEN 'couldn''t find a printed grand total to compare against' END,
    CASE WHEN NOT total_match THEN 'extracted total ' || total || ' != printed ' || printed_total || ' (diff ' || (total - printed_total)::DECIMAL(18,2) || ')' END,
    CASE WHEN NOT subtotal_match THEN 'extracted subtotal ' || subtotal || ' != printed ' || printed_subtotal END,
    CASE WHEN NOT lines_reconcile THEN 'sum of line totals ' || line_sum || ' matches neither printed subtotal (' || coalesce(printed_subtotal::VARCHAR, 'None') || ') nor total (' || coalesce(printed_total::VARCHAR, 'None') || ') - a line may be missing or misread' END,
    CASE WHEN NOT validation_ok THEN 'failed internal arithmetic check' END) AS notes
FROM both_"""

_RATES = "CASE WHEN max_rate NOT IN (0, 0.25, 3, 5, 12, 18, 28) THEN 'line 1: tax rate ' || max_rate || '% is not an allowed rate' END"

BATCH = "batch AS (SELECT 'doc-' || doc_id AS source_file, source AS vendor, 'N ' || (doc_id % 997) AS invoice_number, left(sha256(text), 16) AS file_hash, doc_id AS batch_pos FROM documents)"

ORACLE = {
    "validate_bills": f"WITH {VALIDATED} SELECT doc_id, tax, validation_ok, confidence, vnotes AS notes FROM validated",
    "validation_status": f"WITH {VALIDATED} SELECT validation_ok, confidence, count(*) AS n, sum(total)::DECIMAL(18,2) AS total FROM validated GROUP BY ALL",
    "printed_totals": f"WITH {BILLS}, {PRINTED} SELECT * FROM printed",
    "reconcile_bills": RECONCILE,
    "rules_default": rf"""WITH {BILLS} SELECT doc_id, concat_ws('; ', CASE WHEN invoice_date IS NULL THEN 'missing required field ''invoice_date''' END,
        CASE WHEN invoice_number IS NULL THEN 'missing an identifier - need one of: invoice_number / bill_number / order_number / receipt_number' END,
        CASE WHEN total IS NULL THEN 'no invoice total found' END,
        CASE WHEN total > 50000 THEN 'total ' || format('{{:,.2f}}', total::DOUBLE) || ' exceeds the approval threshold 50,000.00' END,
        CASE WHEN total < 1000 THEN 'total ' || format('{{:,.2f}}', total::DOUBLE) || ' is below the minimum 1,000.00' END,
        CASE WHEN invoice_date > '1998-06-01' THEN 'invoice date ' || invoice_date || ' is in the future' END,
        CASE WHEN date_diff('day', invoice_date::DATE, DATE '1998-06-01') > 2000 THEN 'invoice is older than 2000 days (dated ' || invoice_date || ')' END) AS failures FROM bills""",
    "rules_strict": rf"""WITH {BILLS} SELECT doc_id, concat_ws('; ', CASE WHEN invoice_date IS NULL THEN 'missing required field ''invoice_date''' END,
        CASE WHEN invoice_number IS NULL THEN 'missing an identifier - need one of: invoice_number / bill_number / order_number' END,
        CASE WHEN l_suppkey % 3 <> 0 THEN 'no customer / ''bill to'' details found' END, CASE WHEN l_suppkey % 3 <> 0 THEN 'no GST/VAT/tax registration number found' END,
        'no regulatory details found (HSN/SAC, PAN, CIN, place of supply...)',
        CASE WHEN l_suppkey % 3 = 0 THEN 'no tax breakup found - expected CGST + SGST, or IGST' END,
        CASE WHEN subtotal IS NULL THEN 'no sub total found' END, CASE WHEN total IS NULL THEN 'no invoice total found' END,
        CASE WHEN invoice_date > '1998-06-01' THEN 'invoice date ' || invoice_date || ' is in the future' END, {_RATES}) AS failures FROM bills""",
    "rules_by_vendor": rf"""WITH {BILLS} SELECT doc_id, concat_ws('; ', CASE WHEN invoice_date IS NULL THEN 'missing required field ''invoice_date''' END,
        CASE WHEN invoice_number IS NULL THEN 'missing an identifier - need one of: invoice_number / bill_number / order_number / receipt_number' END,
        CASE WHEN subtotal IS NULL AND l_suppkey % 2 = 1 THEN 'no sub total found' END, CASE WHEN total IS NULL AND l_suppkey % 2 = 0 THEN 'no invoice total found' END,
        CASE WHEN l_suppkey % 2 = 1 AND NOT regexp_full_match(invoice_number, 'INV-\d{{1,3}}-\d+') THEN '''invoice_number'' (' || invoice_number || ') doesn''t match the expected format' END,
        CASE WHEN invoice_date > '1998-06-01' THEN 'invoice date ' || invoice_date || ' is in the future' END) AS failures FROM bills""",
    "dup_in_batch": rf"""WITH {BATCH}, seen AS (SELECT *, min(batch_pos) OVER h AS hp, first_value(source_file) OVER h AS hf, min(batch_pos) OVER k AS kp, first_value(source_file) OVER k AS kf FROM batch
        WINDOW h AS (PARTITION BY file_hash ORDER BY batch_pos), k AS (PARTITION BY lower(vendor), replace(lower(invoice_number), ' ', '') ORDER BY batch_pos))
        SELECT source_file, file_hash, CASE WHEN hp < batch_pos THEN hf WHEN kp < batch_pos THEN kf ELSE '' END AS duplicate_of,
        CASE WHEN hp < batch_pos THEN 'identical file already in this batch' WHEN kp < batch_pos THEN 'same vendor & invoice number in this batch' ELSE '' END AS duplicate_note FROM seen""",
    "dup_vs_history": rf"""WITH {BILLS}, b AS (SELECT *, left(sha256(concat_ws('|', vendor, total::VARCHAR)), 16) AS h, l_orderkey * 100000 + l_suppkey AS pos, lower(vendor) || '|' || lower(invoice_number) AS k FROM bills),
        old AS (SELECT * FROM b WHERE invoice_date < '1995-01-01'), new AS (SELECT * FROM b WHERE invoice_date >= '1995-01-01' OR invoice_date IS NULL),
        oh AS (SELECT h, min_by(source_file, pos) AS f, min_by(invoice_date, pos) AS d FROM old GROUP BY h), ok AS (SELECT k, min_by(source_file, pos) AS f, min_by(invoice_date, pos) AS d FROM old WHERE k IS NOT NULL GROUP BY k),
        s AS (SELECT new.*, min(pos) OVER wh AS hp, first_value(source_file) OVER wh AS hf, CASE WHEN k IS NOT NULL THEN min(pos) OVER wk END AS kp, first_value(source_file) OVER wk AS kf FROM new WINDOW wh AS (PARTITION BY h ORDER BY pos), wk AS (PARTITION BY k ORDER BY pos))
        SELECT source_file, CASE WHEN hp < pos THEN hf WHEN kp < pos THEN kf WHEN oh.f IS NOT NULL THEN oh.f WHEN ok.f IS NOT NULL THEN ok.f ELSE '' END AS duplicate_of,
          CASE WHEN hp < pos THEN 'identical file already in this batch' WHEN kp < pos THEN 'same vendor & invoice number in this batch' WHEN oh.f IS NOT NULL THEN 'identical file processed on ' || oh.d
            WHEN ok.f IS NOT NULL THEN 'invoice ' || invoice_number || ' from ' || vendor || ' already processed on ' || ok.d ELSE '' END AS duplicate_note
        FROM s LEFT JOIN oh ON s.h = oh.h LEFT JOIN ok ON s.k = ok.k""",
    "line_math": rf"""WITH lines AS ({LINES}), r AS (SELECT doc_id, pos, l_partkey, quantity::DECIMAL(18,2)::VARCHAR AS quantity, (floor(price::DOUBLE * 100 / quantity) / 100)::DECIMAL(18,2)::VARCHAR AS rate,
        CASE WHEN pos % 3 = 0 THEN amount ELSE price END::VARCHAR AS taxable_value FROM lines)
        SELECT *, coalesce(abs(quantity::DOUBLE * rate::DOUBLE - taxable_value::DOUBLE) / taxable_value::DOUBLE > 0.02, false) AS math_mismatch FROM r""",
    "derive_totals": f"WITH lines AS ({LINES}) SELECT doc_id, sum(amount)::DECIMAL(18,2) AS subtotal, sum(amount + tax_amount)::DECIMAL(18,2) AS total, (sum(amount + tax_amount) - sum(amount))::DECIMAL(18,2) AS tax FROM lines GROUP BY doc_id",
    "batch_kpis": rf"""WITH {VALIDATED} SELECT count(*) AS extracted, count(*) FILTER (NOT validation_ok) AS arithmetic_issues,
        count(*) FILTER (invoice_date IS NULL OR invoice_number IS NULL OR total IS NULL OR invoice_date > '1998-06-01') AS rule_failures,
        count(*) FILTER (l_orderkey % 7 = 0) AS duplicates, count(*) FILTER (l_suppkey % 5 = 0) AS ocr_used FROM validated""",
    "parse_number": r"""WITH r AS (SELECT doc_id, text, 'Rs. ' || (doc_id * 1237) || ',5' || (n_chars % 10) || CASE doc_id % 3 WHEN 0 THEN '.75' WHEN 1 THEN '-' ELSE '.1.2' END AS raw FROM documents)
        SELECT doc_id, try_cast(regexp_replace(raw, '[^0-9.\-]', '', 'g') AS DOUBLE) AS n, try_cast(regexp_replace(raw, '[^\d.]', '', 'g') AS DOUBLE) AS u,
          len(regexp_extract_all(text, '\d[\d,]*\.\d{2}'))::INT AS n_amounts, replace(regexp_extract_all(text, '[\d,]+\.?\d*')[-1], ',', '') AS last_figure FROM r""",
    "normalize_dates": r"""WITH r AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 9 AS k FROM orders)
        SELECT o_orderkey, CASE WHEN k = 6 THEN 'on ' || strftime(d, '%d-%m-%Y') WHEN k = 7 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS iso,
          CASE WHEN k = 6 THEN 'on ' || strftime(d, '%d-%m-%Y') WHEN k = 7 THEN '' ELSE strftime(d, '%d-%b-%Y') END AS dmy,
          CASE WHEN k IN (0, 1, 3, 4, 5) OR k = 2 AND month(d) = 5 THEN d::DATE END AS rule_date FROM r""",
    "id_confidence": r"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN ' INV-' || o_orderkey WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN '98' || lpad(o_orderkey::VARCHAR, 9, '7') WHEN 3 THEN strftime(o_orderdate, '%d-%b-%y')
          WHEN 4 THEN o_orderpriority WHEN 5 THEN 'Dated' WHEN 6 THEN '' ELSE '#' || o_orderkey END AS raw FROM orders), s AS (SELECT *, trim(raw) AS c FROM r)
        SELECT o_orderkey, c AS cleaned,
          CASE WHEN raw = '' THEN 0.0 WHEN regexp_matches(replace(c, ' ', ''), '^[6-9]\d{9,}$') THEN 0.1 WHEN regexp_matches(c, '^\d{1,2}$') THEN 0.2
            WHEN regexp_matches(c, '^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|^\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}$') THEN 0.05 WHEN regexp_matches(c, '^[A-Za-z\s]+$') AND len(c) < 20 THEN 0.1
            WHEN regexp_matches(c, '^\d{3,9}$') THEN 0.75 WHEN regexp_matches(c, '^[A-Za-z0-9][A-Za-z0-9/_\-]{2,}$') THEN 0.95 ELSE 0.6 END::DOUBLE AS invoice_confidence,
          CASE WHEN raw = '' THEN 0.0 WHEN lower(c) IN ('dated', 'date', 'ref') THEN 0.05 WHEN regexp_matches(c, '^[A-Za-z]{1,4}$') THEN 0.1
            WHEN regexp_matches(c, '^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|^\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}$') THEN 0.05 WHEN regexp_matches(c, '^[A-Za-z0-9][A-Za-z0-9/_\-\s]{1,}$') THEN 0.9 ELSE 0.6 END::DOUBLE AS order_confidence
        FROM s""",
    "scrub_text": r"""WITH r AS (SELECT *, text || ' api_key = zz' || conv_id || ' Bearer abc sk-' || conv_id || '12345678' AS raw FROM conversations)
        SELECT conv_id, turn, regexp_replace(raw, '(sk-[A-Za-z0-9\-_]{8,}|AIza[A-Za-z0-9\-_]{35}|api[_-]?key\s*[:=]\s*\S+|Bearer\s+\S+)', '[REDACTED]', 'gi') AS scrubbed,
          CASE WHEN text IS NULL OR text = '' THEN '(none)' WHEN len(text) > 10 THEN left(text, 3) || '…' || right(text, 3) ELSE '…' END AS masked,
          trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM r""",
    "clean_labels": r"""WITH r AS (SELECT doc_id, text, text AS t FROM documents)
        SELECT doc_id, trim(lower(t), ':.,;-()[]% ') AS label, trim(replace(regexp_replace(lower(t), '[^a-z0-9%/ ]', ' ', 'g'), '  ', ' ')) AS header,
          trim(regexp_replace('[?' || text || '?]', '\[?\?+([^?\]]*)\?+\]?', '\1', 'g')) AS undoubted,
          replace(replace(replace(t, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') AS xml,
          left(regexp_replace(replace(split_part('in/' || t || '.pdf', '/', -1), '\', '_'), '[<>:"|?*\x00-\x1f]', '_', 'g'), 180) AS filename FROM r""",
    "summary_filter": r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Grand Total ' || p_name WHEN 1 THEN ' N/A' WHEN 2 THEN 'Totally ' || p_name ELSE p_name END AS d FROM part)
        SELECT p_partkey, p_partkey % 6 IN (0, 1) AS is_summary, p_partkey % 6 = 0 AS is_summary_line FROM r""",
}


#: As in the scalar functions, in DuckDB's dialect: what stands before a telephone number is kept by a group.
_PERSONAL = (
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]"), (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[IBAN]"), (r"(?i)\b(?:A/?c|Account|Acct)\.?\s*(?:No\.?|Number)?\s*[:\-]?\s*\d{6,}", "Account: [ACCOUNT]"),
    (r"\b(?:\d[ -]?){12,18}\d\b", "[CARD]"), (r"(^|[^0-9])\+?\d[\d\-\s()]{8,}\d", r"\1[PHONE]"),
)
_STAGES = "documents"
for _pattern, _mark in _PERSONAL:
    _before = "text" if _STAGES == "documents" else "t"
    _STAGES = f"(SELECT doc_id, text, regexp_replace({_before}, '{_pattern}', '{_mark}', 'g') AS t, {'0' if _before == 'text' else 'n'} + len(regexp_extract_all({_before}, '{_pattern}')) AS n FROM {_STAGES})"
ORACLE["redact"] = f"SELECT doc_id, t AS redacted, n::INT AS n_redacted FROM {_STAGES}"


def oracle_sql() -> dict[str, str]:
    from tallyforge.plans.document_oracle import DOCUMENTS
    from tallyforge.plans.more_oracle import MORE
    from tallyforge.plans.table_oracle import TABLES

    return ORACLE | MORE | DOCUMENTS | TABLES
