"""Inference reads other tries only of documents that the template as inferred does not fit, and its words are dealt once."""

from __future__ import annotations

from tallyforge.operators import infer, templates
from tallyforge.plans import table_queries
from tests.test_documents import invoice
from tests.test_infer import words


def test_other_tries_are_read_of_unfit_documents_only(spark, monkeypatch):
    wrong = [(t.replace("23", "77") if t.endswith(".60") or "Total" in t else t, *at) for t, *at in invoice()]
    seen, read = [], templates.read_lines

    def spy(lines, layouts, uses):
        rows = layouts.select("template_id", "variant").collect()
        seen.append(({r.doc_id for r in lines.select("doc_id").distinct().collect()}, {(r.template_id, r.variant) for r in rows}))
        return read(lines, layouts, uses)

    monkeypatch.setattr(templates, "read_lines", spy)
    got = {r.doc_id: r.status for r in infer.infer_templates(words(spark, right=invoice(), other=wrong[:-1])).collect()}
    assert got["right"] == "OK" and got["other"] == "REVIEW"
    assert seen == [({"right", "other"}, {("right", 0), ("other", 0)}), ({"other"}, {("other", 1), ("other", 2)})]
    seen.clear()
    assert infer.infer_templates(words(spark, right=invoice())).first().status == "OK" and len(seen) == 1

def test_words_of_inference_are_dealt_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(infer, "infer_templates", lambda words, vendor="": plans.append(words._jdf.queryExecution().optimizedPlan().toString()) or words.selectExpr("doc_id", "'{}' AS template", "'' AS status"))
    for query in (table_queries.infer_template, table_queries.infer_layouts):
        query(spark, "/root/testdata/sf0.001")
    assert [(p.count("Relation ["), p.count("Join"), p.count("Union")) for p in plans] == [(1, 0, 0)] * 2
