"""Work is dealt by document, never by what many documents have in common."""

from tallyforge.operators import templates
from tallyforge.plans.document_queries import TEMPLATE


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_template_are_not_one_task(spark):
    words = spark.range(40).selectExpr("id % 4 as doc_id", "'t' as template_id", "1 as page_no", "int(id) as word_no", "'Amount' as text", "double(id) as x0", "id + 0.5 as x1", "double(id) as top")
    assert "hashpartitioning(template_id" not in plan_of(templates.extract_documents(words, {"t": TEMPLATE}))
