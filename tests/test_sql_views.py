"""A question over the registered views, answered by Spark SQL equals the DataFrame operator."""

from conftest import SF01
from tidemark.operators import churn, grades
from tidemark.plans import params as P
from tidemark.sources.views import orders_view, register_sql_views

QUIET_LAST_QUARTER = """
SELECT g.spending_grade, count(*) AS churned_customer_count
FROM customer_grades g
WHERE g.user_id IN (
    SELECT user_id FROM orders_completed WHERE year(created_at) = 1997 GROUP BY user_id
    HAVING bit_or(shiftleft(1, quarter(created_at))) = 14)
GROUP BY g.spending_grade
"""


def test_spark_sql_on_source_views_equals_operator(spark):
    assert register_sql_views(spark, SF01) == ["orders_completed", "customer_grades"]
    via_sql = sorted(tuple(r) for r in spark.sql(QUIET_LAST_QUARTER).collect())
    o = orders_view(spark, SF01)
    via_op = churn.churn_by_grade(o, grades.grade_by_spend(o), P.CHURN_SPAN, P.CHURN_3Q_ACTIVE,
                                  P.CHURN_3Q_SILENT, P.CHURN_GRAIN)
    assert via_sql == sorted(tuple(r) for r in via_op.collect())
    assert spark.sql("SELECT count(*) FROM orders_completed").collect()[0][0] == o.count()
