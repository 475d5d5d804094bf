"""tidemark: customer-retention and price analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame -> DataFrame`` whose dates,
keys, measures and period grain are parameters. Plans are declared with the
DataFrame API so Catalyst prunes columns, pushes range filters into the
parquet scan and chooses join strategies; no operator uses a Python UDF.

    from tidemark import Span, grades, lapse
    g = grades.grade_by_spend(orders)            # user_id, total_spent, spending_grade
    lapsed = lapse.lapsed(orders, Span("2024-06-01", "2024-06-30"), Span("2024-07-01", "2024-09-30"))
"""

from tidemark.functions.periods import Span, period_key, period_start
from tidemark.operators import acquisition, churn, gaps, grades, lapse, ranking, sales
from tidemark.session import checkpoint_dir, clean_materialized, get_session

__all__ = ["Span", "period_key", "period_start", "get_session", "checkpoint_dir", "clean_materialized",
           "acquisition", "churn", "gaps", "grades", "lapse", "ranking", "sales"]
