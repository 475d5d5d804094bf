"""Parameters of the registered queries.

The source analyses ran on 2023-2025 order data; the test ``orders`` table
spans 1995-01 to 2001-08 and ``events`` covers January 2024, so each window
is moved onto those ranges while keeping its shape (closed or half-open,
number of periods, active then silent).
"""

from tidemark.functions.periods import Span

# Lapse (OP05-OP07): active one quarter, silent the next half year, later a year.
LAPSE_ACTIVE = Span("1997-04-01", "1997-06-30")
LAPSE_SILENT = Span("1997-07-01", "1997-12-31")
LAPSE_LATER = Span("1998-01-01", "1998-12-31")

# Purchase pattern of the lapsed cohort (OP08-OP13): three quarters before the lapse.
PATTERN_SPAN = Span("1996-10-01", "1997-06-30")
PATTERN_GRAIN = "quarter"
PATTERN_K = 3
RECENT_SPAN = Span("1998-01-01", "1998-06-30")

# Consistent users of all customers (OP16-OP17): half-open three quarters.
CONSISTENT_SPAN = Span("1997-01-01", "1997-10-01", closed=False)
CONSISTENT_GRAIN = "quarter"
CONSISTENT_K = 3
TREND_SINCE = "1997-01-01"

# Potential churners (OP21-OP22): data limited to before a cut, as in the source.
CHURN_GAP = 3
CHURN_CUT = "1998-01-01"
CHURN_QUIET = 2

# Churners as of a date inside the data.
AS_OF = "1998-01-01"
AS_OF_QUIET = 3

# Tables: rows created and appended, large and small orders, years appended.
TABLE_SPAN = Span(None, "1998-01-01", closed=False)
BIG_ORDER, SMALL_ORDER, SMALL_YEAR = 400_000, 20_000, 1997
BATCH_YEARS = (1996, 1997, 1998)

# Orders per user and period, pivot (OP23-OP24): four months.
PIVOT_SPAN = Span("1997-01-01", "1997-05-01", closed=False)
PIVOT_PERIODS = ["1997-01", "1997-02", "1997-03", "1997-04"]

# Churn by grade (OP25): quarters of 1997 on orders.
CHURN_SPAN = Span("1997-01-01", "1998-01-01", closed=False)
CHURN_GRAIN = "quarter"
CHURN_3Q_ACTIVE = ["1997-Q1", "1997-Q2", "1997-Q3"]
CHURN_3Q_SILENT = ["1997-Q4"]
CHURN_1M_ACTIVE = ["1997-Q1"]
CHURN_1M_SILENT = ["1997-Q2", "1997-Q3", "1997-Q4"]

# Churn curve (OP26): days of January 2024 on events.
CURVE_SPAN = Span("2024-01-02", "2024-01-08", closed=False)
CURVE_GRAIN = "day"
CURVE_ACTIVE = ["2024-01-02", "2024-01-03", "2024-01-04"]
CURVE_FOLLOW = ["2024-01-05", "2024-01-06", "2024-01-07"]

# Acquisition (OP27-OP32): first orders over a long span, new since a month.
FIRST_SPAN = Span("1995-01-01", "1997-12-31")
NEW_SINCE = "1996-06"
ACTIVITY_SPAN = Span("1996-06-01", "1997-12-31")
LATER_FIRST_SPAN = Span("1995-01-01", "1996-12-31")  # OP32 over a span that leaves rows
# New-customer rate (OP33).
RATE_FIRST_SPAN = Span("1995-01-01", "1998-12-31")
RATE_SINCE = "1996-06"
RATE_MONTHLY_SPAN = Span("1996-06-01", "1998-12-31")

# First gap (OP34-OP38): purchase events by day.
GAP_GRAIN = "day"
GAP_COHORT_FIRST_SPAN = Span("2024-01-01", "2024-01-31")
GAP_COHORT_DAY = "2024-01-02"
GAP_COHORT_SPAN = Span("2024-01-02", "2024-01-10", closed=False)
GAP_COHORT_TARGETS = ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08",
                      "2024-01-09"]
GAP_WINDOW_FIRST_SPAN = Span("2024-01-01", "2024-01-05", closed=False)
GAP_WINDOW_SPAN = Span("2024-01-05", "2024-01-09", closed=False)
GAP_WINDOW_TARGETS = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]

# Sales analytics (OP40-OP58) on lineitem x part x supplier.
SALES_CUT = "1998-07-01"
SALES_CATEGORY = "MEDIUM"
SALES_SINCE = "1999-01-01"
PADDED_YEARS = (1997, 1998)  # their amounts are blanked, so that a mean must be padded
DATE_TEXTS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy")
TOP_K = 10
PROFILE_TOP = 3
TOP_MIN_COUNT = 10
YEARLY_SPAN = Span("1995-06-01", "2000-12-31")
MULTI_SPAN = Span("1995-06-01", "2024-12-31")
TOP_TOTAL_K = 20
