from urbanframe.plans.inspect import plan_operators, plan_text
from urbanframe.plans.queries import (
    nearest_station_summary,
    per_capita_income,
    street_time_share,
    top_months,
    top_months_sql,
)

__all__ = [
    "nearest_station_summary",
    "per_capita_income",
    "plan_operators",
    "plan_text",
    "street_time_share",
    "top_months",
    "top_months_sql",
]
