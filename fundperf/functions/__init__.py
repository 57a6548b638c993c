from fundperf.functions.bounds import broadcast_within, day_span, in_window
from fundperf.functions.stats import (
    annualised_mean,
    annualised_volatility,
    compound_return,
    last_value,
    ols_alpha,
    ols_beta,
    period_alpha,
    ratio,
    running_return,
)
from fundperf.functions.text import as_number, as_percent, header, titled

__all__ = [
    "annualised_mean",
    "annualised_volatility",
    "as_number",
    "as_percent",
    "broadcast_within",
    "compound_return",
    "day_span",
    "header",
    "in_window",
    "last_value",
    "ols_alpha",
    "ols_beta",
    "period_alpha",
    "ratio",
    "running_return",
    "titled",
]
