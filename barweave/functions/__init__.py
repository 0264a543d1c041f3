from barweave.functions.calendar import calendar_features, utc_day, utc_day_text
from barweave.functions.maths import (
    bounded, hash_uniform, inf_to_null, norm_cdf, norm_ppf, safe_corr, safe_div, sigmoid,
)
from barweave.functions.text import norm_symbol, select_text, text_source

__all__ = [
    "bounded", "calendar_features", "hash_uniform", "inf_to_null", "norm_cdf", "norm_ppf", "norm_symbol",
    "safe_corr", "safe_div", "select_text", "sigmoid", "text_source", "utc_day", "utc_day_text",
]
