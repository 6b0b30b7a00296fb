"""Payment-card number masking and inspection for Spark DataFrame columns."""

from panveil.functions import (  # noqa: F401
    MaskMode,
    brand,
    clamp_keep,
    contains_run,
    count_runs,
    first_digits,
    group4,
    hero,
    keep_counts,
    luhn_ok,
    mask_number,
    mask_runs,
    runs,
    tail_mask,
)
