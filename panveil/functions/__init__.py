"""Column -> Column builders. All are Spark built-ins: no Python worker runs for any of them."""

from panveil.functions.digits import GLYPHS, RUN, MAX_SHOWN, MAX_TYPED, contains_run, glyph_fits, glyph_offered, runs
from panveil.functions.display import (
    detected_caption,
    digit_glyphs,
    group4,
    hero,
    hero_compact,
    layout_x,
    reveal_caption,
    to_grouped_offset,
    to_plain_offset,
)
from panveil.functions.ingest import accept_typed, can_commit, luhn_badge, route_shared, shared_text, update_kind, update_resume
from panveil.functions.inspect import brand, count_runs, first_digits, luhn_ok
from panveil.functions.keep import MaskMode, clamp_keep, keep_columns, keep_counts, slider
from panveil.functions.legacy import tail_mask
from panveil.functions.mask import mask_number, mask_runs

__all__ = [
    "GLYPHS", "MAX_SHOWN", "MAX_TYPED", "RUN", "MaskMode", "accept_typed", "brand", "can_commit", "clamp_keep",
    "contains_run", "count_runs", "detected_caption", "digit_glyphs", "first_digits", "glyph_fits", "glyph_offered", "group4", "hero",
    "hero_compact", "keep_columns", "keep_counts", "layout_x", "luhn_badge", "luhn_ok", "mask_number", "mask_runs",
    "reveal_caption", "route_shared", "runs", "shared_text", "slider", "tail_mask", "to_grouped_offset",
    "to_plain_offset", "update_kind", "update_resume",
]
