"""DataFrame -> DataFrame operators on top of the column functions; all are narrow."""

from panveil.operators.cards import mask_columns, run_inventory, screen_texts

__all__ = ["mask_columns", "run_inventory", "screen_texts"]
