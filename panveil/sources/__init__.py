"""Where texts come from and go to."""

from panveil.sources.tables import read_shares, read_table, read_texts, write_masked

__all__ = ["read_shares", "read_table", "read_texts", "write_masked"]
