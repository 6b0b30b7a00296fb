"""Text that arrives from elsewhere: parsing, routing, and what may be committed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import MAX_TYPED, OTHER, ColumnLike, as_col
from panveil.functions.inspect import count_runs, first_digits, luhn_ok


def accept_typed(text: ColumnLike) -> Column:
    """The digits typed, or NULL if there are more than 19: the edit is rejected, not cut."""
    d = F.regexp_replace(as_col(text), OTHER, "")
    return F.when(F.length(d) <= MAX_TYPED, d)


def shared_text(action: Column, mime: Column, payload: Column) -> Column:
    """What a share holds: text of a plain-text SEND or of PROCESS_TEXT, else NULL."""
    return F.when((action == "android.intent.action.SEND") & (mime == "text/plain"), payload).when(action == "android.intent.action.PROCESS_TEXT", payload)


def route_shared(text: ColumnLike) -> Column:
    """struct<mode, single_digits, batch_text>: batch if there are two runs or more; NULL text goes to single."""
    c = as_col(text)
    many = F.coalesce(count_runs(c), F.lit(0)) > 1
    return F.struct(
        F.when(many, "batch").otherwise("single").alias("mode"),
        F.coalesce(first_digits(c), F.lit("")).alias("single_digits"),
        F.when(many, c).otherwise("").alias("batch_text"),
    )


def can_commit(mode: Column, single: Column, batch: Column) -> Column:
    """Whether there is something to mask: a number in single mode, a run in batch mode."""
    return F.when(mode == "batch", F.coalesce(count_runs(batch), F.lit(0)) > 0).otherwise(F.coalesce(F.length(single), F.lit(0)) > 0)


def luhn_badge(number: ColumnLike) -> Column:
    c = as_col(number)
    return (F.length(c) > 0) & luhn_ok(c)


def update_kind(available: Column, priority: Column, days: Column, immediate_ok: Column, flexible_ok: Column) -> Column:
    """IMMEDIATE, FLEXIBLE or NULL: which update to start. An unknown age reaches no threshold."""
    # By priority, days from which an update is immediate and from which it is flexible.
    out = F.when(~F.coalesce(available, F.lit(False)), None).when((priority == 5) & immediate_ok, "IMMEDIATE")
    for level, now, soon in ((4, 5, 3), (3, 30, 15), (2, 90, 30)):
        out = out.when((priority == level) & (days >= now) & immediate_ok, "IMMEDIATE").when((priority == level) & (days >= soon) & flexible_ok, "FLEXIBLE")
    return out.when(priority == 1, "FLEXIBLE")


def update_resume(last_kind: Column, status: Column) -> Column:
    """What to do on return: notify of a finished download, restart an update under way, or NULL.

    status stands for two things that the caller asks about in turn: DOWNLOADED is a state of the installation, and
    matters to a flexible update only; IN_PROGRESS is one of the update's availability, and matters to an immediate one.
    """
    kind = F.coalesce(last_kind, F.lit("FLEXIBLE"))
    return F.when((kind == "FLEXIBLE") & (status == "DOWNLOADED"), "notify").when((kind == "IMMEDIATE") & (status == "IN_PROGRESS"), "restart")
