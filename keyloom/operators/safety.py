"""Edit plans applied and judged: dry runs, what a plan touches, and the first reason against it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import surface as S
from keyloom.functions import text as X


def cut_range(a: Column, move_left: Column, backspaces: Column) -> tuple[Column, Column]:
    """(from, to) of what a plan deletes; null where its cursor would leave the text."""
    to = F.length(a) - move_left
    valid = (to >= 0) & (to - backspaces >= 0)
    return F.when(valid, to - backspaces), F.when(valid, to)


def applied(a: Column, move_left: Column, backspaces: Column, insert: Column) -> Column:
    """The text after a plan; the text itself where the plan doesn't fit."""
    start, end = cut_range(a, move_left, backspaces)
    return F.coalesce(F.concat(F.substr(a, F.lit(1), start.cast("int")), insert, F.substr(a, end.cast("int") + 1)), a)


def matches(a: Column, b: Column, move_left: Column, backspaces: Column, insert: Column) -> Column:
    """Whether the plan fits and turns a into b."""
    return cut_range(a, move_left, backspaces)[0].isNotNull() & (applied(a, move_left, backspaces, insert) == b)


def touched_words(a: Column, start: Column, end: Column) -> Column:
    """Words that a range reaches; of an empty one 1 if it lies inside a word, else 0."""
    at = lambda i: F.substr(a, i.cast("int"), F.lit(1))
    inside = (start > 0) & (end < F.length(a)) & at(start).rlike(S.NOT_WS) & at(start + 1).rlike(S.NOT_WS)
    return F.when(start == end, inside.cast("int")).otherwise(X.count_of(F.substr(a, start.cast("int") + 1, (end - start).cast("int")), S.NOT_WS + "+"))


def report(a: Column, b: Column, move_left: Column, backspaces: Column, insert: Column, proof: Column) -> Column:
    """struct of what a plan does and whether it may be applied, with the first reason that holds.

    proof: what backs the change: boundary, manual, layout, context, or null.
    """
    start, end = cut_range(a, move_left, backspaces)
    fits = start.isNotNull()
    deleted = F.coalesce(F.substr(a, start.cast("int") + 1, (end - start).cast("int")), F.lit(""))
    right = F.coalesce(matches(a, b, move_left, backspaces, insert), F.lit(False))
    words = lambda c: X.count_of(c, S.NOT_WS + "+")
    inner = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{S.WS}+", ""), f"{S.WS}+\\z", "").rlike(S.WS)
    at = lambda i: F.substr(a, i.cast("int"), F.lit(1))
    splits = insert.rlike(S.WS) & F.coalesce((start > 0) & (end < F.length(a)) & at(start).rlike(S.NOT_WS) & at(end + 1).rlike(S.NOT_WS), F.lit(False))
    count_changed = words(a) != words(b)
    boundary = count_changed | inner(deleted) | inner(insert) | splits
    backed = F.coalesce(proof.isin("boundary", "manual"), F.lit(False))
    layout = F.coalesce(proof == "layout", F.lit(False))
    inside = ((backspaces > 0) | (insert != "")) & (move_left > S.trailing_whitespace(a))
    reason = (
        F.when(~fits, "invalid_edit_plan_cursor_bounds").when(~right, "edit_plan_dry_run_mismatch").when((words(a) > 1) & ~backed, "unsafe_multiword_autocorrect_scope")
        .when(inside & ~(backed | layout), "unsafe_middle_suffix_autocorrect_plan").when(boundary & ~(backed | layout), "unsafe_boundary_edit_without_proof").otherwise("safe_edit_plan")
    )
    touched = F.when(fits, touched_words(a, start, end)).otherwise(0)
    return F.struct(
        deleted.alias("deleted"), right.alias("right"), splits.alias("splits"), count_changed.alias("count_changed"), boundary.alias("boundary"), S.left_context_changed(a, b).alias("left_changed"),
        touched.alias("touched"), inside.alias("inside"), (reason == "safe_edit_plan").alias("allowed"), reason.alias("reason"),
    )
