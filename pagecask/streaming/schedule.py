"""When the pipeline's recurring steps are due: pure functions of its state and the time."""

from __future__ import annotations

from dataclasses import replace

from pagecask.streaming.state import PipelineState

MINUTE_MS = 60_000
DAY_MS = 86_400_000
#: How long after consent the daily steps begin.
RECONCILE_AFTER, MAINTAIN_AFTER = 60 * MINUTE_MS, 120 * MINUTE_MS


def due(state: PipelineState, now: int) -> list[str]:
    """Steps to do now, in order. Nothing without consent; while paused only upkeep.

    An import that is running or was never begun is looked after every time;
    once it is complete the reconcile comes daily or when a batch was missed.
    """
    if not state.allowed:
        return []
    out = []
    if not state.settings.paused:
        if state.history.status != "complete":
            out.append("import")
        elif state.reconcile_due or state.reconcile_at is not None and now >= state.reconcile_at:
            out.append("reconcile")
        if state.titles_at is not None and now >= state.titles_at and state.history.status == "complete":
            out.append("titles")
    if state.maintain_at is not None and now >= state.maintain_at:
        out.append("maintain")
    return out


def rearmed(state: PipelineState, now: int, done: list[str]) -> PipelineState:
    """The next times: a day after what was done, and for what has no time yet, or one too far away, its first."""
    if not state.allowed:
        return replace(state, reconcile_at=None, maintain_at=None, titles_at=None)
    reconcile, maintain = state.reconcile_at, state.maintain_at
    if "reconcile" in done or reconcile is not None and reconcile > now + DAY_MS:
        reconcile = now + DAY_MS
    if "maintain" in done or maintain is not None and maintain > now + DAY_MS:
        maintain = now + DAY_MS
    return replace(
        state, reconcile_at=now + RECONCILE_AFTER if reconcile is None else reconcile, maintain_at=now + MAINTAIN_AFTER if maintain is None else maintain,
        titles_at=None if "titles" in done else state.titles_at,
    )
