"""Speech segments from a stream of frames, with what is still open kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_runs(voiced: np.ndarray, first: int, spoken: int, seen: int, ended: bool, padding: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """(first, last) of the runs that are closed, and the open one: its first and its last speech frame.

    voiced: sorted numbers of new speech frames; first, spoken: the open run so far, -1 if there is none; seen: the last
    frame of any kind; ended: whether no more frames follow.
    """
    if spoken >= 0:
        voiced = np.append(spoken, voiced)
    if not len(voiced):
        return [], None
    cuts = np.flatnonzero(np.diff(voiced) > padding)
    begins, ends = voiced[np.append(0, cuts + 1)], voiced[np.append(cuts, len(voiced) - 1)]
    starts = np.maximum(begins - padding, 0)
    if spoken >= 0:
        starts[0] = first
    lasts = ends + padding + 1
    runs = list(zip(starts.tolist(), lasts.tolist(), strict=True))
    if seen < lasts[-1]:  # not yet so many silent frames
        if not ended:
            return runs[:-1], (int(starts[-1]), int(ends[-1]))
        runs[-1] = (runs[-1][0], seen)
    return runs, None


def speech_segments(frames: DataFrame, group: str, frame: str, speech: str, padding: int = 10, idle: str | None = None) -> DataFrame:
    """group, first, last of the closed runs of speech, as split.speech_segments() gives them for a batch.

    frames is a stream. Each group's frames come in the order of its micro-batches, in any order inside one; a row without
    a value of ``speech`` says that the group has no more frames, and closes what is open at its last frame. With ``idle``
    (milliseconds) a group without rows for so long is closed too. The state of a group is three numbers, whatever its
    length, and lies in the checkpoint, so a stream that was stopped goes on inside of a run.
    """
    kind = dict(frames.dtypes)[group]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, spoken, seen = state.get if state.exists else (-1, -1, -1)
        ended, voiced = state.hasTimedOut, [np.zeros(0, np.int64)]
        if not ended:
            for rows in batches:
                known = rows[frame].notna()
                seen = max(seen, int(rows.loc[known, frame].max()) if known.any() else -1)
                ended |= bool(rows[speech].isna().any())
                voiced.append(rows.loc[known & rows[speech].fillna(False).astype(bool), frame].to_numpy(np.int64))
        runs, rest = closed_runs(np.sort(np.concatenate(voiced)), first, spoken, seen, ended, padding)
        if ended:
            state.remove()
        else:
            state.update((*(rest or (-1, -1)), seen))
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({group: pd.Series([key[0]] * len(runs)), "first": pd.Series([r[0] for r in runs], dtype="int64"), "last": pd.Series([r[1] for r in runs], dtype="int64")})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    named = frames.select(group, frame, speech)
    return named.groupBy(group).applyInPandasWithState(step, f"`{group}` {kind}, first long, last long", "first long, spoken long, seen long", "append", timeout)
