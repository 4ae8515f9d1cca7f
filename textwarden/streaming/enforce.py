"""Bounded-lookback enforcement as a stateful stream of chunks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from textwarden.operators.enforcement import OUTCOME, Replay, frame
from textwarden.operators.policy import DEFAULT, Policy

CHUNKS = "response_id long, seq int, chunk string, is_last boolean"


def enforce_stream(chunks: DataFrame, policy: Policy = DEFAULT, prompt: str = "", timeout_ms: int = 3_600_000) -> DataFrame:
    """A row for each response once its last chunk has come, in order of seq; chunks that come early wait in the state.

    chunks: response_id, seq (from 0 without gaps), chunk (null: empty), is_last. Repeated chunks are ignored, also those
    that come within timeout_ms after a response has ended: its state stays as a mark for so long. A response that falls
    silent for timeout_ms is ended with what came.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        replay, wanted, early = pickle.loads(state.get[0]) if state.exists else (Replay(policy, prompt), 0, {})
        over = state.hasTimedOut
        if replay is None:
            # ended before: what comes again is passed over, until the mark goes
            for _ in frames if not over else ():
                pass
            if over:
                state.remove()
            else:
                state.setTimeoutDuration(timeout_ms)
            return
        if not over:
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    if row.seq >= wanted:
                        early[row.seq] = (row.chunk or "", bool(row.is_last))
            while not over and wanted in early:
                chunk, over = early.pop(wanted)
                replay.push(chunk)
                wanted += 1
        if not over:
            state.update((pickle.dumps((replay, wanted, early)),))
            state.setTimeoutDuration(timeout_ms)
            return
        replay.end()
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((pickle.dumps((None, wanted, {})),))
            state.setTimeoutDuration(timeout_ms)
        yield frame([(key[0], *replay.row())], "response_id")

    return chunks.groupBy("response_id").applyInPandasWithState(step, f"response_id long, {OUTCOME}", "state binary", "append", "ProcessingTimeTimeout")
