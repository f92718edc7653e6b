"""Turns of a live word stream.

A turn of a file is given out when a later word opens the next one, or when event time
passes its end by more than the gap. State is one open turn per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "file string, speaker string, start timestamp, end timestamp, text string, n_words int"
STATE = "speaker string, start double, end double, text string, n_words int"


def live_turns(words: DataFrame, max_gap: float = 2.0, lateness: str = "10 seconds") -> DataFrame:
    """``words``: a stream of ``file, speaker, word, start, end`` (timestamps) in order per file."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        open_turn = list(state.get) if state.exists else None

        def close() -> None:
            speaker, start, end, text, n = open_turn
            done.append((key[0], speaker, pd.Timestamp(start, unit="s"), pd.Timestamp(end, unit="s"), text, n))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["start", "end"], kind="stable")
            for w in rows.itertuples():
                start, end = w.start.timestamp(), w.end.timestamp()
                if open_turn and (w.speaker != open_turn[0] or start - open_turn[2] > max_gap):
                    close()
                    open_turn = None
                if open_turn is None:
                    open_turn = [w.speaker, start, end, w.word, len(w.word.split())]
                else:
                    open_turn = [w.speaker, open_turn[1], max(open_turn[2], end), f"{open_turn[3]} {w.word}", open_turn[4] + len(w.word.split())]
            state.update(tuple(open_turn))
            state.setTimeoutTimestamp(max(int(1000 * (open_turn[2] + max_gap)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["file", "speaker", "start", "end", "text", "n_words"])

    return words.withWatermark("end", lateness).groupBy("file").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
