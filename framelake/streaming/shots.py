"""The adaptive shot cut over a stream of frames; beyond the reference, which has no streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cuts(frames: DataFrame, k: float = 2.5, history: int = 50, least: int = 10) -> DataFrame:
    """(video, frame) of the cuts in a stream of (video, frame, score); frames of a video arrive in order between batches.

    The state of a video is its running history, history numbers at most.
    """

    def step(key, parts: Iterator, state):
        import numpy as np
        import pandas as pd

        h = list(state.get[0]) if state.exists else []
        cuts = []
        rows = pd.concat(list(parts)).sort_values("frame")
        for frame, score in zip(rows["frame"], rows["score"], strict=True):
            if len(h) >= least and score > np.mean(h) + k * np.std(h):
                cuts.append(int(frame))
                h = h[-10:]
            h = [*h, float(score)][-history:]
        state.update((h,))
        yield pd.DataFrame({"video": [key[0]] * len(cuts), "frame": cuts})

    kind = dict(frames.dtypes)["video"]
    return frames.groupBy("video").applyInPandasWithState(step, f"video {kind}, frame int", "h array<double>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type by tumbling window of event time; later ones than the watermark allows are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
