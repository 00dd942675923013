"""Online alignment: raw pixels to per-frame proposals in each micro-batch, and proposals to smoothed coefficients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelloom.operators.two_planes import two_plane_proposals
from voxelloom.streaming.windows import append_log

FRAME = ["ts", "seq"]


def start_proposals(pixels: DataFrame, cameras: DataFrame, reference: str, path: str, checkpoint: str, key: str = "rig", trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts the first stage: ``two_plane_proposals`` of every micro-batch, appended under ``path``.

    ``pixels`` is a stream of key, ts, seq, camera, pid, z, rx, ry; the rows of a frame come in one micro-batch (a frame
    set is one file). A batch that runs again after a failure replaces its rows. All frames of a batch are solved together.
    """

    def solve(batch: DataFrame, number: int) -> None:
        append_log(two_plane_proposals(batch, cameras, [key, *FRAME], reference, **options), number, path)

    return pixels.writeStream.foreachBatch(solve).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_proposals(spark: SparkSession, path: str, key: str = "rig", key_type: str = "string", camera_type: str = "string") -> DataFrame:
    """The proposals under ``path`` as a stream."""
    schema = f"`{key}` {key_type}, ts timestamp, seq long, camera {camera_type}, ok boolean, model string, a double, b double"
    return spark.readStream.schema(schema).parquet(path)


def track_alignment(proposals: DataFrame, key: str = "rig", ema: float = 0.3, max_step: float = 0.150, max_scale_step: float = 0.010) -> DataFrame:
    """Coefficients of each camera after each frame: (key, ts, seq, camera, a, b, used, clamped).

    The first frame of a rig that is ok sets its cameras' proposals outright. Later ones are first limited to a step
    about the last value and then averaged in with weight ``ema``. A frame that is not ok, and a camera without a proposal,
    keep what they had, (1, 0) at first. State is one row for each rig with a list of its cameras' two numbers.
    """
    types = dict(proposals.dtypes)
    out = f"`{key}` {types[key]}, ts timestamp, seq long, camera {types['camera']}, a double, b double, used boolean, clamped boolean"
    columns = [key, "ts", "seq", "camera", "a", "b", "used", "clamped"]

    def limited(new: float, old: float, step: float, started: bool) -> tuple[float, bool]:
        far = started and abs(new - old) > step
        return (old + (step if new > old else -step) if far else new), far

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, held = (state.get[0], {c: (a, b) for c, a, b in zip(*state.get[1:])}) if state.exists else (False, {})
        rows = pd.concat(list(batches), ignore_index=True).sort_values([*FRAME, "camera"], kind="stable")
        done = []
        for (ts, seq), frame in rows.groupby(FRAME, sort=False):
            ok = bool(frame["ok"].iloc[0])
            w = ema if started else 1.0
            for camera, a, b in zip(frame["camera"], frame["a"], frame["b"]):
                old_a, old_b = held.get(camera, (1.0, 0.0))
                used = ok and not (pd.isna(a) or pd.isna(b))
                clamped = False
                if used:
                    new_a, far_a = limited(float(a), old_a, max_scale_step, started)
                    new_b, far_b = limited(float(b), old_b, max_step, started)
                    old_a, old_b, clamped = (1 - w) * old_a + w * new_a, (1 - w) * old_b + w * new_b, far_a or far_b
                held[camera] = (old_a, old_b)
                done.append((k[0], ts, int(seq), camera, old_a, old_b, used, clamped))
            started = started or ok
        state.update((started, list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        yield pd.DataFrame(done, columns=columns)

    return proposals.groupBy(key).applyInPandasWithState(step, out, f"started boolean, cameras array<{types['camera']}>, a array<double>, b array<double>", "append", GroupStateTimeout.NoTimeout)
