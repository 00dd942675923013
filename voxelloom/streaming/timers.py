"""Stateful operators whose state lives in the state store by field, with timers where a key may fall silent."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelloom.streaming.stateful import in_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle_trigger_timed(frames: DataFrame, thresh: float, need: int, rearm: float, timeout_s: float, key: str = "rig", idle_shots: int = 1) -> DataFrame:
    """The settle trigger with a timer: a rig that waited ``timeout_s`` fires though no further frame arrives.

    ``frames``: key, ts, seq, grey array<double>. Rows: key, seq, ts, diff, fired, forced. A scene still for ``need`` frames
    fires once; motion above ``rearm`` arms it again. Waiting is measured by the clock of the machine that runs the
    batch, from the rig's first frame or its last shot. A frame that comes after the wait is forced itself; without one the
    timer makes a row of NULL seq, ts and diff, at most ``idle_shots`` times until the next frame. A forced shot disarms.
    The first frame never fires. Frames of a batch are taken by (ts, seq). Needs a trigger that goes on, so that batches
    run when a timer is due.
    """
    types = dict(frames.dtypes)
    out = f"`{key}` {types[key]}, seq long, ts timestamp, diff double, fired boolean, forced boolean"
    columns = [key, "seq", "ts", "diff", "fired", "forced"]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = time.time()
        prev, count, armed, since, idle = state.get if state.exists else (None, 0, True, now, 0)
        done = []
        if state.hasTimedOut:
            done.append((k[0], None, None, None, True, True))
            count, armed, since, idle = 0, False, now, idle + 1
        else:
            idle = 0
            for ts, seq, grey in (r for rows in in_order(batches, ["ts", "seq", "grey"]) for r in zip(rows["ts"], rows["seq"], rows["grey"])):
                grey, diff, fired, forced = np.asarray(grey, float), None, False, False
                if prev is not None:
                    diff = float(np.abs(grey - np.asarray(prev, float)).sum()) / max(len(grey), 1)
                    if diff > rearm:
                        armed, count = True, 0
                    count = count + 1 if diff <= thresh else max(0, count - 1)
                    fired = armed and count >= need
                if fired:
                    armed, count, since = False, 0, now
                elif now - since >= timeout_s:
                    fired = forced = True
                    armed, count, since = False, 0, now
                prev = grey
                done.append((k[0], int(seq), ts, diff, fired, forced))
        state.update((None if prev is None else [float(v) for v in prev], count, armed, since, idle))
        if idle < idle_shots:
            state.setTimeoutDuration(max(1, math.ceil((since + timeout_s - now) * 1000)))
        yield pd.DataFrame(done, columns=columns).astype({"seq": "Int64"})

    return frames.groupBy(key).applyInPandasWithState(step, out, "prev array<double>, count int, armed boolean, since double, idle int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _touching(cell: tuple) -> list[tuple]:
    return [tuple(c + d for c, d in zip(cell, way)) for way in product((-1, 0, 1), repeat=3)]


class _Novelty(StatefulProcessor):
    """Accepted poses by cell of their place; a pose is compared with those of its own and the touching cells.

    A call reads a cell from the state store when it first needs it and writes the cells it changed at its end.
    """

    def __init__(self, key: str, min_rot_deg: float, min_trans: float):
        self.key, self.min_rot, self.min_trans = key, min_rot_deg, min_trans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "x long, y long, z long", "poses array<double>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        self.held: dict[tuple, np.ndarray] = {}
        self.near: dict[tuple, np.ndarray] = {}  # poses of a cell and all that touch it
        self.changed: set[tuple] = set()
        for frame in in_order(rows, ["ts", "seq", "R", "t"]):
            done = [(key[0], int(seq), ts, self._accept(rot, t)) for ts, seq, rot, t in zip(frame["ts"], frame["seq"], frame["R"], frame["t"])]
            yield pd.DataFrame(done, columns=[self.key, "seq", "ts", "accepted"])
        for cell in sorted(self.changed):
            self.cells.updateValue(cell, (self.held[cell].ravel().tolist(),))

    def _poses(self, cell: tuple) -> np.ndarray:
        if cell not in self.held:
            known = self.cells.containsKey(cell)
            self.held[cell] = np.asarray(self.cells.getValue(cell)[0] if known else [], float).reshape(-1, 12)
        return self.held[cell]

    def _accept(self, rot, t) -> bool:
        if rot is None or t is None:
            return True
        pose = np.concatenate([np.asarray(rot, float), np.asarray(t, float)])
        own = tuple(int(math.floor(v / self.min_trans)) for v in pose[9:])
        if own not in self.near:
            self.near[own] = np.concatenate([self._poses(c) for c in _touching(own)])
        if not self._far(pose, self.near[own]):
            return False
        self.held[own] = np.vstack([self._poses(own), pose])
        self.changed.add(own)
        for cell in _touching(own):
            self.near.pop(cell, None)
        return True

    def _far(self, pose: np.ndarray, seen: np.ndarray) -> bool:
        turn = np.degrees(np.arccos(np.clip((seen[:, :9] @ pose[:9] - 1) / 2, -1, 1)))
        way = np.sqrt(((seen[:, 9:] - pose[9:]) ** 2).sum(1))
        return bool(((turn >= self.min_rot) | (way >= self.min_trans)).all())

    def close(self) -> None:
        pass


def novel_views(views: DataFrame, min_rot_deg: float, min_trans: float, key: str = "rig") -> DataFrame:
    """Accepts a view that turns or moves enough against every accepted one: (key, seq, ts, accepted).

    ``views``: key, ts, seq, R array<double>(9), t array<double>(3). A view without a pose is new and is not remembered.
    State is a map from cells of edge ``min_trans`` to the poses accepted there, in RocksDB: a view reads the 27 cells
    where a near pose can be, so what it costs does not grow with all that was accepted, and how many poses a cell can hold
    is bounded by ``min_rot_deg``. Cells read once stay in hand until the batch of the key ends.
    """
    views.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = dict(views.dtypes)
    return views.groupBy(key).transformWithStateInPandas(_Novelty(key, min_rot_deg, min_trans), f"`{key}` {types[key]}, seq long, ts timestamp, accepted boolean", "append", "none")
