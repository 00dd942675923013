"""Stateful operators of the live side, keyed by rig, over Structured Streaming.

Rows of a key arrive unordered inside a micro-batch, so each call sorts its rows by (ts, seq). State is
one JSON string per key. What a call holds is one key's share of a micro-batch, as plain arrays of the columns it
reads; rows are folded and handed on a piece at a time. Bound that share with ``maxFilesPerTrigger``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[dict, pd.DataFrame], list[dict]]


PIECE = 10_000  # rows folded and handed on at once


def _plain(values: pd.Series) -> np.ndarray | pd.Categorical | pd.Series:
    """A column without an object for each row: equal lists as one matrix, strings as codes; else as it came."""
    if values.dtype != object or not len(values):
        return values.copy()  # a view would keep the whole batch
    if all(isinstance(v, str) for v in values):
        return pd.Categorical(values)
    if all(isinstance(v, np.ndarray) and v.dtype.kind in "fiu" for v in values) and len({len(v) for v in values}) == 1:
        return np.stack(values.to_list())
    return values


def _joined(parts: list) -> np.ndarray | pd.Series:
    if all(isinstance(p, np.ndarray) for p in parts) and len({p.shape[1] for p in parts}) == 1:
        return np.concatenate(parts)
    if all(isinstance(p, pd.Categorical) for p in parts):
        return pd.Series(pd.api.types.union_categoricals(parts))
    return pd.concat([pd.Series(list(p) if isinstance(p, np.ndarray) else p.astype(object) if isinstance(p, pd.Categorical) else p) for p in parts], ignore_index=True)


def in_order(batches: Iterator[pd.DataFrame], columns: list[str], piece: int = PIECE) -> Iterator[pd.DataFrame]:
    """The rows of all ``batches`` by (ts, seq), ``piece`` rows at a time."""
    parts: dict[str, list] = {c: [] for c in columns}
    for batch in batches:
        for c in columns:
            parts[c].append(_plain(batch[c]))
    held = {c: _joined(parts.pop(c)) for c in columns}
    ts, seq = held["ts"], held["seq"]
    if ts.isna().any() or seq.isna().any():
        order = pd.DataFrame({"ts": ts, "seq": seq}).sort_values(["ts", "seq"], kind="stable").index.to_numpy()
    else:
        order = np.lexsort((seq.to_numpy(), ts.to_numpy()))
    for start in range(0, len(order), piece):
        at = order[start : start + piece]
        rows = {c: pd.Series(list(v[at])) if isinstance(v, np.ndarray) else v.iloc[at].reset_index(drop=True) for c, v in held.items()}
        yield pd.DataFrame(rows)


def fold_by_key(frames: DataFrame, key: str, out_schema: str, columns: list[str], fold: Fold, initial: dict, reads: list[str]) -> DataFrame:
    """Runs ``fold(state, sorted rows) -> rows`` per key, with the state carried across pieces and batches.

    ``reads`` are the columns a fold uses beside ``ts`` and ``seq``; no others reach it.
    """
    used = ["ts", "seq", *reads]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(initial))
        for rows in in_order(batches, used):
            yield pd.DataFrame([{key: k[0], **r} for r in fold(st, rows)], columns=[key, *columns])
        state.update((json.dumps(st),))

    types = dict(frames.dtypes)
    return frames.select(key, *[c for c in used if c != key]).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {types[key]}, {out_schema}", "state string", "append", GroupStateTimeout.NoTimeout)


def assemble_frame_sets(frames: DataFrame, cameras: list[str], max_ms: float, key: str = "rig", warn_at: int = 100) -> DataFrame:
    """A set whenever a camera advances and every camera has a frame: the latest of each.

    ``frames``: key, camera, seq, ts, host_ns, dev_ns (nullable). The spread uses the device clock when all
    have it, else the host clock; sets above ``max_ms`` are rejected but consume their frames, and exactly
    the ``warn_at``-th rejection in a row raises a warning. A sequence not above the camera's last is stale.
    """
    wanted = list(cameras)

    def fold(st: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for ts, cam, seq, host, dev in zip(rows["ts"], rows["camera"], rows["seq"], rows["host_ns"], rows["dev_ns"]):
            last = st["last"].get(cam)
            if cam not in wanted or (last and seq <= last[0]):
                continue
            st["last"][cam] = [int(seq), int(host), None if pd.isna(dev) else int(dev)]
            if len(st["last"]) < len(wanted):
                continue
            have = list(st["last"].values())
            clock = 2 if all(h[2] is not None for h in have) else 1
            stamps = [h[clock] for h in have]
            spread = (max(stamps) - min(stamps)) / 1e6
            ok = spread <= max_ms
            st["rejects"] = 0 if ok else st["rejects"] + 1
            st["sets"] += 1
            out.append({"set_no": st["sets"], "seq": int(seq), "ts": ts, "clock": "device" if clock == 2 else "host", "spread_ms": spread, "accepted": ok, "warning": st["rejects"] == warn_at})
        return out

    return fold_by_key(frames, key, "set_no long, seq long, ts timestamp, clock string, spread_ms double, accepted boolean, warning boolean",
                       ["set_no", "seq", "ts", "clock", "spread_ms", "accepted", "warning"], fold, {"last": {}, "rejects": 0, "sets": 0}, ["camera", "host_ns", "dev_ns"])


def settle_trigger(frames: DataFrame, thresh: float, need: int, rearm: float, key: str = "rig", timeout_s: float | None = None, mode: str = "settle", every: int = 1) -> DataFrame:
    """Fires once when the scene has been still for ``need`` frames; motion above ``rearm`` arms it again.

    ``frames``: key, ts, seq, grey array<double>. The first frame never fires. ``mode='continuous'`` fires
    on every ``every``-th frame; ``timeout_s`` forces a shot when nothing fired for that long.
    """

    def fold(st: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for ts, seq, grey in zip(rows["ts"], rows["seq"], rows["grey"]):
            now, grey = ts.timestamp(), [float(g) for g in grey]
            diff, fire, forced = None, False, False
            if st["prev"] is not None:
                diff = sum(abs(a - b) for a, b in zip(grey, st["prev"])) / max(len(grey), 1)
                if diff > rearm:
                    st["armed"], st["count"] = True, 0
                st["count"] = st["count"] + 1 if diff <= thresh else max(0, st["count"] - 1)
                if st["armed"] and st["count"] >= need:
                    fire, st["armed"], st["count"] = True, False, 0
            st["prev"], st["n"] = grey, st["n"] + 1
            if mode == "continuous":
                fire = st["n"] % every == 0
            if st["since"] is None or fire:
                st["since"] = now
            elif timeout_s is not None and now - st["since"] >= timeout_s:
                fire = forced = True
                st.update(since=now, armed=False, count=0)
            out.append({"seq": int(seq), "ts": ts, "diff": diff, "fired": fire, "forced": forced})
        return out

    return fold_by_key(frames, key, "seq long, ts timestamp, diff double, fired boolean, forced boolean", ["seq", "ts", "diff", "fired", "forced"],
                       fold, {"prev": None, "count": 0, "armed": True, "since": None, "n": 0}, ["grey"])


def online_align(proposals: DataFrame, reference: str, key: str = "rig_camera", alpha: float = 0.3, max_shift: float = 0.150, max_scale_step: float = 0.010,
                 scale_lo: float = 0.9, scale_hi: float = 1.1) -> DataFrame:
    """Smooths per-frame scale and offset proposals of a camera: EMA (whole on the first), clamped steps.

    ``proposals``: key, camera, ts, seq, a, b (NULL a or b: frame rejected, previous values stay). A scale
    outside its bounds changes only the offset; the reference camera stays at (1, 0).
    """

    def clip(v: float, m: float) -> float:
        return max(-m, min(m, v))

    def fold(st: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for ts, seq, cam, a, b in zip(rows["ts"], rows["seq"], rows["camera"], rows["a"], rows["b"]):
            used = not (pd.isna(a) or pd.isna(b)) and cam != reference
            if used:
                w = alpha if st["n"] else 1.0
                if scale_lo <= a <= scale_hi:
                    st["a"] += clip(w * (float(a) - st["a"]), max_scale_step)
                st["b"] += clip(w * (float(b) - st["b"]), max_shift)
                st["n"] += 1
            out.append({"seq": int(seq), "ts": ts, "a": st["a"], "b": st["b"], "used": used})
        return out

    return fold_by_key(proposals, key, "seq long, ts timestamp, a double, b double, used boolean", ["seq", "ts", "a", "b", "used"], fold, {"a": 1.0, "b": 0.0, "n": 0}, ["camera", "a", "b"])


def novelty_filter(views: DataFrame, min_rot_deg: float, min_trans: float, key: str = "rig") -> DataFrame:
    """Accepts a view that turns or moves enough against every accepted one; a view without a pose is new.

    ``views``: key, ts, seq, R array<double>(9), t array<double>(3).
    """

    def fold(st: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for ts, seq, rot, tr in zip(rows["ts"], rows["seq"], rows["R"], rows["t"]):
            if rot is None or tr is None:
                out.append({"seq": int(seq), "ts": ts, "accepted": True})
                continue
            r, p = [float(v) for v in rot], [float(v) for v in tr]

            def far(q: list) -> bool:
                cos = (sum(x * y for x, y in zip(r, q[0])) - 1) / 2
                return math.degrees(math.acos(max(-1.0, min(1.0, cos)))) >= min_rot_deg or math.dist(p, q[1]) >= min_trans

            ok = all(far(q) for q in st["seen"])
            if ok:
                st["seen"].append([r, p])
            out.append({"seq": int(seq), "ts": ts, "accepted": ok})
        return out

    return fold_by_key(views, key, "seq long, ts timestamp, accepted boolean", ["seq", "ts", "accepted"], fold, {"seen": []}, ["R", "t"])


def run_bounds(frames: DataFrame, max_frames: int | None, duration_s: float | None, key: str = "rig") -> DataFrame:
    """Frames of a key until its count or its duration since the first frame is used up."""

    def fold(st: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for ts, seq in zip(rows["ts"], rows["seq"]):
            now = ts.timestamp()
            st["start"] = now if st["start"] is None else st["start"]
            if (max_frames is not None and st["n"] >= max_frames) or (duration_s is not None and now - st["start"] > duration_s):
                continue
            st["n"] += 1
            out.append({"seq": int(seq), "ts": ts})
        return out

    return fold_by_key(frames, key, "seq long, ts timestamp", ["seq", "ts"], fold, {"start": None, "n": 0}, [])
