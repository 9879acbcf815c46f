"""A particle search beside the inertial filter, for the windows of many vehicles at once: the k-th windows of a block of vehicles are one step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .filters import resampled
from .inertial import Inertials
from .search import Raster

#: Frames of a window and between windows; particles of a vehicle; metres between samples of a profile; seconds of a step; metres that particles move in a tenth of it; metres of noise of a height.
SIZE, STEP, PARTICLES, SPACING, SECONDS, MOVE, SIGMA = 20, 10, 200, 3.0, 10.0, 3.0, 100.0
#: Vehicles that are stepped together: their samples fit a cache.
BLOCK = 16
SCHEMA = "user_id bigint, window_id bigint, first_id bigint, last_id bigint, mode string, entropy double, spread double, east double, north double, up double"
_FILTER = ("p", "v", "q", "accel_bias", "gyro_bias", "cov", "heading")


class Swarms:
    """Filters and particles of some vehicles. Particles are drawn by a generator seeded with the vehicle's key."""

    def __init__(self, keys: np.ndarray, terrain: Raster):
        self.keys, self.terrain, self.f = keys, terrain, Inertials()
        self.f.seat(keys)
        self.centre = np.array([900.0, terrain.shape[0] * terrain.cell / 2])
        self.rng = [np.random.default_rng(k) for k in keys.tolist()]
        self.parts = np.stack([self.centre + r.normal(0, 200, (PARTICLES, 2)) for r in self.rng])
        self.w = np.full((len(keys), PARTICLES), 1 / PARTICLES)
        self.windows = np.zeros(len(keys), int)
        self.heading = (keys * 40 % 360).astype(float)
        b = np.radians(self.heading)
        self.ahead = np.stack([np.sin(b), np.cos(b)], axis=1)

    def state(self, i: int) -> tuple:
        """What is known of one vehicle, for restore."""
        return self.rng[i], self.parts[i].copy(), self.w[i].copy(), int(self.windows[i]), [getattr(self.f, name)[i].copy() for name in _FILTER]

    def restore(self, i: int, state: tuple) -> None:
        self.rng[i], self.parts[i], self.w[i], self.windows[i], held = state
        for name, value in zip(_FILTER, held, strict=True):
            getattr(self.f, name)[i] = value

    def step(self, at: np.ndarray, agl: np.ndarray) -> dict[str, np.ndarray]:
        """The next window of the vehicles at some places: predict, altitude, particles moved and weighed by the window's terrain, position update if they agree. agl: (vehicle, frame), NaN for invalid."""
        f, n = self.f, PARTICLES
        f.level(at, self.heading[at], SECONDS, turning=False)
        f.correct(at, slice(2, 3), -f.p[at, 2:3], np.array([[64.0]]))
        self.parts[at] = self.parts[at] + (MOVE * self.ahead[at])[:, None] + np.stack([self.rng[i].normal(0, 10, (n, 2)) for i in at])
        profile = 1500 - agl
        ok = np.isfinite(profile)
        count = ok.sum(axis=1)
        share = 1 / np.maximum(count, 1)
        apart = np.where(ok, profile - (np.where(ok, profile, 0).sum(axis=1) * share)[:, None], 0)
        usable = (count >= max(3, SIZE // 2)) & (np.sqrt((apart * apart).sum(axis=1) * share) >= 1e-6)
        entropy, spread, agreed = np.full(len(at), np.log(n)), np.full(len(at), np.nan), np.zeros(len(at), bool)
        use = np.flatnonzero(usable)
        if len(use):
            entropy[use], spread[use], agreed[use] = self._weigh(at[use], profile[use], ok[use])
        out = {"user_id": self.keys[at], "window_id": self.windows[at], "mode": np.where(agreed, "terrain_particle_update", "inertial_prediction"), "entropy": entropy, "spread": spread, "east": f.p[at, 0], "north": f.p[at, 1], "up": f.p[at, 2]}
        self.windows[at] += 1
        return out

    def _weigh(self, at: np.ndarray, profile: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entropy and spread of the particles under new weights, and whether they agree, which is judged before they are drawn anew. Particles that see no terrain count as five sigma."""
        # places without a height are nowhere, so that no terrain is read for them
        d = np.where(ok, np.arange(SIZE) * SPACING, np.nan)[:, None]
        parts = self.parts[at]
        r = self.terrain.sample(parts[:, :, :1] + d * self.ahead[at, 0][:, None, None], parts[:, :, 1:] + d * self.ahead[at, 1][:, None, None])
        r -= profile[:, None]
        r = np.where(np.isfinite(r), r, 5 * SIGMA)
        r *= r
        miss = (r @ ok[:, :, None].astype(float))[..., 0] / ok.sum(axis=1)[:, None]
        logs = np.log(np.maximum(self.w[at], 1e-300)) - 0.5 * miss / SIGMA**2
        w = np.exp(logs - logs.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        self.w[at] = w
        apart = parts - (w[:, None] @ parts)
        cov = (w[..., None] * apart).swapaxes(1, 2) @ apart + np.eye(2) * 1e-9
        entropy, spread = -(w * np.log(np.maximum(w, 1e-300))).sum(axis=1), np.trace(cov, axis1=1, axis2=2)
        agreed = (spread < 50_000) & (entropy < 0.75 * np.log(PARTICLES))
        one = at[agreed]
        self.f.correct(one, slice(0, 2), parts[agreed, w[agreed].argmax(axis=1)] - self.centre - self.f.p[one, :2], cov[agreed] + np.eye(2))
        for k in np.flatnonzero(1 / (w * w).sum(axis=1) < 0.6 * PARTICLES):
            i = at[k]
            self.parts[i], self.w[i] = parts[k][resampled(w[k], float(self.rng[i].random()))], 1 / PARTICLES
        return entropy, spread, agreed


def search(samples: DataFrame, terrain: Raster) -> DataFrame:
    """samples: user_id, event_id, ts, agl (null for invalid), taken in order of ts, then event_id. A row for each window.

    Vehicles come one after the other in batches of rows; a task holds a batch, and of the vehicle that the next one may go on with its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, agl, state = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None
        for rows in batches:
            if not len(rows):
                continue
            fresh = rows["user_id"].to_numpy(np.int64)
            if len(key) and key[0] != fresh[0]:
                key, ids, agl, state = key[:0], ids[:0], agl[:0], None
            key, ids, agl = np.concatenate([key, fresh]), np.concatenate([ids, rows["event_id"].to_numpy(np.int64)]), np.concatenate([agl, rows["agl"].to_numpy(float)])
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lengths = np.diff(np.concatenate((first, [len(key)])))
            s = Swarms(key[first], terrain)
            if state is not None:
                s.restore(0, state)
            windows = np.maximum((lengths - SIZE) // STEP + 1, 0)
            found, order = [], np.argsort(-windows, kind="stable")
            for b in range(0, len(order), BLOCK):
                block = order[b : b + BLOCK]
                for k in range(windows[block[0]]):
                    # most windows first, so those that have a k-th one stand in front
                    at = block[: int(np.searchsorted(-windows[block], -k, side="left"))]
                    begin = first[at] + k * STEP
                    found.append({"first_id": ids[begin], "last_id": ids[begin + SIZE - 1], **s.step(at, agl[begin[:, None] + np.arange(SIZE)])})
            if found:
                yield pd.DataFrame({c.split()[0]: np.concatenate([x[c.split()[0]] for x in found]) for c in SCHEMA.split(", ")}).round(6)
            last = len(first) - 1
            rest, state = first[last] + windows[last] * STEP, s.state(last)
            key, ids, agl = key[rest:], ids[rest:], agl[rest:]

    # dealt by number: rows are small and windows are slow, so partitions must not be merged by their size
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.select("user_id", "event_id", "ts", "agl").repartition(parts, "user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, SCHEMA)
