"""One pass over sorted trajectories that finds everything a junction's decision is made of.

decisions.scan() sorts the points by trajectory inside their partitions, and sweep() reads them in Arrow batches. A piece of a
trajectory, as much of it as a batch holds, meets all junctions as a matrix of distances; what the next piece needs is
carried over: a few numbers for each junction and the last rows. So a task's memory grows with the junctions but not with
a trajectory's length, and a row for each point and junction is never made outside a piece.

While nothing has been inside a junction, its start is the nearest point so far, and what was found after an earlier one
is dropped when a nearer one comes; from the first point inside on, the start stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from strideline.plans.params import Decision, Junction

#: Distances in a piece's matrix at most; more junctions are taken in turn.
CELLS = 1 << 20
#: Steps at the end of a trajectory that a direction falls back to.
LATE = 10
#: What the pass finds for each trajectory and junction: whole numbers (none: -1) and doubles (none: NaN).
INDICES = ("first_in", "last_in", "nearest", "start", "radial_idx", "trend_idx", "pathlen_idx", "ring_in", "reach_in")
VALUES = ("t_start", "t_radial", "t_before_pathlen", "t_trend", "t_pathlen", "path_trend", "path_pathlen", "rx", "rz", "near_dx", "near_dz", "t1_dx", "t1_dz", "t2_seg", "t2_dx", "t2_dz", "t2_prev", "lx", "lz", "end_dist", "radial_x", "radial_z", "radial_dist", "pathlen_x", "pathlen_z", "pathlen_dist")
#: Columns of the rows that come in, and those that go out as they are (they are the same in all rows of a trajectory).
POINT, WALK = ("idx", "x", "z", "t", "dx", "dz", "seg"), ("n", "total", "timed", "median", "far", "wide")
#: Found again from scratch when a start moves.
_AFTER = ("radial_idx", "trend_idx", "pathlen_idx")


class Walk:
    """What is known of one trajectory at all junctions."""

    def __init__(self, discs: np.ndarray, how: Decision, wide: float, far: float):
        self.cx, self.cz, self.r, ring, self.reach = discs
        self.ring = ring if np.isnan(wide) else np.where(wide > self.r, wide, self.r + 10.0)
        self.how, self.far, size = how, far, len(self.cx)
        self.at = {k: np.full(size, -1, np.int64) for k in INDICES}
        self.value = {k: np.full(size, np.nan) for k in (*VALUES, "near_seg", "begin")}
        self.least, self.path = np.full(size, np.inf), np.zeros(size)
        self.kept = {k: np.zeros(0) for k in POINT}

    def add(self, rows: dict[str, np.ndarray], last: bool) -> None:
        """The trajectory's next rows, with the last ones before them ahead; last: they end it."""
        old = len(self.kept["idx"])
        p = {k: np.concatenate((self.kept[k], rows[k])) for k in POINT}
        step = max(1, CELLS // len(p["x"]))
        for j in range(0, len(self.cx), step):
            self._meet(slice(j, j + step), p, old, last)
        keep = max(self.how.window, LATE) + 1
        self.kept = {k: v[-keep:] for k, v in p.items()}

    def _meet(self, some: slice, p: dict[str, np.ndarray], old: int, last: bool) -> None:
        """A slab of junctions and a piece; old of its rows were seen before."""
        at, value, how = {k: v[some] for k, v in self.at.items()}, {k: v[some] for k, v in self.value.items()}, self.how  # views: written in place
        least, path, r, ring = self.least[some], self.path[some], self.r[some], self.ring[some]
        base, window, each = int(p["idx"][0]), how.window, np.arange(len(r))
        dx, dz = p["x"][:, None] - self.cx[some], p["z"][:, None] - self.cz[some]
        dist = np.sqrt(dx * dx + dz * dz)
        new, place = dist[old:], np.arange(old, len(dist))

        def first(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Junctions with any row, and the first one's place in p."""
            js = np.flatnonzero(found.any(axis=0))
            return js, found[:, js].argmax(axis=0) + old

        k = new.argmin(axis=0)
        near = new[k, each] < least
        least[near], at["nearest"][near] = new[k, each][near], base + old + k[near]
        moved = near & (at["first_in"] < 0)
        inside = new <= r
        js, k = first(inside)
        come = at["first_in"][js] < 0
        at["first_in"][js[come]] = base + k[come]
        moved[js[come]] = True
        at["last_in"][js] = base + len(dist) - 1 - inside[::-1, js].argmax(axis=0)
        for name, limit in (("ring_in", ring), ("reach_in", self.reach[some])):
            js, k = first(new <= limit)
            none = at[name][js] < 0
            at[name][js[none]] = base + k[none]

        at["start"][moved] = np.where(at["first_in"] >= 0, at["first_in"], at["nearest"])[moved]
        for name in _AFTER:
            at[name][moved] = -1
        for v in value.values():
            v[moved] = np.nan
        path[moved] = 0.0
        start = at["start"] - base  # places in p; under 0 for rows gone by
        js = np.flatnonzero(moved)
        value["t_start"][js] = p["t"][start[js]]

        after = place[:, None] > start
        steps = np.where(after, p["seg"][old:, None], 0.0)
        steps[0] += path
        run = np.cumsum(steps, axis=0)
        path[:] = run[-1]
        js = np.flatnonzero((start + 1 >= old) & (start + 1 < len(dist)))
        value["begin"][js] = dist[start[js] + 1, js]
        back = np.maximum(place - window, 0)
        bar = np.where((place - window)[:, None] >= start + 1, dist[back], value["begin"])
        crossing = after & (new >= ring) & (new >= bar)
        big = p["seg"] >= how.epsilon

        js, k = first(crossing)
        js, k = (x[at["radial_idx"][js] < 0] for x in (js, k))
        at["radial_idx"][js] = base + k
        for name, column in (("t_radial", p["t"]), ("radial_x", p["x"]), ("radial_z", p["z"])):
            value[name][js] = column[k]
        value["radial_dist"][js] = dist[k, js]
        for back_by in range(window - 1, -1, -1):  # the steps up to the crossing, in order
            q = k - back_by
            here = q > start[js]
            jq, q = js[here], q[here]
            sums = big[q]
            for name, column in (("rx", p["dx"]), ("rz", p["dz"])):
                value[name][jq[sums]] = np.nan_to_num(value[name][jq[sums]]) + column[q[sums]]
            longer = ~(value["near_seg"][jq] >= p["seg"][q])
            for name, column in (("near_seg", p["seg"]), ("near_dx", p["dx"]), ("near_dz", p["dz"])):
                value[name][jq[longer]] = column[q[longer]]

        js, k = first(crossing & (place[:, None] > start + 1))
        js, k = (x[at["trend_idx"][js] < 0] for x in (js, k))
        at["trend_idx"][js], value["t_trend"][js], value["path_trend"][js] = base + k, p["t"][k], run[k - old, js]

        js, k = first(after & (run >= self.far))
        js, k = (x[at["pathlen_idx"][js] < 0] for x in (js, k))
        at["pathlen_idx"][js] = base + k
        for name, column in (("t_pathlen", p["t"]), ("pathlen_x", p["x"]), ("pathlen_z", p["z"])):
            value[name][js] = column[k]
        value["pathlen_dist"][js], value["path_pathlen"][js], value["t_before_pathlen"][js] = dist[k, js], run[k - old, js], p["t"][k - 1]

        before = np.vstack((np.full((1, len(r)), np.nan), dist))[old : old + len(new)]  # each row's distance one row earlier
        clear = r + max(5.0, how.linger_delta)
        reached = (at["pathlen_idx"] >= 0) & (place[:, None] + base >= at["pathlen_idx"])
        js, k = first(reached & big[old:, None] & (before >= clear))
        js, k = (x[np.isnan(value["t1_dx"][js])] for x in (js, k))
        value["t1_dx"][js], value["t1_dz"][js] = p["dx"][k], p["dz"][k]

        reach = np.where(after, p["seg"][old:, None], -1.0)
        k = reach.argmax(axis=0)
        js = np.flatnonzero((reach[k, each] >= 0) & ~(value["t2_seg"] >= reach[k, each]))
        k = k[js]
        for name, found in (("t2_seg", reach[k, js]), ("t2_dx", p["dx"][k + old]), ("t2_dz", p["dz"][k + old]), ("t2_prev", before[k, js])):
            value[name][js] = found

        if last:
            tail = np.arange(max(0, len(dist) - LATE), len(dist))
            late = tail[:, None] > start
            js = np.flatnonzero(late.any(axis=0))
            for name, column in (("lx", p["dx"]), ("lz", p["dz"])):
                value[name][js] = np.where(late, column[tail][:, None], 0.0).sum(axis=0)[js]
            if len(dist) > 1:
                js = np.flatnonzero(len(dist) - 1 > start)
                value["end_dist"][js] = dist[-2, js]


def sweep(at: Sequence[Junction], how: Decision, key: pa.DataType, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over batches of trajectory, POINT and WALK (in trajectories of ascending idx): a row for each trajectory and junction, of trajectory, junction, the junction's cx, cz, r, ring and reach, n, total, timed, median, INDICES and VALUES."""
    junctions = np.array([j.junction for j in at], np.int32)
    discs = np.array([(j.cx, j.cz, j.r, j.ring, j.reach) for j in at], np.float64).reshape(-1, 5).T

    def done(walks: list[tuple]) -> pa.RecordBatch:
        """The finished trajectories."""
        size, stack = len(junctions), lambda parts: np.concatenate(parts)
        ids = pa.array([k for k, _, _ in walks], key).take(pa.array(np.repeat(np.arange(len(walks)), size)))
        columns: dict[str, pa.Array] = {"trajectory": ids, "junction": pa.array(np.tile(junctions, len(walks)))}
        for name in ("cx", "cz", "r", "ring", "reach"):
            columns[name] = pa.array(stack([getattr(w, name) for _, w, _ in walks]))
        for name in ("n", "total", "timed", "median"):
            whole = np.repeat([row[name] for _, _, row in walks], size)
            columns[name] = pa.array(whole.astype(np.int64) if name in ("n", "timed") else whole, from_pandas=True)
        for name in INDICES:
            found = stack([w.at[name] for _, w, _ in walks])
            columns[name] = pa.array(found, pa.int64(), mask=found < 0)
        for name in VALUES:
            columns[name] = pa.array(stack([w.value[name] for _, w, _ in walks]), from_pandas=True)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None  # of the trajectory that a batch's end cuts
        for batch in batches:
            if not len(batch):
                continue
            column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*POINT, *WALK)}
            firsts = np.flatnonzero(column["idx"] == 0)
            bounds = [0, *firsts[firsts > 0].tolist(), len(batch)]
            finished: list[tuple] = []
            for a, b in zip(bounds, bounds[1:]):
                row = {n: column[n][a] for n in WALK}
                if (column["idx"][a] == 0) != (walk is None) or column["idx"][b - 1] - column["idx"][a] != b - 1 - a:
                    raise ValueError("idx has to count a trajectory's points from 0 without gaps")
                if walk is None:
                    walk = Walk(discs, how, row["wide"], row["far"])
                last = bool(column["idx"][b - 1] == row["n"] - 1)
                walk.add({n: column[n][a:b] for n in POINT}, last)
                if last:
                    finished.append((batch.column("trajectory")[a].as_py(), walk, row))
                    walk = None
                    if len(finished) * len(junctions) >= CELLS:
                        yield done(finished)
                        finished = []
            if finished:
                yield done(finished)
        if walk is not None:
            raise ValueError("idx has to count a trajectory's points from 0 without gaps")

    return run
