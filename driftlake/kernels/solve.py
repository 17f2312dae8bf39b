"""From pair fits to one pose per frame."""

from __future__ import annotations

import numpy as np


def then(a, b) -> np.ndarray:
    c, s = np.cos(b[2]), np.sin(b[2])
    return np.array([c * a[0] - s * a[1] + b[0], s * a[0] + c * a[1] + b[1], a[2] + b[2]])


def inverse(a) -> np.ndarray:
    c, s = np.cos(a[2]), np.sin(a[2])
    return np.array([-(c * a[0] + s * a[1]), s * a[0] - c * a[1], -a[2]])


def canonical(edges) -> list[tuple]:
    """Edges (from, to, dx, dy, theta) from the earlier frame to the later one, in order."""
    return sorted((a, b, *map(float, o)) if a < b else (b, a, *map(float, inverse(o))) for a, b, *o in edges)


class Graph:
    """Least squares over edges between frames, frame 0 at rest.

    Frames are taken in blocks as wide as the longest edge, so that the normal matrix is block-tridiagonal: a solution
    takes time and memory in proportion to the frames, however long the recording is.
    """

    def __init__(self, n: int, edges: list[tuple], information: np.ndarray):
        self.n, self.edges = n, edges
        self.d = d = information.shape[1]
        self.lo, self.hi = (np.array([e[k] for e in edges], int) for k in (0, 1))
        self.obs = np.array([e[2 : 2 + d] for e in edges], float).reshape(-1, d)
        theta = np.array([e[4] for e in edges], float)
        self.r = np.tile(np.eye(d), (len(edges), 1, 1))
        self.r[:, 0, 0] = self.r[:, 1, 1] = np.cos(theta)
        self.r[:, 0, 1], self.r[:, 1, 0] = -np.sin(theta), np.sin(theta)
        self.info = information
        self.wide = max(1, int((self.hi - self.lo).max(initial=1)))
        self.blocks = max(1, -(-(n - 1) // self.wide))

    def _place(self, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (frame - 1) // self.wide, (frame - 1) % self.wide * self.d

    def factorise(self, factors: np.ndarray) -> None:
        d, m = self.d, self.wide * self.d
        diag, off, y = np.zeros((self.blocks, m, m)), np.zeros((max(1, self.blocks - 1), m, m)), np.zeros((self.blocks, m))
        w = self.info * factors[:, None, None]
        wr = w @ self.r
        own = np.arange(d)
        at = lambda f: (lambda b, i: (b[:, None, None], i[:, None, None] + own[None, :, None], i[:, None, None] + own[None, None, :]))(*self._place(f))
        np.add.at(diag, at(self.hi), w)
        moving = self.lo > 0
        lo, hi, rm, wm, wrm = self.lo[moving], self.hi[moving], self.r[moving], w[moving], wr[moving]
        np.add.at(diag, at(lo), rm.transpose(0, 2, 1) @ wrm)
        (bl, il), (bh, ih) = self._place(lo), self._place(hi)
        cross = -(rm.transpose(0, 2, 1) @ wm)  # rows of lo, columns of hi
        for same in (True, False):
            k = (bl == bh) == same
            rows, cols = il[k][:, None, None] + own[None, :, None], ih[k][:, None, None] + own[None, None, :]
            if same:
                np.add.at(diag, (bl[k][:, None, None], rows, cols), cross[k])
                np.add.at(diag, (bl[k][:, None, None], cols.transpose(0, 2, 1), rows.transpose(0, 2, 1)), cross[k].transpose(0, 2, 1))
            else:
                np.add.at(off, (bl[k][:, None, None], rows, cols), cross[k])
        wo = np.einsum("eij,ej->ei", w, self.obs)
        b, i = self._place(self.hi)
        np.add.at(y, (b[:, None], i[:, None] + own), wo)
        np.add.at(y, (bl[:, None], il[:, None] + own), -np.einsum("eji,ej->ei", rm, wo[moving]))
        used = np.arange(self.blocks * self.wide) < self.n - 1
        mean = np.einsum("bii->", diag) / max(1, (self.n - 1) * d)
        ridge = max(1e-9 * (mean if mean > 0 else 1.0), np.finfo(float).tiny)
        pad = np.where(np.repeat(used, d), ridge, 1.0).reshape(self.blocks, m)
        diag[:, np.arange(m), np.arange(m)] += pad
        # forward elimination; s holds the Schur complements, u what a block's unknowns take from the next block
        self.s, self.u = diag, np.zeros_like(off)
        for k in range(self.blocks - 1):
            self.u[k] = np.linalg.solve(self.s[k], off[k])
            self.s[k + 1] = self.s[k + 1] - off[k].T @ self.u[k]
            y[k + 1] -= self.u[k].T @ y[k]
        x = np.linalg.solve(self.s[-1], y[-1])
        out = np.zeros((self.blocks, m))
        out[-1] = x
        for k in range(self.blocks - 2, -1, -1):
            x = np.linalg.solve(self.s[k], y[k]) - self.u[k] @ x
            out[k] = x
        self.x = np.concatenate([np.zeros((1, d)), out.reshape(-1, d)[: self.n - 1]])

    def poses(self) -> np.ndarray:
        return np.concatenate([self.x, np.zeros((self.n, 3 - self.d))], axis=1)

    def residuals(self) -> np.ndarray:
        """(edges, d): the later pose less what the edge makes of the earlier one."""
        return self.x[self.hi] - np.einsum("eij,ej->ei", self.r, self.x[self.lo]) - self.obs

    def without(self, factors: np.ndarray) -> np.ndarray:
        """Residuals of each edge at the solution without it, by its leverage; as they are where no other path joins its ends."""
        m, d, own = self.wide * self.d, self.d, np.arange(self.d)
        inv, nxt = np.zeros((self.blocks, m, m)), np.zeros((max(1, self.blocks - 1), m, m))  # blocks of the inverse
        inv[-1] = np.linalg.inv(self.s[-1])
        for k in range(self.blocks - 2, -1, -1):
            nxt[k] = -self.u[k] @ inv[k + 1]
            inv[k] = np.linalg.inv(self.s[k]) - nxt[k] @ self.u[k].T
        r = self.residuals()
        bridge = bridges(self.n, list(zip(self.lo.tolist(), self.hi.tolist(), strict=True)))
        out = r.copy()
        for e in np.flatnonzero(~bridge):
            bh, ih = (int(v) for v in self._place(self.hi[e]))
            v = inv[bh][np.ix_(ih + own, ih + own)]
            if self.lo[e] > 0:
                bl, il = (int(v) for v in self._place(self.lo[e]))
                cross = inv[bl][np.ix_(il + own, ih + own)] if bl == bh else nxt[bl][np.ix_(il + own, ih + own)]
                rot = self.r[e]
                v = v - rot @ cross - cross.T @ rot.T + rot @ inv[bl][np.ix_(il + own, il + own)] @ rot.T
            out[e] = np.linalg.solve(np.eye(d) - v @ self.info[e] * factors[e], r[e])
        return out


def bridges(n: int, ends: list[tuple[int, int]]) -> np.ndarray:
    """Whether an edge is the only path between its ends."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for e, (a, b) in enumerate(ends):
        near[a].append((b, e))
        near[b].append((a, e))
    seen, low, out, clock = [0] * n, [0] * n, np.zeros(len(ends), bool), 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, by, rest = stack[-1]
            for to, e in rest:
                if e == by:
                    continue
                if seen[to]:
                    low[node] = min(low[node], seen[to])
                    continue
                clock += 1
                seen[to] = low[to] = clock
                stack.append((to, e, iter(near[to])))
                break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    out[by] = low[node] > seen[up]
    return out


def information(edges: int, d: int, radius: float, covariances: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Information of each edge and whether it had to be made up: one matrix for all (in pixels at the radius), or the
    inverse covariances over their median size."""
    if covariances is None:
        one = np.diag([1.0, 1.0, radius**2][:d])
        return np.tile(one / (np.trace(one) / d), (edges, 1, 1)), np.zeros(edges, bool)
    found = [np.linalg.inv(c) if c is not None and len(c) == d else None for c in covariances]
    sizes = np.sort([np.trace(f) / d for f in found if f is not None])
    usual = float(sizes[len(sizes) // 2]) if len(sizes) else 1.0
    return np.array([(np.eye(d) * usual if f is None else f) / usual for f in found]).reshape(-1, d, d), np.array([f is None for f in found])


def reconciled(n: int, edges, weighting: str = "EQUAL", radius: float = 1.0, covariances: list[np.ndarray | None] | None = None, rotation: bool = True, rounds: int = 8) -> dict:
    """Poses, support and, for each edge as given, its residual, standardised residual, factor and what was made of it.

    EQUAL and ROBUST weigh edges alike at first, UNCERTAINTY and COMBINED by their covariances; ROBUST and COMBINED then
    take weight from edges that disagree with the solution without them.
    """
    if weighting not in ("EQUAL", "UNCERTAINTY", "ROBUST", "COMBINED"):
        raise ValueError(f"unknown weighting {weighting}")
    support = np.zeros(n, int)
    support[:1] = 1
    for a, b, *_ in edges:
        support[a] += 1
        support[b] += 1
    out = {"poses": np.zeros((n, 3)), "support": support, "residual": np.zeros((0, 3)), "standardised": np.zeros(0), "factor": np.zeros(0), "fallback": np.zeros(0, bool), "converged": True}
    if not edges or n < 2:
        return out
    d = 3 if rotation else 2
    order = sorted(range(len(edges)), key=lambda i: (min(edges[i][:2]), max(edges[i][:2]), i))
    made, cov = [], []
    for i in order:
        a, b, *o = edges[i]
        c = covariances[i] if covariances is not None else None
        if a > b and c is not None:
            from driftlake.kernels.fit import covariance_of_inverse

            c = covariance_of_inverse(np.asarray(c), o)
        made.append((a, b, *map(float, o)) if a < b else (b, a, *map(float, inverse(o))))
        cov.append(c)
    info, fallback = information(len(made), d, radius, cov if weighting in ("UNCERTAINTY", "COMBINED") else None)
    g, factors = Graph(n, made, info), np.ones(len(made))
    size = lambda r: np.sqrt(np.maximum(0, np.einsum("ei,eij,ej->e", r, info, r)) / d)
    robust_, before, converged = weighting in ("ROBUST", "COMBINED"), None, True
    if robust_:
        converged = False
        for _ in range(rounds):
            g.factorise(factors)
            r = size(g.without(factors))
            mid = np.sort(r)[len(r) // 2]
            limit = 1.345 * max(1e-6, 1.4826 * np.sort(np.abs(r - mid))[len(r) // 2])
            over = np.maximum(0.0, r - mid)
            new = np.clip(np.where(over > limit, limit / np.maximum(over, 1e-300), 1.0), 0.05, 1.0)
            p = g.poses() * [1, 1, radius]
            still = before is not None and np.sqrt(((p - before) ** 2).sum(axis=1)).max() <= 1e-5
            changed, factors, before = np.max(np.abs(new - factors)), new, p
            if changed <= 1e-4 and still:
                converged = True
                break
    g.factorise(factors)
    r = g.residuals()
    std = size(g.without(factors)) if robust_ else size(r)
    back = np.argsort(order)
    full = np.concatenate([r, np.zeros((len(r), 3 - d))], axis=1)
    out.update(poses=g.poses(), residual=full[back], standardised=std[back], factor=factors[back], fallback=fallback[back], converged=converged)
    return out


def multilag(n: int, edges: list[tuple[int, int, float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Least squares over all edges (from, to, dx, dy, theta) with frame 0 at rest: (poses, support)."""
    got = reconciled(n, edges)
    return got["poses"], got["support"]


def robust(n: int, edges, radius: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """multilag() with edges that disagree with the rest weighted down: (poses, support, weights)."""
    got = reconciled(n, edges, "ROBUST", radius)
    return got["poses"], got["support"], got["factor"]


def least_squares(n: int, edges) -> np.ndarray:
    """(frames, 2) translations by plain least squares over (from, to, dx, dy); frames that no path joins to the first are an error."""
    design, y = np.zeros((len(edges), n)), np.array([e[2:4] for e in edges], float).reshape(-1, 2)
    for k, (a, b, *_) in enumerate(edges):
        design[k, a] -= 1
        design[k, b] += 1
    found, _, rank, _ = np.linalg.lstsq(design[:, 1:], y, rcond=None)
    if rank != n - 1:
        raise ValueError(f"the graph has rank {rank}, not {n - 1}")
    return np.concatenate([np.zeros((1, 2)), found])


def known_angles(poses: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Poses with the angles replaced by known ones."""
    return np.column_stack([poses[:, :2], theta])


def rebased(poses: np.ndarray, frame: int) -> np.ndarray:
    """Poses relative to another frame."""
    back = inverse(poses[frame])
    return np.array([then(back, p) for p in poses])


def scaled(poses: np.ndarray, factor: float) -> np.ndarray:
    """Poses estimated on planes that were scaled down, at full size."""
    if not (np.isfinite(factor) and factor > 0):
        raise ValueError("the factor is a positive number")
    return poses * [factor, factor, 1.0]


def chain(n: int, edges) -> tuple[np.ndarray, np.ndarray]:
    step = {b: o for a, b, *o in edges if b == a + 1}
    poses, support = np.zeros((n, 3)), np.zeros(n, int)
    for t in range(n):
        support[t] = int(t == 0 or t in step)
        if t:
            poses[t] = then(poses[t - 1], step.get(t, (0.0, 0.0, 0.0)))
    return poses, support


def fixed(n: int, edges, reference: int = 0) -> tuple[np.ndarray, np.ndarray]:
    poses, support = np.zeros((n, 3)), np.zeros(n, int)
    support[reference] = 1
    for a, b, *o in edges:
        if a == reference:
            poses[b], support[b] = o, 1
    return poses, support


def event_turn(angles, weights, max_rotation: float, rounds: int = 20) -> dict:
    """The turn at a known event from fits across it: a weighted circular median, then a Huber circular mean.

    delta and spread are NaN with fewer than three fits; inliers are those within the Huber bound of the result.
    """
    a, w = np.asarray(angles, float), np.maximum(np.asarray(weights, float), 1e-12)
    if len(a) < 3:
        return {"delta": float("nan"), "spread": float("nan"), "inliers": 0, "status": "INSUFFICIENT_SUPPORT"}
    wrap = lambda x: np.arctan2(np.sin(x), np.cos(x))
    mid = min(a, key=lambda c: float(np.sum(w * np.abs(wrap(a - c)))))
    spread = np.sort(np.abs(wrap(a - mid)))[len(a) // 2]
    bound = 1.345 * max(1e-9, 1.4826 * spread)
    for _ in range(rounds):
        k = w * np.minimum(1.0, bound / np.maximum(np.abs(wrap(a - mid)), 1e-300))
        new = np.arctan2(np.sum(k * np.sin(a)), np.sum(k * np.cos(a)))
        done = abs(wrap(new - mid)) < 1e-12
        mid = new
        if done:
            break
    inliers = int((np.abs(wrap(a - mid)) <= bound + 1e-12).sum())
    return {"delta": float(wrap(mid)), "spread": float(spread), "inliers": inliers, "status": "HIGH_DISAGREEMENT" if spread > 0.25 * max_rotation else "OK"}


def event_angle(angles, weights, max_rotation: float) -> tuple[float, str]:
    """(turn, status) of event_turn(); no turn without support."""
    got = event_turn(angles, weights, max_rotation)
    return (0.0 if np.isnan(got["delta"]) else got["delta"]), got["status"]
