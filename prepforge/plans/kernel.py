"""Numeric kernel of the gradient search (PIP13-16, EVL8).

A task gets the parameters of one iteration: per position the fitted options
as numbers, their probabilities and the position weights. From a row's stage-1
alternatives it computes every later option's output ``T(x)``, its slope
``T'(x)``, the mixtures, the cross-entropy of a linear model and, going back,
the gradient for probabilities, position weights and model. Only sums leave a
task, so nothing but the stage-1 alternatives is ever stored.

Rows come as an ``(n, p, T)`` array of alternatives. Gradients are those of
the summed loss; statistics of the options count as constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from prepforge.operators.discretize import WIDTH_EPS
from prepforge.operators.scaling import CLIP_BOUND

# Fixed value: slopes are limited to this size where the stage order is learned.
SLOPE_LIMIT = 10.0
FLOOR = 1e-15


class Form(NamedTuple):
    """A fitted option over p features: ``kind`` and its numbers."""

    kind: str
    args: tuple = ()

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and slope (p, or n x p) at x (n x p)."""
        p = x.shape[1]
        if self.kind == "affine":
            shift, scale, unit, bound = self.args
            y = (x - shift) / scale
            d = 1.0 / scale
            if unit:
                d = np.where((y >= 0) & (y <= 1), d, 0.0)
                y = np.clip(y, 0.0, 1.0)
            return (np.clip(y, -CLIP_BOUND, CLIP_BOUND) if bound else y), d
        if self.kind == "repair":
            low, high, fill = self.args
            inside = (x >= low) & (x <= high)
            return np.where(inside, x, fill), inside.astype(float)
        if self.kind == "uniform":
            least, step, n = self.args
            y = np.clip(np.trunc(np.clip((x - least) / (step + WIDTH_EPS), -1.0, n)), 0, n - 1)
            known = np.isfinite(least)
            return np.where(known, y, x), np.where(known, 0.0, 1.0)
        if self.kind == "quantile":
            cuts, n = self.args
            return np.column_stack([np.minimum(np.searchsorted(c, x[:, j], "left"), n - 1) for j, c in enumerate(cuts)]).astype(float).reshape(len(x), p), np.zeros(p)
        if self.kind == "mask":
            return x * self.args[0], self.args[0].astype(float)
        if self.kind == "project":
            center, components = self.args
            y = np.zeros_like(x)
            y[:, :len(components)] = (x - center) @ components.T
            slope = np.zeros(p)
            slope[:len(components)] = components.sum(1)  # all inputs move together
            return y, slope
        return x, np.ones(p)


class Step(NamedTuple):
    """One stage at one position: its options, probabilities (p x T) and the
    position's weights (p)."""

    stage: int
    forms: list[Form]
    probs: np.ndarray
    weight: np.ndarray


class Plan(NamedTuple):
    first: np.ndarray                 # p x T0 probabilities of the stage-1 alternatives
    positions: list[list[Step]]
    slope_limit: float | None = None

    def forward(self, a: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Model inputs, or the inputs of a position."""
        x = (a * self.first).sum(2)
        for steps in self.positions[:upto]:
            x = sum(s.weight * sum(s.probs[:, t] * f.values(x)[0] for t, f in enumerate(s.forms)) for s in steps)
        return x


class Sums(NamedTuple):
    """Sums over rows; ``probs`` by stage (0: the first), ``weights`` positions
    x steps x p, ``w`` and ``b`` of the model."""

    n: float
    loss: float
    correct: float
    first: np.ndarray
    steps: list[list[np.ndarray]]
    weights: list[list[np.ndarray]]
    w: np.ndarray
    b: np.ndarray

    def flat(self) -> np.ndarray:
        parts = [np.array([self.n, self.loss, self.correct]), self.first.ravel(), *[g.ravel() for s in self.steps for g in s], *[g for s in self.weights for g in s], self.w.ravel(), self.b]
        return np.concatenate(parts)


def zeros(plan: Plan, w: np.ndarray) -> Sums:
    p = len(plan.first)
    return Sums(0.0, 0.0, 0.0, np.zeros_like(plan.first), [[np.zeros_like(s.probs) for s in steps] for steps in plan.positions],
                [[np.zeros(p) for _ in steps] for steps in plan.positions], np.zeros_like(w), np.zeros(len(w)))


def unflat(v: np.ndarray, plan: Plan, w: np.ndarray) -> Sums:
    at = 3

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return v[at - like.size:at].reshape(like.shape)

    z = zeros(plan, w)
    return Sums(*v[:3], take(z.first), [[take(g) for g in s] for s in z.steps], [[take(g) for g in s] for s in z.weights], take(z.w), take(z.b))


def run(plan: Plan, a: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, back: bool = True) -> Sums:
    """Loss of the model (K x p, K) on some rows and, with ``back``, the
    gradient of everything; without, of the model only."""
    out = zeros(plan, w)
    if not len(y):
        return out
    x, trace = (a * plan.first).sum(2), []
    for steps in plan.positions:
        total, parts = 0.0, []
        for s in steps:
            outs, slope, mix = [], 0.0, 0.0
            for t, f in enumerate(s.forms):
                v, d = f.values(x)
                if plan.slope_limit is not None:
                    d = np.clip(d, -plan.slope_limit, plan.slope_limit)
                mix = mix + s.probs[:, t] * v
                if back:
                    slope = slope + s.probs[:, t] * d
                    outs.append(v)
            total = total + s.weight * mix
            parts.append((s, outs, slope, mix))
        trace.append(parts)
        x = total
    z = x @ w.T + b
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss, correct = -np.log(np.maximum(p[rows, y], FLOOR)).sum(), (p.argmax(1) == y).sum()
    p[rows, y] -= 1.0
    first = out.first
    if back:
        g = p @ w
        for i in range(len(trace) - 1, -1, -1):
            before = 0.0
            for j, (s, outs, slope, mix) in enumerate(trace[i]):
                for t, v in enumerate(outs):
                    out.steps[i][j][:, t] = (g * v).sum(0) * s.weight
                out.weights[i][j][:] = (g * mix).sum(0)
                before = before + g * slope * s.weight
            g = before
        first = (g[:, :, None] * a).sum(0)
    return out._replace(n=float(len(y)), loss=float(loss), correct=float(correct), first=first, w=p.T @ x, b=p.sum(0))


def rows_of(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(alternatives, labels) of an Arrow batch with columns ``a`` and ``label``."""
    a = batch.column("a")
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(flat.reshape(batch.num_rows, p, -1)), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


def summed(batches: Iterator[pa.RecordBatch], plan: Plan, models: list[tuple[np.ndarray, np.ndarray]], back: bool, slice_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """A task's sums under each model, one after another."""
    total = None
    for batch in batches:
        for lo in range(0, batch.num_rows, slice_rows):
            a, y = rows_of(batch.slice(lo, slice_rows), len(plan.first))
            v = np.concatenate([run(plan, a, y, w, b, back).flat() for w, b in models])
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])


# --------------------------------------------------------------- fits on a batch

def _nz(v: np.ndarray) -> np.ndarray:
    return np.where((v == 0) | np.isnan(v), 1.0, v)


def fit_form(stage: str, method: str, kw: dict, x: np.ndarray, y: np.ndarray) -> Form:
    """An option fitted on a batch of rows (n x p, without gaps): the numbers
    that the operator of that name fits on a table."""
    from prepforge.operators import outliers, reduction, scaling, selection
    p = x.shape[1]
    if stage == "scaling":
        m = scaling.ALIASES.get(method, method)
        if m == "none":
            return Form("identity")
        low, high = x.min(0), x.max(0)
        if m == "standard":
            shift, scale = x.mean(0), x.std(0)
        elif m in ("minmax", "minmax_clip"):
            shift, scale = low, high - low
        elif m == "robust":
            q = np.percentile(x, [25, 50, 75], axis=0)
            shift, scale = q[1], q[2] - q[0]
        else:
            shift, scale = np.zeros(p), np.abs(x).max(0)
        return Form("affine", (shift, _nz(scale), m == "minmax_clip", kw.get("clip", True)))
    if stage == "outlier_repair" and method != "identity":
        kind, k = outliers.parse_repair(method)
        if kind == "ZS":
            low = high = x.mean(0)
            wide = x.std(0)
        elif kind == "IQR":
            low, high = np.percentile(x, [25, 75], axis=0)
            wide = high - low
        else:
            low = high = np.median(x, axis=0)
            wide = np.median(np.abs(x - low), axis=0)
        low, high = low - k * wide, high + k * wide
        inside = (x >= low) & (x <= high)
        count = inside.sum(0)
        return Form("repair", (low, high, np.where(count, (x * inside).sum(0) / np.maximum(count, 1), 0.0)))
    if stage == "discretization" and method != "identity":
        kind, _, n = method.partition("_")
        n = int(n)
        if kind == "uniform":
            return Form("uniform", (x.min(0), (x.max(0) - x.min(0)) / n, n))
        step = round(len(x) / n)
        at = list(range(step - 1, len(x) - 1, step)) if step > 0 else []
        return Form("quantile", (list(np.sort(x, axis=0)[at].T), n))
    if stage == "feature_selection" and method != "none":
        if method == "variance_threshold":
            return Form("mask", ((x.var(0) > kw.get("threshold", selection.VARIANCE_THRESHOLD)).astype(float),))
        if method == "k_best":
            score = _anova(x, y)
        else:
            score = _mutual_info(fit_form("discretization", f"quantile_{kw.get('bins', selection.MI_BINS)}", {}, x, y).values(x)[0], y)
        k = min(int(kw.get("k", 10)), p)
        order = sorted(range(p), key=lambda j: (-np.inf if np.isnan(score[j]) else score[j], j))
        keep = np.zeros(p)
        keep[order[p - k:]] = 1.0
        return Form("mask", (keep,))
    if stage == "dimensionality_reduction" and method != "none":
        from prepforge.functions.linalg import sym_eig_desc
        k = min(int(kw.get("k", reduction.MAX_COMPONENTS)), p, max(len(x) - 1, 1))
        center = x.mean(0) if method == "pca" else np.zeros(p)
        _, v = sym_eig_desc((x - center).T @ (x - center) / max(len(x) - 1, 1), k)
        return Form("project", (center, v.T))
    return Form("identity")  # outlier removal weighs rows, it leaves values


def _anova(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    classes = np.unique(y)
    if len(classes) < 2 or len(x) <= len(classes):
        return np.full(x.shape[1], np.nan)
    groups = [x[y == c] for c in classes]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups) / (len(classes) - 1)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(x) - len(classes))
    with np.errstate(divide="ignore", invalid="ignore"):
        return between / within


def _mutual_info(bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    _, cls = np.unique(y, return_inverse=True)
    for j in range(bins.shape[1]):
        _, b = np.unique(bins[:, j], return_inverse=True)
        joint = np.zeros((b.max() + 1, cls.max() + 1))
        np.add.at(joint, (b, cls), 1)
        joint /= joint.sum()
        both = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        on = joint > 0
        out[j] = (joint[on] * np.log(joint[on] / both[on])).sum()
    return out


def numeric_form(fitted, feats: list[str]) -> Form:
    """The numbers of an option that Spark fitted on a whole table."""
    from prepforge.operators.discretize import BinFitted
    from prepforge.operators.outliers import RepairFitted
    from prepforge.operators.reduction import ProjectFitted
    from prepforge.operators.scaling import ScaleFitted
    from prepforge.operators.selection import SelectFitted
    q = fitted.params
    if isinstance(fitted, ScaleFitted):
        affine = [q["affine"].get(f, (0.0, 1.0)) for f in feats]
        return Form("affine", (np.array([s for s, _ in affine]), np.array([s for _, s in affine]), bool(q.get("unit_clip")), bool(q.get("clip", True)) and bool(q["affine"])))
    if isinstance(fitted, RepairFitted):
        bounds = [q["bounds"].get(f, (-np.inf, np.inf, 0.0)) for f in feats]
        return Form("repair", tuple(np.array([x if x is not None else 0.0 for x in c], float) for c in zip(*bounds, strict=True)))
    if isinstance(fitted, BinFitted) and q["strategy"] == "uniform":
        edges = [q["edges"].get(f, (-np.inf, 1.0)) for f in feats]
        return Form("uniform", (np.array([e for e, _ in edges]), np.array([s for _, s in edges]), q["n_bins"]))
    if isinstance(fitted, BinFitted):
        return Form("quantile", ([np.array(q["cuts"].get(f, []), float) for f in feats], q["n_bins"]))
    if isinstance(fitted, SelectFitted):
        gone = set(fitted.dropped())
        return Form("mask", (np.array([0.0 if f in gone else 1.0 for f in feats]),))
    if isinstance(fitted, ProjectFitted):
        at = [feats.index(c) for c in fitted.cols]
        components = np.zeros((len(q["components"]), len(feats)))
        center = np.zeros(len(feats))
        components[:, at], center[at] = np.array(q["components"]), np.array(q["center"])
        return Form("project", (center, components))
    return Form("identity")
