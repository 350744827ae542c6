"""Probability models for many small fits: NumPy inside grouped tasks, one task a fold and setting."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def logit(p: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    p = np.clip(p, eps, 1 - eps)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, weight: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """Intercept and weights minimising 1/2 |w|^2 + c * sum of losses, by Newton's method."""
    d = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if weight is None else weight
    ridge = np.diag([0.0, *np.ones(x.shape[1])])
    b = np.zeros(d.shape[1])
    value = lambda b: c * float(w @ (np.logaddexp(0, d @ b) - y * (d @ b))) + 0.5 * float(b @ ridge @ b)
    for _ in range(rounds):
        p = sigmoid(d @ b)
        g = c * d.T @ (w * (p - y)) + ridge @ b
        step = np.linalg.solve(c * (d * (w * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ d + ridge + 1e-12 * np.eye(len(b)), g)
        t, now = 1.0, value(b)
        while value(b - t * step) > now + 1e-12 and t > 1e-6:
            t /= 2
        b = b - t * step
        if np.abs(t * step).max() < 1e-10:
            break
    return b


def balanced(y: np.ndarray) -> np.ndarray:
    n1 = max(float(y.sum()), 1e-12)
    n0 = max(len(y) - float(y.sum()), 1e-12)
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))


class Scaler:
    def __init__(self, x: np.ndarray):
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0)
        self.sd[self.sd == 0] = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


class Linear:
    """Standardised inputs, ridge-penalised logistic regression."""

    def __init__(self, c: float = 1.0, class_balance: bool = False):
        self.c, self.class_balance = c, class_balance

    def fit(self, x: np.ndarray, y: np.ndarray) -> Linear:
        self.scale = Scaler(x)
        self.beta = fit_logistic(self.scale(x), y, self.c, balanced(y) if self.class_balance else None)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.beta[0] + self.scale(x) @ self.beta[1:])


def spline_basis(x: np.ndarray, low: float, high: float, knots: int, degree: int = 3) -> np.ndarray:
    """Cubic B-spline columns on even knots, constant beyond the ends; the first column is left out."""
    if high <= low:
        high = low + 1.0
    step = (high - low) / (knots - 1)
    t = low + step * np.arange(-degree, knots + degree)
    x = np.clip(x, low, high - 1e-12 * (high - low))
    b = ((x[:, None] >= t[None, :-1]) & (x[:, None] < t[None, 1:])).astype(float)
    for k in range(1, degree + 1):
        left = (x[:, None] - t[None, : -k - 1]) / (t[k:-1] - t[: -k - 1])
        right = (t[None, k + 1 :] - x[:, None]) / (t[k + 1 :] - t[1:-k])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b[:, 1:]


class Spline(Linear):
    """B-spline columns for the last `signals` inputs, the others as they are."""

    def __init__(self, signals: int, knots: int = 4, c: float = 1.0):
        super().__init__(c)
        self.signals, self.knots = signals, knots

    def _wide(self, x: np.ndarray) -> np.ndarray:
        split = x.shape[1] - self.signals
        parts = [spline_basis(x[:, split + i], *self.ends[i], self.knots) for i in range(self.signals)]
        return np.column_stack([x[:, :split], *parts])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Spline:
        split = x.shape[1] - self.signals
        self.ends = [(float(x[:, split + i].min()), float(x[:, split + i].max())) for i in range(self.signals)]
        super().fit(self._wide(x), y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return super().predict(self._wide(x))


class Boosting:
    """Shallow histogram boosting on the logistic loss: a documented stand-in, trees grown level by level."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.05, least: int = 100, l2: float = 1.0, bins: int = 32):
        self.depth, self.rounds, self.rate, self.least, self.l2, self.bins = depth, rounds, rate, least, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = self._code(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = sigmoid(f)
            tree, step = self._grow(code, y - q, q * (1 - q))
            self.trees.append(tree)
            f += step
        return self

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.asfortranarray(np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]))

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """A tree and what it adds to each row. A level's nodes share their passes: one count and two sums a column."""
        splits, node, now = {}, np.ones(len(g), np.int64), [1]
        columns, cells = code.T, self.bins + 1
        place = np.zeros(len(g), np.int64)
        for _ in range(self.depth):
            rows = [np.flatnonzero(node == k) for k in now]
            now, rows = [k for k, r in zip(now, rows) if len(r) >= 2 * self.least], [r for r in rows if len(r) >= 2 * self.least]
            if not now:
                break
            whole = sum(map(len, rows)) == len(g)
            for i, r in enumerate(rows):
                place[r] = i * cells
            mine = slice(None) if whole else np.sort(np.concatenate(rows))
            p, mg, mh = place[mine], g[mine], h[mine]
            at = [c[mine] + p for c in columns]
            size = len(now) * cells
            shape = (len(columns), len(now), cells)
            n = np.cumsum(np.concatenate([np.bincount(x, minlength=size) for x in at]).reshape(shape), axis=2)
            sg, sh = (np.cumsum(np.concatenate([np.bincount(x, v, size) for x in at]).reshape(shape), axis=2) for v in (mg, mh))
            below = []
            for i, (k, r) in enumerate(zip(now, rows)):
                total_g, total_h = g[r].sum(), h[r].sum()
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = sg[:, i] ** 2 / (sh[:, i] + self.l2) + (total_g - sg[:, i]) ** 2 / (total_h - sh[:, i] + self.l2 + 1e-12) - total_g**2 / (total_h + self.l2)
                gain[(n[:, i] < self.least) | (len(r) - n[:, i] < self.least)] = -1
                j, cut = divmod(int(gain.argmax()), cells)
                if gain[j, cut] > 1e-9:
                    splits[k] = (j, cut)
                    node[r] = 2 * k + (columns[j][r] > cut)
                    below += [2 * k, 2 * k + 1]
            now = below
        leaves, step = {}, np.empty(len(g))
        for k in np.flatnonzero(np.bincount(node)).tolist():
            r = np.flatnonzero(node == k)
            leaves[k] = self.rate * g[r].sum() / (h[r].sum() + self.l2)
            step[r] = leaves[k]
        return {"splits": splits, "leaves": leaves}, step

    def _leaf(self, tree: dict, code: np.ndarray) -> np.ndarray:
        node = np.ones(len(code), np.int64)
        for k in sorted(tree["splits"]):
            j, cut = tree["splits"][k]
            rows = node == k
            node[rows] = 2 * k + (code[rows, j] > cut)
        out = np.zeros(len(code))
        for k, v in tree["leaves"].items():
            out[node == k] = v
        return out

    def predict(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Probabilities after the first `rounds` rounds (all if None): fewer rounds are a model's first trees."""
        code = self._code(x)
        return sigmoid(self.base + sum(self._leaf(t, code) for t in self.trees[:rounds]))


def make_model(kind: str, signals: int, setting: dict) -> Linear | Spline | Boosting:
    if kind == "linear":
        return Linear(setting.get("c", 1.0), setting.get("balanced", False))
    if kind == "spline":
        return Spline(signals, setting.get("knots", 4), setting.get("c", 1.0)) if signals else Linear(setting.get("c", 1.0))
    if kind == "boosting":
        return Boosting(**setting)
    raise ValueError(f"unknown model {kind}")


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising values at the distinct sorted probabilities; equal ones count as one."""
    xs, of, count = np.unique(p, return_inverse=True, return_counts=True)
    value, weight, size = [], [], []
    for v, n in zip(np.bincount(of, y) / count, count):
        value.append(float(v)), weight.append(float(n)), size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v2, w2, s2 = value.pop(), weight.pop(), size.pop()
            value[-1] = (value[-1] * weight[-1] + v2 * w2) / (weight[-1] + w2)
            weight[-1] += w2
            size[-1] += s2
    return xs, np.repeat(value, size)


def calibrate(method: str, p: np.ndarray, y: np.ndarray):
    """A map from raw to calibrated probabilities."""
    if method == "none":
        return lambda q: q
    if method == "sigmoid":
        b = fit_logistic(logit(p)[:, None], y, 1e6)
        return lambda q: sigmoid(b[0] + b[1] * logit(q))
    xs, ys = isotonic(p, y)
    return lambda q: np.clip(np.interp(q, xs, ys), 1e-9, 1 - 1e-9)


def matched_tasks(rows: DataFrame, tasks: DataFrame, keys: list[str], base: list[str], signal: list[str], crossed: list[str], horizon: str = "horizon", least_train: int = 120, least_test: int = 20) -> DataFrame:
    """(keys, pipeline_id, method, ts, probabilities, ...) of the test rows of every task.

    tasks: some of the keys, model, setting, pipeline_id, rows (of the training window; NULL for all),
    regime_conditioned (adds the crossed columns), method. A group is one fold and model setting, boosting
    of any number of rounds being one; its windows, conditionings and methods share the fits whose rows
    and columns are the same, and settings of fewer rounds are the first trees of the longest.
    Both models see the same rows; a task with too few of them gives none.
    """
    types, on = dict(rows.dtypes), [k for k in keys if k in tasks.columns]
    shared = F.when(F.col("model") == "boosting", F.regexp_replace("setting", "-i[0-9]+", "")).otherwise(F.col("setting"))
    packed = tasks.withColumn("shared", shared).groupBy(*on, "model", "shared").agg(F.to_json(F.sort_array(F.collect_set(F.struct("pipeline_id", "method", "rows", "regime_conditioned", "setting")))).alias("variants"))
    facts = ["target_up", "future_return"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, gap, variants = pdf["model"].iloc[0], int(pdf[horizon].iloc[0]), json.loads(pdf["variants"].iloc[0])
        settings = [parse_setting(kind, v["setting"]) for v in variants]
        setting = max(settings, key=lambda s: s.get("rounds", 0))
        pdf = pdf.replace([np.inf, -np.inf], np.nan).dropna(subset=[*base, *signal, *crossed, *facts]).sort_values("ts")
        whole, test, fits, out = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"], {}, []

        def fitted(n_fit: int, size: int, extra: tuple) -> Linear | Spline | Boosting:
            """The model on the first n_fit of the last `size` training rows."""
            key = (n_fit, size, extra)
            if key not in fits:
                part = whole.iloc[len(whole) - size :].iloc[:n_fit]
                fits[key] = make_model(kind, len(extra), setting).fit(part[[*base, *extra]].to_numpy(float), part["target_up"].to_numpy(float))
            return fits[key]

        for v, own in zip(variants, settings):
            size = min(len(whole), v.get("rows") or len(whole))
            train = whole.iloc[len(whole) - size :]
            held = 0 if v["method"] == "none" else max(60, int(0.2 * size))
            n_fit = size - held - gap if held else size
            fit, late = train["target_up"].iloc[: max(n_fit, 0)], train.iloc[size - held :] if held else train.iloc[:0]
            if n_fit < least_train or len(test) < least_test or fit.nunique() < 2 or (held and late["target_up"].nunique() < 2):
                continue
            p = {}
            for name, extra in (("benchmark", ()), ("candidate", (*signal, *(crossed if v["regime_conditioned"] else ())))):
                model, cols = fitted(n_fit, size, extra), [*base, *extra]
                until = (own["rounds"],) if kind == "boosting" else ()
                fix = calibrate(v["method"], model.predict(late[cols].to_numpy(float), *until), late["target_up"].to_numpy(float)) if held else (lambda q: q)
                p[f"{name}_probability"] = np.clip(fix(model.predict(test[cols].to_numpy(float), *until)), 1e-9, 1 - 1e-9)
            out.append(pd.DataFrame({**{k: test[k] for k in keys}, "pipeline_id": v["pipeline_id"], "method": v["method"], "ts": test["ts"], **{c: test[c] for c in facts}, **p}))
        if out:
            return pd.concat(out)
        none = pdf.iloc[:0]
        return pd.DataFrame({**{k: none[k] for k in keys}, "pipeline_id": np.zeros(0, object), "method": np.zeros(0, object), **{c: none[c] for c in ["ts", *facts]}, "benchmark_probability": np.zeros(0), "candidate_probability": np.zeros(0)})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", pipeline_id string, method string, ts {types['ts']}, target_up int, future_return double, benchmark_probability double, candidate_probability double"
    wanted = list(dict.fromkeys([*keys, horizon, "ts", "part", *base, *signal, *crossed, *facts]))
    joined = rows.where(F.col("part").isin("train", "test")).select(*wanted)
    joined = joined.join(F.broadcast(packed), on) if on else joined.crossJoin(F.broadcast(packed))
    return joined.groupBy(*keys, "model", "shared").applyInPandas(one, schema)


def parse_setting(kind: str, text: str) -> dict:
    """A structure's setting as model arguments; trees grow by levels, so 7 leaves are depth 3 and 15 depth 4."""
    part = {p[0]: float(p[1:]) for p in text.split("-")}
    if kind == "boosting":
        return {"depth": int(np.ceil(np.log2(part["l"]))), "rounds": int(part["i"]), "l2": part["r"], "least": 100}
    return {"c": part["c"], **({"knots": int(part["k"])} if "k" in part else {})}
