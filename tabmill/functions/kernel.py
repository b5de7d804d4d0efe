"""Numpy forward pass of the in-context model, for one table or a slice of its query rows."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np

EPSILON = 1e-8


#: Numerators and denominators of erf's rational approximations (Sun's fdlibm), lowest power first: up to 0.84375, 1.25, 1 / 0.35, beyond.
ERF = (
    ((1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05),
     (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)),
    ((-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03),
     (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)),
    ((-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00),
     (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02)),
    ((-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02),
     (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01)),
)


def _ratio(k: int, v: np.ndarray) -> np.ndarray:
    def value(powers: tuple[float, ...]) -> np.ndarray:
        out = np.full_like(v, powers[-1])
        for p in powers[-2::-1]:
            out *= v
            out += p
        return out

    return value(ERF[k][0]) / value(ERF[k][1])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1e-15, each number by the one approximation that it needs; NaN stays NaN."""
    v = np.asarray(x, float).ravel()
    a = np.abs(v)
    out = np.sign(v)  # beyond 6 there is nothing else
    near = np.flatnonzero(a < 0.84375)
    t = v[near]
    out[near] = t + t * _ratio(0, t * t)
    for k, lo, hi in ((1, 0.84375, 1.25), (2, 1.25, 1 / 0.35), (3, 1 / 0.35, 6.0)):
        at = np.flatnonzero((a >= lo) & (a < hi))
        if len(at):
            t = a[at]
            value = 8.45062911510467529297e-01 + _ratio(1, t - 1) if k == 1 else 1 - np.exp(-t * t - 0.5625 + _ratio(k, 1 / (t * t))) / t
            out[at] = np.copysign(value, v[at])
    return out.reshape(np.shape(x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2.0)))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def weighted_labels(context: np.ndarray, values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Single-head attention without projections: for each query the mean of the context's values, weighted by softmax of
    products over the root of the width."""
    return softmax(queries @ context.T / np.sqrt(context.shape[1])) @ values


def monomials(v: np.ndarray, degree: int) -> np.ndarray:
    """(terms, rows): all products of powers of v's columns up to a total degree, in the order of inverse_factorials()."""
    n, width = v.shape
    columns, out = np.ascontiguousarray(v.T), np.empty((math.comb(width + degree, degree), n))
    out[0], starts, end = 1.0, [0] * width, 1  # where those of the last degree begin, by their first column, and end
    for _ in range(degree):
        last, to = [], end
        for k in range(width):
            last.append(to)
            to += end - starts[k]
            np.multiply(out[starts[k] : end], columns[k], out=out[last[k] : to])
        starts, end = last, to
    return out


@functools.cache
def inverse_factorials(width: int, degree: int) -> np.ndarray:
    """(terms, 1): of each product of powers the inverse of its powers' factorials, so that the sum over terms of
    monomials(u) * monomials(v) * these is exp(u . v) cut at the degree; for |u . v| <= 1 and degree 16 within 1e-14 of it."""
    kinds = (c for g in range(degree + 1) for c in itertools.combinations_with_replacement(range(width), g))
    return np.array([[1 / math.prod(math.factorial(c.count(k)) for k in set(c))] for c in kinds])


def context_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the context's features; with a single row the deviation is NaN, as a sample's is."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x.mean(0), x.std(0, ddof=1) if len(x) > 1 else np.full(x.shape[1], np.nan)


def random_weights(layers: int, heads: int, width: int, hidden: int, outputs: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Named arrays of a model with these five numbers, drawn at random (stands for a trained checkpoint)."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
    w = {"architecture": np.array([layers, heads, width, hidden, outputs], float)}
    for name in ("feature", "target"):
        w |= {f"{name}.weight": draw(width, 1), f"{name}.bias": draw(width)}
    for k in range(layers):
        for part in ("columns", "rows"):
            w |= {f"{k}.{part}.in.weight": draw(3 * width, width), f"{k}.{part}.in.bias": draw(3 * width) * 0.1, f"{k}.{part}.out.weight": draw(width, width), f"{k}.{part}.out.bias": draw(width) * 0.1}
        w |= {f"{k}.mlp1.weight": draw(hidden, width), f"{k}.mlp1.bias": draw(hidden) * 0.1, f"{k}.mlp2.weight": draw(width, hidden), f"{k}.mlp2.bias": draw(width) * 0.1}
        for n in (1, 2, 3):
            w |= {f"{k}.norm{n}.weight": np.ones(width), f"{k}.norm{n}.bias": np.zeros(width)}
    return w | {"decoder1.weight": draw(hidden, width), "decoder1.bias": draw(hidden) * 0.1, "decoder2.weight": draw(outputs, hidden), "decoder2.bias": draw(outputs) * 0.1}


def _product(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """v @ w.T as one product of matrices, whatever axes v has before its last."""
    return (v.reshape(-1, v.shape[-1]) @ w.T).reshape(*v.shape[:-1], len(w))


class Forward:
    """Holds one table's context through all layers, so that query rows can be scored in any slices."""

    def __init__(self, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray):
        """x, y: the context rows."""
        self._read(weights)
        self.mean, self.std = context_scale(x)
        self.y_mean = y.mean()
        self._hold(self._scaled(x, self.mean, self.std), y)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logits of query rows; each depends on the context and its own row only."""
        return self._answer(self._scaled(x, self.mean, self.std), np.full(len(x), self.y_mean))

    @classmethod
    def many(cls, weights: dict[str, np.ndarray], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Logits of each table's query rows, of tables (context x, y, query x) of one width that go through the layers together:
        shorter ones are padded, and padded context rows have no weight."""
        f = cls.__new__(cls)
        f._read(weights)
        shape = lambda k: (len(tables), max(len(t[k]) for t in tables))
        (n, c), (_, q), width = shape(0), shape(2), tables[0][0].shape[1]
        cx, cy, qx, known, f.hidden = np.zeros((n, c, width)), np.zeros((n, c)), np.zeros((n, q, width)), np.zeros((n, q)), np.full((n, 1, 1, 1, c), -np.inf)
        for k, (x, y, rows) in enumerate(tables):
            mean, std = context_scale(x)
            cx[k, : len(x)], cy[k, : len(x)], f.hidden[k, ..., : len(x)] = f._scaled(x, mean, std), y, 0
            qx[k, : len(rows)], known[k] = f._scaled(rows, mean, std), y.mean()
        f._hold(cx, cy)
        return [out[: len(t[2])] for out, t in zip(f._answer(qx, known), tables, strict=True)]

    def _read(self, weights: dict[str, np.ndarray]) -> None:
        self.w, self.hidden = weights, None
        self.layers, self.heads, self.width = (int(v) for v in weights["architecture"][:3])

    def _hold(self, z: np.ndarray, y: np.ndarray) -> None:
        self.keys: list[np.ndarray] = []
        cells = self._cells(z, y)
        for k in range(self.layers):
            cells = self._norm(k, 1, cells + self._attend(f"{k}.columns", cells, cells))
            self.keys.append(cells)
            if k + 1 < self.layers:
                cells = self._rest(k, cells, cells)

    def _answer(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        cells = self._cells(z, y)
        for k in range(self.layers):
            cells = self._norm(k, 1, cells + self._attend(f"{k}.columns", cells, cells))
            cells = self._rest(k, cells, self.keys[k])
        return self._line("decoder2", gelu(self._line("decoder1", cells[..., -1, :])))

    def _line(self, name: str, v: np.ndarray) -> np.ndarray:
        return _product(v, self.w[f"{name}.weight"]) + self.w[f"{name}.bias"]

    def _scaled(self, x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / (std + EPSILON), -100, 100)

    def _cells(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(rows, columns, width), with tables before them if there are many: the features' embeddings, then the target's."""
        return np.concatenate([self._line("feature", z[..., None]), self._line("target", y[..., None, None])], -2)

    def _norm(self, k: int, n: int, v: np.ndarray) -> np.ndarray:
        centre = v - v.mean(-1, keepdims=True)
        return centre / np.sqrt((centre * centre).mean(-1, keepdims=True) + 1e-5) * self.w[f"{k}.norm{n}.weight"] + self.w[f"{k}.norm{n}.bias"]

    def _attend(self, name: str, q: np.ndarray, kv: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
        """Multi-head attention over the second-last axis; the axes before it are a batch. hidden is added to the products."""
        w, b, e = self.w[f"{name}.in.weight"], self.w[f"{name}.in.bias"], self.width
        split = lambda v: v.reshape(*v.shape[:-1], self.heads, e // self.heads).swapaxes(-2, -3)
        query, key, value = (split(_product(v, w[i * e : (i + 1) * e]) + b[i * e : (i + 1) * e]) for i, v in ((0, q), (1, kv), (2, kv)))
        products = query @ key.swapaxes(-1, -2) / np.sqrt(e / self.heads)
        out = softmax(products if hidden is None else products + hidden) @ value
        return self._line(f"{name}.out", out.swapaxes(-2, -3).reshape(q.shape))

    def _rest(self, k: int, cells: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Attention to the context's rows, column by column, then the two-layer network."""
        seen = self._attend(f"{k}.rows", cells.swapaxes(-3, -2), context.swapaxes(-3, -2), self.hidden).swapaxes(-3, -2)
        cells = self._norm(k, 2, cells + seen)
        return self._norm(k, 3, cells + self._line(f"{k}.mlp2", gelu(self._line(f"{k}.mlp1", cells))))
