"""Any-order autoregressive density models over dictionary codes, in numpy.

A model sees one row of codes a sample, 0 where a column is unknown, and gives a distribution for every column. It is
trained by hiding a random set of columns and predicting them. Networks are a multilayer perceptron and a small
transformer encoder; embeddings are tied to the output layer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Array = np.ndarray
Params = dict[str, Array]


def relu(x: Array) -> tuple[Array, Array]:
    """Value and derivative."""
    return np.maximum(x, 0), (x > 0).astype(x.dtype)


def gelu(x: Array) -> tuple[Array, Array]:
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)


ACTIVATIONS: dict[str, Callable[[Array], tuple[Array, Array]]] = {"relu": relu, "gelu": gelu}


def softmax(z: Array) -> Array:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Config:
    domains: list[int]  # codes a column, 0 for unknown included
    kind: str = "mlp"  # or "trm"
    d_word: int = 32
    d_ff: int = 64
    n_ff: int = 2  # hidden layers of the perceptron
    n_blocks: int = 2
    n_heads: int = 4
    act: str = "relu"
    lr: float | None = 2e-3
    warmups: int | None = None
    epochs: int = 3
    batch: int = 1024
    seed: int = 1234
    continuous: list[int] = field(default_factory=list)  # columns that hold a number above 0, such as the log of a fanout; 0 is unknown

    def __post_init__(self) -> None:
        if (self.lr is None) == (self.warmups is None):
            raise ValueError("give either a rate or warm-up steps")
        if self.kind not in ("mlp", "trm") or self.act not in ACTIVATIONS:
            raise ValueError("unknown kind of model or activation")
        if self.kind == "trm" and self.d_word % self.n_heads:
            raise ValueError("the heads must divide the word")


@dataclass
class Model:
    config: Config
    params: Params = field(default_factory=dict)

    @classmethod
    def new(cls, config: Config) -> Model:
        rng = np.random.default_rng(config.seed)
        p: Params = {}
        d, n = config.d_word, len(config.domains)

        def linear(name: str, a: int, b: int) -> None:
            p[f"{name}.w"] = rng.normal(0, np.sqrt(2 / (a + b)), (a, b)).astype(np.float32)
            p[f"{name}.b"] = np.zeros(b, np.float32)

        for i, size in enumerate(config.domains):
            if i in config.continuous:
                p[f"num{i}"], p[f"dec{i}"] = (rng.normal(0, 0.02, (2, d)).astype(np.float32), rng.normal(0, 0.02, d).astype(np.float32))
                p[f"bias{i}"] = np.zeros(1, np.float32)
                continue
            p[f"emb{i}"] = rng.normal(0, 0.02, (size, d)).astype(np.float32)
            p[f"emb{i}"][0] = 0  # unknown
            p[f"bias{i}"] = np.zeros(size, np.float32)
        if config.kind == "mlp":
            sizes = [n * d, *[config.d_ff] * (config.n_ff + 1), n * d]
            for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
                linear(f"l{k}", a, b)
        else:
            p["place"] = rng.normal(0, 0.02, (n, d)).astype(np.float32)
            for k in range(config.n_blocks):
                for m in ("q", "k", "v", "o"):
                    linear(f"{k}.{m}", d, d)
                linear(f"{k}.f0", d, config.d_ff)
                linear(f"{k}.f1", config.d_ff, d)
                for m in ("n0", "n1"):
                    p[f"{k}.{m}.g"], p[f"{k}.{m}.b"] = np.ones(d, np.float32), np.zeros(d, np.float32)
            p["n.g"], p["n.b"] = np.ones(d, np.float32), np.zeros(d, np.float32)
        return cls(config, p)

    # ---- networks: each returns the output and a function from its gradient to the input's -----------------------

    @staticmethod
    def _number(x: Array) -> Array:
        """A continuous column's input: whether it is known, and its value."""
        return np.stack([x != 0, x], 1).astype(np.float32)

    def _embed(self, codes: Array) -> Array:
        numbers = set(self.config.continuous)
        return np.stack([
            self._number(codes[:, i]) @ self.params[f"num{i}"] if i in numbers else self.params[f"emb{i}"][codes[:, i].astype(np.int64)] for i in range(codes.shape[1])
        ], 1)

    def _network(self, codes: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        x = self._embed(codes)
        return self._mlp(x) if self.config.kind == "mlp" else self._transformer(x)

    def _linear(self, name: str, x: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        w = self.params[f"{name}.w"]

        def back(g: Array, grads: Params) -> Array:
            flat, fg = x.reshape(-1, x.shape[-1]), g.reshape(-1, g.shape[-1])
            grads[f"{name}.w"] = flat.T @ fg
            grads[f"{name}.b"] = fg.sum(0)
            return g @ w.T

        return x @ w + self.params[f"{name}.b"], back

    def _norm(self, name: str, x: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        mean, std = x.mean(-1, keepdims=True), np.sqrt(x.var(-1, keepdims=True) + 1e-5)
        y = (x - mean) / std
        gain = self.params[f"{name}.g"]

        def back(g: Array, grads: Params) -> Array:
            axes = tuple(range(g.ndim - 1))
            grads[f"{name}.g"], grads[f"{name}.b"] = (g * y).sum(axes), g.sum(axes)
            h = g * gain
            return (h - h.mean(-1, keepdims=True) - y * (h * y).mean(-1, keepdims=True)) / std

        return y * gain + self.params[f"{name}.b"], back

    def _mlp(self, x: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        act = ACTIVATIONS[self.config.act]
        h, backs = x.reshape(len(x), -1), []
        layers = self.config.n_ff + 2
        for k in range(layers):
            h, back = self._linear(f"l{k}", h)
            slope = None
            if k < layers - 1:
                h, slope = act(h)
            backs.append((back, slope))

        def back_all(g: Array, grads: Params) -> Array:
            g = g.reshape(len(g), -1)
            for back, slope in reversed(backs):
                g = back(g if slope is None else g * slope, grads)
            return g.reshape(x.shape)

        return h.reshape(x.shape), back_all

    def _attention(self, name: str, x: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        b, n, d = x.shape
        heads = self.config.n_heads
        (q, bq), (k, bk), (v, bv) = (self._linear(f"{name}.{m}", x) for m in "qkv")

        def split(y: Array) -> Array:
            return y.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3)

        def merge(y: Array) -> Array:
            return y.transpose(0, 2, 1, 3).reshape(b, n, d)

        qs, ks, vs = split(q), split(k), split(v)
        scale = 1 / np.sqrt(d // heads)
        a = softmax(qs @ ks.transpose(0, 1, 3, 2) * scale)
        out, bo = self._linear(f"{name}.o", merge(a @ vs))

        def back(g: Array, grads: Params) -> Array:
            gm = split(bo(g, grads))
            ga = gm @ vs.transpose(0, 1, 3, 2)
            gz = a * (ga - (ga * a).sum(-1, keepdims=True)) * scale
            return bq(merge(gz @ ks), grads) + bk(merge(gz.transpose(0, 1, 3, 2) @ qs), grads) + bv(merge(a.transpose(0, 1, 3, 2) @ gm), grads)

        return out, back

    def _transformer(self, x: Array) -> tuple[Array, Callable[[Array, Params], Array]]:
        act = ACTIVATIONS[self.config.act]
        h = x + self.params["place"]
        backs = []
        for k in range(self.config.n_blocks):
            y, b0 = self._norm(f"{k}.n0", h)
            y, b1 = self._attention(str(k), y)
            h = h + y
            y, b2 = self._norm(f"{k}.n1", h)
            y, b3 = self._linear(f"{k}.f0", y)
            y, slope = act(y)
            y, b4 = self._linear(f"{k}.f1", y)
            h = h + y
            backs.append((b0, b1, b2, b3, slope, b4))
        out, last = self._norm("n", h)

        def back_all(g: Array, grads: Params) -> Array:
            g = last(g, grads)
            for b0, b1, b2, b3, slope, b4 in reversed(backs):
                g = g + b2(b3(b4(g, grads) * slope, grads), grads)
                g = g + b0(b1(g, grads), grads)
            grads["place"] = g.sum(0)
            return g

        return out, back_all

    # ---- use ------------------------------------------------------------------------------------------------------

    def predict(self, codes: Array, column: int) -> Array:
        """Distribution of a column given each row's known codes; unknown itself has no mass, the rest sums to 1."""
        out, _ = self._network(codes)
        z = out[:, column] @ self.params[f"emb{column}"].T + self.params[f"bias{column}"]
        z[:, 0] = -np.inf
        return softmax(z)

    def number(self, codes: Array, column: int) -> Array:
        """Expected value of a continuous column given each row's known codes."""
        out, _ = self._network(codes)
        return out[:, column] @ self.params[f"dec{column}"] + self.params[f"bias{column}"][0]

    def loss(self, codes: Array, hidden: Array) -> tuple[float, Params]:
        """Mean cross-entropy of the hidden columns, or squared error of continuous ones, and its gradients."""
        seen = np.where(hidden, 0, codes)
        out, back = self._network(seen)
        grads: Params = {}
        g = np.zeros_like(out)
        total, count = 0.0, max(1, int(hidden.sum()))
        for i in range(codes.shape[1]):
            rows = np.flatnonzero(hidden[:, i])
            if i in self.config.continuous:
                w = self.params[f"dec{i}"]
                off = out[rows, i] @ w + self.params[f"bias{i}"][0] - codes[rows, i]
                total += float((off**2).sum())
                slope = (2 * off / count).astype(np.float32)
                g[rows, i] = slope[:, None] * w
                grads[f"dec{i}"], grads[f"bias{i}"] = slope @ out[rows, i], np.array([slope.sum()], np.float32)
                continue
            e = self.params[f"emb{i}"]
            if not len(rows):
                grads[f"emb{i}"], grads[f"bias{i}"] = np.zeros_like(e), np.zeros(len(e), np.float32)
                continue
            z = out[rows, i] @ e.T + self.params[f"bias{i}"]
            z[:, 0] = -1e9
            p = softmax(z)
            at = codes[rows, i].astype(np.int64)
            total -= float(np.log(np.maximum(p[np.arange(len(rows)), at], 1e-12)).sum())
            p[np.arange(len(rows)), at] -= 1
            p /= count
            g[rows, i] = p @ e
            grads[f"emb{i}"], grads[f"bias{i}"] = p.T @ out[rows, i], p.sum(0)
        gx = back(g, grads)
        for i in range(codes.shape[1]):
            if i in self.config.continuous:
                grads[f"num{i}"] = self._number(seen[:, i]).T @ gx[:, i]
                continue
            np.add.at(grads[f"emb{i}"], seen[:, i].astype(np.int64), gx[:, i])
            grads[f"emb{i}"][0] = 0
        return total / count, grads


def masks(rng: np.random.Generator, rows: int, columns: int) -> Array:
    """1 to columns - 1 random columns hidden in each row; the only column, where there is one."""
    if columns == 1:
        return np.ones((rows, 1), bool)
    k = rng.integers(1, columns, rows)
    return rng.random((rows, columns)).argsort(1).argsort(1) < k[:, None]


def split(codes: Array, seed: int) -> tuple[Array, Array]:
    """Rows to train on, and a tenth (10,000 at most, none of fewer than 10 rows) to validate on."""
    order = np.random.default_rng(seed).permutation(len(codes))
    n = min(len(codes) // 10, 10_000)
    return codes[order[n:]], codes[order[:n]]


def rate(config: Config, step: int) -> float:
    if config.lr is not None:
        return config.lr
    return config.d_word**-0.5 * min(step**-0.5, step * config.warmups**-1.5)


def train(codes: Array, config: Config, each: Callable[[int, Model, float], None] | None = None) -> tuple[Model, list[float]]:
    """A model and its validation loss after each epoch, by Adam. No rows give the untrained model. each: is told of every epoch."""
    model = Model.new(config)
    rows, held = split(np.asarray(codes, np.float64 if config.continuous else np.int64), config.seed)
    rng = np.random.default_rng(config.seed + 1)
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v = {k: np.zeros_like(x) for k, x in model.params.items()}
    step, history = 0, []
    for _ in range(config.epochs if len(rows) else 0):
        for lo in range(0, len(rows), config.batch):
            part = rows[lo : lo + config.batch]
            _, grads = model.loss(part, masks(rng, *part.shape))
            step += 1
            lr = rate(config, step)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.params[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        history.append(validate(model, held, config) if len(held) else float("nan"))
        if each:
            each(len(history), model, history[-1])
    return model, history


def validate(model: Model, held: Array, config: Config) -> float:
    """Mean loss over batches, weighted by their rows, under masks that are the same every time."""
    rng = np.random.default_rng(config.seed + 2)
    if not len(held):
        return float("nan")
    losses = [(model.loss(part, masks(rng, *part.shape))[0], len(part)) for part in (held[lo : lo + config.batch] for lo in range(0, len(held), config.batch))]
    return sum(a * n for a, n in losses) / sum(n for _, n in losses)


def search(codes: Array, configs: list[Config], reduction: int = 2) -> tuple[Model, Config, float]:
    """The best of several configurations by successive halving: each round the better half trains twice as long."""
    from dataclasses import replace

    left, epochs = list(configs), max(1, min(c.epochs for c in configs) // max(1, len(configs).bit_length()))
    while True:
        tried = []
        for c in left:
            model, history = train(codes, replace(c, epochs=epochs))
            tried.append((history[-1] if history and np.isfinite(history[-1]) else 0.0, len(tried), model, c))
        tried.sort(key=lambda t: t[:2])
        if len(left) == 1 or epochs >= max(c.epochs for c in configs):
            return tried[0][2], tried[0][3], tried[0][0]
        left = [t[3] for t in tried[: max(1, len(tried) // reduction)]]
        epochs *= reduction


# ---- progressive sampling --------------------------------------------------------------------------------------------


def progressive(model: Model, allowed: list[tuple[int, Array]], samples: int, rng: np.random.Generator, scales: dict[int, Array] | None = None) -> Array:
    """Monte-Carlo estimates of P(every column in ``allowed`` takes an allowed code), one a sample.

    allowed: (column, mask over its codes, or a function of the sampled codes that gives one a sample), in the order of
    conditioning. scales: for a column, a number by code that each sample's estimate is multiplied by.
    """
    codes = np.zeros((samples, len(model.config.domains)), np.float64 if model.config.continuous else np.int64)
    return walk(model, codes, allowed, rng, scales)


def walk(model: Model, codes: Array, allowed: list[tuple[int, Array]], rng: np.random.Generator, scales: dict[int, Array] | None = None) -> Array:
    """``progressive`` from samples whose known columns are set already; fills in the columns it conditions on. A continuous
    column (its mask is None) takes its expected value."""
    samples = len(codes)
    p = np.ones(samples)
    for column, mask in allowed:
        if column in model.config.continuous:
            codes[:, column] = np.maximum(model.number(codes, column), 1e-6)
            continue
        ok = mask(codes) if callable(mask) else np.broadcast_to(mask, (samples, len(mask)))
        dist = model.predict(codes, column) * ok
        mass = dist.sum(1)
        p *= mass
        empty = mass <= 0
        dist[empty] = np.where(ok[empty].any(1, keepdims=True), ok[empty], 1.0)
        running = np.cumsum(dist, 1)
        drawn = (running < (rng.random(samples) * running[:, -1])[:, None]).sum(1)
        codes[:, column] = np.minimum(drawn, dist.shape[1] - 1)
        if scales and column in scales:
            p *= scales[column][codes[:, column].astype(np.int64)]
    return p
