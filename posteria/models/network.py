"""Small numpy kernel of the networks: forward pass, gradients, one Adam step.

Everything around it - data movement, averaging, early stopping, scoring - is
Spark work in ``training`` and ``scoring``.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np

from posteria.functions.addressed import MaskMaker, normals

SIGMA_FLOOR = 1e-4  # fixed value: smallest predicted sigma
RAW_SLOPE = 0.05  # fixed value: sigma = floor + softplus(slope * raw)


@dataclass(frozen=True)
class NetConfig:
    """``kind`` is dropout, gaussian, deterministic or variational."""

    kind: str = "dropout"
    hidden: tuple[int, ...] = (500, 1000, 700, 300)
    dropout: tuple[float, ...] = (0.2, 0.2, 0.2, 0.2)
    input_dropout: float = 0.1
    loss: str = "mse"
    epochs: int = 5000
    batch_size: int = 128
    learning_rate: float = 1e-4
    final_learning_rate: float = 1e-7
    step_decay: int = 30
    patience: int = 300
    min_delta: float = 1e-6
    valid_fraction: float = 0.3
    replicas: int | None = None  # None: one per core
    local_steps: bool = True
    seed: int = 42

    def __post_init__(self):
        if self.kind not in ("dropout", "gaussian", "deterministic", "variational"):
            raise ValueError(f"unknown network kind {self.kind!r}")
        if self.loss not in (*LOSSES, "nll"):
            raise ValueError(f"unknown loss {self.loss!r}")
        if self.loss == "nll" and self.kind == "deterministic":
            raise ValueError("nll needs a network with a predicted sigma")

    @property
    def has_sigma(self) -> bool:
        return self.kind != "deterministic"

    @property
    def rates(self) -> list[float]:
        """Dropout before every dense layer, the input first."""
        if self.kind != "dropout":
            return [0.0] * (len(self.hidden) + 1)
        return [self.input_dropout, *self.dropout[: len(self.hidden)]]

    def as_dict(self) -> dict:
        return asdict(self)


# --- losses: value and derivative by prediction ------------------------------------


def _mape(y, p):
    scale = np.maximum(np.abs(y), 1e-7)
    return 100 * np.abs(p - y) / scale, 100 * np.sign(p - y) / scale


def _msle(y, p):
    q, r = np.maximum(p, 1e-7), np.maximum(y, 1e-7)
    gap = np.log1p(q) - np.log1p(r)
    return gap**2, np.where(p > 1e-7, 2 * gap / (1 + q), 0.0)


def _huber(y, p):
    d = p - y
    small = np.abs(d) <= 1
    return np.where(small, 0.5 * d * d, np.abs(d) - 0.5), np.where(small, d, np.sign(d))


def _log_cosh(y, p):
    d = p - y
    return np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) - math.log(2), np.tanh(d)


LOSSES = {
    "mse": lambda y, p: ((p - y) ** 2, 2 * (p - y)),
    "mae": lambda y, p: (np.abs(p - y), np.sign(p - y)),
    "mape": _mape,
    "msle": _msle,
    "huber": _huber,
    "log_cosh": _log_cosh,
}


def softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


# --- parameters ----------------------------------------------------------------------


def init_params(n_in: int, n_out: int, cfg: NetConfig) -> list[np.ndarray]:
    """Weights layer by layer: [W, b] or, variational, [W, W_rho, b, b_rho]."""
    rng = np.random.Generator(np.random.Philox(key=cfg.seed))
    widths = [n_in, *cfg.hidden, n_out * (2 if cfg.has_sigma else 1)]
    params = []
    for a, b in zip(widths, widths[1:]):
        if cfg.kind == "variational":
            params += [rng.normal(0, 0.1, (a, b)), rng.normal(-3, 0.1, (a, b)), rng.normal(0, 0.1, b), rng.normal(-3, 0.1, b)]
        else:
            edge = math.sqrt(6 / (a + b))
            params += [rng.uniform(-edge, edge, (a, b)), np.zeros(b)]
    return params


def layers(params: list[np.ndarray], cfg: NetConfig) -> list[list[np.ndarray]]:
    step = 4 if cfg.kind == "variational" else 2
    return [params[i : i + step] for i in range(0, len(params), step)]


def split_head(out: np.ndarray, cfg: NetConfig):
    """(loc, sigma, raw); sigma and raw are None without a predicted sigma."""
    if not cfg.has_sigma:
        return out, None, None
    k = out.shape[-1] // 2
    raw = out[..., k:]
    return out[..., :k], SIGMA_FLOOR + softplus(RAW_SLOPE * raw), raw


def gradients(params, x, y, cfg: NetConfig, rng, n_instances: float):
    """Mean loss of a batch and its gradient for every parameter."""
    n = len(x)
    stack = layers(params, cfg)
    trail = []
    h = x
    for i, (layer, rate) in enumerate(zip(stack, cfg.rates)):
        mask = (rng.random(h.shape) >= rate) / (1 - rate) if rate > 0 else None
        h = h if mask is None else h * mask
        if cfg.kind == "variational":
            w, w_rho, b, b_rho = layer
            eps, eps_b = rng.standard_normal(w.shape), rng.standard_normal(b.shape)
            s = rng.choice((-1.0, 1.0), h.shape)
            r = rng.choice((-1.0, 1.0), (n, w.shape[1]))
            noise = softplus(w_rho) * eps
            z = h @ w + ((h * s) @ noise) * r + b + softplus(b_rho) * eps_b
            trail.append((h, z, mask, s, r, eps, eps_b, noise))
        else:
            z = h @ layer[0] + layer[1]
            trail.append((h, z, mask))
        h = np.maximum(z, 0) if i < len(stack) - 1 else z

    loc, sigma, raw = split_head(h, cfg)
    size = y.size
    if cfg.loss == "nll":
        gap = y - loc
        loss = (0.5 * (gap / sigma) ** 2 + np.log(sigma) + 0.5 * math.log(2 * math.pi)).sum() / size
        d_loc, d_sigma = -gap / sigma**2 / size, (1 / sigma - gap**2 / sigma**3) / size
    else:
        # the network's output is a sample of its Normal, or loc itself
        eps = rng.standard_normal(loc.shape) if sigma is not None else 0.0
        value, slope = LOSSES[cfg.loss](y, loc + (sigma * eps if sigma is not None else 0.0))
        loss, d_loc = value.sum() / size, slope / size
        d_sigma = d_loc * eps
    d = d_loc if sigma is None else np.concatenate([d_loc, d_sigma * RAW_SLOPE * sigmoid(RAW_SLOPE * raw)], axis=1)

    grads = []
    for i in range(len(stack) - 1, -1, -1):
        h, z, mask = trail[i][:3]
        if i < len(stack) - 1:
            d = d * (z > 0)
        if cfg.kind == "variational":
            s, r, eps, eps_b, noise = trail[i][3:]
            w, w_rho, b, b_rho = stack[i]
            sw, sb = softplus(w_rho), softplus(b_rho)
            d_noise = (h * s).T @ (d * r) * eps
            pull = lambda mu, sig: (mu / n_instances, (sig - 1 / sig) / n_instances)  # KL to N(0, 1)
            kl_w, kl_ws = pull(w, sw)
            kl_b, kl_bs = pull(b, sb)
            layer_grads = [
                h.T @ d + kl_w,
                (d_noise + kl_ws) * sigmoid(w_rho),
                d.sum(0) + kl_b,
                (d.sum(0) * eps_b + kl_bs) * sigmoid(b_rho),
            ]
            loss += sum((0.5 * (m * m + v * v - 1) - np.log(v)).sum() for m, v in ((w, sw), (b, sb))) / n_instances
            back = d @ w.T + ((d * r) @ noise.T) * s
        else:
            layer_grads = [h.T @ d, d.sum(0)]
            back = d @ stack[i][0].T
        grads = layer_grads + grads
        d = back if mask is None else back * mask
    return loss, grads


def adam_step(params, grads, m, v, step: int, rate: float):
    """In-place Adam update; returns the next step number."""
    step += 1
    for p, g, a, b in zip(params, grads, m, v):
        a *= 0.9
        a += 0.1 * g
        b *= 0.999
        b += 0.001 * g * g
        p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return step


def decayed(rate: float, epoch: int, cfg: NetConfig) -> float:
    """Halve every ``step_decay`` epochs, to two significant digits, with a floor."""
    if cfg.step_decay and (epoch + 1) % cfg.step_decay == 0:
        half = rate / 2
        rate = float(f"{half:.1e}")
    return max(cfg.final_learning_rate, rate)


# --- posterior draws -------------------------------------------------------------------


NOISE, HEAD = 254, 255  # layers of the addresses of input noise and of the output's sample
CUBE_NUMBERS = 4_000_000  # of the widest layer of a block
CACHE_NUMBERS = 300_000  # of the widest layer of objects that go through the layers together


def block_draws(params, x: np.ndarray, cfg: NetConfig, n_iter: int, seeds: np.ndarray, errors: np.ndarray | None = None) -> np.ndarray:
    """Draws (objects, n_iter, targets) of a block of objects, one product for each layer."""
    if cfg.kind == "variational":
        noise = errors if errors is not None else [None] * len(x)
        return np.stack([object_draws(params, v, cfg, n_iter, int(s), e) for v, s, e in zip(x, seeds, noise)])
    stack = layers(params, cfg)
    widths = [x.shape[1], *[layer[0].shape[1] for layer in stack]]
    few = max(1, CACHE_NUMBERS // (max(1, n_iter) * max(widths)))  # objects that go through the layers together
    factors = [MaskMaker(n_iter, i, w, rate) if rate > 0 else None for i, (w, rate) in enumerate(zip(widths, cfg.rates))]
    room = [np.empty(min(few, len(x)) * n_iter * w) for w in widths]  # used again by all of them
    out = np.empty((len(x), n_iter, widths[-1] // (2 if cfg.has_sigma else 1)))
    for at in range(0, len(x), few):
        some = slice(at, min(at + few, len(x)))
        n = some.stop - at
        values = [v[: n * n_iter * w].reshape(n, n_iter, w) for v, w in zip(room, widths)]
        h = values[0]
        h[:] = x[some, None, :]
        if errors is not None:
            h += normals(seeds[some], n_iter, NOISE, x.shape[1]) * errors[some, None, :]
        for i, (layer, made) in enumerate(zip(stack, factors)):
            if made is not None:
                h *= made(seeds[some])
            np.matmul(h.reshape(n * n_iter, widths[i]), layer[0], out=values[i + 1].reshape(n * n_iter, widths[i + 1]))
            h = values[i + 1]
            h += layer[1]
            if i < len(stack) - 1:
                np.maximum(h, 0, out=h)
        loc, sigma, _ = split_head(h, cfg)
        out[some] = loc if sigma is None else loc + sigma * normals(seeds[some], n_iter, HEAD, loc.shape[2])
    return out


def block_rows(params, n_iter: int) -> int:
    """Objects whose widest layer fits ``CUBE_NUMBERS``."""
    return max(1, CUBE_NUMBERS // (max(1, n_iter) * max(w.shape[-1] for w in params)))


def object_draws(params, x: np.ndarray, cfg: NetConfig, n_iter: int, seed: int, errors=None) -> np.ndarray:
    """Draws (n_iter, targets) of one object of a variational net, reproducible from its seed alone."""
    rng = np.random.Generator(np.random.Philox(key=seed & 0xFFFFFFFFFFFFFFFF))
    h = np.repeat(x[None], n_iter, axis=0)
    if errors is not None:
        h = h + rng.standard_normal(h.shape) * errors[None]
    stack = layers(params, cfg)
    for i, (layer, rate) in enumerate(zip(stack, cfg.rates)):
        if rate > 0:
            h = h * ((rng.random(h.shape, dtype=np.float32) >= rate) / (1 - rate))
        if cfg.kind == "variational":
            w, w_rho, b, b_rho = layer
            # one weight noise for all draws, decorrelated by random signs
            noise = softplus(w_rho) * rng.standard_normal(w.shape)
            s = rng.choice((-1.0, 1.0), h.shape)
            r = rng.choice((-1.0, 1.0), (n_iter, w.shape[1]))
            h = h @ w + ((h * s) @ noise) * r + b + softplus(b_rho) * rng.standard_normal((n_iter, len(b)))
        else:
            h = h @ layer[0] + layer[1]
        if i < len(stack) - 1:
            h = np.maximum(h, 0)
    loc, sigma, _ = split_head(h, cfg)
    return loc if sigma is None else loc + sigma * rng.standard_normal(loc.shape)


def point_prediction(params, x: np.ndarray, cfg: NetConfig) -> np.ndarray:
    """Noise-free output of a block of rows: loc, without dropout or sampling."""
    h = x
    stack = layers(params, cfg)
    for i, layer in enumerate(stack):
        h = h @ layer[0] + layer[2 if cfg.kind == "variational" else 1]
        if i < len(stack) - 1:
            h = np.maximum(h, 0)
    return split_head(h, cfg)[0]
