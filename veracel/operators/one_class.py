"""One-class support vector machine and autoencoder, fitted in numpy on bounded samples and read by every task.

Both have score(x), higher for less usual rows, and arrays() and facts() for models.save."""

import numpy as np

from .models import load, save


class OneClassSvm:
    """The dual of the one-class machine with a Gaussian kernel, solved by sequential minimal optimisation.

    Minimise a'Ka / 2 for 0 <= a <= 1 and sum a = nu n.  The pair that breaks the conditions most is moved until none
    breaks them by more than `tolerance`.  gamma is 1 / (columns * variance) unless given."""

    KIND = "one-class svm"

    def __init__(self, support: np.ndarray, weights: np.ndarray, rho: float, gamma: float, low: float, high: float):
        self.support, self.weights, self.rho, self.gamma, self.low, self.high = support, weights, rho, gamma, low, high

    @staticmethod
    def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    @classmethod
    def solve(cls, k: np.ndarray, nu: float, tolerance: float = 1e-4, steps: int = 200_000) -> tuple[np.ndarray, float]:
        """a and rho for a kernel matrix."""
        n = len(k)
        total, a = nu * n, np.zeros(n)
        a[: int(total)] = 1.0
        if int(total) < n:
            a[int(total)] = total - int(total)
        g = k @ a
        for _ in range(steps):
            up, down = a < 1 - 1e-12, a > 1e-12  # may grow, may shrink
            i, j = np.where(up, g, np.inf).argmin(), np.where(down, g, -np.inf).argmax()
            if not up.any() or not down.any() or g[j] - g[i] <= tolerance:
                break
            step = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), 1 - a[i], a[j])
            a[i] += step
            a[j] -= step
            g += step * (k[i] - k[j])
        free = (a > 1e-9) & (a < 1 - 1e-9)
        if free.any():
            rho = float(g[free].mean())
        else:
            lows, highs = g[a >= 1 - 1e-9], g[a <= 1e-9]
            rho = float((lows.max() if len(lows) else highs.min()) / 2 + (highs.min() if len(highs) else lows.max()) / 2)
        return a, rho

    @classmethod
    def fit(cls, x: np.ndarray, nu: float = 0.1, gamma: float | None = None) -> "OneClassSvm":
        if not len(x):
            return cls(np.zeros((0, x.shape[1])), np.zeros(0), 0.0, 1.0, 0.0, 1.0)
        gamma = gamma or 1 / (x.shape[1] * (x.var() or 1.0))
        a, rho = cls.solve(cls.kernel(x, x, gamma), nu)
        on = a > 1e-9
        got = cls(x[on], a[on], rho, gamma, 0.0, 1.0)
        raw = -got.decision(x)
        margin = (raw.max() - raw.min()) * 0.1
        got.low, got.high = float(raw.min() - margin), float(raw.max() + margin)
        if got.high <= got.low:
            got.high = got.low + 1.0
        return got

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Above 0 inside."""
        return self.kernel(x, self.support, self.gamma) @ self.weights - self.rho if len(self.support) else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """On the range of the training rows, a tenth wider on both sides."""
        return np.clip((-self.decision(x) - self.low) / (self.high - self.low), 0, 1)

    def save(self, spark, path: str) -> None:
        save(spark, path, self.KIND, {"support": self.support, "weights": self.weights}, {"rho": self.rho, "gamma": float(self.gamma), "low": self.low, "high": self.high})

    @classmethod
    def load(cls, spark, path: str) -> "OneClassSvm":
        a, f = load(spark, path, cls.KIND)
        return cls(a["support"], a["weights"], f["rho"], f["gamma"], f["low"], f["high"])


class Autoencoder:
    """Four layers (hidden, latent, hidden, columns), rectified but for a logistic last one, trained by Adam on the squared error.

    The score is two-sided: how far a row's error is from the median error of the training rows, over their range."""

    KIND = "autoencoder"

    def __init__(self, weights: list[np.ndarray], biases: list[np.ndarray], errors: np.ndarray | None = None):
        self.weights, self.biases, self.errors = weights, biases, np.zeros(0) if errors is None else errors

    @classmethod
    def start(cls, columns: int, hidden: int = 64, latent: int = 16, seed: int = 42) -> "Autoencoder":
        rng, sizes = np.random.default_rng(seed), (columns, hidden, latent, hidden, columns)
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        return cls([rng.uniform(-s, s, (a, b)) for s, a, b in zip(bound, sizes, sizes[1:])], [rng.uniform(-s, s, b) for s, b in zip(bound, sizes[1:])])

    def forward(self, x: np.ndarray, masks: tuple | None = None) -> list[np.ndarray]:
        """What each layer gives, the input first.  masks: what the two hidden layers are multiplied with in training."""
        outs = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = outs[-1] @ w + b
            z = 1 / (1 + np.exp(-np.clip(z, -60, 60))) if k == 3 else np.maximum(z, 0)
            outs.append(z * masks[k // 2] if masks and k in (0, 2) else z)
        return outs

    def gradients(self, x: np.ndarray, masks: tuple | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of the mean squared error, by weights and by biases."""
        outs = self.forward(x, masks)
        d = 2 * (outs[4] - x) / x.size * outs[4] * (1 - outs[4])
        gw, gb = [None] * 4, [None] * 4
        for k in (3, 2, 1, 0):
            gw[k], gb[k] = outs[k].T @ d, d.sum(0)
            if k:
                d = (d @ self.weights[k].T) * (outs[k] > 0)
                if masks and k in (1, 3):
                    d = d * masks[(k - 1) // 2]
        return gw, gb

    @classmethod
    def fit(cls, x: np.ndarray, hidden: int = 64, latent: int = 16, epochs: int = 100, rate: float = 1e-3, decay: float = 1e-5, dropout: float = 0.2, seed: int = 42) -> "Autoencoder":
        net, rng = cls.start(x.shape[1], hidden, latent, seed), np.random.default_rng(seed + 1)
        if not len(x):
            return net
        params = [*net.weights, *net.biases]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, epochs + 1):
            masks = tuple((rng.random((len(x), hidden)) >= dropout) / (1 - dropout) for _ in range(2))
            gw, gb = net.gradients(x, masks)
            for i, (p, g) in enumerate(zip(params, [*gw, *gb])):
                g = g + decay * p
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        net.errors = np.sort(net.error(x))
        return net

    def error(self, x: np.ndarray) -> np.ndarray:
        return ((self.forward(x)[4] - x) ** 2).mean(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        n = len(self.errors)
        spread = self.errors[-1] - self.errors[0] if n else 0.0
        return np.full(len(x), 0.5) if spread < 1e-10 else np.clip(np.abs(self.error(x) - self.errors[n // 2]) / spread, 0, 1)

    def save(self, spark, path: str) -> None:
        save(spark, path, self.KIND, {f"w{i}": w for i, w in enumerate(self.weights)} | {f"b{i}": b for i, b in enumerate(self.biases)} | {"errors": self.errors})

    @classmethod
    def load(cls, spark, path: str) -> "Autoencoder":
        a = load(spark, path, cls.KIND)[0]
        return cls([a[f"w{i}"] for i in range(4)], [a[f"b{i}"] for i in range(4)], a["errors"])
