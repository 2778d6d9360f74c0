"""A character tagger in numpy: bidirectional LSTM with CRF transitions, trained by Adam."""

from __future__ import annotations

import numpy as np

# Characters with a class of their own; others are classed by rule.
OWN = "@.+-()[]{}<>:;,/=_%# \n"
CLASSES = len(OWN) + 36 + 4


def classes(text: str) -> np.ndarray:
    """Class of each character: own sign, digit, letter a-z, capital flagged apart, other letter, rest."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.full(0x250, len(OWN) + 36 + 2, "i2")  # letters beyond ASCII, by far the most of the rest
    table[:192] = len(OWN) + 36 + 3
    for i in range(10):
        table[48 + i] = len(OWN) + i
    for i in range(26):
        table[97 + i] = table[65 + i] = len(OWN) + 10 + i
    for i, c in enumerate(OWN):
        table[ord(c)] = i
    return table


_TABLE = _table()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        draw = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        self.p = {"E": draw(CLASSES, embed) * 2, "O": draw(2 * hidden, tags), "o": np.zeros(tags, "f4"), "T": np.zeros((tags, tags), "f4"), "S": np.zeros(tags, "f4")}
        for d in "fb":
            self.p |= {f"W{d}": draw(embed, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, "f4")}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, batch, embedding. Runs from the end for the backward direction."""
        n, b, _ = x.shape
        k, u = self.hidden, self.p[f"U{d}"]
        z_in = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h, c, out, tape = np.zeros((b, k), "f4"), np.zeros((b, k), "f4"), np.empty((n, b, k), "f4"), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = z_in[t] + h @ u
            gate, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :]
            before, c = (c, h), f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                tape.append((t, i, f, o, new, before, squashed))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of tags for class rows x (batch, time), as time, batch, tag."""
        e = self.p["E"][x.T]
        (hf, tf), (hb, tb) = self._lstm(e, "f", keep), self._lstm(e, "b", keep)
        h = np.concatenate([hf, hb], 2)
        return h @ self.p["O"] + self.p["o"], (e, h, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag rows y, and its gradients."""
        s, (e, h, tf, tb) = self.emissions(x, True)
        n, b, k = s.shape
        tr, y = self.p["T"], y.T
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0] + self.p["S"]
        for t in range(1, n):
            alpha[t] = s[t] + np.logaddexp.reduce(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(tr + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = np.logaddexp.reduce(alpha[-1], 1)
        rows = np.arange(b)
        gold = self.p["S"][y[0]] + sum(s[t, rows, y[t]] for t in range(n)) + sum(tr[y[t - 1], y[t]] for t in range(1, n))
        ds = np.exp(alpha + beta - log_z[:, None])
        g = {"S": ds[0].sum(0), "T": np.zeros_like(tr)}
        for t in range(1, n):
            g["T"] += np.exp(alpha[t - 1][:, :, None] + tr + (s[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(g["T"], (y[:-1].ravel(), y[1:].ravel()), -1)
        np.add.at(g["S"], y[0], -1)
        np.add.at(ds, (np.arange(n)[:, None], rows[None, :], y), -1)
        g["O"], g["o"] = h.reshape(n * b, -1).T @ ds.reshape(n * b, k), ds.sum((0, 1))
        dh, de = ds @ self.p["O"].T, np.zeros_like(e)
        m = self.hidden
        for d, tape, part in (("f", tf, dh[:, :, :m]), ("b", tb, dh[:, :, m:])):
            dw, dh_next, dc = np.zeros_like(self.p[f"U{d}"]), np.zeros((b, m), "f4"), np.zeros((b, m), "f4")
            dz_all = np.zeros((n, b, 4 * m), "f4")
            for t, i, f, o, new, (c0, h0), squashed in reversed(tape):
                dht = part[t] + dh_next
                dc = dc + dht * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), dht * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
                dw += h0.T @ dz
                dh_next, dc = dz @ self.p[f"U{d}"].T, dc * f
                dz_all[t] = dz
            flat = dz_all.reshape(n * b, -1)
            g |= {f"U{d}": dw, f"W{d}": e.reshape(n * b, -1).T @ flat, f"c{d}": flat.sum(0)}
            de += dz_all @ self.p[f"W{d}"].T
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x.T, de)
        return float((log_z - gold).mean()), {k: v / b for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 320, batch: int = 64, rate: float = 0.012, seed: int = 11) -> "Tagger":
        g, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            rows = g.integers(0, len(x), batch)
            _, grads = self.gradients(x[rows], y[rows])
            norm = np.sqrt(sum(float((q**2).sum()) for q in grads.values()))
            for k, q in grads.items():
                q = q * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * q
                v[k] = 0.999 * v.get(k, 0) + 0.001 * q**2
                now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag rows (Viterbi), and the posterior probability of each chosen tag."""
        s, _ = self.emissions(x)
        n, b, _ = s.shape
        tr, best, back = self.p["T"], s[0] + self.p["S"], []
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = best
        for t in range(1, n):
            step = best[:, :, None] + tr
            back.append(step.argmax(1))
            best = s[t] + step.max(1)
            alpha[t] = s[t] + np.logaddexp.reduce(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(tr + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        path = [best.argmax(1)]
        for bp in reversed(back):
            path.append(bp[np.arange(b), path[-1]])
        tags = np.array(path[::-1])
        log_p = alpha + beta - np.logaddexp.reduce(alpha[-1], 1)[:, None]
        return tags.T, np.exp(np.take_along_axis(log_p, tags[:, :, None], 2)[:, :, 0]).T
