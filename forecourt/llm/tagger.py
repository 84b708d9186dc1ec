"""Character tagger: bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Character codes: 0 pads, 1 to 127 are ASCII, then four classes of others.
CODES = 132

LETTER, DIGIT, SPACE, OTHER = 128, 129, 130, 131


def codes(text: str) -> np.ndarray:
    """Code of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.int64)
    wide = np.flatnonzero(points > 127)
    if len(wide):
        out[wide] = [
            LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else OTHER
            for c in map(chr, points[wide])
        ]
    return out


def _lstm(x: np.ndarray, weights: tuple, keep: bool) -> tuple[np.ndarray, list]:
    """Outputs for inputs (time, batch, size), with what the gradient needs if ``keep``."""
    wx, wh, bias = weights
    size = wh.shape[0]
    steps, batch, _ = x.shape
    ahead = x @ wx + bias
    h = np.zeros((batch, size), x.dtype)
    c = np.zeros_like(h)
    out, kept = np.empty((steps, batch, size), x.dtype), []
    for t in range(steps):
        g = np.tanh(ahead[t] + h @ wh)  # of the gates' columns, half the logistic argument
        gate = 0.5 * (g[:, : 3 * size] + 1)
        i, f, o, a = gate[:, :size], gate[:, size : 2 * size], gate[:, 2 * size :], g[:, 3 * size :]
        before, earlier = c, h
        c = f * c + i * a
        tc = np.tanh(c)
        h = out[t] = o * tc
        if keep:
            kept.append((i, f, o, a, before, earlier, tc))
    return out, kept


def _lstm_gradient(dout: np.ndarray, x: np.ndarray, weights: tuple, kept: list) -> tuple:
    wx, wh, _ = weights
    size = wh.shape[0]
    dz = np.empty((*x.shape[:2], 4 * size), x.dtype)
    dwh = np.zeros_like(wh)
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, a, before, earlier, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[:, :size] = dc * a * i * (1 - i) * 2
        z[:, size : 2 * size] = dc * before * f * (1 - f) * 2
        z[:, 2 * size : 3 * size] = dh * tc * o * (1 - o) * 2
        z[:, 3 * size :] = dc * i * (1 - a * a)
        dwh += earlier.T @ z
        dh = z @ wh.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Labels characters; ``labels`` counts them and label 0 is outside."""

    def __init__(self, labels: int, embed: int = 12, hidden: int = 20, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)

        def random(*shape: int) -> np.ndarray:
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 0.5
        self.weights = {
            "embed": random(CODES, embed) * np.float32(4),
            "fx": random(embed, 4 * hidden),
            "fh": random(hidden, 4 * hidden),
            "fb": bias,
            "bx": random(embed, 4 * hidden),
            "bh": random(hidden, 4 * hidden),
            "bb": bias.copy(),
            "out": random(2 * hidden, labels),
            "base": np.zeros(labels, np.float32),
            "move": np.zeros((labels, labels), np.float32),
        }

    def _scores(self, chars: np.ndarray, keep: bool) -> tuple:
        w = self.weights
        x = w["embed"][chars.T]
        forward, kept_f = _lstm(x, (w["fx"], w["fh"], w["fb"]), keep)
        backward, kept_b = _lstm(x[::-1], (w["bx"], w["bh"], w["bb"]), keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ w["out"] + w["base"], both, x, kept_f, kept_b

    def gradient(self, chars: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per window of (batch, time) codes and labels, and its gradient."""
        w = self.weights
        scores, both, x, kept_f, kept_b = self._scores(chars, True)
        steps, batch, labels = scores.shape
        move = w["move"].astype(np.float64)
        s = scores.astype(np.float64)
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[0] = s[0]
        for t in range(1, steps):
            ahead[t] = s[t] + _logsumexp(ahead[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = _logsumexp(move + (s[t + 1] + behind[t + 1])[:, None, :], 2)
        whole = _logsumexp(ahead[-1], 1)
        rows, y = np.arange(batch), truth.T
        reached = s[np.arange(steps)[:, None], rows, y].sum() + move[y[:-1], y[1:]].sum()
        loss = (whole.sum() - reached) / batch
        dscores = np.exp(ahead + behind - whole[:, None])
        pairs = ahead[:-1, :, :, None] + move + (s[1:] + behind[1:])[:, :, None, :] - whole[:, None, None]
        dmove = np.exp(pairs).sum((0, 1))
        np.subtract.at(dmove, (y[:-1], y[1:]), 1)
        dscores[np.arange(steps)[:, None], rows, y] -= 1
        ds = (dscores / batch).astype(np.float32)
        flat = ds.reshape(-1, labels)
        grad = {"out": both.reshape(-1, both.shape[2]).T @ flat, "base": flat.sum(0), "move": (dmove / batch).astype(np.float32)}
        dboth = ds @ w["out"].T
        half = dboth.shape[2] // 2
        dx, grad["fx"], grad["fh"], grad["fb"] = _lstm_gradient(dboth[:, :, :half], x, (w["fx"], w["fh"], w["fb"]), kept_f)
        back = dboth[::-1, :, half:]
        dback, grad["bx"], grad["bh"], grad["bb"] = _lstm_gradient(back, x[::-1], (w["bx"], w["bh"], w["bb"]), kept_b)
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], chars.T.ravel(), (dx + dback[::-1]).reshape(-1, x.shape[2]))
        return float(loss), grad

    def train(self, chars: np.ndarray, truth: np.ndarray, steps: int, batch: int = 64, rate: float = 0.012, seed: int = 3) -> list[float]:
        """Adam over random batches; losses by step."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = draw.integers(0, len(chars), batch)
            loss, grad = self.gradient(chars[rows], truth[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * scale
                first[k] = 0.9 * first[k] + np.float32(0.1) * g
                second[k] = 0.99 * second[k] + np.float32(0.01) * g * g
                fit = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6
                self.weights[k] = (self.weights[k] - now * first[k] / (1 - 0.9**step) / fit).astype(np.float32)
        return losses

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best labels (batch, time) of codes, by Viterbi."""
        scores = self._scores(chars, False)[0]
        steps, batch, labels = scores.shape
        best, back = scores[0], np.empty((steps, batch, labels), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.weights["move"]
            back[t] = ways.argmax(1)
            best = scores[t] + ways.max(1)
        out = np.empty((steps, batch), np.int8)
        out[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out.T
