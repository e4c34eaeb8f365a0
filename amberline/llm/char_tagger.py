"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding of fixed-length windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER, OTHER, PAD = 128, 129, 130  # beyond the 128 ASCII characters
SYMBOLS = 131


def symbols(text: str) -> np.ndarray:
    """One symbol a code point: ASCII as it is, other letters, all else."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = codes.astype(np.uint8)
    for code in np.unique(codes[codes > 127]):
        out[codes == code] = LETTER if chr(code).isalpha() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"cross": np.zeros((tags, tags), np.float32), "bias": np.zeros(tags, np.float32),
             "out": rng.normal(0, 0.3, (2 * hidden, tags)).astype(np.float32)}
        for way in "fb":
            w["table" + way] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden)).astype(np.float32)
            w["table" + way][:, hidden:2 * hidden] += 1  # remember at first
            w["again" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        return cls(w)

    def _pass(self, codes: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states, time first; ``keep`` collects what the backward pass needs."""
        table, again = self.weights["table" + way], self.weights["again" + way]
        size = again.shape[0]
        h = c = np.zeros((codes.shape[1], size), np.float32)
        out = np.empty((len(codes), codes.shape[1], size), np.float32)
        for t in range(len(codes)):
            gates = table[codes[t]] + h @ again
            gates[:, :3 * size] = _sigmoid(gates[:, :3 * size])
            gates[:, 3 * size:] = np.tanh(gates[:, 3 * size:])
            before = c
            c = gates[:, size:2 * size] * before + gates[:, :size] * gates[:, 3 * size:]
            shown = np.tanh(c)
            if keep is not None:
                keep.append((gates, before, shown, h))
            h = gates[:, 2 * size:3 * size] * shown
            out[t] = h
        return out

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """(windows, length, tags) scores of (windows, length) symbols."""
        codes = windows.T
        both = np.concatenate([self._pass(codes, "f"), self._pass(codes[::-1], "b")[::-1]], 2)
        return (both @ self.weights["out"] + self.weights["bias"]).transpose(1, 0, 2)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tag path over (length, tags) scores and the transitions."""
        cross = self.weights["cross"]
        best, back = scores[0], []
        for row in scores[1:]:
            options = best[:, None] + cross
            back.append(options.argmax(0))
            best = options.max(0) + row
        path = [int(best.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return np.array(path[::-1])

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradients."""
        w, codes = self.weights, windows.T
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self._pass(codes, "f", kept["f"]), self._pass(codes[::-1], "b", kept["b"])[::-1]], 2)
        scores = hidden @ w["out"] + w["bias"]
        gold, (steps, batch, n_tags) = tags.T, scores.shape
        cross = w["cross"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + cross, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(cross + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1], 1)
        at = np.arange(batch)
        path = sum(scores[t, at, gold[t]] for t in range(steps)) + sum(cross[gold[t], gold[t + 1]] for t in range(steps - 1))
        g_scores = np.exp(alpha + beta - total[:, None])
        g_scores[np.arange(steps)[:, None], at, gold] -= 1
        g_scores /= batch
        pair = np.exp(alpha[:-1, :, :, None] + cross + (beta + scores)[1:, :, None, :] - total[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        flat, g_flat = hidden.reshape(-1, hidden.shape[2]), g_scores.reshape(-1, n_tags)
        grads = {"cross": (pair / batch).astype(np.float32), "bias": g_flat.sum(0), "out": flat.T @ g_flat}
        g_hidden = (g_flat @ w["out"].T).reshape(hidden.shape)
        size = hidden.shape[2] // 2
        for way, own, order in (("f", g_hidden[:, :, :size], codes), ("b", g_hidden[::-1, :, size:], codes[::-1])):
            grads |= self._backward(kept[way], own, order, way)
        return float((total - path).mean()), grads

    def _backward(self, kept: list, g_out: np.ndarray, codes: np.ndarray, way: str) -> dict[str, np.ndarray]:
        again = self.weights["again" + way]
        size = again.shape[0]
        g_table, g_again = np.zeros_like(self.weights["table" + way]), np.zeros_like(again)
        g_h = g_c = np.zeros(g_out.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            gates, before, shown, h_before = kept[t]
            i, f, o, g = (gates[:, k * size:(k + 1) * size] for k in range(4))
            g_h = g_h + g_out[t]
            g_c = g_c + g_h * o * (1 - shown * shown)
            g_gates = np.concatenate([g_c * g * i * (1 - i), g_c * before * f * (1 - f), g_h * shown * o * (1 - o), g_c * i * (1 - g * g)], 1)
            np.add.at(g_table, codes[t], g_gates)
            g_again += h_before.T @ g_gates
            g_h, g_c = g_gates @ again.T, g_c * f
        return {"table" + way: g_table, "again" + way: g_again}


def train(windows: np.ndarray, tags: np.ndarray, n_tags: int, hidden: int = 16, epochs: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam over shuffled batches; the same data and seed give the same weights."""
    tagger, rng = Tagger.fresh(n_tags, hidden, seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), batch):
            some = order[begin:begin + batch]
            _, grads = tagger.gradients(windows[some], tags[some])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1)) * min(1.0, 5.0 / (norm + 1e-9))
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                tagger.weights[k] = (tagger.weights[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger
