"""A character-level bidirectional LSTM with a CRF over its tags, in numpy: training, and decoding of overlapping windows."""

from __future__ import annotations

import numpy as np

#: Characters that the model tells apart: padding, printable ASCII, line ends and tabs, other letters, all else.
ALPHABET = 99
_CODES = np.full(0x10000, 98, np.uint8)
_CODES[32:127] = np.arange(1, 96)
_CODES[[9, 10, 11, 12, 13]] = 96
_CODES[0xC0:0x2000] = 97


def encode(text: str) -> np.ndarray:
    """One code for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, _CODES[np.minimum(points, 0xFFFF)], 98).astype(np.uint8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights: for each direction the input table (a code's gates), the recurrence and the bias; the output layer; the
    CRF's transitions and start scores."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        f = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"out": f(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "move": f(tags, tags), "start": f(tags)}
        for d in "fb":
            self.w |= {f"x{d}": f(ALPHABET, 4 * hidden), f"u{d}": f(hidden, 4 * hidden)}
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1  # remember at first
            self.w[f"b{d}"] = b

    def _lstm(self, codes, d, keep):
        """h of each step; with keep, also what the backward pass needs. codes: (steps, rows)."""
        n, (steps, rows) = self.hidden, codes.shape
        x, u, b = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"b{d}"]
        table = x + b
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        hs, saved = np.empty((steps, rows, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[codes[t]] + h @ u
            s = _sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                saved.append((t, i, f, o, g, tc, *before))
        return hs, saved

    def emissions(self, codes, keep=False):
        """codes: (rows, steps) -> scores (steps, rows, tags)."""
        turned = np.ascontiguousarray(codes.T)
        hf, sf = self._lstm(turned, "f", keep)
        hb, sb = self._lstm(turned, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.w["out"] + self.w["bias"], h, (turned, sf, sb)

    def gradients(self, codes, tags):
        """Mean negative log-likelihood of the rows' tag sequences, and its gradients."""
        w, n = self.w, self.hidden
        e, h, (turned, sf, sb) = self.emissions(codes, keep=True)
        steps, rows, k = e.shape
        y = tags.T
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0], beta[-1] = w["start"] + e[0], 0
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + w["move"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum((beta[t + 1] + e[t + 1])[:, None, :] + w["move"], 2)
        total = _logsum(alpha[-1], 1)
        at = np.arange(rows)
        gold = w["start"][y[0]] + e[0, at, y[0]]
        de = np.exp(alpha + beta - total[None, :, None])
        both = np.exp(alpha[:-1, :, :, None] + w["move"] + (e + beta)[1:, :, None, :] - total[:, None, None])
        g = {"move": both.sum((0, 1)), "start": de[0].sum(0)}
        np.subtract.at(g["move"], (y[:-1], y[1:]), 1)
        np.subtract.at(g["start"], y[0], 1)
        for t in range(1, steps):
            gold += w["move"][y[t - 1], y[t]] + e[t, at, y[t]]
        de[np.arange(steps)[:, None], at[None, :], y] -= 1
        g["out"] = np.einsum("tbh,tbk->hk", h, de)
        g["bias"] = de.sum((0, 1))
        dh_all = de @ w["out"].T
        seen = np.eye(ALPHABET, dtype=dh_all.dtype)[turned.ravel()]  # sums by code as one product
        for d, saved, part in (("f", sf, dh_all[:, :, :n]), ("b", sb, dh_all[:, :, n:])):
            gu = np.zeros_like(w[f"u{d}"])
            dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            every = np.empty((steps, rows, 4 * n), dh_all.dtype)
            for t, i, f, o, gg, tc, h0, c0 in reversed(saved):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                every[t] = dz
                gu += h0.T @ dz
                dh, dc = dz @ w[f"u{d}"].T, dc * f
            g |= {f"x{d}": seen.T @ every.reshape(-1, 4 * n), f"u{d}": gu, f"b{d}": every.sum((0, 1))}
        return float((total - gold).mean()), {key: value / rows for key, value in g.items()}

    def train(self, codes, tags, epochs=10, batch=64, rate=0.02, seed=3):
        """Adam over shuffled batches; the rate falls to a tenth."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step, steps = 0, epochs * (len(codes) // batch)
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for i in range(0, len(codes) - batch + 1, batch):
                own = order[i : i + batch]
                _, g = self.gradients(codes[own], tags[own])
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale, now = min(1.0, 5.0 / (norm + 1e-9)), rate * (1 - 0.9 * step / steps)
                for k, x in g.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, codes):
        """The best tag sequence of each row: (rows, steps)."""
        e, _, _ = self.emissions(codes)
        return self.viterbi(e, np.full(e.shape[1], len(e)))

    def viterbi(self, e, lengths):
        """The best tag sequence of each row of scores e (steps, rows, tags), of which the first `lengths` steps count."""
        steps, rows, _ = e.shape
        best, back = self.w["start"] + e[0], np.empty(e.shape, np.uint8)
        at = np.arange(rows)
        ends = best.copy()
        for t in range(1, steps):
            s = best[:, :, None] + self.w["move"]
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
            over = lengths == t + 1
            ends[over] = best[over]
        last = ends.argmax(1)
        path = np.zeros((steps, rows), np.uint8)
        for t in range(steps - 1, -1, -1):
            own = lengths > t
            path[t, own] = last[own]
            if t:
                last = np.where(own, back[t][at, last], last)
        return path.T


def label(tagger: Tagger, texts: list[np.ndarray], anchor: np.ndarray, width: int = 96, rows: int = 512, more: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The tags of each text's characters. Windows of `width` characters overlap by half; a character's scores are the mean of
    those of its windows, weighted by how far it stands from the window's ends. Then one path is decoded over each stretch of
    windows that touch, so the transitions hold across their borders. The network is asked in the windows that hold an anchor (a
    character whose code is one, or a position that `more` names) and in those beside them; the others have no span."""
    step = width // 2
    found = [np.zeros(len(t), np.uint8) for t in texts]
    jobs = []
    for k, codes in enumerate(texts):
        hits = np.flatnonzero(anchor[codes])
        if more is not None:
            hits = np.union1d(hits, more[k])
        if len(hits):
            last = max(0, -(-(len(codes) - width) // step))
            first = np.maximum(0, -(-(hits - width + 1) // step) - 1)
            final = np.minimum(last, hits // step + 1)
            own = np.unique(np.concatenate([np.minimum(first + j, final) for j in range(width // step + 3)]))
            jobs += [(k, int(i)) for i in own]
    # stretches of windows that touch: (text, first character, end), and each window's place in one
    stretches: list[list[int]] = []
    for k, i in jobs:
        a, b = i * step, min(i * step + width, len(texts[k]))
        if stretches and stretches[-1][0] == k and a <= stretches[-1][2]:
            stretches[-1][2] = b
        else:
            stretches.append([k, a, b])
    starts = np.cumsum([0, *(b - a for _, a, b in stretches)])
    score, weight = np.zeros((starts[-1], tagger.tags), np.float32), np.zeros(starts[-1], np.float32)
    pull = np.minimum(np.arange(width), np.arange(width)[::-1]).astype(np.float32) + 1
    of = 0
    for j in range(0, len(jobs), rows):
        part = jobs[j : j + rows]
        block = np.zeros((len(part), width), np.uint8)
        for r, (k, i) in enumerate(part):
            piece = texts[k][i * step : i * step + width]
            block[r, : len(piece)] = piece
        e, _, _ = tagger.emissions(block)
        for r, (k, i) in enumerate(part):
            while stretches[of][0] != k or not stretches[of][1] <= i * step < stretches[of][2]:
                of += 1
            a = int(starts[of]) + i * step - stretches[of][1]
            n = min(width, len(texts[k]) - i * step)
            score[a : a + n] += e[:n, r] * pull[:n, None]
            weight[a : a + n] += pull[:n]
    score /= weight[:, None]
    # stretches of like length are decoded together
    order = sorted(range(len(stretches)), key=lambda x: stretches[x][2] - stretches[x][1])
    i = 0
    while i < len(order):
        j, longest = i, stretches[order[i]][2] - stretches[order[i]][1]
        while j < len(order) and j - i < rows and (stretches[order[j]][2] - stretches[order[j]][1]) <= 2 * longest:
            j += 1
        own = order[i:j]
        lengths = np.array([stretches[x][2] - stretches[x][1] for x in own])
        e = np.zeros((int(lengths.max()), len(own), tagger.tags), np.float32)
        for r, x in enumerate(own):
            e[: lengths[r], r] = score[starts[x] : starts[x + 1]]
        for x, tags in zip(own, tagger.viterbi(e, lengths)):
            k, a, b = stretches[x]
            found[k][a:b] = tags[: b - a]
        i = j
    return found
