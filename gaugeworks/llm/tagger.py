"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Training is by backpropagation through time and the forward-backward algorithm of the
CRF, with Adam. Tags are BIO over the kinds; transitions that make no sense are shut.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from gaugeworks.llm.gate import Gate

PAD, SIZE = 0, 104
_NEVER = np.float32(-1e4)


def _symbol(code: int) -> int:
    c = chr(code)
    if 32 <= code < 127:
        return code - 31
    if c == "\n" or c == "\r":
        return 96
    if c.isspace():
        return 97
    base = unicodedata.normalize("NFKD", c)[:1]
    if base and 32 <= ord(base) < 127:
        return ord(base) - 31
    kind = unicodedata.category(c)
    return 98 if kind == "Lu" else 99 if kind[0] == "L" else 100 if kind[0] == "N" else 101 if kind[0] == "P" else 102


_TABLE: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """A number for each code point of a text."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([103 if 0xD800 <= i < 0xE000 else _symbol(i) for i in range(0x3100)], np.int16)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 103).astype(np.int16)


def shut_transitions(kinds: int) -> np.ndarray:
    """-inf where a tag can't follow another. Tags: 0 outside, 1+2k begin, 2+2k inside."""
    n = 1 + 2 * kinds
    shut = np.zeros((n, n), np.float32)
    for k in range(kinds):
        inside = 2 + 2 * k
        for a in range(n):
            if a not in (inside, inside - 1):
                shut[a, inside] = _NEVER
    return shut


class Tagger:
    """Weights of the net, and of its first stage (:class:`gaugeworks.llm.gate.Gate`) if it has one."""

    def __init__(self, weights: dict[str, np.ndarray], gate: Gate | None = None):
        self.w, self.gate = weights, gate
        self.hidden = weights["wh_f"].shape[0]
        self.tags = weights["out"].shape[1]

    @classmethod
    def fresh(cls, hidden: int, kinds: int, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        n, w = 1 + 2 * kinds, {}
        for d in "fb":
            w[f"wx_{d}"] = rng.normal(0, 0.3, (SIZE, 4 * hidden)).astype(np.float32)
            w[f"wx_{d}"][:, hidden : 2 * hidden] += 0.5  # forget gates begin open
            w[f"wh_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        w["out"] = rng.normal(0, 0.1, (2 * hidden, n)).astype(np.float32)
        w["bias"] = np.zeros(n, np.float32)
        w["trans"] = np.zeros((n, n), np.float32)
        w["start"] = np.zeros(n, np.float32)
        return cls(w)

    # -- LSTM: gates are input, forget, output (sigmoid) and candidate (tanh) ----------
    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [T, B, H] of one direction over symbols [T, B]; padding holds zeros."""
        steps, batch = x.shape
        h3, wx, wh = 3 * self.hidden, self.w[f"wx_{d}"].copy(), self.w[f"wh_{d}"].copy()
        wx[:, :h3] *= 0.5
        wh[:, :h3] *= 0.5
        h = np.zeros((batch, self.hidden), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, batch, self.hidden), np.float32)
        kept = []
        real = (x != PAD).astype(np.float32)[:, :, None]
        H = self.hidden
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = wx[x[t]]
            z += h @ wh
            np.tanh(z, out=z)
            s = z[:, :h3]
            s *= 0.5
            s += 0.5
            before_c, before_h = c, h
            c = z[:, H : 2 * H] * c
            c += z[:, :H] * z[:, h3:]
            c *= real[t]
            tc = np.tanh(c)
            h = z[:, 2 * H : h3] * tc
            h *= real[t]
            out[t] = h
            if keep:
                kept.append((t, z, before_c, before_h, tc))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """[T, B, tags] of symbols [T, B]."""
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x, "b", False)
        n = self.hidden
        return f @ self.w["out"][:n] + b @ self.w["out"][n:] + self.w["bias"]

    # -- CRF ------------------------------------------------------------------------
    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags [T, B] (Viterbi)."""
        return self.decode_scored(x)[0]

    def decode_scored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags [T, B], and by how much each is ahead of "outside" at its place."""
        e = self.emissions(x)
        steps, batch, n = e.shape
        shut = shut_transitions((n - 1) // 2)
        trans = self.w["trans"] + shut
        real = x != PAD
        score = self.w["start"] + shut[0] + e[0]
        back = np.zeros((steps, batch, n), np.int8)
        same = np.arange(n, dtype=np.int8)
        for t in range(1, steps):
            both = score[:, :, None] + trans
            best = both.argmax(1)
            after = np.take_along_axis(both, best[:, None, :], 1)[:, 0] + e[t]
            live = real[t][:, None]
            score = np.where(live, after, score)
            back[t] = np.where(live, best, same)
        tags = np.zeros((steps, batch), np.int8)
        at = score.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, -1, -1):
            tags[t] = at
            at = back[t][rows, at]
        tags[~real] = 0
        return tags, np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character, and its gradients."""
        H, w = self.hidden, self.w
        f, kept_f = self._run(x, "f", True)
        b, kept_b = self._run(x, "b", True)
        e = f @ w["out"][:H] + b @ w["out"][H:] + w["bias"]
        steps, batch, n = e.shape
        shut = shut_transitions((n - 1) // 2)
        trans, start = w["trans"] + shut, w["start"] + shut[0]
        real = x != PAD
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            both = alpha[t - 1][:, :, None] + trans
            top = both.max(1)
            after = top + np.log(np.exp(both - top[:, None, :]).sum(1)) + e[t]
            alpha[t] = np.where(real[t][:, None], after, alpha[t - 1])
        top = alpha[-1].max(1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        for t in range(steps - 2, -1, -1):
            both = trans[None] + (e[t + 1] + beta[t + 1])[:, None, :]
            top = both.max(2)
            before = top + np.log(np.exp(both - top[:, :, None]).sum(2))
            beta[t] = np.where(real[t + 1][:, None], before, 0)
        total = float(real.sum())
        post = np.exp(alpha + beta - log_z[None, :, None]) * real[:, :, None]
        hot = np.zeros_like(e)
        ti, bi = np.nonzero(real)
        hot[ti, bi, y[ti, bi]] = 1
        de = (post - hot) / total
        d_trans = np.zeros((n, n), np.float32)
        for t in range(1, steps):
            live = real[t]
            if not live.any():
                break
            pair = np.exp(alpha[t - 1][live][:, :, None] + trans + (e[t] + beta[t])[live][:, None, :] - log_z[live][:, None, None])
            d_trans += pair.sum(0)
            np.subtract.at(d_trans, (y[t - 1][live], y[t][live]), 1)
        gold = (e * hot).sum() + start[y[0]].sum()
        both_real = real[1:]
        gold += trans[y[:-1][both_real], y[1:][both_real]].sum()
        value = float(log_z.sum() - gold) / total
        g = {"trans": d_trans / total, "start": de[0].sum(0), "bias": de.sum((0, 1))}
        g["out"] = np.concatenate([np.tensordot(f, de, ([0, 1], [0, 1])), np.tensordot(b, de, ([0, 1], [0, 1]))])
        for d, kept, part in (("f", kept_f, w["out"][:H]), ("b", kept_b, w["out"][H:])):
            g |= self._back(x, d, kept, de @ part.T, real)
        return value, g

    def _back(self, x: np.ndarray, d: str, kept: list, dh_out: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        H, wh = self.hidden, self.w[f"wh_{d}"]
        gx, gh = np.zeros_like(self.w[f"wx_{d}"]), np.zeros_like(wh)
        dh = np.zeros((x.shape[1], H), np.float32)
        dc = np.zeros_like(dh)
        for t, z, before_c, before_h, tc in reversed(kept):
            live = real[t][:, None]
            i, f, o, q = z[:, :H], z[:, H : 2 * H], z[:, 2 * H : 3 * H], z[:, 3 * H :]
            dh = (dh + dh_out[t]) * live
            dc = (dc + dh * o * (1 - tc * tc)) * live
            dz = np.concatenate([dc * q * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - q * q)], 1)
            np.add.at(gx, x[t], dz)
            gh += before_h.T @ dz
            dh = dz @ wh.T
            dc = dc * f
        return {f"wx_{d}": gx, f"wh_{d}": gh}

    def save(self, path: str) -> None:
        g = self.gate
        gate = {} if g is None else {"gate_here": g.here, "gate_before": g.before, "gate_after": g.after, "gate_at": np.array([g.bias, g.threshold])}
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in (self.w | gate).items()})

    @classmethod
    def load(cls, data) -> Tagger:
        with np.load(data) as found:
            w = {k: found[k].astype(np.float32) for k in found.files}
        tables = [w.pop(k, None) for k in ("gate_here", "gate_before", "gate_after", "gate_at")]
        return cls(w, None if tables[3] is None else Gate(*tables[:3], *map(float, tables[3])))


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}
        self.t = 0

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, clip: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k in w:
            x = g[k] * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.002 * (x * x - self.v[k])
            w[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.998**self.t)) + 1e-8)
