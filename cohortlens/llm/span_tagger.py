"""Character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of every kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32
OTHER, LETTER, DIGIT, SYMBOLS = 0, 1, 2, 3
VOCABULARY = SYMBOLS + 95
NAMES = ("embed", "wx_f", "wh_f", "b_f", "wx_b", "wh_b", "b_b", "out", "out_b", "move", "begin")


def character_ids(text: str) -> np.ndarray:
    """Digits are one class, letters beyond ASCII another, ASCII keeps its characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    ids = np.where((codes >= 32) & (codes < 127), codes - 32 + SYMBOLS, OTHER)
    ids[codes >= 128] = LETTER
    ids[(codes >= 48) & (codes <= 57)] = DIGIT
    return ids


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        start, end = max(0, start), min(length, end)
        if start < end:
            tags[start:end] = 2 + 2 * k
            tags[start] = 1 + 2 * k
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        own = (tag - 1) // 2 if tag else -1
        if start >= 0 and (own != kind or tag % 2 == 1):
            out.append((KINDS[kind], start, i))
            start = -1
        if own >= 0 and start < 0:
            start, kind = i, own
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    def layer(self, ids: np.ndarray, way: str) -> tuple[np.ndarray, dict]:
        w = self.weights
        wh = w[f"wh_{way}"]
        units = wh.shape[0]
        inputs = (w["embed"] @ w[f"wx_{way}"] + w[f"b_{way}"])[ids]
        n, steps = ids.shape
        h, c = np.zeros((n, units), np.float32), np.zeros((n, units), np.float32)
        seen = {"h": np.zeros((steps + 1, n, units), np.float32), "c": np.zeros((steps + 1, n, units), np.float32),
                "gates": np.zeros((steps, n, 4 * units), np.float32)}
        for k in range(steps):
            z = inputs[:, k] + h @ wh
            z[:, :3 * units] = sigmoid(z[:, :3 * units])
            z[:, 3 * units:] = np.tanh(z[:, 3 * units:])
            i, f, o, g = (z[:, j * units:(j + 1) * units] for j in range(4))
            c = f * c + i * g
            h = o * np.tanh(c)
            seen["h"][k + 1], seen["c"][k + 1], seen["gates"][k] = h, c, z
        return seen["h"][1:].transpose(1, 0, 2), seen

    def layer_back(self, ids: np.ndarray, way: str, seen: dict, slope: np.ndarray, grads: dict) -> None:
        w = self.weights
        wh = w[f"wh_{way}"]
        units = wh.shape[0]
        n, steps = ids.shape
        dh, dc = np.zeros((n, units), np.float32), np.zeros((n, units), np.float32)
        dz_all = np.zeros((n, steps, 4 * units), np.float32)
        for k in range(steps - 1, -1, -1):
            i, f, o, g = (seen["gates"][k][:, j * units:(j + 1) * units] for j in range(4))
            squashed = np.tanh(seen["c"][k + 1])
            dh = dh + slope[:, k]
            dc = dc + dh * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * seen["c"][k] * f * (1 - f),
                                 dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
            grads[f"wh_{way}"] += seen["h"][k].T @ dz
            dz_all[:, k] = dz
            dh, dc = dz @ wh.T, dc * f
        by_id = np.zeros((VOCABULARY, 4 * units), np.float32)
        np.add.at(by_id, ids.reshape(-1), dz_all.reshape(-1, 4 * units))
        grads[f"wx_{way}"] += w["embed"].T @ by_id
        grads[f"b_{way}"] += by_id.sum(0)
        grads["embed"] += by_id @ w[f"wx_{way}"].T

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, seen_f = self.layer(ids, "f")
        back, seen_b = self.layer(ids[:, ::-1], "b")
        hidden = np.concatenate([ahead, back[:, ::-1]], axis=2)
        return hidden @ self.weights["out"] + self.weights["out_b"], (hidden, seen_f, seen_b)

    def best_paths(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags of every window."""
        scores, _ = self.emissions(ids)
        move = self.weights["move"]
        n, steps, _ = scores.shape
        state = scores[:, 0] + self.weights["begin"]
        came = np.zeros((steps, n, TAGS), dtype=np.int8)
        for k in range(1, steps):
            options = state[:, :, None] + move[None]
            came[k] = options.argmax(axis=1)
            state = options.max(axis=1) + scores[:, k]
        tags = np.zeros((n, steps), dtype=np.int64)
        tags[:, -1] = state.argmax(axis=1)
        for k in range(steps - 1, 0, -1):
            tags[:, k - 1] = came[k][np.arange(n), tags[:, k]]
        return tags

    def slopes(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the tags and its gradient by forward-backward."""
        w = self.weights
        grads = {name: np.zeros_like(v) for name, v in w.items()}
        scores, (hidden, seen_f, seen_b) = self.emissions(ids)
        move, begin = w["move"], w["begin"]
        n, steps, _ = scores.shape
        alpha = np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0] + begin
        for k in range(1, steps):
            alpha[:, k] = logsumexp(alpha[:, k - 1][:, :, None] + move[None], 1) + scores[:, k]
        beta = np.zeros_like(scores)
        for k in range(steps - 2, -1, -1):
            beta[:, k] = logsumexp(move[None] + (scores[:, k + 1] + beta[:, k + 1])[:, None], 2)
        total = logsumexp(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        gold = scores[rows, cols, tags].sum(1) + begin[tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        slope = np.exp(alpha + beta - total[:, None, None])
        grads["begin"] += slope[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=TAGS)
        for k in range(1, steps):
            pair = alpha[:, k - 1][:, :, None] + move[None] + (scores[:, k] + beta[:, k])[:, None]
            grads["move"] += np.exp(pair - total[:, None, None]).sum(0)
        np.subtract.at(grads["move"], (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1)
        slope[rows, cols, tags] -= 1
        slope = slope.astype(np.float32)
        flat, units = slope.reshape(-1, TAGS), hidden.shape[2] // 2
        grads["out"] += hidden.reshape(-1, 2 * units).T @ flat
        grads["out_b"] += flat.sum(0)
        back = slope @ w["out"].T
        self.layer_back(ids, "f", seen_f, back[:, :, :units], grads)
        self.layer_back(ids[:, ::-1], "b", seen_b, back[:, ::-1, units:], grads)
        return float((total - gold).mean()), {k: v / n for k, v in grads.items()}


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], dims: int = 10, units: int = 16,
          steps: int = 350, batch: int = 96, rate: float = 0.015, seed: int = 9) -> Tagger:
    """Adam over random batches of (text, spans) windows, gradients clipped by norm."""
    rng = np.random.default_rng(seed)
    ids = np.zeros((len(windows), WINDOW), dtype=np.int64)
    tags = np.zeros((len(windows), WINDOW), dtype=np.int64)
    for k, (text, spans) in enumerate(windows):
        own = character_ids(text[:WINDOW])
        ids[k, :len(own)] = own
        tags[k] = tags_of(WINDOW, spans)
    shapes = {"embed": (VOCABULARY, dims), "out": (2 * units, TAGS), "out_b": (TAGS,),
              "move": (TAGS, TAGS), "begin": (TAGS,)}
    for way in "fb":
        shapes |= {f"wx_{way}": (dims, 4 * units), f"wh_{way}": (units, 4 * units), f"b_{way}": (4 * units,)}
    model = Tagger({
        name: (rng.normal(0, 0.25, shapes[name]) if len(shapes[name]) == 2 and name != "move"
               else np.zeros(shapes[name])).astype(np.float32) for name in NAMES})
    for way in "fb":
        model.weights[f"b_{way}"][units:2 * units] = 1.0
    first = {n: np.zeros_like(v) for n, v in model.weights.items()}
    second = {n: np.zeros_like(v) for n, v in model.weights.items()}
    for step in range(1, steps + 1):
        own = rng.integers(0, len(windows), batch)
        _, grads = model.slopes(ids[own], tags[own])
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for n in NAMES:
            g = grads[n] * min(1.0, 5.0 / (norm + 1e-9))
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g ** 2
            change = now * (first[n] / (1 - 0.9 ** step)) / (
                np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-8)
            model.weights[n] = (model.weights[n] - change).astype(np.float32)
    return model


def decode(model: Tagger, regions: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of every region. Windows overlap by half; each character takes the tag of the window
    in whose middle it lies, and spans are read from the joined tags, so a span may cross windows."""
    windows, where = [], []
    for r, text in enumerate(regions):
        ids = character_ids(text)
        last = max(0, -(-(len(ids) - WINDOW) // STRIDE))
        for k in range(last + 1):
            part = np.zeros(WINDOW, dtype=np.int64)
            own = ids[k * STRIDE:k * STRIDE + WINDOW]
            part[:len(own)] = own
            windows.append(part)
            where.append((r, k, k == last, len(ids)))
    tags = [np.zeros(len(text), dtype=np.int64) for text in regions]
    quarter = STRIDE // 2
    for start in range(0, len(windows), 256):
        paths = model.best_paths(np.stack(windows[start:start + 256]))
        for path, (r, k, final, length) in zip(paths, where[start:start + 256]):
            low = k * STRIDE + (quarter if k else 0)
            high = length if final else k * STRIDE + WINDOW - quarter
            tags[r][low:high] = path[low - k * STRIDE:high - k * STRIDE]
    return [spans_of(t) for t in tags]
