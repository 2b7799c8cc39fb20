"""Recurrent block labeller: a bidirectional LSTM in numpy that reads a page's blocks and marks those of its main text.

Each block is a vector: its tag path (hashed tags and class words, weighted towards the leaf), its hashed words, and a few counts. The forward and
backward states together see the whole page. Trained here on generated pages (`python -m lexilink.llm.blocklabel`), on nothing else; the weights are in blocklabel.npz.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

from lexilink.llm import htmlblocks
from lexilink.llm import wordbytes as wb
from lexilink.llm.htmlblocks import Block, blocks

PATH_DIM, WORD_DIM, COUNTS = 96, 16, 7
INPUT = PATH_DIM + WORD_DIM + COUNTS
HIDDEN = 16
WEIGHTS = Path(__file__).with_name("blocklabel.npz")
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_slots: dict[str, int] = {}


def _slot(mark: str) -> int:
    if mark not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        _slots[mark] = zlib.crc32(mark.encode()) % PATH_DIM
    return _slots[mark]


_paths: dict[tuple, np.ndarray] = {}
#: Paths of at most so many marks are remembered by their marks, longer ones know for each slot where it was marked last.
_SHORT = 64


def _last_marked(path: htmlblocks.Path) -> np.ndarray:
    """For each slot the place of its last mark on the path, from 0, or -1; every element copies what its parent knows."""
    way = []
    at = path
    while at is not None and at.last is None:
        way.append(at)
        at = at.parent
    for node in reversed(way):
        last = np.full(PATH_DIM, -1, np.int32) if node.parent is None else node.parent.last.copy()
        for k, mark in enumerate(node.own):
            last[_slot(mark)] = node.size - len(node.own) + k
        node.last = last
    return path.last


def path_vector(path: htmlblocks.Path | None) -> np.ndarray:
    """Hashed marks of a path; nearer to the leaf counts more."""
    if path is None:
        return np.zeros(PATH_DIM, np.float32)
    if path.size > _SHORT:
        last = _last_marked(path)
        return np.where(last < 0, 0.0, 1.0 / (1 + 0.15 * (path.size - 1 - last))).astype(np.float32)
    marks = tuple(path.marks())
    v = _paths.get(marks)
    if v is None:
        v = np.zeros(PATH_DIM, np.float32)
        for back, mark in enumerate(reversed(marks)):
            k = _slot(mark)
            v[k] = max(v[k], 1.0 / (1 + 0.15 * back))
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[marks] = v
    return v


def vectors(found: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block, over the blocks' whole texts; `first` and `total` place a segment in its page."""
    if not found:
        return np.zeros((0, INPUT), np.float32)
    texts = pa.array([b.text for b in found], pa.large_string())
    data, offsets = wb.text_bytes(texts)
    starts, ends, bounds = wb.word_spans(data, offsets)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(found)), n_words)
    bucket = (wb.spans_hash(data, starts, ends) % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.bincount(owner * WORD_DIM + bucket, minlength=len(found) * WORD_DIM).reshape(-1, WORD_DIM) / np.maximum(n_words, 1)[:, None]
    size = np.array([len(b.text) for b in found])
    stops = np.concatenate([[0], np.cumsum(np.isin(data, [33, 46, 63]))])
    out = np.zeros((len(found), INPUT), np.float32)
    out[:, :PATH_DIM] = [path_vector(b.path) for b in found]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = words
    k = PATH_DIM + WORD_DIM
    out[:, k] = np.log1p(n_words) / 5
    out[:, k + 1] = [b.link_chars / max(1, len(b.text)) for b in found]
    out[:, k + 2] = np.minimum(1, (stops[offsets[1:]] - stops[offsets[:-1]]) / np.maximum(n_words, 1) * 5)
    out[:, k + 3] = [b.path is not None and any(m in _HEADS for m in b.path.marks(4)) for b in found]
    out[:, k + 4] = np.minimum(1, size / np.maximum(1, n_words) / 12)
    out[:, k + 5] = np.arange(first, first + len(found)) / max(1, total or len(found))
    out[:, k + 6] = 1
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """w: input to 4 gates, u: state to 4 gates, b: bias, for each direction; v and c: both states to a score."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def fresh(cls, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"w{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
            p[f"u{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["v"], p["c"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
        return cls(p)

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Labeller:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float64) for k in cls.NAMES})

    def _states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: pages x blocks x INPUT, padded at the end; states in block order for direction d."""
        pages, steps, _ = x.shape
        gates_in = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out = np.zeros((pages, steps, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_in[:, t] + h @ self.p[f"u{d}"]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, c_new, c)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._states(x, mask, "f"), self._states(x, mask, "b")], axis=2)
        return sigmoid(both @ self.p["v"] + self.p["c"])

    def long_scores(self, found: list[Block], segment: int = 4096) -> np.ndarray:
        """The scores of one page of very many blocks. Vectors and gates are made a segment at a time, once in each direction, and a state goes into its block's score at once, so memory grows by 8 bytes a block."""
        score = np.full(len(found), self.p["c"][0])
        cuts = range(0, len(found), segment)
        for d, part in (("f", self.p["v"][:HIDDEN]), ("b", self.p["v"][HIDDEN:])):
            w, u, bias = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
            h, c = np.zeros(HIDDEN), np.zeros(HIDDEN)
            for at in cuts if d == "f" else reversed(cuts):
                gates = vectors(found[at : at + segment], at, len(found)).astype(np.float64) @ w + bias
                states = np.empty((len(gates), HIDDEN))
                for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
                    z = h @ u
                    z += gates[t]
                    s = 1 / (1 + np.exp(-z[: 3 * HIDDEN]))
                    c = s[HIDDEN : 2 * HIDDEN] * c + s[:HIDDEN] * np.tanh(z[3 * HIDDEN :])
                    h = states[t] = s[2 * HIDDEN :] * np.tanh(c)
                score[at : at + segment] += states @ part
        return sigmoid(score)

    def label(self, pages: list[list[Block]], long: int = 4096) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length share a batch, those of more than `long` blocks are read by segments."""
        out: list[np.ndarray] = [self.long_scores(p) > 0.5 if len(p) > long else np.zeros(0, bool) for p in pages]
        order = sorted((i for i in range(len(pages)) if 0 < len(pages[i]) <= long), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and len(pages[order[to]]) <= 1.2 * len(pages[order[at]]) + 4:
                to += 1
            some = order[at:to]
            lengths = np.array([len(pages[i]) for i in some])
            x = np.zeros((len(some), lengths.max(), INPUT))
            for k, i in enumerate(some):
                x[k, : lengths[k]] = vectors(pages[i])
            mask = np.arange(lengths.max())[None] < lengths[:, None]
            score = self.scores(x, mask)
            for k, i in enumerate(some):
                out[i] = score[k, : lengths[k]] > 0.5
            at = to
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over blocks and its gradients, by backpropagation through both directions."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self._states(x, mask, d, kept[d]) for d in "fb"], axis=2)
        score = sigmoid(both @ self.p["v"] + self.p["c"])
        n = mask.sum()
        loss = -(np.where(y, np.log(score + 1e-9), np.log(1 - score + 1e-9)) * mask).sum() / n
        err = (score - y) * mask / n
        grads = {"v": np.einsum("pt,pth->h", err, both), "c": np.array([err.sum()])}
        for d, part in (("f", self.p["v"][:HIDDEN]), ("b", self.p["v"][HIDDEN:])):
            gates = np.zeros((*x.shape[:2], 4 * HIDDEN))
            gu = np.zeros_like(self.p[f"u{d}"])
            dh = dc = np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[d]):
                dh = dh + err[:, t, None] * part
                dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
                dcm = dcm + dhm * o * (1 - tanh**2)
                z = np.concatenate([dcm * g * i * (1 - i), dcm * c * f * (1 - f), dhm * tanh * o * (1 - o), dcm * i * (1 - g**2)], axis=1)
                gates[:, t] = z
                gu += h.T @ z
                dh, dc = np.where(m, z @ self.p[f"u{d}"].T, dh), np.where(m, dcm * f, dc)
            grads[f"w{d}"], grads[f"u{d}"], grads[f"b{d}"] = np.einsum("pti,ptg->ig", x, gates, optimize=True), gu, gates.sum(axis=(0, 1))
        return loss, grads


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = 6, rate: float = 0.01, batch: int = 32, seed: int = 5) -> Labeller:
    model = Labeller.fresh(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    ready = [(vectors(b), y) for b, y in pages]
    ready.sort(key=lambda r: len(r[1]))
    groups = [ready[i : i + batch] for i in range(0, len(ready), batch)]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            group = groups[k]
            most = max(len(y) for _, y in group)
            x, y, mask = np.zeros((len(group), most, INPUT)), np.zeros((len(group), most)), np.zeros((len(group), most), bool)
            for i, (v, labels) in enumerate(group):
                x[i, : len(v)], y[i, : len(v)], mask[i, : len(v)] = v, labels, True
            # Marks drop out, so that no single one is relied on.
            x[:, :, :PATH_DIM] *= rng.random((len(group), 1, PATH_DIM)) > 0.06
            _, grads = model.gradients(x, mask, y)
            step += 1
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = model.p[name] - rate * (0.3 if epoch >= epochs - 2 else 1) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def main() -> None:
    from lexilink.llm.pagemaker import make_pages

    model = train([(found, labels) for found, labels, _ in make_pages(3000, seed=11)])
    held = make_pages(400, seed=99)
    right = sum(int((a == y).sum()) for a, (_, y, _) in zip(model.label([f for f, _, _ in held]), held, strict=True))
    print("held-out blocks right:", right / sum(len(y) for _, y, _ in held))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in model.p.items()})


if __name__ == "__main__":
    main()
