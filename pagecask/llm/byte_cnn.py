"""A byte convolutional network in numpy: multi-width filters, max pooling, softmax.

Text is cut into blocks of ``BLOCK`` bytes.  Filters of several widths slide
over the bytes' embeddings with a stride, each filter's maximum over a block is
kept, and a window (two neighbouring blocks) is classified from the larger of
the two maxima.  So neighbouring windows overlap without computing a filter
twice.  All widths are one matrix product: narrow filters are padded by zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 32
STRIDE = 2
WIDTHS = (2, 4, 6)
FILTERS = 14
EMBED = 8
REACH = max(WIDTHS)
PLACES = BLOCK // STRIDE
#: Blocks convolved at once, so that the patches stay in the processor's cache.
CHUNK = 1024


@dataclass
class ByteCnn:
    classes: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 is padding
    filters: np.ndarray  # REACH * EMBED x filters
    bias: np.ndarray
    dense: np.ndarray  # filters x classes
    shift: np.ndarray

    def block_features(self, blocks: np.ndarray) -> np.ndarray:
        """blocks: n x (BLOCK + REACH - STRIDE) bytes -> n x filters maxima."""
        out = np.empty((len(blocks), self.filters.shape[1]), np.float32)
        for k in range(0, len(blocks), CHUNK):
            out[k : k + CHUNK] = (patches(self.embed, blocks[k : k + CHUNK]) @ self.filters).reshape(-1, PLACES, out.shape[1]).max(1)
        return np.maximum(out + self.bias, 0)

    def log_probs(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.dense + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def patches(embed: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """n * PLACES rows: the embeddings of REACH bytes at each place."""
    e = embed[blocks].reshape(len(blocks), -1)
    view = np.lib.stride_tricks.as_strided(
        e, (len(blocks), PLACES, REACH * EMBED), (e.strides[0], STRIDE * EMBED * e.itemsize, e.itemsize)
    )
    return view.reshape(-1, REACH * EMBED)


def filter_mask() -> np.ndarray:
    """Which weights exist: a filter of width w has none beyond w bytes."""
    mask = np.zeros((REACH * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def cut(data: bytes, width: int = BLOCK) -> np.ndarray:
    """The blocks of one text; each reaches into the next, the last is padded."""
    n = max(1, -(-len(data) // width))
    padded = np.zeros(n * width + REACH, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, width + REACH - STRIDE)[::width][:n]


def train(windows: list[bytes], labels: np.ndarray, classes: list[str], *, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 7) -> ByteCnn:
    """Adam on cross entropy. A window is at most two blocks long."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), 2, BLOCK + REACH - STRIDE), np.uint8)
    two = np.zeros(len(windows), bool)
    for k, w in enumerate(windows):
        blocks = cut(w)[:2]
        x[k, : len(blocks)] = blocks
        two[k] = len(blocks) == 2
    mask = filter_mask()
    n_f = mask.shape[1]
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": (rng.normal(0, 1, mask.shape) / np.sqrt(mask.sum(0)) * mask).astype(np.float32),
        "bias": np.zeros(n_f, np.float32),
        "dense": rng.normal(0, 0.1, (n_f, len(classes))).astype(np.float32),
        "shift": np.zeros(len(classes), np.float32),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        lr = rate * (1 - epoch / epochs) + rate * 0.05
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            blocks = x[own].reshape(-1, x.shape[2])
            cols = patches(p["embed"], blocks)
            conv = (cols @ p["filters"]).reshape(len(own), 2, PLACES, n_f)
            conv[~two[own], 1] = -1e9  # no second block
            flat = conv.reshape(len(own), 2 * PLACES, n_f)
            where = flat.argmax(1)
            top = np.take_along_axis(flat, where[:, None], 1)[:, 0] + p["bias"]
            feat = np.maximum(top, 0)
            z = feat @ p["dense"] + p["shift"]
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            g = prob
            g[np.arange(len(own)), labels[own]] -= 1
            g /= len(own)
            grad = {"dense": feat.T @ g, "shift": g.sum(0)}
            d = (g @ p["dense"].T) * (top > 0)
            grad["bias"] = d.sum(0)
            rows = (np.arange(len(own))[:, None] * 2 * PLACES + where).ravel()  # the places that won
            f = np.tile(np.arange(n_f), len(own))
            flat_d = d.ravel()
            won = cols[rows]
            grad["filters"] = np.zeros_like(p["filters"])
            for k in range(n_f):
                sel = slice(k, None, n_f)
                grad["filters"][:, k] = flat_d[sel] @ won[sel]
            grad["filters"] *= mask
            back = (p["filters"].T[f] * flat_d[:, None]).reshape(-1, REACH, EMBED)
            start = (rows // PLACES) * blocks.shape[1] + (rows % PLACES) * STRIDE
            bytes_at = blocks.ravel()[start[:, None] + np.arange(REACH)]
            grad["embed"] = np.stack([np.bincount(bytes_at.ravel(), back[:, :, j].ravel(), 256) for j in range(EMBED)], 1).astype(np.float32)
            grad["embed"][0] = 0
            step += 1
            for k in p:
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    p["embed"][0] = 0
    return ByteCnn(classes, **{k: np.ascontiguousarray(w, np.float32) for k, w in p.items()})
