"""A small byte-level convolutional network in numpy: embedding, filters, chunk pooling, one probability.

Bytes are embedded; filters of WIDTH bytes slide over the whole text with STRIDE; cells of CELL bytes are max-pooled,
and overlapping chunks of CHUNK cells (one cell shared with the next chunk) take the maximum of their cells. A chunk's
vector, with the number of its bytes (few bytes have few maxima to choose from), passes a hidden layer; the maximum and the mean over all chunks make the logit.
"""

from dataclasses import dataclass, field

import numpy as np

WIDTH, STRIDE, CELL, CHUNK = 8, 2, 128, 4
DIM, FILTERS, HIDDEN = 8, 32, 16
_HOP = CHUNK - 1
_PER_CELL = CELL // STRIDE
#: Rows of a matrix product; larger ones wake a pool of threads that takes longer to wake than to work.
_ROWS = 512


@dataclass
class Net:
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(seed: int) -> "Net":
        r = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        e = normal(257, DIM, scale=0.5)
        e[256] = 0
        return Net(
            {
                "embed": e,
                "filters": normal(WIDTH * DIM, FILTERS, scale=0.25),
                "bias": np.zeros(FILTERS, np.float32),
                "hidden": normal(FILTERS + 2, HIDDEN, scale=0.3),
                "hidden_bias": np.zeros(HIDDEN, np.float32),
                "out": normal(2 * HIDDEN, scale=0.3),
                "out_bias": np.zeros(1, np.float32),
            }
        )


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers of all texts, each behind WIDTH fillers (256), so that no filter reaches the next text, and filled up to whole cells; cells of each."""
    cells = np.array([-(-(len(t) + WIDTH) // CELL) for t in texts], np.int64)
    flat = np.full(int(cells.sum()) * CELL + WIDTH, 256, np.int16)
    at = 0
    for t, n in zip(texts, cells.tolist()):
        flat[at + WIDTH : at + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
        at += n * CELL
    return flat, cells


def _windows(flat: np.ndarray, embed: np.ndarray) -> np.ndarray:
    e = embed[flat]
    n = (len(flat) - WIDTH) // STRIDE
    view = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STRIDE * DIM * e.itemsize, e.itemsize), writeable=False)
    return view


def cell_maxima(p: dict, flat: np.ndarray, where: bool = False):
    """Maximum of each filter in each cell; with ``where`` also the position that has it."""
    at = np.arange(0, (len(flat) - WIDTH), CELL)
    maxima = np.empty((len(at), FILTERS), np.float32)
    places = np.empty((len(at), FILTERS), np.int64) if where else None
    step = 256
    for lo in range(0, len(at), step):
        hi = min(len(at), lo + step)
        view = _windows(flat[lo * CELL : hi * CELL + WIDTH], p["embed"])
        out = np.empty((len(view), FILTERS), np.float32)
        for a in range(0, len(view), _ROWS):
            np.matmul(view[a : a + _ROWS], p["filters"], out=out[a : a + _ROWS])
        out = out.reshape(hi - lo, _PER_CELL, FILTERS)
        if where:
            k = out.argmax(axis=1)
            places[lo:hi] = k + (np.arange(lo, hi) * _PER_CELL)[:, None]
            maxima[lo:hi] = np.take_along_axis(out, k[:, None, :], 1)[:, 0]
        else:
            maxima[lo:hi] = out.max(axis=1)
    return maxima, places


def chunk_starts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last cell (exclusive) of each chunk, and the first chunk of each text."""
    n = np.maximum(1, -(-(cells - 1) // _HOP))
    base = np.cumsum(cells) - cells
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(cells)), n)
    start = base[own] + _HOP * (np.arange(len(own)) - first[own])
    stop = np.minimum(start + CHUNK, base[own] + cells[own])
    return start, stop, first


def fill(texts: list[bytes], cells: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bytes in each chunk, as two inputs of the hidden layer."""
    n = np.maximum(1, -(-(cells - 1) // _HOP))
    base = np.repeat(np.cumsum(cells) - cells, n)
    size = np.repeat(np.fromiter(map(len, texts), np.int64, len(texts)), n)
    held = np.maximum(0, np.minimum((stop - base) * CELL, size) - (start - base) * CELL)
    return np.stack([held / (CHUNK * CELL), np.log1p(held) / 6], axis=1).astype(np.float32)


def _pool(maxima, start, stop):
    rows = np.minimum(start[:, None] + np.arange(CHUNK), stop[:, None] - 1)
    return maxima[rows], rows


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """Logit of each text."""
    if not texts:
        return np.zeros(0, np.float32)
    p = net.params
    flat, cells = packed(texts)
    maxima, _ = cell_maxima(p, flat)
    start, stop, first = chunk_starts(cells)
    z = np.maximum(_pool(maxima, start, stop)[0].max(axis=1) + p["bias"], 0)
    z = np.hstack([z, fill(texts, cells, start, stop)])
    h = np.tanh(z @ p["hidden"] + p["hidden_bias"])
    n = np.diff(np.append(first, len(h)))
    doc = np.hstack([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]])
    return doc @ p["out"] + p["out_bias"]


def gradients(net: Net, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
    """Mean weighted log loss and its gradients."""
    p = net.params
    flat, cells = packed(texts)
    maxima, places = cell_maxima(p, flat, where=True)
    start, stop, first = chunk_starts(cells)
    pooled, rows = _pool(maxima, start, stop)
    k = pooled.argmax(axis=1)
    pre = np.take_along_axis(pooled, k[:, None, :], 1)[:, 0] + p["bias"]
    z = np.hstack([np.maximum(pre, 0), fill(texts, cells, start, stop)])
    h = np.tanh(z @ p["hidden"] + p["hidden_bias"])
    n = np.diff(np.append(first, len(h)))
    own = np.repeat(np.arange(len(texts)), n)
    top = np.maximum.reduceat(h, first)
    doc = np.hstack([top, np.add.reduceat(h, first) / n[:, None]])
    prob = 1 / (1 + np.exp(-(doc @ p["out"] + p["out_bias"])))
    loss = -np.mean(weights * np.log(np.where(labels == 1, prob, 1 - prob) + 1e-7))

    d = (weights * (prob - labels) / len(texts)).astype(np.float32)
    g = {"out": doc.T @ d, "out_bias": d.sum(keepdims=True)}
    d_doc = d[:, None] * p["out"]
    is_top = h == top[own]
    dh = np.where(is_top, d_doc[own, :HIDDEN], 0) + d_doc[own, HIDDEN:] / n[own][:, None]
    du = dh * (1 - h * h)
    g["hidden"], g["hidden_bias"] = z.T @ du, du.sum(0)
    dz = (du @ p["hidden"][:FILTERS].T) * (pre > 0)
    g["bias"] = dz.sum(0)
    cell = np.take_along_axis(rows, k, 1)
    place = np.take_along_axis(places, cell, 0)
    i, f = np.nonzero(dz)
    dv, at = dz[i, f], place[i, f] * STRIDE
    taps = flat[at[:, None] + np.arange(WIDTH)]
    seen = p["embed"][taps].reshape(len(at), -1)
    g["filters"] = np.zeros_like(p["filters"])
    order = np.argsort(f, kind="stable")
    cuts = np.searchsorted(f[order], np.arange(FILTERS + 1))
    de = np.empty((len(at), WIDTH * DIM), np.float32)
    for q in range(FILTERS):
        w = order[cuts[q] : cuts[q + 1]]
        g["filters"][:, q] = dv[w] @ seen[w]
        de[w] = dv[w][:, None] * p["filters"][:, q]
    de, at = de.reshape(-1, DIM), taps.ravel()
    g["embed"] = np.stack([np.bincount(at, de[:, k], len(p["embed"])) for k in range(DIM)], axis=1).astype(np.float32)
    g["embed"][256] = 0
    return float(loss), g


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11, epochs: int = 10, batch: int = 32, rate: float = 0.004, balance: float = 1.0) -> Net:
    """Adam over shuffled batches; each class weighs as much as the other to the power ``balance``. A lone class gives a constant."""
    net = Net.start(seed)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    s = {k: np.zeros_like(v) for k, v in net.params.items()}
    share = np.clip(np.array([np.mean(labels == 0), np.mean(labels == 1)]), 1e-3, 1) if len(labels) else np.ones(2)
    class_weight = (0.5 / share) ** balance
    t, total = 0, max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), batch):
            i = order[a : a + batch]
            _, g = gradients(net, [texts[j] for j in i], labels[i], class_weight[labels[i]])
            t += 1
            lr = rate * (1 - t / (total + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, v in g.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                net.params[k] = (net.params[k] - lr * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    return net
