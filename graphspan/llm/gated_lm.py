"""A gated recurrent network over word tokens, in numpy.

The output softmax is factored by class. The most frequent words share `classes` classes of equal
size, each with a softmax over its words; every other word belongs to the class of its count's
power of two, within which it has its share of the counts. A word never seen is of a last class, in
which it is one of as many words as there are distinct words in training.
Biases start at the corpus counts, so training begins at the unigram model. Training is truncated
backpropagation through windows of `window` tokens with the state carried on; scoring carries it
through whole documents.
"""

from __future__ import annotations

import math

import numpy as np

BANDS = 63
_NAMES = ("emb", "wx", "bx", "u", "wc", "bc", "win", "bin")


class Vocabulary:
    """Which class and place each word has; hashes stand for words."""

    def __init__(self, top: list[tuple[int, int]], band_types: np.ndarray, band_tokens: np.ndarray, total: int, distinct: int, per_class: int = 32):
        self.total, self.distinct, self.per_class = total, distinct, per_class
        self.classes = max(1, -(-len(top) // per_class))
        hashes = np.array([h for h, _ in top], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], np.arange(len(top))[order]
        self.top_counts = np.array([c for _, c in top], np.float64)
        self.bands = max(1, int(np.max(np.flatnonzero(band_types), initial=-1)) + 1)  # up to the last that has words
        types, tokens = band_types[: self.bands].astype(np.float64), band_tokens[: self.bands].astype(np.float64)
        for c in self.top_counts:  # the bands are of the other words
            types[int(c).bit_length() - 1] -= 1
            tokens[int(c).bit_length() - 1] -= c
        self.band_mass = tokens + 0.1 * types
        self.band_tokens = np.maximum(tokens, 0)
        self.n_classes = self.classes + self.bands + 1
        self.inputs = self.classes * per_class + self.bands + 1

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input, class, log10 of the share within the class) of each token; 0 for frequent words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        frequent = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        place = self.place[at] if len(self.hashes) else np.zeros(len(hashes), np.int64)
        band = np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, self.bands)
        share = np.where(counts > 0, (counts + 0.1) / np.maximum(np.append(self.band_mass, 1.0)[band], 1e-9), 1.0 / (self.distinct + 1))
        inputs = np.where(frequent, place, self.classes * self.per_class + band)
        group = np.where(frequent, place // self.per_class, self.classes + band)
        return inputs, group, np.where(frequent, 0.0, np.log10(np.minimum(share, 1.0)))


def fresh(vocabulary: Vocabulary, embed: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """First weights: small random ones, biases at the logarithms of the counts."""
    draw = np.random.default_rng(seed).standard_normal
    v = vocabulary
    slots = np.full(v.classes * v.per_class, 1e-6)
    slots[: len(v.top_counts)] = v.top_counts
    within = slots.reshape(v.classes, v.per_class)
    unseen = 0.5 * max(1.0, v.band_tokens[0])  # words seen once stand for words not seen
    groups = np.concatenate((within.sum(axis=1), v.band_tokens + 1e-3, [unseen]))
    weights = {
        "emb": 0.3 * draw((v.inputs, embed)), "wx": draw((embed, 3 * hidden)) / math.sqrt(embed), "bx": np.zeros(3 * hidden),
        "u": draw((hidden, 3 * hidden)) / math.sqrt(hidden), "wc": 0.05 * draw((hidden, v.n_classes)), "bc": np.log(groups / groups.sum()),
        "win": 0.05 * draw((v.classes, hidden, v.per_class)), "bin": np.log(within / within.sum(axis=1, keepdims=True)),
    }
    return {k: x.astype(np.float32) for k, x in weights.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _NAMES])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in _NAMES:
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _gates(x: np.ndarray) -> np.ndarray:
    """Columns for update, reset and news as three tables, each of which lies together."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


_FEW = 8192


def _odds(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(h w + b) up to one factor, and its sums by row. No odds fall under e**-80 of the largest."""
    x = h @ w
    x += b
    x -= x.max(initial=-np.inf)
    if x.size < _FEW or x.min() < -80:  # of many entries the least is found sooner than all are compared
        np.maximum(x, -80, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of classes below `classes`, class by class, and where each class begins."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(classes + 1))
    return order[: cuts[-1]], cuts


def _token_logs(w: dict[str, np.ndarray], h: np.ndarray, inputs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token's class and, for frequent words, of the word in it."""
    classes, per = w["bin"].shape
    x, total = _odds(h, w["wc"], w["bc"])
    odds = x[np.arange(len(h)), group] / total
    order, cuts = _by_class(group, classes)
    mine, slot, within = h[order], (inputs - group * per)[order], np.empty(len(order), odds.dtype)
    for c, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            x, total = _odds(mine[a:b], w["win"][c], w["bin"][c])
            within[a:b] = x[np.arange(b - a), slot[a:b]] / total
    out = np.log(odds).astype(np.float64)
    out[order] += np.log(within)
    return out


def score(w: dict[str, np.ndarray], inputs: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log10 probability of classes and frequent words of each document; document d is tokens first[d]:first[d+1]."""
    hidden = w["u"].shape[0]
    table = _gates(w["emb"] @ w["wx"] + w["bx"])
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = first[:-1][order], lengths[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
    total = np.zeros(len(lengths))
    h = np.zeros((len(sizes), hidden), np.float32)
    states, tokens, owners, held = [], [], [], 0
    u = _gates(w["u"])
    for t, n in enumerate(active.tolist()):
        h = h[:n]
        at = starts[:n] + t
        states.append(h)
        tokens.append(at)
        owners.append(order[:n])
        held += n
        word = inputs[at]
        zr = np.matmul(h, u[:2])
        zr += table[:2].take(word, axis=1)
        z, r = _sigmoid(zr)
        new = h @ u[2]
        new *= r
        new += table[2].take(word, axis=0)
        np.tanh(new, out=new)
        z *= h - new
        h = new + z
        if held >= 32768 or t == len(active) - 1:
            own = np.concatenate(tokens)
            logs = _token_logs(w, np.concatenate(states), inputs[own], group[own])
            total += np.bincount(np.concatenate(owners), logs, len(total))
            states, tokens, owners, held = [], [], [], 0
    return total / math.log(10)


def train(
    w: dict[str, np.ndarray], vocabulary: Vocabulary, inputs: np.ndarray, group: np.ndarray, first: np.ndarray, seed: int,
    window: int = 16, streams: int = 256, rate: float = 0.01, unseen: np.ndarray | None = None, mass: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation over the documents, in seeded order, with Adam.

    The documents, one after the other, are cut into `streams` runs of equal length that advance
    together, a window at a time. The state goes on from window to window and begins anew with each
    document (and at the cuts, one a run). unseen marks tokens that stand for words not seen (half
    of those that occur once): as targets they take that class. mass weighs tokens (of rows that
    stand for several); by default each is one.
    """
    sizes = np.diff(first)
    order = np.random.default_rng(seed).permutation(len(sizes))
    begin = np.cumsum(sizes[order]) - sizes[order]
    n = int(sizes.sum())
    if not n:
        return {k: x.copy() for k, x in w.items()}
    group = np.where(unseen, vocabulary.n_classes - 1, group) if unseen is not None else group
    place = np.repeat(first[:-1][order] - begin, sizes[order]) + np.arange(n)
    width = max(1, min(streams, n // (32 * window)))  # a small chunk has updates enough, too
    steps = -(-n // width)
    spare = width * steps - n
    fresh = np.zeros(n + spare, bool)
    fresh[begin[sizes[order] > 0]] = True
    share = np.ones(n, np.float32) if mass is None else mass[place].astype(np.float32)
    grid = lambda x: np.ascontiguousarray(np.concatenate((x, x[:1].repeat(spare))).reshape(width, steps).T)
    token, target = grid(inputs[place].astype(np.int32)), grid(group[place].astype(np.int32))
    keep = 1 - np.ascontiguousarray(fresh.reshape(width, steps).T).astype(np.float32)
    share = np.ascontiguousarray(np.concatenate((share, np.zeros(spare, np.float32))).reshape(width, steps).T)
    theta = flat(w).astype(np.float32)
    own = _views(theta, w)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    h = np.zeros((width, w["u"].shape[0]), np.float32)
    for number, lo in enumerate(range(0, steps, window), 1):
        part = slice(lo, lo + window)
        grads, h = _window(own, token[part], target[part], keep[part], share[part], h)
        g = flat(grads)
        g *= min(1.0, 5.0 / max(float(np.sqrt(np.dot(g, g))), 1e-6))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        theta -= (rate / (1 - 0.9**number)) * m / (np.sqrt(v / (1 - 0.99**number)) + 1e-6)
    return shaped(theta, w)


def _views(theta: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The named weights as views into one vector."""
    out, at = {}, 0
    for k in _NAMES:
        out[k] = theta[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _window(w, token, target, keep, share, h):
    """Gradients of one window's mean loss, and the state after it.

    Arrays are (steps, streams): input and class of each token, 0 where a document begins (its
    state is zero there), and how much the token counts. h is the state before the window.
    """
    span, n = token.shape
    hidden, classes, per = w["u"].shape[0], w["bin"].shape[0], w["bin"].shape[1]
    u, kind = w["u"], w["u"].dtype
    gate = (w["emb"] @ w["wx"] + w["bx"]).take(token, axis=0)
    before, ahead, news = (np.empty((span, n, hidden), kind) for _ in range(3))
    gates = np.empty((span, n, 2 * hidden), kind)
    for t in range(span):
        h = h * keep[t][:, None]
        before[t] = h
        back = h @ u
        zr = _sigmoid(gate[t, :, : 2 * hidden] + back[:, : 2 * hidden])
        new = np.tanh(gate[t, :, 2 * hidden :] + zr[:, hidden:] * back[:, 2 * hidden :])
        gates[t], ahead[t], news[t] = zr, back[:, 2 * hidden :], new
        h = new + zr[:, :hidden] * (h - new)
    states, goal = before.reshape(-1, hidden), target.ravel()
    weight = (share.ravel() / max(1e-6, float(share.sum()))).astype(kind)
    d, total = _odds(states, w["wc"], w["bc"])
    d *= (weight / total)[:, None]
    d[np.arange(len(goal)), goal] -= weight
    g = {"wc": states.T @ d, "bc": np.ones(len(d), kind) @ d, "win": np.zeros_like(w["win"]), "bin": np.zeros_like(w["bin"])}
    down = d @ w["wc"].T
    word = token.ravel()
    order, cuts = _by_class(goal, classes)
    mine, heavy, slot = states[order], weight[order], (word - goal * per)[order]
    back_down = np.empty((cuts[-1], hidden), kind)
    for c, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a == b:
            continue
        e, total = _odds(mine[a:b], w["win"][c], w["bin"][c])
        e *= (heavy[a:b] / total)[:, None]
        e[np.arange(b - a), slot[a:b]] -= heavy[a:b]
        np.matmul(mine[a:b].T, e, out=g["win"][c])
        np.matmul(np.ones(b - a, kind), e, out=g["bin"][c])
        np.matmul(e, w["win"][c].T, out=back_down[a:b])
    down[order] += back_down
    down = down.reshape(span, n, hidden)
    into, within = np.empty((span, n, 3 * hidden), kind), np.empty((span, n, 3 * hidden), kind)
    dh = np.zeros((n, hidden), kind)
    for t in range(span - 1, -1, -1):
        z, r, new = gates[t, :, :hidden], gates[t, :, hidden:], news[t]
        dnew = dh * (1 - z) * (1 - new * new)
        into[t, :, :hidden] = dh * (before[t] - new) * z * (1 - z)
        into[t, :, hidden : 2 * hidden] = dnew * ahead[t] * r * (1 - r)
        into[t, :, 2 * hidden :] = dnew
        within[t, :, : 2 * hidden] = into[t, :, : 2 * hidden]
        within[t, :, 2 * hidden :] = dnew * r
        dh = (dh * z + within[t] @ u.T + down[t]) * keep[t][:, None]
    order = np.argsort(word.astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.diff(word[order], prepend=-1))
    sums = np.zeros((len(w["emb"]), 3 * hidden), kind)
    sums[word[order[at]]] = np.add.reduceat(into.reshape(-1, 3 * hidden)[order], at, axis=0)
    g |= {"emb": sums @ w["wx"].T, "wx": w["emb"].T @ sums, "bx": np.ones(len(sums), kind) @ sums, "u": states.T @ within.reshape(-1, 3 * hidden)}
    return g, h
