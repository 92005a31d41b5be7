"""A small causal self-attention language model in numpy: forward, backward, Adam.

One layer of one-head attention with a residual, over windows of T ids. The output is a
two-level softmax: ids are sorted by their bytes and cut into GROUPS groups of MEMBERS, so the
probability of an id is that of its group times that of its place in the group, both from the
same state. There are as many groups as members; the table is as large as the ids in use need, up
to GROUPS, which holds every id of the tokenizer.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

T, STRIDE, D = 32, 16, 32
#: At most; GROUPS * MEMBERS is over the tokenizer's 50,257 ids.
GROUPS = MEMBERS = 225
SLOTS = GROUPS * MEMBERS
#: Windows of a batch: bounds the memory of the forward pass.
BATCH = 512
#: Windows that go through attention at once, and places through a softmax.
WINDOWS, PLACES = 32, 512
#: Rows of a block of a long product.
BLOCK = 256
#: An id of more places in a batch is summed by itself.
OFTEN = 16
#: Parameters that Adam takes at once.
CELLS = 1 << 13
#: A mean of gradients, or of their squares, is exact down to a ten millionth of this.
TINY = np.float32(1e-25)
_CAUSAL = np.where(np.tri(T, dtype=bool), 0.0, -1e9).astype(np.float32)


def shapes(g: int) -> dict[str, tuple[int, ...]]:
    """Name -> shape of the parameters with g groups of g members."""
    return {"e": (g * g, D), "pos": (T, D), "q": (D, D), "k": (D, D), "v": (D, D), "o": (D, D), "gw": (D, g), "gb": (g,), "mw": (g, D, g), "mb": (g, g)}


def size(g: int) -> int:
    return sum(math.prod(s) for s in shapes(g).values())


SIZE = size(GROUPS)
_groups = {size(g): g for g in range(1, GROUPS + 1)}

Params = dict[str, np.ndarray]


def unpack(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for name, shape in shapes(_groups[len(flat)]).items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(slot_counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Initial parameters; output biases begin at the ids' own frequencies."""
    r = np.random.default_rng(seed)
    groups = math.isqrt(len(slot_counts))
    flat = (r.standard_normal(size(groups)) * 0.1).astype(np.float32)
    p = unpack(flat)
    c = (slot_counts + 0.5).reshape(groups, groups)
    p["gb"][:] = np.log(c.sum(axis=1) / c.sum())
    p["mb"][:] = np.log(c / c.sum(axis=1, keepdims=True))
    return flat


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, mask), each windows x T, of a sequence whose first id is only context.

    Windows overlap by T - STRIDE ids; each target is scored in exactly one window: the first
    scores all of its own, a later one only the STRIDE targets that no earlier window has.
    """
    n = len(ids) - 1
    count = 1 if n <= T else 1 + -(-(n - T) // STRIDE)
    at = (np.arange(count) * STRIDE)[:, None] + np.arange(T)
    inside = at < n
    at = np.minimum(at, n - 1)
    mask = inside.copy()
    mask[1:, : T - STRIDE] = False
    return ids[at], ids[at + 1], mask


def training_windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same side by side: each target once, with whatever is before it in its window."""
    n = len(ids) - 1
    at = (np.arange(-(-n // T)) * T)[:, None] + np.arange(T)
    inside = at < n
    at = np.minimum(at, n - 1)
    return ids[at], ids[at + 1], inside


def forward(p: Params, x: np.ndarray) -> tuple:
    """States (windows x T x D) and what backward needs."""
    r = {name: np.empty((*x.shape, n), dtype=p["e"].dtype) for name, n in _ROOM.items()}
    _attend(p, _qkv(p), x, r)
    return r["state"], (r["h"], *_thirds(r["qkv"]), r["s"], r["a"])


#: What attention keeps of each place for the way back, and how many numbers of it.
_ROOM = {"h": D, "qkv": 3 * D, "s": T, "a": D, "state": D}


@lru_cache(maxsize=1)
def _room(windows: int, dtype: np.dtype) -> dict[str, np.ndarray]:
    """Memory that every batch of training uses again: arrays of this size would go back to the system after each, page by page."""
    return {name: np.empty((windows, T, n), dtype=dtype) for name, n in {**_ROOM, "sorted": D, "ds": D}.items()}


def _attend(p: Params, qkv: np.ndarray, x: np.ndarray, r: dict[str, np.ndarray]) -> None:
    """Attention of some windows, written into r; q comes out times D ** -0.5."""
    h, s, a, state = r["h"], r["s"], r["a"], r["state"]
    np.take(p["e"], x, axis=0, out=h, mode="clip")
    h += p["pos"]
    np.matmul(h, qkv, out=r["qkv"])
    q, k, v = _thirds(r["qkv"])
    np.matmul(q, _turned(k), out=s)
    _moderate(s, _CAUSAL)
    np.exp(s, out=s)
    s *= (1 / _row_sums(s))[..., None]
    np.matmul(s, v, out=a)
    np.matmul(a, p["o"], out=state)
    state += h


def _rows(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, D)


def _turned(m: np.ndarray) -> np.ndarray:
    """Each window's matrix transposed, in memory of its own: a product with that is twice as fast as one with a view."""
    return np.ascontiguousarray(m.transpose(0, 2, 1))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b over the rows of both, by blocks that the library multiplies without copying them first."""
    n = len(a) // BLOCK * BLOCK
    some, more = (m[:n].reshape(-1, BLOCK, m.shape[1]) for m in (a, b))
    return np.matmul(some.transpose(0, 2, 1), more).sum(axis=0) + a[n:].T @ b[n:]


def _thirds(m: np.ndarray) -> tuple[np.ndarray, ...]:
    return m[..., :D], m[..., D : 2 * D], m[..., 2 * D :]


def _qkv(p: Params) -> np.ndarray:
    """q (times D ** -0.5), k and v side by side."""
    return np.concatenate([p["q"] * p["q"].dtype.type(D**-0.5), p["k"], p["v"]], axis=1)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[-1], dtype=z.dtype)


def _moderate(z: np.ndarray, plus: np.ndarray | None = None) -> np.ndarray:
    """z (and plus) less the greatest of each row where any number is so large or small that exp could leave its range; in place."""
    far = z.max(initial=0) > 60 or z.min(initial=0) < -60
    if plus is not None:
        z += plus
    if far:
        z -= z.max(axis=-1, keepdims=True)
    return z


def _losses(z: np.ndarray, target: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Sum over rows of the negative log-softmax at the targets, and its derivative by z over n; z is overwritten."""
    rows = np.arange(len(z))
    z = _moderate(z)
    got = z[rows, target]
    d = np.exp(z, out=z)
    sums = _row_sums(d)
    d *= (1 / (n * sums))[:, None]
    d[rows, target] -= 1 / n
    return float((np.log(sums) - got).sum(dtype=np.float64)), d


def prepare(flat: np.ndarray) -> Params:
    """Parameters for scoring: products of matrices that follow one another are taken once."""
    p = unpack(flat)
    return p | {"qk": (p["q"] @ p["k"].T) * np.float32(D**-0.5), "vo": p["v"] @ p["o"]}


def log_probs(p: Params, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Natural log of P(target's slot) of the masked places, in order. p comes from prepare().

    The same numbers as from forward(), with fewer passes over memory: softmax sums are divided
    out at the end, and only the targets' logits are kept.
    """
    state = np.empty((*x.shape, D), dtype=p["e"].dtype)
    whole = mask[:, : T - STRIDE].any(axis=1)
    for which, first in ((np.flatnonzero(whole), 0), (np.flatnonzero(~whole), T - STRIDE)):  # later windows are asked for their last places only
        for at in range(0, len(which), WINDOWS):
            rows = which[at : at + WINDOWS]
            h = np.take(p["e"], x[rows], axis=0, mode="clip")
            h += p["pos"]
            last = h[:, first:]
            s = np.matmul(np.matmul(last, p["qk"]), _turned(h))
            s = _moderate(s, _CAUSAL[first:])
            np.exp(s, out=s)
            asked = np.matmul(s, h)
            asked *= (1 / _row_sums(s))[..., None]
            state[rows, first:] = np.matmul(asked, p["vo"]) + last
    slot, groups = y[mask], len(p["gb"])
    order = np.argsort((slot // groups).astype(np.uint8), kind="stable")  # by groups, so that each is a slice
    slot = slot[order]
    group, member = np.divmod(slot, groups)
    state = np.take(_rows(state), np.flatnonzero(mask)[order], axis=0, mode="clip")
    got = np.empty(len(slot), dtype=np.float64)
    for at in range(0, len(slot), PLACES):
        part = slice(at, at + PLACES)
        got[part] = _log_softmax(state[part] @ p["gw"], p["gb"], group[part])
    bounds = np.searchsorted(group, np.arange(groups + 1)).tolist()
    for g in range(groups):
        for at in range(bounds[g], bounds[g + 1], PLACES):
            part = slice(at, min(at + PLACES, bounds[g + 1]))
            got[part] += _log_softmax(state[part] @ p["mw"][g], p["mb"][g], member[part])
    out = np.empty(len(slot), dtype=np.float64)
    out[order] = got
    return out


def _log_softmax(z: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-softmax of z + bias at the targets, one a row; z is overwritten."""
    z += bias
    z = _moderate(z)
    got = z[np.arange(len(z)), target]
    return got - np.log(_row_sums(np.exp(z, out=z)))


def gradient(p: Params, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the masked targets and its gradient, flat.

    Attention goes over WINDOWS windows at a time and the softmax over groups over PLACES places, so
    that what they touch stays near the processor.
    """
    groups, dtype = len(p["gb"]), p["e"].dtype
    room, flat = _room(max(BATCH, len(x)), dtype), np.zeros(size(groups), dtype=dtype)
    g, qkv = unpack(flat), _qkv(p)
    parts = [slice(at, min(at + WINDOWS, len(x))) for at in range(0, len(x), WINDOWS)]
    for part in parts:
        _attend(p, qkv, x[part], {name: room[name][part] for name in _ROOM})
    full = room["state"][: len(x)]
    slot = y[mask]
    order = np.argsort((slot // groups).astype(np.uint8), kind="stable")  # by groups, so that each is a slice
    slot, place = slot[order], np.flatnonzero(mask)[order]
    n = max(1, len(slot))
    state, ds = (_rows(room[name])[: len(slot)] for name in ("sorted", "ds"))
    np.take(_rows(full), place, axis=0, out=state, mode="clip")
    group, member = np.divmod(slot, groups)
    loss = 0.0
    for at in range(0, len(slot), PLACES):
        part = slice(at, at + PLACES)
        loss += _back(state[part], p["gw"], p["gb"], group[part], n, g["gw"], g["gb"], ds[part], False)
    bounds = np.searchsorted(group, np.arange(groups + 1)).tolist()
    for i in range(groups):
        for at in range(bounds[i], bounds[i + 1], PLACES):
            part = slice(at, min(at + PLACES, bounds[i + 1]))
            loss += _back(state[part], p["mw"][i], p["mb"][i], member[part], n, g["mw"][i], g["mb"][i], ds[part], True)
    if len(place) < x.size:
        full[:] = 0
    _rows(full)[place] = ds  # from here on the derivative by the states
    o, qkv, dqkv = p["o"].T.copy(), qkv.T.copy(), np.zeros((D, 3 * D), dtype=dtype)
    within = np.empty((WINDOWS, T, 3 * D), dtype=dtype)
    for part in parts:
        h, qkvs, s, a, dh = (room[name][part] for name in _ROOM)
        g["o"] += _cross(_rows(a), _rows(dh))
        inner = within[: len(h)]  # by q, k and v
        q, k, v = _thirds(qkvs)
        da = np.matmul(dh, o)
        dsm = np.matmul(da, _turned(v))
        dsm -= _row_sums(np.multiply(da, a, out=a))[..., None]  # the sum over j of dsm and s
        dsm *= s
        dq, dk, dv = _thirds(inner)
        np.matmul(dsm, k, out=dq)
        np.matmul(dsm.transpose(0, 2, 1), q, out=dk)
        np.matmul(s.transpose(0, 2, 1), da, out=dv)
        dqkv += _cross(_rows(h), inner.reshape(-1, 3 * D))
        dh += np.matmul(inner, qkv)
    g["q"][:], g["k"][:], g["v"][:] = _thirds(dqkv)
    g["q"] *= dtype.type(D**-0.5)
    np.matmul(np.ones(len(x), dtype=dtype), full.reshape(len(x), -1), out=g["pos"].reshape(-1))
    _sums_by(x.reshape(-1), _rows(full), g["e"])
    return float(loss) / n, flat


def _back(state: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, n: int, gw: np.ndarray, gb: np.ndarray, ds: np.ndarray, more: bool) -> float:
    """The loss of one softmax over state @ w + b; its derivatives are added to gw and gb, and to ds if more, which they replace if not."""
    z = state @ w
    z += b
    loss, d = _losses(z, target, n)
    gw += state.T @ d
    gb += _row_sums(d.T)
    if more:
        ds += d @ w.T
    else:
        np.matmul(d, w.T, out=ds)
    return loss


def _sums_by(ids: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """into[i] becomes the sum of the rows of id i, for each id there is: frequent ids one by one, all others by their first row, their second and so on."""
    ids = ids.astype(np.uint16)  # SLOTS at most; sorted by digits
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], np.take(rows, order, axis=0, mode="clip")
    first = np.flatnonzero(np.diff(ids.astype(np.int32), prepend=-1))
    times = np.diff(first, append=len(ids))
    by = np.argsort(-times, kind="stable")
    first, times = first[by], times[by]
    sums = np.empty((len(first), rows.shape[1]), dtype=rows.dtype)
    above = np.searchsorted(-times, -np.arange(OFTEN + 1)).tolist()  # how many ids have more rows than 0, 1, 2, ...
    often, ones = above[OFTEN], np.ones(len(ids), dtype=rows.dtype)
    for i, (at, n) in enumerate(zip(first[:often].tolist(), times[:often].tolist())):
        np.matmul(ones[:n], rows[at : at + n], out=sums[i])
    sums[often:] = rows[first[often:]]
    for k in range(1, OFTEN):
        sums[often : above[k]] += rows[first[often : above[k]] + k]
    into[ids[first]] = sums


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.flat, self.rate = flat.copy(), rate
        self.m, self.v, self.steps = np.zeros_like(flat), np.zeros_like(flat), 0
        self.some = np.empty(CELLS, dtype=flat.dtype)

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> float:
        loss, g = gradient(unpack(self.flat), x, y, mask)
        self.steps += 1
        fix = (1 - 0.98**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for at in range(0, len(g), CELLS):  # pieces that stay in the processor's memory
            part = slice(at, at + CELLS)
            d, m, v = g[part], self.m[part], self.v[part]
            some = self.some[: len(d)]
            np.multiply(d, 0.1, out=some)
            m *= 0.9
            m += some
            m += TINY  # numbers far below it become zero: they change no parameter, and steps with them are slow
            m -= TINY
            d *= d
            d *= 0.02
            v *= 0.98
            v += d
            v += TINY
            v -= TINY
            np.sqrt(v, out=some)
            some += 1e-6
            np.divide(m, some, out=some)
            some *= np.float32(self.rate * fix)
            self.flat[part] -= some
        return loss
