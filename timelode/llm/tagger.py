"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Each character enters as its class and as what the name lexicon says of its word. Arrays are (time, 2, batch,
width); the middle axis holds the two reading directions, so that one step of both is one small matrix product.
A tag is 0 (nothing) or begin, inside or end of a kind; transitions that would tear a mention apart are forbidden.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Character classes: printable ASCII in lower case, then classes of everything else.
_SPACE, _NEWLINE, _LETTER, _SIGN, _OTHER_DIGIT, _PAD = range(96, 102)
KINDS = 2 * 102
#: What the lexicon says of the word around a character: nothing, given name, family name, both.
FLAGS = 4
FORBIDDEN = -1e4


def _kind(code: int) -> int:
    c = chr(code)
    if c == "\n" or c == "\r":
        return 2 * _NEWLINE
    if 32 < code < 127:
        return 2 * (ord(c.lower()) - 32) + c.isupper() if c.isalpha() else 2 * (code - 32)
    if c.isspace():
        return 2 * _SPACE
    base = unicodedata.normalize("NFD", c)[0]
    if base != c and base.isascii() and base.isalpha():
        return 2 * (ord(base.lower()) - 32) + base.isupper()
    if c.isalpha():
        return 2 * _LETTER + c.isupper()
    return 2 * (_OTHER_DIGIT if c.isdigit() else _SIGN)


_TABLE: np.ndarray | None = None


def kinds(text: str) -> np.ndarray:
    """The character classes of a text, one per code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((_kind(c) for c in range(1 << 16)), np.int16, 1 << 16)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.where(codes > 0xFFFF, 0x2603, codes)]


PAD = FLAGS * 2 * _PAD


def begin(kind: int) -> int:
    return 3 * kind + 1


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The tag of each character; spans are (kind, start, end) of two characters or more."""
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        out[a:b] = begin(kind) + 1
        out[a], out[b - 1] = begin(kind), begin(kind) + 2
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each mention on a path that keeps to the transitions."""
    ends = np.nonzero((tags > 0) & (tags % 3 == 0))[0]
    starts = np.nonzero(tags % 3 == 1)[0]
    return [((int(tags[a]) - 1) // 3, int(a), int(b) + 1) for a, b in zip(starts, ends, strict=True)]


def allowed(tags: int) -> np.ndarray:
    """0 where one tag may follow another, else FORBIDDEN."""
    out = np.full((tags, tags), FORBIDDEN, np.float32)
    for last in (0, *range(3, tags, 3)):
        out[last, 0] = 0
        out[last, 1::3] = 0
    for b in range(1, tags, 3):
        out[b, b + 1] = out[b, b + 2] = out[b + 1, b + 1] = out[b + 1, b + 2] = 0
    return out


def initial(tags: int, *, embed: int = 24, hidden: int = 48, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def w(*shape: int) -> np.ndarray:
        return rng.standard_normal(shape) / np.sqrt(shape[-2])

    bias = np.zeros((2, 1, 4 * hidden))
    bias[:, :, hidden : 2 * hidden] = 1.0
    p = {
        "E": 0.5 * rng.standard_normal((KINDS, embed)), "G": 0.5 * rng.standard_normal((FLAGS, embed)), "W": w(2, embed, 4 * hidden), "U": w(2, hidden, 4 * hidden),
        "b": bias, "O": w(2 * hidden, tags), "o": np.zeros(tags), "T": 0.1 * rng.standard_normal((tags, tags)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


@np.errstate(over="ignore")
def _run(p: dict, x: np.ndarray, keep: bool):
    """Hidden states (time, 2, batch, hidden) in reading order; x (time, batch). Gates: input, forget, output, cell."""
    hidden = p["U"].shape[1]
    turn = -np.concatenate([np.ones(3 * hidden), np.full(hidden, 2.0)]).astype(p["U"].dtype)
    inputs = (p["E"][:, None] + p["G"]).reshape(KINDS * FLAGS, -1)
    table = (inputs @ p["W"] + p["b"]) * turn  # one exp for all gates: tanh(z) = 2 sigmoid(2 z) - 1
    u = p["U"] * turn
    steps, batch = x.shape
    hs = np.empty((steps, 2, batch, hidden), u.dtype)
    h, c = np.zeros((2, batch, hidden), u.dtype), np.zeros((2, batch, hidden), u.dtype)
    gates = np.empty((steps, 2, batch, 4 * hidden), u.dtype) if keep else None
    cells, tanhs = (np.empty_like(hs), np.empty_like(hs)) if keep else (None, None)
    z = np.empty((2, batch, 4 * hidden), u.dtype)
    moved = np.empty_like(h)
    for t in range(steps):  # exp may run over: the gate is shut then
        if keep:
            z = gates[t]
        np.matmul(h, u, out=z)
        z[0] += table[0].take(x[t], axis=0)
        z[1] += table[1].take(x[steps - 1 - t], axis=0)
        np.exp(z, out=z)
        z += 1
        np.divide(1, z, out=z)
        g = z[:, :, 3 * hidden :]
        g *= 2
        g -= 1
        np.multiply(z[:, :, :hidden], g, out=moved)
        c = z[:, :, hidden : 2 * hidden] * c
        c += moved
        tc = np.tanh(c, out=tanhs[t] if keep else moved)
        h = np.multiply(z[:, :, 2 * hidden : 3 * hidden], tc, out=hs[t])
        if keep:
            cells[t] = c
    return hs, (gates, cells, tanhs)


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """(time, batch, tags) scores of windows x (time, batch)."""
    hs, _ = _run(p, x, False)
    hidden = hs.shape[3]
    e = hs[:, 0] @ p["O"][:hidden]
    e += hs[::-1, 1] @ p["O"][hidden:]
    e += p["o"]
    return e


def viterbi(e: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """The best path through each of several texts; e[i] (length, tags). Texts are walked together, longest first."""
    order = sorted(range(len(e)), key=lambda i: -len(e[i]))
    sizes = np.array([len(e[i]) for i in order])
    tags = len(transitions)
    trans = (transitions + allowed(tags)).astype(np.float32)
    outer = np.where(np.arange(tags) % 3 == 1, 0, FORBIDDEN).astype(np.float32)
    outer[0] = 0
    closing = np.where(np.arange(tags) % 3 == 0, 0, FORBIDDEN).astype(np.float32)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t
    # All scores of one step stand together.
    at = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((int(at[-1]), tags), np.float32)
    for row, i in enumerate(order):
        flat[at[: len(e[i])] + row] = e[i]
    back = np.empty((len(flat), tags), np.int8)
    best = np.zeros(len(order), np.int64)
    score = flat[: at[1]] + outer if steps else flat
    tall = np.ascontiguousarray(trans.T)
    for t in range(1, steps + 1):
        now = int(active[t]) if t < steps else 0
        if now < len(score):  # texts that end here
            best[now : len(score)] = (score[now:] + closing).argmax(axis=1)
            score = score[:now]
        if not now:
            break
        move = score[:, None, :] + tall
        back[at[t] : at[t + 1]] = move.argmax(axis=2)
        score = move.max(axis=2)
        score += flat[at[t] : at[t + 1]]
    paths = np.zeros(len(flat), np.int8)
    tag = best.copy()
    for t in range(steps - 1, -1, -1):
        now = int(active[t])
        paths[at[t] : at[t + 1]] = tag[:now]
        if t:
            tag[:now] = back[at[t] : at[t + 1]][np.arange(now), tag[:now]]
    out: list = [None] * len(e)
    for row, i in enumerate(order):
        out[i] = paths[at[: len(e[i])] + row]
    return out


def open_stretches(e: np.ndarray, transitions: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches outside of which the best path surely says "nothing here".

    The texts' scores stand one after the other in e. What a mention of a kind can win over an empty stretch of
    text is at most its begin, inside and end scores with the best transitions into them, less those of tag 0; running
    sums and maxima give the most that any mention over a character can win. Where that is less than nothing for
    every kind, the best path has tag 0. One character of either side is kept.
    """
    t, kinds_ = transitions, range(1, len(transitions), 3)
    ends = list(range(3, len(t), 3))
    empty = e[:, 0] + t[0, 0]
    into_b = np.array([max(t[0, k], t[ends, k].max()) for k in kinds_], np.float32)
    into_i = np.array([max(t[k, k + 1], t[k + 1, k + 1]) for k in kinds_], np.float32)
    into_e = np.array([max(t[k, k + 2], t[k + 1, k + 2]) for k in kinds_], np.float32)
    first = (e[:, 1::3] + into_b - empty[:, None]).astype(np.float64)
    inner = (e[:, 2::3] + into_i - empty[:, None]).astype(np.float64)
    last = (e[:, 3::3] + into_e - empty[:, None]).astype(np.float64)
    # The neighbours' transitions change too when a mention is taken away.
    around = max(0.0, t[0, 0] - t[ends, 0].min()) + max(0.0, (t[ends, 0] - t[0, 0]).max(), (t[ends, 1::3] - t[0, 1::3]).max())
    out = []
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        if not n:
            continue
        total = np.cumsum(inner[a : a + n], axis=0)
        before = total - inner[a : a + n]
        most = np.maximum.accumulate(first[a : a + n] - total, axis=0) + np.maximum.accumulate((last[a : a + n] + before)[::-1], axis=0)[::-1]
        unsure = np.nonzero(most.max(axis=1) + around >= -1e-3)[0]
        if not len(unsure):
            continue
        cuts = np.nonzero(np.diff(unsure) > 2)[0]
        heads, tails = unsure[np.concatenate([[0], cuts + 1])], unsure[np.concatenate([cuts, [len(unsure) - 1]])]
        out += [(i, max(0, h - 1), min(n, z + 2)) for h, z in zip(heads.tolist(), tails.tolist(), strict=True)]
    return out


def _crf(e: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Loss per character and its gradients by emissions and transitions (scaled forward-backward)."""
    steps, batch, tags = e.shape
    full = trans + allowed(tags)
    top = float(full.max())
    m = np.exp(full - top)
    peak = e.max(axis=2, keepdims=True)
    q = np.exp(e - peak)
    alpha, beta, size = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1), e.dtype)
    for t in range(steps):
        a = np.multiply(alpha[t - 1] @ m, q[t], out=alpha[t]) if t else np.copyto(alpha[0], q[0]) or alpha[0]
        size[t] = a.sum(axis=1, keepdims=True)
        a /= size[t]
    q /= size
    for t in range(steps - 2, -1, -1):
        np.matmul(q[t + 1] * beta[t + 1], m.T, out=beta[t])
    de = alpha * beta
    dt = (alpha[:-1].reshape(-1, tags).T @ (q[1:] * beta[1:]).reshape(-1, tags)) * m
    at, rows = np.arange(steps)[:, None], np.arange(batch)[None, :]
    z = float(np.log(size).sum() + peak.sum()) + (steps - 1) * batch * top
    gold = e[at, rows, y].sum() + full[y[:-1], y[1:]].sum()
    de[at, rows, y] -= 1
    dt -= np.bincount((y[:-1] * tags + y[1:]).ravel(), minlength=tags * tags).reshape(tags, tags)
    n = steps * batch
    return (z - float(gold)) / n, de / n, (dt / n).astype(e.dtype)


def _unrun(p: dict, x: np.ndarray, hs: np.ndarray, kept, dh_all: np.ndarray) -> dict:
    """Back-propagation through time of both directions; dh_all is in reading order."""
    gates, cells, tanhs = kept
    steps, _, batch, hidden = hs.shape
    back = np.ascontiguousarray(p["U"].transpose(0, 2, 1))
    dz_all = np.empty_like(gates)
    dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for t in range(steps - 1, -1, -1):
        g = gates[t]
        i, f, o, c_in = g[:, :, :hidden], g[:, :, hidden : 2 * hidden], g[:, :, 2 * hidden : 3 * hidden], g[:, :, 3 * hidden :]
        dh += dh_all[t]
        dz = dz_all[t]
        tc = tanhs[t]
        dc += dh * o * (1 - tc * tc)
        sig = g[:, :, : 3 * hidden]
        slope = sig - sig * sig
        np.multiply(dc * c_in, slope[:, :, :hidden], out=dz[:, :, :hidden])
        if t:
            np.multiply(dc * cells[t - 1], slope[:, :, hidden : 2 * hidden], out=dz[:, :, hidden : 2 * hidden])
        else:
            dz[:, :, hidden : 2 * hidden] = 0
        np.multiply(dh * tc, slope[:, :, 2 * hidden :], out=dz[:, :, 2 * hidden : 3 * hidden])
        np.multiply(dc * i, 1 - c_in * c_in, out=dz[:, :, 3 * hidden :])
        dc *= f
        dh = dz @ back
    grads = {"U": np.empty_like(p["U"]), "b": dz_all.sum(axis=(0, 2))[:, None, :], "W": np.empty_like(p["W"]), "E": 0.0}
    inputs = (p["E"][:, None] + p["G"]).reshape(KINDS * FLAGS, -1)
    d_in = np.zeros_like(inputs)
    for d, places in ((0, x), (1, x[::-1])):
        flat = dz_all[:, d].reshape(-1, 4 * hidden)
        grads["U"][d] = hs[:-1, d].reshape(-1, hidden).T @ dz_all[1:, d].reshape(-1, 4 * hidden)
        ids = places.ravel()
        order = np.argsort(ids, kind="stable")
        seen, first = np.unique(ids[order], return_index=True)
        sums = np.add.reduceat(flat[order], first, axis=0)  # per input class
        grads["W"][d] = inputs[seen].T @ sums
        d_in[seen] += sums @ p["W"][d].T
    d_in = d_in.reshape(KINDS, FLAGS, -1)
    return grads | {"E": d_in.sum(axis=1), "G": d_in.sum(axis=0)}


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients for windows x with tags y, both (time, batch)."""
    hs, kept = _run(p, x, True)
    hidden = hs.shape[3]
    both = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)
    loss, de, dt = _crf(both @ p["O"] + p["o"], y, p["T"])
    g = {"T": dt, "o": de.sum(axis=(0, 1)), "O": both.reshape(-1, 2 * hidden).T @ de.reshape(-1, de.shape[2])}
    dh = de @ p["O"].T
    return loss, g | _unrun(p, x, hs, kept, np.stack([dh[:, :, :hidden], dh[::-1, :, hidden:]], axis=1))


def train(p: dict, x: np.ndarray, y: np.ndarray, *, batch: int, rates: tuple[float, float], seed: int = 0) -> tuple[dict, float]:
    """One pass of Adam over windows x, y (windows, time), the rate falling from the first to the second of
    `rates`. Returns the parameters and the mean loss."""
    rng = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    order, losses = rng.permutation(len(x)), []
    for step, i in enumerate(range(0, len(order), batch), 1):
        some = np.sort(order[i : i + batch])
        loss, g = gradients(p, np.ascontiguousarray(x[some].T), np.ascontiguousarray(y[some].T))
        losses.append(loss)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        rate = rates[0] + (rates[1] - rates[0]) * i / len(order)
        for k in p:
            a = g[k] * scale
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(p[k].dtype)
    return p, float(np.mean(losses)) if losses else 0.0
