"""A character tagger in numpy: bidirectional LSTM, linear layer, CRF transitions.

Arrays are time-major. Gates are ordered input, forget, output, candidate; the
three sigmoid gates are computed as tanh of half their input, so one tanh call
serves all four.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def init(n_chars: int, n_tags: int, dim: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def w(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) * np.sqrt(1.0 / shape[0])).astype(F32)

    p = {"E": (rng.normal(size=(n_chars, dim)) * 0.3).astype(F32), "O": w(2 * hidden, n_tags), "ob": np.zeros(n_tags, F32), "T": np.zeros((n_tags, n_tags), F32), "S": np.zeros(n_tags, F32)}
    for d in "fb":
        b = np.zeros(4 * hidden, F32)
        b[hidden:2 * hidden] = 1.0
        p |= {f"W{d}": w(dim, 4 * hidden), f"U{d}": w(hidden, 4 * hidden), f"b{d}": b}
    return p


def _scaled(hidden: int) -> np.ndarray:
    return np.concatenate([np.full(3 * hidden, 0.5), np.ones(hidden)]).astype(F32)


def _run(table: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray, back: bool, keep: bool):
    """Hidden states of one direction, (time, batch, hidden); with keep also what training needs."""
    n, b = ids.shape
    h4 = u.shape[1]
    h = h4 // 4
    out = np.zeros((n, b, h), F32)
    hs, cs = np.zeros((b, h), F32), np.zeros((b, h), F32)
    kept = []
    for t in range(n - 1, -1, -1) if back else range(n):
        g = table[ids[t]]
        g += hs @ u
        np.tanh(g, out=g)
        s = g[:, :3 * h]
        s *= 0.5
        s += 0.5
        i, f, o, a = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
        c = f * cs + i * a
        tc = np.tanh(c)
        hn = o * tc
        if keep:
            kept.append((t, g, cs, hs, tc))
        m = mask[t][:, None]
        cs, hs = c * m, hn * m
        out[t] = hs
    return out, kept


def scores(p: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Emission scores, (time, batch, tags)."""
    hidden = p["Uf"].shape[0]
    k = _scaled(hidden)
    tables = p.get("_tables")
    if tables is None:
        tables = p["_tables"] = {d: ((p["E"] @ p[f"W{d}"] + p[f"b{d}"]) * k, p[f"U{d}"] * k) for d in "fb"}
    f, _ = _run(*tables["f"], ids, mask, False, False)
    b, _ = _run(*tables["b"], ids, mask, True, False)
    return np.concatenate([f, b], axis=2) @ p["O"] + p["ob"]


def viterbi(p: dict[str, np.ndarray], e: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best tags, (time, batch); places without mask repeat the last."""
    n, b, k = e.shape
    best = e[0] + p["S"]
    back = np.zeros((n, b, k), np.int8)
    t_to = np.ascontiguousarray(p["T"].T)  # (to, from)
    for t in range(1, n):
        s = best[:, None, :] + t_to[None]
        at = s.argmax(axis=2)
        new = np.take_along_axis(s, at[:, :, None], axis=2)[:, :, 0] + e[t]
        m = mask[t].astype(bool)[:, None]
        back[t] = np.where(m, at, np.arange(k))
        best = np.where(m, new, best)
    out = np.zeros((n, b), np.int8)
    out[n - 1] = best.argmax(axis=1)
    rows = np.arange(b)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t][rows, out[t]]
    return out


def decoded(p: dict[str, np.ndarray], e: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best tags as of viterbi, which is run only for the sequences where another path than tag 0 throughout can be best.

    A run of m places of other tags gains at most what entering and leaving it
    and m - 1 transitions within it have over those from 0 to 0; at the start its
    entry, at the end its exit is free. Where the emissions of tag 0 lead by more
    than that at every place, tag 0 throughout is best.
    """
    t = p["T"]
    within = max(0.0, float(t[1:, 1:].max() - t[0, 0]))
    enter, leave = float(t[0, 1:].max() - t[0, 0]), float(t[1:, 0].max() - t[0, 0])
    each = within + max(0.0, enter + leave - within)
    lead = np.where(mask > 0, e[:, :, 0] - e[:, :, 1:].max(axis=2), np.inf)
    lead[0] -= max(0.0, float(p["S"][1:].max() - p["S"][0]) - enter)
    lead[mask.sum(axis=0).astype(int) - 1, np.arange(mask.shape[1])] -= max(0.0, -leave)
    doubt = np.flatnonzero((lead <= each).any(axis=0))
    out = np.zeros(mask.shape, np.int8)
    if len(doubt):
        out[:, doubt] = viterbi(p, np.ascontiguousarray(e[:, doubt]), mask[:, doubt])
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


def loss_and_gradients(p: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood per sequence of the CRF, and its gradients."""
    n, b = ids.shape
    hidden = p["Uf"].shape[0]
    k = _scaled(hidden)
    run = {d: _run((p["E"] @ p[f"W{d}"] + p[f"b{d}"]) * k, p[f"U{d}"] * k, ids, mask, d == "b", True) for d in "fb"}
    hcat = np.concatenate([run["f"][0], run["b"][0]], axis=2)
    e = hcat @ p["O"] + p["ob"]
    tr, rows = p["T"], np.arange(b)
    alpha = np.zeros_like(e)
    alpha[0] = e[0] + p["S"]
    for t in range(1, n):
        a = _logsumexp(alpha[t - 1][:, :, None] + tr[None], 1) + e[t]
        alpha[t] = np.where(mask[t][:, None] > 0, a, alpha[t - 1])
    z = _logsumexp(alpha[n - 1], 1)
    beta = np.zeros_like(e)
    d_t, d_e = np.zeros_like(tr), np.zeros_like(e)
    for t in range(n - 1, -1, -1):
        live = mask[t][:, None]
        d_e[t] = np.exp(alpha[t] + beta[t] - z[:, None]) * live
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + tr[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            d_t += (pair * live[:, :, None]).sum(0)
            bt = _logsumexp(tr[None] + (e[t] + beta[t])[:, None, :], 2)
            beta[t - 1] = np.where(live > 0, bt, beta[t])
    gold = p["S"][tags[0]] + e[0, rows, tags[0]]
    d_s = d_e[0].sum(0)
    np.add.at(d_s, tags[0], -1.0)
    for t in range(n):
        live = mask[t]
        if t:
            gold = gold + live * (tr[tags[t - 1], tags[t]] + e[t, rows, tags[t]])
            np.add.at(d_t, (tags[t - 1], tags[t]), -live)
        d_e[t, rows, tags[t]] -= live
    loss = float((z - gold).mean())
    g = {"T": d_t / b, "S": d_s / b}
    d_e /= b
    g["O"] = hcat.reshape(-1, 2 * hidden).T @ d_e.reshape(-1, e.shape[2])
    g["ob"] = d_e.sum((0, 1))
    d_h = d_e @ p["O"].T
    g["E"] = np.zeros_like(p["E"])
    for d, part in (("f", d_h[:, :, :hidden]), ("b", d_h[:, :, hidden:])):
        u, dh, dc = p[f"U{d}"], np.zeros((b, hidden), F32), np.zeros((b, hidden), F32)
        d_table, d_u = np.zeros((p["E"].shape[0], 4 * hidden), F32), np.zeros_like(u)
        for t, gates, c0, h0, tc in reversed(run[d][1]):
            m = mask[t][:, None]
            dh = (dh + part[t]) * m
            i, f, o, a = (gates[:, j * hidden:(j + 1) * hidden] for j in range(4))
            dc = dc * m + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            np.add.at(d_table, ids[t], da)
            d_u += h0.T @ da
            dh, dc = da @ u.T, dc * f
        g[f"U{d}"], g[f"b{d}"], g[f"W{d}"] = d_u, d_table.sum(0), p["E"].T @ d_table
        g["E"] += d_table @ p[f"W{d}"].T
    return loss, g


def fit(p: dict[str, np.ndarray], batches, rate: float = 0.004, clip: float = 5.0) -> float:
    """Adam steps over (ids, mask, tags) batches; the mean loss."""
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    total, step = 0.0, 0
    p.pop("_tables", None)
    for ids, mask, tags, scale in batches:
        loss, g = loss_and_gradients(p, ids, mask, tags)
        step += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, clip / (norm + 1e-9))
            m, v = state[k]
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            p[k] -= (rate * scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(F32)
        total += loss
    return total / max(step, 1)
