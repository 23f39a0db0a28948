"""A linear-chain conditional random field over flat numpy arrays.

Words of all sequences stand end to end; a sequence is a first word and a
length.  Steps go through all sequences at once, longest first, so step t works
on the leading ones that are longer than t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Layout:
    """Which words each step touches."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        keep = length > 0
        first, length = first[keep], length[keep]
        self.order = order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.most = int(self.length[0]) if len(length) else 0
        self.active = len(length) - np.searchsorted(self.length[::-1], np.arange(self.most), "right")

    def forward(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for t in range(self.most):
            n = int(self.active[t])
            yield t, n, self.first[:n] + t

    def backward(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for t in range(self.most - 1, -1, -1):
            n = int(self.active[t])
            yield t, n, self.first[:n] + t


def viterbi(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, layout: Layout) -> np.ndarray:
    """The best state of each word; ``emit`` words x states, ``move`` from x to."""
    states = np.zeros(len(emit), np.uint8)
    back = np.zeros(emit.shape, np.uint8)
    best = np.zeros((len(layout.first), emit.shape[1]), emit.dtype)
    to = np.ascontiguousarray(move.T)
    for t, n, at in layout.forward():
        if t == 0:
            best[:n] = emit[at] + begin
            continue
        score = best[:n, None, :] + to
        arg = score.argmax(2)
        back[at] = arg
        best[:n] = np.take_along_axis(score, arg[:, :, None], 2)[:, :, 0] + emit[at]
    now = best.argmax(1).astype(np.uint8)
    for t, n, at in layout.backward():
        states[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return states


def marginals(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, layout: Layout, expected: bool = False):
    """Posterior of each word's state by forward-backward; with ``expected`` also expected moves and begins."""
    k = emit.shape[1]
    p = np.exp(emit - emit.max(1, keepdims=True))
    step, start = np.exp(move), np.exp(begin)
    alpha, beta = np.zeros_like(p), np.ones_like(p)
    row = np.zeros((len(layout.first), k), p.dtype)
    for t, n, at in layout.forward():
        row[:n] = (row[:n] @ step if t else start) * p[at]
        row[:n] /= row[:n].sum(1, keepdims=True)
        alpha[at] = row[:n]
    moves = np.zeros((k, k))
    row[:] = 1
    for t, n, at in layout.backward():
        beta[at] = row[:n]
        if t:
            inner = row[:n] * p[at]
            if expected:
                joint = alpha[at - 1][:, :, None] * step * inner[:, None, :]
                moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            row[:n] = inner @ step.T
            row[:n] /= row[:n].sum(1, keepdims=True)
    post = alpha * beta
    total = post.sum(1, keepdims=True)
    post /= np.where(total > 0, total, 1)
    if expected:
        return post, moves, post[layout.first].sum(0)
    return post


def long_marginals(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, first: np.ndarray, length: np.ndarray, block: int = 64) -> np.ndarray:
    """Posteriors of sequences of any length, as ``marginals`` gives them, in steps of ``block`` words.

    Blocks are worked on side by side.  A block's transfer matrix says what any
    state before it leads to behind it, so what a sequence carries into each of
    its blocks, from both ends, takes one step a block, and nothing is cut.
    """
    first, length = first[length > 0], length[length > 0]
    if not len(length) or length.max() <= block:
        return marginals(emit, move, begin, Layout(first, length))
    k = emit.shape[1]
    p = np.exp(emit - emit.max(1, keepdims=True))
    step, start = np.exp(move), np.exp(begin)
    blocks = (length + block - 1) // block
    before = np.cumsum(blocks) - blocks
    at = np.repeat(first, blocks) + (np.arange(int(blocks.sum())) - np.repeat(before, blocks)) * block
    layout = Layout(at, np.minimum(block, np.repeat(first + length, blocks) - at))
    through = np.zeros((len(at), k, k), p.dtype)
    for t, n, x in layout.forward():
        now = through[:n]
        if t == 0:
            now[:, np.arange(k), np.arange(k)] = p[x]
        else:
            now[:] = (now.reshape(-1, k) @ step).reshape(n, k, k) * p[x][:, None, :]
            now /= now.sum((1, 2), keepdims=True)
    carried = np.empty_like(through)
    carried[layout.order] = through
    lead, tail = np.tile(start.astype(p.dtype), (len(at), 1)), np.ones((len(at), k), p.dtype)
    for j in range(1, int(blocks.max())):
        x = before[blocks > j] + j
        now = np.einsum("nk,nkj->nj", lead[x - 1], carried[x - 1]) @ step
        lead[x] = now / now.sum(1, keepdims=True)
    for j in range(int(blocks.max()) - 1, 0, -1):
        x = before[blocks > j] + j
        now = np.einsum("nkj,nj->nk", carried[x], tail[x]) @ step.T
        tail[x - 1] = now / now.sum(1, keepdims=True)
    alpha, beta = np.zeros_like(p), np.ones_like(p)
    row = lead[layout.order]
    for t, n, x in layout.forward():
        row[:n] = (row[:n] @ step if t else row[:n]) * p[x]
        row[:n] /= row[:n].sum(1, keepdims=True)
        alpha[x] = row[:n]
    row = tail[layout.order]
    for t, n, x in layout.backward():
        beta[x] = row[:n]
        row[:n] = (row[:n] * p[x]) @ step.T
        row[:n] /= row[:n].sum(1, keepdims=True)
    post = alpha * beta
    return post / post.sum(1, keepdims=True)


def train(features: list[np.ndarray], sizes: list[int], owner: list[np.ndarray], gold: np.ndarray, layout: Layout, k: int, epochs: int, rate: float = 0.15, decay: float = 1e-4):
    """Weights by full-batch Adam on the conditional likelihood.

    ``features[f]`` are codes below ``sizes[f]`` of the words ``owner[f]``; a
    word's emission is the sum of its codes' rows.  Returns (tables, move, begin).
    """
    rng = np.random.default_rng(5)
    tables = [np.zeros((n, k)) for n in sizes]
    move, begin = rng.normal(0, 0.01, (k, k)), np.zeros(k)
    n, follow = len(gold), np.ones(len(gold), bool)
    follow[layout.first] = False
    after = np.flatnonzero(follow)
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (gold[after - 1], gold[after]), 1)
    seen_begin = np.bincount(gold[layout.first], minlength=k).astype(float)
    params = [*tables, move, begin]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for epoch in range(1, epochs + 1):
        emit = np.zeros((n, k))
        for table, codes, who in zip(tables, features, owner):
            _add_rows(emit, table, codes, who)
        post, moves, begins = marginals(emit, move, begin, layout, expected=True)
        error = -post
        error[np.arange(n), gold] += 1
        grads = [np.stack([np.bincount(codes, error[who, j], m) for j in range(k)], 1) for codes, who, m in zip(features, owner, sizes)]
        grads += [seen_moves - moves, seen_begin - begins]
        for j, (x, g) in enumerate(zip(params, grads)):
            g = g / len(layout.first) - decay * x
            first[j] = 0.8 * first[j] + 0.2 * g
            second[j] = 0.95 * second[j] + 0.05 * g * g
            x += rate * (first[j] / (1 - 0.8**epoch)) / (np.sqrt(second[j] / (1 - 0.95**epoch)) + 1e-6)
    return [t.astype(np.float32) for t in tables], move.astype(np.float32), begin.astype(np.float32)


def _add_rows(emit: np.ndarray, table: np.ndarray, codes: np.ndarray, who: np.ndarray) -> None:
    if len(who) == len(emit):
        emit += table[codes]
    else:
        for j in range(emit.shape[1]):
            emit[:, j] += np.bincount(who, table[codes, j], len(emit))
