"""A small causal self-attention model over subword classes, in numpy."""

from __future__ import annotations

import numpy as np

# A query sees its own block and the one before: windows of 2 * BLOCK, a BLOCK apart.
BLOCK = 16
WIDTH = 8
CLASSES = 24
# Symbols of the input: the commonest subwords, one for all others, one for padding.
SYMBOLS = 1025
OTHER, PAD = SYMBOLS - 2, SYMBOLS - 1
_FAR = -1e4
_HIGH = np.float32(60)
_STEP_BLOCKS = 128
_SCORE_BLOCKS = 256
_RATE = 1e-2
_SHAPES = {
    "embed": (SYMBOLS, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "bias": (BLOCK, 2 * BLOCK),
    "out": (WIDTH, CLASSES),
}
# Position i of a block sees itself and whatever stands before it.
_MASK = np.where(np.arange(2 * BLOCK)[None, :] > np.arange(BLOCK)[:, None] + BLOCK, _FAR, 0.0)


def start(seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; with ``out`` at zero the model is its table of pairs."""
    rng = np.random.default_rng(seed)
    weights = {n: rng.normal(0, 0.2, s).astype(np.float32) for n, s in _SHAPES.items()}
    weights["out"][:] = 0
    weights["bias"][:] = 0
    return weights


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in _SHAPES])


def shaped(numbers: np.ndarray) -> dict[str, np.ndarray]:
    at, weights = 0, {}
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        weights[name] = np.asarray(numbers[at : at + size], dtype=np.float32).reshape(shape)
        at += size
    return weights


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of texts of these lengths in one row of blocks, and its length.

    Each text begins a block after a block of padding, so no window reaches into
    another text.
    """
    blocks = -(-lengths // BLOCK) + 1
    begin = np.concatenate([[0], np.cumsum(blocks)])
    first = np.repeat(begin[:-1] * BLOCK + BLOCK, lengths)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first + inside, int(begin[-1]) * BLOCK


def _soft(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def log_probabilities(
    weights: dict, pairs: np.ndarray, symbols: np.ndarray, targets: np.ndarray
) -> np.ndarray:
    """Natural log probability of each place's target class; places of padding give any value.

    ``symbols`` are the inputs, laid out in blocks, and ``pairs`` the log probability of
    each class after each symbol, which attention adds to.  Each place is a query once,
    in the window that ends with its block.
    """
    embed = weights["embed"]
    ones = np.ones((SYMBOLS, 1), dtype=np.float32)
    hide = np.zeros((SYMBOLS, 1), dtype=np.float32)
    hide[PAD] = _FAR
    query = np.hstack([embed @ weights["query"] / np.float32(WIDTH**0.5), ones])
    key = np.hstack([embed @ weights["key"], hide])
    # The last column adds up the weights, so that they need no division of their own.
    value = np.hstack([embed @ weights["value"], ones])
    bias = (weights["bias"] + _MASK).astype(np.float32)
    blocks = symbols.reshape(-1, BLOCK)
    found = np.empty(len(symbols), dtype=np.float32)
    for at in range(0, len(blocks), _SCORE_BLOCKS):
        part = blocks[at : at + _SCORE_BLOCKS]
        before = blocks[max(at - 1, 0) : at + len(part) - 1]
        if at == 0:
            before = np.concatenate([np.full((1, BLOCK), PAD, dtype=symbols.dtype), before])
        window = np.concatenate([before, part], axis=1)
        scores = query[part] @ key[window].transpose(0, 2, 1)
        scores += bias
        np.minimum(scores, _HIGH, out=scores)
        np.exp(scores, out=scores)
        mixed = scores @ value[window]
        hidden = embed[part] + mixed[..., :-1] / np.maximum(mixed[..., -1:], 1e-30)
        span = slice(at * BLOCK, (at + len(part)) * BLOCK)
        logits = hidden.reshape(-1, WIDTH) @ weights["out"]
        logits += pairs[symbols[span]]
        logits -= logits.max(axis=1, keepdims=True)
        picked = logits[np.arange(len(logits)), targets[span]]
        np.exp(logits, out=logits)
        found[span] = picked - np.log(logits.sum(axis=1))
    return found


def _gradients(weights, pairs, window, targets, valid):
    embed, scale = weights["embed"], np.float32(WIDTH**-0.5)
    keys_in, own = embed[window], embed[window[:, BLOCK:]]
    query, key, value = (
        own @ weights["query"],
        keys_in @ weights["key"],
        keys_in @ weights["value"],
    )
    scores = query @ key.transpose(0, 2, 1)
    scores *= scale
    scores += weights["bias"]
    scores += _MASK.astype(np.float32)
    scores += np.where(window == PAD, np.float32(_FAR), np.float32(0))[:, None, :]
    look = _soft(scores)
    hidden = own + look @ value
    off = _soft(hidden @ weights["out"] + pairs[window[:, BLOCK:]])
    rows, columns = np.indices(targets.shape)
    off[rows, columns, targets] -= 1
    off *= (valid / max(1, valid.sum()))[..., None].astype(np.float32)
    def summed(a, b):
        return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])

    grown = {"out": summed(hidden, off)}
    to_hidden = off @ weights["out"].T
    to_value = look.transpose(0, 2, 1) @ to_hidden
    to_look = to_hidden @ value.transpose(0, 2, 1)
    to_scores = to_look
    to_scores -= (to_look * look).sum(axis=-1, keepdims=True)
    to_scores *= look
    to_query, to_key = to_scores @ key * scale, to_scores.transpose(0, 2, 1) @ query * scale
    grown["bias"] = to_scores.sum(axis=0)
    grown["query"] = summed(own, to_query)
    grown["key"] = summed(keys_in, to_key)
    grown["value"] = summed(keys_in, to_value)
    to_keys = to_key @ weights["key"].T + to_value @ weights["value"].T
    to_keys[:, BLOCK:] += to_hidden + to_query @ weights["query"].T
    at = (window.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
    columns = np.bincount(at, to_keys.ravel(), embed.size)
    grown["embed"] = columns.reshape(embed.shape).astype(np.float32)
    return grown


class Trainer:
    """Adam over blocks, starting from given weights."""

    def __init__(self, weights: dict, pairs: np.ndarray):
        self.weights = {n: w.copy() for n, w in weights.items()}
        self.pairs = pairs
        self.first = {n: np.zeros_like(w) for n, w in weights.items()}
        self.second = {n: np.zeros_like(w) for n, w in weights.items()}
        self.steps = 0

    def fit(self, symbols, targets) -> None:
        blocks = symbols.reshape(-1, BLOCK)
        targets = targets.reshape(-1, BLOCK)
        before = np.concatenate([np.full((1, BLOCK), PAD, dtype=symbols.dtype), blocks[:-1]])
        window = np.concatenate([before, blocks], axis=1)
        real = np.flatnonzero((blocks != PAD).any(axis=1))
        for at in range(0, len(real), _STEP_BLOCKS):
            use = real[at : at + _STEP_BLOCKS]
            grown = _gradients(
                self.weights, self.pairs, window[use], targets[use], blocks[use] != PAD
            )
            self.steps += 1
            for name, g in grown.items():
                m, v = self.first[name], self.second[name]
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                up = m / (1 - 0.9**self.steps)
                down = np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8
                self.weights[name] -= (_RATE * up / down).astype(np.float32)
