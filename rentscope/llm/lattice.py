"""Segmentation lattices of words over a fixed public piece vocabulary.

A word is its UTF-8 bytes behind a word mark; its arcs are the vocabulary's pieces and, for every
byte, the byte piece, so any text has a segmentation. Pieces do not reach across words, so the
marginal probability of a text is the product of its words'. The forward recursion runs in log
space and over many words of one length at once; one call can weigh the same arcs by several
models (rows of ``logp``). A word over ``BATCH_LENGTH`` bytes is walked alone, block by block:
of its alphas only those that the longest piece reaches back to are kept (for counts all of them,
a number a byte), of its arcs those of one block.
"""
from __future__ import annotations

import numpy as np

from .shingles import U, stream

MARK = b" "
VOCABULARY = "piece_bpe_32k.model"
#: Longer words (in bytes) are walked alone instead of in batches by length.
BATCH_LENGTH = 40
#: Weights of arcs that a long word's block holds.
BLOCK_WEIGHTS = 1 << 20
#: Words of one length handled at once.
BATCH_WORDS = 8192

_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = stream(256, 11)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _powers(base: U, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U(1), np.full(n, base, U)])


class Pieces:
    """The vocabulary: piece lookup by hash, byte pieces, and its scores as start weights."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[int, int]]] = {}
        weight = np.zeros(self.size)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
                weight[i] = 1.0 / self.size
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                s = sp.id_to_piece(i)
                if "▁" in s[1:]:
                    continue        # spans words
                raw = s.replace("▁", " ").encode()
                by_length.setdefault(len(raw), []).append((self._hash(raw), i))
                # the file's scores are merge ranks; by Zipf's law a piece's weight is 1 / rank
                weight[i] = 1.0 / (1.0 + max(0.0, -sp.get_score(i)))
        self.start = weight / weight.sum()
        self.tables = {}
        for n, rows in sorted(by_length.items()):
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], U), np.array([r[1] for r in rows], np.int64))
        #: Lengths of the kinds of arcs: the byte pieces, then the tables.
        self.lengths = np.array([1, *self.tables], np.int64)
        self.reach = int(self.lengths.max())

    @staticmethod
    def _hash(raw: bytes) -> int:
        h = 0
        for j, b in enumerate(raw):
            h = (h + int(_BYTE[b]) * pow(0x9E3779B97F4A7C15, j, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length n the ids (or -1) of rows[:, s:s + n], for all s; rows: words x bytes."""
        n_bytes = rows.shape[1]
        with np.errstate(over="ignore"):
            prefix = np.zeros((len(rows), n_bytes + 1), U)
            np.cumsum(_BYTE[rows] * _powers(_P, n_bytes)[:n_bytes], axis=1, out=prefix[:, 1:])
            back = _powers(_P_INV, n_bytes)
            out = {}
            for n, (keys, ids) in self.tables.items():
                if n > n_bytes:
                    break
                h = (prefix[:, n:] - prefix[:, :-n]) * back[:n_bytes - n + 1]
                at = np.minimum(np.searchsorted(keys, h.ravel()), len(keys) - 1)
                out[n] = np.where(keys[at] == h.ravel(), ids[at], -1).reshape(h.shape)
        return out


    def starting(self, row: np.ndarray) -> np.ndarray:
        """Ids (or -1) of the arcs from each position of one word, by kind; they end inside the row."""
        out = np.full((len(row), len(self.lengths)), -1, np.int64)
        out[:, 0] = self.byte[row]
        found = self.arcs(row[None])
        for j, n in enumerate(self.tables, 1):
            if n in found:
                out[:len(row) - n + 1, j] = found[n][0]
        return out


def _groups(words: list[bytes]):
    """(word numbers, matrix of their marked bytes) of words of one length, in bounded batches."""
    if not words:
        return
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True])
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        n = int(length[order[a]]) + 1
        step = BATCH_WORDS if n <= BATCH_LENGTH else 1      # a long word comes alone
        for i in range(a, z, step):
            numbers = order[i:min(z, i + step)]
            raw = b"".join(MARK + words[k] for k in numbers)
            yield numbers, np.frombuffer(raw, np.uint8).reshape(len(numbers), n)


def _forward(pieces: Pieces, rows: np.ndarray, logp: np.ndarray):
    """alpha (positions x words x models) and the arcs used, as (start, end, words, ids)."""
    m, t_max = rows.shape
    alpha = np.full((t_max + 1, m, logp.shape[1]), -np.inf)
    alpha[0] = 0.0
    table, arcs = pieces.arcs(rows), []
    every = np.arange(m)
    for t in range(1, t_max + 1):
        ids = pieces.byte[rows[:, t - 1]]
        arcs.append((t - 1, t, every, ids))
        np.logaddexp(alpha[t], alpha[t - 1] + logp[ids], out=alpha[t])
        for n, found in table.items():
            if n > t:
                break
            ids = found[:, t - n]
            at = np.flatnonzero(ids >= 0)
            if len(at):
                ids = ids[at]
                arcs.append((t - n, t, at, ids))
                alpha[t, at] = np.logaddexp(alpha[t, at], alpha[t - n, at] + logp[ids])
    return alpha, arcs


def _weights(ids: np.ndarray, logp: np.ndarray) -> np.ndarray:
    out = logp[ids]
    out[ids < 0] = -np.inf
    return out


def _long_forward(pieces: Pieces, row: np.ndarray, logp: np.ndarray, every: np.ndarray | None = None) -> np.ndarray:
    """alpha (models) at the end of one word; ``every`` takes that of the first model at each position."""
    reach, kinds = pieces.reach, len(pieces.lengths)
    step = max(reach, BLOCK_WEIGHTS // (kinds * logp.shape[1]))
    slots = (np.arange(reach)[:, None] - pieces.lengths) % reach
    ring = np.full((reach, logp.shape[1]), -np.inf)         # alpha of position t in row t % reach
    ring[0] = 0.0
    for a in range(0, len(row), step):
        z, low = min(len(row), a + step), max(0, a - reach)
        start, ids = pieces.starting(row[low:z]), np.full((z - a, kinds), -1, np.int64)
        for j, n in enumerate(pieces.lengths.tolist()):     # by the arcs' ends: positions a + 1 to z
            first = max(0, n - 1 - (a - low))
            ids[first:, j] = start[a - low + 1 - n + first:z - low + 1 - n, j] if first < z - a else -1
        for t, w in enumerate(_weights(ids, logp), a + 1):
            ring[t % reach] = np.logaddexp.reduce(ring[slots[t % reach]] + w, axis=0)
            if every is not None:
                every[t] = ring[t % reach, 0]
    return ring[len(row) % reach]


def _long_counts(pieces: Pieces, row: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected piece counts of one word: the forward numbers first, then backward block by block."""
    reach, kinds, size = pieces.reach, len(pieces.lengths), len(row)
    alpha = np.zeros(size + 1)
    total = _long_forward(pieces, row, logp, alpha)[0]
    step = max(reach, BLOCK_WEIGHTS // kinds)
    slots = (np.arange(reach)[:, None] + pieces.lengths) % reach
    ring = np.full(reach, -np.inf)                          # beta of position s in entry s % reach
    ring[size % reach] = 0.0
    out = np.zeros(len(logp))
    for z in range(size, 0, -step):
        a = max(0, z - step)
        ids = pieces.starting(row[a:min(size, z + reach)])[:z - a]
        through = _weights(ids, logp[:, 0])
        for s in range(z - 1, a - 1, -1):
            through[s - a] += ring[slots[s % reach]]
            ring[s % reach] = np.logaddexp.reduce(through[s - a])
        p = np.exp(alpha[a:z, None] + through - total)
        out += np.bincount(ids[ids >= 0], p[ids >= 0], len(logp))
    return out


def log_marginals(pieces: Pieces, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Natural-log probability of each word (words x models); logp: pieces x models."""
    out = np.zeros((len(words), logp.shape[1]))
    for numbers, rows in _groups(words):
        long = rows.shape[1] > BATCH_LENGTH
        out[numbers] = _long_forward(pieces, rows[0], logp) if long else _forward(pieces, rows, logp)[0][-1]
    return out


def expected_counts(pieces: Pieces, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x columns of weights) under one model; weights: words x columns."""
    out = np.zeros((len(logp), weights.shape[1]))
    for numbers, rows in _groups(words):
        if rows.shape[1] > BATCH_LENGTH:
            out += _long_counts(pieces, rows[0], logp)[:, None] * weights[numbers[0]]
            continue
        alpha, arcs = _forward(pieces, rows, logp)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0.0
        total, w = alpha[-1][:, 0], weights[numbers]
        seen = []
        for s, t, at, ids in reversed(arcs):
            through = logp[ids, 0] + beta[t, at, 0]
            beta[s, at, 0] = np.logaddexp(beta[s, at, 0], through)
            seen.append((ids, at, np.exp(alpha[s, at, 0] + through - total[at])))
        ids, at, p = (np.concatenate([x[i] for x in seen]) for i in range(3))
        for c in range(weights.shape[1]):
            out[:, c] += np.bincount(ids, p * w[at, c], len(logp))
    return out
