"""An existing piece vocabulary as plain tables, and the lattice of all segmentations of words over it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import sentencepiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x100000001B3)


@dataclass
class Vocabulary:
    """Pieces by length: hashes in order with their ids; byte pieces stand in for characters without a piece."""

    text: list[str]
    score: np.ndarray
    hashes: dict[int, tuple[np.ndarray, np.ndarray]]
    byte: np.ndarray
    unknown: int


def load(model_file: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.vocab_size()
    text = [model.id_to_piece(i) for i in range(size)]
    byte = np.full(256, model.unk_id(), np.int64)
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i in range(size):
        if model.is_byte(i):
            byte[int(text[i][3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            h = _prefix_hashes(np.array([[ord(c) for c in text[i]]], np.uint64))[0, -1]
            by_length.setdefault(len(text[i]), []).append((int(h), i))
    hashes = {}
    for n, pairs in by_length.items():
        pairs.sort()
        hashes[n] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
    return Vocabulary(text, np.array([model.get_score(i) for i in range(size)]), hashes, byte, model.unk_id())


def ranks(vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """Rank of each piece by its score, and the logarithm of all weights 1 / (rank + 10)."""
    order = np.argsort(-vocabulary.score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return rank, float(np.log((1.0 / (rank + 10.0)).sum()))


def prior(vocabulary: Vocabulary) -> np.ndarray:
    """Log weights from the vocabulary's own scores: a piece weighs the less the later its rank by score."""
    rank, log_total = ranks(vocabulary)
    return -np.log(rank + 10.0) - log_total


def decoded(text: list[str], byte_of: dict[int, int], ids: list[int]) -> str:
    """The text of piece ids; bytes in a row are one UTF-8 string, the first space is the encoder's own."""
    if byte_of.keys() & set(ids):
        raw = b"".join(bytes([byte_of[i]]) if i in byte_of else text[i].replace(SPACE, " ").encode() for i in ids)
        out = raw.decode("utf-8", "replace")
    else:
        out = "".join([text[i] for i in ids]).replace(SPACE, " ")
    return out[1:]


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


class Lattice:
    """Words of one length; ``edges[l][:, i]`` is the piece id of the l characters from i, -1 where there is none."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray):
        self.codes, self.vocabulary = codes, vocabulary
        n, self.length = codes.shape
        h = _prefix_hashes(codes)
        power = np.ones(1, np.uint64)
        self.edges: dict[int, np.ndarray] = {}
        for size in range(1, self.length + 1):
            power = power * _BASE
            if size > max(vocabulary.hashes):
                break
            if size not in vocabulary.hashes:
                continue
            known, ids = vocabulary.hashes[size]
            wanted = h[:, size:] - h[:, : self.length - size + 1] * power
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            self.edges[size] = np.where(known[at] == wanted, ids[at], -1)
        # characters without a piece: their bytes
        self.spelt = [(int(w), int(i), self.bytes_of(int(codes[w, i]))) for w, i in zip(*np.nonzero(self.edges[1] < 0), strict=True)]

    def bytes_of(self, code: int) -> np.ndarray:
        return self.vocabulary.byte[list(chr(code).encode("utf-8", "surrogatepass"))]

    def weights(self, logp: np.ndarray) -> dict[int, np.ndarray]:
        padded = np.append(logp, -np.inf)  # id -1
        out = {size: padded[ids] for size, ids in self.edges.items()}
        for w, i, spelt in self.spelt:
            out[1][w, i] = logp[spelt].sum()
        return out

    def forward(self, weights: dict[int, np.ndarray]) -> np.ndarray:
        """alpha[:, j]: log of the summed weight of all segmentations of the first j characters."""
        alpha = np.full((self.length + 1, len(self.codes)), -np.inf)
        alpha[0] = 0.0
        for j in range(1, self.length + 1):
            paths = [alpha[j - size] + w[:, j - size] for size, w in weights.items() if size <= j]
            top = np.maximum.reduce(paths)
            safe = np.where(np.isfinite(top), top, 0.0)
            total = np.zeros(len(top))
            for p in paths:
                total += np.exp(p - safe)
            with np.errstate(divide="ignore"):
                alpha[j] = np.log(total) + safe
        return alpha

    def expected(self, weights: dict[int, np.ndarray], size_of_vocabulary: int) -> np.ndarray:
        """How often each piece is used, on average over the segmentations of every word."""
        alpha = self.forward(weights)
        beta = np.full_like(alpha, -np.inf)
        beta[self.length] = 0.0
        counts = np.zeros(size_of_vocabulary)
        for i in range(self.length - 1, -1, -1):
            total = np.zeros(len(self.codes))
            shares = []
            for size, w in weights.items():
                if i + size <= self.length:
                    # divided by the word's own weight, which every full path contains
                    share = np.exp(w[:, i] + beta[i + size] + alpha[i] - alpha[self.length])
                    shares.append((size, share))
                    total += share
            with np.errstate(divide="ignore"):
                beta[i] = np.log(total) - alpha[i] + alpha[self.length]
            for size, share in shares:
                ids = self.edges[size][:, i]
                counts += np.bincount(ids[ids >= 0], share[ids >= 0], size_of_vocabulary)
        for w, i, spelt in self.spelt:
            share = np.exp(alpha[i, w] + weights[1][w, i] + beta[i + 1, w] - alpha[self.length, w])
            np.add.at(counts, spelt, share)
        return counts


def lattices(vocabulary: Vocabulary, words: list[str], cells: int = 400_000, mark: str = SPACE):
    """(positions of the words, their lattice) in blocks of one length; ``mark`` goes before each word."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        n += len(mark)
        if not n:
            continue
        step = max(1, cells // n)
        for b in range(0, len(at), step):
            block = at[b : b + step]
            codes = np.frombuffer("".join(mark + words[i] for i in block).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield np.array(block), Lattice(vocabulary, codes.reshape(len(block), n).astype(np.uint64))
