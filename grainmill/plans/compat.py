"""Orders drawn from NumPy's and Python's generators, for plans that must repeat those of earlier datasets.

They run on the driver over chunk numbers, or over the draws of a mix, never over rows.
"""

from __future__ import annotations

import random

import numpy as np


def chunk_order(n_chunks: int, seed: int, epoch: int, num_nodes: int = 1) -> list[int]:
    return np.random.RandomState([seed, 1 if num_nodes > 1 else epoch]).permutation(range(n_chunks)).tolist()


def node_order(chunks_of_nodes: list[list[int]], seed: int, epoch: int) -> list[list[int]]:
    """Each node's chunks, permuted; a chunk that several of the node's workers read is there once."""
    return [np.random.RandomState([seed, epoch]).permutation(list(dict.fromkeys(c))).tolist() for c in chunks_of_nodes]


def item_order(n_items: int, seed: int, n_chunks: int, epoch: int, position: int) -> list[int]:
    return np.random.RandomState([seed, n_chunks, epoch, position]).permutation(range(n_items)).tolist()


def draws(weights: list[float], n: int, seed: int) -> list[int]:
    """The streams of n draws in turn."""
    generator, total = random.Random(seed), sum(weights)
    share = [w / total for w in weights]
    return [generator.choices(range(len(share)), weights=share, k=1)[0] for _ in range(n)]


def interleave(lengths: list[int], weights: list[float], seed: int, iterate_over_all: bool) -> list[tuple[int, int]]:
    """(stream, place) in the order of a weighted mix: a stream that ends goes, and the others' weights are scaled up; or the mix ends with it."""
    generator, open_, taken, out = random.Random(seed), list(range(len(lengths))), [0] * len(lengths), []
    while open_:
        total = sum(weights[i] for i in open_)
        i = generator.choices(open_, weights=[weights[j] / total for j in open_], k=1)[0]
        if taken[i] == lengths[i]:
            if not iterate_over_all:
                return out
            open_.remove(i)
            continue
        out.append((i, taken[i]))
        taken[i] += 1
    return out
