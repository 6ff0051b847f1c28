"""Many generators of Python's ``random`` at once: the first draws of each, step by step over all of them.

A generator is a Mersenne Twister that is filled from the words of its seed. A shuffle
takes draws until one fits, so each generator has its own place among its outputs; one that
comes to their end, or draws a mapping twice, is left to ``random`` itself.
"""

from __future__ import annotations

import functools

import numpy as np

SIZE, AHEAD = 624, 397
#: Outputs that are made together, as they don't need one another.
ROUND = SIZE - AHEAD
#: Generators at once: some 10 MB of state.
AT_ONCE = 4096


@functools.cache
def filled() -> np.ndarray:
    """The state that is mixed with a seed."""
    state, x = np.empty(SIZE, np.uint32), 19650218
    for k in range(SIZE):
        state[k] = x
        x = (1812433253 * (x ^ (x >> 30)) + k + 1) & 0xFFFFFFFF
    return state


def outputs(words: np.ndarray, rounds: int) -> np.ndarray:
    """words: of each generator the four words of its seed, lowest first, the highest not zero. Its first outputs, of one round or two, and a zero behind them."""
    state = np.repeat(filled()[:, None], len(words), axis=1)
    keys = [np.ascontiguousarray(words[:, j] + np.uint32(j)) for j in range(words.shape[1])]
    mixed = np.empty(len(words), np.uint32)

    def step(k: int, factor: int) -> np.ndarray:
        before, own = state[k - 1], state[k]
        np.right_shift(before, 30, out=mixed)
        np.bitwise_xor(mixed, before, out=mixed)
        np.multiply(mixed, np.uint32(factor), out=mixed)
        return np.bitwise_xor(own, mixed, out=own)

    at = 1
    for k in range(SIZE):
        own = step(at, 1664525)
        own += keys[k % len(keys)]
        at += 1
        if at == SIZE:
            state[0], at = state[SIZE - 1], 1
    for _ in range(SIZE - 1):
        own = step(at, 1566083941)
        own -= np.uint32(at)
        at += 1
        if at == SIZE:
            state[0], at = state[SIZE - 1], 1
    state[0] = 0x80000000
    out, x = np.zeros((len(words), rounds * ROUND + 1), np.uint32), state[AHEAD:]
    for at in range(0, rounds * ROUND, ROUND):
        y = (state[at : at + ROUND] & np.uint32(0x80000000)) | (state[at + 1 : at + ROUND + 1] & np.uint32(0x7FFFFFFF))
        x = x ^ (y >> 1) ^ ((y & np.uint32(1)) * np.uint32(0x9908B0DF))
        y = x ^ (x >> 11)
        y ^= (y << 7) & np.uint32(0x9D2C5680)
        y ^= (y << 15) & np.uint32(0xEFC60000)
        y ^= y >> 18
        out[:, at : at + ROUND] = y.T
    return out


def shuffled(drawn: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """``variants.shuffled`` of 0 to size - 1 for each generator; ``place``, where it stands among its outputs, is moved on."""
    rows = np.arange(len(drawn))
    flat, start, last_place = drawn.ravel(), rows * drawn.shape[1], drawn.shape[1] - 1
    own = np.tile(np.arange(size, dtype=np.uint8), (len(drawn), 1))
    for last in range(size - 1, 0, -1):
        shift = 32 - (last + 1).bit_length()
        other = flat[start + place] >> shift
        np.minimum(place + 1, last_place, out=place)
        again = np.flatnonzero(other > last)
        while len(again):
            other[again] = flat[start[again] + place[again]] >> shift
            place[again] = np.minimum(place[again] + 1, last_place)
            again = again[other[again] > last]
        held = own[:, last].copy()
        own[:, last] = own[rows, other]
        own[rows, other] = held
    return own


def signatures(words: np.ndarray, count: int, digits: int, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each generator ``count`` mappings and orders in turn, as ASCII digits (generators, count, size), and whether they hold: outputs sufficed and no mapping came twice."""
    drawn, place = outputs(words, 1 if count * (digits + n_pairs) < ROUND // 2 + 10 else 2), np.zeros(len(words), np.intp)
    mappings, orders = np.empty((len(words), count, digits), np.uint8), np.empty((len(words), count, n_pairs), np.uint8)
    for k in range(count):
        mappings[:, k] = shuffled(drawn, place, digits)
        orders[:, k] = shuffled(drawn, place, n_pairs)
    numbers = np.sort(mappings.astype(np.int64) @ 10 ** np.arange(digits), axis=1)
    holds = (place < drawn.shape[1] - 1) & (numbers[:, 1:] != numbers[:, :-1]).all(axis=1) & (words[:, -1] != 0)
    return mappings + 48, orders + 48, holds
