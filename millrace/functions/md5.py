"""MD5 of many short messages at once, for tasks that hash a number of rows beyond what a call per row can do.

A message is a common head and the decimal digits of a number; the sums are those of ``hashlib.md5``, held as numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Messages that are hashed together: their words stay in a core's cache.
AT_ONCE = 1 << 14
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_POWERS = np.array([10**k for k in range(1, 19)], np.int64)


@cache
def _six() -> np.ndarray:
    """The last six digits of 0 to 999,999 as characters, the first one lowest."""
    n = np.arange(1_000_000)
    return sum(((n // 10 ** (5 - k) % 10 + 48).astype(np.uint64) << np.uint64(8 * k) for k in range(6)), np.uint64(0))


def _digits(numbers: np.ndarray, width: int) -> list[tuple[np.ndarray, int]]:
    """Numbers of ``width`` digits as (characters, how many), the first ones in front."""
    out = []
    while width > 6:
        higher = numbers // 1_000_000
        out.append((_six()[numbers - higher * 1_000_000], 6))
        numbers, width = higher, width - 6
    out.append((_six()[numbers] >> np.uint64(8 * (6 - width)), width))
    return out[::-1]


def _block(words: list, n: int, state: list[np.ndarray]) -> list[np.ndarray]:
    """The state after one block of 16 words, each of which is an int or an array of ``n``."""
    u = np.uint32
    a, b, c, d = (np.broadcast_to(s, n).copy() for s in state)
    f, t = np.empty(n, u), np.empty(n, u)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[_WORD[i]]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, u((_ADD[i] + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, u(_ADD[i]), out=f)
        np.left_shift(f, u(_TURN[i]), out=t)
        np.right_shift(f, u(32 - _TURN[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return [x + s for x, s in zip((a, b, c, d), state)]


def _sums(head: bytes, tail: list[tuple[np.ndarray, int]], n: int) -> list[np.ndarray]:
    """The four words of the sums of ``head`` with ``n`` tails, whose characters are given as ``_digits`` does."""
    width = sum(k for _, k in tail)
    state = [np.full(1, x, np.uint32) for x in _START]
    whole = len(head) // 64 * 64
    for at in range(0, whole, 64):
        state = _block(np.frombuffer(head[at : at + 64], "<u4").tolist(), 1, state)
    rest = head[whole:]
    body = bytearray(((len(rest) + width + 8) // 64 + 1) * 64)
    body[: len(rest)] = rest
    body[len(rest) + width] = 0x80
    body[-8:] = (8 * (len(head) + width)).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(body), "<u4").tolist()
    # Characters are put into 64-bit lanes, which hold two words each.
    lanes: dict[int, np.ndarray] = {}
    at = len(rest)
    for value, k in tail:
        lane, shift = at // 8, at % 8 * 8
        parts = [(lane, value << np.uint64(shift))] + ([(lane + 1, value >> np.uint64(64 - shift))] if shift + 8 * k > 64 else [])
        for i, x in parts:
            lanes[i] = lanes[i] | x if i in lanes else x
        at += k
    for i, x in lanes.items():
        words[2 * i] = x.astype(np.uint32) | np.uint32(words[2 * i])
        words[2 * i + 1] = (x >> np.uint64(32)).astype(np.uint32) | np.uint32(words[2 * i + 1])
    for at in range(0, len(words), 16):
        state = _block(words[at : at + 16], n, state)
    return state


def _widths(numbers: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray]]:
    """How many digits numbers have, and which of them."""
    low, high = (len(str(x)) for x in (numbers.min(), numbers.max()))
    if low == high:
        yield low, slice(None)
        return
    widths = np.searchsorted(_POWERS, numbers, "right") + 1
    yield from ((w, widths == w) for w in np.unique(widths).tolist())


def md5_numbers(head: bytes, numbers: np.ndarray, last: bool = False) -> np.ndarray:
    """MD5 of ``head`` and the decimal digits of every number from 0 on: its first or its last 64 bits, which sort as its text does."""
    out = np.empty(len(numbers), np.uint64)
    for at in range(0, len(numbers), AT_ONCE):
        part = numbers[at : at + AT_ONCE]
        for width, here in _widths(part):
            own = part[here]
            a, b = _sums(head, _digits(own, width), len(own))[2 * last : 2 * last + 2]
            out[at : at + AT_ONCE][here] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    return out


def md5_prefixes(head: bytes, numbers: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of the same, 16 at most."""
    out = np.empty(len(numbers), np.uint16)
    for at in range(0, len(numbers), AT_ONCE):
        part = numbers[at : at + AT_ONCE]
        for width, here in _widths(part):
            own = part[here]
            out[at : at + AT_ONCE][here] = _sums(head, _digits(own, width), len(own))[0].astype(np.uint16).byteswap() >> np.uint16(16 - bits)
    return out
