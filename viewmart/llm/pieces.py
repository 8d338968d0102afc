"""Texts as pieces between spaces, each piece known by its bytes.

Tokenizers, and unigram models alike, treat most pieces of a corpus again and again. Pieces are
found and hashed with numpy over the UTF-8 bytes of many texts, and compared with the piece that their
hash stands for; a result is computed once for each distinct piece that a worker does not remember.
"""

import hashlib
from collections.abc import Callable

import numpy as np

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _powers_of_step(n: int) -> np.ndarray:
    """The first n powers of STEP, modulo 2**64; kept up to a bounded length."""
    global _powers
    if n > len(_powers):
        powers = np.full(n, STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        if n > 1 << 16:
            return powers
        _powers = powers
    return _powers[:n]


def white_space(data: np.ndarray) -> np.ndarray:
    """Marks every byte of a white-space character, those beyond ASCII and four controls included."""
    space = ASCII_SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.r_[data[lead[0] :], np.zeros(2, np.uint8)]
        a, b, c = (padded[lead - lead[0] + k].astype(np.int32) for k in range(3))
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        code = (a & 15) << 12 | (b & 63) << 6 | (c & 63)
        three = (a != 0xC2) & (
            (code == 0x1680) | ((code >= 0x2000) & (code <= 0x200A))
            | np.isin(code, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
        )
        space[np.r_[lead[two], lead[two] + 1, lead[three], lead[three] + 1, lead[three] + 2]] = True
    return space


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at every non-empty text, and at every space between two other characters.

    A piece holds the space before it, so the pieces of a text are the text.
    """
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(data):
        return starts
    space = white_space(data)
    cut = data == 32
    cut[1:] &= ~space[:-1]
    cut[:-1] &= ~space[1:]
    cut[starts] = True
    cut[offsets[1:][np.diff(offsets) > 0] - 1] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def hash_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes from one start to the next."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.r_[starts, len(data)])
    powers = _powers_of_step(int(sizes.max()))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    value = BYTE_VALUE[data]
    value *= powers[place]
    total = np.add.reduceat(value, starts)
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return total + sizes.astype(np.uint64)


#: Pieces up to this long are compared in words of eight bytes and remembered as they are.
SHORT = 64


def unlike(data: np.ndarray, starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each piece differs from another one, whose number is given, in any byte."""
    sizes = np.diff(np.r_[starts, len(data)])
    result = sizes != sizes[other]
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((other != np.arange(len(starts))) & ~result)
    for low in range(0, SHORT, 8):
        left = left[sizes[left] > low]
        if not len(left):
            return result
        spare = np.maximum(0, 64 - 8 * (sizes[left] - low)).astype(np.uint64)  # bits beyond the piece
        result[left] = ((words[starts[left] + low] ^ words[starts[other[left]] + low]) << spare) != 0
        left = left[~result[left]]
    for i in left[sizes[left] > SHORT].tolist():
        a, b, n = starts[i], starts[other[i]], sizes[i]
        result[i] = not np.array_equal(data[a : a + n], data[b : b + n])
    return result


def piece_key(piece: bytes) -> bytes:
    """The piece, or for a long one its SHA-256 after a byte that no text holds."""
    return piece if len(piece) <= SHORT else b"\xff" + hashlib.sha256(piece).digest()


class PieceMemo:
    """Numbers distinct pieces; ``learn`` is called with the bytes of those that are new.

    It forgets everything before it would hold more than ``limit`` pieces, unless one call alone
    brings more; ``forget`` is then called too.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], limit: int):
        self.learn, self.forget, self.limit = learn, forget, limit
        self.number: dict[bytes, int] = {}

    def clear(self) -> None:
        """Called at the end of a task, as the next one on this worker may be of another job."""
        self.number = {}
        self.forget()

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece."""
        hashes = hash_runs(data, starts)
        _, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        # Pieces that only share a hash stand for themselves.
        odd = np.flatnonzero(unlike(data, starts, example[inverse]))
        inverse[odd] = len(example) + np.arange(len(odd))
        example = np.r_[example, odd]
        if len(self.number) + len(example) > self.limit:
            self.clear()
        ends, whole = np.r_[starts[1:], len(data)], data.tobytes()
        pieces = [whole[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        keys = [piece if len(piece) <= SHORT else piece_key(piece) for piece in pieces]
        known = self.number
        first = len(known)
        numbers = np.fromiter((known.setdefault(key, len(known)) for key in keys), np.int64, len(keys))
        fresh = numbers >= first
        if fresh.any():
            # Two odd pieces may be equal, so a number may come twice.
            new, at = np.unique(numbers[fresh], return_index=True)
            chosen = np.flatnonzero(fresh)[at].tolist()
            self.learn([pieces[k] for k in chosen])
        return numbers[inverse]


def sum_by_text(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's pieces; 0 for an empty text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    place = np.searchsorted(starts, offsets)
    return total[place[1:]] - total[place[:-1]]
