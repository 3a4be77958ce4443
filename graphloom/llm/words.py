"""Words of many texts at once, as numpy arrays: spans, owners and 64-bit hashes.

A hash is polynomial over the word's bytes, from running sums, and then mixed; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import regex
import xxhash

#: Bytes over which one running sum goes; a longer word is hashed by itself.
REACH = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edge[::2], edge[1::2]


class Hasher:
    """Made once a task: holds the powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self) -> None:
        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = (np.full(REACH + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        self.power[0] = self.inverse[0] = 1
        self.power, self.inverse = np.cumprod(self.power), np.cumprod(self.inverse)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; the spans are sorted and don't overlap."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = int(np.searchsorted(ends, base + REACH, "right"))
            if j <= i:
                out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
                i += 1
                continue
            part = data[base : ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.byte[part] * self.power[: len(part)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * self.inverse[s]
            i = j
        return mix(out)


def batches(texts: Sequence[str | None], size: int = REACH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, the texts' bytes with a newline before each, where each begins)."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and total + len(b) > size:
            yield first, *_joined(held)
            first, held, total = i, [], 0
        held.append(b)
        total += len(b) + 1
    if held:
        yield first, *_joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum([0, *(len(b) + 1 for b in held[:-1])]) + 1
    return np.frombuffer(b"\n" + b"\n".join(held), np.uint8), at


def spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans between ASCII white space."""
    return runs(data > 32)


def letters() -> np.ndarray:
    """Per code point: 2 for letters (category L), 1 for marks (M), which go on with a word, else 0. To be made once a task."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for pattern, kind in ((r"\p{L}+", 2), (r"\p{M}+", 1)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Letters:
    """Made once a task: finds runs of letters."""

    def __init__(self) -> None:
        self.ascii, self.kinds = np.zeros(256, bool), letters()
        self.ascii[97:123] = True
        self.ascii[128:] = True

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In lower-cased UTF-8: a to z, and beyond ASCII what Unicode calls a letter or a mark."""
        inside = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead]
            for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
                at = lead[(first >= low) & (first < high)]
                if not len(at):
                    continue
                point = (data[at] & mask).astype(np.int64)
                for k in range(1, size):
                    point = point << 6 | data[at + k] & 0x3F
                other = at[self.kinds[np.minimum(point, 0x10FFFF)] == 0]
                for k in range(size):
                    inside[other + k] = False
        return runs(inside)


def owners(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text of every span."""
    return np.searchsorted(begins, starts, "right") - 1
