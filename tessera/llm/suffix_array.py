"""Suffix arrays of small shards, in numpy: Larsson-Sadakane refinement and Kasai's common prefixes.

A shard is a list of byte strings (regions). Suffixes end with their region; an ended suffix stands
before any longer one and equal ended suffixes stand in the order of their regions, so the order is total.
Where a symbol has `step` bytes, only suffixes that start with a symbol are sorted.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """regions: byte strings, none empty, each of whole symbols; step: 1, 2 or 4."""

    def __init__(self, regions: list[bytes], step: int = 1):
        self.step = step
        self.text = np.frombuffer(b"".join(regions), np.uint8)
        self.n = len(self.text)
        sizes = np.array([len(r) for r in regions], np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        #: of each place, its region and where that ends
        self.region = np.repeat(np.arange(len(regions), dtype=np.int32), sizes)
        self.end = np.repeat(ends.astype(np.int32), sizes)
        padded = np.zeros(self.n + 16, np.uint8)
        padded[: self.n] = self.text
        #: 8 bytes from each place on, the first the most significant; beyond the region's end zeros
        word = np.ndarray((self.n + 8,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
        self.word = word
        left = np.minimum(self.end - np.arange(self.n), 8).astype(np.uint64)
        cut = np.uint64(64) - left * np.uint64(8)
        self.first = word[: self.n] >> cut << cut

    def suffixes(self) -> np.ndarray:
        """Places in the order of their suffixes. Groups of equal first h bytes (five at first, or the whole symbols in them) are
        sorted by the group of the suffix h further on, and h doubles; groups of one are left alone."""
        n, step = self.n, self.step
        if not n:
            return np.zeros(0, np.int64)
        place = np.uint64(n.bit_length())
        low = (np.uint64(1) << place) - np.uint64(1)
        small = n < 1 << 24
        h = (5 if small else 8) // step * step
        beside = np.uint64(64 - 8 * h)
        k = self.first[::step] >> beside << beside
        if small:  # these bytes and the place in one number
            k |= np.arange(0, n, step, dtype=np.uint64)
            k.sort()
            own, key = (k & np.uint64((1 << 24) - 1)).astype(np.int64), k >> np.uint64(24)
        else:
            own = np.argsort(k)
            own, key = own * step, k[own]
        # ended suffixes that agree so far differ in length by zero bytes at most, or in their regions; all stand before the others
        left = self.end - np.arange(n, dtype=np.int32)
        ended = left.astype(np.int64) * len(self.starts) + self.region
        beyond = int(ended.max()) + 1
        wide = np.uint64((beyond + n).bit_length())
        packed = 2 * int(place) + int(wide) <= 64
        order, rank, slots = np.empty(len(own), np.int64), np.empty(n, np.int32), np.arange(len(own))
        while True:
            # slots, own: places of the order that aren't settled and who stands there, groups of equal keys together
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(heads, len(slots)))
            group = np.repeat(slots[heads], sizes)  # a group's number is where it begins
            rank[own] = group
            alone = heads[sizes == 1]
            order[slots[alone]] = own[alone]
            live = np.repeat(sizes > 1, sizes)
            slots, own, group = slots[live], own[live], group[live]
            if not len(slots):
                return order
            second = rank.take(own + h, mode="clip") + np.int64(beyond)
            over = np.flatnonzero(left[own] <= h)
            second[over] = ended[own[over]]
            # groups stay where they are: the group comes first in the key
            if packed:
                k = (group.astype(np.uint64) << wide | second.view(np.uint64)) << place | own.view(np.uint64)
                k.sort()
                own, key = (k & low).view(np.int64), k >> place
            else:
                by = np.lexsort((second, group))
                own, second = own[by], second[by]
                key = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])]))
            h *= 2

    def common(self, order: np.ndarray) -> np.ndarray:
        """Bytes that the suffix at each place of the order shares with the one before it, region ends respected.

        Kasai: in the order of the text, a place's common prefix is its left neighbour's less a symbol, unless the symbols
        before the two suffixes differ; only there are bytes compared, eight at a time.
        """
        step = self.step
        symbols = self.text.view(f"u{step}")
        before = np.full(self.n, -1, np.int64)
        before[order[1:]] = order[:-1]
        i = np.arange(0, self.n, step)
        own = before[i]
        # a place carries on from its left neighbour if both suffixes have a left neighbour in their regions and the same one
        carries = np.zeros(len(i), bool)
        ok = (own > 0) & (i > 0)
        a, b = i[ok], own[ok]
        carries[ok] = (self.region[a] == self.region[a - 1]) & (self.region[b] == self.region[b - 1]) & (symbols[a // step - 1] == symbols[b // step - 1])
        base = i[~carries]
        shared = np.zeros(self.n, np.int64)
        live = base[before[base] >= 0]
        other = before[live]
        most = np.minimum(self.end[live] - live, self.end[other] - other)
        done = np.zeros(len(live), np.int64)
        active = np.arange(len(live))
        while len(active):
            at = done[active]
            differ = self.word[live[active] + at] ^ self.word[other[active] + at]
            # bytes that agree from the front: by the place of the highest bit that differs
            same = np.where(differ == 0, 8, 0)
            rest = np.flatnonzero(differ)
            if len(rest):
                d = differ[rest]
                same[rest] = sum((d >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
            done[active] += same
            active = active[(same == 8) & (done[active] < most[active])]
        shared[live] = np.minimum(done, most)
        last = np.maximum.accumulate(np.where(carries, 0, i))
        in_text = np.maximum(shared[last] - (i - last), 0)
        return in_text[order // step]


def repeated(regions: list[bytes], length: int, step: int = 1) -> list[np.ndarray]:
    """For each region, the places where a string of `length` bytes starts that also starts at another place of the shard; with
    symbols of `step` bytes, places where a symbol starts."""
    shard = Shard(regions, step)
    if not shard.n:
        return [np.zeros(0, np.int64) for _ in regions]
    order = shard.suffixes()
    same = shard.common(order) >= length
    hit = same | np.append(same[1:], False)
    places = np.sort(order[hit])
    cuts = np.searchsorted(places, shard.starts[1:])
    return [p - s for p, s in zip(np.split(places, cuts), shard.starts.tolist(), strict=True)]
