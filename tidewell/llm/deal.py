"""Packets on their way between parts and shards, in hops of bounded fan-out.

Every part has something for nearly every shard and hears from it again, so one
packet from each to each grows with the square of the input.  Here a place sends
to at most ``FAN`` others in a hop: after hop i a packet stands where the first i
digits are those of its goal and the others those of where it came from.  Packets
that meet are merged and split anew, so a hop has at most FAN of them for each
place, whatever the number of places.
"""

from __future__ import annotations

import numpy as np

FAN = 1024


class Route:
    """Ways between `width` places in as few hops as `fan` allows."""

    def __init__(self, width: int, fan: int = FAN):
        self.width, self.hops, self.radix = width, 1, 1
        while fan**self.hops < width:
            self.hops += 1
        while self.radix**self.hops < width:
            self.radix += 1

    def goal(self, hashed: np.ndarray) -> np.ndarray:
        """The place that a hash belongs to."""
        return (hashed % np.uint64(self.width)).astype(np.int64)

    def toward(self, here: int, goal: np.ndarray, hop: int) -> np.ndarray:
        """Where things at `here` stand after this hop (from 0); after the last one it is their goal, from wherever they began."""
        unit = self.radix ** (self.hops - 1 - hop)
        return goal - goal % unit + here % unit


def picks(to: np.ndarray):
    """Each place in `to`, with the entries that go there."""
    if len(to):
        order = np.argsort(to, kind="stable")
        places, at = np.unique(to[order], return_index=True)
        yield from zip(places.tolist(), np.split(order, at[1:]))
