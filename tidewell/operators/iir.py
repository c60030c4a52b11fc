"""Cascaded integer biquads whose state lives on from call to call."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Biquad:
    """One stage: coefficients in units of 2**-b_bits, p_bits more of precision, output shifted right."""

    b0: int
    b1: int
    b_bits: int
    p_bits: int
    shift: int


class Bank:
    """Stages in a row with their two delays each."""

    def __init__(self, stages: list[Biquad], state: list[list[int]] | None = None):
        self.stages = stages
        self.state = [list(s) for s in state] if state else [[0, 0] for _ in stages]

    def apply(self, samples) -> list[int]:
        out = []
        for x in samples:
            # halves go away from zero
            x = int(math.copysign(math.floor(abs(x) + 0.5), x))
            for stage, w in zip(self.stages, self.state):
                feedback = (stage.b1 * w[0] - stage.b0 * w[1]) >> stage.b_bits
                newest = (x << stage.p_bits) - feedback
                w[0], w[1] = w[1], newest
                # the output mixes the delays after they moved on
                x = (w[0] + 2 * w[1] + newest) >> stage.shift
            out.append(x)
        return out


class Lanes:
    """A bank for many detectors at once: one step takes a sample of each of them."""

    def __init__(self, stages: list[Biquad]):
        self.stages = stages
        self.lane: dict[int, int] = {}
        self.state = np.zeros((len(stages), 2, 0), np.int64)

    def of(self, dets: np.ndarray) -> np.ndarray:
        """Lanes of detectors; new ones begin at rest."""
        names, place = np.unique(dets, return_inverse=True)
        got = np.array([self.lane.setdefault(d, len(self.lane)) for d in names.tolist()], np.int64)
        if len(self.lane) > self.state.shape[2]:
            more = np.zeros((*self.state.shape[:2], max(len(self.lane), 2 * self.state.shape[2])), np.int64)
            more[:, :, : self.state.shape[2]] = self.state
            self.state = more
        return got[place]

    def step(self, lanes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Outputs for one sample of different lanes."""
        for k, stage in enumerate(self.stages):
            older, newer = self.state[k, 0, lanes], self.state[k, 1, lanes]
            newest = (x << stage.p_bits) - ((stage.b1 * older - stage.b0 * newer) >> stage.b_bits)
            self.state[k, 0, lanes], self.state[k, 1, lanes] = newer, newest
            x = (newer + 3 * newest) >> stage.shift
        return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero."""
    return x if x.dtype.kind == "i" else np.copysign(np.floor(np.abs(x) + 0.5), x).astype(np.int64)


def filtered(tod: DataFrame, stages: list[Biquad]) -> DataFrame:
    """det, samp, z: every detector's samples through a fresh bank.

    Detectors are dealt to groups, and a group's samples pass in order of samp,
    so that one numpy step serves all its detectors; only their delays are held.
    """
    spark = tod.sparkSession
    kind = dict(tod.dtypes)["samp"]
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, bank = None, None
        for batch in batches:
            group, det, samp = (batch.column(k).to_numpy() for k in range(3))
            x = rounded(batch.column(3).to_numpy(zero_copy_only=False))
            # a step is one sample number of one group
            new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (samp[1:] != samp[:-1]))))
            z = np.empty(len(x), np.int64)
            begun = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            lanes = np.empty(len(x), np.int64)
            banks = []
            for a, e in zip(begun.tolist(), [*begun[1:].tolist(), len(x)]):
                if group[a] != at:
                    at, bank = group[a], Lanes(stages)
                lanes[a:e] = bank.of(det[a:e])
                banks += [bank] * int(np.count_nonzero((new >= a) & (new < e)))
            for one, a, e in zip(banks, new.tolist(), [*new[1:].tolist(), len(x)]):
                z[a:e] = one.step(lanes[a:e], x[a:e])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(z)], ["det", "samp", "z"])

    rows = tod.select(F.pmod(F.xxhash64("det"), F.lit(groups)).alias("group"), F.col("det").cast("long").alias("det"), "samp", "y")
    return rows.repartition("group").sortWithinPartitions("group", "samp", "det").mapInArrow(run, f"det long, samp {kind}, z long")
