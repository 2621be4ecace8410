"""Links between 64-bit fingerprints within a Hamming radius: pigeonhole shards, a BK-tree in each.

Two fingerprints that differ in at most r bits agree on at least n - r of any n blocks of bits. A shard holds the
fingerprints that agree on one choice of blocks, so each pair within the radius meets in a shard. Shards are dealt by
shuffle. In a shard, a BK-tree keeps each child under its integer distance to the parent, and a search within r follows
only edges of distances d - r to d + r. A shard of more than `limit` fingerprints is dealt again by blocks of its
remaining bits, in which the same argument holds, until it is small: nothing is dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import written

LIMIT = 4096
FEW = 8
ALL = (1 << 64) - 1


def split_masks(free: int, blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` among `blocks` runs of the bits in `free`."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [sum(1 << i for i in bits[len(bits) * j // blocks : len(bits) * (j + 1) // blocks]) for j in range(blocks)]
    return [sum(c) for c in combinations(cut, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.value.append(x)
        self.children.append({})
        at, new = 0, len(self.value) - 1
        while at != new:
            at = self.children[at].setdefault((x ^ self.value[at]).bit_count(), new)

    def near(self, x: int, radius: int):
        """Numbers of the values within the radius, in the order of a depth-first walk."""
        todo = [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


class Sets:
    """Disjoint sets of numbers 0, 1, 2, ..."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def shard_links(values: list[int], radius: int, texts: list[str] | None = None, like=None, met: list[int] = ()) -> list[tuple[int, int]]:
    """A spanning forest of the links among values (numbers in the list): within the radius, and like(text, text) where texts are given.

    Pairs that agree on one of the masks in `met` are left to the shard of that mask.
    """
    tree, sets, out = BKTree(), Sets(), []
    for i, x in enumerate(values):
        sets.up.append(i)
        for j in tree.near(x, radius):
            if (a := sets.root(i)) == (b := sets.root(j)):
                continue
            apart = x ^ values[j]
            if all(apart & m for m in met) and (like is None or like(texts[i], texts[j])):
                sets.up[max(a, b)] = min(a, b)
                out.append((j, i))
        tree.add(x)
    return out


def _shards(radius: int, masks: list[int], limit: int, like):
    """Streams rows (mask, fp, id[, text]) sorted by shard; yields links (a, b), or the rows of large shards dealt anew (a = b = null)."""
    with_text = like is not None
    names = ["mask", "fp", "id", *["text"] * with_text]
    earlier = {m: masks[:i] for i, m in enumerate(masks)}

    def rows(out: list[tuple], links: list[tuple[int, int]]) -> pa.RecordBatch:
        cols = [pa.array([x[0] for x in links] + [None] * len(out), pa.int64()), pa.array([x[1] for x in links] + [None] * len(out), pa.int64())]
        for k, n in enumerate(names):
            cols.append(pa.array([None] * len(links) + [x[k] for x in out], pa.string() if n == "text" else pa.int64()))
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", *names])

    def again(mask: int, held: list[tuple]) -> list[tuple]:
        deeper = [(mask & ALL) | m for m in split_masks(ALL & ~mask, radius + 1, 1)]
        return [(signed(m), *x[1:]) for x in held for m in deeper]

    def run(batches):
        key, held, large, links = None, [], False, []

        def done():
            if len(held) > 1 and not large:
                # in a small shard pairs are rather left to an earlier one; in a large one few are looked at, as most are connected
                met = earlier.get(key[0] & ALL, ()) if len(held) <= FEW else ()
                found = shard_links([x[1] & ALL for x in held], radius, [x[3] for x in held] if with_text else None, like, met)
                links.extend((held[i][2], held[j][2]) for i, j in found)

        for batch in batches:
            mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(mask):
                continue
            value = mask & fp
            cut = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
            end = np.append(cut[1:], len(mask))
            # shards of one row matter only where they may go on in a batch before or after
            some = (end - cut > 1) | (cut == 0) | (end == len(mask))
            columns = [c.to_pylist() if n == "text" else c.to_numpy(zero_copy_only=False).tolist() for n, c in zip(names, batch.columns)]
            for i, j in zip(cut[some].tolist(), end[some].tolist()):
                if key != (k := (int(mask[i]), int(value[i]))):
                    done()
                    key, held, large = k, [], False
                held += zip(*(c[i:j] for c in columns))
                if len(held) > limit and ALL & ~key[0]:
                    large = True
                if large and held:
                    yield rows(again(key[0], held), [])
                    held = []
            if len(links) > 10_000:
                yield rows([], links)
                links = []
        done()
        yield rows([], links)

    return run


def links(fps: DataFrame, radius: int, blocks: int, like=None, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between ids of fps (id long, fp long[, text]), enough to connect all that are within the radius.

    like(text, text), if given, decides on pairs within the radius. A pair is looked at in the first shard that it shares.
    Null fingerprints link with nothing.
    """
    cols = ["fp", "id", *["text"] * (like is not None)]
    masks = split_masks(ALL, blocks, blocks - radius)
    shards = fps.where("fp IS NOT NULL").select(F.explode(F.array(*(F.lit(signed(m)).cast("long") for m in masks))).alias("mask"), *cols)
    schema = "a long, b long, mask long, fp long, id long" + ", text string" * (like is not None)
    value = F.col("fp").bitwiseAND(F.col("mask"))
    found = []
    while True:
        dealt = shards.repartition(F.col("mask"), value).sortWithinPartitions(F.col("mask"), value)
        out = written(dealt.mapInArrow(_shards(radius, masks, limit, like), schema))
        found.append(out.where("a IS NOT NULL").select("a", "b"))
        shards = out.where("a IS NULL").select("mask", *cols)
        if shards.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every
