"""Mixing sources to target weights, measured in tokens.

Budgets are handed down a tree (for instance domain, language, source). Every node passes its budget to
its children by weight; a child that cannot take its part, even if all its records are repeated as often
as allowed, leaves a shortage that its siblings take over by weight as far as they can, and only what a
whole family cannot take goes up to the parent's siblings. The tree has one row per leaf, so it is small
and solved on the driver; the number of leaves is checked.

Each leaf then takes whole seeded epochs, and of its last epoch a prefix in seeded random order. The
prefix is found without sorting a leaf in one task: records fall into hash blocks of their seeded order,
the blocks' token sums are scanned, and only the block in which the budget ends is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.operators.scans import scan_before

#: The largest tree that is solved on the driver.
MAX_LEAVES = 100_000
BLOCK_BITS = 12


@dataclass
class Node:
    """A node of the budget tree; leaves have a capacity in tokens."""

    weight: float
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: float = 0.0

    def limit(self) -> float:
        return sum(c.limit() for c in self.children.values()) if self.children else self.capacity


def share_out(amount: float, nodes: Sequence[tuple[float, float]]) -> list[float]:
    """Split ``amount`` over (weight, limit) pairs by weight; what one cannot take goes to the others.

    Never exceeds a limit. The sum is ``amount`` unless all limits are reached. Zero weights get nothing.
    """
    given = [0.0] * len(nodes)
    open_ = [i for i, (w, limit) in enumerate(nodes) if w > 0 and limit > 0]
    left = amount
    while open_ and left > 1e-9:
        total = sum(nodes[i][0] for i in open_)
        full = [i for i in open_ if nodes[i][1] - given[i] <= left * nodes[i][0] / total]
        if not full:
            for i in open_:
                given[i] += left * nodes[i][0] / total
            return given
        for i in full:
            left -= nodes[i][1] - given[i]
            given[i] = nodes[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def hand_down(node: Node, amount: float) -> None:
    """Give ``amount`` to ``node`` and its descendants; siblings take over shortages before ancestors' siblings."""
    node.budget = min(amount, node.limit())
    kids = list(node.children.values())
    for kid, part in zip(kids, share_out(node.budget, [(k.weight, k.limit()) for k in kids])):
        hand_down(kid, part)


def leaf_budgets(leaves: Sequence[tuple[Sequence[str], Sequence[float], float]], amount: float) -> dict[tuple[str, ...], float]:
    """Budgets of leaves given as (path, weights along the path, capacity)."""
    root = Node(1.0)
    for path, weights, capacity in leaves:
        node = root
        for name, weight in zip(path, weights):
            node = node.children.setdefault(name, Node(weight))
        node.capacity = capacity
    hand_down(root, amount)
    found = {}
    for path, _, _ in leaves:
        node = root
        for name in path:
            node = node.children[name]
        found[tuple(path)] = node.budget
    return found


def mix(sizes: DataFrame, leaf: Sequence[str], record: str, size: str, budgets: DataFrame, seed: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The records taken: all columns of ``sizes`` and ``epoch`` (from 1), one row for each time taken.

    ``budgets`` has the leaf's columns, ``full`` (whole epochs) and ``rest`` (tokens of the next, partial
    epoch). A record of the partial epoch is taken if more than half of it lies within ``rest``, so a leaf
    misses its budget by at most half of one record. Null or zero sizes are taken with whole epochs only.
    """
    order = F.xxhash64(F.lit(seed), F.col("full") + 1, F.col(record))
    keyed = (
        sizes.join(budgets, list(leaf))
        .withColumn("__order", order)
        .withColumn("__block", F.shiftright("__order", 64 - block_bits))
        .withColumn("__size", F.coalesce(F.col(size), F.lit(0)))
    )
    placed = scan_before(keyed, leaf, "__block", ["__order", record], "__size", "__before", fold="sum")
    in_rest = (F.col("__size") > 0) & (F.coalesce("__before", F.lit(0)) + F.col("__size") / 2 <= F.col("rest"))
    epochs = F.when(in_rest, F.col("full") + 1).otherwise(F.col("full"))
    taken = placed.withColumn("__epochs", epochs.cast("int")).filter(F.col("__epochs") > 0)
    return taken.select(*sizes.columns, F.explode(F.sequence(F.lit(1), F.col("__epochs"))).alias("epoch"))
