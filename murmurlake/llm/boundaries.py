"""Boosted decisions on whether a speaker turn ends between two neighbouring cues.

Recordings with a roster teach them: their labels say where the speaker changes. A bounded sample of such
pairs (``SAMPLE`` rows, the first by a seeded hash) fits gradient-boosted depth-two trees with logistic
loss; the trees become one column expression, so every pair of cues is decided in the JVM. Features are
those of the speech: hesitations, sounds and time stamps are classified token by token and left out, and a
cue of nothing else neither ends a turn nor counts. ``decided_turns`` makes turns of the decisions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.operators.scans import scan_before
from murmurlake.session import materialise

#: The most labelled pairs that are brought to the driver to fit on.
SAMPLE = 20_000
SEED = 11
FEATURES = ("gap", "former_ends", "opens_capital", "marked", "named", "former_words", "words")


@dataclass
class Boosted:
    """Trees as (feature, cut, (feature, cut, low, high) if at most the cut, the same if above)."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, cut, low, high in self.trees:
            side = x[:, f] <= cut
            for (g, c, a, b), rows in ((low, side), (high, ~side)):
                out[rows] += np.where(x[rows, g] <= c, a, b)
        return out

    def column(self, features: list[Column]) -> Column:
        """The log odds as an expression over the feature columns."""

        def leaf(t) -> Column:
            return F.when(features[t[0]] <= float(t[1]), F.lit(float(t[2]))).otherwise(F.lit(float(t[3])))

        total = F.lit(self.base)
        for f, cut, low, high in self.trees:
            total = total + F.when(features[f] <= float(cut), leaf(low)).otherwise(leaf(high))
        return total


def _stump(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rate: float) -> tuple[float, tuple]:
    """The best single split of the rows by gain, with its two leaf values."""
    best, found = 0.0, (0, 0.0, 0.0, 0.0)
    g, h = grad.sum(), hess.sum()
    for f, options in enumerate(cuts):
        at = np.searchsorted(options, x[:, f], side="left")
        gl = np.cumsum(np.bincount(at, grad, len(options) + 1))[:-1]
        hl = np.cumsum(np.bincount(at, hess, len(options) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        if len(gain) and gain.max() > best:
            i = int(np.argmax(gain))
            best, found = float(gain[i]), (f, float(options[i]), rate * gl[i] / (hl[i] + 1), rate * (g - gl[i]) / (h - hl[i] + 1))
    return best, found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Gradient boosting with logistic loss and Newton leaves; deterministic."""
    if not len(y):
        return Boosted()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(base=float(np.log(mean / (1 - mean))))
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        gain, (f, cut, _, _) = _stump(x, grad, hess, cuts, rate)
        if gain <= 1e-6:
            break
        side = x[:, f] <= cut
        low, high = (_stump(x[s], grad[s], hess[s], cuts, rate)[1] for s in (side, ~side))
        tree = (f, cut, low, high)
        score += Boosted(trees=[tree]).score(x)
        model.trees.append(tree)
    return model


def adjacent(cues: DataFrame) -> DataFrame:
    """Each cue that has words with the features of the step from the one before it: owner, o1, o2, id, former_id, features.

    ``cues`` are ``turns.cue_features``. An owner's first such cue has a null ``former_id`` and null features
    of the step. The cue before is found by a blocked scan.
    """
    said = cues.filter("words > 0").withColumns({"said": F.struct("o1", "o2", "id", F.coalesce("ends", "o1").alias("ends"), "closes", "words"), "block": F.shiftright("o1", 28)})
    b = scan_before(said, ["owner"], "block", ["o1", "o2", "id"], "said", "former")
    gap = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (F.col("o1") - F.col("former.ends")) / 1e6))
    return b.select("owner", "o1", "o2", "id", F.col("former.id").alias("former_id"), gap.alias("gap"), F.col("former.closes").alias("former_ends"), "opens_capital", "marked", "named", F.col("former.words").alias("former_words"), "words")


def labelled(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with ``changed``: whether the speaker of the cue's first word differs from that of the former
    cue's last one. ``words`` are word segments with their speakers; pairs without both are left out."""
    per = words.groupBy("owner", "id").agg(F.min_by("speaker_no", "seg").alias("first"), F.max_by("speaker_no", "seg").alias("last"))
    a = per.select("owner", F.col("id").alias("former_id"), F.col("last").alias("was"))
    b = per.select("owner", "id", "first")
    return pairs.join(b, ["owner", "id"]).join(a, ["owner", "former_id"]).withColumn("changed", (F.col("first") != F.col("was")).cast("double"))


def fit_on(pairs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Boosted:
    """Fit on the first ``sample`` labelled pairs in the order of a seeded hash: bounded, and the same every time."""
    rows = pairs.orderBy(F.xxhash64(F.lit(seed), "owner", "id"), "id").select(*FEATURES, "changed").limit(sample).toPandas().to_numpy(dtype=float)
    return fit(rows[:, :-1], rows[:, -1])


def decided(pairs: DataFrame, model: Boosted) -> DataFrame:
    """Pairs with the probability of a change of speaker and the decision; null and true for an owner's first cue."""
    odds = model.column([F.col(f) for f in FEATURES])
    known = F.col("former_id").isNotNull()
    return pairs.withColumn("probability", F.when(known, 1 / (1 + F.exp(-odds)))).withColumn("changes", ~known | (F.col("probability") > 0.5))


def decided_turns(decisions: DataFrame) -> DataFrame:
    """Turns of the cues between decided changes: owner_id, turn_no (from 1), first_id, last_id, cues, probability
    (of the change that opens the turn; null for the first)."""
    order = ["o1", "o2", "id"]
    marked = materialise(decisions.withColumns({"starts": F.col("changes").cast("bigint"), "block": F.shiftright("o1", 28)}))
    numbered = scan_before(marked, ["owner"], "block", order, "starts", "n", fold="sum").withColumn("turn_no", (F.coalesce("n", F.lit(0)) + F.col("starts")).cast("int"))
    place = F.struct(*order)
    per = numbered.groupBy("owner", "turn_no").agg(F.min_by("id", place).alias("first_id"), F.max_by("id", place).alias("last_id"), F.count("*").alias("cues"), F.min_by("probability", place).alias("probability"))
    return per.withColumnRenamed("owner", "owner_id")


def held_out_report(pairs: DataFrame, share: int = 4) -> dict[str, float]:
    """Fit on the labelled ``pairs`` of most owners, judge those of the others (one in ``share`` by hash):
    pairs, base rate of changes, accuracy, precision and recall of changes, and the share of true turns that
    the decisions cut exactly (both ends right)."""
    held = F.pmod(F.xxhash64("owner"), F.lit(share)) == 0
    test = materialise(decided(pairs.filter(held), fit_on(pairs.filter(~held))))
    yes, true = F.col("changes"), F.col("changed") > 0
    row = test.agg(F.count("*").alias("pairs"), F.avg("changed").alias("base"), F.avg((yes == true).cast("int")).alias("accuracy"), F.avg(F.when(yes, true.cast("int"))).alias("precision"), F.avg(F.when(true, yes.cast("int"))).alias("recall")).first()
    both = {}
    for name, c in (("true", "changed > 0"), ("decided", "changes")):
        both[name] = decided_turns(test.withColumn("changes", F.expr(c))).select("owner_id", "first_id", "last_id")
    exact = both["true"].join(both["decided"], ["owner_id", "first_id", "last_id"], "left_semi").count() / max(1, both["true"].count())
    return {**row.asDict(), "exact_turns": exact}
