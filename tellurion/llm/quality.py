"""A quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a
linear model with hinge loss fitted by dual coordinate descent.

Indicators are hashed byte n-grams (1 to 3 bytes) and n-grams over a text's repetition
pattern (whether a word equals the one before it; 1 to 4 words). The class
counts behind the ratios are taken over every labelled training row; the linear model is
fitted on at most `fit_rows` of them, chosen by a hash of the id. Labels that contradict
each other for one id are left out. Without labels of both classes every score is 0.5.

Null and empty texts have no indicators and score by the bias alone. Any text is read
whole. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
FIT_ROWS = 4000
#: Up to so many label rows (16 bytes each) are broadcast to the texts; beyond that both sides are shuffled.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3

_MULTIPLY = np.uint32(2654435761)


def indicators(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text."""
    raw = (text or "").encode()
    if not raw:
        return np.empty(0, np.int32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = [b]
    if len(b) > 1:
        two = (b[:-1] << 8) | b[1:]
        grams.append(two + 0x100)
        if len(b) > 2:
            grams.append(((two[:-1] << 8) | b[2:]) + 0x20000)
    words = raw.split()
    if len(words) > 1:
        same = np.fromiter(map(bytes.__eq__, words[1:], words), np.uint32, len(words) - 1)
        wide = [same + 0x2000000]
        for n in (2, 3, 4):
            if len(same) >= n:
                code = same[: len(same) - n + 1].copy()
                for k in range(1, n):
                    code = (code << 1) | same[k : len(same) - n + 1 + k]
                wide.append(code + np.uint32(0x2000000 + 0x100 * n))
        grams += wide
    seen = np.zeros(1 << bits, bool)
    for g in grams:
        seen[(g * _MULTIPLY) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """score = sigmoid(a * (weights . indicators + bias) + b)"""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    bits: int = BITS

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() + self.bias)

    def score_text(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(indicators(text, self.bits)) + self.b, -40, 40))))


def descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss; an indicator's value is its ratio. Gives weights and bias."""
    w, bias = np.zeros(len(ratio)), 0.0
    norms = np.array([float((ratio[r] ** 2).sum()) + 1.0 for r in rows])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            slope = signs[i] * (float(w[r] @ x) + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[r] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]) * norms[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, b)


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, bits: int = BITS, fit_rows: int = FIT_ROWS, smoothing: float = 1.0, cost: float = 0.1, blend: float = 0.75) -> Model:
    """Fit on docs(doc_id, text) and labels(doc_id, quality); keep: condition on labels' doc_id, None for all."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("good")).filter("doc_id is not null and good in (0, 1)")
    if keep is not None:
        marked = marked.filter(keep)
    marked = marked.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("most")).filter("good = most").select("doc_id", "good")
    texts = docs.select("doc_id", "text")

    def joined(side: DataFrame, small: bool) -> DataFrame:
        return texts.join(F.broadcast(side) if small else side.hint("shuffle_hash"), "doc_id")

    def counted(batches):
        for batch in batches:
            total = np.zeros((2, 1 << bits), np.int64)
            n = np.zeros(2, np.int64)
            for text, good in zip(batch.text, batch.good, strict=True):
                total[good][indicators(text, bits)] += 1
                n[good] += 1
            at = np.flatnonzero(total.any(axis=0))
            yield pd.DataFrame({"at": np.append(at, -1), "bad": np.append(total[0][at], n[0]), "good": np.append(total[1][at], n[1])})

    counts = joined(marked, marked.count() <= BROADCAST_LABELS).select("text", "good").mapInPandas(counted, "at int, bad long, good long")
    table = counts.groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # at most 2 ** bits + 1 rows
    rows = table[table["at"] < 0]
    if rows.empty or not int(rows.bad.iloc[0]) or not int(rows.good.iloc[0]):
        return Model(np.zeros(1 << bits), 0.0, 1.0, 0.0, bits)
    table = table[table["at"] >= 0]
    bad, good = np.full(1 << bits, smoothing), np.full(1 << bits, smoothing)
    bad[table["at"]] += table.bad
    good[table["at"]] += table.good
    used = np.zeros(1 << bits, bool)
    used[table["at"]] = True
    ratio = np.where(used, np.log(good / good.sum()) - np.log(bad / bad.sum()), 0.0)

    chosen = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), "doc_id").limit(fit_rows)
    packed = F.pandas_udf(lambda t: pd.Series([indicators(x, bits).tobytes() for x in t], dtype=object), "binary")
    sample = joined(chosen, True).select("doc_id", "good", packed("text").alias("found")).orderBy(F.xxhash64("doc_id", "found")).limit(fit_rows).collect()
    found = [np.frombuffer(r.found, np.int32) for r in sample]
    good = np.array([r.good for r in sample])
    if len(set(good.tolist())) < 2:
        return Model(np.zeros(1 << bits), 0.0, 1.0, 0.0, bits)
    held = np.arange(len(sample)) % 4 == 0  # for the sigmoid
    fit = [f for f, h in zip(found, held, strict=True) if not h]
    signs = np.where(good[~held] == 1, 1.0, -1.0)
    if len(set(signs.tolist())) < 2 or len(set(good[held].tolist())) < 2:
        held[:] = True
        fit, signs = found, np.where(good == 1, 1.0, -1.0)
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    w, bias = descend(fit, signs, ratio, cost * 0.5 / share)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    weights = ratio * ((1 - blend) * mean + blend * w)
    model = Model(weights.astype(np.float64), bias, 1.0, 0.0, bits)
    check = [f for f, h in zip(found, held, strict=True) if h]
    model.a, model.b = calibrate(np.array([model.margin(f) for f in check]), good[held])
    return model


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher for better texts. The model's size is fixed by its bits, so it travels with the function."""
    weights = model.weights.astype(np.float32)
    small = Model(weights, model.bias, model.a, model.b, model.bits)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([small.score_text(t) for t in texts], dtype="float64")

    return scored(text)


def accepted(score_column: Column, threshold: float = THRESHOLD) -> Column:
    return score_column >= threshold
