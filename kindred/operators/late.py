"""Late interaction, pooling, windows and signals of ragged arrays (V21-V31, T4, ST2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def window_starts(n: Column, width: int, hop: int) -> Column:
    """Starts 0, hop, ... that fit, and an end-aligned last window; [0] for short inputs."""
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(n - width, F.lit(0)).cast("long"), F.lit(hop).cast("long"))
    return F.when(n <= width, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(regular, F.array((n - width).cast("long")))))


def budget(v: Column, b: int) -> Column:
    """B entries at rint(linspace(0, n - 1, b)); one entry is the first."""
    if b == 1:
        return F.slice(v, 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.element_at(v, (F.rint(i * (F.size(v) - 1) / F.lit(b - 1.0)) + 1).cast("int")))


def maxsim(a: Column, b: Column) -> Column:
    """Mean over both sides of each window's best partner."""
    one = lambda x, y: F.aggregate(F.transform(x, lambda p: F.array_max(F.transform(y, lambda q: dot(p, q)))), F.lit(0.0), lambda s, m: s + m) / F.size(x)
    return (one(a, b) + one(b, a)) / 2


def pooled(windows: DataFrame, by: str, start: str, width: int, vec: str) -> DataFrame:
    """Mean weighted by the stretch between the midpoints of neighbouring window centres."""
    w = Window.partitionBy(by).orderBy(start)
    centre = F.col(start) + width / 2
    low = F.coalesce((F.lag(centre).over(w) + centre) / 2, F.col(start).cast("double"))
    high = F.coalesce((F.lead(centre).over(w) + centre) / 2, F.col(start) + F.lit(float(width)))
    flat = windows.withColumn("_w", high - low).select(by, "_w", F.posexplode(vec).alias("pos", "x"))
    flat = flat.groupBy(by, "pos").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec))


def repeated_scores(windows: DataFrame, by: str, pos: str, vec: str, gap: int) -> DataFrame:
    """Each window's best similarity to a window of the same set at least `gap` away."""
    a, b = windows.select(by, pos, vec), windows.select(by, F.col(pos).alias("_p"), F.col(vec).alias("_v"))
    pairs = a.join(b, by).where(F.abs(F.col(pos) - F.col("_p")) >= gap)  # windows of one track only
    return pairs.groupBy(by, pos).agg(F.max(dot(F.col(vec), F.col("_v"))).alias("score"))


def salient_scores(windows: DataFrame, by: str, pos: str, vec: str, whole: str) -> DataFrame:
    """(1 - similarity to the whole) + half the larger change to a neighbour."""
    w = Window.partitionBy(by).orderBy(pos)
    change = lambda other: F.coalesce(1 - dot(F.col(vec), other), F.lit(0.0))
    return windows.withColumn("score", (1 - dot(F.col(vec), F.col(whole))) + 0.5 * F.greatest(change(F.lag(vec).over(w)), change(F.lead(vec).over(w)))).select(by, pos, "score")


def diverse_top(scored: DataFrame, by: str, pos: str, n: int, gap: int) -> DataFrame:
    """T4: greedy best windows at least `gap` apart, then filled up by score; one bounded set per group."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", pos], ascending=[False, True], kind="stable")
        at, chosen = pdf[pos].to_numpy(), []
        for p in at:
            if len(chosen) < n and all(abs(p - c) >= gap for c in chosen):
                chosen.append(p)
        chosen += [p for p in at if p not in chosen][: max(0, n - len(chosen))]
        return pd.DataFrame({by: pdf[by].iloc[0], pos: chosen, "rank": np.arange(1, len(chosen) + 1)})

    return scored.groupBy(by).applyInPandas(pick, f"{by} long, {pos} long, rank long")


def frozen(v: Column, b: int) -> Column:
    """Exactly b entries at even places, for any number of entries; null for none."""
    return F.when(F.size(v) > 0, budget(v, b))


def ranked_prefix(v: Column, b: int) -> Column:
    """The first b entries; fewer are spread and repeated."""
    return F.when(F.size(v) >= b, F.slice(v, 1, b)).otherwise(frozen(v, b))


def section_maxsim(repeated: Column, salient: Column, other_repeated: Column, other_salient: Column, b: int) -> Column:
    """Mean of both kinds of sections' MaxSim at the budget."""
    one = lambda x, y: maxsim(ranked_prefix(x, b), ranked_prefix(y, b))
    return 0.5 * (one(repeated, other_repeated) + one(salient, other_salient))


def hybrid(whole: Column, uniform: Column, sections: Column) -> Column:
    """The frozen weights."""
    return 0.50 * whole + 0.25 * uniform + 0.25 * sections


def padded(samples: Column, size: int, policy: str) -> Column:
    """A short array repeated or followed by zeros up to size; `reject` raises where the row is read; empty ones raise always."""
    n = F.size(samples)
    if policy == "repeat":
        short = F.slice(F.flatten(F.array_repeat(samples, F.ceil(F.lit(size) / n).cast("int"))), 1, size)
    elif policy == "zero":
        short = F.concat(samples, F.array_repeat(F.lit(0.0), F.lit(size) - n))
    elif policy == "reject":
        short = F.raise_error(F.lit("an array is shorter than a window")).cast("array<double>")
    else:
        raise ValueError(f"unknown policy {policy}")
    return F.when(n == 0, F.raise_error(F.lit("an array is empty")).cast("array<double>")).when(n < size, short).otherwise(samples)


def window_values(samples: Column, size: int, hop: int, policy: str = "repeat") -> Column:
    """V28, ST2: array of (start, v): windows of a whole array, the last one aligned to its end."""
    whole = padded(samples, size, policy)
    return F.transform(window_starts(F.size(whole), size, hop), lambda a: F.struct(a.alias("start"), F.slice(whole, (a + 1).cast("int"), F.lit(size)).alias("v")))


def signal_features(samples: pd.Series, rate: float) -> pd.DataFrame:
    """V29, on arrays of samples: RMS, zero crossings, crest, centroid and seven band energies, by numpy's FFT."""
    out = []
    edges = np.array([20, 60, 250, 500, 2000, 4000, 6000, 20000.0])
    for s in samples:
        x = np.asarray(s, float)
        if not len(x):
            out.append((None,) * 5)
            continue
        rms = float(np.sqrt((x * x).mean()))
        power = np.abs(np.fft.rfft(x)) ** 2
        freq = np.fft.rfftfreq(len(x), 1 / rate)
        total = power.sum() + 1e-12
        bands = [float(power[(freq >= a) & (freq < b)].sum() / total) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out.append((rms, float((np.signbit(x[1:]) != np.signbit(x[:-1])).mean()) if len(x) > 1 else 0.0, float(np.abs(x).max() / (rms + 1e-12)), float((freq * power).sum() / total), bands))
    return pd.DataFrame(out, columns=["rms", "zero_crossings", "crest", "centroid", "bands"])


def fit_frames(v: Column, size: int) -> Column:
    """The middle `size` entries of a longer array; a shorter one is followed by zeros."""
    n = F.size(v)
    return F.when(n >= size, F.slice(v, (F.floor((n - size) / 2) + 1).cast("int"), F.lit(size))).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.lit(size) - n)))


def mel_target(spec: pd.Series, rate: float = 22050.0) -> pd.Series:
    """Arrays [mels][frames] of log energies -> ten numbers: shares of seven bands, deviation and 10-95 % range of the level, centroid in kHz."""
    edges = np.array([20, 60, 250, 500, 2000, 4000, 6000, 20000.0])
    out = []
    for s in spec:
        x = np.array([np.asarray(r, float) for r in s])
        hz = _mel_centres(len(x), rate / 2)
        energy = np.exp(x)
        band = np.array([energy[m].mean() if m.any() else 0.0 for m in ((hz >= a) & (hz < b) for a, b in zip(edges[:-1], edges[1:], strict=True))])
        level = x.mean(axis=0)
        low, high = np.percentile(level, (10, 95))
        centroid = (hz[:, None] * energy).sum(axis=0).mean() / (energy.sum(axis=0).mean() + 1e-9)
        out.append([*(band / (band.sum() + 1e-9)), level.std(), high - low, centroid / 1000])
    return pd.Series(out)


def _mel_centres(n: int, top: float) -> np.ndarray:
    """n frequencies that are evenly spaced in mels (linear to 1 kHz, then logarithmic: 27 steps for a factor of 6.4)."""
    step = np.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + np.log(f / 1000) / step
    m = np.linspace(0, to_mel(top), n)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (np.maximum(m, 15) - 15)))
