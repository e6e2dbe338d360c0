"""Market regimes: features by date, causal filtering, timelines, summaries."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breadth(panel: DataFrame) -> DataFrame:
    """Share of instruments above their moving average; a missing value counts as below."""
    return panel.groupBy("date").agg(F.avg(F.coalesce((F.col("px_to_sma_50") > 0).cast("double"), F.lit(0.0))).alias("breadth_above_sma50"))


def features(context: DataFrame, wide: DataFrame) -> DataFrame:
    """Seven columns by date; rows with a gap go. One row a date, so its windows need no key."""
    w = Window.orderBy("date")
    roll = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda e, s, n: F.when(F.count(s).over(roll(n)) >= n, e.over(roll(n)))
    c, v = F.col("bench_close"), F.col("vix")
    one = context.withColumn("r", F.ln(F.try_divide(c, F.lag(c).over(w))))
    r = F.col("r")
    vol = {n: full(F.stddev_samp(r), r, n) * math.sqrt(252) for n in (20, 60)}
    out = one.select(
        "date", *(F.ln(F.try_divide(c, F.lag(c, n).over(w))).alias(f"mkt_ret_{n}") for n in (20, 60)), vol[20].alias("mkt_vol_20"), F.try_divide(vol[20], vol[60]).alias("mkt_vol_ratio_20_60"),
        (c / full(F.max(c), c, 252) - 1).alias("mkt_drawdown_252"), F.try_divide(v - full(F.avg(v), v, 60), full(F.stddev_samp(v), v, 60)).alias("vix_z_60"),
    )
    return out.join(wide, "date").dropna()


def timeline(states: DataFrame) -> DataFrame:
    """Runs of equal states of states(date, state)."""
    w = Window.orderBy("date")
    change = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    runs = states.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(F.first("state").alias("state"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions"))


def transitions(states: DataFrame) -> DataFrame:
    pairs = states.withColumn("next", F.lead("state").over(Window.orderBy("date"))).where("next is not null").groupBy("state", "next").agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def describe(rows: DataFrame, ret: str = "ret", others: tuple[str, ...] = ()) -> DataFrame:
    """Sessions, share, means and annualised return and volatility by state."""
    r = F.col(ret)
    out = rows.groupBy("state").agg(F.count("*").alias("sessions"), F.avg(r).alias("mean_ret"), (F.avg(r) * 252).alias("annual_return"), (F.stddev_samp(r) * math.sqrt(252)).alias("annual_vol"), *(F.avg(c).alias(f"mean_{c}") for c in others))
    return out.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy()))


def labels(summary: DataFrame, vol: str, ret: str) -> DataFrame:
    """Fixed limits: names by the percentile rank of volatility and the sign of the mean return."""
    n = F.count("*").over(Window.partitionBy())
    tie = F.count("*").over(Window.partitionBy(vol))
    rank = (F.rank().over(Window.orderBy(vol)) + (tie - 1) / 2) / n
    level = F.when(rank > 0.66, "high volatility").when(rank < 0.34, "low volatility").otherwise("moderate volatility")
    way = F.when(F.col(ret) > 0.005, "rising").when(F.col(ret) < -0.005, "falling").otherwise("flat")
    return summary.withColumn("label", F.concat_ws(", ", level, way)).withColumn("state_order", (F.row_number().over(Window.orderBy(vol, "state")) - 1).cast("long"))


def switches(states: DataFrame) -> DataFrame:
    """One row: runs (the first session begins one), sessions, and switches a year of 252 sessions."""
    runs = timeline(states).agg(F.count("*").alias("runs"), F.sum("sessions").alias("sessions"), F.min("sessions").alias("shortest"), F.percentile("sessions", F.lit(0.5)).alias("median"))
    return runs.withColumn("per_year", F.try_divide(F.col("runs"), F.col("sessions") / 252))


def shares(states: DataFrame) -> DataFrame:
    """Sessions of each state and their share of all."""
    return states.groupBy("state").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def durations(moves: DataFrame) -> DataFrame:
    """Mean sessions spent in a state before it is left, from transitions(state, next, p); a state that is never left gets 1e9."""
    stay = moves.groupBy("state").agg(F.max(F.when(F.col("state") == F.col("next"), F.col("p")).otherwise(0.0)).alias("stay"))
    return stay.select("state", (1 / F.greatest(1 - F.col("stay"), F.lit(1e-9))).alias("expected_sessions"))


def argmax(probabilities: Column) -> Column:
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("long")


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """A column for each Gaussian state."""
    d, out = x.shape[1], np.empty((len(x), len(means)))
    for s in range(len(means)):
        chol = np.linalg.cholesky(covs[s])
        z = np.linalg.solve(chol, (x - means[s]).T)
        out[:, s] = -0.5 * (z**2).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * d * math.log(2 * math.pi)
    return out


def forward(x: np.ndarray, start: np.ndarray, moves: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered posteriors of a Gaussian hidden Markov model, where row t uses x up to t alone, and the log-likelihood of x."""
    logs = log_density(x, means, covs)
    most = logs.max(axis=1)
    b = np.exp(logs - most[:, None])  # densities, scaled by the largest of their row
    if (moves == moves[0]).all():  # rows don't depend on each other
        prior = np.tile(moves[0], (len(x), 1))
        prior[:1] = start
        joint = prior * b
        scale = np.maximum(joint.sum(axis=1), 1e-300)
        return joint / scale[:, None], float((np.log(scale) + most).sum())
    out, prior, scale = np.empty_like(b), np.maximum(start, 1e-300), np.empty(len(x))
    moves = np.maximum(moves, 1e-300)
    for t in range(len(x)):
        if t:
            prior = out[t - 1] @ moves
        joint = prior * b[t]
        scale[t] = max(joint.sum(), 1e-300)
        out[t] = joint / scale[t]
    return out, float((np.log(scale) + most).sum())


def forward_filter(x: np.ndarray, *model: np.ndarray) -> np.ndarray:
    return forward(x, *model)[0]


def backward(f: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed posteriors from filtered ones, which look ahead, and the expected number of each move."""
    if (moves == moves[0]).all():
        return f, f[:-1].T @ f[1:]
    ahead = f @ moves
    smooth, pairs = np.empty_like(f), np.zeros_like(moves)
    smooth[-1] = f[-1]
    for t in range(len(f) - 2, -1, -1):
        both = f[t][:, None] * moves * (smooth[t + 1] / np.maximum(ahead[t], 1e-300))[None, :]
        pairs += both
        smooth[t] = both.sum(1)
    return smooth, pairs


def fit_hmm(x: np.ndarray, k: int = 3, rounds: int = 200, seed: int = 17, tol: float = 1e-4, sticky: bool = True, scattered: bool = False) -> tuple[np.ndarray, ...]:
    """Baum-Welch with full covariances until the likelihood gains less than tol; states come in the order of the variance of the first column.

    Not sticky: moves don't depend on the state before, which makes it a Gaussian mixture. scattered: starts from rows drawn by the seed.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    order = np.argsort(np.abs(x[:, 0] - x[:, 0].mean()))
    means = np.stack([x[p].mean(0) for p in np.array_split(order, k)]) + 1e-3 * rng.standard_normal((k, d))
    covs = np.stack([np.cov(x[p].T).reshape(d, d) + 1e-4 * np.eye(d) for p in np.array_split(order, k)])
    if scattered:
        means, covs = x[rng.choice(n, k, replace=False)].copy(), np.stack([np.cov(x.T).reshape(d, d) + 1e-4 * np.eye(d)] * k)
    moves, start = np.full((k, k), 0.05 / max(1, k - 1)) + np.eye(k) * (0.95 - 0.05 / max(1, k - 1)), np.full(k, 1 / k)
    if not sticky:
        moves = np.full((k, k), 1 / k)
    before = -math.inf
    for _ in range(rounds):
        f, total = forward(x, start, moves, means, covs)
        if total - before < tol:
            break
        before = total
        smooth, pairs = backward(f, moves)
        w = smooth / np.maximum(smooth.sum(0), 1e-12)
        means = w.T @ x
        covs = np.stack([(w[:, s, None] * (x - means[s])).T @ (x - means[s]) + 1e-4 * np.eye(d) for s in range(k)])
        if sticky:
            moves, start = pairs / np.maximum(pairs.sum(1, keepdims=True), 1e-12), smooth[0]
        else:
            start = smooth.mean(0)
            moves = np.tile(start, (k, 1))
    by = np.argsort(covs[:, 0, 0])
    return start[by], moves[by][:, by], means[by], covs[by]


def bic(log_likelihood: float, n: int, k: int, d: int, sticky: bool = True) -> float:
    """Bayesian information criterion: starts and moves (or weights alone), means and full covariances are parameters."""
    free = (k - 1) * (k + 1 if sticky else 1) + k * d + k * d * (d + 1) // 2
    return free * math.log(n) - 2 * log_likelihood


def agreement(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of equal states under the best matching of their numbers, which are arbitrary."""
    return max(float((a == np.array(order)[b]).mean()) for order in itertools.permutations(range(k)))


def fit_kmeans(x: np.ndarray, k: int, seed: int = 17, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Inertia and centres: spread starting rows, then nearest centres and their means until nothing changes. Centres by their first column."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        far = ((x[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
    before = None
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if before is not None and (own == before).all():
            break
        before = own
        centres = np.stack([x[own == s].mean(0) if (own == s).any() else centres[s] for s in range(k)])
    return float(((x - centres[own]) ** 2).sum()), centres[np.argsort(centres[:, 0])]


#: Starts of each kind, of which the best stays: by likelihood, or by inertia.
STARTS = {"hmm": 1, "gmm": 5, "kmeans": 10}


def fit_kind(kind: str, x: np.ndarray, k: int, seed: int, start: int) -> tuple[float, tuple[np.ndarray, ...]]:
    """A score to be maximised, and the model, of one start."""
    if kind == "kmeans":
        inertia, centres = fit_kmeans(x, k, seed + start)
        return -inertia, (centres,)
    model = fit_hmm(x, k, seed=seed + start, sticky=kind == "hmm", scattered=start > 0)
    return forward(x, *model)[1], model


def posteriors(kind: str, x: np.ndarray, model: tuple[np.ndarray, ...]) -> np.ndarray:
    if kind == "kmeans":
        return np.eye(len(model[0]))[((x[:, None] - model[0]) ** 2).sum(2).argmin(1)]
    return forward_filter(x, *model)


def packed(model: tuple[np.ndarray, ...]) -> list[float]:
    return np.concatenate([m.ravel() for m in model]).tolist()


def unpacked(kind: str, flat, k: int, d: int) -> tuple[np.ndarray, ...]:
    shapes = [(k, d)] if kind == "kmeans" else [(k,), (k, k), (k, d), (k, d, d)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return tuple(p.reshape(s) for p, s in zip(np.split(np.asarray(flat, float), cuts), shapes))


def assign_by_fold(rows: DataFrame, f: DataFrame, columns: list[str], k: int = 3, least: int = 250, smoothed: bool = False, kind: str = "hmm") -> DataFrame:
    """date, fold, state and posteriors of each fold's test rows: fitted on its fit and inner windows with the gap between, filtered from the first row of the series.

    rows(date, columns) has one row a date, so a fold, whose series ends with its test window, is one task. Rows in gaps belong to the series
    too. smoothed: posteriors that look ahead, as a negative control. kind: hmm, gmm or kmeans, the best of its STARTS. Folds with fewer than `least` rows to fit on are left out.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf[columns].to_numpy(float)
        train, test = (pdf["train"].to_numpy(bool), pdf["test"].to_numpy(bool))
        if train.sum() < least:
            return pd.DataFrame(columns=["fold", "date", "state", "posterior"])
        mean, std = x[train].mean(0), x[train].std(0)
        z = (x - mean) / np.where(std > 0, std, 1)
        model = max((fit_kind(kind, z[train], k, 17, start) for start in range(STARTS[kind])), key=lambda m: m[0])[1]
        p = posteriors(kind, z, model)
        p = (backward(p, model[1])[0] if smoothed and kind == "hmm" else p)[test]
        return pd.DataFrame({"fold": pdf["fold"].to_numpy()[test], "date": pdf["date"].to_numpy()[test], "state": p.argmax(1), "posterior": list(p)})

    limits = f.select("fold", "fit_start_date", "inner_end_date", "test_start_date", "test_end_date")  # a few rows
    series = rows.join(F.broadcast(limits), F.col("date") <= F.col("test_end_date"))
    tagged = series.select("fold", "date", *columns, F.col("date").between(F.col("fit_start_date"), F.col("inner_end_date")).alias("train"), (F.col("date") >= F.col("test_start_date")).alias("test"))
    return tagged.groupBy("fold").applyInPandas(one, "fold long, date date, state long, posterior array<double>")


def compare(rows: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("hmm", "gmm", "kmeans"), sizes: tuple[int, ...] = (2, 3, 4, 5), holdout: float = 0.25, seed: int = 17) -> DataFrame:
    """By kind and number of states: BIC on the first part of the series, log-likelihood of the held-out rest, durations, shares, stability and plausibility.

    Stability: how often a second fit, without the first tenth, agrees on the state, states matched. Plausible, by fixed limits: the shortest
    duration is 10 sessions or more and the smallest share 5 %. k-means has no likelihood, so neither BIC nor a held-out one. rows(date,
    columns) has one row a date. Every start of a candidate, of either fit, is a task; the best of them is kept in the plan.
    """

    def prepared(pdf: pd.DataFrame, rival: bool) -> tuple[np.ndarray, int, int]:
        x = pdf.sort_values("date")[columns].to_numpy(float)
        cut, a = int(len(x) * (1 - holdout)), int(len(x) * 0.1) if rival else 0
        mean, std = x[a:cut].mean(0), x[a:cut].std(0)
        return (x - mean) / np.where(std > 0, std, 1), a, cut

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, k, start, rival = (pdf[c].iloc[0] for c in ("kind", "k", "start", "rival"))
        z, a, cut = prepared(pdf, bool(rival))
        if cut < 20 * k:
            return pd.DataFrame(columns=["kind", "k", "rival", "score", "model"])
        score, model = fit_kind(kind, z[a:cut], int(k), seed + int(rival), int(start))
        return pd.DataFrame([(kind, k, rival, score, packed(model))], columns=["kind", "k", "rival", "score", "model"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, k, d = pdf["kind"].iloc[0], int(pdf["k"].iloc[0]), len(columns)
        model, rival = (unpacked(kind, pdf[c].iloc[0], k, d) for c in ("model", "other"))
        z, _, cut = prepared(pdf, False)
        state, other = posteriors(kind, z, model).argmax(1), posteriors(kind, prepared(pdf, True)[0], rival).argmax(1)
        sticky, likely = kind == "hmm", kind != "kmeans"
        lengths = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(state)) + 1, [len(state)]]))
        shortest = float((1 / np.maximum(1 - np.diag(model[1]), 1e-9)).min()) if sticky else float(lengths.min())
        share = float((np.bincount(state, minlength=k) / len(state))[np.unique(state)].min())
        held_out, likelihood = (forward(z[cut:], *model)[1], forward(z[:cut], *model)[1]) if likely else (None, None)
        row = (kind, k, bic(likelihood, cut, k, d, sticky) if likely else None, held_out, shortest, float(np.median(lengths)), share, agreement(state, other, k), len(lengths) / max(len(z) / 252, 1e-9), shortest >= 10 and share >= 0.05)
        return pd.DataFrame([row], columns=out)

    out = ["kind", "n_states", "bic", "holdout_ll", "min_duration", "median_duration", "smallest_share", "stability", "switches_per_year", "plausible"]
    spark = rows.sparkSession
    tries = spark.createDataFrame([(kind, k, start, rival) for kind in kinds for k in sizes for start in range(STARTS[kind]) for rival in (False, True)], "kind string, k int, start int, rival boolean")
    own = rows.select("date", *columns)
    fits = own.crossJoin(F.broadcast(tries)).groupBy("kind", "k", "start", "rival").applyInPandas(fitted, "kind string, k int, rival boolean, score double, model array<double>")  # a few candidates
    best = fits.groupBy("kind", "k").agg(F.max_by(F.when(~F.col("rival"), F.col("model")), F.when(~F.col("rival"), F.col("score"))).alias("model"), F.max_by(F.when(F.col("rival"), F.col("model")), F.when(F.col("rival"), F.col("score"))).alias("other"))
    each = own.crossJoin(F.broadcast(best))
    return each.groupBy("kind", "k").applyInPandas(one, "kind string, n_states int, bic double, holdout_ll double, min_duration double, median_duration double, smallest_share double, stability double, switches_per_year double, plausible boolean")
