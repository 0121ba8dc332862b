"""Rating parameters, stop rules, and the exact replay of one round in numpy."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class EloParams:
    """Options of one rating run. Defaults are those of the cached variant."""

    k_start: float = 32.0
    k_end: float = 2.0
    decay_rounds: float = 30.0
    patience: int = 20
    initial: float = 1500.0
    min_r_delta: float = 0.01
    min_r_delta_rounds: int = 100
    max_rounds: int | None = 200
    use_r_delta: bool = True  # rule 4
    use_truth: bool = True  # rules 3 and 4 look at the true scores
    halve_small: bool = False  # share of small changes over 2n instead of n
    fixed_k: float | None = None  # constant K instead of the decay

    def __post_init__(self):
        for name in ("k_start", "k_end", "decay_rounds", "initial", "min_r_delta"):
            object.__setattr__(self, name, float(getattr(self, name)))
        if self.fixed_k is not None:
            object.__setattr__(self, "fixed_k", float(self.fixed_k))

    def k_at(self, round_number: int) -> float:
        if self.fixed_k is not None:
            return self.fixed_k
        slope = (self.k_start - self.k_end) * (round_number / self.decay_rounds)
        return max(self.k_start - slope, self.k_end)

    def with_(self, **changes) -> "EloParams":
        return replace(self, **changes)


# The default hyper-parameter grids.
GRID_2D = {"k_start": (4, 8, 16, 32, 64), "k_end": (1, 2, 4, 8, 16)}
GRID_4D = {
    "k_start": (8, 16, 24, 32, 48, 64), "k_end": (1, 2, 4, 8),
    "decay_rounds": (10, 20, 30, 50), "patience": (5, 10, 20, 30),
}


def grid_params(grid: dict[str, tuple], base: EloParams = EloParams()) -> list[EloParams]:
    """All combinations of the grid with k_end <= k_start."""
    names = list(grid)
    combos = (dict(zip(names, values)) for values in itertools.product(*grid.values()))
    settings = [base.with_(**c) for c in combos]
    return [p for p in settings if p.k_end <= p.k_start]


@dataclass
class StopWatch:
    """Decides after each round whether a run has converged, and why."""

    params: EloParams
    best: float = -math.inf
    improved_at: int = 0
    history: list[float] = field(default_factory=list)

    def check(self, round_number: int, avg_change: float, share_small: float, r: float | None):
        """Reason of the first rule that is met, else None. ``r`` None: no truth."""
        p = self.params
        if p.use_truth and r is not None:
            if r > self.best:
                self.best, self.improved_at = r, round_number
            self.history.append(r)
        if avg_change < 0.1:
            return "avg_change<0.1"
        if share_small > 0.95:
            return "95%_small"
        if not p.use_truth:
            return None
        if round_number - self.improved_at >= p.patience:
            return f"patience_{p.patience}"
        window = p.min_r_delta_rounds
        if p.use_r_delta and len(self.history) >= window:
            gain = self.history[-1] - self.history[-window]
            if gain < p.min_r_delta:  # False if either is NaN
                return f"r_delta<{p.min_r_delta}_in_{window}r"
        return None


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, round_number: int) -> np.ndarray:
    """Hash of the verdicts in one round: the public splitmix64 finaliser over hash and round."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(round_number + 1) * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def round_order(h: np.ndarray, round_number: int) -> np.ndarray:
    """Permutation of the verdicts in one round: sort by a mix of hash and round."""
    return np.argsort(mixed(h, round_number), kind="stable")


def stable_order(ids: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative ids, 16 bits at a time (numpy sorts those by radix)."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ids) and ids.max() > 0xFFFF:
        order = order[np.argsort((ids[order] >> 16).astype(np.uint16), kind="stable")]
    if len(ids) and ids.max() > 0xFFFFFFFF:
        order = order[np.argsort(ids[order] >> 32, kind="stable")]
    return order


def independent_batches(a: np.ndarray, b: np.ndarray, n_items: int) -> Iterator[np.ndarray]:
    """Split games, given in play order, into batches without a common player.

    A game is ready when it is the next unplayed one of both its players; playing
    batch after batch gives exactly the ratings of playing the games one by one.
    """
    games = len(a)
    players = np.empty(2 * games, dtype=np.int64)
    players[0::2], players[1::2] = a, b
    queue = stable_order(players) // 2  # games per player, in play order
    ends = np.cumsum(np.bincount(players, minlength=n_items))
    at = np.concatenate(([0], ends[:-1]))
    queue = np.append(queue, games)  # sentinel read by players that are done
    nxt = np.where(at < ends, queue[np.minimum(at, 2 * games)], games)
    both = a + b
    asked = np.zeros(n_items, dtype=np.int64)  # last step at which a player moved on
    moved, step = np.arange(n_items), 1
    asked[moved] = step
    while len(moved):
        game = nxt[moved]
        open_ = game < games
        game, player = game[open_], moved[open_]
        other = both[game] - player
        # met by both players in this step: count it for the first side only
        once = (asked[other] != step) | (player == a[game])
        ready = game[(nxt[other] == game) & once]
        if not len(ready):
            return
        yield ready
        moved = np.concatenate((a[ready], b[ready]))
        step += 1
        asked[moved] = step
        at[moved] += 1
        nxt[moved] = np.where(at[moved] < ends[moved], queue[at[moved]], games)


def play_round(
    ratings: np.ndarray, a: np.ndarray, b: np.ndarray, points: np.ndarray, k: np.ndarray,
    record: bool = False,
):
    """Replay games in the given order on ``ratings`` (items x settings), in place.

    Returns, per setting, the summed absolute change and the number of games that
    moved both sides by less than one point; with ``record`` also each game's ratings
    before the game and its change (first setting).
    """
    change = np.zeros(ratings.shape[1])
    small = np.zeros(ratings.shape[1], dtype=np.int64)
    log = np.empty((3, len(a))) if record else None
    scale = math.log(10.0) / 400.0
    for games in independent_batches(a, b, len(ratings)):
        ia, ib = a[games], b[games]
        ra, rb = ratings[ia], ratings[ib]
        delta = k * (points[games, None] - 1.0 / (1.0 + np.exp((rb - ra) * scale)))
        ratings[ia] = ra + delta
        ratings[ib] = rb - delta
        size = np.abs(delta)
        change += 2.0 * size.sum(axis=0)
        small += (size < 1.0).sum(axis=0)
        if record:
            log[:, games] = ra[:, 0], rb[:, 0], delta[:, 0]
    return change, small, log


def sync_round(
    ratings: np.ndarray, a: np.ndarray, b: np.ndarray, points: np.ndarray, k: np.ndarray, mean_change: bool
):
    """All games on the ratings before the round, in place; the sums are those of ``play_round``.

    An item moves by the mean or the sum of its changes; games without a known winner are draws.
    """
    n = len(ratings)
    points = np.where(np.isnan(points), 0.5, points)
    expected = 1.0 / (1.0 + np.exp((ratings[b] - ratings[a]) * (math.log(10.0) / 400.0)))
    delta = k * (points[:, None] - expected)
    size = np.abs(delta)
    played = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    for i in range(ratings.shape[1]):
        moved = np.bincount(a, delta[:, i], n) - np.bincount(b, delta[:, i], n)
        ratings[:, i] += moved / played if mean_change else moved
    return 2.0 * size.sum(axis=0), (size < 1.0).sum(axis=0), None


def column_pearson(truth: np.ndarray, ratings: np.ndarray) -> np.ndarray | None:
    """Pearson r of the known true scores with each rating column; None below 2 rows."""
    known = ~np.isnan(truth)
    if known.sum() < 2:
        return None
    t = truth[known] - truth[known].mean()
    x = ratings[known] - ratings[known].mean(axis=0)
    bottom = np.sqrt((t * t).sum() * (x * x).sum(axis=0))
    # constant columns leave rounding dust in x; they count as undefined
    flat = np.ptp(ratings[known], axis=0) == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((bottom > 0) & ~flat, t @ x / bottom, np.nan)


def normalise(ratings: np.ndarray) -> np.ndarray:
    """Min-max per column; a flat column becomes 0."""
    low, span = ratings.min(axis=0), np.ptp(ratings, axis=0)
    return np.where(span > 0, (ratings - low) / np.where(span > 0, span, 1.0), 0.0)


def fit_quality(truth: np.ndarray, scores: np.ndarray) -> dict[str, np.ndarray]:
    """n, r, R squared, MAE, RMSE of each score column against the known truth."""
    known = ~np.isnan(truth)
    n, settings = int(known.sum()), scores.shape[1]
    if n < 2:
        nan = np.full(settings, np.nan)
        return {"n": n, "pearson_r": nan, "r_squared": nan, "mae": nan, "rmse": nan}
    t, miss = truth[known], scores[known] - truth[known][:, None]
    sse, sst = (miss**2).sum(axis=0), ((t - t.mean()) ** 2).sum()
    if np.ptp(t) > 0:
        fit = 1 - sse / sst
    else:
        fit = np.where(sse == 0, 1.0, 0.0)
    return {
        "n": n, "pearson_r": column_pearson(truth, scores), "r_squared": fit,
        "mae": np.abs(miss).mean(axis=0), "rmse": np.sqrt(sse / n),
    }
