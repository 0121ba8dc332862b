"""Elo by synchronous rounds: fully relational, one join-and-aggregate per round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.verdicts import elo_delta, first_score
from rankforge.operators.elo_replay import GROUP, GROUP_VERDICTS, _prepare, normalise_ratings
from rankforge.operators.elo_rules import EloParams
from rankforge.operators.evaluate import pearson
from rankforge.session import cut_lineage, measured


@dataclass
class SyncRun:
    ratings: DataFrame
    rounds: DataFrame


def start_ratings(items: DataFrame, by: list[str], initial: float) -> DataFrame:
    return items.select(
        *by, F.col("response_id").cast("string").alias("response_id"),
        F.col("norm_response").cast("double").alias("norm_response"), F.lit(initial).alias("elo"),
    )


def item_changes(verdicts: DataFrame, ratings: DataFrame, by: list[str], k: Column) -> DataFrame:
    """Per item: summed rating change, games, and the sums that the stop rules need.

    Both sides' ratings are looked up in the (much smaller) rating table; every verdict
    then becomes two rows that combine map-side, so an item with very many verdicts
    sends one row per task. Winner counts and absolute changes ride on the first side.
    """
    side_a = ratings.select(*by, F.col("response_id").alias("response1_id"), F.col("elo").alias("_ra"))
    side_b = ratings.select(*by, F.col("response_id").alias("response2_id"), F.col("elo").alias("_rb"))
    games = verdicts.join(side_a, [*by, "response1_id"]).join(side_b, [*by, "response2_id"])
    delta = elo_delta(F.col("_ra"), F.col("_rb"), first_score(F.col("winner")), k)
    won = F.col("winner")
    games = games.withColumn("_d", delta)
    sides = F.array(
        F.struct(F.col("response1_id").alias("id"), F.col("_d").alias("d"), F.lit(True).alias("first")),
        F.struct(F.col("response2_id").alias("id"), (-F.col("_d")).alias("d"), F.lit(False).alias("first")),
    )
    rows = games.select(*by, won.alias("_w"), F.inline(sides))
    return rows.groupBy(*by, F.col("id").alias("response_id")).agg(
        F.sum("d").alias("delta"), F.count("*").alias("games"),
        F.sum(F.when(F.col("first"), 2 * F.abs("d"))).alias("change"),
        F.count_if(F.col("first") & (F.abs("d") < 1)).alias("small"),
        *[F.count_if(F.col("first") & (F.col("_w") == w)).alias(w) for w in ("A", "B", "Equal")],
    )


def sync_step(
    verdicts: DataFrame, ratings: DataFrame, by: list[str], k: Column, mean_change: bool = True
) -> DataFrame:
    """Ratings after one synchronous round, with the round's sums per item."""
    changes = item_changes(verdicts, ratings, by, k)
    step = F.col("delta") / F.col("games") if mean_change else F.col("delta")
    base = ratings.select(*by, "response_id", "norm_response", "elo")
    return base.join(changes, [*by, "response_id"], "left").withColumn(
        "elo", F.col("elo") + F.coalesce(step, F.lit(0.0))
    )


def round_stats(after: DataFrame, by: list[str], round_number: int, k: float) -> DataFrame:
    """Per group: the history row of one round, from the per-item sums."""
    truth = F.when(~F.isnan("norm_response"), F.col("norm_response"))
    known = F.when(truth.isNotNull(), F.col("elo"))
    n = F.sum(F.coalesce("A", F.lit(0)) + F.coalesce("B", F.lit(0)) + F.coalesce("Equal", F.lit(0)))
    out = after.groupBy(*by).agg(
        n.alias("n_pairs"), F.sum("change").alias("_change"), F.sum("small").alias("_small"),
        F.when(F.count(truth) >= 2, pearson(truth, known)).alias("pearson_r"),
        (F.count(truth) >= 2).alias("_has_r"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("A", "B", "Equal")],
    ).filter(F.col("n_pairs") > 0)
    return out.select(
        *by, F.lit(round_number + 1).alias("round"), F.lit(k).alias("k"), "pearson_r",
        (F.col("_change") / (2 * F.col("n_pairs"))).alias("avg_change"),
        (F.col("_small") / F.col("n_pairs")).alias("pct_small"), "A", "B", "Equal", "_has_r",
    )


def _advance(state: DataFrame | None, stats: DataFrame, by: list[str], p: EloParams) -> DataFrame:
    """Apply the stop rules per group; the rule state is a small table of its own."""
    nan = F.lit(float("nan"))
    if state is None:
        joined = stats.withColumns(
            {
                "_best": F.lit(float("-inf")), "_improved": F.lit(0),
                "_hist": F.array().cast("array<double>"),
            }
        )
    else:
        joined = stats.join(state.select(*by, "_best", "_improved", "_hist"), by)
    seen = F.col("_has_r") & F.lit(p.use_truth)
    better = seen & F.col("pearson_r").isNotNull() & (F.col("pearson_r") > F.col("_best"))
    now = F.col("round") - 1
    joined = joined.withColumns(
        {
            "_improved": F.when(better, now).otherwise(F.col("_improved")),
            "_best": F.when(better, F.col("pearson_r")).otherwise(F.col("_best")),
            "_hist": F.slice(
                F.when(
                    seen, F.concat("_hist", F.array(F.coalesce("pearson_r", nan)))
                ).otherwise(F.col("_hist")),
                F.greatest(F.lit(1), F.size("_hist") + 2 - F.lit(p.min_r_delta_rounds)),
                p.min_r_delta_rounds,
            ),
        }
    )
    gain = F.try_element_at("_hist", F.lit(-1)) - F.try_element_at("_hist", F.lit(1))
    stagnant = (F.size("_hist") >= p.min_r_delta_rounds) & ~F.isnan(gain) & (gain < p.min_r_delta)
    shown = F.col("pct_small") / 2 if p.halve_small else F.col("pct_small")
    reason = F.when(F.col("avg_change") < 0.1, "avg_change<0.1").when(shown > 0.95, "95%_small")
    if p.use_truth:
        reason = reason.when(now - F.col("_improved") >= p.patience, f"patience_{p.patience}")
        if p.use_r_delta:
            reason = reason.when(stagnant, f"r_delta<{p.min_r_delta}_in_{p.min_r_delta_rounds}r")
    return joined.withColumn("converge_reason", reason)


def elo_sync(
    verdicts: DataFrame, items: DataFrame, params: EloParams = EloParams(), by: list[str] = GROUP,
    rounds: int | None = None, mean_change: bool = True,
) -> SyncRun:
    """Rate items by synchronous rounds.

    All verdicts of a round use the ratings at its start; an item moves by the mean
    (or, with ``mean_change=False``, the sum) of its changes. ``rounds`` fixes the
    number of rounds; otherwise each group stops by the usual rules, and groups that
    have stopped drop out of the following joins. The driver learns only how many
    groups are still active. A group of more than a cell of verdicts, which its verdicts'
    task and prompt part into classes without a common item, plays its rounds in cells
    (``elo_cells``) without a join per round.
    """
    from rankforge.operators import elo_cells

    games, players, appear = _prepare(verdicts, items, by, 0, own=True)
    sizes = games.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > elo_cells.CELL_VERDICTS)
    apart = elo_cells.split_cells(games, appear, measured(sizes), by)
    done: SyncRun | None = None
    if apart.limit(1).count():
        setting = params.with_(max_rounds=rounds or params.max_rounds)
        history, rated = elo_cells.replay_cells(
            games, players, appear, apart, [setting], by, GROUP_VERDICTS, True, False, False, mean_change, rounds is None
        )
        done = SyncRun(rated.select(*by, *_ITEM_COLUMNS, "elo_normalized"), history.select(*by, *_ROUND_COLUMNS))
        games, players = (t.join(apart.select(*by), by, "left_anti") for t in (games, players))
        if not players.limit(1).count():
            return done
    rest = _by_joins(games, players, params, by, rounds, mean_change)
    if done is None:
        return rest
    return SyncRun(done.ratings.unionByName(rest.ratings), done.rounds.unionByName(rest.rounds))


_ITEM_COLUMNS = ["response_id", "norm_response", "elo"]
_ROUND_COLUMNS = ["round", "k", "pearson_r", "avg_change", "pct_small", "A", "B", "Equal", "converge_reason"]


def _by_joins(
    games: DataFrame, players: DataFrame, params: EloParams, by: list[str], rounds: int | None, mean_change: bool
) -> SyncRun:
    """Rounds as joins and aggregations over all games."""
    items = players.withColumnRenamed("truth", "norm_response")
    ratings = measured(cut_lineage(start_ratings(items, by, params.initial)))
    s = F.col("s")
    verdicts = games.select(
        *by, F.col("a").alias("response1_id"), F.col("b").alias("response2_id"),
        F.when(s == 1.0, "A").when(s == 0.0, "B").when(s == 0.5, "Equal").alias("winner"),
    )
    cap = rounds or params.max_rounds
    state: DataFrame | None = None
    history: list[DataFrame] = []
    finished: list[DataFrame] = []
    r_no = 0
    while cap is None or r_no < cap:
        k = params.k_at(r_no)
        # one row per item, read three times in the next round: written out, not recomputed
        after = measured(cut_lineage(sync_step(verdicts, ratings, by, F.lit(k), mean_change)))
        ratings.unpersist()
        stats = round_stats(after, by, r_no, k)
        ratings = after
        if rounds is None:
            state = cut_lineage(_advance(state, stats, by, params))
            history.append(state)
            stopped = state.filter(F.col("converge_reason").isNotNull()).select(*by)
            active = state.filter(F.col("converge_reason").isNull())
            n_active = active.count()
            if not n_active:
                break
            if stopped.limit(1).count():
                finished.append(after.join(stopped, by, "left_semi"))
                ratings = after.join(stopped, by, "left_anti")
                verdicts = verdicts.join(stopped, by, "left_anti")
                state = active
        else:
            stats = stats.withColumn("converge_reason", F.lit(None).cast("string"))
            history.append(cut_lineage(stats))
        r_no += 1
    item_cols = [*by, *_ITEM_COLUMNS]
    ratings = ratings.select(*item_cols)
    for part in finished:
        ratings = ratings.unionByName(part.select(*item_cols))
    table = history[0]
    for h in history[1:]:
        table = table.unionByName(h, allowMissingColumns=True)
    return SyncRun(normalise_ratings(ratings, by), table.select(*by, *_ROUND_COLUMNS))
