"""Exact sequential Elo replay, parallel over groups, settings and inside very large groups.

The order of play belongs to the data: the items of a group are dealt into blocks by their
ids, a round walks a round-robin schedule of block meetings, and the games of a meeting
follow a keyed hash. Meetings of a step share no item. A group that fits a task plays this
order there, whole rounds without leaving the task; a larger one plays the meetings of a
step as tasks of their own. Ratings are the same in both places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.functions.hashing import key_hash, order_number
from rankforge.functions.verdicts import first_score
from rankforge.operators.columns import GROUP_KEYS, all_present
from rankforge.operators.elo_rules import (
    EloParams, StopWatch, column_pearson, fit_quality, normalise, play_round, round_order,
)
from rankforge.operators.evaluate import pearson
from rankforge.operators.ordering import row_index
from rankforge.schemas import LABELS
from rankforge.session import cut_lineage, drop_scratch, measured, output_partitions, scratch_path, write_scratch

GROUP = ["dataset", "item"]
#: Verdicts to which the meetings of two blocks are cut; part of the order.
GROUP_VERDICTS = 2_000_000
#: Groups up to this size play inside one task; picks the place, not the result.
TASK_VERDICTS = 2_000_000
VERDICTS_PER_TASK = 500_000
SETTINGS_PER_TASK = 48
#: Steps of a large group's round between two checkpoints.
STEPS_PER_CHECKPOINT = 8
_HASH_BUCKETS = 4096

_ROUND_FIELDS = [
    ("round", T.IntegerType()), ("k", T.DoubleType()), ("pearson_r", T.DoubleType()),
    ("avg_change", T.DoubleType()), ("pct_small", T.DoubleType()), ("A", T.LongType()),
    ("B", T.LongType()), ("Equal", T.LongType()), ("converge_reason", T.StringType()),
]
_ITEM_FIELDS = [
    ("response_id", T.StringType()), ("norm_response", T.DoubleType()), ("elo", T.DoubleType()),
    ("elo_normalized", T.DoubleType()),
]
_FIT_FIELDS = [
    ("n", T.LongType()), ("fit_r", T.DoubleType()), ("r_squared", T.DoubleType()),
    ("mae", T.DoubleType()), ("rmse", T.DoubleType()),
]
_GAME_FIELDS = [
    ("pair_in_round", T.LongType()), ("response1_id", T.StringType()),
    ("response2_id", T.StringType()), ("winner", T.StringType()), ("old_a", T.DoubleType()),
    ("old_b", T.DoubleType()), ("new_a", T.DoubleType()), ("new_b", T.DoubleType()),
]
_FIELDS = _ITEM_FIELDS + _ROUND_FIELDS + _FIT_FIELDS + _GAME_FIELDS


@dataclass
class EloRun:
    """Result tables of a replay; ``setting`` numbers the parameter sets."""

    ratings: DataFrame
    rounds: DataFrame
    fits: DataFrame | None = None
    comparisons: DataFrame | None = None


def block_hash(column: str) -> Column:
    """What deals an item into a block: the same on both sides of a verdict."""
    return order_number(key_hash(F.col(column), seed="block"))


def _prepare(verdicts: DataFrame, items: DataFrame, by: list[str], seed: int, own: bool = False):
    """Compact games of known items, the items, and where each item appears.

    Games carry ids, points, the hash that orders the rounds, and the class ``_c`` of their
    verdict: a hash of the group keys beside ``by``. An item appears in the classes from
    ``_c`` to ``_last``. ``own`` keeps games of an
    item against itself, and leaves the points of an unknown winner empty. Items that games name are looked up once each, not once a game.
    """
    classes = [c for c in GROUP_KEYS if c in verdicts.columns and c not in by]
    known, points = all_present(["response1_id", "response2_id"]), first_score(F.col("winner"))
    games = verdicts.filter(known if own else F.col("response1_id") != F.col("response2_id")).select(
        *by, F.col("response1_id").cast("string").alias("a"), F.col("response2_id").cast("string").alias("b"),
        (F.when(F.col("winner").isin(*LABELS), points) if own else points).alias("s"),
        order_number(key_hash("response1_id", "response2_id", seed=seed)).alias("h"),
        *(["round"] if "round" in verdicts.columns else []),
        (F.xxhash64(*classes) if classes else F.lit(0).cast("bigint")).alias("_c"),
    )
    # fresh aliases: games and items may come from one plan, and cogroup needs them apart
    players = items.select(
        *[F.col(c).alias(c) for c in by], F.col("response_id").cast("string").alias("response_id"),
        F.col("norm_response").cast("double").alias("truth"), block_hash("response_id").alias("block_hash"),
    )
    # read several times: written once, so that what is behind runs once
    players, _ = write_scratch(players, "replay-players")
    games, path = write_scratch(games.filter(all_present(by)), "replay-verdicts")
    ids = F.array(*[F.struct(F.col(c).cast("string").alias("id"), "_c") for c in ("a", "b")])
    appear = games.select(*by, F.inline(ids)).groupBy(*by, "id").agg(F.min("_c").alias("_c"), F.max("_c").alias("_last"))
    appear, _ = write_scratch(appear, "replay-appear")
    known = players.select(*[F.col(c).alias(c) for c in by], F.col("response_id").alias("id"))
    unknown = measured(appear.join(known, [*by, "id"], "left_anti").select(*by, "id"))
    if unknown.limit(1).count():
        for side in ("a", "b"):
            gone = unknown.select(*[F.col(c).alias(c) for c in by], F.col("id").alias(side))
            games = games.join(gone, [*by, side], "left_anti")
        games, _ = write_scratch(games, "replay-verdicts")
        drop_scratch(games.sparkSession, path)
    unknown.unpersist()
    return games, players, appear


def _schema(by: list[str], source: DataFrame) -> T.StructType:
    keys = [source.schema[c] for c in by]
    tags = [T.StructField("setting", T.IntegerType()), T.StructField("kind", T.StringType())]
    return T.StructType(keys + tags + [T.StructField(n, t) for n, t in _FIELDS])


_ARROW = {
    T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
}


def _rows(keys: dict, kind: str, length: int, **cols) -> pa.Table:
    """An output block: given columns, the rest NULL."""
    arrays, names = [], []
    for name, scalar in keys.items():
        arrays.append(pa.repeat(scalar, length))
        names.append(name)
    tail = [("setting", T.IntegerType()), ("kind", T.StringType()), *_FIELDS]
    cols["kind"] = pa.repeat(pa.scalar(kind), length)
    for name, dtype in tail:
        want = _ARROW[dtype]
        value = cols.get(name)
        if value is None:
            value = pa.nulls(length, want)
        elif not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.array(value, type=want, from_pandas=True)
        arrays.append(value.cast(want))
        names.append(name)
    return pa.table(arrays, names=names)


def _apart(df: DataFrame) -> DataFrame:
    """Fresh column identities: both sides of a cogroup may come from one plan."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _two_tables(run):
    """Spark reads the arity of a cogroup function; hand it a plain one."""

    def call(games: pa.Table, players: pa.Table) -> pa.Table:
        return run(games, players)

    return call


def _winner_counts(points: np.ndarray) -> tuple[int, int, int]:
    return int((points == 1.0).sum()), int((points == 0.0).sum()), int((points == 0.5).sum())


def _meetings(x: np.ndarray, y: np.ndarray, blocks: int) -> np.ndarray:
    """The step at which two blocks play, as ``_meeting_step`` has it."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    last = blocks - 1
    met = 1 + np.where(high == last, 2 * low, low + high) % max(last, 1)
    return np.where(x == y, 0, met)


class _UnitReplay:
    """Replays the whole groups of a unit, one after the other, for a list of parameter sets.

    A unit is one or more groups (told apart by ``_g``) and one chunk of the settings.
    ``limit`` is the block size of the order; None plays by the hash alone.
    """

    def __init__(self, by, settings, limit, want_ratings, want_fit, record):
        self.by, self.settings, self.limit = by, settings, limit
        self.want_ratings, self.want_fit, self.record = want_ratings, want_fit, record

    def __call__(self, games: pa.Table, players: pa.Table) -> pa.Table:
        out = []
        if games.num_rows and players.num_rows:
            part = games["_part"][0].as_py()
            games, players = games.sort_by("_g"), players.sort_by([("_g", "ascending"), ("response_id", "ascending")])
            of_games, of_players = games["_g"].to_numpy(), players["_g"].to_numpy()
            for g in np.unique(of_games):
                lo, hi = np.searchsorted(of_games, [g, g + 1])
                low, high = np.searchsorted(of_players, [g, g + 1])
                out += self._group(games.slice(lo, hi - lo), players.slice(low, high - low), part)
        source = games if games.num_rows else players
        return pa.concat_tables(out or [_rows({c: source[c][0] for c in self.by}, "none", 0)])

    def _group(self, games: pa.Table, players: pa.Table, part: int) -> list[pa.Table]:
        keys = {c: games[c][0] for c in self.by}
        chosen = list(range(part * SETTINGS_PER_TASK, min((part + 1) * SETTINGS_PER_TASK, len(self.settings))))
        params = [self.settings[i] for i in chosen]
        ids = players["response_id"].combine_chunks()
        truth = np.array(players["truth"].to_numpy(zero_copy_only=False), dtype=float)
        a = pc.index_in(games["a"], value_set=ids)
        b = pc.index_in(games["b"], value_set=ids)
        found = pc.and_(pc.is_valid(a), pc.is_valid(b))
        games = games.filter(found)
        if not games.num_rows:
            return []
        a = a.filter(found).to_numpy().astype(np.int64)
        b = b.filter(found).to_numpy().astype(np.int64)
        s, h = games["s"].to_numpy(), games["h"].to_numpy()
        step = np.zeros(len(a), dtype=np.int64)
        if self.limit is not None:
            blocks = block_count(len(a), self.limit)
            block = players["block_hash"].to_numpy() % blocks
            step = _meetings(block[a], block[b], blocks)
        base = np.lexsort((s, b, a, h))
        a, b, s, h, step = a[base], b[base], s[base], h[base], step[base]
        drawn = games["round"].to_numpy()[base] if "round" in games.column_names else None

        out: list[pa.Table] = []
        ratings = np.array([[p.initial for p in params]] * len(ids), dtype=float)
        live = np.arange(len(params))
        watch = [StopWatch(p) for p in params]
        final = ratings.copy()
        r_no = 0
        while len(live):
            if drawn is not None:
                use = np.flatnonzero(drawn == r_no)
                if not len(use):
                    break
            else:
                use = np.arange(len(a))
            order = use[round_order(h[use], r_no)]
            order = order[np.argsort(step[order], kind="stable")]
            k = np.array([params[i].k_at(r_no) for i in live])
            change, small, log = play_round(
                ratings, a[order], b[order], s[order], k, record=self.record
            )
            r = column_pearson(truth, ratings)
            counts = _winner_counts(s[order])
            stop = np.zeros(len(live), dtype=bool)
            reasons: list[str | None] = []
            avg = change / (2 * len(order))
            share = small / len(order)
            for i, setting in enumerate(live):
                p = params[setting]
                shown = share[i] / 2 if p.halve_small else share[i]
                reason = watch[setting].check(r_no, avg[i], shown, None if r is None else r[i])
                reasons.append(reason)
                last = p.max_rounds is not None and r_no + 1 >= p.max_rounds
                stop[i] = reason is not None or last
            n = len(live)
            out.append(
                _rows(
                    keys, "round", n, setting=[chosen[i] for i in live], round=[r_no + 1] * n, k=k,
                    pearson_r=None if r is None else r, avg_change=avg, pct_small=share,
                    A=[counts[0]] * n, B=[counts[1]] * n, Equal=[counts[2]] * n,
                    converge_reason=reasons,
                )
            )
            if self.record:
                g = len(order)
                names = np.where(s[order] == 1.0, "A", np.where(s[order] == 0.0, "B", "Equal"))
                out.append(
                    _rows(
                        keys, "game", g, setting=[chosen[0]] * g, round=[r_no + 1] * g,
                        k=np.full(g, k[0]), pair_in_round=np.arange(g),
                        response1_id=ids.take(pa.array(a[order])),
                        response2_id=ids.take(pa.array(b[order])), winner=names.tolist(),
                        old_a=log[0], old_b=log[1], new_a=log[0] + log[2], new_b=log[1] - log[2],
                    )
                )
            final[:, live] = ratings
            # the active set: settings that have stopped leave the matrix
            live = live[~stop]
            ratings = np.ascontiguousarray(ratings[:, ~stop])
            r_no += 1

        scores = normalise(final)
        for i, setting in enumerate(chosen):
            if self.want_ratings:
                out.append(
                    _rows(
                        keys, "item", len(ids), setting=[setting] * len(ids), response_id=ids,
                        norm_response=truth, elo=final[:, i], elo_normalized=scores[:, i],
                    )
                )
        if self.want_fit:
            q = fit_quality(truth, scores)
            n = len(chosen)
            out.append(
                _rows(
                    keys, "fit", n, setting=chosen, n=[q["n"]] * n, fit_r=q["pearson_r"],
                    r_squared=q["r_squared"], mae=q["mae"], rmse=q["rmse"],
                )
            )
        return out


def block_count(verdicts: int, limit: int) -> int:
    """Blocks of a group: an even number, so that a meeting holds about half of ``limit``."""
    return 2 * math.ceil(math.sqrt(verdicts / float(limit)))


def _units(sizes: DataFrame, by: list[str], target: float) -> DataFrame:
    """Groups with a number ``_g`` and the unit ``_unit`` they are packed into by size.

    Units are cuts of a running sum of sizes. The sum runs inside hash buckets first and
    over one row per bucket then, so no task sees all groups. A unit holds ``target``
    verdicts and at most one group more.
    """
    order = [F.col(c) for c in by]
    keyed = sizes.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(_HASH_BUCKETS)))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    placed = keyed.withColumns(
        {"_end": F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(inside)}
    )
    totals = keyed.groupBy("_bucket").agg(F.sum("_n").alias("_all"), F.count("*").alias("_many"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first"),
    )
    return placed.join(starts, "_bucket").select(
        *by, "_n", (F.col("_first") + F.col("_i") - 1).alias("_g"),
        F.floor((F.col("_start") + F.col("_end") - F.col("_n")) / F.lit(float(target))).alias("_unit"),
    )


def _replay_units(
    games: DataFrame, players: DataFrame, sizes: DataFrame, total: int, settings: list[EloParams],
    by: list[str], limit: int | None, ratings: bool, fits: bool, record: bool,
) -> DataFrame:
    """Groups that play inside a task: packed by size, one task per unit and settings chunk."""
    spark = games.sparkSession
    parts = math.ceil(len(settings) / SETTINGS_PER_TASK)
    # few groups with long replays are spread over the cores, many small ones share a task
    wanted = 4 * spark.sparkContext.defaultParallelism
    target = max(1.0, min(float(VERDICTS_PER_TASK), total * parts / wanted))
    units = measured(_units(sizes, by, target))
    n_units = (units.agg(F.max("_unit")).first()[0] or 0) + 1
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    # hashed units collide: more partitions than units keep two long ones apart
    tasks = output_partitions(spark, min(4 * n_units * parts, 20_000), 1)
    keys = ["_unit", "_part"]
    left = games.join(units.drop("_n"), by).withColumn("_part", part).repartition(tasks, *keys)
    right = _apart(players.join(units.drop("_n"), by).withColumn("_part", part)).repartition(tasks, *keys)
    replay = _UnitReplay(by, settings, limit, ratings, fits, record)
    played = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_two_tables(replay), _schema(by, games))
    played, _ = write_scratch(played, "replay-played")
    units.unpersist()
    return played


def elo_replay(
    verdicts: DataFrame, items: DataFrame, settings: EloParams | list[EloParams] = EloParams(),
    by: list[str] = GROUP, seed: int = 42, group_verdicts: int = GROUP_VERDICTS,
    ratings: bool = True, fits: bool = False, comparisons: bool = False, method: str = "blocks",
    task_verdicts: int = TASK_VERDICTS,
) -> EloRun:
    """Rate the items of every group by replaying its verdicts until a stop rule holds.

    Each round plays all verdicts (or those with that ``round`` value) one after the
    other. The order, and with it the ratings, depends on ``method`` and ``group_verdicts``.
    ``blocks`` walks meetings of blocks of items, cut to about ``group_verdicts`` verdicts;
    groups up to ``task_verdicts`` do so inside a task (sweeps: by verdicts times batches of
    settings). A larger one plays in cells where its verdicts' task and prompt part it into
    classes without a common item (``elo_cells``), else step by step over many tasks; ratings
    are equal in all places. ``sequence`` orders by a keyed hash alone and needs the group
    in one task: one above ``group_verdicts`` verdicts is an error. Verdicts that name an
    unknown item are dropped, and groups without verdicts skipped.
    """
    if method not in ("sequence", "blocks"):
        raise ValueError(f"unknown method {method!r}")
    settings = settings if isinstance(settings, list) else [settings]
    if comparisons and len(settings) > 1:
        raise ValueError("a comparison history needs a single parameter set")
    games, players, appear = _prepare(verdicts, items, by, seed)
    sizes = measured(games.groupBy(*by).agg(F.count("*").alias("_n")))
    total, largest = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if method == "sequence":
        if largest > group_verdicts:
            raise ValueError(f"a group has {largest} verdicts, more than {group_verdicts}; use method='blocks'")
        task_verdicts = largest
    limit = group_verdicts if method == "blocks" else None
    # what a task plays is verdicts times settings
    inside = task_verdicts if method == "sequence" else task_verdicts // math.ceil(len(settings) / SETTINGS_PER_TASK)
    tables, small = [], sizes
    if largest > inside:
        from rankforge.operators.elo_cells import replay_cells, split_cells

        large = sizes.filter(F.col("_n") > task_verdicts)
        small = sizes.filter(F.col("_n") <= task_verdicts)
        if "round" not in games.columns:  # rounds of their own verdicts may end at different times in two classes
            apart = split_cells(games, appear, sizes.filter(F.col("_n") > inside), by)
            if apart.limit(1).count():
                tables += replay_cells(games, players, appear, apart, settings, by, limit, ratings, fits, comparisons)
                large, small = (measured(t.join(apart.select(*by), by, "left_anti")) for t in (large, small))
        if large.limit(1).count():
            tables += _replay_large(games, players, large, settings, by, group_verdicts, fits, comparisons)
    if not tables or small.limit(1).count():
        tables.append(_replay_units(games, players, small, total, settings, by, limit, ratings, fits, comparisons))
    sizes.unpersist()
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.unionByName(t, allowMissingColumns=True)

    def pick(kind: str, fields) -> DataFrame:
        # a table of large groups leaves out the columns of a kind that is not wanted
        cols = [F.col(n) if n in everything.columns else F.lit(None).cast(t).alias(n) for n, t in fields]
        return everything.filter(F.col("kind") == kind).select(*by, "setting", *cols)

    fit_table = None
    if fits:
        fit_table = pick("fit", _FIT_FIELDS).withColumnRenamed("fit_r", "pearson_r")
    game_table = None
    if comparisons:
        game_table = pick("game", [("round", None), ("k", None), *_GAME_FIELDS])
    return EloRun(pick("item", _ITEM_FIELDS), pick("round", _ROUND_FIELDS), fit_table, game_table)


# --- groups too large for one task ---------------------------------------------


def _partner(block: Column, step: Column, blocks: Column) -> Column:
    """Opponent block in a round-robin schedule over an even number of blocks.

    Step 0 is the block against itself. Steps 1 .. blocks-1 are the circle method:
    blocks x and y meet when x + y = step - 1 modulo blocks - 1, and the block left
    over plays the last one.
    """
    m = blocks - 1
    r = step - 1
    mirrored = F.pmod(r - block, m)
    unpaired = F.pmod(r * F.floor(blocks / 2), m)  # solves 2x = r modulo the odd m
    paired = F.when(block == m, unpaired).otherwise(F.when(mirrored == block, m).otherwise(mirrored))
    return F.when((step == 0) | (blocks == 1), block).otherwise(paired)


def _meeting_step(x: Column, y: Column, blocks: Column) -> Column:
    """The step at which two blocks play."""
    m = blocks - 1
    low, high = F.least(x, y), F.greatest(x, y)
    # blocks - 1 has no partner of its own number: it meets x at step 2x
    return F.when(x == y, 0).otherwise(
        1 + F.pmod(F.when(high == m, 2 * low).otherwise(low + high), F.greatest(m, F.lit(1)))
    ).cast("int")


class _BlockReplay:
    """Plays the games between (or inside) two blocks.

    Returns the items with new ratings; the first item of the meeting carries the sums of
    the round so far, so that steps chain without a second reader.
    """

    def __init__(self, round_number, settings, record):
        self.round_number, self.settings, self.record = round_number, settings, record

    def __call__(self, players: pa.Table, games: pa.Table) -> pa.Table:
        # Spark tells arrays without nulls apart; what goes back is the plain kind
        plain = {"live": pa.list_(pa.int32()), "rating": pa.list_(pa.float64()), "sums": pa.list_(pa.float64())}
        for name, kind in plain.items():
            players = players.set_column(
                players.schema.get_field_index(name), name, players[name].cast(kind)
            )
        if not players.num_rows:
            return self._with_log(players)
        players = players.sort_by("response_id")
        ids = players["response_id"].combine_chunks()
        live = players["live"][0].as_py()
        ratings = np.array(players["rating"].to_pylist(), dtype=float).reshape(-1, len(live))
        sums = [r for r in players["sums"].to_pylist() if r is not None]
        total = np.sum(np.array(sums, dtype=float), axis=0) if sums else np.zeros(2 * len(live) + 3)
        log = None
        if games.num_rows:
            a = pc.index_in(games["a"], value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
            b = pc.index_in(games["b"], value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
            s, h = games["s"].to_numpy(), games["h"].to_numpy()
            base = np.lexsort((s, b, a, h))
            order = base[round_order(h[base], self.round_number)]
            k = np.array([self.settings[i].k_at(self.round_number) for i in live])
            change, small, log = play_round(ratings, a[order], b[order], s[order], k, record=self.record)
            total += np.concatenate([change, small, _winner_counts(s)])
        n = players.num_rows
        made = {
            "rating": pa.array(list(ratings), type=pa.list_(pa.float64())),
            "sums": pa.array([total.tolist()] + [None] * (n - 1), type=pa.list_(pa.float64())),
        }
        for name, column in made.items():
            players = players.set_column(players.schema.get_field_index(name), name, column)
        if not self.record or log is None:
            return self._with_log(players)
        g = len(order)
        tags = {c: pa.repeat(players[c][0], g) for c in players.column_names if c not in _STATE}
        played = pa.table(
            {
                **tags, "response1_id": ids.take(pa.array(a[order])), "response2_id": ids.take(pa.array(b[order])),
                "s": pa.array(s[order]), "position": pa.array(np.arange(g)), "old_a": pa.array(log[0]),
                "old_b": pa.array(log[1]), "delta": pa.array(log[2]),
            }
        )
        wide = pa.concat_tables([players, played], promote_options="default")
        return wide.select([*players.column_names, *_LOG_TYPES])

    def _with_log(self, players: pa.Table) -> pa.Table:
        for name, kind in _LOG_TYPES.items() if self.record else ():
            players = players.append_column(name, pa.nulls(players.num_rows, kind))
        return players


#: Columns of an item's state; games of the log leave them empty.
_STATE = {"response_id", "truth", "_block", "_nb", "live", "rating", "sums"}
_BLOCK_DDL = (
    "response_id string, truth double, _block int, _nb int, live array<int>, rating array<double>, "
    "sums array<double>, _lo int, _hi int"
)
_LOG_TYPES = {
    "response1_id": pa.string(), "response2_id": pa.string(), "s": pa.float64(), "position": pa.int64(),
    "old_a": pa.float64(), "old_b": pa.float64(), "delta": pa.float64(),
}
_LOG_DDL = (
    "response1_id string, response2_id string, s double, position bigint, old_a double, old_b double, delta double"
)


def _settings_table(spark, settings: list[EloParams]) -> DataFrame:
    """One row per parameter set: what the stop rules read."""
    rows = [
        (
            i, p.patience, p.min_r_delta, p.min_r_delta_rounds, p.max_rounds, p.use_r_delta, p.use_truth, p.halve_small,
            f"patience_{p.patience}", f"r_delta<{p.min_r_delta}_in_{p.min_r_delta_rounds}r",
        )
        for i, p in enumerate(settings)
    ]
    return spark.createDataFrame(
        rows,
        "setting int, _patience int, _delta double, _window int, _cap int, _by_delta boolean, _truth boolean, "
        "_halve boolean, _say_patience string, _say_delta string",
    )


def _advance_rules(stats: DataFrame, watch: DataFrame | None, rules: DataFrame, by: list[str]) -> DataFrame:
    """The stop rules of one round, per group and setting, on executors.

    ``stats`` has round, pearson_r, has_r, avg_change, pct_small; ``watch`` is the result of
    the round before (best r, the round it came, the last r values) or None.
    """
    key = [*by, "setting"]
    if watch is None:
        joined = stats.withColumns(
            {"_best": F.lit(float("-inf")), "_improved": F.lit(0), "_hist": F.array().cast("array<double>")}
        )
    else:
        joined = stats.join(watch.select(*key, "_best", "_improved", "_hist"), key)
    joined = joined.join(rules, "setting")
    seen = F.col("has_r") & F.col("_truth")
    better = F.coalesce(seen & (F.col("pearson_r") > F.col("_best")), F.lit(False))
    now = F.col("round") - 1
    longer = F.concat("_hist", F.array(F.coalesce("pearson_r", F.lit(float("nan")))))
    joined = joined.withColumns(
        {
            "_improved": F.when(better, now).otherwise(F.col("_improved")),
            "_best": F.when(better, F.col("pearson_r")).otherwise(F.col("_best")),
            "_hist": F.when(
                seen,
                F.slice(longer, F.greatest(F.lit(1), F.size(longer) - F.col("_window") + 1), F.col("_window")),
            ).otherwise(F.col("_hist")),
        }
    )
    gain = F.try_element_at("_hist", F.lit(-1)) - F.try_element_at("_hist", F.lit(1))
    flat = (F.size("_hist") >= F.col("_window")) & ~F.isnan(gain) & (gain < F.col("_delta"))
    shown = F.when(F.col("_halve"), F.col("pct_small") / 2).otherwise(F.col("pct_small"))
    reason = (
        F.when(F.col("avg_change") < 0.1, F.lit("avg_change<0.1"))
        .when(shown > 0.95, F.lit("95%_small"))
        .when(F.col("_truth") & (now - F.col("_improved") >= F.col("_patience")), F.col("_say_patience"))
        .when(F.col("_truth") & F.col("_by_delta") & flat, F.col("_say_delta"))
    )
    capped = F.coalesce(F.col("round") >= F.col("_cap"), F.lit(False))
    return joined.withColumn("converge_reason", reason).withColumn(
        "stopped", F.col("converge_reason").isNotNull() | capped
    ).drop(*[c for c in rules.columns if c != "setting"])


def _replay_large(
    games: DataFrame, players: DataFrame, sizes: DataFrame, settings: list[EloParams],
    by: list[str], limit: int, fits: bool, record: bool,
) -> list[DataFrame]:
    """Sequential replay of groups whose verdicts do not fit one task.

    In each step of the schedule every block meets one other (or itself): these meetings
    share no item and run in parallel. With verdicts spread evenly over the items, a meeting
    holds about ``limit`` / 2 of them however large the group is; one item in very many
    verdicts makes its block's meetings larger, as its games depend on each other and have
    to be played in turn. Verdicts are written once, partitioned by step. Steps of a round
    chain, the sums riding along, and are checkpointed every STEPS_PER_CHECKPOINT steps and
    at the end of the round. Stop rules advance in a table of one row per group and setting;
    settings that have stopped leave the rating arrays, and groups without any leave the
    rounds. The driver learns how many rows of that table are still live, nothing else.
    """
    spark = games.sparkSession
    blocks = measured(
        sizes.select(*by, (2 * F.ceil(F.sqrt(F.col("_n") / F.lit(float(limit))))).cast("int").alias("_nb"))
    )

    def block_of(hashed: Column) -> Column:
        return F.pmod(hashed, F.col("_nb").cast("bigint")).cast("int")

    tagged = games.join(blocks, by).withColumns(
        {"_x": block_of(block_hash("a")), "_y": block_of(block_hash("b"))}
    )
    tagged = tagged.withColumns(
        {
            "_lo": F.least("_x", "_y"), "_hi": F.greatest("_x", "_y"),
            "_step": _meeting_step(F.col("_x"), F.col("_y"), F.col("_nb")),
        }
    ).drop("_x", "_y", "_nb")
    path = scratch_path(spark, "replay-games")
    tagged.write.partitionBy("_step").parquet(path)
    stored = spark.read.parquet(path)
    steps = sorted(r[0] for r in stored.select("_step").distinct().collect())
    rules = _settings_table(spark, settings)

    no_sums = F.lit(None).cast("array<double>")
    state = cut_lineage(
        players.join(blocks, by).select(
            *by, "response_id", "truth", block_of(F.col("block_hash")).alias("_block"), "_nb",
            F.array(*[F.lit(i) for i in range(len(settings))]).alias("live"),
            F.array(*[F.lit(float(p.initial)) for p in settings]).alias("rating"), no_sums.alias("sums"),
        )
    )
    blocks.unpersist()
    columns = state.columns
    keys_ddl = ", ".join(f"`{c}` {games.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys_ddl}, {_BLOCK_DDL}" + (f", {_LOG_DDL}" if record else "")
    meeting = [*by, "_lo", "_hi"]
    history_path, done_path, log_path = (scratch_path(spark, f"replay-{n}") for n in ("rounds", "done", "log"))
    history, log = [], []
    watch: DataFrame | None = None
    r_no = 0
    while True:
        used = stored.filter(F.col("round") == r_no).drop("round") if "round" in stored.columns else stored
        if "round" in stored.columns and not used.limit(1).count():
            break
        for at, step in enumerate(steps):
            other = _partner(F.col("_block"), F.lit(step), F.col("_nb"))
            placed = state.withColumns(
                {"_lo": F.least("_block", other).cast("int"), "_hi": F.greatest("_block", other).cast("int")}
            )
            replay = _BlockReplay(r_no, settings, record)
            now = _apart(used.filter(F.col("_step") == step).drop("_step"))
            # a meeting without players belongs to a group that has stopped
            out = placed.groupBy(*meeting).cogroup(now.groupBy(*meeting)).applyInArrow(_two_tables(replay), schema)
            if record:
                out = cut_lineage(out)
                out.filter(F.col("position").isNotNull()).select(
                    *by, "_lo", "_hi", *_LOG_TYPES, F.lit(step).alias("_step"), F.lit(r_no + 1).alias("round"),
                    F.lit(settings[0].k_at(r_no)).alias("k"),
                ).write.mode("append").parquet(log_path)
                log = [log_path]
                out = out.filter(F.col("position").isNull())
            state = out.select(*columns)
            if (at + 1) % STEPS_PER_CHECKPOINT == 0 and at + 1 < len(steps) and not record:
                state = cut_lineage(state)
        state = cut_lineage(state)
        stats = _round_rows(state, by, r_no)
        watch = cut_lineage(_advance_rules(stats, watch, rules, by))
        ks = F.create_map(*[F.lit(x) for i, p in enumerate(settings) for x in (i, p.k_at(r_no))])
        watch.select(
            *by, "setting", F.lit("round").alias("kind"), "round", ks[F.col("setting")].alias("k"),
            "pearson_r", "avg_change", "pct_small", "A", "B", "Equal", "converge_reason",
        ).write.mode("append").parquet(history_path)
        history = [history_path]
        over, left = watch.agg(F.count_if("stopped"), F.count_if(~F.col("stopped"))).first()
        if over:
            ended = watch.filter("stopped").groupBy(*by).agg(F.sort_array(F.collect_list("setting")).alias("_over"))
            joined = state.join(ended, by, "left").withColumn("_z", F.arrays_zip("live", "rating"))
            gone = F.filter("_z", lambda z: F.array_contains("_over", z["live"]))
            joined.filter(F.col("_over").isNotNull()).select(
                *by, "response_id", F.col("truth").alias("norm_response"), F.inline(gone)
            ).withColumnsRenamed({"live": "setting", "rating": "elo"}).write.mode("append").parquet(done_path)
            stay = F.when(F.col("_over").isNull(), F.col("_z")).otherwise(
                F.filter("_z", lambda z: ~F.array_contains("_over", z["live"]))
            )
            state = joined.withColumn("_z", stay).filter(F.size("_z") > 0).withColumns(
                {"live": F.col("_z")["live"], "rating": F.col("_z")["rating"]}
            ).select(*columns)
            watch = watch.filter(~F.col("stopped"))
        if not left:
            break
        state = state.withColumn("sums", no_sums)
        r_no += 1
    # without verdicts for a further round, what is live ends where it stands
    state.select(
        *by, "response_id", F.col("truth").alias("norm_response"), F.inline(F.arrays_zip("live", "rating"))
    ).withColumnsRenamed({"live": "setting", "rating": "elo"}).write.mode("append").parquet(done_path)
    drop_scratch(spark, path)

    rating_ddl = f"{keys_ddl}, response_id string, norm_response double, setting int, elo double"
    round_ddl = (
        f"{keys_ddl}, setting int, kind string, round int, k double, pearson_r double, avg_change double, "
        "pct_small double, A bigint, B bigint, Equal bigint, converge_reason string"
    )
    rounds = _read_back(spark, history, round_ddl)
    spread = _read_back(spark, [done_path], rating_ddl)
    ratings = normalise_ratings(spread, [*by, "setting"]).withColumn("kind", F.lit("item"))
    tables = [rounds, ratings]
    if fits:
        from rankforge.operators.evaluate import rating_metrics

        quality = rating_metrics(ratings, [*by, "setting"], with_p=False)
        tables.append(quality.withColumnRenamed("pearson_r", "fit_r").withColumn("kind", F.lit("fit")))
    if record:
        logged = _read_back(
            spark, log, f"{keys_ddl}, _lo int, _hi int, {_LOG_DDL}, _step int, round int, k double"
        )
        numbered = row_index(logged, ["_step", "_lo", "_hi", "position"], [*by, "round"], name="pair_in_round")
        name = F.when(F.col("s") == 1.0, "A").when(F.col("s") == 0.0, "B").otherwise("Equal")
        tables.append(
            numbered.select(
                *by, F.lit(0).alias("setting"), F.lit("game").alias("kind"), "round", "k",
                "pair_in_round", "response1_id", "response2_id", name.alias("winner"), "old_a",
                "old_b", (F.col("old_a") + F.col("delta")).alias("new_a"),
                (F.col("old_b") - F.col("delta")).alias("new_b"),
            )
        )
    return tables


def _read_back(spark, paths: list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def _round_rows(state: DataFrame, by: list[str], round_number: int) -> DataFrame:
    """Per group and live setting: the sums and r of a round, from the items behind it."""
    truth = F.when(~F.isnan("truth"), F.col("truth"))
    each = state.select(
        *by, truth.alias("t"), F.posexplode(F.arrays_zip("live", "rating")).alias("_i", "_z"),
        F.size("live").alias("_live"), "sums",
    )
    known = F.when(F.col("t").isNotNull(), F.col("_z.rating"))

    def of(offset: Column) -> Column:
        return F.coalesce(F.sum(F.element_at("sums", (offset + 1).cast("int"))), F.lit(0.0))

    at, live = F.col("_i"), F.col("_live")
    rows = each.groupBy(*by, F.col("_z.live").alias("setting")).agg(
        of(at).alias("_change"), of(live + at).alias("_small"),
        *[of(2 * live + i).cast("bigint").alias(c) for i, c in enumerate(("A", "B", "Equal"))],
        F.when(F.count("t") >= 2, pearson(F.col("t"), known)).alias("pearson_r"),
        (F.count("t") >= 2).alias("has_r"),
    )
    n = F.col("A") + F.col("B") + F.col("Equal")
    return rows.filter(n > 0).select(
        *by, "setting", F.lit(round_number + 1).alias("round"), "pearson_r", "has_r",
        (F.col("_change") / (2 * n)).alias("avg_change"), (F.col("_small") / n).alias("pct_small"), "A", "B", "Equal",
    )


def normalise_ratings(ratings: DataFrame, by: list[str] = GROUP, rating: str = "elo") -> DataFrame:
    """Add the min-max normalised rating per group; a flat group becomes 0.

    Bounds come from an aggregation and join, not a window, so a group holding most
    items needs no single-task sort.
    """
    bounds = ratings.groupBy(*by).agg(F.min(rating).alias("_low"), F.max(rating).alias("_high"))
    span = F.col("_high") - F.col("_low")
    value = F.when(span > 0, (F.col(rating) - F.col("_low")) / span).otherwise(F.lit(0.0))
    return ratings.join(measured(bounds), by).withColumn("elo_normalized", value).drop("_low", "_high")

