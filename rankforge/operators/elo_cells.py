"""Exact sequential replay of large groups whose verdicts fall into classes without a common item.

Games depend on each other only through the items they share. Where the class columns of a
verdict (task, prompt) cut a group into classes that share no item, each class can play the
group's order alone. Classes are dealt into cells, a task plays all rounds of a cell, and
what the stop rules read is merged from the sums of the cells. A first pass plays rounds and
returns sums only; rules are judged per group and setting; a last pass plays every setting up
to its last round and returns ratings. Settings that differ in their stop rules alone are
one path of ratings and are played once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators.elo_replay import (
    SETTINGS_PER_TASK, TASK_VERDICTS, _apart, _meetings, _two_tables, _winner_counts,
)
from rankforge.operators.elo_rules import EloParams, StopWatch, mixed, play_round, round_order, sync_round
from rankforge.operators.ordering import row_index
from rankforge.session import measured, output_partitions, write_scratch

#: Verdicts of a cell: what a task plays at a time.
CELL_VERDICTS = 125_000
#: Rounds of the first pass; each further pass goes twice as far.
FIRST_ROUNDS = 40

_MOMENTS = ["mt", "ctt", "tlo", "thi", "mx", "cxx", "ctx", "lo", "hi", "klo", "khi"]
_SUM_DDL = (
    "_path int, round int, change double, small bigint, A bigint, B bigint, Equal bigint, n bigint, "
    + ", ".join(f"{c} double" for c in _MOMENTS)
)
_LAST_DDL = (
    "_path int, stop int, kind string, response_id string, norm_response double, elo double, elo_normalized double, "
    "n bigint, mt double, ctt double, tlo double, thi double, sabs double, ssq double, round int, k double, _step int, "
    "_z bigint, response1_id string, response2_id string, s double, old_a double, old_b double, delta double"
)
_JUDGED_DDL = (
    "setting int, _path int, round int, k double, pearson_r double, avg_change double, pct_small double, "
    "A bigint, B bigint, Equal bigint, converge_reason string, lo double, hi double, over boolean"
)


def paths_of(settings: list[EloParams]) -> tuple[list[EloParams], list[int]]:
    """The different paths of ratings among the settings, and the path of each setting."""
    seen: dict[tuple, int] = {}
    first, of = [], []
    for p in settings:
        key = (p.initial, p.fixed_k) if p.fixed_k is not None else (p.initial, p.k_start, p.k_end, p.decay_rounds)
        if key not in seen:
            seen[key] = len(first)
            first.append(p)
        of.append(seen[key])
    return first, of


def _key_of(table: pa.Table, by: list[str]) -> tuple:
    return tuple(table[c][0].as_py() for c in by)


def _table(ddl: str, tags: dict, length: int, **cols) -> pa.Table:
    """An output block in the order of the schema: tags repeated, given columns, the rest NULL."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    arrays = [pa.repeat(v, length) for v in tags.values()]
    names = list(tags)
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        value = cols.get(name)
        if value is None:
            value = pa.nulls(length, kinds[kind])
        elif np.isscalar(value):
            value = pa.repeat(pa.scalar(value, type=kinds[kind]), length)
        elif not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.array(value, type=kinds[kind])
        arrays.append(value.cast(kinds[kind]))
        names.append(name)
    return pa.table(arrays, names=names)


class _Cell:
    """The games of a cell in the order of its group, on item numbers."""

    def __init__(self, games: pa.Table, players: pa.Table, sync: bool | None = None):
        self.sync = sync  # rounds at once, by mean or sum of changes; None: one game after the other
        players = players.sort_by("response_id")
        self.ids = players["response_id"].combine_chunks()
        self.truth = np.array(players["truth"].to_numpy(zero_copy_only=False), dtype=float)
        a = pc.index_in(games["a"], value_set=self.ids)
        b = pc.index_in(games["b"], value_set=self.ids)
        a = a.to_numpy(zero_copy_only=False).astype(np.int64)
        b = b.to_numpy(zero_copy_only=False).astype(np.int64)
        s, h = games["s"].to_numpy(zero_copy_only=False), games["h"].to_numpy()
        blocks = players["_nb"][0].as_py()
        block = players["block_hash"].to_numpy() % blocks
        step = _meetings(block[a], block[b], blocks)
        base = np.lexsort((s, b, a, h))
        self.a, self.b, self.s, self.h, self.step = a[base], b[base], s[base], h[base], step[base]
        self.counts = _winner_counts(self.s)
        known = ~np.isnan(self.truth)
        self.known = slice(None) if known.all() else known
        t = self.truth[self.known]
        self.n = len(t)
        self.mean = float(t.mean()) if self.n else 0.0
        self.off = t - self.mean
        self.truths = {
            "mt": self.mean, "ctt": float((self.off**2).sum()),
            "tlo": float(t.min()) if self.n else None, "thi": float(t.max()) if self.n else None,
        }

    def order(self, round_number: int) -> np.ndarray:
        order = round_order(self.h, round_number)
        return order[np.argsort(self.step[order], kind="stable")]

    def play(self, ratings: np.ndarray, round_number: int, k: np.ndarray, record: bool = False):
        if self.sync is not None:
            return None, sync_round(ratings, self.a, self.b, self.s, k, self.sync)
        order = self.order(round_number)
        return order, play_round(ratings, self.a[order], self.b[order], self.s[order], k, record=record)


class _Sums:
    """Plays rounds of a cell and returns the sums of each: no item leaves the task."""

    def __init__(self, by, paths, rounds, live, sync):
        # ``live``: paths still played per group, None for all
        self.by, self.paths, self.rounds, self.live, self.sync = by, paths, rounds, live, sync

    def __call__(self, games: pa.Table, players: pa.Table) -> pa.Table:
        if not players.num_rows:
            return _table(_SUM_DDL, {c: games[c][0] for c in self.by}, 0)
        key, part = _key_of(players, self.by), players["_part"][0].as_py()
        tags = {c: players[c][0] for c in self.by}
        low, high = part * SETTINGS_PER_TASK, min((part + 1) * SETTINGS_PER_TASK, len(self.paths))
        chosen = [i for i in range(low, high) if self.live is None or i in self.live.get(key, ())]
        if not chosen:
            return _table(_SUM_DDL, tags, 0)
        cell = _Cell(games, players, self.sync)
        ratings = np.array([[self.paths[i].initial for i in chosen]] * len(cell.ids), dtype=float)
        m, out = len(chosen), []
        for r_no in range(self.rounds):
            k = np.array([self.paths[i].k_at(r_no) for i in chosen])
            _, (change, small, _) = cell.play(ratings, r_no, k)
            x = ratings[cell.known]
            mean = x.mean(axis=0) if cell.n else np.zeros(m)
            off = x - mean
            out.append(
                _table(
                    _SUM_DDL, tags, m, _path=chosen, round=r_no + 1, change=change, small=small, A=cell.counts[0],
                    B=cell.counts[1], Equal=cell.counts[2], n=cell.n, **cell.truths, mx=mean,
                    cxx=(off * off).sum(axis=0), ctx=cell.off @ off, lo=ratings.min(axis=0), hi=ratings.max(axis=0),
                    klo=x.min(axis=0) if cell.n else None, khi=x.max(axis=0) if cell.n else None,
                )
            )
        return pa.concat_tables(out)


class _Last:
    """Plays every path to the last rounds of its settings: ratings, fit sums, games there."""

    def __init__(self, by, paths, ends, ratings, fits, record, sync):
        # ``ends``: per group and path, the last rounds with the bounds of the ratings there
        self.by, self.paths, self.ends, self.sync = by, paths, ends, sync
        self.ratings, self.fits, self.record = ratings, fits, record

    def __call__(self, games: pa.Table, players: pa.Table) -> pa.Table:
        if not players.num_rows:
            return _table(_LAST_DDL, {c: games[c][0] for c in self.by}, 0)
        key, part = _key_of(players, self.by), players["_part"][0].as_py()
        tags = {c: players[c][0] for c in self.by}
        ends = self.ends.get(key, {})
        low, high = part * SETTINGS_PER_TASK, min((part + 1) * SETTINGS_PER_TASK, len(self.paths))
        live = [i for i in range(low, high) if i in ends]
        out = [_table(_LAST_DDL, tags, 0)]
        if not live:
            return out[0]
        cell = _Cell(games, players, self.sync)
        ratings = np.array([[self.paths[i].initial for i in live]] * len(cell.ids), dtype=float)
        r_no = 0
        while live:
            k = np.array([self.paths[i].k_at(r_no) for i in live])
            order, (_, _, log) = cell.play(ratings, r_no, k, self.record)
            r_no += 1
            if self.record:
                z = (mixed(cell.h[order], r_no - 1) ^ np.uint64(1 << 63)).view(np.int64)
                out.append(
                    _table(
                        _LAST_DDL, tags, len(order), _path=live[0], stop=max(ends[live[0]]), kind="game", round=r_no,
                        k=float(k[0]),
                        _step=cell.step[order], _z=z, response1_id=cell.ids.take(pa.array(cell.a[order])),
                        response2_id=cell.ids.take(pa.array(cell.b[order])), s=cell.s[order],
                        old_a=log[0], old_b=log[1], delta=log[2],
                    )
                )
            for at, i in enumerate(live):
                if r_no in ends[i]:
                    out += self._ended(cell, tags, i, r_no, ratings[:, at], *ends[i][r_no])
            left = np.array([max(ends[i]) > r_no for i in live])
            live = [i for i, stays in zip(live, left) if stays]
            ratings = np.ascontiguousarray(ratings[:, left])
        return pa.concat_tables(out)

    def _ended(self, cell, tags, path, stop, elo, low, high) -> list[pa.Table]:
        scores = (elo - low) / (high - low) if high > low else np.zeros(len(elo))
        out = []
        if self.ratings:
            out.append(
                _table(
                    _LAST_DDL, tags, len(elo), _path=path, stop=stop, kind="item", response_id=cell.ids,
                    norm_response=pa.array(cell.truth, mask=np.isnan(cell.truth)), elo=elo, elo_normalized=scores,
                )
            )
        if self.fits:
            miss = scores[cell.known] - cell.truth[cell.known]
            out.append(
                _table(
                    _LAST_DDL, tags, 1, _path=path, stop=stop, kind="fit", n=cell.n, **cell.truths,
                    sabs=float(np.abs(miss).sum()), ssq=float((miss**2).sum()),
                )
            )
        return out


def _merged(sums: DataFrame, by: list[str]) -> DataFrame:
    """The rounds of whole groups from those of their cells; moments merge around the common mean."""
    key = [*by, "_path", "round"]
    means = sums.groupBy(*key).agg(
        F.sum("n").alias("_all"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"_{c}") for c in ("mt", "mx")]
    )
    dt, dx = F.col("mt") - F.col("_mt"), F.col("mx") - F.col("_mx")
    n = F.col("n")
    out = sums.join(means, key).groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("change", "small", "A", "B", "Equal", "n")],
        F.sum(F.col("ctt") + n * dt * dt).alias("_tt"), F.sum(F.col("cxx") + n * dx * dx).alias("_xx"),
        F.sum(F.col("ctx") + n * dt * dx).alias("_tx"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.min("klo") < F.max("khi")).alias("_apart"),
    )
    bottom = F.sqrt("_tt") * F.sqrt("_xx")
    r = F.when(F.col("_apart") & (F.col("n") >= 2), F.try_divide("_tx", bottom))
    return out.withColumn("pearson_r", r).drop("_tt", "_xx", "_tx", "_apart")


class _Judge:
    """The stop rules of a group and setting over all rounds played so far."""

    def __init__(self, by, settings, over, rules):
        self.by, self.settings, self.over, self.rules = by, settings, over, rules

    def __call__(self, rounds: pa.Table) -> pa.Table:
        tags = {c: rounds[c][0] for c in self.by}
        setting = rounds["setting"][0].as_py()
        rows = []
        if (*_key_of(rounds, self.by), setting) not in self.over:
            p = self.settings[setting]
            watch = StopWatch(p)
            for row in rounds.sort_by("round").to_pylist():
                games = row["A"] + row["B"] + row["Equal"]
                avg, share = row["change"] / (2 * games), row["small"] / games
                r = row["pearson_r"]
                seen = None if row["n"] < 2 else float("nan") if r is None else r
                at = row["round"] - 1
                shown = share / 2 if p.halve_small else share
                reason = watch.check(at, avg, shown, seen) if self.rules else None
                last = p.max_rounds is not None and at + 1 >= p.max_rounds
                over = reason is not None or last
                rows.append(
                    {
                        "setting": setting, "_path": row["_path"], "round": at + 1, "k": p.k_at(at), "pearson_r": r,
                        "avg_change": avg, "pct_small": share, "A": row["A"], "B": row["B"], "Equal": row["Equal"],
                        "converge_reason": reason, "lo": row["lo"], "hi": row["hi"], "over": over,
                    }
                )
                if over:
                    break
        if not rows or not rows[-1]["over"]:
            rows = []  # a further pass plays this setting from the start
        return _table(_JUDGED_DDL, tags, len(rows), **{c: [r[c] for r in rows] for c in rows[0]} if rows else {})


def split_cells(games: DataFrame, appear: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """The groups of ``sizes`` that have several classes, which share no item and fit a task each."""
    tangled = appear.filter(F.col("_c") != F.col("_last")).select(*by).distinct()
    classes = games.groupBy(*by, "_c").agg(F.count("*").alias("_m"))
    whole = classes.groupBy(*by).agg(F.count("*").alias("_k"), F.max("_m").alias("_m"))
    fit = whole.filter((F.col("_k") > 1) & (F.col("_m") <= TASK_VERDICTS)).select(*by)
    return measured(sizes.join(fit, by, "left_semi").join(tangled, by, "left_anti"))


def replay_cells(
    games: DataFrame, players: DataFrame, appear: DataFrame, sizes: DataFrame, settings: list[EloParams],
    by: list[str], limit: int, ratings: bool, fits: bool, record: bool,
    sync: bool | None = None, rules: bool = True,
) -> list[DataFrame]:
    """Replay of groups whose classes share no item; ratings equal those of the other places.

    ``sync`` plays rounds at once, by mean or sum of changes; without ``rules`` only the cap
    on rounds ends a setting. The driver holds, per large group and setting, the last round: groups have more than
    a task's verdicts each, so their number follows the input divided by that.
    """
    spark = games.sparkSession
    paths, path_of = paths_of(settings)
    parts = math.ceil(len(paths) / SETTINGS_PER_TASK)
    nb = (2 * F.ceil(F.sqrt(F.col("_n") / F.lit(float(limit))))).cast("int")
    cells = F.ceil(F.col("_n") / F.lit(float(CELL_VERDICTS))).cast("bigint")
    chosen = measured(sizes.select(*by, nb.alias("_nb"), cells.alias("_cells")))
    n_cells = chosen.agg(F.sum("_cells")).first()[0]
    # hashed cells collide: where they are few, more partitions keep two long ones apart
    tasks = output_partitions(spark, min(max(n_cells * parts, min(4 * n_cells * parts, 800)), 20_000), 1)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    cell = F.pmod("_c", "_cells")
    keys = [*by, "_cell", "_part"]
    left = games.join(chosen.drop("_nb"), by).select(*by, "a", "b", "s", "h", cell.alias("_cell"))
    own = F.coalesce("_c", F.xxhash64("response_id"))  # an item without games has a cell too
    known = appear.select(*[F.col(c).alias(c) for c in by], F.col("id").alias("response_id"), "_c")
    right, _ = write_scratch(
        players.join(chosen, by).join(known, [*by, "response_id"], "left").withColumn("_c", own).select(
            *by, "response_id", "truth", "block_hash", "_nb", cell.alias("_cell")
        ),
        "replay-items",
    )
    keys_ddl = ", ".join(f"`{c}` {games.schema[c].dataType.simpleString()}" for c in by)

    def play(run, ddl: str, name: str) -> DataFrame:
        l, r = (_apart(t).withColumn("_part", part).repartition(tasks, *keys) for t in (left, right))
        made = l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_two_tables(run), f"{keys_ddl}, {ddl}")
        return write_scratch(made, name)[0]

    names = spark.createDataFrame(list(enumerate(path_of)), "setting int, _path int")
    ends: dict[tuple, dict[int, dict[int, tuple]]] = {}
    over: set[tuple] = set()
    live: dict[tuple, set[int]] | None = None
    judged, span = [], FIRST_ROUNDS
    open_ = {(*g, i) for g in map(tuple, chosen.select(*by).collect()) for i in range(len(settings))}
    while open_:
        caps = [settings[x[-1]].max_rounds for x in open_]
        rounds = span if any(c is None for c in caps) else min(span, max(caps))
        sums = play(_Sums(by, paths, rounds, live, sync), _SUM_DDL, "replay-sums")
        stats = _merged(sums, by).filter(F.col("A") + F.col("B") + F.col("Equal") > 0).join(names, "_path")
        judge = _Judge(by, settings, over, rules)
        found = stats.groupBy(*by, "setting").applyInArrow(_one_table(judge), f"{keys_ddl}, {_JUDGED_DDL}")
        found = write_scratch(found, "replay-judged")[0]
        judged.append(found)
        over = set(over)
        for row in found.filter("over").select(*by, "setting", "_path", "round", "lo", "hi").collect():
            group, (setting, path, stop, low, high) = tuple(row[: len(by)]), row[len(by):]
            ends.setdefault(group, {}).setdefault(path, {})[stop] = (low, high)
            over.add((*group, setting))
        open_ -= over
        live = {}
        for *group, setting in open_:
            live.setdefault(tuple(group), set()).add(path_of[setting])
        span *= 2

    history = judged[0]
    for more in judged[1:]:
        history = history.unionByName(more)
    tables = [history.drop("_path", "lo", "hi", "over").withColumn("kind", F.lit("round"))]
    ended = history.filter("over").select(
        *by, "setting", "_path", F.col("round").alias("stop"), F.col("pearson_r").alias("_r")
    )
    if ratings or fits or record:
        last = play(_Last(by, paths, ends, ratings, fits, record, sync), _LAST_DDL, "replay-last")
    at = [*by, "_path", "stop"]
    if ratings:
        items = last.filter("kind = 'item'").select(*at, "kind", "response_id", "norm_response", "elo", "elo_normalized")
        tables.append(items.join(ended.drop("_r"), at).drop("_path", "stop"))
    if fits:
        tables.append(_fits(last.filter("kind = 'fit'"), at).join(ended, at).select(
            *by, "setting", F.lit("fit").alias("kind"), "n", F.when(F.col("n") >= 2, F.col("_r")).alias("fit_r"),
            "r_squared", "mae", "rmse",
        ))
    if record:
        logged = last.filter("kind = 'game'").select(
            *by, "round", "k", "_step", "_z", "response1_id", "response2_id", "s", "old_a", "old_b", "delta"
        )
        order = ["_step", "_z", "response1_id", "response2_id", "s"]
        numbered = row_index(logged, order, [*by, "round"], name="pair_in_round")
        name = F.when(F.col("s") == 1.0, "A").when(F.col("s") == 0.0, "B").otherwise("Equal")
        tables.append(
            numbered.select(
                *by, F.lit(0).alias("setting"), F.lit("game").alias("kind"), "round", "k",
                "pair_in_round", "response1_id", "response2_id", name.alias("winner"), "old_a", "old_b", (F.col("old_a") + F.col("delta")).alias("new_a"),
                (F.col("old_b") - F.col("delta")).alias("new_b"),
            )
        )
    chosen.unpersist()
    return tables


def _one_table(run):
    """Spark reads the arity of a grouped function; hand it a plain one."""

    def call(rows: pa.Table) -> pa.Table:
        return run(rows)

    return call


def _fits(sums: DataFrame, at: list[str]) -> DataFrame:
    """Rank quality per group and path from the sums of the cells."""
    mean = sums.groupBy(*at).agg((F.sum(F.col("n") * F.col("mt")) / F.sum("n")).alias("_mt"))
    off = F.col("mt") - F.col("_mt")
    whole = sums.join(mean, at).groupBy(*at).agg(
        F.sum("n").alias("n"), F.sum(F.col("ctt") + F.col("n") * off * off).alias("_tt"), F.sum("sabs").alias("_sabs"),
        F.sum("ssq").alias("_ssq"), (F.min("tlo") < F.max("thi")).alias("_apart"),
    )
    r2 = F.when(F.col("_apart"), 1 - F.col("_ssq") / F.col("_tt")).otherwise(
        F.when(F.col("_ssq") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    enough = F.col("n") >= 2
    return whole.select(
        *at, "n", F.when(enough, r2).alias("r_squared"), F.when(enough, F.col("_sabs") / F.col("n")).alias("mae"),
        F.when(enough, F.sqrt(F.col("_ssq") / F.col("n"))).alias("rmse"),
    )
