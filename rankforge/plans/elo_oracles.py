"""The sequential replay as SQL: a recursive query in which each step plays all ready games.

A game is ready when it is the next one of both its players, so the ratings are those of
playing the games one by one, in the order of blocks and keyed hashes of the operators.
"""

from __future__ import annotations

from rankforge.functions import permutation
from rankforge.operators.elo_replay import GROUP_VERDICTS
from rankforge.operators.elo_rules import EloParams

WORD = "18446744073709551616::uhugeint"


def _mix(h: str, round_number: str) -> str:
    """splitmix64 of hash and round, in 128-bit arithmetic modulo 2**64."""
    z = f"(({h}::uhugeint + ({round_number} + 1)::uhugeint * 11400714819323198485::uhugeint) % {WORD})::ubigint"
    for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931")):
        z = f"((xor({z}, ({z}) >> {shift})::uhugeint * {factor}::uhugeint) % {WORD})::ubigint"
    return f"xor({z}, ({z}) >> 31)"


def _hash(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::bigint"


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::double" for v in values) + "]"


def walk_ctes(numbers: str) -> str:
    """CTE ``walked``: column ``k``, where the permutation sends each row of ``numbers``, a CTE
    with id, number, size and key."""
    turns, (m1, m2), low = permutation.ROUNDS, permutation.FACTORS, permutation._BITS32
    h = f"(((case when j % 2 = 0 then r else c end) + key + j::bigint * {0x3C6EF372}) & {low})"
    return f"""
grid as materialized (
  select id, size, key, number, w, ceil(size / w)::bigint t
  from (select *, greatest(1, ceil(sqrt(size)))::bigint w from {numbers})),
walk as (
  select id, size, key, w, t, number % w c, number // w r, 0 j, false moved from grid
  union all
  select id, size, key, w, t, case when j % 2 = 0 then (c + h) % w else c end,
    case when j % 2 = 1 then (r + h) % t else r end, (j + 1) % {turns}, true
  from (select *, xor(h2, h2 >> 16) h from (
    select *, (xor(h1, h1 >> 16) * {m2}) & {low} h2 from (
      select *, (xor(h0, h0 >> 16) * {m1}) & {low} h1 from (
        select *, {h} h0 from walk where not moved or j > 0 or c + w * r >= size))))),
walked as materialized (
  select id, c + w * r k from walk where moved and j = 0 and c + w * r < size)"""


def drawn_ctes(source: str, by: str, rounds: int, num_pairs: str = "n // 2", seed: int = 42) -> str:
    """CTE ``drawn``: by, round, pair_in_round, response1_id, response2_id of items in ``source``."""
    keys = f"{by}, " if by else ""
    on = " and ".join(["true", *[f"x.{c.strip()} = d.{c.strip()}" for c in by.split(",") if c.strip()]])
    name = " || '_' || ".join([*[c.strip() for c in by.split(",") if c.strip()], "round", f"'{seed}'"])
    return f"""
numbered as materialized (
  select {keys}response_id, row_number() over ({'partition by ' + by if by else ''} order by response_id) - 1 i from {source}),
orders as materialized (
  select *, n * (n - 1) // 2 size, least({num_pairs}, n * (n - 1) // 2) m
  from (select {keys}count(*) n from numbered group by all), range({rounds}) t(round)),
draws as materialized (
  select {keys}round, d number, size, {_hash(name)} & {permutation._BITS32} key,
    row_number() over () id
  from (select *, unnest(range(m)) d from orders)),{walk_ctes("draws")},
picked as materialized (
  select {keys}round, number pair_in_round, k - hi * (hi - 1) // 2 lo, hi
  from (select *, case when g * (g - 1) // 2 > k then g - 1 when g * (g + 1) // 2 <= k then g + 1 else g end hi
    from (select *, floor((1 + sqrt(1 + 8 * k::double)) / 2)::bigint g from draws join walked using (id)))),
drawn as materialized (
  select d.* exclude (lo, hi), x.response_id response1_id, y.response_id response2_id
  from picked d join numbered x on {on} and x.i = d.lo join numbered y on {on.replace("x.", "y.")} and y.i = d.hi)"""


def replay_ctes(settings: list[EloParams], rounds: int, drawn: bool = False, record: bool = False) -> str:
    """With ``drawn`` the verdicts have a round and are played in it alone; with ``record`` there is
    also ``played``: every game with the ratings before it and its change (first setting).

    CTEs up to ``ended``: item, setting (1-based), response_id, norm_response, e1 .. e<rounds>,
    and ``sums``: item, setting, n and per round the summed change and the small changes."""
    many = len(settings)
    ks = ", ".join(_list(p.k_at(r) for p in settings) for r in range(rounds))
    zeros = _list([0.0] * many)
    each = f"range(1, {many + 1})"
    start = _list(p.initial for p in settings)
    last = ", ".join(f"{start} e{r}, {zeros} c{r}, {zeros} s{r}" for r in range(1, rounds + 1))

    def at(r: int, column: str, value: str) -> str:
        return f"case when round = {r - 1} then {value} else own.{column}{r} end"

    moved = "list_transform({each}, lambda i: own.elo[i] + sign * d[i])".format(each=each)
    kept = ", ".join(
        # ratings of a round stand for later ones too, until those are played
        f"case when round <= {r - 1} then {moved} else own.e{r} end, "
        + at(r, "c", f"list_transform({each}, lambda i: own.c{r}[i] + abs(d[i]))") + ", "
        + at(r, "s", f"list_transform({each}, lambda i: own.s{r}[i] + (abs(d[i]) < 1.0)::int * (sign = 1)::int)")
        for r in range(1, rounds + 1)
    )
    names = ", ".join(f"e{r}, c{r}, s{r}" for r in range(1, rounds + 1))
    spread = ", ".join(f"unnest(e{r}) e{r}, unnest(c{r}) c{r}, unnest(s{r}) s{r}" for r in range(1, rounds + 1))
    totals = ", ".join(f"sum(c{r}) c{r}, sum(s{r}) s{r}" for r in range(1, rounds + 1))
    mixed = _mix("h", "round")
    # the ratings of a player in the order of its games ride along as a list
    log = {"names": ", log", "start": ", [{start}[1]] log".format(start=start), "moved": ""}
    if record:
        log["moved"] = ", list_append(own.log, own.elo[1] + sign * d[1])"
    else:
        log = dict.fromkeys(log, "")
    history = """,
told as materialized (select item, player, unnest(log) elo, generate_subscripts(log, 1) nth from state),
played as materialized (
  select p.gid, p.item, p.a, p.b, p.s, p.k[1] k, x.elo old_a, y.elo old_b, z.elo - x.elo d
  from plays p join told x on x.item = p.item and x.player = p.a and x.nth = p.na
    join told y on y.item = p.item and y.player = p.b and y.nth = p.nb
    join told z on z.item = p.item and z.player = p.a and z.nth = p.na + 1)""" if record else ""
    return f"""
known as materialized (
  select v.dataset, v.item, response1_id a, response2_id b,
    case winner when 'A' then 1.0 when 'B' then 0.0 else 0.5 end::double s,
    {_hash("response1_id || '_' || response2_id || '_42'")} h,
    {_hash("response1_id || '_block'")} ha, {_hash("response2_id || '_block'")} hb{', v.round drawn' if drawn else ''}
  from {'judged' if drawn else 'verdicts'} v
  join items x on x.item = v.item and x.response_id = v.response1_id
  join items y on y.item = v.item and y.response_id = v.response2_id
  where response1_id <> response2_id),
sizes as materialized (
  select item, count(*) n, (2 * ceil(sqrt(count(*) / {float(GROUP_VERDICTS)!r})))::bigint nb from known group by 1),
met as materialized (
  select k.*, n, nb, least(ha % nb, hb % nb) lo, greatest(ha % nb, hb % nb) hi from known k join sizes using (item)),
games as materialized (
  select *, row_number() over (order by item, round, step, z, a, b, s) gid
  from (select item, a, b, s, round, {mixed} z, case when lo = hi then 0
      else 1 + (case when hi = nb - 1 then 2 * lo else lo + hi end) % greatest(nb - 1, 1) end step
    from met, range({rounds}) t(round){' where met.drawn = t.round' if drawn else ''})),
sides as materialized (
  select gid, item, player, row_number() over (partition by item, player order by gid) nth
  from (select gid, item, a player from games union all select gid, item, b from games)),
plays as materialized (
  select g.gid, g.item, g.round, g.a, g.b, g.s, x.nth na, y.nth nb, ([{ks}])[g.round + 1] k
  from games g join sides x on x.gid = g.gid and x.player = g.a join sides y on y.gid = g.gid and y.player = g.b),
state(item, player, done, elo, {names}{log['names']}) using key (item, player) as (
  select distinct item, player, 0::bigint done, {start} elo, {last}{log['start']} from sides
  union
  select own.item, own.player, own.done + 1, {moved}, {kept}{log['moved']}
  from (
    select p.*, sign, who, list_transform({each}, lambda i: p.k[i] * (p.s - 1.0::double
        / (1.0::double + pow(10.0::double, (b.elo[i] - a.elo[i]) / 400.0::double)))) d
    from (select distinct s.gid from state m join sides s
        on s.item = m.item and s.player = m.player and s.nth = m.done + 1) next
    join plays p using (gid)
    join recurring.state a on a.item = p.item and a.player = p.a and a.done = p.na - 1
    join recurring.state b on b.item = p.item and b.player = p.b and b.done = p.nb - 1,
    (select 1 sign, 'a' who union all select -1, 'b') both_sides) played
  join recurring.state own on own.item = played.item and own.player = case who when 'a' then played.a else played.b end),
spread as materialized (
  select item, player response_id, unnest({each}) setting, {spread} from state),
ended as materialized (
  select i.dataset, i.item, setting, i.response_id, i.norm_response, {', '.join(f'e{r}' for r in range(1, rounds + 1))}
  from spread s join items i using (item, response_id)),
sums as materialized (
  select item, setting, any_value(n) n, {totals} from spread join sizes using (item) group by 1, 2){history}"""


def sync_ctes(p: EloParams) -> str:
    """CTE ``rounds``: synchronous rounds of every group until a stop rule holds.

    One step of the recursion plays one round: the rows are the items of the groups still
    live, each with its group's rule state (best r, the round it came, the last r values).
    """
    k = f"greatest({p.k_start!r} - ({p.k_start!r} - {p.k_end!r}) * (t.round / {p.decay_rounds!r}), {p.k_end!r})"
    window = p.min_r_delta_rounds
    return f"""
sync(item, id, truth, elo, round, best, improved, hist, k, r, avg_change, pct_small, wa, wb, we, reason) as (
  select item, response_id, norm_response, {p.initial!r}::double, 0, '-infinity'::double, 0, []::double[], 0.0::double,
    null::double, null::double, null::double, 0::bigint, 0::bigint, 0::bigint, null::varchar
  from items where item in (select v.item from verdicts v)
  union all
  select m.item, m.id, m.truth, m.elo, m.round + 1, best, improved, hist, k, r, avg_change, pct_small, wa, wb, we,
    case when avg_change < 0.1 then 'avg_change<0.1' when pct_small > 0.95 then '95%_small'
      when m.round - improved >= {p.patience} then 'patience_{p.patience}'
      when len(hist) >= {window} and hist[-1] - hist[1] < {p.min_r_delta!r} then 'r_delta<{p.min_r_delta}_in_{window}r' end
  from (
    select t.item, t.id, t.truth, t.round, t.elo + coalesce(step, 0) elo, g.k, g.avg_change, g.pct_small, g.wa, g.wb, g.we,
      corr(t.truth, t.elo + coalesce(step, 0)) over w r,
      case when r > t.best then r else t.best end best, case when r > t.best then t.round else t.improved end improved,
      list_append(t.hist, r)[-{window}:] hist
    from (select * from sync where reason is null) t
    left join (
      select item, id, sum(d) / count(*) step from (
        select item, unnest([response1_id, response2_id]) id, unnest([d, -d]) d from PLAYED) group by 1, 2) c
      on c.item = t.item and c.id = t.id
    join (
      select item, any_value(k) k, sum(abs(d)) / count(*) avg_change, count(*) filter (abs(d) < 1)::double / count(*) pct_small,
        count(*) filter (winner = 'A') wa, count(*) filter (winner = 'B') wb, count(*) filter (winner = 'Equal') we
      from PLAYED group by 1) g on g.item = t.item
    window w as (partition by t.item)) m),
rounds as materialized (
  select distinct i.dataset, s.item, round, k, r, avg_change, pct_small, wa, wb, we, reason
  from sync s join (select distinct dataset, item from items) i using (item) where round > 0)""".replace(
        "PLAYED",
        f"""(
          select v.item, v.response1_id, v.response2_id, v.winner, {k} k,
            {k} * ((case winner when 'A' then 1.0 when 'B' then 0.0 else 0.5 end)::double
              - 1.0::double / (1.0::double + pow(10.0::double, (b.elo - t.elo) / 400.0::double))) d
          from verdicts v join (select * from sync where reason is null) t on t.item = v.item and t.id = v.response1_id
          join (select * from sync where reason is null) b on b.item = v.item and b.id = v.response2_id)""",
    )
