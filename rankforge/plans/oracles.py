"""The same queries as SQL for DuckDB, on the same tables.

Fragments are CTE bodies; ``sql(final, *names)`` puts the needed ones in front, in
order. Orders, draws and splits use md5, which both engines compute alike.
"""

from __future__ import annotations

from rankforge.operators.elo_rules import GRID_2D, EloParams, grid_params
from rankforge.operators.sweep import optimizer_base
from rankforge.plans.elo_oracles import drawn_ctes, replay_ctes, sync_ctes
from rankforge.plans.testbed import CHECKPOINTS

LABELS = ("A", "B", "Equal")


def uni(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::bigint::double / 4294967296.0::double)"


def labelled(source: str) -> str:
    """jrt shifted by abs(min), label min-max scaled, all other columns kept."""
    return f"""
      select s.* exclude (jrt), s.jrt + abs(m.lo) as jrt,
        case when (m.hi + abs(m.lo)) - (m.lo + abs(m.lo)) = 0 then 0.0::double
          else ((s.jrt + abs(m.lo)) - (m.lo + abs(m.lo)))
            / ((m.hi + abs(m.lo)) - (m.lo + abs(m.lo))) end as label
      from {source} s, (select min(jrt) lo, max(jrt) hi from {source}) m"""


WINNER = "case when a.label > b.label then 'A' when b.label > a.label then 'B' else 'Equal' end"


def paired(source: str, order: str, keys: str = "item task prompt", extra: str = "") -> str:
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split())
    cols = ", ".join(f"a.{k}" for k in keys.split())
    return f"""
      select {cols}, a.response response1, b.response response2, a.id response1_id,
        b.id response2_id, a.label norm_response1, b.label norm_response2, {WINNER} winner {extra}
      from {source} a join {source} b on {on} and {order}"""


def averaged(source: str) -> str:
    """Duplicates by (item, task, prompt, response) averaged."""
    digest = "md5(md5(item) || md5(task) || md5(prompt) || md5(response))"
    return f"""
      select item, task, prompt, response, avg(jrt) jrt,
        case when count(*) = 1 then min(id) else 'dupe_average:' || {digest} end id
      from {source} group by item, task, prompt, response"""


def graded(source: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    qs = ", ".join(
        f"quantile_cont(norm_diff, {q}) over ({part}) q{int(q * 100)}" for q in (0.25, 0.5, 0.75)
    )
    return f"""
      select *, 1.0::double - norm_diff difficulty_score,
        case when norm_diff >= q75 then 1 when norm_diff >= q50 then 2
          when norm_diff >= q25 then 3 else 4 end difficulty_level,
        case when norm_diff >= q75 then 'Easy' when norm_diff >= q50 then 'Medium-Easy'
          when norm_diff >= q25 then 'Medium-Hard' else 'Hard' end difficulty_category
      from (select *, {qs} from (select *, abs(norm_response1 - norm_response2) norm_diff
        from {source}))"""


SOFT = "exp({x} - greatest(logit_a, logit_b, logit_equal))"


def softmax(scale: str = "1.0") -> tuple[str, str, str]:
    top = f"greatest(logit_a / {scale}::double, logit_b / {scale}::double, logit_equal / {scale}::double)"
    parts = [f"exp({x} / {scale}::double - {top})" for x in ("logit_a", "logit_b", "logit_equal")]
    total = "(" + " + ".join(parts) + ")"
    return tuple(f"({p} / {total})" for p in parts)


def argmax(a: str, b: str, e: str) -> str:
    return f"case when {a} >= {b} and {a} >= {e} then 'A' when {b} >= {e} then 'B' else 'Equal' end"


def value_of(w: str, a: str, b: str, e: str) -> str:
    return f"case when {w} = 'A' then {a} when {w} = 'B' then {b} else {e} end"


def code(w: str) -> str:
    return f"case {w} when 'A' then 0 when 'B' then 1 when 'Equal' then 2 else -1 end"


FULL_LINE = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_split'"

CTE: dict[str, str] = {
    "orders_raw": """
      select o_orderkey::varchar id, o_orderpriority item, o_orderstatus task,
        strftime(o_orderdate, '%Y-%m') prompt, 'order ' || o_orderkey response, o_totalprice jrt
      from orders""",
    "events_raw": """
      select event_id::varchar id, event_id, event_type item, 'use' task, user_id::varchar prompt,
        'event ' || event_id response, floor(value / 20) * 20 jrt
      from events""",
    "dup_raw": """
      select event_id::varchar id, event_type item, 'day' task, strftime(ts, '%Y-%m-%d') prompt,
        user_id::varchar response, value jrt
      from events""",
    "docs_raw": """
      select d.doc_id::varchar id, d.doc_id, lang item, source task, 'doc' prompt, text response,
        quality::double jrt
      from documents d left join labels l on d.doc_id = l.doc_id""",
    "cust_raw": """
      select c_nationkey || '-' || c_custkey id, c_mktsegment item, c_nationkey::varchar prompt,
        c_name response, c_acctbal jrt
      from customer""",
    "orders_lab": labelled("orders_raw"),
    "events_lab": labelled("events_raw"),
    "dup_avg": averaged("dup_raw"),
    "dup_lab": labelled("dup_avg"),
    "orders_pairs": paired(
        "orders_lab", "(md5(a.id) < md5(b.id) or (md5(a.id) = md5(b.id) and a.id < b.id))"
    ),
    "events_pairs0": paired("events_lab", "a.event_id < b.event_id"),
    "events_pairs": f"""
      select * exclude (u), case when u < 0.6 then 'train' when u < 0.8 then 'val' else 'test' end split
      from (select *, {uni("prompt || '_split'")} u from events_pairs0)""",
    "orders_graded": graded("orders_pairs"),
    "events_graded": graded("events_pairs", "split"),
    "events_graded_all": graded("events_pairs"),
    "events_scored": """
      select *, z logit_a, -z logit_b,
        0.6::double - 12.0::double * abs(norm_response1 - norm_response2)
          + ((13 * ia + 7 * ib) % 97)::double / 97.0::double - 0.5::double logit_equal
      from (select *, 8.0::double * (norm_response1 - norm_response2)
          + (((31 * ia + 17 * ib) % 101)::double / 101.0::double - 0.5::double) z
        from (select *, response1_id::bigint ia, response2_id::bigint ib from events_pairs))""",
    "events_detail": """
      select *, case when winner = predicted_winner then 1 else 0 end correct,
        {value} confidence
      from (select *, {arg} predicted_winner from events_scored)""".format(
        arg=argmax("logit_a", "logit_b", "logit_equal"),
        value=value_of("predicted_winner", *softmax()),
    ),
    "verdicts": """
      select 'events' dataset, item, response1_id, response2_id, predicted_winner winner, confidence
      from events_detail""",
    "items": """
      select 'events' dataset, item, id response_id, prompt, task, response, label norm_response
      from events_lab
      where id in (select response1_id from events_pairs union select response2_id from events_pairs)""",
    "cells": "select split, count(*) n, "
    + ", ".join(
        f"count(*) filter (winner = '{t}' and predicted_winner = '{p}') n_{t}_{p}"
        for t in LABELS for p in LABELS
    )
    + " from events_detail group by split",
    "line_resp": f"""
      select l_orderkey || '-' || l_linenumber id, l_returnflag item, l_linestatus task,
        l_partkey::varchar prompt, l_suppkey::varchar response, l_quantity / 50.0::double as label,
        md5({FULL_LINE}) ord,
        case when {uni(FULL_LINE)} < 0.5 then 'train' when {uni(FULL_LINE)} < 0.75 then 'val'
          else 'test' end split
      from lineitem""",
    "line_pairs": paired("line_resp", "a.ord < b.ord", "item task prompt split"),
    "flags": """
      select id, bool_or(split = 'train') train, bool_or(split = 'val') val,
        bool_or(split = 'test') test
      from line_resp group by id""",
    "line_kept": """
      select p.* from line_pairs p
      where split = 'train'
        or (split = 'val' and not exists (select 1 from flags f
          where f.id in (p.response1_id, p.response2_id) and f.train and f.val))
        or (split = 'test' and not exists (select 1 from flags f
          where f.id in (p.response1_id, p.response2_id) and f.test and (f.train or f.val)))""",
}
# the "in" subqueries above are cheaper as two anti joins
CTE["blocked"] = """
      select id, 'val' split from flags where train and val
      union all select id, 'test' from flags where test and (train or val)"""
CTE["line_kept"] = """
      select p.* from line_pairs p
      anti join blocked b on b.id = p.response1_id and b.split = p.split
      anti join blocked c on c.id = p.response2_id and c.split = p.split"""

STRATA = "item, task, score_quartile"
CTE["orders_q"] = """
      select s.*, case when label <= q.a then 'Q1' when label <= q.b then 'Q2'
        when label <= q.c then 'Q3' else 'Q4' end score_quartile
      from orders_lab s, (select quantile_cont(label, 0.25) a, quantile_cont(label, 0.5) b,
        quantile_cont(label, 0.75) c from orders_lab) q"""


def remainder(source: str, count: str, share: str, out: str) -> str:
    return f"""
      select * exclude (base, rest, place), (base + case when place <= spare and base < {count}
          then 1 else 0 end)::bigint {out}
      from (select *, row_number() over (order by rest desc, {STRATA}) place,
          ceil((sum({count}) over ())::double * {share}) - sum(base) over () spare
        from (select *, floor({count} * {share}) base, {count} * {share} - floor({count} * {share}) rest
          from {source})) """


TRAIN, VAL = 0.55, 0.15
CTE["strata"] = f"select {STRATA}, count(*)::double n from orders_q group by all having count(*) > 1"
CTE["quota_t"] = (
    "select * exclude (spare), n - n_test lft from ("
    + remainder("strata", "n", f"({1 - TRAIN - VAL!r})::double", "n_test") + ")"
)
CTE["quota"] = remainder("quota_t", "lft", f"({VAL / (TRAIN + VAL)!r})::double", "n_val")
CTE["assigned"] = f"""
      select id, item, task, prompt, response, label, score_quartile,
        case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end split
      from (select *, row_number() over (partition by {STRATA} order by md5(id || '_42'), id) rn
        from orders_q) left join quota using ({STRATA})"""

for name, n in (("passes2", 2), ("passes3", 3), ("passes20", 20)):
    g, s = softmax(), softmax("0.7")
    CTE[name] = f"""
      select response1_id || '_' || response2_id source_row_index, winner true_winner, pass_index,
        case when pass_index = 0 then 'greedy' else 'stochastic' end pass_type,
        case when pass_index = 0 then top
          when u < pa then 'A' when u < pa + pb then 'B' else 'Equal' end pred_winner, pa, pb, pe
      from (select *, {uni("response1_id || '_' || response2_id || '_' || pass_index || '_42'")} u,
          case when pass_index = 0 then ga else sa end pa,
          case when pass_index = 0 then gb else sb end pb,
          case when pass_index = 0 then ge else se end pe
        from (select *, {g[0]} ga, {g[1]} gb, {g[2]} ge, {s[0]} sa, {s[1]} sb, {s[2]} se,
            {argmax("logit_a", "logit_b", "logit_equal")} top,
            unnest(generate_series(0, {n})) pass_index from events_scored))"""


def votes_of(source: str) -> str:
    counts = ", ".join(
        f"count(*) filter (pass_type = 'stochastic' and pred_winner = '{w}') votes_{w}" for w in LABELS
    )
    arg = argmax("votes_A", "votes_B", "votes_Equal")
    top = "greatest(votes_A, votes_B, votes_Equal)"
    return f"""
      select *, {arg} majority_winner,
        (votes_A = {top})::int + (votes_B = {top})::int + (votes_Equal = {top})::int > 1 is_tie,
        ({arg} = true_winner)::bigint majority_correct
      from (select source_row_index, min(true_winner) true_winner, {counts},
          count(*) filter (pass_type = 'greedy') g, count(*) filter (pass_type = 'stochastic') s,
          count(*) filter (pass_type = 'greedy' and pred_winner = true_winner) gh,
          count(*) filter (pass_type = 'stochastic' and pred_winner = true_winner) sh
        from {source} group by 1)"""


CTE["votes20"] = votes_of("passes20")
CTE["votes3"] = votes_of("passes3")

CTE["rating0"] = "select dataset, item, response_id, norm_response, 1500.0::double elo from items"
for r in (1, 2, 3):
    k = f"{max(32.0 - 30.0 * ((r - 1) / 30.0), 2.0)!r}::double"
    CTE[f"games{r}"] = f"""
      select v.*, {k} * ((case winner when 'A' then 1.0 when 'B' then 0.0 else 0.5 end)::double
          - 1.0::double / (1.0::double + pow(10.0::double, (b.elo - a.elo) / 400.0::double))) d
      from verdicts v
      join rating{r - 1} a on a.item = v.item and a.response_id = v.response1_id
      join rating{r - 1} b on b.item = v.item and b.response_id = v.response2_id"""
    CTE[f"rating{r}"] = f"""
      select p.dataset, p.item, p.response_id, p.norm_response, p.elo + coalesce(c.step, 0) elo
      from rating{r - 1} p left join (select item, id, sum(d) / count(*) step
        from (select item, response1_id id, d from games{r}
          union all select item, response2_id, -d from games{r}) group by 1, 2) c
      on c.item = p.item and c.id = p.response_id"""
CTE["rated"] = """
      select *, case when hi > lo then (elo - lo) / (hi - lo) else 0.0::double end elo_normalized
      from (select *, min(elo) over (partition by item) lo, max(elo) over (partition by item) hi
        from rating3)"""
CTE["quality"] = """
      select dataset, item, count(*) n, corr(norm_response, elo_normalized) pearson_r,
        1 - sum((norm_response - elo_normalized) ** 2)
          / (var_pop(norm_response) * count(*)) r_squared,
        avg(abs(norm_response - elo_normalized)) mae,
        sqrt(avg((norm_response - elo_normalized) ** 2)) rmse
      from rated group by 1, 2"""

_names = ", ".join(f"('{n}', {a!r}::double)" for n, a in CHECKPOINTS.items())
CTE["ckpt_all"] = f"""
      select doc_id, peft_model_id, case when {uni("doc_id || '_half'")} < 0.5
          then 'validation' else 'test' end split,
        case when {uni("doc_id || '_' || peft_model_id || '_hit'")} < acc then quality + toxic
          else floor({uni("doc_id || '_' || peft_model_id || '_miss'")} * 3)::int end predictions,
        quality + toxic ratings,
        try_cast(regexp_extract(peft_model_id, '^checkpoint-(\\d+)', 1) as bigint) steps
      from labels, (values {_names}) t(peft_model_id, acc)"""
CTE["ckpt"] = "select * from ckpt_all where steps between 30000 and 43752"
CTE["ckpt_m"] = """
      select peft_model_id, steps, split, avg((predictions = ratings)::int::double) accuracy,
        case when stddev_pop(predictions) > 0 and stddev_pop(ratings) > 0
          then corr(ratings::double, predictions::double) else 0.0::double end pearson
      from ckpt group by 1, 2, 3"""
CTE["ckpt_s"] = """
      select v.peft_model_id checkpoint, v.steps, v.accuracy val_accuracy, v.pearson val_pearson,
        t.accuracy test_accuracy, t.pearson test_pearson
      from ckpt_m v join ckpt_m t on v.peft_model_id = t.peft_model_id
        and v.split = 'validation' and t.split = 'test'"""

SLICE = "('0x' || substr(md5({x} || '_slice'), 1, 15))::bigint % 3"
CTE["live0"] = "select dataset, item, response_id, norm_response, 1500.0::double elo from items"
for r in (1, 2, 3):
    CTE[f"live{r}"] = f"""
      select p.dataset, p.item, p.response_id, p.norm_response, p.elo + coalesce(c.step, 0) elo
      from live{r - 1} p left join (select item, id, sum(d) / count(*) step
        from (select item, unnest([response1_id, response2_id]) id, unnest([d, -d]) d
          from (select v.*, {33 - r}.0::double * ((case winner when 'A' then 1.0 when 'B' then 0.0 else 0.5 end)::double
              - 1.0::double / (1.0::double + pow(10.0::double, (b.elo - a.elo) / 400.0::double))) d
            from verdicts v join live{r - 1} a on a.item = v.item and a.response_id = v.response1_id
              join live{r - 1} b on b.item = v.item and b.response_id = v.response2_id
            where {SLICE.format(x="response1_id")} = {r - 1})) group by 1, 2) c
      on c.item = p.item and c.id = p.response_id"""
_running = ", ".join(
    f"count(*) filter (winner = '{t}' and predicted_winner = '{p}') over w n_{t}_{p}" for t in LABELS for p in LABELS
)
CTE["running"] = f"""
      select split, row_number() over w n, {_running} from (
        select *, {SLICE.format(x="response1_id || '_' || response2_id")} slice from events_detail)
      window w as (partition by split order by slice, response1_id, response2_id)"""

NEEDS = {
    "live0": "items", "live1": "live0 verdicts", "live2": "live1", "live3": "live2", "running": "events_detail",
    "orders_lab": "orders_raw", "events_lab": "events_raw", "dup_avg": "dup_raw", "dup_lab": "dup_avg",
    "orders_pairs": "orders_lab", "events_pairs0": "events_lab", "events_pairs": "events_pairs0",
    "orders_graded": "orders_pairs", "events_graded": "events_pairs",
    "events_graded_all": "events_pairs", "events_scored": "events_pairs",
    "events_detail": "events_scored", "verdicts": "events_detail",
    "items": "events_lab events_pairs", "cells": "events_detail", "line_pairs": "line_resp",
    "flags": "line_resp", "blocked": "flags", "line_kept": "line_pairs blocked",
    "orders_q": "orders_lab", "strata": "orders_q", "quota_t": "strata", "quota": "quota_t",
    "assigned": "orders_q quota", "passes2": "events_scored", "passes3": "events_scored",
    "passes20": "events_scored", "votes20": "passes20", "votes3": "passes3", "rating0": "items",
    **{f"games{r}": f"verdicts rating{r - 1}" for r in (1, 2, 3)},
    **{f"rating{r}": f"games{r} rating{r - 1}" for r in (1, 2, 3)},
    "rated": "rating3", "quality": "rated", "ckpt": "ckpt_all", "ckpt_m": "ckpt", "ckpt_s": "ckpt_m",
}


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, "").split():
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{n} as materialized ({CTE[n]})" for n in order)
    return (f"with {ctes}\n" if ctes else "") + final


def recursive(ctes: str, final: str) -> str:
    """A query over verdicts and items with further, recursive CTEs."""
    return "with recursive " + sql("", "verdicts", "items").removeprefix("with ").rstrip() + "," + ctes + "\n" + final


def swept_sql() -> str:
    """The small grid after two rounds; the first two stop rules alone can end a run there."""
    settings = grid_params(GRID_2D, optimizer_base().with_(max_rounds=2))
    rows = ", ".join(
        f"({i + 1}, {p.k_start!r}::double, {p.k_end!r}::double, {p.decay_rounds!r}::double, {p.patience}::bigint)"
        for i, p in enumerate(settings)
    )
    why = "case when c{r} / (2 * n) < 0.1 then 'avg_change<0.1' when s{r} / n > 0.95 then '95%_small' end"
    return recursive(replay_ctes(settings, 2) + f""",
stops as (select item, setting, {why.format(r=1)} why1, {why.format(r=2)} why2 from sums),
kept as (
  select dataset, item, setting, response_id, norm_response, case when why1 is not null then e1 else e2 end elo,
    case when why1 is not null then 1 else 2 end::bigint rounds_to_converge, coalesce(why1, why2) converge_reason
  from ended join stops using (item, setting)),
scaled as (
  select *, case when hi > lo then (elo - lo) / (hi - lo) else 0.0::double end score
  from (select *, min(elo) over g lo, max(elo) over g hi from kept window g as (partition by item, setting)))""",
        f"""select dataset, item, k_start, k_end, decay_rounds, patience, rounds_to_converge, converge_reason,
        round(corr(norm_response, score), 6) pearson_r,
        round(1 - sum((norm_response - score) ** 2) / (var_pop(norm_response) * count(*)), 6) r_squared,
        round(avg(abs(norm_response - score)), 6) mae, round(sqrt(avg((norm_response - score) ** 2)), 6) rmse, count(*) n
      from scaled join (values {rows}) t(setting, k_start, k_end, decay_rounds, patience) using (setting)
      group by all""")


def random_rounds_sql(rounds: int) -> str:
    """Random pairs of three rounds, judged, and their ratings."""
    scored = CTE["events_scored"].replace("from events_pairs)", "from drawn_pairs)")
    return recursive(drawn_ctes("items", "dataset, item", rounds) + f""",
drawn_pairs as materialized (
  select d.*, a.norm_response norm_response1, b.norm_response norm_response2
  from drawn d join items a on a.item = d.item and a.response_id = d.response1_id
    join items b on b.item = d.item and b.response_id = d.response2_id),
drawn_scored as materialized ({scored}),
judged as materialized (
  select *, {argmax("logit_a", "logit_b", "logit_equal")} winner from drawn_scored),"""
        + replay_ctes([EloParams()], rounds, drawn=True),
        f"""select dataset, item, response_id, round(norm_response, 6) norm_response, round(e{rounds}, 6) elo
      from (select dataset, item, response_id, norm_response, coalesce(e{rounds}, 1500.0::double) e{rounds}
        from items left join ended using (dataset, item, response_id, norm_response))""")


def ratios_sql(val: float = 0.10, test: float = 0.20, tol: float = 1e-3, steps: int = 30) -> str:
    """The two nested bisections, one evaluation per step of a recursive query."""
    goals = (1 - val - test, val, test)

    def counted(rows: str) -> str:
        return f"list_sum(list_transform(h, lambda x: x.g * (({rows}) * (({rows}) - 1) // 2)::double))"

    a, b = "floor(x.n * train)::bigint", "floor(x.n * mid)::bigint"
    hit = " and ".join(f"abs(s[{i + 1}] / all_pairs - {g!r}::double) < {tol!r}" for i, g in enumerate(goals))
    return sql("", "orders_raw").replace("with ", "with recursive ", 1).rstrip() + f""",
hist as materialized (
  select list({{'n': n, 'g': g}} order by n) h from (select n, count(*)::double g
    from (select count(*) n from orders_raw group by item, task, prompt) group by 1)),
search as (
  select h, 1 o, 0 i, 0.4::double low, 0.85::double high, 0.05::double vlow, 0.25::double vhigh, false ended,
    null::double train, null::double mid, null::double[] s from hist
  union all
  select h, case when inner_end and not ended then o + 1 else o end, case when inner_end then 0 else i + 1 end,
    case when inner_end and not ended and less then train else low end,
    case when inner_end and not ended and not less then train else high end,
    case when inner_end then 0.05 when vless then mid else vlow end,
    case when inner_end then 0.25 when vless then vhigh else mid end, ended, train, mid, s
  from (select *, inner_end and (({hit}) or o = {steps}) ended, s[1] / all_pairs < {goals[0]!r}::double less
    from (select *, abs(s[2] / all_pairs - {val!r}::double) < {tol!r} or i + 1 = {steps} inner_end,
        s[2] / all_pairs < {val!r}::double vless
      from (select *, list_sum(s) all_pairs
        from (select *, [{counted(a)}, {counted(b)}, {counted(f"x.n - {a} - {b}")}] s
          from (select h, o, i, low, high, vlow, vhigh, (low + high) / 2 train, (vlow + vhigh) / 2 mid
            from search where not ended)))))),
solved as (select * from search where ended)
select s[1]::bigint train_pairs, s[2]::bigint val_pairs, s[3]::bigint test_pairs,
  round(s[1] / list_sum(s), 6) train_ratio, round(s[2] / list_sum(s), 6) val_ratio,
  round(s[3] / list_sum(s), 6) test_ratio, round(train, 6) response_train, round(mid, 6) response_val from solved"""


def p_values_sql() -> str:
    """p by Simpson's rule on the integral of cos(theta) ** (n - 3), which the beta integral is."""
    nodes, a = 2000, "((n - 2) / 2.0::double)"
    height = (
        f"list_sum(list_transform(range({nodes + 1}), lambda i: (case when i = 0 or i = {nodes} then 1 when i % 2 = 1 "
        f"then 4 else 2 end) * pow(cos(lo + i * (pi() / 2 - lo) / {nodes}), n - 3)))"
    )
    beta = f"exp(lgamma({a}) + lgamma(0.5) - lgamma({a} + 0.5))"
    return sql(f"""select dataset, prompt, n, round(r, 6) pearson_r,
        round(least(1, 2 / {beta} * {height} * (pi() / 2 - lo) / {3 * nodes}), 6) p_value
      from (select *, asin(least(1, abs(r))) lo from (
        select r.dataset, i.prompt, count(*) n, case when min(r.norm_response) < max(r.norm_response)
            and min(elo_normalized) < max(elo_normalized) then corr(r.norm_response, elo_normalized) end r
        from rated r join items i using (dataset, item, response_id) group by 1, 2))
      where n >= 3 and r is not null""", "rated", "items")


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) {name}"


PCT = "count(*) * 100.0::double / sum(count(*)) over ({w})"


def category_report(source: str, by: str = "") -> str:
    head, part = (f"{by}, ", f"partition by {by}") if by else ("", "")
    return f"""select {head}difficulty_category, count(*) n,
        round(avg((winner = 'Equal')::int::double) * 100, 6) equal_pct,
        round(count(*)::double / sum(count(*)) over ({part}) * 100, 6) pct
      from {source} group by {head}difficulty_category"""


def counted(column: str, source: str, name: str | None = None, kind: str = "bigint") -> str:
    name = name or column
    return f"""select ({column})::{kind} {name}, count(*) n,
        round(count(*)::double / sum(count(*)) over () * 100, 6) pct
      from {source} group by 1"""


PROGRESSIVE = "case when difficulty_level = 1 then 1 when difficulty_level in (2, 3) then 2 else 3 end"
GRADUAL = "case when difficulty_score <= 0.33::double then 1 when difficulty_score <= 0.67::double then 2 else 3 end"


def _f1(c: str) -> str:
    called = " + ".join(f"n_{t}_{c}" for t in LABELS)
    support = " + ".join(f"n_{c}_{p}" for p in LABELS)
    return f"(case when {called} + {support} > 0 then 2 * n_{c}_{c}::double / ({called} + {support}) else 0.0::double end)"


def _support(c: str) -> str:
    return "(" + " + ".join(f"n_{c}_{p}" for p in LABELS) + ")"


def _called(c: str) -> str:
    return "(" + " + ".join(f"n_{t}_{c}" for t in LABELS) + ")"


HITS = "(n_A_A + n_B_B + n_Equal_Equal)"
ALL_SUPPORT = "(" + " + ".join(_support(c) for c in LABELS) + ")"


def _class_rows() -> str:
    def prec(c):
        return f"(case when {_called(c)} > 0 then n_{c}_{c}::double / {_called(c)} else 0.0::double end)"

    def rec(c):
        return f"(case when {_support(c)} > 0 then n_{c}_{c}::double / {_support(c)} else 0.0::double end)"

    rows = [
        f"select split, '{c}' class, round({prec(c)}, 6) as precision, round({rec(c)}, 6) recall, "
        f"round({_f1(c)}, 6) f1, {_support(c)}::bigint support from cells"
        for c in LABELS
    ]
    macro = [f"round(({' + '.join(m(c) for c in LABELS)}) / 3, 6)" for m in (prec, rec, _f1)]
    weighted = [
        f"round(({' + '.join(f'{m(c)} * {_support(c)}' for c in LABELS)}) / {ALL_SUPPORT}, 6)"
        for m in (prec, rec, _f1)
    ]
    for name, m in (("macro avg", macro), ("weighted avg", weighted)):
        rows.append(
            f"select split, '{name}', {m[0]}, {m[1]}, {m[2]}, {ALL_SUPPORT}::bigint from cells"
        )
    return " union all ".join(rows)


def _instruction() -> str:
    return (
        "'Task: ' || task || chr(10) || 'Description: ' || prompt || chr(10) || chr(10) || "
        "'Response A: ' || response1 || chr(10) || 'Response B: ' || response2 || chr(10) || chr(10) || "
        "'Which response is more scientifically possible and provable with a hypothesis?'"
    )


PAIR_TEXT = "task || ': ' || prompt || chr(10) || 'A: ' || response1 || chr(10) || 'B: ' || response2"
N_EVENTS = "(select count(*) from events)"


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def put(name: str, final: str, *names: str) -> None:
        out[name] = sql(final, *names)

    put("dup_average", "select item, task, prompt, response, round(jrt, 6) jrt, id ID from dup_avg", "dup_avg")
    put("dup_rows", """select id ID, item, prompt, response from dup_raw
      qualify count(*) over (partition by item, task, prompt, response) > 1""", "dup_raw")
    out["doc_dedupe"] = sql(
        f"""select id ID, item, task, md5(task || ': ' || prompt || chr(10) || lower(response)) text_md5,
          length(response)::bigint n_chars, round(jrt, 6) jrt from ({averaged("docs_raw")})""",
        "docs_raw",
    )
    put("minmax_label", "select id ID, round(jrt, 6) jrt, round(label, 6) as label from orders_lab", "orders_lab")
    put("clean_events", """select id ID, item, prompt,
        md5('Q ' || task || ': ' || prompt || chr(10) || lower(response)) text_md5,
        round(jrt, 6) jrt, round(label, 6) as label from dup_lab""", "dup_lab")
    put("fitted_scaler", """select round(min(jrt) + abs(min(jrt)), 6) data_min,
        round(max(jrt) + abs(min(jrt)), 6) data_max from dup_avg""", "dup_avg")
    holdout = """select c.*, ((c.jrt + abs(m.lo)) - f.mn) / (f.mx - f.mn) as label
        from cust_raw c, (select min(jrt) lo from cust_raw) m,
          (select min(jrt) + abs(min(jrt)) mn, max(jrt) + abs(min(jrt)) mx from orders_raw) f"""
    put("holdout_label", f"""select id ID, item, prompt, prompt || chr(10) || lower(response) as text,
        round(label, 9) as label from ({holdout})""", "orders_raw", "cust_raw")
    hpairs = paired("hold", "(md5(a.id) < md5(b.id) or (md5(a.id) = md5(b.id) and a.id < b.id))",
                    "item prompt")
    out["holdout_difficulty"] = (
        sql("", "orders_raw", "cust_raw").rstrip() + f", hold as materialized ({holdout}), hp as ({hpairs})"
        + f"""select 'holdout' split, 'holdout' task, difficulty_category, count(*) n,
          round(count(*)::double / sum(count(*)) over () * 100, 6) pct
          from ({graded("hp")}) group by 3"""
    )
    pair_cols = "item, task, prompt, response1, response2, response1_id, response2_id, norm_response1, norm_response2, winner"
    put("pairs_events", f"select {pair_cols} from events_pairs", "events_pairs")
    put("pairs_orders", """select item, task, prompt, response1_id, response2_id,
        round(norm_response1, 9) norm_response1, round(norm_response2, 9) norm_response2, winner
        from orders_pairs""", "orders_pairs")
    put("group_sizes", "select item, task, prompt, count(*) n from orders_raw group by all", "orders_raw")
    put("size_histogram", """select n, count(*) as "groups" from (select count(*) n from orders_raw
        group by item, task, prompt) group by 1""", "orders_raw")
    put("difficulty_report", category_report("orders_graded"), "orders_graded")
    put("difficulty_by_split", category_report("events_graded", "split"), "events_graded")
    put("difficulty_pairs", """select response1_id, response2_id, split, round(norm_diff, 6) norm_diff,
        round(difficulty_score, 6) difficulty_score, difficulty_category,
        difficulty_level::bigint difficulty_level,
        difficulty_category || '_' || item || '_' || task stratify_key from events_graded""",
        "events_graded")
    put("norm_diff_stats", """select round(avg(d), 6) mean, round(quantile_cont(d, 0.5), 6) median,
        round(quantile_cont(d, 0.25), 6) q25, round(quantile_cont(d, 0.75), 6) q75
        from (select abs(norm_response1 - norm_response2) d from orders_pairs)""", "orders_pairs")
    put("winner_report", "select winner, count(*) n from events_pairs group by 1", "events_pairs")
    put("phases_progressive", counted(PROGRESSIVE, "orders_graded", "curriculum_phase"), "orders_graded")
    put("phases_gradual", counted(GRADUAL, "orders_graded", "curriculum_phase"), "orders_graded")
    put("phases_mixed", """select 1::bigint curriculum_phase,
        (case when difficulty_level = 1 then 3 else 1 end)::bigint phase1_weight,
        (case when difficulty_level <= 2 then 2 else 1 end)::bigint phase2_weight,
        1::bigint phase3_weight, count(*) n from orders_graded group by all""", "orders_graded")
    put("epoch_subset", f"""select e::bigint epoch, count(*) n
        from (select {PROGRESSIVE} p from orders_graded), generate_series(1, 10) t(e)
        where p <= case when e <= 4 then 1 when e <= 7 then 2 else 3 end group by 1""", "orders_graded")
    put("epoch_subset_gradual", """select item, count(*) n, round(max(difficulty_score), 6) top
        from events_graded_all
        where difficulty_score <= 0.6::double * (select max(difficulty_score) from events_graded_all)
        group by 1""", "events_graded_all")
    put("epoch_schedule", """select e::bigint epoch,
        (case when e <= 3 then 1 when e <= 6 then 2 else 3 end)::bigint phase, count(*) n,
        max(difficulty_level)::bigint top_level
        from orders_graded, generate_series(1, 10) t(e)
        where difficulty_level <= case when e <= 3 then 1 when e <= 6 then 2 else 4 end
        group by 1, 2""", "orders_graded")
    put("level_filter", counted("difficulty_level", "orders_graded where difficulty_level <= 2"), "orders_graded")
    put("score_quartile_report", "select item, task, score_quartile, count(*) n from orders_q group by all", "orders_q")
    put("split_assign", "select id ID, score_quartile, split from assigned", "assigned")
    put("split_report", counted("split", "assigned", kind="varchar"), "assigned")
    put("stratification_report", """select split, score_quartile, count(*) n,
        round(count(*)::double / sum(count(*)) over (partition by split) * 100, 6) pct
        from assigned group by 1, 2""", "assigned")
    put("pair_ratio_eval", """select a::bigint train_pairs, b::bigint val_pairs, c::bigint test_pairs,
        round(a / (a + b + c), 6) train_ratio, round(b / (a + b + c), 6) val_ratio,
        round(c / (a + b + c), 6) test_ratio
        from (select sum(x * (x - 1) // 2)::double a, sum(y * (y - 1) // 2)::double b,
            sum((n - x - y) * (n - x - y - 1) // 2)::double c
          from (select n, floor(n * 0.55::double)::bigint x, floor(n * 0.15::double)::bigint y
            from (select count(*) n from orders_raw group by item, task, prompt)))""", "orders_raw")
    key = "md5(response1_id || '_' || response2_id || '_42'), response1_id || '_' || response2_id"
    put("pair_sample", f"""select response1_id, response2_id, item, task, split
        from (select *, row_number() over (partition by split order by {key}) rs
          from (select *, row_number() over (partition by split, item, task order by {key}) rn
            from (select *, case when total <= budget then n when sn <= target then n
                else least(n, greatest(1, floor(target::double * (n::double / sn)))) end q
              from (select *, count(*) over (partition by split, item, task) n,
                  count(*) over (partition by split) sn, count(*) over () total,
                  case split when 'train' then floor(budget * 0.7::double)
                    when 'val' then floor(budget * 0.1::double)
                    else budget - floor(budget * 0.7::double) - floor(budget * 0.1::double) end target
                from (select *, {N_EVENTS} budget from events_pairs)))) where rn <= q)
        where rs <= case when total <= budget then total else target end or sn <= target""", "events_pairs")
    put("row_sample", """select id ID, item from orders_raw
        qualify row_number() over (order by md5(id || '_42'), id) <= (select count(*) from customer)""",
        "orders_raw")
    put("source_index", """select id ID, row_number() over (order by id::bigint) - 1 source_row_index
        from orders_raw""", "orders_raw")
    overlap = """count(*) filter (train) train_ids, count(*) filter (val) val_ids,
        count(*) filter (test) test_ids, count(*) filter (train and val) train_val_overlap,
        count(*) filter (train and test) train_test_overlap,
        count(*) filter (val and test) val_test_overlap"""
    put("overlap_report", f"select {overlap} from flags", "flags")
    put("leakage_report", f"""select o.*, b.v - a.v val_removed, b.t - a.t test_removed,
        f.tv final_train_val_overlap, f.tt final_train_test_overlap, f.vt final_val_test_overlap
        from (select {overlap} from flags) o,
          (select count(*) filter (split = 'val') v, count(*) filter (split = 'test') t from line_pairs) b,
          (select count(*) filter (split = 'val') v, count(*) filter (split = 'test') t from line_kept) a,
          (select count(*) filter (tr and va) tv, count(*) filter (tr and te) tt,
             count(*) filter (va and te) vt
           from (select id, bool_or(split = 'train') tr, bool_or(split = 'val') va,
               bool_or(split = 'test') te
             from (select response1_id id, split from line_kept
               union all select response2_id, split from line_kept) group by id)) f""",
        "line_pairs", "line_kept", "flags")
    put("leakage_removed", """select item, task, split, winner, count(*) n, min(response1_id) first_id
        from line_kept group by 1, 2, 3, 4""", "line_kept")
    apairs = paired("assigned", "(md5(a.id) < md5(b.id) or (md5(a.id) = md5(b.id) and a.id < b.id))",
                    "item task prompt split")
    out["pair_dataset"] = (
        sql("", "assigned").rstrip() + f", ap as materialized ({apairs})"
        + f"""select split, difficulty_category,
          (case when split = 'train' then {PROGRESSIVE} end)::bigint curriculum_phase, count(*) n,
          min(response1) first_response, max(response2) last_response
          from ({graded("ap", "split")}) group by 1, 2, 3"""
    )
    dp = paired("dl", "a.doc_id < b.doc_id")
    out["prompt_text"] = (
        sql("", "docs_raw").rstrip() + ", dl as materialized (select *, coalesce(jrt, 0) as label from docs_raw)"
        + f"""select response1_id, response2_id, md5({PAIR_TEXT}) prompt_md5,
          length({PAIR_TEXT})::bigint n_chars from ({dp})"""
    )
    put("item_prompt_text", f"select response1_id, response2_id, {PAIR_TEXT} prompt_text from events_pairs", "events_pairs")
    put("training_set", f"""select split, response1_id, response2_id, md5({_instruction()}) text_md5,
        ({code('winner')})::bigint as label from events_graded where difficulty_level <= 2""", "events_graded")
    put("training_rows", f"""select response1_id, response2_id, {PAIR_TEXT} as text,
        ({code('winner')})::bigint as label from events_graded
        qualify row_number() over (order by {key}) <= {N_EVENTS}""", "events_graded")
    put("instruction_text", f"select response1_id, response2_id, md5({_instruction()}) md5 from events_pairs", "events_pairs")
    out["verdict_parse"] = """
      select event_id, coalesce(json_extract_string(j, '$.winner'), 'Equal') winner,
        round(coalesce(json_extract_string(j, '$.confidence')::double, 0.0), 6) confidence
      from (select event_id, regexp_extract(raw, '\\{.*\\}') j
        from (select event_id, case event_type when 'click' then body
            when 'view' then 'My verdict: ' || body || ' as asked' when 'error' then 'no verdict'
            else props end raw
          from (select *, '{"winner": "' || case when value > 50 then 'A' else 'B' end
              || '", "confidence": 0.' || json_extract_string(props, '$.k') || '}' body from events)))
      where j <> ''"""
    put("verdict_detail", """select response1_id, response2_id, winner, predicted_winner,
        round(confidence, 6) confidence, correct::bigint correct from events_detail""", "events_detail")
    rest = "(1.0::double - confidence) / 2"
    probs = ", ".join(
        f"round(case when winner = '{w}' then confidence else {rest} end, 6) prob_{w}" for w in LABELS
    )
    put("verdict_probs", f"select response1_id, response2_id, {probs} from verdicts", "verdicts")
    put("classification_summary", f"""select split, n n_samples, round({HITS}::double / n, 6) accuracy,
        round(({' + '.join(_f1(c) for c in LABELS)}) / 3, 6) f1_macro,
        round(({' + '.join(f'{_f1(c)} * {_support(c)}' for c in LABELS)}) / {ALL_SUPPORT}, 6) f1_weighted,
        {', '.join(f'round({_f1(c)}, 6) f1_{c}' for c in LABELS)}, {HITS}::bigint n_correct,
        {', '.join(f'{_called(c)}::bigint predicted_{c}' for c in LABELS)},
        {', '.join(f'{_support(c)}::bigint true_{c}' for c in LABELS)} from cells""", "cells")
    put("confusion", " union all ".join(
        f"select split, '{t}' true_winner, '{p}' predicted_winner, n_{t}_{p} n from cells"
        for t in LABELS for p in LABELS), "cells")
    put("class_report", _class_rows(), "cells")
    run = ", ".join(
        f"(sum(count(*) filter (winner = '{t}' and predicted_winner = '{p}')) over w)::bigint n_{t}_{p}"
        for t in LABELS for p in LABELS
    )
    put("running_metrics", f"""select split, bucket, (sum(count(*)) over w)::bigint processed, {run},
        round((sum(sum(correct)) over w)::double / (sum(count(*)) over w)::double, 6) accuracy
        from (select *, ((row_number() over (partition by split order by ia, ib) - 1) // 500)::bigint bucket
          from events_detail)
        group by split, bucket window w as (partition by split order by bucket)""", "events_detail")
    put("label_metrics", f"""select split, count(*) n, round(avg(correct::double), 6) accuracy,
        round(coalesce(corr(({code('winner')})::double, ({code('predicted_winner')})::double), 0), 6) pearson
        from events_detail group by 1""", "events_detail")
    put("label_codes", f"""select ({code('winner')})::bigint true_id,
        ({code('predicted_winner')})::bigint pred_id, count(*) n from events_detail group by 1, 2""",
        "events_detail")
    put("verdict_python_scorer", f"""select response1_id, response2_id,
        case when fails then 'Equal' else {argmax("logit_a", "logit_b", "logit_equal")} end predicted_winner,
        case when fails then 0.0::double else round({value_of(argmax("logit_a", "logit_b", "logit_equal"), *softmax())}, 6)
          end confidence
      from (select *, z logit_a, -z logit_b,
          ((13 * ia + 7 * ib) % 89)::double / 89.0::double - 0.6::double logit_equal, (7 * ia + ib) % 97 = 0 fails
        from (select *, ((31 * ia + 17 * ib) % 101)::double / 101.0::double - 0.5::double z
          from (select *, response1_id::bigint ia, response2_id::bigint ib from events_pairs)))""", "events_pairs")
    put("pending_verdicts", """select response1_id, response2_id, item from verdicts
        where confidence < 0.6""", "verdicts")
    put("completeness", """select count(*) pairs, count(*) filter (confidence >= 0.6) judged,
        count(*) filter (confidence < 0.6) pending from verdicts""", "verdicts")
    put("passes_table", f"""select source_row_index, true_winner,
        ({code('true_winner')})::bigint true_label_id, pass_type, pass_index::bigint pass_index,
        (case when pass_index = 0 then 1.0 else 0.7 end)::double temperature, round(pa, 6) prob_A,
        round(pb, 6) prob_B, round(pe, 6) prob_Equal, ({code('pred_winner')})::bigint pred_label_id,
        pred_winner, round({value_of('pred_winner', 'pa', 'pb', 'pe')}, 6) confidence,
        pred_winner = true_winner is_correct from passes2""", "passes2")
    put("pass_accuracy", """select pass_type, pass_index::bigint pass_index, count(*) n,
        round(avg((pred_winner = true_winner)::int::double), 6) accuracy from passes20
        group by 1, 2""", "passes20")
    put("majority_vote", """select source_row_index, true_winner, votes_A, votes_B, votes_Equal,
        majority_winner, is_tie, majority_correct from votes20""", "votes20")
    put("pass_summary", """select count(*) total_samples, sum(g + s)::bigint total_rows,
        sum(g)::bigint greedy_rows, sum(s)::bigint stochastic_rows,
        round(sum(gh)::double / sum(g)::double, 6) greedy_accuracy,
        round(sum(sh)::double / sum(s)::double, 6) stochastic_accuracy,
        round(avg(majority_correct), 6) majority_accuracy, round(avg(is_tie::int), 6) tie_rate,
        count(*) filter (s = 0) samples_without_votes, 0::bigint truth_conflicts,
        case when min(s) = max(s) then min(s) end inferred_stochastic_passes,
        (count(*) * (case when min(s) = max(s) then min(s) end + 1))::bigint expected_rows,
        count(*) filter (g > 1) samples_with_extra_greedy from votes20""", "votes20")
    put("pass_checks", """select count(*) as "rows",
        count(*) filter (not (isfinite(pa) and isfinite(pb) and isfinite(pe))) not_finite,
        count(*) filter (abs(pa + pb + pe - 1) > 1e-3) drifting,
        round(max(abs(pa + pb + pe - 1)), 6) max_drift from passes20""", "passes20")
    put("items_from_pairs", "select item, response_id, prompt, response, norm_response from items", "items")
    put("resolved_verdicts", """select count(*) verdicts, count(*) filter (a.response_id is null
        or b.response_id is null) dropped from verdicts v
        left join items a on a.item = v.item and a.response_id = v.response1_id
        left join items b on b.item = v.item and b.response_id = v.response2_id""", "verdicts", "items")
    put("elo_sync_3rounds", """select dataset, item, response_id, round(norm_response, 6) norm_response,
        round(elo, 6) elo, round(elo_normalized, 6) elo_normalized from rated""", "rated")
    history = " union all ".join(
        f"""select s.dataset, s.item, {r}::bigint as round, round({32 - (r - 1)}.0::double, 6) k,
          round(p.r, 6) pearson_r, round(s.c / s.n, 6) avg_change, round(s.sm::double / s.n, 6) pct_small,
          s.wa "A", s.wb "B", s.we "Equal"
          from (select dataset, item, count(*) n, sum(abs(d)) c, count(*) filter (abs(d) < 1) sm,
              count(*) filter (winner = 'A') wa, count(*) filter (winner = 'B') wb,
              count(*) filter (winner = 'Equal') we from games{r} group by 1, 2) s
          join (select item, corr(norm_response, elo) r from rating{r} group by 1) p using (item)"""
        for r in (1, 2, 3)
    )
    put("elo_sync_history", history, "rating3")
    out["elo_sync_converged"] = recursive(sync_ctes(EloParams()), """select dataset, item, round::bigint as round,
        round(k, 6) k, round(r, 6) pearson_r, round(avg_change, 6) avg_change, wa "A", wb "B", we "Equal", reason converge_reason from rounds""")
    out["elo_replay_2rounds"] = recursive(replay_ctes([EloParams()], 2), """select dataset, item, response_id,
        round(norm_response, 6) norm_response, round(e2, 6) elo,
        round((e2 - min(e2) over g) / (max(e2) over g - min(e2) over g), 6) elo_normalized
        from ended window g as (partition by item)""")
    out["elo_large_groups"] = out["elo_replay_2rounds"]
    out["elo_summary_2rounds"] = recursive(replay_ctes([EloParams()], 2) + """,
scaled as (
  select *, (e2 - min(e2) over g) / (max(e2) over g - min(e2) over g) score
  from ended window g as (partition by item))""", """select dataset, item, 2::bigint rounds, count(*) n_items,
        any_value(v.n_pairs) n_pairs, count(*) n, round(corr(norm_response, score), 6) pearson_r,
        round(1 - sum((norm_response - score) ** 2) / (var_pop(norm_response) * count(*)), 6) r_squared,
        round(avg(abs(norm_response - score)), 6) mae, round(sqrt(avg((norm_response - score) ** 2)), 6) rmse,
        -- thousands of items and a strong r: the tail is below the sixth digit
        0.0::double p_value
      from scaled join (select item, count(*) n_pairs from verdicts group by 1) v using (item) group by 1, 2""")
    out["elo_comparisons"] = recursive(replay_ctes([EloParams()], 1, record=True), """select i.dataset, item,
        row_number() over (partition by item order by gid) - 1 pair_in_round, a response1_id, b response2_id,
        case s when 1.0 then 'A' when 0.0 then 'B' else 'Equal' end winner, round(k, 6) k, round(old_a, 6) old_a,
        round(old_b, 6) old_b, round(old_a + d, 6) new_a, round(old_b - d, 6) new_b
        from played join (select distinct dataset, item from items) i using (item)""")
    out["elo_sweep_2rounds"] = swept_sql()
    out["elo_random_rounds"] = random_rounds_sql(3)
    loose = "select item || '|' || response_id response_id from items"
    out["random_pairs"] = recursive(
        f"\nloose as materialized ({loose})," + drawn_ctes("loose", "", 1, "(select count(*) from events)"),
        "select round::bigint as round, pair_in_round, response1_id, response2_id from drawn",
    )
    put("rating_metrics", """select dataset, item, n, round(pearson_r, 6) pearson_r,
        round(r_squared, 6) r_squared, round(mae, 6) mae, round(rmse, 6) rmse from quality""", "quality")
    out["rating_p_values"] = p_values_sql()
    out["response_ratios"] = ratios_sql()
    put("dataset_averages", """select dataset, round(avg(pearson_r), 6) pearson_r,
        round(avg(r_squared), 6) r_squared, round(avg(mae), 6) mae, round(avg(rmse), 6) rmse,
        sum(n)::bigint n_items, (select count(*) from verdicts) n_pairs from quality group by 1""",
        "quality", "verdicts")
    put("top_bottom", """select dataset, item, side, place, response_id, elo from (
        select dataset, item, 'top' side, response_id, elo,
          row_number() over (partition by item order by elo desc, response_id) place from r4
        union all select dataset, item, 'bottom', response_id, elo,
          row_number() over (partition by item order by elo, response_id) from r4) where place <= 10""",
        "rated")
    out["top_bottom"] = out["top_bottom"].replace(
        "\nselect dataset, item, side", ",\nr4 as (select dataset, item, response_id, round(elo, 4) elo from rated)\nselect dataset, item, side", 1
    ) if "\nselect dataset, item, side" in out["top_bottom"] else out["top_bottom"]
    put("checkpoint_registry", "select distinct peft_model_id, steps from ckpt", "ckpt")
    put("checkpoint_predictions", """select c.peft_model_id, c.steps, c.split, doc_id,
        predictions::bigint predictions, ratings::bigint ratings, round(accuracy, 6) accuracy,
        round(pearson, 6) pearson from ckpt c join ckpt_m m using (peft_model_id, steps, split)""",
        "ckpt", "ckpt_m")
    summary = """select checkpoint, steps, round(val_accuracy, 6) val_accuracy,
        round(val_pearson, 6) val_pearson, round(test_accuracy, 6) test_accuracy,
        round(test_pearson, 6) test_pearson from ckpt_s"""
    put("checkpoint_summary", summary, "ckpt_s")
    put("best_checkpoint", f"{summary} order by ckpt_s.val_accuracy desc, steps limit 1", "ckpt_s")
    put("csv_roundtrip", """select id ID, item, task, md5(response) text_md5,
        length(response)::bigint n_chars, jrt from docs_raw""", "docs_raw")
    put("csv_first_rows", """select id ID, md5(response) text_md5 from docs_raw
        order by doc_id limit 100""", "docs_raw")
    put("json_report", category_report("events_graded_all"), "events_graded_all")
    out["json_report"] = f"select difficulty_category, n, pct from ({out['json_report']})"
    out["latest_written"] = "select r_regionkey::bigint r_regionkey, r_name from region"
    put("holdout_kept_label", """select id ID, item, prompt, prompt || chr(10) || lower(response) as text,
        round(jrt / 1000, 9) as label from cust_raw where jrt is not null""", "cust_raw")
    put("passes_stamp", """select count(*) n, 1::bigint run_ids, 1::bigint times, true id_of_time, true recent
        from passes2""", "passes2")
    put("dataset_union", """select 'orders' dataset, count(*) n, count(task) with_task,
        round(avg(jrt), 6) mean_score from orders_raw
      union all select 'events', count(*), count(task), round(avg(jrt), 6) from events_raw
      union all select 'customer', count(*), 0, round(avg(jrt), 6) from cust_raw""",
        "orders_raw", "events_raw", "cust_raw")
    put("partition_refresh", """select 'orders' dataset, item, count(*) n, round(avg(jrt), 6) mean_score
        from orders_raw group by item
      union all select 'events', item, count(*), round(avg(jrt), 6) from dup_raw group by item""",
        "orders_raw", "dup_raw")
    out["checked_write"] = """select count(*) n, count(distinct o_orderkey) ids, true has_latest from orders"""
    put("verdict_cache", "select item, winner, count(*) n from verdicts group by 1, 2", "verdicts")
    out["verdict_cache_bucketed"] = out["verdict_cache"]
    rated = {
        "events": f"select 'events' dataset, item, label t, 0.5 * label + 0.5 * {uni("id || '_new'")} p from events_lab",
        "orders": f"select 'orders' dataset, item, label t, 0.3 * label + 0.7 * {uni("id || '_old'")} p from orders_lab",
    }
    quality = """count(*) n, round(corr(t, p), 6) pearson_r,
        round(1 - avg((t - p) ** 2) / var_pop(t), 6) r_squared, round(avg(abs(t - p)), 6) mae,
        round(sqrt(avg((t - p) ** 2)), 6) rmse"""
    both = " union all ".join(rated.values())
    put("refreshed_summary", f"""select dataset, item, {quality} from ({both}) group by 1, 2
      union all select dataset, '(all)', {quality} from ({both}) group by 1""", "events_lab", "orders_lab")
    put("stream_resume", """select split, winner, predicted_winner, count(*) n from events_detail
        group by 1, 2, 3""", "events_detail")
    put("stream_metrics", f"""select split, n n_samples, round({HITS}::double / n, 6) accuracy,
        round(({' + '.join(_f1(c) for c in LABELS)}) / 3, 6) f1_macro from cells""", "cells")
    put("stream_running_metrics", f"""select split, n n_samples, round({HITS}::double / n, 6) accuracy,
        round(({' + '.join(_f1(c) for c in LABELS)}) / 3, 6) f1_macro, ({HITS})::bigint n_correct
        from running where n % 500 = 0""", "running")
    put("stream_ratings", """select dataset, item, response_id, round(norm_response, 6) norm_response,
        round(elo, 6) elo from live3""", "live3")
    put("stream_votes", """select source_row_index, true_winner, votes_A, votes_B, votes_Equal
        from votes3""", "votes3")
    return out
