"""Exposure and outcome queries on the bindings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalis.operators import exposure as ex
from thermalis.plans import bindings as b
from thermalis.plans.index_queries import POSTS
from thermalis.plans.rounding import rounded
from thermalis.sources import rds
from thermalis.sources.scratch import fresh_folder
from thermalis.sources.workbook import register

#: Perception threshold and classes that suit the bound panel.
PERCEPTION, CLASSES = 50.0, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "none"]


def _rows(s, d, mode="warm"):
    return ex.exposures(b.panel(s, d), mode, perception=PERCEPTION)


def heat_exposure(s, d):
    return _rows(s, d, "all").groupBy("city", "warm_season", "heatday", "percep", "comb_exp").agg(F.count("*").alias("n"), F.sum("count").alias("events"))


def joint_exposure_counts(s, d):
    return ex.joint_counts(_rows(s, d, "all"))


def panel_from_rds(s, d):
    """Days in each joint level of a panel that was written in R's serialised form and read back."""
    rds.register(s)
    panel, folder = b.panel(s, d), fresh_folder(s, "panel")
    panel.write.format("rds").mode("append").save(folder)
    back = s.read.format("rds").schema(panel.schema).load(folder)
    return ex.joint_counts(ex.exposures(back, "all", perception=PERCEPTION))


def lag_basis(s, d):
    rows = ex.lag_basis(_rows(s, d))
    return rows.groupBy("city", "class").agg(*(F.sum(c).alias(c) for c in ("cb_temp", "cb_perc", "cb2", "cb3", "cb4")), F.count("cb_temp").alias("usable"))


def _models(s, d):
    """Stand-ins for fitted metrics, exact in SQL: sums per series."""
    rows = _rows(s, d, "all").groupBy(*ex.SERIES).agg(F.sum("count").alias("n"), F.sum("heatday").alias("h"), F.sum("percep").alias("p"))
    return rows.select(*ex.SERIES, (F.col("n") * 1.0).alias("qaic_temp"), (F.col("n") + F.col("h") % 7 - 3.0).alias("qaic_perc"), (F.col("h") % 11 / 100.0).alias("r2_temp"), (F.col("p") % 13 / 100.0).alias("r2_perc"), (F.col("n") % 17 != 0).alias("converged_temp"), F.lit(True).alias("converged_perc"))


def _grid(s, d):
    return ex.winner_grid(ex.classify_winners(_models(s, d)), CLASSES)


def winner_grid(s, d):
    return _grid(s, d)


def winner_workbook(s, d):
    """The winner grid, written as workbooks and read back."""
    register(s)
    grid, folder = _grid(s, d), fresh_folder(s, "winners")
    grid.write.format("workbook").mode("append").save(folder)
    return s.read.format("workbook").schema(grid.schema).load(folder)


def winner_long(s, d):
    return rounded(ex.winner_long(_grid(s, d)))


def supplement_bars(s, d):
    """The winner grid's shares as a figure shows them; two classes under names that figures know."""
    known = ex.recoded(F.col("class"), {"MACHINERY": "male", "BUILDING": "all-cause"})
    out = ex.supplement_bars(_grid(s, d).withColumn("class", known))
    return rounded(out.withColumn("outcome", F.regexp_replace("outcome", "\n", " ")))


def excluded_city(s, d):
    """Exposure levels without one city, whose rows take no part in any quantile either."""
    rows = ex.exposures(b.panel(s, d), "all", perception=PERCEPTION, excluded="NATION_3")
    return rows.groupBy("city", "comb_exp").agg(F.count("*").alias("n"))


def winrate_rollup(s, d):
    return rounded(ex.win_rates(_grid(s, d)))


def winrate_annotation(s, d):
    return rounded(ex.win_summary(ex.win_rates(_grid(s, d))))


def _effects(s, d, unit="type"):
    """Relative risks with intervals from simple shares, exact in SQL."""
    rows = b.panel(s, d).groupBy(unit, "class").agg(F.avg("heatPerception").alias("m"), F.sum("count").alias("n"))
    return rows.select(unit, "class", F.exp(F.col("m") / 100 - 0.3).alias("rr"), F.exp(F.col("m") / 100 - 0.3 - 20 / F.sqrt("n")).alias("rrlow"), F.exp(F.col("m") / 100 - 0.3 + 20 / F.sqrt("n")).alias("rrhigh"))


def ivw_pool(s, d):
    return rounded(ex.inverse_variance_pool(_effects(s, d), ["class"]))


def truncated_effects(s, d):
    return rounded(ex.truncate(_effects(s, d), 1.25))


def figure5_rows(s, d):
    """Rows of every city, pooled by type and combined; three classes stand for the cases 2 to 4."""
    case = F.when(F.col("class") == "MACHINERY", ex.CASES[1]).when(F.col("class") == "AUTOMOBILE", ex.CASES[2]).when(F.col("class") == "BUILDING", ex.CASES[3])
    pooled = _effects(s, d).withColumn("case", case).where("case is not null").drop("class")
    city = _effects(s, d, "city").withColumn("case", case).where("case is not null")
    names = sorted(r[0] for r in b.read(s, d, "nation").select("n_name").collect())  # 25 at every scale
    places = {name: 10.0 + k for k, name in enumerate(names)}
    return rounded(ex.forest_rows(city, pooled, places | {"Pooled: Death": 6.5, "Pooled: Hospitlization": 2.0, "Combined": 0.5}))


def glm_model_comparison(s, d):
    return rounded(ex.classify_winners(ex.compare_models(ex.lag_basis(_rows(s, d)))), 4)


def joint_rr(s, d):
    return rounded(ex.joint_rr(ex.joint_effects(ex.lag_basis(_rows(s, d, "all")))), 4)


def meta_pooled_rr(s, d):
    return rounded(ex.pooled_rr(ex.pool_effects(ex.joint_effects(ex.lag_basis(_rows(s, d, "all"))))), 4)


QUERIES = {f.__name__: f for f in (heat_exposure, joint_exposure_counts, panel_from_rds, lag_basis, winner_grid, winner_workbook, winner_long, supplement_bars, excluded_city, winrate_rollup, winrate_annotation, ivw_pool, truncated_effects, figure5_rows, glm_model_comparison, joint_rr, meta_pooled_rr)}

PANEL = (
    POSTS
    + """, dd as (select city, date, avg(price) as price, avg(indicator) as share, avg(balance) as balance, min(continent) as continent from posts group by all),
panel as (select p.city as country, p.city, p.date, p.segment as class, case when dd.continent < 'AM' then 'Death' when dd.continent < 'E' then 'Hospitlization' else 'Emergency department visit' end as type,
  dd.price / 1e4 as temp, 100 * dd.share as hp, month(p.date)::int as month, p.n as count from (select city, date, segment, count(*) as n from posts group by all) p join dd on p.city = dd.city and p.date = dd.date),
cut as (select city, quantile_cont(temp, 0.95) as q from panel group by city),
ex as (select panel.*, (not (month between 5 and 9))::int as warm_season, (temp > q)::int as heatday, (hp >= 50)::int as percep, 1 + (hp >= 50)::int + 2 * (temp > q)::int as comb_exp from panel join cut on panel.city = cut.city)"""
)
GRID = (
    PANEL
    + f""", mm as (select country, city, type, class, sum(count) as n, sum(heatday) as h, sum(percep) as p from ex group by all),
dl as (select *, n - (n + h % 7 - 3.0) as dq, h % 11 / 100.0::double - p % 13 / 100.0::double as dr from mm where n % 17 <> 0),
win as (select *, case when abs(dq) <= 2 then 'S' when dq > 2 then 'P' else 'T' end || '-' || case when abs(dr) <= 0.02 then 'S' when dr > 0.02 then 'T' else 'P' end as w from dl),
grid as (select t.type, c.class, nullif(count(w.w), 0) as city_num, {", ".join(f'''count(*) filter (where w.w = '{x}') as "{x}"''' for x in ex.WINNERS)}
  from (select distinct type from win) t cross join (select unnest([{", ".join(f"'{c}'" for c in CLASSES)}]) as class) c left join win w on w.type = t.type and w.class = c.class group by t.type, c.class)"""
)
LONG = " union all ".join(f"""select type, class, city_num, '{x}' as winner, "{x}" as n from grid""" for x in ex.WINNERS)
_S = {x: f'''sum("{x}")''' for x in ex.WINNERS}
_F = {
    "P_QAIC_only": f"{_S['P-S']} + {_S['P-T']}", "P_R2_only": _S["S-P"], "P_both": _S["P-P"], "P_either": f"{_S['P-S']} + {_S['P-T']} + {_S['S-P']} + {_S['P-P']}",
    "T_QAIC_only": f"{_S['T-S']} + {_S['T-P']}", "T_R2_only": _S["S-T"], "T_both": _S["T-T"], "T_either": f"{_S['T-S']} + {_S['T-P']} + {_S['S-T']} + {_S['T-T']}", "S_both": _S["S-S"],
}
RATES = f", rates as (select type, sum(city_num)::bigint as n_pairs, {', '.join(f'({v})::bigint as n_{k}' for k, v in _F.items())}, {', '.join(f'100.0 * ({v}) / sum(city_num)::double as pct_{k}' for k, v in _F.items())} from grid group by type)"
EFFECTS = PANEL + ", eff as (select type, class, exp(m / 100 - 0.3) as rr, exp(m / 100 - 0.3 - 20 / sqrt(n)) as rrlow, exp(m / 100 - 0.3 + 20 / sqrt(n)) as rrhigh from (select type, class, avg(hp) as m, sum(count) as n from panel group by all))"
_LAG = lambda c: f"({c} + lag({c}, 1) over s + lag({c}, 2) over s)"
_W = "(1 / pow((ln(rrhigh) - ln(rrlow)) / 3.92, 2))"

ORACLE_SQL = {
    "heat_exposure": f"with {PANEL} select city, warm_season, heatday, percep, comb_exp, count(*) as n, sum(count)::bigint as events from ex group by all",
    "joint_exposure_counts": f"with {PANEL} select city, {', '.join(f'sum((comb_exp = {k})::int)::bigint as cat{k}' for k in range(1, 5))}, count(*) as n from ex group by city",
    "lag_basis": f"""with {PANEL}, lg as (select city, class, {_LAG("heatday")} as t, {_LAG("percep")} as p, {", ".join(f"{_LAG(f'(comb_exp = {k})::int')} as c{k}" for k in (2, 3, 4))} from ex where warm_season = 1 window s as (partition by country, city, type, class order by date))
select city, class, sum(t)::bigint as cb_temp, sum(p)::bigint as cb_perc, sum(c2)::bigint as cb2, sum(c3)::bigint as cb3, sum(c4)::bigint as cb4, count(t) as usable from lg group by all""",
    "winner_grid": f"with {GRID} select * from grid",
    "winner_workbook": f"with {GRID} select * from grid",
    "winner_long": f"with {GRID}, lng as ({LONG}) select *, round(n * 100.0 / city_num::double, 6) as pct from lng",
    "supplement_bars": f"""with {GRID}, named as (select * replace (case class when 'MACHINERY' then 'Male' when 'BUILDING' then 'All-cause' else class end as class) from grid where city_num > 0), lng as ({LONG.replace(" from grid", " from named")}),
seen as (select class, row_number() over (order by coalesce(list_position(['All-cause', 'Age 0-69', 'Age 70+', 'Female', 'Male'], class), 9), class)::int as class_place from (select distinct class from named))
select l.class, city_num, winner, n, round(n * 100.0 / city_num::double, 6) as pct, case type when 'Hospitlization' then 'Hospitalization' when 'Emergency department visit' then 'Emergency dept. visits' else type end as outcome, class_place,
  list_position([{", ".join(f"'{x}'" for x in ex.WINNERS)}], winner)::int as fill_place, list_position(['Death', 'Hospitlization', 'Emergency department visit'], type)::int as outcome_place from lng l join seen on l.class = seen.class""",
    "excluded_city": f"with {PANEL} select city, comb_exp, count(*) as n from ex where city <> 'NATION_3' group by all",
    "winrate_rollup": f"with {GRID}{RATES} select type, n_pairs, {', '.join(f'n_{k}' for k in _F)}, {', '.join(f'round(pct_{k}, 6) as pct_{k}' for k in _F)} from rates",
    "winrate_annotation": f"with {GRID}{RATES} " + " union all ".join(f"select type, '{k}' as category, round(pct_{k}, 6) as pct, 'P ' || round(pct_P_either)::int || '% | S ' || round(pct_S_both)::int || '% | T ' || round(pct_T_either)::int || '%' as annotation from rates" for k in ("P_both", "P_QAIC_only", "P_R2_only", "S_both", "T_R2_only", "T_QAIC_only", "T_both")),
    "ivw_pool": f"with {EFFECTS}, w as (select class, sum({_W} * ln(rr)) / sum({_W}) as m, sqrt(1 / sum({_W})) as s, count(*) as n from eff group by class) select class, n, round(exp(m), 6) as rr, round(exp(m - 1.96 * s), 6) as rrlow, round(exp(m + 1.96 * s), 6) as rrhigh from w",
    "truncated_effects": f"with {EFFECTS} select type, class, round(rr, 6) as rr, round(rrlow, 6) as rrlow, round(rrhigh, 6) as rrhigh, round(rrlow, 6) as ymin_plot, round(least(rrhigh, 1.25), 6) as ymax_plot, rrhigh > 1.25 as high_trunc from eff",
    "figure5_rows": f"""with {EFFECTS}, cs as (select * from (values ('MACHINERY', '{ex.CASES[1]}', 'Cat2', 0.2::double), ('AUTOMOBILE', '{ex.CASES[2]}', 'Cat3', 0.0::double), ('BUILDING', '{ex.CASES[3]}', 'Cat4', -0.2::double)) v(class, "case", cat, shift)),
ceff as (select city, class, exp(m / 100 - 0.3) as rr, exp(m / 100 - 0.3 - 20 / sqrt(n)) as rrlow, exp(m / 100 - 0.3 + 20 / sqrt(n)) as rrhigh from (select city, class, avg(hp) as m, sum(count) as n from panel group by all)),
e as (select city as row_label, class, rr, rrlow, rrhigh, false as is_pooled, false as is_combined from ceff union all select 'Pooled: ' || type, class, rr, rrlow, rrhigh, true, false from eff
  union all select 'Combined', 'BUILDING', exp(m), exp(m - 1.96 * s), exp(m + 1.96 * s), true, true from (select sum({_W} * ln(rr)) / sum({_W}) as m, sqrt(1 / sum({_W})) as s from eff where class = 'BUILDING')),
pos as (select n_name as row_label, 9.0 + row_number() over (order by n_name) as y from nation union all select * from (values ('Pooled: Death', 6.5), ('Pooled: Hospitlization', 2.0), ('Combined', 0.5)) v(a, y))
select e.row_label, "case", round(rr, 6) as rr, round(rrlow, 6) as rrlow, round(rrhigh, 6) as rrhigh, is_pooled, is_combined, cat, y::double as y_center, round(y::double + shift, 6) as y_plot, round(least(rrhigh, 4), 6) as rr_hi_p, rrhigh > 4 as "trunc"
from e join cs on e.class = cs.class join pos on e.row_label = pos.row_label""",
}
ORACLE_SQL["panel_from_rds"] = ORACLE_SQL["joint_exposure_counts"]
