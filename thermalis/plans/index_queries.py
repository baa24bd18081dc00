"""City-index queries on the bindings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalis.functions import calendar
from thermalis.operators import city_index as ix
from thermalis.plans import bindings as b
from thermalis.plans.rounding import rounded
from thermalis.sources.runs import read_index_run, write_index_run
from thermalis.sources.scratch import fresh_folder
from thermalis.sources.tables import read_csv, write_csv


def _days(s, d):
    return ix.city_day(b.posts(s, d))


def _dates(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def city_day_counts(s, d):
    days = _days(s, d).select("city", "date", "continent", "country", "hemisphere", "year", "month", "season", "heat_posts", "observed_posts", "total_posts", "denominator_is_proxy", "daily_hpii_raw")
    return rounded(_dates(days))


def city_day_from_csv(s, d):
    """City days of posts that were written as delimited text and read back under a schema."""
    folder = fresh_folder(s, "posts")
    posts = b.posts(s, d).select("row_index", "city", "country", "continent", "hemisphere", "date", "indicator")
    write_csv(posts, folder)
    back = calendar.with_calendar(read_csv(s, folder, posts.schema))
    return rounded(_dates(ix.city_day(back).select("city", "date", "heat_posts", "observed_posts", "daily_hpii_raw")))


def city_day_external_denominator(s, d):
    days = ix.city_day(b.posts(s, d), totals=b.totals(s, d))
    return rounded(_dates(days.select("city", "date", "heat_posts", "observed_posts", "total_posts", "denominator_source", "denominator_is_proxy", "daily_hpii_raw")))


def city_day_own_denominator(s, d):
    posts = b.posts(s, d).withColumn("own", F.when(F.col("row_index") % 3 != 0, F.col("row_index") % 5))
    return ix.city_day(posts, total_col="own").groupBy("city", "denominator_source").agg(F.count("*").alias("days"), F.sum("total_posts").alias("posts"))


def city_month_index(s, d):
    return rounded(ix.monthly(_days(s, d)))


def city_season_index(s, d):
    out = ix.seasonal(_days(s, d)).select("city", "season", "seasonal_heat_posts", "seasonal_total_posts", "seasonal_hpii_daily_mean", "seasonal_hpii_daily_sum", "seasonal_active_days", "seasonal_hpii", "seasonal_hpii_percent", "peak_month_in_season", "peak_month_hpii_percent", "denominator_is_proxy")
    return rounded(out)


def hpvi_city_season(s, d):
    return rounded(ix.variability(_days(s, d)))


def normalized_city_month(s, d):
    out = ix.normalise_city_month(_days(s, d)).groupBy("city", "month").agg(F.count("*").alias("days"), F.min("daily_hpii_norm").alias("lo"), F.max("daily_hpii_norm").alias("hi"), F.sum("daily_hpii_norm").alias("total"))
    return rounded(out)


def coverage(s, d):
    return rounded(ix.coverage(_days(s, d)))


def eligible_cities(s, d):
    cfg = ix.IndexConfig(min_heat_posts=150, min_active_days=50)
    return rounded(ix.eligibility(_days(s, d), cfg))


def eligible_city_days(s, d):
    cfg = ix.IndexConfig(min_heat_posts=230, min_active_days=50)
    return ix.eligible_days(_days(s, d), cfg).groupBy("city").agg(F.count("*").alias("days"), F.sum("heat_posts").alias("heat_posts"))


def peak_month(s, d):
    return rounded(ix.peak_months(ix.monthly(_days(s, d)), ["city", "season"]).select("city", "season", "month", "month_hpii"))


def volume_strata(s, d):
    return ix.volume_strata(_days(s, d))


def season_with_volume(s, d):
    days = _days(s, d)
    return ix.with_volume(ix.seasonal(days), ix.volume_strata(days)).groupBy("tweet_volume_stratum", "season").agg(F.count("*").alias("cities"), F.sum("seasonal_heat_posts").alias("heat_posts"))


def polarization(s, d):
    return rounded(ix.polarisation(ix.seasonal(_days(s, d))))


def city_typology(s, d):
    days = _days(s, d)
    return rounded(ix.typology(ix.with_levels(ix.seasonal(days)), ix.monthly(days)))


def index_run_summary(s, d):
    _, summary = ix.index_run(b.posts(s, d), totals=b.totals(s, d), cfg=ix.IndexConfig(apply_eligibility_filters=False))
    return rounded(summary.withColumn("breaks", F.array_join(F.transform("breaks", lambda x: F.format_string("%.4f", x)), " ")))


def _written(s, d):
    folder = fresh_folder(s, "index")
    write_index_run(b.posts(s, d), folder, cfg=ix.IndexConfig(apply_eligibility_filters=False), indicator="indicator")
    return read_index_run(s, folder)


def index_run_seasons(s, d):
    """City seasons of a written run, read back."""
    tables, _ = _written(s, d)
    return rounded(tables["city_season"].select("city", "season", "seasonal_heat_posts", "seasonal_total_posts", "seasonal_hpii_percent", "hpii_level", "tweet_volume_stratum"))


def index_run_written(s, d):
    """Rows of every table of a written run, beside the counts that its summary states."""
    tables, summary = _written(s, d)
    sizes = None
    for name, t in sorted(tables.items()):
        one = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        sizes = one if sizes is None else sizes.unionByName(one)
    stated = s.createDataFrame([(f"summary {k}", summary[k]) for k in ("n_city_days", "n_city_months", "n_city_seasons", "n_cities", "n_continents")], "name string, n long")
    return sizes.unionByName(stated)


def all_cities_eligible(s, d):
    return rounded(ix.eligibility(_days(s, d), ix.IndexConfig(apply_eligibility_filters=False)))


def jenks_levels(s, d):
    return rounded(ix.with_levels(ix.seasonal(_days(s, d))).select("city", "season", "seasonal_hpii_percent", "hpii_level", "hpii_level_roman", "high_hpii_binary", "intensity_variability_typology"))


def season_calendar(s, d):
    p = b.posts(s, d)
    sides = p.select("date", F.explode(F.array(F.lit("north"), F.lit("south"))).alias("hemisphere"))
    return calendar.with_calendar(sides).groupBy("hemisphere", "month_num", "season").agg(F.count("*").alias("n"), F.min("year").alias("first_year"))


def month_and_hemisphere(s, d):
    """Months and hemispheres from the forms that inputs use."""
    e = b.read(s, d, "events")
    forms = F.array(F.lit("2022-03-05"), F.lit("Mar"), F.lit("sept"), F.lit(" 7 "), F.lit("13"), F.lit("junk"), F.lit("11.0"), F.lit("October"), F.lit(""))
    codes = F.array(F.lit("AUS"), F.lit(" bra"), F.lit("USA"), F.lit("XXX"))
    lands = F.array(F.lit("Oceania"), F.lit("europe"), F.lit("South America"))
    rows = e.select(F.get(forms, (F.col("event_id") % 9).cast("int")).alias("raw"), F.get(codes, (F.col("event_id") % 4).cast("int")).alias("country"), F.get(lands, (F.col("event_id") % 3).cast("int")).alias("continent"))
    return rows.groupBy("raw", "country", "continent").agg(F.count("*").alias("n")).select("*", calendar.month_number(F.col("raw")).alias("month_num"), calendar.hemisphere(F.col("country"), F.col("continent")).alias("hemisphere"))


def synthetic_dates(s, d):
    t = b.tweets(s, d).select("row_index", F.col("continent").alias("city"), "month")
    return calendar.with_dates(t).groupBy("city", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_is_synthetic").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def event_city_days(s, d):
    e = b.read(s, d, "events").select(F.col("event_id").alias("row_index"), (F.col("user_id") % 25).cast("string").alias("city"), F.to_date("ts").alias("date"), (F.col("event_type") == "error").cast("int").alias("indicator"))
    full = e.withColumns({"continent": F.lit("x"), "country": F.lit("y"), "hemisphere": F.lit("north")})
    days = ix.city_day(calendar.with_calendar(full))
    return rounded(_dates(days.select("city", "date", "heat_posts", "observed_posts", "daily_hpii_raw")))


QUERIES = {f.__name__: f for f in (city_day_counts, city_day_from_csv, city_day_external_denominator, city_day_own_denominator, city_month_index, city_season_index, hpvi_city_season, normalized_city_month, coverage, eligible_cities, eligible_city_days, peak_month, volume_strata, season_with_volume, polarization, city_typology, index_run_summary, index_run_seasons, index_run_written, all_cities_eligible, jenks_levels, season_calendar, month_and_hemisphere, synthetic_dates, event_city_days)}

SEASON = """list_extract(['Winter','Spring','Summer','Fall'], 1 + ((({m}) % 12) // 3 + case when {h} = 'south' then 2 else 0 end) % 4)"""
POSTS = f"""
posts0 as (
  select o_orderkey as row_index, n_name as city, n_name as country, r_name as continent,
    case when n_nationkey % 2 = 0 then 'north' else 'south' end as hemisphere, cast(o_orderdate as date) as date,
    cast(o_orderpriority in ('1-URGENT', '2-HIGH') as int) as indicator, o_totalprice as price, c_acctbal as balance, c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
posts as (
  select *, year(date)::int as year, month(date)::int as month_num, strftime(date, '%Y-%m') as month, {SEASON.format(m="month(date)", h="hemisphere")} as season from posts0)"""
DAYS = (
    POSTS
    + """,
days as (
  select city, date, min(continent) as continent, min(country) as country, min(hemisphere) as hemisphere, min(year) as year, min(month) as month, min(month_num) as month_num, min(season) as season,
    sum(indicator)::bigint as heat_posts, count(*) as observed_posts, count(*) as total_posts, 1 as denominator_is_proxy, sum(indicator) / count(*)::double as h
  from posts group by city, date)"""
)
MONTHLY = (
    DAYS
    + """,
monthly as (
  select city, continent, country, hemisphere, year, month, month_num, season, sum(heat_posts)::bigint as month_heat_posts, sum(total_posts)::bigint as month_total_posts,
    sum(h) as month_hpii_daily_sum, avg(h) as month_hpii_daily_mean, sum(h) as month_hpii_norm_sum, count(distinct date) as month_active_days,
    sum(heat_posts) / sum(total_posts)::double as month_hpii
  from days group by all)"""
)
PEAK = MONTHLY + ", peak as (select * from (select *, row_number() over (partition by city, season order by month_hpii desc nulls last, year, month_num) as k from monthly) where k = 1)"
HPVI = """,
smooth as (select *, avg(h) over (partition by city order by date rows between 6 preceding and current row) as h7 from days),
hpvi0 as (
  select city, continent, country, hemisphere, season, count(h7) as hpvi_days_used,
    case when abs(avg(h7)) < 1e-15 and abs(stddev_pop(h7)) < 1e-15 then 0 else stddev_pop(h7) / (abs(avg(h7)) + 1e-8) end as v
  from smooth group by all)"""
SEASONS = (
    PEAK
    + HPVI
    + """,
seasons as (
  select d.city, d.continent, d.season, sum(d.heat_posts)::bigint as seasonal_heat_posts, sum(d.total_posts)::bigint as seasonal_total_posts, avg(h) as seasonal_hpii_daily_mean, sum(h) as seasonal_hpii_daily_sum,
    count(distinct d.date) as seasonal_active_days, sum(d.heat_posts) / sum(d.total_posts)::double as seasonal_hpii
  from days d group by all)"""
)
VOLUME = """,
annual as (select city, sum(total_posts)::bigint as annual_total_posts, sum(heat_posts)::bigint as annual_heat_posts, count(distinct date) as active_days from days group by city),
volume as (
  select *, case when annual_total_posts <= (select quantile_cont(annual_total_posts, 0.3) from annual) then 'Low'
    when annual_total_posts <= (select quantile_cont(annual_total_posts, 0.7) from annual) then 'Medium' else 'High' end as tweet_volume_stratum from annual)"""
#: Natural breaks of the seasons' percentages: least squared deviation of j classes up to each value, from that of j - 1.
BREAKS = """,
vals as (select row_number() over (order by seasonal_hpii * 100) as i, seasonal_hpii * 100 as v from seasons where seasonal_hpii is not null),
sums as (select 0 as i, null::double as v, 0::double as s1, 0::double as s2 union all select i, v, sum(v) over (order by i), sum(v * v) over (order by i) from vals),
own as (select a.i as f, e.i as e, l.v as b, e.s2 - l.s2 - (e.s1 - l.s1) ** 2 / (e.i - l.i) as sse from vals a join sums l on l.i = a.i - 1 join sums e on e.i >= a.i),
c1 as (select e, sse as cost, []::double[] as cuts from own where f = 1)""" + "".join(
    f""",
c{j} as (select own.e, min(sse + p.cost) as cost, arg_min(list_append(p.cuts, b), sse + p.cost) as cuts from own join c{j - 1} p on p.e = own.f - 1 where own.f >= 2 group by own.e)"""
    for j in range(2, 8)
) + """,
breaks as (select [(select min(v) from vals)] || cuts || [(select max(v) from vals)] as breaks from c7 where e = (select max(i) from vals)),
levels as (
  select s.*, h.v as hpvi, list_position(list_transform(breaks[2:], lambda b: seasonal_hpii * 100 <= b), true)::int as hpii_level from seasons s join hpvi0 h on s.city = h.city and s.season = h.season, breaks)"""
TOTALS = """, tot as (
  select n_name as city, cast(o_orderdate as date) as date, count(*) as t from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""
COVER = (
    DAYS
    + f""",
span as (select city, min(date) as a, max(date) as b, min(hemisphere) as hemisphere from days group by city),
every as (select city, hemisphere, unnest(generate_series(a, b, interval 1 day))::date as date from span),
expected as (select city, {SEASON.format(m="month(date)", h="hemisphere")} as season, count(*) as expected_days from every group by all),
cover as (
  select e.city, e.season, expected_days, coalesce(o.n, 0)::bigint as observed_unique_days, coalesce(o.n, 0) / expected_days::double as coverage_frac
  from expected e left join (select city, season, count(distinct date) as n from days group by all) o on e.city = o.city and e.season = o.season)"""
)
ELIGIBLE = (
    COVER
    + """,
elig as (
  select s.*, coverage_min_frac, coverage_mean_frac, expected_days_total, observed_days_total from
    (select city, sum(heat_posts)::bigint as total_heat_posts, count(distinct date) as active_days, count(distinct season) as season_n from days group by city) s
    left join (select city, min(coverage_frac) as coverage_min_frac, avg(coverage_frac) as coverage_mean_frac, sum(expected_days)::bigint as expected_days_total, sum(observed_unique_days)::bigint as observed_days_total from cover group by city) c on s.city = c.city)"""
)


def _tier(column: str, kind: str) -> str:
    return f"""(select continent, season, case when count(*) <= 1 then 0 else greatest(0, least(1, sum(raw) / (sum(pow(p, 2.6)) * greatest(max(a) - min(a), 1e-12)))) end as {kind} from (
      select continent, season, p, a, pow(p, 2.6) * (select sum(y.p * abs(x.a - y.a)) from {kind}_p y where y.continent = x.continent and y.season = x.season) as raw from {kind}_p x) group by all)"""


def _signal(column: str, kind: str) -> str:
    test = "scaled" if kind == "hppi_hpii" else "v"
    lo, hi = ("1/3.0::double", "2/3.0::double") if kind == "hppi_hpii" else ("0.1", "0.3")
    return f""",
{kind}_s as (select continent, season, v, case when max(v) over g > min(v) over g then (v - min(v) over g) / (max(v) over g - min(v) over g) else 0 end as scaled from (select continent, season, coalesce({column}, 0) as v from both_) window g as (partition by continent, season)),
{kind}_a as (select *, (scaled + 1e-9) * case when {test} <= {lo} then 1 when {test} <= {hi} then 2 else 3 end as a from {kind}_s),
{kind}_p as (select continent, season, a, a / sum(a) over (partition by continent, season) as p from {kind}_a)"""


ORACLE_SQL = {
    "city_day_counts": f"with {DAYS} select city, strftime(date, '%Y-%m-%d') as date, continent, country, hemisphere, year, month, season, heat_posts, observed_posts, total_posts, denominator_is_proxy, round(h, 6) as daily_hpii_raw from days",
    "city_day_from_csv": f"with {DAYS} select city, strftime(date, '%Y-%m-%d') as date, heat_posts, observed_posts, round(h, 6) as daily_hpii_raw from days",
    "city_day_external_denominator": f"""with {DAYS}{TOTALS}
select d.city, strftime(d.date, '%Y-%m-%d') as date, heat_posts, observed_posts, coalesce(t, observed_posts)::bigint as total_posts,
  case when t is null then 'observed_input_rows_proxy' else 'external_city_day_totals' end as denominator_source, (t is null)::int as denominator_is_proxy, round(heat_posts / coalesce(t, observed_posts)::double, 6) as daily_hpii_raw
from days d left join tot on d.city = tot.city and d.date = tot.date""",
    "city_day_own_denominator": f"""with {POSTS}, d as (
  select city, date, count(*) as n, coalesce(arg_min(row_index % 5, row_index) filter (where row_index % 3 <> 0), count(*)) as t from posts group by all)
select city, case when t = n then 'observed_input_rows_proxy' else 'input_total_posts_col' end as denominator_source, count(*) as days, sum(t)::bigint as posts from d group by all""",
    "city_month_index": f"with {MONTHLY} select city, continent, country, hemisphere, year, month, month_num, season, month_heat_posts, month_total_posts, round(month_hpii_daily_sum, 6) as month_hpii_daily_sum, round(month_hpii_daily_mean, 6) as month_hpii_daily_mean, round(month_hpii_norm_sum, 6) as month_hpii_norm_sum, month_active_days, round(month_hpii, 6) as month_hpii, round(month_hpii * 100, 6) as month_hpii_percent from monthly",
    "city_season_index": f"with {SEASONS} select s.city, s.season, seasonal_heat_posts, seasonal_total_posts, round(seasonal_hpii_daily_mean, 6) as seasonal_hpii_daily_mean, round(seasonal_hpii_daily_sum, 6) as seasonal_hpii_daily_sum, seasonal_active_days, round(seasonal_hpii, 6) as seasonal_hpii, round(seasonal_hpii * 100, 6) as seasonal_hpii_percent, p.month as peak_month_in_season, round(p.month_hpii * 100, 6) as peak_month_hpii_percent, 1 as denominator_is_proxy from seasons s left join peak p on s.city = p.city and s.season = p.season",
    "hpvi_city_season": f"with {DAYS}{HPVI} select city, continent, country, hemisphere, season, hpvi_days_used, round(v, 6) as hpvi, round(v * 100, 6) as hpvi_percent, case when v is null then 'unknown' when v <= 0.1 then 'low' when v <= 0.3 then 'moderate' else 'high' end as hpvi_tier, coalesce(v > 0.3, false)::int as hpvi_high_binary from hpvi0",
    "normalized_city_month": f"""with {DAYS}, med as (select city, month, median(h) as m from days group by all), res as (select d.city, d.month, h - m as r from days d join med on d.city = med.city and d.month = med.month),
q as (select city, month, quantile_cont(r, 0.01) as lo, quantile_cont(r, 0.99) as hi from res group by all), norm as (select res.city, res.month, least(greatest(r, lo), hi) as v from res join q on res.city = q.city and res.month = q.month)
select city, month, count(*) as days, round(min(v), 6) + 0.0 as lo, round(max(v), 6) + 0.0 as hi, round(sum(v), 6) + 0.0 as total from norm group by all""",
    "coverage": f"with {COVER} select city, season, expected_days, observed_unique_days, round(coverage_frac, 6) as coverage_frac from cover",
    "eligible_cities": f"with {ELIGIBLE} select city, total_heat_posts, active_days, season_n, round(coverage_min_frac, 6) as coverage_min_frac, round(coverage_mean_frac, 6) as coverage_mean_frac, expected_days_total, observed_days_total, coalesce(total_heat_posts >= 150 and active_days >= 50 and coverage_min_frac >= 0.15, false)::int as eligible_city from elig",
    "eligible_city_days": f"with {ELIGIBLE} select city, count(*) as days, sum(heat_posts)::bigint as heat_posts from days where city in (select city from elig where total_heat_posts >= 230 and active_days >= 50 and coverage_min_frac >= 0.15) group by city",
    "peak_month": f"with {PEAK} select city, season, month, round(month_hpii, 6) as month_hpii from peak",
    "volume_strata": f"with {DAYS}{VOLUME} select * from volume",
    "season_with_volume": f"with {SEASONS}{VOLUME} select tweet_volume_stratum, season, count(*) as cities, sum(seasonal_heat_posts)::bigint as heat_posts from seasons s left join volume v on s.city = v.city group by all",
    "polarization": f"""with {SEASONS}, both_ as (select s.city, s.continent, s.season, seasonal_hpii * 100 as pct, v from seasons s join hpvi0 h on s.city = h.city and s.season = h.season){_signal("pct", "hppi_hpii")}{_signal("v", "hppi_hpvi")}
select n.continent, n.season, n.n_cities, round(hppi_hpii, 6) as hppi_hpii, round(hppi_hpvi, 6) as hppi_hpvi,
  case when hppi_hpii < 0.05 then 'low' when hppi_hpii <= 0.15 then 'moderate' else 'high' end as hppi_hpii_tier, case when hppi_hpvi < 0.05 then 'low' when hppi_hpvi <= 0.15 then 'moderate' else 'high' end as hppi_hpvi_tier
from (select continent, season, count(distinct city) as n_cities from both_ group by all) n join {_tier("pct", "hppi_hpii")} a on n.continent = a.continent and n.season = a.season join {_tier("v", "hppi_hpvi")} c on n.continent = c.continent and n.season = c.season""",
    "city_typology": f"""with {SEASONS}{BREAKS}, top as (select * from (select *, row_number() over (partition by city order by month_hpii desc nulls last, year, month_num) as k from monthly) where k = 1),
dom as (select * from (select *, row_number() over (partition by city order by round(seasonal_hpii_daily_sum, 9) desc nulls last, season) as k from seasons) where k = 1),
x as (select s.city, sum((coalesce(hpii_level, 0) >= 5)::int)::bigint as n_high,
  max(seasonal_hpii_daily_sum) filter (where s.season = 'Summer') as st, max(seasonal_hpii_daily_sum) filter (where s.season = 'Winter') as wt, max(p.month_hpii) filter (where s.season = 'Summer') as sp, max(p.month_hpii) filter (where s.season = 'Winter') as wp
  from levels s left join peak p on s.city = p.city and s.season = p.season group by s.city),
y as (select *, coalesce(round(wp, 9), '-inf'::double) > coalesce(round(sp, 9), '-inf'::double) as pc, coalesce(round(wt, 9), '-inf'::double) > coalesce(round(st, 9), '-inf'::double) as tc from x)
select top.city, top.continent, top.country, top.hemisphere, top.season as peak_season, top.month as peak_month, round(top.month_hpii, 6) as peak_month_hpii_global, round(top.month_hpii * 100, 6) as peak_month_hpii_percent_global,
  dom.season as total_dominant_season, round(dom.seasonal_hpii_daily_sum, 6) as total_dominant_hpii_sum, round(dom.seasonal_hpii, 6) as total_dominant_hpii, round(dom.seasonal_hpii * 100, 6) as total_dominant_hpii_percent,
  (top.season = dom.season)::int as peak_total_coincide, n_high as n_high_hpii_seasons, (n_high >= 2)::int as multi_season_high_hpii,
  round(st, 6) as summer_total_hpii_sum, round(sp, 6) as summer_peak_month_hpii, round(sp * 100, 6) as summer_peak_month_hpii_percent, round(wt, 6) as winter_total_hpii_sum, round(wp, 6) as winter_peak_month_hpii, round(wp * 100, 6) as winter_peak_month_hpii_percent,
  case when pc and tc then 'Both' when pc then 'Peak' when tc then 'Total' else 'NoCounterSeasonal' end as counter_seasonal_label, (pc or tc)::int as counter_seasonal_binary
from top join dom on top.city = dom.city join y on top.city = y.city""",
    "jenks_levels": f"""with {SEASONS}{BREAKS}, t as (select *, coalesce(hpii_level >= 5, false) as hi, coalesce(hpvi > 0.3, false) as hv from levels)
select city, season, round(seasonal_hpii * 100, 6) as seasonal_hpii_percent, hpii_level, list_extract(['I','II','III','IV','V','VI','VII'], hpii_level) as hpii_level_roman, hi::int as high_hpii_binary,
  case when hi and hv then 'Perception Hotspots' when hi then 'Stable High' when not hv then 'Stable Low' else 'Variability Low' end as intensity_variability_typology from t""",
    "index_run_summary": f"""with {DAYS.replace("count(*) as total_posts, 1 as denominator_is_proxy, sum(indicator) / count(*)::double as h", "count(*) as n").replace("days as (", "days0 as (")}{TOTALS},
days as (select d.* exclude (n), coalesce(t, n)::bigint as total_posts, (t is null)::int as denominator_is_proxy, heat_posts / coalesce(t, n)::double as h from days0 d left join tot on d.city = tot.city and d.date = tot.date),
seasons as (select city, season, sum(heat_posts) / sum(total_posts)::double as seasonal_hpii from days group by all){BREAKS.split(",\nlevels as")[0]}
select count(*) as city_days, count(distinct city) as cities, sum(heat_posts)::bigint as heat_posts, sum(total_posts)::bigint as total_posts, round(avg(denominator_is_proxy), 6) as denominator_proxy_fraction, 0.0::double as date_synthetic_fraction, 0.0::double as hemisphere_inferred_fraction,
  array_to_string(list_transform((select breaks from breaks), lambda x: printf('%.4f', x)), ' ') as breaks from days""",
    "index_run_seasons": f"with {SEASONS}{BREAKS}{VOLUME} select l.city, season, seasonal_heat_posts, seasonal_total_posts, round(seasonal_hpii * 100, 6) as seasonal_hpii_percent, hpii_level, tweet_volume_stratum from levels l left join volume v on l.city = v.city",
    "index_run_written": f"""with {SEASONS}, x as (select (select count(*) from days) as d, (select count(*) from monthly) as m, (select count(*) from seasons) as s, (select count(distinct city) from days) as c, (select count(distinct continent) from days) as k,
  (select count(*) from (select distinct continent, season from seasons)) as p)
select unnest(['city_day', 'city_month', 'city_season', 'city_typology', 'polarization', 'volume_strata', 'city_eligibility', 'summary n_city_days', 'summary n_city_months', 'summary n_city_seasons', 'summary n_cities', 'summary n_continents']) as name,
  unnest([d, m, s, c, p, c, c, d, m, s, c, k]) as n from x""",
    "all_cities_eligible": f"with {ELIGIBLE} select city, total_heat_posts, active_days, season_n, round(coverage_min_frac, 6) as coverage_min_frac, round(coverage_mean_frac, 6) as coverage_mean_frac, expected_days_total, observed_days_total, 1 as eligible_city from elig",
    "season_calendar": f"with {POSTS}, s as (select date, unnest(['north', 'south']) as hemisphere from posts) select hemisphere, month(date)::int as month_num, {SEASON.format(m='month(date)', h='hemisphere')} as season, count(*) as n, min(year(date))::int as first_year from s group by all",
    "month_and_hemisphere": """with e as (select list_extract(['2022-03-05','Mar','sept',' 7 ','13','junk','11.0','October',''], (event_id % 9 + 1)::int) as raw, list_extract(['AUS',' bra','USA','XXX'], (event_id % 4 + 1)::int) as country, list_extract(['Oceania','europe','South America'], (event_id % 3 + 1)::int) as continent from events)
select raw, country, continent, count(*) as n, case raw when '2022-03-05' then 3 when 'Mar' then 3 when 'sept' then 9 when ' 7 ' then 7 when '11.0' then 11 when 'October' then 10 end as month_num,
  case when upper(trim(country)) in ('AUS', 'BRA') then 'south' when country = 'USA' then 'north' when lower(continent) in ('oceania', 'south america') then 'south' else 'north' end as hemisphere from e group by all""",
    "synthetic_dates": """with t as (select doc_id, lang as city, doc_id % 12 as k from documents where doc_id is not null), m as (select *, 2022 + (k + 2) // 12 as y, (k + 2) % 12 + 1 as mm, row_number() over (partition by city, k order by doc_id) - 1 as j from t)
select city, strftime(make_date(y::int, mm::int, (j % 28 + 1)::int), '%Y-%m-%d') as date, 1 as date_is_synthetic, count(*) as n, min(doc_id) as first_row from m group by all""",
    "event_city_days": "select (user_id % 25)::varchar as city, strftime(cast(ts as date), '%Y-%m-%d') as date, sum((event_type = 'error')::int)::bigint as heat_posts, count(*) as observed_posts, round(sum((event_type = 'error')::int) / count(*)::double, 6) as daily_hpii_raw from events group by (user_id % 25)::varchar, cast(ts as date)",
}
