"""Similar texts, fits from sums, closed-form pooling and epoch training on the bindings, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalis.operators import evaluation as ev
from thermalis.operators import exposure as ex
from thermalis.operators import glm, minhash, training
from thermalis.operators.percentiles import exact_percentiles
from thermalis.plans import bindings as b
from thermalis.plans.exposure_queries import PANEL, PERCEPTION
from thermalis.plans.rounding import rounded
from thermalis.plans.text_queries import ALNUM, TWEETS
from thermalis.sources.models import load_model, save_model
from thermalis.sources.scratch import fresh_folder, saved
from thermalis.streaming.city_day import drained, read_stream, streaming_city_day, streaming_spells


def _similar(s, d):
    return minhash.similar_texts(b.tweets(s, d), "text")


def minhash_pairs(s, d):
    """Pairs of different texts (the least row of each) of similarity 0.85 or more."""
    return rounded(_similar(s, d).pairs)


def minhash_rows(s, d):
    """Every text with the least row of its set, and the numbers of its links to other sets and to other texts."""
    return _similar(s, d).rows()


def _basis(s, d, mode="warm"):
    return ex.lag_basis(ex.exposures(b.panel(s, d), mode, perception=PERCEPTION))


def glm_by_sums(s, d):
    """Both models of every series from aggregated normal equations, with the winners."""
    return rounded(ex.classify_winners(glm.compare_models(_basis(s, d))), 4)


def joint_rr_by_sums(s, d):
    """Relative risks of all series, fitted from aggregated normal equations."""
    return rounded(ex.joint_rr(glm.joint_effects(_basis(s, d, "all"))), 4)


def winners_of_fits(s, d):
    """The winner grid of fitted models."""
    return ex.winner_grid(ex.classify_winners(glm.compare_models(_basis(s, d))), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def pooled_fixed(s, d):
    """Fixed-effect pooling of three means of every city, with their covariance, by type and class."""
    cells = {"b1": F.col("temp"), "b2": F.col("heatPerception") / 100, "b3": F.col("month").cast("double")}
    p = b.panel(s, d).select("type", "class", "city", *(c.alias(k) for k, c in cells.items()))
    low = [(i, j) for j in range(1, 4) for i in range(j, 4)]
    studies = p.groupBy("type", "class", "city").agg(*(F.avg(k).alias(k) for k in cells), *((F.covar_samp(f"b{i}", f"b{j}") / F.count("*")).alias(f"v{i}{j}") for i, j in low), F.count("*").alias("n"))
    return rounded(ex.pool_fixed(studies.where("n > 20")), 5)


def meta_fixed_rr(s, d):
    """Relative risks pooled with fixed effects from the fits of all series."""
    return rounded(ex.pooled_rr(ex.pool_fixed(glm.joint_effects(_basis(s, d, "all")))), 4)


def _labelled(s, d):
    t = b.tweets(s, d).select("row_index", "sentence", F.col("author_id").alias("city_id"))
    return b.predictions(s, d).select("row_index", "label", "month").join(t, "row_index")


def epoch_training(s, d):
    """Quality of every fold's model on its own rows after each epoch."""
    placed = _labelled(s, d)
    placed = placed.join(ev.group_folds(placed, "city_id", 5).select("city_id", F.col("fold").alias("fold_id")), "city_id")
    return rounded(training.train_by_epochs(placed).history_table(s))


def epoch_heldout(s, d):
    """Monthly metrics of every row predicted by the model that did not see its group, and their summary over folds."""
    _, held = training.cross_train(_labelled(s, d))
    return rounded(ev.monthly_metrics(held))


def fold_summary_trained(s, d):
    """Mean and deviation of held-out metrics over the folds of a grouped cross-validation."""
    _, held = training.cross_train(_labelled(s, d))
    return rounded(ev.fold_summary(held.groupBy("fold_id").agg(*ev.confusion_metrics())))


def final_fit_monthly(s, d):
    """A model trained on nine months of rows, and its metrics in each of the months after them."""
    t = _labelled(s, d)
    state = training.train_final(t.where("month < '2022-12'"))
    return rounded(ev.monthly_metrics(training.predict_batched(t.where("month >= '2022-12'"), {0: state})))


def reloaded_model(s, d):
    """Predictions, in batches, of a fitted pipeline that was saved and loaded again."""
    t = saved(_labelled(s, d), "labelled")  # read by every pass of the fit and by the predictions
    folder = fresh_folder(s, "model")
    save_model(ev.fit_baseline(t), folder, s)
    state = training.State.of_pipeline(load_model(folder, spark=s))
    return rounded(training.predict_batched(t, {0: state}).select("row_index", "label", "pred_label", "pred_prob_1"))


QUANTILES = [0.0, 0.01, 0.3, 0.5, 0.7, 0.95, 0.99, 1.0]


def hot_group_percentiles(s, d):
    """Exact percentiles of the few groups that hold all line items, and of one that is nearly constant."""
    line = b.read(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"), "l_quantity")
    wide = exact_percentiles(line, ["flag"], "price", QUANTILES).withColumn("measure", F.lit("price"))
    flat = exact_percentiles(line, ["flag"], "l_quantity", QUANTILES).withColumn("measure", F.lit("quantity"))
    return rounded(wide.unionByName(flat))


def _event_stream(s, d):
    # a pattern, since a stream does not read a single file by its name
    e = read_stream(s, f"{d}/event[s].parquet", b.read(s, d, "events").schema)
    return e.select(F.col("event_id").alias("row_index"), F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 25).cast("string").alias("city"), (F.col("event_type") == "error").cast("int").alias("indicator"))


def stream_city_day(s, d):
    """City-day counts of the event stream that are final at its end: days that the watermark has passed."""
    days = drained(s, streaming_city_day(_event_stream(s, d)), "city-days")
    return days.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def stream_spells(s, d):
    """Finished spells of activity of every user, from keyed state."""
    spells = drained(s, streaming_spells(_event_stream(s, d), "user_id"), "spells")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return spells.select("user_id", shown("first_ts"), shown("last_ts"), "first_row", "posts")


QUERIES = {f.__name__: f for f in (minhash_pairs, minhash_rows, glm_by_sums, joint_rr_by_sums, winners_of_fits, pooled_fixed, meta_fixed_rr, hot_group_percentiles, stream_city_day, stream_spells, epoch_training, epoch_heldout, fold_summary_trained, final_fit_monthly, reloaded_model)}

SETS = f"""{TWEETS}, w as (select row_index, regexp_extract_all(lower(trim(coalesce(text, ''))), '[{ALNUM}]+') as w from tweets),
s as (select row_index, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) end as s from w),
m as (select row_index, case when len(s) = 0 then row_index else min(row_index) over (partition by s) end as representative, len(s) as n from s),
heads as (select s.row_index, s, len(s) as n from s join m on s.row_index = m.row_index where m.representative = m.row_index and len(s) > 0),
e as (select row_index, n, unnest(s) as g from heads),
o as (select x.row_index, y.row_index as other, any_value(x.n) as n, any_value(y.n) as m, count(*) as k from e x join e y on x.g = y.g and x.row_index < y.row_index group by x.row_index, y.row_index),
pairs as (select row_index, other, k / (n + m - k)::double as similarity from o where k / (n + m - k)::double >= 0.85)"""
_LOW = [(i, j) for j in range(1, 4) for i in range(j, 4)]


def _inverse(prefix: str) -> dict[tuple[int, int], str]:
    """Closed form of a symmetric 3 x 3 inverse, lower triangle, from columns such as v11."""
    c = {(i, j): f"{prefix}{max(i, j)}{min(i, j)}" for i in range(1, 4) for j in range(1, 4)}
    det = f"({c[1, 1]} * ({c[2, 2]} * {c[3, 3]} - {c[3, 2]} * {c[3, 2]}) - {c[2, 1]} * ({c[2, 1]} * {c[3, 3]} - {c[3, 2]} * {c[3, 1]}) + {c[3, 1]} * ({c[2, 1]} * {c[3, 2]} - {c[2, 2]} * {c[3, 1]}))"
    top = {
        (1, 1): f"{c[2, 2]} * {c[3, 3]} - {c[3, 2]} * {c[3, 2]}",
        (2, 1): f"{c[3, 1]} * {c[3, 2]} - {c[2, 1]} * {c[3, 3]}",
        (3, 1): f"{c[2, 1]} * {c[3, 2]} - {c[3, 1]} * {c[2, 2]}",
        (2, 2): f"{c[1, 1]} * {c[3, 3]} - {c[3, 1]} * {c[3, 1]}",
        (3, 2): f"{c[2, 1]} * {c[3, 1]} - {c[1, 1]} * {c[3, 2]}",
        (3, 3): f"{c[1, 1]} * {c[2, 2]} - {c[2, 1]} * {c[2, 1]}",
    }
    return {k: f"({v}) / nullif({det}, 0)" for k, v in top.items()}


def _w(i: int, j: int, prefix: str = "w") -> str:
    return f"{prefix}{max(i, j)}{min(i, j)}"


_TURNED = {i: f"({_w(i, 1)} * b1 + {_w(i, 2)} * b2 + {_w(i, 3)} * b3)" for i in (1, 2, 3)}
_MEAN = {i: f"({_w(i, 1, 'u')} * t1 + {_w(i, 2, 'u')} * t2 + {_w(i, 3, 'u')} * t3)" for i in (1, 2, 3)}

ORACLE_SQL = {
    "minhash_pairs": f"with {SETS} select row_index, other, round(similarity, 6) as similarity from pairs",
    "minhash_rows": f"""with {SETS}, c as (select representative, count(*) as copies from m group by representative),
ends as (select row_index as a, other as b from pairs union all select other, row_index from pairs),
l as (select a, count(*) as set_links, sum(copies)::bigint as text_links from ends join c on b = representative group by a)
select m.row_index, m.representative, n::int as n_shingles, coalesce(set_links, 0)::bigint as set_links, case when n = 0 then 0 else coalesce(text_links, 0) + copies - 1 end::bigint as text_links
from m join c on m.representative = c.representative left join l on l.a = m.representative""",
    "hot_group_percentiles": " union all ".join(
        f"select l_returnflag as flag, '{measure}' as measure, {', '.join(f'round(quantile_cont({c}, {q}), 6) + 0.0 as q{i}' for i, q in enumerate(QUANTILES))} from lineitem group by l_returnflag" for measure, c in (("price", "l_extendedprice"), ("quantity", "l_quantity"))
    ),
    "stream_city_day": """with w as (select max(ts) - interval 1 day as passed from events)
select (user_id % 25)::varchar as city, strftime(cast(ts as date), '%Y-%m-%d') as date, sum((event_type = 'error')::int)::bigint as heat_posts, count(*) as observed_posts
from events, w where ts is not null group by user_id % 25, cast(ts as date), passed having cast(ts as date) + interval 1 day <= date_trunc('millisecond', passed)""",
    "stream_spells": """with e as (select user_id, event_id, epoch_us(ts) as t from events where user_id is not null and ts is not null),
g as (select *, coalesce(t - lag(t) over k >= 6 * 3600 * 1000000::bigint, true)::int as starts from e window k as (partition by user_id order by t, event_id)),
n as (select *, sum(starts) over (partition by user_id order by t, event_id rows unbounded preceding) as spell from g)
select user_id, strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S.%f') as first_ts, strftime(make_timestamp(max(t)), '%Y-%m-%d %H:%M:%S.%f') as last_ts, arg_min(event_id, (t, event_id)) as first_row, count(*) as posts from n group by user_id, spell
having max(t) + 6 * 3600 * 1000000::bigint <= (select max(t) // 1000 * 1000 - 24 * 3600 * 1000000::bigint from e)""",
    "pooled_fixed": f"""with {PANEL}, rows_ as (select type, class, city, temp as b1, hp / 100 as b2, month::double as b3 from panel),
st as (select type, class, city, avg(b1) as b1, avg(b2) as b2, avg(b3) as b3, {", ".join(f"covar_samp(r.b{i}, r.b{j}) / count(*) as v{i}{j}" for i, j in _LOW)} from rows_ r group by type, class, city having count(*) > 20),
wt as (select *, {", ".join(f"{e} as w{i}{j}" for (i, j), e in _inverse("v").items())} from st),
sm as (select type, class, count(*) as studies, {", ".join(f"sum(w{i}{j}) as s{i}{j}" for i, j in _LOW)}, {", ".join(f"sum({e}) as t{i}" for i, e in _TURNED.items())}, sum({" + ".join(f"b{i} * {e}" for i, e in _TURNED.items())}) as q0 from wt where w11 is not null group by type, class),
iv as (select *, {", ".join(f"{e} as u{i}{j}" for (i, j), e in _inverse("s").items())} from sm),
mn as (select *, {", ".join(f"{e} as m{i}" for i, e in _MEAN.items())} from iv)
select type, class, studies, {", ".join(f"round(m{i}, 5) + 0.0 as b{i}" for i in (1, 2, 3))}, {", ".join(f"round(u{i}{j}, 5) + 0.0 as v{i}{j}" for i, j in _LOW)}, round(greatest(0, q0 - (m1 * t1 + m2 * t2 + m3 * t3)), 5) + 0.0 as q, 3 * (studies - 1) as df from mn""",
}
