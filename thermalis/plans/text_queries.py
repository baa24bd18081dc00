"""Text, label and evaluation queries on the bindings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalis.functions import lexicon, text
from thermalis.operators import evaluation as ev
from thermalis.operators import text_pipeline as tp
from thermalis.plans import bindings as b
from thermalis.plans.rounding import rounded
from thermalis.sources.scratch import saved
from thermalis.sources.tables import stage_summary


def normalize_text(s, d):
    t = b.tweets(s, d)
    return t.select("row_index", F.sha2(text.normalise(F.col("sentence")), 256).alias("words_sha256"), F.sha2(text.normalise(F.col("sentence"), "alnum"), 256).alias("alnum_sha256"), F.size(text.tokens(F.col("sentence"))).cast("long").alias("n_tokens"))


#: A small table of lemmas, of frequent words of the bound texts and of the phrases.
LEMMAS = {"sweating": "sweat", "walked": "walk", "is": "be", "opens": "open", "was": "be", "lexicon": "word"}


def lemmatised_text(s, d):
    """Normal forms whose words are replaced by lemmas."""
    t = b.tweets(s, d)
    return t.select("row_index", F.sha2(text.normalise(F.col("sentence"), lemmas=LEMMAS), 256).alias("lemmas_sha256"))


def candidate_retrieval(s, d):
    out = tp.retrieve_candidates(b.tweets(s, d))
    return out.select("row_index", "retrieval_categories", "has_first_person_cue", "has_outdoor_cue", "has_negation_pattern", "candidate_flag", "candidate_reason", F.coalesce(F.array_join(F.flatten(F.map_values("retrieval_matches")), "|"), F.lit("")).alias("matched_terms"))


def retrieval_reason_counts(s, d):
    out = tp.retrieve_candidates(b.tweets(s, d))
    return out.groupBy("candidate_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "candidate_reason").limit(10)


def rule_filter(s, d):
    out = tp.apply_rules(b.tweets(s, d))
    return out.select("row_index", "rule_filter_pass", "rule_filter_decision", "rule_filter_subcategory", "explicit_personal_exposure", F.size("rule_filter_matches").cast("long").alias("n_hits"))


def rule_summary(s, d):
    out = stage_summary(tp.apply_rules(b.tweets(s, d)), "rule_filter_pass", "rule_filter_decision")
    return out.select("rows", "flagged", F.explode("top_reasons").alias("r")).select("rows", "flagged", "r.reason", "r.n")


def exact_dedup(s, d):
    t = b.tweets(s, d).select("row_index", F.col("text").alias("sentence"))
    return tp.exact_duplicates(t).select("row_index", "duplicate_of")


def rt_qt_filter(s, d):
    return b.tweets(s, d).select("row_index", text.is_repost(F.col("sentence")).cast("int").alias("is_repost"))


def promo_score(s, d):
    return b.tweets(s, d).select("row_index", text.count_of(F.col("sentence"), lexicon.PROMOTION).cast("int").alias("promo_score"))


def account_hygiene(s, d):
    return rounded(tp.account_hygiene(b.tweets(s, d).select("row_index", "author_id", "month", F.col("text").alias("sentence"))))


def shingle_jaccard_pairs(s, d):
    """Similarity of each document with the next one in its block (first word), by five-word shingles."""
    from pyspark.sql import Window

    t = b.tweets(s, d).select("row_index", text.tokens(F.col("text"), "alnum").alias("w"))
    t = saved(t.where("size(w) > 0").withColumn("at", F.monotonically_increasing_id()), "words")
    # neighbours are found among numbers alone, so a frequent first word brings no texts together; then texts are joined
    w = Window.partitionBy("block").orderBy("row_index")
    nxt = t.select("row_index", "at", F.get("w", 0).alias("block")).withColumns({"other": F.lead("row_index").over(w), "next": F.lead("at").over(w)}).where("other is not null")
    nxt = nxt.drop("block").join(t.select("at", "w"), "at").join(t.select(F.col("at").alias("next"), F.col("w").alias("o")), "next")
    return rounded(nxt.select("row_index", "other", text.jaccard(text.shingles(F.col("w")), text.shingles(F.col("o"))).alias("similarity")))


def near_dup_greedy(s, d):
    return tp.greedy_near_duplicates(b.tweets(s, d).select("row_index", F.col("text").alias("sentence")), most=None)


def dedup_funnel(s, d):
    t = b.tweets(s, d).select("row_index", "author_id", "month", F.col("text").alias("sentence"))
    return tp.dedup_funnel(t).select("row_index", "removal_reason", "duplicate_of")


def _labelled(s, d):
    return b.predictions(s, d).join(b.tweets(s, d).select("row_index", "sentence", F.col("author_id").alias("city_id")), "row_index")


def gold_union(s, d):
    t = _labelled(s, d).select("row_index", "sentence", "label")
    both = tp.tagged_union(t.where("row_index % 3 <> 0"), t.where("row_index % 3 = 0"))
    out = both.unionByName(tp.boundary_examples(s).withColumn("original_split", F.lit("boundary")), allowMissingColumns=True)
    return out.groupBy("original_split", "label").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def gold_labels(s, d):
    out = tp.gold_labels(tp.tagged_union(combined=_labelled(s, d).select("row_index", "sentence", "label")), augment=True)
    return out.withColumn("sentence", F.sha2("sentence", 256))


def near_dup_uncapped(s, d):
    """As ``near_dup_greedy``, by MinHash bands and rounds over all blocks at once."""
    return tp.near_duplicates_without_cap(b.tweets(s, d).select("row_index", F.col("text").alias("sentence")))


def removal_log(s, d):
    t = b.tweets(s, d).select("row_index", "author_id", "month", F.col("text").alias("sentence"))
    return tp.removal_log(tp.dedup_funnel(t, user_col="author_id"), "author_id")


def rule_audit(s, d):
    """The rows that the rules remove, by decision, beside those that they keep."""
    ruled = tp.with_relation(tp.apply_rules(b.tweets(s, d)))
    return ruled.groupBy("relation", "rule_filter_decision", "rule_filter_subcategory").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def hygiene_by_created_at(s, d):
    """Account hygiene with months taken from a time stamp, some of which say nothing."""
    stamp = F.when(F.col("row_index") % 11 == 0, "no date").when(F.col("row_index") % 7 > 0, F.concat("month", F.lit("-15 08:30:00")))
    t = b.tweets(s, d).select("row_index", F.col("author_id").alias("username"), stamp.alias("created_at"), F.col("text").alias("sentence"))
    return rounded(tp.account_hygiene(t))


def overall_metrics(s, d):
    return rounded(ev.overall_metrics(b.predictions(s, d)))


def monthly_metrics(s, d):
    return rounded(ev.monthly_metrics(b.predictions(s, d)))


def classification_report(s, d):
    return rounded(ev.classification_report(b.predictions(s, d)))


def fold_summary(s, d):
    folds = ev.monthly_metrics(b.predictions(s, d))
    return rounded(ev.fold_summary(folds))


def class_weights(s, d):
    return rounded(ev.class_weights(b.predictions(s, d)))


def monthly_positive_rate(s, d):
    return rounded(b.predictions(s, d).groupBy("month").agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate")))


def audit_allocation(s, d):
    return ev.audit_allocation(b.predictions(s, d), per_month=20)


def audit_sample(s, d):
    return ev.audit_sample(b.predictions(s, d), per_month=20)


def group_kfold(s, d):
    return ev.group_folds(_labelled(s, d), "city_id", 5)


def baseline_classifier(s, d):
    """Monthly metrics of predictions by models that did not see a row's group."""
    t = _labelled(s, d).select("row_index", "sentence", "label", "month", "city_id")
    return rounded(ev.monthly_metrics(ev.cross_validate(t, "city_id", folds=3)))


QUERIES = {f.__name__: f for f in (normalize_text, lemmatised_text, candidate_retrieval, retrieval_reason_counts, rule_filter, rule_summary, exact_dedup, rt_qt_filter, promo_score, account_hygiene, shingle_jaccard_pairs, near_dup_greedy, near_dup_uncapped, dedup_funnel, removal_log, rule_audit, hygiene_by_created_at, gold_union, gold_labels, overall_metrics, monthly_metrics, classification_report, fold_summary, class_weights, monthly_positive_rate, audit_allocation, audit_sample, group_kfold, baseline_classifier)}

_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in b.PHRASES) + "]"
TWEETS = f"""tweets as (
  select doc_id as row_index, list_extract({_PHRASES}, (doc_id % {len(b.PHRASES)} + 1)::int) || ' ' || coalesce(text, '') as sentence, text, source as author_id, lang as continent,
    strftime(date '2022-03-01' + to_months((doc_id % 12)::int), '%Y-%m') as month
  from documents where doc_id is not null)"""
NORM = "array_to_string(regexp_extract_all(lower(trim({t})), '[{c}]+'), ' ')"
WORDS, ALNUM = "a-zA-Z''", "a-zA-Z0-9''"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, '(?i)(?:{_q('|'.join(patterns))})')"


def _term(t: str) -> str:
    return r"\b" + t.replace(" ", r"\s+") + r"\b"


_LEX = lexicon.POSITIVE_LEXICON
RETRIEVED = f"""with {TWEETS}, n as (select row_index, {NORM.format(t="sentence", c=WORDS)} as n from tweets), f as (
  select row_index, n, {", ".join(f"{_any('n', [_term(t) for t in terms])} as {c}" for c, terms in _LEX.items())},
    {_any("n", lexicon.FIRST_PERSON)} as fp, {_any("n", lexicon.OUTDOOR)} as od, {_any("n", lexicon.NEGATION)} as ng,
    array_to_string(list_filter([{", ".join(f"case when regexp_matches(n, '(?i){_q(_term(t))}') then '{_q(t)}' end" for terms in _LEX.values() for t in terms)}], lambda x: x is not null), '|') as matched_terms
  from n), r as (
  select *, physiological or psychological or coping_individual as strong from f), c as (
  select *, case when ng and not strong then 'negated_heat_expression' when strong then 'strong_positive_lexicon' when ambient_heat and (fp or od) then 'ambient_heat_plus_personal_or_outdoor_cue'
    when ambient_heat then 'ambient_heat_without_personal_cue' else 'no_positive_match' end as candidate_reason from r)"""
_RULES = [(f, s_, p) for f, s_, patterns in lexicon.EXCLUSION_RULES for p in patterns]
_SAFE = lambda p: p
RULED = f"""with {TWEETS}, l as (select row_index, lower(sentence) as t from tweets), h as (
  select row_index, list_filter([{", ".join(f"case when regexp_matches(t, '(?i){_q(p)}') then '{f}:{s_}' end" for f, s_, p in _RULES)}], lambda x: x is not null) as hits,
    {_any("t", lexicon.RULE_FIRST_PERSON)} and ({_any("t", lexicon.RULE_OUTDOOR)} or {_any("t", lexicon.RULE_DEICTIC)} or {_any("t", lexicon.RULE_PHYSIOLOGY)}) as own from l), d as (
  select row_index, (len(hits) = 0 or own)::int as rule_filter_pass, case when len(hits) = 0 then 'pass' when own then 'override_explicit_personal_exposure' else split_part(hits[1], ':', 1) end as rule_filter_decision,
    case when len(hits) = 0 then '' when own then 'override' else split_part(hits[1], ':', 2) end as rule_filter_subcategory, own::int as explicit_personal_exposure, len(hits)::bigint as n_hits from h)"""
PRED = f"{TWEETS}, pred as (select t.row_index, continent, month, quality as label, case when row_index % 3 = 0 then 1 - quality else quality end as pred_label from tweets t join labels l on t.row_index = l.doc_id)"
METRICS = """count(*) as n, round(avg((label = pred_label)::int), 6) as accuracy, round(coalesce(sum((label = 1 and pred_label = 1)::int) / nullif(sum((pred_label = 1)::int), 0)::double, 0), 6) as "precision",
  round(coalesce(sum((label = 1 and pred_label = 1)::int) / nullif(sum((label = 1)::int), 0)::double, 0), 6) as recall, round(coalesce(2.0 * sum((label = 1 and pred_label = 1)::int) / nullif(sum((pred_label = 1)::int) + sum((label = 1)::int), 0)::double, 0), 6) as f1"""
REPORT = """per0 as (select c as class, (select count(*) from pred where label = c) as t, (select count(*) from pred where pred_label = c) as q, (select count(*) from pred where label = c and pred_label = c) as h from (select label as c from pred union select pred_label from pred)),
per as (select class::varchar as class, coalesce(h / nullif(q, 0)::double, 0) as p, coalesce(h / nullif(t, 0)::double, 0) as r, coalesce(2.0 * h / nullif(q + t, 0)::double, 0) as f, t from per0)"""
ALLOC = """n as (select month, continent as stratum, count(*) as n from pred group by all), tt as (select *, sum(n) over (partition by month) as total, least(20, sum(n) over (partition by month)) as target from n),
sh as (select *, round_even(n / total::double * target, 0)::bigint as share from tt), df as (select *, target - sum(share) over (partition by month) as diff, row_number() over (partition by month order by n desc, stratum) - 1 as k, count(*) over (partition by month) as strata from sh)"""



def _near(most: int | None = None) -> str:
    """Greedy near duplicates of w0(row_index, t): a table ``near`` with each row's representative."""
    return f"""w as (select row_index, regexp_extract_all(lower(trim(t)), '[{ALNUM}]+') as w from w0),
n as (select row_index, length(array_to_string(w, ' ')) as n, array_to_string(w[1:4], ' ') || chr(1) || len(w) // 5 || chr(1) || length(array_to_string(w, ' ')) // 20 as block,
  case when len(w) = 0 then [] else list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
p as (select *, row_number() over (partition by block order by row_index) as k, count(*) over (partition by block) as many from n), x as (select * from p where many > 1{f" and k <= {most}" if most else ""}),
r(block, k, row_index, rep, reps) as (
  select block, 1::bigint, row_index, null::bigint, [{{'row_index': row_index, 'n': n, 's': s}}] from x where k = 1
  union all select block, k, row_index, rep, case when rep is null then list_append(reps, {{'row_index': row_index, 'n': n, 's': s}}) else reps end from (
    select x.block, x.k, x.row_index, x.n, x.s, r.reps, list_filter(r.reps, lambda q: abs(q.n - x.n) <= 40 and case when len(list_distinct(list_concat(q.s, x.s))) = 0 then 1 else len(list_intersect(q.s, x.s)) / len(list_distinct(list_concat(q.s, x.s)))::double end >= 0.85)[1].row_index as rep
    from r join x on x.block = r.block and x.k = r.k + 1)),
near as (select row_index, rep from r where rep is not null)"""


#: Accounts of m(author_id, month, t): a table ``hygiene``.
HYGIENE = f"""hx as (select author_id as account, month, {NORM.format(t="t", c=ALNUM)} as norm, {_any("t", lexicon.PROMOTION)}::int as promo from m),
hy as (select *, (count(*) over (partition by account, month, norm) > 1)::int as rep from hx), hygiene as (select account, month, count(*) as posts, avg(rep) as dr, avg(promo) as pr, case when avg(rep) >= 0.8 then 'templated_posting' when avg(promo) >= 0.6 then 'bulk_promotional_behavior' end as hygiene_flag from hy group by all having count(*) >= 5)"""
FUNNEL = f"""{TWEETS}, f0 as (select row_index, author_id, month, coalesce(text, 'nan') as t from tweets),
f1 as (select *, {_any("trim(t)", lexicon.REPOSTS)} as repost, min(row_index) over (partition by {NORM.format(t="t", c=ALNUM)}) as first_row from f0),
f2 as (select *, case when repost then 'rt_or_qt' when first_row < row_index then 'exact_duplicate' end as early from f1),
w0 as (select row_index, t from f2 where early is null), {_near(200)},
f3 as (select f2.*, near.rep, coalesce(early, case when near.rep is not null then 'near_duplicate' end) as reason from f2 left join near on f2.row_index = near.row_index),
m as (select author_id, month, t from f3 where reason is null), {HYGIENE},
final as (select f3.*, hygiene_flag from f3 left join hygiene on f3.author_id is not distinct from account and f3.month = hygiene.month)"""
_LANDS = list(lexicon.CITY_POOL)
#: City, continent and country of the k-th of 60 made-up cities, ten to a continent.
_POOL = f"""'SYN_' || list_extract(list_extract([{", ".join("[" + ", ".join(f"'{c}'" for c in lexicon.CITY_POOL[n]) + "]" for n in _LANDS)}], (k // 10 + 1)::int), (k % 10 % 3 + 1)::int) || printf('_CITY_%03d', k + 1) as city_id, list_extract([{", ".join(f"'{n}'" for n in _LANDS)}], (k // 10 + 1)::int) as continent,
  list_extract(list_extract([{", ".join("[" + ", ".join(f"'{c}'" for c in lexicon.CITY_POOL[n]) + "]" for n in _LANDS)}], (k // 10 + 1)::int), (k % 10 % 3 + 1)::int) as country"""

ORACLE_SQL = {
    "normalize_text": f"with {TWEETS} select row_index, sha256({NORM.format(t='sentence', c=WORDS)}) as words_sha256, sha256({NORM.format(t='sentence', c=ALNUM)}) as alnum_sha256, len(regexp_extract_all(lower(trim(sentence)), '[{WORDS}]+'))::bigint as n_tokens from tweets",
    "lemmatised_text": f"with {TWEETS} select row_index, sha256(array_to_string(list_transform(regexp_extract_all(lower(trim(sentence)), '[{WORDS}]+'), lambda w: case w {' '.join(f"when '{k}' then '{v}'" for k, v in LEMMAS.items())} else w end), ' ')) as lemmas_sha256 from tweets",
    "candidate_retrieval": RETRIEVED
    + f""" select row_index, array_to_string(list_filter([{", ".join(f"case when {c} then '{c}' end" for c in sorted(_LEX))}], lambda x: x is not null), '|') as retrieval_categories, fp::int as has_first_person_cue, od::int as has_outdoor_cue, ng::int as has_negation_pattern,
  (candidate_reason in ('strong_positive_lexicon', 'ambient_heat_plus_personal_or_outdoor_cue'))::int as candidate_flag, candidate_reason, matched_terms from c""",
    "retrieval_reason_counts": RETRIEVED + " select candidate_reason, count(*) as n from c group by 1 order by n desc, candidate_reason limit 10",
    "rule_filter": RULED + " select * from d",
    "rule_summary": RULED + " select (select count(*) from d) as rows, (select sum(rule_filter_pass)::bigint from d) as flagged, rule_filter_decision as reason, count(*) as n from d group by 3 order by n desc, reason limit 10",
    "exact_dedup": f"with x as (select doc_id as row_index, min(doc_id) over (partition by {NORM.format(t="coalesce(text, 'nan')", c=ALNUM)}) as f from documents where doc_id is not null) select row_index, case when f < row_index then f end as duplicate_of from x",
    "rt_qt_filter": f"with {TWEETS} select row_index, {_any('trim(sentence)', lexicon.REPOSTS)}::int as is_repost from tweets",
    "promo_score": f"with {TWEETS} select row_index, ({' + '.join(f"regexp_matches(sentence, '(?i){p}')::int" for p in lexicon.PROMOTION)})::int as promo_score from tweets",
    "account_hygiene": f"""with {TWEETS}, x as (select author_id as account, month, {NORM.format(t="coalesce(text, 'nan')", c=ALNUM)} as norm, {_any("coalesce(text, 'nan')", lexicon.PROMOTION)}::int as promo from tweets),
y as (select *, (count(*) over (partition by account, month, norm) > 1)::int as rep from x), g as (select account, month, count(*) as posts, avg(rep) as dr, avg(promo) as pr from y group by all having count(*) >= 5)
select account, month, posts, round(dr, 6) as dup_ratio, round(pr, 6) as promo_ratio, case when dr >= 0.8 then 'templated_posting' when pr >= 0.6 then 'bulk_promotional_behavior' end as hygiene_flag from g""",
    "shingle_jaccard_pairs": f"""with {TWEETS}, t as (select row_index, regexp_extract_all(lower(trim(text)), '[{ALNUM}]+') as w from tweets), s as (
  select row_index, w[1] as block, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' '))) as s from t where len(w) > 0),
p as (select row_index, s, lead(row_index) over k as other, lead(s) over k as o from s window k as (partition by block order by row_index))
select row_index, other, round(len(list_intersect(s, o)) / len(list_distinct(list_concat(s, o)))::double, 6) as similarity from p where other is not null""",
    "gold_union": f"""with {PRED}, u as (select row_index, label, case when row_index % 3 <> 0 then 'train' else 'test' end as original_split from pred union all select 900001 + i, (i < 4)::int, 'boundary' from range({len(tp.BOUNDARY_EXAMPLES)}) r(i))
select original_split, label::int as label, count(*) as n, min(row_index)::bigint as first_row from u group by all""",
    "overall_metrics": f"with {PRED} select {METRICS} from pred",
    "monthly_metrics": f"with {PRED} select month, {METRICS} from pred group by month having count(distinct label) >= 2",
    "classification_report": f"""with {PRED}, {REPORT} select class, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1, t as support from per
union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(t)::bigint from per union all select 'weighted avg', round(sum(p * t) / sum(t), 6), round(sum(r * t) / sum(t), 6), round(sum(f * t) / sum(t), 6), sum(t)::bigint from per""",
    "fold_summary": f"""with {PRED}, q as (select month, avg((label = pred_label)::int) as a, coalesce(sum((label = 1 and pred_label = 1)::int) / nullif(sum((pred_label = 1)::int), 0)::double, 0) as p,
  coalesce(sum((label = 1 and pred_label = 1)::int) / nullif(sum((label = 1)::int), 0)::double, 0) as r, coalesce(2.0 * sum((label = 1 and pred_label = 1)::int) / nullif(sum((pred_label = 1)::int) + sum((label = 1)::int), 0)::double, 0) as f from pred group by month having count(distinct label) >= 2)
select round(avg(a), 6) as accuracy_mean, round(stddev_pop(a), 6) as accuracy_std, round(avg(p), 6) as precision_mean, round(stddev_pop(p), 6) as precision_std, round(avg(r), 6) as recall_mean, round(stddev_pop(r), 6) as recall_std, round(avg(f), 6) as f1_mean, round(stddev_pop(f), 6) as f1_std from q""",
    "group_kfold": f"""with recursive {TWEETS}, g as (select author_id as city_id, count(*) as n, row_number() over (order by count(*) desc, author_id) as k from tweets t join labels l on t.row_index = l.doc_id where author_id is not null group by author_id),
r(k, city_id, n, fold, loads) as (
  select 0::bigint, null::varchar, 0::bigint, 0::bigint, list_transform(range((select least(5, count(*)) from g)), lambda x: 0::bigint)
  union all select g.k, g.city_id, g.n, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, i: case when i = list_position(loads, list_min(loads)) then v + g.n else v end) from r join g on g.k = r.k + 1)
select city_id, n, fold::int as fold from r where k > 0""",
    "near_dup_greedy": f"with recursive w0 as (select doc_id as row_index, coalesce(text, 'nan') as t from documents where doc_id is not null), {_near()} select row_index, rep as near_duplicate_of from near",
    "near_dup_uncapped": f"with recursive w0 as (select doc_id as row_index, coalesce(text, 'nan') as t from documents where doc_id is not null), {_near()} select row_index, rep as near_duplicate_of from near",
    "dedup_funnel": f"with recursive {FUNNEL} select row_index, coalesce(reason, hygiene_flag) as removal_reason, case when reason = 'exact_duplicate' then first_row when reason = 'near_duplicate' then rep end as duplicate_of from final",
    "removal_log": f"""with recursive {FUNNEL} select row_index, coalesce(reason, hygiene_flag) as removal_reason, case when reason = 'exact_duplicate' then first_row when reason = 'near_duplicate' then rep end as duplicate_of,
  case reason when 'rt_or_qt' then 'pattern match' when 'exact_duplicate' then 'normalized text duplicate' when 'near_duplicate' then 'jaccard>=0.85' else 'user_col=author_id' end as notes from final where coalesce(reason, hygiene_flag) is not null""",
    "rule_audit": RULED + " select case when rule_filter_pass = 1 then 'kept' else 'audit' end as relation, rule_filter_decision, rule_filter_subcategory, count(*) as n, min(row_index) as first_row from d group by all",
    "hygiene_by_created_at": f"with {TWEETS}, m as (select author_id, case when row_index % 11 <> 0 and row_index % 7 > 0 then month else 'unknown' end as month, coalesce(text, 'nan') as t from tweets), {HYGIENE} select account, month, posts, round(dr, 6) as dup_ratio, round(pr, 6) as promo_ratio, hygiene_flag from hygiene",
    "gold_labels": f"""with {PRED}, pool as (select k, {_POOL} from range(60) p(k)),
x as (select t.row_index, t.sentence, quality as label, md5('42:' || t.row_index) as h from tweets t join labels l on t.row_index = l.doc_id),
y as (select *, ('0x' || substr(h, 1, 2))::int % 64 as s from x), z as (select *, row_number() over (partition by label, s order by h, row_index) - 1 + s as j from y),
o as (select sample_id, sentence, label, i from (select unnest([{", ".join(f"{{'s': '{_q(t)}', 'l': {y}, 'c': '{c}'}}" for t, y, c in tp.BOUNDARY_EXAMPLES)}]) as e, unnest(range({len(tp.BOUNDARY_EXAMPLES)})) as i) q, lateral (select e.c as sample_id, e.s as sentence, e.l as label))
select printf('sample_%06d', row_index + 1) as sample_id, (row_index + 100001)::varchar as tweet_id, sha256(sentence) as sentence, label::int as label, city_id, continent, country, strftime(date '2022-03-01' + to_months(((j + label) % 12)::int), '%Y-%m') as month,
  'combined' as original_split, 'X' as source_platform, 1 as metadata_is_synthetic, 1 as needs_metadata_backfill, 0 as is_synthetic_example, '' as synthetic_example_type, row_index from z join pool on k = j % 60
union all select printf('synthetic_boundary_%03d', i + 1), (900001 + i)::varchar, sha256(sentence), label, city_id, continent, country, strftime(date '2022-03-01' + to_months(i::int), '%Y-%m'), 'synthetic_boundary', 'X', 1, 1, 1, sample_id, null from o join pool on k = i""",
    "audit_sample": f"""with {PRED}, {ALLOC}, take as (select month, stratum, least(n, greatest(0, share + sign(diff) * (abs(diff) // strata + (k < abs(diff) % strata)::int)))::bigint as n_take from df),
r as (select pred.*, n_take, row_number() over (partition by pred.month, continent order by md5('42:' || row_index), row_index) as r from pred join take on pred.month = take.month and continent = stratum)
select row_index, continent, month, label, pred_label, '' as manual_label, '' as manual_review_notes, 'pending' as audit_status from r where r <= n_take""",
    "class_weights": f"with {PRED}, k as (select label, count(*) as n_class from pred group by label) select label, n_class, round((select count(*) from pred) / ((select count(*) from k) * n_class)::double, 6) as class_weight from k",
    "monthly_positive_rate": f"with {PRED} select month, count(*) as n, round(avg(label), 6) as positive_rate from pred group by month",
    "audit_allocation": f"""with {PRED}, {ALLOC} select month, stratum, n, least(n, greatest(0, share + sign(diff) * (abs(diff) // strata + (k < abs(diff) % strata)::int)))::bigint as n_take from df""",
}
