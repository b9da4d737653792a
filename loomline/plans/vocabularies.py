"""Queries of the vocabulary operators: raw labels and clips are derived from ``part`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.vocabulary import CLASSES, vocabulary
from loomline.operators import labels
from loomline.plans.registry import query, table


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


_V = "v(name, para, conf, forb, boxes, i) as (values " + ", ".join(f"('{n}', {_list(a)}, {_list(b)}, {_list(c)}, {str(x).lower()}, {i})" for i, (n, a, b, c, x) in enumerate(CLASSES)) + ")"
_ALIASES = [a.replace("_", " ").lower() for n, p, *_ in CLASSES for a in (n, *p)]
_RAW = f"""r as (select p_partkey as k, list_extract({_list(_ALIASES)}, (p_partkey % {len(_ALIASES)} + 1)::int) as a from part),
q as (select k, case k % 6 when 0 then a when 1 then substr(a, 2) when 2 then 'old ' || a || ' on a bench' when 3 then upper(replace(a, ' ', '_')) when 4 then 'kitchen ' || a else 'x' || substr(a, 3) || 'zz' end as raw from r)"""


def _raw(spark, sf_dir):
    k = F.col("p_partkey")
    a = F.element_at(F.array(*map(F.lit, _ALIASES)), (k % len(_ALIASES) + 1).cast("int"))
    raw = (
        F.when(k % 6 == 0, a).when(k % 6 == 1, F.substring(a, 2, 1000)).when(k % 6 == 2, F.concat(F.lit("old "), a, F.lit(" on a bench")))
        .when(k % 6 == 3, F.upper(F.replace(a, F.lit(" "), F.lit("_")))).when(k % 6 == 4, F.concat(F.lit("kitchen "), a)).otherwise(F.concat(F.lit("x"), F.substring(a, 3, 1000), F.lit("zz")))
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), raw.alias("raw"))


@query("label_resolve", rf"""with {_V}, {_RAW},
al as (select name, pos, trim(regexp_replace(lower(replace(a, '_', ' ')), '\s+', ' ', 'g')) as alias from (select name, unnest([name] || para) as a, unnest(range(len(para) + 1)) as pos from v)),
u as (select distinct raw, trim(regexp_replace(lower(replace(raw, '_', ' ')), '\s+', ' ', 'g')) as key from q),
d as (select raw, name, levenshtein(key, alias) as d from u, al where levenshtein(key, alias) <= 2),
n as (select raw, min(d) as least, list(distinct name) as names from d where d = (select min(d) from d e where e.raw = d.raw) group by raw),
s as (select raw, name, arg_min(length(alias), pos) as len from u, al join v using (name) where length(alias) >= 4 and contains(key, alias) and len(list_filter(forb, lambda f: contains(key, f))) = 0 group by raw, name),
t as (select raw, list(name) as names from s where len = (select max(len) from s e where e.raw = s.raw) group by raw)
select k, q.raw, case when n.names is not null then case when len(n.names) = 1 then n.names[1] end when len(t.names) = 1 then t.names[1] end as class,
  case when least = 0 then 'exact' when len(n.names) = 1 then 'edit' when len(n.names) > 1 then 'ambiguous' when len(t.names) = 1 then 'substring' when len(t.names) > 1 then 'ambiguous' else 'none' end as resolution
from q left join n on n.raw = q.raw left join t on t.raw = q.raw""")
def label_resolve(spark, sf_dir):
    return labels.resolve(_raw(spark, sf_dir), "raw", vocabulary(spark)).select("k", "raw", "class", "resolution")


_CLIPS = "c as (select c_custkey as clip, list_sort(list_distinct([n1.name, n2.name])) as labels from customer join v n1 on n1.i = c_custkey % 15 join v n2 on n2.i = (c_custkey * 7 + 3) % 15)"
_HARD = f"""vo as (select clip, u.n as name, count(*) as votes from (select clip, unnest(conf) as n from (select clip, labels, unnest(labels) as l from c) join v on v.name = l) u group by all),
ab as (select c.clip, v.name, v.i, coalesce(votes, 0) as votes from c join v on not list_contains(labels, v.name) left join vo on vo.clip = c.clip and vo.name = v.name),
rk as (select *, row_number() over (partition by clip order by votes desc, case when votes > 0 then name end, i) as k from ab),
h as (select clip, list(name order by k) as hard from rk where k <= 4 group by clip)"""


def _clips(spark, sf_dir):
    names, k = F.array(*(F.lit(x[0]) for x in CLASSES)), F.col("c_custkey")
    at = lambda i: F.element_at(names, (i % 15 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("clip"), F.array_sort(F.array_distinct(F.array(at(k), at(k * 7 + 3)))).alias("labels"))


@query("hard_negatives", f"with {_V}, {_CLIPS}, {_HARD} select clip, array_to_string(hard, ',') as hard_negatives from h")
def hard_negatives(spark, sf_dir):
    return labels.hard_negatives(_clips(spark, sf_dir), vocabulary(spark)).select("clip", F.array_join("hard_negatives", ",").alias("hard_negatives"))


_GENERIC = ["object", "instrument"]


@query("prompt_plan", f"with {_V}, {_CLIPS}, {_HARD}, g as (select clip, labels, hard, greatest(0, 5 - len(labels)) as rest, least(2, greatest(0, 5 - len(labels)) // 2) as n from c join h using (clip)) select clip, array_to_string(list_transform(({_list(_GENERIC)})[1:n] || labels || hard[1:rest - n], lambda x: replace(x, '_', ' ')), ',') as prompts from g")
def prompt_plan(spark, sf_dir):
    c = labels.hard_negatives(_clips(spark, sf_dir), vocabulary(spark))
    return labels.prompt_plan(c, _GENERIC).select("clip", F.array_join("prompts", ",").alias("prompts"))


@query("naming_margin", """with c as (select event_id as det_id, 'class ' || k as label, ((event_id * (k + 3) * 7919) % 1009) / 1009::double as score from events, range(4) t(k) where k <= event_id % 4),
r as (select *, row_number() over w as n, lead(score) over w as nx from c window w as (partition by det_id order by score desc, label))
select det_id, label, round(score, 9) as score, round(score - coalesce(nx, 0), 9) as margin, score >= 0.35::double and score - coalesce(nx, 0) >= 0.10::double as decided from r where n = 1""")
def naming_margin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("det_id"), F.explode(F.sequence(F.lit(0), F.col("event_id") % 4)).alias("k"))
    c = e.select("det_id", F.concat(F.lit("class "), F.col("k")).alias("label"), (F.col("det_id") * (F.col("k") + 3) * 7919 % 1009 / F.lit(1009.0)).alias("score"))
    return labels.name_by_margin(c).select("det_id", "label", F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"), "decided")


@query("classes_without_public_boxes", f"with {_V} select name, i::int as ordinal from v where not boxes")
def classes_without_public_boxes(spark, sf_dir):
    return vocabulary(spark).where("not has_public_boxes").select("name", "ordinal")
