"""The SQL that says the same as the queries of the blueprint's operators."""

from skein.operators.calibration import EDGES
from skein.operators.routing import RAILS

_AUTHOR = "lower(regexp_replace(trim(author_id), '^@+', ''))"
_DM = r"(please\s+(dm|direct\s+message)|send\s+(us|a)\s+(dm|direct\s+message)|click\s+here\s+to\s+chat|please\s+follow\s+(us\s+)?and\s+(dm|direct))"


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\s\p{{Z}}]+'), lambda x: x <> '')"


def _mentions(c: str) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({c}, ''), '@([\p{{L}}\p{{N}}_]+)', 1), lambda x: lower(x))"


def _redirect(c: str) -> str:
    return f"(coalesce(regexp_matches({c}, '{_DM}', 'i'), false) and len({_tokens(c)}) < 25)"


def _draw(seed: int, c: str) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || cast({c} as varchar)), 1, 8) as bigint)"


def _rail(c: str) -> str:
    cases = " ".join("when regexp_matches({}, '{}', 'i') then '{}'".format(c, p.removeprefix("(?i)").replace("'", "''"), name) for name, p in RAILS)
    return f"case {cases} end"


_BRAND = "novafonhelp"
_CLEAN = r"nullif(regexp_extract({0}, '^[\s\x{{a0}}]*(\d+)(?:\.0*)?[\s\x{{a0}}]*$', 1), '')"

_REPORT = f"""select coalesce(o.handle, m.handle) handle, coalesce(outbound_count, 0) outbound_count, coalesce(mention_count, 0) mention_count,
  coalesce(o.handle, m.handle) in (select handle from brand_config where in_known_list) in_known_list
  from (select {_AUTHOR} handle, count(*) outbound_count from twcs where inbound = false and author_id is not null group by 1) o
  full join (select h handle, count(*) mention_count from (select unnest({_mentions('text')}) h from twcs where inbound) group by 1) m on o.handle = m.handle"""

_THREADS = f"""with recursive once as (select tweet_id id, min(author_id) author, min(inbound) inbound, min(created_at) at_, min(text) text from twcs group by 1),
refs as (select tweet_id a, {_CLEAN.format('in_response_to_tweet_id')} b from twcs
  union select tweet_id, {_CLEAN.format('part')} from (select tweet_id, unnest(string_split(coalesce(response_tweet_id, ''), ',')) part from twcs)),
pairs as (select a, b from refs where b is not null union select b, a from refs where b is not null),
reach as (select a id, a low from pairs union select p.b, r.low from reach r join pairs p on p.a = r.id where r.low < p.b),
comp as (select id, min(low) t from reach group by 1),
named as (select o.*, coalesce(comp.t, o.id) t, coalesce(lower(regexp_replace(trim(author), '^@+', '')) = '{_BRAND}', false) brand, coalesce(inbound, false) customer, {_redirect('text')} moved
  from once o left join comp using (id)),
threads as (select t thread_id, count(*) tweet_count, count(*) filter (where customer) customer_turn_count, count(*) filter (where brand and not moved) brand_turn_count,
  bool_or(brand and moved) channel_switch,
  list(text order by at_ nulls first, id) filter (where customer) texts, list(at_ order by at_ nulls first, id) filter (where customer) times, list(id order by at_ nulls first, id) ids
  from named where t in (select t from named where brand) group by 1 having count(*) filter (where customer) > 0 and count(*) filter (where brand and not moved) > 0)"""

_CENTS = """with flat as (select label, unnest(range(len(embedding))) i, unnest(embedding) x from embeddings),
means as (select label, i, avg(cast(x as double)) x from flat group by 1, 2),
norms as (select label, sqrt(sum(x * x)) n from means group by 1),
cents as (select label, i, x / n x from means join norms using (label))"""

_CAL = """with cal as (select thread_id, model_confidence score, cast(predicted_intent = correct_intent as integer) correct
  from golden_set where model_confidence is not null and correct_intent is not null and predicted_intent is not null)"""

_BINS = " ".join(f"when score >= {EDGES[i]!r} and score < {EDGES[i + 1]!r} then {i}" for i in range(10))


def _bm25(docs: str, queries: str) -> str:
    return f"""with docs as ({docs}), queries as ({queries}),
words as (select id, {_tokens('body')} w from docs),
post as (select id, len(w) dl, unnest(w) term from words), tf as (select id, dl, term, count(*) tf from post group by all),
size as (select count(*) n, avg(len(w)) avgdl from words),
df as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from tf, size group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end idf from df),
asked as (select id query_id, term, count(*) times from (select id, unnest({_tokens('body')}) term from queries) group by all),
scores as (select query_id, tf.id doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
  from asked join idf using (term) join tf using (term), size group by all)"""


_INTENTS = _bm25("select name id, concat_ws(' ', description, array_to_string(exemplars, ' ')) body from taxonomy", "select thread_id id, min(first_customer_message) body from labelled group by 1")
_RANK = "row_number() over (partition by query_id order by round(score, 9) desc, doc_id) - 1"
_OVERLAP = "len(list_intersect(qw, dw)) / greatest(1, len(qw))"


def _vector(source: str) -> str:
    """The stand-in encoder's unit vectors of (id, body): words by 16 places."""
    return f"""select id, list_transform(v, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0), 1)) v
  from (select id, list_transform(range(16), lambda i: len(list_filter(p, lambda x: x = i))::double) v
  from (select id, list_transform({_tokens('body')}, lambda w: cast('0x' || substr(md5('0:' || w), 1, 8) as bigint) % 16) p from {source}))"""


_HYBRID = f"""{_INTENTS}, allscores as (select q.id query_id, d.id doc_id, coalesce(score, 0) score from queries q cross join docs d left join scores s on s.query_id = q.id and s.doc_id = d.id),
lex as (select query_id, doc_id, {_RANK} rank from allscores),
qv as ({_vector('queries')}), dv as ({_vector('docs')}),
sims as (select qv.id query_id, dv.id doc_id, list_sum(list_transform(range(1, 17), lambda i: qv.v[i] * dv.v[i])) score from qv, dv),
den as (select query_id, doc_id, {_RANK} rank from sims),
hybrid as (select query_id, doc_id, 0.4 / (61 + lex.rank) + 0.6 / (61 + den.rank) score from lex join den using (query_id, doc_id)),
ranked as (select query_id, doc_id, score, {_RANK} rank from hybrid)"""
_GOLD = f"""with gold as (select *, coalesce({_rail('first_customer_message')} is not null, false) or coalesce(model_confidence, 0.5) < 0.45 escalated from golden_set)"""
_LABELS = f"""{_GOLD}, used as (select correct_intent g, predicted_intent p from gold where correct_intent is not null and predicted_intent is not null),
each as (select g label, g = p hit, true is_gold from used union all select p, g = p, false from used),
labels as (select label, count(*) filter (where hit and is_gold) tp, count(*) filter (where not hit and not is_gold) fp, count(*) filter (where not hit and is_gold) fn from each group by 1),
f1s as (select *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 from labels)"""
_RATINGS = """with base as (select thread_id item, min(calibrated_conf) a, min(knn_margin) b, min(tweet_count) c from labelled group by 1),
ratings as (select item, 'a' rater, cast(least(5, floor(a * 5) + 1) as integer) score from base where a is not null union all
  select item, 'b', cast(least(5, floor(b * 5) + 1) as integer) from base where b is not null union all select item, 'c', least(5, c) from base where c is not null)"""


def _kappa(source: str, by: str, weight: str, digits: int = 6) -> str:
    return f"""cells as (select {by}, a, b, count(*) o from {source} group by all),
labs as (select {by}, label, row_number() over (partition by {by} order by label) i from (select {by}, a label from cells union select {by}, b from cells)),
obs as (select c.*, x.i ia, y.i ib from cells c join labs x on x.{by} = c.{by} and x.label = c.a join labs y on y.{by} = c.{by} and y.label = c.b),
ma as (select {by}, ia, sum(o) m from obs group by all), mb as (select {by}, ib, sum(o) m from obs group by all), tot as (select {by}, sum(o) n from obs group by all),
e as (select ma.{by}, sum({weight} * ma.m * mb.m / n) e from ma join mb on ma.{by} = mb.{by} join tot on tot.{by} = ma.{by} group by all),
w as (select {by}, sum({weight} * o) w, sum(o) n from obs group by all),
k as (select w.{by}, round(coalesce(1 - w / nullif(e, 0), 1.0), {digits}) kappa, cast(n as bigint) n from w join e on w.{by} = e.{by})"""


_PAIRS = f"{_GOLD}, pr as (select 1 one, correct_intent a, predicted_intent b from gold where correct_intent is not null and predicted_intent is not null)"
_POISSON = " + ".join(f"(u >= {c!r})::int" for c in (lambda: [sum(0.36787944117144233 / __import__("math").factorial(j) for j in range(k + 1)) for k in range(12)])())

SQL = {
    "csv_round_trip": "select tweet_id, inbound, epoch_us(date_trunc('second', created_at)) micros, text from twcs where regexp_matches(text, '[^\\s\\p{Z}]')",
    "json_lines_round_trip": "select * from labelled where trim(first_customer_message) <> ''",
    "run_log": "select 'twcs' stage, count(*) n_rows from twcs union all select 'documents', count(*) from documents",
    "brand_json_report": "select '{\"brands\":' || count(*) || ',\"outbound\":' || sum(outbound_count) || '}' json from brand_config",
    "intent_report": """select '| intent | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(knn_label, '') || ' | ' || n || ' |', chr(10) order by knn_label nulls first) markdown
  from (select knn_label, count(*) n from labelled group by 1)""",
    "label_choices": "select string_agg('<Choice value=\"' || name || '\"/>', chr(10) order by name) xml from taxonomy",
    "message_predicates": rf"""select tweet_id, {_AUTHOR} author, {_redirect('text')} dm_redirect,
  coalesce(not regexp_matches(text, '[^\s\p{{Z}}]') or regexp_full_match(text, '\s*(https?://\S+\s*)+'), true) link_or_blank, cast(len({_tokens('text')}) as integer) words,
  cast(len({_mentions('text')}) as integer) n_mentions, coalesce(regexp_matches(text, '[\x{{0400}}-\x{{04FF}}\x{{0600}}-\x{{06FF}}\x{{4E00}}-\x{{9FFF}}]'), false) other_script,
  substring(regexp_replace(regexp_replace(text, '^(@[\p{{L}}\p{{N}}_]+[\s\p{{Z}}]*)+', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), 1, 120) head, {_CLEAN.format('in_response_to_tweet_id')} parent from twcs""",
    "mention_counts": f"select handle, count(*) n from (select unnest({_mentions('text')}) handle from twcs) group by 1",
    "token_counts": f"select token, count(*) n from (select unnest({_tokens('text')}) token from documents) group by 1",
    "rounded_confidence": "select thread_id, floor(calibrated_conf * 10000 + 0.5) / 10000 conf, coalesce(floor(knn_conf * 10000 + 0.5) / 10000, 1.0) raw from labelled",
    "quality_gates": """with v as (select cast(count(*) as double) r, avg((text is not null)::int) t, avg(inbound::int) i from twcs)
  select 'rows' gate, round(r, 6) value, r >= 1000 passed from v union all select 'text_share', round(t, 6), t between 0.9 and 1 from v
  union all select 'inbound_share', round(i, 6), i between 0.02 and 0.35 from v""",
    "cache_keys": """select name, sha256('{"messages":[{"content":"' || description || '","role":"user"}],"model":"stub","params":{},"provider":"local"}') key from taxonomy""",
    "parsed_replies": """with n as (select name, length(description) n from taxonomy)
  select name, case n % 3 when 0 then cast(n % 5 + 1 as integer) when 1 then 4 else 3 end score, case n % 3 when 0 then 'A' when 1 then 'B' else 'tie' end winner,
  case n % 3 when 1 then 't1,' || name else '' end cited from n""",
    "brand_report": _REPORT,
    "top_brands": f"select * from ({_REPORT}) order by outbound_count desc, handle limit 10",
    "time_split": f"""with r as (select created_at from twcs where inbound and tweet_id in (select {_CLEAN.format('in_response_to_tweet_id')} from twcs where {_AUTHOR} = '{_BRAND}'))
  select count(*) filter (where created_at < timestamptz '2017-11-15 00:00:00+00') train, count(*) filter (where created_at >= timestamptz '2017-11-15 00:00:00+00') test from r""",
    "handles_by_use": f"""with authors as (select distinct {_AUTHOR} handle from twcs where author_id is not null),
  every as (select handle from authors union select handle from brand_config union select unnest({_mentions('text')}) from twcs)
  select handle, handle in (select handle from authors) and handle not in (select handle from brand_config) unlisted from every""",
    "uncalibrated_threads": "select distinct thread_id from labelled where thread_id not in (select thread_id from golden_set)",
    "hygiene_blocks": "select lower(substring(text, 1, 15)) prefix, cast(floor(length(text) / 10) as bigint) tens, count(*) n from (select distinct text from documents where text is not null) group by 1, 2 having count(*) > 1",
    "brand_threads": f"""{_THREADS} select thread_id, tweet_count, customer_turn_count, brand_turn_count, channel_switch, texts[1] first_customer_message,
  epoch_us(times[1]) asked_at, cast(ids[1] as bigint) first_id from threads""",
    "thread_averages": f"{_THREADS} select count(*) threads, round(avg(tweet_count), 6) mean_tweets, count(*) filter (where channel_switch) switched from threads",
    "label_centroids": f"{_CENTS} select label, cast(i as integer) i, round(x, 6) x from cents",
    "nearest_centroid": f"""{_CENTS}, ids as (select vec_id, unnest(range(len(embedding))) i, unnest(embedding) x from embeddings),
  sims as (select vec_id, label, round(sum(cast(ids.x as double) * cents.x), 9) sim from ids join cents using (i) group by all),
  ranked as (select *, row_number() over (partition by vec_id order by sim desc, label desc) r from sims)
  select a.vec_id, a.label nearest, round(a.sim, 6) conf, round(a.sim - b.sim, 6) margin from ranked a join ranked b on a.vec_id = b.vec_id and a.r = 1 and b.r = 2""",
    "vector_norms": "select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 6) squared, 1.0::double unit_squared from embeddings",
    "cluster_exemplars": f"select label, vec_id, cast(place as integer) place from (select label, vec_id, row_number() over (partition by label order by {_draw(42, 'vec_id')}, vec_id) place from embeddings) where place <= 10",
    "taxonomy_coverage": """with named as (select min(name) intent, c from (select name, unnest(source_clusters) c from taxonomy) group by c)
  select count(*) total, count(*) filter (where coalesce(intent, 'out_of_scope') <> 'out_of_scope') mapped,
  round(avg((coalesce(intent, 'out_of_scope') <> 'out_of_scope')::int), 6) coverage from embeddings left join named on c = vec_id % 30""",
    "expected_calibration_error": f"""{_CAL}, bins as (select case {_BINS} end b, count(*) n, avg(correct) acc, avg(score) conf from cal group by 1)
  select round(sum(case when b is null then 0 else n * abs(acc - conf) end) / sum(n), 6) ece, cast(sum(n) as bigint) n from bins""",
    "conformal_threshold": f"""{_CAL}, run as (select score, row_number() over w n, sum(1 - correct) over (order by score desc, thread_id rows unbounded preceding) e from cal window w as (order by score desc, thread_id))
  select coalesce(min(score) filter (where round(e / n + sqrt(ln(1 / 0.05) / (2 * n)), 9) <= 0.4), 0.0) tau, count(*) n from run""",
    "isotonic_scores": f"""{_CAL}, pooled as (select score, sum(correct) s, count(*) c from cal group by 1),
  lows as (select a.score i, b.score j, (select sum(s) / sum(c) from pooled x where x.score between a.score and b.score) m from pooled a join pooled b on a.score <= b.score),
  mins as (select k.score k, l.i, min(l.m) m from pooled k join lows l on l.i <= k.score and l.j >= k.score group by 1, 2)
  select k score, round(max(m), 6) calibrated from mins group by 1""",
    "bm25_intents": f"{_INTENTS} select query_id, doc_id, round(score, 6) score from scores",
    "bm25_documents": f"""{_bm25("select doc_id id, text body from documents", "select name id, description body from taxonomy")},
  norm as (select query_id, doc_id, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else score end score from scores),
  ranked as (select *, {_RANK} rank from norm) select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from ranked where rank < 20""",
    "fused_intents": f"{_HYBRID} select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from ranked where rank < 5",
    "fused_metrics": f"""{_HYBRID}, gold as (select thread_id query_id, min(knn_label) doc_id from labelled where knn_label is not null group by 1)
  select round(avg(coalesce(1.0 / (rank + 1), 0)), 6) mrr, round(avg(case when rank < 5 then 1.0 else 0.0 end), 6) recall, round(avg(case when rank < 5 then 1 / log2(rank + 2) else 0.0 end), 6) ndcg, count(*) n
  from gold left join ranked using (query_id, doc_id)""",
    "reranked_intents": f"""{_HYBRID}, pairs as (select query_id, doc_id, list_distinct({_tokens('q.body')}) qw, list_distinct({_tokens('t.description')}) dw
    from ranked r join queries q on q.id = r.query_id join taxonomy t on t.name = r.doc_id where q.body is not null and rank < 20),
  again as (select query_id, doc_id, {_OVERLAP} score from pairs), placed as (select *, {_RANK} rank from again)
  select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from placed where rank < 5""",
    "reranked_documents": f"""{_bm25("select doc_id id, text body from documents", "select name id, description body from taxonomy")},
  norm as (select query_id, doc_id, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else score end score from scores),
  first as (select query_id, doc_id, {_RANK} rank from norm),
  pairs as (select query_id, f.doc_id, list_distinct({_tokens('q.body')}) qw, list_distinct({_tokens('d.text')}) dw from first f join queries q on q.id = f.query_id join documents d on d.doc_id = f.doc_id where rank < 20),
  again as (select query_id, doc_id, {_OVERLAP} score from pairs), placed as (select *, {_RANK} rank from again)
  select query_id, doc_id, score, cast(rank as integer) rank from placed where rank < 5""",
    "dense_neighbours": f"""with u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
  n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) l from u),
  sims as (select q.vec_id query_id, d.vec_id doc_id, list_dot_product(q.v, d.v) / (q.l * d.l) score from n q, n d where q.vec_id % 50 = 0),
  placed as (select *, {_RANK} rank from sims) select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from placed where rank < 20""",
    "retrieval_metrics": f"""{_INTENTS}, lex as (select query_id, doc_id, {_RANK} + 1 r from scores),
  gold as (select thread_id query_id, min(knn_label) doc_id from labelled where knn_label is not null group by 1)
  select round(avg(coalesce(1.0 / r, 0)), 6) mrr, round(avg(case when r <= 5 then 1.0 else 0.0 end), 6) recall, round(avg(case when r <= 5 then 1 / log2(r + 1) else 0.0 end), 6) ndcg, count(*) n
  from gold left join lex using (query_id, doc_id)""",
    "rail_counts": f"select coalesce({_rail('text')}, 'none') reason_code, count(*) n from twcs group by 1",
    "routes": f"""with r as (select {_rail('first_customer_message')} rail, calibrated_conf c, tweet_count t, coalesce(knn_margin, 1.0) m from labelled)
  select case when rail is not null or t = 0 or c < 0.35 then 'escalate' else 'auto_handle' end as action,
  case when rail is not null then rail when t = 0 then 'retrieval_empty' when c < 0.35 then case when m < 0.1 then 'low_intent_confidence' else 'low_calibrated_confidence' end else 'passed_all_gates' end reason_code,
  case when rail is not null then 1 when t = 0 or c < 0.35 then 2 else 3 end layer, count(*) n from r group by 1, 2, 3""",
    "lowest_confidence": "select thread_id, min(coalesce(calibrated_conf, 1.0)) conf from labelled group by 1 order by conf, thread_id limit 60",
    "golden_strata": f"""with base as (select thread_id, min(coalesce(calibrated_conf, 1.0)) conf, max(tweet_count) tweets, min(first_customer_message) m, {_draw(42, 'thread_id')} d from labelled group by 1),
  a as (select thread_id from base order by conf, thread_id limit 60),
  b as (select thread_id from base where thread_id not in (from a) and tweets >= 4 order by d, thread_id limit 40),
  c as (select thread_id from base where thread_id not in (from a) and thread_id not in (from b) and length(m) < 20 order by d, thread_id limit 20),
  e as (select thread_id from base where thread_id not in (from a) and thread_id not in (from b) and thread_id not in (from c) order by d, thread_id limit 80)
  select thread_id, 'low_confidence' stratum from a union all select thread_id, 'long' from b union all select thread_id, 'short' from c union all select thread_id, 'rest' from e""",
    "numbered_batches": f"""with s as (select thread_id from (select distinct thread_id from golden_set) order by {_draw(42, 'thread_id')}, thread_id limit 100)
  select thread_id, cast((row_number() over (order by thread_id) - 1) // 20 as integer) batch from s""",
    "intent_accuracy": f"{_GOLD} select round(avg((correct_intent = predicted_intent)::int), 6) accuracy, count(*) n from gold where correct_intent is not null and predicted_intent is not null",
    "intent_f1": f"{_LABELS} select * from f1s",
    "macro_f1": f"{_LABELS} select round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) macro_f1 from labels",
    "escalation_scores": f"""{_GOLD}, c as (select count(*) filter (where should_escalate and escalated) tp, count(*) filter (where not should_escalate and escalated) fp,
  count(*) filter (where should_escalate and not escalated) fn, count(*) filter (where not should_escalate and not escalated) tn from gold where should_escalate is not null)
  select round((tp + tn) / (tp + fp + fn + tn), 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) over_rate, tp + fp + fn + tn n from c""",
    "accuracy_interval": f"""with h as (select thread_id, max((correct_intent = predicted_intent)::int)::double hit from golden_set group by 1),
  d as (select r, hit, (cast('0x' || substr(md5('42:' || r || ':' || thread_id), 1, 8) as bigint) + 0.5) / 4294967296.0::double u from h, range(1, 2001) t(r) where hit is not null),
  m as (select r, sum(hit * ({_POISSON})) / nullif(sum({_POISSON}), 0) mean from d group by 1)
  select round(quantile_cont(mean, 0.025), 6) lower, round(quantile_cont(mean, 0.975), 6) upper from m""",
    "intent_kappa": f"""select 'none' kind, kappa, n from ({_PAIRS}, {_kappa('pr', 'one', '(ia <> ib)::int')} select * from k)
  union all select 'quadratic', kappa, n from ({_PAIRS}, {_kappa('pr', 'one', 'pow(ia - ib, 2)')} select * from k)""",
    "rater_kappas": f"""{_RATINGS}, pr as (select x.rater || y.rater who, x.score a, y.score b from ratings x join ratings y on x.item = y.item and x.rater < y.rater),
  {_kappa('pr', 'who', 'pow(ia - ib, 2)')} select who[1] rater_a, who[2] rater_b, kappa, n from k""",
    "jury_median": f"{_RATINGS} select item, cast(median(score) as double) median, cast(round_even(avg(score), 0) as integer) vote from ratings group by 1",
    "judge_as_annotator": f"""with ratings as (select * from ({_RATINGS} select * from ratings)), h as (select * from ratings where rater <> 'c'),
  loo as (select item, rater, score, cast(round_even((sum(score) over (partition by item) - score) / (count(*) over (partition by item) - 1), 0) as integer) o, count(*) over (partition by item) n from h),
  human as (select avg(a) a from (select rater, avg((score = o)::int) a from loo where n > 1 group by 1)),
  votes as (select item, cast(round_even(avg(score), 0) as integer) v from h group by 1),
  judge as (select avg((score = v)::int) a, count(*) n from ratings join votes using (item) where rater = 'c'),
  jk as (with pr as (select 1 one, score a, v b from ratings join votes using (item) where rater = 'c'), {_kappa('pr', 'one', 'pow(ia - ib, 2)', 12)} select kappa from k),
  hk as (with pr as (select rater, score a, o b from loo where n > 1), {_kappa('pr', 'rater', 'pow(ia - ib, 2)', 12)} select avg(kappa) kappa, count(*) n from k)
  select round(judge.a, 6) judge_agreement, round(human.a, 6) human_agreement, case when judge.a >= human.a - 0.05 then 'YES' else 'NO' end verdict,
  round(jk.kappa, 6) judge_kappa, round(hk.kappa, 6) human_kappa, judge.n n_items, hk.n n_raters from judge, human, jk, hk""",
    "mean_rater_kappa": f"""{_RATINGS}, pr as (select x.rater || y.rater who, x.score a, y.score b from ratings x join ratings y on x.item = y.item and x.rater < y.rater),
  {_kappa('pr', 'who', 'pow(ia - ib, 2)', 12)} select round(coalesce(avg(kappa), 1.0), 6) kappa, count(*) pairs from k""",
    "win_rate": f"{_RATINGS} select round(avg((x.score > y.score)::int), 6) win_rate, count(*) n from ratings x join ratings y using (item) where x.rater = 'a' and y.rater = 'b'",
    "evaluation_record": f"""{_GOLD}, base as (select *, {_rail('first_customer_message')} is not null railed from gold where correct_intent is not null),
  names as (select list_sort(list(distinct correct_intent)) l from base), top as (select correct_intent t from base group by 1 order by count(*) desc, 1 limit 1),
  every as (select 'agent' system, thread_id, correct_intent g, predicted_intent p, should_escalate ge, escalated e from base
    union all select 'random', thread_id, correct_intent, l[{_draw(7, 'thread_id')} % len(l) + 1], should_escalate, true from base, names
    union all select 'majority', thread_id, correct_intent, t, should_escalate, coalesce(railed, false) from base, top),
  acc as (select system, count(*) n, avg((g = p)::int) accuracy from every where p is not null group by 1),
  hits as (select system, thread_id, max((g = p)::int)::double hit from every where p is not null group by 1, 2),
  d as (select system, r, hit, (cast('0x' || substr(md5('42:' || r || ':' || thread_id), 1, 8) as bigint) + 0.5) / 4294967296.0::double u from hits, range(1, 2001) t(r)),
  m as (select system, r, sum(hit * ({_POISSON})) / nullif(sum({_POISSON}), 0) mean from d group by 1, 2),
  ci as (select system, quantile_cont(mean, 0.025) lower, quantile_cont(mean, 0.975) upper from m group by 1),
  sides as (select system, g label, g = p hit, true is_gold from every where p is not null union all select system, p, g = p, false from every where p is not null),
  f1s as (select system, label, coalesce(2.0 * count(*) filter (where hit and is_gold) / nullif(2 * count(*) filter (where hit and is_gold) + count(*) filter (where not hit), 0), 0) f1 from sides group by 1, 2),
  mf as (select system, avg(f1) macro_f1 from f1s group by 1),
  c as (select system, count(*) filter (where ge and e) tp, count(*) filter (where not ge and e) fp, count(*) filter (where ge and not e) fn, count(*) filter (where not ge and not e) tn from every where ge is not null group by 1)
  select system, n, round(accuracy, 6) accuracy, round(lower, 6) lower, round(upper, 6) upper, round(macro_f1, 6) macro_f1, round((tp + tn) / (tp + fp + fn + tn), 6) flag_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) flag_f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) over_rate from acc join ci using (system) join mf using (system) join c using (system)""",
    "median_interval": f"""with h as (select thread_id, max(tweet_count)::double v from labelled group by 1),
  d as (select r, v, (cast('0x' || substr(md5('42:' || r || ':' || thread_id), 1, 8) as bigint) + 0.5) / 4294967296.0::double u from h, range(1, 201) t(r) where v is not null),
  e as (select r, v, unnest(range({_POISSON})) from d), m as (select r, quantile_cont(v, 0.5) s from e group by 1)
  select quantile_cont(s, 0.025) lower, quantile_cont(s, 0.975) upper from m""",
    "golden_set_rows": f"""with base as (select thread_id, min(coalesce(calibrated_conf, 1.0)) conf, max(tweet_count) tweets, min(first_customer_message) m, {_draw(42, 'thread_id')} d from labelled group by 1),
  a as (select thread_id from base order by conf, thread_id limit 60),
  b as (select thread_id from base where thread_id not in (from a) and tweets >= 4 order by d, thread_id limit 40),
  c as (select thread_id from base where thread_id not in (from a) and thread_id not in (from b) and length(m) < 20 order by d, thread_id limit 20),
  three as (select thread_id, 'low_confidence' stratum from a union all select thread_id, 'long' from b union all select thread_id, 'short' from c),
  e as (select thread_id, row_number() over (order by d, thread_id) nth from base where thread_id not in (select thread_id from three)),
  every as (from three union all select thread_id, 'rest' from e where nth <= 200 - (select count(*) from three))
  select thread_id, stratum, row_number() over (order by {_draw(43, 'thread_id')}, thread_id) <= 50 double_annotate, cast(row_number() over (order by {_draw(44, 'thread_id')}, thread_id) as integer) place from every""",
    "provider_chain": """select sha256('{"messages":[{"content":"' || description || '","role":"user"}],"model":"stub","params":{},"provider":"local"}') key,
  case when length(description) % 2 = 1 then 'last ' else 'late ' end || length(description) response, case when length(description) % 2 = 1 then 'last' else 'late' end provider,
  'spent: BudgetSpent: 50 calls' || case when length(description) % 2 = 1 then '; late: Busy: 429' else '' end errors from taxonomy""",
    "cached_answers": """with p as (select distinct first_customer_message m from labelled where first_customer_message is not null),
  f as (select m in (select first_customer_message from golden_set where first_customer_message is not null) cached from p)
  select case when cached then 'kept' else 'new' end response, 'stub' provider, cached, count(*) n from f group by all""",
    "cache_statistics": "select coalesce(event_type, 'unknown') provider, count(*) n, (select count(*) from events) total from events group by 1",
    "ledger_of_first_day": "select event_type provider, count(*) calls from events where strftime(ts, '%Y-%m-%d') = (select strftime(min(ts), '%Y-%m-%d') from events) and event_type is not null group by 1",
    "second_labeller": f"""with base as (select thread_id, min(knn_label) f, {_draw(42, 'thread_id')} d from labelled group by 1), picked as (select * from base order by d, thread_id limit 300),
  placed as (select *, row_number() over (order by thread_id) - 1 place from picked), names as (select list_sort(list(name)) l from taxonomy)
  select round(avg((f = l[(place % 20) % len(l) + 1])::int), 6) accuracy, count(*) n from placed, names where f is not null""",
    "merged_clusters": "select case when c % 4 < 3 then 'intent_' || c % 4 else 'out_of_scope' end as name, c as cluster from (select distinct vec_id % 30 c from embeddings)",
    "agent_answers": f"""{_INTENTS}, top as (select query_id, doc_id, {_RANK} rank from scores),
  ev as (select query_id, count(*) found, string_agg(doc_id, ',' order by rank) filter (where rank < 3) cited from top where rank < 5 group by 1),
  base as (select thread_id query_id, min(first_customer_message) m, min(calibrated_conf) c, coalesce(min(knn_margin), 1.0) g from labelled group by 1),
  r as (select query_id, {_rail('m')} rail, c, g, coalesce(found, 0) t, coalesce(cited, '') cited from base left join ev using (query_id) where m is not null),
  o as (select *, case when rail is not null or t = 0 or c < 0.35 then 'escalate' else 'auto_handle' end as action from r)
  select query_id, action, case when rail is not null then rail when t = 0 then 'retrieval_empty' when c < 0.35 then case when g < 0.1 then 'low_intent_confidence' else 'low_calibrated_confidence' end else 'passed_all_gates' end reason_code,
  case when action = 'escalate' then '[ESCALATED]' else 'Thank you.' end reply, case when action = 'escalate' then '' else cited end cited from o""",
    "golden_csv_round_trip": "select * exclude (first_customer_created_at), epoch_us(try_cast(first_customer_created_at as timestamptz)) asked_at from golden_set",
    "calibration_record": f"""{_CAL}, bins as (select case {_BINS} end b, count(*) n, avg(correct) acc, avg(score) conf from cal group by 1),
  run as (select score, row_number() over w n, sum(1 - correct) over (order by score desc, thread_id rows unbounded preceding) e from cal window w as (order by score desc, thread_id)),
  t as (select coalesce(min(score) filter (where round(e / n + sqrt(ln(1 / 0.05) / (2 * n)), 9) <= 0.4), 0.0) tau from run)
  select tau, round(sum(case when b is null then 0 else n * abs(acc - conf) end) / sum(n), 6) ece, 0.4::double alpha, 0.05::double delta, cast(sum(n) as bigint) n from bins, t group by tau""",
    "full_report": """with i as (select string_agg('| ' || coalesce(knn_label, '') || ' | ' || n || ' |', chr(10) order by knn_label nulls first) t from (select knn_label, count(*) n from labelled group by 1)),
  d as (select string_agg('| ' || coalesce(k, '') || ' | ' || n || ' |', chr(10) order by k nulls first) t from (select lower(trim(difficulty)) k, count(*) n from golden_set group by 1))
  select '# Report' || chr(10, 10) || '## Intents' || chr(10, 10) || '| intent | n |' || chr(10) || '|---|---|' || chr(10) || i.t || chr(10, 10) || '## Difficulty' || chr(10, 10)
  || '| difficulty | n |' || chr(10) || '|---|---|' || chr(10) || d.t markdown from i, d""".replace("chr(10, 10)", "chr(10) || chr(10)"),
    "swapped_verdicts": f"""with p as (select ['A', 'B', 'tie'][{_draw(1, 'thread_id')} % 3 + 1] a, ['A', 'B', 'tie'][{_draw(2, 'thread_id')} % 3 + 1] b from (select distinct thread_id from labelled)),
  s as (select a, b, case a when 'A' then 'agent_win' when 'B' then 'baseline_win' else 'tie' end x, case b when 'B' then 'agent_win' when 'A' then 'baseline_win' else 'tie' end y from p)
  select case when x = y then x else 'tie' end verdict, a = b same_letter, x = y same_side, count(*) n from s group by 1, 2, 3""",
    "score_correlations": """with u as (select calibrated_conf x, knn_margin y from labelled where calibrated_conf is not null and knn_margin is not null),
  r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry from u)
  select round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman, count(*) n from r""",
    "majority_baseline": """with m as (select correct_intent majority from golden_set where correct_intent is not null group by 1 order by count(*) desc, 1 limit 1)
  select majority, round(avg((correct_intent = majority)::int), 6) accuracy from golden_set, m where correct_intent is not null group by 1""",
    "consistent_labels": "select round(avg(s::int), 6) rate, count(*) n from (select count(distinct knn_label) = 1 s from labelled where knn_label is not null group by thread_id)",
    "call_budget": "select provider, allowed, count(*) n from (select event_type provider, row_number() over (partition by strftime(ts, '%Y-%m-%d'), event_type order by ts, event_id) <= 50 allowed from events) group by 1, 2",
    "call_ledger": "select strftime(ts, '%Y-%m-%d') || '/' || event_type day_key, count(*) calls from events group by 1",
    "cache_misses": """with p as (select distinct first_customer_message m from labelled where first_customer_message is not null),
  c as (select distinct first_customer_message m from golden_set) select 'hit' kind, count(*) n from p where m in (from c) union all select 'miss', count(*) from p where m not in (select m from c where m is not null)""",
}
