"""DuckDB statements for the queries of this subpackage that SQL expresses."""

from __future__ import annotations

from .licenses import BLOCK, PHRASES, STEP, TEMPLATES, token_set
from .line_dedup import MIN_WORDS
from .quality import BOILERPLATE, MAX_LOST, MAX_REPEATED
from .quality import MIN_WORDS as LEAST_WORDS

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1 = rf"""
with lines as (
  select doc_id, i, l, nw, sum(nw) over (partition by doc_id order by i) as c from (
    select doc_id, i, ls[i] as l, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) as nw
    from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), unnest(range(1, len(ls) + 1)) t(i))),
spans as (
  select a.doc_id, a.i as s, min(b.i) as e from lines a join lines b on b.doc_id = a.doc_id and b.i >= a.i and b.c - a.c + a.nw >= {MIN_WORDS}
  group by all
  union
  select b.doc_id, max(a.i), b.i from lines a join lines b on b.doc_id = a.doc_id and b.i >= a.i and b.c - a.c + a.nw >= {MIN_WORDS}
  group by b.doc_id, b.i),
runs as (
  select p.doc_id, p.s, p.e, string_agg(l.l, chr(10) order by l.i) as content
  from spans p join lines l on l.doc_id = p.doc_id and l.i between p.s and p.e group by all),
later as (
  select doc_id, s, e from runs qualify row_number() over (partition by content order by doc_id, s) > 1),
gone as (
  select distinct l.doc_id, l.i from lines l join later r on r.doc_id = l.doc_id and l.i between r.s and r.e),
left_over as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
         coalesce(string_agg(l.l, chr(10) order by l.i) filter (where g.i is null), '') as text
  from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_removed, 0) as n_removed, r.text
from documents d left join left_over r on r.doc_id = d.doc_id"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strings(words) -> str:
    return "[" + ", ".join(_sql(w) for w in words) + "]"


def _op5() -> str:
    templates = ",\n  ".join(f"({_sql(label)}, {threshold}, {_strings(sorted(t.decode() for t in token_set(text)))})"
                             for label, threshold, text in TEMPLATES)
    places = "\n  union all\n  ".join(
        f"select doc_id, {_sql(label)} as label, p - 1 as p from d, unnest(range(1, n + 1)) t(p) "
        f"where ws[p] = {_sql(w[0])} and ws[p:p + {len(w) - 1}] = {_strings(w)}"
        for label, phrase in PHRASES for w in [phrase.split()])
    return rf"""
with d as (select doc_id, ws, len(ws) as n from (select doc_id, {WORDS} as ws from documents)),
templates(label, threshold, tokens) as (values
  {templates}),
base as (
  {places}),
blocks as (
  select doc_id, list_distinct(ws[s + 1:s + {BLOCK}]) as b from d, unnest(range(0, n, {STEP})) t(s)
  where s = 0 or s + {BLOCK - STEP} < n),
found as (
  select doc_id, label, len(list_intersect(b, tokens)) as shared, len(tokens) as size, threshold
  from blocks join templates on list_has_any(b, tokens)),
matched as (select doc_id, label, cast(shared as double) / size as part from found where shared >= ceil(threshold * size - 1e-9)),
based as (
  select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
labelled as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from base union select doc_id, label from matched) group by doc_id),
scored as (select doc_id, max(part) as part from matched group by doc_id)
select d.doc_id, d.n as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, case when n_base is not null then 1.0 else coalesce(part, 0.0) end::double as score
from d left join based using (doc_id) left join labelled using (doc_id) left join scored using (doc_id)"""


OP10 = rf"""
with items as (select coalesce(item_id::varchar, '') as item_id, {WORDS} as ws from benchmark),
windows as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k:k + 9], ' ') as win
  from items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(k) where len(ws) > 0),
d as (select doc_id, {WORDS} as ws from documents),
places as (
  select doc_id, k, s.n, array_to_string(ws[k:k + s.n - 1], ' ') as win
  from d cross join (select distinct n from windows) s, unnest(range(1, len(ws) - s.n + 2)) t(k)),
hits as (select p.doc_id, p.k, p.n, w.item_id from places p join windows w on w.n = p.n and w.win = p.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by doc_id)
select d.doc_id, len(d.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (doc_id) left join named using (doc_id)"""

OP7 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
sized as (
  select *, 20 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])'))
            + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) as chars from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars, false as rewrites
from sized group by conv_id"""

OP8 = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
grams as (select doc_id, k, array_to_string(ws[k:k + 4], ' ') as g from d, unnest(range(1, len(ws) - 3)) t(k)),
twice as (select doc_id, k from grams qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 5)) as p from twice) group by doc_id),
lines as (
  select doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as ws, len(ws) as n, length(l) - length(replace(l, '|', '')) as pipes,
         len(regexp_extract_all(l, '[#*$%&|<>]')) as symbols, length(l) - length(replace(l, '!', '')) as cries,
         translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
         regexp_matches(l, '[.!?:;"'')”…][\x20\x09-\x0D]*$') as ended
  from (select doc_id, unnest(string_split(text, chr(10))) as l from d)),
judged as (
  select doc_id, l, n, n > 0 and (
    n < 25 and regexp_matches(low, {_sql('|'.join(p.decode() for p in BOILERPLATE))})
    or symbols >= greatest(3, n * 0.5)
    or pipes > 0 and pipes * 3 >= n
    or not ended and n < 10 and (pipes > 0 or contains(l, '»'))
    or not ended and n < 5 and regexp_matches(low, '^[\x20\x09-\x0D]*(home|menu|next|previous|back|share|search)\b')
    or n >= 5 and not regexp_matches(l, '\p{{L}}')
    or n >= 8 and list_max(map_values(list_aggregate(ws, 'histogram'))) * 2 > n
    or n >= 8 and len(list_filter(ws, lambda w: strlen(w) > 1 and regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]'))) * 2 > n
    or n >= 4 and cries * 2 > n
    or n >= 40 and not regexp_matches(l, '[.!?;:]')) as bad
  from lines),
by_doc as (
  select doc_id, count(*) filter (n > 0) - count(distinct l) filter (n > 0) as dup, coalesce(sum(n) filter (bad), 0) as gone
  from judged group by doc_id),
counted as (
  select d.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, dup as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         len(ws) < {LEAST_WORDS} or 100 * coalesce(c.n, 0) > {MAX_REPEATED} * len(ws) as base_failed,
         case when len(ws) = 0 then 0.0 else cast(gone as double) / len(ws) end::double as lost
  from d join by_doc using (doc_id) left join covered c using (doc_id))
select *, not base_failed and lost <= {MAX_LOST} as kept from counted"""

OP11 = rf"""
with d as (select doc_id, ws, len(ws) as n from (select doc_id, {WORDS} as ws from documents)),
totals as (select count(*) filter (n > 0) as nd, cast(sum(n) as bigint) as nl from d),
items as (
  select item_no, item_id, t, count(*) as c from (select row_number() over () as item_no, item_id, unnest({WORDS}) as t from benchmark)
  group by all),
tf as (
  select doc_id, n, t, count(*) as tf from (select doc_id, n, unnest(ws) as t from d) where t in (select t from items) group by all),
weights as (
  select t, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * df + 1))) as bigint) as w
  from (select t, count(*) as df from tf group by t), totals),
scores as (
  select item_no, item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nl)))) as bigint) as score
  from items join tf using (t) join weights using (t), totals group by all)
select item_id, cast(row_number() over (partition by item_no order by score desc, doc_id) as int) as rank, doc_id, score
from scores where score > 0 qualify rank <= 10"""

OP13 = """
with e as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as k from e),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(sum(a.x * b.x) as bigint) as score
  from parts a join parts b using (k) where a.vec_id % 100 = 0 group by a.vec_id, b.vec_id, a.label, b.label),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scores where same and other_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as int) as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not same
  and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5"""

ORACLE_SQL = {
    "op1_line_dedup": OP1, "op5_license_scan": _op5(), "op7_chat_formatting": OP7, "op8_quality_rules": OP8,
    "op10_decontamination": OP10, "op11_ranked_search": OP11, "op13_hard_negatives": OP13,
}
