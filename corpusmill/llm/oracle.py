"""DuckDB SQL for the queries of this package that SQL can express, written from
what the results are, not from the Spark plans."""

from __future__ import annotations

_TURNS = """
  spoken as (
    select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as n, role, text
    from (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
          from conversations where conv_id is not null and turn is not null)),
  answers as (select conv_id, n, text, row_number() over (partition by conv_id order by n desc) as back from spoken where role = 'assistant'),
  ends as (
    select a.conv_id, a.n as last, coalesce(b.text, '') as stale
    from answers a left join answers b on b.conv_id = a.conv_id and b.back = 2 where a.back = 1),
  turns as (
    select conv_id * 2 as conv_id, n, role, text from spoken
    union all
    select conv_id * 2 + 1, n, role, case when n = last then stale else text end
    from spoken left join ends using (conv_id) where last is null or n <= last),
  pairs as (select distinct conv_id as pair_id from conversations where conv_id is not null),
  first_difference as (
    select pair_id, min(n) as n from (
      select coalesce(a.conv_id // 2, b.conv_id // 2) as pair_id, coalesce(a.n, b.n) as n,
             a.role is not distinct from b.role and a.text is not distinct from b.text as same
      from (select * from turns where conv_id % 2 = 0) a
      full join (select * from turns where conv_id % 2 = 1) b on a.conv_id + 1 = b.conv_id and a.n = b.n)
    where not same group by pair_id),
  cut as (
    select t.conv_id // 2 as pair_id, t.conv_id % 2 = 0 as chosen, t.n, t.role, t.n < coalesce(d.n, 1000000000) as common,
           '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as said, length(t.role) + 13 as skip
    from turns t left join first_difference d on d.pair_id = t.conv_id // 2),
  placed as (
    select *, sum(length(said)) over (partition by pair_id, chosen, common order by n) - length(said) as off from cut),
  parts as (
    select pair_id,
      string_agg(said, '' order by n) filter (chosen and common) as prompt,
      count(*) filter (chosen and common) as n_prompt,
      string_agg(said, '' order by n) filter (chosen and not common) as chosen_completion,
      string_agg((off + skip) || '-' || (off + length(said)), ',' order by n) filter (chosen and not common and role = 'assistant') as chosen_spans,
      string_agg(said, '' order by n) filter (not chosen and not common) as rejected_completion,
      string_agg((off + skip) || '-' || (off + length(said)), ',' order by n) filter (not chosen and not common and role = 'assistant') as rejected_spans
    from placed group by pair_id)"""

OP1 = f"""
with {_TURNS}
select pair_id, pair_id * 2 as chosen, pair_id * 2 + 1 as rejected, coalesce(n_prompt, 0) as n_prompt, coalesce(prompt, '') as prompt,
  coalesce(chosen_completion, '') as chosen_completion, coalesce(chosen_spans, '') as chosen_spans,
  coalesce(rejected_completion, '') as rejected_completion, coalesce(rejected_spans, '') as rejected_spans
from pairs left join parts using (pair_id)
"""

_W = r"[^\x20\x09-\x0D]+"

OP7 = f"""
with d as (
    select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
  windows as (
    select r, i, list_slice(w, i, i + 7) as x from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
  twice as (select r, x from windows group by r, x having count(*) > 1),
  covered as (select r, count(distinct i + k) as n from (select r, i from windows join twice using (r, x)), (select unnest(range(8)) as k) group by r),
  lines as (
    select r, sum(c - 1) as n from (
      select r, line, count(*) as c from (select r, unnest(string_split(t, chr(10))) as line from d)
      where regexp_matches(line, '{_W}') group by r, line) group by r),
  f as (
    select d.r, doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
    from d left join covered using (r) left join lines using (r)),
  rules as (
    select *, n_words < 20 as f_short, 100 * n_repeat_words > 30 * n_words as f_repeat,
      100 * n_symbols > 25 * word_chars as f_symbol, 100 * n_dup_lines > 10 * n_words as f_line from f),
  long_form as (
    select r, source, unnest([f_short, f_repeat, f_symbol, f_line]) as failed, unnest([1, 2, 3, 4]) as rule from rules),
  rates as (select source, rule, count(*) as n, sum(failed::int) as k, avg(failed::int) as rate from long_form group by source, rule),
  moments as (select rule, avg(rate) as m, var_pop(rate) as v from rates group by rule),
  weights as (select rule, m, case when v > 0 and m * (1 - m) > v then m * (1 - m) / v - 1 else 20.0 end as weight from moments),
  hosts as (select source, max((k + weight * m) / (n + weight)) as worst from rates join weights using (rule) group by source)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short or f_repeat as base_failed,
  not (f_short or f_repeat) and worst <= 0.9 and not (worst > 0.5 and (f_symbol or f_line)) as kept
from rules join hosts on rules.source is not distinct from hosts.source
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_A = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '{_A}') as w from documents),
  items as (select distinct item_id, regexp_extract_all({_LOW}, '{_A}') as w from benchmark),
  patterns as (
    select distinct item_id, list_slice(w, i, i + 9) as x, len(list_slice(w, i, i + 9)) as n
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
  sizes as (select distinct n from patterns),
  windows as (
    select r, i, n, list_slice(w, i, i + n - 1) as x
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
  found as (select r, i, n, item_id from windows join patterns using (n, x)),
  words as (select r, count(distinct i + k) as n_hit from (select r, i, unnest(range(n)) as k from found) group by r),
  named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (r) left join named using (r)
"""

OP3 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
  windows as (
    select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as x from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
  hashed as (select r, i, md5(x) as x from windows),
  twice as (select x from hashed group by x having count(*) > 1),
  gone as (select distinct r, i + k as i from (select r, i from hashed join twice using (x)), (select unnest(range(35)) as k)),
  kept as (
    select r, string_agg(word, ' ' order by i) as t, count(*) as n
    from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) anti join gone using (r, i) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""

OP2 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '{_W}') as w from documents),
  shingles as (
    select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) as x
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
  sizes as (select doc_id, count(*) as n from shingles group by doc_id),
  common as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by all),
  links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
  edges as (select a, b from links union select b, a from links),
  reach as (select a as id, a as r from edges union select e.a, reach.r from reach join edges e on e.b = reach.id),
  found as (select id, min(r) as r from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(r, d.doc_id) as component_id, coalesce(r, d.doc_id) = d.doc_id as kept
from d left join sizes on sizes.doc_id = d.doc_id left join found on found.id = d.doc_id
"""

OP5 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as t, octet_length(encode(coalesce(text, ''))) as n from documents),
  windows as (select doc_id, i, md5(substring(t, 2 * i + 1, 200)) as x from (select doc_id, t, unnest(range(n - 99)) as i from d where n >= 100)),
  later as (select doc_id, i from windows qualify row_number() over (partition by x order by doc_id, i) > 1),
  marked as (
    select doc_id, i, coalesce(lag(i) over o + 100 < i, true) as fresh, least(100, coalesce(lead(i) over o - i, 100)) as adds
    from later window o as (partition by doc_id order by i)),
  numbered as (select *, sum(fresh::int) over (partition by doc_id order by i) as k from marked),
  spans as (select doc_id, k, min(i) as a, max(i) + 100 as b, sum(adds) as size from numbered group by doc_id, k),
  gaps as (
    select s.doc_id, k, substring(t, 2 * coalesce(lag(b) over (partition by s.doc_id order by k), 0) + 1,
      2 * (a - coalesce(lag(b) over (partition by s.doc_id order by k), 0))) as piece from spans s join d using (doc_id)),
  cut as (select doc_id, count(*) as n_spans, sum(size) as gone, max(b) as last from spans group by doc_id),
  kept as (
    select doc_id, string_agg(piece, '' order by k) || any_value(substring(t, 2 * last + 1)) as t
    from gaps join cut using (doc_id) join d using (doc_id) group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.t, d.t))) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id)
"""

# CRC-32 of distinct words by its bitwise definition (polynomial 0xEDB88320); h is
# read from hexadecimal digits.
OP11 = f"""
with recursive table_of(b, c, k) as (
    select b, b, 0 from (select unnest(range(256)) as b)
    union all
    select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from table_of where k < 8),
  crc_table as (select list(c order by b) as tab from table_of where k = 8),
  d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '{_A}') as w from documents),
  dw as (select r, word, count(*) as n from (select r, unnest(w) as word from d) group by r, word),
  tw as (select word, count(*) as n from (select unnest(regexp_extract_all({_LOW}, '{_A}')) as word from benchmark) group by word),
  vocabulary as (select word, hex(encode(word)) as h from (select word from dw union select word from tw)),
  steps(word, h, i, crc) as (
    select word, h, 0, 4294967295 from vocabulary
    union all
    select word, h, i + 1, xor(crc >> 8, tab[xor(crc & 255, ('0x' || substr(h, 2 * i + 1, 2))::bigint) + 1])
    from steps, crc_table where 2 * i < length(h)),
  buckets as (select word, xor(crc, 4294967295) % 10000 as bucket from steps where 2 * i = length(h)),
  s as (select bucket, sum(n) as s from dw join buckets using (word) group by bucket),
  t as (select bucket, sum(n) as t from tw join buckets using (word) group by bucket),
  gains as (
    select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::double / ((coalesce(s, 0) + 1) * (t_all + 10000))::double))::bigint as gain
    from s full join t using (bucket),
      (select coalesce(sum(s), 0)::bigint as s_all from s), (select coalesce(sum(t), 0)::bigint as t_all from t)),
  weights as (select r, sum(n * gain)::bigint as weight from dw join buckets using (word) join gains using (bucket) group by r),
  scores as (
    select d.r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
      coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from d left join weights using (r)),
  ranked as (
    select r, row_number() over (order by score desc, doc_id nulls last) as place, floor(10 * count(*) over () / 100) as draws
    from scores where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= draws then place end::bigint as rank, n_features as n_words
from scores left join ranked using (r)
"""

ORACLE: dict[str, str] = {
    "op1_preference_formatting": OP1,
    "op2_minhash_near_dedup": OP2,
    "op3_substring_dedup": OP3,
    "op5_suffix_array_dedup": OP5,
    "op7_quality_rules": OP7,
    "op9_benchmark_decontamination": OP9,
    "op11_importance_resampling": OP11,
}
