"""The same queries as DuckDB SQL over the same tables, for checking.

Written on its own terms (loops over lists, ranked subqueries), not derived
from the Spark plans. Queries without an entry need a walk of unknown depth
and are checked against brute force in the tests.
"""

from __future__ import annotations

from corpusmill.functions import fixed_values as fv

_WS = r"[\t\n\x{b}\x{c}\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_PHONE = r"\+?[0-9][0-9\-\s]{7,}[0-9]"
_AS_OF = "timestamp '2000-01-01'"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _strip(c: str) -> str:
    """Trim white space of any kind."""
    return f"regexp_replace(regexp_replace({c}, '^{_WS}', ''), '{_WS}$', '')"


def _prefix(c: str, limit: int) -> str:
    """Whole characters within a byte limit."""
    fits = f"list_max(list_filter(range({limit // 4}, {limit + 1}), lambda n: strlen({c}[1:n]) <= {limit}))"
    return f"case when strlen({c}) <= {limit} then {c} else {c}[1:{fits}] end"


def _redact(c: str) -> str:
    return (
        f"regexp_replace(regexp_replace({c}, '{_EMAIL}', '{fv.EMAIL_MARK}', 'g'), '{_PHONE}', '{fv.PHONE_MARK}', 'g')"
    )


def _sentence(c: str) -> str:
    return f"case when {c} = '' or right({c}, 1) in ('.', '!', '?') then {c} else {c} || '.' end"


def _supported(c: str) -> str:
    return f"case when {c} in ('fr','de','it','rm','en') then {c} else '' end"


def _highlight_ctes(source: str, key: str, text: str) -> str:
    """CTEs ending in ``snip(key, snippet)``."""
    return f"""
  flat as (select {key} as k, {_squeeze(text)} as t from {source}),
  headed as (select k, t, {_prefix('t', 220)} as h from flat),
  placed as (select *, length(h) - length(string_split(h, ' ')[-1]) - 1 as cut from headed),
  snipped as (
    select k, trim(case when strlen(t) <= 220 then t
      when cut > 0 and strlen(h[1:cut]) > 40 then h[1:cut] else h end) as s from placed),
  snip as (select k, {_sentence('s')} as snippet from snipped)"""


_DOCS = f"""
  docs as (
    select doc_id, lower(source) || ':' || doc_id as document_id, lang, 'Document ' || doc_id as title, text as content,
      '/' || lang || '/' || source || '/' || doc_id || '.txt' as source_path, source as source_system,
      'https://' || source || '.example.org/' || doc_id as source_uri, cast(doc_id as varchar) as external_id,
      case when lang = 'fr' then timestamp '2024-01-01' + to_minutes(n_chars) end as modified_at,
      lower(source) || ':' || doc_id || ':' || case when {_supported('lang')} = '' then 'fr' else lang end as translation_id
    from documents)"""

_WORDS = f"""
  worded as (
    select *, list_filter(string_split({_squeeze('content')}, ' '), lambda w: w <> '') as words from docs)"""


def _chunks(size: int = 768, step: int = 653) -> str:
    return f"""{_DOCS},{_WORDS},
  starts as (
    select * exclude (words), words, unnest(range(0, len(words), {step})) as s from worded),
  chunks as (
    select replace(replace(translation_id, ':', '_'), ' ', '_') || '_chunk_' || lpad(cast(s // {step} as varchar), 4, '0') as chunk_id,
      document_id, lang, title, source_path, source_system, source_uri, cast(s // {step} as integer) as part,
      array_to_string(words[s + 1:s + {size}], ' ') as content,
      cast(least({size}, len(words) - s) as integer) as token_count
    from starts where s = 0 or s - {step} + {size} < len(words))"""


_EMBED = """list_transform(range(0, 128), lambda i: cast(
    cast(('0x' || substr(sha256(cast(i as varchar) || ':' || {t}), 1, 8)) as ubigint) / 4294967295.0 * 2.0 - 1.0 as float))"""


def _embed(t: str) -> str:
    return _EMBED.replace("{t}", t)


_SIGNATURE = (
    "'lang=' || language || '|votation=|object=|canton=|ragMode=local|embedder=deterministic|"
    "summarizer=deterministic|topK=5'"
)
_ASKED = f"""
  asked as (
    select conv_id * 1000 + turn as question_id, {_strip('text')} as raw,
      case when turn = 0 then 'de' else 'en-gb' end as language
    from conversations where role = 'user'),
  cut as (select question_id, language, raw as c from asked),
  signed as (
    select question_id, language, {_strip(_redact('c'))} as question, {_SIGNATURE} as signature from cut),
  keyed as (
    select *, sha256(signature) as context_hash, sha256(question || '|' || signature || '|exact-v1') as exact_key,
      sha256(sha256(question) || '|' || sha256(signature) || '|semantic-v1') as semantic_key from signed)"""

_HITS = f"""{_chunks()},{_ASKED},
  work as (select distinct exact_key, question, language from keyed),
  qv as (select exact_key, {_embed('question')} as v from work where question <> ''),
  cv as (select chunk_id, {_embed('content')} as v from chunks),
  scored as (
    select exact_key, chunk_id, round(list_cosine_similarity(cast(qv.v as double[]), cast(cv.v as double[])), 10) as score
    from qv, cv),
  ranked as (
    select *, row_number() over (partition by exact_key order by score desc, chunk_id) as rank from scored),
  hits as (select r.*, c.* exclude (chunk_id) from ranked r join chunks c using (chunk_id) where rank <= 5)"""

_CATALOG = f"""
  dated as (
    select o.*, c.*, case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderdate end as vote_date
    from orders o join customer c on o_custkey = c_custkey),
  cat as (
    select 'orders:' || o_orderkey as id, 'orders' as source_system,
      'https://www.' || lower(o_orderstatus) || '.admin.ch/' || o_custkey as source_uri,
      'v' || o_custkey as votation_id,
      case when o_orderpriority = '5-LOW' then '' else 'Obj/' || o_custkey || '.' || o_orderpriority[1:1] end as object_id,
      case o_orderstatus when 'F' then 'federal' when 'O' then 'cantonal' else 'communal' end as level,
      'N' || chr(c_nationkey + 65) as canton,
      case when o_orderstatus = 'P' then cast(c_nationkey as varchar) else '' end as commune_code,
      case when vote_date > {_AS_OF} then 'upcoming' else 'past' end as status,
      o_orderpriority[3:] as object_type, c_mktsegment as object_theme, vote_date, c_name as source_org,
      o_orderpriority[1:1] as priority, o_orderstatus
    from dated)"""

_WRITES = """
  writes as (
    select 'orders:' || l_orderkey as document_id, (['fr','de','it','rm','en','es','pt'])[l_linenumber] as lang,
      'Title ' || l_partkey as title, 'Text of ' || l_partkey || ' by ' || l_suppkey as content_normalized,
      case when l_returnflag = 'A' then 'Shown ' || l_partkey else 'Title ' || l_partkey end as display_title,
      case when l_linestatus = 'F' then 'ready' else 'pending' end as status,
      l_shipdate as written_at, l_partkey as sequence, l_suppkey as writer, l_returnflag as flag, l_linestatus as line
    from lineitem)"""

_NEWEST = "written_at desc, sequence desc, writer desc, flag, line"

_TRANSLATIONS = f"""{_WRITES},
  tr as (
    select * from writes
    qualify row_number() over (partition by document_id, lang order by {_NEWEST}) = 1)"""

_PAGE_FILTER = "votation_id <> '' and vote_date >= timestamp '1996-01-01' and level = 'cantonal'"


def _items(chosen: str, first: str, requested: str) -> str:
    """CTEs from ``rows`` on; ends in ``items``."""
    return f"""
  rws as ({chosen}),
  firsts as (
    select * from rws qualify row_number() over (partition by votation_id order by {first}) = 1),
  named as (
    select votation_id, lang, arg_min(title, id) as title, arg_min(display_title, id) as display_title
    from rws group by all),
  maps as (
    select votation_id, array_to_string(list(lang || '=' || title order by lang), '|') as titles,
      list(lang order by lang) as langs, list(display_title order by lang) as shown
    from named group by votation_id),
  picked as (
    select f.*, m.titles, langs, shown, list_contains(langs, '{requested}') as ready,
      case when list_contains(langs, 'en') then 'en' else langs[1] end as fb
    from firsts f join maps m using (votation_id)),
  filled as (
    select *, case when ready then langs else list_concat(langs, ['{requested}']) end as l2,
      case when ready then shown else list_concat(shown, [shown[list_position(langs, fb)]]) end as s2 from picked),
  items as (
    select votation_id, strftime(coalesce(vote_date, {_AS_OF}), '%Y-%m-%dT%H:%M:%SZ') as date_iso, level, canton,
      commune_code, status, '{requested}' as language, titles,
      array_to_string(list_sort(list_transform(range(1, len(l2) + 1), lambda i: l2[i] || '=' || s2[i])), '|') as display_titles,
      case when ready then 'ready' else 'pending' end as translation_state,
      case when not ready then fb end as fallback_language
    from filled)"""


_JOINED = "select cat.*, lang, title, display_title from cat join tr on cat.id = tr.document_id"


def _page_rows(condition: str, limit: int, offset: int) -> str:
    return f"""
  heads as (
    select votation_id, bool_or(vote_date is null) as undated, max(vote_date) as newest
    from cat where {condition} and id in (select document_id from tr) group by votation_id
    order by undated desc, newest desc nulls last, votation_id limit {limit} offset {offset}),
  chosen as ({_JOINED} where {condition} and votation_id in (select votation_id from heads))"""


_FIRST = "vote_date desc nulls first, lang, id"
_PAGED = f"with {_CATALOG},{_TRANSLATIONS},{_page_rows(_PAGE_FILTER, 50, 20)},{_items('from chosen', _FIRST, 'rm')}"
_UNDATED = f"with {_CATALOG},{_TRANSLATIONS},{_page_rows('true', 100, 0)},{_items('from chosen', _FIRST, 'it')}"
_ROW_PAGED = f"""with {_CATALOG},{_TRANSLATIONS},
  chosen as ({_JOINED} where {_PAGE_FILTER} order by vote_date desc nulls first, votation_id, lang, id limit 50 offset 20),
  {_items('from chosen', _FIRST, 'rm')}"""
_DETAIL = f"with {_CATALOG},{_TRANSLATIONS},{_items(_JOINED, "lang = 'de' desc, lang, id", 'de')}"

_USAGE = f"""
  raw as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events),
  u0 as (
    select 'evt_' || lpad(cast(event_id as varchar), 12, '0') as event_id, ts as created_at,
      case when event_type in ('view','click') then 'qa_query' else 'rag_index' end as flow,
      case when event_type = 'click' then 'summarization' when event_type in ('error','purchase') then 'translation'
        else 'embedding' end as operation,
      case when k < 50 then 'local' else 'llm' end as mode,
      case when k < 10 then 'unknown' else 'model-x' end as provider_name,
      'm' || cast(k as varchar)[1:1] as model_name, '' as run_id, '' as request_id,
      'doc-' || user_id as document_id, 'en' as source_lang,
      case when k < 30 then 'fr' when k < 60 then 'de' when k < 80 then 'en' else 'it' end as target_lang,
      cast(greatest(k * 4 - 40, 0) as bigint) as input_chars, cast(k * 2 as bigint) as output_chars,
      cast(k as bigint) as input_tokens, cast(k // 2 as bigint) as output_tokens,
      cast(case when k < 20 or k * 2 = 0 then k + k // 2 else k * 2 end as bigint) as total_tokens,
      'provider' as usage_source, case when event_type = 'error' then 'error' else 'success' end as status,
      cast(round(value * 10) as bigint) as duration_ms, '' as error_code
    from raw),
  daily as (
    select cast(created_at as date) as day, flow, operation, mode, model_name, provider_name,
      count(*) as events_count, count(*) filter (status = 'success') as success_count,
      count(*) filter (status <> 'success') as error_count, cast(sum(input_chars) as bigint) as input_chars_sum,
      cast(sum(output_chars) as bigint) as output_chars_sum, cast(sum(input_tokens) as bigint) as input_tokens_sum,
      cast(sum(output_tokens) as bigint) as output_tokens_sum, cast(sum(total_tokens) as bigint) as total_tokens_sum,
      cast(sum(duration_ms) as bigint) as duration_ms_sum
    from u0 group by all)"""

_HASH = f"sha256(lang || '|' || title || '|' || {_squeeze('content')})"
_SOURCE_HASH = f"sha256(lang || '|' || title || '|' || {_strip('content')})"
_FINGERPRINT = """sha256(source_system || '|' || external_id || '|' || source_uri || '||' ||
    coalesce(strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ'), ''))"""
_EXPECTED = "cast(case when {n} = 0 then 0 else 1 + greatest(0, ceil(({n} - {size}) / {step}.0)) end as integer)"


def _expected(size: int, step: int, n: str = "n") -> str:
    return _EXPECTED.format(size=size, step=step, n=n)


_DECIDED = f"""with {_DOCS},{_WORDS},
  facts as (
    select document_id, lang, len(words) as n, {_HASH} as h, {_FINGERPRINT} as fp,
      modified_at is not null as high, doc_id from worded),
  stored as (
    select f.*, l.quality = 1 as complete, {_expected(768, 653)} as held,
      case when lang = 'es' then 'pending' else 'ready' end as status,
      case when toxic = 1 then 'stale' else h end as old_hash
    from facts f join labels l using (doc_id)),
  decided as (
    select f.document_id, f.lang, {_expected(768, 653, 'f.n')} as expected_chunks,
      case when s.document_id is null then 'new' when not s.complete then 'incomplete'
        when f.n = 0 then 'chunk_count' when s.status <> 'ready' then 'translation'
        when f.high then 'same_source' when s.old_hash = f.h then 'same_content' else 'changed' end as reason
    from facts f left join stored s on f.document_id = s.document_id)"""


def _count_words(words: list[str]) -> str:
    return " + ".join(f"cast(contains(lower(text), '{w}') as integer)" for w in words)


def _language_code(c: str) -> str:
    return f"case when regexp_matches({c}, '{fv.LANGUAGE_CODE}') then {c} else '' end"


def _message(messages: dict[str, str], c: str) -> str:
    cases = " ".join(f"when '{lang}' then '{text.replace(chr(39), chr(39) * 2)}'" for lang, text in messages.items())
    return f"case {c} {cases} else '{messages['fr'].replace(chr(39), chr(39) * 2)}' end"


_LANGS = "(values ('fr'), ('de'), ('it'), ('rm'), ('en')) as t(code)"

ORACLE: dict[str, str] = {
    "chunk_documents": f"with {_chunks()} select chunk_id, document_id, lang, part, token_count, sha256(content) as content_sha from chunks",
    "chunk_documents_512": f"with {_chunks(512, 461)} select chunk_id, token_count, sha256(content) as content_sha from chunks",
    "expected_chunk_count": f"""with {_DOCS},{_WORDS}, c as (select document_id, cast(len(words) as integer) as n from worded)
        select document_id, n as tokens, {_expected(768, 653)} as chunks_768, {_expected(1024, 820)} as chunks_1024 from c""",
    "chunk_token_stats": f"""with {_chunks()} select count(*) as chunk_count, cast(min(token_count) as bigint) as tokens_min,
        cast(round(avg(token_count)) as bigint) as tokens_avg,
        cast(quantile_disc(token_count, 0.95) as bigint) as tokens_p95, cast(max(token_count) as bigint) as tokens_max from chunks""",
    "chunk_token_stats_by_lang": f"""with {_chunks()} select lang, count(*) as chunk_count, cast(min(token_count) as bigint) as tokens_min,
        cast(round(avg(token_count)) as bigint) as tokens_avg,
        cast(quantile_disc(token_count, 0.95) as bigint) as tokens_p95, cast(max(token_count) as bigint) as tokens_max
        from chunks group by lang""",
    "chunk_counts_by_lang": f"with {_chunks()} select lang as key, count(*) as chunk_count from chunks group by lang",
    "chunk_counts_by_source": f"with {_chunks()} select source_system as key, count(*) as chunk_count from chunks group by all",
    "top_documents": f"""with {_chunks()} select document_id, count(*) as chunk_count, any_value(title) as title,
        any_value(source_path) as source_path from chunks group by document_id order by chunk_count desc, document_id limit 25""",
    "sample_chunks": f"""with {_chunks()} select chunk_id, lang, token_count, title,
        case when strlen(content) > 220 then ({_prefix('content', 220)}) || '...' else content end as snippet
        from chunks order by chunk_id limit 40""",
    "run_totals": f"""with {_chunks()}, d as (select document_id, count(*) as c, sum(greatest(token_count, 0)) as t, count(*) * 3 as e,
          count(*) + max(token_count) as u from chunks group by all)
        select count(*) as documents, cast(sum(c) as bigint) as chunks, cast(sum(t) as bigint) as tokens,
        cast(sum(e) as bigint) as embed_ms, cast(sum(u) as bigint) as upsert_ms, round(sum(c) / count(*), 2) as chunks_per_document,
        round(count(*) * 60.0::double / (sum(e) / 100.0::double), 2) as documents_per_minute, round(sum(c) / (sum(e) / 100.0::double), 2) as chunks_per_second,
        round((sum(u) / 10.0::double) / (sum(e) / 100.0::double), 2) as upsert_share_percent from d""",
    "fetch_cache_fresh": "select page_id, url from pages where page_id <= 72 and page_id % 5 <> 0",
    "fetch_cache_retained": "select page_id, url from pages where page_id <= 168",
    "seed_urls": """select o_orderkey as voting_id, p as position, n as name, u as url from (
          select o_orderkey, 0 as p, 'voting' as n, 'https://x/v/' || o_orderkey as u from orders
          union all select o_orderkey, 1, 'affairs', 'https://x/affairs/' || o_orderkey from orders where o_orderkey % 3 <> 0
          union all select o_orderkey, 2, 'votes', 'https://x/votes/' || o_orderkey from orders where o_orderkey % 2 <> 0
          union all select o_orderkey, 3, 'meeting', 'https://x/meeting/' || o_orderkey from orders where o_orderstatus = 'F'
          union all select o_orderkey, 4, 'bodies', 'https://x/bodies/' || o_orderkey from orders where o_orderstatus <> 'P'
          union all select o_orderkey, 5, 'affairs-fallback', 'https://api.openparldata.ch/v1/votings/' || o_orderkey || '/affairs' from orders where o_orderkey % 3 = 0)""",
    "missing_bodies": """with a as (select distinct o_custkey as k from orders), r as (select 'https://api.openparldata.ch/v1/affairs/' || k as r, k from a)
        select case when k % 4 = 0 then 'https://x/c/' || k else r || '/contributors' end as url from r
        union select r || '/docs' from r where not (k % 2 = 0 and k in (select c_custkey from customer)) union select r || '/texts' from r""",
    "front_matter_rows": """select doc_id, source as title, 'lang=' || lang || '|chars=1:2|id=' || doc_id as entries, sha256('Body: ' || text) as body_sha from documents""",
    "document_ids": f"with {_DOCS} select document_id, translation_id, translate(source_path, '/.', '__') as path_id from docs",
    "content_hash": f"with {_DOCS} select document_id, {_HASH} as content_hash from docs",
    "source_fingerprint": f"""with {_DOCS} select document_id, {_FINGERPRINT} as source_fingerprint,
        case when modified_at is null then 'low' else 'high' end as fingerprint_confidence from docs""",
    "translation_source_hash": f"with {_DOCS} select document_id, {_SOURCE_HASH} as source_hash from docs",
    "person_ids": """with p as (select *, 'intv:' || lower(replace(string_split(p_name, ' ')[1] || '_' ||
        string_split(p_name, ' ')[-1] || '_' || p_type, ' ', '_')) as person_id from part)
        select p_partkey, person_id, p_brand || ':' || person_id || ':' || p_size as link_id from p""",
    "slugs": f"with {_CATALOG} select id, translate(lower(object_id), ' _/:.', '-----') as slug from cat",
    "pii_redact": f"""select doc_id, sha256({_redact('text')}) as redacted_sha, regexp_matches(text, '{_EMAIL}') as has_email,
        regexp_matches(text, '{_PHONE}') as has_phone from documents""",
    "markdown_strip": f"select doc_id, sha256({_squeeze("translate(text, '#*_`[]()', '        ')")}) as plain_sha from documents",
    "compact_text": f"""with f as (select doc_id, {_squeeze('text')} as t from documents)
        select doc_id, case when strlen(t) <= 300 then t else trim({_prefix('t', 300)}) || '...' end as compact from f""",
    "highlight_snippets": f"with {_highlight_ctes('documents', 'doc_id', 'text')} select k as doc_id, snippet from snip",
    "argument_side": f"""with s as (select doc_id, {_count_words(fv.PRO_WORDS)} as pro, {_count_words(fv.CONTRA_WORDS)} as con from documents)
        select doc_id, case when pro = 0 and con = 0 then 'unknown' when pro >= con then 'pro' else 'contra' end as side from s""",
    "token_estimates": f"select conv_id, turn, cast(ceil(strlen({_strip('text')}) / 4.0) as bigint) as tokens from conversations",
    "language_codes": f"""with {_DOCS}, r as (select document_id, lower(lang || case when title like '%3' then '-ch' else '' end) as c, lang from docs)
        select document_id, {_language_code('c')} as plain, {_supported('c')} as supported, c as request,
        string_split(c, '-')[1] as summary, case when lang in ('de','it','rm','en') then lang else 'fr' end as by_path from r""",
    "page_urls": """select page_id, string_split(url, '#')[1] as canonical, sha256(string_split(url, '#')[1]) as cache_key,
        case when lower(url) like '%/de/%' then 'de' when lower(url) like '%/it/%' then 'it'
        when lower(url) like '%/rm/%' then 'rm' when lower(url) like '%/en/%' then 'en' else 'fr' end as lang,
        'local_fixture' as system, regexp_matches(url, '^https://m[.]ththth[.]example[.]net/') as allowed from pages""",
    "json_props": "select event_id, json_extract_string(props, '$.k') as k_text, '' as missing from events",
    "usage_tokens": """with r as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)
        select event_id, k as input_tokens, cast(7 as bigint) as output_tokens, k + 7 as total_tokens, 'provider' as usage_source from r""",
    "vote_dates": f"""with p as (select o_orderkey, case when o_orderstatus = 'P' then o_orderdate - interval 2 hour else o_orderdate end as d from orders)
        select o_orderkey, strftime(d, '%Y-%m-%dT%H:%M:%SZ') as parsed, case when d > {_AS_OF} then 'upcoming' else 'past' end as status from p""",
    "hash_embedding": f"""with {_ASKED.replace('question_id, language, ' + _strip(_redact('c')), 'question_id, language, c')},
        t as (select a.question_id, {_strip('a.raw')} as x from asked a),
        v as (select question_id, {_embed('x')} as v from t)
        select question_id, cast(unnest(range(0, 128)) as integer) as dim, round(cast(unnest(v) as double), 7) as value from v""",
    "vector_topk": """with q as (select * from embeddings order by vec_id limit 1),
        s as (select q.vec_id as query_id, e.vec_id as item_id,
          round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 10) as score from q, embeddings e),
        r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
        select query_id, item_id, cast(rank as integer) as rank, round(score, 6) as score from r where rank <= 5""",
    "vector_topk_batch": """with s as (select q.vec_id as query_id, e.vec_id as item_id,
          round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 10) as score
          from embeddings q join embeddings e on q.vec_id <> e.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
        select query_id, item_id, cast(rank as integer) as rank, round(score, 6) as score from r where rank <= 5""",
    "cosine_pairs": """select a.vec_id as item_id,
        round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "semantic_cache_probe": """with s as (select q.vec_id as query_id, e.vec_id as cache_key,
          round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 10) as score
          from embeddings q join embeddings e on q.vec_id <> e.vec_id and q.label = e.label),
        r as (select *, row_number() over (partition by query_id order by score desc, cache_key) as rank from s)
        select query_id, cache_key, round(score, 6) as score from r where rank = 1 and score >= 0.4""",
    "retrieval": f"with {_HITS} select exact_key, cast(rank as integer) as rank, chunk_id, round(score, 6) as score from hits",
    "qa_answers": f"""with {_HITS},{_highlight_ctes('hits', "exact_key || '#' || rank", 'content')},
        lead as (select * from hits qualify row_number() over (partition by exact_key, document_id order by rank) = 1),
        two as (select l.exact_key, l.rank, s.snippet from lead l join snip s on s.k = l.exact_key || '#' || l.rank
          where s.snippet <> '' qualify row_number() over (partition by l.exact_key order by l.rank) <= 2),
        said as (select exact_key, string_agg(snippet, ' ' order by rank) as body from two group by all),
        cited as (select * from hits qualify row_number() over (partition by exact_key, source_uri, title order by rank) = 1),
        cites as (select exact_key, string_agg('other~' || source_uri || '~' || title, '|' order by rank) as citations from cited group by all),
        agg as (select exact_key, round(least(1, greatest(0, avg(score))), 2) as confidence,
          array_to_string(list_sort(list_distinct(list(document_id))), '|') as used_documents from hits group by all)
        select question_id, question, language,
          {_message(fv.SUMMARY_PREFIX, "string_split(language, '-')[1]")} || ' ' || body as answer, confidence, citations, used_documents
        from keyed join said using (exact_key) join cites using (exact_key) join agg using (exact_key)""",
    "prompt_budget": f"""with {_HITS}, a as (select h.*, w.question from hits h join work w using (exact_key)),
        b as (select exact_key, rank, cast(greatest(800, 4000 - strlen('Question utilisateur (sanitisee):' || chr(10) || question || chr(10) || chr(10)
            || 'Extraits de documents publics indexes:' || chr(10)) - 220) as bigint) as budget, strlen(content) as tb,
          chr(10) || '[' || rank || '] source=' || source_path || ' title=' || title || ' lang=' || lang || ' score=' || printf('%.4f', score)
            || ' source_uri=' || source_uri || ' intervenants=none' || chr(10) as header from a),
        c as (select *, coalesce(sum(tb + strlen(header)) over (partition by exact_key order by rank
            rows between unbounded preceding and 1 preceding), 0) as used from b)
        select exact_key, cast(rank as integer) as rank, cast(used as bigint) as used_before, budget,
          cast(greatest(0, budget - used - strlen(header)) as bigint) as room, header from c where used < budget""",
    "sanitized_questions": f"""with t as (select conv_id, turn, {_strip('text')} as raw from conversations),
        c as (select conv_id, turn, raw as c from t),
        s as (select conv_id, turn, {_strip(_redact('c'))} as question from c)
        select *, question <> '' and not contains(question, '{fv.EMAIL_MARK}') and not contains(question, '{fv.PHONE_MARK}') as cacheable from s""",
    "cache_keys": f"with {_ASKED} select question_id, signature, context_hash, exact_key, semantic_key from keyed",
    "cache_eviction": """select event_id as cache_key from events where ts + interval 20 day >= timestamp '2024-01-25'
        order by ts desc, event_id limit 500""",
    "cache_metrics": """with l as (select event_type as e, cast(json_extract_string(props, '$.k') as bigint) as k from events),
        c as (select count(*) filter (e = 'view') as exact_hits, count(*) filter (e = 'click') as semantic_hits,
          count(*) filter (e in ('signup','purchase')) as misses, count(*) filter (e = 'error') as bypass_sensitive_question,
          count(*) filter (e = 'purchase') as bypass_semantic_disabled, count(*) filter (e = 'signup') as bypass_question_too_short,
          avg(0.9 + k / 1000) filter (e = 'click') as m,
          cast(sum(ceil(k / 4.0)) filter (e in ('view','click')) as bigint) as saved_input_tokens_estimate,
          cast(sum(ceil(k * 3 / 4.0)) filter (e in ('view','click')) as bigint) as saved_output_tokens_estimate from l)
        select * exclude (m), round((exact_hits + semantic_hits) / (exact_hits + semantic_hits + misses), 4) as hit_rate,
          round(semantic_hits / (exact_hits + semantic_hits + misses), 4) as semantic_hit_rate,
          round(m, 4) as semantic_score_mean_on_hit,
          saved_input_tokens_estimate + saved_output_tokens_estimate as saved_total_tokens_estimate from c""",
    "votation_total": f"with {_CATALOG} select count(distinct votation_id) as total from cat where {_PAGE_FILTER}",
    "votation_page": f"{_PAGED} from items",
    "votation_page_undated": f"{_UNDATED} from items",
    "votation_row_page": f"{_ROW_PAGED} from items",
    "votation_page_objects": f"{_PAGED} select distinct votation_id, object_id from rws where object_id <> ''",
    "votation_page_sources": f"{_PAGED} select distinct votation_id, source_uri from rws",
    "votation_pending_jobs": f"""{_UNDATED} select distinct id as document_id, 'it' as target_lang from rws
        where votation_id in (select votation_id from items where translation_state = 'pending')""",
    "votation_detail": f"{_DETAIL} from items",
    "object_list": f"""with {_CATALOG},{_TRANSLATIONS}, f as (select * from cat where object_id <> ''
          qualify row_number() over (partition by votation_id, object_id order by id) = 1)
        select votation_id, object_id, coalesce(title, '') as title, object_type, object_theme,
          translate(lower(object_id), ' _/:.', '-----') as slug, f.status
        from f left join tr on f.id = tr.document_id and tr.lang = 'de'""",
    "object_detail": f"""with {_CATALOG},{_TRANSLATIONS}, b as (select cat.*, lang, title, content_normalized from cat join tr on cat.id = tr.document_id
          where object_id <> '' qualify row_number() over (partition by object_id order by lang = 'it' desc, lang, id) = 1)
        select object_id, votation_id, lang as language, title, object_type, object_theme, content_normalized as context,
          'pro: for ' || priority || chr(10) || 'contra: against' as arguments, object_type || ',' || object_theme as tags,
          source_system as source_systems from b""",
    "object_sources": f"""with {_CATALOG}, f as (select * from cat where object_id <> ''
          qualify row_number() over (partition by object_id, source_uri order by vote_date desc nulls last, id) = 1)
        select object_id, 'official' as type, source_org as title, source_uri as url,
          case when o_orderstatus = 'F' then 'dataset' else '' end as origin from f""",
    "taxonomies": f"""with {_CATALOG},{_TRANSLATIONS}
        select distinct 'levels' as taxonomy, level as value from cat
        union select 'cantons', canton from cat union select 'statuses', status from cat
        union select 'object_types', object_type from cat union select 'themes', object_theme from cat
        union select 'languages', lang from tr""",
    "translation_left_join": f"""with {_CATALOG},{_TRANSLATIONS} select id, votation_id, coalesce(title, '') as title
        from cat left join tr on id = document_id and lang = 'fr'""",
    "upsert_latest": f"""with {_WRITES}, w as (select *, line = 'O' as batch from writes)
        select document_id, lang, title, content_normalized, line from w
        qualify row_number() over (partition by document_id, lang order by batch desc, {_NEWEST}) = 1""",
    "replace_documents": f"""with {_WRITES}, o as (select distinct document_id from writes where line = 'O')
        select document_id, count(*) as rows, max(written_at) as newest, min(line) as line from writes
        where line = case when document_id in (from o) then 'O' else 'F' end group by document_id""",
    "index_skip_decisions": f"""{_DECIDED} select document_id, expected_chunks, reason in ('same_source', 'same_content') as skip, reason from decided""",
    "index_to_process": f"{_DECIDED} select document_id, lang from decided where reason not in ('same_source', 'same_content')",
    "index_state_merge": f"""with {_CATALOG},{_TRANSLATIONS}, l as (select document_id, count(*) as n, count(*) filter (status = 'ready') as r from tr group by all)
        select coalesce(id, document_id) as document_id, status, coalesce(n, 0) as translations, coalesce(r, 0) as ready
        from cat full join l on id = document_id""",
    "missing_translations": f"""with {_DOCS} select distinct document_id, code as lang from docs, {_LANGS}
        except select document_id, lang from docs""",
    "translation_plan": f"""with {_DOCS},
        own as (select *, case when {_supported('lang')} = '' then 'fr' else lang end as l from docs),
        hashed as (select document_id, doc_id, l, title, content, lang, {_SOURCE_HASH.replace('lang ||', 'l ||')} as source_hash,
          {_SOURCE_HASH} as raw_hash from own),
        st as (select h.document_id, raw_hash, content from hashed h join labels using (doc_id) where lang <> 'es'),
        al as (select h.*, code from hashed h, {_LANGS}),
        j as (select al.*, st.content is not null as reused from al left join st
          on st.document_id = al.document_id and code = 'de' and st.raw_hash = al.source_hash and trim(st.content) <> '')
        select document_id, code as lang, title,
          case when code = l then 'source' when reused then 'reused' else 'translate' end as origin,
          case when code = l or reused then 'source' else '' end as provider, l as source_lang, source_hash,
          sha256(case when code <> l and reused then {_squeeze('content')} else content end) as content_sha from j""",
    "best_source_translation": f"""with {_CATALOG},{_TRANSLATIONS} select document_id, 'en' as target_lang, lang, title from tr
        where lang <> 'en' and document_id in (select id from cat)
        qualify row_number() over (partition by document_id order by lang = 'fr' desc, lang) = 1""",
    "pending_translations": f"""with recursive {_TRANSLATIONS},
        st as (select document_id, lang, sha256(lang || '|' || title || '|' || content_normalized) as own, status = 'ready' as is_ready from tr),
        ev as (select event_id, 'orders:' || user_id as document_id, case event_type when 'view' then 'en' when 'signup' then 'fr' when 'error' then 'it' else 'de' end as lang,
          ts as t, event_type = 'purchase' as done from events),
        l as (select * from (select *, sum(done::int) over (partition by document_id, lang order by t, not done, event_id rows unbounded preceding) as g from ev) where not done),
        n as materialized (select a.document_id, a.lang, a.g, a.t, b.t as nxt from (select distinct document_id, lang, g, t, t + interval 2 day as open from l) a
          asof join (select distinct document_id, lang, g, t from l) b on a.document_id = b.document_id and a.lang = b.lang and a.g = b.g and a.open < b.t),
        chain as (select document_id, lang, g, min(t) as t from l group by all
          union select n.document_id, n.lang, n.g, n.nxt from chain join n using (document_id, lang, g, t)),
        started as (select document_id, lang, min(event_id) as event_id from chain join l using (document_id, lang, g, t) group by document_id, lang, g, t),
        source as (select s.event_id, s.document_id, s.lang as target_lang, st.lang as source_lang, st.own as source_hash
          from started s join st on st.document_id = s.document_id and st.lang <> s.lang
          qualify row_number() over (partition by s.event_id, s.document_id, s.lang order by st.lang = 'en' desc, st.lang = 'fr' desc, st.lang) = 1)
        select * from source where not exists (
          select 1 from st ready join st en on en.document_id = ready.document_id and en.lang = 'en'
          where ready.is_ready and ready.document_id = source.document_id and ready.lang = source.target_lang and en.own = source.source_hash)""",
    "metrics_source_pick": f"""with {_TRANSLATIONS} select document_id, lang, cast(strlen(title) as integer) as title_bytes from tr
        qualify row_number() over (partition by document_id order by lang = 'it' desc, lang = 'fr' desc, lang) = 1""",
    "first_seen_sources": f"""with {_CATALOG} select source_uri, id from cat
        qualify row_number() over (partition by source_uri order by vote_date desc nulls last, id) = 1""",
    "usage_events": f"with {_USAGE} from u0",
    "usage_daily": f"with {_USAGE} from daily",
    "usage_events_page": f"""with {_USAGE} select event_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at, flow, operation, mode, total_tokens
        from u0 where created_at between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 12:00:00' and flow = 'rag_index'
        order by u0.created_at desc, event_id desc limit 200 offset 10""",
    "usage_events_middle": f"""with {_USAGE} select event_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at, flow, total_tokens
        from u0 order by u0.created_at desc, event_id desc limit 500 offset (select count(*) // 2 from u0)""",
    "usage_daily_page": f"""with {_USAGE} from daily where day between date '2024-01-05' and date '2024-01-20' and flow = 'rag_index'
        order by day desc, flow, operation, mode, model_name, provider_name limit 200 offset 10""",
    "usage_per_document": f"""with {_USAGE} select document_id,
        count(distinct case when operation = 'translation' and target_lang <> 'en' then target_lang end) as translations_attempted,
        count(distinct case when operation = 'translation' and target_lang <> 'en' and status = 'success' then target_lang end) as translations_succeeded,
        count(*) filter (operation = 'embedding') as embedding_calls,
        cast(coalesce(sum(input_chars) filter (operation = 'embedding'), 0) as bigint) as embedding_input_chars_sum,
        cast(coalesce(sum(input_tokens) filter (operation = 'embedding'), 0) as bigint) as embedding_input_tokens_sum,
        cast(coalesce(sum(total_tokens) filter (operation = 'embedding'), 0) as bigint) as embedding_total_tokens_sum,
        cast(coalesce(sum(input_tokens) filter (operation = 'translation'), 0) as bigint) as llm_input_tokens_sum,
        cast(coalesce(sum(output_tokens) filter (operation = 'translation'), 0) as bigint) as llm_output_tokens_sum,
        cast(coalesce(sum(total_tokens) filter (operation = 'translation'), 0) as bigint) as llm_total_tokens_sum
        from u0 group by document_id""",
    "usage_daily_stream": f"with {_USAGE} from daily",
    "usage_daily_once": f"with {_USAGE} from daily",
    "cache_replay": """with recursive l as (select event_id, event_type as key, ts as t from events),
        n as materialized (select a.key, a.t, b.t as nxt from (select distinct key, t, t + interval 6 hour as open from l) a
          asof join (select distinct key, t from l) b on a.key = b.key and a.open < b.t),
        chain as (select key, min(t) as t from l group by key
          union select n.key, n.nxt from chain join n using (key, t)),
        m as (select key, t, min(event_id) as miss from chain join l using (key, t) group by all)
        select event_id, l.key, case when event_id = miss then 'miss' else 'exact_hit' end as outcome
        from l left join m on l.key = m.key and l.t = m.t""",
    "selected_votings": """select o_orderkey as voting_id, 'future' as selection_strategy from orders
        where o_orderdate > timestamp '2001-07-25' order by o_orderkey limit 30""",
    "vote_display_titles": """with r as (select o_orderkey, o_orderstatus = 'F' as f, o_orderpriority = '5-LOW' as low, o_orderpriority from orders)
        select o_orderkey as voting_id, array_to_string(list_filter(['de=Abstimmung ' || o_orderkey,
          case when f then 'fr=Affaire ' || o_orderkey end, case when low then 'it=5-LOW' end], lambda x: x is not null), '|') as titles from r""",
    "vote_languages": """with p as (
          select o_orderkey as v, 'de' as l from orders union select o_orderkey, 'fr' from orders where o_orderstatus = 'F'
          union select o_orderkey, 'it' from orders where o_orderpriority = '5-LOW'
          union select o_orderkey, 'rm' from orders where o_orderstatus = 'O'
          union select doc_id, lang from documents where lang in ('fr','de','it','rm','en')
          union select item_id, 'en' from benchmark)
        select o_orderkey as voting_id, string_agg(l, ',' order by l) as languages from orders join p on v = o_orderkey group by all""",
    "vote_initiants": """with c as (select l_orderkey as voting_id,
          cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as position,
          case when l_linenumber < 4 then 'Full ' || l_suppkey else 'Anna Nr' || l_suppkey end as fullname, 'P1' as party,
          case when l_returnflag = 'R' and l_linestatus = 'O' then 'Motionnaire principal' else 'Membre' end as role,
          l_returnflag = 'A' as person from lineitem),
        s as (select *, bool_or(role <> 'Membre') over (partition by voting_id) as marked from c)
        select voting_id, position, fullname, party, role from s where case when marked then role <> 'Membre' else person end""",
    "vote_arguments": f"""with d as (select source as v, 0 as o, doc_id as p, {_squeeze('text')} as text from documents),
        sd as (select *, {_count_words(fv.PRO_WORDS)} as pro, {_count_words(fv.CONTRA_WORDS)} as con from d),
        a as (select v, o, p, text, case when pro = 0 and con = 0 then 'u' when pro >= con then 'pro' else 'contra' end as side from sd
          union all select 'src' || item_id, 1, item_id, {_squeeze('text')}, 'u' from benchmark),
        k as (select * from a where text <> ''),
        u as (select v, o, p, text, case row_number() over (partition by v order by o, p) when 1 then 'pro' when 2 then 'contra' end as side from k where side = 'u'),
        r as (select v, o, p, text, side from k where side <> 'u'
          union all select v, o, p, text, side from u where side is not null and not exists (select 1 from k where k.v = u.v and k.side = u.side))
        select v as voting_id, side, o as origin, p as position, text as piece from r""",
    "vote_locations": """with v as (select c_custkey, case when c_mktsegment = 'BUILDING' then -1 else c_nationkey end as target, n_regionkey as r
          from customer join nation on c_nationkey = n_nationkey),
        b as (select c_custkey, n_nationkey as k, case when n_nationkey > 12 then 'N' || chr(n_nationkey + 65) else '' end as canton,
          case when n_nationkey > 5 then n_name else '' end as place, n_nationkey = target as own
          from v join nation on n_regionkey = r)
        select c_custkey as voting_id, canton, cast(k as varchar) as commune_code, place as commune_name from b
        qualify row_number() over (partition by c_custkey order by own desc, k) = 1""",
    "crawl_levels": """with c as (select c_custkey as v, c_nationkey as n, n_regionkey as r, exists (select 1 from orders where o_custkey = c_custkey) as linked
          from customer join nation on c_nationkey = n_nationkey),
        u as (select v, 0 as depth, 'c/' || v as u, 'v1-c-' || v as label from c
          union all select o_custkey, 1, 'o/' || o_orderkey, 'link' from orders
          union all select v, 2, 'n/' || n, 'link' from c where linked union all select v, 3, 'r/' || r, 'link' from c where linked)
        select v as voting_id, depth, 'https://api.openparldata.ch/v1/' || u as url, label from u""",
    "stored_filters": f"""select o_orderkey, cast(o_orderkey as varchar) as votation_id, '' as object_id,
        case when o_orderstatus = 'F' then 'federal' else 'cantonal' end as level, 'GE' as canton,
        case when o_orderstatus <> 'P' and o_orderdate > {_AS_OF} then 'upcoming' else 'past' end as status, 'official' as source_type,
        case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as vote_date from orders""",
    "people_from_names": f"""with {_DOCS}, s as (select document_id, string_split(content, '.') as parts from docs),
        w as (select document_id, unnest(parts) as part, unnest(range(0, len(parts))) as i from s),
        t as (select document_id, i, list_filter(string_split({_squeeze('part')}, ' '), lambda x: x <> '') as ws from w),
        n as (select document_id, i, ws[1] || '~' || array_to_string(ws[2:], ' ') as name from t where len(ws) >= 2),
        f as (select * from n qualify row_number() over (partition by document_id, lower(name) order by i) = 1)
        select document_id, cast(row_number() over (partition by document_id order by i) - 1 as integer) as at, name from f""",
    "language_view": """with d as (select doc_id, '{"body":{"text":' || to_json(text) || '},"doc":{"doc_id":' || doc_id || '},"title":"' || source || '"}' as j from documents)
        select doc_id, sha256(replace(replace(replace(j, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026')) as fr_sha,
          '{"doc":{"doc_id":' || doc_id || '}}' as de_view from d""",
    # scripts are raw text; of character references only those that pages hold are decoded
    "html_text": f"""with p as (select page_id, string_split_regex(html, '(?i)</?script[^>]*>') as parts from pages),
        t as (select page_id, list_transform(parts, lambda x, i: case when i % 2 = 0 then x else
          replace(replace(replace(replace(regexp_replace(x, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') end) as nodes from p)
        select page_id, {_squeeze("array_to_string(nodes, ' ')")} as text from t""",
    "metadata_sanitized": """select c_custkey, '{"more":{"segment":"' || c_mktsegment || '"},"name":"' || c_name || '"}' as clean from customer""",
}

# Each question key is walked in time order, one ask after the other.
ORACLE["qa_cached_answers"] = f"""with recursive {_ASKED},
    asks as (
      select question_id, question_id * 10 + n as ask, exact_key, strlen(question) >= {fv.SEMANTIC_MIN_BYTES} as long_enough,
        (question_id * 7919 + n * n * 180 + n * (question_id % 5) * 20000) % 300000 as sec,
        question <> '' and not contains(question, '{fv.EMAIL_MARK}') and not contains(question, '{fv.PHONE_MARK}') as cacheable
      from keyed, unnest(range(4)) as t(n)),
    ordered as (select *, row_number() over (partition by exact_key order by sec, ask) as i from asks where cacheable),
    walk(exact_key, i, ask, outcome, made, entry_at) as (
      select exact_key, i, ask, 'miss', sec, sec from ordered where i = 1
      union all
      select o.exact_key, o.i, o.ask,
        case when o.sec - made <= {fv.EXACT_TTL_SECONDS} then 'exact_hit' when o.long_enough and o.sec - made <= {fv.SEMANTIC_TTL_SECONDS} then 'semantic_hit' else 'miss' end,
        case when o.sec - made <= {fv.EXACT_TTL_SECONDS} or (o.long_enough and o.sec - made <= {fv.SEMANTIC_TTL_SECONDS}) then made else o.sec end,
        case when o.sec - made <= {fv.EXACT_TTL_SECONDS} or (o.long_enough and o.sec - made <= {fv.SEMANTIC_TTL_SECONDS}) then made else o.sec end
      from walk w join ordered o on o.exact_key = w.exact_key and o.i = w.i + 1),
    said as ({ORACLE["qa_answers"]})
    select asks.ask as question_id, coalesce(outcome, 'bypass_sensitive') as outcome, entry_at::bigint as entry_second,
      case when outcome = 'semantic_hit' then 1.0::double end as score, answer, confidence
    from asks left join walk using (ask) join said on said.question_id = asks.question_id"""

ORACLE["vector_topk_cells"] = ORACLE["vector_topk_batch"]

ORACLE["vote_json_rows"] = f"""with o as (
      select *, cast(o_orderkey as varchar) as k, o_orderstatus as s, o_orderpriority <> '5-LOW' as has_affair,
        case o_orderstatus when 'F' then 'CH' when 'O' then 'ZH' else cast(o_custkey % 25 as varchar) end as body from orders),
    l as (
      select *, case when s = 'F' then ['de','fr']
        else list_filter([case when has_affair then 'fr' end, 'de', case when s = 'O' then 'it' end], lambda x: x is not null) end as langs from o),
    r as (select *, unnest(langs) as lang from l),
    v as (
      select *, case lang when 'de' then 'Vorlage ' || k when 'it' then case when s <> 'P' then 'Oggetto ' || k end end as own from r)
    select 'openparldata:v' || k as document_id, lang,
      case when has_affair then 'Geschaeft ' || k else coalesce(own, 'Vorlage ' || k) end as title,
      array_to_string(langs, ',') as languages, 'Anna~Nr' || o_custkey || '~Urheber' as people, 'v' || k as votation_id,
      case when has_affair then k end as object_id, case when has_affair then o_orderpriority[3:] end as object_type,
      case s when 'F' then 'federal' when 'O' then 'cantonal' else 'communal' end as level,
      case s when 'O' then 'ZH' when 'P' then 'BE' end as canton, case when s = 'P' then body end as commune_code,
      case when o_orderdate > {_AS_OF} then 'upcoming' else 'past' end as status,
      strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') as vote_date,
      sha256('{{' || case when has_affair then '"affair":{{"id":' || k || case when lang = 'de' then ',"title":"Geschaeft ' || k || '"' else '' end
          || case when lang = 'fr' then ',"type_name":"' || o_orderpriority[3:] || '"' else '' end || '}},' else '' end
        || case when s = 'F' then '"available_languages":["de","fr","xx"],' else '' end
        || case when s = 'P' then '"canton":"be",' else '' end
        || '"initiants":[{{"fullname":"Anna Nr' || o_custkey || '","role":"Urheber"}}],"source_system":"openparldata","voting":{{"body_key":"' || body
        || '","date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","external_id":"v' || k || '"'
        || coalesce(',"title":"' || own || '"', '') || '}}}}') as content_sha from v"""

_JSON_TEXT = (
    "replace(replace(replace(cast(to_json(text) as varchar), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026')"
)
ORACLE["generic_json_rows"] = f"""with d as (
      select *, lang = 'fr' as listed, cast(doc_id as varchar) as k, {_JSON_TEXT} as j from documents),
    c as (select *, case when listed then '{{"result":{{"count":1,"results":[{{"author":"Anna Meier, Bo Li Ost,Solo","id":"ds-' || k
        || '","issued":"2024-02-03T04:05:06","language":["it","xx","fr"],"license_id":"cc-by","notes":' || j
        || ',"organization":{{"display_name":{{"fr":"' || source || '"}}}},"title":{{"de":"Daten ' || k || '","it":"Dati ' || k
        || '"}},"url":"https://data.example.org/' || k || '"}}]}}}}' else '{{"more":{{"share":1.5}},"text":' || j || '}}' end as body from d)
    select case when listed then 'opendata_swiss:ds-' || k else 'json_fixture:sets_' || k || '_json' end as document_id,
      case when listed then 'opendata_swiss:ds-' || k else 'json_fixture:sets_' || k || '_json' end || ':fr' as translation_id,
      'fr' as lang, case when listed then 'Daten ' || k else k end as title, case when listed then source else '' end as source_org,
      case when listed then 'https://data.example.org/' || k else '' end as source_uri, case when listed then 'cc-by' else '' end as license_uri,
      case when listed then '2024-02-03T04:05:06Z' end as issued, case when listed then 'it,fr' else '' end as languages,
      case when listed then 'Anna~Meier~source_contributor|Bo~Li Ost~source_contributor' else '' end as people,
      sha256({_squeeze('body')}) as content_sha from c"""
