"""The queries' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_BITS = " + ".join(f"(case when embedding[{i + 1}] > 0 then '1' else '0' end)" for i in range(64)).replace(" + ", " || ")

_SEARCH = f"""
with codes as (select vec_id, {_BITS} as code from embeddings),
pairs as (
  select q.vec_id as vec_id, c.vec_id as neighbour_id, hamming(q.code, c.code) as distance
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (select *, row_number() over (partition by vec_id order by distance, neighbour_id) as rank from pairs)
select vec_id, cast(rank as bigint) as rank, neighbour_id, cast(distance as bigint) as distance from ranked where rank <= 10
"""

_CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), told as (
  select conv_id, turn, role, text, length(role) + length(text)
    + (length(role) - length(replace(replace(role, '\', ''), '|', '')))
    + (length(text) - length(replace(replace(text, '\', ''), '|', ''))) + 4 + 7 as chars
  from rows
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from told group by conv_id
"""

_URLS = r"""
with places as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), ruled as (
  select page_id, host, path, case
    when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
    when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
    when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
    when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule
  from places
), matched as (
  select *, case when rule is null then case
    when regexp_matches(host || path, '(?s)/cgi-bin/.*/login') then '/cgi-bin/*/login'
    when regexp_matches(host || path, '(?s)/tracker/.*\.gif') then '/tracker/*.gif'
    when contains(host || path, '.doubleclick.') then '.doubleclick.'
    when regexp_matches(host || path, '(?s)/banner/.*\.swf') then '/banner/*.swf'
    when contains(host || path, ';jsessionid=') then ';jsessionid='
    when contains(host || path, '/adserver/') then '/adserver/'
    when contains(host || path, '/wp-admin/') then '/wp-admin/'
    when contains(host || path, '/ads/') then '/ads/' end end as pattern
  from ruled
)
select page_id, host, path, rule, pattern, case when rule in ('com/', 'www.example.com/en/') then 'allow'
  when rule is not null or pattern is not null then 'block' else 'allow' end as verdict
from matched
"""

_WARC = """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), firsts as (select hex, min(page_id) as first from payloads group by hex),
bits as (
  select hex, array_to_string(list_transform(range(40), lambda i: list_extract(
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    instr('0123456789abcdef', substr(hex, i + 1, 1)))), '') as b from firsts
), digests as (
  select hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * cast(substr(b, 5 * i + 1, 1) as int) + 8 * cast(substr(b, 5 * i + 2, 1) as int) + 4 * cast(substr(b, 5 * i + 3, 1) as int)
    + 2 * cast(substr(b, 5 * i + 4, 1) as int) + cast(substr(b, 5 * i + 5, 1) as int), 1)), '') as payload_digest from bits
)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when p.page_id = f.first then 'response' else 'revisit' end as record_type,
  case when p.page_id <> f.first then f.first end as refers_to, cast(null as varchar) as error
from payloads p join firsts f on p.hex = f.hex join digests d on d.hex = p.hex
"""

_SQL: dict[str, str] = {
    "op5_hamming_search": _SEARCH,
    "op7_warc": _WARC,
    "op9_chat": _CHAT,
    "op10_urls": _URLS,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
