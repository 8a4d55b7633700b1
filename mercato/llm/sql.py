"""DuckDB SQL for the queries that SQL can express."""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
  select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from docs
),
keyed as (select *, translate(trim(line, {_SPACES}), {_LOWER}) as key from lines),
repeated as (
  select key, max(doc_id) as last_doc from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
),
marked as (
  select k.*, coalesce(k.doc_id <> r.last_doc, false) as dropped from keyed k left join repeated r using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""

_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
with items as (select cast(item_id as varchar) as item, {_TOKENS} as w from benchmark),
windows as (
  select distinct item, least(len(w), 10) as n, w[pos:pos + least(len(w), 10) - 1] as win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as pos from items where len(w) > 0)
),
docs as (select doc_id, {_TOKENS} as w from documents),
lengths as (select distinct n from windows),
places as (
  select doc_id, pos, n, w[pos:pos + n - 1] as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from docs, lengths where len(w) >= n)
),
found as (select doc_id, pos, p.n, item from places p join windows using (win)),
words as (
  select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(pos, pos + n)) as word from found) group by doc_id
),
ids as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
  from found group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (doc_id) left join ids using (doc_id)
"""

OP7 = f"""
with docs as (select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, count(*) as n,
    cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight
  from docs group by source
),
caps as (select *, source_size * 3.0::double as cap, sum(source_size) over () as total from sources),
levels as (
  select *, (total - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (w rows between current row and unbounded following) as level
  from caps window w as (order by cap / weight, source nulls last)
),
final as (select max(level) as final from levels where cap > level * weight),
targets as (
  select source, source_size, case when cap <= level * weight or final is null then cap else final * weight end as target
  from levels, final
),
placed as (
  select doc_id, size, source_size, target, d.source,
    coalesce(target / nullif(source_size, 0), 0) as each,
    row_number() over (partition by d.source order by size desc, doc_id nulls first) - 1 as nth,
    cast(cast('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8) as ubigint) as double)
      / 4294967296.0::double as start
  from docs d join targets t on d.source is not distinct from t.source
),
taken as (
  select *, cast(floor((nth + 1) * each + start) - floor(nth * each + start) as bigint) as copies from placed
)
select doc_id, source, size, source_size, target, copies, size * copies as taken from taken
"""

OP8 = rf"""
with docs as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as lines
  from documents
),
wins as (
  select doc_id, pos, w[pos:pos + 2] as win
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as pos from docs where len(w) > 2)
),
again as (select *, count(*) over (partition by doc_id, win) as n from wins),
repeats as (
  select doc_id, count(distinct word) as n_repeat_words
  from (select doc_id, unnest(range(pos, pos + 3)) as word from again where n > 1) group by doc_id
),
counted as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as held, len(lines) as n_lines,
    cast(len(regexp_extract_all(text, '!!')) as bigint) as shouts,
    cast(len(regexp_extract_all(text, '[A-Z]')) as bigint) as capitals,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from docs left join repeats using (doc_id)
),
judged as (
  select *, cast(len(held) - len(list_distinct(held)) as bigint) as n_dup_lines,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_symbols * 4 <= n_words and word_chars between n_words * 2 and n_words * 20
    and n_dup_lines * 2 <= n_lines and shouts * 4 <= n_words and capitals * 2 <= word_chars as kept
from judged
"""

_SECOND = "ac|co|com|edu|go|gob|gov|govt|gouv|ltd|me|mil|ne|net|nom|or|org|plc|sch"


def _level(name: str, source: str, own: str) -> str:
    """A level's strength and the posterior of its groups (n, bad, mean)."""
    return f"""
{name}_rho as (
  select (sum((bad - n * mean) * (bad - n * mean) / n) - sum(mean * (1 - mean)))
    / nullif(sum((n - 1) * (mean * (1 - mean))), 0) as rho
  from {source} where n > 0
),
{name}_strength as (
  select 1 / greatest(least(coalesce(rho, 0.0::double), 0.99::double), 0.0001::double) - 1 as strength from {name}_rho
),
{name} as (
  select {own}, bad + strength * mean as alpha, n - bad + strength * (1 - mean) as beta
  from {source}, {name}_strength
)"""


_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]{1,32};"

OP9 = rf"""
with urls as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(?::[0-9]*)?\z', '') as name from (select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_LOWER}) as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages)
),
known as (
  select doc_id as page_id, max(case when kept then 0 else 1 end) as outcome from (
    with documents as (
      select page_id as doc_id, regexp_replace(coalesce(html, ''), '{_MARKUP}', ' ', 'g') as text from pages
    ), {OP8.strip().removeprefix("with ")}
  ) where doc_id is not null group by doc_id
),
counted as (
  select name, count(outcome) as n, coalesce(cast(sum(outcome) as bigint), 0) as bad
  from urls left join known using (page_id) group by name
),
hosts as (
  select *, case when address or found = '' then name else found end as domain,
    case when address then '[]' else regexp_extract(name, '(?:^|\.)((?:{_SECOND})\.[a-z][a-z]|[^.]+)$', 1) end as suffix
  from (
    select *, regexp_matches(name, '^(?:[0-9]+(?:\.[0-9]+){{3}}|\[.*\])\z') as address,
      regexp_extract(name, '(?:^|\.)([^.]+\.(?:(?:{_SECOND})\.[a-z][a-z]|[^.]+))$', 1) as found
    from counted
  )
),
suffix_rows as (
  select suffix, cast(sum(n) as bigint) as n, cast(sum(bad) as bigint) as bad,
    (select (sum(bad) + 1) / (sum(n) + 2) from hosts) as mean
  from hosts group by suffix
),
{_level("suffixes", "suffix_rows", "suffix")},
domain_rows as (
  select domain, h.suffix, cast(sum(n) as bigint) as n, cast(sum(bad) as bigint) as bad,
    any_value(alpha / (alpha + beta)) as mean
  from hosts h join suffixes s on h.suffix = s.suffix group by domain, h.suffix
),
{_level("domains", "domain_rows", "domain, suffix")},
host_rows as (
  select name, n, bad, alpha / (alpha + beta) as mean
  from hosts h join domains d on h.domain = d.domain and h.suffix = d.suffix
),
{_level("judged", "host_rows", "name")},
bounds as (
  select name, alpha / (alpha + beta)
    - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) as lower_bound
  from judged
),
ruled as (
  select u.*, lower_bound, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/')
      then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from urls u join bounds using (name)
)
select page_id, host, path, rule, case
  when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when lower_bound > 0.5 then 'block' else 'allow' end as verdict
from ruled
"""


def _hashed(column: str) -> str:
    """A column as a leaf takes it."""
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


_HEAD = "||".join(_hashed(c) for c in ("doc_id", "source", "lang", "n_chars"))
# crc32 of the digits, bit by bit.
_BIT = "case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
_CRC = f"""xor(4294967295, list_reduce(
  [4294967295::bigint] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint),
  lambda x, y: list_reduce([xor(x, y)] || range(8), lambda a, i: {_BIT})))"""

OP11 = f"""
with recursive docs as (
  select doc_id, lang, sha256({_HEAD} || {_hashed("text")}) as leaf,
    case when {_CRC} % 3 = 0 then sha256({_HEAD} || {_hashed(f"translate(text, {_LOWER})")}) end as changed
  from documents
),
leaves as (
  select *, dense_rank() over (order by lang nulls first) - 1 as tree, count(*) over (partition by lang) as n,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place
  from docs
),
up as (
  select 0 as level, tree, place, n, leaf as digest from leaves
  union all
  select level + 1, tree, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by place))
  from up where n > 1 group by level, tree, place // 8, n
),
roots as (select tree, digest as subroot, count(*) over () as n from up where n = 1),
top as (
  select 0 as level, tree as place, n, subroot as digest from roots
  union all
  select level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by place))
  from top where n > 1 group by level, place // 8, n
),
steps as (
  select level, tree, place, n,
    coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as after
  from (
    select * from up where n > 1
    union all select level + 1000, -1, place, n, digest from top where n > 1
  ) window run as (partition by level, tree, place // 8 order by place)
),
folded as (
  select 0 as level, tree, tree as own, place, n, row_number() over () as id,
    coalesce(changed, leaf) as digest, '' as proof from leaves
  union all
  select case when f.n = 1 then 1000 else f.level + 1 end,
    case when f.n = 1 then -1 else f.tree end, own,
    case when f.n = 1 then f.own else f.place // 8 end,
    case when f.n = 1 then (select count(*) from roots) else (f.n + 7) // 8 end,
    id,
    case when f.n = 1 then f.digest else sha256(s.before || f.digest || s.after) end,
    case when f.n = 1 then f.proof else f.proof || s.before || s.after end
  from folded f left join steps s on s.level = f.level and s.tree = f.tree and s.place = f.place
  where not (f.n = 1 and f.tree = -1)
),
ended as (select * from folded where n = 1 and tree = -1),
numbered as (select *, row_number() over () as id from leaves)
select doc_id, leaf, subroot, (select digest from top where n = 1) as root, sha256(proof) as proof_sha256,
  e.digest as folded_root, e.digest = (select digest from top where n = 1) as verified
from numbered l join ended e using (id) join roots r on r.tree = l.tree
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
with docs as (select doc_id, row_number() over (order by doc_id, text) as r, {_TERMS} as terms from documents),
counted as (select *, cast(len(terms) as bigint) as n from docs where len(terms) > 0),
totals as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from counted),
items as (select row_number() over () as q, * from (select distinct item_id, text from benchmark)),
wanted as (
  select q, item_id, term, cast(count(*) as bigint) as times
  from (select q, item_id, unnest({_TERMS}) as term from items) group by all
),
tf as (
  select r, doc_id, n, term, cast(count(*) as bigint) as tf
  from (select r, doc_id, n, unnest(terms) as term from counted) group by all
),
df as (select term, count(*) as df from tf group by term),
weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from df, totals
),
impacts as (
  select r, doc_id, term,
    w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) as impact
  from tf join weights using (term), totals
),
scores as (
  select q, item_id, r, doc_id, cast(sum(times * impact) as bigint) as score
  from wanted join impacts using (term) group by all
)
select item_id, cast(row_number() over best as int) as rank, doc_id, score from scores where score > 0
window best as (partition by q order by score desc, doc_id, r)
qualify row_number() over best <= 20
"""
