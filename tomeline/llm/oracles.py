"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .mixing import SEEDS, WEIGHTS
from .url_filter import GAP, GLOBS, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, g from windows group by doc_id, g having count(*) > 1),
again as (select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(3)) as k from windows join twice using (doc_id, g)) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
base as (
  select d.doc_id, text, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(a.n, 0) as bigint) as n_repeat_words
  from d join lines using (doc_id) left join again a using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or n_symbols * 10 > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
  or n_dup_lines * 2 > len(string_split(text, chr(10))) or length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) * 2 < word_chars or length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) * 5 > word_chars * 2
  or len(regexp_extract_all(text, '\.\.\.|\x{{2026}}|(^|\n)[ \t]*[-\x{{2022}}\x{{25cf}}]')) * 10 > n_words or contains(lower(text), 'lorem ipsum')) as kept
from judged
"""

NEAR_DUPS = rf"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) in (1, 2)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.c >= 85 * (x.n + y.n - p.c)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on l.a = r.b),
top as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, t.component_id, d.doc_id = t.component_id as kept from d left join sizes s using (doc_id) join top t using (doc_id)
"""

REPEATS = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
owner as (select g, min(doc_id) as first_doc from windows group by g),
gone as (select distinct doc_id, i + k as p from (select doc_id, i, unnest(range(13)) as k from windows join owner using (g) where first_doc < doc_id)),
places as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
rest as (select p.doc_id, count(g.p) as n_removed, string_agg(case when g.p is null then word end, ' ' order by p.p) as kept from places p left join gone g on g.doc_id = p.doc_id and g.p = p.p group by p.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join rest using (doc_id)
"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


def _glob(glob: str) -> str:
    host, path = glob.split(GAP)
    return f"chost like '{host.replace('*', '%')}'" if host != "*" else f"cpath like '{path.replace('*', '%')}'"


_BY_LENGTH = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_RULE = "case " + " ".join(f"when {_fits(h, p)} then '{h}{p}'" for _, h, p in _BY_LENGTH) + " end"
_GLOB = "case " + " ".join(f"when {_glob(g)} then '{g.replace(GAP, '|')}'" for g in GLOBS) + " end"
_VERDICT = "case " + " ".join(f"when rule = '{h}{p}' then '{v}'" for v, h, p in RULES) + " when \"glob\" is not null then 'block' else 'allow' end"

URLS = rf"""
with recursive parts as (select page_id, {_FOLD.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
plain(text, now) as (select distinct x, x from (select host as x from parts union select path from parts) union all select text, url_decode(now) from plain where url_decode(now) <> now),
decoded as (select text, arg_min(regexp_replace(lower(now), '[\x01-\x20]+', '', 'g'), length(now)) as now from plain group by text),
ruled as (select *, {_RULE} as rule from parts),
spelt as (select r.*, concat('.', trim(regexp_replace(regexp_replace(h.now, '^.*@', ''), ':[0-9]*$', ''), '.'), '.') as chost, regexp_replace(p.now, '/([.]?/)+', '/', 'g') as cpath
  from ruled r join decoded h on h.text = r.host join decoded p on p.text = r.path),
judged as (select *, case when rule is null then {_GLOB} end as "glob" from spelt)
select page_id, host, path, rule, {_VERDICT} as verdict, "glob" from judged
"""

_WEIGHT = "case (row_number() over (order by source nulls last) - 1) % 3 " + " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS)) + " end"

MIXING = rf"""
with d as (select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, count(*) as n_docs from d group by source),
weighed as (select *, cast({_WEIGHT} as bigint) as weight from sources),
total as (select cast(sum(source_size) as bigint) as t from weighed),
-- Caps bind first where size over weight is least; what stays uncapped begins at the first source that its level doesn't cap.
levels as (select *, 3.0 * source_size / weight as ratio, t - coalesce(sum(3 * source_size) over (order by 3.0 * source_size / weight rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (order by 3.0 * source_size / weight rows between current row and unbounded following) as share from weighed cross join total),
chosen as (select cast(rest as bigint) as rest, cast(share as bigint) as share from levels where cast(rest as double) / share <= ratio order by ratio limit 1),
goal as (select source, source_size, n_docs, least(cast(rest as double) * weight / share, cast(3 * source_size as double)) as target from weighed cross join chosen),
rated as (select *, case when source_size > 0 then target / source_size else 0 end as rate from goal),
shared as (select *, lower(lpad(to_hex(cast(ceil((rate - floor(rate)) * 4503599627370496.0::double) as bigint)), 14, '0')) as share from rated),
tried as (select g.source, s.at, sum(case when concat('0', substr(md5(concat('mix:', cast(s.at as varchar), ':', cast(d.doc_id as varchar))), 1, 13)) < g.share then d.size else 0 end) as more
  from d join shared g on g.source is not distinct from d.source cross join (select unnest(range({SEEDS})) as at) s group by g.source, s.at),
nearest as (select *, row_number() over (partition by t.source order by abs(cast(floor(g.rate) * g.source_size + t.more as double) - g.target), t.at) as nr from tried t join shared g on g.source is not distinct from t.source),
final as (select d.*, n.source_size, n.target, cast(floor(n.rate) as bigint) + case when concat('0', substr(md5(concat('mix:', cast(n.at as varchar), ':', cast(d.doc_id as varchar))), 1, 13)) < n.share then 1 else 0 end as copies
  from d join nearest n on n.source is not distinct from d.source where n.nr = 1)
select doc_id, size, source_size, target, copies * size as taken, source, cast(copies as bigint) as copies from final
"""

#: Lines are the pieces between line ends; the first k of them with their ends are the text's first k units.
FILL_MIDDLE = """
with cut as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as parts, sha256(concat('7:', coalesce(cast(doc_id as varchar), ''))) as digest from documents),
units as (select *, len(parts) - case when parts[len(parts)] = '' then 1 else 0 end as n,
  cast(concat('0x', substr(digest, 1, 8)) as bigint) as h1, cast(concat('0x', substr(digest, 9, 8)) as bigint) as h2, cast(concat('0x', substr(digest, 25, 8)) as bigint) as h4 from cut),
bounds as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high from units),
slices as (select *, case when low = 0 then '' when low = n then text else concat(array_to_string(parts[1:low], chr(10)), chr(10)) end as prefix,
  case when high = 0 then '' when high = n then text else concat(array_to_string(parts[1:high], chr(10)), chr(10)) end as before,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from bounds),
made as (select *, substr(before, length(prefix) + 1) as middle, substr(text, length(before) + 1) as suffix from slices)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
  sha256(text) as restored_sha256 from made
"""
