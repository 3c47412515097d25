"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations


def quality_sql(rounds: int = 12, prior: float = 20.0, share: float = 0.8) -> str:
    """Features, vote patterns, and expectation-maximisation unrolled into one step a round."""
    votes = (
        ("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
        ("n_symbols * 4 > n_words", "n_symbols * 100 <= n_words"),
        ("n_repeat_words * 5 > n_words", "n_repeat_words * 20 <= n_words"),
        ("n_upper * 2 > n_letters", "n_upper * 5 <= n_letters"),
        ("n_exclaims * 5 > n_words", "n_exclaims * 20 <= n_words"),
        ("n_dup_lines * 2 > n_lines", "n_dup_lines = 0"),
        ("word_chars < 2 * n_words or word_chars > 20 * n_words", "word_chars between 3 * n_words and 12 * n_words"),
        ("n_letters * 2 < word_chars", "n_letters * 10 >= word_chars * 8"),
    )
    k = range(len(votes))
    good, bad = [0.01, 0.14, 0.85], [0.2, 0.1, 0.7]
    cast = lambda xs: "[" + ", ".join(f"cast({x!r} as double)" for x in xs) + "]"

    def posterior(model: str) -> str:
        odds = f"ln((1 - {model}.share) / {model}.share)" + "".join(f" + ln({model}.bad_{j}[v{j} + 1]) - ln({model}.good_{j}[v{j} + 1])" for j in k)
        return f"1.0 / (1.0 + exp({odds}))"

    steps = [f"m0 as (select cast({share!r} as double) as share, " + ", ".join(f"{cast(good)} as good_{j}, {cast(bad)} as bad_{j}" for j in k) + ")"]
    for i in range(rounds):
        rates = ", ".join(
            "[" + ", ".join(f"(coalesce(sum(case when v{j} = {v} then {w} * n end), 0.0) + {prior!r} * {first[v]!r}) / (sum({w} * n) + {prior!r})" for v in range(3)) + f"] as {kind}_{j}"
            for j in k for kind, w, first in (("good", "p", good), ("bad", "(1 - p)", bad))
        )
        steps.append(f"m{i + 1} as materialized (select (sum(p * n) + {prior!r} * {share!r}) / (sum(n) + {prior!r}) as share, {rates} from (select t.*, {posterior(f'm{i}')} as p from patterns t, m{i}))")
    digits = ", ".join(f"case when {b} then 0 when {g} then 2 else 1 end as v{j}" for j, (b, g) in enumerate(votes))
    names = ", ".join(f"v{j}" for j in k)
    return rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (select rid, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 9),
repeated as (
  select rid, i from (select rid, i, count(*) over (partition by rid, array_to_string(w[i:i + 7], ' ')) as c from windows) where c > 1),
covered as (
  select rid, cast(sum(least(8, i - last)) as bigint) as n from (
    select rid, i, coalesce(lag(i) over (partition by rid order by i), -8) as last from repeated) group by rid),
f as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(lines) as n_lines,
    length(body) - length(regexp_replace(body, '\p{{L}}', '', 'g')) as n_letters,
    length(body) - length(regexp_replace(body, '\p{{Lu}}', '', 'g')) as n_upper,
    length(body) - length(replace(body, '!', '')) as n_exclaims
  from d left join covered c using (rid)),
voted as materialized (select *, {digits} from f),
patterns as materialized (select {names}, count(*) as n from voted group by {names}),
{", ".join(steps)},
scored as (select t.*, {posterior(f"m{rounds}")} as p_good, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from voted t, m{rounds})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p_good >= 0.5 as kept, round(p_good, 6) as p_good
from scored"""


URLS = r"""
with u as (
  select page_id, coalesce(url, '') as url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
r as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
    regexp_matches(lower(url), '://([a-z0-9-]+\.)*[a-z0-9-]+\.edu(/|$|\?|#|:)') as allowed,
    regexp_matches(lower(url), '(^|[^a-z0-9])(cheap[-_.]pills|free[-_.]casino|online[-_.]casino|win[-_.]money|adult[-_.]video|hot[-_.]singles|payday[-_.]loan|porn|xxx)($|[^a-z0-9])')
      or regexp_matches(lower(url), '/(redirect|out|click)\?([^#]*&)?(url|to|target)=https?(:|%3a)')
      or regexp_matches(lower(url), '[?&;](phpsessid|jsessionid)=[a-z0-9]{8,}') as blocked
  from u)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when allowed then 'allow' when blocked then 'block' else 'allow' end as verdict
from r"""


MIX = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), text, '')) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as slot from s),
w as (select *, case slot % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as cap from r),
l as (
  select *, (1.5::double * (sum(source_size) over ()) - coalesce(sum(cap) over lower, 0)) / (sum(weight) over () - coalesce(sum(weight) over lower, 0)) as level
  from w window lower as (order by cap / weight, slot rows between unbounded preceding and 1 preceding)),
f as (select level from l where cap > weight * level order by cap / weight, slot limit 1),
t as (select source, source_size, case when cap <= weight * level then cap else weight * (select level from f) end as target from l),
c as (
  select d.*, t.source_size, t.target, cast(round(t.target) as bigint) as want,
    coalesce(sum(size) over (partition by d.source order by h, size rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(greatest(0, least(size, want - start)) + greatest(0, least(size, want - source_size - start)) as bigint) as taken
from c"""


LINES = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (
  select doc_id, cast(i as bigint) as i, trim(lines[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as line
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from d) where regexp_matches(lines[i], '[^\x20\x09-\x0D]')),
s as (select *, row_number() over (partition by doc_id order by i) as pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
v as (
  select t.k, s.doc_id, s.pos, string_agg(o.line, chr(10) order by o.pos) as body, sum(o.n) as n
  from s, (values (1), (2)) as t(k), s as o
  where o.doc_id = s.doc_id and o.pos between s.pos and s.pos + t.k - 1 group by t.k, s.doc_id, s.pos having count(*) = t.k),
later as (
  select * from (select *, row_number() over (partition by k, body order by doc_id, pos) as nth, count(*) over (partition by k, body) as copies from v)
  where nth > 1 and (k = 2 or n >= 50 or copies >= 10)),
gone as (
  select doc_id, list_sort(list(distinct s.i)) as gone, list_sort(list(distinct s.pos)) as spots from (select doc_id, unnest(range(pos, pos + k)) as pos from later) x
  join s using (doc_id, pos) group by doc_id),
r as (select d.*, coalesce(gone, []) as gone, coalesce(spots, []) as spots from d left join gone using (doc_id))
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(len(gone) as bigint) as n_removed,
  cast(len(list_filter(spots, lambda p: not list_contains(spots, p - 1))) as bigint) as n_runs,
  sha256(array_to_string(list_filter(lines, lambda x, i: not list_contains(gone, i)), chr(10))) as kept_sha256
from r"""
