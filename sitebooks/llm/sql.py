"""Checking SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from .url_filter import DOUBT, LEAST_WEIGHT, LIMIT, MOST_WEIGHT, TWO_LABELS, Rule

_SHRUNK = "(k + weight * mean) / (n + weight)"


def _weighted(name: str) -> str:
    """The groups of a step with the fitted weight of their prior ``mean``."""
    return f"""{name}_moments as (
      select sum(pow(k - n * mean, 2) - n * mean * (1 - mean)) as excess, sum(n * (n - 1) * mean * (1 - mean)) as pairs
      from {name}),
    {name}_weighted as (
      select g.*, case when coalesce(pairs, 0) = 0 or excess <= 0 then {MOST_WEIGHT}
                       else least(greatest(pairs / excess - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) end as weight
      from {name} g, {name}_moments)"""


def url_sql(rules: tuple[Rule, ...]) -> str:
    """The verdict of each page: the longest rule's, else by the lower bound of its host's bad rate."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))

    def fits(r: Rule) -> str:
        return f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"

    rule = " ".join(f"when {fits(r)} then '{r.host}{r.path}'" for r in ordered)
    stated = " ".join(f"when '{r.host}{r.path}' then '{r.verdict}'" for r in ordered)
    two = ", ".join(f"'{s}'" for s in TWO_LABELS)
    return f"""
    with outcomes as (
      select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
      from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
    placed as (
      select page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
    counted as (
      select host, count(bad) as n, coalesce(sum(bad), 0)::double as k,
             regexp_extract(regexp_replace(host, '^[^@]*@', ''), '^([^:]*?)\\.*(?::|$)', 1) as bare
      from placed left join outcomes using (page_id) group by host),
    split as (
      select *, string_split(bare, '.') as labels, len(string_split(bare, '.')) as parts,
             array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') as last_two
      from counted),
    hosts as (
      select host, n, k,
             case when parts = 1 or regexp_matches(bare, '^[0-9.]+$') then bare
                  when parts > 2 and last_two in ({two}) then array_to_string(list_slice(labels, -3, -1), '.')
                  else last_two end as domain,
             case when parts = 1 or regexp_matches(bare, '^[0-9.]+$') then bare
                  when parts > 2 and last_two in ({two}) then last_two
                  else labels[-1] end as suffix
      from split),
    root as (select (sum(k) + 0.5) / (sum(n) + 1.0) as mean from hosts),
    suffixes as (
      select suffix, sum(n) as n, sum(k) as k, any_value(mean) as mean from hosts, root group by suffix),
    {_weighted("suffixes")},
    domains as (
      select h.domain, sum(h.n) as n, sum(h.k) as k,
             any_value((s.k + s.weight * s.mean) / (s.n + s.weight)) as mean
      from hosts h join suffixes_weighted s using (suffix) group by h.domain),
    {_weighted("domains")},
    members as (
      select h.host, h.n, h.k, (d.k + d.weight * d.mean) / (d.n + d.weight) as mean
      from hosts h join domains_weighted d using (domain)),
    {_weighted("members")},
    rates as (select host, n, weight, {_SHRUNK} as rate from members_weighted),
    verdicts as (
      select host, case when rate - sqrt(rate * (1 - rate) / (n + weight + 1)) * sqrt({(1 - DOUBT) / DOUBT}) > {LIMIT}
                        then 'block' else 'allow' end as reputation
      from rates),
    ruled as (select page_id, host, path, case {rule} end as rule from placed)
    select page_id, host, path, rule,
           case rule {stated} else reputation end as verdict
    from ruled join verdicts using (host)
    """
