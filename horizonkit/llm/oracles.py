"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from horizonkit.llm.secret_scan import BASE_KINDS, PEM_BEGIN, PEM_END, PEM_LAST, PEM_LINE, RULES


def _keys(rank: int) -> str:
    """Private keys: the text is split at BEGIN lines; a key reaches to its END line, else over its leading key lines."""
    begin, end, line, last = (p.replace("'", "''") for p in (PEM_BEGIN, PEM_END, PEM_LINE, PEM_LAST))
    lengths = "list_sum(list_transform({}, lambda x: length(x)))"
    return f"""
    select doc_id, {rank} as rank, 'pem' as kind, {{'a': a, 'n': length(mark) + case
        when regexp_matches(after, '{end}')
            then length(string_split_regex(after, '{end}')[1]) + length(regexp_extract(after, '{end}'))
        when rest > 0 then size + rest else greatest(size - 1, 0) end}} as s
    from (select *, coalesce(list_sum(list_transform(own[1:filled], lambda x: length(x) + 1)), 0) as size,
                 case when len(own) < len(lines) and filled = len(own)
                      then length(regexp_extract(lines[filled + 1], '{last}', 1)) else 0 end as rest
          from (select *, coalesce(list_max(list_transform(range(1, len(own) + 1), lambda i:
                              case when regexp_matches(own[i], '[A-Za-z0-9+/=]') then i end)), 0) as filled
                from (select *, lines[1:coalesce(nullif(list_position(flags, false), 0), len(lines) + 1) - 1] as own
                      from (select *, list_transform(lines, lambda x: regexp_matches(x, '{line}')) as flags
                            from (select doc_id, m[i] as mark, g[i + 1] as after,
                                         string_split(regexp_replace(g[i + 1], '\\\\[nr]', ' ' || chr(10), 'g'), chr(10)) as lines,
                                         {lengths.format("g[1:i]")} + coalesce({lengths.format("m[1:i - 1]")}, 0) as a
                                  from (select *, unnest(range(1, len(m) + 1)) as i
                                        from (select doc_id, regexp_extract_all(t, '{begin}') as m,
                                                     string_split_regex(t, '{begin}') as g from texts)))))))"""


def _matches(rule, rank: int) -> str:
    """Spans of one rule: lengths of the gaps and matches before give the positions."""
    if rule.pattern == PEM_BEGIN:
        return _keys(rank)
    pattern = rule.pattern.replace("'", "''")
    measured = f"regexp_extract_all(t, '{pattern}', {rule.measured})"
    return f"""
    select doc_id, {rank} as rank, '{rule.kind}' as kind, unnest(list_transform(
        list_filter(range(1, len(m) + 1), lambda i: length(w[i]) >= {rule.least}),
        lambda i: {{'a': list_sum(list_transform(g[1:i], lambda x: length(x)))
                        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                   'n': length(m[i])}})) as s
    from (select doc_id, regexp_extract_all(t, '{pattern}') as m, {measured} as w,
                 string_split_regex(t, '{pattern}') as g from texts)"""


def secret_scans() -> str:
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(
        f"coalesce(count(*) filter (kind = '{k}'), 0)::bigint as n_{k}" for k in BASE_KINDS
    )
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(_matches(r, i) for i, r in enumerate(RULES))}),
spans as (select doc_id, rank, kind, s.a::bigint as a,
                 kind || ':' || s.a::bigint || ':' || (s.a + s.n)::bigint as span from found),
per_doc as (select doc_id, {counts}, string_agg(span, ',' order by a, rank) filter (kind in ({base})) as base,
                   string_agg(span, ',' order by a, rank) as spans from spans group by doc_id)
select d.doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in BASE_KINDS)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc p on d.doc_id = p.doc_id"""
