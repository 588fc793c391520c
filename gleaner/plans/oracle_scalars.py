"""DuckDB oracle SQL for the scalar / document / browse queries."""

from __future__ import annotations

from gleaner.operators import browse as B
from gleaner.plans.oracle_links import LINKS, REGISTRY, TITLES, file_path


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


AS_OF = "date '2025-01-31'"
FORMATS = ["%B %d, %Y", "%b %d, %Y", "%m.%d.%Y", "%d/%m/%Y"]


def cascade(x: str) -> str:
    parsed = ", ".join(f"try_strptime({x}, '{f}')" for f in FORMATS)
    rel = (f"case when regexp_extract({x}, '(\\d+) giorni fa', 1) <> '' then "
           f"({AS_OF} - cast(regexp_extract({x}, '(\\d+) giorni fa', 1) as integer))::timestamp end")
    return f"strftime(coalesce({parsed}, {rel}), '%Y-%m-%d')"


RENDERED = """select o_orderkey,
      case o_orderpriority when '1-URGENT' then strftime(o_orderdate, '%B %-d, %Y')
                           when '2-HIGH' then strftime(o_orderdate, '%b %-d, %Y')
                           when '3-MEDIUM' then strftime(o_orderdate, '%m.%d.%Y')
                           when '4-NOT SPECIFIED' then strftime(o_orderdate, '%d/%m/%Y')
                           else 'order ' || o_orderkey::varchar end as raw
    from orders"""

SEC = "'^(\\w{3}), (\\d{1,2} \\w{3} \\d{4})'"

STEM_NAME = "regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)"

PROMPT_HEADER = (f"printf({q(B.PROMPT_HEADER)}, coalesce(title, 'None'), coalesce(source, 'None'), "
                 f"coalesce(publish_date, 'None'), coalesce(url, 'None'))")
ROUTE_TEXT = f"case when coalesce(has_text, false) then {q(B.ROUTE_RETRIEVE)} else {q(B.ROUTE_BROWSE)} end"

SQL = {
    "path_collisions": f"""with {TITLES}, p as (select page_id, {file_path('title', 'source', 'null::varchar')} as path from titles),
          f as (select page_id, substr(path, 6) as article_file_path from p)
        select article_file_path, count(*) as n_articles, max(page_id)::varchar as stored_page
        from f group by article_file_path having count(*) > 1""",
    "date_attr": """with r as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as raw from orders)
        select o_orderkey, raw, split_part(raw, 'T', 1) as publish_date from r""",
    "date_cascade": f"with r as ({RENDERED}) select o_orderkey, raw, {cascade('raw')} as publish_date from r",
    "date_relative": f"""with r as (select p_partkey, p_size::varchar || ' giorni fa' as raw from part)
        select p_partkey, raw, {cascade('raw')} as publish_date from r""",
    "section_date": f"""with r as (select o_orderkey,
            case when o_orderstatus = 'P' then 'New submissions for ' || strftime(o_orderdate, '%a, %-d %b %Y')
                 else strftime(o_orderdate, '%a, %-d %b %Y') || ' (showing first entries)' end as section_head
          from orders)
        select o_orderkey, section_head,
          case when lower(regexp_extract(section_head, {SEC}, 1)) in ('mon','tue','wed','thu','fri','sat','sun')
               then strftime(try_strptime(regexp_extract(section_head, {SEC}, 2), '%d %b %Y'), '%Y-%m-%d') end
            as publish_date
        from r""",
    "safe_filename": f"""with {TITLES} select page_id, substr({file_path('title', 'source', 'null::varchar')}, 6) as file_name from titles""",
    "camel_case": """with s as (select distinct event_type || '_' || event_type || '_log' as snake from events)
        select snake, array_to_string(list_transform(string_split(snake, '_'),
               lambda x: upper(x[1]) || lower(x[2:])), '') as camel from s""",
    "run_date": f"select doc_id, strftime({AS_OF}, '%Y-%m-%d') as run_date from documents",
    "doc_stem": f"""select page_id, lower(case when regexp_matches({STEM_NAME}, '^.+\\.[^.]+$')
                                   and not regexp_matches({STEM_NAME}, '^\\.[^.]*$')
                              then regexp_extract({STEM_NAME}, '^(.*)\\.[^.]+$', 1) else {STEM_NAME} end) as stem
        from pages""",
    "json_path_get": """select event_id, json_extract_string(props, '$.k') as k,
        coalesce(json_extract_string(props, '$.z'), 'default') as z from events""",
    "doc_json": """select doc_id, '{"title": null, "source": "' || source || '", "lang": "' || lang || '", "text": ' || coalesce(to_json(text)::varchar, 'null') || '}' as body
        from documents""",
    "doc_kind": """with p as (select page_id, case when ends_with(url, '.html')
                    then regexp_replace(url, '\\.html$', '.pdf') end as pdf_url from pages)
        select page_id, pdf_url, case when nullif(pdf_url, '') is not null then 'pdf' else 'json' end as kind from p""",
    "pending_downloads": """with p as (select page_id, url, case when ends_with(url, '.html')
                    then regexp_replace(url, '\\.html$', '.pdf') end as pdf_url from pages)
        select page_id, pdf_url from p w where nullif(pdf_url, '') is not null
          and not exists (select 1 from p f where starts_with(f.url, 'https://blog.') and f.pdf_url = w.pdf_url)""",
    "paged_concat": """with d as (select conv_id, count(*) as n_pages, string_agg(text, '' order by turn) as body
                      from conversations group by conv_id)
        select conv_id, n_pages, md5(body) as body_md5, length(body)::bigint as n_chars from d""",
    "day_part": """select case when hour(ts) between 5 and 11 then 'morning'
                          when hour(ts) between 12 and 17 then 'afternoon' else 'evening' end as part,
                      count(*) as n from events group by 1""",
    "classify_commands": """with c as (select event_id,
            case when event_type = 'signup' then '/bye'
                 when event_type in ('view', 'click') then json_extract_string(props, '$.k')
                 else event_type end as cmd from events)
        select event_id, cmd,
          case when regexp_full_match(trim(cmd), '[+-]?0*[1-4]?[0-9]') and try_cast(cmd as integer) >= 0 then 'option'
               when regexp_full_match(trim(cmd), '[+-]?[0-9]+') then 'invalid'
               when cmd = '/bye' then 'exit' else 'query' end as kind from c""",
    "flag_split": """select d.source,
          coalesce(min(case when coalesce(l.quality = 1, false) then d.doc_id end), -1) as first_flagged,
          count(*) filter (where coalesce(l.quality = 1, false)) as n_flagged,
          count(*) filter (where not coalesce(l.quality = 1, false)) as n_rest
        from documents d left join labels l on d.doc_id = l.doc_id group by d.source""",
    "route_articles": f"""with {LINKS}, {REGISTRY}
        select url, case when has_text then 'retrieve' else 'browse' end as route from registry""",
    "prompt_table": f"""with {LINKS}, {REGISTRY},
        h as (select url, {PROMPT_HEADER} as header, {ROUTE_TEXT} as rt from registry)
        select url, 0 as option, printf({q(B.PROMPT_TEMPLATES[0])}, header, rt) as prompt from h
        union all select url, 1, printf({q(B.PROMPT_TEMPLATES[1])}, header, rt) from h
        union all select url, 2, printf({q(B.PROMPT_TEMPLATES[2])}, header) from h""",
    "lookup_article": f"""with {LINKS}
        select url, title, page_id from abs_links
        where url in (select url from abs_links where pos = 0)
        qualify row_number() over (partition by url order by page_id, pos) = 1""",
    "new_or_all": f"""with {LINKS}, {REGISTRY},
        old_reg as (select url, false as is_new from old_rows)
        select 'with_new' as variant, url, is_new from registry
          where is_new or not exists (select 1 from registry where is_new)
        union all
        select 'no_new', url, is_new from old_reg
          where is_new or not exists (select 1 from old_reg where is_new)""",
    "article_listing": """with l as (select conv_id, turn,
            chr(9) || printf('%d) %s - %s, %s', (row_number() over (partition by conv_id order by turn)) - 1,
                             text, role, turn::varchar) || chr(10) as line
          from conversations)
        select conv_id, count(*) as n_lines, md5(string_agg(line, '' order by turn)) as listing_md5
        from l group by conv_id""",
}
