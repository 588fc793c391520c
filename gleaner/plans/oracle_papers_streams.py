"""DuckDB oracle SQL for the paper listing and the streaming queries (the
streams are checked against the batch result they must equal)."""

from __future__ import annotations

from gleaner.plans.oracle_folding import SQL as FOLDING
from gleaner.plans.oracle_links import LINKS, file_path

PAPERS = """with c as (select conv_id, turn, role, text, case when turn < 2 then 0 else 1 end as sec
                   from conversations),
        dt as (select conv_id, turn, sec, row_number() over (partition by {part} order by turn) - 1 as pos
               from c where role = 'user'),
        nx as (select d.*, (select min(a.turn) from c a where a.conv_id = d.conv_id and a.sec = d.sec
                            and a.role = 'assistant' and a.turn > d.turn) as dd_turn from dt d)
        select nx.conv_id as page_id, {sec}::integer as section_pos, nx.pos::integer as pos,
               'https://arxiv.org/abs/' || nx.conv_id::varchar || '.' || nx.turn::varchar as url,
               'https://arxiv.org/pdf/' || nx.conv_id::varchar || '.' || nx.turn::varchar as pdf_url,
               case when a.turn is not null then regexp_replace(a.text, '^\\s+|\\s+$', '', 'g') end
                 as title,
               case when a.turn is not null then 'assistant|conv' || nx.conv_id::varchar else '' end as authors,
               strftime(date '2024-01-01' + (nx.conv_id + {sec})::integer, '%Y-%m-%d') as publish_date
        from nx left join c a on a.conv_id = nx.conv_id and a.turn = nx.dd_turn
        where nx.pos < 20"""

SQL = {
    "paper_listing": PAPERS.format(part="conv_id, sec", sec="nx.sec"),
    "paper_listing_compat": PAPERS.format(part="conv_id", sec="(select min(f.sec) from c f where f.conv_id = nx.conv_id)"),
    # run = the arrival of the first page that shows the link
    "stream_ingest": f"""with {LINKS},
        b as (select *, (page_id % 4)::integer as run from abs_links where url is not null and url <> ''
              qualify row_number() over (partition by url order by page_id % 4, page_id, pos) = 1)
        select url, {file_path('title', 'source', 'null::varchar')} as article_file_path, title, source,
               null::varchar as publish_date, coalesce(length(title) > 0, false) as has_text, run = 3 as is_new, run
        from b""",
    "stream_state": FOLDING["state_last_write"],
}
