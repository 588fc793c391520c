"""DuckDB oracle SQL for the whole ingest runs."""

from __future__ import annotations

from gleaner.plans.oracle_links import ARTICLE, LINKS, absolutize, file_path, text_of

RUNS = f"""with {LINKS},
site as (select page_id, url as page_url, html, regexp_extract(url, '(example\\.(com|net|org))', 1) as base from pages),
rows_of as (
  select l.page_id, l.pos, l.title, s.base, s.page_url, {absolutize('l.href', 's.base')} as url
  from links l join site s using (page_id) where s.base <> '' and l.pos < 20
  union all
  select l.page_id, -1, l.title, s.base, s.page_url, case s.base when 'example.net' then l.href else s.base || substr(l.href, 2) end
  from links l join site s using (page_id) where l.pos = 0 and s.base in ('example.net', 'example.org')),
good as (select * from rows_of where url is not null and url <> ''),
one as (select * from good where starts_with(page_url, 'http://') qualify row_number() over (partition by url order by page_id, pos) = 1),
two as (select * from good where url not in (select url from one) qualify row_number() over (partition by url order by page_id, pos) = 1),
arts as (select *, false as is_new from one union all select *, true from two),
fetched as (
  select base || regexp_extract(html, '<li><a href="([^"]*)"', 1) as url, page_id, html from site
  qualify row_number() over (partition by url order by page_id) = 1),
body as (select url, case when contains(html, '<article>') then {text_of(ARTICLE)} end as text from fetched
         where contains(url, 'example.')),
full_rows as (
  select arts.url, arts.title, split_part(base, '.', 2) as source, base, body.text, is_new,
         {file_path('arts.title', "split_part(base, '.', 2)", 'null::varchar')} as path
  from arts left join body on body.url = arts.url)
"""


def value(x: str) -> str:
    return f"coalesce(to_json({x})::varchar, 'null')"


BODY = (f"""'{{"title": ' || {value('title')} || ', "publish_date": null, "url": ' || {value('url')} || ', "source_url": ' """
        f"""|| {value('base')} || ', "source": ' || {value('source')} || ', "text": ' || {value('text')} || '}}'""")

SQL = {
    "ingest_run": RUNS + """select url, path as article_file_path, title, source, null::varchar as publish_date,
        coalesce(length(text) > 0, false) as has_text, is_new,
        case when coalesce(length(text) > 0, false) then 'retrieve' else 'browse' end as route from full_rows""",
    "document_table": RUNS + f"""select path, url, 'json' as kind, md5({BODY}) as body_md5,
        length({BODY})::bigint as n_chars from full_rows""",
}
