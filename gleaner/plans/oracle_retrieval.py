"""DuckDB oracle SQL for the retrieval queries."""

from __future__ import annotations

from gleaner.plans.oracle_links import TITLES, file_path


def tokens(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


def bucket(w: str) -> str:
    return f"(('0x' || substr(md5({w}), 1, 8))::bigint % 64)"


CHUNKS = f"""
tk as (select doc_id, {tokens('text')} as tk from documents),
nc as (select doc_id, tk, greatest(1, ceil((len(tk) - 200) / 824.0))::bigint as nc from tk),
ci as (select doc_id, tk, nc, unnest(range(nc)) as i from nc),
chunks as (select doc_id, i::integer as chunk_pos, nc,
                  tk[i * 824 + 1 : i * 824 + 1024] as toks,
                  array_to_string(tk[i * 824 + 1 : i * 824 + 1024], ' ') as text from ci)
"""


def topk(pairs: str, k: int, q: str = "query_id", c: str = "vec_id") -> str:
    return f"""select {q}, {c}, round(s, 6) as sim, rnk::integer as rnk from (
        select *, row_number() over (partition by {q} order by round(s, 9) desc, {c}) as rnk from ({pairs}))
        where rnk <= {k}"""


COS = "list_cosine_similarity(q.embedding::double[], c.embedding::double[])"

NAMES = f"""{TITLES}, names as (select page_id as doc_id,
    substr({file_path('title', 'source', 'null::varchar')}, 6) as name from titles)"""

LEVEL = """select doc_id, g as pos, string_agg(text, ' ' order by pos) as text,
                  ceil(max(n) / 4.0)::bigint as n
           from (select *, pos // 4 as g from {src} {where}) group by doc_id, g"""


def level(src: str, first: bool) -> str:
    red = LEVEL.format(src=src, where="" if first else "where n > 1")
    return red if first else f"{red} union all select doc_id, pos, text, n from {src} where n <= 1"


def vectors(src: str, key: str, text: str, name: str) -> str:
    """CTEs of sparse vectors: {name}_b (key, b, c) and {name}_n (key, nrm)."""
    return f"""{name}_b as materialized (select {key}, {bucket('w')} as b, count(*)::double as c from
                 (select {key}, unnest({tokens(f'lower({text})')}) as w from {src}) group by all),
        {name}_n as (select {key}, sqrt(sum(c * c)) as nrm from {name}_b group by {key})"""


PASSAGES = f"""with {CHUNKS},
        stored as (select doc_id, text, min(chunk_pos) as chunk_pos from chunks group by doc_id, text),
        tools as (select doc_id * 2 as tool_id, 'A tool to query the document ' || text as t from documents
                  union all select doc_id * 2 + 1, 'A tool to summarize the document ' || text from documents),
        {vectors('tools', 'tool_id', 't', 'c')}, {vectors('benchmark', 'item_id', 'text', 'q')},
        tool_pairs as (select q_n.item_id, c_n.tool_id, d / (q_n.nrm * c_n.nrm) as s from
            (select item_id, tool_id, sum(q_b.c * c_b.c) as d from q_b join c_b using (b) group by all)
            join q_n using (item_id) join c_n using (tool_id)),
        picked as (select distinct item_id, tool_id // 2 as doc_id from
            (select *, row_number() over (partition by item_id order by round(s, 9) desc, tool_id) as r from tool_pairs) where r <= 3),
        {vectors('stored', 'doc_id, chunk_pos', 'text', 'p')},
        pairs as (select q_n.item_id, p_n.doc_id, p_n.chunk_pos, coalesce(d, 0) / (q_n.nrm * p_n.nrm) as s
            from picked join q_n using (item_id) join p_n using (doc_id)
            left join (select item_id, doc_id, chunk_pos, sum(q_b.c * p_b.c) as d
                       from picked join q_b using (item_id) join p_b using (doc_id, b) group by all) using (item_id, doc_id, chunk_pos)),
        best as (select *, row_number() over (partition by item_id order by round(s, 9) desc,
                     doc_id::varchar || ':' || chunk_pos::varchar) as rnk from pairs)
        select item_id, rnk::integer as rnk, doc_id, chunk_pos, md5(text) as passage_md5, round(s, 6) as sim
        from best join stored using (doc_id, chunk_pos) where rnk <= 2"""


SQL = {
    "doc_vectors": f"""with {vectors('documents', 'doc_id', 'text', 'd')}
        select o.doc_id, i::integer as dim, round(coalesce(c, 0.0) / coalesce(nrm, 1.0), 9) as x
        from documents o cross join range(64) t(i) left join d_b on d_b.doc_id = o.doc_id and d_b.b = i
        left join d_n on d_n.doc_id = o.doc_id""",
    "passage_topk": PASSAGES,
    "topk_labels": f"""with {vectors('documents', 'doc_id', 'text', 'd')}, {vectors('benchmark', 'item_id', 'text', 'q')},
        allowed as (select item_id, case item_id % 3 when 0 then [] when 1 then ['en'] else ['de', 'fr'] end as labels from benchmark),
        pairs as (select q_n.item_id, d_n.doc_id, coalesce(dot, 0) / (q_n.nrm * d_n.nrm) as s
            from q_n cross join d_n join allowed using (item_id) join documents using (doc_id)
            left join (select item_id, doc_id, sum(q_b.c * d_b.c) as dot from q_b join d_b using (b) group by all) using (item_id, doc_id)
            where len(labels) = 0 or list_contains(labels, lang))
        """ + topk("select * from pairs", 2, "item_id", "doc_id"),
    "chunk_docs": f"""with {CHUNKS} select doc_id, chunk_pos, len(toks)::integer as n_tokens,
        md5(text) as chunk_md5 from chunks""",
    "embed_hash": f"""with w as (select doc_id, unnest({tokens('lower(text)')}) as w from documents)
        select doc_id, {bucket('w')} as bucket, count(*) as cnt from w group by all""",
    "vector_topk": topk(f"select q.vec_id as query_id, c.vec_id, {COS} as s from embeddings q, embeddings c "
                        "where q.vec_id <> c.vec_id", 2),
    "topk_filtered": topk(f"select q.vec_id as query_id, c.vec_id, {COS} as s from embeddings q, embeddings c "
                          "where q.vec_id <> c.vec_id and c.label in (1, 3, 5)", 2),
    "topk_by_doc": topk(f"select q.vec_id as query_id, c.vec_id, {COS} as s from embeddings q, embeddings c "
                        "where q.vec_id <> c.vec_id and q.label = c.label", 2),
    "two_level_topk": """with
        el as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings),
        cent as (select label, list(m order by d) as cv from (select label, d, avg(x) as m from el group by label, d)
                 group by label),
        g as (select qid, label from (
                select q.vec_id as qid, c.label,
                       row_number() over (partition by q.vec_id
                         order by round(list_cosine_similarity(q.embedding::double[], c.cv), 9) desc, c.label) as r
                from embeddings q, cent c) where r <= 3),
        p as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) as s
              from embeddings q join g on g.qid = q.vec_id join embeddings c on c.label = g.label
              where c.vec_id <> q.vec_id)
        """ + topk("select * from p", 2),
    "tool_catalog": f"""with {NAMES}
        select doc_id, 'vector' as kind, 'vector_tool_' || name as tool_name,
               'A tool to query the document ' || name as description from names
        union all
        select doc_id, 'summary', 'summary_tool_' || name, 'A tool to summarize the document ' || name from names""",
    "catalog_topk": f"""with {NAMES},
        cat as (select doc_id * 2 as tool_id, 'A tool to query the document ' || name as description from names
                union all select doc_id * 2 + 1, 'A tool to summarize the document ' || name from names),
        cb as (select id, {bucket('w')} as b, count(*)::double as c from
                 (select tool_id as id, unnest({tokens('lower(description)')}) as w from cat) group by all),
        qb as (select id, {bucket('w')} as b, count(*)::double as c from
                 (select item_id as id, unnest({tokens('lower(text)')}) as w from benchmark) group by all),
        cn as (select id, sqrt(sum(c * c)) as nrm from cb group by id),
        qn as (select id, sqrt(sum(c * c)) as nrm from qb group by id),
        dot as (select qb.id as qid, cb.id as cid, sum(qb.c * cb.c) as d from qb join cb on qb.b = cb.b group by all),
        pairs as (select qn.id as item_id, cn.id as tool_id, coalesce(dot.d, 0) / (qn.nrm * cn.nrm) as s
                  from qn cross join cn left join dot on dot.qid = qn.id and dot.cid = cn.id)
        """ + topk("select * from pairs", 3, "item_id", "tool_id"),
    "tree_reduce": f"""with {CHUNKS},
        l0 as (select doc_id, chunk_pos::bigint as pos, text, nc as n from chunks),
        l1 as ({level('l0', True)}),
        l2 as ({level('l1', False)}),
        l3 as ({level('l2', False)}),
        l4 as ({level('l3', False)})
        select doc_id, md5(text) as summary_md5, length(text)::bigint as n_chars from l4""",
    "index_idempotent": f"""with {CHUNKS}
        select doc_id, md5(text) as chunk_hash, min(chunk_pos) as chunk_pos from chunks group by doc_id, md5(text)""",
}
