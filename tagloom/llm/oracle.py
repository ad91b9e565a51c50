"""SQL for the queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT_DEDUP = r"""
with texts as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
    from documents
)
select
    doc_id,
    min(doc_id) over same as keep_id,
    count(*) over same as group_size,
    doc_id = min(doc_id) over same as kept,
    text_sha256
from texts
window same as (partition by text_sha256)
"""

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w, least(13, len({_WORDS})) as n from benchmark),
windows as (
    select distinct item_id, n, w[i : i + n - 1] as win
    from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as i from b where n > 0)
),
places as (
    select doc_id, n, i, w[i : i + n - 1] as win
    from (
        select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i
        from d, (select distinct n from windows)
        where len(w) >= n
    )
),
hits as (select doc_id, i, p.n, item_id from places p join windows b on p.n = b.n and p.win = b.win),
hit as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits))
    group by doc_id
),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
    from (select distinct doc_id, item_id::varchar as item from hits)
    group by doc_id
)
select
    d.doc_id,
    len(w)::bigint as n_words,
    coalesce(n_hit, 0) as n_hit,
    coalesce(n_items, 0) as n_items,
    sha256(coalesce(list, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

JACCARD_JOIN = r"""
with recursive w as (
    select
        doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
),
shingles as (
    select distinct doc_id, unnest(case
        when len(w) = 0 then []
        when len(w) < 3 then [array_to_string(w, ' ')]
        else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
    end) as s
    from w
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as x, b.doc_id as y, count(*) as shared
    from shingles a join shingles b using (s)
    where a.doc_id < b.doc_id
    group by x, y
),
links as (
    select x, y from common
    join sizes p on p.doc_id = x
    join sizes q on q.doc_id = y
    where 100 * shared >= 90 * (p.n + q.n - shared)
),
edges as (select x, y from links union all select y, x from links),
reach as (
    select doc_id as x, doc_id as y from w
    union
    select r.x, e.y from reach r join edges e on r.y = e.x
)
select
    w.doc_id,
    coalesce(n, 0) as n_shingles,
    (select min(y) from reach r where r.x = w.doc_id) as component_id,
    (select count(*) from edges e where e.x = w.doc_id) as n_links
from w left join sizes using (doc_id)
"""

RANKED_SEARCH = f"""
with docs as (select doc_id, w, len(w) as n from (select doc_id, {_WORDS} as w from documents) where len(w) > 0),
facts as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
asked as (
    select item_id, t, count(*) as times
    from (select item_id, unnest({_WORDS}) as t from benchmark)
    group by item_id, t
),
found as (
    select doc_id, t, count(*) as tf
    from (select doc_id, unnest(w) as t from docs)
    where t in (select t from asked)
    group by doc_id, t
),
weights as (
    select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as weight
    from (select t, count(*) as df from found group by t), facts
),
impacts as (
    select doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) as impact
    from found join docs using (doc_id), facts
),
scores as (
    select item_id, doc_id, sum(times * weight * impact)::bigint as score
    from asked join weights using (t) join impacts using (t)
    group by item_id, doc_id
)
select item_id, rank, doc_id, score
from (
    select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank
    from scores where score > 0
)
where rank <= 10
"""

# crc32 by its table of 256 remainders, byte by byte.
SPELLING_VARIANTS = r"""
with recursive remainders(i, k, c) as (
    select range, 0, range from range(256)
    union all
    select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from remainders where k < 8
),
crc as (select list(c order by i) as of from remainders where k = 8),
runs as (
    select doc_id, word, count(*) as n
    from (
        select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word
        from documents
    )
    where length(word) >= 7
    group by doc_id, word
),
named as (select word, n, hex(doc_id || ':' || word) as h from runs),
bytes as (
    select word, n, list_transform(range(0, length(h) // 2), lambda i:
        (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) as b
    from named
),
hashed as (
    select word, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x:
        xor(c >> 8, of[(xor(c, x) & 255) + 1]))) as h
    from bytes, crc
),
cut as (
    select n, case when h % 31 = 0
        then word[: h % length(word)] || word[h % length(word) + 2 :]
        else word end as word
    from hashed
),
v as (
    select word, sum(n)::bigint as n, length(word) as size
    from cut where length(word) >= 7 group by word having sum(n) >= 2
),
less as (
    select word, size, i, word[: i - 1] || word[i + 1 :] as rest
    from (select word, size, unnest(range(1, size + 1)) as i from v)
),
pairs as (
    select a.word as x, b.word as y from less a join less b using (size, i, rest) where a.word <> b.word
    union
    select v.word, less.word from v join less on v.word = less.rest
    union
    select less.word, v.word from v join less on v.word = less.rest
),
near as (
    select x as word, count(*) as n_near, max(n) as most, first(y order by n desc, y) as best
    from pairs join v on y = v.word group by x
),
forms as (
    select v.word, v.n, coalesce(n_near, 0) as n_near,
        case when most >= 10 * v.n then best end as form, case when most >= 10 * v.n then most end as form_n
    from v left join near using (word)
),
ways as (
    select word, word as root from forms
    union
    select ways.word, form from ways join forms on ways.root = forms.word where form is not null
)
select forms.word, forms.form, ways.root, forms.n, forms.n_near, forms.form_n
from forms join ways using (word) join forms as last on last.word = ways.root
where last.form is null
"""

ALL = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_decontamination": DECONTAMINATION,
    "op9_jaccard_join": JACCARD_JOIN,
    "op12_ranked_search": RANKED_SEARCH,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
