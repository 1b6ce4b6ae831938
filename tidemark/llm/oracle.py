"""The same results as plain SQL, where SQL can express them."""

from __future__ import annotations

from tidemark.llm import decontaminate, linededup, manifest

ORACLE: dict[str, str] = {}

ORACLE["op3_line_dedup"] = f"""
with split as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
    from documents
), facts as (
    select *, len(regexp_extract_all(line, '{linededup.WORD}')) as words,
        ('0x' || substr(md5(string_agg(md5(line), '') over (
            partition by doc_id order by i rows between {linededup.WINDOW - 1} preceding and current row)), 1, 8))::bigint as rolled,
        lead(len(regexp_extract_all(line, '{linededup.WORD}')), 1, 0) over (partition by doc_id order by i) as next_words,
        i = max(i) over (partition by doc_id) as is_last
    from split
), cut as (
    select *, is_last or words >= {linededup.LINE_WORDS} or next_words >= {linededup.LINE_WORDS}
        or i > 1 and i < max(i) over (partition by doc_id) - 1 and rolled < least(lag(rolled, 1, 4294967296) over w, lead(rolled, 1, 4294967296) over w) as ends
    from facts window w as (partition by doc_id order by i)
), placed as (
    select *, coalesce(sum(ends::int) over (
        partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk,
        sum(words) over (partition by doc_id order by i) as upto, sum(words) over (partition by doc_id) as total
    from cut
), spans as (
    select doc_id, first, last from (
        select doc_id, min(i) as first, max(i) as last, count(*) as size, sum(words) as words from placed group by doc_id, chunk
    ) where words >= case when size > 1 then {linededup.CHUNK_WORDS} else {linededup.LINE_WORDS} end
    union
    select a.doc_id, a.i, b.i from placed a join placed b on a.doc_id = b.doc_id and a.words > 0
        and b.upto - b.words < a.upto - a.words + {linededup.PASSAGE_WORDS} and a.upto - a.words + {linededup.PASSAGE_WORDS} <= b.upto
    union
    select a.doc_id, b.i, a.i from placed a join placed b on a.doc_id = b.doc_id and a.words > 0
        and a.upto >= {linededup.PASSAGE_WORDS} and b.upto - b.words <= a.upto - {linededup.PASSAGE_WORDS} and a.upto - {linededup.PASSAGE_WORDS} < b.upto
), pieces as (
    select s.doc_id, first, last, string_agg(line, chr(10) order by i) as body
    from spans s join placed p on p.doc_id = s.doc_id and p.i between first and last group by all
), marked as (
    select *, min(doc_id) over (partition by body) as keeper, min_by(first, (doc_id, first)) over (partition by body) as stays from pieces
), gone as (
    select distinct doc_id, unnest(range(
        case when doc_id = keeper then greatest(first, stays + last - first + 1) else first end, last + 1)) as i
    from marked where doc_id <> keeper or first <> stays
), result as (
    select p.doc_id, count(*)::bigint as n_lines, count(g.i)::bigint as removed_lines,
        coalesce(sum(words) filter (g.i is not null), 0)::bigint as removed_words,
        coalesce(string_agg(line, chr(10) order by p.i) filter (g.i is null), '') as text
    from placed p left join gone g on g.doc_id = p.doc_id and g.i = p.i group by p.doc_id
)
select doc_id, n_lines, removed_lines, removed_words, length(text)::bigint as n_chars, sha256(text) as text_sha256
from result
"""

_WORDS = f"regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{decontaminate.WORD}')"

ORACLE["op4_decontaminate"] = f"""
with doc as (select doc_id, coalesce({_WORDS}, []) as words from documents),
item as (select item_id, {_WORDS} as words from benchmark),
windows as (
    select distinct item_id, least(len(words), {decontaminate.SPAN}) as n,
        unnest(list_transform(range(1, len(words) - least(len(words), {decontaminate.SPAN}) + 2),
            lambda i: array_to_string(words[i:i + least(len(words), {decontaminate.SPAN}) - 1], ' '))) as span
    from item where len(words) > 0
), lengths as (select distinct n from windows),
runs as (
    select doc_id, n, unnest(range(1, len(words) - n + 2)) as place,
        unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) as span
    from doc, lengths where len(words) >= n
), met as (select r.doc_id, r.n, r.place, w.item_id from runs r join windows w on r.n = w.n and r.span = w.span),
hit as (select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(place, place + n)) as p from (select distinct doc_id, n, place from met)) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, item_id::varchar as id from met) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join listed using (doc_id)
"""

ORACLE["op8_knn"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vector from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, max(list_dot_product(q.vector, c.vector)::bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.vector) = len(c.vector) group by all
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

ORACLE["op10_warc"] = """
with p as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


# Eight steps of the checksum's shift register for one byte.
_STEP = "c"
for _ in range(8):
    _STEP = f"list_transform([{_STEP}], lambda y: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)[1]"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), "
    f"lambda a, b: list_transform([xor(a, b)], lambda c: {_STEP})[1]), 4294967295)"
)
_FANOUT = manifest.FANOUT

ORACLE["op13_manifest"] = f"""
with recursive marked as (
    select *, case when {_CRC} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as altered
    from documents
), hashed as (
    select doc_id, source, sha256({" || ".join(_field(c) for c in manifest.FIELDS)}) as leaf,
        sha256({" || ".join(_field("altered" if c == "text" else c) for c in manifest.FIELDS)}) as altered_leaf
    from marked
), leaves as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf, altered_leaf) - 1 as place,
        count(*) over (partition by source) as n from hashed
), nodes as (
    select source, 0 as level, place, leaf as digest, n from leaves
    union all
    select source, level + 1, place // {_FANOUT}, sha256(string_agg(digest, '' order by place)), (any_value(n) + {_FANOUT - 1}) // {_FANOUT}
    from nodes where n > 1 group by source, level, place // {_FANOUT}
), tops as (
    select source, digest as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n
    from nodes where n = 1
), upper as (
    select 0 as level, place, subroot as digest, n from tops
    union all
    select level + 1, place // {_FANOUT}, sha256(string_agg(digest, '' order by place)), (any_value(n) + {_FANOUT - 1}) // {_FANOUT}
    from upper where n > 1 group by level, place // {_FANOUT}
), steps as (
    select source, level, place,
        coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
        coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
    from nodes where n > 1 window w as (partition by source, level, place // {_FANOUT} order by place)
), upper_steps as (
    select level, place,
        coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
        coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
    from upper where n > 1 window w as (partition by level, place // {_FANOUT} order by place)
), climb as (
    select source, place as leaf_place, level, place, altered_leaf as folded, '' as proof from (select *, 0 as level from leaves)
    union all
    select c.source, leaf_place, c.level + 1, c.place // {_FANOUT}, sha256(before || folded || after), proof || before || after
    from climb c join steps s on s.source is not distinct from c.source and s.level = c.level and s.place = c.place
), climbed as (
    select source, leaf_place, folded, proof from climb
    qualify row_number() over (partition by source, leaf_place order by level desc) = 1
), climb_up as (
    select c.source, leaf_place, 0 as level, t.place, folded, proof from climbed c join tops t on t.source is not distinct from c.source
    union all
    select c.source, leaf_place, c.level + 1, c.place // {_FANOUT}, sha256(before || folded || after), proof || before || after
    from climb_up c join upper_steps s on s.level = c.level and s.place = c.place
), ended as (
    select * from climb_up qualify row_number() over (partition by source, leaf_place order by level desc) = 1
)
select l.doc_id, l.leaf, t.subroot, u.digest as root, sha256(e.proof) as proof_sha256, e.folded as folded_root,
    e.folded = u.digest as verified
from leaves l join ended e on e.source is not distinct from l.source and e.leaf_place = l.place
    join tops t on t.source is not distinct from l.source join (select digest from upper where n = 1) u on true
"""

ORACLE["op11_substrings"] = r"""
with doc as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') as words from documents
), windows as (
    select doc_id, unnest(range(1, len(words) - 48)) as place,
        sha256(unnest(list_transform(range(1, len(words) - 48), lambda i: array_to_string(words[i:i + 49], ' ')))) as span
    from doc where len(words) >= 50
), spare as (
    select doc_id, place from (select *, min(doc_id) over (partition by span) as first from windows) where first < doc_id
), gone as (select doc_id, list(distinct p) as places from (select doc_id, unnest(range(place, place + 50)) as p from spare) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
    sha256(array_to_string(case when places is null then words else
        list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: not list_contains(places, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from doc left join gone using (doc_id)
"""
