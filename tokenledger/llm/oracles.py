"""SQL for the queries that SQL can express."""

from __future__ import annotations

from tokenledger.llm import dialogue, lm, mixing

_OP1 = f"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents
), sources as (
    select source, sum(size)::bigint as source_size,
        list_extract({list(mixing.WEIGHTS)}, ((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int)::double as weight
    from sized group by source
), running as (
    select *, {mixing.CAP} * source_size as cap,
        coalesce(sum({mixing.CAP} * source_size) over (w rows between unbounded preceding and 1 preceding), 0) as capped,
        sum(weight) over (w rows between current row and unbounded following) as open_weight,
        {mixing.SHARE} * sum(source_size) over () as budget
    from sources window w as (order by {mixing.CAP} * source_size / weight, source nulls last)
), water as (
    select coalesce(min_by((budget - capped) / open_weight, cap / weight) filter ((budget - capped) / open_weight * weight < cap), 1e300) as level from running
), goals as (
    select source, source_size, least(level * weight, cap) as target,
        case when source_size > 0 then least(level * weight, cap) / source_size else 0 end as rate
    from running, water
), coins as (
    select d.doc_id, d.source, d.size, k.k, g.source_size, g.target, g.rate,
        ('0x' || substr(md5('mix' || k.k || ':' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint / {float(1 << 52)}
            < g.rate - floor(g.rate) as extra
    from sized d join goals g on d.source is not distinct from g.source cross join (select unnest(range({mixing.TRIES})) as k) k
), draws as (
    select source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(case when extra then size else 0 end) - any_value(target)) as miss
    from coins group by source, k
), chosen as (
    select source, min(struct_pack(miss := miss, k := k)).k as k from draws group by source
)
select c.doc_id, c.size::bigint as size, c.source_size, c.target, (c.size * (floor(c.rate) + c.extra::int))::bigint as taken,
    (floor(c.rate) + c.extra::int)::bigint as copies
from coins c join chosen h on c.source is not distinct from h.source and c.k = h.k
"""

_OP9 = """
with recursive texts as (
    select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
    select doc_id, list_distinct(case when len(w) between 1 and 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from texts where len(w) > 0
), elements as (
    select doc_id, len(s) as n, unnest(s) as e from sets
), links as (
    select a.doc_id as a, b.doc_id as b from elements a join elements b on a.e = b.e and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id having count(*) * 10 >= 8 * (any_value(a.n) + any_value(b.n) - count(*))
), reached(doc_id, other) as (
    select doc_id, doc_id from documents union select r.doc_id, l.b from reached r join links l on r.other = l.a
)
select doc_id, min(other) as class_id from reached group by doc_id
"""

_OP10 = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), terms as (
    select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from usable
), scores as (
    select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
    from terms q join terms c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by q.vec_id, c.vec_id
), ranked as (
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_OP2 = f"""
with texts as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
        doc_id in (select doc_id from labels where quality = 1) as target
    from documents
), tokens as (
    select r, target, unnest(w) as word, generate_subscripts(w, 1) as i from texts
), totals as (
    select count(*) as n_all, count(*) filter (target) as n_target, count(*) filter (i = 1) as s_all, count(*) filter (i = 1 and target) as s_target
    from tokens
), vocabulary as (
    select word, count(*) as c_all, count(*) filter (target) as c_target from tokens group by word
    having count(*) >= {lm.LEAST}
), unknown as (
    select n_all - coalesce((select sum(c_all) from vocabulary), 0) as c_all, n_target - coalesce((select sum(c_target) from vocabulary), 0) as c_target,
        (select count(*) from vocabulary) as size from totals
), numbered as (
    select r, target, i, v.word as word, coalesce(v.c_all, u.c_all) as c_all, coalesce(v.c_target, u.c_target) as c_target
    from tokens left join vocabulary v on tokens.word = v.word cross join unknown u
), paired as (
    select *, i = 1 as first, lag(word) over p as before, lag(c_all) over p as b_all, lag(c_target) over p as b_target
    from numbered window p as (partition by r order by i)
), pairs as (
    select first, before, word, count(*) as p_all, count(*) filter (target) as p_target from paired group by first, before, word
    having count(*) >= {lm.LEAST}
), losses as (
    select r,
        -ln((coalesce(p_target, 0) + {lm.MASS} * ((c_target + 1) / (n_target + size + 1)))
            / (case when a.first then s_target else b_target end + {lm.MASS})) as target_loss,
        -ln((coalesce(p_all, 0) + {lm.MASS} * ((c_all + 1) / (n_all + size + 1)))
            / (case when a.first then s_all else b_all end + {lm.MASS})) as background_loss
    from paired a cross join totals cross join (select size from unknown)
    left join pairs b on a.first = b.first and a.before is not distinct from b.before and a.word is not distinct from b.word
), scored as (
    select r, avg(target_loss) as t, avg(background_loss) as b from losses group by r
)
select doc_id, len(w)::bigint as n_tokens, round(coalesce(t, 0), 6) as target_loss, round(coalesce(b, 0), 6) as background_loss,
    round(coalesce(t - b, 0), 6) as score
from texts left join scored on texts.r = scored.r
"""

_OP6 = """
with texts as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 19], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from texts where len(w) >= 20)
), later as (
    select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from windows) where n > 1
), gone as (
    select distinct doc_id, unnest(range(i, i + 20)) as i from later
), words as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from texts
), kept as (
    select words.doc_id, string_agg(word, ' ' order by words.i) as kept, count(*) as n
    from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id
)
select texts.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join kept on texts.doc_id = kept.doc_id
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::bigint)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _via(state: str, letter: str, cost: str) -> str:
    """A way on from a state, in the walk over a conversation's rows."""
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}')"


_D = {s: _via(s, "D", str(dialogue.DELETE)) for s in ("m0", "m1", "m2", "m3")}
_I = {s: _via(s, "I", str(dialogue.INSERT)) for s in ("m0", "m1", "m2", "m3")}
_CLOSED = f"""select conv_id, n, m0, m1, m2, list_min([m3, {_I['m2']}]) as m3 from (
            select conv_id, n, m0, m1, list_min([m2, {_I['m0']}, {_I['m1']}, {_I['m3']}]) as m2, m3 from walk)"""


def _write(state: str, initial: str) -> str:
    """To keep a row with this initial, or else to give it that one; out of reach for rows that must go."""
    keep = _via(state, "K", f"forbidden + 5 * (fault = 'truncated')::int")
    other = "1000000000" if initial == "s" else f"{dialogue.REROLE} + forbidden + 5 * (fault = 'truncated')::int"
    return f"case when kind = '{initial}' then {keep} else {_via(state, 'R', other)} end"


# For each state the cheapest edits so far, as (cost, letters); inserts come before a row, the last ones at the end.
_OP11 = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), marked as (
    select *, {_CRC32.format('k')} % 20 as m from keyed
), damaged as (
    select conv_id, turn, case when m = 4 then 'user' else role end as role,
        case when m = 1 then '' when m = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when m = 3 then [0, 1] else [0] end) as copy
    from marked where m <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged
), seen as (
    select *, row_number() over (partition by conv_id, role, text order by n) > 1 as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid from placed
), faulty as (
    select conv_id, n, turn, role, text, role[1] as kind,
        case when solid = '' then 'blank' when again then 'duplicate' when right(solid, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(role[1]) over (partition by conv_id order by n) || role[1] as pair
    from seen
), rows_ as (
    select *, case when fault in ('blank', 'duplicate') then 1000000000 else 0 end as forbidden from faulty
), walk as (
    select distinct conv_id, 0::bigint as n, struct_pack(c := 0::bigint, a := '') as m0, struct_pack(c := 1000000000::bigint, a := '') as m1,
        struct_pack(c := 1000000000::bigint, a := '') as m2, struct_pack(c := 1000000000::bigint, a := '') as m3
    from rows_
    union all
    select w.conv_id, r.n, {_D['m0']}, list_min([{_D['m1']}, {_write('m0', 's')}]),
        list_min([{_D['m2']}, {_write('m0', 'u')}, {_write('m1', 'u')}, {_write('m3', 'u')}]), list_min([{_D['m3']}, {_write('m2', 'a')}])
    from ({_CLOSED}) w join rows_ r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1
), ended as (
    select w.conv_id, list_min([m0, m3]) as best from ({_CLOSED}) w
    join (select conv_id, max(n) as n from rows_ group by conv_id) e on e.conv_id is not distinct from w.conv_id and e.n = w.n
), letters as (
    select conv_id, best.a as a, unnest(range(1, len(best.a) + 1)) as p, len(best.a) - len(replace(best.a, 'D', '')) as gone from ended
), edits as (
    select conv_id, p, a[p] as letter, len(replace(a[1:p], 'I', '')) as n,
        ['user', 'assistant'][((len(replace(a[1:p - 1], 'D', '')) - (len(a) - gone) % 2) % 2 + 1)::int] as fits
    from letters
), repaired as (
    select e.conv_id, p, case when letter = 'K' then role else fits end || ':' || case when letter = 'I' then '' else text end as line
    from edits e left join rows_ r on r.conv_id is not distinct from e.conv_id and r.n = e.n where letter <> 'D'
), hashed as (
    select conv_id, sha256(string_agg(line, chr(10) order by p)) as repaired_sha256 from repaired group by conv_id
), facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
    from rows_ group by conv_id
)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
    coalesce(best.a, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join facts f on f.conv_id is not distinct from i.conv_id
left join ended e on e.conv_id is not distinct from i.conv_id
left join hashed h on h.conv_id is not distinct from i.conv_id
"""

_OP12 = """
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), terms as (
    select vec_id, label, generate_subscripts(v, 1) as i, unnest(v) as x from usable
), scores as (
    select a.vec_id as anchor_id, b.vec_id, any_value(a.label) = any_value(b.label) as same, sum(a.x * b.x)::bigint as score
    from terms a join terms b on a.i = b.i where a.vec_id % 100 = 0 group by a.vec_id, b.vec_id
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score,
        row_number() over (partition by anchor_id order by score desc, vec_id) as place
    from scores where same and vec_id <> anchor_id
), found as (
    select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
    from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
        and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
    where place <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 5
"""

_OP13 = """
with parts as (
    select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
    from pages
), judged as (
    select page_id, host, path, case
        when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
    from parts
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from judged
"""

ORACLES: dict[str, str] = {
    "op1_mix": _OP1, "op2_lm": _OP2, "op6_substrings": _OP6, "op9_darts": _OP9, "op10_maxscore": _OP10, "op11_dialogue": _OP11,
    "op12_negatives": _OP12, "op13_urls": _OP13,
}
