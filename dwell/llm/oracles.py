"""DuckDB SQL for the text queries that SQL can express."""

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(x: str) -> str:
    """A line without white space at both ends and with A-Z lower-cased."""
    return f"translate(trim({x}, E' \\t\\n\\x0B\\f\\r'), '{_ABC}', '{_ABC.lower()}')"


def word_list(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^\\x20\\x09-\\x0D]+')"


def quality(docs: str = "documents", min_docs: int = 20, max_share: float = 0.01, min_kept: float = 0.3) -> str:
    return f"""
with d as (select row_number() over () as rid, doc_id, text, source, {word_list('text')} as w,
                  string_split(coalesce(text, ''), chr(10)) as ls from {docs}),
g as (select rid, i, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) as g
      from (select rid, w, unnest(range(1, len(w) - 3)) as i from d)),
r as (select rid, unnest(range(i, i + 5)) as p from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1),
rw as (select rid, count(distinct p) as n_repeat_words from r group by rid),
l as (select rid, source, {key('l')} as k, l from (select rid, source, unnest(ls) as l from d) where {key('l')} <> ''),
dl as (select rid, count(*) - count(distinct l) as n_dup_lines, sum(length(k)) as line_chars from l group by rid),
hosts as (select source, count(*) as n_host from d group by source),
over_limit as (select c.source, c.k from (select source, k, count(distinct rid) as n from l group by source, k) c
               join hosts h on c.source is not distinct from h.source where c.n > {min_docs} and c.n > h.n_host * cast({max_share} as double)),
rm as (select l.rid, sum(length(l.k)) as removed from l join over_limit o on l.k = o.k and l.source is not distinct from o.source group by l.rid),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             coalesce(line_chars, 0) as line_chars, coalesce(removed, 0) as removed_chars
      from d left join rw using (rid) left join dl using (rid) left join rm using (rid))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       cast(line_chars as bigint) as line_chars, cast(removed_chars as bigint) as removed_chars,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
         and not (removed_chars > 0 and line_chars - removed_chars < cast({min_kept} as double) * line_chars) as kept
from m"""


LINE_DEDUP = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, generate_subscripts(ls, 1) as i, unnest(ls) as l from d),
k as (select rid, i, l, {key('l')} as k from l),
f as (select k from k where k <> '' group by k having count(distinct rid) >= 10),
g as (select rid, count(*) as n_lines, count(f.k) as n_dropped,
             coalesce(string_agg(l, chr(10) order by i) filter (where f.k is null), '') as kept from k left join f using (k) group by rid)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, sha256(kept) as kept_sha256
from d join g using (rid)"""

CHAT = r"""
with marks(m) as (values ('### System: '), ('### User: '), ('### Assistant: '), ('### Role '), ('</role> '), ('</turn>' || chr(10)), ('\')),
c as (select row_number() over () as rid, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1 - i, -7, i, case i when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(i)),
known as (select *, role in ('system', 'user', 'assistant') as known from c),
more as (select rid, sum((length(text) - length(replace(text, m, ''))) // length(m)) as in_text,
                sum((length(role) - length(replace(role, m, ''))) // length(m)) as in_role from known, marks group by rid),
t as (select conv_id, turn, role, text, known, length(text) + in_text + 8
             + case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 else length(role) + in_role + 17 end as chars
      from known join more using (rid)),
o as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
             coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss, sum(chars) as chars,
             count(*) filter (where not coalesce((before is null and role in ('system', 'user')) or (before in ('system', 'assistant') and role = 'user')
                                                 or (before = 'user' and role = 'assistant'), false)) as n_faults,
             arg_max(role, struct_pack(a := turn, b := role, c := text)) = 'assistant' as ended
      from o group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(chars as bigint) as formatted_chars, cast(n_faults as bigint) as n_faults, n_faults = 0 and ended as whole from g"""

SPELLING = f"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc),
found as (select doc_id, run, count(*) as c from (
            select doc_id, unnest(regexp_extract_all(translate(text, '{_ABC}', '{_ABC.lower()}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents) group by all),
h as (select run, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: cast('0x' || x as bigint)),
                                     lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) as h from found, t),
s as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
w as (select word, cast(sum(c) as bigint) as n from s where length(word) >= 5 group by word having sum(c) >= 3),
k as (select word, n, i, left(word, i) || substr(word, i + 2) as less from (select word, n, unnest(range(length(word))) as i from w)),
p as (select a.word, b.word as near, b.n as near_n from k a join k b on a.less = b.less and a.i = b.i and a.word <> b.word
      union select k.word, w.word, w.n from k join w on k.less = w.word
      union select w.word, k.word, k.n from k join w on k.less = w.word),
b as (select word, count(*) as n_near, max(near_n) as best_n from p group by word),
f as (select p.word, min(p.near) as form, any_value(best_n) as form_n from p join b on p.word = b.word and p.near_n = b.best_n join w on p.word = w.word where b.best_n >= 2 * w.n group by p.word),
r as (select word, form as root from f union all select r.word, f.form from r join f on r.root = f.word),
ends as (select word, root from r where root not in (select word from f))
select w.word, f.form, coalesce(ends.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, f.form_n
from w left join b using (word) left join f using (word) left join ends using (word)"""

NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
      from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""

ORACLES = {
    "op4_quality_rules": quality(),
    "op9_line_dedup": LINE_DEDUP,
    "op11_chat_format": CHAT,
    "op12_spelling_variants": SPELLING,
    "op13_hard_negatives": NEGATIVES,
}
