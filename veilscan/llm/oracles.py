"""DuckDB SQL for those operators that SQL can express, written from their definitions."""

from __future__ import annotations

from .quality_rules import COVERAGE, LINE_COVERAGE

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

JACCARD = rf"""with recursive texts as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from texts),
cells as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c from cells a join cells b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common where 100 * c >= 80 * (nx + ny - c)),
edges as (select x as a, y as b from links union all select y, x from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, e.b from reach r join edges e on r.b = e.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, (select min(b) from reach r where r.a = s.doc_id) as component_id from sets s"""

NEAREST = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_SAID = "<|im_end|><|im_start|>assistant ok"
CHAT = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length('<|im_start|>') + length(replace({_ESC.format("role")}, chr(10), '\n')) + 1 + length({_ESC.format("text")}) + length('<|im_end|>') + 1) as bigint) as formatted_chars from t group by conv_id"""

_LIMITS = " or ".join(f"coalesce(c{n}.chars, 0) / greatest(b.word_chars, 1) > {most}" for n, most in COVERAGE.items())
_COVERS = ", ".join(
    f"g{n} as (select doc_id, i, count(*) over (partition by doc_id, g) as c from (select doc_id, unnest(range(1, len(w) - {n - 2})) as i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as g from texts where len(w) >= {n})), "
    f"p{n} as (select distinct doc_id, unnest(range(i, i + {n})) as pos from g{n} where c > 1), "
    f"c{n} as (select p.doc_id, count(*) as words, sum(length(t.w[p.pos])) as chars from p{n} p join texts t using (doc_id) group by 1)"
    for n in (3, *COVERAGE)
)
QUALITY_RULES = rf"""with texts as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents), {_COVERS},
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from texts),
dups as (select doc_id, line, row_number() over (partition by doc_id, line order by k) as nth from lines where len({_WORDS.format("line")}) > 0),
again as (select doc_id, count(*) as n, sum(list_sum(list_transform({_WORDS.format("line")}, lambda x: length(x)))) as chars from dups where nth > 1 group by 1),
base as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols from texts),
out as (select b.*, cast(coalesce(a.n, 0) as bigint) as n_dup_lines, cast(coalesce(c3.words, 0) as bigint) as n_repeat_words, b.n_words < 50 or 100 * coalesce(c3.words, 0) > 50 * b.n_words as base_failed,
 {_LIMITS} or coalesce(a.chars, 0) / greatest(b.word_chars, 1) > {LINE_COVERAGE} as repetitive
 from base b left join again a using (doc_id) {' '.join(f'left join c{n} on c{n}.doc_id = b.doc_id' for n in (3, *COVERAGE))})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not repetitive as kept from out"""
