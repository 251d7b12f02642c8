"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{WORD}') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
starts as (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8),
windows as (select r, i, array_to_string(list_slice(ws, i, i + 7), ' ') as win from starts),
twice as (select r, i from windows qualify count(*) over (partition by r, win) > 1),
inside as (select r, count(distinct j) as n from (select r, unnest(range(i, i + 8)) as j from twice) group by r),
m as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, len(regexp_extract_all(t, '\p{{Lu}}'))::bigint as n_capitals,
    len(regexp_extract_all(t, '\p{{L}}'))::bigint as n_letters, len(regexp_extract_all(t, '!'))::bigint as n_marks,
    len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1]))::bigint as n_same_next
  from w left join inside using (r)),
f as (
  select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end
    + case when 10 * n_capitals > 6 * n_letters then 16 else 0 end + case when 10 * n_marks > 3 * n_words then 32 else 0 end
    + case when word_chars > 20 * n_words then 64 else 0 end + case when 10 * n_same_next > 3 * n_words then 128 else 0 end)::bigint as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f
"""



def crc32(value: str) -> str:
    """Unsigned crc32 of a text of ASCII digits and signs, bit by bit (fixed polynomial 0xEDB88320)."""
    bits = "list_reduce([s0, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    chars = f"list_transform(string_split({value}, ''), lambda ch: ascii(ch)::bigint)"
    step = bits.replace("s0", "xor(c, b)")
    return f"xor(list_reduce(list_concat([4294967295::bigint], {chars}), lambda c, b: {step}), 4294967295)"


FANOUT = 8
#: Levels of the trees in SQL: enough for 8 ** 8 rows of one language.
LEVELS = 8
LEAF = " || ".join(
    f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)


def _tree(name: str, leaves: str) -> str:
    """All levels of trees over (g, i, h): name0, name1, ... with the number of nodes per tree, and name: (g, level, i, n, h)."""
    parts = [f"{name}0 as (select g, 0 as level, i, count(*) over (partition by g) as n, h from ({leaves}))"]
    for k in range(1, LEVELS + 1):
        parts.append(
            f"""{name}{k} as (select g, {k} as level, i // {FANOUT} as i, ceil(any_value(n) / {FANOUT})::bigint as n,
            case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h
            from {name}{k - 1} group by g, i // {FANOUT})"""
        )
    union = " union all ".join(f"select * from {name}{k}" for k in range(LEVELS + 1))
    return ", ".join([*parts, f"{name} as ({union})"])


def _steps(name: str, source: str) -> str:
    """(leaf key k, level, before, after): the joined siblings of each leaf on its way up, where its tree has more than one node."""
    return f"""{name}_steps as (select l.k, t.level, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < l.i // ({FANOUT} ** t.level)::bigint), '') as before,
      coalesce(string_agg(t.h, '' order by t.i) filter (t.i > l.i // ({FANOUT} ** t.level)::bigint), '') as after
      from {source} l join {name} t on t.g = l.g and t.n > 1 and t.i // {FANOUT} = l.i // ({FANOUT} ** (t.level + 1))::bigint
      group by l.k, t.level)"""


MERKLE = f"""
with d as (select row_number() over () as k, coalesce('=' || lang, '') as g, doc_id, {LEAF.replace("{text}", "text")} as own, {LEAF.replace("{text}", "bad")} as other
  from (select *, case when {crc32("doc_id::varchar")} % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as bad from documents)),
l as (select k, g, doc_id, sha256(own) as h, sha256(other) as changed, row_number() over (partition by g order by doc_id nulls first, sha256(own)) - 1 as i from d),
{_tree("t", "select g, i, h from l")},
r as (select g as k, '' as g, row_number() over (order by g) - 1 as i, h from t where level = {LEVELS}),
{_tree("u", "select g, i, h from r")},
{_steps("t", "l")}, {_steps("u", "r")},
way as (select k, level, before, after from t_steps union all select l.k, {LEVELS} + s.level, s.before, s.after from l join u_steps s on s.k = l.g),
steps as (select k, list({{'b': before, 'a': after}} order by level) as path, string_agg(before || after, '' order by level) as told from way group by k),
folds as (select l.*, coalesce(list_reduce(list_concat([{{'b': '', 'a': changed}}], path), lambda x, y: {{'b': '', 'a': sha256(y.b || x.a || y.a)}}).a, changed) as folded,
  sha256(coalesce(told, '')) as proof from l left join steps using (k))
select doc_id, f.h as leaf, r.h as subroot, u.h as root, proof as proof_sha256, folded as folded_root, folded = u.h as verified
from folds f join r on r.k = f.g join u on u.level = {LEVELS}
"""

PREFIX_TRIE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as p, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
h as (select c, n, c - c % 5 as base, {crc32("c::varchar")} % 9 as h from (select c, count(*) as n from t group by c)),
given as (select h.c, p, role, text from h join t on t.c = h.base and t.p <= h.h),
taken as (select c, count(*) as taken from given group by c),
own as (select h.c, t.p - h.h + coalesce(taken, 0) as p, role, text from h join t on t.c = h.c and t.p > h.h left join taken on taken.c = h.c),
made as (select h.c, coalesce(list(sha256(length(role) || ':' || role || text) order by p) filter (p is not null), []) as s, coalesce(list(strlen(text) order by p) filter (p is not null), []) as b
  from h left join (select * from given union all select * from own) x on x.c = h.c group by h.c),
pre as (select c, d, array_to_string(list_slice(s, 1, d), ',') as k, array_to_string(list_slice(s, 1, d - 1), ',') as up, len(s) = d as ends, case when d > 0 then b[d] else 0 end as bytes
  from (select *, unnest(range(0, len(s) + 1)) as d from made)),
node as (select d, k, any_value(up) as up, min(c) as conv_id, count(*) as n, any_value(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from pre group by d, k),
kids as (select d - 1 as d, up as k, count(*) as n_children from node where d > 0 group by all),
full_ as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (d, k)),
below as (select a.d, a.k, sum((f.n_children = 0)::int) as n_leaves, sum((f.n - 1) * f.bytes) as saved
  from (select distinct a.d, a.k, b.d as bd, b.k as bk from pre a join pre b on a.c = b.c and b.d >= a.d) a join full_ f on f.d = a.bd and f.k = a.bk group by a.d, a.k)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n as n_convs, f.n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, f.ends_sha256
from full_ f join below using (d, k) left join node p on p.d = f.d - 1 and p.k = f.up and f.d > 0
"""

ORACLES = {"op6_quality_rules": QUALITY_RULES, "op11_prefix_trie": PREFIX_TRIE, "op13_merkle": MERKLE}
