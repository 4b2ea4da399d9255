"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from pageloom.llm import license_scan

EXACT = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
r as (select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
             row_number() over (partition by t order by doc_id nulls last) as k from d)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(t) as text_sha256 from r
"""

CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ANS\]|/?ROLE\b|\+\])', '\1\\\2\3', 'g')) as n
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(n + case when before = role then 3 when role = 'user' then 18 when role = 'assistant' then 13
                    else 19 + length(url_encode(role)) end)::bigint as formatted_chars
from e group by conv_id
"""

DECONTAMINATE = r"""
with dw as (
  select doc_id, row_number() over () as rid,
         list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from documents
),
bw as (
  select item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from benchmark
),
win as (
  select distinct item_id::varchar as item, least(10, len(w)) as n, list_slice(w, s, s + least(10, len(w)) - 1) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from bw where len(w) > 0)
),
sizes as (select distinct n from win),
pos as (
  select rid, s, n, list_slice(w, s, s + n - 1) as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from dw, sizes where len(w) >= n)
),
hit as (select p.rid, p.s, p.n, x.item from pos p join win x on p.n = x.n and p.win = x.win),
covered as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(s, s + n)) as k from hit) group by rid),
found as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from dw left join covered using (rid) left join found using (rid)
"""

MIX = r"""
with sizes as (select source, count(*) as n from documents group by source),
share as (select source, n, pow(n, 0.5) as weight from sizes),
rate as (select source, weight / (select sum(weight) from share) * (select sum(n) from share) / n as rate from share),
part as (select source, rate, greatest(ceil(rate / 64.0), 1)::int as parts from rate),
cdf as (
  with recursive r as (
    select source, parts, rate / parts as mean, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as c from part
    union all
    select source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from r where k < ceil(mean + 12 * sqrt(mean) + 30)
  ) select * from r
),
draw as (
  select doc_id, d.source, text, j,
         (('0x' || substr(md5('mix5|' || j || '|' || doc_id), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u
  from (select doc_id, d.source, text, unnest(range(1, parts + 1)) as j from documents d join part p on d.source = p.source) d
),
n as (
  select d.doc_id, d.source, d.text, count(*) filter (where c.c < d.u) as repeats
  from draw d join cdf c on c.source = d.source group by all
)
select doc_id, source, copy_no::int as copy_no, repeats::int as repeats, md5('order5|' || copy_no || '|' || doc_id) as mix_key,
       sha256(text) as text_sha256
from (select *, unnest(range(0, repeats)) as copy_no from n where repeats > 0)
"""

_NOTICES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
_SIZED = " union all ".join(
    f"select rid, array_to_string(w[1:{n}], ' ') as words, 0 as one from st0 where len(w) > {before}"
    for before, n in zip((0, *license_scan.SIZES), license_scan.SIZES, strict=False)
)
_MOST = license_scan.SIZES[-1]

LICENSE = rf"""
with t(tpl, license, text) as (values {_NOTICES}),
f as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, doc_id % 10 = 0 as gives from documents),
p as (
  select *, source || case when not gives or doc_id % 3 >= 1 then '/' || (doc_id // 100) else '' end
         || case when not gives or doc_id % 3 >= 2 then '/' || (doc_id // 10) else '' end as dir
  from f
),
cut as (select rid, string_split(lower(text), chr(10)) as lines from p where regexp_matches(lower(text), '{license_scan.CUE}')),
lt as (select rid, list_filter(list_transform(lines, lambda x: regexp_extract_all(x, '[a-z0-9]+')[1:{_MOST}]), lambda x: len(x) > 0) as l from cut),
st0 as (
  select rid, w from (select rid, flatten(l[s:s + {_MOST - 1}])[1:{_MOST}] as w from (select rid, l, unnest(range(1, len(l) + 1)) as s from lt))
  where regexp_matches(array_to_string(w[1:{license_scan.HEAD}], ' '), '{license_scan.CUE}')
),
every as (
  select rid, array_to_string(regexp_extract_all(l, '[a-z0-9]+'), ' ') as words, 1 as one
  from (select rid, unnest(list_filter(lines, lambda x: regexp_matches(x, '{license_scan.CUE}'))) as l from cut
        union all select rid, lower(text) from p where gives)
  union all {_SIZED}
),
seg as (select rid, words, max(one) as one from every where words <> '' group by all),
su as (select words, sum(one) as files from seg group by words),
st as (select words, files, tok, count(*) as c from (select words, files, unnest(string_split(words, ' ')) as tok from su) group by all),
df as (select tok, sum(files) as df from st group by tok),
n as (select sum(files) as n from su),
tt as (select tpl, license, tok, count(*) as c from (select tpl, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from t) group by all),
kinds as (select tpl, license, case when license = '{license_scan.BARE}' then 2 when sum(c) >= {license_scan.WHOLE} then 0 else 1 end as kind from tt group by tpl, license),
sw as (select words, tok, c * (ln((1.0 + n)::double / (1.0 + df)::double) + 1.0) as w from st join df using (tok), n),
tw as (select tpl, tok, c * (ln((1.0 + n)::double / (1.0 + coalesce(df, 0))::double) + 1.0) as w from tt left join df using (tok), n),
sn as (select words, sqrt(sum(w * w)) as norm from sw group by words),
tn as (select tpl, sqrt(sum(w * w)) as norm from tw group by tpl),
dot as (select sw.words, tw.tpl, round(sum((sw.w / sn.norm) * (tw.w / tn.norm)), 6) as cosine
        from sw join tw using (tok) join sn on sn.words = sw.words join tn on tn.tpl = tw.tpl group by all),
best as (select words, kind, license, cosine from dot join kinds using (tpl)
         where cosine >= case kind when 0 then {license_scan.SAME} else {license_scan.SIMILAR} end
         qualify row_number() over (partition by words order by kind, cosine desc, license) = 1),
own as (select rid, kind, license, cosine from seg join best using (words)
        qualify row_number() over (partition by rid order by kind, cosine desc, license) = 1),
given as (select dir, license, cosine from own join p using (rid) where gives
          qualify row_number() over (partition by dir order by kind, cosine desc, license) = 1),
heir as (select p.rid, g.dir, g.license, g.cosine from p join given g on starts_with(p.dir || '/', g.dir || '/')
         qualify row_number() over (partition by p.rid order by length(g.dir) desc) = 1)
select doc_id, p.dir || '/' || case when gives then 'LICENSE-' else 'text-' end || doc_id as path,
       coalesce(own.license, heir.license) as license, coalesce(own.cosine, heir.cosine) as cosine,
       case when own.rid is not null then 'own' when heir.rid is not null then 'inherited' else 'none' end as how,
       case when own.rid is null then heir.dir end as from_dir
from p left join own using (rid) left join heir using (rid)
"""

#: Levels that the SQL of the hash tree spells out; 3 to this power is more than the leaves of any driver table.
DEPTH = 14
#: CRC-32 of the digits of an id, bit by bit; its lowest bit.
_ODD = """(xor(list_reduce(list_concat([4294967295::BIGINT], range(8 * length(doc_id::VARCHAR))), lambda acc, k:
  CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(acc, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE acc END) & 1 = 1
  THEN xor((CASE WHEN k % 8 = 0 THEN xor(acc, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE acc END) >> 1, 3988292384)
  ELSE (CASE WHEN k % 8 = 0 THEN xor(acc, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE acc END) >> 1 END), 4294967295) & 1)"""


def _leaf(text: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"


def _levels(name: str) -> str:
    """Nodes of all levels from {name}0(tree, pos, h, n), and beside each the digests before and after it in its run."""
    run = "OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
    parts = []
    for k in range(DEPTH):
        parts.append(f"""
{name}x{k} AS (SELECT tree, pos, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (n + 2) // 3 AS n
  FROM {name}{k} GROUP BY tree, pos // 3, n)""")
    return ",".join(parts)


def _folds(name: str, nodes: str, tree: str) -> str:
    """{name}0(tree, place, cur, proof, ...) folded level by level along its way to the top."""
    return ",".join(
        f"""
{name}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN n = 1 THEN cur ELSE sha256(concat(b, cur, a)) END AS cur,
  CASE WHEN n = 1 THEN proof ELSE concat(proof, b, a) END AS proof)
  FROM {name}{k} f JOIN {nodes}x{k} x ON x.tree = f.{tree} AND x.pos = f.place // {3**k})"""
        for k in range(DEPTH)
    )


MERKLE = f"""
WITH d AS (SELECT *, {_ODD} AS odd, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents),
l AS (SELECT doc_id, tree, {_leaf("text")} AS leaf,
  CASE WHEN odd = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
s0 AS (SELECT tree, place AS pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM o),{_levels("s")},
t0 AS (SELECT 0 AS tree, tree AS pos, h, count(*) OVER () AS n FROM s{DEPTH}),{_levels("t")},
f0 AS (SELECT doc_id, tree, leaf, place, claim AS cur, '' AS proof FROM o),{_folds("f", "s", "tree")},
g0 AS (SELECT doc_id, tree, 0 AS one, leaf, tree AS place, cur, proof FROM f{DEPTH}),{_folds("g", "t", "one")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
FROM g{DEPTH} g JOIN s{DEPTH} s ON s.tree = g.tree, t{DEPTH} t"""

SQL = {
    "op3_license_scan": LICENSE,
    "op5_mix_sources": MIX,
    "op6_exact_dedup": EXACT,
    "op7_chat_format": CHAT,
    "op8_decontaminate": DECONTAMINATE,
    "op13_merkle_manifest": MERKLE,
}
