"""Check SQL of the queries that SQL can express."""

from __future__ import annotations

from . import hashtree, secrets

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
o as (select d, n, max(page_id) as original from p where n >= 1000 group by d, n)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
    case when page_id < original then 'revisit' else 'response' end as record_type,
    case when page_id < original then original end as refers_to
from p left join o using (d, n)
"""

_NORMAL = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

CONTAINED = f"""
with d as (select doc_id, {_NORMAL} as w from documents), b as (select item_id, {_NORMAL} as w from benchmark),
c as (select item_id, w, least(len(w), 5) as k from b where w <> ['']),
bs as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from c, unnest(range(1, len(w) - k + 2)) as r(i)),
ds as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s from d, (select distinct k from bs) as ks, unnest(range(1, len(w) - k + 2)) as r(i)),
n as (select item_id, count(*) as n from bs group by item_id)
select doc_id, item_id, any_value(n) as item_shingles, count(*) as common from bs join ds using (k, s) join n using (item_id)
group by doc_id, item_id having count(*) * 100 >= any_value(n) * 80
"""

NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s from w, unnest(range(1, greatest(len(w) - 1, 2))) as r(i) where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
e as (select x, y from l union all select y, x from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.y from r join e on r.b = e.x),
least_of as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join least_of using (doc_id) left join n using (doc_id)
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])), 4294967295)"""


def _placed(shards: int) -> str:
    """Nested draws of the tree as one expression over ``key``."""
    def draw(children: dict[str, float]) -> str:
        costs = ", ".join(f"{{'a': -ln((('0x' || substr(md5(key || '|{c}'), 1, 12))::bigint + 0.5) / {16 ** 12}::double) / {w}, 'c': '{c}'}}"
                          for c, w in sorted(children.items()))
        return f"list_sort([{costs}])[1].c"

    levels = hashtree._levels(hashtree.topology(shards))
    region = draw(levels[0][""])
    rack = "case region " + " ".join(f"when '{p}' then {draw(c)}" for p, c in levels[1].items()) + " end"
    leaf = "case rack " + " ".join(f"when '{p}' then {draw(c)}" for p, c in levels[2].items()) + " end"
    return f"(select row_id, {leaf}::int as shard from (select *, {rack} as rack from (select *, {region} as region from k)))"


SHARDS = f"""
with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
k as (select row_number() over () as row_id, coalesce(doc_id::varchar, '') as key, * from documents),
s as (select k.doc_id, key, octet_length(encode(coalesce(text, ''))) + 1 as size, {_CRC} as text_crc32, a.shard, b.shard as grown_shard
    from k join {_placed(8)} a using (row_id) join {_placed(9)} b using (row_id), t)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard,
    row_number() over (partition by shard order by md5(key), doc_id, size, text_crc32) - 1 as slot, grown_shard from s
"""


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Without the look-behind and the possessive step, which only save time: a match begins at the start of its run anyway.
_BARE = "[A-Za-z+/_-]*[0-9][A-Za-z0-9+/_-]*"


def _secrets() -> str:
    value = lambda p, least: f"length(regexp_extract(m, {_text(p)}, 1)) >= {least}"
    kinds = [("assign", secrets.ASSIGN, value(secrets.ASSIGN, 6)), ("access", secrets.ACCESS, "true"), ("hex", secrets.HEX, "true"),
             ("ident", secrets.IDENT, value(secrets.IDENT, 3)), ("endpoint", secrets.ENDPOINT, "true"),
             ("bare", _BARE, "length(m) >= 20 and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')")]
    found = " union all ".join(
        f"select row_id, '{k}' as kind, {n} as o, i, ms[i] as m, length(gs[i]) as gap, {ok} as ok from (select row_id, i, ms, gs, ms[i] as m from "
        f"(select row_id, regexp_extract_all(text, {_text(p)}) as ms, string_split_regex(text, {_text(p)}) as gs from d), unnest(range(1, len(ms) + 1)) as r(i))"
        for n, (k, p, ok) in enumerate(kinds, 1))

    def seen(kinds: tuple[str, ...]) -> str:
        return "kind in (" + ", ".join(f"'{k}'" for k in kinds) + ")"

    def overlaps(kinds: tuple[str, ...]) -> str:
        return (f"(coalesce(max(case when {seen(kinds)} then e end) over before > s, false) or "
                f"coalesce(min(case when {seen(kinds)} then s end) over behind < e, false))")

    def near(kinds: tuple[str, ...], only: str = "true") -> str:
        of = f"{seen(kinds)} and {only}"
        return (f"(coalesce(s - max(case when {of} then e end) over before <= {secrets.REACH}, false) or "
                f"coalesce(min(case when {of} then s end) over behind - e <= {secrets.REACH}, false))")

    windows = ("window before as (partition by row_id order by s, o, e rows between unbounded preceding and 1 preceding), "
               "behind as (partition by row_id order by s, o, e rows between 1 following and unbounded following)")
    base = seen(secrets.BASE)
    return f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
m as ({found}),
p as (select row_id, kind, o, ok, sum(gap + length(m)) over (partition by row_id, kind order by i) as e, length(m) as n from m),
a as (select row_id, kind, o, e - n as s, e from p where ok),
b as (select *, case when kind in ('bare', 'ident') then {overlaps(secrets.BASE)} when kind = 'endpoint' then {overlaps(("access", "hex"))}
    else false end as hidden from a {windows}),
v as (select *, kind = 'bare' and {overlaps(("ident",))} as of_ident from b where not hidden {windows}),
c as (select *, {near(secrets.WHO)} as who, {near(("access",))} as key, {near(secrets.WHERE)} as place, {near(secrets.WHAT)} as what,
    {near(secrets.WHAT, "not of_ident")} as proof from v {windows}),
f as (select * from c where case kind when 'ident' then proof when 'bare' then place or case when of_ident then key else who end
    when 'endpoint' then who and what else true end),
h as (select *, kind = 'bare' and coalesce(max(case when {seen(("ident", "endpoint"))} then e end) over before >= e, false) as inside from f {windows}),
g as (select row_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) filter (where {base}) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) as spans from h where not inside group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (row_id)
"""


SECRETS = _secrets()
