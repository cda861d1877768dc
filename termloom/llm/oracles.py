"""The SQL of those registered queries that plain SQL can say."""

from __future__ import annotations

# Words between blanks, and the CRC-32 of a text's bytes by a table made from its polynomial.
_BLANKS = r"[ \t-\r]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '')"
_CRC = """crc_table as (select list(v order by i) as t from (
    select i, list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i))),
  raw as (select *, coalesce(text, '') as body from documents),
  summed as (select *, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: cast('0x' || h as bigint)),
    lambda c, x: xor(c >> 8, t[cast((xor(c, x) & 255) + 1 as bigint)]), cast(4294967295 as bigint)), 4294967295) as crc from raw, crc_table)"""


def _leading(hexed: str, digits: int) -> str:
    return f"cast(cast('0x' || substr({hexed}, 1, {digits}) as bigint) as double)"


def _crossed(part: str, rate: str) -> str:
    offset = f"{_leading(f"md5('18:{part}:' || (source is null) || ':' || coalesce(source, ''))", 8)} / 4294967296.0"
    return f"cast(floor({offset} + {rate} * place) - floor({offset} + {rate} * (place - 1)) as bigint)"


OP1 = f"""with {_CRC},
  d as (select doc_id, source, cast(len({_WORDS}) as bigint) as size, md5('17:' || coalesce(cast(doc_id as varchar), 'null') || ':' || crc) as key, crc from summed),
  sizes as (select source, cast(sum(size) as bigint) as source_size from d group by source),
  s as (select *, row_number() over (order by source is null, source) as spot from sizes),
  w as (select *, source_size * 2.0::double as cap, [5.0::double, 2.0, 1.0][cast((spot - 1) % 3 + 1 as integer)] as weight from s),
  r as (select *, cap / weight as ratio, cast(sum(source_size) over () as double) * 1.5::double as pool from w),
  l as (select *, (pool - coalesce(sum(cap) over (order by ratio, spot rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, spot rows between current row and unbounded following) as level from r),
  f as (select coalesce(first(level order by ratio, spot) filter (level <= ratio), max(ratio)) as level from l),
  t as (select source, source_size, least(cap, f.level * weight) as target from l, f),
  m as (select d.*, source_size, target, size > target * 0.015625::double as long from d join t on d.source is not distinct from t.source),
  p as (select *, row_number() over (partition by source, long order by lpad(cast(length(bin(size)) as varchar), 2, '0') || substr(bin(size), 1, 3), substr(key, 1, 2), size, key, doc_id, crc) as place from m),
  q as (select *, case when long then {_crossed("long", "(target / source_size)")} end as n from p),
  x as (select source, cast(coalesce(sum(n * size), 0) as bigint) as got, cast(coalesce(sum(size) filter (long), 0) as bigint) as big from q group by source),
  y as (select q.*, case when source_size - big > 0 then least(2.0::double, greatest(0.0::double, (target - got) / (source_size - big))) else 0.0::double end as rest from q join x on q.source is not distinct from x.source)
select doc_id, size, source_size, target, coalesce(n, {_crossed("rest", "rest")}) * size as taken from y"""

OP2 = f"""with {_CRC},
  d as (select doc_id, cast(strlen(body) + 16 as bigint) as size, crc, coalesce(cast(doc_id as varchar), 'null') as key from summed),
  draws as (select key, s, -ln((cast(cast('0x' || substr(md5('29:' || s // 4 || ':' || key), s % 4 * 8 + 1, 8) as bigint) as double) + 0.5) / 4294967296.0) as cost from (select distinct key from d), range(41) r(s)),
  homes as (select key, cast(arg_min(s, cost) filter (s < 40) as integer) as shard, cast(arg_min(s, cost) as integer) as grown_shard from draws group by key)
select doc_id, size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by md5('30:' || key || ':' || crc), doc_id, crc) - 1 as slot, grown_shard from d join homes using (key)"""

OP5 = f"""with d as (select doc_id, {_WORDS} as w from documents),
  starts as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from d where len(w) >= 20),
  windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from starts),
  late as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as n from windows) where n > 1),
  each as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
  marked as (select e.*, max(case when l.i is not null then e.i end) over (partition by e.doc_id order by e.i rows between 19 preceding and current row) is not null as gone
    from each e left join late l on e.doc_id = l.doc_id and e.i = l.i),
  kept as (select doc_id, count_if(gone) as n_removed, string_agg(x, ' ' order by i) filter (not gone) as text from marked group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (doc_id)"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""with d as (select doc_id, {_ITEM_WORDS} as w from documents),
  b as (select item_id, {_ITEM_WORDS} as w from benchmark),
  bi as (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
  bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from bi),
  di as (select doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) as i from d, (select distinct n from bw) s where len(w) >= s.n),
  dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from di),
  found as (select doc_id, dw.n, i, item_id from dw join bw using (n, k)),
  hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
  names as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from found where item_id is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join names using (doc_id)"""

ORACLES = {"op1_source_mix": OP1, "op2_rendezvous_shards": OP2, "op5_fm_index_repeats": OP5, "op10_suffix_array_decontam": OP10}
