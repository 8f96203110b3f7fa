"""DuckDB SQL of the operators that SQL can express.

The others are tested against brute force or the library they must equal: packing, merging by rank, WAV
files and trained models are no SQL.
"""

from __future__ import annotations

import string

from siftlane.llm import mixing

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"


def components(nodes: str, links: str) -> str:
    """(node, component) for nodes (node) and links (a, b)."""
    return f"""with recursive links as ({links}), both_ways as (select a, b from links union select b, a from links),
        reach as (select node, node m from ({nodes}) union select b, m from reach join both_ways on a = node)
        select node, min(m) component from reach group by node"""


def near_duplicates(k: int = 3, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    sets = f"""select distinct doc_id, unnest(case when len(w) >= {k} then list_transform(range(1, len(w) - {k} + 2), lambda i: {shingle}) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s
        from (select doc_id, {WORDS} w from documents)"""
    links = "select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where " + f"100 * c >= {percent} * (x.n + y.n - c)"
    found = components("select doc_id node from documents", links)
    return f"""with sets as ({sets}), sizes as (select doc_id, count(*) n from sets group by all),
        pairs as (select x.doc_id a, y.doc_id b, count(*) c from sets x join sets y on x.s = y.s and x.doc_id < y.doc_id group by all), found as ({found})
        select doc_id, coalesce(n, 0) n_shingles, component component_id, component = doc_id kept from documents left join sizes using (doc_id) join found on node = doc_id"""


def near_vectors(threshold: float = 0.93) -> str:
    links = f"""select x.vec_id a, y.vec_id b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id
        where list_dot_product(x.embedding::double[], y.embedding::double[]) / (sqrt(list_dot_product(x.embedding::double[], x.embedding::double[])) * sqrt(list_dot_product(y.embedding::double[], y.embedding::double[]))) >= {threshold}"""
    found = components("select vec_id node from embeddings", "select a, b from near")
    return f"""with near as ({links}), found as ({found}), degree as (select v, count(*) n from (select a v from near union all select b from near) group by v)
        select vec_id, coalesce(n, 0) n_links, component component_id, component = vec_id kept from embeddings join found on node = vec_id left join degree on v = vec_id"""


def _shared(nodes: str, parents: str, name: str, total: str) -> str:
    ratio = "cast(capacity as double) / weight"
    ahead = f"over (partition by {parents} order by {ratio}, {name} rows between unbounded preceding and 1 preceding)"
    return f"""select * exclude (rest, mass, filled, open), case when filled then capacity else least(capacity, weight * open.rest // open.mass) end given from (
        select *, min({{'x': {ratio}, 'y': {name}, 'rest': rest, 'mass': mass}}) filter (not filled) over (partition by {parents}) open from (
          select *, capacity * mass <= weight * greatest(rest, 0) filled from (
            select *, ({total})::hugeint - coalesce(sum(capacity) {ahead}, 0) rest, sum(weight) over (partition by {parents}) - coalesce(sum(weight) {ahead}, 0) mass from ({nodes}))))"""


def _weight(level: str, weights: dict) -> str:
    cases = " ".join(f"when '{k}' then {round(v * mixing.UNIT)}" for k, v in weights.items())
    return f"case {level} {cases} else {round(mixing.OTHER * mixing.UNIT)} end::hugeint"


def mix(share: float = 0.6, epochs: int = 2, seed: int = 17) -> str:
    """The readings of mixing.mix with its production weights, for rows whose keys differ."""
    rows = f"""select doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1), '') as int), 0) % 4) "domain", coalesce(lang, '') lang, coalesce(source, '') source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n_tokens from documents"""
    domain = _shared(f'select "domain", sum(capacity)::hugeint capacity, {_weight(chr(34) + "domain" + chr(34), mixing.DOMAIN_WEIGHTS)} weight, 0 root from langs group by "domain"', "root", '"domain"', f"(select floor(sum(tokens) * {share}::double) from leaves)")
    lang = _shared('select langs.*, d.given above from langs join domains d using ("domain")', '"domain"', "lang", "above")
    leaf = _shared('select leaves.*, x.given above from leaves join langs2 x using ("domain", lang)', '"domain", lang', "source", "above")
    return f"""with r as (select * from ({rows}) where n_tokens > 0),
      leaves as (select "domain", lang, source, sum(n_tokens) tokens, (sum(n_tokens) * {epochs})::hugeint capacity, {round(mixing.OTHER * mixing.UNIT)}::hugeint weight from r group by all),
      langs as (select "domain", lang, sum(capacity)::hugeint capacity, {_weight('lang', mixing.LANG_WEIGHTS)} weight from leaves group by "domain", lang),
      domains as ({domain}), langs2 as ({lang}), given as ({leaf}),
      reads as (select r.*, e epoch, given::bigint given, given - e * tokens part, sum(n_tokens) over (partition by "domain", lang, source, e order by md5('{seed}:' || e || ':' || doc_id), doc_id::varchar) upto
        from r join given using ("domain", lang, source), range({epochs}) t(e))
      select doc_id, "domain", lang, source, n_tokens, epoch::int epoch, given from reads where upto <= part"""


def crc32_table() -> list[int]:
    """The remainders of all bytes by the polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = 0xEDB88320 ^ c >> 1 if c & 1 else c >> 1
        out.append(c)
    return out


def crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), lambda a, b: xor(a >> 8, ({crc32_table()}::ubigint[])[(xor(a, b) & 255)::int + 1])), 4294967295::ubigint)"


def _spread(name: str, source: str, loads: str) -> str:
    """A recursive table (k, loads, slot, shard) that puts source (k, slot, bytes) one by one on the least loaded shard."""
    least = "list_position(loads, list_min(loads))"
    return f"""{name} as (select 0::bigint k, ({loads}) loads, null::int slot, null::int shard union all
        select o.k, list_transform(loads, lambda v, i: case when i = {least} then v + o.bytes else v end), o.slot, ({least} - 1)::int from {name} join {source} o on o.k = {name}.k + 1)"""


def shards(n: int = 16, grown: int = 17, slots: int = 4096, parts: int = 16, slack: float = 0.01) -> str:
    """Places of all rows by the first map, and shards by its second version; for tables whose parts aren't crowded."""
    by_size = "row_number() over (order by bytes desc, slot) k, slot, bytes"
    return f"""with recursive rows as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint size, ({crc32("coalesce(text, '')")})::bigint text_crc32, (({crc32("coalesce(doc_id::varchar, '')")}) % {slots})::int virtual_slot, (({crc32("'part:' || coalesce(doc_id::varchar, '')")}) % {parts})::int part from documents),
      sizes as (select virtual_slot slot, sum(size)::bigint bytes from rows group by all), ordered as (select {by_size} from sizes),
      {_spread("first", "ordered", f"select list_transform(range({n}), lambda i: 0::bigint)")},
      kept as (select slot, bytes, shard, sum(bytes) over (partition by shard order by bytes desc, slot) <= (select sum(bytes) * {1 + slack}::double / {grown} from sizes) stays from sizes join first using (slot)),
      moving as (select {by_size} from kept where not stays),
      held as (select i, coalesce(sum(bytes) filter (stays), 0)::bigint load from range({grown}) r(i) left join kept on shard = i group by i),
      {_spread("second", "moving", "select list(load order by i) from held")},
      next as (select slot, shard from kept where stays union all select slot, shard from second where k > 0)
      select doc_id, size, text_crc32, 'bytes' law, a.shard, row_number() over (partition by a.shard order by virtual_slot, part, doc_id, text_crc32, size) - 1 slot, null::int grown_shard, virtual_slot, 1 map_version, b.shard next_shard, 2 next_version
      from rows join first a on a.slot = virtual_slot join next b on b.slot = virtual_slot"""


SQL: dict[str, str] = {
    "op4_virtual_slots": shards(),
    "op5_hierarchical_budgets": mix(),
    "op9_itq_dedup": near_vectors(),
    "op10_circulant_minhash": near_duplicates(),
}
