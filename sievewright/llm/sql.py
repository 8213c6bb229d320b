"""DuckDB SQL with the rows of those queries that SQL can express."""

from .licenses import DENIED, FILE_NAME, LEAST, MARGIN, TEMPLATES, TERM, UNKNOWN

_CLOSURE = """, pairs as (select a, b from links union all select b, a from links),
 reach(node, spot) as (select id, id from nodes union select r.node, p.b from reach r join pairs p on p.a = r.spot),
 comp as (select node, min(spot) as component_id from reach group by node)"""

OP2 = (
    r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
 nodes as (select doc_id as id, len(s) as n from s),
 e as (select doc_id, unnest(s) as x from s),
 common as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from common c join nodes x on x.id = c.a join nodes y on y.id = c.b where 100 * k >= 85 * (x.n + y.n - k))"""
    + _CLOSURE
    + " select id as doc_id, cast(n as bigint) as n_shingles, component_id, id = component_id as kept from nodes join comp on node = id"
)

OP3 = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, cast(octet_length(encode(h)) as bigint) as n, sha1(h) as x, max(page_id) over (partition by sha1(h)) as r from p),
 bits as (select *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(x, i, 1)) - 1), 4, '0')), '') as b from d)
 select page_id, n as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(substr(b, 5 * i + 1, 1) as integer) * 16 + cast(substr(b, 5 * i + 2, 1) as integer) * 8 + cast(substr(b, 5 * i + 3, 1) as integer) * 4
 + cast(substr(b, 5 * i + 4, 1) as integer) * 2 + cast(substr(b, 5 * i + 5, 1) as integer), 1)), '') as payload_digest, case when r = page_id then 'response' else 'revisit' end as record_type, case when r <> page_id then r end as refers_to from bits"""

OP4 = (
    """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
 good as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 nodes as (select vec_id as id from v),
 links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.98)"""
    + _CLOSURE
    + """, n as (select a, count(*) as n from pairs group by a)
 select id as vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, component_id, id = component_id as kept from nodes join comp on node = id left join n on n.a = id"""
)

OP7 = r"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
 h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
 r(rh, rp, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
 f as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
 select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join f using (page_id)"""

_NOTICES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

#: Between two blocks of a text.
_BLANK = r"\n[\x20\x09-\x0D]*\n"

#: RE2 has no look-ahead; names of this query end in a number, so that part of the pattern can't matter.
_FILE = FILE_NAME.replace(r"(?=[0-9])", "")

OP8 = rf"""with d as (select doc_id, concat_ws('/', source, lang, doc_id) as path, coalesce(text, '') as text from documents),
 n as (select count(*) as files from d), df as (select term, count(*) as df from (select distinct path, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from d) group by term),
 g as (select distinct path, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{_BLANK}'))) as seg from d),
 tf as (select path, seg, term, count(*) as tf from (select path, seg, unnest(regexp_extract_all(lower(seg), '{TERM}')) as term from g) group by all),
 t(template, license, notice) as (values {_NOTICES}),
 m as (select template, license, term, count(*) as tf from (select template, license, unnest(regexp_extract_all(lower(notice), '{TERM}')) as term from t) group by all),
 w as (select path, seg, term, tf.tf * (ln((1 + files) / (1 + df.df)) + 1) as w from tf join df using (term) cross join n),
 v as (select template, license, term, m.tf * (ln((1 + files) / (1 + coalesce(df.df, 0))) + 1) as v from m left join df using (term) cross join n),
 vn as (select template, sqrt(sum(v * v)) as vn from v group by 1), wn as (select path, seg, sqrt(sum(w * w)) as wn from w group by all),
 s as (select path, seg, license, max(score) as score from (select path, seg, license, round(sum(w * v / vn) / any_value(wn), 6) as score from w join v using (term) join vn using (template) join wn using (path, seg) group by path, seg, template, license) x group by all),
 k as (select *, row_number() over (partition by path, seg order by score desc, license) as place, lead(score) over (partition by path, seg order by score desc, license) as next from s),
 y as (select path, score, next is not null and next >= {LEAST} - {MARGIN} and round(score - next, 6) < {MARGIN} as unsure, license from k where place = 1 and score >= {LEAST} and not regexp_matches(array_to_string(regexp_extract_all(lower(seg), '{TERM}'), ' '), '{DENIED}')),
 b as (select path, case when unsure then '{UNKNOWN}' else license end as license, score from y qualify row_number() over (partition by path order by unsure, score desc, case when unsure then '{UNKNOWN}' else license end) = 1),
 f as (select regexp_replace(path, '/?[^/]*$', '') as dir, license, score from b where regexp_matches(path, '{_FILE}') qualify row_number() over (partition by regexp_replace(path, '/?[^/]*$', '') order by score desc, license) = 1),
 u as (select doc_id, path, regexp_replace(path, '/?[^/]*$', '') as near, regexp_replace(path, '/[^/]*/[^/]*$', '') as far from d)
 select doc_id, coalesce(b.license, x.license, y.license) as license, coalesce(b.score, x.score, y.score) as score,
 case when b.license is not null then 'own' when x.license is not null or y.license is not null then 'inherited' else 'none' end as origin,
 case when b.license is null then coalesce(x.dir, y.dir) end as from_dir from u left join b using (path) left join f x on x.dir = near left join f y on y.dir = far"""

OP10 = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, x, case x when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from (values (0), (1)) v(x)),
 z as (select *, length(role) + length(regexp_replace(role, '[^\\<\[\]/]', '', 'g')) as role_size, case when contains(text, '</s>') then 2 + length(text) + length(regexp_replace(text, '[^\\<\[\]/]', '', 'g')) else length(text) end as text_size from t)
 select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(9 + role_size + 1 + text_size + 4) as bigint) as formatted_chars from z group by conv_id"""

def _merkle(levels: int) -> str:
    """SQL of op11: `levels` levels of 16, a node that is alone staying as it is. Each row folds up by its own path."""
    field = lambda x: f"case when {x} is null then '-' else octet_length(encode(cast({x} as varchar))) || ':' || {x} end"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_transform(range(0, 8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"d as (select doc_id, source, {leaf('text')} as leaf, {leaf(lower)} as other, {crc} % 5 = 0 as tampered, row_number() over () as r from documents)",
        "p0 as (select r, source as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n, leaf as h, case when tampered then other else leaf end as f, '' as proof from d)",
    ]
    name = "p0"
    for tree in ("s", "t"):
        for k in range(levels):
            new, children = f"{tree}{k}", f"{tree}{k}c"
            out.append(f"{children} as (select g, i // 16 as j, list(h order by i) as hs from (select distinct g, i, h from {name} where n > 1) group by all)")
            out.append(
                f"{new} as (select r, {name}.g, coalesce(j, 0) as i, (n + 15) // 16 as n, case when n > 1 then sha256(array_to_string(hs, '')) else h end as h, "
                "case when n > 1 then sha256(array_to_string(hs[:i % 16], '') || f || array_to_string(hs[i % 16 + 2:], '')) else f end as f, "
                f"case when n > 1 then proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') else proof end as proof from {name} left join {children} on {name}.g is not distinct from {children}.g and j = i // 16 and n > 1)"
            )
            name = new
        if tree == "s":
            out.append(f"subroots as (select g, any_value(h) as h from {name} group by g)")
            out.append("places as (select g, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n from subroots)")
            out.append(f"tops as (select r, '' as g, places.i, places.n, h, f, proof, h as subroot from {name} join places on {name}.g is not distinct from places.g)")
            name = "tops"
    out.append(f"folded as (select d.doc_id, leaf, tops.subroot, {name}.h as root, sha256({name}.proof) as proof_sha256, {name}.f as folded_root from {name} join d using (r) join tops using (r))")
    return "with " + ",\n ".join(out) + "\n select *, folded_root = root as verified from folded"


OP11 = _merkle(5)

#: Sources stop in the order of their bounds over their weights; the rate is that of the first k stopped beyond which none reaches its bound.
OP13 = r"""with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(text, '')) as mark from documents),
 z as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
 w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 3 * source_size as bound from z),
 o as (select *, row_number() over (order by bound / w, source nulls last) as k, sum(source_size) over () as pot, sum(w) over () as heavy from w),
 p as (select k, w, bound, pot - coalesce(sum(bound) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest, heavy - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) as heavy from o),
 f as (select rest, heavy from p where rest * w < bound * heavy order by k limit 1),
 t as (select o.source, o.source_size, case when f.heavy is null or f.rest * o.w >= o.bound * f.heavy then cast(o.bound as double) else cast(f.rest * o.w as double) / cast(f.heavy as double) end as target from o left join f on true),
 e as (select *, cast(case when source_size = 0 then 0.0 else least(target / source_size, 3.0) end as decimal(17, 15)) as copies, cast(cast(('0x' || substr(md5('1:' || coalesce('+' || source, '')), 1, 8)) as bigint) / 4294967296 as decimal(17, 15)) as u from t),
 h as (select d.*, e.source_size, e.target, e.copies, e.u, md5('1:' || coalesce(cast(doc_id as varchar), '-') || ':' || mark) < '8' as half from d join e on d.source is not distinct from e.source),
 s as (select *, sum(copies) over (partition by source order by half, case when half then -size else size end, doc_id nulls first, mark rows between unbounded preceding and current row) + u as upto from h),
 c as (select *, cast(floor(upto) - floor(upto - copies) as bigint) as n, row_number() over () as r, row_number() over (partition by source order by half, case when half then -size else size end, doc_id nulls first, mark) as place from s),
 m as (select source, any_value(target) as target, any_value(target) - sum(size * n) as miss from c group by source),
 x as (select r, c.source, size, cast(sign(miss) as integer) as way, cast(floor(abs(miss)) as bigint) as missing, row_number() over (partition by c.source order by size desc, place) as k from c join m on c.source is not distinct from m.source
 where abs(miss) > 0.001 * m.target and size > 0 and case when miss > 0 then n < copies else n > copies end),
 g as (select source, cast(0 as bigint) as k, cast(0 as bigint) as r, 0 as way, any_value(missing) as rest, false as turned from x group by source
 union all select x.source, x.k, x.r, x.way, g.rest - case when x.size <= g.rest then x.size else 0 end, x.size <= g.rest from g join x on x.source is not distinct from g.source and x.k = g.k + 1)
 select doc_id, size, source_size, target, cast(size * (n + coalesce(g.way, 0)) as bigint) as taken from c left join g on g.r = c.r and g.turned"""

SQL = {"op2_minhash": OP2, "op3_warc": OP3, "op4_embeddings": OP4, "op7_urls": OP7, "op8_licenses": OP8, "op10_chat": OP10, "op11_merkle": OP11, "op13_mixing": OP13}
