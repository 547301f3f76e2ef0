"""DuckDB SQL for the text operators whose whole result SQL can express."""

from __future__ import annotations

# Fixed values, spelt out here once more so that this SQL shares none with the operators: base phrases of licences,
# templates with the phrase that has to stand, and the patterns of secrets with the group of the value and its least length.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
STATEMENTS = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "must retain the above copyright notice"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "to endorse or promote products"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("agpl-3", "gnu affero general public license version 3", "affero general public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]+", 0, 80),
]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_join() -> str:
    """Shingle sets by their text, all pairs that share one, and components by recursion."""
    return rf"""
with recursive worded as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), placed as (select doc_id, len(w) as many, unnest(w) as w, unnest(range(len(w))) as i from worded),
runs as (select doc_id, many, i, concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o) as t from placed window o as (partition by doc_id order by i)),
sets as (
  select worded.doc_id, coalesce(list(distinct t) filter (t is not null), []) as s
  from worded left join runs on runs.doc_id = worded.doc_id and i <= greatest(many - 4, 0) group by worded.doc_id
), sized as (select doc_id, len(s) as n, hash(list_sort(s)) as alike from sets),
one as (select alike, n, min(doc_id) as rep from sized where n > 0 group by alike, n),
tokens as (select rep, one.n, unnest(s) as t from one join sets on sets.doc_id = one.rep),
links as (
  select a.rep as a, b.rep as b from tokens a join tokens b on a.t = b.t and a.rep < b.rep and a.n >= 0.85 * b.n and b.n >= 0.85 * a.n
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), two_way as (select a, b from links union all select b, a from links),
reach as (select rep as node, rep as seen from one union select reach.node, two_way.b from reach join two_way on two_way.a = reach.seen)
, lowest as (select node, min(seen) as component_id from reach group by node)
select doc_id, sized.n::bigint as n_shingles, coalesce(component_id, doc_id) as component_id
from sized left join one on one.alike = sized.alike and one.n = sized.n left join lowest on lowest.node = one.rep
"""


def license_scan() -> str:
    """Words with their places, each template's starts from the rarest word of what has to stand, and its words matched there."""
    rows = [(k, label, t.split(), None) for k, (label, t) in enumerate(PHRASES)]
    rows += [(len(PHRASES) + k, label, t.split(), key.split()) for k, (label, t, key) in enumerate(STATEMENTS)]
    at = lambda t, key: next(i for i in range(len(t)) if t[i : i + len(key)] == key)
    values = ", ".join(f"({k}, {_text(label)}, [{', '.join(map(_text, t))}], {at(t, key) if key else 0}, {len(key or t)}, {'true' if key is None else 'false'})" for k, label, t, key in rows)
    return rf"""
with templates as (select * from (values {values}) v(k, label, t, lo, size, base)),
slots as (select k, unnest(t) as w, unnest(range(len(t))) as o from templates),
worded as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
placed as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from worded),
known as (select * from placed where w in (select w from slots)),
rare as (select slots.w, count(distinct doc_id) as n from slots left join known on known.w = slots.w group by slots.w),
anchors as (select k, arg_min(slots.w, n * 1000 + o) as w from slots join templates using (k) join rare on rare.w = slots.w where o >= lo and o < lo + size group by k),
starts as (select distinct known.doc_id, k, i - o as s from anchors join slots using (k, w) join known using (w)),
matched as (
  select starts.doc_id, k, s, count(*) as n, count(*) filter (o >= lo and o < lo + size) as n_key
  from starts join slots using (k) join templates using (k) join known on known.doc_id = starts.doc_id and known.i = s + o and known.w = slots.w
  group by starts.doc_id, k, s
), found as (
  select doc_id, label, base, s, n / len(t)::double as share from matched join templates using (k)
  where n_key = size and (base or n / len(t)::double >= 0.75)
), told as (
  select doc_id, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word, max(share) as score,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, string_agg(distinct label, ',' order by label) as labels
  from found group by doc_id
)
select worded.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from worded left join told on told.doc_id = worded.doc_id
"""


def secret_scan() -> str:
    """Matches with the lengths of what lies before them, owners of each value, and the spans put together."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(SECRETS):
        rx = _text(pattern)
        parts.append(f"""
  select doc_id, {k} as kind, {_text(name)} as name, {least} as least, unnest(string_split_regex(coalesce(text, ''), {rx})[:len(regexp_extract_all(coalesce(text, ''), {rx}))]) as gap,
    unnest(regexp_extract_all(coalesce(text, ''), {rx})) as whole, unnest(regexp_extract_all(coalesce(text, ''), {rx}, {group})) as value,
    unnest(range(len(regexp_extract_all(coalesce(text, ''), {rx})))) as nth, source, lang from documents""")
    return rf"""
with matches as ({" union all ".join(parts)}),
placed as (
  select *, sum(length(gap) + length(whole)) over (partition by doc_id, kind order by nth) as stop from matches
), spans as (select doc_id, kind, name, (stop - length(whole))::bigint as start, stop::bigint as stop, value, source, lang from placed where length(value) >= least),
owned as (select value, count(distinct coalesce('o' || source, 'n')) as owners, count(distinct (coalesce('o' || source, 'n'), coalesce('l' || lang, 'n'))) as repos from spans group by value),
judged as (select spans.*, owners < 3 and (owners < 2 or repos < 6) as live from spans join owned using (value)),
told as (
  select doc_id, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, count(*) filter (live) as n_live,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3), '') as base,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3 or live), '') as spans
  from judged group by doc_id
)
select d.doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live
from documents d left join told on told.doc_id = d.doc_id
"""


def near_vectors() -> str:
    """All pairs by their cosine in doubles, and components by recursion."""
    return """
with recursive doubles as (select vec_id, embedding::double[] as v from embeddings),
fine as (
  select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from doubles
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9
), reach as (select vec_id as node, vec_id as seen from embeddings union select node, b from reach join links on a = seen),
least as (select node, min(seen) as component_id from reach group by node),
many as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join many on a = vec_id join least on node = vec_id
"""


def centroids() -> str:
    """Every distance to every centroid in whole numbers; the rounds are spelt out."""
    assign = """
a{r} as (
  select row_key, v, k, d from (
    select row_key, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept, c{r}
  ) qualify row_number() over (partition by row_key order by d, k) = 1
)"""
    move = """
m{n} as (
  select k, list((floor_sum - case when floor_sum % n < 0 then floor_sum % n + n else floor_sum % n end) // n order by i) as c
  from (select k, i, sum(x)::bigint as floor_sum, count(*) as n from (select k, unnest(v) as x, unnest(range(64)) as i from a{r}) group by k, i) group by k
),
c{n} as (select c{r}.k, coalesce(m{n}.c, c{r}.c) as c from c{r} left join m{n} using (k))"""
    rounds = ",".join(assign.format(r=r) + "," + move.format(r=r, n=r + 1) for r in range(3)) + "," + assign.format(r=3)
    return f"""
with doubles as (select vec_id, embedding::double[] as e from embeddings),
kept as (
  select row_number() over () as row_key, vec_id, list_transform(e, lambda x: floor(64 * x)::bigint) as v from doubles
  where len(e) = 64 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
),
c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 as k, v as c from kept qualify k < 16),
{rounds}
select vec_id, a3.k::integer as cluster, d as distance, sum(d) over (partition by a3.k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(c3.c, ',')) as centroid_sha256
from a3 join kept using (row_key) join c3 on c3.k = a3.k
"""


def fill_in_middle() -> str:
    """Lists of units, cut by numbers from the hash; what is restored has to be the text."""
    drawn = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::bigint"
    return rf"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), cut as (
  select doc_id, text, u, len(u) as n, {drawn(0)} % (len(u) + 1) as x, {drawn(1)} % (len(u) + 1) as y, {drawn(2)} % 100 as p, {drawn(3)} % 100 as q from base
), formed as (
  select *, least(x, y) as a, greatest(x, y) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or p >= 90 then 'plain' when q < 20 then 'spm' else 'psm' end as form from cut
), parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:n], ''), '') as suf from formed
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else text end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


ORACLE: dict[str, str] = {
    "op2_jaccard_join": jaccard_join(), "op6_license_scan": license_scan(), "op7_secret_scan": secret_scan(), "op10_near_vectors": near_vectors(),
    "op11_centroids": centroids(), "op12_fill_in_middle": fill_in_middle(),
}
