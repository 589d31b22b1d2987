"""DuckDB SQL for the operators whose rows SQL can compute on whole tables."""

from __future__ import annotations

_JACCARD = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (
    select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as seen from documents union select r.doc_id, b.y from reach r join both_ways b on b.x = r.seen),
least as (select doc_id, min(seen) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id from documents d left join sizes s on s.doc_id = d.doc_id join least l on l.doc_id = d.doc_id
"""

#: The other operators' rows come from tokenizers, models, hashes of byte runs or fingerprints, which SQL cannot give; tests compare those with brute force.
ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": _JACCARD}
