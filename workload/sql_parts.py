"""Building blocks of the DuckDB counterparts, written from the operators' definitions."""

from __future__ import annotations

from string import Formatter

from passagework.functions.prompts import Templates
from workload.views import CATEGORIES, NBSP, SETTINGS, ZWSP, sql_view

WS = r"\t\n\v\f\r \x1c-\x1f\x{85}\p{Z}"
NL = "chr(10)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_views(*names: str) -> str:
    return "with " + ", ".join(sql_view(n) for n in names)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def nfkc(x: str) -> str:
    """Normal form of the characters that occur in the views."""
    for old, new in (("ﬃ", "ffi"), ("ﬁ", "fi"), ("…", "..."), (NBSP, " ")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def fix_encoding(x: str) -> str:
    for old, new in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
                     ("’", "''"), ("‘", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"),
                     ("…", "..."), (NBSP, " "), (ZWSP, "")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def drop_furniture(x: str) -> str:
    s = f"[{WS}]"
    line = (rf"(?i)^(?:{s}*page{s}+\p{{Nd}}+{s}*(?:of{s}+\p{{Nd}}+)?{s}*|{s}*\p{{Nd}}+{s}*"
            rf"|{s}*-{s}*\p{{Nd}}+{s}*-{s}*|{s}*©.*|{s}*confidential{s}*)$")
    return (f"array_to_string(list_filter(string_split({x}, {NL}), "
            f"lambda l: not regexp_matches(l, '{line}')), {NL})")


def whitespace(x: str) -> str:
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', {NL} || {NL}, 'g')"
    return (f"array_to_string(list_transform(string_split({x}, {NL}), "
            f"lambda l: regexp_replace(l, '[{WS}]+$', '')), {NL})")


def strip_control(x: str) -> str:
    return (rf"regexp_replace({x}, "
            rf"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')")


def urls(x: str) -> str:
    return rf"regexp_replace({x}, 'https?://[^{WS}]+', '', 'g')"


def emails(x: str) -> str:
    return rf"regexp_replace({x}, '[^{WS}]+@[^{WS}]+\.[^{WS}]+', '', 'g')"


def punctuation(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[.]{{4,}}', '...', 'g'), '[-]{{4,}}', '---', 'g')"


def clean_steps(source: str, name: str, columns: str) -> str:
    """CTEs that clean ``text`` of ``source`` for embedding, ending in ``name``."""
    keep = f"{columns}, " if columns else ""
    return (
        f"{name}_1 as (select {keep}{drop_furniture(fix_encoding(nfkc('text')))} as text "
        f"from {source}), "
        f"{name}_2 as (select {keep}{strip(strip_control(whitespace('text')))} as text "
        f"from {name}_1), "
        f"{name}_3 as (select {keep}{punctuation(emails(urls('text')))} as text from {name}_2), "
        f"{name} as (select {keep}{strip(whitespace('text'))} as text from {name}_3)")


def recursive_chunks(source: str, name: str, size: int = 1000, overlap: int = 200) -> str:
    """CTEs that chunk ``text`` of ``source`` (doc_id, text), ending in ``name``.

    Texts are cut level by level into pieces, runs of neighbouring small pieces become lists of
    cut offsets, and a recursion walks each run window by window.
    """
    n = name
    marks = [f"{NL} || {NL}", NL, "'. '", "' '"]
    parts = [f"{n}_s1 as (select doc_id, 0 as start, text as t, 1 as level from {source} "
             f"where regexp_matches(text, '[^{WS}]'))"]
    for depth in range(1, 6):
        chosen = " ".join(f"when level <= {i} and contains(t, {m}) then {i}"
                          for i, m in enumerate(marks, 1))
        mark = " ".join(f"when {i} then {m}" for i, m in enumerate(marks, 1))
        parts.append(f"""
        {n}_c{depth} as (select *, case {chosen} else 5 end as sep from {n}_s{depth}),
        {n}_d{depth} as (select *, case sep {mark} else '' end as mark from {n}_c{depth}),
        {n}_e{depth} as (select doc_id, start as parent, sep, unnest(
              case when sep = 5
                   then list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))
                   else list_transform(string_split(t, mark), lambda part, i:
                        case when i = 1 then part else mark || part end) end) as piece,
              generate_subscripts(
              case when sep = 5
                   then list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))
                   else string_split(t, mark) end, 1) as i from {n}_d{depth}),
        {n}_f{depth} as (select *, coalesce(sum(length(piece)) over (partition by doc_id, parent
              order by i rows between unbounded preceding and 1 preceding), 0) + parent as start,
              length(piece) >= {size} and sep < 5 as big from {n}_e{depth} where piece <> ''),
        {n}_g{depth} as (select *, sum(big::int) over (partition by doc_id, parent order by i)
              as island from {n}_f{depth}),
        {n}_s{depth + 1} as (select doc_id, start, piece as t, sep + 1 as level
              from {n}_g{depth} where big)""")
    small = " union all ".join(
        f"select doc_id, {d} as depth, parent, island, start, length(piece) as len "
        f"from {n}_g{d} where not big" for d in range(1, 6))
    parts.append(f"""
        {n}_runs as (select doc_id, depth, parent, island,
              list_append(list(start order by start), max(start + len)) as cuts
              from ({small}) group by doc_id, depth, parent, island),
        {n}_walk as (
              select doc_id, depth, parent, island, cuts, 1 as first,
                     len(list_filter(cuts, lambda c: c <= cuts[1] + {size})) as stop
              from {n}_runs
              union all
              select doc_id, depth, parent, island, cuts, first,
                     len(list_filter(cuts, lambda c: c <= cuts[first] + {size})) as stop
              from (select doc_id, depth, parent, island, cuts,
                           least(greatest(first, len(list_filter(cuts, lambda c: c <
                             greatest(cuts[stop] - {overlap}, cuts[stop + 1] - {size}))) + 1), stop)
                             as first
                    from {n}_walk where stop < len(cuts))),
        {n}_raw as (select w.doc_id, cuts[first] as start, {strip(
            f"substr(s.text, (cuts[first] + 1)::bigint, (cuts[stop] - cuts[first])::bigint)")}
              as text from {n}_walk w join {source} s on w.doc_id = s.doc_id),
        {n} as (select doc_id,
              (row_number() over (partition by doc_id order by start) - 1)::int as chunk_index,
              (count(*) over (partition by doc_id))::int as total_chunks, text
              from {n}_raw where text <> '')""")
    return ", ".join(parts)


def hash_vectors(source: str, name: str, keys: str, column: str = "text",
                 dimension: int = 384) -> str:
    """CTEs that give ``name`` (keys, embedding): the signed hashed word counts at unit length."""
    n = name
    key_list = keys.split(", ")
    on = " and ".join(f"d.{k} = v.{k}" for k in key_list)
    own = ", ".join(f"d.{k}" for k in key_list)
    return f"""
        {n}_t as (select {keys}, unnest(regexp_extract_all({column}, '[A-Za-z0-9]+')) as token
              from {source}),
        {n}_h as (select {keys}, md5(lower(token)) as h from {n}_t),
        {n}_b as (select {keys}, ('0x' || substr(h, 1, 8))::bigint % {dimension} as cell,
              sum(case when ('0x' || substr(h, 9, 1))::int % 2 = 0 then 1 else -1 end)::bigint as n
              from {n}_h group by {keys}, cell),
        {n}_l as (select *, sqrt((sum(n * n) over (partition by {keys}))::double) as size from {n}_b),
        {n}_m as (select {keys}, map_from_entries(list(row(cell, (n / size)::float))) as cells
              from {n}_l where size > 0 group by {keys}),
        {n} as (select {own}, list_transform(range({dimension}), lambda i:
              coalesce(v.cells[i], 0::float)) as embedding
              from {source} d left join {n}_m v on {on})"""


def squared_l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), lambda p: "
            f"(p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))")


def score(distance: str) -> str:
    return f"round(greatest(0.0, 1.0 - {distance} / 2.0), 4)"


def ranked(queries: str, stored: str, name: str, ties: str = "ordinal",
           default_k: int = 5, k: str = "top_k") -> str:
    """CTE ``name`` (query_id, rank, ties, distance) of filtered nearest neighbours."""
    order = ", ".join(f"c.{t}" for t in ties.split(", "))
    return f"""
        {name}_p as (select q.query_id, coalesce(nullif(q.{k}, 0), {default_k}) as k, {order},
              {squared_l2('q.embedding', 'c.embedding')} as distance
              from {queries} q join {stored} c
              on coalesce(q.category, '') = '' or q.category = c.category),
        {name}_r as (select *, (row_number() over (partition by query_id
              order by distance, {ties}))::int as rank from {name}_p),
        {name} as (select query_id, rank, {ties}, distance from {name}_r where rank <= k)"""


def render(template: str, **slots: str) -> str:
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if slot is not None:
            parts.append(f"coalesce({slots[slot]}, '')")
    return " || ".join(parts)


def summary(hits: str, name: str, budget: int = SETTINGS.context_chars) -> str:
    """CTE ``name``: context, source list and counts per question, packed by a running fold."""
    n = name
    return f"""
        {n}_e as (select *, '[Source: ' || filename || ']' || {NL} || content as entry from {hits}),
        {n}_u as (select *, coalesce(sum(length(entry) + 2) over (partition by query_id
              order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as used
              from {n}_e),
        {n}_o as (select *, min(case when used + length(entry) > {budget} then rank end)
              over (partition by query_id) as overflow from {n}_u),
        {n}_k as (select *, case
              when overflow is null or rank < overflow then entry
              when rank = overflow and {budget} - used - 50 > 100
                   then substr(entry, 1, {budget} - used - 50) || '...' end as kept from {n}_o),
        {n}_c as (select query_id, coalesce(string_agg(kept,
              {NL} || {NL} || '---' || {NL} || {NL} order by rank), '') as context,
              count(*) as documents_retrieved, count(distinct filename) as filename_count
              from {n}_k group by query_id),
        {n}_d as (select query_id, filename, category, min(rank) as rank from {hits} group by all),
        {n}_s as (select query_id, string_agg('- ' || filename || ' (' || category || ')', {NL}
              order by rank) as source_list from {n}_d group by query_id),
        {n} as (select c.*, s.source_list from {n}_c c join {n}_s s using (query_id))"""


def user_message(templates: Templates = Templates()) -> str:
    slots = {"question": "question", "context": "context", "sources": "source_list"}
    return (f"case when documents_retrieved is null then {render(templates.nothing, **slots)} "
            f"when filename_count > 1 then {render(templates.several, **slots)} "
            f"else {render(templates.grounded, **slots)} end")


def categories() -> str:
    rows = ", ".join(f"({text(c)}, {text(d)})" for c, d in CATEGORIES)
    return f"categories as (select * from (values {rows}) t(category, description))"


def category_list() -> str:
    return ", ".join(text(c) for c, _ in CATEGORIES)
