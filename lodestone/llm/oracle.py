"""DuckDB SQL for the operators that SQL can express over the whole tables."""

from __future__ import annotations

from .decontamination import LEAST_TOKENS, MASKS, SHARE, SPAN
from .jaccard import THRESHOLD
from .quotes import ANNOUNCE
from .quotes import LEAST as LEAST_QUOTE
from .secrets import ACCESS, ACCESS_LEAST, ALLOWED, ASSIGN, ASSIGN_LEAST, CLASSES, HEX, SEQUENCES
from .shingles import WORDS


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(pattern: str, kind: str, order: int, keep: str, source: str = "d") -> str:
    """Spans of a pattern, by what stands between its matches and the matches themselves; `hit` names a match in `keep`."""
    p = _quoted(pattern)
    return f"""select row, {order} as ord, '{kind}' as kind, a, a + length(hit) as b, hit from (
        select row, hit, cast(sum(length(gap) + length(hit)) over (partition by row order by k) - length(hit) as bigint) as a from (
          select row, unnest(regexp_extract_all(text, {p})) as hit, unnest(regexp_split_to_array(text, {p})[:-2]) as gap, unnest(range(len(regexp_extract_all(text, {p})))) as k from {source})) where {keep}"""


def _blanked(text: str, pattern: str, keep: str) -> str:
    p = _quoted(pattern)
    return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {p}), regexp_extract_all({text}, {p})),
      lambda z: z[1] || coalesce(case when {keep.replace('hit', 'z[2]')} then repeat(' ', length(z[2])) else z[2] end, '')), '')"""


def secrets_sql() -> str:
    hexes, letters = CLASSES["entropy_hex"], CLASSES["entropy_base64"]
    best = "list_max(list_transform(range(1, length(hit) - {w} + 2), lambda i: list_entropy(string_split(substr(hit, i, {w}), '')))) >= {t} - 1e-9"
    allowed = f"not regexp_matches(hit, {_quoted(ALLOWED)})"
    alone = f"length(hit) >= {hexes[1]} and regexp_full_match(hit, '[0-9A-Fa-f]+')"  # the look-arounds of the pattern ask for whole runs
    assign, access = f"length(regexp_extract(hit, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}", f"length(hit) >= {ACCESS_LEAST}"
    without = "text"
    for sequence in SEQUENCES:
        without = f"replace({without}, '{sequence}', '{' ' * len(sequence)}')"
    return f"""with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
      base as ({_spans(ASSIGN, "assign", 0, assign)} union all {_spans(ACCESS, "access", 1, access)} union all {_spans(HEX, "hex", 2, "true")}),
      d1 as (select row, {_blanked("text", ASSIGN, assign)} as text from d), d2 as (select row, {_blanked("text", ACCESS, access)} as text from d1),
      d3 as (select row, {_blanked("text", HEX, "hit is not null")} as text from d2), rest as (select row, {without} as text from d3),
      runs as ({_spans("[A-Za-z0-9]+", "entropy_hex", 3, alone, "rest")} union all {_spans(letters[0], "entropy_base64", 4, "true", "rest")}),
      extra as (select * from runs r where {allowed}
        and case when kind = 'entropy_hex' then {best.format(w=hexes[1], t=hexes[2])} else {best.format(w=letters[1], t=letters[2])} end),
      n as (select row, sum((kind = 'assign')::int)::bigint as n_assign, sum((kind = 'access')::int)::bigint as n_access, sum((kind = 'hex')::int)::bigint as n_hex,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) as listed from base group by 1),
      every as (select row, string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) as spans from (select row, ord, kind, a, b from base union all select row, ord, kind, a, b from extra) group by 1)
      select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(listed, '')) as base_sha256, coalesce(spans, '') as spans
      from d left join n using (row) left join every using (row)"""


def contamination_sql() -> str:
    tokens = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    seeds = " union all ".join(f"select id, i, {m} as mask, [" + ", ".join(f"t[i + {k + 1}]" for k in mask) + f"] as seed from {{src}} where i + {mask[-1]} < len(t)" for m, mask in enumerate(MASKS))
    return f"""with d as (select row_number() over () as id, doc_id, {tokens} as t from documents),
      b as (select min(item_id) as id, t from (select item_id, {tokens} as t from benchmark) where len(t) >= {LEAST_TOKENS} group by t),
      dp as (select id, t, unnest(range(len(t))) as i from d), bp as (select id, t, unnest(range(len(t))) as i from b),
      ds as ({seeds.format(src="dp")}), bs as ({seeds.format(src="bp")}),
      met as (select distinct ds.id as doc, bs.id as item, ds.i - bs.i as diagonal from ds join bs using (mask, seed)),
      agree as (select doc, item, diagonal, unnest(range(len(b.t))) as i, b.t as bt, d.t as dt from met join b on b.id = item join d on d.id = doc),
      ones as (select doc, item, diagonal, i, least(len(bt), {SPAN}) as span, (i + diagonal >= 0 and i + diagonal < len(dt) and coalesce(bt[i + 1] = dt[i + diagonal + 1], false))::int as same from agree),
      sums as (select *, sum(same) over (partition by doc, item, diagonal order by i rows between {SPAN - 1} preceding and current row) as part,
        sum(same) over (partition by doc, item, diagonal) as agreeing from ones),
      hit as (select doc, item, max(agreeing) as agreeing from sums where i + 1 >= span and part >= ceil(span * {SHARE}) group by doc, item),
      per as (select doc, count(*) as n, string_agg(item::varchar, ',' order by item) as items, max(agreeing)::bigint as agreeing from hit group by doc)
      select doc_id, (n is not null)::int as contaminated, coalesce(n, 0) as n_items, coalesce(items, '') as items, coalesce(agreeing, 0) as agreeing from d left join per on per.doc = d.id"""


def classes_sql() -> str:
    """Pairs that share one of their least hashes (as pairs at the threshold must), verified, and the closure of the links."""
    w = WORDS
    return rf"""with recursive d as materialized (select row_number() over () as id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from documents),
      s as materialized (select id, doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {w} then [hash(array_to_string(w, ' '))]
        else list_transform(range(1, len(w) - {w - 2}), lambda i: hash(array_to_string(w[i:i + {w - 1}], ' '))) end)) as sh from d),
      u as (select id, unnest(sh[1:len(sh) - ceil({THRESHOLD} * len(sh) - 1e-9)::int + 1]) as h from s),
      p as materialized (select distinct a.id as x, b.id as y from u a join u b on a.h = b.h and a.id < b.id),
      m as (select x, y, a.sh as ash, b.sh as bsh, len(list_intersect(a.sh, b.sh)) as met from p join s a on a.id = x join s b on b.id = y),
      e as materialized (select x, y from m where met >= {THRESHOLD} * (len(ash) + len(bsh) - met) - 1e-9),
      l as (select x, y from e union all select y, x from e),
      reach(id, other) as (select id, id from s union select reach.id, l.y from reach join l on l.x = reach.other),
      c as (select reach.id, min(o.doc_id) as class_id from reach join s o on o.id = reach.other group by 1),
      n as (select x as id, count(*) as n from l group by 1)
      select doc_id, class_id, coalesce(n, 0) as n_links from s left join c using (id) left join n using (id)"""


def threads_sql() -> str:
    """Messages by lines, quoted passages by runs of lines of one level, links by comparing every passage with every message,
    and reply order by the paths of segments. One turn of a conversation has one message of each role."""
    norm = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    key = lambda x: f"coalesce('v' || {x}, 'n')"
    mark = r"'^([ \t]*>)+[ \t]?'"
    return rf"""with recursive m as materialized (select conv_id, turn, role, {key("conv_id")} as ckey, row_number() over (partition by conv_id order by turn nulls first, role nulls first) as pos, coalesce(text, '') as t from conversations),
      l as materialized (select conv_id, pos, unnest(regexp_split_to_array(t, '\r?\n')) as line, unnest(range(len(regexp_split_to_array(t, '\r?\n')))) as i from m),
      lv as materialized (select conv_id, pos, i, length(regexp_replace(regexp_extract(line, {mark}), '[^>]', '', 'g')) as level, regexp_replace(line, {mark}, '') as line from l),
      ol as materialized (select * from lv where level = 0 and not regexp_matches(line, {_quoted(ANNOUNCE)})),
      o as materialized (select m.conv_id, m.pos, any_value(turn) as turn, any_value(role) as role, any_value(ckey) as ckey, trim(coalesce(string_agg(line, chr(10) order by i), '')) as own from m left join ol on ol.conv_id is not distinct from m.conv_id and ol.pos = m.pos group by 1, 2),
      on_ as materialized (select *, {norm("own")} as n from o),
      f as materialized (select distinct conv_id, pos, ckey, n from (select conv_id, pos, ckey, n from on_ union all select ol.conv_id, ol.pos, {key("ol.conv_id")}, {norm("line")} from ol) where n <> ''),
      r as (select *, i - row_number() over (partition by conv_id, pos, level order by i) as run from lv),
      p as materialized (select conv_id, pos, level, min(i) as i, {norm("string_agg(line, chr(10) order by i)")} as n from r where level > 0 group by conv_id, pos, level, run),
      h1 as (select p.conv_id, p.pos, p.i, max(f.pos) as src from p join f on f.conv_id is not distinct from p.conv_id and f.pos < p.pos and f.n = p.n group by 1, 2, 3),
      h2 as (select p.conv_id, p.pos, p.i, max(x.pos) as src from p join on_ x on x.conv_id is not distinct from p.conv_id and x.pos < p.pos and p.n <> '' and contains(' ' || x.n || ' ', ' ' || p.n || ' ') group by 1, 2, 3),
      a1 as (select n, min((ckey, pos)) as first from f group by 1),
      a2 as (select q.n, min((x.ckey, x.pos)) as first from (select distinct n from p where n <> '') q join on_ x on contains(' ' || x.n || ' ', ' ' || q.n || ' ') group by 1),
      s as materialized (select p.conv_id, p.pos, p.level, p.i, case when h1.src is not null then ({key("p.conv_id")}, h1.src) when h2.src is not null then ({key("p.conv_id")}, h2.src)
          when length(p.n) < {LEAST_QUOTE} then null when (a1.first[1] <> {key("p.conv_id")} or a1.first[2] < p.pos) then a1.first when (a2.first[1] <> {key("p.conv_id")} or a2.first[2] < p.pos) then a2.first end as source
        from p left join h1 on h1.conv_id is not distinct from p.conv_id and h1.pos = p.pos and h1.i = p.i left join h2 on h2.conv_id is not distinct from p.conv_id and h2.pos = p.pos and h2.i = p.i
        left join a1 on a1.n = p.n left join a2 on a2.n = p.n),
      k as materialized (select conv_id, pos, count(*) as n_quotes, count(source) as n_linked, arg_min(source, (level, i)) filter (source is not null) as source from s group by 1, 2),
      j as materialized (select o.conv_id, o.pos, o.ckey, k.n_quotes, k.n_linked, k.source, case when k.source[1] = o.ckey and k.source[2] < o.pos - 1 then k.source[2] end as hangs_on
        from o left join k on k.conv_id is not distinct from o.conv_id and k.pos = o.pos),
      g as materialized (select *, coalesce(max(case when hangs_on is not null then pos end) over (partition by conv_id order by pos), 1) as segment from j),
      path(conv_id, segment, way) as (select distinct conv_id, 1, []::bigint[] from g
        union all select c.conv_id, c.pos, path.way || [-c.hangs_on, c.pos] from path join g u on u.conv_id is not distinct from path.conv_id and u.segment = path.segment
          join g c on c.conv_id is not distinct from u.conv_id and c.hangs_on = u.pos)
      select o.conv_id, o.turn, o.role, o.own as text, row_number() over (partition by o.conv_id order by path.way, g.pos) as position, case when g.hangs_on is not null then e.turn else b.turn end as parent_turn,
        coalesce(g.n_quotes, 0) as n_quotes, coalesce(g.n_linked, 0) as n_linked, nullif(substring(g.source[1], 2), '') as source_conv, '<|' || coalesce(o.role, 'unknown') || '|>' || chr(10) || o.own as formatted
      from g join o on o.conv_id is not distinct from g.conv_id and o.pos = g.pos join path on path.conv_id is not distinct from g.conv_id and path.segment = g.segment
        left join o e on e.conv_id is not distinct from g.conv_id and e.pos = g.hangs_on left join o b on b.conv_id is not distinct from g.conv_id and b.pos = g.pos - 1"""
