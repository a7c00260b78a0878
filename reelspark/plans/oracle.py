"""DuckDB SQL for the recommender views, shared by every oracle query.

The driver registers the raw parquet tables as views; each oracle statement
re-derives the recommender views as CTEs with the same rules as
``reelspark.sources.driver_tables``.
"""

from __future__ import annotations

VIEWS = {
    "ratings": """
select uid, mid, score, ts from (
  select o_custkey uid, l_partkey mid, cast(ceil(l_quantity/5) as double)/2 score,
         cast(epoch(o_orderdate) as bigint) ts,
         row_number() over (partition by o_custkey, l_partkey
                            order by o_orderdate desc, l_orderkey desc, l_linenumber desc, l_quantity desc) rn
  from lineitem join orders on l_orderkey = o_orderkey) x where rn = 1""",
    "items": """
select p_partkey mid, concat(p_name,' (',cast(1970+p_size as varchar),')') title,
       concat(p_type,'|',replace(p_name,' ','|')) genres from part""",
    "users": "select c_custkey uid, c_name username from customer",
    "tags": """
select user_id uid, cast(regexp_extract(props,'([0-9]+)',1) as bigint) mid, event_type tag,
       cast(floor(epoch(ts)) as bigint) ts from events""",
    "log_lines": """
select event_id, case when event_type in ('purchase','view')
  then concat('INFO web : MOVIE_RATING_PREFIX:', cast(user_id as varchar), '|',
              regexp_extract(props,'([0-9]+)',1), '|', cast(cast(1+event_id%10 as double)/2 as varchar), '|',
              cast(cast(floor(epoch(ts)) as bigint) as varchar))
  else concat('INFO web : ', event_type) end line from events""",
}

# CTEs derived from the views, reused by several statements.
DERIVED = {
    "avg_scores": "select mid, avg(score) avg from ratings group by mid",
    "genres_list": """
select distinct g genre from (select unnest(string_split(genres, '|')) g from items) t where g <> ''""",
    "genre_top": """
select genre, cast(rn as bigint) rank, mid, avg from (
  select g.genre, i.mid, a.avg,
         row_number() over (partition by g.genre order by a.avg desc, i.mid asc) rn
  from items i join avg_scores a on i.mid = a.mid
  join genres_list g on contains(lower(i.genres), lower(g.genre))) t where rn <= 10""",
    "item_years": """
select mid, title, genres,
       coalesce(try_cast(nullif(regexp_extract(title, '\\((\\d{4})\\)\\s*$', 1), '') as integer), 1990) release_year
from items""",
    "user_pref": """
select distinct r.uid, g genre from ratings r join items i on r.mid = i.mid,
  unnest(string_split(i.genres, '|')) t(g) where r.score > 3.0 and g <> ''""",
}

_DEPS = {
    "avg_scores": ["ratings"],
    "genres_list": ["items"],
    "genre_top": ["items", "avg_scores", "genres_list"],
    "item_years": ["items"],
    "user_pref": ["ratings", "items"],
}


def _closure(names):
    out: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views/derived CTEs (and their dependencies), then ``body``."""
    extra = extra or {}
    order = _closure(names)
    parts = []
    for n in order:
        sql = VIEWS.get(n) or DERIVED[n]
        parts.append(f"{n} as ({sql.strip()})")
    for n, sql in extra.items():
        parts.append(f"{n} as ({sql.strip()})")
    body = body.strip()
    if body[:15].lower() == "with recursive ":
        # RECURSIVE belongs right after WITH and applies to the whole list
        return "with recursive " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].lower() == "with ":
        # the body brings its own CTEs: append them to ours
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
