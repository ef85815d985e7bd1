"""Domain views over the driver tables, one SQL text per view.

The same text runs in Spark (through named DataFrames) and inside the SQL used
for checking; ``{k}`` is the only dialect difference (number inside ``props``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_K = {
    "spark": "cast(get_json_object(props, '$.k') as int)",
    "sql": "cast(props->>'k' as int)",
}

VIEWS = {
    "catalogue": """
        select p_partkey as product_id, p_partkey as ord, p_name as name, p_brand as brand,
               p_type as category, p_size % 5 as subcategory, p_retailprice as price,
               case when p_partkey % 5 = 0 then p_retailprice * 0.9e0 end as promo_price,
               case when p_partkey % 9 > 0 then p_size end as sugar,
               case when p_partkey % 13 > 0 then cast(p_partkey % 40 as int) end as fat,
               cast(p_partkey % 600 as int) as kcal
        from {part}""",
    "recipe": """
        select o_orderkey as recipe_id, cast(o_orderkey % 6 as double) as rating,
               cast(o_orderkey % 250 as int) as n_ratings,
               case when o_orderkey % 7 > 0 then cast(o_orderkey % 900 as double) end as kcal,
               case when o_orderkey % 11 > 0 then cast(10 + o_orderkey % 70 as int) end as time_min,
               o_orderpriority as source
        from {orders}""",
    "ingredient": """
        select l_orderkey as recipe_id, cast(l_linenumber as bigint) * 1000000000 + l_partkey as ord,
               l_partkey as product_id, l_extendedprice as regular,
               case when l_discount >= 0.05e0 then l_extendedprice * (1.0e0 - 3.0e0 * l_discount) end as promo,
               least(1.0e0, l_quantity / 25.0e0) as used_share, l_linenumber as line, l_suppkey as supplier
        from {lineitem}""",
    "track": """
        select user_id as session, event_id as frame, ts, value / 100.0e0 as x,
               cast(event_id % 250 as double) / 100.0e0 as y, {k} / 100.0e0 as z,
               radians(cast(event_id % 360 as double)) as rot_y
        from {events}""",
    "wide_track": """
        select user_id as session, event_id as frame, ts, value / 2.0e0 as x, {k} * 1.0e0 as z
        from {events}""",
    "observation": """
        select event_id as ord, 'm' || cast(user_id % 4 as string) as map_id,
               'p' || cast({k} % 40 as string) as product_id, 'n' || cast({k} % 7 as string) as name,
               value / 20.0e0 as x, cast(event_id % 250 as double) / 100.0e0 as y, {k} / 20.0e0 as z,
               case event_type when 'purchase' then 'hög' when 'click' then 'medium' else 'låg' end as confidence,
               50.0e0 + {k} / 2.0e0 as score, cast(event_id % 500 as int) as frame
        from {events}""",
    "point": """
        select event_id as point_id, cast(user_id % 4 as int) as map_id, value / 10.0e0 as x,
               cast(event_id % 250 as double) / 100.0e0 as y, {k} / 5.0e0 as z,
               {k} * 10.0e0 as u, value * 10.0e0 as v, value / 40.0e0 as depth,
               cast(event_id % 3 as int) as confidence, cast(event_id % 500 as int) as frame
        from {events}""",
    "box": """
        select p_partkey as box_id, cast(p_partkey % 500 as int) as frame, p_name as name,
               p_size * 5.0e0 as x1, p_size * 5.0e0 + 200.0e0 as x2, 100.0e0 as y1, 600.0e0 as y2
        from {part}""",
    "flag": """
        select event_id as flag_id, user_id as product_id, ts, value > 200.0e0 as handled
        from {events} where event_type = 'error'""",
    "localisation": """
        select event_id as fix_id, cast(user_id % 4 as int) as map_id, user_id as device, ts,
               value / 10.0e0 as true_x, {k} / 10.0e0 as true_z,
               value / 10.0e0 + cast(event_id % 30 as double) / 100.0e0 as est_x,
               {k} / 10.0e0 - cast(event_id % 20 as double) / 100.0e0 as est_z,
               event_type <> 'error' as hit, {k} as inliers,
               {k} / (1.0e0 + cast(event_id % 100 as double)) as inlier_ratio
        from {events}""",
    "tracking": """
        select event_id, user_id as device, ts, event_type = 'signup' as is_fix, {k} as inliers,
               value / 10.0e0 as x, cast(event_id % 90 as double) / 9.0e0 as z,
               radians(cast(event_id % 360 as double)) as yaw
        from {events}""",
    "descriptor": "select vec_id as frame, label as map_id, embedding as vec from {embeddings}",
}
VIEWS["session"] = """
        select session as session_id,
               case session % 3 when 0 then 'klar' when 1 then 'pausad' else 'aktiv' end as status,
               min_by(x, frame) as start_x, min_by(z, frame) as start_z,
               max_by(x, frame) as end_x, max_by(z, frame) as end_z,
               min(ts) as started, max(ts) as ended, count(*) as n_frames
        from {wide_track} group by session"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # times are stored without a zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(text: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name].replace("{k}", _K["spark"])
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _names(text)})


def with_views(body: str) -> str:
    """``body`` in checking SQL with every ``{view}`` it mentions defined up front."""
    wanted: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _names(text):
            if n in VIEWS and n not in wanted:
                wanted[n] = ""
                sql = add(VIEWS[n].replace("{k}", _K["sql"]).replace("as string", "as varchar"))
                wanted.pop(n)
                wanted[n] = sql
            text = text.replace("{" + n + "}", n)
        return text

    body = add(body)
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} as ({sql})" for n, sql in wanted.items())
    stripped = body.lstrip()
    if stripped.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{stripped[len('with recursive '):]}"
    if stripped.lower().startswith("with "):
        return f"with {ctes},\n{stripped[len('with '):]}"
    return f"with {ctes}\n{body}"


class Registry:
    """Named queries of one subject: a Spark function and, where SQL can say it, the SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def register(fn):
            if key in self.queries:
                raise KeyError(key)
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = with_views(sql)
            return fn

        return register


def sql_round(expr: str, places: int = 4) -> str:
    return f"(round(({expr}) + 1e-9, {places}) + 0e0)"
