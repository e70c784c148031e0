"""Registry records: nested JSON to rows (SRC4, M10-M12, O14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_month
from ..functions.jsons import na_to_null
from ..functions.text import strip_tags

_EVENT = "struct<id:bigint,name:string,location:string,url:string,date:string>"
_COMPETITION = f"struct<role:string,points:int,result:string,event:{_EVENT}>"
_DIVISION = f"struct<division:struct<name:string,abbreviation:string>,competitions:array<{_COMPETITION}>>"
ROLES = ("leader", "follower")


def _v(path: str, kind: str = "string"):
    return F.expr(f"try_variant_get(v, '{path}', '{kind}')")


def responses(raw: DataFrame) -> DataFrame:
    """query, payload with ``v`` (the payload as a variant) and ``kind``: none, candidates, dancer or error."""
    v = raw.withColumn("v", F.expr("try_parse_json(payload)"))
    shape = F.schema_of_variant("v")
    empty = F.col("payload").isNull() | F.trim("payload").isin("", "[]", "{}", "null", '""')
    listed = F.startswith(shape, F.lit("ARRAY"))
    names = F.expr("try_variant_get(v, '$.names', 'array<variant>')")
    dancer = F.expr(" OR ".join(f"variant_get(v, '$.{k}') IS NOT NULL" for k in (*ROLES, "dominate_data", "dancer_wsdcid")))
    nothing = _v("$.type").isin("none", "error") | F.expr("variant_get(v, '$.error') IS NOT NULL")
    kind = (
        F.when(empty, "none").when(F.col("v").isNull(), "error").when(listed | names.isNotNull(), "candidates")
        .when(~F.startswith(shape, F.lit("OBJECT")), "error").when(dancer, "dancer").when(nothing, "none").otherwise("error")
    )
    return v.withColumn("kind", kind)


def candidates(found: DataFrame) -> DataFrame:
    """query, registry_id, first_name, last_name of the dancers that a search lists (K17: three spellings of the number)."""
    items = F.coalesce(F.expr("try_variant_get(v, '$.names', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    each = found.where("kind = 'candidates'").select("query", F.posexplode(items).alias("ord", "v"))
    number = F.coalesce(*(_v(f"$.{k}", "bigint") for k in ("wscid", "wsdcid", "dancer_wsdcid")))
    return each.select("query", "ord", number.alias("registry_id"), _v("$.first_name").alias("first_name"), _v("$.last_name").alias("last_name")).where("registry_id IS NOT NULL")


def dancers(found: DataFrame) -> DataFrame:
    """One row per dancer record with roles and levels; N/A becomes null."""
    na = lambda path: na_to_null(_v(path))
    nested = lambda k: F.coalesce(*(_v(f"$.{b}.dancer.{k}") for b in ("dominate_data", "follower", "leader")))
    other = "$.non_dominate_lookup[0]"
    return found.where("kind = 'dancer'").select(
        "query", F.coalesce(_v("$.dancer_wsdcid"), nested("wscid")).try_cast("bigint").alias("registry_id"),
        F.coalesce(_v("$.dancer_first"), nested("first_name")).alias("first_name"), F.coalesce(_v("$.dancer_last"), nested("last_name")).alias("last_name"),
        _v("$.short_dominate_role").alias("primary_role"), _v("$.short_non_dominate_role").alias("secondary_role"),
        na("$.dominate_role_highest_level").alias("primary_highest_level"), na("$.dominate_role_highest_level_points").alias("primary_highest_points"),
        na("$.non_dominate_role_highest_level").alias("secondary_highest_level"), na("$.non_dominate_role_highest_level_points").alias("secondary_highest_points"),
        na("$.dominate_required").alias("level_required"), na("$.dominate_allowed").alias("level_allowed"),
        na(f"{other}.non_dominate_required").alias("secondary_level_required"), na(f"{other}.non_dominate_allowed").alias("secondary_level_allowed"),
        na(f"{other}.non_dominate_recommended").alias("secondary_level_recommended"), F.nullif(strip_tags(_v(f"{other}.message")), F.lit("")).alias("secondary_rule"),
        F.coalesce(_v("$.is_pro", "boolean"), F.lit(False)).alias("is_pro"),
    )


def placements(found: DataFrame) -> DataFrame:
    """Role -> style -> division -> competition flattened; an empty list in place of a map means none."""
    rows = None
    for role in ROLES:
        styles = F.from_json(F.get_json_object("payload", f"$.{role}.placements"), f"map<string,map<string,{_DIVISION}>>", {"mode": "PERMISSIVE"})
        part = found.where("kind = 'dancer'").select("query", F.lit(role).alias("of"), F.explode(styles).alias("style", "divisions"))
        part = part.select("query", "of", "style", F.explode("divisions").alias("abbr", "d")).select("query", "of", "style", "abbr", "d.division", F.posexplode("d.competitions").alias("ord", "c"))
        rows = part if rows is None else rows.unionByName(part)
    month = F.date_format(parse_month(F.col("c.event.date")), "yyyy-MM")
    return rows.select(
        "query", F.coalesce("c.role", "of").alias("role"), "style", F.coalesce("division.name", "abbr").alias("division"), F.coalesce("division.abbreviation", "abbr").alias("division_abbr"),
        F.col("c.result").alias("result"), F.col("c.points").alias("points"), F.col("c.event.id").alias("registry_event_id"), F.col("c.event.name").alias("event_name"),
        F.col("c.event.location").alias("location"), F.col("c.event.url").alias("url"), month.alias("month"), "ord",
    )


def newest_first(rows: DataFrame) -> DataFrame:
    """O14."""
    return rows.orderBy(F.desc_nulls_last("month"), "query", "role", "style", "division", "ord")


def registry_for(searched: DataFrame, wanted: DataFrame) -> DataFrame:
    """ER12: per wanted name (name, name_norm) the only candidate with exactly that name, or why there is none.

    ``searched`` are candidates with name_norm; a search that failed comes with status error.
    """
    fits = wanted.join(searched.where("registry_id IS NOT NULL"), "name_norm", "left").groupBy("name", "name_norm").agg(F.count_distinct("registry_id").alias("n"), F.min("registry_id").alias("registry_id"))
    failed = searched.where("status = 'error'").select(F.col("query").alias("name")).distinct().withColumn("failed", F.lit(True))
    status = F.when(F.coalesce("failed", F.lit(False)), "unavailable").when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("multiple")
    return fits.join(failed, "name", "left").select("name", "name_norm", status.alias("status"), F.when(F.col("n") == 1, F.col("registry_id")).alias("registry_id"))
