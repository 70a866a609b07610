"""Airport lists and versions from gateway JSON, and metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AIRPORTS = "airports array<struct<AirportCode:string,AirportName:string,AcceptedSceneryCount:int,metadata:struct<icao_code:string,faa_code:string,local_code:string>>>"
VERSIONS = "airport struct<icao:string,recommendedSceneryId:long,scenery:array<struct<sceneryId:long,userName:string,dateAccepted:string,dateApproved:string>>>"
ZERO_DATE = "0000-00-00T00:00:00.000Z"


def _merged(code: Column, more: Column) -> Column:
    """``code`` with ``more`` behind it, unless that is empty or already contained."""
    return F.when(more.isNull() | (more == "") | code.contains(more), code).otherwise(F.concat(code, F.lit(" "), more))


def gateway_airports(documents: DataFrame) -> DataFrame:
    """(code, name, codes) of the airports in JSON texts (column ``value``) whose number of accepted sceneries isn't negative."""
    rows = documents.select(F.explode(F.from_json("value", AIRPORTS)["airports"]).alias("a")).filter("a.AcceptedSceneryCount >= 0")
    codes = F.col("a.AirportCode")
    for more in ("icao_code", "faa_code", "local_code"):
        codes = _merged(codes, F.col(f"a.metadata.{more}"))
    return rows.select(F.col("a.AirportCode").alias("code"), F.coalesce("a.AirportName", F.lit("")).alias("name"), codes.alias("codes"))


def gateway_versions(documents: DataFrame) -> DataFrame:
    """(icao, scenery_id, user, accepted, approved, recommended); versions neither accepted nor approved are left out."""
    parsed = documents.select(F.from_json("value", VERSIONS)["airport"].alias("a"))
    rows = parsed.select("a.icao", F.col("a.recommendedSceneryId").alias("best"), F.explode("a.scenery").alias("s"))
    date = lambda c: F.nullif(F.nullif(F.col(f"s.{c}"), F.lit(ZERO_DATE)), F.lit(""))
    out = rows.select("icao", F.col("s.sceneryId").alias("scenery_id"), F.coalesce("s.userName", F.lit("")).alias("user"), date("dateAccepted").alias("accepted"), date("dateApproved").alias("approved"), F.col("best").eqNullSafe(F.col("s.sceneryId")).alias("recommended"))
    return out.filter("accepted is not null or approved is not null")


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; short rows are filled with empty strings."""
    return spark.read.csv(path, header=True, quote='"', escape='"').na.fill("")
