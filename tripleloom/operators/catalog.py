"""Channel and mapping catalogs as tables: register, list, look up, remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.model import Mapping
from tripleloom.operators.dryrun import dry_run
from tripleloom.operators.settings import mapping_hash, mapping_header


def register_channels(requests: DataFrame, catalog: DataFrame, mappings: dict[str, Mapping]) -> DataFrame:
    """Decide each request (channel_id, seq, mapping_id, ...): `accepted` and the `reason` if not.

    The mapping is tried on its sample first. Then an id must be new: neither in the catalog nor
    asked for by an earlier request of the batch. The first request of an id is found with a partial
    aggregate and matched on the unique (id, seq), so one id asked for very often is no hot key.
    """
    tried = dry_run(requests, mappings).drop("doc").withColumnRenamed("error", "_error").drop("ok")
    known = catalog.select("channel_id").distinct().withColumn("_known", F.lit(True))
    checked = tried.join(known, "channel_id", "left")
    passes = F.col("_error").isNull() & F.col("_known").isNull()
    first = checked.where(passes).groupBy("channel_id").agg(F.min("seq").alias("seq")).withColumn("_first", F.lit(True))
    decided = checked.join(first, ["channel_id", "seq"], "left")
    reason = (
        F.when(F.col("_error").isNotNull(), F.concat(F.lit("RMLMappingException: "), "_error"))
        .when(F.col("_known") | F.col("_first").isNull(), F.concat(F.lit("NonUniqueChannelIdException: "), "channel_id"))
    )
    return decided.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_error", "_known", "_first")


def list_channels(
    definitions: DataFrame,
    include_all: bool = False,
    status: bool = False,
    metadata: bool = False,
    settings: bool = False,
    rml: bool = False,
) -> DataFrame:
    """Channels with the sections asked for; none asked for leaves the id alone.

    The mapping text comes only with its own flag, so a listing of a column table does not read it.
    """
    columns = [F.col("channel_id")]
    if include_all or status:
        columns.append(F.col("status"))
    if include_all or metadata:
        mapping = F.col("metadata.mapping")
        if include_all or rml:
            shown = mapping.withField("rmlHash", mapping_hash(mapping.getField("rml")))
        else:
            shown = mapping_header(mapping)
        columns.append(F.col("metadata").withField("mapping", shown).alias("metadata"))
    if include_all or settings:
        columns.append(F.col("settings"))
    return definitions.select(*columns)


def find(table: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """Rows of the wanted ids; an id that is not there comes back with an error text."""
    rows = wanted.select(id_column).distinct().join(table.withColumn("_found", F.lit(True)), id_column, "left")
    missing = F.concat(F.lit("No entry with ID: "), F.col(id_column).cast("string"))
    return rows.withColumn("error", F.when(F.col("_found").isNull(), missing)).drop("_found")


def remove(table: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The table without the given ids."""
    return table.join(ids.select(id_column).distinct(), id_column, "left_anti")


def remove_report(table: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """One row per id to remove: `removed`, or not because it was not there."""
    there = table.select(id_column).distinct().withColumn("_there", F.lit(True))
    asked = ids.select(id_column).distinct().join(there, id_column, "left")
    return asked.select(id_column, F.col("_there").isNotNull().alias("removed"))


def with_mapping_id(mappings: DataFrame) -> DataFrame:
    """Catalog rows with an id derived from their content, so that a repeated task adds no twin."""
    return mappings.withColumn("mapping_id", F.substring(F.sha2(F.to_json(F.struct(*mappings.columns)), 256), 1, 24))


def list_mappings(mappings: DataFrame, include_all: bool = False, header: bool = False, rml: bool = False) -> DataFrame:
    """Mappings as id only, header (text replaced by its hash), or whole."""
    plain = [c for c in mappings.columns if c not in ("mapping_id", "rml")]
    if include_all or (header and rml):
        return mappings.select("mapping_id", *plain, "rml", mapping_hash(F.col("rml")).alias("rml_hash"))
    if header:
        return mappings.select("mapping_id", *plain, mapping_hash(F.col("rml")).alias("rml_hash"))
    return mappings.select("mapping_id")
