"""Trial runs of mappings on sample messages, for a whole catalog at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.model import Mapping, MappingError
from tripleloom.operators import rulesets, validate
from tripleloom.operators.mapping import JSONLD, TURTLE, document_column, join_conditions, with_elements
from tripleloom.session import fits, prepare
from tripleloom.vocab import INPUT_FORMATS

# fixed values: sample message of each input format
SAMPLES = {"JSON": '{"key": "value"}', "CSV": "1, 2, 3", "XML": "<tag>text</tag>"}


def sample_for(input_format: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in SAMPLES.items():
        out = F.when(input_format == name, F.lit(text)).otherwise(out)
    return out


def no_such_mapping(mapping_id: Column) -> Column:
    return F.concat(F.lit("NoSuchMapping: "), F.coalesce(mapping_id, F.lit("null")))


Rules = dict[str, Mapping] | DataFrame


def rules_of(spark: SparkSession, mappings: Rules) -> DataFrame:
    """The rule table of some mappings; a table of rules is one already (see sources.rules.load_catalog)."""
    return mappings if isinstance(mappings, DataFrame) else rulesets.rule_table(spark, mappings)


def apply_by_id(df: DataFrame, mappings: Rules, mapping_id: str, payload: str, key: str) -> DataFrame:
    """Add `doc` and `error` for rows that each name their mapping.

    Mappings that can be data are looked up, so the plan doesn't grow with their number; the others are columns of their own,
    each guarded by its id, so a row pays for the one it uses. Errors are values: an unknown mapping, one that
    cannot be compiled, or a malformed message never stops the others. With a table of rules all are looked up; one that
    is no data there is an error of its messages. Rules that the driver holds are broadcast if their size, which it knows, is
    below Spark's threshold; a table of rules is left to Catalyst.
    """
    spark = prepare(df.sparkSession)
    chosen = F.col(mapping_id)
    rules = rules_of(spark, mappings)
    compiled = {} if isinstance(mappings, DataFrame) else mappings
    names = {c: f"_rule_{c}" for c in rules.columns}
    # the program is parsed once a mapping
    rules = rules.withColumn("program", F.from_json("program", rulesets.PROGRAM, {"maxStringLen": "2147483647"}))
    df = df.join(rules.select(*[F.col(c).alias(n) for c, n in names.items()]), chosen == F.col(names["mapping_id"]), "left")
    formats = tuple(sorted({m.input_format for m in compiled.values()})) or INPUT_FORMATS
    fmt, problem = F.col(names["input_format"]), F.col(names["problem"])
    if isinstance(mappings, DataFrame):
        problem = F.coalesce(problem, F.when(~F.col(names["is_data"]), F.lit("MappingError: this mapping has to be compiled")))
    df = df.withColumn("_ok", validate.is_valid(F.col(payload), fmt, formats) & problem.isNull())
    active = F.col("_ok") & F.col(names["is_data"])
    columns, written = rulesets.document(F.col(payload), F.col(key).cast("string"), active, names["input_format"], names["output_format"], names["program"])
    for name, column in columns.items():
        df = df.withColumn(name, column)
    doc = F.when(active, written)
    helpers = [*names.values(), "_ok", *columns]
    for n, (name, mapping) in enumerate(compiled.items()):
        try:
            if rulesets.as_data(mapping) is not None:
                continue
        except MappingError:  # its problem is in the rules
            continue
        column = f"_m{n}"
        form = TURTLE if mapping.output_format == "TTL" else JSONLD
        mine = F.col("_ok") & (chosen == name)
        try:
            df = with_elements(df, mapping, form, column, F.col(payload), mine, F.col(key).cast("string"), join_conditions(mapping))
        except MappingError as e:
            doc = F.when(chosen == name, F.lit(None).cast("string")).otherwise(doc)
            df = df.withColumn(names["problem"], F.when(chosen == name, F.lit(f"MappingError: {e}")).otherwise(problem))
            continue
        doc = F.when(chosen == name, document_column(F.col(column), mapping.output_format)).otherwise(doc)
        helpers.append(column)
    error = (
        F.when(fmt.isNull(), no_such_mapping(chosen))
        .when(problem.isNotNull(), problem)
        .when(~F.col("_ok"), validate.error_text(fmt))
    )
    return df.withColumn("doc", F.when(F.col("_ok") & problem.isNull(), doc)).withColumn("error", error).drop(*helpers)


def dry_run(catalog: DataFrame, mappings: Rules, mapping_id: str = "mapping_id", sample: str | None = None) -> DataFrame:
    """ok, error and doc of every catalog row, run on its sample or on the default of its format.

    Without samples of their own every mapping is run once, apart from the catalog, and looked up.
    """
    known = rules_of(catalog.sparkSession, mappings).select(F.col("mapping_id").alias("_named"), F.col("input_format").alias("_format"))
    if sample is None:
        names = known.select(F.col("_named").alias("_tried"), F.lit(None).cast("string").alias("_own"))
        tried = dry_run(names, mappings, "_tried", "_own").drop("_own")
        if not isinstance(mappings, DataFrame) and fits(catalog.sparkSession, rulesets.rule_rows(mappings)):
            tried = F.broadcast(tried)  # a row for each of the driver's mappings, whose documents come from short samples
        rows = catalog.join(tried, F.col(mapping_id) == F.col("_tried"), "left")
        unknown = F.when(F.col("_tried").isNull(), no_such_mapping(F.col(mapping_id)))
        return rows.withColumns({"error": F.coalesce("error", unknown), "ok": F.coalesce("ok", F.lit(False))}).drop("_tried")
    catalog = catalog.join(known, F.col(mapping_id) == F.col("_named"), "left")
    fmt = F.col("_format")
    text = F.coalesce(F.col(sample), sample_for(fmt))
    run = apply_by_id(catalog.withColumn("_sample", text), mappings, mapping_id, "_sample", mapping_id)
    return run.withColumn("ok", F.col("error").isNull()).drop("_sample", "_named", "_format")
