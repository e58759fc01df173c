"""N-Triples text: one statement per line, so it splits and reads at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators import terms
from tripleloom.operators.mapping import LANG_STRING
from tripleloom.vocab import XSD_STRING

# Subject, predicate, object in one pass; the object is split by its first character afterwards.
_LINE = (
    r'^\s*(<[^>]*+>|_:\S+)\s*<([^>]*+)>\s*'
    r'(?:<([^>]*+)>|(_:\S+)|"((?:[^"\\]++|\\.)*+)"(?:\^\^<([^>]*+)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
)


# One replace turns a line into its fields; the literal, which may hold anything, comes last.
_FIELDS = "\x02$1\x01$2\x01$3\x01$4\x01$6\x01$7\x01$5"


def parse_lines(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """Triples of a column of N-Triples lines; blank lines, comments and broken lines give nothing."""
    cut = F.split(F.regexp_replace(F.col(line), _LINE, _FIELDS), "\x01", 7)
    # the generator stands between the filter and the expression, which is thus evaluated once
    rows = df.select(*keep, F.explode_outer(F.array(cut)).alias("_f"))
    rows = rows.where(F.col("_f")[0].startswith("\x02") & (F.size("_f") == 7))
    subject, predicate, iri, blank, datatype, lang, text = (F.col("_f")[i] for i in range(7))
    is_iri, is_blank = iri != "", blank != ""
    bare = F.substring(subject, F.lit(2), F.length(subject))
    return rows.select(
        *keep,
        F.when(bare.startswith("<"), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare).alias("s"),
        predicate.alias("p"),
        F.when(is_iri, iri).when(is_blank, blank).otherwise(terms.unescape_literal(text)).alias("o"),
        F.when(is_iri, "iri").when(is_blank, "bnode").otherwise("literal").alias("o_kind"),
        F.when(is_iri | is_blank, None)
        .when(lang != "", LANG_STRING)
        .when(datatype != "", datatype)
        .otherwise(XSD_STRING)
        .alias("o_datatype"),
        F.nullif(lang, F.lit("")).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), "value")


def to_lines(triples: DataFrame, *keep: str) -> DataFrame:
    """One N-Triples line per row of a triples table."""

    def resource(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    quoted = F.concat(F.lit('"'), terms.escape_literal(F.col("o")), F.lit('"'))
    obj = (
        F.when(F.col("o_kind") != "literal", resource("o"))
        .when(F.col("o_lang").isNotNull(), F.concat(quoted, F.lit("@"), "o_lang"))
        .when(F.coalesce("o_datatype", F.lit(XSD_STRING)) != XSD_STRING, F.concat(quoted, F.lit("^^<"), "o_datatype", F.lit(">")))
        .otherwise(quoted)
    )
    return triples.select(*keep, F.concat(resource("s"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))
