"""License files, headers and flags of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.classify import license_family, license_file_type, spdx, top_folder
from gleaner.plans import signatures as S


def families(files: DataFrame, text: str = "text") -> DataFrame:
    """files with family and kind of the text."""
    kinds = F.create_map(*[F.lit(x) for f, k, _ in S.LICENSES for x in (f, k)])
    out = files.withColumn("family", license_family(F.col(text)))
    return out.withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("family")), F.lit("read in full")))


def flags(files: DataFrame) -> DataFrame:
    """One row from (path, family): copyleft and restricted families, more than one family, no license at the root.

    Only license files count, notes and notices don't; unrecognized texts are no family. There are as many families as
    the table has.
    """
    own = files.where(license_file_type(F.substring_index("path", "/", -1)) == "license")
    row = own.agg(F.collect_set(F.when(F.col("family") != "Unrecognized", F.col("family"))).alias("f"), F.coalesce(F.bool_or(~F.col("path").contains("/")), F.lit(False)).alias("root"))
    some = lambda names: F.array_join(F.array_sort(F.array_intersect("f", F.array(*[F.lit(n) for n in names]))), ",")
    return row.select(some(S.COPYLEFT).alias("copyleft"), some(S.SOURCE_AVAILABLE).alias("source_available"), (F.size("f") > 1).alias("more_than_one_family"), (~F.col("root")).alias("missing_root_license"))


def spdx_headers(files: DataFrame) -> DataFrame:
    """(scope, name, identifier, files): by identifier over all, and by top folder."""
    rows = files.where(F.col("text").contains("SPDX-License-Identifier")).select(spdx(F.col("text")).alias("identifier"), top_folder(F.col("path")).alias("area")).where("identifier <> ''")
    all_ = rows.groupBy("identifier").agg(F.count("*").alias("files")).select(F.lit("all").alias("scope"), F.lit("").alias("name"), "identifier", "files")
    return all_.unionByName(rows.groupBy("area", "identifier").agg(F.count("*").alias("files")).select(F.lit("area").alias("scope"), F.col("area").alias("name"), "identifier", "files"))
