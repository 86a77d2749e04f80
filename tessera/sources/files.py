"""JSON and JSONL sources and sinks: catalogs, templates, label maps, ground truth, result bundles, page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = ("125", "127", "137", "163")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, and its top-level keys and values as text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.withColumn("fields", F.from_json("value", "map<string,string>")).drop("value")


def form_of(path: Column) -> Column:
    """The form that a path names."""
    out = F.lit(None).cast("string")
    for form in FORMS:
        out = F.when(path.contains(form), form).otherwise(out)
    return out


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, form, field, value); underscore keys and nested values go."""
    each = json_files(spark, path).select(stem_of(F.col("path")).alias("doc_id"), form_of(F.col("path")).alias("form"), F.explode("fields").alias("field", "value"))
    return each.filter(~F.col("field").startswith("_") & ~F.coalesce("value", F.lit("")).rlike(r"^\s*[\[{]"))


def field_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Fields of schema files as a long table; a missing category is general."""
    kinds = "struct<form_number:string,fields:map<string,struct<type:string,tooltip:string,default_value:string,category:string,suffix:string,page:int,x_min:double,y_min:double,x_max:double,y_max:double>>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("s"))
    each = read.select(F.col("s.form_number").alias("form"), F.explode("s.fields").alias("field", "f"))
    return each.select("form", "field", F.coalesce("f.type", F.lit("text")).alias("field_type"), "f.tooltip", "f.default_value", F.coalesce("f.category", F.lit("general")).alias("category"), "f.suffix", F.coalesce("f.page", F.lit(0)).alias("page"), "f.x_min", "f.y_min", "f.x_max", "f.y_max").filter(F.col("form").isin(*FORMS))


def region_template(spark: SparkSession, path: str) -> DataFrame:
    """Typed rectangles of template files, with the resolution they are drawn at (300 unless stated)."""
    kinds = "struct<form_type:string,template_dpi:int,regions:array<struct<field_name:string,page:int,x_min:double,y_min:double,x_max:double,y_max:double,field_type:string>>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("t"))
    return read.select(F.col("t.form_type").alias("form"), F.coalesce("t.template_dpi", F.lit(300)).alias("dpi"), F.inline("t.regions"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label to candidate fields."""
    kinds = "struct<form_type:string,mappings:map<string,array<struct<field_name:string,page:int,y_region:string,match_confidence:double,seen_count:int>>>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("m"))
    return read.select(F.col("m.form_type").alias("form"), F.explode("m.mappings").alias("label", "c")).select("form", "label", F.inline("c"))


def merge_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of several JSONL files, equal stripped lines once."""
    return spark.read.text(paths).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def write_bundle(rows: DataFrame, path: str, stage: str = "stage") -> None:
    """One folder of JSON lines a stage."""
    rows.write.mode("overwrite").partitionBy(stage).json(path)


def not_done(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids whose output is not there yet."""
    return new.join(done.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def usable_cache(pages: DataFrame, kinds: tuple[str, ...] = ("text", "blocks")) -> DataFrame:
    """Doc, usable of (doc, kind, page): whether each cached kind has as many pages as there are images."""
    n = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("page")))
    counted = pages.groupBy("doc").agg(n("image").alias("image"), *[n(k).alias(k) for k in kinds])
    full = [(F.col(k) > 0) & (F.col(k) == F.col("image")) for k in kinds]
    return counted.select("doc", F.array_min(F.array(*[c.cast("int") for c in full])).cast("boolean").alias("usable"))


def page_images(files: DataFrame, stems: DataFrame) -> DataFrame:
    """Folder, stem, page, path: images (folder, path) named stem_page_N.png, cleaned variants aside; a stem without
    any takes all page images of its folder."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = files.withColumn("_name", name).filter(F.col("_name").rlike(r"_page_[0-9]+\.png$") & ~F.col("_name").contains("_clean"))
    seen = parts.select("folder", F.regexp_extract("_name", r"^(.*)_page_[0-9]+\.png$", 1).alias("stem"), F.regexp_extract("_name", r"_page_([0-9]+)\.png$", 1).cast("int").alias("page"), "path")
    own = stems.join(seen, ["folder", "stem"])
    rest = stems.join(own.select("folder", "stem").distinct(), ["folder", "stem"], "left_anti").join(seen.drop("stem"), "folder")
    return own.unionByName(rest.select(*own.columns))
