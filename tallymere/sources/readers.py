"""Sources and sinks: labels as JSON, queue payloads, partitioned blobs, result artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = """merchant struct<name:string,branch:string,address:string,tax_id:string,phone:string>, buyer struct<name:string,tax_id:string>,
receipt struct<number:string,date:string,date_raw:string,time:string,currency:string,decimal_convention:string,cashier:string,terminal:string>,
line_items array<struct<position:int,description_raw:string,sku:string,qty:string,unit:string,unit_price:string,line_total:string,modifiers:array<struct<label:string,amount:string>>,bbox:array<double>,is_template_row:boolean>>,
totals struct<subtotal:string,tax:string,tax_breakdown:array<struct<label:string,base:string,rate:string,amount:string>>,discount:string,total:string,tender:string,change:string,prices_include_tax:boolean>,
payment struct<method:string,card_last4:string>, meta struct<is_handwritten:boolean,is_refund:boolean,legibility:string,ambiguous_fields:array<string>,unreadable_regions:array<string>,receipt_is_inconsistent:boolean,notes:string>"""
JOB = "id string, image_key string, source string, original_filename string, content_type string"


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Label documents, a JSON file each, with file_name; TEMPLATE and manifest files aren't labels.

    Money is text in the files, so no digit is lost. Strict reading fails on a bad file and names it; the other keeps
    its text in `corrupt`.
    """
    reader = spark.read.schema(LABEL + ("" if strict else ", corrupt string")).option("multiLine", "true").option("pathGlobFilter", "*.json")
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    named = reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))
    return named.where(~F.lower("file_name").isin("template.json", "manifest.json"))


def with_defaults(records: DataFrame) -> DataFrame:
    """Parsed records with the schema's defaults where JSON had nothing."""
    item = lambda x: x.withField("position", F.coalesce(x["position"], F.lit(0))).withField("description_raw", F.coalesce(x["description_raw"], F.lit(""))).withField("is_template_row", F.coalesce(x["is_template_row"], F.lit(False)))
    flag = lambda m, name: F.coalesce(m[name], F.lit(False))
    meta = F.col("meta")
    for name in ("is_handwritten", "is_refund", "receipt_is_inconsistent"):
        meta = meta.withField(name, flag(F.col("meta"), name))
    return records.withColumn("line_items", F.transform(F.coalesce("line_items", F.array().cast(records.schema["line_items"].dataType)), item)).withColumn("meta", meta.withField("legibility", F.coalesce(F.col("meta.legibility"), F.lit("good")))).withColumn("receipt", F.col("receipt").withField("decimal_convention", F.coalesce(F.col("receipt.decimal_convention"), F.lit("point"))))


def parse_job(payload: Column) -> Column:
    """A queue message, or null for one that is no object of the schema or lacks id or key."""
    job = F.from_json(payload, JOB)
    return F.when(job["id"].isNotNull() & job["image_key"].isNotNull(), job)


def split_jobs(messages: DataFrame, payload_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(jobs, dead letters)."""
    parsed = messages.withColumn("_job", parse_job(F.col(payload_col)))
    return parsed.where("_job is not null").select("_job.*"), parsed.where("_job is null").drop("_job")


def write_blobs(files: DataFrame, path: str, when_col: str) -> None:
    """Blobs by year and month of arrival."""
    files.withColumns({"yyyy": F.date_format(when_col, "yyyy"), "mm": F.date_format(when_col, "MM")}).write.mode("append").partitionBy("yyyy", "mm").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """A run's results; a folder that is there already is refused."""
    df.write.mode("errorifexists").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, header: bool = True) -> None:
    """A workbook as a folder with a CSV table a sheet."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").option("header", header).csv(f"{path}/{name}")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with the rows of delta in place of those of their keys; reviewed rows of base are never replaced."""
    fixed = base.where("status = 'reviewed'").select(key)
    new = delta.join(fixed, key, "left_anti")
    return base.join(new.select(key), key, "left_anti").unionByName(new)
