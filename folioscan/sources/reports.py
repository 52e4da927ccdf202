"""Report XML: one row a file, parsed by from_xml; each file is a record or has a reason why it is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import child_text
from folioscan.operators.dedup import first_wins

SCHEMA = (
    "report_id string, study_instance_uid string, patient struct<patient_id:string, patient_name:string, sex:string>, "
    "exam struct<exam_date:string, modality:string, exam_part:string, doctor:string>, diagnosis struct<conclusion:string, description:string>, _corrupt_record string"
)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, xml): the *.xml files of a folder, not of folders in it."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"))


def reason(r: Column, xml: Column) -> Column:
    """Why a file is rejected, in the order of the checks; null if it is not."""
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    broken = r.isNull() | r["_corrupt_record"].isNotNull()
    root = ~F.rlike(xml, F.lit(r"^\s*(?:<\?xml[^>]*\?>)?(?:\s|<!--(?s:.*?)-->)*<report[\s>/]"))
    return (
        F.when(broken, "not well-formed").when(root, "no report element").when(text(r["report_id"]), "no report_id").when(text(r["patient"]["patient_id"]), "no patient_id")
        .when(r["diagnosis"].isNull(), "no diagnosis").when(text(r["diagnosis"]["conclusion"]), "no conclusion")
    )


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): records have the fields, '' where one lacks; rejects are (file, reason)."""
    read = files.withColumn("_r", F.from_xml("xml", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    judged = read.withColumn("reason", reason(F.col("_r"), F.col("xml")))
    fields = ["report_id", "study_instance_uid", "patient.patient_id", "patient.patient_name", "patient.sex", "exam.exam_date", "exam.modality", "exam.exam_part", "exam.doctor", "diagnosis.conclusion", "diagnosis.description"]
    records = judged.where("reason IS NULL").select("file", *(child_text(F.col(f"_r.{f}")).alias(f.split(".")[-1]) for f in fields))
    return records, judged.where("reason IS NOT NULL").select("file", "reason")


def unique_reports(records: DataFrame) -> DataFrame:
    """The first record of each report_id, by file name."""
    return first_wins(records, ["report_id"], ["file"])


def build_counts(files: DataFrame) -> DataFrame:
    """(indexed, duplicates, bad) of a folder's files."""
    records, rejects = parse(files)
    every = records.select("report_id").unionByName(rejects.select(F.lit(None).cast("string").alias("report_id")))
    counted = every.agg(F.countDistinct("report_id").alias("indexed"), F.count("report_id").alias("good"), F.count("*").alias("files"))
    return counted.select("indexed", (F.col("good") - F.col("indexed")).alias("duplicates"), (F.col("files") - F.col("good")).alias("bad"))
