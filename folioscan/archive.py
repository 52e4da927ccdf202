"""The archive: image import as batches on what is archived already, its tables' listings, and storing the files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import dicom_date, sex, storage_path
from folioscan.operators import hierarchy, lifecycle
from folioscan.sources import store
from folioscan.sources.images import opened

UID, SHA = "sop_instance_uid", "sha256"
STUDIES = 200


def import_batch(images: DataFrame, existing: Mapping[str, DataFrame] | None = None, crashed: Column | None = None) -> dict[str, DataFrame]:
    """The archive's tables after a batch of files (path, file_size, sha256, meta), taken in the order of path: replies,
    patients, studies, series, instances and the new backup events. existing holds the tables before (any of them).

    Files that cannot be read get 400 and take no part in the rest. A file that is archived already is a DUPLICATE, one
    that was left half done a RESUME, other content under a known uid a CONFLICT, which is written to the instance
    unless that is archived. crashed marks files whose import breaks off after the decision (500): their instance stays
    PARSED and has no event. An instance and its event come from the same decision, so they are written together.
    """
    existing = existing or {}
    rows = images.select("path", "file_size", SHA, "meta.*")
    broken = F.lit(False) if crashed is None else F.coalesce(crashed, F.lit(False))
    good = rows.where("outcome = 'OK'").withColumns({"study_date": dicom_date(F.col("study_date")), "birth_date": dicom_date(F.col("birth_date")), "sex": sex(F.col("sex")), "crashed": broken})
    before = existing.get("instances")
    decided = lifecycle.import_decisions(good, UID, SHA, "crashed", ("path",), before)
    bad = rows.where("outcome <> 'OK'").select("path", F.col("outcome").alias("decision"), F.lit(400).alias("status"))
    kept = decided.where(F.col("decision").isin("NEW", "RESUME"))
    number = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    status = F.when(F.col("crashed") & F.col("decision").isin("NEW", "RESUME"), 500).otherwise(lifecycle.http_status(F.col("decision"), F.lit(True)))
    arrived = decided.where("decision = 'NEW'").select(UID, "series_instance_uid", "sop_class_uid", number("instance_number"), "file_size", F.lit(None).cast("string").alias("storage_path"))
    held = arrived if before is None else before.select(*arrived.columns).unionByName(arrived)
    states = lifecycle.states_after(decided, before, UID, SHA)
    # the attempt that completes an import, of which there is one, says where the file is
    stored = kept.where(~F.col("crashed")).select(F.col(UID).alias("_of"), storage_path(F.col("study_instance_uid"), F.col("series_instance_uid"), F.col(UID)).alias("_path"))
    return {
        "replies": decided.select("path", "decision", status.alias("status")).unionByName(bad),
        "patients": hierarchy.upsert_patients(existing.get("patients"), kept.select("patient_id", "issuer", "patient_name", "birth_date", "sex", "path"), ["path"]),
        "studies": hierarchy.upsert_studies(existing.get("studies"), kept.select("study_instance_uid", "patient_id", "issuer", "study_date", "accession_number", "study_description", "path"), ["path"]),
        "series": hierarchy.upsert_series(existing.get("series"), kept.select("series_instance_uid", "study_instance_uid", "modality", number("series_number"), "path"), ["path"]),
        "instances": held.join(states, UID).join(stored, F.col(UID) == F.col("_of"), "left").withColumn("storage_path", F.coalesce("storage_path", "_path")).drop("_of", "_path"),
        "backup_events": lifecycle.outbox(decided, UID, "crashed", ("path",)),
    }


def write_batch(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """All tables of a batch under one version, published by a marker at the end: all of it is seen or nothing."""
    return store.publish(spark, folder, tables)


def get_instance(instances: DataFrame, uid: str) -> DataFrame:
    return hierarchy.point_lookup(instances, UID, uid, instances.columns)


def list_studies(tables: Mapping[str, DataFrame], patient_id: str = "", issuer: str = "", most: int = STUDIES) -> DataFrame:
    """(study_instance_uid, patient_name, patient_id, issuer, study_date, n_instances): newest first, then by uid; of one
    patient if it is given, narrowed by issuer only then."""
    studies = hierarchy.filtered(tables["studies"], ("patient_id", patient_id), ("issuer", issuer))
    page = hierarchy.list_top(studies.join(tables["patients"].select("patient_id", "issuer", "patient_name"), ["patient_id", "issuer"]), [F.desc("study_date"), F.desc("study_instance_uid")], most)
    # only instances of the page's studies are counted
    children = tables["instances"].select("series_instance_uid").join(tables["series"].select("series_instance_uid", F.col("study_instance_uid").alias("of")), "series_instance_uid")
    counted = hierarchy.with_child_count(page, children, "study_instance_uid", "of", "n_instances", page=True)
    return counted.select("study_instance_uid", "patient_name", "patient_id", "issuer", "study_date", "n_instances")


def series_of_study(tables: Mapping[str, DataFrame], study: str) -> DataFrame:
    """(place, series_instance_uid, modality, series_number, n_instances) of a study by number, those without one (-1)
    first, then by uid; place counts from 1."""
    from pyspark.sql import Window

    series = tables["series"].where(F.col("study_instance_uid") == study)
    counted = hierarchy.with_child_count(series, tables["instances"].select("series_instance_uid"), "series_instance_uid", "series_instance_uid", "n_instances", page=True)
    order = Window.partitionBy("study_instance_uid").orderBy(F.asc_nulls_first("series_number"), "series_instance_uid")
    return counted.select(F.row_number().over(order).alias("place"), "series_instance_uid", "modality", F.coalesce("series_number", F.lit(-1)).alias("series_number"), "n_instances")


def recent_backup_events(events: DataFrame, most: int) -> DataFrame:
    """(task_id, instance_id, status, retry_count) of the latest events."""
    return hierarchy.list_top(events, [F.desc("id")], most).select("task_id", "instance_id", "status", "retry_count")


def store_files(files: DataFrame, root: str) -> DataFrame:
    """(source, relative, stored) for files (source, relative path): tasks copy each to a staging name of its own under
    root and rename it, so that no half file is seen and an attempt that runs again does no harm; stored is false for
    one that is missing or cannot be written, whose staging file is removed. Pyarrow opens sources and root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            done = [_stored(fs, base, *pair) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.bool_())], ["source", "relative", "stored"])

    return files.select(F.col("source").cast("string").alias("source"), F.col("relative").cast("string").alias("relative")).mapInArrow(run, "source string, relative string, stored boolean")


def _stored(fs: pyarrow.fs.FileSystem, base: str, source: str | None, relative: str | None) -> bool:
    if not source or not relative or ".." in relative.split("/"):
        return False
    staging, target = f"{base}/.staging/{uuid.uuid4().hex}", f"{base}/{relative}"
    try:
        from_fs, path = opened(source)
        for folder in (f"{base}/.staging", target.rpartition("/")[0]):
            fs.create_dir(folder, recursive=True)
        with from_fs.open_input_stream(path) as file, fs.open_output_stream(staging) as out:
            while piece := file.read(1 << 20):
                out.write(piece)
        fs.move(staging, target)
        return True
    except OSError:
        if fs.get_file_info(staging).is_file:
            fs.delete_file(staging)
        return False
