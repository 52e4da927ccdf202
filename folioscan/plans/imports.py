"""Sources, sinks and the archive's state on the driver's tables: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import archive
from folioscan.functions import text
from folioscan.operators import hierarchy, index, lifecycle
from folioscan.plans.archive import CUSTOMER, NOW, _outbox
from folioscan.plans.common import scratch, table, write_files
from folioscan.sources import images, reports, store

#: The study whose series are listed, the time that divides events into two batches of imports, an instance.
STUDY, CUT, INSTANCE = 7, "2024-01-16 00:00:00", "7.3"


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _xml(id: Column, patient: Column, conclusion: Column, description: Column) -> Column:
    part = lambda name, value: F.concat(F.lit(f"<{name}>"), _escaped(value), F.lit(f"</{name}>"))
    return F.concat(F.lit('<?xml version="1.0"?><report>'), part("report_id", id), F.lit("<patient>"), part("patient_id", patient), F.lit("</patient><exam><modality>CT</modality></exam><diagnosis>"), conclusion, part("description", description), F.lit("</diagnosis></report>"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of every document: pairs share an id, some lack a patient or a conclusion, some are cut short."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " "))
    conclusion = F.when(i % 7 == 3, F.lit("")).otherwise(F.concat(F.lit("<conclusion>"), _escaped(F.concat(F.lit("c "), F.col("source"))), F.lit("</conclusion>")))
    xml = _xml(F.concat(F.lit("R"), i - i % 2), F.when(i % 13 == 5, F.lit("")).otherwise(F.concat(F.lit("P"), i % 50)), conclusion, F.concat(F.lit("d "), words))
    return docs.select(F.concat(F.lpad(i.cast("string"), 12, "0"), F.lit(".xml")).alias("file"), F.when(i % 11 == 4, F.substring(xml, 1, 90)).otherwise(xml).alias("xml"))


def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports parsed from XML, the first of each id."""
    records, _ = reports.parse(_reports(spark, sf_dir))
    return reports.unique_reports(records).select("report_id", "file", "patient_id", "study_instance_uid", "conclusion", "description")


def report_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse(_reports(spark, sf_dir))[1]


def report_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.build_counts(_reports(spark, sf_dir))


def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, one a nation, some of another kind, read and parsed."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", _xml(F.concat(F.lit("N"), "n_nationkey"), F.col("n_name"), F.lit("<conclusion>c</conclusion>"), F.lit("d")).alias("xml")).collect()
    folder = scratch(spark)
    write_files(spark, folder, {f"n{r.n_nationkey}.{'txt' if r.n_nationkey % 6 == 5 else 'xml'}": r.xml.encode() for r in n})
    return reports.parse(reports.read_files(spark, folder))[0].select("file", "report_id", "patient_id")


def _element(tag: str, vr: str, value: Column, explicit: Column | bool = True) -> Column:
    data = F.concat(F.encode(value, "UTF-8"), F.when(F.octet_length(value) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    size = F.lpad(F.hex(F.octet_length(data).cast("long")), 2, "0")
    long = F.concat(F.unhex(F.lit(tag)), F.unhex(F.concat(size, F.lit("000000"))), data)
    short = F.concat(F.unhex(F.lit(tag)), F.encode(F.lit(vr), "UTF-8"), F.unhex(F.concat(size, F.lit("00"))), data)
    return short if explicit is True else F.when(explicit, short).otherwise(long)


#: In hex: a sequence and an item of no stated length with a patient's id that is not the file's; an element of unknown
#: kind; pixel data, cut short as it is never read.
NESTED = "08004011" + "5351" + "0000" + "FFFFFFFF" + "FEFF00E0" + "FFFFFFFF" + "10002000" + "4C4F" + "0200" + "5858" + "FEFF0DE0" + "00000000" + "FEFFDDE0" + "00000000"
UNKNOWN, PIXELS = "09001010" + "554E" + "0000" + "04000000" + "01020304", "E07F1000" + "4F57" + "0000" + "00100000" + "0102"
NESTED_IMPLICIT = "08004011" + "FFFFFFFF" + "FEFF00E0" + "FFFFFFFF" + "10002000" + "02000000" + "5858" + "FEFF0DE0" + "00000000" + "FEFFDDE0" + "00000000"
PIXELS_IMPLICIT = "E07F1000" + "00100000" + "0102"


def _image(key: Column, name: Column, kind: Column, date: Column) -> Column:
    """The bytes of a header; kind says what is wrong with it (0 to 3) or how it is coded."""
    explicit = kind != 4
    syntax = F.when(kind == 1, "1.2.840.10008.1.2.2").when(kind == 4, "1.2.840.10008.1.2").otherwise("1.2.840.10008.1.2.1")
    uid = lambda x: F.concat(F.lit(x), key.cast("string"))
    series = F.when(kind == 2, F.unhex(F.lit(""))).otherwise(_element("20000E00", "UI", uid("1.4."), explicit))
    whole = F.concat(
        F.unhex(F.lit("00" * 128)), F.encode(F.when(kind == 0, "DICN").otherwise("DICM"), "UTF-8"), _element("02001000", "UI", syntax), _element("08001800", "UI", uid("1.2."), explicit), _element("08002000", "DA", date, explicit),
        _element("10001000", "PN", name, explicit), _element("10002000", "LO", uid("P"), explicit), _element("20000D00", "UI", uid("1.3."), explicit), series, _element("20001300", "IS", F.lpad((key % 1000).cast("string"), 4, "0"), explicit),
    )
    # a sequence without a length, then an element of a long kind and the pixel data, each with its four bytes of length
    tail = F.unhex(F.when(explicit, F.lit(NESTED + UNKNOWN + PIXELS)).otherwise(F.lit(NESTED_IMPLICIT + PIXELS_IMPLICIT)))
    return F.when(kind == 3, F.substring(whole, F.lit(1), F.octet_length(whole) - 3)).otherwise(F.concat(whole, tail))


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header of every order, written as bytes and read back: each kind of outcome, both codings."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    content = _image(F.col("o_orderkey"), F.col("c_name"), F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyyMMdd"))
    read = orders.select("o_orderkey", images.metadata(content).alias("m"))
    ok = lambda c: F.when(F.col("m.outcome") == "OK", c)
    return read.select("o_orderkey", "m.outcome", *(ok(F.col(f"m.{c}")).alias(c) for c in ("sop_instance_uid", "series_instance_uid", "patient_id", "patient_name", "instance_number", "series_number")), ok(F.date_format(text.dicom_date(F.col("m.study_date")), "yyyy-MM-dd")).alias("study_date"))


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of image files, one a nation, read by ranges: size, digest and header."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", _image(F.col("n_nationkey"), F.col("n_name"), F.lit(5), F.lit("20240102")).alias("x")).collect()
    folder = scratch(spark)
    write_files(spark, folder, {f"{r.n_nationkey}.dcm": bytes(r.x) for r in rows})
    read = images.read_images(spark, folder)
    return read.select("file_size", "sha256", F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("int").alias("n_nationkey"), F.col("meta.outcome").alias("outcome"), F.col("meta.patient_name").alias("n_name"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of import attempts: content that differs, attempts that break off, files that cannot be read."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    uid = F.concat(F.col("user_id").cast("string"), F.lit("."), (i % 4).cast("string"))
    fields = {c: F.lit("") for c in images.STRINGS} | {"series_number": F.lit(-1), "instance_number": (i % 9).cast("int")}
    fields |= {"sop_instance_uid": uid, "study_instance_uid": F.concat(F.lit("s"), "user_id"), "series_instance_uid": F.concat(F.lit("e"), uid), "patient_id": F.concat(F.lit("p"), F.col("user_id") % 50), "patient_name": F.col("event_type"), "modality": F.col("event_type"), "study_date": F.date_format("ts", "yyyyMMdd")}
    meta = F.struct(F.when(i % 17 == 0, "TRUNCATED").otherwise("OK").alias("outcome"), *(c.alias(n) for n, c in fields.items()))
    return e.select(F.lpad(i.cast("string"), 12, "0").alias("path"), i.alias("file_size"), F.when(F.col("value") > 60, "a").otherwise("b").alias("sha256"), meta.alias("meta"), (i % 3 == 0).alias("crash"), (F.col("ts") >= F.lit(CUT).cast("timestamp")).alias("later"))


def _two_batches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The first batch is written as a version and read back as what is archived when the second comes."""
    rows, folder = _attempts(spark, sf_dir), scratch(spark)
    crashed = F.substring("path", 1, 12).cast("long") % 3 == 0
    first = archive.import_batch(rows.where("not later"), crashed=crashed)
    archive.write_batch(spark, folder, first)
    held = {name: store.load(spark, folder, name) for name in ("patients", "studies", "series", "instances")}
    return archive.import_batch(rows.where("later"), held, crashed)


def import_next_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_batches(spark, sf_dir)["replies"]


def import_next_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_batches(spark, sf_dir)["instances"].select("sop_instance_uid", "sha256", "status", "file_size", "storage_path")


def import_next_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_batches(spark, sf_dir)["patients"].select("patient_id", "patient_name")


def import_next_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of the first batch, with the date of the second where that has one of theirs, and new ones."""
    return _two_batches(spark, sf_dir)["studies"].select("study_instance_uid", "patient_id", F.col("study_date").cast("string").alias("study_date"))


def import_next_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series stay as they came first."""
    return _two_batches(spark, sf_dir)["series"].select("series_instance_uid", "study_instance_uid", "modality")


def instance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instance of the archive after both batches."""
    return archive.get_instance(_two_batches(spark, sf_dir)["instances"], INSTANCE).select("sop_instance_uid", "series_instance_uid", "sha256", "status", "instance_number")


def import_next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_batches(spark, sf_dir)["backup_events"]


def _archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as patients, orders as studies, lines as series, and as many instances as a line's number says."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    patients = c.select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_nationkey").cast("string").alias("issuer"), F.col("c_name").alias("patient_name"))
    studies = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("study_instance_uid"), F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_nationkey").cast("string").alias("issuer"), F.to_date("o_orderdate").alias("study_date"))
    uid = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey")
    series = l.select(uid.alias("series_instance_uid"), F.col("l_orderkey").alias("study_instance_uid"), F.col("l_returnflag").alias("modality"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("series_number"))
    return {"patients": patients, "studies": studies, "series": series, "instances": l.select(uid.alias("series_instance_uid"), F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("instance_number"))}


def study_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.list_studies(_archive(spark, sf_dir)).withColumn("study_date", F.col("study_date").cast("string"))


def study_list_of_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.list_studies(_archive(spark, sf_dir), str(CUSTOMER)).withColumn("study_date", F.col("study_date").cast("string"))


def series_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of a study in their order: those without a number come first."""
    return archive.series_of_study(_archive(spark, sf_dir), STUDY)


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the path of the order it names; some name none."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("instance_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.storage_path(F.col("o_custkey"), F.lit("1"), F.col("o_orderkey")).alias("storage_path"))
    return lifecycle.event_paths(events, orders)


def _dispatched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _outbox(spark, sf_dir).withColumns({"task_id": F.concat(F.lit("t"), "id"), "instance_id": F.col("id") * 3})
    return lifecycle.dispatch(events, events.where("id % 5 <> 2").select("id"), F.lit(NOW).cast("timestamp"), None)


def dispatch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir)[0]


def dispatch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir)[1].select("id", "status")


def recent_backup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events after a round of the dispatcher."""
    return archive.recent_backup_events(_dispatched(spark, sf_dir)[1], 20)


def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins by name against accounts; a name that no account has is refused."""
    logins = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 13).cast("string"), 9, "0")).alias("username"))
    accounts = table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"))
    return hierarchy.looked_up(logins, accounts, "username").select("event_id", "username", "role", F.col("role").isNotNull().alias("known"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, sex codes, bit strings, masks, padding and paths on every order."""
    k = F.col("o_orderkey")
    date = F.when(k % 5 == 0, F.lit("20240230")).when(k % 5 == 1, F.lit("2024-1-1")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select(
        k, F.date_format(text.dicom_date(date), "yyyy-MM-dd").alias("day"), text.sex(F.col("o_orderstatus")).alias("sex"), text.binary_string(-k).alias("bits"), text.from_binary_string(text.binary_string(k)).alias("back"), text.unsigned(-k).alias("unsigned"),
        text.hamming(k, F.col("o_custkey")).alias("hamming"), text.masked(F.when(k % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))).alias("masked"), F.length(text.trim_padding(F.concat("o_orderpriority", F.lit(" \x00 ")))).alias("trimmed"), text.storage_path(F.col("o_custkey"), F.lit("s"), k).alias("path"),
        text.child_text(F.when(k % 2 == 0, F.col("o_orderstatus"))).alias("child"),
    )


def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two published versions and a later one that lacks its marker: the second is what a reader gets."""
    tf = index.term_frequencies(table(spark, sf_dir, "documents"), {"text": 1})
    folder, n = scratch(spark), table(spark, sf_dir, "documents").count()
    store.publish(spark, folder, {"terms": index.document_frequencies(tf.where("tf > 1"))})
    version = store.publish(spark, folder, {"terms": index.document_frequencies(tf)})
    index.document_frequencies(tf.where("tf > 2")).write.parquet(f"{folder}/v{version + 1}/terms")
    return store.load(spark, folder, "terms").select("term", "df", F.lit(store.versions(spark, folder)[-1]).alias("version"), F.lit(n).alias("documents"))


QUERIES = [
    report_records, report_rejects, report_build_counts, report_scan, image_headers, image_scan, import_next_replies, import_next_instances, import_next_patients, import_next_studies, import_next_series, instance_lookup, import_next_events, recent_backup_events, study_list, study_list_of_patient, series_list, event_paths,
    dispatch_messages, dispatch_states, account_lookup, text_functions, index_versions,
]

_REPORT = r"""r AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') || '.xml' AS file, CASE WHEN doc_id % 11 = 4 THEN 'not well-formed' WHEN doc_id % 13 = 5 THEN 'no patient_id' WHEN doc_id % 7 = 3 THEN 'no conclusion' END AS reason, 'R' || (doc_id - doc_id % 2) AS report_id,
  'P' || (doc_id % 50) AS patient_id, 'c ' || source AS conclusion, trim('d ' || trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g'))) AS description FROM documents)"""
_TRY = f"""
a AS (SELECT event_id, lpad(event_id::VARCHAR, 12, '0') AS path, user_id || '.' || (event_id % 4) AS uid, CASE WHEN value > 60 THEN 'a' ELSE 'b' END AS sha, event_id % 3 = 0 AS crashed, ts >= TIMESTAMP '{CUT}' AS later, user_id, event_type, ts, event_id % 17 = 0 AS bad FROM events),
f AS (SELECT *, first_value(sha) OVER w AS sha0, row_number() OVER w AS rn FROM a WHERE NOT bad WINDOW w AS (PARTITION BY uid ORDER BY later, path)),
g AS (SELECT *, max((sha = sha0 AND NOT crashed)::INT) OVER (PARTITION BY uid ORDER BY later, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM f),
d AS (SELECT *, CASE WHEN rn = 1 THEN 'NEW' WHEN sha <> sha0 THEN 'CONFLICT' WHEN done = 1 THEN 'DUPLICATE' ELSE 'RESUME' END AS decision FROM g)"""
_PARTS = "i AS (SELECT l_orderkey, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS uid, l_linenumber AS n, l_returnflag FROM lineitem)"
_STUDIES = f"""WITH {_PARTS} SELECT o_orderkey AS study_instance_uid, c_name AS patient_name, c_custkey::VARCHAR AS patient_id, c_nationkey::VARCHAR AS issuer, strftime(o_orderdate, '%Y-%m-%d') AS study_date,
  (SELECT coalesce(sum(a.n), 0) FROM i AS a JOIN i AS b USING (uid, l_orderkey) WHERE a.l_orderkey = o_orderkey)::BIGINT AS n_instances FROM orders JOIN customer ON o_custkey = c_custkey {{where}} ORDER BY o_orderdate::DATE DESC, o_orderkey DESC LIMIT 200"""
_ROUND = f"""o AS (SELECT event_id AS id, ['PENDING', 'PUBLISHED', 'CONFIRMED', 'DEAD'][event_id % 4 + 1] AS status, event_id % 7 AS retry_count, ts AS created_at, ts + INTERVAL 64 SECOND AS next_retry_at FROM events),
due AS (SELECT id FROM o WHERE (status = 'PENDING' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 5 SECOND) OR (status = 'PUBLISHED' AND next_retry_at <= TIMESTAMP '{NOW}' AND retry_count < 5))"""

def _hex(tag: str, vr: str, value: str) -> str:
    """An element as SQL that gives its hex digits."""
    n = f"octet_length(encode({value}))"
    return f"'{tag}{vr.encode().hex().upper()}' || lpad(hex({n} + {n} % 2), 2, '0') || '00' || hex(encode({value})) || repeat('00', ({n} % 2)::INT)"


SQL = {
    "report_records": f"WITH {_REPORT} SELECT report_id, file, patient_id, '' AS study_instance_uid, conclusion, description FROM r WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY file) = 1",
    "report_rejects": f"WITH {_REPORT} SELECT file, reason FROM r WHERE reason IS NOT NULL",
    "report_build_counts": f"WITH {_REPORT} SELECT count(DISTINCT report_id) FILTER (reason IS NULL) AS indexed, count(*) FILTER (reason IS NULL) - count(DISTINCT report_id) FILTER (reason IS NULL) AS duplicates, count(reason) AS bad FROM r",
    "report_scan": "SELECT 'n' || n_nationkey || '.xml' AS file, 'N' || n_nationkey AS report_id, n_name AS patient_id FROM nation WHERE n_nationkey % 6 <> 5",
    "image_headers": """WITH k AS (SELECT o_orderkey, o_orderkey % 8 AS kind, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE kind WHEN 0 THEN 'NOT_DICOM' WHEN 1 THEN 'UNSUPPORTED_TS' WHEN 2 THEN 'MISSING_REQUIRED' WHEN 3 THEN 'TRUNCATED' ELSE 'OK' END AS outcome, CASE WHEN kind > 3 THEN '1.2.' || o_orderkey END AS sop_instance_uid, CASE WHEN kind > 3 THEN '1.4.' || o_orderkey END AS series_instance_uid,
  CASE WHEN kind > 3 THEN 'P' || o_orderkey END AS patient_id, CASE WHEN kind > 3 THEN c_name END AS patient_name, CASE WHEN kind > 3 THEN (o_orderkey % 1000)::INT END AS instance_number, CASE WHEN kind > 3 THEN -1 END AS series_number, CASE WHEN kind > 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS study_date FROM k""",
    "image_scan": f"WITH f AS (SELECT n_nationkey, n_name, repeat('00', 128) || '4449434D' || {_hex('02001000', 'UI', "'1.2.840.10008.1.2.1'")} || {_hex('08001800', 'UI', "'1.2.' || n_nationkey")} || {_hex('08002000', 'DA', "'20240102'")} || {_hex('10001000', 'PN', 'n_name')} || {_hex('10002000', 'LO', "'P' || n_nationkey")} || {_hex('20000D00', 'UI', "'1.3.' || n_nationkey")} || {_hex('20000E00', 'UI', "'1.4.' || n_nationkey")} || {_hex('20001300', 'IS', "lpad((n_nationkey % 1000)::VARCHAR, 4, '0')")} || '{NESTED}{UNKNOWN}{PIXELS}' AS x FROM nation) SELECT n_nationkey, 'OK' AS outcome, n_name, (len(x) // 2)::BIGINT AS file_size, sha256(unhex(x)) AS sha256 FROM f",
    "import_next_replies": f"WITH {_TRY} SELECT path, decision, CASE WHEN crashed AND decision IN ('NEW', 'RESUME') THEN 500 WHEN decision = 'CONFLICT' THEN 409 WHEN decision = 'DUPLICATE' THEN 200 ELSE 201 END AS status FROM d WHERE later UNION ALL SELECT path, 'TRUNCATED', 400 FROM a WHERE bad AND later",
    "import_next_instances": f"""WITH {_TRY}, s AS (SELECT uid, any_value(sha0) AS sha256, CASE WHEN bool_or(decision IN ('NEW', 'RESUME') AND NOT crashed) THEN 'ARCHIVED' WHEN bool_or(decision = 'CONFLICT') THEN 'CONFLICT' ELSE 'PARSED' END AS status,
  max(event_id) FILTER (decision = 'NEW') AS file_size, any_value(user_id) AS user_id FROM d GROUP BY uid) SELECT uid AS sop_instance_uid, sha256, status, file_size, CASE WHEN status = 'ARCHIVED' THEN 's' || user_id || '/e' || uid || '/' || uid || '.dcm' END AS storage_path FROM s""",
    "import_next_patients": f"WITH {_TRY} SELECT 'p' || (user_id % 50) AS patient_id, arg_max(event_type, (later, path)) AS patient_name FROM d WHERE decision IN ('NEW', 'RESUME') GROUP BY ALL",
    "import_next_studies": f"WITH {_TRY} SELECT 's' || user_id AS study_instance_uid, 'p' || (user_id % 50) AS patient_id, strftime(arg_max(ts, (later, path)), '%Y-%m-%d') AS study_date FROM d WHERE decision IN ('NEW', 'RESUME') GROUP BY user_id",
    "import_next_series": f"WITH {_TRY} SELECT 'e' || uid AS series_instance_uid, 's' || any_value(user_id) AS study_instance_uid, arg_min(event_type, (later, path)) AS modality FROM d WHERE decision IN ('NEW', 'RESUME') GROUP BY uid",
    "instance_lookup": f"""WITH {_TRY} SELECT uid AS sop_instance_uid, 'e' || uid AS series_instance_uid, any_value(sha0) AS sha256, CASE WHEN bool_or(decision IN ('NEW', 'RESUME') AND NOT crashed) THEN 'ARCHIVED' WHEN bool_or(decision = 'CONFLICT') THEN 'CONFLICT' ELSE 'PARSED' END AS status,
  (max(event_id) FILTER (decision = 'NEW') % 9)::INT AS instance_number FROM d WHERE uid = '{INSTANCE}' GROUP BY uid""",
    "recent_backup_events": f"WITH {_ROUND} SELECT 't' || id AS task_id, 3 * id AS instance_id, CASE WHEN status = 'PENDING' AND id % 5 <> 2 AND id IN (SELECT id FROM due) THEN 'PUBLISHED' ELSE status END AS status, retry_count FROM o ORDER BY id DESC LIMIT 20",
    "import_next_events": f"WITH {_TRY} SELECT sha256(uid || '|' || path) AS task_id, uid, 'PENDING' AS status, 0 AS retry_count FROM d WHERE later AND decision IN ('NEW', 'RESUME') AND NOT crashed",
    "study_list": _STUDIES.format(where=""),
    "study_list_of_patient": _STUDIES.format(where=f"WHERE c_custkey = {CUSTOMER}"),
    "series_list": f"""WITH {_PARTS} SELECT (row_number() OVER (ORDER BY CASE WHEN n % 3 <> 0 THEN n END NULLS FIRST, uid))::INT AS place, uid AS series_instance_uid, l_returnflag AS modality, CASE WHEN n % 3 <> 0 THEN n ELSE -1 END AS series_number, n::BIGINT AS n_instances FROM i WHERE l_orderkey = {STUDY}""",
    "event_paths": "SELECT event_id, event_id * 2 AS instance_id, CASE WHEN o_orderkey IS NOT NULL THEN o_custkey || '/1/' || o_orderkey || '.dcm' END AS storage_path FROM events LEFT JOIN orders ON o_orderkey = event_id * 2",
    "dispatch_messages": f"""WITH {_ROUND} SELECT id, '{{"task_id":"t' || id || '","instance_id":' || 3 * id || '}}' AS value FROM due""",
    "dispatch_states": f"WITH {_ROUND} SELECT id, CASE WHEN status = 'PENDING' AND id % 5 <> 2 AND id IN (SELECT id FROM due) THEN 'PUBLISHED' ELSE status END AS status FROM o",
    "account_lookup": "SELECT event_id, 'Customer#' || lpad((user_id * 13)::VARCHAR, 9, '0') AS username, c_mktsegment AS role, c_mktsegment IS NOT NULL AS known FROM events LEFT JOIN customer ON c_name = 'Customer#' || lpad((user_id * 13)::VARCHAR, 9, '0')",
    "text_functions": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderstatus IN ('M', 'F', 'O') THEN o_orderstatus END AS sex, lpad(bin((18446744073709551616::HUGEINT - o_orderkey) % 18446744073709551616::HUGEINT), 64, '0') AS bits, o_orderkey AS back,
  ((18446744073709551616::HUGEINT - o_orderkey) % 18446744073709551616::HUGEINT)::VARCHAR AS unsigned, bit_count(xor(o_orderkey, o_custkey))::INT AS hamming, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '******' END AS masked, length(o_orderpriority)::INT AS trimmed, o_custkey || '/s/' || o_orderkey || '.dcm' AS path,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS child FROM orders""",
    "index_versions": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, 2 AS version, (SELECT count(*) FROM documents) AS documents FROM w WHERE strlen(term) > 1 GROUP BY term""",
}
