"""The report search service: build an index version from report files, answer queries and suggestions as JSON."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import Settings
from folioscan.functions.hashing import cache_key
from folioscan.functions.text import snippet, tokens
from folioscan.operators import impact, index, spell
from folioscan.sources import reports, store

FIELDS = {"conclusion": 2, "description": 1}


class ResultCache:
    """Least recently used entries, each for a time. Keys hold the index version, so a new version starts afresh."""

    def __init__(self, entries: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: OrderedDict[str, tuple[float, str]] = OrderedDict()

    def get(self, key: str) -> str | None:
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at >= self.seconds:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return value

    def put(self, key: str, value: str) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)


class SharedResults:
    """Answers that all instances of the service share: a file for each version and query under a folder, for a time.
    Whatever fails, the service answers without it."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.clock = spark, folder, seconds, clock

    def _path(self, key: str):
        return store._files(self.spark, f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}.json")

    def get(self, key: str) -> str | None:
        try:
            _, fs, path = self._path(key)
            if not fs.exists(path):
                return None
            file = fs.open(path)
            try:
                held = json.loads(bytes(file.readAllBytes()).decode())
            finally:
                file.close()
            return held["answer"] if held["key"] == key and self.clock() - held["at"] < self.seconds else None
        except (Py4JError, ValueError, KeyError, TypeError):  # unreachable, or half written by something else
            return None

    def put(self, key: str, value: str) -> None:
        """Written under a name of its own and renamed, so that no half answer is read; the last of several stays."""
        try:
            jvm, fs, path = self._path(key)
            staged = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid.uuid4().hex}")
            out = fs.create(staged, True)
            out.write(bytearray(json.dumps({"key": key, "at": self.clock(), "answer": value}).encode()))
            out.close()
            if not fs.rename(staged, path):  # a file system that does not rename onto a file
                fs.delete(path, False)
                fs.rename(staged, path)
        except Py4JError:
            pass


def build_index(spark: SparkSession, reports_dir: str, index_dir: str, words: index.Words | None = None) -> int:
    """Scan, parse, keep the first report of each id, weigh, normalise, publish; returns the new version. Terms and
    their signatures are published with it, for suggestions. words says how text is cut (`segment.words_by`)."""
    records, _ = reports.parse(reports.read_files(spark, reports_dir))
    unique = reports.unique_reports(records)
    weights = index.build(unique, FIELDS, id="report_id", words=words)
    terms = weights.select("term", F.col("df").alias("freq")).distinct()
    return store.publish(spark, index_dir, {"docs": unique, "blocks": impact.blocks(weights, id="report_id"), "variants": spell.variants(terms)})


def main(arguments: list[str] | None = None) -> int:
    """python -m folioscan.service --build-index [settings.ini]: builds the next version of the index."""
    import argparse

    parser = argparse.ArgumentParser()
    parser.add_argument("--build-index", action="store_true", required=True)
    parser.add_argument("settings", nargs="?")
    asked = parser.parse_args(arguments)
    settings = Settings.load(asked.settings)
    spark = SparkSession.builder.appName("folioscan").getOrCreate()
    print(json.dumps({"version": build_index(spark, settings.reports_dir, settings.index_dir)}))
    return 0


class SearchService:
    """Answers from the latest version, as found at the time of each query."""

    def __init__(self, spark: SparkSession, settings: Settings, archived: DataFrame | None = None, words: index.Words | None = None):
        """words must be what the index was built with."""
        self.spark, self.settings, self.archived, self.words = spark, settings, archived, words
        self.cache = ResultCache(settings.cache_entries, settings.cache_seconds)
        self.shared = SharedResults(spark, settings.shared_results, settings.cache_seconds) if settings.shared_results else None

    def _version(self) -> int:
        known = store.versions(self.spark, self.settings.index_dir)
        return known[-1] if known else 0

    def search(self, query: str) -> str:
        if not query:
            return json.dumps({"error": "empty query"})
        version = self._version()
        key = cache_key(version, query)
        if (known := self.cache.get(key)) is not None:
            return known
        of_index = f"{self.settings.index_dir}|{key}"
        if self.shared and (known := self.shared.get(of_index)) is not None:
            self.cache.put(key, known)
            return known
        docs, blocks = (store.load(self.spark, self.settings.index_dir, t, version) for t in ("docs", "blocks"))
        asked = self.spark.createDataFrame([(0, query)], "qid int, query string")
        hits = impact.search(blocks, asked, docs.count(), self.settings.top_k, id="report_id", words=self.words).join(docs, "report_id")
        text = F.concat_ws(" ", "conclusion", "description")
        cut = self.words or tokens
        said = [w for w in asked.select(cut(F.col("query")).alias("w")).first().w if len(w.encode()) > 1]
        first = F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in said), F.lit(query))

        def answered(hits: DataFrame) -> list[dict]:
            shown = hits.select("rank", "report_id", F.col("patient_name").alias("patient"), F.col("exam_date").alias("date"), "modality", F.round("score", 4).alias("score"), "has_image", snippet(text, first).alias("snippet"))
            return [{k: v for k, v in r.asDict().items() if k != "rank"} for r in shown.orderBy("rank").collect()]

        plain = hits.withColumn("has_image", F.lit(False))
        try:
            rows = answered(plain if self.archived is None else index.with_link_flag(hits, self.archived, "study_instance_uid"))
        except PySparkException:  # without the archive, reports are still found, without their images
            rows = answered(plain)
        out = json.dumps({"query": query, "version": version, "count": len(rows), "hits": rows}, ensure_ascii=False)
        self.cache.put(key, out)
        if self.shared:
            self.shared.put(of_index, out)
        return out

    def suggest(self, query: str) -> str:
        known = store.load(self.spark, self.settings.index_dir, "variants")
        asked = self.spark.createDataFrame([(query,)], "query string")
        rows = spell.nearest(asked, known, k=self.settings.suggestions).orderBy("rank").collect()
        return json.dumps({"query": query, "suggestions": [{"term": r.term, "distance": r.distance, "freq": r.freq} for r in rows]}, ensure_ascii=False)

    def answer(self, kind: int, payload: bytes) -> tuple[int, bytes]:
        """Reply to a frame: its type and payload."""
        if kind == 0x01:
            return 0x11, self.search(payload.decode()).encode()
        if kind == 0x02:
            return 0x12, self.suggest(payload.decode()).encode()
        return 0x7F, json.dumps({"error": "bad type"}).encode()


if __name__ == "__main__":
    raise SystemExit(main())
