"""The service and the import end to end, settings, and operations on ordered rows."""

import json

import pytest
from pyspark.sql import functions as F

from folioscan import archive, service
from folioscan.config import Settings
from folioscan.operators import sequences
from folioscan.sources import images, reports, select, store
from tests.test_sources import CASES, GOOD, image


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder, index = tmp_path_factory.mktemp("reports"), str(tmp_path_factory.mktemp("index") / "i")
    findings = ["肺结节 右肺 结节", "骨折 左臂", "肝囊肿 囊肿", "脑梗死"]
    for k in range(8):
        (folder / f"r{k}.xml").write_text(GOOD.format(f"R{k}", f"<description>{findings[k % 4]} 描述 {k}x</description>").replace("肺结节", findings[k % 4], 1).replace("1.2</study", f"1.{k}</study"))
    assert service.build_index(spark, str(folder), index) == 1
    return Settings(reports_dir=str(folder), index_dir=index)


def test_search(spark, built):
    archived = spark.createDataFrame([("1.0",), (None,)], "study_instance_uid string")
    s = service.SearchService(spark, built, archived)
    got = json.loads(s.search("肺结节"))
    assert got["version"] == 1 and {h["report_id"] for h in got["hits"]} == {"R0", "R4"} and got["count"] == 2
    assert {h["report_id"]: h["has_image"] for h in got["hits"]} == {"R0": True, "R4": False}
    assert all("肺结节" in h["snippet"] and h["score"] > 0 for h in got["hits"])
    assert s.search("肺结节") == s.search("肺结节") and len(s.cache.held) == 1
    assert json.loads(s.search("")) == {"error": "empty query"} and json.loads(s.search("无此词"))["count"] == 0
    assert json.loads(s.suggest("肺结"))["suggestions"][0]["term"] == "肺结节"
    kind, payload = s.answer(1, "骨折".encode())
    assert kind == 0x11 and json.loads(payload)["count"] == 2 and s.answer(2, "骨拆".encode())[0] == 0x12 and s.answer(9, b"")[0] == 0x7F
    service.build_index(spark, built.reports_dir, built.index_dir)
    assert json.loads(s.search("肺结节"))["version"] == 2


def test_postings_scan_is_filtered(spark, built):
    from folioscan.operators import impact

    hits = impact.search(store.load(spark, built.index_dir, "blocks"), spark.createDataFrame([(0, "骨折 肺结节")], "qid int, query string"), 8, 5, id="report_id")
    assert "In(term" in hits._jdf.queryExecution().toString() or "term IN" in hits._jdf.queryExecution().toString()


def test_cache():
    now = [0.0]
    c = service.ResultCache(2, 10, lambda: now[0])
    c.put("a", "1"), c.put("b", "2")
    assert c.get("a") == "1"
    c.put("c", "3")
    assert c.get("b") is None and c.get("a") == "1"
    now[0] = 10.0
    assert c.get("a") is None


def test_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("01", image()), ("02", image()), ("03", image(number=b"8")), ("04", CASES["truncated"][0])):
        (folder / f"{name}.dcm").write_bytes(data)
    tables = archive.import_batch(images.read_images(spark, str(folder)))
    assert {r.path[-6:-4]: (r.decision, r.status) for r in tables["replies"].collect()} == {"01": ("NEW", 201), "02": ("DUPLICATE", 200), "03": ("CONFLICT", 409), "04": ("TRUNCATED", 400)}
    assert archive.write_batch(spark, str(tmp_path / "out"), tables) == 1
    counts = {t: store.load(spark, str(tmp_path / "out"), t).count() for t in tables}
    assert counts == {"replies": 4, "patients": 1, "studies": 1, "series": 1, "instances": 1, "backup_events": 1}
    assert store.load(spark, str(tmp_path / "out"), "instances").first().storage_path == "1.2/1.2.9/1.2.3.dcm"


def test_settings(tmp_path):
    ini = tmp_path / "a.ini"
    ini.write_text("[folioscan]\ntop_k = 7\nindex_dir = there\n")
    got = Settings.load(str(ini), {"FOLIOSCAN_INDEX_DIR": "env"})
    assert (got.top_k, got.index_dir, got.suggestions) == (7, "env", 5)
    for bad in ({"FOLIOSCAN_TOP_K": "x"}, {"FOLIOSCAN_TOP_K": "0"}, {"FOLIOSCAN_INDEX_DIR": " "}):
        with pytest.raises(ValueError):
            Settings.load(None, bad)


def test_sequences(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    values = lambda d: [r.v for r in d.collect()]
    assert values(sequences.sorted_rows(df, "v")) == [1, 2, 3] and values(sequences.reversed_rows(df, "v")) == [3, 2, 1]
    assert values(sequences.merged(df, df, "v")) == [1, 1, 2, 2, 3, 3] and sorted(values(sequences.without(df, "v", 2))) == [1, 3]
    assert sorted(values(sequences.shuffled(df, "v", 4))) == [1, 2, 3] and values(sequences.shuffled(df, "v", 4)) == values(sequences.shuffled(df, "v", 4))
    moved = sequences.rotated(spark.range(5).select(F.col("id").alias("v"), F.col("id").alias("at")), "at", 2, 5).orderBy("at")
    assert values(moved) == [2, 3, 4, 0, 1]
    got = sequences.run_steps({"c": (["a", "b"], lambda a, b: a.union(b)), "a": ([], lambda: df), "b": (["a"], lambda a: a.limit(1))})
    assert got["c"].count() == 4


def test_select(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "x.json").write_text('{"a": 1, "b": {"c": "z"}}\n')
    assert [tuple(r) for r in select.select(spark, str(tmp_path / "x.csv"), "SELECT b FROM {source} WHERE a > 1").collect()] == [("y",)]
    assert select.select(spark, str(tmp_path / "x.json"), "SELECT b.c FROM {source}", "json").first()[0] == "z"


def test_unspaced_text_is_found(spark, tmp_path):
    """Build and search cut words by the same dictionary, so a word inside of unspaced text is found."""
    from folioscan.operators import segment

    words = segment.words_by(segment.Dictionary({"肺结节": 5, "结节": 8, "右肺": 6, "上叶": 6, "考虑": 9, "骨折": 5, "左臂": 4}))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, finding in enumerate(["右肺上叶结节影，考虑肺结节", "左臂骨折", "考虑骨折"]):
        (folder / f"r{k}.xml").write_text(GOOD.format(f"R{k}", "").replace("肺结节", finding))
    settings = Settings(reports_dir=str(folder), index_dir=str(tmp_path / "index"))
    service.build_index(spark, settings.reports_dir, settings.index_dir, words)
    s = service.SearchService(spark, settings, words=words)
    found = lambda q: [h["report_id"] for h in json.loads(s.search(q))["hits"]]
    assert found("肺结节") == ["R0"] and set(found("骨折")) == {"R1", "R2"} and found("右肺上叶") == ["R0"] and found("脑") == []
    assert {"term": "肺结节", "distance": 2, "freq": 1} in json.loads(s.suggest("肺节结"))["suggestions"]


def test_search_without_the_archive(spark, built):
    """If the archive cannot be read, reports are found all the same, without their images."""
    broken = spark.createDataFrame([("x",)], "study_instance_uid string").select(F.raise_error(F.lit("archive is down")).cast("string").alias("study_instance_uid"))
    got = json.loads(service.SearchService(spark, built, broken).search("骨折"))
    assert got["count"] == 2 and not any(h["has_image"] for h in got["hits"])


def test_files_are_stored_whole_or_not(spark, tmp_path):
    """In tasks: many files, a missing one, one that is there already, a path that leads out, nulls."""
    (tmp_path / "in").mkdir()
    for k in range(300):
        (tmp_path / f"in/{k}.dcm").write_bytes(b"%d" % k * 1000)
    root = tmp_path / "store"
    (root / "1/2").mkdir(parents=True)
    (root / "1/2/3.dcm").write_bytes(b"old")
    rows = [(str(tmp_path / f"in/{k}.dcm"), f"1/2/{k}.dcm") for k in range(300)] + [(f"file:{tmp_path}/in/7.dcm", "a/b.dcm"), (str(tmp_path / "missing.dcm"), "1/x.dcm"), (str(tmp_path / "in/1.dcm"), "../out.dcm"), (None, "1/y.dcm"), (str(tmp_path / "in/1.dcm"), None)]
    done = archive.store_files(spark.createDataFrame(rows, "source string, relative string").repartition(4), f"file:{root}").collect()
    assert {(r.source, r.relative) for r in done if not r.stored} == set(rows[-4:]) and len(done) == len(rows)
    assert all((root / f"1/2/{k}.dcm").read_bytes() == b"%d" % k * 1000 for k in range(300)) and (root / "a/b.dcm").read_bytes() == b"7" * 1000
    assert not list((root / ".staging").iterdir()) and not (tmp_path / "out.dcm").exists() and not (root / "1/x.dcm").exists()


def test_results_are_shared(spark, built, tmp_path):
    """A second instance answers from what the first has found; answers expire; a failing store is left out."""
    import dataclasses

    settings = dataclasses.replace(built, shared_results=str(tmp_path / "shared"))
    one, two = service.SearchService(spark, settings), service.SearchService(spark, settings)
    said = one.search("骨折")
    two._version = lambda: json.loads(said)["version"]
    key = f'{built.index_dir}|{service.cache_key(json.loads(said)["version"], "骨折")}'
    assert two.shared.get(key) == said
    blocks, service.impact.search = service.impact.search, None  # a search would fail now
    try:
        assert two.search("骨折") == said and len(two.cache.held) == 1
    finally:
        service.impact.search = blocks
    late = service.SharedResults(spark, settings.shared_results, 10, lambda: 1e12)
    assert late.get(key) is None
    (tmp_path / "file").write_text("x")
    broken = service.SearchService(spark, dataclasses.replace(built, shared_results=str(tmp_path / "file/under")))
    assert json.loads(broken.search("骨折"))["hits"] == json.loads(said)["hits"]
    for f in (tmp_path / "shared").glob("*.json"):
        f.write_text("{half")
    assert json.loads(service.SearchService(spark, settings).search("骨折"))["hits"] == json.loads(said)["hits"]


def test_build_from_the_command_line(spark, built, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("FOLIOSCAN_REPORTS_DIR", built.reports_dir)
    monkeypatch.setenv("FOLIOSCAN_INDEX_DIR", str(tmp_path / "i"))
    assert service.main(["--build-index"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"version": 1}
