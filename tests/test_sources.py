"""Inventories, stores and streams on folders made here."""

import json
import os

from pyspark.sql import functions as F

from siftlake.functions.detectors import ensemble, presence, register, maker, sample_order
from siftlake.plans.actions import execute_moves
from siftlake.sources import inventory, stores
from siftlake.streaming.incremental import by_batch, recompute_changed


def fill(folder, names):
    for n in names:
        path = folder / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(n.encode())


def test_inventory_rules(spark, tmp_path):
    fill(tmp_path, ["a.jpg", "sub/B.JPEG", ".hidden/x.jpg", "sub/.y.png", "node_modules/z.jpg", "Lib.photoslibrary/q.jpg", "notes.txt", "v.mp4", "_keep.gif"])
    (tmp_path / "empty.png").write_bytes(b"")
    os.link(tmp_path / "a.jpg", tmp_path / "twin.jpg")
    os.symlink(tmp_path / "v.mp4", tmp_path / "link.mp4")
    listed = inventory.listing(spark, [str(tmp_path), str(tmp_path / "missing")])
    found = inventory.records(listed, exclusions=("*.mp4",))
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in found.collect()) == ["_keep.gif", "a.jpg", "empty.png", "sub/B.JPEG"]
    assert inventory.records(listed, images=False, gifs=False, videos=False).count() == 0
    assert inventory.records(listed, include_hidden=True, images=True).where("path LIKE '%hidden%'").count() == 1
    files = inventory.binary_files(spark, str(tmp_path), (".jpg", ".jpeg"))
    assert files.where("path LIKE '%a.jpg'").select("size").head()[0] == len("a.jpg")


def test_decision_and_session_stores(spark, tmp_path):
    path = str(tmp_path / "keep.json")
    assert stores.load_decisions(spark, path).count() == 0
    kept = spark.createDataFrame([("/a", 1, 2, "t"), ("/b", 3, 4, "t")], "path string, size bigint, mtime_ns bigint, decided_at string")
    stores.save_decisions(kept, path)
    assert sorted(tuple(r) for r in stores.load_decisions(spark, path).collect()) == sorted(tuple(r) for r in kept.collect())
    assert os.stat(path).st_mode & 0o777 == 0o600
    cleared = spark.createDataFrame([("/b",)], "path string")
    assert [r["path"] for r in stores.merged_decisions(kept, kept.where("path = '/a'"), cleared).collect()] == ["/a"]
    (tmp_path / "keep.json").write_text("{")
    assert stores.load_decisions(spark, path).count() == 0
    session = str(tmp_path / "session.json")
    assert stores.load_session(session) == (None, None)
    stores.save_session(session, {"groups": []})
    assert stores.load_session(session)[0]["result"] == {"groups": []}
    (tmp_path / "session.json").write_text("[1]")
    assert stores.load_session(session)[1] and os.path.exists(session)
    assert stores.discard_session(session) and not stores.discard_session(session)


def test_receipts(spark, tmp_path):
    item = {"path": "/a", "ok": True, "action": "quarantine", "destination": "/q/a", "size": 3}
    for k, dry in enumerate((True, False)):
        stores.write_receipt(str(tmp_path), {"dry_run": dry, "action": "quarantine", "session_id": f"{k}abcdefghij", "started_at": f"2024-01-0{k + 1}T00:00:00", "items": [item]}, f"s{k}")
    (tmp_path / "broken.json").write_text("{nope")
    found = stores.read_receipts(spark, str(tmp_path) + "/*.json")
    assert sorted(r["id"] for r in found.collect()) == ["action-s1-1abcdefg", "preview-s0-0abcdefg"]
    assert [r["id"] for r in stores.list_receipts(found, undoable_only=True).collect()] == ["action-s1-1abcdefg"]
    assert [r["dry_run"] for r in stores.list_receipts(found, limit=1).collect()] == [False]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"pairs": [{"path_a": "a.jpg", "path_b": "b.jpg", "similar": True}]}))
    assert stores.load_manifest(spark, str(tmp_path / "m.json"), "pairs").head()["path_a"] == str(tmp_path / "a.jpg")


def test_moves_do_not_overwrite(tmp_path):
    fill(tmp_path, ["a", "b", "q/b"])
    done = execute_moves([(str(tmp_path / "a"), str(tmp_path / "q/a")), (str(tmp_path / "b"), str(tmp_path / "q/b"))])
    assert [e is None for _, _, e in done] == [True, False] and (tmp_path / "b").exists()


def by_name(word):
    class ByName:
        def score(self, path):
            if "bad" in path:
                raise ValueError("cannot read")
            return 0.9 if word in path else 0.0

        def close(self):
            pass

    return ByName


def test_detectors_fail_closed_and_reuse(spark):
    register("names", ensemble(by_name("cat"), by_name("dog")))
    columns = "path string, human_detection_status string, human_detection_signature string, human_max_confidence double, error string"
    rows = [("/cat", None, None, None, None), ("/dog", None, None, None, None), ("/tree", None, None, None, None), ("/bad", None, None, None, None), ("/known", "person_confirmed", "old", 0.1, None)]
    got = {r["path"]: r["human_detection_status"] for r in presence(spark.createDataFrame(rows, columns), maker("names"), "names").collect()}
    assert got == {"/cat": "person_detected", "/dog": "person_detected", "/tree": "no_person_detected", "/bad": "analysis_failed", "/known": "person_confirmed"}
    assert sample_order(5) == [2, 0, 4, 1, 3] and sample_order(1) == [0]


def test_only_changed_records_are_computed_again(spark, tmp_path):
    columns = "path string, size bigint, mtime double, mtime_ns bigint, device bigint, inode bigint, media_type string, sha256 string"
    old = spark.createDataFrame([("/a", 1, 1.0, 1, 1, 1, "image", "A"), ("/b", 2, 1.0, 1, 1, 2, "image", "B")], columns)
    now = spark.createDataFrame([("/a", 1, 1.0, 1, 1, 1, "image", None), ("/b", 2, 1.0, 9, 1, 2, "image", None)], columns)
    done, cache = recompute_changed(now, old.withColumn("algorithm_version", F.lit("v1")), "v1", lambda df: df.withColumn("sha256", F.lit("new")))
    assert {r["path"]: r["sha256"] for r in done.collect()} == {"/a": "A", "/b": "new"}
    assert {r["path"]: r["sha256"] for r in cache.collect()} == {"/a": "A", "/b": "new"}
    now.write.parquet(str(tmp_path / "in"))
    seen = []
    q = by_batch(spark.readStream.schema(now.schema).parquet(str(tmp_path / "in")), lambda df, k: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sum(seen) == 2
