"""Review state, header sizes and the command line."""

import json
import struct

import pytest

from siftlake import cli
from siftlake.plans.review import Previews, Stale, Versioned, cancellable, manifest, progress
from siftlake.sources.dimensions import dimensions, with_dimensions


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h)


def test_header_sizes(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 30, 40) + b"\0" * 9
    assert dimensions(png(7, 9)) == (7, 9) and dimensions(jpeg) == (40, 30)
    assert dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert dimensions(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    far = b"\xff\xd8" + 40 * (b"\xff\xe1" + struct.pack(">H", 60_000) + b"x" * 59_998) + jpeg[2:]
    assert len(far) > 2_000_000 and dimensions(far) == (40, 30)
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        entries = struct.pack(order + "HHIHH", 256, 3, 1, 31, 0) + struct.pack(order + "HHII", 257, 4, 1, 17)
        assert dimensions(mark + struct.pack(order + "I", 5000) + b"\0" * 4992 + struct.pack(order + "H", 2) + entries) == (31, 17)
    meta = b"\0" * 4 + b"".join(struct.pack(">I", 20) + b"ispe" + struct.pack(">III", 0, w, h) for w, h in ((320, 240), (4000, 3000)))
    assert dimensions(struct.pack(">I", 16) + b"ftypheic" + b"\0" * 4 + struct.pack(">I", len(meta) + 8) + b"meta" + meta) == (4000, 3000)
    assert dimensions(b"") is None and dimensions(b"\x89PNG\r\n\x1a\n") is None
    (tmp_path / "a.png").write_bytes(png(7, 9))
    rows = [(str(tmp_path / "a.png"), None, None, None), (str(tmp_path / "gone.png"), None, 1, None), ("/kept", 2, 2, None)]
    got = {r["path"].split("/")[-1]: (r["width"], r["height"], r["error"] is None) for r in with_dimensions(spark.createDataFrame(rows, "path string, width int, height int, error string")).collect()}
    assert got == {"a.png": (7, 9, True), "gone.png": (None, 1, False), "kept": (2, 2, True)}


def test_previews_are_used_once_and_expire():
    now = [0.0]
    p = Previews(10, lambda: now[0])
    a, b, c = p.issue("x"), p.issue("x"), p.issue("x")
    assert (p.redeem(a, "x"), p.redeem(a, "x"), p.redeem(b, "y")) == ("valid", "missing", "changed")
    now[0] = 11
    assert p.redeem(c, "x") == "expired"


def test_versions_and_manifests(spark):
    plan = spark.createDataFrame([("/a", "trash", 1), ("/b", "trash", 2)], "path string, action string, size bigint")
    assert manifest(plan) == manifest(plan.orderBy("size", ascending=False)) != manifest(plan.limit(1))
    v = Versioned(plan)
    assert v.change(0, lambda m: m.limit(1)) == 1 and v.members.count() == 1
    with pytest.raises(Stale):
        v.change(0, lambda m: m)
    seen = []
    with cancellable(spark, "tag"), progress(spark, lambda a, b: seen.append((a, b)), 0.01):
        assert "tag" in spark.getTags()
        spark.range(1000).repartition(3).count()


def test_scan_and_isolate_from_the_command_line(spark, tmp_path, capsys):
    for name, body in (("a.jpg", b"same"), ("b.jpg", b"same"), ("c.jpg", b"other")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    cli.main(["scan", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["exact_groups"] == 1
    cli.main(["isolate", str(tmp_path / "out"), "--folder", str(tmp_path / "review"), "--execute"])
    copied = sorted(p.name for p in (tmp_path / "review").rglob("*.jpg"))
    assert copied in (["KEEP__a.jpg", "b.jpg"], ["KEEP__b.jpg", "a.jpg"])
    cli.main(["doctor"])
    assert "spark" in capsys.readouterr().out
