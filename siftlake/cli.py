"""Command line: scan, isolate, undo, receipts, evaluate, doctor."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.report import pixel_bound
from siftlake.operators.evaluate import confusion
from siftlake.operators.ranking import receipt_totals, receipts_to_prune, resolve_receipt
from siftlake.plans import actions as T
from siftlake.plans import scan as SC
from siftlake.shipping import ship
from siftlake.sources import inventory, stores
from siftlake.storage import settled


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siftlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def file_records(spark: SparkSession, roots: list[str], hidden: bool, exclusions: tuple[str, ...]) -> DataFrame:
    """Records of folders, with hashes where a size occurs again; codes of pictures need a decoder plug-in."""
    listed = inventory.records(inventory.listing(spark, roots, include_hidden=hidden, exclusions=exclusions), include_hidden=hidden, exclusions=exclusions)
    known = inventory.with_hashes(settled(listed, "listed"))
    missing = {name: kind for name, kind in (c.strip().split(" ", 1) for c in S.RECORD.split(", ")) if name not in known.columns}
    return known.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()})


def cmd_scan(a: argparse.Namespace) -> None:
    spark = session()
    roots, errors = inventory.checked_roots(a.roots)
    for e in errors:
        print(e, file=sys.stderr)
    records = file_records(spark, roots, a.include_hidden, tuple(a.exclude))
    bounds = {m: pixel_bound(a.low_resolution) for m in (S.IMAGE, S.GIF, S.VIDEO)} if a.low_resolution else {}
    members = SC.scan(records, SC.Options(similar_images=False, low_resolution=bounds, random_review=a.random_review, seed=a.seed, per_root=a.per_root))
    members.write.mode("overwrite").parquet(a.out)
    found = spark.read.parquet(a.out)
    if a.json:
        stores.save_result(a.json, roots, records.select(*(c.split()[0] for c in S.RECORD.split(", "))), found, errors)
    print(SC.scan_summary(found).select(F.to_json(F.struct("*"))).head()[0])


def cmd_isolate(a: argparse.Namespace) -> None:
    plan = T.isolate_plan(session().read.parquet(a.members), tuple(a.kinds), not a.plain_names, a.folder)
    rows = [(r["path"], r["destination"]) for r in plan.toLocalIterator()]
    for source, destination in rows:
        print(f"{source}\t{destination}\t{(T.place(source, destination, a.mode) or 'done') if a.execute else ''}".rstrip("\t"))
    if a.execute:
        for r in T.group_notes(plan, session().read.parquet(a.members)).toLocalIterator():
            stores.write_json(os.path.join(r["folder"], "_group.json"), json.loads(r["note"]))


def cmd_receipts(a: argparse.Namespace) -> None:
    found = stores.read_receipts(session(), a.folder.rstrip("/") + "/*.json")
    if a.action == "show":
        rows = resolve_receipt(found, a.reference).collect()
        if len(rows) != 1:
            sys.exit("no such receipt" if not rows else "several receipts match: " + ", ".join(r["id"] for r in rows))
        print(json.dumps(rows[0].asDict(recursive=True), default=str, indent=1))
    elif a.action == "prune":
        for r in receipts_to_prune(found.withColumn("started_at", F.col("started")), F.current_timestamp(), a.older_than_days, a.keep, a.drop_previews).collect():
            print(f"{r['id']}\t{r['reason']}")
    else:
        for r in stores.list_receipts(found, limit=a.limit).join(receipt_totals(found), "id").collect():
            print(f"{r['id']}\t{r['action']}\t{r['ok']} ok\t{r['failed']} failed\t{r['bytes']} bytes")


def cmd_undo(a: argparse.Namespace) -> None:
    spark = session()
    items = stores.read_receipts(spark, a.receipt).select(F.posexplode("items").alias("item_ord", "x")).select("item_ord", "x.*")


    there = [(p,) for r in items.select("path", "destination").collect() for p in r if p and os.path.exists(p)]
    plan = T.undo_plan(items, spark.createDataFrame(there, "path string"), dry_run=not a.execute).orderBy("step").collect()
    todo = [(r["source"], r["destination"]) for r in plan if r["error"] is None]
    done = T.execute_moves(todo) if a.execute else [(s, d, None) for s, d in todo]
    for r in [(r["source"], r["destination"], r["error"]) for r in plan if r["error"]] + done:
        print("\t".join(str(x) for x in r))


def cmd_evaluate(a: argparse.Namespace) -> None:
    spark = session()
    label = "similar" if a.kind == "pairs" else "has_person"
    keys = ["path_a", "path_b"] if a.kind == "pairs" else ["path"]
    truth = stores.load_manifest(spark, a.manifest, a.kind)
    predicted = spark.read.json(a.predictions).select(*keys, F.col(f"predicted_{label}").alias("predicted"))
    print(confusion(truth.join(predicted, keys, "left"), label, "predicted").select(F.to_json(F.struct("*"))).head()[0])


def cmd_doctor(_: argparse.Namespace) -> None:
    spark = session()
    print(f"spark {spark.version}, python {sys.version.split()[0]}, checkpoint folder {spark.conf.get('spark.checkpoint.dir', None) or 'not set'}")
    for module in ("pyarrow", "pandas", "numpy", "PIL", "cv2"):
        print(f"{module}: {'there' if importlib.util.find_spec(module) else 'not there'}")
    print(f"ffprobe: {shutil.which('ffprobe') or 'not there'}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftlake", description=__doc__)
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("scan")
    s.add_argument("roots", nargs="+")
    s.add_argument("--out", required=True)
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("--include-hidden", action="store_true")
    s.add_argument("--low-resolution", type=float, metavar="MEGAPIXELS")
    s.add_argument("--random-review", type=int, default=0)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--per-root", action="store_true")
    s.add_argument("--json", help="also write the whole result to this file")
    s.set_defaults(run=cmd_scan)
    s = sub.add_parser("isolate")
    s.add_argument("members")
    s.add_argument("--folder", required=True)
    s.add_argument("--kinds", nargs="+", default=list(S.KINDS), choices=S.KINDS)
    s.add_argument("--plain-names", action="store_true")
    s.add_argument("--mode", choices=T.MODES, default="copy")
    s.add_argument("--execute", action="store_true")
    s.set_defaults(run=cmd_isolate)
    s = sub.add_parser("receipts")
    s.add_argument("action", choices=("list", "show", "prune"))
    s.add_argument("folder")
    s.add_argument("reference", nargs="?", default="")
    s.add_argument("--limit", type=int, default=0)
    s.add_argument("--older-than-days", type=float)
    s.add_argument("--keep", type=int)
    s.add_argument("--drop-previews", action="store_true")
    s.set_defaults(run=cmd_receipts)
    s = sub.add_parser("undo")
    s.add_argument("receipt")
    s.add_argument("--execute", action="store_true")
    s.set_defaults(run=cmd_undo)
    s = sub.add_parser("evaluate")
    s.add_argument("kind", choices=("items", "pairs"))
    s.add_argument("manifest")
    s.add_argument("predictions")
    s.set_defaults(run=cmd_evaluate)
    s = sub.add_parser("doctor")
    s.set_defaults(run=cmd_doctor)
    a = p.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
