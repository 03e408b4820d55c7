"""Jobs for spark-submit: ``python -m ferrule.plans.jobs index --root STORE --config-path DUMP`` and the like. Each prints one JSON line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ferrule.plans import index
from ferrule.plans.profiles import profiles
from ferrule.plans.settings import Settings
from ferrule.plans.tools import TOOLS, Store
from ferrule.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferrule", description="Index source trees and query the index.")
    jobs = p.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("index", help="index the main root and its extensions")
    build.add_argument("--config-path", required=True)
    build.add_argument("--extension", action="append", default=[], help="root of an extension; may be given again")
    build.add_argument("--extensions-in", help="folder whose children are extensions")
    build.add_argument("--only", action="append", help="source_id to index; the others stay as they are")
    build.add_argument("--version", help="name of a build to go on with")
    build.add_argument("--clear", action="store_true", help="remove the index first")
    stage = jobs.add_parser("stage", help="write the graph in the exchange format")
    stage.add_argument("--staging", required=True)
    again = jobs.add_parser("rebuild", help="make the graph from staged files")
    again.add_argument("--staging", required=True)
    call = jobs.add_parser("call", help="run a tool")
    call.add_argument("tool", choices=sorted(TOOLS))
    call.add_argument("arguments", nargs="?", default="{}", help="JSON")
    for job in (build, stage, again, call, jobs.add_parser("restore", help="go back to the version before"), jobs.add_parser("clear", help="remove the index"), jobs.add_parser("stats", help="rows of each table")):
        job.add_argument("--root", required=True, help="folder of the index")
    listed = jobs.add_parser("profiles", help="list named indexes")
    listed.add_argument("--folder", required=True)
    listed.add_argument("--registry", default="")
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    """The result of a job; what is wrong with it under ``error``."""
    a = _parser().parse_args(argv)
    if a.job == "profiles":
        return {"profiles": [p.record() for p in profiles(a.folder, a.registry)]}
    if a.job == "index":
        info = files.dump_info(spark, a.config_path).first()
        if not info.valid:
            return {"error": f"no valid Configuration.xml in {a.config_path}" + (f": {info.error}" if info.error else "")}
        more = a.extension + (files.extension_roots(spark, a.extensions_in, a.config_path) if a.extensions_in else [])
        if a.clear:
            index.clear(spark, a.root)
        return index.build(spark, a.root, a.config_path, more, Settings.from_env(), only=a.only, version=a.version)
    if a.job == "rebuild":
        return index.rebuild(spark, a.staging, a.root)
    if a.job == "restore":
        return {"version": index.restore(spark, a.root)}
    if a.job == "clear":
        index.clear(spark, a.root)
        return {"cleared": a.root}
    store = Store.open(spark, a.root, settings=Settings.from_env())
    if a.job == "stage":
        return index.stage_csv(store.tables["nodes"], store.tables["edges"], a.staging)
    if a.job == "stats":
        return {r.collection: r.n for r in store.stats().collect()} | {f"graph_{r.part}_{r.kind or 'total'}": r.n for r in store.graph_stats().collect()}
    return json.loads(store.respond(a.tool, json.loads(a.arguments)))


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("ferrule").getOrCreate()
    out = run(spark, sys.argv[1:] if argv is None else argv)
    print(json.dumps(out, ensure_ascii=False))
    return int("error" in out)


if __name__ == "__main__":
    sys.exit(main())
