"""Command line: init, ingest, status, run, stage and validate, with JSON on standard output."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from captionloom.plans import ledger
from captionloom.plans.config import ConfigError, load_config
from captionloom.plans.engine import Engine, StageBlocked, plan
from captionloom.sources.artifacts import Fingerprints, SensitiveDataError, Workspace


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="captionloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("init", "ingest", "status", "run", "stage", "validate"):
        c = commands.add_parser(name)
        c.add_argument("--config", required=True)
        c.add_argument("--job-id", required=True)
        if name == "ingest":
            c.add_argument("source")
        if name == "stage":
            c.add_argument("stage", choices=ledger.ALL_STAGES)
        if name == "run":
            c.add_argument("--stages", default="")
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--resume", action="store_true")
    return out


def act(args: argparse.Namespace, stages: dict | None = None) -> dict:
    """What a command answers. Stages that run need `stages`, the functions of an Engine."""
    config = load_config(args.config)
    if args.command == "init":
        Workspace.create(config.jobs_root, args.job_id)
        return {"job_id": args.job_id, "status": "initialized"}
    space = Workspace.create(config.jobs_root, args.job_id) if args.command == "ingest" else Workspace.open(config.jobs_root, args.job_id)
    if args.command == "ingest":
        receipt = space.ingest(args.source)
        space.write_json("source/discovery.json", receipt)
        return {"job_id": args.job_id, "status": receipt["status"], "sha256": receipt["sha256"]}
    names = {"stage": [getattr(args, "stage", "")], "validate": ["validate", "manifest"]}.get(args.command)
    if args.command == "run":
        names = plan(config.single, [s for s in args.stages.split(",") if s] or None)
        if args.dry_run:
            return {"job_id": args.job_id, "stages": names}
    from captionloom.session import build_session

    engine = _engine(build_session(), config, space, args.job_id, stages or {})
    if args.command == "status":
        found = [r.asDict() for r in engine.status().collect()]
        return {"job_id": args.job_id, "jobs": found}
    return {"job_id": args.job_id, "stages": engine.run(names, resume=getattr(args, "resume", False))}


def _engine(spark, config, space: Workspace, job_id: str, stages: dict) -> Engine:
    """An engine for one job's workspace, which knows the job's source if it was ingested."""
    from pyspark.sql import functions as F

    hashes = Fingerprints(spark, str(space.root / "logs" / "fingerprints"))

    def present(spark):
        # The ledger's own folder changes while it is looked at.
        folders = [str(p) for p in sorted(space.root.iterdir()) if p.is_dir() and p.name != "logs"]
        files = hashes.files(folders) if folders else spark.createDataFrame([], "path string, bytes long, sha256 string")
        path = F.regexp_replace(files["path"], "^file:/+", "/")
        return files.select(F.lit(job_id).alias("job_id"), F.substring(path, len(str(space.root)) + 2, 1 << 20).alias("path"), "sha256")

    jobs = spark.createDataFrame([(job_id,)], "job_id string")
    digest = hashlib.sha256(Path(config.path).read_bytes()).hexdigest()
    engine = Engine(spark, str(space.root / "logs"), stages, config.single, jobs, present, digest)
    if (space.root / "source" / "discovery.json").exists() and engine.records().filter("stage = 'acquire'").isEmpty():
        receipt = space.read_json("source/discovery.json")
        engine.acquired(spark.createDataFrame([(job_id, receipt["source_path"], receipt["bytes"], receipt["sha256"])], "job_id string, path string, bytes long, sha256 string"))
    return engine


def main(argv: list[str] | None = None, stages: dict | None = None) -> int:
    try:
        print(json.dumps(act(parser().parse_args(argv), stages), ensure_ascii=False))
        return 0
    except (ConfigError, SensitiveDataError) as e:
        error = {"error": type(e).__name__, "message": str(e)}
    except StageBlocked as e:
        error = {"error": e.code}
    except OSError:
        error = {"error": "LOCAL_IO_FAILURE"}  # the message would name a path
    print(json.dumps(error), file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())
