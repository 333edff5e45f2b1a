"""Command line: generate, update and scan."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sourceloom import __version__
from sourceloom.config import Config, load_config
from sourceloom.documents.provider import get_provider
from sourceloom.logs import configure_logging
from sourceloom.plans.runs import Runner
from sourceloom.session import local_session, scratch
from sourceloom.sources.worktree import is_work_tree


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="sourceloom", description="Structure of a Java repository, and documents from it.")
    main.add_argument("--version", action="version", version=f"sourceloom {__version__}")
    verbs = main.add_subparsers(dest="verb", required=True)
    helps = {
        "generate": "analyse everything and write all documents",
        "update": "analyse what changed and write the documents it affects",
        "scan": "print a structural report; no model is asked",
    }
    for verb, text in helps.items():
        p = verbs.add_parser(verb, help=text)
        p.add_argument("repository", type=Path)
        p.add_argument("--config", type=Path, help="YAML file over the defaults")
        p.add_argument("--language", action="append", help="analyse this language only (repeatable)")
        p.add_argument("--model", help="model name")
        p.add_argument("--host", help="model host")
        p.add_argument("--output-dir", help="folder of the documents, relative to the repository")
        p.add_argument("--log-level", help="DEBUG, INFO, WARNING or ERROR")
        if verb != "scan":
            p.add_argument("--force", action="store_true", help="write every document, changed or not")
            p.add_argument("--keep-graph", action="store_true", help="keep edges and calls beside the snapshot and change them by what was edited")
    return main


def config_of(args: argparse.Namespace) -> Config:
    model = {k: v for k, v in (("name", args.model), ("host", args.host)) if v}
    over = {"languages": args.language, "output_dir": args.output_dir, "model": model}
    over = {k: v for k, v in over.items() if v}
    if args.log_level:
        over["logging"] = {"level": args.log_level}
    return load_config(args.config, over)


def run(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None) -> int:
    args = parser().parse_args(argv)
    config = config_of(args)
    configure_logging(config.logging)
    root = args.repository.resolve()
    if not is_work_tree(root):
        print(f"Error: {root} is not inside a Git working tree", file=sys.stderr)
        return 1
    if args.verb != "scan":
        provider = provider or get_provider(config.model)
        if not provider.is_available():
            print(f"Error: model {config.model.name!r} is not available at {config.model.host}", file=sys.stderr)
            return 1
    spark = spark or local_session()
    runner = Runner(spark, root, config, provider, keep_graph=getattr(args, "keep_graph", False))
    with scratch(spark):
        if args.verb == "scan":
            for line in runner.report():
                print(line)
            return 0
        summary = runner.full(args.force) if args.verb == "generate" else runner.update(args.force)
    print(f"Mode: {summary.mode}")
    print(
        f"Files scanned: {summary.files_scanned}  parsed: {summary.files_parsed}  "
        f"removed: {summary.files_removed}  reused: {summary.files_reused}"
    )
    if summary.message:
        print(summary.message)
    for r in summary.doc_results:
        print(f"  [{'written' if r.written else 'skipped'}] {r.filename} ({r.reason})")
    if any(r.written for r in summary.doc_results):
        print(f"Documents are in {root / config.output_dir}")
    return 0


if __name__ == "__main__":
    sys.exit(run())
