"""Command line: list, open, seed, delete and schema.

    python -m layerloom list --root DIR
    python -m layerloom open SCENARIO.json [--seed N] --root DIR
    python -m layerloom seed SCENARIO_ID SEED --root DIR
    python -m layerloom delete IDENTITY --root DIR
    python -m layerloom schema [PATH]

SCENARIO may be a file, or the id of a bundled scenario.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from layerloom.errors import StageError
from layerloom.features import size_class
from layerloom.files import Store
from layerloom.operators.preview import preview
from layerloom.run import Instance, prepare_json
from layerloom.session import session
from layerloom.spec import document

BUNDLED = Path(__file__).parent / "scenarios"


def bundled() -> dict[str, Path]:
    """Bundled scenarios by id."""
    return {p.stem: p for p in sorted(BUNDLED.glob("*.json"))}


def load(scenario: str) -> bytes:
    path = bundled().get(scenario, Path(scenario))
    if not path.is_file():
        raise FileNotFoundError(f"no scenario {scenario}")
    return path.read_bytes()


def instances(store: Store, root: str) -> list[dict]:
    """Records of all complete instances below root, by scenario and seed."""
    out = []
    for name in store.folders(f"{root}/instances"):
        if store.exists(f"{root}/instances/{name}/SUCCESS"):
            out.append(json.loads(store.read(f"{root}/instances/{name}/record.json")))
    return sorted(out, key=lambda r: (r["scenario_id"], r["seed"]))


def summary(spark: SparkSession, instance: Instance) -> str:
    """Row counts, checks, and the first rows of each output."""
    r = instance.record
    scenario = document.parse(Store(spark).read(f"{instance.path}/scenario.json"))
    lines = [f"{r['scenario_id']}, seed {r['seed']}: {'found' if instance.reused else 'built'} ({size_class(max(r['raw'].values()))}), {len(r['checks'])} checks hold"]
    lines += [f"  {name}: {n} rows" for name, n in (r["raw"] | r["models"]).items()]
    for out in scenario.output_models:
        rows = preview(instance.table(spark, out.name), out.grain)
        widths = [max(len(row[k]) for row in rows) for k in range(len(rows[0]))]
        lines += ["", out.name, *("  " + "  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in rows)]
    return "\n".join(lines)


def same_document(store: Store, root: str, scenario_id: str) -> bytes:
    """The one document that instances of a scenario were built from, or the bundled one."""
    found = {r["scenario_sha256"]: r for r in instances(store, root) if r["scenario_id"] == scenario_id}
    if len(found) > 1:
        raise ValueError(f"{scenario_id} has instances of {len(found)} different documents")
    if found:
        return store.read(f"{root}/instances/{next(iter(found.values()))['identity']}/scenario.json").encode()
    return load(scenario_id)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="layerloom", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"list": (), "open": ("scenario",), "seed": ("scenario", "seed"), "delete": ("identity",), "schema": ()}.items():
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a, **({"type": int} if a == "seed" else {}))
        if name == "open":
            p.add_argument("--seed", type=int, default=0)
        if name == "schema":
            p.add_argument("path", nargs="?")
        else:
            p.add_argument("--root", default="layerloom-data")
    args = parser.parse_args(argv)
    if args.command == "schema":
        if args.path:
            document.export_json_schema(args.path)
        else:
            print(json.dumps(document.json_schema(), indent=2))
        return 0
    spark = spark or session()
    store = Store(spark)
    try:
        if args.command == "list":
            built = instances(store, args.root)
            for name in sorted({*bundled(), *(r["scenario_id"] for r in built)}):
                seeds = [str(r["seed"]) for r in built if r["scenario_id"] == name]
                print(f"{name}{' (seeds ' + ', '.join(seeds) + ')' if seeds else ''}")
        elif args.command == "delete":
            path = f"{args.root}/instances/{args.identity}"
            if "/" in args.identity or not store.exists(path):
                raise FileNotFoundError(f"no instance {args.identity}")
            store.delete(path)
        else:
            source = load(args.scenario) if args.command == "open" else same_document(store, args.root, args.scenario)
            print(summary(spark, prepare_json(spark, source, args.seed, args.root)))
    except (StageError, ValueError, OSError) as e:
        print(f"layerloom: {e}", file=sys.stderr)
        return 1
    return 0
