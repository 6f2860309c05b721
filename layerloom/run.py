"""Building instances: a scenario and a seed become verified tables, once, and are found again by their identity.

An instance is a folder: scenario.json, raw/<table>, models/<model> (Parquet), record.json and, written last, SUCCESS.
It is built in a folder of its own and moved into place when all assertions hold, so a failed or interrupted build is
never taken for a result. Every model is written and read again before the next reads it: what may raise has raised.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession

import layerloom
from layerloom.errors import ParseError, SemanticError, StageError
from layerloom.files import Store
from layerloom.operators import checks, models
from layerloom.operators.preview import checksum
from layerloom.plans import ResolvedPlan, resolve
from layerloom.plans.resolved import reads
from layerloom.session import require
from layerloom.sources import parquet
from layerloom.sources.synthetic import synthesise
from layerloom.spec import document
from layerloom.spec import model as m

SIDE_BY_SIDE = 8
STAGES = ("parse", "resolve", "generate", "write", "load", "build", "test")


@dataclass
class Instance:
    """Where the tables of a built instance are, and its record."""

    path: str
    record: dict
    reused: bool = False

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        layer = "raw" if name in self.record["raw"] else "models"
        return spark.read.parquet(f"{self.path}/{layer}/{name}")


@dataclass
class _Progress:
    seconds: dict[str, float] = field(default_factory=dict)
    stage: str = "parse"

    @contextmanager
    def at(self, stage: str) -> Iterator[None]:
        self.stage, began = stage, time.monotonic()
        try:
            yield
        finally:
            self.seconds[stage] = round(self.seconds.get(stage, 0.0) + time.monotonic() - began, 3)


def identity(scenario: m.Scenario, seed: int) -> str:
    """The hash that instances are known by: the document's meaning, the seed and the versions that make the rows."""
    parts = {"scenario": document.content_hash(scenario), "seed": seed, "engine": layerloom.__version__, "spark": pyspark.__version__, "layout": 2}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def run_checks(plan: ResolvedPlan, tables: dict[str, DataFrame], names: set[str]) -> dict[str, int]:
    """Violations of all assertions whose tables are there and that end with one of names, by check name."""
    mine = [a for a in plan.assertions() if _last(a, plan) in names]
    found: dict[str, int] = {}

    def simple(assertions: list[m.Assertion]) -> None:
        found.update(checks.row_checks(assertions, tables))  # one pass over the table for all of them

    def other(assertion: m.Assertion) -> None:
        for key, rows in checks.violations(assertion, tables):
            found[key] = rows.count()

    single = [[a for a in mine if a.model == name and isinstance(a, checks.SINGLE_ROW)] for name in sorted(names)]
    _together([(simple, (s,)) for s in single if s] + [(other, (a,)) for a in mine if not isinstance(a, checks.SINGLE_ROW)])
    return found


def _together(calls: list[tuple[Callable, tuple]]) -> None:
    """Runs calls side by side, as Spark jobs of one session; the first failure in their order is raised."""
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        for done in [pool.submit(f, *args) for f, args in calls]:
            done.result()


def _last(a: m.Assertion, plan: ResolvedPlan) -> str:
    """The table of an assertion that is built last."""
    order = [*plan.raw, *plan.order]
    return max([a.model, *([a.to_model] if isinstance(a, m.References) else [])], key=order.index)


def _test(plan: ResolvedPlan, tables: dict[str, DataFrame], names: set[str], results: dict[str, int]) -> None:
    found = run_checks(plan, tables, names)
    results |= found
    if broken := {k: n for k, n in found.items() if n}:
        raise StageError("test", ", ".join(f"{k}: {n}" for k, n in sorted(broken.items())), tuple(sorted(broken)))


def build(spark: SparkSession, plan: ResolvedPlan, seed: int, path: str, progress: _Progress | None = None) -> dict:
    """Builds an instance at path and returns its record; raises StageError at the first stage that fails."""
    require(spark)
    store, progress = Store(spark), progress or _Progress()
    with progress.at("generate"):
        frames, counts = synthesise(spark, plan, seed)
    tables: dict[str, DataFrame] = {}
    results: dict[str, int] = {}
    rows: dict[str, int] = {}
    sums: dict[str, str] = {}

    def keep(name: str, layer: str, df: DataFrame, known: int | None = None) -> None:
        schema, at = plan.schemas[name], f"{path}/{layer}/{name}"
        with progress.at("write" if layer == "raw" else "build"):
            try:
                parquet.write(df, at, schema)
            except StageError:
                raise
            except Exception as e:  # Spark's own errors: a cast, an overflow, an unmapped value
                raise StageError("generate" if layer == "raw" else "build", f"{name}: {_first_line(e)}") from e
        with progress.at("load"):
            tables[name] = parquet.read(spark, at, schema)
            rows[name], sums[name] = checksum(tables[name])
            if known is not None and rows[name] != known:
                raise StageError("load", f"{name} has {rows[name]} rows, not {known}")

    def make(name: str) -> None:
        df, _ = models.build(plan.models[name], {x: (tables[x], plan.schemas[x]) for x in reads(plan.models[name])})
        keep(name, "models", df)

    # Tables of a wave don't read each other: they are built side by side, and all are tested before the next wave.
    _together([(keep, (name, "raw", df, counts[name])) for name, df in frames.items()])
    with progress.at("test"):
        _test(plan, tables, set(plan.raw), results)
    left = list(plan.order)
    while left:
        wave = [name for name in left if all(x in tables for x in reads(plan.models[name]))]
        _together([(make, (name,)) for name in wave])
        left = [name for name in left if name not in wave]
        with progress.at("test"):
            _test(plan, tables, set(wave), results)  # a model that fails is never read by others

    scenario = plan.scenario
    record = {
        "scenario_id": scenario.scenario_id, "seed": seed, "identity": identity(scenario, seed), "scenario_sha256": document.content_hash(scenario),
        "engine": layerloom.__version__, "spark": pyspark.__version__, "raw": {t: rows[t] for t in plan.raw}, "models": {x: rows[x] for x in plan.order},
        "checksums": sums, "checks": results, "seconds": progress.seconds,
    }
    store.write(f"{path}/scenario.json", document.canonical(scenario).decode())
    record["files"] = {f: n for f, n in store.files(path).items() if f != "record.json"}
    record["sha256"] = store.digests(path, list(record["files"]))
    store.write(f"{path}/record.json", json.dumps(record, indent=1, sort_keys=True))
    store.write(f"{path}/SUCCESS", record["identity"])
    return record


def _first_line(e: Exception) -> str:
    return str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__


def verified(store: Store, path: str, wanted: str) -> dict | None:
    """The record of a complete instance whose files are all there with their sizes and SHA-256; None otherwise."""
    if not store.exists(f"{path}/SUCCESS"):
        return None
    try:
        record = json.loads(store.read(f"{path}/record.json"))
        if store.read(f"{path}/SUCCESS") != wanted or record["identity"] != wanted:
            return None
        scenario = store.read(f"{path}/scenario.json").encode()
        found = store.files(path)
        whole = all(found.get(f) == n for f, n in record["files"].items())
        whole = whole and store.digests(path, list(record["files"])) == record["sha256"]
        return record if whole and hashlib.sha256(scenario).hexdigest() == record["scenario_sha256"] else None
    except (ValueError, KeyError):
        return None


def prepare(spark: SparkSession, plan: ResolvedPlan, seed: int, root: str, progress: _Progress | None = None) -> Instance:
    """The instance of a plan below root: found again, or built and put in place as a whole."""
    store, wanted = Store(spark), identity(plan.scenario, seed)
    final = f"{root}/instances/{wanted}"
    if record := verified(store, final, wanted):
        return Instance(final, record, reused=True)
    work = f"{root}/building/{wanted}-{uuid.uuid4().hex[:8]}"
    try:
        record = build(spark, plan, seed, work, progress)
        if store.exists(final) and verified(store, final, wanted) is None:
            store.delete(final)
        placed = store.rename(work, final)  # another build may have come first; its rows are the same
    finally:
        store.delete(work)
    return Instance(final, record if placed else verified(store, final, wanted) or record)


def prepare_json(spark: SparkSession, source: bytes | str, seed: int, root: str) -> Instance:
    """From a document to an instance. A failure leaves a record in root/failures and is raised as StageError."""
    progress, store, scenario_id = _Progress(), Store(spark), "unknown"
    try:
        with progress.at("parse"):
            scenario = document.parse(source)
            scenario_id = scenario.scenario_id
        with progress.at("resolve"):
            plan = resolve(scenario)
        return prepare(spark, plan, seed, root, progress)
    except (ParseError, SemanticError, StageError) as e:
        stage = e.stage if isinstance(e, StageError) else progress.stage
        details = e.details if isinstance(e, StageError) else e.codes if isinstance(e, SemanticError) else (e.code,)
        failure = {"scenario_id": scenario_id, "seed": seed, "stage": stage, "message": str(e), "details": list(details), "seconds": progress.seconds}
        store.write(f"{root}/failures/{scenario_id}-{seed}-{uuid.uuid4().hex[:8]}.json", json.dumps(failure, indent=1))
        raise e if isinstance(e, StageError) else StageError(stage, str(e), tuple(details)) from e
