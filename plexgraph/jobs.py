"""Runs: phases and generators with a registry, stages with gates and a heartbeat, presets, caches with a time limit, providers."""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

State = dict[str, DataFrame]


class Phase(Protocol):
    """A step of a run: tables in, tables out."""

    name: str

    def run(self, state: State) -> State: ...


@dataclass(frozen=True)
class Step:
    """A phase of a function that maps the state to the tables it adds."""

    name: str
    function: Callable[[State], State]

    def run(self, state: State) -> State:
        return {**state, **self.function(state)}


def run_phases(phases: list[Phase], state: State, log: Callable[[str, float], None] | None = None) -> State:
    """All phases in order; each sees what those before it made. Planning only: tables are worked out when they are written."""
    names = [p.name for p in phases]
    if len(set(names)) != len(names):
        raise ValueError(f"phases of one name: {sorted(n for n in names if names.count(n) > 1)}")
    for p in phases:
        began = time.monotonic()
        state = p.run(state)
        if log:
            log(p.name, time.monotonic() - began)
    return state


@dataclass
class Generators:
    """Named sinks; a run writes those selected, less those skipped, each to a folder of its own."""

    known: dict[str, Callable[[State, str], None]] = field(default_factory=dict)

    def register(self, name: str, sink: Callable[[State, str], None]) -> None:
        self.known[name] = sink

    def chosen(self, select: list[str] | None = None, skip: list[str] | tuple[str, ...] = ()) -> list[str]:
        unknown = sorted({*(select or ()), *skip} - set(self.known))
        if unknown:
            raise ValueError(f"unknown generators: {', '.join(unknown)}")
        return [n for n in self.known if (select is None or n in select) and n not in skip]

    def run(self, state: State, folder: str, select: list[str] | None = None, skip: list[str] | tuple[str, ...] = ()) -> dict[str, str]:
        """Outcome by name; a sink that fails doesn't stop the others."""
        out = {}
        for name in self.chosen(select, skip):
            try:
                self.known[name](state, f"{folder}/{name}")
                out[name] = "written"
            except Exception as e:  # noqa: BLE001  reported by name
                out[name] = f"{type(e).__name__}: {e}"
        return out


@dataclass
class Factories:
    """Providers and stores by name; the default where none is asked for."""

    default: str
    known: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def register(self, name: str, make: Callable[..., Any]) -> None:
        self.known[name.lower()] = make

    def resolve(self, name: str | None = None) -> str:
        wanted = (name or self.default).lower()
        if wanted not in self.known:
            raise ValueError(f"unknown provider {wanted!r}; known: {', '.join(sorted(self.known))}")
        return wanted

    def create(self, name: str | None = None, **options) -> Any:
        return self.known[self.resolve(name)](**options)


@dataclass
class TimedCache:
    """At most ``size`` values for ``seconds`` each; the least recently used leaves first. ``clock`` can be replaced in tests."""

    seconds: float = 60.0
    size: int = 1000
    clock: Callable[[], float] = time.monotonic
    hits: int = 0
    misses: int = 0
    held: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key, make: Callable[[], Any]) -> Any:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value

    def expire(self) -> int:
        """Drops what is too old and says how much that was."""
        now = self.clock()
        old = [k for k, (t, _) in self.held.items() if now - t >= self.seconds]
        for k in old:
            del self.held[k]
        return len(old)


def index_gate(valid: bool | None, coverage: float | None = None, floor: float | None = None, strict: bool = False) -> tuple[str, str | None]:
    """(verdict, warning) before indexing: refused without a valid report, refused or warned about below the coverage floor."""
    if valid is None:
        raise ValueError("a validation result is required")
    if not valid:
        return "refused", "validation failed"
    if coverage is not None and floor is not None and coverage < floor:
        return ("refused" if strict else "warned"), f"header coverage {coverage}% is below {floor}%"
    return "open", None


def gate_rows(reports: DataFrame, floor: float, strict: bool = False) -> DataFrame:
    """``reports`` (valid, coverage, ...) with the gate's verdict, for many projects at once."""
    low = F.col("coverage") < floor
    verdict = F.when(~F.coalesce("valid", F.lit(False)), "refused").when(low, "refused" if strict else "warned").otherwise("open")
    return reports.withColumn("verdict", verdict)


#: Marks in a project's file list, languages to scan and folders to leave out.
PRESETS = {
    "typescript": (r"(^|/)tsconfig\.json$", ("ts", "tsx"), ("dist/",)),
    "react": (r"\.(tsx|jsx)$", ("ts", "tsx", "js", "jsx"), ("build/", "storybook-static/")),
    "next": (r"(^|/)next\.config\.[a-z]+$", ("ts", "tsx", "js", "jsx"), (".next/", "out/")),
    "vue": (r"\.vue$", ("vue", "ts", "js"), ("dist/",)),
    "python": (r"(^|/)(pyproject\.toml|setup\.py|requirements\.txt)$", ("py",), ("venv/", "__pycache__/")),
    "go": (r"(^|/)go\.mod$", ("go",), ("vendor/",)),
    "rust": (r"(^|/)Cargo\.toml$", ("rs",), ("target/",)),
    "java": (r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$", ("java",), ("target/", "build/")),
}


def detect_presets(files: DataFrame) -> list[str]:
    """Names of the presets whose marks stand among files (path); one row of flags comes back."""
    row = files.agg(*[F.max(F.col("path").rlike(mark)).alias(k) for k, (mark, _, _) in PRESETS.items()]).first()
    return [k for k in PRESETS if row[k]]


def merge_presets(names: list[str], languages: list[str] | tuple[str, ...] = (), ignores: list[str] | tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Languages and ignore rules of several presets and a user's own, each once, the presets' first."""
    unknown = [n for n in names if n not in PRESETS]
    if unknown:
        raise ValueError(f"unknown presets: {', '.join(unknown)}")
    out = {"languages": [x for n in names for x in PRESETS[n][1]] + list(languages), "ignores": [x for n in names for x in PRESETS[n][2]] + list(ignores)}
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


class Heartbeat:
    """What a run is doing: the last beat as JSON, replaced whole, and an event log that only grows, on any file system."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock, self.beats = spark, folder.rstrip("/"), clock, 0

    def event(self, kind: str, **details) -> None:
        row = [(float(self.clock()), kind, json.dumps(details, sort_keys=True))]
        self.spark.createDataFrame(row, "at double, kind string, details string").coalesce(1).write.mode("append").json(f"{self.folder}/events")

    def beat(self, status: str, **details) -> None:
        self.beats += 1
        row = [(float(self.clock()), status, self.beats, json.dumps(details, sort_keys=True))]
        self.spark.createDataFrame(row, "at double, status string, beats int, details string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/heartbeat")

    def last(self) -> DataFrame:
        return self.spark.read.schema("at double, status string, beats int, details string").json(f"{self.folder}/heartbeat")

    def events(self) -> DataFrame:
        return self.spark.read.schema("at double, kind string, details string").json(f"{self.folder}/events")

    def batch_sink(self, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch sink that beats and logs around another one."""

        def run(batch: DataFrame, number: int) -> None:
            self.event("batch", number=number)
            sink(batch, number)
            self.beat("idle", batch=number)

        return run


def staged(legs: list[tuple[str, Callable[[SparkSession, str], DataFrame]]], spark: SparkSession, folder: str, heartbeat: Heartbeat | None = None, resume: bool = True) -> dict[str, str]:
    """Legs in order, each written under ``folder`` before the next begins; a leg already whole is kept with ``resume``.

    Outcome by leg: kept, written, or failed with what it raised, and then nothing after it runs.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = {}
    for name, leg in legs:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"{name!r} is no folder name")
        done = hadoop.Path(f"{folder}/{name}/_SUCCESS")
        if resume and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            out[name] = "kept"
            continue
        try:
            leg(spark, folder).write.mode("overwrite").parquet(f"{folder}/{name}")
            out[name] = "written"
        except Exception as e:  # noqa: BLE001  reported by leg
            out[name] = f"failed: {type(e).__name__}"
        if heartbeat:
            heartbeat.event("leg", name=name, outcome=out[name])
        if out[name] not in ("written", "kept"):
            break
    return out
