"""Configuration: validated once on the driver, small and frozen."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Root:
    page_id: str
    local_name: str = ""


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values: rate, concurrency, grace and limits."""

    vault: str
    managed: str
    roots: tuple[Root, ...] = ()
    requests_per_second: float = 2.5
    concurrency: int = 2
    grace_runs: int = 2
    most_trash_ratio: float = 0.2
    most_trash_count: int = 50
    download_external: bool = False
    largest_asset: int = 100 << 20
    log_level: str = field(default="info", compare=False)

    def problems(self) -> list[str]:
        """What is wrong with the settings; nothing may run with a non-empty list."""
        import posixpath

        clean = posixpath.normpath(self.managed)
        out = [f"duplicate root {p}" for p in sorted({r.page_id for r in self.roots if sum(x.page_id == r.page_id for x in self.roots) > 1})]
        if clean in ("/", posixpath.normpath(self.vault), posixpath.expanduser("~")):
            out.append("managed folder is unsafe")
        elif not clean.startswith(posixpath.normpath(self.vault) + "/"):
            out.append("managed folder is outside the vault")
        if not 0 < self.requests_per_second <= 3 or self.concurrency < 1 or self.grace_runs < 1 or not 0 <= self.most_trash_ratio <= 1:
            out.append("a limit is out of range")
        return out

    def digest(self) -> str:
        """Changes when a setting that shapes output does; the log level doesn't."""
        shaping = {k: v for k, v in asdict(self).items() if k not in ("log_level", "requests_per_second", "concurrency")}
        return hashlib.sha256(json.dumps(shaping, sort_keys=True).encode()).hexdigest()

    def root_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.page_id, r.local_name) for r in self.roots], "page_id string, local_name string")


def doctor(spark: SparkSession, settings: Settings, state: str) -> DataFrame:
    """``name, ok, detail`` of each check of the installation."""
    import sys

    from foliate.sources.tables import Snapshots

    problems = settings.problems()
    checks = [("python", sys.version_info >= (3, 10), sys.version.split()[0]), ("spark", spark.version >= "4", spark.version), ("settings", not problems, "; ".join(problems)), ("roots", bool(settings.roots), str(len(settings.roots)))]
    try:
        checks.append(("state", True, f"run {Snapshots(spark, state).latest() or 0}"))
    except Exception as e:  # noqa: BLE001 - a failing check is a finding
        checks.append(("state", False, str(e)[:200]))
    return spark.createDataFrame(checks, "name string, ok boolean, detail string")
