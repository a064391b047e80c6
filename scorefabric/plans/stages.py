"""Stages of a run: named functions with dependencies, each materialised once under a versioned path and then read."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stages:
    spark: SparkSession
    root: str
    stages: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def stage(self, name: str, *needs: str):
        def add(fn):
            self.stages[name] = (fn, needs)
            return fn

        return add

    def order(self, wanted: list[str]) -> list[str]:
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"stages need each other: {(*above, name)}")
            if name not in out:
                for n in self.stages[name][1]:
                    visit(n, (*above, name))
                out.append(name)

        for w in wanted:
            visit(w, ())
        return out

    def path(self, name: str) -> str:
        """Changes with the code of the stage and of all it needs, so no stale result is read."""
        h = hashlib.sha256()
        for n in self.order([name]):
            h.update(n.encode() + inspect.getsource(self.stages[n][0]).encode())
        return f"{self.root}/{name}-{h.hexdigest()[:16]}"

    def done(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self, *wanted: str, slots: int = 1, retries: int = 0) -> dict[str, DataFrame]:
        """Results of all stages needed, `slots` stages at a time, each tried again up to `retries` times; a stage whose
        needs failed is not tried, others go on."""
        waiting = self.order(list(wanted))
        out: dict[str, DataFrame] = {}
        failed: dict[str, Exception] = {}

        def attempt(name: str) -> DataFrame:
            fn, needs = self.stages[name]
            for left in range(retries, -1, -1):
                try:
                    if not self.done(name):
                        fn(self.spark, *[out[x] for x in needs]).write.mode("overwrite").parquet(self.path(name))
                    return self.spark.read.parquet(self.path(name))
                except Exception:  # noqa: BLE001
                    if not left:
                        raise
            raise AssertionError("unreachable")

        with ThreadPoolExecutor(slots) as pool:
            running: dict = {}
            while waiting or running:
                for n in list(waiting):
                    needs = self.stages[n][1]
                    if any(x in failed for x in needs):
                        failed[n] = RuntimeError("a stage that it needs failed")
                        waiting.remove(n)
                    elif len(running) < slots and all(x in out for x in needs):
                        running[pool.submit(attempt, n)] = n
                        waiting.remove(n)
                for f in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                    n = running.pop(f)
                    if f.exception():
                        failed[n] = f.exception()
                    else:
                        out[n] = f.result()
        if failed:
            raise RuntimeError(f"stages failed: { {k: str(v)[:200] for k, v in failed.items()} }")
        return out
