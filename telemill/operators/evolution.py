"""Private evolution that goes on where it was stopped.

A run lives in a folder: its parameters, and for each iteration the stages seed,
population, votes and selected. A stage counts once its record is there; the record
is written after the stage's rows, under a name of its own, and then renamed, so a
stopped run leaves whole stages or none. Rows without a record are not read.

The noise of an iteration follows from a secret seed that is recorded before the
votes are counted. Whatever is lost after that, a task, the driver or the rows, is
drawn again from the same seed and is the same noise: no vote is ever told twice
with different noise, and the budget is spent once. Votes without noise are never
written. Whoever can read the folder can take the noise away: keep it as secret as
the real rows, and `forget_seeds` once the run is done.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions import semantics as S
from . import evaluate as E
from . import synthesis as Y
from .ranks import running_counts

STAGES = ("seed", "population", "votes", "selected")


class RunFolder:
    """Records and rows of a run, in whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, parameters: dict, fresh: Callable[[int], str] = lambda iteration: S.fresh_seed()):
        self.spark, self.path, self.fresh = spark, path, fresh
        self.told = json.loads(json.dumps(parameters, sort_keys=True))
        before = self._read("parameters")
        if before is None:
            self._write("parameters", self.told)
        elif before != self.told:
            changed = sorted(k for k in {*before, *self.told} if before.get(k) != self.told.get(k))
            raise ValueError(f"{path} holds a run with other parameters: {', '.join(changed)}")

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, record: str) -> dict | None:
        fs, path = self._hadoop(f"{record}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, record: str, what: dict) -> None:
        """The record, whole or not at all; one that is there already stays."""
        fs, temporary = self._hadoop(f"_{record}-{uuid.uuid4().hex}")
        _, path = self._hadoop(f"{record}.json")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(temporary, path):
            fs.delete(temporary, False)

    def seed(self, iteration: int) -> str:
        """The secret seed of an iteration's noise: drawn and recorded when first asked for, the same ever after."""
        name = f"{iteration:04}-seed"
        if self._read(name) is None:
            self._write(name, {"iteration": iteration, "stage": "seed", "seed": self.fresh(iteration)})
        return self._read(name)["seed"]

    def stage(self, iteration: int, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows: read if it is recorded, else made, written and recorded."""
        record = f"{iteration:04}-{name}"
        known = self._read(record)
        if known is None:
            began, folder = time.time(), f"{record}-{uuid.uuid4().hex}"
            rows().write.parquet(f"{self.path}/{folder}")
            n = self.spark.read.parquet(f"{self.path}/{folder}").count()
            self._write(record, {"iteration": iteration, "stage": name, "folder": folder, "rows": n, "seconds": round(time.time() - began, 3)})
            known = self._read(record)
        return self.spark.read.parquet(f"{self.path}/{known['folder']}")

    def history(self) -> DataFrame:
        """iteration, stage, rows, seconds of what is recorded; of votes also the candidates that have any."""
        rows = []
        for k in range(self.told["rounds"]):
            for name in STAGES[1:]:
                if (r := self._read(f"{k:04}-{name}")) is not None:
                    some = self.spark.read.parquet(f"{self.path}/{r['folder']}").where("votes > 0").count() if name == "votes" else None
                    rows.append((k, name, r["rows"], r["seconds"], some))
        return self.spark.createDataFrame(rows, "iteration int, stage string, rows long, seconds double, with_votes long")

    def forget_seeds(self) -> None:
        """Deletes the seeds of iterations that are done: from then on nobody can take their noise away."""
        for k in range(self.told["rounds"]):
            fs, path = self._hadoop(f"{k:04}-seed.json")
            if self._read(f"{k:04}-selected") is not None and fs.exists(path):
                fs.delete(path, False)


def run(
    real: DataFrame,
    folder: RunFolder,
    first: Callable[[], DataFrame],
    vary: Callable[[DataFrame, int], DataFrame],
    numeric: list[str],
    categories: list[str],
) -> DataFrame:
    """The last selection, with guid. Parameters of the folder: n, rounds, epsilon, delta, and if wanted method (ranked or sampled), voters and key.

    first makes the candidates of the first iteration, vary those that are made of each selection; both without
    ids, which are given here. Voters, if told, are so many real rows by a fixed order of their key.
    """
    told = folder.told
    n, rounds = told["n"], told["rounds"]
    sigma = privacy.calibrate_sigma(told["epsilon"], told["delta"], rounds)
    voters = E.sample_exact(real, told.get("key", "guid"), told["voters"], "voters") if told.get("voters") else real
    numbered = lambda df: Y._numbered(df.drop("candidate_id"), "candidate_id")
    pool = folder.stage(0, "population", lambda: numbered(first()))
    chosen = pool
    for k in range(rounds):
        if k:
            parents = chosen
            pool = folder.stage(k, "population", lambda p=parents, k=k: numbered(p.drop("candidate_id").unionByName(vary(p, k - 1).drop("candidate_id"))))
        here = pool
        votes = folder.stage(k, "votes", lambda k=k, p=here: Y.noisy_votes(Y.device_votes(voters, p, numeric, categories), sigma, folder.seed(k)))
        chosen = folder.stage(k, "selected", lambda k=k, p=here, v=votes: _select(p, v, n, told.get("method", "ranked"), k))
    places = running_counts(chosen, "candidate_id").select(F.col("value").alias("candidate_id"), F.col("before").alias("__at"), F.col("n").alias("__n"))
    copies = chosen.select(*chosen.columns, F.monotonically_increasing_id().alias("__copy")) if told.get("method") == "sampled" else chosen.withColumn("__copy", F.lit(0))
    named = copies.join(places, "candidate_id").withColumn("guid", F.when(F.col("__n") == 1, F.format_string("pe_%07d", "__at")).otherwise(F.format_string("pe_%07d_%d", "__at", "__copy")))
    return named.drop("__at", "__n", "__copy")


def _select(pool: DataFrame, votes: DataFrame, n: int, method: str, iteration: int) -> DataFrame:
    if method == "ranked":
        return pool.join(Y.select_ranked(votes, n).select("candidate_id"), "candidate_id", "left_semi")
    if method == "sampled":
        # the draw is of what is released already, so its seed need not be secret
        return pool.join(Y.select_sampled(votes, n, f"select-{iteration}").select("candidate_id"), "candidate_id")
    raise ValueError(f"method {method}")


def spent_epsilon(folder: RunFolder) -> float:
    """The epsilon that the iterations recorded so far have cost."""
    told = folder.told
    drawn = sum(folder._read(f"{k:04}-votes") is not None for k in range(told["rounds"]))
    sigma = privacy.calibrate_sigma(told["epsilon"], told["delta"], told["rounds"])
    return privacy.compute_epsilon(sigma, told["delta"], drawn) if drawn else 0.0
