"""A privacy budget that all callers share, and integer noise.

The ledger is a folder in shared storage: entry n holds what has been spent in all after n answers. An answer is paid for
by making entry n + 1, which only one caller can; who finds it made reads it and tries the next. So no two callers spend
the same remainder, whatever session they are in.
"""

from __future__ import annotations

import os
import secrets

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class PrivacyLedger:
    """Spends are entries of a folder that any session may open by its path; what would exceed the budget is refused."""

    def __init__(self, spark: SparkSession, path: str, epsilon: float):
        jvm = spark.sparkContext._jvm
        self.path_of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self.folder = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.folder)
        self.epsilon = epsilon

    def _entries(self) -> dict[int, float]:
        """Total after each entry: both are in the entry's name, so that an entry is whole as soon as it is there."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        return {int(n.split("-")[1]): float(n.split("-")[2]) for n in names if n.startswith("total-")}

    @property
    def left(self) -> float:
        entries = self._entries()
        return self.epsilon - (entries[max(entries)] if entries else 0.0)

    def spend(self, epsilon: float) -> float:
        if epsilon <= 0:
            raise ValueError("an answer costs more than 0")
        while True:
            entries = self._entries()
            n = max(entries, default=0)
            total = entries.get(n, 0.0) + epsilon
            if total > self.epsilon + 1e-12:
                raise ValueError(f"privacy budget exhausted: {self.epsilon - total + epsilon} left, {epsilon} asked")
            # The number is claimed first, by a name without the amount: making it fails where it is there already.
            if self._claim(f"claim-{n + 1}"):
                self.fs.create(self.path_of(f"total-{n + 1}-{total!r}"), False).close()
                return epsilon
            # Someone else has the number. If that caller dies before it writes its total, the claim stands for nothing
            # spent yet: nobody can go on, which errs on the side of refusing.
            if max(self._entries(), default=0) == n:
                raise ValueError("privacy ledger is being written by another caller; try again")

    def _claim(self, name: str) -> bool:
        """Make an empty file; False if it is there. Hadoop's local file system looks first and makes it then, which two callers may do at once."""
        if self.folder.toUri().getScheme() in (None, "file"):
            try:
                os.close(os.open(f"{self.folder.toUri().getPath()}/{name}", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(self.path_of(name), False).close()
        except Py4JJavaError:
            if self.fs.exists(self.path_of(name)):
                return False
            raise
        return True


def geometric(epsilon: float, seed: int | None = None) -> Column:
    """Two-sided geometric noise for a count: whole numbers, so that no low bits of a floating-point sum give the count away."""
    first, second = ((seed, seed + 1) if seed is not None else (secrets.randbits(62), secrets.randbits(62)))
    return sum_of_sides(epsilon, first) - sum_of_sides(epsilon, second)


def sum_of_sides(epsilon: float, seed: int) -> Column:
    """A geometric deviate: failures before the first success of probability 1 - exp(-epsilon)."""
    return F.floor(F.log(1 - F.rand(seed)) / (-epsilon)).cast("long")
