"""The study protocol: a plan is fixed by its hash, rounds run in order, results are written once.

Entries are a table of (kind, number, digest, body) that is only appended to; everything it holds is small.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "kind string, number int, digest string, body string"


def digest(item) -> str:
    return hashlib.sha256(json.dumps(item, sort_keys=True, default=str, allow_nan=False).encode()).hexdigest()


class StudyLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(FIELDS).json(self.path)
        except Exception as error:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], FIELDS)

    def _find(self, kind: str, number: int = 0):
        return self.entries().where((F.col("kind") == kind) & (F.col("number") == number)).first()

    def _append(self, kind: str, number: int, body) -> str:
        row = [(kind, number, digest(body), json.dumps(body, sort_keys=True, default=str))]
        self.spark.createDataFrame(row, FIELDS).coalesce(1).write.mode("append").json(self.path)
        return row[0][2]

    def plan(self, body) -> str:
        """Fixes the plan, or checks that it is the one that was fixed."""
        if found := self._find("plan"):
            if found["digest"] != digest(body):
                raise ValueError("the plan has changed since it was fixed")
            return found["digest"]
        return self._append("plan", 0, body)

    def round(self, number: int, body) -> str:
        """Keeps a round's result; rounds follow each other from 1 and none is replaced."""
        if self._find("plan") is None:
            raise ValueError("there is no plan")
        if self._find("lock") is not None:
            raise ValueError("the selection is locked")
        if self._find("round", number) is not None:
            raise FileExistsError(f"round {number} has a result")
        if number > 1 and self._find("round", number - 1) is None:
            raise ValueError(f"round {number - 1} has no result")
        return self._append("round", number, body)

    def lock(self, rounds: int, body) -> str:
        if any(self._find("round", k) is None for k in range(1, rounds + 1)):
            raise ValueError("rounds are missing")
        if self._find("lock") is not None:
            raise FileExistsError("the selection is locked")
        return self._append("lock", 0, body)

    def finalize(self, body, selection) -> str:
        found = self._find("lock")
        if found is None or found["digest"] != digest(selection):
            raise ValueError("the selection is not the locked one")
        if self._find("final") is not None:
            raise FileExistsError("there is a final result")
        return self._append("final", 0, body)
