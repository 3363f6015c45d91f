"""Numbered states of a table in a folder: small JSON files, the one with the highest number counts.

A writer changes the state that it has read and puts the result in place as the next number. It claims
that number first, by creating a file that must not be there yet, so of two writers one gets it
and the other reads again and redoes its change; no change is lost. A state appears by a
rename, so readers see it whole or not at all.

Defined cases: no state is no table; a claim whose writer died is passed over after ``CLAIM_SECONDS``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

CLAIM_SECONDS = 600
TRIES = 50


class Conflict(OSError):
    """Another writer has put a state in place since this one was read."""


class States:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _listed(self) -> list:
        fs, p = self.fs(f"{self.root}/states")
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def names(self) -> list[str]:
        """Names of the states, newest first."""
        return sorted((n[: -len(".json")] for n, _ in self._listed() if n.startswith("v-") and n.endswith(".json")), reverse=True)

    def current(self) -> str | None:
        return next(iter(self.names()), None)

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/states/{name}.json", wholetext=True).first()[0])

    def _create(self, path: str) -> bool:
        """Whether this writer has created a file that was not there."""
        fs, p = self.fs(path)
        if p.toUri().getScheme() in (None, "file"):
            return self.spark._jvm.java.io.File(p.toUri().getPath()).createNewFile()
        from py4j.protocol import Py4JJavaError

        try:
            fs.create(p, False).close()
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        return True

    def commit(self, state: dict, base: str | None) -> str:
        """Put ``state`` in place after the state ``base``; Conflict if that is not the newest any more."""
        fs, folder = self.fs(f"{self.root}/states")
        fs.mkdirs(folder)
        if self.current() != base:
            raise Conflict(base)
        number = int(base[2:]) + 1 if base else 1
        listed = dict(self._listed())
        while (claimed := listed.get(f"v-{number:012d}.claim")) is not None and time.time() - claimed / 1000 > CLAIM_SECONDS:
            number += 1
        name = f"v-{number:012d}"
        if not self._create(f"{self.root}/states/{name}.claim"):
            raise Conflict(name)
        part = f"{self.root}/states/{uuid.uuid4().hex}.part"
        _, p = self.fs(part)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.current() != base or not fs.rename(p, self.fs(f"{self.root}/states/{name}.json")[1]):
            raise Conflict(name)
        return name

    def change(self, make: Callable[[dict | None], dict], undo: Callable[[dict], None] = lambda state: None) -> str:
        """Commit what ``make`` makes of the newest state, again from the start as long as another writer was first.

        ``undo`` gets a state that was not committed.
        """
        for k in range(TRIES):
            base = self.current()
            state = make(self.read(base) if base else None)
            try:
                return self.commit(state, base)
            except Conflict:
                undo(state)
                time.sleep(min(2.0, 0.05 * 2**k))
        raise Conflict(f"{self.root}: other writers were first {TRIES} times")

    def drop_old(self, keep: int, folders: Callable[[dict], set[str]]) -> None:
        """Delete the states beyond the newest ``keep``, their claims, and the folders that only they use."""
        names = self.names()
        kept = {d for n in names[:keep] for d in folders(self.read(n))}
        for n in names[keep:]:
            for folder in folders(self.read(n)) - kept:
                fs, p = self.fs(f"{self.root}/{folder}")
                fs.delete(p, True)
            for kind in ("json", "claim"):
                fs, p = self.fs(f"{self.root}/states/{n}.{kind}")
                fs.delete(p, False)
