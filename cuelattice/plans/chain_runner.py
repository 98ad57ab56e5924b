"""User operators and the runner that applies a resolved chain of them, layer after layer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from cuelattice.session import materialize

Operator = Callable[..., DataFrame]

TYPES = {"float": float, "int": int, "bool": bool, "str": str}


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    default: Any
    lo: float | None = None
    hi: float | None = None
    choices: tuple[str, ...] = ()

    def coerce(self, value: Any) -> Any:
        if self.kind == "enum":
            if value not in self.choices:
                raise ValueError(f"{self.name}: {value!r} is not one of {', '.join(self.choices)}")
            return value
        if self.kind == "bool" and isinstance(value, str):
            return value.lower() in ("1", "true", "yes", "on")
        number = round(float(value)) if self.kind == "int" else value
        out = TYPES[self.kind](number)
        if self.kind in ("int", "float"):
            out = out if self.lo is None else max(out, TYPES[self.kind](self.lo))
            out = out if self.hi is None else min(out, TYPES[self.kind](self.hi))
        return out


@dataclass(frozen=True)
class Registered:
    op_id: str
    kind: str
    run: Operator
    params: tuple[Param, ...] = field(default=())


class Registry:
    """Operators by id. Registering an id twice is an error; every operator can be switched off."""

    def __init__(self) -> None:
        self._ops: dict[str, Registered] = {}

    def register(self, op_id: str, kind: str, *params: Param) -> Callable[[Operator], Operator]:
        def add(fn: Operator) -> Operator:
            if op_id in self._ops:
                raise ValueError(f"operator {op_id!r} is already registered")
            self._ops[op_id] = Registered(op_id, kind, fn, (Param("enabled", "bool", True), *params))
            return fn

        return add

    def get(self, op_id: str) -> Registered:
        if op_id not in self._ops:
            raise KeyError(f"unknown operator {op_id!r}")
        return self._ops[op_id]

    def resolve(self, op_id: str, given: dict[str, Any]) -> dict[str, Any]:
        known = {p.name: p for p in self.get(op_id).params}
        for name in given:
            if name not in known:
                raise ValueError(f"operator {op_id!r} has no parameter {name!r}")
        return {n: p.coerce(given.get(n, p.default)) for n, p in known.items()}

    def apply(self, df: DataFrame, chain: list[tuple[str, dict[str, Any]]]) -> DataFrame:
        """Fold the live steps of a chain over ``df``; an empty chain returns ``df`` itself."""
        for op_id, given in chain:
            values = self.resolve(op_id, given)
            if values.pop("enabled"):
                df = df.transform(self.get(op_id).run, **values)
        return df

    def apply_layers(self, df: DataFrame, layers: list[list[tuple[str, dict[str, Any]]]]) -> DataFrame:
        for chain in layers:
            df = self.apply(df, chain)
        return df

    def apply_jobs(self, df: DataFrame, steps: DataFrame, job: str, most: int = 256) -> DataFrame:
        """Every job's rows through the chain that its step rows (job, pos, op_id, params map of text) describe.

        Jobs with the same chain form one group, and each group is one composed transform of its rows; all its parameters are checked and typed before any
        row is read. Jobs without steps keep their rows. There are as many branches as different chains, which are a catalog's, not the data's: more than ``most`` is an error.
        """
        step = F.struct("pos", "op_id", F.array_sort(F.map_entries("params")).alias("params"))
        chains = steps.groupBy(job).agg(F.to_json(F.array_sort(F.collect_list(step))).alias("_chain"))
        chains = materialize(chains, "job-chains")
        found = [r[0] for r in chains.select("_chain").distinct().orderBy("_chain").limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} different chains")
        parsed = {c: [(s["op_id"], {e["key"]: e.get("value") for e in s["params"]}) for s in json.loads(c)] for c in found}
        for chain in parsed.values():
            for op_id, given in chain:
                self.resolve(op_id, given)
        out = df.join(chains.select(job), job, "left_anti")
        for text, chain in parsed.items():
            mine = df.join(chains.filter(F.col("_chain") == text).select(job), job, "left_semi")
            out = out.unionByName(self.apply(mine, chain).select(*df.columns))
        return out
