"""Bounded self-tuning: the registry of tunables, proposals, guards and rollback decisions. Control runs on the driver over small tables."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.scoring import SALIENCE
from sedimenta.operators.latest import latest_by


@dataclass(frozen=True)
class Tunable:
    worker: str
    name: str
    kind: str
    default: Any
    low: float
    high: float
    step: float


# The tunables with bounds and largest relative step.
TUNABLES = (
    Tunable("salience", "component_weights", "weights", SALIENCE, 0.0, 1.0, 0.2), Tunable("mode_switcher", "cen_threshold", "float", 8.0, 5.0, 12.0, 0.2), Tunable("mode_switcher", "dmn_threshold", "float", 4.0, 2.0, 6.0, 0.2),
    Tunable("surprise", "context_window", "int", 20, 10, 50, 0.3), Tunable("schema_evolver", "other_share_threshold", "float", 0.2, 0.05, 0.6, 0.2), Tunable("schema_evolver", "promote_min_entities", "int", 10, 3, 100, 0.3),
    Tunable("edge_confidence", "base_rate", "float", 0.7, 0.55, 0.85, 0.1), Tunable("edge_confidence", "corroboration_weight", "float", 0.8, 0.2, 2.0, 0.2), Tunable("belief", "auto_confirm_floor", "float", 0.75, 0.6, 0.9, 0.1),
    Tunable("entity_dedup", "kind_unify_floor", "float", 0.85, 0.75, 0.95, 0.05),
)


def find(worker: str, name: str) -> Tunable:
    return next(t for t in TUNABLES if (t.worker, t.name) == (worker, name))


def validate(t: Tunable, current: Any, proposed: Any, values: dict[str, Any] | None = None) -> None:
    """Raises ValueError unless the change keeps bounds, step, weights' sum and cen above dmn."""
    if t.kind == "weights":
        if set(proposed) != set(current):
            raise ValueError("other keys")
        if abs(sum(proposed.values()) - 1) > 0.01:
            raise ValueError("weights must sum to 1")
        pairs = [(current[k], proposed[k]) for k in current]
    else:
        if t.kind == "int" and int(proposed) != proposed:
            raise ValueError("a whole number is asked for")
        pairs = [(current, proposed)]
    for was, new in pairs:
        if not t.low <= new <= t.high:
            raise ValueError("out of bounds")
        if was and abs(new - was) / abs(was) > t.step + 1e-9:
            raise ValueError("too large a step")
    if t.worker == "mode_switcher" and values:
        both = {**values, t.name: proposed}
        if both.get("cen_threshold", 8.0) <= both.get("dmn_threshold", 4.0):
            raise ValueError("cen must be above dmn")


def propose(t: Tunable, current: Any, salt: str) -> Any:
    """A bounded step up or down; the direction follows a checksum, so reruns agree."""
    up = zlib.crc32(f"{t.worker}.{t.name}.{salt}".encode()) % 2 == 0
    if t.kind == "weights":
        keys = sorted(current)
        k = keys[zlib.crc32(salt.encode()) % len(keys)]
        other = keys[(keys.index(k) + 1) % len(keys)]
        d = min(current[k], current[other]) * t.step / 2 * (1 if up else -1)
        return {**current, k: current[k] + d, other: current[other] - d}
    new = min(t.high, max(t.low, current * (1 + t.step / 2 * (1 if up else -1))))
    return int(round(new)) if t.kind == "int" else new


def current_values(ledger: DataFrame) -> DataFrame:
    """(worker, tunable, new_value) of the latest promote or rollback."""
    return latest_by(ledger.where("kind IN ('promote', 'rollback')"), ["worker", "tunable"], ["recorded_at", "id"], ["new_value"])


def active_promotes(ledger: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Promotes younger than `days` with no later promote or rollback of the same tunable."""
    w = Window.partitionBy("worker", "tunable").orderBy("recorded_at", "id")
    rows = ledger.where("kind IN ('promote', 'rollback')").withColumn("_next", F.lead("id").over(w))
    return rows.where((F.col("kind") == "promote") & F.col("_next").isNull() & (F.col("recorded_at") > now - F.lit(days * 86400))).drop("_next")


def halted(ledger: DataFrame, now: Column, most: int = 3, days: int = 7) -> Column:
    return F.count_if((F.col("kind") == "rollback") & (F.col("recorded_at") >= now - F.lit(days * 86400))) > most


def rollback_reason(violations: Column, events: Column, before: Column, after: Column, least: int = 50, drop: float = 0.10) -> Column:
    """invariant, degraded or null; rates are null where there is no sample."""
    worse = (events >= least) & (before > 0) & ((before - after) / before >= drop)
    return F.when(violations > 0, "invariant").when(worse, "degraded")


def replay(events: DataFrame, score, current: dict, variant: dict, order: list[Column], n: int = 30, kind: str | None = None) -> DataFrame:
    """The newest n events under two settings, side by side; the limit comes before the filter by kind."""
    newest = events.orderBy(*order).limit(n)
    own = newest.where(F.col("kind") == kind) if kind else newest
    return own.withColumn("current", score(current)).withColumn("variant", score(variant))


def panel(votes: DataFrame, budget: int = 200_000) -> DataFrame:
    """votes (pair, seat, vote, tokens) -> (pair, winner): plurality of the votes cast before the token budget ran out."""
    spent = F.sum("tokens").over(Window.orderBy("pair", "seat").rowsBetween(Window.unboundedPreceding, 0))
    cast = votes.withColumn("_spent", spent).where(F.col("_spent") <= budget)
    n = lambda v: F.count_if(F.col("vote") == v)
    g = cast.groupBy("pair").agg(n("A").alias("a"), n("B").alias("b"), n("TIE").alias("t"))
    return g.select("pair", F.when((F.col("a") > F.col("b")) & (F.col("a") > F.col("t")), "A").when((F.col("b") > F.col("a")) & (F.col("b") > F.col("t")), "B").otherwise("TIE").alias("winner"))


def salience_guard(outputs: DataFrame) -> DataFrame:
    """Outputs (score, components) that break the range or don't have exactly the known components."""
    keys = F.array(*[F.lit(k) for k in sorted(SALIENCE)])
    exact = F.array_sort(F.map_keys("components")) == keys
    return outputs.where(~(F.col("score").between(0, 1) & exact) | F.col("score").isNull())
