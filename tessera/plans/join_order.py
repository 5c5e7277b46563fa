"""A greedy left-deep join order for inner equi joins, from estimated sizes.

Relations are joined along the graph of their equi conditions: first the smallest filtered relation, then always the connected
relation with the smallest estimate, filtered ones first; parts of the graph that nothing connects are put together last, by the
smallest first, so a Cartesian product is delayed as long as it can be, and refused if what is to be put to the rest has more than
``PRODUCT_ROWS`` rows. Relations that are only compared by inequalities come
after the equi-joined ones. Estimates are Catalyst's ``sizeInBytes`` after filters, or given by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_enough

PRODUCT_ROWS = 1_000


@dataclass
class Relation:
    """A named input; ``filtered`` says that a filter was put on it, ``size`` its estimated bytes (or None to ask Catalyst)."""

    name: str
    df: DataFrame
    filtered: bool = False
    size: float | None = None

    def bytes(self) -> float:
        if self.size is None:
            self.size = float(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return self.size


@dataclass
class Condition:
    """A predicate between two relations; ``equi`` if it equates columns of both."""

    left: str
    right: str
    on: Column
    equi: bool = True


@dataclass
class Plan:
    """What was chosen: the order, and the conditions used at each step."""

    order: list[str] = field(default_factory=list)
    steps: list[list[Condition]] = field(default_factory=list)


def choose(relations: Sequence[Relation], conditions: Sequence[Condition]) -> Plan:
    """The join order."""
    by: Mapping[str, Relation] = {r.name: r for r in relations}
    rank = lambda n: (not by[n].filtered, by[n].bytes(), n)
    left = set(by)
    plan = Plan()
    used: set[int] = set()
    while left:
        joined = set(plan.order)
        equi = {n for n in left for c in conditions if c.equi and ((c.left == n and c.right in joined) or (c.right == n and c.left in joined))}
        theta = {n for n in left for c in conditions if not c.equi and ((c.left == n and c.right in joined) or (c.right == n and c.left in joined))}
        nxt = min(equi or ({n for n in left if _open(n, left - {n}, conditions)} if joined else set()) or theta or left, key=rank)
        plan.order.append(nxt)
        left.discard(nxt)
        joined.add(nxt)
        now = [k for k, c in enumerate(conditions) if k not in used and c.left in joined and c.right in joined]
        used.update(now)
        plan.steps.append([conditions[k] for k in now])
    return plan


def _open(name: str, others: set[str], conditions: Sequence[Condition]) -> bool:
    """Whether the relation starts another connected part of the graph (so that it is put together before the product)."""
    return any(c.equi and ((c.left == name and c.right in others) or (c.right == name and c.left in others)) for c in conditions)


def join(relations: Sequence[Relation], conditions: Sequence[Condition]) -> DataFrame:
    """The inner join of all relations in the chosen order. Columns of different relations must have different names."""
    by = {r.name: r.df for r in relations}
    plan = choose(relations, conditions)
    # Connected parts are joined by themselves; products of parts come last.
    parts: list[tuple[set[str], DataFrame]] = []
    later: list[Condition] = []
    for name, conds in zip(plan.order, plan.steps, strict=True):
        hit = [p for p in parts if any(c.equi and ({c.left, c.right} - {name}) <= p[0] for c in conds)]
        if not hit:
            parts.append(({name}, by[name]))
            later += conds
            continue
        names, df = hit[0]
        own = [c for c in conds if {c.left, c.right} - {name} <= names]
        later += [c for c in conds if c not in own]
        on = own[0].on
        for c in own[1:]:
            on = on & c.on
        parts[parts.index(hit[0])] = (names | {name}, df.join(by[name], on))
    names, out = parts[0]
    for more, df in parts[1:]:
        names = names | more
        own = [c for c in later if {c.left, c.right} <= names]
        later = [c for c in later if c not in own]
        if own:
            on = own[0].on
            for c in own[1:]:
                on = on & c.on
            out = out.join(df, on)
        else:
            if not small_enough(df, PRODUCT_ROWS):
                raise ValueError(f"nothing connects {sorted(names - more)} with {sorted(more)}, and those are no few rows")
            out = out.crossJoin(F.broadcast(df))
    return out
