"""Shapes as a table: targets, a path and constraints with parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quadlake.session import local_frame, metadata_rows
from quadlake.spec import RULES, SEVERITY
from quadlake.vocab import SH

# Components, by what they need.
VALUE_TESTS = (
    "datatype", "nodeKind", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive",
    "minLength", "maxLength", "pattern", "languageIn", "in", "sql",
)
NESTED = ("node", "property", "not", "and", "or", "xone")
COMPONENTS = VALUE_TESTS + NESTED + (
    "minCount", "maxCount", "class", "uniqueLang", "equals", "disjoint", "lessThan",
    "lessThanOrEquals", "qualified", "closed", "hasValue",
)
TARGET_KINDS = ("class", "node", "subjectsOf", "objectsOf", "implicit")

FRAME_SCHEMA = (
    "shape_id string, target_kind string, target string, path array<struct<op: string, iri: string>>, "
    "component string, params map<string,string>, severity string, message string, deactivated boolean"
)


class Step(NamedTuple):
    """One step of a path: op is '^' for inverse and '?', '+' or '*' for repeats.

    Alternatives are joined by '|' in ``iri``.
    """

    op: str
    iri: str

    @property
    def inverse(self) -> bool:
        return self.op.startswith("^")

    @property
    def repeat(self) -> str:
        return self.op.lstrip("^")

    @property
    def predicates(self) -> list[str]:
        return self.iri.split("|")


class Constraint(NamedTuple):
    component: str
    params: Mapping[str, str]


@dataclass(frozen=True)
class Shape:
    id: str
    constraints: tuple[Constraint, ...] = ()
    targets: tuple[tuple[str, str], ...] = ()
    path: tuple[Step, ...] = ()
    severity: str = SH + "Violation"
    message: str | None = None
    deactivated: bool = False

    @property
    def predicate(self) -> str | None:
        """The IRI of a path that is a single predicate."""
        if len(self.path) == 1 and self.path[0].op == "" and "|" not in self.path[0].iri:
            return self.path[0].iri
        return None

    @property
    def path_text(self) -> str | None:
        if not self.path:
            return None
        return self.predicate or "/".join(map(_step_text, self.path))


def _step_text(step: Step) -> str:
    text = "|".join(f"<{p}>" for p in step.predicates)
    if len(step.predicates) > 1:
        text = f"({text})"
    return ("^" if step.inverse else "") + text + step.repeat


def shape(id: str, *constraints: tuple, targets: Iterable[tuple[str, str]] = (),
          path: str | Iterable[tuple[str, str]] = (), **options) -> Shape:
    """A shape; constraints are (component, params) pairs, a text path is one predicate."""
    steps = (Step("", path),) if isinstance(path, str) else tuple(Step(*s) for s in path)
    made = Shape(id, tuple(Constraint(*c) for c in constraints), tuple(targets), steps, **options)
    _check(made)
    return made


def _check(s: Shape) -> None:
    for kind, _ in s.targets:
        if kind not in TARGET_KINDS:
            raise ValueError(f"{s.id}: unknown target {kind}")
    for c in s.constraints:
        if c.component not in COMPONENTS:
            raise ValueError(f"{s.id}: unknown component {c.component}")
    for step in s.path:
        if step.op not in ("", "^", "?", "+", "*", "^?", "^+", "^*"):
            raise ValueError(f"{s.id}: unknown path step {step.op}")


def to_frame(spark: SparkSession, shapes: Iterable[Shape]) -> DataFrame:
    """One row per shape, target and constraint."""
    rows = []
    for s in shapes:
        for kind, target in s.targets or ((None, None),):
            for c in s.constraints or (Constraint(None, {}),):
                steps = [{"op": step.op, "iri": step.iri} for step in s.path]
                rows.append((s.id, kind, target, steps, c.component, list(c.params.items()),
                             s.severity, s.message, s.deactivated))
    return local_frame(spark, rows, FRAME_SCHEMA)


def from_frame(df: DataFrame) -> list[Shape]:
    """Shapes of a table; its size is checked before it comes to the driver."""
    found: dict[str, dict] = {}
    for r in metadata_rows(df):
        s = found.setdefault(r.shape_id, {"row": r, "targets": {}, "constraints": {}})
        if r.target_kind is not None:
            s["targets"][(r.target_kind, r.target)] = None
        if r.component is not None:
            params = dict(sorted((r.params or {}).items()))
            s["constraints"][(r.component, tuple(params.items()))] = None
    shapes = []
    for id, s in sorted(found.items()):
        r = s["row"]
        constraints = [(c, dict(p)) for c, p in sorted(s["constraints"])]
        shapes.append(shape(
            id, *constraints, targets=sorted(s["targets"]), path=[(x.op, x.iri) for x in r.path or []],
            severity=r.severity, message=r.message, deactivated=bool(r.deactivated)))
    return shapes


def mandatory_shapes() -> list[Shape]:
    """A minCount 1 shape for each mandatory rule."""
    return [
        shape(f"urn:x:shape:{r.cls.rsplit('#', 1)[1]}:{r.property}", ("minCount", {"count": "1"}),
              targets=[("class", r.cls)], path=r.property, severity=SEVERITY[r.requirement])
        for r in RULES if r.requirement == "mandatory"
    ]
