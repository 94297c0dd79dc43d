"""Syntax trees of statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Path:
    """alias.property; in row scope a bare output name has no property."""

    alias: str
    prop: str


@dataclass(frozen=True)
class Name:
    """A bare name: an alias or, in row scope, an output."""

    name: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple
    otherwise: object | None


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: object | None  # Path, Name or None for *
    distinct: bool = False


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Item:
    expr: object
    name: str
    explicit: bool


@dataclass(frozen=True)
class NodePattern:
    alias: str
    type: str | None


@dataclass(frozen=True)
class EdgePattern:
    label: str | None
    out: bool


@dataclass(frozen=True)
class Pattern:
    nodes: tuple
    edges: tuple


@dataclass(frozen=True)
class OrderKey:
    expr: object
    descending: bool


@dataclass(frozen=True)
class Projection:
    items: tuple
    distinct: bool = False
    group: tuple = ()
    having: object | None = None
    where: object | None = None


@dataclass(frozen=True)
class SetItem:
    target: Path
    value: object


@dataclass(frozen=True)
class Create:
    alias: str
    type: str | None
    props: tuple
    into: Path
    on: str | None = None  # of MERGE


@dataclass
class Statement:
    matches: list = field(default_factory=list)
    optional: list = field(default_factory=list)
    where: object | None = None
    sets: list = field(default_factory=list)
    removes: list = field(default_factory=list)
    deletes: list = field(default_factory=list)
    creates: list = field(default_factory=list)
    merges: list = field(default_factory=list)
    with_: Projection | None = None
    returns: Projection | None = None
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None

    @property
    def updates(self) -> bool:
        return bool(self.sets or self.removes or self.deletes or self.creates or self.merges)


def walk(node):
    """The node and everything below it."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
