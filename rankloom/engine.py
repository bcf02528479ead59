"""The registries of functions in one place, for custom definitions and introspection."""

from __future__ import annotations

from rankloom.functions import scalar
from rankloom.operators import field_weighting, joins, summarize, weighting  # noqa: F401


def define_join(name: str, builder, describe: str = "") -> None:
    joins.define(name, describe)(builder)


def define_weighting(name: str, fn, roles: tuple = ("match",), **defaults) -> None:
    weighting.define(name, roles, **defaults)(fn)


def define_summarizer(name: str, fn, roles: tuple = (), **defaults) -> None:
    summarize.define(name, roles, **defaults)(fn)


def define_scalar(name: str, arity: int, fn) -> None:
    scalar.define(name, arity)(fn)


def functions() -> dict[str, list[str]]:
    return {"join": sorted(joins.REGISTRY), "weighting": sorted(weighting.REGISTRY), "summarizer": sorted(summarize.REGISTRY), "scalar": sorted({n for n, _ in scalar.FUNCTIONS})}


def describe(kind: str, name: str) -> dict:
    if kind == "join":
        return {"name": name.lower(), "doc": joins.REGISTRY[name.lower()][1]}
    return {"weighting": weighting, "summarizer": summarize}[kind].describe(name)
