"""What can be plugged in: catalogs of machines and events, targets of snapshots, stores."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from quaymark.models.machines import DeclaredEvent, DeclaredState, Machine


@runtime_checkable
class MachineCatalog(Protocol):
    """The machines that are known, by type."""

    def machines(self) -> Mapping[str, Machine]: ...


@runtime_checkable
class EventCatalog(Protocol):
    """The events that are known, by name, and the keyed states, by class."""

    def events(self) -> Mapping[str, DeclaredEvent]: ...

    def states(self) -> Mapping[str, DeclaredState]: ...


@runtime_checkable
class SinkTarget(Protocol):
    """Where snapshots go: makes its tables, and takes batches of rows of one of them, each exactly once."""

    def prepare(self) -> None: ...

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None: ...


@runtime_checkable
class StateStoreProvider(Protocol):
    """Opens a store from settings."""

    def open(self, settings: Mapping[str, str]) -> object: ...


KINDS: dict[str, type] = {"machines": MachineCatalog, "events": EventCatalog, "sink": SinkTarget, "store": StateStoreProvider}
_FACTORIES: dict[tuple[str, str], Callable[..., object]] = {}


def register(kind: str, name: str, factory: Callable[..., object]) -> None:
    """A name may be taken once."""
    if kind not in KINDS:
        raise ValueError(f"no kind of provider: {kind}")
    if (kind, name) in _FACTORIES:
        raise ValueError(f"{kind} {name} is registered already")
    _FACTORIES[kind, name] = factory


def provider(kind: str, name: str, *args: object) -> object:
    """The provider of a name, made new; what it lacks of its kind is an error."""
    if (kind, name) not in _FACTORIES:
        known = ", ".join(sorted(n for k, n in _FACTORIES if k == kind)) or "none"
        raise KeyError(f"no {kind} {name}; known: {known}")
    made = _FACTORIES[kind, name](*args)
    if not isinstance(made, KINDS[kind]):
        raise TypeError(f"{kind} {name} is no {KINDS[kind].__name__}")
    return made
