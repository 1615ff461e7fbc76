"""State machines declared on classes: states, transitions, locks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quaymark.models.language import ModelClass, ModelError, Resolved

_STEP = re.compile(r"\s*(\w+)\s*-(\w+)->\s*(\w+)\s*(?::\s*([\w:]+))?\s*")


@dataclass(frozen=True)
class Edge:
    state: str
    event: str
    to: str
    payload: str | None


@dataclass
class Machine:
    type: str
    initial: str
    edges: list[Edge]
    terminals: set[str]
    locks: dict[str, list[str]] = field(default_factory=dict)
    status_property: str | None = None
    id_property: str | None = None
    cls: str = ""

    def target(self, state: str, event: str) -> str | None:
        return next((e.to for e in self.edges if e.state == state and e.event == event), None)

    def states(self) -> list[str]:
        out = [self.initial]
        for e in self.edges:
            out += [s for s in (e.state, e.to) if s not in out]
        return out


def _tag(c: ModelClass, name: str) -> str | None:
    return next((v for k, v in c.tags.items() if k.endswith(f"sm.{name}")), None)


def machine(resolved: Resolved, path: str) -> Machine:
    """The machine of a class whose tags declare one; checked: names, one edge per state and event, every state reachable, payload classes known."""
    c = resolved.model.classes[path]

    def wrong(what: str) -> ModelError:
        return ModelError(f"{c.where}: {path}: {what}")

    kind, initial, text = _tag(c, "type"), _tag(c, "initial"), _tag(c, "transitions")
    if not kind or not initial or not text:
        raise wrong("type, initial and transitions are needed")
    edges: list[Edge] = []
    for step in filter(str.strip, text.split(";")):
        m = _STEP.fullmatch(step)
        if not m:
            raise wrong(f"no transition: {step.strip()}")
        e = Edge(*m.groups())
        if any(x.state == e.state and x.event == e.event for x in edges):
            raise wrong(f"{e.event} leaves {e.state} twice")
        if e.payload:
            resolved.lookup(e.payload, path, c.imports, c.where)
        edges.append(e)
    seen, todo = {initial}, [initial]
    while todo:
        s = todo.pop()
        for e in edges:
            if e.state == s and e.to not in seen:
                seen.add(e.to)
                todo.append(e.to)
    lost = sorted({s for e in edges for s in (e.state, e.to)} - seen)
    if lost:
        raise wrong(f"never reached: {', '.join(lost)}")
    declared = {s.strip() for s in (_tag(c, "terminal") or "").split(",") if s.strip()}
    if declared - seen:
        raise wrong(f"no state: {', '.join(sorted(declared - seen))}")
    terminals = declared | {s for s in seen if not any(e.state == s for e in edges)}
    locks: dict[str, list[str]] = {}
    for part in filter(str.strip, (_tag(c, "locks") or "").split(";")):
        # the templates follow the first `: ` after the event names
        names, _, keys = part.partition(": ")
        for ev in (n.strip() for n in names.split(",")):
            if not any(e.event == ev for e in edges):
                raise wrong(f"no event: {ev}")
            locks[ev] = [k.strip() for k in keys.split(",") if k.strip()]
    props = {p.name for p, _ in resolved.properties(path)}
    for name in ("statusProperty", "idProperty"):
        if _tag(c, name) and _tag(c, name) not in props:
            raise wrong(f"no property: {_tag(c, name)}")
    return Machine(kind, initial, edges, terminals, locks, _tag(c, "statusProperty"), _tag(c, "idProperty"), path)


def machines(resolved: Resolved) -> dict[str, Machine]:
    """All declared machines by type."""
    out: dict[str, Machine] = {}
    for path, c in resolved.model.classes.items():
        if any(s.endswith("sm.root") for s in c.stereotypes):
            m = machine(resolved, path)
            if m.type in out:
                raise ModelError(f"{c.where}: {m.type} is declared by {out[m.type].cls} already")
            out[m.type] = m
    return out


_FITS = {
    "String": lambda v: isinstance(v, str), "Boolean": lambda v: isinstance(v, bool), "Integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    **dict.fromkeys(("Float", "Decimal", "Number"), lambda v: (isinstance(v, (int, float)) and not isinstance(v, bool)) or (isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", v) is not None)),
    **dict.fromkeys(("Date", "StrictDate", "DateTime"), lambda v: isinstance(v, str) and re.match(r"\d{4}-\d{2}-\d{2}", v) is not None),
}


def payload_errors(resolved: Resolved, path: str, payload: object, at: str = "") -> list[str]:
    """What of a payload doesn't fit its class: values missing, too many, or of another type, each with its place. Members the class doesn't have don't matter."""
    if not isinstance(payload, dict):
        return [f"{at or 'payload'}: no object"]
    out = []
    for p, kind in resolved.properties(path):
        here = f"{at}.{p.name}" if at else p.name
        value, m = payload.get(p.name), p.multiplicity
        many = m.many
        if many and value is not None and not isinstance(value, list):
            out.append(f"{here}: no list")
            continue
        values = (value or []) if many else [] if value is None else [value]
        if len(values) < m.low and p.default is None:
            out.append(f"{here}: missing")
        if m.high is not None and len(values) > m.high:
            out.append(f"{here}: more than {m.high}")
        for i, v in enumerate(values):
            place = f"{here}[{i}]" if many else here
            if kind in _FITS:
                if not _FITS[kind](v):
                    out.append(f"{place}: no {kind}")
            elif kind in resolved.model.enums:
                if v not in resolved.model.enums[kind].values:
                    out.append(f"{place}: no {kind}")
            else:
                out += payload_errors(resolved, kind, v, place)
    return out


#: Retries an event may declare at most. A fixed value.
MAX_RETRIES = 20


@dataclass(frozen=True)
class DeclaredEvent:
    """An event class: where it is handled, what it locks, what it may emit, what happens to its errors."""

    cls: str
    name: str
    domain: str
    locks: tuple[str, ...]
    emits: tuple[str, ...]
    on_error: str
    retries: int


@dataclass(frozen=True)
class DeclaredState:
    cls: str
    key: str


def declared_events(resolved: Resolved) -> tuple[dict[str, DeclaredEvent], dict[str, DeclaredState]]:
    """The events (by name) and keyed states (by class) of a model; checked: names, lock fields, emitted events, error policy, retries."""
    events: dict[str, DeclaredEvent] = {}
    states: dict[str, DeclaredState] = {}
    for path, c in resolved.model.classes.items():
        tag = lambda n: next((v for k, v in c.tags.items() if k.endswith(f"event.{n}")), None)  # noqa: B023, E731

        def wrong(what: str) -> ModelError:
            return ModelError(f"{c.where}: {path}: {what}")  # noqa: B023

        fields = {p.name for p, _ in resolved.properties(path)}

        def known(template: str) -> str:
            lost = set(re.findall(r"\{(\w+)\}", template)) - fields  # noqa: B023
            if lost:
                raise wrong(f"no field for {template}: {', '.join(sorted(lost))}")  # noqa: B023
            return template

        if any(s.endswith("event.state") for s in c.stereotypes):
            if not tag("key"):
                raise wrong("a key is needed")
            states[path] = DeclaredState(path, known(tag("key")))
        if not any(s.endswith("event.event") for s in c.stereotypes):
            continue
        name = tag("name") or path.rpartition("::")[2]
        if name in events:
            raise wrong(f"{name} is declared by {events[name].cls} already")
        if not tag("domain"):
            raise wrong("a domain is needed")
        retries = tag("retries") or "0"
        if not retries.isdigit() or int(retries) > MAX_RETRIES:
            raise wrong(f"retries from 0 to {MAX_RETRIES}: {retries}")
        policy = (tag("onError") or "park").lower()
        if policy not in ("park", "block"):
            raise wrong(f"no policy: {policy}")
        split = lambda t: tuple(x.strip() for x in (t or "").split(",") if x.strip())
        events[name] = DeclaredEvent(path, name, tag("domain"), tuple(map(known, split(tag("locks")))), split(tag("emits")), policy, int(retries))
    for e in events.values():
        for target in e.emits:
            if target not in events:
                raise ModelError(f"{resolved.model.classes[e.cls].where}: {e.name} emits {target}, which isn't declared")
    return events, states
