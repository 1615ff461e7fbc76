"""The model language: classes, enums, associations, with stereotypes and tagged values.

One pass of a token expression, then a recursive reader. Constraints, derived properties, profiles
and functions are read over; their bodies aren't kept. Every error names file, line and column.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyarrow import fs


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Multiplicity:
    low: int
    high: int | None

    @property
    def many(self) -> bool:
        return self.high is None or self.high > 1

    @property
    def required(self) -> bool:
        return self.low > 0


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    multiplicity: Multiplicity
    default: str | None = None


@dataclass
class ModelClass:
    path: str
    properties: list[Property] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    stereotypes: list[str] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    imports: tuple[str, ...] = ()
    where: str = ""


@dataclass
class ModelEnum:
    path: str
    values: list[str]
    where: str = ""


@dataclass
class ModelAssociation:
    path: str
    ends: list[Property]
    imports: tuple[str, ...] = ()
    where: str = ""


@dataclass
class Model:
    classes: dict[str, ModelClass] = field(default_factory=dict)
    enums: dict[str, ModelEnum] = field(default_factory=dict)
    associations: dict[str, ModelAssociation] = field(default_factory=dict)

    def elements(self) -> dict:
        return {**self.classes, **self.enums, **self.associations}


_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^###\w+)|(?P<string>'(?:[^'\\]|\\.)*')|(?P<path>[A-Za-z_]\w*(?:::\w+)*(?:::\*)?)|(?P<number>-?\d+(?:\.\d+)?)|(?P<open><<)|(?P<close>>>)|(?P<arrow>->)|(?P<op>.)", re.S | re.M
)


class _Reader:
    def __init__(self, text: str, file: str) -> None:
        self.text, self.file = text, file
        self.tokens = [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.at = 0

    def place(self, at: int | None = None) -> str:
        i = self.at if at is None else at
        pos = self.tokens[i][2] if i < len(self.tokens) else len(self.text)
        return f"{self.file}:{self.text.count(chr(10), 0, pos) + 1}:{pos - self.text.rfind(chr(10), 0, pos)}"

    def fail(self, what: str) -> ModelError:
        return ModelError(f"{self.place()}: {what}")

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None, kind: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise self.fail(f"end of file, {want or kind} expected")
        k, t, _ = self.tokens[self.at]
        if (want is not None and t != want) or (kind is not None and k != kind):
            raise self.fail(f"{want or kind} expected, {t!r} found")
        self.at += 1
        return t

    def took(self, t: str) -> bool:
        if self.peek() == t:
            self.at += 1
            return True
        return False

    def skip_block(self, open_: str, close: str) -> None:
        self.take(open_)
        depth = 1
        while depth:
            t = self.take()
            depth += (t == open_) - (t == close)

    def name(self) -> str:
        t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "", 0)
        if t[0] == "string":
            self.at += 1
            return _unquoted(t[1])
        return self.take(kind="path")

    def model(self) -> Model:
        m = Model()
        imports: list[str] = []
        while self.at < len(self.tokens):
            where = self.place()
            word = self.take(kind="path")
            if word == "import":
                imports.append(self.take(kind="path").removesuffix("::*"))
                if self.took("::"):
                    self.take("*")
                self.take(";")
                continue
            stereotypes, tags = self.annotations()
            if word == "function":
                while self.peek() != "{":
                    self.take()
                self.skip_block("{", "}")
                continue
            path = self.take(kind="path")
            if path in m.elements():
                raise ModelError(f"{where}: {path} is declared twice")
            if word == "Class":
                parents = []
                if self.took("extends"):
                    parents.append(self.take(kind="path"))
                    while self.took(","):
                        parents.append(self.take(kind="path"))
                if self.peek() == "[":
                    self.skip_block("[", "]")
                m.classes[path] = ModelClass(path, self.properties(path), parents, stereotypes, tags, tuple(imports), where)
            elif word == "Enum":
                m.enums[path] = ModelEnum(path, self.values(path), where)
            elif word == "Association":
                ends = self.properties(path)
                if len(ends) != 2:
                    raise ModelError(f"{where}: association {path} needs two ends")
                m.associations[path] = ModelAssociation(path, ends, tuple(imports), where)
            elif word == "Profile":
                self.skip_block("{", "}")
            else:
                raise ModelError(f"{where}: unknown element {word!r}")
        return m

    def annotations(self) -> tuple[list[str], dict[str, str]]:
        stereotypes: list[str] = []
        tags: dict[str, str] = {}
        while True:
            if self.took("<<"):
                while not self.took(">>"):
                    p = self.take(kind="path")
                    self.take(".")
                    stereotypes.append(f"{p}.{self.take(kind='path')}")
                    self.took(",")
            elif self.peek() == "{" and self.at + 3 < len(self.tokens) and self.tokens[self.at + 2][1] == ".":
                self.take("{")
                while not self.took("}"):
                    p = self.take(kind="path")
                    self.take(".")
                    key = f"{p}.{self.take(kind='path')}"
                    self.take("=")
                    tags[key] = _unquoted(self.take(kind="string"))
                    self.took(",")
            else:
                return stereotypes, tags

    def values(self, path: str) -> list[str]:
        out: list[str] = []
        self.take("{")
        while not self.took("}"):
            self.annotations()
            v = self.name()
            if v in out:
                raise self.fail(f"{path} has {v} twice")
            out.append(v)
            self.took(",")
        return out

    def properties(self, path: str) -> list[Property]:
        out: list[Property] = []
        self.take("{")
        while not self.took("}"):
            self.annotations()
            if self.took("("):  # (shared), (composite)
                self.take(kind="path")
                self.take(")")
            name = self.name()
            if self.peek() == "(":  # derived: not stored
                self.skip_block("(", ")")
                self.skip_block("{", "}")
                self.take(":")
                self.take(kind="path")
                self.multiplicity()
                self.take(";")
                continue
            self.take(":")
            kind = self.take(kind="path")
            mult = self.multiplicity()
            default = None
            if self.took("="):
                parts = []
                while self.peek() not in (";", ""):
                    parts.append(self.take())
                default = "".join(parts)
            self.take(";")
            if any(p.name == name for p in out):
                raise self.fail(f"{path} has the property {name} twice")
            out.append(Property(name, kind, mult, default))
        return out

    def multiplicity(self) -> Multiplicity:
        self.take("[")
        text = ""
        while not self.took("]"):
            text += self.take()
        m = re.fullmatch(r"(\d+)|\*|(\d+)\.\.(\d+|\*)", text)
        if not m:
            raise self.fail(f"no multiplicity: [{text}]")
        if m.group(1):
            return Multiplicity(int(m.group(1)), int(m.group(1)))
        if text == "*":
            return Multiplicity(0, None)
        low, high = int(m.group(2)), None if m.group(3) == "*" else int(m.group(3))
        if high is not None and high < low:
            raise self.fail(f"no multiplicity: [{text}]")
        return Multiplicity(low, high)


def _unquoted(t: str) -> str:
    return re.sub(r"\\(.)", r"\1", t[1:-1])


def parse(text: str, file: str = "model") -> Model:
    return _Reader(text, file).model()


def merged(models: list[Model]) -> Model:
    """Several files as one model. An element that a later file repeats word for word is dropped; a differing one is an error."""
    out = Model()
    for m in models:
        for kind in ("classes", "enums", "associations"):
            mine, theirs = getattr(out, kind), getattr(m, kind)
            for path, e in theirs.items():
                if path in out.elements():
                    old = out.elements()[path]
                    bare = lambda x: {k: v for k, v in vars(x).items() if k not in ("where", "imports", "stereotypes", "tags")}
                    if type(old) is not type(e) or bare(old) != bare(e):
                        raise ModelError(f"{e.where}: {path} differs from the one at {old.where}")
                    continue
                mine[path] = e
    return out



def scanned(folders: Sequence[str], suffix: str = ".pure") -> Model:
    """The models of all files below the folders, in order of their paths, merged. A folder that isn't there, or has no such file, is an error."""
    models = []
    for folder in folders:
        where, root = (fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder)))
        found = where.get_file_info(fs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == fs.FileType.Directory else []
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))
        if not paths:
            raise ModelError(f"{folder}: no {suffix} file")
        for path in paths:
            with where.open_input_stream(path) as f:
                models.append(parse(f.read().decode(), path))
    return merged(models)


#: The built-in types. Fixed values.
PRIMITIVES = ("String", "Integer", "Float", "Decimal", "Boolean", "Date", "StrictDate", "DateTime", "Number")


class Resolved:
    """A model whose names are looked up: own package, imports, then a unique simple name."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._simple: dict[str, list[str]] = {}
        for path in [*model.classes, *model.enums]:
            self._simple.setdefault(path.rpartition("::")[2], []).append(path)
        for c in model.classes.values():
            self.lineage(c.path)
            for p in c.properties:
                self._check(p, self.lookup(p.type, c.path, c.imports, c.where), c.where)

    def lookup(self, name: str, inside: str, imports: tuple[str, ...], where: str) -> str:
        if name in PRIMITIVES:
            return name
        known = self.model.classes.keys() | self.model.enums.keys()
        package = inside.rpartition("::")[0]
        for candidate in (name, f"{package}::{name}" if package else name, *(f"{i}::{name}" for i in imports)):
            if candidate in known:
                return candidate
        found = self._simple.get(name, [])
        if len(found) == 1:
            return found[0]
        raise ModelError(f"{where}: {name} is {'ambiguous' if found else 'unknown'}")

    def lineage(self, path: str, seen: tuple[str, ...] = ()) -> list[str]:
        """The class and its ancestors, the farthest first."""
        if path in seen:
            raise ModelError(f"{self.model.classes[path].where}: {path} extends itself")
        c = self.model.classes[path]
        out: list[str] = []
        for p in c.parents:
            for a in self.lineage(self.lookup(p, path, c.imports, c.where), (*seen, path)):
                if a not in out:
                    out.append(a)
        return [*out, path]

    def properties(self, path: str) -> list[tuple[Property, str]]:
        """Own and inherited properties with their resolved types."""
        out: list[tuple[Property, str]] = []
        for a in self.lineage(path):
            c = self.model.classes[a]
            for p in c.properties:
                if any(q.name == p.name for q, _ in out):
                    raise ModelError(f"{c.where}: {p.name} is inherited already")
                out.append((p, self.lookup(p.type, a, c.imports, c.where)))
        return out

    def owned(self, path: str) -> list[tuple[Property, str]]:
        """Ends of associations that the class owns: the other end is to one, this one to many or declared second."""
        out = []
        line = set(self.lineage(path))
        for a in self.model.associations.values():
            kinds = [self.lookup(e.type, a.path, a.imports, a.where) for e in a.ends]
            for near, far in ((0, 1), (1, 0)):
                end, back = a.ends[far], a.ends[near]
                # The class at the to-one end owns what hangs at the to-many end; between two to-one ends the first owns.
                owns = not back.multiplicity.many and (end.multiplicity.many or far == 1)
                if kinds[near] in line and owns:
                    out.append((end, kinds[far]))
        return out

    def _check(self, p: Property, kind: str, where: str) -> None:
        d = p.default
        if d is None:
            return
        tests = {"Integer": r"-?\d+", "Float": r"-?\d+(\.\d+)?", "Decimal": r"-?\d+(\.\d+)?", "Number": r"-?\d+(\.\d+)?", "Boolean": "true|false", "String": r"'.*'"}
        if kind in self.model.enums:
            value = d.rpartition(".")[2]
            good = value in self.model.enums[kind].values
        else:
            good = kind not in tests or re.fullmatch(tests[kind], d, re.S) is not None
        if not good:
            raise ModelError(f"{where}: {d} is no {kind} for {p.name}")
