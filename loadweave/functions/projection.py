"""Projections and ellipsoids from well-known text, and the columns that project places with them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from . import expr

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z_0-9]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


@dataclass
class Node:
    """A keyword with its values and the nodes inside it."""

    name: str
    values: list[Any] = field(default_factory=list)
    inside: list[Node] = field(default_factory=list)

    def every(self, *names: str):
        """Nodes of these names at any depth, outermost first."""
        queue = [self]
        while queue:
            node = queue.pop(0)
            if node.name in names:
                yield node
            queue += node.inside

    def first(self, *names: str) -> Node | None:
        return next(self.every(*names), None)


def parse(text: str) -> Node:
    """The tree of nested KEYWORD["name", values, ...]; brackets may be square or round."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found or found.end() == at:
            raise ValueError(f"unreadable text at {at}: {text[at:at + 20]!r}")
        tokens.append(found)
        at = found.end()
    root, stack, last = None, [], None
    for token in tokens:
        quoted, word, number, mark = token.groups()
        if word is not None:
            last = Node(word.upper())
            if stack:
                stack[-1].inside.append(last)
            elif root is not None:
                raise ValueError("more than one keyword at the top")
            else:
                root = last
        elif mark and mark in "[(":
            if last is None:
                raise ValueError("a bracket without a keyword")
            stack.append(last)
            last = None
        elif mark and mark in "])":
            if not stack:
                raise ValueError("a bracket too many")
            stack.pop()
            last = None
        elif mark is None:
            if not stack:
                raise ValueError("a value outside of brackets")
            stack[-1].values.append(quoted.replace('""', '"') if quoted is not None else float(number))
    if root is None or stack:
        raise ValueError("brackets aren't closed")
    return root


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid, or places in degrees (``projected`` False), on an ellipsoid of axis a and flattening f."""

    projected: bool
    a: float
    f: float
    lat0: float = 0.0
    lon0: float = 0.0
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0

    def forward(self, lat, lon) -> tuple[Column, Column]:
        """(x, y) of places in degrees: easting and northing, or longitude and latitude."""
        if not self.projected:
            return expr._col(lon), expr._col(lat)
        return expr.tm_forward(lat, lon, self.lat0, self.lon0, self.k0, self.fe, self.fn, self.a, self.f)


#: Names of a parameter in different writings.
PARAMETERS = {"lat0": ("latitude of origin", "latitude of natural origin"), "lon0": ("central meridian", "longitude of center", "longitude of natural origin"), "k0": ("scale factor", "scale factor at natural origin"), "fe": ("false easting",), "fn": ("false northing",)}


def grid_of(text: str) -> Grid:
    """The grid that well-known text describes (both versions' keywords); another projection than transverse Mercator is an error.

    Lengths are in the unit of the projected system, angles in degrees; a parameter that isn't given takes 0, the scale 1.
    """
    root = parse(text)
    ellipsoid = root.first("SPHEROID", "ELLIPSOID")
    if ellipsoid is None or len(ellipsoid.values) < 3:
        raise ValueError("no ellipsoid")
    a, inverse = float(ellipsoid.values[1]), float(ellipsoid.values[2])
    f = 1 / inverse if inverse else 0.0
    method = root.first("PROJECTION", "METHOD")
    if root.first("PROJCS", "PROJCRS") is None or method is None:
        return Grid(False, a, f)
    kind = re.sub(r"[\s_]+", " ", str(method.values[0])).lower()
    if kind not in ("transverse mercator", "gauss kruger"):
        raise ValueError(f"{method.values[0]!r} isn't supported")
    given = {re.sub(r"[\s_]+", " ", str(p.values[0])).lower(): float(p.values[1]) for p in root.every("PARAMETER") if len(p.values) > 1}
    own = [n for n in (root.first("PROJCS", "PROJCRS").inside) if n.name in ("UNIT", "LENGTHUNIT") and len(n.values) > 1]
    metre = float(own[-1].values[1]) if own else 1.0
    found = {name: next((given[w] for w in ways if w in given), 1.0 if name == "k0" else 0.0) for name, ways in PARAMETERS.items()}
    return Grid(True, a / metre, f, **found)
