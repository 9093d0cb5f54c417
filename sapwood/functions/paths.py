"""Selectors (which scopes of a document) and paths (where one scope is), as plan-time values and columns.

A path column is array<struct<key string, idx int>>: a member step has a key, an element step an index.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_TYPE = "array<struct<key: string, idx: int>>"
EACH_INDEX, EACH_MEMBER = {"each": "index"}, {"each": "member"}
_PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def _quoted(key: str) -> str:
    return key if re.match(_PLAIN_KEY, key) else json.dumps(key, ensure_ascii=False)


@dataclass(frozen=True)
class Selector:
    """Steps from the root: a member name, an element number, every element or every member."""

    steps: tuple = ()

    @classmethod
    def of(cls, *steps) -> Selector:
        """From names, numbers, EACH_INDEX and EACH_MEMBER, in any mix."""
        return cls(tuple(("each", s["each"]) if isinstance(s, dict) else s for s in steps))

    def member(self, name: str) -> Selector:
        return Selector((*self.steps, name))

    def index(self, n: int) -> Selector:
        return Selector((*self.steps, n))

    def each_index(self) -> Selector:
        return Selector((*self.steps, ("each", "index")))

    def each_member(self) -> Selector:
        return Selector((*self.steps, ("each", "member")))

    def compose(self, other: Selector) -> Selector:
        return Selector(self.steps + other.steps)

    @property
    def is_multi(self) -> bool:
        return any(isinstance(s, tuple) for s in self.steps)

    def __str__(self) -> str:
        shown = {("each", "index"): "[*]", ("each", "member"): "[]"}
        return "".join(shown[s] if isinstance(s, tuple) else f"[{s}]" if isinstance(s, int) else f".{_quoted(s)}" for s in self.steps) or "."

    def may_overlap(self, other: Selector) -> bool:
        """Could both select one scope, or one a scope inside the other's? Over the shorter length, step by step."""

        def meet(a, b) -> bool:
            member = lambda s: isinstance(s, str) or s == ("each", "member")
            return member(a) == member(b) and (isinstance(a, tuple) or isinstance(b, tuple) or a == b)

        return all(meet(a, b) for a, b in zip(self.steps, other.steps, strict=False))

    def covers(self, path: Column) -> Column:
        """True where the first steps of a path are this selector's: the scope itself and all inside it."""
        out = F.size(path) >= len(self.steps)
        for i, s in enumerate(self.steps):
            step = F.get(path, F.lit(i))
            if isinstance(s, tuple):
                out = out & (step["idx"].isNotNull() if s[1] == "index" else step["key"].isNotNull())
            else:
                out = out & ((step["idx"] == s) if isinstance(s, int) else (step["key"] == s))
        return F.coalesce(out, F.lit(False))

    def selects(self, path: Column) -> Column:
        return self.covers(path) & (F.size(path) == len(self.steps))


def quoted_json(text: Column) -> Column:
    """A JSON string literal: only quotes, backslashes and control characters are escaped."""
    # the first test is cheap and true of most texts
    plain = text.rlike(r"^[ !#-\[\]-~]*\z") | (F.is_valid_utf8(text) & ~text.rlike(r'["\\\x00-\x1f]'))
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""))


def display(path: Column) -> Column:
    """A path column as text: plain names after a dot, other names quoted, numbers in brackets, '.' for the root."""
    step = lambda s: F.when(s["idx"].isNotNull(), F.concat(F.lit("["), s["idx"].cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("."), F.when(s["key"].rlike(_PLAIN_KEY), s["key"]).otherwise(quoted_json(s["key"])))
    )
    return F.when(F.size(path) == 0, F.lit(".")).otherwise(F.array_join(F.transform(path, step), ""))


#: A selector as a column: of a step's three fields one is set.
SELECTOR_TYPE = "array<struct<key: string, idx: int, each: string>>"


def overlap(a: Column, b: Column) -> Column:
    """Selector.may_overlap for columns of SELECTOR_TYPE."""

    def meet(x, y):
        member = lambda s: s["key"].isNotNull() | F.coalesce(s["each"] == "member", F.lit(False))
        same = F.coalesce(x["key"] == y["key"], x["idx"] == y["idx"], F.lit(False))
        return (member(x) == member(y)) & (x["each"].isNotNull() | y["each"].isNotNull() | same)

    n = F.least(F.size(a), F.size(b))
    return F.forall(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), meet), lambda m: m)


def natural_keys(members: Column, fields: Column | None = None) -> Column:
    """The names of a map column in order: first those that fields (array<string>) names, as it names them, then
    the rest by text, but names that differ only in a number of up to nine digits at their end by that number."""
    stem = lambda k: F.regexp_replace(k, r"[0-9]+$", "")
    digits = lambda k: F.length(k) - F.length(stem(k))
    number = lambda k: F.when(digits(k).between(1, 9), F.substring(k, F.length(stem(k)) + 1, F.lit(9)).cast("int"))
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)

    def less(a, b):
        by_number = number(a).isNotNull() & number(b).isNotNull() & (stem(a) == stem(b)) & (number(a) != number(b))
        return F.when(by_number, sign(number(a), number(b))).otherwise(sign(a, b))

    keys = F.map_keys(members)
    if fields is None:
        return F.array_sort(keys, less)
    named = F.array_distinct(F.filter(fields, lambda f: f.isNotNull() & F.map_contains_key(members, f)))
    return F.concat(named, F.array_sort(F.array_except(keys, named), less))
