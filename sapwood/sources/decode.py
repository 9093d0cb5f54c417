"""Documents to node tables: one row for every value of a parsed document.

The decoders are small: each turns one text into plain Python values (dict, list, str, float, bool,
None); all that comes after is DataFrame work on the node table.
"""

from __future__ import annotations

import configparser
import csv
import io
import json
import re
import sys
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pre: place in document order; last: greatest pre inside; ancestors: pre of the root down to the node itself.
NODE_FIELDS = "pre long, last long, depth int, path array<struct<key: string, idx: int>>, ancestors array<bigint>, kind string, bool boolean, num double, lexeme string, str string, size int"

SPLITTABLE = {"jsonl": True, "csv": True}


class Lexeme(float):
    """A number that keeps its source text."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


class Pairs(list):
    """Members in source order, repeats included."""


class Malformed(ValueError):
    def __init__(self, message: str, row: int | None = None, col: int | None = None):
        super().__init__(message)
        self.row, self.col = row, col


def real(n) -> float:
    """A number as a double; one beyond all doubles is infinite."""
    try:
        return float(n)
    except OverflowError:
        return float("inf") if n > 0 else float("-inf")


def _refuse(name: str):
    raise Malformed(f"{name} is no JSON number")


_READ = {held: json.JSONDecoder(object_pairs_hook=Pairs, parse_int=of, parse_float=of, parse_constant=_refuse).decode for held, of in ((False, float), (True, Lexeme))}


def _json(text: str, lexemes: bool):
    try:
        return _READ[lexemes](text)
    except json.JSONDecodeError as e:
        raise Malformed(e.msg, e.lineno, e.colno) from None


def _jsonl(text: str, lexemes: bool):
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            try:
                out.append(_json(line, lexemes))
            except Malformed as e:
                raise Malformed(str(e), n, e.col) from None
    return out


_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')


def _jsonc(text: str, lexemes: bool):
    """Comments become blanks of the same shape, so positions stay; a comma before a close goes."""
    blank = lambda m: m[1] or re.sub(r"[^\n]", " ", m[0])
    return _json(_COMMA.sub(lambda m: m[1] or " ", _COMMENT.sub(blank, text)), lexemes)


def _csv(text: str, lexemes: bool):
    """A row's cells by the header's names; missing cells give no member, a cell beyond the header
    is named by its column's number from 1 (with underscores before it where the header has that name).
    Long cells are left to the limits."""
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    try:
        rows = [r for r in reader if r]
    except csv.Error as e:
        raise Malformed(str(e), reader.line_num) from None
    names = list(rows[0]) if rows else []
    taken = set(names)
    for n in range(len(names) + 1, max(map(len, rows), default=0) + 1):
        name = str(n)
        while name in taken:
            name = f"_{name}"
        names.append(name)
        taken.add(name)
    return [Pairs(zip(names, r, strict=False)) for r in rows[1:]]


def _toml(text: str, lexemes: bool):
    import tomllib

    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        at = re.search(r"at line (\d+), column (\d+)", str(e))  # the position is told in the message only
        raise Malformed(str(e), *(map(int, at.groups()) if at else ())) from None


def _ini(text: str, lexemes: bool):
    """Values before any section belong to the document; all values are text."""
    read = configparser.RawConfigParser(strict=False, interpolation=None, delimiters=("=",))
    read.optionxform = str
    try:
        read.read_string("[\0]\n" + text)
    except configparser.Error as e:
        lines = [n for n, _ in getattr(e, "errors", [])] or [getattr(e, "lineno", None)]
        raise Malformed(str(e), lines[0] and lines[0] - 1) from None  # one line stands before the text
    return dict(read["\0"].items()) | {s: dict(read[s].items()) for s in read.sections() if s != "\0"}


def _yaml(text: str, lexemes: bool):
    """Repeated mapping members merge, a merge key's members come after a mapping's own, several documents make a list."""
    import yaml

    def build(node, top=False):
        if isinstance(node, yaml.SequenceNode):
            return [build(n) for n in node.value]
        if isinstance(node, yaml.MappingNode):
            out, merged = {}, []
            for k, v in node.value:
                if k.tag == "tag:yaml.org,2002:merge":
                    merged += v.value if isinstance(v, yaml.SequenceNode) else [v]
                    continue
                key, value = str(build(k)) if not isinstance(k, yaml.MappingNode) else ", ".join(f"{build(a)}: {build(b)}" for a, b in k.value), build(v)
                key = k.value if isinstance(k, yaml.ScalarNode) else key
                out[key] = {**out[key], **value} if isinstance(out.get(key), dict) and isinstance(value, dict) else value
            for m in merged:
                out |= {k: v for k, v in build(m).items() if k not in out}
            return out
        kind, raw = node.tag.rpartition(":")[2], node.value
        if kind == "null":
            return None
        if kind == "bool":
            return raw.lower() in ("true", "yes", "on")
        return number(raw.replace("_", "").lower(), kind) if kind in ("int", "float") else raw

    def number(raw: str, kind: str) -> float:
        sign, size = -1 if raw.startswith("-") else 1, raw.lstrip("+-")
        if ":" in size:  # sixties
            total = 0.0
            for part in size.split(":"):
                total = 60 * total + float(part)
            return sign * total
        if kind == "float":
            return sign * float(size[1:] if size in (".inf", ".nan") else size)
        return real(sign * int(size, 8 if re.fullmatch(r"0\d+", size) else 0))

    try:
        found = [build(n) for n in yaml.compose_all(text, yaml.SafeLoader) if n is not None]
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise Malformed(str(e), *((mark.line + 1, mark.column + 1) if mark else ())) from None
    return found[0] if len(found) == 1 else found or None


def _xml(text: str, lexemes: bool):
    """An element is its name, attributes and children in order; text between elements is a string child.
    Elements stay as they are until they are walked, see _element."""
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        raise Malformed(str(e), e.position[0], e.position[1] + 1) from None


def _element(e) -> Pairs:
    """An XML element's members."""
    children = [e.text] if e.text and e.text.strip() else []
    for c in e:
        children.append(c)
        if c.tail and c.tail.strip():
            children.append(c.tail)
    return Pairs([("name", e.tag), ("attributes", e.attrib), ("children", children)])


def _relaxed(name: str):
    def read(text: str, lexemes: bool):
        from . import relaxed

        return getattr(relaxed, name)(text, lexemes)

    return read


DECODERS = {
    "json": _json, "jsonl": _jsonl, "jsonc": _jsonc, "csv": _csv, "toml": _toml, "ini": _ini, "yaml": _yaml, "xml": _xml,
    "json5": _relaxed("json5"), "jsonic": _relaxed("jsonic"), "zon": _relaxed("zon"),
}
_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def _texts(values):
    """Texts as Arrow's; half a surrogate pair is no character and becomes "?"."""
    import pyarrow as pa

    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


class Columns:
    """Rows of a node table as they come from documents, column by column; the paths and ancestors lie flat."""

    SCALARS = ("pre", "last", "depth", "kind", "bool", "num", "lexeme", "str", "size")

    LISTS = (*SCALARS, "of", "fail", "keys", "indexes", "above")

    def __init__(self):
        for name in self.LISTS:
            setattr(self, name, [])
        self.path_ends, self.above_ends = [0], [0]

    def clear(self) -> None:
        """Takes all rows out; the lists stay the same objects."""
        for name in self.LISTS:
            getattr(self, name).clear()
        self.path_ends[:] = self.above_ends[:] = [0]

    def __len__(self) -> int:
        return len(self.kind)

    def broken(self, of: int, message: str, row: int | None, col: int | None) -> None:
        for name in self.SCALARS:
            getattr(self, name).append(None)
        self.path_ends.append(None)
        self.above_ends.append(None)
        self.of.append(of)
        self.fail.append({"code": "INPUT_INVALID", "message": message, "row": row, "col": col})

    def batch(self, ids, names: list[str], fail_type):
        """One Arrow batch of all rows so far."""
        import pyarrow as pa

        def lists(ends, values):
            # an end without a value is a null list; the one before it stands for it
            valid, offsets, at = [], [0], 0
            for e in ends[1:]:
                valid.append(e is not None)
                at = at if e is None else e
                offsets.append(at)
            mask = None if all(valid) else pa.array([not v for v in valid], pa.bool_())
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)

        path = pa.StructArray.from_arrays([_texts(self.keys), pa.array(self.indexes, pa.int32())], ["key", "idx"])
        made = [
            ids.take(pa.array(self.of, pa.int64())), pa.array(self.pre, pa.int64()), pa.array(self.last, pa.int64()), pa.array(self.depth, pa.int32()),
            lists(self.path_ends, path), lists(
                self.above_ends,
                pa.array(self.above, pa.int64()),
            ), pa.array(self.kind, pa.string()), pa.array(self.bool, pa.bool_()),
            pa.array(self.num, pa.float64()), pa.array(self.lexeme, pa.string()), _texts(self.str), pa.array(self.size, pa.int32()), pa.array(self.fail, fail_type),
        ]
        return pa.RecordBatch.from_arrays(made, names)


#: Rows from which on the nodes so far are passed on, in the midst of a document too.
ROWS = 20_000


def _members(v, duplicates: str) -> list:
    """The members that count of an object."""
    pairs = v.items() if isinstance(v, dict) else _element(v) if isinstance(v, ET.Element) else v
    if duplicates == "all":
        return pairs
    out = {}
    for k, v in pairs:
        if duplicates == "last_wins" or k not in out:
            out[k] = v
    return out.items()


def _count(value, duplicates: str) -> int:
    """How many nodes a value has."""
    n, todo = 0, [value]
    while todo:
        v = todo.pop()
        n += 1
        if isinstance(v, (Pairs, dict, ET.Element)):
            todo.extend(child for _, child in _members(v, duplicates))
        elif isinstance(v, (list, tuple)):
            todo.extend(v)
    return n


def walk(value, duplicates: str, into: Columns, of: int):
    """Appends the nodes of one value in document order. duplicates: last_wins keeps a member's first place and
    last value, first_wins its first, all every occurrence.

    Each time ROWS rows are there it yields, for the caller to take the rows out.
    """
    first = len(into)
    pre, last, depths, kinds, bools, nums, lexemes, strs, sizes = (getattr(into, n).append for n in Columns.SCALARS)
    ofs, fails, path_end, above_end = into.of.append, into.fail.append, into.path_ends.append, into.above_ends.append
    all_kinds, all_keys, all_indexes, all_above = into.kind, into.keys, into.indexes, into.above

    # a stack of iterators, so that depth is not bound by Python's
    def enter(v, up, step):
        n = len(all_kinds) - first
        depth = 0
        if up is not None:
            _, _, named, keys, indexes, above, depth = up
            key, index = (step, None) if named else (None, step)
            all_keys.extend(keys)
            all_keys.append(key)
            all_indexes.extend(indexes)
            all_indexes.append(index)
            all_above.extend(above)
        all_above.append(n)
        path_end(len(all_keys))
        above_end(len(all_above))
        pre(n)
        last(n)
        ofs(of)
        fails(None)
        truth = number = text = string = inner = None
        size = 0
        if type(v) is float:
            kind, number = "number", v
        elif isinstance(v, str):
            kind, string = "string", str(v)
        elif v is None:
            kind = "null"
        elif isinstance(v, bool):
            kind, truth = "bool", v
        elif isinstance(v, (int, float)):
            kind, number = "number", real(v)
            text = getattr(v, "text", None)
            text = text if text is not None and _NUMBER.match(text) else None
        elif isinstance(v, (Pairs, dict, ET.Element)):
            kind = "object"
            found = _members(v, duplicates)
            inner, size, depth = iter(found), len(found), depth + 1
        elif isinstance(v, (list, tuple)):
            kind, inner, size, depth = "array", enumerate(v), len(v), depth + 1
        else:
            kind, string = "string", str(v)
        depths(depth)
        kinds(kind)
        bools(truth)
        nums(number)
        lexemes(text)
        strs(string)
        sizes(size)
        if inner is None:
            return None
        return [n, inner, kind == "object", *(([], [], [n]) if up is None else ([*keys, key], [*indexes, index], [*above, n])), depth]

    def foresee(end: int) -> None:
        """Sets ``last`` of the open containers among the rows; what is still to come in them is counted."""
        for frame in reversed(stack):
            if first + frame[0] < 0:
                break  # passed on before, as all outside it
            rest = list(frame[1])
            frame[1] = iter(rest)
            end += sum(_count(child, duplicates) for _, child in rest)
            into.last[first + frame[0]] = end

    stack = [f] if (f := enter(value, None, None)) else []
    while stack:
        frame = stack[-1]
        n, inner = frame[:2]
        for step, child in inner:
            if deeper := enter(child, frame, step):
                stack.append(deeper)
                break
            if len(all_kinds) >= ROWS:
                break
        else:
            if first + n >= 0:
                into.last[first + n] = len(all_kinds) - first - 1
            stack.pop()
        if len(all_kinds) >= ROWS:
            done = len(all_kinds) - first
            foresee(done - 1)
            yield
            first = len(all_kinds) - done


def nodes(
    docs: DataFrame,
    key: str = "doc_id",
    content: str = "content",
    format: str | None = None,
    lexemes: bool = False,
    duplicates: str = "last_wins",
) -> DataFrame:
    """The node table of documents: key, the NODE_FIELDS and ``fail`` (null but for a document that cannot be read,
    which has one row with null fields). The format is a literal or the column ``format`` of docs.

    A task holds one parsed document and the rows of about ROWS nodes. Half of a surrogate pair in a text becomes "?".
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    from ..functions.failures import FAIL_TYPE

    named = docs.select(F.col(key).alias("_id"), F.col(content).alias("_content"), *([] if format else [F.col("format").alias("_format")]))
    shape = f"_id {dict(named.dtypes)['_id']}, {NODE_FIELDS}, fail {FAIL_TYPE}"
    names = ["_id", *(f.name for f in _parse_datatype_string(NODE_FIELDS).fields), "fail"]
    fail_type = to_arrow_type(_parse_datatype_string(FAIL_TYPE))

    def run(batches):
        for b in batches:
            out = Columns()
            for i in range(b.num_rows):
                text, fmt = b.column(1)[i].as_py(), format or b.column(2)[i].as_py()
                try:
                    if fmt not in DECODERS:
                        raise Malformed(f"no decoder for {fmt}")
                    if text is None:
                        raise Malformed("no content")
                    for _ in walk(DECODERS[fmt](text.decode() if isinstance(text, bytes) else text, lexemes), duplicates, out, i):
                        yield out.batch(b.column(0), names, fail_type)
                        out.clear()
                except (ValueError, RecursionError) as e:  # Malformed and broken UTF-8 among them
                    out.broken(i, str(e), getattr(e, "row", None), getattr(e, "col", None))
                if len(out) >= ROWS:
                    yield out.batch(b.column(0), names, fail_type)
                    out.clear()
            if len(out):
                yield out.batch(b.column(0), names, fail_type)

    return named.mapInArrow(run, shape).withColumnRenamed("_id", key)


#: An event in a document's list: a container's start or end or a scalar, its member's name, and whether a comma goes before it.
EVENT_FIELDS = "kind string, key_name string, later boolean, bool boolean, num double, str string"


def listed(value, duplicates: str, into: list) -> None:
    """Appends the EVENT_FIELDS of one JSON value, in document order."""
    add = into.append
    stack = [(None, False, iter([(None, value)]))]
    later = False
    while stack:
        end, named, inner = stack[-1]
        for step, v in inner:
            key, of = step if named else None, type(v)
            if of is float:
                add(("number", key, later, None, v, None))
            elif of is str:
                add(("string", key, later, None, None, v))
            elif of is Pairs:
                add(("object_start", key, later, None, None, None))
                stack.append(("object_end", True, iter(_members(v, duplicates))))
                later = False
                break
            elif of is list:
                add(("array_start", key, later, None, None, None))
                stack.append(("array_end", False, enumerate(v)))
                later = False
                break
            elif v is None:
                add(("null", key, later, None, None, None))
            else:
                add(("bool", key, later, v, None, None))
            later = True
        else:
            if end:
                add((end, None, False, None, None, None))
            later = True
            stack.pop()


def event_lists(docs: DataFrame, policies: list[str], key: str = "doc_id", content: str = "content") -> DataFrame:
    """The events of JSON documents, one row for each document and policy of repeated members: key, policy and events
    (array of EVENT_FIELDS). Documents that cannot be read give none.

    A text is parsed once for all policies, and as its events stay together nothing has to bring them together again.
    A document is held whole, so this is for short ones; nodes() reads any.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    named = docs.select(F.col(key).alias("_id"), F.col(content).alias("_content"))
    shape = f"_id {dict(named.dtypes)['_id']}, policy string, events array<struct<{EVENT_FIELDS}>>"
    fields = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(EVENT_FIELDS).fields}

    def run(batches):
        import pyarrow as pa

        rows, of, policy, ends = [], [], [], [0]

        def batch(ids):
            made = [_texts(c) if t == pa.string() else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)]
            events = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, list(fields)))
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(policy, pa.string()), events], ["_id", "policy", "events"])
            for held in (rows, of, policy):
                held.clear()
            ends[:] = [0]
            return out

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                try:
                    value = _json(text.decode() if isinstance(text, bytes) else text, False)
                except (ValueError, RecursionError):  # Malformed and broken UTF-8 among them
                    continue
                for p in policies:
                    listed(value, p, rows)
                    of.append(i)
                    policy.append(p)
                    ends.append(len(rows))
                if len(rows) >= ROWS:
                    yield batch(b.column(0))
            if rows:
                yield batch(b.column(0))

    return named.where("_content is not null").mapInArrow(run, shape).withColumnRenamed("_id", key)


def formats(spark) -> DataFrame:
    """What each format allows: record-wise splitting, and the decoder for whole documents."""
    return spark.createDataFrame(
        [(f, SPLITTABLE.get(f, False), f in ("json", "jsonl", "csv", "xml")) for f in sorted(DECODERS)],
        "format string, splittable boolean, native boolean",
    )
