"""CSV, JSON and XML payloads held in a column.

A parsed payload is a struct column

    error     STRING
    decl      STRING                      XML declaration, rewritten for UTF-8
    nodes     ARRAY<STRUCT<path, value, kind, name, depth, up, at>>   JSON and XML, every node in document order
    rows      ARRAY<ARRAY<STRING>>        CSV

``at`` is a node's position, ``depth`` its level and ``up`` the closing marks of its ancestors, innermost first.  A node's
subtree is the run of deeper nodes behind it, so a branch is rendered, cut out or replaced as a slice of the array, and
nothing is stored twice.  An XML element of simple content is a ``tag`` node, its attributes and a ``simple`` node.

JSON and XML are read by one Arrow-batched pass per payload, because no built-in keeps what these dialects need: key
order, duplicate keys and number literals, strictness without failing the job.  CSV is read without Python.  Everything
after that (path lookup, writes, rendering, leaves, diff) is column work.
"""

from __future__ import annotations

import json
import re
import sys
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import csv_path, json_key_text, json_pattern, xml_pattern
from . import edits
from .columns import bind, let, materialise
from .scalars import csv_row

MAX_DEPTH = 512
PARSED = f"struct<error:string,decl:string,nodes:{edits.NODES}>"
_FIELDS = [("path", pa.string()), ("value", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("up", pa.string()),
           ("at", pa.int32())]
_ARROW = pa.struct([("error", pa.string()), ("decl", pa.string()), ("nodes", pa.list_(pa.struct(_FIELDS)))])
#: Kinds that are not leaves; a tag is not even addressed, its simple node is.
BRANCHES = ("object", "array", "element", "tag")


class BadPayload(ValueError):
    pass


# ---- JSON -----------------------------------------------------------------

class _Literal(str):
    """A JSON number kept as written."""


class _Members(list):
    """Object members in order, duplicates included."""


def _no_constant(name):
    raise BadPayload(f"json: invalid literal {name}")


def json_nodes(raw: bytes):
    decoder = json.JSONDecoder(object_pairs_hook=_Members, parse_float=_Literal, parse_int=_Literal,
                               parse_constant=_no_constant)
    text = raw.decode("utf-8", "replace")
    body = text.strip(" \t\r\n")
    if not body:
        raise BadPayload("json: empty message")
    try:
        doc, end = decoder.raw_decode(body)
    except RecursionError:
        raise BadPayload(f"json: nesting deeper than {MAX_DEPTH} levels") from None
    except json.JSONDecodeError as e:
        raise BadPayload(f"json: {e.msg} at offset {e.pos}") from None
    if end != len(body):
        raise BadPayload("json: trailing data after document")
    nodes = []

    def walk(v, path, name, depth, up):
        add = lambda value, kind: nodes.append((path, value, kind, name, depth, up))
        if isinstance(v, list):
            if depth >= MAX_DEPTH:
                raise BadPayload(f"json: nesting deeper than {MAX_DEPTH} levels")
            if isinstance(v, _Members):
                add(None, "object")
                for k, x in v:
                    walk(x, json_key_text(path, k), k, depth + 1, "}" + up)
            else:
                add(None, "array")
                for i, x in enumerate(v):
                    walk(x, f"{path}[{i}]", f"[{i}]", depth + 1, "]" + up)
        elif isinstance(v, _Literal):
            add(str(v), "number")
        elif isinstance(v, str):
            add(v.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in v) else v, "string")
        elif v is None:
            add("", "null")
        else:
            add("true" if v else "false", "bool")

    walk(doc, "", "", 0, "")
    return None, nodes


# ---- XML ------------------------------------------------------------------

_DECLARED = re.compile(rb"^\xef?\xbb?\xbf?\s*<\?xml([^>]*?)\?>", re.S)
_ENCODING = re.compile(r"""encoding\s*=\s*(?:"([^"]*)"|'([^']*)')""")
# The single-byte encodings legacy feeds declare.
_LATIN1 = {"iso-8859-1", "iso8859-1", "latin1", "l1", "iso_8859-1"}
_CP1252 = {"windows-1252", "cp1252"}
_UTF8 = {"", "utf-8", "utf8", "us-ascii", "ascii"}


def xml_text_of(raw: bytes) -> tuple[str, str | None]:
    """(document text, declaration rewritten for UTF-8)."""
    m = _DECLARED.match(raw)
    inst = m[1].decode("latin-1").strip() if m else None
    found = _ENCODING.search(inst or "")
    label = ((found[1] or found[2] or "") if found else "").strip().lower()
    if label in _LATIN1:
        text = raw.decode("latin-1")
    elif label in _CP1252:
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw) if any(
            0x80 <= b < 0xA0 for b in raw) else raw.decode("latin-1")
    elif label in _UTF8:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            raise BadPayload("xml: invalid UTF-8") from None
    else:
        raise BadPayload(f'xml: unsupported encoding "{label}"')
    return text, _ENCODING.sub('encoding="UTF-8"', inst) if inst is not None else None


def xml_nodes(raw: bytes):
    if not raw.strip():
        raise BadPayload("xml: empty message")
    text, decl = xml_text_of(raw)
    # stack items: [name, [(attr, value)], [content], has_elements]
    top, stack = [], []

    def start(name, attrs):
        if len(stack) >= MAX_DEPTH:
            raise BadPayload(f"xml: nesting deeper than {MAX_DEPTH} levels")
        item = [name, list(zip(attrs[::2], attrs[1::2])), [], False]
        if stack:
            stack[-1][2].append(item)
            stack[-1][3] = True
        else:
            top.append(item)
        stack.append(item)

    def chars(data):
        if stack:
            content = stack[-1][2]
            if content and isinstance(content[-1], str):
                content[-1] += data
            else:
                content.append(data)

    def cut(*_):
        if stack:
            stack[-1][2].append("")  # a comment or instruction ends a text run

    p = expat.ParserCreate("utf-8")
    p.ordered_attributes, p.buffer_text = True, True
    p.StartElementHandler, p.CharacterDataHandler = start, chars
    p.EndElementHandler = lambda name: stack.pop()
    p.CommentHandler = p.ProcessingInstructionHandler = cut

    def refuse(*_):
        raise BadPayload("xml: entities other than the five of XML are not supported")

    p.EntityDeclHandler = p.SkippedEntityHandler = refuse
    body = _DECLARED.sub(b"", text.encode("utf-8"), count=1)
    try:
        p.Parse(body, True)
    except expat.ExpatError as e:
        raise BadPayload(f"xml: {e}") from None
    nodes = []

    def walk(item, path, depth, up):
        name, attrs, content, has_elements = item
        nodes.append((path, None, "element" if has_elements else "tag", name, depth, up))
        up, depth = f"</{name}>{up}", depth + 1
        for k, v in attrs:
            nodes.append((f"{path}/@{k}", v, "attr", k, depth, up))
        if not has_elements:
            nodes.append((path, "".join(content), "simple", "", depth, up))
            return
        seen = {}
        for c in content:
            if isinstance(c, str) and not c.strip():
                continue
            key = "#text" if isinstance(c, str) else c[0]
            seen[key] = seen.get(key, 0) + 1
            child = f"{path}/{key}" + (f"[{seen[key]}]" if seen[key] > 1 else "")
            if isinstance(c, str):
                nodes.append((child, c, "text", key, depth, up))
            else:
                walk(c, child, depth, up)

    walk(top[0], top[0][0], 0, "")
    return (f"<?xml {decl}?>" if decl else "<?xml?>" if decl == "" else ""), nodes


# ---- CSV ------------------------------------------------------------------

#: Mark of structure inside the text while it is cut; where the text has it itself it is written as mark and x.
_MARK = "\ufdd0"


def _csv_error(p: str = "p") -> str:
    """The first place where quotes are wrong, of the pieces between quotes."""
    sep = "[,\\\\n]"
    lines = lambda upto: f"size(split(array_join(slice({p}, 1, {upto}), ''), '\\\\n'))"
    # the quoted field that the quote behind piece i - 1 closes opens at the last piece that follows structure
    opened = f"array_max(filter(sequence(1, greatest(i - 1, 1), 2), j -> j = 1 OR {p}[j - 1] != ''))"
    quoted = f"concat('csv: record on line ', {lines(opened)}, ': extraneous or missing \" in quoted-field')"
    bare = f"concat('csv: record on line ', {lines('i + 1')}, ': bare \" in non-quoted-field')"
    return f"""get(filter(transform(sequence(0, size({p}) - 1), i -> CASE
        WHEN size({p}) = 1 THEN NULL
        WHEN i % 2 = 1 THEN IF(i = size({p}) - 1, {quoted.replace("i - 1", "i")}, NULL)
        WHEN i > 0 AND {p}[i] != '' AND NOT {p}[i] RLIKE '^{sep}' THEN {quoted}
        WHEN i < size({p}) - 1 AND {p}[i] != '' AND NOT {p}[i] RLIKE '{sep}\\\\z' THEN {bare} END), e -> e IS NOT NULL), 0)"""


def _csv_cells(p: str = "p") -> str:
    """Rows of cells from the pieces between quotes: even ones are structure, odd ones text.

    An empty even piece between two odd ones is a doubled quote; a piece that opens a quoted field is marked, so that a
    quoted empty line is not taken for a blank one."""
    m = _MARK
    marked = (f"array_join(transform({p}, (x, i) -> CASE WHEN i % 2 = 1 THEN IF(i = 1 OR {p}[i - 1] != '', concat('{m}q', x), x) "
              f"WHEN x = '' AND i > 0 AND i < size({p}) - 1 THEN '\"' ELSE replace(replace(x, ',', '{m},'), '\\n', '{m}n') END), '')")
    cell = f"replace(replace(IF(c LIKE '{m}q%', substring(c, 3), c), '{m}x', '{m}'), '\\r', '\\n')"
    return f"transform(filter(split({marked}, '{m}n'), l -> l != ''), l -> transform(split(l, '{m},'), c -> {cell}))"


def _csv(raw: Column) -> Column:
    """The parsed struct of strict RFC 4180 text; blank lines are skipped, CR inside values is LF."""
    text = F.replace(F.make_valid_utf8(F.coalesce(raw, F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    pieces = F.split(F.replace(text, F.lit(_MARK), F.lit(_MARK + "x")), '"')
    both = bind(pieces, f"p -> named_struct('error', {_csv_error()}, 'rows', {_csv_cells()})")
    return bind(both, "x -> named_struct('error', coalesce(x.error, IF(size(x.rows) = 0, 'csv: empty message', NULL)), "
                      "'rows', IF(x.error IS NULL, x.rows, slice(x.rows, 1, 0)))")


_PARSERS = {"json": json_nodes, "xml": xml_nodes}


# The parsers travel with the task, so executors need no installed package.
for _module in (__name__, json_key_text.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])


def _arrow_parser(fmt: str):
    parse, names = _PARSERS[fmt], [n for n, _ in _FIELDS]

    def run(batch: pa.Array) -> pa.Array:
        out = []
        for raw in batch.to_pylist():
            try:
                decl, nodes = parse(raw or b"")
                out.append({"error": None, "decl": decl, "nodes": [dict(zip(names, (*n, i))) for i, n in enumerate(nodes)]})
            except BadPayload as e:
                out.append({"error": str(e), "decl": None, "nodes": []})
        return pa.array(out, type=_ARROW)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=PARSED)


def parse_tree(df: DataFrame, fmt: str, raw: str = "raw", out: str = "msg") -> DataFrame:
    """Add the parsed struct column of a json, xml or csv payload."""
    if fmt == "csv":
        return materialise(df, out, _csv(F.col(raw).cast("string")))
    return materialise(df.withColumn(f"__{out}", _arrow_parser(fmt)(F.col(raw).cast("binary"))), out, F.col(f"__{out}"), df.columns)


class Tree:
    """Accessors over a parsed tree column, same contract as ``Parsed``.

    Writes give a new Tree; a write that the message's structure does not allow leaves it as it is and sets ``error``."""

    def __init__(self, col: Column | str, fmt: str):
        self.name = col if isinstance(col, str) else None
        self.col = F.col(col) if isinstance(col, str) else col
        self.fmt, self.pending = fmt, None
        self.error = self.col["error"]
        self.nodes, self.grid = (None, self.col["rows"]) if fmt == "csv" else (self.col["nodes"], None)

    def _written(self, write) -> "Tree":
        """The message after ``write(view)`` gave (error, nodes) or, for CSV, rows; the message before is bound once."""
        def after(m):
            view = Tree(m, self.fmt)
            if self.fmt == "csv":
                return F.struct(m["error"].alias("error"), write(view).alias("rows"))
            return let(write(view), lambda done: F.struct(F.coalesce(m["error"], done["error"]).alias("error"), m["decl"].alias("decl"), done["nodes"].alias("nodes")))

        return Tree(let(self.col, after), self.fmt)

    def _matches(self, path: str) -> Column:
        """The nodes a path addresses."""
        if self.fmt == "json":
            pattern = json_pattern(path)
            own, elems = f"^{pattern}$", rf"^{pattern}(\[\d+\])?$"
            return F.filter(self.nodes, lambda x: x["path"].rlike(elems) & ~(
                (x["kind"] == "array") & x["path"].rlike(own)))
        pattern = xml_pattern(path)
        if "(?:" not in pattern:
            exact = re.sub(r"\\(.)", r"\1", pattern)
            return F.filter(self.nodes, lambda x: (x["path"] == exact) & (x["kind"] != "tag"))
        return F.filter(self.nodes, lambda x: x["path"].rlike(f"^{pattern}$") & (x["kind"] != "tag"))

    def _shown(self, node: Column, nodes: Column) -> Column:
        """A leaf's value, a branch as text."""
        return F.when(~node["kind"].isin(*BRANCHES), node["value"]).when(
            node["at"].isNotNull(), edits.render(self.fmt, edits.subtree(nodes, node["at"])))

    def _cells(self, row: int, col: int) -> Column:
        """CSV cells, or with no column re-encoded rows, of one row or all (0)."""
        rows = F.slice(self.grid, row, 1) if row else self.grid
        if not col:
            return F.transform(rows, csv_row)
        return F.transform(F.filter(rows, lambda r: F.size(r) >= col), lambda r: r[col - 1])

    def get_all(self, path: str) -> Column:
        if self.fmt == "csv":
            return self._cells(*csv_path(path))
        return let(self.nodes, lambda ns: F.transform(self._over(ns)._matches(path), lambda x: self._shown(x, ns)))

    def get(self, path: str) -> Column:
        if self.fmt == "csv":
            return F.get(self._cells(*csv_path(path)), F.lit(0))
        return let(self.nodes, lambda ns: let(F.get(self._over(ns)._matches(path), F.lit(0)), lambda x: self._shown(x, ns)))

    def _over(self, nodes: Column) -> "Tree":
        view = Tree.__new__(Tree)
        view.__dict__.update(self.__dict__, nodes=nodes)
        return view

    def set(self, path: str, value) -> "Tree":
        """A new message with ``value`` at ``path``; structure is created as needed.

        JSON keeps the value's type (NULL is null), XML and CSV write its text (NULL is empty)."""
        if self.fmt == "csv":
            row, col = csv_path(path)
            if not col:
                raise ValueError(f'csv: path "{path}": set requires a column')
            return self._written(lambda t: edits.csv_set(t.grid, row or 1, col, value))
        # writes in a row are one fold over the message as it was before them
        before, writes = self.pending or (self, [])
        writes = [*writes, edits.json_edit(path, value) if self.fmt == "json" else edits.xml_edit(path, value)]
        done = before._written(lambda t: edits.edited(self.fmt, t.nodes, writes))
        done.pending = before, writes
        return done

    def each_segment(self, name: str, write, where=None) -> "Tree":
        """Write to every top-level unit of a name: rows 'R', members of a JSON object (arrays fanned out), XML children.

        ``write(unit, i, units)`` gets a handle with ``get`` and ``set`` on paths relative to the unit, its number from 0
        and the handles of all units as they were (``units[2]``); ``where(unit, i)`` leaves out units.  One pass, in
        which every unit is read and put back at its place."""
        if self.fmt == "csv":
            if name != "R":
                return self

            def rows(t):
                units = _Units(lambda k: CsvUnit(F.get(t.grid, F.lit(k))), F.size(t.grid))

                def one(row, i):
                    unit = CsvUnit(row)
                    new = write(unit, i, units).row
                    return new if where is None else F.when(where(unit, i), new).otherwise(row)

                return F.transform(t.grid, one)

            return self._written(rows)

        def unit(sub, i, subs):
            unit, units = TreeUnit(self.fmt, sub), _Units(lambda k: TreeUnit(self.fmt, subs(k)), subs(None))
            new = write(unit, i, units).result()
            return new if where is None else F.when(where(unit, i), new).otherwise(F.struct(edits.no_error().alias("error"), sub.alias("nodes")))

        return self._written(lambda t: edits.each_unit(t.nodes, t._units(name), unit))

    def _units(self, name: str) -> Column:
        """The nodes that begin a top-level unit."""
        if self.fmt == "json":
            return self._matches(json_key_text("", name))
        root = F.get(self.nodes, F.lit(0))
        is_unit = lambda x: x["kind"].isin("element", "tag") & (x["name"] == name)
        return F.when(root["name"] == name, F.slice(self.nodes, 1, 1)).otherwise(F.filter(self.nodes, lambda x: (x["depth"] == 1) & is_unit(x)))

    def rows(self) -> Column:
        """CSV rows as ARRAY<ARRAY<STRING>>."""
        return self.grid

    def serialize(self) -> Column:
        """Canonical text; NULL for a message with an error."""
        def text(m):
            if self.fmt == "csv":
                got = F.concat(F.array_join(F.transform(m["rows"], csv_row), "\n"), F.lit("\n"))
            elif self.fmt == "json":
                got = edits.render("json", m["nodes"])
            else:
                got = F.concat(F.coalesce(m["decl"], F.lit("")), edits.render("xml", m["nodes"]))
            return F.when(m["error"].isNull(), got)

        return let(self.col, text)

    def segments(self, name: str) -> Column:
        """Top-level units of a name as their rendered values: CSV rows 'R',
        JSON members (arrays fanned out), XML child elements."""
        if self.fmt == "csv":
            return F.transform(self.grid, csv_row) if name == "R" else F.array().cast("array<string>")
        if self.fmt == "json":
            return self.get_all(json_key_text("", name))
        simple = lambda ns, u: F.get(F.filter(edits.subtree(ns, u["at"]), lambda x: (x["kind"] == "simple") & (x["depth"] == u["depth"] + 1)), F.lit(0))["value"]
        return let(self.nodes, lambda ns: F.transform(self._over(ns)._units(name), lambda u: F.when(u["kind"] == "tag", simple(ns, u)).otherwise(self._shown(u, ns))))

    def leaves(self) -> Column:
        """Non-empty leaves, ARRAY<STRUCT<path, value, kind>>."""
        if self.fmt == "csv":
            path = lambda r, c: F.concat(F.when(r == 0, F.lit("R.")).otherwise(F.concat(F.lit("R["), (r + 1).cast("string"), F.lit("]."))), (c + 1).cast("string"))
            cells = F.flatten(F.transform(self.grid, lambda row, r: F.transform(row, lambda v, c: F.struct(
                path(r, c).alias("path"), v.alias("value"), F.lit("cell").alias("kind")))))
            return F.filter(cells, lambda x: x["value"] != "")
        return F.filter(self.nodes, lambda x: ~x["kind"].isin(*BRANCHES) & (x["value"] != ""))


class _Units:
    """All units of a name as they were: ``units[k]`` is a handle, ``count`` their number."""

    def __init__(self, handle, count: Column):
        self._handle, self.count = handle, count

    def __getitem__(self, k: int):
        return self._handle(k)


class CsvUnit:
    """One CSV row; paths are column numbers."""

    def __init__(self, row: Column):
        self.row = row

    @staticmethod
    def _column(rel: str) -> int:
        if not re.fullmatch(r"[1-9]\d*", rel):
            raise ValueError(f'csv: row-relative path "{rel}" must be a column number')
        return int(rel)

    def get(self, rel: str) -> Column:
        return F.get(self.row, F.lit(self._column(rel) - 1))

    def set(self, rel: str, value) -> "CsvUnit":
        return CsvUnit(edits.cell_set(self.row, self._column(rel), value))


class TreeUnit:
    """A subtree of a JSON or XML message; paths are relative to it."""

    def __init__(self, fmt: str, nodes: Column, writes: tuple = ()):
        self.fmt, self.nodes, self.writes = fmt, nodes, writes

    def get(self, rel: str) -> Column:
        """The first match, a branch as text."""
        return let(self.result()["nodes"], lambda ns: edits.relative_get(self.fmt, ns, rel))

    def set(self, rel: str, value) -> "TreeUnit":
        write = edits.json_edit(rel, value) if self.fmt == "json" else edits.xml_edit(rel, value, inside=True)
        return TreeUnit(self.fmt, self.nodes, (*self.writes, write))

    def result(self) -> Column:
        """(error, nodes) after the writes."""
        nodes = edits.numbered(self.nodes)
        if not self.writes:
            return F.struct(edits.no_error().alias("error"), nodes.alias("nodes"))
        return edits.edited(self.fmt, nodes, list(self.writes))
