"""Target messages assembled from columns.

The structure of a new message is known while the query is built, so all
padding, promotion and ordering happen in Python on the driver, once per
query; what reaches the executors is one flat concatenation of columns.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import json_steps, json_string, xml_steps
from .columns import bind, each, let, sql_text, text_or_empty
from .delimited import SPECS, DelimitedSpec, compile_path, escape_sql
from .scalars import csv_row, json_quote, xml_attr, xml_text


class SegmentBuilder:
    """Fields of one segment: {field: {rep: {comp: {sub: text}}}}."""

    def __init__(self, spec: DelimitedSpec, name: str):
        self.spec, self.name, self.fields = spec, name, {}

    def set(self, rel: str, value) -> "SegmentBuilder":
        p = compile_path(self.spec, f"{self.name}-{rel}")
        raw = self.spec.raw_fields(self.name)
        if p.field <= raw and (p.comp or p.sub):
            raise ValueError(f"{self.spec.name}: {self.name}-{p.field} holds a delimiter and has no components")
        level = "sub" if p.sub else "comp" if p.comp else "rep"
        below = ("comp", "sub") if level == "rep" else ("sub",) if level == "comp" else ()
        keep = tuple(r for r in below if r in self.spec.escapes.values())
        if isinstance(value, str) and self.spec.defaults["esc"] not in value:
            text = _literal(value, self.spec, keep)
        else:
            text = _Leaf(text_or_empty(value), keep)
        rep = self.fields.setdefault(p.field, {}).setdefault(max(p.rep, 1), {})
        comp = rep.setdefault(p.comp or 1, {})
        if not p.comp:
            rep.clear()
            comp = rep.setdefault(1, {})
        elif not p.sub:
            comp.clear()
        comp[p.sub or 1] = text
        return self

    def parts(self) -> list:
        """The segment's text as constants and leaves."""
        dl = self.spec.defaults
        nested = lambda d, sep, inner: _padded({k: inner(v) for k, v in d.items()}, sep)
        comp = lambda c: nested(c, dl["sub"], lambda t: [t])
        rep = lambda r: nested(r, dl["comp"], comp)
        field = lambda f: nested(f, dl["rep"], rep)
        raw = self.spec.raw_fields(self.name)
        out = [self.name]
        if raw:
            out += [dl["field"], _encoding_chars(self.spec)]
        for n in range(raw + 1, max(self.fields, default=0) + 1):
            out += [dl["field"], *(field(self.fields[n]) if n in self.fields else [])]
        return out


def _concat(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _padded(items: dict[int, list], sep: str) -> list:
    out = []
    for n in range(1, max(items) + 1):
        out += [sep] * (n > 1) + items.get(n, [])
    return out


class _Leaf:
    """A value column still to be encoded, with the separators it may keep."""

    def __init__(self, text: Column, keep: tuple[str, ...]):
        self.text, self.keep = text, keep


def _literal(text: str, spec: DelimitedSpec, keep: tuple[str, ...]) -> str:
    """Wire form of a constant, encoded on the driver; constants holding an
    escape character go through the column form instead."""
    codes = {spec.defaults[r]: b for b, r in spec.escapes.items() if r not in keep}
    esc = spec.defaults["esc"]
    return "".join(f"{esc}{codes[c]}{esc}" if c in codes else f"{esc}X{ord(c):02X}{esc}" if c < " " else c for c in text)


def _special(spec: DelimitedSpec, keep: tuple[str, ...]) -> str:
    """Pattern of what a leaf may not hold as it is."""
    return "[" + "".join("\\" + spec.defaults[r] for r in spec.escapes.values() if r not in keep) + r"\x00-\x1f]"


def _encoded_row(parts: list, spec: DelimitedSpec) -> Column:
    """Constants and leaves of one row, concatenated.

    Each leaf stands in compiled code, which reads it once; the encoding is a
    function over its tokens and runs for leaves that need it alone."""
    def leaf(p):
        return F.coalesce(F.when(p.text.rlike(_special(spec, p.keep)), bind(p.text, f"t -> {escape_sql('t', spec, p.keep)}")), p.text)

    out, run = [], ""
    for p in parts:
        if isinstance(p, str):
            run += p
            continue
        out += [F.lit(run), leaf(p)] if run else [leaf(p)]
        run = ""
    return F.concat(*out, F.lit(run)) if out else F.lit(run)


class _Repeat:
    """Segments of an array column: constants and leaves of one, and the leaves of all as an array of arrays."""

    def __init__(self, spec: DelimitedSpec, name: str, over: Column, fill):
        self.spec, self.parts = spec, []

        def leaves(x, i):
            seg = SegmentBuilder(spec, name)
            fill(seg, x, i)
            self.parts = [*seg.parts(), "\r"]
            return F.array(*(p.text for p in self.parts if isinstance(p, _Leaf))).cast("array<string>")

        self.values = F.transform(over, leaves)

    def text(self, values: Column) -> Column:
        """The segments, of ``values``: functions are interpreted, so the leaves are tested as a whole, and encoded one
        by one only where the test finds anything."""
        keeps = [p.keep for p in self.parts if isinstance(p, _Leaf)]
        rules = list(dict.fromkeys(keeps))

        def encoded(keep):
            return f"CASE WHEN t RLIKE {sql_text(_special(self.spec, keep))} THEN {escape_sql('t', self.spec, keep)} ELSE t END"

        by_rule = encoded(rules[0]) if len(rules) == 1 else "CASE " + " ".join(
            f"WHEN i IN ({', '.join(str(i) for i, k in enumerate(keeps) if k == r)}) THEN {encoded(r)}" for r in rules) + " END"

        def segment(row: Column) -> Column:
            out, run, n = [], "", 0
            for p in self.parts:
                if isinstance(p, str):
                    run += p
                    continue
                out += [F.lit(run)] * bool(run) + [F.get(row, F.lit(n))]
                run, n = "", n + 1
            return F.concat(*out, F.lit(run))

        joined = lambda rows: F.call_function("array_join", F.transform(rows, segment), F.lit(""))
        if not rules:
            return joined(values)
        found = F.call_function("array_join", F.flatten(values), F.lit("")).rlike(_special(self.spec, ()))
        return F.when(found, joined(F.transform(values, lambda row: each(row, f"(t, i) -> {by_rule}")))).otherwise(joined(values))


def _encoding_chars(spec: DelimitedSpec) -> str:
    return "".join(spec.defaults[r] for r in spec.encoding_order)


class DelimitedBuilder:
    """A new HL7 or ASTM message with the format's default delimiters."""

    def __init__(self, spec: DelimitedSpec):
        self.spec, self.order = spec, []

    def _segment(self, name: str, occ: int) -> SegmentBuilder:
        same = [i for i, s in enumerate(self.order) if isinstance(s, SegmentBuilder) and s.name == name]
        while len(same) < occ:
            at = same[-1] + 1 if same else len(self.order)
            self.order.insert(at, SegmentBuilder(self.spec, name))
            same = [i for i, s in enumerate(self.order) if isinstance(s, SegmentBuilder) and s.name == name]
        return self.order[same[occ - 1]]

    def set(self, path: str, value) -> "DelimitedBuilder":
        p = compile_path(self.spec, path)
        if not p.field:
            raise ValueError(f"{self.spec.name}: path {path}: set requires a field or deeper")
        seg = self._segment(p.seg, max(p.occ, 1))
        if p.field > self.spec.raw_fields(p.seg):
            seg.set(path[path.index("-") + 1:], value)
        return self

    def repeat(self, name: str, over: Column, fill) -> "DelimitedBuilder":
        """One segment per element of an array column.

        ``fill(segment_builder, element, index)`` sets fields relative to the
        new segment, index counts from 0."""

        self.order.append(_Repeat(self.spec, name, over, fill))
        return self

    def text(self) -> Column:
        return self._text(lambda r: let(r.values, r.text))

    def add_to(self, df: DataFrame, name: str) -> DataFrame:
        """The text as a column; the leaves of repeated segments are a column of a projection before it, not bound by a
        function, which would copy them."""
        given, names = df.columns, {}
        for r in (s for s in self.order if isinstance(s, _Repeat)):
            names[r] = f"__{name}_{len(names)}"
        text = self._text(lambda r: r.text(F.col(names[r])))
        return df.select(*given, *(r.values.alias(n) for r, n in names.items())).withColumn(name, text).drop(*names.values())

    def _text(self, repeated) -> Column:
        runs = [[]]
        for s in self.order:
            if isinstance(s, SegmentBuilder):
                runs[-1] += [*s.parts(), "\r"]
            else:
                runs += [repeated(s), []]
        return _concat([_encoded_row(r, self.spec) if isinstance(r, list) else r for r in runs if not isinstance(r, list) or r])


class CsvBuilder:
    """A CSV document of a fixed number of rows."""

    def __init__(self):
        self.rows: dict[int, dict[int, Column]] = {}

    def set(self, path: str, value) -> "CsvBuilder":
        from ..paths import csv_path
        row, col = csv_path(path)
        if not col:
            raise ValueError(f'csv: path "{path}": set requires a column')
        self.rows.setdefault(row or 1, {})[col] = text_or_empty(value)
        return self

    def text(self) -> Column:
        out = []
        for r in range(1, max(self.rows) + 1):
            cells = self.rows.get(r, {})
            width = max(cells, default=0)
            out += [csv_row(F.array(*(cells.get(c, F.lit("")) for c in range(1, width + 1))) if width
                            else F.array().cast("array<string>")), F.lit("\n")]
        return _concat(out)


class JsonBuilder:
    """A JSON document; ``when`` makes a member depend on the row.

    The document is a table of paths.  Its shape follows from it: steps that are numbers make an array, steps that are
    names an object; a value set on a path replaces what was below it, and a longer path the value above it.  Keys keep
    the order in which they were first set, arrays are padded with null up to the highest present element."""

    def __init__(self):
        self.leaves: dict[tuple, tuple] = {}
        self.values: list[Column] = []
        self.place: dict[tuple, int] = {}  # every path and its beginnings, by first use

    def _next_steps(self, path: tuple) -> list:
        n = len(path)
        return sorted({p[n] for p in self.leaves if len(p) > n and p[:n] == path}, key=lambda s: self.place[(*path, s)])

    def set(self, path: str, value, when: Column | None = None) -> "JsonBuilder":
        at: tuple = ()
        for step in json_steps(path):
            known = self._next_steps(at)
            if known and isinstance(step, int) != isinstance(known[0], int):
                if isinstance(step, int):
                    raise ValueError(f'json: path "{path}": [{step}] applied to an object with keys')
                # a name on an array means its first element
                at = (*at, min(known))
                inner = self._next_steps(at)
                if inner and isinstance(inner[0], int):
                    raise ValueError(f'json: path "{path}": key "{step}" applied to nested arrays')
            at = (*at, step)
        self.leaves = {p: v for p, v in self.leaves.items() if p[:len(at)] != at and at[:len(p)] != p}
        for n in range(1, len(at) + 1):
            self.place.setdefault(at[:n], len(self.place))
        leaf = _json_constant(value)
        if leaf is None:
            leaf = len(self.values)
            self.values.append(text_or_empty(value))
        self.leaves[at] = leaf, when
        return self

    def text(self) -> Column:
        return self._render(())[0]

    def _render(self, path: tuple) -> tuple[Column, Column | None]:
        """(text, present) of what is at a path, where present None means always."""
        if path in self.leaves:
            leaf, when = self.leaves[path]
            return (F.lit(leaf) if isinstance(leaf, str) else json_quote(self.values[leaf])), when
        parts = {s: self._render((*path, s)) for s in self._next_steps(path)}
        if not parts:
            return F.lit("{}"), None
        any_of = lambda conds: None if any(c is None for c in conds) else reduce(lambda a, b: a | b, conds)
        only = lambda text, cond: text if cond is None else F.when(cond, text)
        present = any_of([p for _, p in parts.values()])
        if all(isinstance(s, str) for s in parts):
            members = [only(F.concat(F.lit(json_string(s) + ":"), t), p) for s, (t, p) in parts.items()]
            return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")), present
        cells = []
        for i in range(max(parts) + 1):
            text, cond = parts.get(i, (F.lit("null"), None))
            filled = text if cond is None else F.when(cond, text).otherwise(F.lit("null"))
            cells.append(only(filled, any_of([p for s, (_, p) in parts.items() if s >= i])))
        return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")), present


def _json_constant(value) -> str | None:
    """JSON text of a Python scalar, which keeps its type; None for columns."""
    if isinstance(value, Column):
        return None
    return json_string(value) if isinstance(value, str) else json.dumps(value)


class _Xml:
    def __init__(self, name):
        self.name, self.attrs, self.text, self.children = name, {}, None, []


class XmlBuilder:
    """An XML document with one root element."""

    def __init__(self):
        self.doc = None

    def set(self, path: str, value) -> "XmlBuilder":
        steps = xml_steps(path)
        cur = None
        for name, occ, is_attr in steps:
            if is_attr:
                if cur is None:
                    raise ValueError(f'xml: path "{path}": cannot set an attribute on the document root')
                cur.attrs[name] = text_or_empty(value)
                return self
            if cur is None:
                if self.doc is None:
                    self.doc = _Xml(name)
                if self.doc.name != name or occ > 1:
                    raise ValueError(f'xml: path "{path}": document element is "{self.doc.name}"')
                cur = self.doc
                continue
            same = [c for c in cur.children if c.name == name]
            while len(same) < max(occ, 1):
                same.append(_Xml(name))
                cur.children.append(same[-1])
            cur = same[max(occ, 1) - 1]
        cur.text, cur.children = text_or_empty(value), []
        return self

    def text(self) -> Column:
        return self._render(self.doc)

    def _render(self, n: _Xml) -> Column:
        head = [F.lit("<" + n.name)]
        for k, v in n.attrs.items():
            head += [F.lit(f' {k}="'), xml_attr(v), F.lit('"')]
        close = F.lit(f"</{n.name}>")
        if n.children:
            body = [self._render(c) for c in n.children]
            own = [xml_text(n.text)] if n.text is not None else []
            return _concat([*head, F.lit(">"), *own, *body, close])
        if n.text is None:
            return _concat([*head, F.lit("/>")])
        return F.concat(*head, F.when(n.text == "", F.lit("/>")).otherwise(
            F.concat(F.lit(">"), xml_text(n.text), close)))


def new_message(data_type: str):
    """An empty message of a registered format, to be filled with ``set``."""
    if data_type in SPECS:
        return DelimitedBuilder(SPECS[data_type])
    made = {"csv": CsvBuilder, "json": JsonBuilder, "xml": XmlBuilder}.get(data_type)
    if made is None:
        known = sorted([*SPECS, "csv", "json", "xml"])
        raise ValueError(f'newMessage: unknown data type "{data_type}" (registered: {known})')
    return made()
