"""Writes on parsed CSV, JSON and XML messages, and their text.

A node array is a tree in document order, so a write is one splice: the path is walked down as far as the message goes,
and one run of nodes (a subtree, or nothing at the end of one) gives way to the nodes of what is left of the path.  The
shape of those is known while the query is built.  All of it is column work on the row's own array, linear in its nodes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..paths import json_key_text, json_steps, xml_steps
from .columns import bind, each, let, text_or_empty
from .scalars import json_quote_sql, xml_attr, xml_text

NODE = "struct<path:string,value:string,kind:string,name:string,depth:int,up:string,at:int>"
NODES = f"array<{NODE}>"


def no_error() -> Column:
    return F.lit(None).cast("string")


def numbered(nodes: Column) -> Column:
    return each(nodes, "(x, i) -> named_struct('path', x.path, 'value', x.value, 'kind', x.kind, 'name', x.name, 'depth', x.depth, 'up', x.up, 'at', i)")


def end_of(ns: Column, at: Column) -> Column:
    """The position behind the subtree that begins at ``at``."""
    behind = lambda depth: F.get(F.filter(F.slice(ns, at + 2, F.size(ns)), lambda y: y["depth"] <= depth), F.lit(0))["at"]
    return F.coalesce(let(F.get(ns, at)["depth"], behind), F.size(ns))


def between(ns: Column, begin: Column, end: Column) -> Column:
    return F.slice(ns, begin + 1, F.greatest(end - begin, F.lit(0)))


def subtree(ns: Column, at: Column) -> Column:
    """The nodes of a subtree, still with the positions they have in the message."""
    return between(ns, at, end_of(ns, at))


def children(ns: Column, at: Column) -> Column:
    """The direct children of the node at ``at``."""
    return let(F.get(ns, at)["depth"] + 1, lambda depth: F.filter(between(ns, at + 1, end_of(ns, at)), lambda y: y["depth"] == depth))


def _done(nodes: Column, error: Column | None = None) -> Column:
    return F.struct((no_error() if error is None else error).alias("error"), nodes.alias("nodes"))


# ---- text -------------------------------------------------------------------

def render(fmt: str, nodes: Column) -> Column:
    """The text of a message or a subtree; the first node's own key or position is left out."""
    return let(nodes, _json_text if fmt == "json" else _xml_text)


def _after(ns: Column, i: Column) -> Column:
    """The depth of the next node; behind the last one that of the first."""
    return F.coalesce(F.get(ns, i + 1)["depth"], F.get(ns, F.lit(0))["depth"])


def _json_text(ns: Column) -> Column:
    # strings and keys are quoted by one expression each
    quoted = each(ns, "x -> named_struct('v', CASE WHEN x.kind = 'string' THEN " + json_quote_sql("x.value") + " END, 'k', CASE WHEN x.up LIKE '}%' THEN "
                  + json_quote_sql("x.name") + " END)")

    def piece(x, i, q):
        first = F.lit(0) == i
        comma = F.when(first | (x["depth"] > F.get(ns, i - 1)["depth"]), F.lit("")).otherwise(F.lit(","))
        key = F.when(first | ~x["up"].startswith("}"), F.lit("")).otherwise(F.concat(q["k"], F.lit(":")))
        body = F.when(x["kind"] == "object", F.lit("{")).when(x["kind"] == "array", F.lit("[")).when(x["kind"] == "string", q["v"]) \
            .when(x["kind"] == "null", F.lit("null")).otherwise(x["value"])

        def closed(depth):
            # a container without children ends at once; then the ancestors that end here
            own = F.when((depth <= x["depth"]) & (x["kind"] == "object"), F.lit("}")).when((depth <= x["depth"]) & (x["kind"] == "array"), F.lit("]")).otherwise(F.lit(""))
            return F.concat(own, F.substring(x["up"], F.lit(1), F.greatest(x["depth"] - depth, F.lit(0))))

        return F.concat(comma, key, body, let(_after(ns, i), closed))

    return let(quoted, lambda qs: F.array_join(F.transform(ns, lambda x, i: piece(x, i, F.get(qs, i))), ""))


def _xml_text(ns: Column) -> Column:
    def closers(up: Column, n: Column) -> Column:
        return F.when(n <= 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", up, F.lit(">"), n), F.lit(">")))

    def piece(x, i):
        nxt = F.get(ns, i + 1)
        # what ends a start tag: another attribute goes on, an empty value closes the element
        head = F.when(nxt["kind"] == "attr", F.lit("")).when((nxt["kind"] == "simple") & (nxt["value"] == ""), F.lit("/>")).otherwise(F.lit(">"))
        ends = let(x["depth"] - _after(ns, i), lambda n: closers(x["up"], n))
        empty = (x["kind"] == "simple") & (x["value"] == "")
        return F.when(x["kind"].isin("element", "tag"), F.concat(F.lit("<"), x["name"], head)) \
            .when(x["kind"] == "attr", F.when(i == 0, x["value"]).otherwise(F.concat(F.lit(" "), x["name"], F.lit('="'), xml_attr(x["value"]), F.lit('"'), head))) \
            .when(empty, let(ends, lambda e: F.substring(e, F.locate(">", e) + 1, F.length(e)))).otherwise(F.concat(xml_text(x["value"]), ends))

    return F.array_join(F.transform(ns, piece), "")


# ---- writes -----------------------------------------------------------------
#
# Writes are data: an array of (path, steps, value), folded over the message by one expression of constant size, however
# many writes there are and however long their paths.  The SQL below names the message ``m`` and a write ``w``.

_EDITED = f"struct<error:string,nodes:{NODES}>"
_WRITES = {"json": "array<struct<path:string,steps:array<struct<key:string,idx:int,text:string>>,kind:string,value:string>>",
           "xml": "array<struct<path:string,root:string,steps:array<struct<name:string,occ:int>>,attr:string,value:string>>"}


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _end(i: str) -> str:
    return f"coalesce(get(filter(slice(m.nodes, {i} + 2, size(m.nodes)), y -> y.depth <= m.nodes[{i}].depth), 0).at, size(m.nodes))"


def _kids(i: str) -> str:
    return f"filter(slice(m.nodes, {i} + 2, {_end(i)} - {i} - 1), y -> y.depth = m.nodes[{i}].depth + 1)"


def _has_kids(i: str) -> str:
    return f"coalesce(get(m.nodes, {i} + 1).depth > m.nodes[{i}].depth, false)"


def _at(at: str, used: str = "st.used", stop: str = "NULL", have: str = "0") -> str:
    return f"named_struct('at', {at}, 'used', {used}, 'stop', CAST({stop} AS STRING), 'have', {have})"


def _new(path: str, value: str, kind: str, name: str, depth: str, up: str) -> str:
    return f"named_struct('path', {path}, 'value', {value}, 'kind', {kind}, 'name', {name}, 'depth', {depth}, 'up', {up}, 'at', 0)"


def _renumbered(nodes: str) -> str:
    return (f"transform({nodes}, (x, i) -> named_struct('path', x.path, 'value', x.value, 'kind', x.kind, 'name', x.name, "
            "'depth', x.depth, 'up', x.up, 'at', i))")


def _splice(begin: str, end: str, new: str) -> str:
    nodes = _renumbered(f"concat(slice(m.nodes, 1, {begin}), {new}, slice(m.nodes, {end} + 1, size(m.nodes)))")
    return f"CAST(named_struct('error', m.error, 'nodes', {nodes}) AS {_EDITED})"


def _failed(text: str) -> str:
    return f"CAST(named_struct('error', coalesce(m.error, {text}), 'nodes', m.nodes) AS {_EDITED})"


def _json_write() -> str:
    index = (f"CASE WHEN m.nodes[st.at].kind = 'object' AND {_has_kids('st.at')} THEN "
             + _at("st.at", stop="""concat('json: path "', w.path, '": [', s.idx, '] applied to an object with keys')""")
             + f" WHEN m.nodes[st.at].kind != 'array' THEN {_at('st.at', stop=chr(39) + 'replace' + chr(39))} ELSE "
             + _let(_kids("st.at"), "k", f"IF(size(k) > s.idx, {_at('get(k, s.idx).at', 'st.used + 1')}, {_at('st.at', stop=chr(39) + 'insert' + chr(39), have='size(k)')})") + " END")
    member = _let(f"get(filter({_kids('c')}, y -> y.name = s.key), 0).at", "f", f"IF(f IS NULL, {_at('c', stop=chr(39) + 'insert' + chr(39))}, {_at('f', 'st.used + 1')})")
    # a key on an array with elements means its first element
    key = _let(f"IF(m.nodes[st.at].kind = 'array' AND {_has_kids('st.at')}, st.at + 1, st.at)", "c",
               f"CASE WHEN c != st.at AND m.nodes[c].kind = 'array' AND {_has_kids('c')} THEN "
               + _at("c", stop="""concat('json: path "', w.path, '": key "', s.key, '" applied to nested arrays')""")
               + f" WHEN m.nodes[c].kind != 'object' THEN {_at('c', stop=chr(39) + 'replace' + chr(39))} ELSE {member} END")
    walk = f"aggregate(w.steps, {_at('0', '0')}, (st, s) -> CASE WHEN st.stop IS NOT NULL THEN st WHEN s.key IS NULL THEN {index} ELSE {key} END)"
    # what is left of the path, as nodes below x; elements in between are null
    path = lambda n: f"ltrim('.', concat(x.path, array_join(transform(slice(rest, 1, {n}), r -> r.text), '')))"
    up = "concat(array_join(reverse(transform(slice(rest, 1, j + 1), r -> IF(r.key IS NULL, ']', '}'))), ''), x.up)"
    pads = ("IF(s.key IS NULL AND IF(j = 0, st.have, 0) < s.idx, transform(sequence(IF(j = 0, st.have, 0), greatest(s.idx - 1, IF(j = 0, st.have, 0))), o -> "
            + _new(f"concat({path('j')}, '[', o, ']')", "''", "'null'", "concat('[', o, ']')", "x.depth + 1 + j", up) + f"), {_none()})")
    own = _new(path("j + 1"), "IF(j = size(rest) - 1, w.value, NULL)", "CASE WHEN j = size(rest) - 1 THEN w.kind WHEN rest[j + 1].key IS NULL THEN 'array' ELSE 'object' END",
               "coalesce(s.key, concat('[', s.idx, ']'))", "x.depth + 1 + j", up)
    below = f"flatten(transform(rest, (s, j) -> concat({pads}, array({own}))))"
    box = lambda kind, value: f"array({_new('x.path', value, kind, 'x.name', 'x.depth', 'x.up')})"
    new = (f"CASE st.stop WHEN 'insert' THEN {below} WHEN 'replace' THEN concat({box('IF(rest[0].key IS NULL, ' + chr(39) + 'array' + chr(39) + ', ' + chr(39) + 'object' + chr(39) + ')', 'CAST(NULL AS STRING)')}, {below}) "
           f"ELSE {box('w.kind', 'w.value')} END")
    put = _let("m.nodes[st.at]", "x", _let("slice(w.steps, st.used + 1, size(w.steps))", "rest", _let(
        _end("st.at"), "e", _splice("IF(st.stop <=> 'insert', e, st.at)", "e", new))))
    return _let(walk, "st", f"IF(st.stop IS NULL OR st.stop IN ('insert', 'replace'), {put}, {_failed('st.stop')})")


def _none() -> str:
    return f"CAST(array() AS {NODES})"


def _xml_write() -> str:
    step = _let(f"filter({_kids('st.at')}, y -> y.kind IN ('element', 'tag') AND y.name = s.name)", "k",
                f"IF(size(k) >= s.occ, {_at('get(k, s.occ - 1).at', 'st.used + 1')}, {_at('st.at', stop=chr(39) + 'insert' + chr(39), have='size(k)')})")
    walk = f"aggregate(w.steps, {_at('0', '0')}, (st, s) -> IF(st.stop IS NOT NULL, st, {step}))"
    text = "concat('/', r.name, IF(r.occ > 1, concat('[', r.occ, ']'), ''))"
    path = lambda n: f"concat(x.path, array_join(transform(slice(rest, 1, {n}), r -> {text}), ''))"
    up = lambda n: f"concat(array_join(reverse(transform(slice(rest, 1, {n}), r -> concat('</', r.name, '>'))), ''), '</', x.name, '>', x.up)"
    have = "IF(j = 0, st.have, 0)"
    o_path = f"concat({path('j')}, '/', s.name, IF(o > 1, concat('[', o, ']'), ''))"
    empty = (f"array({_new(o_path, 'CAST(NULL AS STRING)', chr(39) + 'tag' + chr(39), 's.name', 'x.depth + 1 + j', up('j'))}, "
             f"{_new(o_path, chr(39) * 2, chr(39) + 'simple' + chr(39), chr(39) * 2, 'x.depth + 2 + j', 'concat(' + chr(39) + '</' + chr(39) + ', s.name, ' + chr(39) + '>' + chr(39) + ', ' + up('j') + ')')})")
    pads = f"IF({have} + 1 < s.occ, flatten(transform(sequence({have} + 1, greatest(s.occ - 1, {have} + 1)), o -> {empty})), {_none()})"
    start = _new(path("j + 1"), "CAST(NULL AS STRING)", "IF(j = size(rest) - 1, 'tag', 'element')", "s.name", "x.depth + 1 + j", up("j"))
    chain = f"flatten(transform(rest, (s, j) -> concat({pads}, array({start}))))"
    n = "size(rest)"
    simple = lambda value: _new(path(n), value, "'simple'", "''", f"x.depth + 1 + {n}", up(n))
    mark = _new(f"concat({path(n)}, '/@', w.attr)", "w.value", "'attr'", "w.attr", f"x.depth + 1 + {n}", up(n))
    tail = f"IF(w.attr IS NULL, array({simple('w.value')}), array({mark}, {simple(chr(39) * 2)}))"
    as_kind = lambda kind: f"array({_new('x.path', 'CAST(NULL AS STRING)', kind, 'x.name', 'x.depth', 'x.up')})"
    attrs = "filter(sub, y -> y.depth = x.depth + 1 AND y.kind = 'attr')"
    # an element of simple content loses it to its first child
    content = "filter(sub, y -> NOT (y.depth = x.depth + 1 AND y.kind IN ('attr', 'simple')))"
    quote = lambda t: f"'{t}'"
    grown = _splice("st.at", "e", f"concat({as_kind(quote('element'))}, {attrs}, {content}, {chain}, {tail})")
    replaced = _splice("st.at", "e", f"concat({as_kind(quote('tag'))}, {attrs}, {tail})")
    marked = _let(f"named_struct('known', get(filter({attrs}, y -> y.name = w.attr), 0).at, 'behind', st.at + 1 + size({attrs}))", "a",
                  _splice("coalesce(a.known, a.behind)", "coalesce(a.known + 1, a.behind)", f"array({mark})"))
    put = _let("m.nodes[st.at]", "x", _let("slice(w.steps, st.used + 1, size(w.steps))", "rest", _let(_end("st.at"), "e", _let(
        "slice(m.nodes, st.at + 2, e - st.at - 1)", "sub", f"CASE WHEN st.stop IS NOT NULL THEN {grown} WHEN w.attr IS NULL THEN {replaced} ELSE {marked} END"))))
    wrong = """concat('xml: path "', w.path, '": document element is "', m.nodes[0].name, '"')"""
    return f"IF(w.root IS NOT NULL AND m.nodes[0].name != w.root, {_failed(wrong)}, {_let(walk, 'st', put)})"


def _json_leaf(value) -> tuple[Column, Column]:
    """(kind, literal text) of a value, which keeps its type."""
    if not isinstance(value, Column):
        if value is None:
            return F.lit("null"), F.lit("")
        if isinstance(value, str):
            return F.lit("string"), F.lit(value)
        return F.lit("bool" if isinstance(value, bool) else "number"), F.lit(json.dumps(value))
    # the type of a column is known to the optimizer, which folds this away
    kind, text = F.typeof(value), value.cast("string")
    whole = kind.isin("double", "float") & text.rlike(r"^-?\d+\.0$")
    number = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    # a number that JSON cannot write is its text
    name = F.when(value.isNull(), "null").when(kind == "boolean", "bool").when(number & text.rlike(r"^-?[0-9]"), "number").otherwise("string")
    return name, F.coalesce(F.when(whole, F.regexp_replace(text, r"\.0$", "")).otherwise(text), F.lit(""))


def json_edit(path: str, value) -> Column:
    """A write as a row of data."""
    kind, text = _json_leaf(value)
    one = lambda s: F.struct(F.lit(None if isinstance(s, int) else s).cast("string").alias("key"), F.lit(s if isinstance(s, int) else None).cast("int").alias("idx"),
                             F.lit(f"[{s}]" if isinstance(s, int) else json_key_text("x", s)[1:]).alias("text"))
    return F.struct(F.lit(path).alias("path"), F.array(*map(one, json_steps(path))).alias("steps"), kind.alias("kind"), text.alias("value"))


def xml_edit(path: str, value, inside: bool = False) -> Column:
    """A write as a row of data; ``inside`` a unit the path begins below its first node."""
    steps = xml_steps(path)
    for name, _, _ in steps:
        if re.search(r"[<>&\"'=/ \t\n\r]", name):
            raise ValueError(f'xml: path "{path}": invalid name "{name}"')
    if not inside and steps[0][2]:
        raise ValueError(f'xml: path "{path}": cannot set an attribute on the document root')
    # a second document element is never there: its name cannot be one
    root = None if inside else steps[0][0] if steps[0][1] <= 1 else ""
    down = [(n, max(o, 1)) for n, o, is_attr in steps[0 if inside else 1:] if not is_attr]
    attr = steps[-1][0] if steps[-1][2] else None
    one = lambda s: F.struct(F.lit(s[0]).alias("name"), F.lit(s[1]).alias("occ"))
    return F.struct(F.lit(path).alias("path"), F.lit(root).cast("string").alias("root"), F.array(*map(one, down)).cast("array<struct<name:string,occ:int>>").alias("steps"),
                    F.lit(attr).cast("string").alias("attr"), text_or_empty(value).alias("value"))


def edited(fmt: str, nodes: Column, writes: list[Column]) -> Column:
    """(error, nodes) after writes one after the other; nodes must be numbered from 0."""
    start = F.struct(no_error().alias("error"), nodes.alias("nodes")).cast(_EDITED)
    body = _json_write() if fmt == "json" else _xml_write()
    return F.call_function("aggregate", F.array(*writes).cast(_WRITES[fmt]), start, F.expr(f"(m, w) -> IF(m.error IS NOT NULL OR size(m.nodes) = 0, m, {body})"))


# ---- units ----------------------------------------------------------------------

def each_unit(ns: Column, units: Column, write: Callable) -> Column:
    """(error, nodes) with every unit written: the message is cut at the units' first nodes, each cut's subtree is given to
    ``write(sub, i, subs)`` for an (error, nodes), and the parts are put together again."""
    def cut(us: Column) -> Column:
        until = lambda i: F.coalesce(F.get(us, i + 1)["at"], F.size(ns))
        sub = lambda i: let(between(ns, F.get(us, i)["at"], until(i)), lambda part: between(part, F.lit(0), behind(part)))
        subs = lambda k: F.size(us) if k is None else sub(F.lit(k))

        def behind(part):
            # a cut's subtree ends where a node is as high as its first
            depth = F.get(part, F.lit(0))
            return let(F.get(F.filter(F.slice(part, F.lit(2), F.size(part)), lambda y: y["depth"] <= depth["depth"]), F.lit(0))["at"] - depth["at"],
                       lambda n: F.coalesce(n, F.size(part)))

        def one(u, i):
            def split(part):
                return let(behind(part), lambda n: let(write(between(part, F.lit(0), n), i, subs), lambda done: F.struct(
                    done["error"].alias("error"), F.concat(done["nodes"], between(part, n, F.size(part))).alias("nodes"))))
            return let(between(ns, u["at"], until(i)), split)

        def joined(parts):
            error = F.get(F.filter(F.transform(parts, lambda p: p["error"]), lambda e: e.isNotNull()), F.lit(0))
            before = between(ns, F.lit(0), F.get(us, F.lit(0))["at"])
            return F.when(error.isNotNull(), _done(ns, error)).otherwise(_done(numbered(F.concat(before, F.flatten(F.transform(parts, lambda p: p["nodes"]))))))

        return F.when(F.size(us) == 0, _done(ns)).otherwise(let(F.transform(us, one), joined))

    return let(units, cut)


def relative_get(fmt: str, nodes: Column, rel: str) -> Column:
    """The first match of a path relative to a unit's first node (numbered from 0), a branch as text."""
    if fmt == "json":
        steps = F.array(*(F.struct(F.lit(None if isinstance(s, int) else s).cast("string").alias("key"), F.lit(s if isinstance(s, int) else None).cast("int").alias("idx"))
                          for s in json_steps(rel)))
        own = f"IF(m.nodes[a].kind = 'array', transform({_kids('a')}, y -> y.at), array(a))"
        step = (f"IF(s.key IS NULL, transform(filter(ats, a -> m.nodes[a].kind = 'array'), a -> get({_kids('a')}, s.idx).at), "
                f"flatten(transform(flatten(transform(ats, a -> {own})), a -> transform(filter({_kids('a')}, y -> y.name = s.key AND m.nodes[a].kind = 'object'), y -> y.at))))")
    else:
        steps = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(o).alias("occ"), F.lit(is_attr).alias("attr")) for n, o, is_attr in xml_steps(rel)))
        same = f"filter({_kids('a')}, y -> y.name = s.name AND IF(s.attr, y.kind = 'attr', y.kind IN ('element', 'tag', 'text')))"
        step = f"flatten(transform(ats, a -> transform(IF(s.occ > 0, slice({same}, greatest(s.occ, 1), 1), {same}), y -> y.at)))"
    found = f"aggregate(m.steps, array(0), (ats, s) -> filter({step}, a -> a IS NOT NULL))"
    if fmt == "json":
        found = f"filter(transform({found}, a -> IF(m.nodes[a].kind = 'array', get({_kids('a')}, 0).at, a)), a -> a IS NOT NULL)"
    ahead = bind(F.struct(nodes.alias("nodes"), steps.alias("steps")), f"m -> named_struct('nodes', m.nodes, 'at', get({found}, 0))")

    def shown(x):
        node = F.get(x["nodes"], x["at"])
        simple = F.get(F.filter(children(x["nodes"], x["at"]), lambda y: y["kind"] == "simple"), F.lit(0))["value"]
        return F.when(x["at"].isNull(), no_error()).when(node["kind"] == "tag", simple) \
            .when(node["kind"].isin("object", "array", "element"), render(fmt, subtree(x["nodes"], x["at"]))).otherwise(node["value"])

    return let(ahead, shown)


# ---- CSV ------------------------------------------------------------------------

def cell_set(row: Column, col: int, value) -> Column:
    text = text_or_empty(value)
    padded = F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(col) - F.size(row), F.lit(0))))
    return F.transform(padded, lambda x, i: F.when(i == col - 1, text).otherwise(x))


def csv_set(rows: Column, row: int, col: int, value) -> Column:
    empty = F.array().cast("array<string>")
    padded = F.concat(rows, F.array_repeat(empty, F.greatest(F.lit(row) - F.size(rows), F.lit(0))))
    return F.transform(padded, lambda r, i: F.when(i == row - 1, cell_set(r, col, value)).otherwise(r))
