"""Delimiter-based wire formats (HL7 v2, ASTM E1394) as Column expressions.

A message is parsed once into a struct column

    error     STRING            why the text is no message, NULL when it is one
    bytewise  BOOLEAN           text was read one byte per character
    d         STRUCT<field, rep, comp, sub, esc>
    segs      ARRAY<ARRAY<STRING>>

where ``segs[i][0]`` is the segment name and ``segs[i][n]`` is field n, still
in its wire form.  Header segments keep the separator itself as field 1 and
the encoding characters as field 2, so the index is the field number for every
segment.  Lower levels are split on demand, and all of it is array work inside
one row: reading a value never shuffles.

The separators come from each message's own header.  Spark's ``split`` has a
regex-free path for a backslash followed by one non-alphanumeric character,
so a per-row separator costs no pattern compilation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_col, bind, let, materialise, sql_text, text_or_empty

CONTROL = r"[\x00-\x1f]"


@dataclass(frozen=True)
class DelimitedSpec:
    """What distinguishes one delimiter-based format from another."""

    name: str
    name_pattern: str
    name_len: int
    headers: tuple[str, ...]
    header_hint: str
    defaults: dict[str, str]
    encoding_order: tuple[str, ...]
    escapes: dict[str, str]
    has_sub: bool
    header_raw: int = 2
    path_re: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        sub = r"(?:\.([1-9]\d*))?" if self.has_sub else "()"
        idx = r"(?:\[([1-9]\d*)\])?"
        object.__setattr__(self, "path_re", re.compile(
            rf"({self.name_pattern}){idx}(?:-([1-9]\d*){idx}(?:\.([1-9]\d*){sub})?)?"))

    def __hash__(self):
        return hash(self.name)

    def raw_fields(self, segment: str) -> int:
        return self.header_raw if segment in self.headers else 0


# Fixed values of the two standards: header names, default delimiters, the
# order of the encoding characters, and the escape bodies.
HL7V2 = DelimitedSpec(
    name="hl7v2",
    name_pattern="[A-Z][A-Z0-9]{2}",
    name_len=3,
    headers=("MSH", "BHS", "FHS"),
    header_hint="MSH, BHS, or FHS",
    defaults={"field": "|", "rep": "~", "comp": "^", "sub": "&", "esc": "\\"},
    encoding_order=("comp", "rep", "esc", "sub"),
    escapes={"F": "field", "S": "comp", "T": "sub", "R": "rep", "E": "esc"},
    has_sub=True,
)
ASTM = DelimitedSpec(
    name="astm",
    name_pattern="[A-Z]",
    name_len=1,
    headers=("H",),
    header_hint="H",
    defaults={"field": "|", "rep": "\\", "comp": "^", "sub": "", "esc": "&"},
    encoding_order=("rep", "comp", "esc"),
    escapes={"F": "field", "R": "rep", "S": "comp", "E": "esc"},
    has_sub=False,
)
SPECS = {s.name: s for s in (HL7V2, ASTM)}


@dataclass(frozen=True)
class Path:
    """SEG[occ]-field[rep].comp.sub; 0 means the index was not written."""

    seg: str
    occ: int = 0
    field: int = 0
    rep: int = 0
    comp: int = 0
    sub: int = 0


def compile_path(spec: DelimitedSpec, path: str) -> Path:
    m = spec.path_re.fullmatch(path)
    if m is None:
        hint = "SEG[occ]-field[rep].component" + (".subcomponent" if spec.has_sub else "")
        raise ValueError(f'{spec.name}: invalid path "{path}" (expected {hint})')
    return Path(m[1], *(int(g or 0) for g in m.groups()[1:]))


# ---- small column helpers -------------------------------------------------

def split_on(text: Column, sep: Column) -> Column:
    """Split at a literal one-character separator held in a column."""
    return F.split(text, F.concat(F.lit("\\"), sep))


def join_with(parts: Column, sep: Column) -> Column:
    return F.call_function("array_join", parts, sep)


def replace_all(text: Column, old, new) -> Column:
    return F.replace(text, as_col(old), as_col(new))


def pad_to(arr: Column, n: int) -> Column:
    """Right-pad a string array with '' up to n elements."""
    return F.when(F.size(arr) >= n, arr).otherwise(
        F.concat(arr, F.array_repeat(F.lit(""), F.lit(n) - F.size(arr))))


def delims_lit(spec: DelimitedSpec) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in spec.defaults.items()))


# ---- escape sequences -----------------------------------------------------
#
# Both directions cut the text into tokens with one regular expression built
# from the message's delimiters and map the tokens.  A sequence never spans a
# separator, so the token pattern may run over a whole field at once and still
# treat every leaf on its own.

def _quoted(d: Column, roles) -> list[Column]:
    return [F.concat(F.lit("\\"), d[r]) for r in roles]


def _text(*parts) -> Column:
    return F.concat(*(as_col(p) for p in parts))


def _tokens(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(1))


def unescape(text: Column, d: Column, spec: DelimitedSpec, bytewise: Column | None = None,
             inside: tuple[str, ...] = ()) -> Column:
    """Expand escape sequences; unknown and unterminated ones stay verbatim.

    ``inside`` names the separators that structure ``text`` below its level.
    """
    (esc,) = _quoted(d, ["esc"])
    pattern = _text("(", esc, "[^", esc, *_quoted(d, inside), "]*", esc, "|[^", esc, "]+|", esc, ")")

    letters = "".join(spec.escapes)

    def decoded(tok):
        raw = F.unhex(F.call_function("substring", tok, F.lit(3), F.length(tok) - 3))
        as_text = raw.cast("string")
        if bytewise is not None:
            as_text = F.when(bytewise, F.decode(raw, "ISO-8859-1")).otherwise(as_text)
        return (F.when(~F.startswith(tok, d["esc"]), tok)
                .when(tok.rlike(rf"(?s)^.[{letters}].$"),
                      F.call_function("translate", F.substring(tok, 2, 1), F.lit(letters), _delims(d, spec)))
                .when(tok.rlike(r"(?s)^.X([0-9A-Fa-f]{2})+.$"), as_text)
                .otherwise(tok))

    return F.array_join(F.transform(_tokens(text, pattern), decoded), "")


def _delims(d: Column, spec: DelimitedSpec) -> Column:
    """The delimiters as one string, in the order of the escape letters."""
    return F.concat(*(d[r] for r in spec.escapes.values()))


def _needs_encoding(text: Column, d: Column, spec: DelimitedSpec) -> Column:
    tests = [F.contains(text, d[r]) for r in spec.escapes.values()]
    return reduce(lambda a, b: a | b, tests, text.rlike(CONTROL))


def escape(text: Column, d: Column, spec: DelimitedSpec, keep: tuple[str, ...] = ()) -> Column:
    """Inverse of :func:`unescape`: delimiters and control characters become
    sequences.

    A sequence unescape kept verbatim is emitted untouched when nothing inside
    it needs encoding.  ``keep`` names separators that are structure here and
    stay as they are.
    """
    (esc,) = _quoted(d, ["esc"])
    special = [esc, *_quoted(d, [r for r in spec.escapes.values() if r != "esc"]), r"\x00-\x1f"]
    known = "|".join(spec.escapes)
    pattern = _text("(", esc, f"(?!(?:{known}|X(?:[0-9A-Fa-f]{{2}})+)", esc, ")[^", *special, "]*", esc,
                    "|[^", *special, "]+|[", *special, "])")

    letters = "".join(spec.escapes)

    def encoded(tok):
        coded = (F.when(F.contains(_delims(d, spec), tok), F.call_function("translate", tok, _delims(d, spec), F.lit(letters)))
                 .when(tok < " ", F.concat(F.lit("X"), F.hex(tok))))
        kept = F.length(tok) != 1
        if keep:
            kept = kept | tok.isin(*(d[r] for r in keep))
        return F.when(kept, tok).otherwise(F.coalesce(F.concat(d["esc"], coded, d["esc"]), tok))

    return F.array_join(F.transform(_tokens(text, pattern), encoded), "")


def escape_sql(text: str, spec: DelimitedSpec, keep: tuple[str, ...] = ()) -> str:
    """:func:`escape` under the format's default delimiters, as SQL text."""
    dl = spec.defaults
    esc, order = dl["esc"], "".join(dl[r] for r in spec.escapes.values())
    special = "".join("\\" + c for c in order) + r"\x00-\x1f"
    q = "\\" + esc
    known = "|".join(spec.escapes)
    pattern = rf"({q}(?!(?:{known}|X(?:[0-9A-Fa-f]{{2}})+){q})[^{special}]*{q}|[^{special}]+|[{special}])"
    kept = "length(k) <> 1" + (f" OR k IN ({', '.join(sql_text(dl[r]) for r in keep)})" if keep else "")
    e = sql_text(esc)
    coded = (f"CASE WHEN contains({sql_text(order)}, k) THEN translate(k, {sql_text(order)}, '{''.join(spec.escapes)}') "
             f"WHEN k < ' ' THEN concat('X', hex(k)) END")
    token = f"CASE WHEN {kept} THEN k ELSE coalesce(concat({e}, {coded}, {e}), k) END"
    return f"array_join(transform(regexp_extract_all({text}, {sql_text(pattern)}, 1), k -> {token}), '')"


# ---- parse ----------------------------------------------------------------

def _delims_error(d: str, spec: DelimitedSpec) -> str:
    """SQL text: why a delimiter set is unusable, or NULL."""
    roles = ["field", "rep", "comp", "esc"] + (["sub"] if spec.has_sub else [])
    cases = ""
    for i, r in enumerate(roles):
        c = f"{d}.{r}"
        checks = [(f"{c} IN ('\\r', '\\n', char(0))", "is not allowed"),
                  (f"{c} RLIKE '^[0-9A-Za-z]$'", "must not be alphanumeric")]
        if i:
            checks.append((f"{c} IN ({', '.join(f'{d}.{o}' for o in roles[:i])})", "is used twice"))
        for cond, text in checks:
            cases += f" WHEN {cond} THEN concat('{spec.name}: header delimiters: delimiter \"', {c}, '\" {text}')"
    # the format's own delimiters need no tests
    usual = f"concat({', '.join(f'{d}.{r}' for r in roles)}) = {sql_text(''.join(spec.defaults[r] for r in roles))}"
    return f"CASE WHEN {usual} THEN NULL{cases} END"


def _header_delims(head: str, spec: DelimitedSpec) -> str:
    """SQL text: the delimiters a header line names, defaults for the rest."""
    n, got = spec.name_len, {}
    sep = f"substring({head}, {n + 1}, 1)"
    enc = f"substring_index(substring({head}, {n + 2}), {sep}, 1)"
    got["field"] = sep
    for i, role in enumerate(spec.encoding_order):
        got[role] = f"coalesce(nullif(substring({enc}, {i + 1}, 1), ''), {sql_text(spec.defaults[role])})"
    got.setdefault("sub", "''")
    return "named_struct(" + ", ".join(f"'{k}', {got[k]}" for k in spec.defaults) + ")"


def parse_delimited(df: DataFrame, spec: DelimitedSpec, raw: str = "raw", out: str = "msg") -> DataFrame:
    """Add the parsed struct column ``out``; narrow, one pass, never raises."""
    n, good = spec.name_len, f"'^{spec.name_pattern}$'"
    bw, lines, dl, dx, at, segs = (f"__{out}_{k}" for k in ("bw", "lines", "dl", "d", "at", "segs"))
    given = [c for c in df.columns if c != out]
    is_binary = df.schema[raw].dataType.typeName() == "binary"
    text = f"cast(`{raw}` AS STRING)"
    # One byte per character when the bytes are not UTF-8, or when a header
    # delimiter would be a multi-byte character.
    odd = f"{text} RLIKE {sql_text(rf'^[\r\n]*.{{0,{n + 4}}}[^\x00-\x7f]')}"
    bytewise = f"NOT is_valid_utf8({text}) OR {odd}" if is_binary else odd
    source = f"`{raw}`" if is_binary else f"encode(`{raw}`, 'UTF-8')"
    names = ", ".join(f"'{h}'" for h in spec.headers)
    is_head = lambda line: f"substring({line}, 1, {n}) IN ({names})"
    df = df.withColumn(bw, F.expr(f"coalesce({bytewise}, false)"))
    df = df.withColumn(lines, F.expr(
        f"array_remove(split(replace(coalesce(CASE WHEN {bw} THEN decode({source}, 'ISO-8859-1') ELSE {text} END, ''), "
        f"'\\n', '\\r'), '\\r'), '')"))
    h = f"coalesce(get({lines}, 0), '')"
    headed = f"({is_head(h)} AND length({h}) > {n})"
    df = df.withColumn(dl, F.expr(_header_delims(h, spec)))
    default = "named_struct(" + ", ".join(f"'{k}', {sql_text(v)}" for k, v in spec.defaults.items()) + ")"
    err = _delims_error(dl, spec)
    df = df.withColumn(dx, F.expr(f"named_struct('d', CASE WHEN {headed} AND ({err}) IS NULL THEN {dl} ELSE {default} END, 'e', {err})"))
    sep = f"{dx}.d.field"
    # the function is interpreted for every line: the pattern is a column, a header is told without an array of names
    df = df.withColumn(at, F.expr(f"concat(char(92), {sep})"))
    cut = lambda t: f"split({t}, {at})"
    starts = " OR ".join(f"startswith(s, '{h}')" for h in spec.headers)
    df = df.withColumn(segs, F.expr(
        f"transform({lines}, s -> CASE WHEN {starts} THEN concat(array(substring(s, 1, {n}), {sep}), "
        f"{cut(f'substring(s, {n + 2})')}) ELSE {cut('s')} END)"))
    bad_at = (f"cast(array_position(transform({segs}, s -> NOT s[0] RLIKE {good} OR "
              f"({is_head('s[0]')} AND size(s) = 3 AND s[2] = '')), true) AS INT)")
    line = f"get({lines}, b - 1)"
    name = f"substring({line}, 1, {n})"
    where = f"'{spec.name}: segment ', b, ': "
    seg_err = (f"CASE WHEN b = 0 THEN NULL WHEN length({line}) < {n} THEN concat({where}too short: \"', {line}, '\"') "
               f"WHEN NOT {name} RLIKE {good} THEN concat({where}invalid segment name \"', {name}, '\"') "
               f"WHEN {is_head(line)} AND length({line}) > {n} THEN NULL "
               f"WHEN {is_head(line)} THEN concat({where}header segment ', {name}, ' has no field separator') "
               f"ELSE concat({where}expected \"', {sep}, '\" after segment name ', {name}) END")
    # a header with encoding characters, then good names of no headers: nothing to look for
    heads = "|".join(spec.headers)
    plain = (f"array_join(transform({segs}, s -> s[0]), '\\r') RLIKE {sql_text(rf'^(?:{heads})(?:\r(?!(?:{heads})(?:\r|\z)){spec.name_pattern})*\z')} "
             f"AND NOT (size(get({segs}, 0)) = 3 AND get(get({segs}, 0), 2) = '')")
    error = (f"CASE WHEN size({lines}) = 0 THEN '{spec.name}: empty message' "
             f"WHEN NOT {headed} THEN '{spec.name}: message must start with a header segment ({spec.header_hint})' "
             f"WHEN {dx}.e IS NOT NULL THEN {dx}.e WHEN {plain} THEN NULL ELSE get(transform(array({bad_at}), b -> {seg_err}), 0) END")
    return materialise(df, out, F.expr(
        f"named_struct('error', {error}, 'bytewise', {bw}, 'd', {dx}.d, 'segs', {segs})"), given)


# ---- reading --------------------------------------------------------------

class _Sql:
    """The same reads as SQL text over a named column.

    One parsed expression instead of dozens of Column calls: a projection of
    twenty fields is planned in milliseconds instead of seconds."""

    def __init__(self, name: str, spec: DelimitedSpec):
        self.c, self.spec, self.d = f"`{name}`", spec, f"`{name}`.d"

    def segments(self, name: str) -> str:
        return f"filter({self.c}.segs, s -> s[0] = '{name}')"

    def nth(self, text: str, sep: str, idx: int) -> str:
        if idx == 1:  # what stands before the first separator, without an array of all
            return f"substring_index({text}, {self.d}.{sep}, 1)"
        return f"get(split({text}, concat(char(92), {self.d}.{sep})), {idx - 1})"

    def show(self, text: str) -> str:
        d, letters = self.d, "".join(self.spec.escapes)
        below = ("rep", "comp", "sub") if self.spec.has_sub else ("rep", "comp")
        esc = f"char(92), {d}.esc"
        seps = ", ".join(f"char(92), {d}.{r}" for r in below)
        pattern = f"concat('(', {esc}, '[^', {esc}, {seps}, ']*', {esc}, '|[^', {esc}, ']+|', {esc}, ')')"
        delims = ", ".join(f"{d}.{r}" for r in self.spec.escapes.values())
        raw = "unhex(substring(t, 3, length(t) - 3))"
        token = (f"CASE WHEN NOT startswith(t, {d}.esc) THEN t "
                 f"WHEN t RLIKE '(?s)^.[{letters}].$' THEN translate(substring(t, 2, 1), '{letters}', concat({delims})) "
                 f"WHEN t RLIKE '(?s)^.X([0-9A-Fa-f]{{2}})+.$' THEN CASE WHEN {self.c}.bytewise "
                 f"THEN decode({raw}, 'ISO-8859-1') ELSE cast({raw} AS STRING) END ELSE t END")
        whole = f"array_join(transform(regexp_extract_all({text}, {pattern}, 1), t -> {token}), '')"
        valid = f"make_valid_utf8(CASE WHEN {self.c}.bytewise THEN cast(encode(x, 'ISO-8859-1') AS STRING) ELSE x END)"
        # as a coalesce, whose first value and last both read the text, so that compiled code reads it once
        return (f"coalesce(CASE WHEN contains({text}, {d}.esc) OR {self.c}.bytewise "
                f"THEN get(transform(array({whole}), x -> {valid}), 0) END, {text})")

    def _all(self, p: Path) -> tuple[str, bool]:
        segs = self.segments(p.seg)
        segs = f"slice({segs}, {p.occ}, 1)" if p.occ else segs
        fields = f"transform(filter({segs}, s -> size(s) > {p.field}), s -> s[{p.field}])"
        if p.field <= self.spec.raw_fields(p.seg):
            return (f"filter({fields}, f -> false)" if max(p.rep, p.comp, p.sub) > 1 else fields), True
        if p.rep:
            found = f"transform({fields}, f -> {self.nth('f', 'rep', p.rep)})"
        else:
            found = f"flatten(transform({fields}, f -> split(f, concat(char(92), {self.d}.rep))))"
        for idx, sep in ((p.comp, "comp"), (p.sub, "sub")):
            if idx:
                found = f"transform({found}, f -> {self.nth('f', sep, idx)})"
        return f"filter({found}, f -> f IS NOT NULL)", False

    def get_all(self, p: Path) -> str:
        found, raw = self._all(p)
        return found if raw else f"transform({found}, f -> {self.show('f')})"

    def get(self, p: Path) -> str:
        if p.field <= self.spec.raw_fields(p.seg) or p.occ > 1:
            return self._get_any(p)
        # The first segment of the name decides in most messages.  It is found by its place among the names, which all
        # reads of one projection share, in compiled code; all segments are searched only where it leaves a choice.
        names = f"transform({self.c}.segs, s -> s[0])"
        first = f"get({self.c}.segs, cast(array_position({names}, '{p.seg}') AS INT) - 1)"
        field = f"get({first}, {p.field})"
        value = self.nth(field, "rep", max(p.rep, 1))
        for idx, sep in ((p.comp, "comp"), (p.sub, "sub")):
            if idx:
                value = self.nth(value, sep, idx)
        more = [] if p.occ else [f"size({names}) - size(array_remove({names}, '{p.seg}')) > 1"]
        if not p.rep and max(p.comp, p.sub) > 1:
            more.append(f"contains({field}, {self.d}.rep)")
        if more:
            value = f"coalesce({value}, CASE WHEN {' OR '.join(more)} THEN {self._found(p)} END)"
        return self.show(value)

    def _get_any(self, p: Path) -> str:
        return f"get({self._all(p)[0]}, 0)" if p.field <= self.spec.raw_fields(p.seg) else self.show(self._found(p))

    def _found(self, p: Path) -> str:
        """The first match in wire form, of all segments of the name."""
        if (p.comp <= 1 and p.sub <= 1 and p.rep <= 1) or (p.occ and p.rep):
            segs = self.segments(p.seg)
            seg = f"get({segs}, {p.occ - 1})" if p.occ else f"get(filter({segs}, s -> size(s) > {p.field}), 0)"
            value = self.nth(f"get({seg}, {p.field})", "rep", max(p.rep, 1))
            for idx, sep in ((p.comp, "comp"), (p.sub, "sub")):
                if idx:
                    value = self.nth(value, sep, idx)
            return value
        return f"get({self._all(p)[0]}, 0)"


class Parsed:
    """Accessors over a parsed column; every method returns a Column.

    An index that is not written matches all occurrences, ``get`` takes the
    first match, and a path that matches nothing is NULL.
    """

    FIELDS = ("error", "bytewise", "d", "segs")

    def __init__(self, col: Column | str | None, spec: DelimitedSpec, parts: dict[str, Column] | None = None):
        self.name = col if isinstance(col, str) else None
        if parts is None:
            col = F.col(col) if isinstance(col, str) else col
            parts = {k: col[k] for k in self.FIELDS}
        self.spec = spec
        self.parts = parts
        self.error, self.bytewise, self.d, self.segs = (parts[k] for k in self.FIELDS)

    @property
    def col(self) -> Column:
        return F.struct(*(self.parts[k].alias(k) for k in self.FIELDS))

    def _with(self, **kw) -> "Parsed":
        return Parsed(None, self.spec, self.parts | kw)

    def _below(self, level: str) -> tuple[str, ...]:
        """Separators that structure a piece of this level."""
        order = ("rep", "comp", "sub") if self.spec.has_sub else ("rep", "comp")
        return order[("field", "rep", "comp", "sub").index(level):]

    def _show(self, text: Column) -> Column:
        """One wire piece as the reader sees it: leaves decoded, separators kept."""
        if self.name:
            coded = F.contains(text, self.d["esc"]) | self.bytewise
            return F.coalesce(F.when(coded, bind(text, "p -> " + _Sql(self.name, self.spec).show("p"))), text)

        def decoded(t):
            return let(unescape(t, self.d, self.spec, self.bytewise, self._below("field")), lambda x: F.make_valid_utf8(
                F.when(self.bytewise, F.encode(x, "ISO-8859-1").cast("string")).otherwise(x)))

        return F.when(F.contains(text, self.d["esc"]) | self.bytewise, decoded(text)).otherwise(text)

    def _segment_text(self, seg: Column) -> Column:
        sep = self.d["field"]
        field_text = lambda f: self._show(f)
        plain = join_with(F.concat(F.array(seg[0]), F.transform(F.slice(seg, F.lit(2), F.size(seg)), field_text)), sep)
        head = F.concat(seg[0], sep, join_with(F.concat(F.array(F.get(seg, F.lit(2))), F.transform(
            F.slice(seg, F.lit(4), F.size(seg)), field_text)), sep))
        return F.when(seg[0].isin(*self.spec.headers), head).otherwise(plain)

    def segments(self, name: str) -> Column:
        """All segments of one name, as ARRAY<ARRAY<STRING>>."""
        return F.filter(self.segs, lambda s: s[0] == name)

    def _candidates(self, p: Path, base: Column | None) -> Column:
        base = self.segments(p.seg) if base is None else base
        return F.slice(base, p.occ, 1) if p.occ else base

    def _found(self, p: Path, base: Column | None) -> tuple[Column, str]:
        """(wire pieces matching p, their level)."""
        segs = self._candidates(p, base)
        fields = F.transform(F.filter(segs, lambda s: F.size(s) > p.field), lambda s: s[p.field])
        if p.field <= self.spec.raw_fields(p.seg):
            hidden = p.rep > 1 or p.comp > 1 or p.sub > 1
            return (F.filter(fields, lambda f: F.lit(False)) if hidden else fields), "raw"
        if p.rep:
            found = F.transform(fields, self._nth("rep", p.rep))
        else:
            found = F.flatten(F.transform(fields, lambda f: split_on(f, self.d["rep"])))
        for idx, name in ((p.comp, "comp"), (p.sub, "sub")):
            if idx:
                found = F.transform(found, self._nth(name, idx))
        return F.filter(found, lambda t: t.isNotNull()), "wire"

    def _nth(self, sep: str, idx: int):
        if idx == 1:
            return lambda t: F.call_function("substring_index", t, self.d[sep], F.lit(1))
        return lambda t: F.get(split_on(t, self.d[sep]), F.lit(idx - 1))

    def get_all(self, path: str | Path, base: Column | None = None) -> Column:
        p = compile_path(self.spec, path) if isinstance(path, str) else path
        if not p.field:
            return F.transform(self._candidates(p, base), self._segment_text)
        if self.name and base is None:
            return F.expr(_Sql(self.name, self.spec).get_all(p))
        found, level = self._found(p, base)
        return found if level == "raw" else F.transform(found, lambda t: self._show(t))

    def get(self, path: str | Path, base: Column | None = None) -> Column:
        p = compile_path(self.spec, path) if isinstance(path, str) else path
        if not p.field:
            return F.get(self.get_all(p, base), F.lit(0))
        if self.name and base is None:
            return F.expr(_Sql(self.name, self.spec).get(p))
        if p.field <= self.spec.raw_fields(p.seg):
            return F.get(self._found(p, base)[0], F.lit(0))
        if (p.comp <= 1 and p.sub <= 1 and p.rep <= 1) or (p.occ and p.rep):
            # The first segment that has the field decides.  The search by name
            # is the same expression for every field of a segment, so all
            # reads of one projection share it.
            segs = self.segments(p.seg) if base is None else base
            if p.occ:
                seg = F.get(segs, F.lit(p.occ - 1))
            else:
                seg = F.get(F.filter(segs, lambda s: F.size(s) > p.field), F.lit(0))
            return self._piece(F.get(seg, F.lit(p.field)), p)
        found, level = self._found(p, base)
        return self._show(F.get(found, F.lit(0)))

    def _piece(self, field: Column, p: Path) -> Column:
        return self._show(self._wire_piece(field, p))

    def _wire_piece(self, field: Column, p: Path) -> Column:
        value = self._nth("rep", max(p.rep, 1))(field)
        for idx, sep in ((p.comp, "comp"), (p.sub, "sub")):
            if idx:
                value = self._nth(sep, idx)(value)
        return value

    def at(self, seg: Column, name: str, rel: str) -> Column:
        """A path relative to one segment, e.g. ``at(obx, 'OBX', '5.1')``."""
        p = compile_path(self.spec, f"{name}-{rel}")
        if p.field <= self.spec.raw_fields(name):
            return F.get(self.get_all(p, F.array(seg)), F.lit(0))
        return self._show(self._at_wire(seg, p))

    def _at_wire(self, seg: Column, p: Path) -> Column:
        if p.rep or (p.comp <= 1 and p.sub <= 1):
            return self._wire_piece(F.get(seg, F.lit(p.field)), p)
        return F.get(self._found(p, F.array(seg))[0], F.lit(0))

    def at_each(self, over: Column, read) -> Column:
        """ARRAY<ARRAY<STRING>>: what :meth:`at` gives for every element of an array column.

        ``read(element)`` lists (segment, name, path).  The pieces are tested for escapes as a whole and decoded one by
        one only where the test finds something."""
        def wire(x):
            paths = [(seg, compile_path(self.spec, f"{name}-{rel}")) for seg, name, rel in read(x)]
            if any(p.field <= self.spec.raw_fields(p.seg) for _, p in paths):
                raise ValueError(f"{self.spec.name}: fields that hold delimiters are read with at")
            return F.array(*(self._at_wire(seg, p) for seg, p in paths))

        return let(F.transform(over, wire), lambda rows: F.when(
            self.bytewise | F.contains(F.array_join(F.flatten(rows), ""), self.d["esc"]),
            F.transform(rows, lambda row: F.transform(row, lambda t: self._show(t)))).otherwise(rows))

    def has_segment(self, name: str) -> Column:
        return F.exists(self.segs, lambda s: s[0] == name)

    # ---- writing ----------------------------------------------------------

    def _encode(self, value: Column, level: str) -> Column:
        """Wire form of a value written at ``level``: separators below the
        level split, the level's own and higher ones are data."""
        return escape(value, self.d, self.spec, keep=self._below(level))

    def _field_write(self, p: Path, value: Column):
        """What writing a field or deeper does to one segment."""
        wire = self._encode(value, "sub" if p.sub else "comp" if p.comp else "rep")

        def put(arr, idx, new):
            return F.transform(pad_to(arr, idx), lambda x, i: F.when(i == idx - 1, new(x)).otherwise(x))

        def in_comp(x):
            return join_with(put(split_on(x, self.d["sub"]), p.sub, lambda _: wire), self.d["sub"]) if p.sub else wire

        def in_rep(x):
            return join_with(put(split_on(x, self.d["comp"]), p.comp, in_comp), self.d["comp"]) if p.comp else wire

        def in_field(x):
            return join_with(put(split_on(x, self.d["rep"]), max(p.rep, 1), in_rep), self.d["rep"])

        return lambda seg: put(seg, p.field + 1, in_field)

    def each_segment(self, name: str, write, where=None) -> "Parsed":
        """Write to every segment of a name, in one pass that reads them by occurrence and puts them back by position.

        ``write(segment, i, segments)`` gets a handle with ``get`` and ``set`` on paths relative to the segment, its number
        from 0 and the handles of all of them as they were (``segments[2]``, ``segments.count``); ``where(segment, i)``
        leaves out segments."""
        if name in self.spec.headers:
            raise ValueError(f"{self.spec.name}: {name} is written with set")

        def written(segs):
            at = F.filter(F.transform(segs, lambda s, i: F.when(s[0] == name, i)), lambda i: i.isNotNull())

            def put(at):
                handles = Segments(self, name, segs, at)

                def one(pos, i):
                    old = F.get(segs, pos)
                    unit = Segment(self, name, old)
                    new = write(unit, i, handles).fields
                    new = new if where is None else F.when(where(unit, i), new).otherwise(old)
                    until = F.coalesce(F.get(at, i + 1), F.size(segs))
                    return F.concat(F.array(new), F.slice(segs, pos + 2, F.greatest(until - pos - 1, F.lit(0))))

                before = F.slice(segs, F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.size(segs)))
                return F.concat(before, F.flatten(F.transform(at, one)))

            return let(at, put)

        return self._with(segs=let(self.segs, written))

    def set(self, path: str, value) -> "Parsed":
        """A new message with ``value`` at ``path``; structure is created as
        needed (segments after their group, padded fields, promoted leaves)."""
        spec, p = self.spec, compile_path(self.spec, path)
        if not p.field:
            raise ValueError(f"{spec.name}: path {path}: set requires a field or deeper")
        value = text_or_empty(value)
        if p.field <= spec.raw_fields(p.seg):
            if p.comp or p.sub:
                raise ValueError(f"{spec.name}: path {path}: {p.seg}-{p.field} holds a delimiter and has no components")
            return self._set_delimiters(p, value)
        write, occ = self._field_write(p, value), max(p.occ, 1)

        def positions(segs):
            return F.filter(F.transform(segs, lambda s, i: F.when(s[0] == p.seg, i)), lambda i: i.isNotNull())

        def ensured(segs, pos):
            at = F.coalesce(F.array_max(pos) + 1, F.size(segs))
            return F.when(F.size(pos) >= occ, segs).otherwise(F.concat(
                F.slice(segs, F.lit(1), at),
                F.array_repeat(F.array(F.lit(p.seg)), F.greatest(F.lit(occ) - F.size(pos), F.lit(0))),
                F.slice(segs, at + 1, F.size(segs))))

        def written(segs):
            return let(F.get(positions(segs), F.lit(occ - 1)), lambda target: F.transform(
                segs, lambda s, i: F.when(i == target, write(s)).otherwise(s)))

        return self._with(segs=let(self.segs, lambda segs: let(
            let(positions(segs), lambda pos: ensured(segs, pos)), written)))

    def _set_delimiters(self, p: Path, value: Column) -> "Parsed":
        spec = self.spec
        new = {k: self.d[k] for k in spec.defaults}
        if p.field == 1:
            new["field"] = F.when(F.length(value) == 1, value).otherwise(self.d["field"])
        else:
            for i, role in enumerate(spec.encoding_order):
                new[role] = F.coalesce(F.nullif(F.substring(value, i + 1, 1), F.lit("")), F.lit(spec.defaults[role]))
        nd = F.struct(*(v.alias(k) for k, v in new.items()))
        head_field = lambda s, j: F.when(F.lit(j) == p.field, value).otherwise(F.get(s, F.lit(j)))
        segs = F.transform(self.segs, lambda s, i: F.when(
            s[0].isin(*spec.headers),
            F.concat(F.array(s[0]),
                     F.when((i == 0) & (s[0] == p.seg), F.array(head_field(s, 1), head_field(s, 2)))
                     .otherwise(F.slice(s, 2, 2)),
                     F.transform(F.slice(s, F.lit(4), F.size(s)), lambda f: self._rewrite(f, nd)))
        ).otherwise(F.transform(s, lambda f: self._rewrite(f, nd))))
        return self._with(segs=segs, d=nd)

    def _rewrite(self, f: Column, nd: Column) -> Column:
        """One field's canonical wire text under the delimiters ``nd``."""
        roles = self._below("field")
        seps = _quoted(self.d, roles)
        pieces = F.split(f, _text("(?<=[", *seps, "])|(?=[", *seps, "])"))

        def piece(p):
            expr = F
            for role in roles:
                expr = expr.when(p == self.d[role], nd[role])
            return expr.otherwise(escape(unescape(p, self.d, self.spec, self.bytewise), nd, self.spec))

        return F.array_join(F.transform(pieces, piece), "")

    def serialize(self) -> Column:
        """Canonical wire text: own delimiters, CR after every segment."""
        sep, d = self.d["field"], self.d

        def canon(f):
            return F.when(F.contains(f, d["esc"]) | f.rlike(CONTROL), self._rewrite(f, d)).otherwise(f)

        def joined(fields):
            """Tested as a whole; field by field only where the test finds something."""
            return let(join_with(fields, sep), lambda t: F.when(
                F.contains(t, d["esc"]) | t.rlike(CONTROL), join_with(F.transform(fields, canon), sep)).otherwise(t))

        def line(s):
            body = F.when(s[0].isin(*self.spec.headers), F.concat(
                s[0], sep, F.coalesce(F.get(s, F.lit(2)), F.lit("")),
                F.when(F.size(s) > 3, F.concat(sep, joined(F.slice(s, F.lit(4), F.size(s))))).otherwise(F.lit(""))))
            return body.otherwise(joined(s))

        return F.concat(F.array_join(F.transform(self.segs, line), "\r"), F.lit("\r"))

    def serialize_bytes(self) -> Column:
        text = self.serialize()
        return F.when(self.bytewise, F.encode(text, "ISO-8859-1")).otherwise(text.cast("binary"))

    # ---- flattening -------------------------------------------------------

    def occurrences(self) -> Column:
        """ARRAY<STRUCT<pos, occ>> in document order.

        Counted per distinct name, so the cost is names x segments and no
        window over exploded rows is needed."""
        numbered = F.transform(self.segs, lambda s, i: F.struct(s[0].alias("name"), i.alias("pos")))
        names = F.array_distinct(F.transform(self.segs, lambda s: s[0]))
        counted = F.flatten(F.transform(names, lambda nm: F.transform(
            F.filter(numbered, lambda x: x["name"] == nm),
            lambda x, k: F.struct(x["pos"].alias("pos"), (k + 1).alias("occ")))))
        return F.array_sort(counted)


class Segment:
    """One segment of a message; paths are relative to it, e.g. ``3[2].1``."""

    def __init__(self, message: Parsed, name: str, fields: Column):
        self.message, self.name, self.fields = message, name, fields

    def _path(self, rel: str) -> Path:
        p = compile_path(self.message.spec, f"{self.name}-{rel}")
        if not p.field:
            raise ValueError(f'{self.message.spec.name}: segment-relative path "{rel}": a field is required')
        return p

    def get(self, rel: str) -> Column:
        self._path(rel)
        return self.message.at(self.fields, self.name, rel)

    def set(self, rel: str, value) -> "Segment":
        return Segment(self.message, self.name, self.message._field_write(self._path(rel), text_or_empty(value))(self.fields))


class Segments:
    """The handles of all segments of a name, as they were."""

    def __init__(self, message: Parsed, name: str, segs: Column, at: Column):
        self.message, self.name, self.segs, self.at, self.count = message, name, segs, at, F.size(at)

    def __getitem__(self, k: int) -> Segment:
        return Segment(self.message, self.name, F.get(self.segs, F.get(self.at, F.lit(k))))
