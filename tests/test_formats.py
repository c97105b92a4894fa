"""The five formats, on messages that are made by rule, so that every expected value follows from how a message was made."""

import csv
import io
import json
import random
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from segmenta.functions.builder import new_message
from segmenta.functions.delimited import ASTM, HL7V2, Parsed, compile_path, parse_delimited
from segmenta.functions.trees import Tree, parse_tree
from segmenta.operators.leaves import diff, flatten_delimited, flatten_tree
from segmenta.paths import csv_path, json_steps, xml_steps
from segmenta.plans import translators as tr

class Made:
    """Segments as lists of fields, fields as lists of repetitions, repetitions as lists of components of sub-components."""

    def __init__(self, seed, names=("ZAA", "ZBB", "ZAA", "ZCC"), seps="|^~\\&"):
        rng = random.Random(seed)
        self.seps = seps
        # separators in values travel as escapes; the escape character itself has a test of its own
        word = lambda: "".join(rng.choice("abÄß 019" + seps[:3] + seps[4]) for _ in range(rng.randint(1, 6)))
        part = lambda depth: word() if depth == 0 else [part(depth - 1) for _ in range(rng.choice([1, 1, 2, 3]))]
        self.segments = [(n, [part(3) for _ in range(rng.randint(1, 4))]) for n in names]

    def escaped(self, text):
        """Separators become escapes named by what they separate, whatever characters this message uses for them."""
        names = dict(zip(self.seps, "FSRET"))
        return "".join(f"{self.seps[3]}{names[c]}{self.seps[3]}" if c in names else c for c in text)

    def text(self, end="\r"):
        f, s, r, _, t = self.seps
        head = f"MSH{f}{self.seps[1:]}{f}FROM{f}{f}{f}{f}20310506070809{f}{f}XYZ{s}Q01{f}C1{f}T{f}2.6"
        rows = [f.join([n, *(r.join(s.join(t.join(map(self.escaped, c)) for c in rep) for rep in field) for field in fields)]) for n, fields in self.segments]
        return end.join([head, *rows]) + end

    def leaves(self):
        """(path, value) with the shortest form of each path."""
        seen = {}
        for n, fields in self.segments:
            seen[n] = seen.get(n, 0) + 1
            seg = n if seen[n] == 1 else f"{n}[{seen[n]}]"
            for i, field in enumerate(fields, 1):
                for j, rep in enumerate(field, 1):
                    at = f"{seg}-{i}" + (f"[{j}]" if j > 1 else "")
                    for k, comp in enumerate(rep, 1):
                        for m, leaf in enumerate(comp, 1):
                            yield at + (f".{k}" if len(rep) > 1 or len(comp) > 1 else "") + (f".{m}" if len(comp) > 1 else ""), leaf


def parsed(spark, texts, spec=HL7V2):
    rows = [(i, bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)]
    return parse_delimited(spark.createDataFrame(rows, "id int, raw binary"), spec), Parsed("msg", spec)


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("id").select(*columns).collect()] if "id" in df.columns else [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("seps", ["|^~\\&", "#*!?$"])
def test_hl7_leaves_read_back(spark, seps):
    made = [Made(s, seps=seps) for s in range(6)]
    df, m = parsed(spark, [x.text() for x in made])
    assert [r[0] for r in values(df, m.serialize())] == [x.text() for x in made]
    flat = {}
    for r in flatten_delimited(df, ["id"], HL7V2).orderBy("id", "ord").collect():
        if r.path[0] == "Z":
            flat.setdefault(r.id, []).append((r.path, r.value))
    assert flat == {i: list(x.leaves()) for i, x in enumerate(made)}
    first = list(made[0].leaves())
    got = df.filter("id = 0").select(*(m.get(p).alias(str(i)) for i, (p, _) in enumerate(first))).first()
    assert list(got) == [v for _, v in first]


def test_hl7_levels(spark):
    """A path above the leaves gives encoded text, one below a leaf is only there for component 1, a missing one is NULL."""
    df, m = parsed(spark, ["MSH|^~\\&|LAB\rZAA|k1^k2&k3~k4|plain\rZAA|second\r"])
    want = {"MSH-1": "|", "MSH-2": "^~\\&", "MSH-3": "LAB", "ZAA-1": "k1^k2&k3", "ZAA-1.2": "k2&k3", "ZAA-1.2.2": "k3", "ZAA-1[2]": "k4", "ZAA-1[2].1": "k4",
            "ZAA-2.1": "plain", "ZAA-2.2": None, "ZAA[2]-1": "second", "ZAA[3]-1": None, "ZQQ-4": None, "ZAA-40": None}
    got = df.select(*(m.get(p).alias(str(i)) for i, p in enumerate(want))).first()
    assert dict(zip(want, got)) == want
    assert values(df, m.get_all("ZAA-1"), m.get("ZAA"), F.size(m.segments("ZAA"))) == [(["k1^k2&k3", "k4", "second"], "ZAA|k1^k2&k3~k4|plain", 2)]


def astm_text(tests=3, end="\r"):
    rows = [f"R|{i}|^^^T{i}|{i * 11}&F&{i}|u{i}||N||F||||2031050607{i:02d}00" for i in range(1, tests + 1)]
    return end.join(["H|\\^&|||ANALYSER|||||||P|LIS2-A2|20310506070809", "P|1||CASE7||ROE^RICHARD||19550203|F", "O|1|TUBE9||^^^PANEL|S|20310506070000", *rows, "L|1|N"]) + end


def test_astm_reads(spark):
    df, m = parsed(spark, [astm_text()], ASTM)
    want = {"H-1": "|", "H-2": "\\^&", "H-5": "ANALYSER", "P-5": "ROE^RICHARD", "P-5.1": "ROE", "O-4.4": "PANEL", "R-3": "11|1", "R[3]-4": "u3", "R[2]-2.4": "T2", "R-1.1": "1",
            "Q-2": None, "R[4]-1": None}
    got = df.select(*(m.get(p).alias(str(i)) for i, p in enumerate(want))).first()
    assert dict(zip(want, got)) == want and values(df, m.serialize(), m.get_all("R-3")) == [(astm_text(), ["11|1", "22|2", "33|3"])]


def test_bad_hl7_paths():
    """One thing wrong with a good path at a time."""
    good = "ZAA[2]-3[4].5.6"
    compile_path(HL7V2, good)
    for old, new in (("ZAA", "zaa"), ("ZAA", ""), ("-3", "-0"), (".5", ".0"), (".6", ".6.7"), ("[2]", "[0]")):
        with pytest.raises(ValueError):
            compile_path(HL7V2, good.replace(old, new))


def test_line_ends_and_foreign_bytes(spark):
    one = Made(40)
    df, m = parsed(spark, [one.text("\n"), one.text("\r\n"), b"MSH|^~\\&|X\rZAA|\xff\xfe raw\r", "MSH|^~\\&|X\rZAA|keep \\Q9\\ and \\Z\r", "MSH|^~\\&|X\rZAA|\\X4A4B\\!\r"])
    got = [bytes(r[0]) for r in values(df, m.serialize_bytes())]
    assert got[:2] == [one.text().encode()] * 2 and got[2] == b"MSH|^~\\&|X\rZAA|\xff\xfe raw\r" and got[3].endswith(b"keep \\Q9\\ and \\E\\Z\r")
    assert [r[0] for r in values(df, m.get("ZAA-1"))][3:] == ["keep \\Q9\\ and \\Z", "JK!"]


def test_parse_errors(spark):
    head = "MSH|^~\\&|X\r"
    bad = ["", "ZAA|1\r", "MSH\r", "MSH|^~\\&", head + "z1a|1\r", head + "ZA\r", head + "ZAA~1\r", "MSH|^^\\&|X\r", "MSHA^~\\&AX\r"]
    df, m = parsed(spark, [*bad, head])
    errors = [r[0] for r in values(df, m.error)]
    assert errors[0] == "hl7v2: empty message" and errors[4] == 'hl7v2: segment 2: invalid segment name "z1a"' and errors[-1] is None
    assert [bool(e) for e in errors[:-1]] == [True, True, True, errors[3] is not None, True, True, True, True, True]


def test_writes_change_one_place(spark):
    """A value set at a leaf's path reads back there, and every other leaf stays as it was."""
    made = Made(77)
    leaves = list(made.leaves())
    df, m = parsed(spark, [made.text()])
    for p, _ in leaves[::max(1, len(leaves) // 6)]:
        changed = df.select(m.set(p, "new|^value&").col.alias("msg"))
        m2 = Parsed("msg", HL7V2)
        got = changed.select(*(m2.get(q).alias(str(i)) for i, (q, _) in enumerate(leaves))).first()
        want = {q: ("new|^value&" if q == p else v) for q, v in leaves}
        # a separator below the level that is set splits
        diffs = [q for (q, _), g in zip(leaves, got) if g != want[q]]
        assert diffs in ([], [p]), (p, diffs)


def test_writes_make_places(spark):
    df, m = parsed(spark, ["MSH|^~\\&|X\rZAA|v\r"])
    cases = {"ZAA-4": "\rZAA|v|||w\r", "ZAA-1[3]": "\rZAA|v~~w\r", "ZAA-1.3": "\rZAA|v^^w\r", "ZAA-1.1.2": "\rZAA|v&w\r", "ZBB-2": "\rZBB||w\r", "ZAA[2]-1": "\rZAA|v\rZAA|w\r"}
    got = df.select(*(m.set(p, "w").serialize().alias(str(i)) for i, p in enumerate(cases))).first()
    assert all(t.endswith(w) for t, w in zip(got, cases.values())), list(got)
    for p in ("MSH-1.2", "MSH-2.1.3", "ZAA"):
        with pytest.raises(ValueError):
            m.set(p, "w")


def test_diff(spark):
    made = Made(5)
    leaves = dict(made.leaves())
    df, m = parsed(spark, [made.text()])
    before = flatten_delimited(df, ["id"], HL7V2)
    path = next(p for p, v in leaves.items() if not set(v) & set("|^~\\&"))
    after = flatten_delimited(df.select("id", m.set(path, "ANEW").set("ZNN-2", "there").col.alias("msg")), ["id"], HL7V2)
    changed = {(r.path, r.op, r["from"], r.to) for r in diff(before, after, ["id"]).collect()}
    assert changed == {(path, "changed", leaves[path], "ANEW"), ("ZNN-2", "added", None, "there")}
    back = {(r.path, r.op, r["from"], r.to) for r in diff(after, before, ["id"]).collect()}
    assert back == {(path, "changed", "ANEW", leaves[path]), ("ZNN-2", "removed", "there", None)} and diff(before, before, ["id"]).isEmpty()


# --- JSON ---------------------------------------------------------------------------------------------------------------

def some_json(rng, depth=3):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return [rng.randint(-99, 10**17), rng.random() * 10, rng.choice(["ä\"\\/\n", "", "x y", "🚲"]), rng.choice([True, False]), None][kind]
    if kind < 7:
        return {rng.choice(["k", "odd key", "é", "a.b", "n1", "n2"]): some_json(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [some_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def compact(v):
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def json_leaves(v, at=""):
    if isinstance(v, dict):
        for k, x in v.items():
            plain = k.replace("_", "a").isalnum() and k.isascii() and not k[0].isdigit()
            yield from json_leaves(x, (f"{at}.{k}" if at else k) if plain else f'{at}["{k}"]')
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from json_leaves(x, f"{at}[{i}]")
    elif v is not None and v != "":
        yield at, v if isinstance(v, str) else compact(v)


def test_json_round_trips(spark):
    rng = random.Random(8)
    docs = [some_json(rng) for _ in range(40)]
    # what a parser would normalise stays as it was written
    exact = ['{"t":1,"t":2}', '[12345678901234567890,1E+2,-0.50]', "[" * 512 + "]" * 512]
    texts = [compact(d) for d in docs] + exact
    df = parse_tree(spark.createDataFrame(list(enumerate(texts)), "id int, raw string"), "json")
    t = Tree("msg", "json")
    assert [r[0] for r in values(df, t.serialize())] == texts
    flat = {}
    for r in flatten_tree(df.filter(f"id < {len(docs)}"), ["id"], "json").orderBy("id", "ord").collect():
        flat.setdefault(r.id, []).append(r.value)
    want = {i: [v for _, v in json_leaves(d)] for i, d in enumerate(docs)}
    assert flat == {i: v for i, v in want.items() if v}


def test_json_that_is_cut_off(spark):
    whole = compact({"list": [1, {"deep": "text"}], "flag": True})
    bad = [whole[:i] for i in range(len(whole))] + [whole + "]", whole + whole, whole.replace(":", "=", 1), whole.replace("]", ",]"), "[" * 513 + "]" * 513]
    df = parse_tree(spark.createDataFrame([(i, t) for i, t in enumerate([*bad, whole])], "id int, raw string"), "json")
    errors = [r[0] for r in values(df, Tree("msg", "json").error)]
    assert all(errors[:-1]) and errors[-1] is None


def test_json_reads(spark):
    doc = {"team": [{"who": "Ada", "tags": ["x", "y"]}, {"who": "Bo"}, {"tags": ["z"]}], "size": 3, "ok": False}
    df = parse_tree(spark.createDataFrame([(compact(doc),)], "raw string"), "json")
    t = Tree("msg", "json")
    row = df.select(t.get_all("team.who"), t.get("team[1].who"), t.get_all("team[0].tags"), t.get("size"), t.get("ok"), t.get("team[5].who"), t.get("team[2]"), t.segments("team")).first()
    assert list(row) == [["Ada", "Bo"], "Bo", ["x", "y"], "3", "false", None, compact(doc["team"][2]), [compact(x) for x in doc["team"]]]


def test_bad_tree_paths():
    """One thing wrong with a good path at a time."""
    for compiled, good, wrong in (
            (json_steps, "a.b[0].c", [("a", ""), (".b", "..b"), ("[0]", "[]"), ("[0]", "[-2]"), ("[0]", "[007]"), (".c", "."), (".c", "c"), ("b", 'b["'), ("[0]", "[")]),
            (xml_steps, "a/b[2]/@c", [("a/", "//"), ("/b", "//b"), ("[2]", "[0]"), ("[2]", "[y]"), ("[2]", "[02]"), ("[2]", "[2"), ("@c", "@"), ("@c", "@c/d"), ("/@c", "@c"), ("/@c", "/")]),
            (csv_path, "R[2].3", [("[2]", "[0]"), ("R", "ZAA-1")])):
        compiled(good)
        for old, new in wrong:
            with pytest.raises(ValueError):
                compiled(good.replace(old, new, 1))


# --- XML ----------------------------------------------------------------------------------------------------------------

def some_xml(rng, depth=3):
    """(canonical text, another way to write it)."""
    name = rng.choice(["item", "x:y", "Grüße", "n-1"])
    attrs = {k: rng.choice(["v", "<&\">", "é"]) for k in ("id", "xml:lang", "z")[:rng.randint(0, 3)]}
    head = name + "".join(f" {k}={quoteattr(v, {chr(34): '&quot;'}).replace(chr(39), chr(34))}" for k, v in attrs.items())
    loose = name + "".join(f"\n {k} = '{escape(v)}'" for k, v in attrs.items())
    if depth == 0 or rng.random() < 0.3:
        text = rng.choice(["", "one & two", "a < b", "  kept  "])
        body, other = escape(text), (f"<![CDATA[{text}]]>" if text and rng.random() < 0.5 else escape(text))
    else:
        parts = [some_xml(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        body, other = "".join(p[0] for p in parts), "\n".join(["<!-- note -->", *(p[1] for p in parts), "<?do it?>"])
    return (f"<{head}>{body}</{name}>" if body else f"<{head}/>"), f"<{loose}>{other}</{name}>"


def test_xml_canonical_form(spark):
    rng = random.Random(4)
    pairs = [some_xml(rng) for _ in range(25)]
    pairs = [(a.replace("x:y", "xy"), b.replace("x:y", "xy")) for a, b in pairs]
    df = parse_tree(spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)] + [(i + 100, a) for i, (a, _) in enumerate(pairs)], "id int, raw string"), "xml")
    t = Tree("msg", "xml")
    got = [r[0] for r in values(df, t.serialize())]
    assert got == [a for a, _ in pairs] * 2


def test_xml_that_is_cut_off(spark):
    whole = '<r a="1"><s>t</s><u/></r>'
    bad = [whole[:i] for i in range(len(whole))] + [whole + "<r/>", whole + "x", whole.replace("</s>", "</S>"), whole.replace('"1"', "1"), "<d>" * 513 + "</d>" * 513]
    df = parse_tree(spark.createDataFrame([(i, t) for i, t in enumerate([*bad, whole])], "id int, raw string"), "xml")
    errors = [r[0] for r in values(df, Tree("msg", "xml").error)]
    assert all(errors[:-1]) and errors[-1] is None


def test_xml_character_sets(spark):
    rows = [(i, bytearray(f'<?xml version="1.0" encoding="{label}"?><w>{text}</w>'.encode(codec))) for i, (label, codec, text) in enumerate(
        [("ISO-8859-15", "iso8859-15", "Œuvre €"), ("windows-1250", "cp1250", "żółw"), ("utf-8", "utf-8", "žluť"), ("US-ASCII", "ascii", "plain")])]
    rows.append((9, bytearray(b'<?xml version="1.0" encoding="no-such-set"?><w/>')))
    df = parse_tree(spark.createDataFrame(rows, "id int, raw binary"), "xml")
    t = Tree("msg", "xml")
    got = values(df, t.get("w"), t.error)
    read = [g for g, e in got[:4] if e is None]
    assert {"žluť", "plain"} <= set(read) and set(read) <= {"Œuvre €", "żółw", "žluť", "plain"} and got[4][1]


def test_xml_entities_are_refused(spark):
    rows = [(0, '<!DOCTYPE r [<!ENTITY big "boom">]><r>&big;</r>'), (1, '<!DOCTYPE r [<!ENTITY big SYSTEM "file:///etc/hostname">]><r/>'), (2, "<!DOCTYPE r><r>fine &amp; well</r>"), (3, "<r>&big;</r>")]
    t = Tree("msg", "xml")
    got = values(parse_tree(spark.createDataFrame(rows, "id int, raw string"), "xml"), t.error, t.get("r"))
    assert got[0][0] and got[1][0] and got[3][0] and got[2] == (None, "fine & well")


# --- CSV ----------------------------------------------------------------------------------------------------------------

def written(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def test_csv(spark):
    rng = random.Random(6)
    tables = [[[rng.choice(["", "plain", "with,comma", 'a "quote"', "two\nlines", "é"]) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 5))] for _ in range(12)]
    texts = [written(t) for t in tables]
    bad = ["", 'x,"open\n', 'x"y,z\n']
    df = parse_tree(spark.createDataFrame([(i, x) for i, x in enumerate(texts + bad)], "id int, raw string"), "csv")
    t = Tree("msg", "csv")
    got = values(df, t.error, t.serialize(), t.get_all("R.2"), t.get("R[1].2"))
    assert all(e for e, *_ in got[len(tables):])
    for rows, text, (error, back, second, first) in zip(tables, texts, got):
        assert error is None and back == text and second == [r[1] for r in rows] and first == rows[0][1]


# --- new messages -------------------------------------------------------------------------------------------------------

def test_builders(spark):
    one = spark.range(1)
    doc = {"kind": "Report", "final": False, "count": 7, "who": [{"name": 'O"Brien', "roles": ["lead", "staff"]}, {"name": "Li"}], "note": None, "ratio": 2.5}
    j = new_message("json")
    for path, v in [("kind", "Report"), ("final", False), ("count", 7), ("who[0].name", F.lit('O"Brien')), ("who[0].roles[0]", "lead"), ("who[0].roles[1]", "staff"), ("who[1].name", "Li"),
                    ("note", None), ("ratio", 2.5)]:
        j.set(path, v)
    j.set("never.there", "v", when=F.lit(False))
    assert one.select(j.text()).first()[0] == compact(doc)
    padded = new_message("json").set("list[2]", "third")
    assert one.select(padded.text()).first()[0] == '{"list":[null,null,"third"]}'
    for first, second in (("a.b", "a[0]"), ("a[0][0]", "a.b")):
        with pytest.raises(ValueError):
            new_message("json").set(first, 1).set(second, 2)
    replaced = new_message("json").set("a.b", 1).set("a", 2).set("c", 3).set("c.d", 4)
    assert one.select(replaced.text()).first()[0] == '{"a":2,"c":{"d":4}}'

    x = new_message("xml")
    for path, v in [("Order/@id", "7"), ("Order/line[2]/@qty", "5"), ("Order/line[1]/part", F.lit("bolt & nut")), ("Order/by", "me")]:
        x.set(path, v)
    assert one.select(x.text()).first()[0] == '<Order id="7"><line><part>bolt &amp; nut</part></line><line qty="5"/><by>me</by></Order>'
    with pytest.raises(ValueError):
        x.set("Other/by", "you")
    h = new_message("hl7v2").set("MSH-9.2", "Q01").set("ZAA-2", F.lit("a^b|c")).set("ZAA-1[2].1", "d\\e")
    assert one.select(h.text()).first()[0] == "MSH|^~\\&|||||||^Q01\rZAA|~d\\E\\e|a^b\\F\\c\r"


def test_bridge_keeps_content(spark):
    df, a = parsed(spark, [astm_text(2)], ASTM)
    df = parse_delimited(df.select(tr.result_to_oru(a).text().alias("raw")), HL7V2)
    df = parse_delimited(df.select(tr.oru_to_result(Parsed("msg", HL7V2)).text().alias("raw")), ASTM)
    want = {"H-5": "ANALYSER", "P-3": "CASE7", "P-5.1": "ROE", "P-5.2": "RICHARD", "P-7": "19550203", "O-2": "TUBE9", "O-4.4": "PANEL"} | {
        k: v for i in (1, 2) for k, v in ((f"R[{i}]-2.4", f"T{i}"), (f"R[{i}]-3", f"{i * 11}|{i}"), (f"R[{i}]-4", f"u{i}"))}
    got = df.select(*(a.get(p).alias(str(i)) for i, p in enumerate(want))).first()
    assert dict(zip(want, got)) == want
