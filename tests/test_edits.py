"""Writes on received messages and segment handles, against plain versions."""

import csv
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from segmenta.functions.columns import materialise
from segmenta.functions.delimited import HL7V2, Parsed, parse_delimited
from segmenta.functions.trees import Tree, parse_tree
from segmenta.paths import json_steps, xml_steps


def trees(spark, fmt, raws):
    return parse_tree(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"), fmt), Tree("msg", fmt)


def texts(df, *cols):
    rows = df.orderBy("id").select(*cols).collect()
    return [r[0] if len(cols) == 1 else tuple(r) for r in rows]


# ---- JSON: values as ("o", [[key, value]]), ("a", [value]) or a scalar ---------------------------------------------

def from_json(text):
    def plain(v):
        return ("a", [plain(x) for x in v]) if isinstance(v, list) else v
    def tree(v):
        if isinstance(v, tuple) and v[0] == "pairs":
            return ("o", [[k, tree(x)] for k, x in v[1]])
        if isinstance(v, list):
            return ("a", [tree(x) for x in v])
        return v
    return tree(json.loads(text, object_pairs_hook=lambda p: ("pairs", p)))


def to_json(v):
    if isinstance(v, tuple):
        if v[0] == "o":
            return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + to_json(x) for k, x in v[1]) + "}"
        return "[" + ",".join(map(to_json, v[1])) + "]"
    return json.dumps(v, ensure_ascii=False)


def plain_json_set(text, path, value):
    """What a write gives, or None where the structure does not allow it."""
    box = [from_json(text)]  # the document as the only element of a list
    holder, key = box, 0
    for s in json_steps(path):
        cur = holder[key]
        if isinstance(s, int):
            if isinstance(cur, tuple) and cur[0] == "o" and cur[1]:
                return None
            if not (isinstance(cur, tuple) and cur[0] == "a"):
                cur = holder[key] = ("a", [])
            cur[1].extend([None] * (s + 1 - len(cur[1])))
            holder, key = cur[1], s
            continue
        if isinstance(cur, tuple) and cur[0] == "a" and cur[1]:
            holder, key = cur[1], 0
            cur = holder[key]
            if isinstance(cur, tuple) and cur[0] == "a" and cur[1]:
                return None
        if not (isinstance(cur, tuple) and cur[0] == "o"):
            cur = holder[key] = ("o", [])
        pair = next((p for p in cur[1] if p[0] == s), None)
        if pair is None:
            pair = [s, None]
            cur[1].append(pair)
        holder, key = pair, 1
    holder[key] = value
    return to_json(box[0])


def some_value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return ("a", [some_value(rng, depth - 1) for _ in range(rng.randrange(4))])
    if kind == 6:
        return ("o", [[rng.choice("abcd"), some_value(rng, depth - 1)] for _ in range(rng.randrange(4))])
    return [None, True, 7, "x\"\\\né", ""][kind]


JSON_PATHS = ["a", "a.b", "a[2]", "[0].a", "a.b[2].c", '["odd.key"].b']


def test_json_writes(spark):
    rng = random.Random(4)
    docs = [to_json(some_value(rng, 4)) for _ in range(150)] + ['{"a":1,"a":{"b":2}}', "{}", "[]", '[[{"a":1}]]', '{"a":[{"b":[1]},{"b":2}]}']
    df, t = trees(spark, "json", docs)
    for path in JSON_PATHS:
        got = texts(df, t.set(path, "né\"w").serialize())
        assert got == [plain_json_set(d, path, "né\"w") for d in docs], path
    one, two = t.set("a.b[1]", 5), t.set("a.b[1]", 5).set("z", None).set("a.b[1]", "again")
    assert texts(df, one.serialize()) == [plain_json_set(d, "a.b[1]", 5) for d in docs]
    def both(d):
        for p, v in (("a.b[1]", 5), ("z", None), ("a.b[1]", "again")):
            d = d and plain_json_set(d, p, v)
        return d
    assert texts(df, two.serialize()) == [both(d) for d in docs]
    # what was written is read, and a failed write says why and leaves the message
    failed = [r for r in df.select(t.set("a[0]", 1).error.alias("e"), t.set("a[0]", 1).get("a").alias("a")).collect() if r.e]
    assert {r.e for r in failed} == {'json: path "a[0]": [0] applied to an object with keys', 'json: path "a[0]": key "a" applied to nested arrays'}
    assert all(r.a.startswith("{") for r in failed if "object" in r.e)


def test_json_values_keep_their_type(spark):
    df, t = trees(spark, "json", ['{"a":0}'])
    df = df.select("id", "msg", F.lit(7).alias("i"), F.lit(2.5).alias("f"), F.lit(3.0).alias("w"), F.lit(True).alias("t"), F.lit("s").alias("s"),
                   F.lit(None).cast("long").alias("n"), F.expr("cast(1.50 as decimal(9,2))").alias("d"), F.expr("double('NaN')").alias("nan"))
    m = t
    for c in ("i", "f", "w", "t", "s", "n", "d", "nan"):
        m = m.set(c, F.col(c))
    assert texts(df, m.serialize()) == ['{"a":0,"i":7,"f":2.5,"w":3,"t":true,"s":"s","n":null,"d":1.50,"nan":"NaN"}']
    for path in ("", "a..b", "a["):
        with pytest.raises(ValueError):
            t.set(path, 1)


# ---- XML: elements as [name, {attribute: value}, text or [element or text]] ------------------------------------------

def show_xml(e):
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f"<{e[0]}" + "".join(f' {k}="{esc(v)}"' for k, v in e[1].items())
    inner = esc(e[2]) if isinstance(e[2], str) else "".join(esc(c) if isinstance(c, str) else show_xml(c) for c in e[2])
    return f"{head}>{inner}</{e[0]}>" if inner else f"{head}/>"


def plain_xml_set(doc, path, value):
    import copy

    doc, steps = copy.deepcopy(doc), xml_steps(path)
    if steps[0][0] != doc[0] or steps[0][1] > 1:
        return None
    cur = doc
    for name, occ, is_attr in steps[1:]:
        if is_attr:
            cur[1][name] = value
            return show_xml(doc)
        if isinstance(cur[2], str):
            cur[2] = cur[2] and [] or []
        same = [c for c in cur[2] if not isinstance(c, str) and c[0] == name]
        while len(same) < max(occ, 1):
            same.append([name, {}, ""])
            cur[2].append(same[-1])
        cur = same[max(occ, 1) - 1]
    cur[2] = value
    return show_xml(doc)


def some_element(rng, depth, name="r"):
    attrs = {k: rng.choice(["1", "<&>"]) for k in rng.sample("xyz", rng.randrange(3))}
    if not depth or rng.random() < 0.3:
        return [name, attrs, rng.choice(["", "text", "a & b"])]
    parts = [some_element(rng, depth - 1, rng.choice("abc")) for _ in range(rng.randrange(1, 4))]
    if rng.random() < 0.3:
        parts.insert(rng.randrange(len(parts) + 1), "mixed")
    return [name, attrs, parts]


def test_xml_writes(spark):
    rng = random.Random(6)
    docs = [some_element(rng, 3) for _ in range(80)]
    df, t = trees(spark, "xml", [show_xml(d) for d in docs])
    assert texts(df, t.serialize()) == [show_xml(d) for d in docs]
    for path in ("r", "r/@x", "r/a[2]", "r/a[3]/b/@y", "r/a/b/c", "other"):
        m = t.set(path, "né<w")
        got = texts(df, m.serialize())
        assert got == [plain_xml_set(d, path, "né<w") for d in docs], path
    again = t.set("r/a[2]/b", "1").set("r/a[2]/b/@k", "2").set("r/a[2]", "3")
    def thrice(d):
        import xml.etree.ElementTree as ET
        assert ET.fromstring(show_xml(d)) is not None
        e = [d[0], dict(d[1]), d[2]]
        return plain_xml_set(e, "r/a[2]", "3")
    assert texts(df, again.serialize()) == [thrice(d) for d in docs]
    assert texts(df, t.set("other", 1).error)[0] == 'xml: path "other": document element is "r"'
    for path in ("@x", "r/a b", "", "r//a"):
        with pytest.raises(ValueError):
            t.set(path, 1)


def test_xml_declarations_stay(spark):
    df, t = trees(spark, "xml", ['<?xml version="1.0" encoding="UTF-8"?>\n<r><a/></r>'])
    assert texts(df, t.set("r/a", "x").serialize()) == ['<?xml version="1.0" encoding="UTF-8"?><r><a>x</a></r>']


# ---- CSV -----------------------------------------------------------------------------------------------------------

def plain_csv(text):
    """Rows, or the line and kind of the first wrong quote, by a scan over the characters."""
    text = text.replace("\r\n", "\n")
    rows, row, at, line = [], [], 0, 1
    while at < len(text):
        if not row and text[at] == "\n":
            at, line = at + 1, line + 1
            continue
        begun = line
        if text[at] == '"':
            cell, at = "", at + 1
            while True:
                if at >= len(text):
                    return f'csv: record on line {begun}: extraneous or missing " in quoted-field'
                if text[at] == '"':
                    if text[at + 1:at + 2] == '"':
                        cell, at = cell + '"', at + 2
                        continue
                    break
                cell, line, at = cell + text[at], line + (text[at] == "\n"), at + 1
            at += 1
            if at < len(text) and text[at] not in ",\n":
                return f'csv: record on line {begun}: extraneous or missing " in quoted-field'
        else:
            cell = re.match(r"[^,\n]*", text[at:])[0]
            if '"' in cell:
                return f'csv: record on line {begun}: bare " in non-quoted-field'
            at += len(cell)
        row.append(cell.replace("\r", "\n"))
        if at < len(text) and text[at] == ",":
            at += 1
            if at < len(text) and text[at] != "\n":
                continue
            row.append("")
        rows.append(row)
        row, at, line = [], at + 1, line + 1
    return rows or "csv: empty message"


def test_csv_without_python(spark):
    rng = random.Random(8)
    pieces = ['a', '"', '""', ',', '\n', '\r\n', '\r', ' ', '﷐', '﷐x', 'é', '"q"', '"x,y"', '"l\nm"', '"",', '﷐q']
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)] + ["", "\n\n", '""', '"a', 'a"b', 'x\n"a\n""b"c,d', '"a\nb"x']
    df, t = trees(spark, "csv", cases)
    got = [r[0] or r[1] for r in df.orderBy("id").select("msg.error", "msg.rows").collect()]
    want = [plain_csv(c) for c in cases]
    assert got == want, next((c, g, w) for c, g, w in zip(cases, got, want) if g != w)
    assert sum(isinstance(w, list) for w in want) > 300 and sum(isinstance(w, str) for w in want) > 300
    assert "Python" not in df.select(t.get("R.1"), t.rows())._jdf.queryExecution().toString()


def test_csv_rows_and_writes(spark):
    raws = ['a,"b ""q""",c\nd\n', '""\nx,,\n', "one\n"]
    df, t = trees(spark, "csv", raws)
    assert texts(df, t.get("R[2]")) == ["d", "x,,", None]
    assert texts(df, t.get_all("R")) == [['a,"b ""q""",c', "d"], ['""', "x,,"], ["one"]]
    assert texts(df, t.get("R")) == ['a,"b ""q""",c', '""', "one"]
    m = t.set("R.2", "x,y").set("R[3].2", None).set("R[2].4", 'q"')
    def plain(raw):
        rows = plain_csv(raw)
        for r, c, v in ((1, 2, "x,y"), (3, 2, ""), (2, 4, 'q"')):
            rows += [[] for _ in range(r - len(rows))]
            rows[r - 1] += [""] * (c - len(rows[r - 1]))
            rows[r - 1][c - 1] = v
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        return out.getvalue()
    assert texts(df, m.serialize()) == [plain(r) for r in raws]
    with pytest.raises(ValueError):
        t.set("R[2]", "x")


def test_many_csv_rows_are_linear(spark):
    df, t = trees(spark, "csv", ["\n".join(f'{i},"v{i}"' for i in range(30_000))])
    assert texts(df, F.size(t.rows()), t.get("R[29999].2")) == [(30_000, "v29998")]


# ---- segment handles ----------------------------------------------------------------------------------------------

def test_handles_on_rows(spark):
    df, t = trees(spark, "csv", ["a,b,c\nd,e,f\n", "x\n"])
    m = t.each_segment("R", lambda row, i, rows: row.set("3", F.concat(rows[0].get("2"), row.get("3"))), where=lambda row, i: i == 1)
    assert texts(df, m.serialize()) == ["a,b,c\nd,e,bf\n", "x\n"]
    n = t.each_segment("R", lambda row, i, rows: row.set("4", i).set("1", F.upper(row.get("1"))))
    assert texts(df, n.serialize()) == ["A,b,c,0\nD,e,f,1\n", "X,,,0\n"]
    with pytest.raises(ValueError):
        t.each_segment("R", lambda row, i, rows: row.set("R.1", 1))


def test_handles_on_json(spark):
    docs = ['{"name":[{"family":"Doe","given":["J"]},{"family":"Roe"}],"active":true}', '{"name":{"family":"Solo"},"x":1}', '{"x":[1]}', '{"name":[1,{"family":"Poe"}]}']
    df, t = trees(spark, "json", docs)
    m = t.each_segment("name", lambda u, i, us: u.set("family", F.concat(us[0].get("family"), F.lit("-"), u.get("family"))), where=lambda u, i: i == 1)
    df2 = materialise(df, "msg", m.col)
    m = t.each_segment("name", lambda u, i, us: u.set("given[1]", "Q").set("count", us.count), where=lambda u, i: i == 0)
    assert texts(df2, m.serialize()) == ['{"name":[{"family":"Doe","given":["J","Q"],"count":2},{"family":"Doe-Roe"}],"active":true}',
                                        '{"name":{"family":"Solo","given":[null,"Q"],"count":1},"x":1}', '{"x":[1]}',
                                        '{"name":[{"given":[null,"Q"],"count":2},{"family":null}]}']
    # a write that a unit does not allow is the message's error
    bad = t.each_segment("name", lambda u, i, us: u.set("a.b", 1).set("a[1]", 2))
    assert texts(df, bad.error, bad.serialize().isNull()) == [(None, False) if "name" not in d else ('json: path "a[1]": [1] applied to an object with keys', True) for d in docs]


def test_handles_on_xml(spark):
    docs = ['<Bundle><entry><id value="1"/></entry><skip/><entry><id value="2"/></entry>tail</Bundle>', "<entry>text</entry>", "<Bundle/>"]
    df, t = trees(spark, "xml", docs)
    m = t.each_segment("entry", lambda u, i, us: u.set("id/@value", F.concat(us[0].get("id/@value"), u.get("id/@value"))), where=lambda u, i: i == 1)
    df2 = materialise(df, "msg", m.col)
    m = t.each_segment("entry", lambda u, i, us: u.set("note", "first").set("@n", us.count), where=lambda u, i: i == 0)
    assert texts(df2, m.serialize()) == ['<Bundle><entry n="2"><id value="1"/><note>first</note></entry><skip/><entry><id value="12"/></entry>tail</Bundle>',
                                        '<entry n="1"><note>first</note></entry>', "<Bundle/>"]
    assert texts(df, t.segments("entry")) == [['<entry><id value="1"/></entry>', '<entry><id value="2"/></entry>'], ["text"], []]


HL7 = ("MSH|^~\\&|SEND|SFAC|RECV|RFAC|20260730||ADT^A01|CTRL001|P|2.5\rPID|1||MRN1~MRN2||DOE^JOHN\rOBX|1|NM|WT||70|kg\rNTE|1||between\rOBX|2|NM|HT||180|cm\r")


def test_handles_on_segments(spark):
    df = parse_delimited(spark.createDataFrame([(0, HL7), (1, HL7.replace("OBX", "ZBX"))], "id int, raw string"), HL7V2)
    m = Parsed("msg", HL7V2)
    n = m.each_segment("OBX", lambda s, i, all_: s.set("1", i + 100))
    assert texts(df, n.serialize()) == [HL7.replace("OBX|1|", "OBX|100|").replace("OBX|2|", "OBX|101|"), HL7.replace("OBX", "ZBX")]
    n = m.each_segment("OBX", lambda s, i, all_: s.set("5", F.concat(all_[0].get("5"), F.lit("/"), s.get("5"))), where=lambda s, i: i == 1)
    assert texts(df, n.serialize())[0] == HL7.replace("180", "70/180")
    # nested: second repetition, a component, a subcomponent; separators are escaped; other segments stay where they are
    n = m.each_segment("PID", lambda s, i, all_: s.set("3[2]", F.concat(s.get("3"), F.lit("^"))).set("5.2.2", "SUB").set("9[3].2", s.get("3[2]")))
    assert texts(df, n.serialize())[0] == HL7.replace("MRN1~MRN2||DOE^JOHN", "MRN1~MRN1^||DOE^JOHN&SUB||||~~^MRN2")
    assert texts(df, m.each_segment("OBX", lambda s, i, all_: s.set("1", all_.count)).get_all("OBX-1"))[0] == ["2", "2"]
    for rel in ("", "x", "0", "OBX-1"):
        with pytest.raises(ValueError):
            m.each_segment("OBX", lambda s, i, all_, rel=rel: s.set(rel, 1))


def test_many_segments_are_linear(spark):
    raw = "MSH|^~\\&|A\r" + "".join(f"OBX|{i}|NM|x\rNTE|{i}\r" for i in range(4000))
    df = parse_delimited(spark.createDataFrame([(0, raw)], "id int, raw string"), HL7V2)
    got = texts(df, Parsed("msg", HL7V2).each_segment("OBX", lambda s, i, all_: s.set("1", i + 7)).serialize())[0]
    assert got == re.sub(r"OBX\|(\d+)", lambda m: f"OBX|{int(m[1]) + 7}", raw)


def test_reads_take_the_first_match_of_any_segment_or_repetition(spark):
    head = "MSH|^~\\&|A||||||ADT^A01"
    bodies = ["PID|1||~^^z||^g~h^i^k", "PID\rPID|1||3^4~5^6&7||f^g", "PID|1||a\rPID|2||b^c~^d&e||~~x^y^z", "ZZZ|1", "PID|1||a\\T\\b^c\\X41\\"]
    df = spark.createDataFrame([(i, f"{head}\r{b}") for i, b in enumerate(bodies)], "id int, raw string").repartition(2)
    df, m = parse_delimited(df, HL7V2), Parsed("msg", HL7V2)
    paths = ["PID-3", "PID-3.1", "PID-3.2", "PID-3.3", "PID-3[2].1", "PID-3[2].2.2", "PID-5.2", "PID-5.3", "PID[1]-3.2", "PID[2]-3", "MSH-9.2"]
    for r in df.select(*(m.get(p).alias(f"one_{i}") for i, p in enumerate(paths)), *(m.get_all(p).alias(f"all_{i}") for i, p in enumerate(paths))).collect():
        for i, p in enumerate(paths):
            assert r[f"one_{i}"] == next(iter(r[f"all_{i}"]), None), p
    # the first segment of a name is found in compiled code: a search through all of them stands below a CASE only
    plan = df.select(m.get("PID-3").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan


def test_serialised_fields_are_tested_a_segment_at_a_time(spark):
    raws = ["MSH|^~\\&|a\\T\\b|c\rPID|1||x\\X41\\y^z\\Zq\\|\\E\\|t\rPV1||||", "MSH|^~\\&\rPID|1|2|3", "MSH|^~\\&||\rZZZ|\x02a|b\\X0D\\"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string").repartition(2)
    df, m = parse_delimited(df, HL7V2), Parsed("msg", HL7V2)
    df = df.select("id", m.serialize().alias("t"))
    assert [r.t for r in df.orderBy("id").collect()] == [
        "MSH|^~\\&|a\\T\\b|c\rPID|1||xAy^z\\Zq\\|\\E\\|t\rPV1||||\r", "MSH|^~\\&\rPID|1|2|3\r", "MSH|^~\\&||\rZZZ|\\X02\\a|b\\X0D\\\r"]
    assert "array(array_join(" in df._jdf.queryExecution().optimizedPlan().toString()
