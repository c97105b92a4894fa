"""Queries over message text: parsing, paths, conversion, difference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.builder import new_message
from ..functions.delimited import ASTM, HL7V2, Parsed, parse_delimited
from ..functions.scalars import csv_row
from ..functions.trees import Tree, parse_tree
from ..operators.leaves import added_removed, diff, flatten_delimited, flatten_tree, invalid_and_valid, rebuild, segment_rows
from ..plans import translators as tr
from ..plans.channel import Channel, Destination, run_channel
from ..plans.formats import ArrowText
from . import feeds
from .feeds import parsed_hl7, table
from .registry import query

CENTS = "CAST(round({} * 100) AS BIGINT)"


def cents(text):
    return (text.cast("decimal(18,2)") * 100).cast("long")


def to_astm(df, text):
    """Re-read built ASTM text."""
    return parse_delimited(df.withColumn("raw", text), ASTM), Parsed("msg", ASTM)


@query("orders_by_customer", f"""
SELECT o_custkey AS custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines,
       CAST(coalesce(sum({CENTS.format('l_extendedprice')}), 0) AS BIGINT) AS price_cents
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def orders_by_customer(spark, sf):
    df, m = parsed_hl7(feeds.orders_hl7(spark, sf))
    price = F.aggregate(F.transform(m.segments("OBR"), lambda s: cents(m.at(s, "OBR", "23"))), F.lit(0).cast("long"),
                        lambda a, x: a + x)
    per_msg = df.select("msg_id", m.get("PID-3").cast("long").alias("custkey"), F.size(m.segments("OBR")).alias("n"),
                        price.alias("price"))
    # an order may come as several messages
    per_order = per_msg.groupBy("custkey", "msg_id").agg(F.sum("n").alias("n"), F.sum("price").alias("price"))
    return per_order.groupBy("custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"),
                                            F.sum("price").alias("price_cents"))


@query("order_lines_by_priority", f"""
SELECT o_orderpriority AS priority, count(*) AS lines, count(DISTINCT l_partkey) AS parts,
       CAST(sum({CENTS.format('l_quantity')}) AS BIGINT) AS quantity_cents, min(strftime(l_shipdate, '%Y%m%d%H%M%S')) AS first_ship
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def order_lines_by_priority(spark, sf):
    df, m = parsed_hl7(feeds.orders_hl7(spark, sf))
    seg = segment_rows(df, ["msg"], HL7V2, name="OBR")
    at = lambda rel: m.at(F.col("fields"), "OBR", rel)
    rows = seg.select(at("5").alias("priority"), at("4.1").alias("part"), at("9").alias("qty"), at("7").alias("ship"))
    return rows.groupBy("priority").agg(F.count("*").alias("lines"), F.count_distinct("part").alias("parts"),
                                        F.sum(cents(F.col("qty"))).alias("quantity_cents"), F.min("ship").alias("first_ship"))


@query("orders_to_instrument", """
SELECT CASE o_orderstatus WHEN 'O' THEN 'N' WHEN 'P' THEN 'C' ELSE 'A' END AS action, o_orderpriority AS priority,
       count(*) AS records, CAST(sum(l_partkey) AS BIGINT) AS part_sum, CAST(sum(l_orderkey) AS BIGINT) AS specimen_sum
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def orders_to_instrument(spark, sf):
    df, m = parsed_hl7(feeds.orders_hl7(spark, sf))
    df = tr.order_to_astm(m).add_to(df.select("msg_id", "msg"), "raw")
    df, a = parse_delimited(df, ASTM), Parsed("msg", ASTM)
    rows = segment_rows(df, ["msg"], ASTM, name="O")
    at = lambda rel: a.at(F.col("fields"), "O", rel)
    rows = rows.select(at("11").alias("action"), at("5").alias("priority"), at("4.4").cast("long").alias("part"),
                       at("2").cast("long").alias("specimen"))
    return rows.groupBy("action", "priority").agg(F.count("*").alias("records"), F.sum("part").alias("part_sum"),
                                                  F.sum("specimen").alias("specimen_sum"))


@query("results_round_trip", f"""
SELECT l_partkey AS part, count(*) AS n, CAST(sum({CENTS.format('l_quantity')}) AS BIGINT) AS quantity_cents,
       CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS price_cents,
       count(*) FILTER (l_discount > 0.05) AS low_flags, count(*) FILTER (l_linestatus <> 'F') AS preliminary
FROM lineitem GROUP BY 1""")
def results_round_trip(spark, sf):
    df, m = parsed_hl7(feeds.results_oru(spark, sf))
    df, a = to_astm(df.select("msg_id", "msg"), tr.oru_to_result(m).text())
    df = df.select("msg_id", tr.result_to_oru(a).text().alias("raw"))
    df, b = parsed_hl7(df)
    r = df.select(b.get("OBX-3.1").cast("long").alias("part"), b.get("OBX[1]-5").alias("qty"), b.get("OBX[2]-5").alias("price"),
                  b.get("OBX[2]-8").alias("flag"), b.get("OBX[2]-11").alias("status"))
    return r.groupBy("part").agg(F.count("*").alias("n"), F.sum(cents(F.col("qty"))).alias("quantity_cents"),
                                 F.sum(cents(F.col("price"))).alias("price_cents"), F.count_if(F.col("flag") == "L").alias("low_flags"),
                                 F.count_if(F.col("status") == "P").alias("preliminary"))


@query("query_answers", """
SELECT o_orderkey AS specimen, CASE WHEN o_orderkey % 3 = 0 THEN 'ALL' ELSE o_orderpriority END AS test, 'Q' AS action,
       'F' AS closing FROM orders""")
def query_answers(spark, sf):
    o = table(spark, sf, "orders")
    q = new_message("astm").set("H-5", "ANALYZER").set("H-14", "20240101").set("Q-1", "1")
    q.set("Q-2.2", F.col("o_orderkey")).set("Q-3.4", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")))
    df, m = to_astm(o, q.text())
    df = df.filter(m.has_segment("Q")).select("msg")
    df, a = to_astm(df, tr.query_to_order(m).text())
    return df.select(a.get("O-2").cast("long").alias("specimen"), a.get("O-4.4").alias("test"), a.get("O-11").alias("action"),
                     a.get("L-2").alias("closing"))


@query("query_order_lookup", """
SELECT o_orderkey AS specimen, coalesce(max(l_partkey), -1) AS test FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def query_order_lookup(spark, sf):
    """The order for a queried specimen is looked up in the result feed."""
    q = new_message("astm").set("H-5", "ANALYZER").set("Q-1", "1").set("Q-2.2", F.col("o_orderkey"))
    df, m = to_astm(table(spark, sf, "orders"), q.text())
    asked = df.select(m.get("Q-2.2").alias("specimen"), "msg")
    res, r = parsed_hl7(feeds.results_oru(spark, sf))
    ordered = res.select(r.get("OBR-2").alias("specimen"), r.get("OBR-4.1").cast("long").alias("test"))
    ordered = ordered.groupBy("specimen").agg(F.max("test").cast("string").alias("test"))
    found = asked.join(ordered, "specimen", "left")
    df, a = to_astm(found, tr.query_to_order(m, F.coalesce("test", F.lit("-1"))).text())
    return df.select(a.get("O-2").cast("long").alias("specimen"), a.get("O-4.4").cast("long").alias("test"))


@query("segments_by_type", """
SELECT seg, CAST(sum(n) AS BIGINT) AS n, max(hi) AS last_occurrence FROM (
  SELECT unnest(['MSH', 'PID']) AS seg, 1 AS n, 1 AS hi FROM orders
  UNION ALL SELECT 'ORC', greatest(c, 1), greatest(c, 1) FROM (SELECT o_orderkey, count(l_orderkey) c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
  UNION ALL SELECT 'OBR', c, c FROM (SELECT l_orderkey, count(*) c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)) GROUP BY 1""")
def segments_by_type(spark, sf):
    df, m = parsed_hl7(feeds.orders_hl7(spark, sf))
    names = F.transform(m.segs, lambda s: s[0])
    occ = df.select(F.explode(F.transform(m.occurrences(), lambda o: F.struct(
        F.get(names, o["pos"]).alias("seg"), o["occ"].alias("occ")))).alias("x"))
    return occ.groupBy("x.seg").agg(F.count("*").alias("n"), F.max("x.occ").alias("last_occurrence"))


@query("document_escapes", """
SELECT lang, count(*) AS n, count(*) AS unchanged, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def document_escapes(spark, sf):
    d = table(spark, sf, "documents")
    b = new_message("hl7v2").set("MSH-10", F.col("doc_id")).set("OBX-3", F.col("lang")).set("OBX-5.1.1", F.col("text"))
    df, m = parsed_hl7(d.select("doc_id", F.col("text").alias("original"), b.text().alias("raw")))
    got = df.select(m.get("OBX-3").alias("lang"), "original", m.get("OBX-5").alias("got"))
    return got.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("original")).alias("unchanged"),
                                   F.sum(F.length("got")).alias("chars"))


@query("conversation_canonical", """
SELECT role, count(*) AS n, count(*) AS stable, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def conversation_canonical(spark, sf):
    """Serialising a parsed message gives the message back, and again."""
    c = table(spark, sf, "conversations")
    b = new_message("hl7v2").set("MSH-10", F.concat_ws(".", "conv_id", "turn")).set("NTE-1", F.col("role")).set("NTE-3.1.1", F.col("text"))
    df, m = parsed_hl7(c.select(b.text().alias("raw")))
    df = df.select(F.col("raw").alias("wire"), m.serialize().alias("raw"))
    df, m = parsed_hl7(df)
    got = df.select(m.get("NTE-1").alias("role"), (F.col("wire") == F.col("raw")).alias("same"), m.get("NTE-3").alias("text"))
    return got.groupBy("role").agg(F.count("*").alias("n"), F.count_if("same").alias("stable"), F.sum(F.length("text")).alias("chars"))


@query("customer_leaves", """
WITH v AS (SELECT unnest([
  {p: 'MSH-1', v: '|'}, {p: 'MSH-2', v: '^~\\&'}, {p: 'MSH-3', v: 'CRM'}, {p: 'MSH-9.1', v: 'ADT'}, {p: 'MSH-9.2', v: 'A08'},
  {p: 'MSH-10', v: 'C' || c_custkey}, {p: 'MSH-11', v: 'P'}, {p: 'MSH-12', v: '2.5.1'}, {p: 'PID-1', v: '1'},
  {p: 'PID-3', v: c_custkey::VARCHAR}, {p: 'PID-5.1', v: c_name}, {p: 'PID-5.2', v: c_mktsegment},
  {p: 'PID-8', v: CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END}]) AS x FROM customer)
SELECT x.p AS path, count(*) AS n, count(DISTINCT x.v) AS distinct_values, CAST(sum(length(x.v)) AS BIGINT) AS chars FROM v GROUP BY 1""")
def customer_leaves(spark, sf):
    df, _ = parsed_hl7(feeds.customers_hl7(spark, sf))
    return flatten_delimited(df, ["msg_id"], HL7V2).groupBy("path").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"), F.sum(F.length("value")).alias("chars"))


def _corrections(spark, sf):
    before, _ = parsed_hl7(feeds.customers_hl7(spark, sf))
    after, _ = parsed_hl7(feeds.customers_hl7(spark, sf, corrected=True))
    return [flatten_delimited(d, ["msg_id"], HL7V2) for d in (before, after)]


@query("correction_diff", """
SELECT c_custkey AS msg_id, 'PID-5.1' AS path, 'changed' AS op, c_name AS "from", 'NEW ' || c_name AS "to" FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'PID-5.2', 'removed', c_mktsegment, NULL FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 'PID-13', 'added', NULL, '555-0100' FROM customer WHERE c_custkey % 5 = 0""")
def correction_diff(spark, sf):
    return diff(*_corrections(spark, sf), ["msg_id"]).select("msg_id", "path", "op", "from", "to")


@query("correction_paths", """
SELECT 'PID-5.2' AS path, 'removed' AS op, count(*) AS n FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT 'PID-13', 'added', count(*) FROM customer WHERE c_custkey % 5 = 0""")
def correction_paths(spark, sf):
    return added_removed(*_corrections(spark, sf), ["msg_id"]).groupBy("path", "op").agg(F.count("*").alias("n"))


@query("cross_format_diff", """
SELECT op, count(*) AS n FROM (
  SELECT 'removed' AS op FROM customer, range(13)
  UNION ALL SELECT 'added' FROM customer, range(3)) GROUP BY 1""")
def cross_format_diff(spark, sf):
    """Received HL7 against the CSV it became: both flattened sides."""
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    before = flatten_delimited(df, ["msg_id"], HL7V2)
    csv = parse_tree(df.select("msg_id", tr.patient_csv(m).text().alias("raw")), "csv")
    return diff(before, flatten_tree(csv, ["msg_id"], "csv"), ["msg_id"]).groupBy("op").agg(F.count("*").alias("n"))


@query("uppercase_names", """
SELECT c_custkey AS msg_id, upper(c_name) AS family, c_mktsegment AS given, c_custkey AS mrn FROM customer""")
def uppercase_names(spark, sf):
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    df, m = parsed_hl7(df.select("msg_id", tr.uppercase_name(m).serialize().alias("raw")))
    return df.select("msg_id", m.get("PID-5.1").alias("family"), m.get("PID-5.2").alias("given"), m.get("PID-3").cast("long").alias("mrn"))


@query("structure_writes", """
SELECT c_custkey AS msg_id, c_custkey || '^^^' || c_nationkey AS id, c_mktsegment AS second_rep, 'Z' || c_custkey AS visit,
       3 AS observations FROM customer""")
def structure_writes(spark, sf):
    """Promotion, repetition padding and segment creation on real messages."""
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("msg_id"), "c_nationkey"), "msg_id"))
    m2 = m.set("PID-3.4", F.col("c_nationkey")).set("PID-3[2]", m.get("PID-5.2")).set(
        "PV1-19", F.concat(F.lit("Z"), m.get("PID-3"))).set("OBX[3]-1", "3")
    df, r = parsed_hl7(df.select("msg_id", m2.serialize().alias("raw")))
    return df.select("msg_id", r.get("PID-3").alias("id"), r.get("PID-3[2]").alias("second_rep"), r.get("PV1-19").alias("visit"),
                     F.size(r.segments("OBX")).alias("observations"))


_BAD = [(0, "hl7v2: empty message"), (1, "hl7v2: message must start with a header segment (MSH, BHS, or FHS)"),
        (2, 'hl7v2: segment 3: invalid segment name "p1d"'), (3, 'hl7v2: header delimiters: delimiter "^" is used twice'),
        (4, 'hl7v2: segment 3: too short: "ZZ"'), (5, 'hl7v2: segment 3: expected "|" after segment name ZZZ')]


@query("invalid_messages", "SELECT error_text, count(*) AS n FROM (SELECT CASE c_custkey % 97 " + " ".join(
    f"WHEN {k} THEN 'parse (hl7v2): {t}'" for k, t in _BAD) + " ELSE 'ok' END AS error_text FROM customer) GROUP BY 1")
def invalid_messages(spark, sf):
    df, _ = parsed_hl7(feeds.bad_mix(spark, sf))
    bad, good = invalid_and_valid(df, "hl7v2")
    both = bad.select("error_text").unionByName(good.select(F.lit("ok").alias("error_text")))
    return both.groupBy("error_text").agg(F.count("*").alias("n"))


@query("rebuilt_messages", "SELECT count(*) AS n, count(*) AS identical FROM customer")
def rebuilt_messages(spark, sf):
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    seg = segment_rows(df.select("msg_id", "msg"), ["msg_id"], HL7V2)
    text = F.when(F.col("fields")[0] == "MSH", F.concat(F.lit("MSH|"), F.array_join(F.slice("fields", F.lit(3), F.size("fields")), "|"))
                  ).otherwise(F.array_join("fields", "|"))
    again = rebuild(seg.select("msg_id", "pos", text.alias("text")), ["msg_id"])
    j = df.select("msg_id", F.col("raw").alias("wire")).join(again, "msg_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("wire") == F.col("raw")).alias("identical"))


@query("repeated_values", """
SELECT user_id AS visit_no, max('MAIN' || lpad(user_id::VARCHAR, 7, '0') || ';EID' || lpad((user_id % 40)::VARCHAR, 7, '0')) AS ids,
       count(*) AS n FROM events GROUP BY 1""")
def repeated_values(spark, sf):
    df, m = parsed_hl7(feeds.events_adt(spark, sf))
    r = df.select(F.substring(m.get("PV1-19"), 2, 9).cast("long").alias("visit_no"), F.array_join(m.get_all("PID-3.1"), ";").alias("ids"))
    return r.groupBy("visit_no").agg(F.max("ids").alias("ids"), F.count("*").alias("n"))


# ---- JSON, XML, CSV -------------------------------------------------------

_ACCEPTED = """c_custkey % 10 <> 9"""


@query("fhir_to_adt", f"""
SELECT c_custkey AS mrn, c_name AS family, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS given,
       strftime(DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y%m%d') AS birth,
       CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 'FHIRpat-' || c_custkey AS control_id
FROM customer WHERE {_ACCEPTED}""")
def fhir_to_adt(spark, sf):
    def translate(m):
        m.reject(*tr.fhir_rejection(m))
        return tr.fhir_to_adt(m)

    ch = Channel("webhook", "http-listener", "json", [Destination("adt", "mllp-sender", "hl7v2")], transformers=[translate])
    _, dest = run_channel(ch, feeds.patients_json(spark, sf).withColumn("meta", F.create_map().cast("map<string,string>")))
    df, m = parsed_hl7(dest.filter("state = 'QUEUED'").select(F.col("payload").alias("raw")))
    return df.select(m.get("PID-3.1").cast("long").alias("mrn"), m.get("PID-5.1").alias("family"), m.get("PID-5.2").alias("given"),
                     m.get("PID-7").alias("birth"), m.get("PID-8").alias("sex"), m.get("MSH-10").alias("control_id"))


@query("fhir_acks", """
SELECT CASE WHEN c_custkey % 10 = 9 THEN 'ERROR' ELSE 'TRANSFORMED' END AS state, CASE WHEN c_custkey % 10 = 9 THEN 'AR' ELSE 'AA' END AS ack_code,
  CASE WHEN c_custkey % 10 = 9 THEN 'translator 1: rejected (AR): expected a Patient resource, got Device' ELSE '' END AS error_text,
  count(*) AS n FROM customer GROUP BY ALL""")
def fhir_acks(spark, sf):
    def translate(m):
        m.reject(*tr.fhir_rejection(m))
        return tr.fhir_to_adt(m)

    ch = Channel("webhook", "http-listener", "json", [Destination("adt", "mllp-sender", "hl7v2")], transformers=[translate])
    msgs, _ = run_channel(ch, feeds.patients_json(spark, sf).withColumn("meta", F.create_map().cast("map<string,string>")))
    return msgs.groupBy("state", "ack_code", "error_text").agg(F.count("*").alias("n"))


@query("fhir_xml_to_adt", """
SELECT c_custkey AS mrn, c_name AS family, c_mktsegment AS given, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
       'FHIRXpat-' || c_custkey AS control_id FROM customer""")
def fhir_xml_to_adt(spark, sf):
    x = parse_tree(feeds.patients_xml(spark, sf), "xml")
    df, m = parsed_hl7(x.select(tr.fhir_xml_to_adt(Tree("msg", "xml")).text().alias("raw")))
    return df.select(m.get("PID-3.1").cast("long").alias("mrn"), m.get("PID-5.1").alias("family"), m.get("PID-5.2").alias("given"),
                     m.get("PID-8").alias("sex"), m.get("MSH-10").alias("control_id"))


@query("adt_to_fhir_full", """
SELECT DISTINCT 'MAIN' || lpad(user_id::VARCHAR, 7, '0') AS id, 'EID' || lpad((user_id % 40)::VARCHAR, 7, '0') AS enterprise_id,
       'FAM' || user_id AS family, '1980-01-01' AS birth, CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
       'urn:mrn:MAIN' AS system, 'true' AS active FROM events""")
def adt_to_fhir_full(spark, sf):
    df, m = parsed_hl7(feeds.events_adt(spark, sf))
    df = parse_tree(df.select(tr.fhir_patient_full(m).text().alias("raw")), "json")
    t = Tree("msg", "json")
    return df.select(t.get("id").alias("id"), t.get("identifier[1].value").alias("enterprise_id"), t.get("name.family").alias("family"),
                     t.get("birthDate").alias("birth"), t.get("gender").alias("gender"), t.get("identifier[0].system").alias("system"),
                     t.get("active").alias("active")).distinct()


@query("adt_to_fhir_short", """
SELECT c_custkey AS msg_id, c_custkey::VARCHAR AS id, c_name AS family, c_mktsegment AS given,
       CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM customer""")
def adt_to_fhir_short(spark, sf):
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    df = parse_tree(df.select("msg_id", tr.fhir_patient(m).text().alias("raw")), "json")
    t = Tree("msg", "json")
    return df.select("msg_id", t.get("id").alias("id"), t.get("name[0].family").alias("family"), t.get("name[0].given").alias("given"),
                     t.get("gender").alias("gender"))


@query("event_json_values", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def event_json_values(spark, sf):
    df = parse_tree(table(spark, sf, "events").select("event_type", F.col("props").alias("raw")), "json")
    return df.select("event_type", Tree("msg", "json").get("k").cast("long").alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("event_json_typed", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1""")
def event_json_typed(spark, sf):
    """Typed access without leaving the JVM, where literals need not be kept."""
    v = F.try_parse_json("props")
    e = table(spark, sf, "events").select(F.try_variant_get(v, "$.k", "bigint").alias("k"))
    return e.groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("fhir_json_leaves", """
WITH v AS (SELECT unnest([
  {p: 'resourceType', v: CASE WHEN c_custkey % 10 = 9 THEN 'Device' ELSE 'Patient' END}, {p: 'id', v: 'pat-' || c_custkey},
  {p: 'identifier[0].system', v: 'urn:mrn'}, {p: 'identifier[0].value', v: c_custkey::VARCHAR}, {p: 'name[0].family', v: c_name},
  {p: 'name[0].given[0]', v: CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END},
  {p: 'birthDate', v: strftime(DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y-%m-%d')},
  {p: 'gender', v: CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END}]) AS x FROM customer)
SELECT x.p AS path, count(*) AS n, CAST(sum(length(x.v)) AS BIGINT) AS chars FROM v WHERE x.v IS NOT NULL GROUP BY 1""")
def fhir_json_leaves(spark, sf):
    df = parse_tree(feeds.patients_json(spark, sf), "json")
    return flatten_tree(df, ["msg_id"], "json").groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("fhir_xml_leaves", """
WITH v AS (SELECT unnest([
  {p: 'Patient/@xmlns', v: 'http://hl7.org/fhir'}, {p: 'Patient/id/@value', v: 'pat-' || c_custkey},
  {p: 'Patient/identifier/value/@value', v: c_custkey::VARCHAR}, {p: 'Patient/name/family/@value', v: c_name},
  {p: 'Patient/name/given/@value', v: c_mktsegment},
  {p: 'Patient/gender/@value', v: CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END}]) AS x FROM customer)
SELECT x.p AS path, count(*) AS n, CAST(sum(length(x.v)) AS BIGINT) AS chars FROM v GROUP BY 1""")
def fhir_xml_leaves(spark, sf):
    df = parse_tree(feeds.patients_xml(spark, sf), "xml")
    return flatten_tree(df, ["msg_id"], "xml").groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def _documents(spark, sf, raw):
    return table(spark, sf, "documents").select("lang", F.col("text").alias("original"), raw.alias("raw"))


def _unchanged(df, value):
    got = df.select("lang", "original", value.alias("got"))
    return got.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("original")).alias("unchanged"),
                                   F.sum(F.length("got")).alias("chars"))


_DOCS = "SELECT lang, count(*) AS n, count(*) AS unchanged, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1"


@query("document_json", _DOCS)
def document_json(spark, sf):
    b = new_message("json").set("doc.text", F.col("text")).set("doc.n", 1)
    df = parse_tree(_documents(spark, sf, b.text()), "json")
    return _unchanged(df, Tree("msg", "json").get("doc.text"))


@query("document_xml", _DOCS)
def document_xml(spark, sf):
    b = new_message("xml").set("doc/@lang", F.col("lang")).set("doc/text", F.col("text"))
    df = parse_tree(_documents(spark, sf, b.text()), "xml")
    return _unchanged(df, Tree("msg", "xml").get("doc/text"))


@query("document_csv", _DOCS)
def document_csv(spark, sf):
    b = new_message("csv").set("R.1", F.col("doc_id")).set("R.2", F.col("text")).set("R[2].1", F.col("lang"))
    df = parse_tree(_documents(spark, sf, b.text()), "csv")
    return _unchanged(df, Tree("msg", "csv").get("R.2"))


@query("patient_csv_rows", """
SELECT c_custkey AS msg_id, c_custkey || ',' || c_name || ',' || c_mktsegment || ',' AS line, 4 AS columns FROM customer""")
def patient_csv_rows(spark, sf):
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    df = parse_tree(df.select("msg_id", tr.patient_csv(m).text().alias("raw")), "csv")
    row = F.get(Tree("msg", "csv").rows(), F.lit(0))
    return df.select("msg_id", csv_row(row).alias("line"), F.size(row).alias("columns"))


@query("xml_errors", """
SELECT c_custkey AS msg_id, c_custkey % 5 = 0 AS well_formed, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS name FROM customer""")
def xml_errors(spark, sf):
    """XML of every customer, four fifths of it broken: cut off, a wrong end tag, a declared entity, two roots."""
    k, name = F.col("c_custkey"), F.col("c_name")
    good = F.concat(F.lit("<c><n>"), name, F.lit("</n></c>"))
    raw = (F.when(k % 5 == 0, good).when(k % 5 == 1, F.substring(good, 1, 10)).when(k % 5 == 2, F.concat(F.lit("<c><n>"), name, F.lit("</m></c>")))
           .when(k % 5 == 3, F.concat(F.lit('<!DOCTYPE c [<!ENTITY e "x">]>'), good)).otherwise(F.concat(good, good)))
    df = parse_tree(table(spark, sf, "customer").select(k.alias("msg_id"), raw.alias("raw")), "xml")
    return df.select("msg_id", F.col("msg.error").isNull().alias("well_formed"), Tree("msg", "xml").get("c/n").alias("name"))


# ---- writes on received messages --------------------------------------------

_GIVEN = "CASE WHEN c_nationkey % 3 <> 0 THEN '\"given\":[\"' || c_mktsegment || '\",\"Q\"]' ELSE '\"given\":[null,\"Q\"]' END"


@query("json_edits", f"""
SELECT c_custkey AS msg_id, '{{"resourceType":"' || CASE WHEN c_custkey % 10 = 9 THEN 'Device' ELSE 'Patient' END || '","id":"pat-' || c_custkey
  || '","identifier":[{{"system":"urn:mrn","value":' || c_custkey || '}},null,{{"use":"old"}}],"name":[{{"family":"' || c_name || '",' || {_GIVEN}
  || '}}],"birthDate":null,"gender":{{"text":"' || CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END || '"}},"meta":{{"odd.key":{{"nation":'
  || c_nationkey || ',"even":' || CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}}}' AS text FROM customer""")
def json_edits(spark, sf):
    """Received resources rewritten: typed values, padded arrays, a leaf that becomes an object, created members."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("msg_id"), "c_custkey", "c_nationkey")
    df, t = parse_tree(feeds.patients_json(spark, sf).join(own, "msg_id"), "json"), Tree("msg", "json")
    new = t.set("identifier[0].value", F.col("c_custkey")).set("identifier[2].use", "old").set("name.given[1]", "Q").set("birthDate", None) \
        .set("gender.text", t.get("gender")).set('meta["odd.key"].nation', F.col("c_nationkey")).set('meta["odd.key"].even', F.col("c_nationkey") % 2 == 0)
    return df.select("msg_id", new.serialize().alias("text"))


@query("xml_edits", """
SELECT c_custkey AS msg_id, '<Patient xmlns="http://hl7.org/fhir"><id value="x-' || c_custkey || '"/><identifier><value value="' || c_custkey
  || '" use="old"/></identifier><name><family value="' || c_name || '"/><given value="' || c_mktsegment || '"/><given/><given>Q &amp; A</given></name><gender value="' || g || '">'
  || g || '</gender><contact><name><family value="' || c_name || '"/></name></contact></Patient>' AS text
FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS g FROM customer)""")
def xml_edits(spark, sf):
    """Received resources rewritten: attributes, text in place of content, further occurrences, created elements."""
    df, t = parse_tree(feeds.patients_xml(spark, sf), "xml"), Tree("msg", "xml")
    new = t.set("Patient/id/@value", F.concat(F.lit("x-"), t.get("Patient/identifier/value/@value"))).set("Patient/identifier/value/@use", "old") \
        .set("Patient/name/given[3]", "Q & A").set("Patient/gender", t.get("Patient/gender/@value")).set("Patient/contact/name/family/@value", t.get("Patient/name/family/@value"))
    return df.select("msg_id", new.serialize().alias("text"))


@query("csv_edits", """
SELECT c_custkey AS msg_id, '0,' || c_custkey || ',"' || c_name || ', Ltd",' || c_mktsegment || chr(10) || '1,,' || c_name || chr(10) || '""' || chr(10)
  || ',,"a ""b"' || '""' || chr(10) AS text FROM customer""")
def csv_edits(spark, sf):
    """Received rows rewritten: a number before each of the first rows, a cell beyond the last, a row beyond the last."""
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    raw = F.concat(F.lit("x,"), k, F.lit(',"'), name, F.lit('"\r\ny,,"'), name, F.lit('"\n""\n'))
    df = parse_tree(table(spark, sf, "customer").select(F.col("c_custkey").alias("msg_id"), "c_mktsegment", raw.alias("raw")), "csv")
    t = Tree("msg", "csv")
    new = t.set("R.3", F.concat(t.get("R.3"), F.lit(", Ltd"))).set("R[1].4", F.col("c_mktsegment")).set("R[4].3", 'a "b"')
    new = new.each_segment("R", lambda row, i, rows: row.set("1", i), where=lambda row, i: i < 2)
    return df.select("msg_id", new.serialize().alias("text"))


@query("renumbered_observations", """
SELECT l_partkey AS part, count(*) AS n, '100;101' AS numbers, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS first_cents,
       l_partkey || '/PRICE' AS second_code, min('L' || l_suppkey) AS least_rep, max('L' || l_suppkey) AS greatest_rep FROM lineitem GROUP BY l_partkey""")
def renumbered_observations(spark, sf):
    """Every observation gets a new number and the second one a code made of both, through segment handles."""
    df, m = parsed_hl7(feeds.results_oru(spark, sf))
    new = m.each_segment("OBX", lambda s, i, all_: s.set("1", i + 100).set("3.1", F.when(i == 1, F.concat(all_[0].get("3.1"), F.lit("/"), s.get("3.1"))).otherwise(s.get("3.1"))))
    new = new.each_segment("PID", lambda s, i, all_: s.set("3[2].4.2", F.concat(F.lit("L"), s.get("3.1"))))
    df, r = parsed_hl7(df.select("msg_id", new.serialize().alias("raw")))
    got = df.select(r.get("OBR-4.1").cast("long").alias("part"), F.array_join(r.get_all("OBX-1"), ";").alias("numbers"), cents(r.get("OBX[1]-5")).alias("cents"),
                    r.get("OBX[2]-3.1").alias("second_code"), r.get("PID-3[2].4.2").alias("rep"))
    return got.groupBy("part", "numbers", "second_code").agg(F.count("*").alias("n"), F.sum("cents").alias("first_cents"),
                                                             F.min("rep").alias("least_rep"), F.max("rep").alias("greatest_rep"))


@query("arrow_step", """
SELECT c_custkey AS msg_id, CASE WHEN c_custkey % 97 = 5 THEN 'ERROR' ELSE 'TRANSFORMED' END AS state,
  CASE WHEN c_custkey % 97 = 5 THEN 'translator 1: ValueError: no code for ' || c_name ELSE '' END AS error_text,
  CASE WHEN c_custkey % 97 <> 5 THEN c_custkey || ',"' || reverse(c_name) || ', ' || c_mktsegment || '"' END AS line FROM customer""")
def arrow_step(spark, sf):
    """A user's function over Arrow batches as a step of a chain; the rows it fails on stop alone."""
    def coded(batch):
        out = []
        for mrn, name, given in zip(*(c.to_pylist() for c in batch.columns)):
            if int(mrn) % 97 == 5:
                raise ValueError(f"no code for {name}")
            out.append(f'{mrn},"{name[::-1]}, {given}"\n')
        return out

    def translate(m):
        return ArrowText(coded, "csv", mrn=m.get("PID-3"), name=m.get("PID-5.1"), given=m.get("PID-5.2"))

    ch = Channel("codes", "mllp-listener", "hl7v2", [Destination("out", "file-writer", "csv")], transformers=[translate])
    msgs, _ = run_channel(ch, feeds.customers_hl7(spark, sf).withColumn("meta", F.create_map().cast("map<string,string>")))
    return msgs.select("msg_id", "state", "error_text", F.rtrim(F.replace(F.col("transformed").cast("string"), F.lit("\n"), F.lit(" "))).alias("line"))
