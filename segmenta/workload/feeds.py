"""Messages rendered from the tables, and the same messages read back.

Every query of the workload goes table -> wire text -> parse -> compute, so
its answer comes from the text.  Whole tables are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builder import new_message
from ..functions.columns import materialise
from ..functions.delimited import HL7V2, Parsed, parse_delimited
from ..functions.scalars import composite, hl7_time, parse_hl7_time
from ..plans.translators import render_adt

# How the event table's types map to triggers and outcomes.
EVENT_TRIGGERS = {"signup": "A01", "click": "A02", "purchase": "A03", "view": "A08", "error": "A11"}
EVENT_OUTCOMES = {"error": "permanent", "view": "transient"}
BEDS = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Rendering and parsing are far more work than reading, so rows are dealt
    out where the scan has too few splits: at least one a core, and no task
    with many more rows than ``ROWS_A_TASK`` however few files hold them."""
    splits, least = df.rdd.getNumPartitions(), least_tasks(df)
    return df.repartition(least) if splits < least else df


def least_tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def numbered_lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Line items with a row number taken at the scan, where it is repeatable."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(*(columns or li.columns), F.monotonically_increasing_id().alias("uid"))


def mapped(col: Column, table: dict[str, str], default: str | None = None) -> Column:
    expr = F
    for k, v in table.items():
        expr = expr.when(col == k, v)
    return expr.otherwise(F.lit(default))


def money(col: Column) -> Column:
    return F.format_string("%.2f", col)


def orders_hl7(spark: SparkSession, sf: str) -> DataFrame:
    """msg_id, raw: one ORM^O01 message per order, with all its lines.

    A message is one row by its nature, whatever its size.  Both sides are dealt by order at once, so that nothing moves
    twice, and orders meet their customers before they get their lines.  What a line says is rendered while it is a row,
    in compiled code, with a mark where the order's priority goes."""
    o, c = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    li = numbered_lines(spark, sf, "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    tasks, mark, empty = least_tasks(li), F.lit("\x1f"), [F.lit("")]
    text = F.concat(composite(F.col("l_partkey"), "", "L"), mark, F.concat_ws(
        "|", *empty, hl7_time(F.col("l_shipdate")), *empty, F.col("l_quantity").cast("decimal(18,2)").cast("string"),
        *empty * 13, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    rows = materialise(li.repartition(tasks, "l_orderkey"), "line", F.struct("uid", text.alias("text")), ["l_orderkey"])
    lines = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    o = o.join(c.select("c_custkey", "c_name"), o.o_custkey == c.c_custkey, "left").repartition(tasks, "o_orderkey")
    m = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    control = F.when(F.col("o_orderstatus") == "O", "NW").when(F.col("o_orderstatus") == "P", "CA").otherwise("SC")
    out = new_message("hl7v2")
    for path, v in {"MSH-3": F.lit("SIM"), "MSH-7": hl7_time(F.col("o_orderdate")), "MSH-9.1": F.lit("ORM"),
                    "MSH-9.2": F.lit("O01"), "MSH-10": F.concat(F.lit("ORM"), F.col("o_orderkey").cast("string")), "MSH-11": F.lit("P"), "MSH-12": F.lit("2.5.1"),
                    "PID-1": F.lit("1"), "PID-3": F.col("o_custkey"), "PID-5.1": F.col("c_name")}.items():
        out.set(path, v)
    key, sep = F.col("o_orderkey").cast("string"), F.lit("\r")
    orc = F.concat(F.lit("ORC|"), control, F.lit("|"), key, sep)
    # a missing priority takes its place with it, as other missing values do
    priority = F.concat(F.concat_ws("|", F.lit(""), "o_orderpriority"), F.lit("|"))
    pair = F.concat(orc, F.lit("OBR|1|"), key, F.lit("||"))
    pairs = F.concat(pair, F.replace(F.call_function("array_join", F.col("lines.text"), F.concat(sep, pair)), mark, priority), sep)
    # an order without lines still announces itself, with its ORC only
    body = F.when(F.size("lines") > 0, pairs).otherwise(orc)
    return m.select(F.col("o_orderkey").alias("msg_id"), F.concat(out.text(), body).alias("raw"))


def results_oru(spark: SparkSession, sf: str) -> DataFrame:
    """msg_id, raw: one ORU^R01 per line item row with two observations."""
    li = spread(numbered_lines(spark, sf)).withColumnRenamed("uid", "msg_id")
    out = new_message("hl7v2")
    for path, v in {"MSH-3": "LAB", "MSH-7": hl7_time(F.col("l_shipdate")), "MSH-9.1": "ORU", "MSH-9.2": "R01",
                    "MSH-10": F.concat(F.lit("R"), F.col("msg_id").cast("string")), "MSH-11": "P", "MSH-12": "2.5.1",
                    "PID-1": "1", "PID-3.1": F.col("l_suppkey"), "PID-5.1": F.col("l_returnflag"), "PID-5.2": F.col("l_linestatus"),
                    "OBR-1": "1", "OBR-2": F.col("l_orderkey"), "OBR-4.1": F.col("l_partkey"), "OBR-7": hl7_time(F.col("l_shipdate")),
                    "OBX-1": "1", "OBX-2": "NM", "OBX-3.1": F.col("l_partkey"), "OBX-5": money(F.col("l_quantity")), "OBX-6": "EA",
                    "OBX-8": "N", "OBX-11": "F",
                    "OBX[2]-1": "2", "OBX[2]-2": "NM", "OBX[2]-3.1": "PRICE", "OBX[2]-5": money(F.col("l_extendedprice")),
                    "OBX[2]-6": "USD", "OBX[2]-8": F.when(F.col("l_discount") > 0.05, "L").otherwise("N"),
                    "OBX[2]-11": F.when(F.col("l_linestatus") == "F", "F").otherwise("P")}.items():
        out.set(path, v)
    return li.select("msg_id", out.text().alias("raw"))


def bed(n: Column) -> Column:
    """unit^room^bed^facility of a bed number; ten beds to a unit."""
    return composite(F.concat(F.lit("U"), F.floor(n / 10).cast("string")), F.concat(F.lit("R"), (n % 10).cast("string")), "1",
                     "MAIN")


def events_adt(spark: SparkSession, sf: str) -> DataFrame:
    return adt_of(table(spark, sf, "events"))


def adt_of(e: DataFrame) -> DataFrame:
    """msg_id, raw: one ADT message per event, of a table or a stream; the user is the visit."""
    trig = mapped(F.col("event_type"), EVENT_TRIGGERS)
    text = render_adt({
        "trigger": trig, "at": F.col("ts"), "control_id": F.concat(F.lit("E"), F.col("event_id").cast("string")),
        "mrn": F.concat(F.lit("MAIN"), F.lpad(F.col("user_id").cast("string"), 7, "0")),
        "enterprise_id": F.concat(F.lit("EID"), F.lpad((F.col("user_id") % 40).cast("string"), 7, "0")),
        "home_facility": F.lit("MAIN"), "family": F.concat(F.lit("FAM"), F.col("user_id").cast("string")),
        "given": F.lit("G"), "birth": F.lit("19800101"), "sex": F.when(F.col("user_id") % 2 == 0, "F").otherwise("M"),
        "patient_class": F.lit("I"), "location": bed(F.col("event_id") % BEDS),
        "prior_location": F.when(trig == "A02", bed((F.col("event_id") * 7) % BEDS)),
        "visit": F.concat(F.lit("V"), F.lpad(F.col("user_id").cast("string"), 9, "0")),
        "admitted_at": F.col("ts"), "discharged_at": F.when(trig == "A03", F.col("ts"))})
    return e.select(F.col("event_id").alias("msg_id"), text.alias("raw"))


def parsed_hl7(df: DataFrame) -> tuple[DataFrame, Parsed]:
    return parse_delimited(df, HL7V2), Parsed("msg", HL7V2)


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return visits_of(events_adt(spark, sf))


def visits_of(messages: DataFrame) -> DataFrame:
    """Event rows read back from the ADT text."""
    df, m = parsed_hl7(messages)
    return df.select(
        F.col("msg_id").alias("seq"), m.get("PV1-19").alias("visit"), m.get("MSH-9.2").alias("trigger"),
        parse_hl7_time(m.get("EVN-2")).alias("ts"), m.get("PV1-3").alias("location"), m.get("PV1-6").alias("prior"),
        m.get("MSH-10").alias("control_id"), m.get("PID-3[1].1").alias("mrn"))


def patients_json(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    b = new_message("json")
    b.set("resourceType", F.when(F.col("c_custkey") % 10 == 9, "Device").otherwise("Patient"))
    b.set("id", F.concat(F.lit("pat-"), F.col("c_custkey").cast("string")))
    b.set("identifier[0].system", "urn:mrn").set("identifier[0].value", F.col("c_custkey").cast("string"))
    b.set("name[0].family", F.col("c_name"))
    b.set("name[0].given[0]", F.col("c_mktsegment"), when=F.col("c_nationkey") % 3 != 0)
    b.set("birthDate", F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.pmod("c_custkey", F.lit(9000)).cast("int")), "yyyy-MM-dd"))
    b.set("gender", F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female"))
    return c.select(F.col("c_custkey").alias("msg_id"), b.text().alias("raw"))


def patients_xml(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    b = new_message("xml")
    b.set("Patient/@xmlns", "http://hl7.org/fhir").set("Patient/id/@value", F.concat(F.lit("pat-"), F.col("c_custkey").cast("string")))
    b.set("Patient/identifier/value/@value", F.col("c_custkey").cast("string"))
    b.set("Patient/name[1]/family/@value", F.col("c_name")).set("Patient/name[1]/given[1]/@value", F.col("c_mktsegment"))
    b.set("Patient/gender/@value", F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female"))
    return c.select(F.col("c_custkey").alias("msg_id"), b.text().alias("raw"))


def customers_hl7(spark: SparkSession, sf: str, corrected: bool = False) -> DataFrame:
    """One ADT^A08 per customer; the corrected feed renames every seventh
    customer, adds a phone to every fifth and drops the segment of every
    eleventh."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("NEW "), F.col("c_name"))).otherwise(F.col("c_name")) if corrected else F.col("c_name")
    b = new_message("hl7v2")
    for path, v in {"MSH-3": "CRM", "MSH-9.1": "ADT", "MSH-9.2": "A08", "MSH-10": F.concat(F.lit("C"), k.cast("string")),
                    "MSH-11": "P", "MSH-12": "2.5.1", "PID-1": "1", "PID-3.1": k, "PID-5.1": name,
                    "PID-5.2": F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")) if corrected else F.col("c_mktsegment"),
                    "PID-8": F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F"),
                    "PID-13": F.when(k % 5 == 0, "555-0100").otherwise("") if corrected else ""}.items():
        b.set(path, v)
    return c.select(k.alias("msg_id"), b.text().alias("raw"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery attempts: the user is the destination, the day the message."""
    df, m = parsed_hl7(events_adt(spark, sf))
    outcomes = {t: EVENT_OUTCOMES[k] for k, t in EVENT_TRIGGERS.items() if k in EVENT_OUTCOMES}
    read = df.select("msg_id", m.get("PV1-19").alias("destination_id"), m.get("MSH-9.2").alias("trigger"),
                     m.get("EVN-2").alias("at"), m.get("MSH-10").alias("control_id"))
    return read.select(
        F.col("msg_id").alias("attempt_seq"), "destination_id", F.substring("at", 7, 2).cast("long").alias("msg_id"),
        parse_hl7_time(F.col("at")).alias("ts"), mapped(F.col("trigger"), outcomes, "sent").alias("outcome"),
        F.concat(F.lit("attempt "), "control_id").alias("error"))


def stored_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message store rows from the order feed: channel by priority, state by
    order status, read from header-only ORM text."""
    o = table(spark, sf, "orders")
    b = new_message("hl7v2")
    for path, v in {"MSH-3": F.col("o_orderpriority"), "MSH-7": hl7_time(F.col("o_orderdate")), "MSH-9.1": "ORM", "MSH-9.2": "O01",
                    "MSH-10": F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), "MSH-11": "P", "MSH-12": "2.5.1",
                    "ORC-1": F.col("o_orderstatus"), "ORC-2": F.col("o_orderkey"), "PID-3.1": F.col("o_custkey")}.items():
        b.set(path, v)
    df, m = parsed_hl7(o.select(F.col("o_orderkey").alias("msg_id"), b.text().alias("raw")))
    read = df.select("msg_id", "raw", m.get("MSH-3").alias("channel_id"), m.get("MSH-10").alias("control_id"),
                     m.get("ORC-1").alias("st"), m.get("PID-3.1").alias("mrn"), m.get("MSH-7").alias("at"))
    st, at = F.col("st"), parse_hl7_time(F.col("at"))
    state = F.when(st == "O", "RECEIVED").when(st == "F", "TRANSFORMED").otherwise("ERROR")
    return read.select(
        "msg_id", "channel_id", F.md5("control_id").alias("correlation_id"),
        F.lit(None).cast("long").alias("replay_of"), state.alias("state"), F.lit("hl7v2").alias("data_type"), "raw",
        F.when(~st.isin("O", "F"), F.when(F.col("msg_id") % 2 == 0, "parse (hl7v2): hl7v2: empty message").otherwise(
            "translator 1: failed")).otherwise("").alias("error_text"),
        "mrn", at.alias("received_at"), at.alias("updated_at"))


def stored_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """Two destinations per transformed message."""
    m = stored_messages(spark, sf).filter("state = 'TRANSFORMED'")
    d = m.select("msg_id", "channel_id", "raw", "received_at", F.explode(F.array(F.lit("csv"), F.lit("fhir"))).alias("destination_id"))
    pick = F.pmod(F.col("msg_id") + F.when(F.col("destination_id") == "csv", 0).otherwise(1), F.lit(5))
    state = F.when(pick == 0, "ERROR").when(pick == 1, "QUEUED").otherwise("SENT")
    return d.select("msg_id", "channel_id", "destination_id", state.alias("state"),
                    F.when(F.col("msg_id") % 13 != 0, F.col("raw")).alias("payload"), F.lit("hl7v2").alias("data_type"),
                    F.pmod("msg_id", F.lit(4)).cast("int").alias("attempts"),
                    F.when(state == "ERROR", "refused").otherwise("").alias("last_error"), (state == "ERROR").alias("dead_letter"),
                    F.col("received_at").alias("queued_at"))


def stored_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pending deliveries in arrival order."""
    d = stored_destinations(spark, sf).filter("state = 'QUEUED'")
    return d.select((F.col("msg_id") * 2 + F.when(F.col("destination_id") == "csv", 0).otherwise(1)).alias("queue_id"),
                    "channel_id", "destination_id", "msg_id", F.col("queued_at").alias("not_before"))


def bad_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The customer feed with every 97th message cut, mis-headed or broken."""
    c = customers_hl7(spark, sf)
    k = F.col("msg_id")
    raw = (F.when(k % 97 == 0, "").when(k % 97 == 1, F.concat(F.lit("X"), F.col("raw")))
           .when(k % 97 == 2, F.concat(F.col("raw"), F.lit("p1d|x\r"))).when(k % 97 == 3, F.replace("raw", F.lit("^~\\&"), F.lit("^^\\&")))
           .when(k % 97 == 4, F.concat(F.col("raw"), F.lit("ZZ\r"))).when(k % 97 == 5, F.concat(F.col("raw"), F.lit("ZZZ^1\r")))
           .otherwise(F.col("raw")))
    return c.withColumn("raw", raw)
