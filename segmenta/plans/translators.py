"""Translators between message formats.

Each takes the source message (``get``/``get_all``/``segments``/``at``) and
returns a builder; all of them are expression builders that run once, on the
driver, while the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.builder import CsvBuilder, DelimitedBuilder, JsonBuilder, new_message
from ..functions.columns import or_default
from ..functions.delimited import Parsed
from ..functions.scalars import action_code, composite, gender_from_sex, hl7_date, hl7_time, iso_date, sex_from_gender

# Trigger events, their message structures, code systems.
TRIGGERS = {"EncounterAdmitted": "A01", "EncounterTransferred": "A02", "EncounterDischarged": "A03",
            "PatientUpdated": "A08", "EncounterCancelled": "A11", "EncounterPreAdmitted": "A05"}
STRUCTURES = {"A08": "ADT_A01", "A05": "ADT_A01", "A11": "ADT_A09"}
IDENTIFIER_TYPES = "http://terminology.hl7.org/CodeSystem/v2-0203"


def _hl7_header(out: DelimitedBuilder, app, kind: str, event: str, control) -> DelimitedBuilder:
    fields = {"MSH-3": app, "MSH-9.1": kind, "MSH-9.2": event, "MSH-10": control, "MSH-11": "P", "MSH-12": "2.5.1"}
    for path, value in fields.items():
        out.set(path, value)
    return out


def _astm_header(out: DelimitedBuilder, sender, at) -> DelimitedBuilder:
    for path, value in {"H-5": sender, "H-12": "P", "H-13": "LIS2-A2", "H-14": at}.items():
        out.set(path, value)
    return out


def _copy(out, pairs: dict[str, Column]):
    for path, value in pairs.items():
        out.set(path, value)
    return out


def patient_csv(m: Parsed) -> CsvBuilder:
    """id, last name, first name, date of birth."""
    return _copy(new_message("csv"), {"R.1": m.get("PID-3[1].1"), "R.2": m.get("PID-5.1"),
                                      "R.3": m.get("PID-5.2"), "R.4": m.get("PID-7")})


def patient_csv_row(m: Parsed) -> CsvBuilder:
    return _copy(new_message("csv"), {"R.1": m.get("PID-3.1"), "R.2": m.get("PID-5.1"),
                                      "R.3": m.get("PID-5.2"), "R.4": m.get("PID-7")})


def fhir_patient(m: Parsed, system: str = "urn:mrn") -> JsonBuilder:
    """Short patient resource."""
    mrn, given, dob = m.get("PID-3.1"), m.get("PID-5.2"), iso_date(m.get("PID-7"))
    out = new_message("json")
    out.set("resourceType", "Patient").set("id", mrn)
    out.set("identifier[0].system", system).set("identifier[0].value", mrn)
    out.set("active", True).set("name[0].family", m.get("PID-5.1"))
    out.set("name[0].given[0]", given, when=_truthy(given))
    out.set("birthDate", dob, when=dob.isNotNull())
    return out.set("gender", gender_from_sex(m.get("PID-8"), with_other=False))


def fhir_patient_routing(m: Parsed) -> dict[str, Column]:
    """Update events address the patient's own resource."""
    mrn = m.get("PID-3.1")
    put = m.get("MSH-9.2").isin("A28", "A31") & _truthy(mrn)
    return {"http.method": F.when(put, "PUT"), "http.path": F.when(put, F.concat(F.lit("/fhir/Patient/"), mrn))}


def fhir_patient_full(m: Parsed, system: str = "urn:mrn", enterprise_system: str = "urn:enterprise-id") -> JsonBuilder:
    mrn = m.get("PID-3[1].1")
    enterprise, given, middle = m.get("PID-3[2].1"), m.get("PID-5.2"), m.get("PID-5.3")
    dob, phone, street, country = iso_date(m.get("PID-7")), m.get("PID-13"), m.get("PID-11.1"), m.get("PID-11.6")
    out = new_message("json")
    out.set("resourceType", "Patient").set("id", mrn)
    out.set("identifier[0].use", "usual").set("identifier[0].type.coding[0].system", IDENTIFIER_TYPES)
    out.set("identifier[0].type.coding[0].code", "MR")
    out.set("identifier[0].system", F.concat(F.lit(system + ":"), or_default(m.get("PID-3[1].4"), "unknown")))
    out.set("identifier[0].value", mrn)
    has_eid = _truthy(enterprise)
    out.set("identifier[1].use", "secondary", when=has_eid)
    out.set("identifier[1].system", enterprise_system, when=has_eid)
    out.set("identifier[1].value", enterprise, when=has_eid)
    out.set("active", True).set("name[0].use", "official").set("name[0].family", m.get("PID-5.1"))
    out.set("name[0].given[0]", given, when=_truthy(given))
    out.set("name[0].given[1]", middle, when=_truthy(middle))
    out.set("birthDate", dob, when=dob.isNotNull())
    out.set("gender", gender_from_sex(m.get("PID-8")))
    for k, v in (("system", "phone"), ("value", phone), ("use", "home")):
        out.set(f"telecom[0].{k}", v, when=_truthy(phone))
    here = _truthy(street)
    for path, v in (("use", "home"), ("line[0]", street), ("city", m.get("PID-11.3")), ("state", m.get("PID-11.4")),
                    ("postalCode", m.get("PID-11.5"))):
        out.set(f"address[0].{path}", v, when=here)
    return out.set("address[0].country", country, when=here & _truthy(country))


def _truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def fhir_to_adt(m) -> DelimitedBuilder:
    """JSON Patient resource to an A31 person update."""
    pid = m.get("id")
    out = _hl7_header(new_message("hl7v2"), "FHIR", "ADT", "A31", F.concat(F.lit("FHIR"), or_default(pid, "0")))
    return _patient_segment(out, or_default(or_default(m.get("identifier[0].value"), pid), ""), m.get("name[0].family"),
                            m.get("name[0].given[0]"), m.get("birthDate"), m.get("gender"))


def fhir_rejection(m) -> tuple[Column, Column, Column]:
    """(condition, code, text): only Patient resources are accepted."""
    kind = m.get("resourceType")
    return (~kind.eqNullSafe("Patient"), F.lit("AR"),
            F.concat(F.lit("expected a Patient resource, got "), or_default(kind, "nothing")))


def fhir_xml_to_adt(m) -> DelimitedBuilder:
    v = lambda path: m.get(f"Patient/{path}/@value")
    out = _hl7_header(new_message("hl7v2"), "FHIR-XML", "ADT", "A31", F.concat(F.lit("FHIRX"), or_default(v("id"), "0")))
    return _patient_segment(out, or_default(or_default(v("identifier/value"), v("id")), ""), v("name[1]/family"),
                            v("name[1]/given[1]"), v("birthDate"), v("gender"))


def fhir_xml_rejection(m) -> tuple[Column, Column, Column]:
    return (~_truthy(m.get("Patient")), F.lit("AR"), F.lit("expected a Patient resource"))


def _patient_segment(out, ident, family, given, birth, gender):
    return _copy(out, {"PID-1": F.lit("1"), "PID-3.1": ident, "PID-5.1": family, "PID-5.2": given,
                       "PID-7": hl7_date(birth), "PID-8": sex_from_gender(F.coalesce(gender, F.lit("")))})


_PATIENT = {"3.1": "3.1", "5.1": "5.1", "5.2": "5.2", "7": "7", "8": "8"}


def result_to_oru(m: Parsed) -> DelimitedBuilder:
    """ASTM result message to ORU^R01: one observation per result record."""
    at = m.get("H-14")
    out = new_message("hl7v2").set("MSH-3", or_default(m.get("H-5"), "ASTM")).set("MSH-7", at)
    _hl7_header(out, or_default(m.get("H-5"), "ASTM"), "ORU", "R01", F.concat(F.lit("ASTM"), or_default(at, "0")))
    out.set("PID-1", "1")
    _copy(out, {f"PID-{a}": m.get(f"P-{b}") for a, b in _PATIENT.items()})
    _copy(out, {"OBR-1": F.lit("1"), "OBR-2": m.get("O-2"), "OBR-4.1": m.get("O-4.4"), "OBR-7": m.get("O-6")})

    def obx(seg, r, i):
        at_ = lambda rel: m.at(r, "R", rel)
        _copy(seg, {"1": (i + 1).cast("string"), "2": F.lit("TX"), "3.1": at_("2.4"), "5": at_("3"), "6": at_("4"),
                    "8": at_("6"), "11": or_default(at_("8"), "F")})

    return out.repeat("OBX", m.segments("R"), obx)


def oru_to_result(m: Parsed) -> DelimitedBuilder:
    """ORU^R01 to an ASTM result message, the inverse."""
    out = _astm_header(new_message("astm"), or_default(m.get("MSH-3"), "LIS"), m.get("MSH-7"))
    out.set("P-1", "1")
    _copy(out, {f"P-{a}": m.get(f"PID-{b}") for a, b in _PATIENT.items()})
    _copy(out, {"O-1": F.lit("1"), "O-2": m.get("OBR-2"), "O-4.4": m.get("OBR-4.1"), "O-6": m.get("OBR-7")})

    def result(seg, o, i):
        at_ = lambda rel: m.at(o, "OBX", rel)
        _copy(seg, {"1": (i + 1).cast("string"), "2.4": at_("3.1"), "3": at_("5"), "4": at_("6"), "6": at_("8"),
                    "8": or_default(at_("11"), "F")})

    out.repeat("R", m.segments("OBX"), result)
    return out.set("L-1", "1").set("L-2", "N")


def order_to_astm(m: Parsed) -> DelimitedBuilder:
    """ORM^O01 to an ASTM order: the n-th OBR takes the n-th ORC's control."""
    out = _astm_header(new_message("astm"), or_default(m.get("MSH-3"), "LIS"), m.get("MSH-7"))
    out.set("P-1", "1")
    _copy(out, {f"P-{a}": m.get(f"PID-{b}") for a, b in _PATIENT.items()})
    obr = m.segments("OBR")
    pairs = F.slice(F.arrays_zip(obr.alias("obr"), m.segments("ORC").alias("orc")), F.lit(1), F.size(obr))
    rows = m.at_each(pairs, lambda x: [*((x["obr"], "OBR", rel) for rel in ("2", "4.1", "5", "7")), (x["orc"], "ORC", "1")])

    def order(seg, row, i):
        specimen, test, priority, at, control = (F.get(row, F.lit(k)) for k in range(5))
        _copy(seg, {"1": (i + 1).cast("string"), "2": specimen, "4.4": test, "5": or_default(priority, "R"), "6": at,
                    "11": action_code(control)})

    out.repeat("O", rows, order)
    return out.set("L-1", "1").set("L-2", "N")


def query_to_order(m: Parsed, test: Column | None = None) -> DelimitedBuilder:
    """ASTM query to the order answering it; ``test`` is a looked-up order,
    the query's own test otherwise."""
    specimen = or_default(or_default(m.get("Q-2.2"), m.get("Q-2")), "")
    asked = or_default(m.get("Q-3.4"), "ALL")
    out = _astm_header(new_message("astm"), "LIS", m.get("H-14"))
    _copy(out, {"O-1": F.lit("1"), "O-2": specimen, "O-4.4": asked if test is None else or_default(test, asked),
                "O-5": F.lit("R"), "O-11": F.lit("Q")})
    return out.set("L-1", "1").set("L-2", "F")


def uppercase_name(m: Parsed) -> Parsed:
    """Normalise the family name in place; messages without one are left."""
    name = m.get("PID-5.1")
    changed = m.set("PID-5.1", F.upper(name))
    return m._with(segs=F.when(_truthy(name), changed.segs).otherwise(m.segs))


def ack(m: Parsed, code: Column, text: Column, control: Column, at: Column) -> Column:
    """Acknowledgement text: sender and receiver swapped, same delimiters; a
    minimal one when the inbound message has no readable header."""
    sep, enc = m.get("MSH-1"), m.get("MSH-2")
    trigger = or_default(m.get("MSH-9.2"), "")
    d = m.d
    esc = lambda c: _encoded(m, F.coalesce(c, F.lit("")))
    kind = F.when(trigger == "", "ACK").otherwise(F.concat(F.lit("ACK"), d["comp"], esc(trigger), d["comp"], F.lit("ACK")))
    head = F.concat_ws("", F.lit("MSH"), sep, enc, *(p for f in (
        esc(m.get("MSH-5")), esc(m.get("MSH-6")), esc(m.get("MSH-3")), esc(m.get("MSH-4")), hl7_time(at), F.lit(""), kind,
        esc(control), esc(or_default(m.get("MSH-11"), "P")), esc(or_default(m.get("MSH-12"), "2.5.1"))) for p in (sep, f)),
        F.lit("\r"))
    tail = F.concat(F.lit("MSA"), sep, code, sep, esc(m.get("MSH-10")),
                    F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(sep, esc(text))), F.lit("\r"))
    plain = new_message("hl7v2").set("MSH-7", hl7_time(at)).set("MSH-9.1", "ACK").set("MSH-10", control)
    plain.set("MSH-11", "P").set("MSH-12", "2.5.1").set("MSA-1", code)
    bare = plain.text()
    nak = F.when(F.coalesce(text, F.lit("")) == "", bare).otherwise(plain.set("MSA-3", text).text())
    return F.when(m.error.isNull(), F.concat(head, tail)).otherwise(nak)


def _encoded(m: Parsed, c: Column) -> Column:
    return m._encode(c, "rep")


def read_ack(m: Parsed) -> dict[str, Column]:
    """code, text, refers_to and error of an acknowledgement."""
    code = m.get("MSA-1")
    return {"code": F.nullif(code, F.lit("")), "text": m.get("MSA-3"), "refers_to": m.get("MSA-2"),
            "error": F.when(m.error.isNotNull(), F.concat(F.lit("mllp: unparseable ACK: "), m.error))
            .when(F.coalesce(code, F.lit("")) == "", "mllp: ACK has no MSA-1")}


# ---- rendering feeds from tables ------------------------------------------

def _trimmed(name: str, fields: dict[int, Column | str | None], first: int = 1) -> Column:
    """A segment from numbered fields, trailing empty fields cut.  Texts and runs of missing fields are one constant."""
    out, run = [], name
    for n in range(first, max(fields) + 1):
        cell, run = fields.get(n), run + "|"
        if isinstance(cell, Column):
            out += [F.lit(run), F.coalesce(cell.cast("string"), F.lit(""))]
            run = ""
        else:
            run += cell or ""
    return F.rtrim(F.concat(*out, F.lit(run)), F.lit("|"))


def render_adt(event: dict[str, Column], app="SIM", facility="SIMNET", to_app="RCV", to_facility="TEST",
               authority="SIMNET", processing="T", version="2.5.1") -> Column:
    """ADT text of an event row.

    ``event``: trigger, at, control_id, mrn, home_facility, enterprise_id,
    family, given, middle, birth, sex, address, phone, marital, account,
    patient_class, location, prior_location, attending, admit_source, visit,
    admitted_at, discharged_at, disposition; missing keys render empty.  NULL
    when the row has no patient or no encounter, or no trigger for it."""
    e = dict.fromkeys("family given middle sex address phone marital account patient_class location prior_location attending "
                      "admit_source visit disposition birth home_facility enterprise_id admitted_at discharged_at".split()) | event
    time = lambda ts: None if ts is None else hl7_time(ts)
    code = e["trigger"]
    structure = F
    for k, v in STRUCTURES.items():
        structure = structure.when(code == k, v)
    structure = structure.otherwise(F.concat(F.lit("ADT_"), code))
    at = hl7_time(e["at"])
    msh = _trimmed("MSH", {2: "^~\\&", 3: app, 4: facility, 5: to_app, 6: to_facility,
                           7: at, 9: composite("ADT", code, structure), 10: e["control_id"], 11: processing,
                           12: version}, first=2)
    evn = _trimmed("EVN", {1: code, 2: at, 6: None if e["discharged_at"] is None else F.when(code == "A03", time(e["discharged_at"]))})
    ids = F.concat(composite(e["mrn"], "", "", e["home_facility"], "MR"), F.lit("~"),
                   composite(e["enterprise_id"], "", "", authority, "PI"))
    pid = _trimmed("PID", {1: "1", 3: ids, 5: composite(e["family"], e["given"], e["middle"]), 7: e["birth"],
                           8: e["sex"], 11: e["address"], 13: e["phone"], 16: e["marital"], 18: e["account"]})
    pv1 = _trimmed("PV1", {1: "1", 2: e["patient_class"], 3: e["location"], 6: e["prior_location"], 7: e["attending"],
                           14: e["admit_source"], 19: e["visit"], 36: e["disposition"], 44: time(e["admitted_at"]),
                           45: time(e["discharged_at"])})
    visit = F.lit(None) if e["visit"] is None else e["visit"]
    # the condition makes the text NULL from its end: below a CASE the parts that segments have in common would be
    # computed for each, in one method too long for the JIT compiler
    there = F.when(code.isin(*TRIGGERS.values()) & e["mrn"].isNotNull() & visit.isNotNull(), "")
    return F.concat(F.concat_ws("\r", msh, evn, pid, pv1, F.lit("")), there)
