"""Outcome rules: acknowledgements, HTTP statuses, retry decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENT, TRANSIENT, PERMANENT = "sent", "transient", "permanent"


def ack_accepted(code: Column) -> Column:
    return F.coalesce(code, F.lit("")).isin("", "AA", "CA")


def http_status(code: Column, timed_out: Column | None = None) -> Column:
    """HTTP status answering a decision code."""
    status = F.when(code.isin("AA", "CA"), 200).when(code.isin("AR", "CR"), 400).otherwise(500)
    return status if timed_out is None else F.when(timed_out, 504).otherwise(status)


def http_outcome(status: Column) -> Column:
    """NULL status means the request itself failed."""
    return (F.when(status.between(200, 299), SENT)
            .when(status.isNull() | (status >= 500) | status.isin(408, 429), TRANSIENT)
            .otherwise(PERMANENT))


def mllp_outcome(msa1: Column) -> Column:
    """NULL means no readable acknowledgement."""
    return F.when(msa1.isin("AA", "CA"), SENT).when(msa1.isin("AE", "AR", "CE", "CR"), PERMANENT).otherwise(TRANSIENT)


def e1381_outcome(accepted: Column) -> Column:
    return F.when(accepted, SENT).otherwise(TRANSIENT)


def ack_decision(error_kind: Column, reject_code: Column, override: Column | None = None) -> Column:
    """Code for one failed or finished step.

    ``error_kind`` is NULL (done or filtered), 'reject', 'permanent' or any
    other text for an ordinary error; ``reject_code`` is what the step asked
    for; ``override`` wins over the automatic decision."""
    auto = (F.when(error_kind.isNull(), "AA").when(error_kind == "reject", reject_code)
            .when(error_kind == "permanent", "AR").otherwise("AE"))
    return auto if override is None else F.coalesce(F.nullif(override, F.lit("")), auto)


def backoff_seconds(attempts: Column, base: float, cap: float = 300.0, jitter_key: list[Column] | None = None) -> Column:
    """base * 2^(n-1) up to ``cap``; with ``jitter_key`` +-20 percent, hashed
    from the key so replays agree."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(62))), F.lit(float(cap)))
    if jitter_key is None:
        return delay
    unit = F.pmod(F.xxhash64(*jitter_key, attempts), F.lit(1_000_000)) / 1_000_000.0
    return delay * (F.lit(0.8) + F.lit(0.4) * unit)


def exhausted(attempts: Column, max_attempts: int) -> Column:
    return F.lit(False) if max_attempts == -1 else attempts >= max_attempts


def route_problem(path: Column) -> Column:
    """Why an HTTP path hint is refused (a permanent error), or NULL."""
    is_url = path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | path.startswith("//")
    return F.when(is_url, F.concat(F.lit('http-sender: http.path "'), path, F.lit('" must be a path, not a URL')))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; above the root is the root."""
    parts = F.split(path, "/")
    # the first segment is the empty one before the leading slash and stays
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    ends_open = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(ends_open, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolve_url(base: str, path: Column) -> Column:
    """Target of a relative path hint against the base URL; . and .. are resolved."""
    import re
    m = re.match(r"^([a-z]+://[^/?#]+)([^?#]*)", base)
    host, base_path = m[1], m[2] or "/"
    folder = base_path[:base_path.rindex("/") + 1]
    own, rest = F.regexp_extract(path, "^[^?#]*", 0), F.regexp_extract(path, "[?#].*$", 0)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.lit(folder), own))
    return (F.when(path.isNull() | (path == ""), F.lit(base))
            .when(own == "", F.concat(F.lit(host + base_path), rest))
            .otherwise(F.concat(F.lit(host), _without_dots(whole), rest)))
