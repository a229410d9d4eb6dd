"""Report details of every coverage type as rows of one shape (D-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AT = "method string, path string"
#: The shape of each type's details, as far as it is read.
SHAPES = {
    "endpoint": f"endpoints array<struct<id string, {_AT}, covered boolean>>, items array<struct<id string, {_AT}, covered boolean>>",
    "parameter": f"parameters array<struct<parameter struct<id string, name string, {_AT}>, ratio double>>",
    "business": "rules array<struct<rule struct<id string, endpoints array<string>>, covered boolean>>",
    "integration": f"flows array<struct<flow struct<steps array<struct<id string, name string, {_AT}>>>, status string>>",
    "error": f"scenarios array<struct<scenario struct<id string, {_AT}, errorCode string>, covered boolean, id string, description string, source_location string>>,"
    f" items array<struct<scenario struct<id string, {_AT}, errorCode string>, covered boolean, id string, description string, source_location string>>",
    "security": "controls array<struct<control struct<id string, endpoint string>, covered boolean>>",
    "performance": f"performanceCoverages array<struct<endpoint struct<id string, {_AT}>, hasLoadTestData boolean>>",
    "resilience": f"resilienceCoverages array<struct<scenario struct<id string, endpoint struct<{_AT}>>, covered boolean>>",
}
# Codes told by the words of an inferred scenario, in order, and the class names that give a path.
ERROR_HINTS = (
    ("403", r"unauthorized|no.*authorization|forbidden"),
    ("401", r"authentication|invalid.*auth|invalid_auth"),
    ("404", r"not.*found|resource.*not"),
    ("400", r"illegal.*argument|invalid.*param|bad.*request"),
    ("500", r"null.*check|npe|null_check"),
)
CLASS_FILE = r"(?i)/([A-Z][a-zA-Z]+?)(?:Api|Controller|Resource|Handler|Mutation|Datafetcher|Filter|QueryService|Repository)\.java"


def _row(method: Column | None, path: Column | None, covered: Column, name: Column | None, codes: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(text(method).alias("method"), text(path).alias("path"), F.coalesce(covered, F.lit(False)).alias("covered"), text(name).alias("name"), (F.array().cast("array<string>") if codes is None else codes).alias("error_codes"))


def _word(text: Column, n: int) -> Column:
    return F.get(F.split(text, " ", -1), F.lit(n))


def _endpoint(d: Column) -> Column:
    def row(e: Column) -> Column:
        unnamed = (F.coalesce(e["method"], F.lit("")) == "") & (F.coalesce(e["path"], F.lit("")) == "") & F.contains(e["id"], F.lit(" "))
        rest = F.substring(e["id"], F.instr(e["id"], " ") + 1, F.length(e["id"]))
        return _row(F.when(unnamed, _word(e["id"], 0)).otherwise(e["method"]), F.when(unnamed, rest).otherwise(e["path"]), e["covered"], None)

    return F.transform(F.coalesce(d["endpoints"], d["items"]), row)


def _parameter(d: Column) -> Column:
    return F.transform(d["parameters"], lambda p: _row(p["parameter"]["method"], p["parameter"]["path"], p["ratio"] > 0, F.coalesce(p["parameter"]["name"], p["parameter"]["id"])))


def _business(d: Column) -> Column:
    def rows(r: Column) -> Column:
        named = r["rule"]["endpoints"]
        each = F.transform(named, lambda e: _row(F.when(F.contains(e, F.lit(" ")), _word(e, 0)), F.when(F.contains(e, F.lit(" ")), _word(e, 1)).otherwise(e), r["covered"], r["rule"]["id"]))
        return F.when(F.size(named) > 0, each).otherwise(F.array(_row(None, None, r["covered"], r["rule"]["id"])))

    return F.flatten(F.transform(d["rules"], rows))


def _integration(d: Column) -> Column:
    def rows(f: Column) -> Column:
        steps = F.filter(f["flow"]["steps"], lambda s: (F.coalesce(s["method"], F.lit("")) != "") & (F.coalesce(s["path"], F.lit("")) != ""))
        return F.transform(steps, lambda s: _row(s["method"], s["path"], ~f["status"].eqNullSafe(F.lit("missing")), F.coalesce(s["id"], s["name"])))

    return F.flatten(F.filter(F.transform(d["flows"], rows), lambda x: x.isNotNull()))


def _error(d: Column) -> Column:
    def row(s: Column) -> Column:
        sc = s["scenario"]
        words = F.concat(F.lower(F.coalesce(s["description"], F.lit(""))), F.coalesce(s["id"], F.lit("")))
        told = F.coalesce(*[F.when(words.rlike(p), F.lit(c)) for c, p in ERROR_HINTS], F.lit("exception"))
        own = F.filter(F.array(F.nullif(sc["errorCode"], F.lit(""))), lambda x: x.isNotNull())
        stem = F.lower(F.regexp_extract(F.coalesce(s["source_location"], F.lit("")), CLASS_FILE, 1))
        inferred = _row(None, F.when(stem != "", F.concat(F.lit("/"), stem)), s["covered"], F.coalesce(s["id"], F.lit("")), F.array(told))
        return F.when(sc.isNotNull(), _row(sc["method"], sc["path"], s["covered"], sc["id"], own)).otherwise(inferred)

    return F.transform(F.coalesce(d["scenarios"], d["items"]), row)


def _security(d: Column) -> Column:
    def row(c: Column) -> Column:
        at = c["control"]["endpoint"]
        return _row(_word(at, 0), F.when(F.contains(at, F.lit(" ")), _word(at, 1)), c["covered"], c["control"]["id"])

    return F.filter(F.transform(d["controls"], row), lambda x: F.coalesce(x["path"], F.lit("")) != "")


def _performance(d: Column) -> Column:
    return F.transform(d["performanceCoverages"], lambda c: _row(c["endpoint"]["method"], c["endpoint"]["path"], c["hasLoadTestData"], c["endpoint"]["id"]))


def _resilience(d: Column) -> Column:
    found = F.filter(d["resilienceCoverages"], lambda c: c["scenario"]["endpoint"].isNotNull())
    return F.transform(found, lambda c: _row(c["scenario"]["endpoint"]["method"], c["scenario"]["endpoint"]["path"], c["covered"], c["scenario"]["id"]))


READERS = {
    "endpoint": _endpoint, "parameter": _parameter, "business": _business, "integration": _integration, "error": _error,
    "security": _security, "performance": _performance, "resilience": _resilience,
}


def normalized(reports: DataFrame) -> DataFrame:
    """D-09: (report, type, position, method, path, covered, name, error_codes): the items of reports (report, type, details JSON),
    in order. Details of other types or shapes, and nulls, give no rows; a missing flag is not covered."""
    rows = F.lit(None)
    for kind, read in READERS.items():
        rows = F.when(F.col("type") == kind, read(F.from_json("details", SHAPES[kind]))).otherwise(rows)
    return reports.select("report", "type", F.posexplode(rows).alias("position", "_r")).select("report", "type", "position", "_r.*")
