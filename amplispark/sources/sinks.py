"""Amplicons, with probes or nested amplicons, as lines of text and files: TSV, JSON lines, a JSON array and FASTA."""

from __future__ import annotations

import decimal
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The columns of tables of amplicons.
PRODUCT = ("source_file", "sequence_id", "experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i")
PROBE = (*PRODUCT, "probe_name", "probe_seq", "probe_found", "probe_strand", "probe_pos", "probe_mm", "probe_site")
NESTED = (*PRODUCT[:7], "inner_experiment_id", "inner_found", "inner_start", "inner_end", "inner_length", "inner_type", "inner_fwd_mm", "inner_rev_mm")
#: The fields of JSON objects in order; those after the colon are left out where empty or 0.
WIRE = "experiment_id sequence_id start end length type: fwd_mm rev_mm fwd_mm_i rev_mm_i seq source_file score"
WIRE_PROBE = "probe_name probe_seq probe_found: probe_strand probe_pos probe_mm probe_site"
WIRE_NESTED = "inner_found: inner_experiment_id inner_start inner_end inner_length inner_type inner_fwd_mm inner_rev_mm"
KINDS = {"product": (PRODUCT, (WIRE,)), "probe": (PROBE, (WIRE, WIRE_PROBE)), "nested": (NESTED, (WIRE, WIRE_NESTED))}
FORMATS = ("tsv", "jsonl", "json", "fasta")


def shortest(x: Column) -> Column:
    """A double in its shortest form: 12, 0.0001, 1e-05, 1.5e+06."""
    text = F.abs(x).cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    bare = lambda c: F.regexp_replace(c, r"\.0$", "")
    mantissa, power = bare(F.regexp_extract(text, r"^([0-9.]+)E", 1)), F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    digits = F.replace(text, F.lit("."), F.lit(""))
    million = F.regexp_replace(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.regexp_replace(F.substring(digits, 2, 30), "0+$", "")), r"\.$", "")
    written = (
        F.when(F.isnan(x), "NaN")
        .when(F.abs(x) == float("inf"), F.concat(F.when(x < 0, "-").otherwise("+"), F.lit("Inf")))
        .when(F.instr(text, "E") == 0, F.concat(sign, F.when(F.abs(x) < 1e6, bare(text)).otherwise(F.concat(million, F.lit("e+06")))))
        .when(power == -4, F.concat(sign, F.lit("0.000"), F.replace(mantissa, F.lit("."), F.lit(""))))
        .otherwise(F.concat(sign, mantissa, exponent))
    )
    return F.when(x.isNotNull(), written)


def shortest_of(x: float) -> str:
    """shortest() of one double."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    if not 1e-4 <= abs(x) < 1e6 and x:
        mantissa, _, power = f"{decimal.Decimal(repr(x)).normalize():e}".partition("e")
        return f"{mantissa}e{int(power):+03d}"
    text = f"{decimal.Decimal(repr(x or 0.0)):f}"
    return text[:-2] if text.endswith(".0") else text


def _text(rows: DataFrame, name: str) -> Column:
    value = shortest(F.col(name)) if dict(rows.dtypes)[name] == "double" else F.col(name).cast("string")
    return F.coalesce(value, F.lit(""))


def with_score(columns: tuple[str, ...]) -> tuple[str, ...]:
    return (*columns, "score")


def tsv_value(rows: DataFrame, columns: tuple[str, ...] = PRODUCT) -> Column:
    return F.concat_ws("\t", *[_text(rows, c) for c in columns])


def tsv_lines(rows: DataFrame, columns: tuple[str, ...] = PRODUCT) -> DataFrame:
    return rows.select(tsv_value(rows, columns).alias("value"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Lines as files of text; a header is a first file of its own."""
    if header is not None:
        lines = lines.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value")).unionAll(lines)
    lines.write.text(path)


def json_lines(rows: DataFrame, kind: str = "product") -> DataFrame:
    """One object a row, with the wire's fields that rows have; mismatch places become lists, a struct `thermo` an object."""
    types = dict(rows.dtypes)
    wire = []
    for group in KINDS[kind][1]:
        always, _, rest = group.partition(":")
        for name in group.replace(":", "").split():
            if name not in types:
                continue
            value = F.col(name)
            if name in ("fwd_mm_i", "rev_mm_i"):
                value = F.when(value != "", F.split(value, ",").cast("array<int>"))
            elif name in rest.split():
                value = F.when(value != "" if types[name] == "string" else value != 0, value)
            wire.append(value.alias(name))
    if "thermo" in types:
        wire.append(F.col("thermo"))
    return rows.select(F.to_json(F.struct(*wire), {"ignoreNullFields": "true"}).alias("value"))


def fasta_lines(rows: DataFrame, kind: str = "product") -> DataFrame:
    """Two lines in one value for each row with bases of rows (n, experiment_id, start, end, length, source_file, seq)."""
    if kind == "nested":
        raise ValueError("nested amplicons have no FASTA form")
    head = F.format_string(">%s_%d start=%d end=%d len=%d source_file=%s", "experiment_id", "n", "start", "end", "length", "source_file")
    if kind == "probe":
        head = F.concat(head, F.lit(" probe="), F.col("probe_name"), F.lit(" found="), F.col("probe_found").cast("string"))
    return rows.where("seq != ''").select(F.concat(head, F.lit("\n"), F.col("seq")).alias("value"))


def write_tsv(rows: DataFrame, path: str, columns: tuple[str, ...] = PRODUCT, header: bool = True) -> None:
    outer = ("experiment_id", "start", "end", "length", "type") if columns == NESTED else ()
    cols = [_text(rows, c).alias(f"outer_{c}" if c in outer else c) for c in columns]
    rows.select(cols).write.option("sep", "\t").option("header", header).option("emptyValue", "").option("quote", "").csv(path)


def write(rows: DataFrame, path: str, format: str = "tsv", kind: str = "product", header: bool = True) -> None:
    """rows in one of FORMATS, in as many files as rows have partitions.

    The files of json, joined in order of their names, are one array.
    """
    if format not in FORMATS or kind not in KINDS:
        raise ValueError(f"no format or kind: {format!r}, {kind!r}")
    if format == "tsv":
        columns = KINDS[kind][0]
        write_tsv(rows, path, with_score(columns) if kind == "product" and "score" in rows.columns else columns, header)
    elif format == "fasta":
        fasta_lines(rows, kind).write.text(path)
    elif format == "jsonl":
        json_lines(rows, kind).write.text(path)
    else:
        write_json(rows, path, kind)


def indented(line: str) -> str:
    """One object of a JSON array as it stands in an indented one."""
    return "  " + json.dumps(json.loads(line), indent=2, ensure_ascii=False).replace("\n", "\n  ")


def write_json(rows: DataFrame, path: str, kind: str = "product") -> None:
    """rows as one indented JSON array, in part files that joined in order of their names are the array."""
    lines = cut(json_lines(rows, kind))

    @F.arrow_udf("string")
    def pretty(found: pa.Array) -> pa.Array:
        return pa.array(map(indented, found.to_pylist()), pa.string())

    _json_array(lines.select(pretty("value").alias("value")), "", ",\n").write.text(path)


def _json_array(lines: DataFrame, first_mark: str = "  ", mark: str = ", ") -> DataFrame:
    """Lines of an array: each object in its own partition's place, all but the first after a comma."""
    spark, placed = lines.sparkSession, lines.select("value", F.monotonically_increasing_id().alias("at"))
    first = placed.agg(F.min("at")).first()[0]
    objects = placed.select(F.concat(F.when(F.col("at") == first, first_mark).otherwise(mark), F.col("value")).alias("value"))
    bracket = lambda c: spark.range(0, 1, 1, 1).select(F.lit(c).alias("value"))
    return bracket("[").unionAll(objects).unionAll(bracket("]"))
