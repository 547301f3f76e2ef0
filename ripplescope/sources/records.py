"""Parsers of line and record formats, over one text per row."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths

# Formats of build messages, the heading of a listing, and the counters of a run's summary.
MESSAGE = r"^\s*(.+?)\((\d+),(\d+)(?:,(\d+),(\d+))?\)\s*:\s*(error|warning)\s+([A-Z]+\d+)\s*:\s*(.*?)(?:\s+\[([^\]]+)\])?\s*$"
BARE_MESSAGE = r"^\s*(\S(?:.*?\S)?)\s*:\s*(error|warning)\s+([A-Z]+\d+)\s*:\s*(.*?)(?:\s+\[([^\]]+)\])?\s*$"
LISTING = r"(?i)following tests are available"
COUNTERS = ["total", "failed", "succeeded", "skipped"]
#: Records that a text gives at a time.
PORTION = 1 << 16


def _status(chunks: list[str]) -> Iterator[tuple[str, str, str | None]]:
    left = iter(chunks)
    for chunk in left:
        if len(chunk) >= 4:
            moved = chunk[0] in "RC" or chunk[1] in "RC"
            yield chunk[:2], chunk[3:], (next(left, "") or None) if moved else None


def _name_status(chunks: list[str]) -> Iterator[tuple[str, str, str | None]]:
    left = iter(chunks)
    for status in left:
        if status:
            origin = next(left, None) if status[0] in "RC" else None
            file = next(left, None)
            if file:
                yield status, file, origin


def _records(raw: DataFrame, parse: Callable) -> DataFrame:
    """Reads each text once, from chunk to chunk, and gives its records in portions: time grows with its length, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse((text or "").split("\x00"))
                while some := list(itertools.islice(found, PORTION)):
                    status, file, origin = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(some), pa.string()), *[pa.array(x, pa.string()) for x in (status, file, origin)]], names=["id", "status", "file", "origin"])

    return raw.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, status string, file string, origin string")


def status_records(raw: DataFrame) -> DataFrame:
    """``(id, status, file, origin)`` of ``raw(id, text)``: NUL-separated ``XY path`` records; those under 4 characters are left out, and a rename or copy takes one more, its other path."""
    return _records(raw, _status)


def name_status_records(raw: DataFrame) -> DataFrame:
    """``(id, status, file, origin)`` of ``raw(id, text)``: a status, then a path, or two for renames and copies, all NUL-separated; records without a path are left out."""
    return _records(raw, _name_status)


def text_lines(raw: DataFrame) -> DataFrame:
    """``(id, line_no, line)``."""
    return raw.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def named_tests(raw: DataFrame) -> DataFrame:
    """``(id, test)``: full names, without arguments, of a file that has one name a line and nothing else; names of one dot count too."""
    test = names.strip_args(names.trimmed(F.col("line")))
    return text_lines(raw).select("id", test.alias("test")).where(F.col("test").rlike(names.FULL_NAME) & names.class_of_listed(F.col("test")).isNotNull()).distinct()


def _listing(raw: DataFrame, marker: str) -> DataFrame:
    """``(id, line_no, test, at)``: lines without arguments, and the place of the first heading of their text."""
    lines = text_lines(raw).withColumn("test", names.strip_args(names.trimmed(F.col("line"))))
    at = lines.where(F.col("line").rlike(marker)).groupBy("id").agg(F.min("line_no").alias("at"))
    return lines.join(at, "id", "left").where((F.col("test") != "") & (F.col("at").isNull() | (F.col("line_no") > F.col("at"))))


def listed_tests(raw: DataFrame, marker: str = LISTING) -> DataFrame:
    """``(id, test)``: full names, without arguments, that a listing has.

    Below the heading, every line that is a full name with a class; without a heading,
    only names of two dots or more that are no files.
    """
    test = F.col("test")
    plain = test.rlike(names.FULL_NAME) & names.class_of_listed(test).isNotNull()
    strict = ~test.rlike(names.FILE_LIKE) & (F.size(F.split(test, r"\.")) >= 3)
    return _listing(raw, marker).where(plain & (F.col("at").isNotNull() | strict)).select("id", "test").distinct()


def has_bare_names(raw: DataFrame, marker: str = LISTING) -> DataFrame:
    """``(id, bare)``: whether a listing with the heading names something that tells no class."""
    found = _listing(raw, marker).where("at is not null").groupBy("id").agg(F.bool_or(names.class_of_listed(F.col("test")).isNull()).alias("bare"))
    return raw.select("id").join(found, "id", "left").fillna(False, ["bare"])


def run_output(raw: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Failures ``(id, method, message)`` with up to ``most`` indented lines each, and counters ``(id, counter, n)``.

    Failures are looked for while a text's lines are an array, so that no line becomes
    a row and none is shuffled. A counter stands alone on its line, the first such line
    counts, and one that is missing is 0; a text without a total has none.
    """
    each = raw.select("id", F.split("text", r"\r?\n").alias("lines"))
    head = lambda line: F.nullif(F.regexp_extract(line, r"^failed\s+(\S+)\s+\(", 1), F.lit(""))
    heads = F.transform("lines", lambda line, i: F.when(head(line).isNotNull(), F.struct(head(line).alias("method"), F.slice("lines", i + 2, most).alias("after"))))
    found = each.select("id", F.explode(F.array_compact(heads)).alias("x")).select("id", "x.method", "x.after")
    end = F.array_position(F.transform("after", lambda line: line.rlike(r"^\s+\S")), F.lit(False)).cast("int")  # 0: all are indented
    said = F.slice("after", F.lit(1), F.when(end > 0, end - 1).otherwise(F.lit(most)))
    failures = found.select("id", "method", F.array_join(F.transform(said, names.trimmed), "\n").alias("message"))
    number = lambda c: F.min_by(F.regexp_extract("line", rf"^\s*{c}:\s*(\d+)\s*$", 1).try_cast("long"), F.when(F.col("line").rlike(rf"^\s*{c}:\s*\d+\s*$"), F.col("line_no"))).alias(c)
    counts = text_lines(raw).where(F.col("line").rlike(r":\s*\d+\s*$")).groupBy("id").agg(*map(number, COUNTERS)).where("total is not null")
    return failures, counts.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(c, F.lit(0).cast("long")).alias("n")) for c in COUNTERS])).alias("x")).select("id", "x.counter", "x.n")


def build_messages(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """Diagnostics with 0-based places, each (file, line, column, code, message) once per text. Relative files are below ``folder``, where it is given.

    The lines of a text, each once, are matched while they are still an array, so
    that a match is made once and only messages become rows: into fields between
    U+0001, which counts as a blank in a line; only what has no place is matched
    again by the bare form. A place that isn't given is null before it is cast, as
    Spark makes an error with its message and stack for each text that is no number.
    """
    fields = lambda line, rx, order: F.regexp_replace(line, rx, "\x01".join(f"${i}" if i else "" for i in order))
    lines = F.filter(F.array_distinct(F.split(F.replace("text", F.lit("\x01"), F.lit(" ")), r"\r?\n")), lambda line: F.contains(line, F.lit("error")) | F.contains(line, F.lit("warning")))
    full = F.transform(lines, lambda line: fields(line, MESSAGE, [1, 2, 3, 4, 5, 6, 7, 8, 9]))
    told = F.transform(full, lambda f: F.when(F.contains(f, F.lit("\x01")), f).otherwise(fields(f, BARE_MESSAGE, [1, 0, 0, 0, 0, 2, 3, 4, 5])))
    both = raw.select("id", F.posexplode(told).alias("line_no", "f")).where(F.contains("f", F.lit("\x01")))
    f = lambda i: F.get(F.col("f"), F.lit(i))
    number = lambda *tried: F.coalesce(*[F.nullif(f(i), F.lit("")).try_cast("int") - 1 for i in tried], F.lit(0))
    parsed = both.withColumn("f", F.split("f", "\x01")).select(
        "id", "line_no", f(0).alias("file"), number(1).alias("start_line"), number(2).alias("start_col"), number(3, 1).alias("end_line"), number(4, 2).alias("end_col"),
        f(5).alias("severity"), f(6).alias("code"), f(7).alias("message"), F.nullif(f(8), F.lit("")).alias("project"),
    )
    if folder is not None:
        parsed = parsed.withColumn("file", F.when(paths.is_absolute(F.col("file")), F.col("file")).otherwise(paths.folded(F.concat(F.lit(folder.rstrip("/") + "/"), "file"))))
    key = ["id", "file", "start_line", "start_col", "code", "message"]
    rest = [c for c in parsed.columns if c not in key and c != "line_no"]
    return parsed.groupBy(*key).agg(F.min_by(F.struct(*rest), "line_no").alias("r")).select(*key, "r.*")


def host_registrations(raw: DataFrame) -> DataFrame:
    """``(id, pipe, capabilities)``: what a host wrote, its pipe on the first line and its capabilities on the second; null where it doesn't say."""
    line = lambda i: names.trimmed(F.coalesce(F.get(F.split("text", r"\r?\n"), F.lit(i)), F.lit("")))
    return raw.select("id", line(0).alias("pipe"), F.when(line(1) != "", F.split(line(1), r"\s+")).alias("capabilities"))


def declarations(raw: DataFrame) -> DataFrame:
    """``(id, fqn, line)`` of the classes that source texts declare."""
    from ..operators.results import carried_namespace

    lines = text_lines(raw).select(F.col("id").alias("file"), F.col("line_no").alias("line"), F.col("line").alias("text"))
    return carried_namespace(lines).select(F.col("file").alias("id"), "fqn", "line")


def method_lines(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """``(id, method, line)``: the first line of each source text ``raw(id, text)`` that declares one of ``methods(id, method)``.

    A declaration begins with how it can be reached, and its name stands before a
    parenthesis or type arguments.
    """
    lines = text_lines(raw).where(F.col("line").rlike(r"^\s*(public|internal|protected|private)"))
    named = lines.select("id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\b(\w+)\s*[(<]"), F.lit(1))).alias("method"))
    return named.join(methods.select("id", "method").distinct(), ["id", "method"], "left_semi").groupBy("id", "method").agg(F.min("line_no").alias("line"))


def command_line(args: list[str]) -> dict:
    """Command, files and flags; ValueError for what isn't known."""
    flags = {"--base": str, "--format": str, "--repo": str, "--ci": bool, "--staged": bool}
    out: dict = {"command": None, "files": []}
    left = list(args)
    while left:
        word = left.pop(0)
        if word.startswith("--"):
            name, eq, value = word.partition("=")
            if name not in flags:
                raise ValueError(f"unknown flag {name}")
            if flags[name] is bool:
                out[name[2:]] = True
            elif eq or left:
                out[name[2:]] = value if eq else left.pop(0)
            else:
                raise ValueError(f"{name} needs a value")
        elif out["command"] is None:
            out["command"] = word
        else:
            out["files"].append(word)
    if out["command"] not in ("build-map", "affected", "run", "status"):
        raise ValueError(f"unknown command {out['command']}")
    if out["files"] and out["command"] not in ("affected", "run"):
        raise ValueError(f"{out['command']} takes no files")
    if out.get("format", "text") not in ("text", "json"):
        raise ValueError("format is text or json")
    return out
