"""Reading reports, failures and requests."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from triagewright import schemas as S
from triagewright.functions import text as T
from triagewright.sources.markup import VOID, Element, Markup

STEPS = "array<struct<status:string,text:string>>"
RAW = "report_id string, failure_idx long, test_case_id string, scenario_name string, failed_step_line string, error_message string, failure_image string, video_url string, steps " + STEPS
FOUND = pa.schema([(c, pa.int64() if c == "failure_idx" else pa.string()) for c in ("report_id", "failure_idx", "test_case_id", "scenario_name", "failed_step_line", "error_message", "failure_image", "video_url")] + [("steps", pa.list_(pa.struct([("status", pa.string()), ("text", pa.string())])))])
#: Bytes of HTML in a row that goes to Python, characters that a reader takes at a time, and failures in a batch that comes back.
PIECE, CHUNK, BATCH = 1 << 12, 1 << 16, 1 << 11


class Reader(Markup):
    """Failed tests of one report, collected while its tags go by. Tests and steps may stand inside one another; what is in the inner one is in the outer one too."""

    def __init__(self) -> None:
        super().__init__()
        self.tests: list[dict] = []
        self.inner: list[tuple[int, dict]] = []  # open tests, with their depth
        self.steps: list[tuple[int, dict]] = []  # open steps
        self.held: list[str] = []
        self.length = 0
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, piece: bytes) -> None:
        """The next bytes of the page. What a tag, comment or area leaves unread is read again only when as much more has come."""
        text = self.decoder.decode(piece)
        self.held.append(text)
        self.length += len(text)
        if self.length >= max(CHUNK, len(self.rawdata)):
            self.read_on()

    def read_on(self) -> None:
        self.feed("".join(self.held))
        self.held, self.length = [], 0

    def done(self) -> list[dict]:
        """The tests that nothing to come can change, once each: those before the outermost open one."""
        n = next((i for i, t in enumerate(self.tests) if t is self.inner[0][1]), 0) if self.inner else len(self.tests)
        out, self.tests = self.tests[:n], self.tests[n:]
        return out

    def last(self) -> list[dict]:
        """The page has ended: the tests that are left."""
        self.held.append(self.decoder.decode(b"", True))
        self.read_on()
        self.close()
        return self.tests

    def begin(self, element: Element) -> None:
        depth, tag, a, classes = len(self.open), element.tag, element.attrs, element.classes
        if tag == "li" and "test-item" in classes:
            test = {"status": a.get("status", ""), "id": a.get("test-id", ""), "name": None, "steps": []}
            self.tests.append(test)
            self.inner.append((depth, test))
        elif self.inner:
            for at, test in self.inner:
                if "name" in classes and test["name"] is None and self.under("test-detail", at):
                    test["name"] = self.text(depth, tag)
            for at, step in self.steps:
                self.inside(step, at, depth, tag, a, classes)
            if "step" in classes:
                step = {"classes": classes, "span": None, "text": self.text(depth, tag), "error": None, "value": "", "image": None, "video": None}
                for _, test in self.inner:
                    test["steps"].append(step)
                self.steps.append((depth, step))

    def end(self) -> None:
        for stack in (self.steps, self.inner):
            while stack and stack[-1][0] >= len(self.open):
                stack.pop()

    def under(self, part: str, at: int) -> bool:
        """Whether an open element from that depth on has a class with this in its name."""
        return any(part in c for e in self.open[at:] if not e.gone for c in e.classes)

    def text(self, depth: int, tag: str) -> list[str]:
        found: list[str] = []
        if tag not in VOID:
            self.texts.append((depth, found))
        return found

    def inside(self, step: dict, at: int, depth: int, tag: str, a: dict, classes: set[str]) -> None:
        if tag == "span" and step["span"] is None:
            step["span"] = self.text(depth, tag)
        elif tag == "textarea" and "code-block" in classes and step["error"] is None:
            step["error"], step["value"] = self.text(depth, tag), a.get("value", "")
        elif step["image"] is None and (tag == "img" or tag == "a" and self.under("screenshots", at)):
            step["image"] = a["src"] if "src" in a else a.get("href", "")
        elif tag == "source" and step["video"] is None and any(e.tag == "video" for e in self.open[at:]):
            step["video"] = a.get("src", "")


#: Which class of a step wins.
STATUS = (("pass-bg", "PASS"), ("fail-bg", "FAIL"), ("error-bg", "ERROR"), ("skip-bg", "SKIP"), ("warning-bg", "WARN"))


def failed(tests: list[dict]) -> Iterator[dict]:
    """Those that failed, as failures; a test without a failed step isn't one."""
    told = lambda s: "".join(s["text"] if s["span"] is None else s["span"])
    told_error = lambda s: e if (e := "".join(s["error"] or [])).strip() else s["value"]
    for t in tests:
        if t["status"].lower() not in ("fail", "error"):
            continue
        step = next((s for kind in ("fail-bg", "error-bg") for s in t["steps"] if kind in s["classes"]), None)
        if step is None:
            continue
        yield {
            "test_case_id": t["id"], "scenario_name": "".join(t["name"] or []), "failed_step_line": told(step), "error_message": told_error(step),
            "failure_image": step["image"] or "", "video_url": step["video"] or "",
            "steps": [{"status": next((v for c, v in STATUS if c in s["classes"]), "INFO"), "text": told(s)} for s in t["steps"]],
        }


def failed_tests(html: str) -> Iterator[dict]:
    """Failed tests of a report's HTML, in order."""
    reader = Reader()
    reader.held.append(html)
    yield from failed(reader.last())


def read_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Failures of reports that come in pieces, one report after the other: (report_id, first, piece). `first` or another report_id begins a report.

    A task holds a chunk of HTML, the tests that are open and a batch of failures, however long the reports are.
    """
    reader, name, n, found = None, None, 0, []

    def keep(tests: list[dict]) -> None:
        nonlocal n
        for t in failed(tests):
            found.append({"report_id": name, "failure_idx": n, **t})
            n += 1

    for b in batches:
        for report_id, first, piece in zip(*(c.to_pylist() for c in b.columns)):
            if reader is None or first or report_id != name:
                if reader is not None:
                    keep(reader.last())
                reader, name, n = Reader(), report_id, 0
            reader.add(piece)
            keep(reader.done())
            if len(found) >= BATCH:
                yield pa.RecordBatch.from_pylist(found, FOUND)
                found = []
    if reader is not None:
        keep(reader.last())
    yield pa.RecordBatch.from_pylist(found, FOUND)


def error_text(c: Column) -> Column:
    """Line ends unified, lines without trailing blanks."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    return F.when(T.blank(c), "").otherwise(T.trim(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")))


def steps_text(steps: Column) -> Column:
    """Numbered steps with their status; those without text aren't counted."""
    clean = F.filter(F.transform(steps, lambda s: F.struct(s["status"].alias("status"), T.collapse(s["text"]).alias("text"))), lambda s: ~T.blank(s["text"]))
    return F.array_join(F.transform(clean, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), s["status"], F.lit("] "), s["text"])), "\n")


def explode_reports(reports: DataFrame) -> DataFrame:
    """failures, one row a failed test, in order of the report. reports: (report_id, html). Null and empty reports give none."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / PIECE).cast("int")), lambda i: F.substring(b, i * PIECE + 1, F.lit(PIECE)))
    pieces = F.get(F.transform(F.array(F.col("html").cast("binary")), cut), F.lit(0))
    rows = reports.where(~T.blank(F.col("html"))).select("report_id", F.posexplode(pieces).alias("at", "piece"))
    return as_failures(rows.select("report_id", (F.col("at") == 0).alias("first"), "piece").mapInArrow(read_pages, RAW))


def explode_pieces(pieces: DataFrame) -> DataFrame:
    """As explode_reports(), of reports whose HTML is dealt over rows (report_id, at, html), in order of `at`: no row, sort or task holds a report whole."""
    spark = pieces.sparkSession
    dealt = pieces.where("html IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "report_id").sortWithinPartitions("report_id", "at")
    return as_failures(dealt.select("report_id", F.lit(False).alias("first"), F.col("html").cast("binary").alias("piece")).mapInArrow(read_pages, RAW))


def as_failures(found: DataFrame) -> DataFrame:
    """What read_pages() found, with texts as failures have them."""
    error = error_text(F.col("error_message"))
    return found.select(
        "report_id", "failure_idx", T.collapse(F.col("test_case_id")).alias("test_case_id"), T.collapse(F.col("scenario_name")).alias("scenario_name"),
        T.collapse(F.col("failed_step_line")).alias("failed_step_line"), error.alias("error_message"), "failure_image", T.collapse(F.col("video_url")).alias("video_url"),
        F.lit("").alias("feature_name"), error.alias("stack_trace"), F.lit("").alias("console_logs"), steps_text(F.col("steps")).alias("all_steps"),
    )


def rendered_item() -> Column:
    """A failure as a test of a report."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    c = F.col
    return F.concat(
        F.lit('<li class="test-item" status="fail" test-id="'), safe(c("test_case_id")), F.lit('"><div class="test-detail"><p class="name">'), safe(c("scenario_name")),
        F.lit('</p></div><div class="step pass-bg"><span>open</span></div><div class="step fail-bg"><span>'), safe(c("failed_step_line")),
        F.lit('</span><textarea class="code-block">'), safe(c("error_message")), F.lit('</textarea><div class="screenshots"><a href="'), safe(c("failure_image")),
        F.lit('">x</a></div><video><source src="'), safe(c("video_url")), F.lit('"></video></div></li>'),
    )


BEFORE, AFTER = "<html><body><ul>", "</ul></body></html>"


def render_reports(failures: DataFrame) -> DataFrame:
    """(report_id, report_type, html): the markup that explode_reports() reads, one report of all its failures."""
    found = failures.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("failure_idx", rendered_item().alias("item")))).alias("items"))
    return found.select("report_id", F.lit("EXTENT").alias("report_type"), F.concat(F.lit(BEFORE), F.array_join("items.item", "\n"), F.lit(AFTER)).alias("html"))


def in_pieces(items: DataFrame, before: str, after: str) -> DataFrame:
    """(report_id, at, html): reports of items (report_id, failure_idx, item), with what stands before and after those of a report."""
    at = lambda part, i: F.struct(F.lit(part).alias("part"), i.alias("failure_idx")).alias("at")
    none = F.lit(None).cast("long")
    ends = F.array(F.struct(at(0, none), F.lit(before).alias("html")), F.struct(at(2, none), F.lit(after).alias("html")))
    frames = items.select("report_id").distinct().select("report_id", F.inline(ends))
    return items.select("report_id", at(1, F.col("failure_idx")), F.col("item").alias("html")).unionByName(frames)


def render_pieces(failures: DataFrame) -> DataFrame:
    """render_reports() in pieces, as explode_pieces() takes them. No piece has a line end at its end: they are lines of a file."""
    return in_pieces(failures.select("report_id", "failure_idx", rendered_item().alias("item")), BEFORE, AFTER)


def read_reports(spark: SparkSession, path: str, report_type: str = "EXTENT") -> DataFrame:
    """Whole HTML files; the file's name is the report's id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report_id"), F.lit(report_type).alias("report_type"), F.col("value").alias("html"))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """HTML files line by line, as explode_pieces() takes them; long files may be split. The file's name is the report's id."""
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("report_id"), at.alias("at"), F.concat("value", F.lit("\n")).alias("html"))


def read_failures_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of {"failures": [...]}, in the order of the list; a null list gives none."""
    item = F.col("item")
    fields = ", ".join(f"{c} string" for c in S.FAILURE_FIELDS)
    raw = spark.read.schema(f"failures array<struct<{fields.replace(' string', ':string')}>>").json(path, multiLine=True)
    found = raw.select(F.input_file_name().alias("report_id"), F.posexplode("failures").alias("failure_idx", "item")).where(item.isNotNull())
    return found.select("report_id", F.col("failure_idx").cast("long").alias("failure_idx"), "item.*")


def to_failure_records(failures: DataFrame, reports: DataFrame) -> DataFrame:
    """The eight fields of failures whose report is of the known type; others give none."""
    known = reports.where(F.upper("report_type") == "EXTENT").select("report_id").distinct()
    names = {"test_case_id": "test_id", "scenario_name": "scenario", "failed_step_line": "failed_step", "error_message": "error", "failure_image": "screenshot", "video_url": "video", "feature_name": "feature", "stack_trace": "stack_trace"}
    return failures.join(known, "report_id").select("report_id", "failure_idx", *[F.col(a).alias(b) for a, b in names.items()])


def to_requests(failures: DataFrame, *keep: str) -> DataFrame:
    """failures as model requests, with further columns to keep."""
    names = {"test_case_id": "test_name", "feature_name": "feature", "scenario_name": "scenario", "failed_step_line": "failed_step", "error_message": "error"}
    same = ("stack_trace", "console_logs", "failure_image", "video_url", "all_steps")
    return failures.select("report_id", "failure_idx", *keep, *[F.col(a).alias(b) for a, b in names.items()], *same, F.lit("EXTENT").alias("report_type"))


def list_text(value) -> str | None:
    """A list's items that aren't blank, joined, and lists in it likewise, however deep."""
    if not isinstance(value, list):
        return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return ", ".join(x for x in map(list_text, value) if x and x.strip())


@F.pandas_udf(StringType())
def joined_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list_text(json.loads(t)))


def as_string(v: Column, lists: Column | None = None) -> Column:
    """Any JSON value as a request's string: lists give their items that aren't blank, joined; objects their JSON; null stays null."""
    kind = F.schema_of_variant(v)
    if lists is None:
        lists = joined_list(F.when(kind.startswith("ARRAY"), F.to_json(v)))
    return F.when(kind.startswith("ARRAY"), lists).when(kind.startswith("OBJECT"), F.to_json(v)).when(kind == "VOID", F.lit(None).cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


REQUEST_NAMES = {c: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(c.split("_"))) for c in S.REQUEST_FIELDS}


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests from JSON texts whose fields may be of any type. Text that isn't an object gives a row of nulls."""
    root = F.try_parse_json(F.col(column))
    field = lambda n: F.try_variant_get(F.col("_root"), f"$.{n}", "variant")
    step = lambda s: F.coalesce(F.when(F.schema_of_variant(s).startswith("OBJECT"), F.coalesce(F.try_variant_get(s, "$.text", "string"), F.try_variant_get(s, "$.raw", "string"))), as_string(s, F.to_json(s)), F.lit(""))
    steps = F.transform(F.try_variant_get(F.col("_root"), "$.allStepsDetail", "array<variant>"), step)
    return lines.withColumn("_root", root).select(*[c for c in lines.columns if c != column], *[as_string(field(n)).alias(c) for c, n in REQUEST_NAMES.items()], steps.alias("all_steps_detail"), F.coalesce(F.try_variant_get(F.col("_root"), "$.forceReanalysis", "boolean"), F.lit(False)).alias("force_reanalysis"))


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))
