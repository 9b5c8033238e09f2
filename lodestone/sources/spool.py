"""The capture queue, written and read, batch and stream; a paged relay as a data source, read and written."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestone.schema import MAX_BATCH_ENTRIES, MAX_CONTENT_CHARS

#: The sources of hook events, and the fields in which a hook's input may hold its text.
EVENT_SOURCES = {"SessionStart": "session_start", "PreCompact": "pre_compact", "Stop": "stop", "UserPromptSubmit": "user_prompt"}
TEXT_FIELDS = ("summary", "content", "text", "output", "message", "description", "prompt")


def capture_lines(inputs: DataFrame, ts: str) -> DataFrame:
    """Queue lines (value) of hook inputs: columns input and project_id, and source, task_id and session_id if there are any.

    The input is a JSON object, or plain text; its content is the first text field that
    is not empty, else all of it, on one line and cut at the longest length.  A source
    that isn't given follows from hook_event_name, a task from the first TASK-<n> in the
    input.  Inputs without a project give no line; null inputs count as empty.
    """
    have = set(inputs.columns)
    rows = inputs.where("coalesce(project_id, '') <> ''").withColumn("input", F.coalesce("input", F.lit("")))
    field = lambda name: F.nullif(F.get_json_object("input", f"$.{name}"), F.lit(""))
    given = lambda name, other: F.coalesce(F.nullif(F.col(name), F.lit("")), other) if name in have else other
    event = field("hook_event_name")
    source = F.lit("unknown")
    for name, found in EVENT_SOURCES.items():
        source = F.when(event == name, found).otherwise(source)
    flat = F.translate(F.coalesce(*[field(n) for n in TEXT_FIELDS], F.col("input")), "\n\r", " ")  # line feeds become spaces, carriage returns go
    parts = {"source": given("source", source), "agent": F.coalesce(field("agent_name"), field("agent_type"), F.lit("unknown")), "task_id": given("task_id", F.nullif(F.regexp_extract("input", "TASK-[0-9]+", 0), F.lit("")))}
    line = F.struct(F.lit(1).alias("v"), *[c.alias(n) for n, c in parts.items()], given("session_id", field("session_id")).alias("session_id"), F.col("project_id"), F.lit(ts).alias("ts"), F.substring(flat, 1, MAX_CONTENT_CHARS).alias("content"), F.struct(*[c.alias(n) for n, c in parts.items()], F.lit("lodestone").alias("captured_by")).alias("metadata"))
    return rows.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def write_queue(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path, lineSep="\n")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n")


def stream_queue(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; each is read once under a checkpoint."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(path)


WIRE_ROW = "entry_id string, client_id string, sequence_no long, op string, record_id string, blinded_project_id string, ts string, payload string"


def _page(options: dict, cursor: str) -> tuple[list[dict], str, bool]:
    """(entries, cursor after them, whether more follow) of a relay's page; a page without a cursor leaves it where it was."""
    url = f"{options['url'].rstrip('/')}/oplog/{options['project']}?since={cursor}"
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {options.get('token', '')}"})
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", "30"))) as r:
        body = json.load(r)
    entries, after = (body.get("entries"), body.get("cursor")) if isinstance(body, dict) else (None, None)
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("bad envelope")
    if after is not None and not (isinstance(after, str) and after.isascii() and after.isdigit() and len(after) <= 19):
        raise ValueError("bad envelope")
    after = cursor if after is None else after
    return entries, after, bool(body.get("has_more")) and after != cursor


def _row(e: dict) -> tuple:
    return (e["entry_id"], e["client_id"], int(e["sequence_no"]), e["op"], e["record_id"], e["blinded_project_id"], e["ts"], e["payload"])


class Page(InputPartition):
    """Entries after a cursor: all, or those up to a last one."""

    def __init__(self, cursor: str, last: str | None = None, after: str | None = None):
        self.cursor, self.last, self.after = cursor, last, after


class _RelayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(self.options.get("cursor", "0"))]

    def read(self, partition: Page) -> Iterator[tuple]:
        cursor, more = partition.cursor, True
        while more:
            entries, cursor, more = _page(self.options, cursor)
            yield from map(_row, entries)


class RelayPull(DataSource):
    """format("relay_pull"): all wire rows of a project after a cursor, page by page until drained.

    Options: url, project, cursor, token, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "relay_pull"

    def schema(self) -> str:
        return WIRE_ROW

    def reader(self, schema) -> DataSourceReader:
        return _RelayReader(dict(self.options))


class _RelayStreamReader(DataSourceStreamReader):
    """An offset is the cursor that a batch reaches, with what is needed to read it again: where its walk began, and
    the pages of that walk, each by the cursor after it and its last entry.

    Pages are read again up to that last entry, so a batch that is run twice reads the same
    entries, whatever the relay got in between and however long its pages are by then.
    """

    def __init__(self, options: dict):
        self.options, self.first = options, self._at(options.get("cursor") or "0")
        self.offset = self.first

    @staticmethod
    def _at(cursor: str) -> dict:
        return {"from": cursor, "cursor": cursor, "pages": {}}

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        start = cursor = self.offset["cursor"]
        pages, more = {}, True
        while more and len(pages) < int(self.options.get("pages", "100")):
            entries, cursor, more = _page(self.options, cursor)
            if entries and cursor in (start, *pages):
                raise ValueError("a page that doesn't move its cursor")
            if entries:
                pages[cursor] = entries[-1]["entry_id"]
        if pages:
            self.offset = {"from": start, "cursor": cursor, "pages": pages}
        return self.offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # the batches that a restarted query runs again come first; the walk goes on from them
        if int(end["cursor"]) > int(self.offset["cursor"]):
            self.offset = end
        out, before = [], end["from"]
        for after in sorted(end["pages"], key=int):
            if int(after) > int(start["cursor"]):
                out.append(Page(max(before, start["cursor"], key=int), end["pages"][after], after))
            before = after
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        cursor, more = partition.cursor, True
        while more:
            entries, cursor, more = _page(self.options, cursor)
            for e in entries:
                yield (*_row(e), partition.after)
                if e["entry_id"] == partition.last:
                    return
        raise ValueError(f"the relay no longer has entry {partition.last}")


class RelayStream(DataSource):
    """format("relay_stream"): a project's wire rows after a cursor as a stream, a task for each page of a batch.

    cursor is a page's: with all rows of a batch, its greatest is where the next batch
    goes on.  The driver walks the pages that a batch is to have and keeps their cursors and
    last entries only.  A query that starts again must be given a cursor no later than that of
    its checkpoint's last batch; what comes before is skipped.
    Options: url, project, cursor, token, timeout, pages (of a batch at most; 100).
    """

    @classmethod
    def name(cls) -> str:
        return "relay_stream"

    def schema(self) -> str:
        return f"{WIRE_ROW}, cursor string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RelayStreamReader(dict(self.options))


class _RelayWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        batch: list[dict] = []
        for row in iterator:
            batch.append(row.asDict())
            if len(batch) == MAX_BATCH_ENTRIES:
                self._send(batch)
                batch = []
        if batch:
            self._send(batch)
        return WriterCommitMessage()

    def _send(self, entries: list[dict]) -> None:
        url = f"{self.options['url'].rstrip('/')}/oplog/{self.options['project']}"
        body = json.dumps({"entries": entries}).encode()
        headers = {"Authorization": f"Bearer {self.options.get('token', '')}", "Content-Type": "application/json"}
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=float(self.options.get("timeout", "30"))):
            pass


class RelayPush(DataSource):
    """format("relay_push"): posts wire rows to a relay in batches of at most 1000.

    A task that is tried again posts its rows again; the relay ignores what it has.
    Options: url, project, token, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "relay_push"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RelayWriter(dict(self.options))
