"""A data source over a paged trace interface (REST), and the rows of its traces.

``spark.read.format("gaugeworks_traces")``; options: url, public_key, secret_key, path
(traces, or scores), session, name, from, to, max_items, page_size, pages_per_task,
min_interval. Requests are spaced by min_interval and repeated on failure. All pages are one
partition unless pages_per_task says otherwise: the rate of requests grows with the tasks,
so smaller ranges are for servers without a limit and for saved pages (a ``file:`` URL
of a folder that all executors see).
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, name string, session_id string, timestamp string, raw string"
TIMEOUT, RETRIES = 90, 8


def fetch(url: str, auth: tuple[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    """A JSON answer; waits and repeats on failures and on answers that ask to slow down."""
    request = urllib.request.Request(url)
    if auth:
        request.add_header("Authorization", "Basic " + base64.b64encode(":".join(auth).encode()).decode())
    for turn in range(RETRIES):
        try:
            with opener(request, timeout=TIMEOUT) as answer:
                return json.loads(answer.read().decode())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or turn == RETRIES - 1:
                raise
            wait = e.headers.get("Retry-After") if e.headers else None
            sleep(float(wait) if wait and wait.replace(".", "", 1).isdigit() else 2**turn)
        except urllib.error.URLError:
            if turn == RETRIES - 1:
                raise
            sleep(2**turn)
    raise RuntimeError("unreachable")


def page_url(options: dict, page: int) -> str:
    if options["url"].startswith("file:"):  # pages saved as files
        return f"{options['url'].rstrip('/')}/{options.get('path', 'traces')}-{page}.json"
    query = {"page": page, "limit": int(options.get("page_size", 50))}
    for key, name in (("session", "sessionId"), ("name", "name"), ("from", "fromTimestamp"), ("to", "toTimestamp")):
        if options.get(key):
            query[name] = options[key]
    return f"{options['url'].rstrip('/')}/{options.get('path', 'traces')}?{urllib.parse.urlencode(query)}"


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    room: int


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _auth(self) -> tuple[str, str] | None:
        return (self.options["public_key"], self.options["secret_key"]) if self.options.get("public_key") else None

    def partitions(self) -> list[Pages]:
        head = fetch(page_url(self.options, 1), self._auth())
        pages = int((head.get("meta") or {}).get("totalPages") or 1)
        size, most = int(self.options.get("page_size", 50)), int(self.options.get("max_items") or 0)
        if most:
            pages = min(pages, -(-most // size))
        # one task by default: the interval between requests is kept within a task
        step = int(self.options.get("pages_per_task") or pages)
        return [Pages(p, min(pages, p + step - 1), (most - (p - 1) * size) if most else -1) for p in range(1, pages + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        gap, left = float(self.options.get("min_interval", 1.0)), partition.room
        for page in range(partition.first, partition.last + 1):
            began = time.monotonic()
            for item in fetch(page_url(self.options, page), self._auth()).get("data") or []:
                if left == 0:
                    return
                left -= 1
                yield (item.get("id"), item.get("name"), item.get("sessionId"), item.get("timestamp"), json.dumps(item))
            if page < partition.last:
                time.sleep(max(0.0, gap - (time.monotonic() - began)))


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gaugeworks_traces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)


def _frame(spark: SparkSession, url: str, path: str, session: str | None = None, name: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(TraceSource)
    given = {"url": url, "path": path, "session": session, "name": name, **options}
    return spark.read.format(TraceSource.name()).options(**{k: str(v) for k, v in given.items() if v not in (None, "")}).load()


def list_traces(spark: SparkSession, url: str, **options) -> DataFrame:
    """The traces of a session, a name or a span of time (session, name, from, to, max_items)."""
    return _frame(spark, url, "traces", **options)


def list_scores(spark: SparkSession, url: str, **options) -> DataFrame:
    """(id, trace_id, name, value_num, value_str, timestamp) of the scores on the server."""
    raw = _frame(spark, url, "scores", **options)
    of = lambda k: F.get_json_object("raw", f"$.{k}")
    number = of("value").try_cast("double")
    return raw.select("id", of("traceId").alias("trace_id"), "name", number.alias("value_num"), F.when(number.isNull(), F.coalesce(of("stringValue"), of("value"))).alias("value_str"), "timestamp")


def one(url: str, kind: str, key: str, auth: tuple[str, str] | None = None, opener: Callable = urllib.request.urlopen) -> dict:
    """A single trace or session (``kind`` is traces or sessions) as the server gives it."""
    return fetch(f"{url.rstrip('/')}/{kind}/{urllib.parse.quote(key, safe='')}", auth, opener)


SPAN_SCHEMA = "span_id string, trace_id string, name string, start_time string, end_time string, status string, raw string"


def spans(spark: SparkSession, url: str, project: str, limit: int = 1000, opener: Callable = urllib.request.urlopen) -> DataFrame | None:
    """Up to ``limit`` spans of a project from a collector; None if it doesn't answer. Both
    the newer layout (``data`` with ``context``) and the older one (flat rows) are read."""
    if not available(url, opener=opener):
        return None
    try:
        answer = fetch(f"{url.rstrip('/')}/v1/projects/{urllib.parse.quote(project, safe='')}/spans?limit={limit}", opener=opener)
    except (OSError, ValueError, RuntimeError):
        return None
    found = (answer.get("data") or answer.get("spans") or []) if isinstance(answer, dict) else answer
    rows = []
    for s in found[:limit]:
        ids = s.get("context") or {}
        status = s.get("status_code") or (s.get("status") if isinstance(s.get("status"), str) else None)
        rows.append((ids.get("span_id") or s.get("span_id"), ids.get("trace_id") or s.get("trace_id"), s.get("name"), s.get("start_time"), s.get("end_time"), status, json.dumps(s)))
    return spark.createDataFrame(rows, SPAN_SCHEMA)


def send_scores(scores: DataFrame, url: str, auth: tuple[str, str] | None, post: Callable | None = None) -> int:
    """Sends (trace_id, name, value, comment) rows to a server; returns how many it took.

    Without credentials nothing is sent, and a failure to send never raises: scoring goes
    on without the server. Rows without a trace are passed over. Each task posts its rows.
    """
    if not auth:
        return 0
    rows = scores.where("trace_id is not null").select("trace_id", "name", "value", "comment")
    target, head = f"{url.rstrip('/')}/scores", "Basic " + base64.b64encode(":".join(auth).encode()).decode()
    deliver = post or _post

    def run(batches: Iterator) -> Iterator:
        sent = 0
        for batch in batches:
            for row in batch.to_pylist():
                body = {"traceId": row["trace_id"], "name": row["name"], "value": row["value"], "comment": row["comment"]}
                try:
                    deliver(target, head, json.dumps(body).encode())
                    sent += 1
                except (OSError, ValueError):
                    continue
        yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64())})

    return rows.mapInArrow(run, "sent bigint").agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]


def _post(url: str, auth: str, body: bytes) -> None:
    request = urllib.request.Request(url, body, {"Authorization": auth, "Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        answer.read()


def sorter_rows(traces: DataFrame) -> DataFrame:
    """One flat row per trace of a sorter; traces without a type and an expectation are left out."""
    of = lambda path: F.coalesce(F.get_json_object("raw", f"$.output.sorter.{path}"), F.get_json_object("raw", f"$.output.{path}"))
    yes = lambda c: _truthy(of(c))
    rows = traces.select(
        F.col("session_id").alias("session"), F.get_json_object("raw", "$.input.filename").alias("filename"), F.col("id").alias("trace_id"),
        of("expected_subtype").alias("expected_subtype"), of("contract_subtype").alias("contract_subtype"), yes("subtype_ok").alias("subtype_ok"),
        yes("subtype_ok_equiv").alias("subtype_ok_equiv"), yes("doc_type_ok").alias("doc_type_ok"), of("confidence").try_cast("double").alias("confidence"),
        of("doc_type").alias("doc_type"), F.get_json_object("raw", "$.input.model").alias("model"), F.get_json_object("raw", "$.input.prompt_version").alias("prompt_version"), F.col("timestamp"),
    )
    return rows.where(F.col("doc_type").isNotNull() | F.col("expected_subtype").isNotNull())


def _truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(c).isin("false", "0", "", "null", "none"), F.lit(False))


def available(url: str, timeout: float = 3.0, opener: Callable = urllib.request.urlopen) -> bool:
    """Whether a span collector answers."""
    try:
        with opener(url, timeout=timeout) as answer:
            return 200 <= answer.status < 500
    except (OSError, ValueError):
        return False
