"""Messages delivered at least once: exactly one copy of each is kept.

A :class:`MessageStore` holds the one winner of every message. Messages are spread over
buckets by a hash of their identifier, and a partition is one bucket of one month in
which messages were received. Beside the partitions lies the identifier index: for each
bucket a small table of (hash of the identifier, partition). To merge a batch the store
reads the index of the batch's buckets only, looks the batch's identifiers up in it, reads
the partitions they lie in (and those that the batch falls into), recomputes one winner
per identifier over old and new rows, writes new versions of just those partitions and
of the index of their buckets, and makes both visible by one rename of a manifest.
A merge that dies half way leaves the former manifest in force; merging the same batch
again changes nothing. The rename must be atomic and must not replace a file, as on HDFS
or a shared file system; on an object store put the manifest behind a conditional write.

The winner is the copy with the earliest received_at (null counts as latest), and
among equals the smallest row id.
"""

from __future__ import annotations

import json
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A store has at most so many partitions; their names are held by the driver.
PARTITIONS_LIMIT = 20_000
#: Rows a bucket should hold; see :func:`buckets_for`.
BUCKET_ROWS, LEAST_BUCKETS = 20_000_000, 4


def buckets_for(rows: int) -> int:
    """How many buckets a store of about so many messages should have."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def _accents() -> tuple[str, str, str]:
    """Precomposed Latin letters, their base letters and their marks."""
    letters, bases, marks = [], [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2:
            letters.append(chr(code))
            bases.append(parts[0])
            marks.append(parts[1])
    return "".join(letters), "".join(bases), "".join(marks)


def _bare_trace(trace: Column) -> Column:
    return F.substring_index(F.translate(F.lower(trace), "-{}()\"' \t\r\n\u00a0\u200b\ufeff", ""), ":", -1)


def _bare_file(name: Column) -> Column:
    encoded = F.when(name.contains("%"), F.coalesce(F.call_function("try_url_decode", F.replace(name, F.lit("+"), F.lit("%2B"))), name)).otherwise(name)
    last = F.substring_index(F.substring_index(encoded, "/", -1), "\\", -1)
    return F.lower(F.trim(last, F.lit(" \t\r\n\u00a0\u200b\ufeff")))


def with_message_key(df: DataFrame, trace: str, name: str, out: str) -> DataFrame:
    """The messages of ``df``, with one identifier of each.

    A trace id counts however it is written: upper or lower case, with or without dashes,
    braces, blanks, ``urn:uuid:`` or ``trace:`` before it. A file name counts without its
    folder, percent-encoded or not, with composed or decomposed accents, in any case, with
    blanks around it. Rows that lack either are no messages and are left out.

    The key comes out of a generator, so that a filter on it isn't pushed below and each
    row's key is made once; names in ASCII, nearly all, need no pattern.
    """
    df = df.drop(out)
    step = df.where(F.col(trace).isNotNull() & F.col(name).isNotNull())
    step = step.withColumns({"__trace": _bare_trace(F.col(trace)), "__file": _bare_file(F.col(name))})
    letters, bases, marks = _accents()
    last = F.col("__file")
    plain = F.regexp_replace(F.translate(last, letters, bases), r"\p{M}", "")
    signs = F.regexp_replace(F.translate(last, letters, marks), r"\P{M}", "")
    file = F.when(F.octet_length(last) > F.length(last), F.concat(plain, F.lit("|"), signs)).otherwise(last)
    key = F.when((F.col("__trace") != "") & (last != ""), F.array(F.concat("__trace", F.lit("/"), file)))
    return step.select(*df.columns, F.explode(key).alias(out))


def is_message(trace: Column, name: Column) -> Column:
    """Whether a row has both identifiers."""
    return F.coalesce((_bare_trace(trace) != "") & (_bare_file(name) != ""), F.lit(False))


def one_copy(df: DataFrame, key: str, received: str, row_id: str) -> DataFrame:
    """The winner of each key. Spark prunes to one row per key before the shuffle
    (WindowGroupLimit), so a key with very many copies costs one row per task."""
    order = Window.partitionBy(key).orderBy(F.col(received).asc_nulls_last(), F.col(row_id).asc())
    return df.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


class MessageStore:
    """One copy of each message below ``path``, a folder that all executors share.

    ``buckets`` counts for a new store only; an old one keeps its own. Columns of a batch
    that begin with ``__`` belong to the store. Every row of a batch must have a key, as
    :func:`with_message_key` leaves it, and all batches the same columns. An empty batch
    changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, received: str, row_id: str, buckets: int = 1):
        self.spark, self.path, self.key, self.received, self.row_id = spark, path.rstrip("/"), key, received, row_id
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self.buckets = self._state().get("buckets", buckets)

    # -- manifest -----------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names(self.path) if n.startswith("manifest-") and n.endswith(".json"))

    def _state(self, version: int | None = None) -> dict:
        """What a manifest says, by default the newest: buckets, schema, parts and index."""
        versions = self._versions()
        if not versions:
            return {"version": 0}
        version = version or versions[-1]
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": version}
        finally:
            stream.close()

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The newest version and the folder of each partition."""
        state = self._state()
        return state["version"], state.get("parts", {})

    def _publish(self, version: int, state: dict) -> None:
        aside = self._path(f"{self.path}/.manifest-{version}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{self.path}/manifest-{version}.json")):
            raise RuntimeError(f"version {version} was written by another merge")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest ``keep`` versions don't need; returns the folders deleted.
        Readers of older versions must be done."""
        versions = self._versions()
        states = [self._state(v) for v in versions[-max(1, keep) :]]
        used = {folder for s in states for kind in ("parts", "index") for folder in s[kind].values()}
        gone = 0
        for version in versions[: -max(1, keep)]:
            old = self._state(version)
            for folder in {*old["parts"].values(), *old["index"].values()} - used:
                gone += bool(self._fs.delete(self._path(folder), True))
            self._fs.delete(self._path(f"{self.path}/manifest-{version}.json"), False)
        return gone

    # -- reading ------------------------------------------------------------------
    def _rows(self, state: dict, partitions: set[str] | None = None) -> DataFrame | None:
        paths = [f for p, f in sorted(state.get("parts", {}).items()) if partitions is None or p in partitions]
        return self.spark.read.schema(state["schema"]).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The stored messages; None for an empty store."""
        found = self._rows(self._state())
        return None if found is None else found.drop("__hash", "__part", "__bucket")

    def index(self, buckets: set[int] | None = None, state: dict | None = None) -> DataFrame | None:
        """(__hash, __part) of the messages of some buckets, by default of all; None if
        there are none."""
        state = state or self._state()
        paths = [f for b, f in sorted(state.get("index", {}).items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema("__hash bigint, __part string").parquet(*paths) if paths else None

    # -- merging ------------------------------------------------------------------
    def merge(self, batch: DataFrame) -> set[str]:
        """Merge a batch; returns the partitions that were written anew.

        The bucket is taken from the hash by which Spark shuffles rows to find winners, so
        where the number of shuffle partitions is a multiple of the number of buckets (or
        the other way round) each task writes whole buckets, without a second shuffle.
        """
        month = F.coalesce(F.date_format(self.received, "yyyy-MM"), F.lit("none"))
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        part = month if self.buckets == 1 else F.concat(month, F.lit("."), bucket.cast("string"))
        keyed = batch.withColumns({"__hash": F.xxhash64(self.key), "__bucket": bucket, "__part": part})
        state = self._state()
        version, parts, index = state["version"] + 1, state.get("parts", {}), state.get("index", {})
        rows, touched = keyed, set()
        if parts:
            falls = self._few(keyed.select("__bucket", "__part").distinct())
            if not falls:
                return set()
            touched = {p for _, p in falls}
            known = self.index({b for b, _ in falls}, state)
            if known is not None:
                touched |= {p for (p,) in self._few(known.join(keyed.select("__hash"), "__hash", "left_semi").select("__part").distinct())}
            old = self._rows(state, touched)
            rows = keyed if old is None else old.unionByName(keyed)
        target = f"{self.path}/v{version}-{uuid.uuid4().hex[:8]}"
        winners = one_copy(rows, self.key, self.received, self.row_id)
        winners.withColumn("__dir", F.col("__part")).write.partitionBy("__dir").parquet(f"{target}/rows")
        written = {n[6:]: f"{target}/rows/{n}" for n in self._names(f"{target}/rows") if n.startswith("__dir=")}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in winners.schema)
        after = {"buckets": self.buckets, "schema": schema, "parts": {p: f for p, f in parts.items() if p not in touched} | written}
        after["index"] = index | self._write_index(state, after, touched, set(written), target)
        self._publish(version, after)
        return touched | set(written)

    def _write_index(self, before: dict, after: dict, touched: set[str], written: set[str], target: str) -> dict[str, str]:
        """New index tables of the buckets whose partitions changed: what they said of other
        partitions, and what stands in the new ones."""
        of = lambda p: int(p.rpartition(".")[2]) if self.buckets > 1 else 0
        changed = {of(p) for p in touched | written}
        entries = self._rows(after, written)
        entries = None if entries is None else entries.select("__hash", "__part")
        if (old := self.index(changed, before)) is not None:
            names = self.spark.createDataFrame([(p,) for p in sorted(touched | written)], "__part string")
            rest = old.join(F.broadcast(names), "__part", "left_anti").select("__hash", "__part")  # few by PARTITIONS_LIMIT
            entries = rest if entries is None else entries.unionByName(rest)
        if entries is None:
            return {}
        bucket = F.substring_index("__part", ".", -1) if self.buckets > 1 else F.lit("0")
        entries.withColumn("__dir", bucket).repartition("__dir").write.partitionBy("__dir").parquet(f"{target}/index")
        return {n[6:]: f"{target}/index/{n}" for n in self._names(f"{target}/index") if n.startswith("__dir=")}

    def _few(self, names: DataFrame) -> list:
        rows = names.limit(PARTITIONS_LIMIT + 1).collect()
        if len(rows) > PARTITIONS_LIMIT:
            raise ValueError("the store has too many partitions")
        return rows
