"""Secrets in every historical version, each content scanned once for each version of the rules.

Contents are named by their SHA-256. A ledger in the shared folder holds the findings of every (content, rule version)
that was scanned. A run hashes all versions, sends only contents that the ledger lacks to the
scanner, appends their findings, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import if_small, same, whole_text, written

#: The published base rules.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")

#: Further kinds of this library, each with a string that any match contains.
MORE = {
    "pem": (b"-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    "github": (b"gh", re.compile(r"(?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{36,}")),
    "jwt": (b"eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
}
KINDS = (*BASE_KINDS, *MORE)
RULE_VERSION = "1"

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(" ") for i in range(256))


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int


def find_secrets(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) in code points, sorted. Cheap byte searches rule out most texts before a pattern runs."""
    found = []
    low = raw.lower()  # ASCII only
    text = None

    def whole() -> str:
        nonlocal text
        if text is None:
            text = raw.decode("utf-8", "replace")
        return text

    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(whole()) if len(m[2]) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(whole())]
    if b"h" * 24 in raw.translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(whole())]
    for k, (sign, pattern) in enumerate(MORE.values(), len(BASE_KINDS)):
        if sign in raw:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(whole())]
    return sorted(found)


FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t.as_buffer().to_pybytes())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ["digest", "findings"])


def _exists(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger(spark, ledger: str, rule_version: str) -> DataFrame:
    """``digest, findings`` under one rule version; none where the ledger doesn't exist yet."""
    schema = f"digest binary, findings {FINDINGS}, rule_version string"
    if not _exists(spark, ledger):
        return spark.createDataFrame([], schema).drop("rule_version")
    return spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == rule_version).select("digest", "findings")


def scan_versions(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """``path, findings`` of every row of ``versions`` (``path, text``); ``ledger`` is a folder that grows by this run.

    A null text is empty, an empty text has no findings. Rows with equal texts are scanned once, whatever their
    paths, and repeated rows each get their row. Null paths are paths. An empty table gives no rows and
    adds nothing. Other columns are ignored. A run that dies before the ledger's append is
    committed leaves nothing behind; one that dies later finds its contents scanned.
    """
    spark = versions.sparkSession
    text = whole_text(F.col("text"))
    named = versions.select("path", text.cast("binary").alias("content"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    paths = written(named.select("path", "digest"), "paths")
    known = read_ledger(spark, ledger, rule_version).select("digest")
    unseen = written(paths.groupBy("digest").agg(F.min("path").alias("path")).join(known, "digest", "left_anti"), "unseen")
    # One path stands for a content; rows that repeat both are rid of after the scan.
    # In a first run nearly all contents are unseen: the join is left to AQE, which sends the few of a later run whole.
    blobs = named.join(unseen, same(named, unseen, "path", "digest"), "left_semi").select("digest", "content")
    findings = blobs.mapInArrow(_scan, f"digest binary, findings {FINDINGS}").groupBy("digest").agg(F.first("findings").alias("findings"))
    findings.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)

    hits = read_ledger(spark, ledger, rule_version).filter(F.size("findings") > 0).groupBy("digest").agg(F.first("findings").alias("findings"))
    hits = written(hits, "findings")  # most contents have none and need no join
    return paths.join(if_small(hits), "digest", "left").select("path", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def span_text(findings):
    """``kind:start:end`` of all findings, comma-joined."""
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
