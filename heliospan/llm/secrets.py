"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import materialize, over_batches, prepared, scratch_dir


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, its least length, and a version that changes with any of them."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}.{self.version}"


# The base rules in their order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

BLOB = "blob STRING, text STRING"
FINDINGS = "blob STRING, rule STRING, spans ARRAY<STRUCT<start: INT, end: INT>>"


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points; one whose group is too short is dropped after it was matched."""
    found = _compiled(rule).finditer(text)
    return [m.span() for m in found if len(m[rule.group]) >= rule.least]


_CACHE: dict[Rule, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    if rule not in _CACHE:
        pattern = rule.pattern
        if rule.kind == "hex":  # a run of 16 or more is found directly, and is a whole run either way
            pattern = f"[0-9a-f]{{{rule.least},}}"
        _CACHE[rule] = re.compile(pattern, re.ASCII)
    return _CACHE[rule]


def blob_of(text: F.Column) -> F.Column:
    """Content address: the digest of the UTF-8 bytes; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scan(batch: pa.RecordBatch, rules: tuple[Rule, ...]) -> Iterator[dict]:
    blobs, names, spans = [], [], []
    todo = batch.column("rules").to_pylist()
    by_key = {r.key: r for r in rules}
    for blob, text, keys in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), todo):
        for key in keys:
            blobs.append(blob)
            names.append(key)
            spans.append([{"start": s, "end": e} for s, e in matches(by_key[key], text or "")])
    yield {"blob": blobs, "rule": names, "spans": spans}


class Ledger:
    """Findings per (blob, rule and version), appended to a folder; blobs without findings are noted too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """What was scanned so far, one row per pair even if a lost run wrote a pair twice."""
        try:
            return self.spark.read.schema(FINDINGS).parquet(self.path).dropDuplicates(["blob", "rule"])
        except AnalysisException:
            return self.spark.createDataFrame([], FINDINGS)

    def update(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the (blob, rule version) pairs of ``texts`` that the ledger lacks; return the pairs scanned now.

        Copies share a blob, so a text that a third of all paths share is scanned
        once; a task keeps one text per address before anything is exchanged.
        """
        wanted = texts.select("blob", "text")
        known = self.read().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        have = F.array(*[F.lit(r.key) for r in rules])
        lacking = F.array_except(have, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = wanted.dropDuplicates(["blob"]).join(known, "blob", "left").withColumn("rules", lacking)
        unseen = unseen.filter(F.size("rules") > 0).select("blob", "text", "rules")
        new = materialize(over_batches(unseen, lambda batch: _scan(batch, rules), FINDINGS), "findings")
        new.write.mode("append").parquet(self.path)
        return new


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and its spans (kind, start, end) in order of start, then kind as listed.

    Every row of ``docs`` comes back, repeated rows and null ids too; a null text
    is the empty blob, without findings. Findings are joined to all paths of their
    blob; a blob with very many paths is split by the skew join.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select("doc_id", blob_of(F.col("text")).alias("blob"), "text")
    ledger.update(rows, rules)
    turn = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    hits = ledger.read().filter(F.col("rule").isin([r.key for r in rules])).select(
        "blob", "rule", F.explode("spans").alias("s"))
    hits = hits.select("blob", F.struct(
        F.col("s.start").alias("start"), turn[F.col("rule")].alias("turn"), kind[F.col("rule")].alias("kind"),
        F.col("s.end").alias("end")).alias("hit"))
    per_blob = hits.groupBy("blob").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    return rows.select("doc_id", "blob").join(materialize(per_blob, "hits"), "blob", "left")


def secret_report(docs: DataFrame) -> DataFrame:
    """Digest of a first scan: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = prepared(docs.sparkSession)
    found = scan(docs, Ledger(spark, scratch_dir(spark, "ledger")))
    hits = F.coalesce("hits", F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, turn: INT, kind: STRING, end: INT>>)"))
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")
    listed = F.concat_ws(",", F.transform("hits", lambda h: F.concat_ws(":", h["kind"], h["start"], h["end"])))
    return found.withColumn("hits", hits).select(
        F.col("doc_id").cast("long").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))
