"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger
lists the pairs of blob and rule version scanned before; a run scans each unseen
blob once, whatever the number of paths and versions that have it, with the rules
it has not been scanned with. Findings and paths are kept by blob and joined in the
end: for the paths of the run, or by ``Ledger.report`` for all paths ever seen.

Texts are not exchanged: which rows to leave out (further copies of a blob, blobs
that the ledger knows) is a small table, broadcast while its size, which is
checked, is under ``BROADCAST_BYTES`` and joined by a shuffle beyond.

Defined results
---------------
* One row per path and finding: doc_id, path (source and id), blob, rule, version,
  start, end (character offsets), secret_sha256. The secret itself isn't shown.
* Null texts have no blob. The empty text is a blob without findings. A null
  source or id is written as an empty part of the path; repeated rows of one path
  and text are one version. Other columns are ignored.
* A secret is taken to its end, however long; a private key from its first line
  to its last, or as far as its code goes.
* Findings of a rule don't overlap; those of different rules may.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed, ensure_checkpoint_dir, is_missing, read_table

BROADCAST_BYTES = 64 << 20


class Rule(NamedTuple):
    """A rule: texts with one of ``anchors`` (lower case) are searched for ``pattern``.

    The secret is group 1, or the whole match without groups.
    """

    name: str
    version: int
    anchors: tuple[str, ...]
    pattern: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: A key's name, read whole so that long words are read once, and what may stand between it and the value.
_TOKEN = r"(?<![a-z0-9_-])(?=[a-z0-9_-]*(?:token|secret|api[_-]?key))[a-z0-9_-]++"
_PASSWORD = r"(?<![a-z0-9_-])(?=(?:[a-z0-9_-]*[_-])?(?:password|passwd|pwd))[a-z0-9_-]++"
_TO_VALUE = r"(?:\\?[\"'])?\s*+[=:]\s*+(?:\\?[\"'])?"
_KEY_END = r"-----END [A-Z ]{0,20}PRIVATE KEY-----"

RULES = (
    Rule("access_key_id", 1, ("akia", "asia"), r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    Rule("password_assignment", 2, ("password", "passwd", "pwd"), r"(?i)" + _PASSWORD + _TO_VALUE + r"([^\s\"']{8,}+)"),
    Rule("token_assignment", 2, ("token", "secret", "api_key", "apikey", "api-key"), r"(?i)" + _TOKEN + _TO_VALUE + r"([A-Za-z0-9+/_.=-]{16,}+)"),
    Rule("private_key", 2, ("private key",), r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+" + _KEY_END + r"|(?:\s*+[A-Za-z0-9+/=]{40,}+)*+)"),
    Rule("git_token", 2, ("ghp_", "gho_", "ghs_", "github_pat_"), r"(?<![A-Za-z0-9_])(gh[pos]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+)(?![A-Za-z0-9_])"),
    Rule("chat_token", 2, ("xox",), r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,}+)"),
    Rule("json_web_token", 1, ("eyj",), r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    Rule("bearer_header", 2, ("bearer",), r"(?i)bearer\s+([A-Za-z0-9._~+/=-]{20,}+)"),
    Rule("url_credentials", 2, ("://",), r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*+:([^\s/:@]{3,}+)@"),
)


def scan_text(text: str, rules: list[tuple[str, int, tuple[str, ...], re.Pattern]]) -> list[tuple[str, int, int, int, str]]:
    """(rule, version, start, end, hash of the secret) of each finding."""
    out, low = [], text.lower()
    for name, version, anchors, pattern in rules:
        if any(a in low for a in anchors):
            for m in pattern.finditer(text):
                g = 1 if pattern.groups else 0
                out.append((name, version, m.start(g), m.end(g), hashlib.sha256(m.group(g).encode("utf-8", "replace")).hexdigest()))
    return out


def versions(docs: DataFrame) -> DataFrame:
    """path, blob, prefix (64 bits of it), id of every version that has a text."""
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    made = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.sha2("text", 256).alias("blob"))
    return made.withColumns({"key": F.coalesce("doc_id", F.lit(-1)), "prefix": F.conv(F.substring("blob", 1, 15), 16, 10).cast("long")})


class Ledger:
    """Scanned pairs, findings and paths as tables in a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], schema)

    def is_new(self) -> bool:
        """Whether nothing has been scanned yet."""
        return not self._read("scanned", "blob string").limit(1).count()

    def scanned(self, blobs: DataFrame | None = None) -> DataFrame:
        """blob, rules (name@version); of ``blobs`` (blob) only, if given."""
        made = self._read("scanned", "blob string, rules array<string>")
        if blobs is not None:  # a small batch doesn't set the ledger in motion
            made = made.join(_within(blobs.select("blob"), 256), "blob", "left_semi")
        return made.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, rule string, version int, start long, end long, secret_sha256 string").distinct()

    def paths(self) -> DataFrame:
        """doc_id, path, blob of every version seen."""
        return self._read("paths", "doc_id long, path string, blob string").distinct()

    def append(self, scanned: DataFrame, found: DataFrame, paths: DataFrame) -> None:
        """A pair counts as scanned only once all else is safe; what a broken run leaves counts once."""
        found.write.mode("append").parquet(f"{self.path}/findings")
        paths.write.mode("append").parquet(f"{self.path}/paths")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")

    def report(self, rules: tuple[Rule, ...] | None = None) -> DataFrame:
        """Findings of ``rules`` on all paths ever seen, as ``scan`` gives them."""
        return _joined(self.paths(), _of(self.findings(), RULES if rules is None else rules))


def _of(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return found.filter(F.concat_ws("@", "rule", "version").isin([r.key for r in rules]))


def _joined(paths: DataFrame, found: DataFrame) -> DataFrame:
    return paths.join(found, "blob").select("doc_id", "path", "blob", "rule", "version", "start", "end", "secret_sha256")


def _within(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, are within the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all paths of ``docs``; the ledger, if given, is brought up to date."""
    keys = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
    all_versions = checkpointed(versions(docs))
    blobs = all_versions.groupBy("blob").agg(F.min("key").alias("first"))
    complete_only = ledger is None or ledger.is_new()  # each blob with all rules or not at all
    if not complete_only:
        blobs = checkpointed(blobs)
        done = ledger.scanned(blobs)
        blobs = checkpointed(blobs.join(done, "blob", "left").withColumn("missing", F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>")))).drop("rules"))
    else:
        blobs = blobs.withColumn("missing", keys)
    complete = "size(missing) = 0"
    marked = all_versions.join(blobs, "blob").filter(f"key <> first OR {complete}").select("key", "prefix").distinct()
    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key"), F.sha2("text", 256).alias("blob"), "text")
    texts = texts.withColumn("prefix", F.conv(F.substring("blob", 1, 15), 16, 10).cast("long")).join(_within(checkpointed(marked), 16), ["key", "prefix"], "left_anti")
    if complete_only:
        texts = texts.withColumn("missing", F.lit(None).cast("array<string>"))
    else:
        partly = checkpointed(blobs.filter(F.size("missing").between(1, len(rules) - 1)).select("blob", "missing"))
        texts = texts.join(_within(partly, 64 + 24 * len(rules)), "blob", "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(r.name, r.version, r.anchors, re.compile(r.pattern), r.key) for r in rules]
        for b in batches:
            out = []
            for blob, text, missing in zip(b["blob"], b["text"], b["missing"]):
                wanted = [r[:4] for r in ready if missing is None or r[4] in missing]
                out += [(blob, *f) for f in scan_text(text, wanted)]
            yield pd.DataFrame(out, columns=["blob", "rule", "version", "start", "end", "secret_sha256"]).astype({"version": "int32", "start": "int64", "end": "int64"})

    found = texts.select("blob", "text", "missing").mapInPandas(apply, "blob string, rule string, version int, start long, end long, secret_sha256 string")
    found = checkpointed(found.distinct())
    paths = all_versions.select("doc_id", "path", "blob").distinct()
    if ledger is not None:
        ledger.append(blobs.filter("size(missing) > 0").select("blob", F.col("missing").alias("rules")), found, paths)
        found = _of(ledger.findings(), rules)
    return _joined(paths, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each a version of the path source/id, through a new ledger in the shared folder."""
    ledger = Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return scan(read_table(spark, sf_dir, "documents"), ledger)
