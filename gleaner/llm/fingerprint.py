"""Document fingerprints: a homomorphic hash of a document's paragraphs.

Every paragraph is hashed to a wide vector of ``LANES`` numbers of 32 bits, the
eight words of SHA-256 of the paragraph and a block number, for eight blocks. The
state of a document is the sum of the vectors, lane by lane modulo 2**32. So the
order of the paragraphs doesn't matter, and paragraphs are added to or taken from
a state without the rest of the text. The fingerprint is SHA-256 of the state.

The sum tells unlike documents apart that nobody made to collide. Someone who may
choose paragraphs freely can look for sums that vanish, and 64 lanes are few against
that; the lanes are a parameter of the module (``BLOCKS``).

Defined results
---------------
* Paragraphs are the lines of a text without spaces, tabs and carriage returns at
  both ends; empty ones don't count. Repeated ones count each time.
* A null text, an empty one and one without a paragraph have the state of zeros.
* Every row of the input gives a row, also without an id or repeated.
* Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import read_table

BLOCKS = 8
LANES = 8 * BLOCKS
_SUFFIXES = [b"\x1f%d" % i for i in range(BLOCKS)]


def paragraphs(text: str | None) -> list[str]:
    return [p for line in text.split("\n") if (p := line.strip(" \t\r"))] if text else []


def vectors(parts: Iterable[str]) -> np.ndarray:
    """The wide vectors of paragraphs, a row each."""
    out = bytearray()
    for part in parts:
        start = hashlib.sha256(part.encode("utf-8", "replace"))
        for suffix in _SUFFIXES:
            h = start.copy()
            h.update(suffix)
            out += h.digest()
    return np.frombuffer(bytes(out), ">u4").reshape(-1, LANES).astype(np.uint32)


def state_of(parts: Iterable[str]) -> np.ndarray:
    return vectors(parts).sum(axis=0, dtype=np.uint32)


def to_hex(state: np.ndarray) -> str:
    return state.astype(">u4").tobytes().hex()


def from_hex(state: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(state), ">u4").astype(np.uint32)


def digest(state: str) -> str:
    return hashlib.sha256(state.encode()).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, state (hex), fingerprint; one row per row of ``docs``.

    Nothing is exchanged: each text is read where it is.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, text in zip(b["doc_id"], b["text"]):
                parts = paragraphs(text)
                state = to_hex(state_of(parts))
                out.append((id_, len(parts), state, digest(state)))
            made = pd.DataFrame(out, columns=["doc_id", "n_paragraphs", "state", "fingerprint"])
            made["doc_id"] = b["doc_id"].to_numpy()
            yield made

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = source.mapInPandas(apply, "doc_id string, n_paragraphs long, state string, fingerprint string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def update_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """``states`` (doc_id, n_paragraphs, state, fingerprint) after ``changes``.

    changes: doc_id, paragraph, added (true: inserted, false: deleted). Paragraphs
    are hashed where they are and summed by id before they are exchanged, then added
    to the states; ids without a state start at zeros. Every state of an id that has
    several is changed alike; those without an id stay, as do others without a
    change; a null state is one of zeros. Deleting what was never there is not
    noticed, as the hash keeps no list; the count then falls below the truth.
    Changes with a null in a column or an empty paragraph change nothing.
    """

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made: dict[int, list] = {}
            for id_, paragraph, added in zip(b["doc_id"], b["paragraph"], b["added"]):
                part = paragraph.strip(" \t\r")
                if part:
                    one = made.setdefault(id_, [0, np.zeros(LANES, np.uint32)])
                    one[0] += 1 if added else -1
                    one[1] += state_of([part]) * np.uint32(1 if added else 0xFFFFFFFF)
            yield pd.DataFrame([(k, n, lanes.astype(np.int64)) for k, (n, lanes) in made.items()], columns=["doc_id", "by", "lanes"])

    wanted = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "paragraph", "added").dropna()
    made = wanted.mapInPandas(moves, "doc_id long, by long, lanes array<long>")
    sums = [F.sum(F.get("lanes", F.lit(i))).alias(f"l{i}") for i in range(LANES)]
    moved = made.groupBy("doc_id").agg(F.sum("by").alias("by"), *sums).select("doc_id", "by", F.array(*[f"l{i}" for i in range(LANES)]).alias("lanes"))
    old = states.select(F.col("doc_id").cast("long").alias("doc_id"), "n_paragraphs", "state", "fingerprint")
    both = old.join(moved, "doc_id", "full")
    before = F.coalesce("state", F.lit("0" * 8 * LANES))
    lane = lambda x, i: F.conv(F.substring(before, 8 * i + 1, F.lit(8)), 16, 10).cast("long") + x
    after = F.array_join(F.transform("lanes", lambda x, i: F.lower(F.lpad(F.hex(F.pmod(lane(x, i), F.lit(1 << 32))), 8, "0"))), "")
    both = both.withColumn("now", F.when(F.col("by").isNull(), before).otherwise(after))
    count = (F.coalesce("n_paragraphs", F.lit(0)) + F.coalesce("by", F.lit(0))).cast("long")
    return both.select("doc_id", count.alias("n_paragraphs"), F.col("now").alias("state"), F.sha2("now", 256).alias("fingerprint"))


def equal_documents(made: DataFrame) -> DataFrame:
    """Groups of ids with equal fingerprints: fingerprint, doc_ids, two ids at least."""
    groups = made.filter("doc_id IS NOT NULL AND n_paragraphs > 0").groupBy("fingerprint").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    return groups.filter(F.size("doc_ids") > 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH parts AS (
  SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS part
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), kept AS (SELECT doc_id, part FROM parts WHERE part <> ''),
blocks AS (
  SELECT doc_id, k, sha256(part || chr(31) || k::VARCHAR) AS h
  FROM kept, range({BLOCKS}) AS r(k)
), lanes AS (
  SELECT doc_id, k * 8 + j AS lane, sum(('0x' || substr(h, CAST(j * 8 + 1 AS INT), 8))::BIGINT) % 4294967296 AS v
  FROM blocks, range(8) AS s(j) GROUP BY doc_id, lane
), states AS (
  SELECT doc_id, string_agg(lpad(lower(to_hex(v::BIGINT)), 8, '0'), '' ORDER BY lane) AS state FROM lanes GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
found AS (
  SELECT d.doc_id, coalesce(c.n, 0) AS n_paragraphs, coalesce(s.state, repeat('0', {LANES * 8})) AS state
  FROM documents d LEFT JOIN states s USING (doc_id) LEFT JOIN counts c USING (doc_id)
)
SELECT doc_id, n_paragraphs, state, sha256(state) AS fingerprint FROM found
"""
