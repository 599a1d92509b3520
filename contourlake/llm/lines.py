"""Line dedup: lines that many documents share stay only in the document with the smallest id.

Lines become 128-bit key hashes before the shuffle; counts of documents are
two-sided minima that combine on the map side, so a line that a third of all
documents hold costs one row a task. The lines of such a key are then dealt over
several tasks, each with the key's document. Texts are shuffled once, to meet
the keys that they lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, table, written


def line_key(line: bytes) -> bytes:
    """The line without the ASCII white space at its ends (U+0020, U+0009 to U+000D), A-Z as a-z."""
    return line.strip().lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _bytes(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with its text column rewritten, and `n_lines`, `n_dropped` added.

    A text is split at newlines; null or empty text is one empty line. A line
    whose key has `min_chars` code points or more and stands in `min_docs`
    documents or more is dropped from all of them but the one with the smallest
    id. Rows with one id are one document. A row without an id takes no part:
    its lines are neither counted nor dropped. Other columns pass through
    unchanged, whatever their names, unless the two added columns replace them;
    an empty table gives an empty table.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for k in map(line_key, _bytes(text.as_py()).split(b"\n")) if _long_enough(k, min_chars)}
                ids.extend([doc] * len(own))
                found.extend(map(_hash, own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.binary())], names=["doc", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(keys, f"doc {kind}, h binary")
    if min_docs == 2:
        counted = keyed.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        keyed = keyed.distinct()
        counted = keyed.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = written(counted.select("h", "first", "n"))
    drops = met(keyed, shared, ["h"], ["doc"]).where("doc != first").groupBy("doc").agg(F.collect_set("h").alias("drops"))
    through = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.struct(*[F.col(f"`{c}`") for c in through]).alias("row"))
    joined = rows.join(drops, "doc", "left").select("row.*", F.col("drops").alias("__drops"))
    at = through.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                lines = _bytes(text.as_py()).split(b"\n")
                kept = lines
                if drop.is_valid:
                    gone = set(drop.as_py())
                    kept = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in gone)]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*through, "n_lines", "n_dropped"])

    schema = docs.select(*[F.col(f"`{c}`") for c in through]).schema
    return joined.mapInArrow(rewrite, schema.add("n_lines", "long").add("n_dropped", "long"))


def op5_line_dedup(spark, sf_dir):
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
