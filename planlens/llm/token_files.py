"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A corpus is a folder. Part k has ``<name>.ids`` (uint16, or uint32 where the vocabulary needs it, little-endian, one
document after the other), ``<name>.off`` (n + 1 int64 offsets, counted from the part's first id) and ``<name>.doc``
(n int64 document ids, then n bytes that are 1 where the id is null). ``manifest`` (Parquet) lists the parts in order
with their bases, which are prefix sums of the parts' numbers of ids.

A task writes under a name of its own and its row in the manifest is what makes the files count, so tasks may run
twice. Files are memory-mapped where the folder is on a mounted file system, else read by ranges.

Defined results: null and empty texts are the end id alone; null ids come first; rows with equal ids stand in the order
of their texts' hashes and each has its own place; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planlens.llm.common import opener, ship, shipped, shared_dir, text_of, written
from planlens.llm.encoding import encoder, spaced_words

MANIFEST = "part int, name string, n_docs long, n_tokens long"
#: Ids of a part that one task reads.
READ_IDS = 4_000_000
#: Stored bytes of input that make one part, and the most parts.
PART_BYTES, MOST_PARTS = 1 << 27, 200_000


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _parts(docs: DataFrame) -> int:
    """Parts of about PART_BYTES of stored input, as many as shuffles have partitions at least."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int, cut=spaced_words, vocabulary: int = 50_257,
                      id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the corpus below out, in ascending order of ids; returns the manifest with bases."""
    spark = docs.sparkSession
    ship(spark, path)
    parts = parts or _parts(docs)
    dtype = _dtype(vocabulary)

    def write(batches):
        name, encode, (fs, root) = f"part-{uuid.uuid4().hex}", encoder(shipped(path), cut), opener(out)
        fs.create_dir(root, recursive=True)
        offsets, ids, nulls, n = array("q", [0]), array("q"), bytearray(), 0
        with fs.open_output_stream(f"{root}/{name}.ids") as f:
            for b in batches:
                for a in range(0, len(b), 4096):
                    some = b.iloc[a : a + 4096]
                    for t in encode(list(some["text"])):
                        f.write(np.append(t, end_id).astype(dtype).tobytes())
                        n += len(t) + 1
                        offsets.append(n)
                ids.frombytes(b["id"].fillna(0).to_numpy(np.int64).tobytes())
                nulls += b["none"].to_numpy(np.uint8).tobytes()
        if not ids:
            fs.delete_file(f"{root}/{name}.ids")
            return
        with fs.open_output_stream(f"{root}/{name}.off") as f:
            f.write(np.asarray(offsets, "<i8").tobytes())
        with fs.open_output_stream(f"{root}/{name}.doc") as f:
            f.write(np.asarray(ids, "<i8").tobytes())
            f.write(bytes(nulls))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "name": [name], "n_docs": [len(ids)], "n_tokens": [n]})

    text = text_of(text_col)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).isNull().alias("none"), text.alias("text"), F.xxhash64(text).alias("tie"))
    d = d.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie")
    rows = sorted(written(d.mapInPandas(write, MANIFEST)).collect())  # one row for each part
    base, out_rows = 0, []
    for r in rows:
        out_rows.append((*r, base))
        base += r.n_tokens
    manifest = spark.createDataFrame(out_rows, T._parse_datatype_string(MANIFEST + ", base long"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return manifest


def _array(fs, path: str, dtype: str, first: int, n: int) -> np.ndarray:
    """n items of a flat file from the first on; mapped into memory on mounted file systems."""
    if n == 0:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r", offset=first * np.dtype(dtype).itemsize, shape=(n,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * np.dtype(dtype).itemsize, first * np.dtype(dtype).itemsize), dtype)


def map_token_files(spark: SparkSession, out: str, each, schema: str, vocabulary: int = 50_257) -> DataFrame:
    """each(id or None, start in the corpus, ids) for every document of the folder gives the rows' values, in schema's order."""
    ship(spark)
    manifest = spark.read.parquet(f"{out}/manifest")
    dtype, names = _dtype(vocabulary), [f.name for f in T._parse_datatype_string(schema)]
    step = F.greatest(F.lit(1), F.floor(F.lit(READ_IDS) * F.col("n_docs") / F.greatest(F.col("n_tokens"), F.lit(1))).cast("long"))
    ranges = manifest.select("*", step.alias("step")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.col("step"))).alias("first"))
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches):
        fs, root = opener(out)
        for b in batches:
            for r in b.itertuples():
                k = min(r.step, r.n_docs - r.first)
                off = _array(fs, f"{root}/{r.name}.off", "<i8", r.first, k + 1)
                ids = _array(fs, f"{root}/{r.name}.doc", "<i8", r.first, k)
                none = np.array(_array(fs, f"{root}/{r.name}.doc", "u1", 8 * r.n_docs + r.first, k))
                tokens = _array(fs, f"{root}/{r.name}.ids", dtype, int(off[0]), int(off[-1] - off[0]))
                rows = [each(None if none[i] else int(ids[i]), r.base + int(off[i]), tokens[off[i] - off[0] : off[i + 1] - off[0]]) for i in range(k)]
                yield pd.DataFrame({c: pd.Series([x[j] for x in rows], dtype="Int64" if j == 0 else None) for j, c in enumerate(names)})

    return ranges.mapInPandas(read, schema)


def _digest(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def op6(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the corpus to the shared folder and reads it back."""
    out = shared_dir(docs.sparkSession)
    write_token_files(docs, out, path, end_id)
    return map_token_files(docs.sparkSession, out, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
