"""How often every distinct value or term occurs, and in how many rows.

Terms are combined within each input task, partitioned by hash bits, and each partition is
aggregated by DuckDB.  A partition of more rows or bytes than fit is spilled to the shared folder
by further hash bits, again and again, before it is aggregated, so memory stays bounded whatever
the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.runtime import new_path

_WORDS = re.compile(r"[^\W_]+")
_FLUSH_TERMS = 100_000
#: Hash bits that one level of spilling uses.
RADIX_BITS = 3
_SCHEMA = pa.schema([("h", pa.int64()), ("field_name", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_rows", pa.int64())])
_DDL = "h long, field_name string, term string, n_occurrences long, n_rows long"


def terms(text: str) -> list[str]:
    """The longest runs of letters and digits of the NFKC, lower-case text."""
    return _WORDS.findall(unicodedata.normalize("NFKC", text).lower())


def _hash(field: str, term: str) -> int:
    x = xxhash.xxh3_64_intdigest(f"{field}\0{term}")
    return x - (1 << 64) if x >> 63 else x


def _count(values: list[str], words: list[str]):
    """Rows to partial counts; each row adds at most one to a term's rows, so partial counts add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: Counter = Counter()
        rows: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(rows)
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*((_hash(*k), *k, occurrences[k], rows[k]) for k in keys)), _SCHEMA)], schema=_SCHEMA
            )
            occurrences.clear()
            rows.clear()
            return out

        for batch in batches:
            for i, field in enumerate([*values, *words]):
                for text, n in Counter(batch.column(i).to_pylist()).items():
                    if text is None:
                        continue
                    found = Counter([text] if text else []) if i < len(values) else Counter(terms(text))
                    for term, c in found.items():
                        occurrences[field, term] += c * n
                        rows[field, term] += n
            if len(rows) >= _FLUSH_TERMS:
                yield flush()
        if rows:
            yield flush()

    return run


def _radix(h: pa.Array, level: int) -> pa.Array:
    """The bits of the hash that level ``level`` of spilling splits by, from the top."""
    shift = 64 - RADIX_BITS * (level + 1)
    return pc.bit_wise_and(pc.shift_right(pc.cast(h, pa.int64()), pa.scalar(shift, pa.int64())), pa.scalar((1 << RADIX_BITS) - 1, pa.int64()))


class _Spill:
    """Rows written to a Parquet file for each value of the next hash bits."""

    def __init__(self, system: fs.FileSystem, folder: str, level: int):
        self.system, self.level, self.files = system, level, {}
        self.folder, self.rows, self.bytes = f"{folder}/{uuid.uuid4().hex}", Counter(), Counter()
        system.create_dir(self.folder, recursive=True)

    def add(self, table: pa.Table) -> None:
        radix = _radix(table.column("h").combine_chunks(), self.level)
        for bucket in pc.unique(radix).to_pylist():
            part = table.filter(pc.equal(radix, bucket))
            if bucket not in self.files:
                self.files[bucket] = pq.ParquetWriter(f"{self.folder}/{bucket}.parquet", _SCHEMA, compression="zstd", filesystem=self.system)
            self.files[bucket].write_table(part)
            self.rows[bucket] += part.num_rows
            self.bytes[bucket] += part.nbytes

    def close(self) -> Iterator[tuple[str, int, int]]:
        for writer in self.files.values():
            writer.close()
        for bucket in sorted(self.files):
            yield f"{self.folder}/{bucket}.parquet", self.rows[bucket], self.bytes[bucket]


_SUMS = "select any_value(h) as h, field_name, term, sum(n_occurrences)::bigint as n_occurrences, sum(n_rows)::bigint as n_rows from held group by field_name, term"


def _aggregate(folder: str, most_rows: int, most_bytes: int, memory_mb: int):
    """Sum the partial counts of one hash partition in DuckDB, spilling by radix what is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        own = f"{root}/{uuid.uuid4().hex}"
        engine = duckdb.connect(config={"memory_limit": f"{memory_mb}MB", "threads": "1"})

        def sums(held: pa.Table) -> Iterator[pa.RecordBatch]:
            engine.register("held", held)
            for batch in engine.sql(_SUMS).to_arrow_reader(20_000):
                yield pa.Table.from_batches([batch]).cast(_SCHEMA).combine_chunks().to_batches()[0]
            engine.unregister("held")

        def settle(path: str, rows: int, size: int, level: int) -> Iterator[pa.RecordBatch]:
            source = pq.ParquetFile(path, filesystem=system)
            if (rows <= most_rows and size <= most_bytes) or RADIX_BITS * (level + 1) > 60:
                yield from sums(source.read())
            else:
                spill = _Spill(system, own, level)
                for batch in source.iter_batches(10_000):
                    spill.add(pa.Table.from_batches([batch], schema=_SCHEMA))
                for part in spill.close():
                    yield from settle(*part, level + 1)
            system.delete_file(path)

        try:
            held: list[pa.RecordBatch] = []
            rows, size, spill = 0, 0, None
            for batch in batches:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if rows > most_rows or size > most_bytes:
                    spill = spill or _Spill(system, own, 0)
                    spill.add(pa.Table.from_batches(held, schema=_SCHEMA))
                    held, rows, size = [], 0, 0
            if spill is not None:
                if held:
                    spill.add(pa.Table.from_batches(held, schema=_SCHEMA))
                held = []
                for part in spill.close():
                    yield from settle(*part, 1)
            elif held:
                yield from sums(pa.Table.from_batches(held, schema=_SCHEMA))
            if spill is not None:
                system.delete_dir(own)
        finally:
            engine.close()

    return run


def term_counts(
    df: DataFrame,
    values: list[str],
    words: list[str],
    rare_below: int = 3,
    common_share: float = 0.1,
    partitions: int | None = None,
    most_rows: int = 200_000,
    most_bytes: int = 48 << 20,
    memory_mb: int = 256,
    spill_dir: str | None = None,
) -> DataFrame:
    """Occurrences and rows of every term: (field_name, term, n_occurrences, n_rows, mark).

    A term is the whole value of each column in ``values``, or each longest run of letters and
    digits in the NFKC, lower-case text of each column in ``words``.  mark is 'rare' below
    ``rare_below`` rows, 'common' above ``common_share`` of all rows of the table, else null; a
    term that is both (in tiny tables) is 'rare'.

    Null and empty values are no term, texts without letter or digit have none, repeated rows all
    count, control characters and blanks are part of a whole value; an empty table gives no row;
    other columns may have any name.  A hash partition of more than ``most_rows`` partial counts or
    ``most_bytes`` spills below ``spill_dir``, the shared folder unless given: a mounted path or an
    address that pyarrow reaches (file, hdfs, s3, gs).  A spilled file is deleted once it is summed.
    """
    spark = df.sparkSession
    folder = spill_dir or new_path(spark, "radix")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    fields = df.select(*[df[c].cast("string").alias(f"c{i}") for i, c in enumerate([*values, *words])])
    partial = fields.mapInArrow(_count(values, words), _DDL)
    counted = partial.repartition(partitions, "h").mapInArrow(_aggregate(folder, most_rows, most_bytes, memory_mb), _DDL)
    rows = F.col("n_rows")
    mark = F.when(rows < rare_below, "rare").when(rows > _floor_share(common_share, total), "common")
    return counted.select("field_name", "term", "n_occurrences", "n_rows", mark.alias("mark"))


def _floor_share(share: float, total: int) -> int:
    from fractions import Fraction

    return int(Fraction(str(share)) * total)
