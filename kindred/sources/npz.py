"""NPZ archives as a data source (SC8-SC11, SK1, SK3): one row per index of its parallel arrays.

    load(spark, path, "track_ids long, neural array<float>")

Arrays are members `<column>.npy`; one-dimensional ones give numbers or text, others arrays (of arrays).
A column of the schema that the archive has not is null.  The rows are dealt into parts of
`rows_per_part`; a part reads its rows of each member, half floats become floats.
"""

from __future__ import annotations

import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or dtype.hasobject:
        raise ValueError("only plain arrays in row order can be read")
    return shape, dtype


def _rows(archive: zipfile.ZipFile, name: str, a: int, z: int) -> np.ndarray:
    """Rows a..z of a member, the others are passed over."""
    with archive.open(f"{name}.npy") as f:
        shape, dtype = _header(f)
        width = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        skip = a * width
        while skip:
            skip -= len(f.read(min(skip, 1 << 20))) or skip
        raw = f.read((z - a) * width)
    return np.frombuffer(raw, dtype).reshape(z - a, *shape[1:])


def _opened(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    disk, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return zipfile.ZipFile(disk.open_input_file(at))


class _Part(InputPartition):
    def __init__(self, path: str, a: int, z: int) -> None:
        self.path, self.a, self.z = path, a, z


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], step: int) -> None:
        self.schema, self.paths, self.step = schema, paths, step

    def partitions(self):
        parts = []
        for path in self.paths:
            with _opened(path) as archive:
                members = {n.removesuffix(".npy") for n in archive.namelist()}
                sizes = set()
                for name in (f.name for f in self.schema if f.name in members):
                    with archive.open(f"{name}.npy") as f:
                        sizes.add(_header(f)[0][0])
            if len(sizes) > 1:
                raise ValueError(f"{path}: arrays of unequal length: {sorted(sizes)}")
            n = sizes.pop() if sizes else 0
            parts += [_Part(path, a, min(a + self.step, n)) for a in range(0, n, self.step)]
        return parts or [_Part("", 0, 0)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.a == partition.z:
            return
        target = to_arrow_schema(self.schema)
        with _opened(partition.path) as archive:
            members = {n.removesuffix(".npy") for n in archive.namelist()}
            columns = []
            for f in target:
                if f.name not in members:
                    columns.append(pa.nulls(partition.z - partition.a, f.type))
                    continue
                x = _rows(archive, f.name, partition.a, partition.z)
                x = x.astype(np.float32) if x.dtype == np.float16 else x
                columns.append(pa.array(x.tolist(), f.type) if x.ndim > 1 or x.dtype.kind in "US" else pa.array(x).cast(f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=target)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("tell the columns to read: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"].split("\n"), int(self.options.get("rows_per_part", 65_536)))


def write(rows, folder: str) -> None:
    """SK1, SK3: a folder of NPZ archives, one per task, with a member for each column (numbers, text, arrays of one length).

    Archives get a new name in every attempt and count only where the manifest beside them names them.
    """
    names = rows.columns

    def run(batches):
        import uuid

        from pyarrow import fs

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        name = f"{uuid.uuid4().hex}.npz"
        disk, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        disk.create_dir(at, recursive=True)
        with disk.open_output_stream(f"{at}/{name}", compression=None) as out:
            # plain members, so that readers can pass over rows; written through a buffer, since streams cannot seek
            import io

            buffer = io.BytesIO()
            np.savez(buffer, **{c: _array(t.column(c).combine_chunks()) for c in names})
            out.write(buffer.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t.num_rows])], ["name", "n"])

    rows.mapInArrow(run, "name string, n long").write.parquet(f"{folder}/manifest")


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def load(spark, path: str, schema: str):
    """Rows of one archive, or of a folder that `write` made."""
    spark.dataSource.register(NpzSource)
    if path.endswith(".npz"):
        return spark.read.format("npz").schema(schema).option("path", path).load()
    names = [r.name for r in spark.read.parquet(f"{path}/manifest").select("name").toLocalIterator()]  # a row per archive
    return spark.read.format("npz").schema(schema).option("path", "\n".join(f"{path}/{n}" for n in names)).load()
