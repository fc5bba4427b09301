"""Image files: which exist, and their pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelscope.functions.pixels import NoCodec, decode_image

from labelscope.functions.paths import decoded_path, local_path

_CONTENT_BYTES = 32 * 2**20  # content handed on at once


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file below ``root``; contents are not read.

    The driver lists the folder. For stores too large for that, make a ``manifest`` in tasks,
    or ask about the annotated files: ``existing_images``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(local_path(F.col("path")).alias("image_path"), "length")


def manifest(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Path and length of every file below ``root``, listed in tasks, folder by folder.

    Each round lists the folders found by the one before, each in one task, and writes what it
    finds below ``folder`` (one that all executors share): the driver learns whether there are
    more folders, no names. Hidden files and folders (``.`` or ``_`` in front) count like any
    other; a link is what it points at. The result is the table written.
    """
    frontier, level, parts = spark.createDataFrame([(root,)], "image_path string"), 0, []
    while True:
        found = frontier.repartition("image_path").mapInArrow(_listed, "image_path string, length bigint, folder boolean")
        parts.append(f"{folder.rstrip('/')}/level={level}")
        found.write.mode("overwrite").parquet(parts[-1])
        entries = spark.read.parquet(parts[-1])
        frontier, level = entries.where("folder").select("image_path"), level + 1
        if frontier.isEmpty():
            return spark.read.parquet(*parts).where("NOT folder").select("image_path", "length")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        for path in batch.column(0).to_pylist():
            key, inside = files.locate(path)
            system = files.systems[key]
            infos = system.get_file_info(fs.FileSelector(inside))
            # Names go back to the caller's spelling: the folder's, and the entry's own.
            names = [f"{path.rstrip('/')}/{i.base_name}" for i in infos]
            folders = [i.type == fs.FileType.Directory for i in infos]
            for first in range(0, len(infos), 10_000):
                part = slice(first, first + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[part], pa.string()), pa.array([i.size for i in infos[part]], pa.int64()), pa.array(folders[part], pa.bool_())],
                    ["image_path", "length", "folder"],
                )


class _Files:
    """Plain paths and URIs looked up in the file systems they belong to."""

    def __init__(self) -> None:
        self.systems: dict[str, fs.FileSystem] = {"": fs.LocalFileSystem()}

    def locate(self, path: str) -> tuple[str, str]:
        """File system key and the path inside it."""
        if path.startswith("file:/"):
            return "", "/" + path.removeprefix("file:").lstrip("/")
        scheme, mark, rest = path.partition("://")
        if not mark:
            return "", path
        host, slash, inside = rest.partition("/")
        key = f"{scheme}://{host}"
        if key not in self.systems:
            self.systems[key] = fs.FileSystem.from_uri(f"{key}/")[0]
        # Object stores name the bucket in the path, others the host in the connection.
        return key, (f"{host}/{inside}" if self.systems[key].type_name in ("s3", "gcs", "abfs") else slash + inside)

    def existing(self, paths: list[str]) -> list[bool]:
        """Which of the paths are files, asked for in one call per file system."""
        places = [self.locate(p) for p in paths]
        found = [False] * len(paths)
        for key in {k for k, _ in places}:
            mine = [i for i, (k, _) in enumerate(places) if k == key]
            infos = self.systems[key].get_file_info([places[i][1] for i in mine])
            for i, info in zip(mine, infos, strict=True):
                found[i] = info.type == fs.FileType.File
        return found

    def content(self, path: str) -> bytes | None:
        """What the file holds; None where there is none. Other failures are raised."""
        key, inside = self.locate(path)
        try:
            with self.systems[key].open_input_stream(inside, compression=None) as stream:
                return stream.read()
        except (FileNotFoundError, NotADirectoryError):
            return None
        except OSError:
            if self.systems[key].get_file_info(inside).type == fs.FileType.File:
                raise
            return None


def _only_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        yield batch.filter(pa.array(files.existing(batch.column(0).to_pylist()), type=pa.bool_()))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        rows, size = [], 0
        for path in batch.column(0).to_pylist():
            content = error = None
            try:
                content = files.content(path)
            except Exception as failure:  # throttled, forbidden, broken: not the same as missing
                error = f"read: {failure or type(failure).__name__}"
            if content is not None or error is not None:
                rows.append((path, content, error))
                size += len(content or b"")
            if size >= _CONTENT_BYTES:
                yield _content_batch(rows)
                rows, size = [], 0
        yield _content_batch(rows)


def _content_batch(rows: list[tuple[str, bytes | None, str | None]]) -> pa.RecordBatch:
    paths, contents, errors = zip(*rows, strict=True) if rows else ((), (), ())
    arrays = [pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["image_path", "image", "read_error"])


def existing_images(paths: DataFrame) -> DataFrame:
    """Those of the distinct ``image_path`` values that are files, asked for in tasks."""
    asked = paths.select("image_path").where(F.col("image_path").isNotNull()).distinct()
    return asked.mapInArrow(_only_files, "image_path string")


def fetch_images(paths: DataFrame) -> DataFrame:
    """Encoded content of each ``image_path``, read where the row is.

    Nothing is listed on the driver and no content is shuffled. A path without a file is
    left out; a file that could not be read has no image and says why in ``read_error``.
    Give ``paths`` without repeats.
    """
    asked = paths.select("image_path").where(F.col("image_path").isNotNull())
    return asked.mapInArrow(_contents, "image_path string, image binary, read_error string")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels of every readable image below ``root``.

    ``image`` is a struct of height, width, nChannels, mode and data with the bytes
    in blue-green-red order. Files that cannot be decoded are left out.
    """
    decoded = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "true")
        .load(root)
    )
    fields = [f"image.{f}" for f in ("height", "width", "nChannels", "mode", "data")]
    return decoded.select(decoded_path(F.col("image.origin")).alias("image_path"), F.struct(*fields).alias("image"))


def image_sizes(images: DataFrame) -> DataFrame:
    return images.select("image_path", "image.width", "image.height")


# --- images opened by the task that needs them ------------------------------------


class FileImages:
    """Images by path, opened where they are wanted.

    ``decode`` makes of a file's bytes what a predictor takes; None hands the bytes on. A path
    without a file gives None. A failed read is an OSError; a file that cannot be decoded
    raises what the decoder raises.
    """

    def __init__(self, decode: Callable[[bytes], Any] | None = decode_image) -> None:
        self.decode = decode

    def placed(self, keys: DataFrame, tasks: int | None = None) -> DataFrame:
        return keys.repartition(tasks) if tasks else keys

    def reader(self) -> Callable[[dict], Any]:
        """A function from a row with the path, in its first column, to the image."""
        files = _Files()

        def image(row: dict) -> Any:
            content = files.content(next(iter(row.values())))
            return content if content is None or self.decode is None else self.decode(content)

        return image


_ROWS_HELD = 64  # of a row group, decoded at once


class StoredImages:
    """Images kept in rows of Parquet files, read by the task that wants them.

    ``places`` has the key columns, the ``file`` and the row number ``at``. Only places are
    joined and shuffled: a task gets the wanted rows of whole files and reads each row group
    that has any once, a few rows at a time.
    """

    def __init__(self, places: DataFrame, column: str = "image") -> None:
        self.places, self.column = places, column

    def placed(self, keys: DataFrame, tasks: int | None = None) -> DataFrame:
        found = keys.join(self.places, [c for c in keys.columns if c in self.places.columns])
        dealt = found.repartition(tasks, "file") if tasks else found.repartition("file")
        return dealt.sortWithinPartitions("file", "at")

    def reader(self) -> Callable[[dict], Any]:
        column, files = self.column, _Files()
        held = {"path": None, "file": None, "group": -1, "next": 0, "batches": iter(()), "first": 0, "rows": ()}

        def image(row: dict) -> Any:
            at = row["at"]
            if row["file"] != held["path"]:
                system, inside = files.locate(row["file"])
                opened = pq.ParquetFile(files.systems[system].open_input_file(inside))
                held.update(path=row["file"], file=opened, group=-1, next=0, batches=iter(()), first=0, rows=())
            while at >= held["first"] + len(held["rows"]):
                if at < held["next"]:  # in the row group being read
                    held["first"] += len(held["rows"])
                    held["rows"] = next(held["batches"])[column]
                    continue
                held["group"] += 1
                held.update(first=held["next"], rows=())
                held["next"] += held["file"].metadata.row_group(held["group"]).num_rows
                if at < held["next"]:  # else nothing is wanted in this one
                    held["batches"] = held["file"].iter_batches(_ROWS_HELD, [held["group"]], [column])
            return held["rows"][at - held["first"]].as_py()

        return image

    def __getstate__(self) -> dict:
        return {"column": self.column, "places": None}  # tasks only read


# --- a planned scan -----------------------------------------------------------------


class _Rows(InputPartition):
    def __init__(self, file: str, group: int, first: int, count: int) -> None:
        self.file, self.group, self.first, self.count = file, group, first, count


class PlannedImages(DataSource):
    """The images named in a key table: a partition for each run of its rows.

    ``load(path)`` names a Parquet table with ``image_path``; ``rows`` is the number of images
    a partition has at most. The plan comes from the footers of that table, so no image folder is
    listed, and only wanted images are opened. Every key is a row: one whose file is missing has
    neither image nor error, one that cannot be read or decoded says why in ``read_error``.
    """

    decode: Callable[[bytes], Any] | None = None
    image_type = "binary"

    @classmethod
    def name(cls) -> str:
        return "planned_images"

    def schema(self) -> str:
        return f"image_path string, image {self.image_type}, read_error string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _PlannedReader(self.options, type(self).decode)


class _PlannedReader(DataSourceReader):
    def __init__(self, options: dict, decode: Callable[[bytes], Any] | None) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", "1000"))
        self.images = FileImages(decode)

    def partitions(self) -> list[_Rows]:
        files, parts = _Files(), []
        key, inside = files.locate(self.path)
        system = files.systems[key]
        root = "" if not key else key + ("" if inside.startswith("/") else "/")
        for info in sorted(system.get_file_info(fs.FileSelector(inside, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                meta = pq.ParquetFile(system.open_input_file(info.path)).metadata
                for group in range(meta.num_row_groups):
                    n = meta.row_group(group).num_rows
                    at = info.path if system.type_name not in ("s3", "gcs", "abfs") else info.path.partition("/")[2]
                    parts += [_Rows(f"{root}{at}", group, a, min(self.rows, n - a)) for a in range(0, n, self.rows)]
        return parts

    def read(self, part: _Rows) -> Iterator[tuple]:
        if part is None:  # a table without rows has no partitions
            return
        files = _Files()
        key, inside = files.locate(part.file)
        table = pq.ParquetFile(files.systems[key].open_input_file(inside)).read_row_group(part.group, columns=["image_path"])
        image = self.images.reader()
        for path in table["image_path"].slice(part.first, part.count).to_pylist():
            content = error = None
            try:
                content = None if path is None else image({"image_path": path})
            except NoCodec:
                raise
            except Exception as failure:  # one bad file must not end the scan
                error = f"{'read' if isinstance(failure, OSError) else 'decode'}: {failure or type(failure).__name__}"
            yield path, content if not isinstance(content, dict) else _as_row(content), error


def _as_row(image: dict) -> tuple:
    return tuple(image[name] for name in ("height", "width", "nChannels", "mode", "data"))


def planned_images(
    spark: SparkSession, keys: str, decode: Callable[[bytes], Any] | None = decode_image, rows: int = 1000
) -> DataFrame:
    """``image_path``, ``image`` and ``read_error`` of every row of the stored key table ``keys``.

    ``decode`` gives pixels as Spark's image source has them; None leaves the bytes as they are.
    """
    kind = "binary" if decode is None else "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
    source = type("PlannedImages", (PlannedImages,), {
        "decode": staticmethod(decode) if decode else None, "image_type": kind,
    })
    spark.dataSource.register(source)
    return spark.read.format("planned_images").option("rows", rows).load(keys)
