"""Path columns: resolving, comparing and naming."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.domain import BOX, DEFAULT_EXTENSION
from labelscope.functions.text import as_text, strip


def store_of(root: str) -> str:
    """Scheme and host of the store a root lies in; empty for plain and ``file:`` paths."""
    found = re.match("(?!file:)[A-Za-z][A-Za-z0-9+.-]*://[^/]*", root)
    return found.group() if found else ""


def join_path(root: str, name: Column) -> Column:
    """``root/name``; an absolute ``name`` lies in the store of the root, a URI stands alone."""
    prefix = root if not root or root.endswith("/") else root + "/"
    joined = F.when(F.startswith(name, F.lit("/")), F.concat(F.lit(store_of(root)), name))
    if store_of(root):
        joined = joined.when(F.rlike(name, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:/")), name)
    return joined.otherwise(F.concat(F.lit(prefix), name))


def resolve_path(path: Column, root: str) -> Column:
    return join_path(root, strip(as_text(path)))


def path_key(path: str) -> Column:
    """Path column without empty, ``.`` and ``..`` steps, so spellings of one file agree.

    ``file:`` in front counts for nothing; other schemes and hosts stay as they are.
    """
    local = f"regexp_replace({path}, '^file:/+', '/')"
    store = f"regexp_extract({local}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', 0)"
    inside = f"substring({local}, length({store}) + 1)"
    parts = f"""aggregate(split({inside}, '/'), cast(array() as array<string>), (done, part) -> CASE
        WHEN part IN ('', '.') THEN done
        WHEN part = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
        ELSE concat(done, array(part)) END)"""
    # Most paths have no such step, which four cheap tests tell.
    plain = f"""NOT (contains({path}, '//') OR contains({path}, '/.') OR startswith({path}, '.')
        OR startswith({path}, 'file:'))"""
    return F.expr(f"""CASE WHEN {plain} THEN {path}
        ELSE concat({store}, if(startswith({inside}, '/'), '/', ''), array_join({parts}, '/')) END""")


def with_image_key(df: DataFrame) -> DataFrame:
    """Add ``image_key``, the canonical path that joins on images use, if it is not there.

    Never null, so a join on it adds no null test of the whole expression.
    """
    if "image_key" in df.columns:
        return df
    return df.withColumn("image_key", F.coalesce(path_key("image_path"), F.lit("")))


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and host of the store it lies in; local folders stay plain."""
    if not root:
        return root
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "/", whole)


def local_path(uri: Column) -> Column:
    """``file:`` URI from a file listing as a plain path; other schemes stay."""
    return F.regexp_replace(uri, "^file:/+", "/")


def decoded_path(origin: Column) -> Column:
    """Percent-encoded origin of an image row as a plain path."""
    return local_path(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))))


def extension(path: str) -> Column:
    """Last dot of the file name and what follows; leading dots do not count."""
    name = f"ltrim('.', substring_index({path}, '/', -1))"
    return F.expr(f"""CASE WHEN contains({name}, '.') THEN concat('.', substring_index({name}, '.', -1))
        ELSE '{DEFAULT_EXTENSION}' END""")


def crop_name(path: str = "image_path", box: Sequence[str] = BOX) -> Column:
    """File name of a crop, from the resolved path and the unclamped box."""
    key = f"concat({path}, '_', " + ", '_', ".join(box) + ")"
    return F.concat(F.expr(f"concat('crop_', substring(md5({key}), 1, 12))"), extension(path))
