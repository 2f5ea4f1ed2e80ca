"""Identities: content hashes, canonical JSON, deterministic ids, hash splits and their checks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_id(content: Column, prefix: str = "sha256:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(content, 256))


def canonical_json(value: object, ascii_only: bool = False) -> str:
    """JSON with sorted keys and without spaces; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def canonical_hash(payload: Column, fields: list[str] | None = None, without: tuple[str, ...] = (), ascii_only: bool = False) -> Column:
    """Hash of a JSON object column in canonical form: of ``fields`` only, or of all but ``without``.

    Spark's own JSON writer keeps field order and drops nulls, so this is an Arrow UDF; each different text of a batch is read once.
    """
    import hashlib

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        row = json.loads(text)
        row = {k: row[k] for k in fields} if fields is not None else {k: v for k, v in row.items() if k not in without}
        return hashlib.sha256(canonical_json(row, ascii_only).encode()).hexdigest()

    @F.arrow_udf(T.StringType())
    def digest(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode("encode")
        return pa.array([one(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return digest(payload)


#: Types that Spark's JSON writer writes as Python does.
PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _is_plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_is_plain(f.dataType) for f in kind.fields)
    return _is_plain(kind.elementType) if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType) else isinstance(kind, PLAIN)


def _in_order(kind: T.DataType) -> bool:
    return not isinstance(kind, T.StructType) or kind.names == sorted(kind.names) and all(_in_order(f.dataType) for f in kind.fields)


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """A struct with its fields in the order of their names, inner structs too; one that is so stays as it is, which keeps plans small."""
    if _in_order(kind):
        return value
    fields = sorted(kind.fields, key=lambda f: f.name)
    return F.when(value.isNotNull(), F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields]))


@F.arrow_udf(T.StringType())
def _written_hash(texts: pa.Array) -> pa.Array:
    """Hashes of JSON with sorted keys; control characters, which Spark and Python number in different letters, are written again."""
    import hashlib

    canonical = lambda t: canonical_json(json.loads(t)) if "\\u00" in t else t
    return pa.array([None if t is None else hashlib.sha256(canonical(t).encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def struct_hash(rows: DataFrame, value: Column, nulls: bool = True) -> Column:
    """``canonical_hash`` of a struct of ``rows`` written as JSON, with its null fields or without.

    Spark writes structs of texts, whole numbers and truth values with sorted fields, so Python has only to hash them; other values are written again by Python.
    """
    kind = rows.select(value.alias("v")).schema["v"].dataType
    options = {"ignoreNullFields": str(not nulls).lower()}
    return _written_hash(F.to_json(_sorted_fields(value, kind), options)) if _is_plain(kind) else canonical_hash(F.to_json(value, options))


def round_half_even(value: Column, places: int) -> Column:
    """Python's rounding of the binary value, which Spark's decimal rounding differs from."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else round(float(v), places)).astype("float64")

    return rounded(value)


def hash_bucket(key: Column, salt: str, version: str, buckets: int = 100) -> Column:
    """First eight bytes of sha256("version:salt:key") as a number, modulo ``buckets``."""
    digest = F.sha2(F.concat_ws(":", F.lit(version), F.lit(salt), key.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def hash_fraction(key: Column) -> Column:
    """First 32 bits of the key's sha256 as a fraction of their largest value."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value)) == 0, F.lit(True))


def is_timestamp_with_offset(value: Column) -> Column:
    """ISO 8601 with a time and an offset."""
    form = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(form & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def is_version(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d+\.\d+(\.\d+)?$"), F.lit(False))


def is_hex_id(value: Column, prefix: str = "sha256:") -> Column:
    return F.coalesce(value.rlike(f"^{prefix}[0-9a-f]{{64}}$"), F.lit(False))


def is_safe_relative_path(value: Column) -> Column:
    """A relative path with forward slashes and no empty, dot or parent part."""
    parts = F.split(F.regexp_replace(value, r"\\", "/"), "/")
    return F.coalesce(~value.startswith("/") & ~value.rlike("^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def image_extension(content: Column) -> Column:
    """File extension by the first bytes, or null."""
    return F.when(F.hex(F.substring(content, 1, 3)) == "FFD8FF", ".jpg").when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", ".png")


@F.arrow_udf(T.StringType())
def _points_json(rows: pa.Array) -> pa.Array:
    """JSON of lists of points, numbers rounded to six places and written as Python does; each different number of a batch once."""
    points = rows.flatten()
    numbers = pa.chunked_array([points.flatten()[points.type.get_field_index(c)] for c in "xy"])
    if numbers.null_count:
        raise TypeError("a corner without a coordinate")
    # by their bits, as -0.0 isn't 0.0
    different, at = np.unique(numbers.to_numpy().view(np.int64), return_inverse=True)
    texts = json.dumps([round(x, 6) for x in different.view(np.float64).tolist()], separators=(",", ":"))[1:-1].split(",")
    x, y = (pa.array(texts, pa.string()).take(pa.array(i)) for i in np.split(at, 2))
    texts = pc.binary_join_element_wise("[", pc.binary_join_element_wise(x, y, ","), "]", "")
    ends = np.cumsum(np.append(0, pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts, mask=rows.is_null())
    return pc.binary_join_element_wise("[", pc.binary_join(lists, ","), "]", "")


@F.arrow_udf(T.StringType())
def _text_json(texts: pa.Array) -> pa.Array:
    """JSON of texts or null; each different text of a batch once."""
    coded = texts.dictionary_encode("encode")
    return pa.array([json.dumps(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def corner_id(corners: Column, *parts: Column, digits: int = 20) -> Column:
    """The first hex digits of the sha256 of a JSON list of ``parts`` (texts or null) and corners rounded to six places, or of the corners alone.

    Numbers are written and rounded as Python does, which Spark's own functions differ from, so Arrow UDFs write the JSON. Null corners have no id.
    """
    text = _points_json(corners)
    if parts:
        text = F.concat(F.lit("["), *[x for p in parts for x in (_text_json(p), F.lit(","))], text, F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, digits)


def source_key(source: Column, candidate: Column) -> Column:
    """``source:id``; null without either."""
    return F.when((F.length(source) > 0) & (F.length(candidate) > 0), F.concat_ws(":", source, candidate))


def titled(name: str, version: str, algorithm: Column) -> Column:
    """A window's title; an algorithm's version that isn't one is called unknown."""
    return F.concat(F.lit(f"{name} {version} · Algorithm "), F.when(F.coalesce(is_version(algorithm), F.lit(False)), algorithm).otherwise("unknown"))
