"""Media columns: documents stored as progressive JPEG, and read back into payloads and RGB tensors.

Media and tensors are tables in the shared folder. A text's tensor has about twice its bytes, so round_trip(), which wants
digests only, stores, reads and deletes them one slice of the documents after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import release, small_batches, staged

#: Bytes of a row batch that a worker hands on.
BATCH = 2_000_000
#: Rows of a batch that Spark hands to a worker.
ROWS = 256
#: Bytes of text in a slice, and the most slices.
SLICE = 32 << 20
SLICES = 6
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, feature string"


def _batched(rows, schema: pa.Schema):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH or len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def store(docs: DataFrame, unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zero bytes to a positive multiple of ``unit``, in a progressive JPEG.

    A null text is empty; an empty text is one unit of zeros. Repeated rows each get a row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    yield ident, len(raw), jpeg.encode(raw + b"\0" * ((-len(raw)) % unit if raw else unit))

        yield from _batched(rows(), schema)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def read(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Decodes the media column: payload, size, a feature of the tensor, or with ``tensors`` the RGB tensor itself (height x width x 3 bytes) in its place.

    Null media can't be decoded and are an error; an empty table gives an empty result.
    """
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("feature", pa.string())]
    schema = pa.schema(kinds + [("rgb", pa.binary())] * tensors)

    def run(batches):
        def rows():
            for batch in batches:
                for ident, n, media in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    image = jpeg.Image(media)
                    rgb = image.rgb()
                    row = (ident, n, media, jpeg.payload_of(image), image.height, image.width)
                    yield (*row, None, rgb.tobytes()) if tensors else (*row, feature(rgb))

        yield from _batched(rows(), schema)

    return small_batches(stored).select("doc_id", "n_bytes", "media").mapInArrow(run, READ + ", rgb binary" * tensors)


def feature(rgb) -> str:
    """Size and mean of each channel in hundredths."""
    high, wide, _ = rgb.shape
    total = [rgb[..., k].sum(dtype=np.int64) for k in range(3)]
    return f"{wide}x{high}:" + ":".join(str(int(t) * 100 // (high * wide)) for t in total)


def features(tensors: DataFrame) -> DataFrame:
    """The rows of stored tensors (rgb, height, width, other columns) with the feature of each in place of these three."""
    rest = [f for f in tensors.schema if f.name not in ("rgb", "height", "width", "feature")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)

    def run(batches):
        for batch in batches:
            shapes = zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            said = [feature(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(high, wide, 3)) for rgb, high, wide in shapes]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(said, pa.string())], names=[*batch.schema.names[3:], "feature"])

    return small_batches(tensors).select("rgb", "height", "width", *[f.name for f in rest]).mapInArrow(run, f"{kinds}, feature string")


def round_trip(docs: DataFrame, slice_bytes: int = SLICE, slices: int = SLICES) -> DataFrame:
    """digests() of every row of docs, of media that were stored and read back, with features of tensors that were stored and read back.

    Documents are dealt into slices by a hash of doc_id and text, as many as their bytes call for but at most ``slices``.
    Odd rows as in store(); other columns aren't read, whatever their names.
    """
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = int(min(slices, total // slice_bytes + 1))
    out = None
    for k in range(count):
        media = staged(store(docs.where(F.pmod(F.xxhash64("doc_id", text), F.lit(count)) == k)), "media")
        tensors = staged(digests(read(media, tensors=True), "height", "width", "rgb"), "tensors")
        part = staged(features(tensors), "features")
        release(media, tensors)
        out = part if out is None else out.unionByName(part)
    return out


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Digests of what read() gave, and more of its columns."""
    size = F.octet_length("payload")
    return decoded.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", *more,
    )
