"""Media columns of TIFF files: pages in, pages out.

Reading walks the chain of image directories in either byte order, decodes uncompressed, PackBits,
LZW and deflate data in strips or tiles, undoes the horizontal predictor and gives one row per page.
Files are independent, so the work is a map over rows; a task holds one file at a time.

Rows: a null file has no pages; a file that cannot be read gives one row with `error` set and no
samples; repeated rows and empty tables need nothing special; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded to whole rows of this many samples.
WIDTH = 576
#: Rows of a written page, and the sides of its tiles.
PAGE_ROWS, TILE = 64, (192, 16)

# Tags, compressions and type sizes of the file format.
TAG = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "strip_rows": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}

PAGES = "page integer, width integer, height integer, channels integer, bits integer, compression integer, samples binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as runs, the rest as literals."""
    x = np.frombuffer(data, np.uint8)
    cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    out, held = bytearray(), 0  # data[held:at] waits as a literal

    def literal(upto):
        for k in range(held, upto, 128):
            part = data[k : min(upto, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(np.diff(cut) >= 3):
        a, z = int(cut[k]), int(cut[k + 1])
        literal(a)
        for i in range(a, z, 128):
            n = min(128, z - i)
            out += bytes([(257 - n) & 255, data[i]]) if n > 1 else bytes([0, data[i]])
        held = z
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last, length = [], 9, 0, 0, None, 0
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            now = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(now)
        last = now
        length += len(now)
        if length >= size:
            break
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    held, bits, width, out = 0, 0, 9, bytearray()
    table: dict[bytes, int] = {}

    def put(code):
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    now, n = b"", 258
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if len(more) == 1 or more in table:
            now = more
            continue
        put(table[now] if len(now) > 1 else now[0])
        table[more] = n
        n += 1
        if n == 4094:
            put(256)
            table, n, width = {}, 258, 9
        elif n + 1 > 1 << width:
            width += 1
        now = data[i : i + 1]
    if now:
        put(table[now] if len(now) > 1 else now[0])
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _inflate(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} is not supported")


def read_pages(data: bytes):
    """Yields each page as a dict of the columns of PAGES but page and error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(form, data, place)
        get = lambda name, default=None: tags.get(TAG[name], default)
        width, height = get("width")[0], get("height")[0]
        channels, bits = get("samples", (1,))[0], get("bits", (1,))[0]
        compression, predictor = get("compression", (NONE,))[0], get("predictor", (1,))[0]
        if bits not in (8, 16) or get("planar", (1,))[0] != 1 or predictor not in (1, 2):
            raise ValueError("sample layout is not supported")
        kind = np.dtype(f"{order}u{bits // 8}")
        if get("tile_offsets"):
            w, h = get("tile_width")[0], get("tile_height")[0]
            offsets, sizes, across = get("tile_offsets"), get("tile_bytes"), -(-width // w)
        else:
            w, h = width, min(height, get("strip_rows", (height,))[0])
            offsets, sizes, across = get("strip_offsets"), get("strip_bytes"), 1
        image = np.zeros((height, width, channels), kind)
        for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = k // across * h, k % across * w
            rows = h if get("tile_offsets") else min(h, height - y)
            need = rows * w * channels * bits // 8
            raw = _inflate(data[o : o + s], compression, need)
            if len(raw) != need:
                raise ValueError("a strip or tile is too short")
            part = np.frombuffer(raw, kind).reshape(rows, w, channels)
            if predictor == 2:
                part = np.add.accumulate(part, axis=1, dtype=kind)
            image[y : y + rows, x : x + w] = part[: height - y, : width - x]
        yield {"width": width, "height": height, "channels": channels, "bits": bits, "compression": compression, "samples": image.tobytes()}
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def write_pages(pages: list[dict], order: str = "<") -> bytes:
    """A file of 8-bit pages; each is a dict of image (height, width, channels), compression, predictor and tile (width, height) or strip rows."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        image = page["image"]
        height, width, channels = image.shape
        if tile := page.get("tile"):
            w, h = tile
            grid = np.zeros((-(-height // h) * h, -(-width // w) * w, channels), np.uint8)
            grid[:height, :width] = image
            parts = [grid[y : y + h, x : x + w] for y in range(0, height, h) for x in range(0, width, w)]
        else:
            h = page.get("rows", height)
            parts = [image[y : y + h] for y in range(0, height, h)]
        offsets, sizes = [], []
        for part in parts:
            if page["predictor"] == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = np.ascontiguousarray(part).tobytes()
            raw = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[page["compression"]](raw)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        entries = {"width": (4, [width]), "height": (4, [height]), "bits": (3, [8] * channels), "compression": (3, [page["compression"]]), "photometric": (3, [1 if channels == 1 else 2]), "samples": (3, [channels]), "planar": (3, [1]), "predictor": (3, [page["predictor"]])}
        entries |= {"tile_width": (4, [w]), "tile_height": (4, [h]), "tile_offsets": (4, offsets), "tile_bytes": (4, sizes)} if tile else {"strip_offsets": (4, offsets), "strip_rows": (4, [h]), "strip_bytes": (4, sizes)}
        fields = []
        for tag, kind, values in sorted((TAG[k], *v) for k, v in entries.items()):
            body = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack(order + "I", len(out))
                out += body
                body = place
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def pack_payload(payload: bytes) -> bytes:
    """A payload of whole rows as gray pages: a single row by LZW, even pages by deflate with predictor, odd ones as PackBits tiles."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    pages = []
    for k, y in enumerate(range(0, len(image), PAGE_ROWS)):
        part = image[y : y + PAGE_ROWS]
        if len(image) == 1:
            pages.append({"image": part, "compression": LZW, "predictor": 1})
        elif k % 2:
            pages.append({"image": part, "compression": PACKBITS, "predictor": 1, "tile": TILE})
        else:
            pages.append({"image": part, "compression": DEFLATE, "predictor": 2, "rows": 32})
    return write_pages(pages)


def _feature(samples: np.ndarray, pages: int) -> str:
    """Pages, mean sample and the shares of 16 equal ranges of samples in 1/255."""
    shares = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{pages};{int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};{bytes(shares.astype(np.uint8)).hex()}"


def pages(files: DataFrame, column: str = "media") -> DataFrame:
    """One row per page: all columns of files but the media, and those of PAGES (which win where names clash)."""
    new = [c.split()[0] for c in PAGES.split(", ")]
    own = [c for c in files.columns if c != column and c not in new]
    types = (pa.int32(),) * 6 + (pa.binary(), pa.string())

    def rows(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(column)):
                if not data.is_valid:
                    continue
                found, error = [], None
                try:
                    found.extend(read_pages(data.as_py()))
                except (ValueError, struct.error, zlib.error, TypeError, IndexError) as e:
                    error = str(e) or type(e).__name__
                found = [p | {"page": k, "error": None} for k, p in enumerate(found)]
                if error:
                    found.append(dict.fromkeys(new) | {"page": len(found), "error": error})
                if found:
                    kept = [batch.column(c).take(pa.array([i] * len(found))) for c in own]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array([p[c] for p in found], t) for c, t in zip(new, types, strict=True))], names=[*own, *new])

    schema = files.select(*own).schema
    for field in PAGES.split(", "):
        schema = schema.add(*field.split())
    return files.select(*own, column).mapInArrow(rows, schema)


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded by 255 to whole rows, as a file of gray pages."""

    def rows(batches):
        for batch in batches:
            for ids, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                padded = data + b"\xff" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))
                yield pa.RecordBatch.from_arrays([pa.array([ids.as_py()], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([pack_payload(padded)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_batched(rows), "doc_id bigint, n_bytes bigint, media binary")


def _batched(rows, size: int = 1 << 23):
    """Joins the small record batches of rows into batches of some megabytes."""

    def joined(batches):
        held, total = [], 0
        for b in rows(batches):
            held.append(b)
            total += b.nbytes
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def store_and_read(docs: DataFrame) -> DataFrame:
    """The contract's digest of each text's stored media, from its pages read back."""
    files = write_media(docs)

    def rows(batches):
        for batch in batches:
            out = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
            for data in batch.column("media"):
                data = data.as_py()
                found = [p["samples"] for p in read_pages(data)]
                payload = b"".join(found)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(_feature(np.frombuffer(payload, np.uint8), len(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out.values())], names=["doc_id", "n_bytes", *out])

    return files.mapInArrow(rows, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
