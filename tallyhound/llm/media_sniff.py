"""Media columns: signature sniffing, validation, carving.

A multi-pattern automaton finds every magic number in a stored value in one pass; a validator for each format checks the
structure and gives the length, so that chance hits fall away and what is embedded can be carved out; the type found
replaces a wrong declared one. store() packs bytes losslessly as 8-bit samples of a WAV, BMP or PNG behind a header with
a declared type, as such columns hold them; recover() gets them back from the stored bytes alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import documents, named, text_or_empty

#: Payloads are padded with PAD to a multiple of UNIT bytes; pictures are SIDE samples wide.
UNIT, PAD, SIDE = 576, b"\xff", 24
#: The magic numbers of the formats known here.
MAGIC = {b"RIFF": "audio/wav", b"BM": "image/bmp", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b".snd": "audio/basic"}
STORED = ("audio/wav", "image/bmp", "image/png")


def wav_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    place, end = at + 12, at + size
    if end > len(b):
        return None
    while place + 8 <= end:
        name, n = b[place : place + 4], struct.unpack_from("<I", b, place + 4)[0]
        place += 8 + n + (n & 1)
        if name == b"data":
            return size if place <= end else None
    return None


def bmp_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, first, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if header < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or at + size > len(b):
        return None
    return size if first + (width * bits + 31) // 32 * 4 * abs(height) == size else None


def png_length(b: bytes, at: int) -> int | None:
    place = at + 8
    while place + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, place)
        if place + 12 + n > len(b) or zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return None
        place += 12 + n
        if name == b"IEND":
            return place - at
    return None


def gif_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    place = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while place < len(b):
        kind = b[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place += 2
        elif kind == 0x2C and place + 11 <= len(b):
            place += 11 + (3 << ((b[place + 9] & 7) + 1) if b[place + 9] & 0x80 else 0)
        else:
            return None
        while place < len(b) and b[place]:
            place += b[place] + 1
        place += 1
    return None


def au_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 24:
        return None
    first, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return first + size if first >= 24 and 1 <= coding <= 27 and rate and 0 < channels <= 8 and at + first + size <= len(b) else None


VALID: dict[str, Callable[[bytes, int], int | None]] = {"audio/wav": wav_length, "image/bmp": bmp_length, "image/png": png_length, "image/gif": gif_length, "audio/basic": au_length}


@lru_cache(maxsize=1)
def automaton():  # noqa: ANN201
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


def sniff(blob: bytes) -> tuple[list[tuple[int, int, str]], int]:
    """(start, length, type) of each embedded medium, outermost and leftmost first, without overlaps; and all magic hits."""
    found, hits, free = [], 0, 0
    for end, (size, kind) in sorted((end - n + 1, (n, kind)) for end, (n, kind) in automaton().iter(blob.decode("latin-1"))):
        hits += 1
        if end >= free and (n := VALID[kind](blob, end)):
            found.append((end, n, kind))
            free = end + n
    return found, hits


def wav(samples: bytes) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(samples: bytes) -> bytes:
    rows = len(samples) // SIDE
    grey = b"".join(bytes((v, v, v, 0)) for v in range(256))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + len(samples), 0, 54 + 1024, 40, SIDE, -rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey + samples


def png(samples: bytes) -> bytes:
    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, SIDE)
    lines = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1).tobytes()  # each line begins with its filter, none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 1)) + part(b"IEND", b"")


def samples_of(kind: str, media: bytes) -> bytes:
    if kind == "audio/wav":
        return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    place, data = 8, []
    while place < len(media):
        n, name = struct.unpack_from(">I4s", media, place)
        if name == b"IDAT":
            data.append(media[place + 8 : place + 8 + n])
        place += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, SIDE + 1)[:, 1:].tobytes()


def padded(raw: bytes) -> bytes:
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(payload: bytes) -> tuple[str, bytes]:
    """(declared type, stored bytes) of a payload. Its checksum alone decides the format and the type declared."""
    seed = zlib.crc32(payload)
    kind, declared = STORED[seed % 3], STORED[seed // 3 % 3]
    return declared, b"Content-Type: " + declared.encode() + b"\r\n\r\n" + {"audio/wav": wav, "image/bmp": bmp, "image/png": png}[kind](payload)


def recover(declared: str, blob: bytes) -> tuple[bytes, str]:
    """The payload of a stored value, and what sniffing said of it; nothing where it holds no medium."""
    found, hits = sniff(blob)
    if not found:
        return b"", f"none;declared {declared};hits {hits};media 0"
    at, size, kind = found[0]
    said = f"{kind};{'as declared' if kind == declared else 'declared ' + declared};at {at};length {size};hits {hits};media {len(found)}"
    return samples_of(kind, blob[at : at + size]), said


def sniffed(df: DataFrame, *, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """df with `media`, the embedded media of a binary column, outermost and leftmost first: start, length, type, corrected, bytes.

    A medium counts only if its format's own structure and length hold, so cut ones do not; corrected says that declared_col
    names another type (null where there is none). Null and empty blobs, and blobs without a medium, have an empty list.
    Blobs are read whole; repeated rows have equal lists; df must have no column media, any other name will do; an empty
    df gives an empty result.
    """
    if "media" in df.columns:
        raise ValueError("df has a column media")
    kind = "array<struct<start:int,length:int,type:string,corrected:boolean,bytes:binary>>"

    @F.pandas_udf(kind)
    def carved(blobs: pd.Series, declared: pd.Series) -> pd.Series:
        out = []
        for blob, said in zip(blobs, declared):
            found = sniff(bytes(blob))[0] if blob is not None else []
            out.append([{"start": at, "length": n, "type": t, "corrected": None if said is None else said != t, "bytes": bytes(blob)[at : at + n]} for at, n, t in found])
        return pd.Series(out, dtype=object)

    said = F.lit(None).cast("string") if declared_col is None else named(declared_col)
    return df.withColumn("media", carved(named(blob_col), said))


def media_column(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blobs: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    and, if asked for, the declared type and the stored bytes.

    Null text counts as empty: one unit of padding. Texts are stored whole; equal texts have equal values; extra columns
    of df are ignored; an empty df gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "media"]
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", declared string, media binary" * blobs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                raw = text.encode("utf-8", "surrogatepass")
                declared, blob = store(padded(raw))
                back, said = recover(declared, blob)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), said, declared if blobs else None, blob if blobs else None))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out if blobs else out.drop(columns=["declared", "media"])

    return df.select(id_col, text_or_empty(text_col).alias("_text")).mapInPandas(run, schema)


def op8_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(documents(spark, sf_dir))
