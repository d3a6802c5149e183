"""Raw-file sources as Arrow kernels over ``binaryFile`` rows (``path, content``).

Every kernel is a map over files: one row in, its members or records out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import tarfile
import wave
import zipfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _members(df: DataFrame, reader: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, raw in reader(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([raw], pa.binary())], ["path", "name", "raw"])

    return df.select("path", "content").mapInArrow(run, "path string, name string, raw binary")


def safe_name(name: str) -> str:
    """A member's name without empty and ``.`` parts; absolute names and ``..`` are errors."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if name.startswith("/") or ".." in parts or not parts:
        raise ValueError(f"unsafe member name: {name!r}")
    return "/".join(parts)


def zip_members(df: DataFrame, suffix: str = "") -> DataFrame:
    def read(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir() and i.filename.endswith(suffix):
                    yield safe_name(i.filename), z.read(i)

    return _members(df, read)


def tar_members(df: DataFrame, suffix: str = "") -> DataFrame:
    """Regular members of a tar file, compressed or not, in one pass; a repeated name is an error."""

    def read(content: bytes):
        seen = set()
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    name = safe_name(m.name)
                    if name in seen:
                        raise ValueError(f"repeated member {name}")
                    seen.add(name)
                    yield name, t.extractfile(m).read()

    return _members(df, read)


def verified_prefix(members: DataFrame, size: int, sha256: str | None, prefix: int, md5: str | None = None, sha1: str | None = None) -> DataFrame:
    """The first ``prefix`` bytes of members whose whole size and digests are as pinned."""
    if not (sha256 or md5 or sha1):
        raise ValueError("at least one digest is pinned")
    ok = (F.octet_length("raw") == size) & (F.lit(prefix) <= size)
    for found, pinned in ((F.sha2("raw", 256), sha256), (F.md5("raw"), md5), (F.sha1("raw"), sha1)):
        ok = ok & (found == pinned.lower()) if pinned else ok
    checked = F.when(ok, F.substring("raw", 1, prefix)).otherwise(F.raise_error(F.concat(F.lit("not as pinned: "), F.col("name"))).cast("binary"))
    return members.withColumn("raw", checked)


def jsonl_documents(df: DataFrame) -> DataFrame:
    """``text`` of JSON lines in plain, gzip or zstd files, as UTF-8 with replacement."""

    def read(content: bytes):
        if content[:2] == b"\x1f\x8b":
            content = gzip.decompress(content)
        elif content[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            content = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)).read()
        for i, line in enumerate(content.decode("utf-8", "replace").splitlines()):
            if line.strip():
                yield f"{i:09d}", json.loads(line)["text"].encode("utf-8", "replace")

    return _members(df, read)


def pcm16_wav(raw: bytes, rate: int | None = None) -> np.ndarray:
    """Samples of a mono 16-bit WAV file; anything else is an error."""
    with wave.open(io.BytesIO(raw)) as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 2 or w.getcomptype() != "NONE" or (rate and w.getframerate() != rate):
            raise ValueError("not mono 16-bit PCM at the rate asked for")
        frames = w.readframes(w.getnframes())
        if len(frames) != 2 * w.getnframes():
            raise ValueError("truncated")
    return np.frombuffer(frames, "<i2")


def riff_chunks(raw: bytes):
    """(tag, body) of each chunk of a RIFF file; one that says it is longer than the file is an error."""
    view, at = memoryview(raw), 12
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    while len(raw) - at >= 8:
        tag, size = struct.unpack_from("<4sI", raw, at)
        if at + 8 + size > len(raw):
            raise ValueError(f"truncated in the chunk {tag!r}")
        yield tag, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def float32_wav(raw: bytes, rate: int | None = None) -> np.ndarray:
    """Samples of a mono 32-bit float WAV file; anything else is an error."""
    parts = dict(riff_chunks(raw))
    if not {b"fmt ", b"data"} <= parts.keys() or len(parts[b"fmt "]) < 16:
        raise ValueError("no format or no data")
    code, channels, hertz, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if (code, channels, bits) != (3, 1, 32) or rate not in (None, hertz) or len(parts[b"data"]) % 4:
        raise ValueError("not whole mono 32-bit float samples at the rate asked for")
    x = np.frombuffer(parts[b"data"], "<f4")
    if not np.isfinite(x).all():
        raise ValueError("samples that aren't finite")
    return x


def cifar_records(df: DataFrame, pixels: int = 3072) -> DataFrame:
    """Label and planar pixels of fixed-width image records; a file of another size is an error."""
    odd = F.raise_error(F.concat(F.lit("no whole records: "), F.col("path")))
    n = F.when(F.octet_length("content") % (pixels + 1) == 0, F.expr(f"octet_length(content) div {pixels + 1}")).otherwise(odd.cast("int"))
    rows = df.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("record"))
    return rows.select("path", "record", F.expr(f"cast(conv(hex(substring(content, record * {pixels + 1} + 1, 1)), 16, 10) as int)").alias("label"), F.expr(f"substring(content, record * {pixels + 1} + 2, {pixels})").alias("pixels"))


def midi_notes(raw: bytes, track: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(pitch, start, end, order) of a track's notes in ticks, on- and off-events paired first
    in, first out; and how many off-events had no note."""
    if raw[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    at, k = 8 + struct.unpack(">I", raw[4:8])[0], 0
    while at + 8 <= len(raw):
        tag, size = raw[at : at + 4], struct.unpack(">I", raw[at + 4 : at + 8])[0]
        if tag == b"MTrk":
            if k == track:
                return _track_notes(raw[at + 8 : at + 8 + size])
            k += 1
        at += 8 + size
    raise ValueError(f"no track {track}")


def _track_notes(data: bytes) -> tuple[list[tuple[int, int, int, int]], int]:
    at = now = status = order = spare = 0
    on: dict[tuple[int, int], deque] = defaultdict(deque)
    notes = []

    def number() -> int:
        nonlocal at
        n = 0
        while True:
            b = data[at]
            at += 1
            n = n << 7 | b & 0x7F
            if b < 0x80:
                return n

    while at < len(data):
        now += number()
        if data[at] >= 0x80:
            status = data[at]
            at += 1
        if status in (0xFF, 0xF0, 0xF7):
            at += status == 0xFF
            size = number()
            at += size
            continue
        high = status & 0xF0
        first = data[at]
        second = data[at + 1] if high not in (0xC0, 0xD0) else 0
        at += 1 if high in (0xC0, 0xD0) else 2
        key = (status & 0x0F, first)
        if high == 0x90 and second:
            on[key].append((now, order))
            order += 1
        elif high == 0x80 or high == 0x90:
            if on[key]:
                start, number_of = on[key].popleft()
                notes.append((first, start, now, number_of))
            else:
                spare += 1
    if any(on.values()):
        raise ValueError("a note never ends")
    return sorted(notes, key=lambda n: n[3]), spare


def ticks_per_quarter(raw: bytes) -> int:
    """What a MIDI file's header says; divisions by time codes are an error."""
    if raw[:4] != b"MThd" or len(raw) < 14:
        raise ValueError("not a MIDI file")
    division = struct.unpack_from(">H", raw, 12)[0]
    if not 0 < division < 0x8000:
        raise ValueError(f"ticks of {division:#x} aren't parts of a quarter")
    return division


def midi_table(df: DataFrame, track: int) -> DataFrame:
    """The notes of a track of each file ``path, content``: ``path, quarter, nid, pitch, start,
    stop`` in ticks, ``quarter`` of them to a quarter note, and ``spare`` off-events without a
    note. A track without a note is an error."""
    schema = "path string, quarter int, nid int, pitch int, start long, stop long, spare int"

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                quarter = ticks_per_quarter(content)
                notes, spare = midi_notes(content, track)
                if not notes:
                    raise ValueError(f"{path}: no note in track {track}")
                pitch, start, stop, order = map(list, zip(*notes))
                n = len(notes)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                columns = [[path] * n, [quarter] * n, order, pitch, start, stop, [spare] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "quarter", "nid", "pitch", "start", "stop", "spare"])

    return df.select("path", "content").mapInArrow(run, schema)


def table_fingerprint(clips: DataFrame) -> str:
    """:func:`content_fingerprint` of a table ``name, frames``: the digest runs over all clips in
    order, so they pass the driver one partition at a time and none is kept."""
    h = hashlib.sha256()
    for r in clips.select("name", "frames").orderBy(F.col("name").cast("binary")).toLocalIterator():
        h.update(r.name.encode() + b"\0" + bytes(r.frames))
    return h.hexdigest()


def content_fingerprint(clips: list[tuple[str, bytes]]) -> str:
    """SHA-256 over ``name NUL frames`` of all clips in order of their names."""
    h = hashlib.sha256()
    for name, frames in sorted(clips):
        h.update(name.encode() + b"\0" + frames)
    return h.hexdigest()


def npz_long(spark: SparkSession, path: str) -> DataFrame:
    """Tensors of an NPZ file whose keys are ``corpus/seed``, as rows of probabilities."""
    rows = []
    with np.load(path) as z:
        for key in z.files:
            corpus, seed = key.rsplit("/", 1)
            rows += [(corpus, seed, i, np.asarray(r, np.float32).tolist()) for i, r in enumerate(np.atleast_2d(z[key]))]
    return spark.createDataFrame(rows, "corpus string, seed string, seq_id int, p array<float>")
