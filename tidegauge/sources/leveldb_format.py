"""The LevelDB file formats, as its documentation describes them: sorted tables, write logs, Snappy blocks."""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack, unpack_from

# The last bytes of a table, sizes of its footer and of a log's blocks and record headers.
MAGIC = bytes.fromhex("57fb808b247547db")
FOOTER, LOG_BLOCK, LOG_HEADER = 48, 32768, 7
Entry = tuple[bytes, int, bool, bytes]  # key, sequence number, live, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, lowest first, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def snappy(data: bytes) -> bytes:
    """Decompress a Snappy block: literals and copies of what came before."""
    size, at = varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        kind, at = tag & 3, at + 1
        if kind == 0:
            n = tag >> 2
            if n >= 60:
                width = n - 59
                n = int.from_bytes(data[at : at + width], "little")
                at += width
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if kind == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            width = 2 if kind == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < back <= len(out):
            raise ValueError("a copy from before the block")
        while n > 0:  # a copy may reach into what it writes
            some = out[len(out) - back : len(out) - back + n]
            out += some
            n -= len(some)
    if len(out) != size:
        raise ValueError("a Snappy block of another size than it says")
    return bytes(out)


def _block(data: bytes, offset: int, size: int) -> bytes:
    raw, kind = data[offset : offset + size], data[offset + size]
    if kind > 1:
        raise ValueError(f"unknown compression {kind}")
    return snappy(raw) if kind else raw


def _pairs(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Keys and values of a block; a key says how much it shares with the one before it."""
    (restarts,) = unpack_from("<I", block, len(block) - 4)
    end, at, key = len(block) - 4 * (restarts + 1), 0, b""
    while at < end:
        shared, at = varint(block, at)
        own, at = varint(block, at)
        size, at = varint(block, at)
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + size]
        at += own + size


def table_entries(data: bytes) -> Iterator[Entry]:
    """Entries of a sorted table: the index at its end names the data blocks."""
    if len(data) < FOOTER or data[-8:] != MAGIC:
        raise ValueError("not a table file")
    footer = data[-FOOTER:]
    _, at = varint(footer, 0)
    _, at = varint(footer, at)
    offset, at = varint(footer, at)
    size, at = varint(footer, at)
    for _, handle in _pairs(_block(data, offset, size)):
        start, at = varint(handle, 0)
        length, _ = varint(handle, at)
        for key, value in _pairs(_block(data, start, length)):
            (mark,) = unpack_from("<Q", key, len(key) - 8)
            yield key[:-8], mark >> 8, mark & 255 == 1, value


def log_entries(data: bytes) -> Iterator[Entry]:
    """Entries of a write log: records, maybe in several parts, that are batches of writes. A torn end is left out."""
    at, parts = 0, b""
    while at + LOG_HEADER <= len(data):
        left = LOG_BLOCK - at % LOG_BLOCK
        if left < LOG_HEADER:
            at += left
            continue
        size, kind = unpack_from("<HB", data, at + 4)
        if kind == 0 or at + LOG_HEADER + size > len(data):
            return
        part = data[at + LOG_HEADER : at + LOG_HEADER + size]
        at += LOG_HEADER + size
        parts = part if kind in (1, 2) else parts + part
        if kind in (1, 4):  # whole, or its last part
            yield from _batch(parts)


def _batch(data: bytes) -> Iterator[Entry]:
    seq, count = unpack_from("<QI", data, 0)
    at = 12
    for k in range(count):
        live = data[at] == 1
        size, at = varint(data, at + 1)
        key, at = data[at : at + size], at + size
        value = b""
        if live:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        yield key, seq + k, live, value


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def log_of(seq: int, writes: list[tuple[bytes, bytes | None]]) -> bytes:
    """A write log of one batch from sequence number ``seq`` on; a value of None deletes. Without checksums, which readers may leave unchecked."""
    rest = pack("<QI", seq, len(writes)) + b"".join(bytes([v is not None]) + _number(len(k)) + k + (b"" if v is None else _number(len(v)) + v) for k, v in writes)
    out, kind = bytearray(), 2
    while True:
        room = LOG_BLOCK - LOG_HEADER
        part, rest = rest[:room], rest[room:]
        out += b"\0\0\0\0" + pack("<HB", len(part), kind if rest else (1 if kind == 2 else 4)) + part
        if not rest:
            return bytes(out)
        kind = 3
