"""Type-length-value frames: type u8, flags u8, big-endian length u32, payload."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frame types and the greatest payload.
TYPES = {0x01: "SEARCH", 0x02: "SUGGEST", 0x11: "SEARCH_RESPONSE", 0x12: "SUGGEST_RESPONSE", 0x7F: "ERROR"}
HEADER, MOST_PAYLOAD = 6, 1 << 20


def encode(kind: int, payload: bytes, flags: int = 0) -> bytes:
    return struct.pack(">BBI", kind, flags, len(payload)) + payload


def encoded(kind: Column, payload: Column, flags: int = 0) -> Column:
    """A frame as an expression, of a type number and a binary payload."""
    head = F.concat(F.lpad(F.hex(kind), 2, "0"), F.lit(f"{flags:02X}"), F.lpad(F.hex(F.octet_length(payload)), 8, "0"))
    return F.concat(F.unhex(head), payload)


class Decoder:
    """Whole frames of bytes that come in pieces. A bad type or an over-long frame ends the stream."""

    def __init__(self, most: int = MOST_PAYLOAD):
        self.held, self.most, self.status = b"", most, "PARTIAL"

    def feed(self, data: bytes) -> list[tuple[int, int, bytes]]:
        self.held += data
        out, at = [], 0
        while self.status not in ("BAD_TYPE", "TOO_LONG"):
            self.status = "PARTIAL"
            if len(self.held) - at < HEADER:
                break
            kind, flags, n = struct.unpack_from(">BBI", self.held, at)
            if kind not in TYPES:
                self.status = "BAD_TYPE"
            elif n > self.most:
                self.status = "TOO_LONG"
            elif len(self.held) - at < HEADER + n:
                break
            else:
                out.append((kind, flags, self.held[at + HEADER : at + HEADER + n]))
                at += HEADER + n
        self.held = self.held[at:]  # once, not for each frame
        return out


@F.udtf(returnType="seq int, status string, type int, flags int, payload binary")
class TlvFrames:
    """Frames of one binary value, then a row with what is left: PARTIAL, BAD_TYPE or TOO_LONG; nothing if all is read."""

    def eval(self, data: bytes):
        decoder = Decoder()
        seq = 0
        for kind, flags, payload in decoder.feed(bytes(data or b"")):
            yield seq, "OK", kind, flags, payload
            seq += 1
        if decoder.held:
            yield seq, decoder.status, None, None, decoder.held


def decoded(df: DataFrame, column: str = "data") -> DataFrame:
    """df's rows with each frame of the column."""
    return df.lateralJoin(TlvFrames(F.col(column).outer()))
