"""Frames from a stream of pieces of bytes: what is left of a connection's bytes is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.sources.frames import Decoder

FRAMES = "conn string, n long, status string, type int, flags int, payload binary"


def _decode(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, n, status = state.get if state.exists else (b"", 0, "PARTIAL")
    decoder, out = Decoder(), []
    decoder.held, decoder.status = bytes(held), status
    for data in pd.concat(list(parts)).sort_values("seq").data:
        ended = decoder.status in ("BAD_TYPE", "TOO_LONG")
        for kind, flags, payload in decoder.feed(bytes(data)):
            out.append((key[0], n, "OK", kind, flags, payload))
            n += 1
        if decoder.status in ("BAD_TYPE", "TOO_LONG"):
            decoder.held = b""
            if not ended:  # said once; the rest of the connection is ignored
                out.append((key[0], n, decoder.status, None, None, None))
    state.update((decoder.held, n, decoder.status))
    yield pd.DataFrame(out, columns=["conn", "n", "status", "type", "flags", "payload"]).astype({"type": "Int32", "flags": "Int32"})


def decode(pieces: DataFrame) -> DataFrame:
    """Frames of a stream (conn, seq, data), each with its number in the connection; a bad frame ends the connection.
    State is at most one frame's bytes."""
    return pieces.groupBy("conn").applyInPandasWithState(_decode, FRAMES, "held binary, n long, status string", "append", GroupStateTimeout.NoTimeout)
