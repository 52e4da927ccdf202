"""op12: round trips, the mask token by token against plain spans, and whole tables against SQL."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import bpe, chat, queries
from tests.oracle import compare, connection

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "\\", "|", "<\\|", "<\\\\|im_end|>", "im_end|>", "assistant", " ok", "\n", "é中", "'ll", "  "]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return chat.ChatEncoder(bpe.load_ranks(f.read()))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|im_sep|>"]), st.lists(st.sampled_from(ODD), max_size=8).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(encoder, turns):
    formatted = chat.rendered(turns)
    assert chat.read_turns(formatted) == turns
    assert formatted.count(chat.START) == formatted.count(chat.SEP) == formatted.count(chat.END) == len(turns)
    texts, ids, loss, first = encoder.encode([turns, [], turns])
    assert texts == [formatted, "", formatted] and first[0] == 0 and first[-1] == len(ids) and first[1] == first[2]
    assert b"".join(encoder.tokens[i] for i in ids.tolist()).decode() == formatted * 2
    one = slice(0, first[1])
    assert "".join(encoder.under_loss(ids[one], loss[one])) == "".join(t for r, t in turns if r == "assistant")
    mask, control, role = [], {i: b.decode() for b, i in encoder.control.items()}, b""
    inside = text = False
    for i in ids[one].tolist():
        if i in control:
            inside, text = control[i] == chat.START, control[i] == chat.SEP
            role = b"" if inside else role
            mask.append(False)
        else:
            role += encoder.tokens[i] if inside else b""
            mask.append(text and role == b"assistant")
    assert loss[one].tolist() == mask


def test_same_ids(encoder):
    """Between control tokens the ids are those of the segment by itself."""
    text = "It's a <|im_end|> test,  of 123 \n\n things\t"
    _, ids, _, _ = encoder.encode([[("user", text)]])
    s, p, e = encoder.control.values()
    assert ids.tolist() == [s, *encoder.plain.encode(b"user")[0], p, *encoder.plain.encode(chat.escaped(text).encode())[0], e]


def plain_digests(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for c, x in by.items():
        x.sort(key=lambda y: y[:2])
        learnt = "".join(t for _, _, r, t in x if r == "assistant")
        out[c] = (len(x), sha("".join(f"{r}\n{t}\n" for _, _, r, t in x)), len(learnt), sha(learnt), sum(32 + len(chat.escaped(r)) + len(chat.escaped(t)) for _, _, r, t in x))
    return out


def test_whole(spark, monkeypatch):
    """Nulls everywhere, odd texts, one conversation with most turns (over several partitions and parts), a very long
    text, clashing columns; an empty table."""
    monkeypatch.setattr(chat, "PART_BYTES", 2000)
    r = random.Random(12)
    rows = [(c, i * 3, r.choice(["user", "assistant", "system"]), "".join(r.choices(ODD, k=r.randint(0, 30)))) for c in range(60) for i in range(r.randint(1, 6))]
    rows += [(7, 100 + i, "assistant" if i % 2 else "user", f"turn {i} " * 9) for i in range(1500)]
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", None), (61, None, None, None), (62, 0, "assistant", "word " * 500_000), (63, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.formatted_chars) for x in chat.formatted_digests(frame.selectExpr("*", "1 AS ids", "2 AS k1", "3 AS formatted"), RANKS).collect()}
    assert got == plain_digests(rows)
    assert chat.formatted_digests(frame.where("conv_id > 100"), RANKS).collect() == []
    parts = [x for x in chat.format_conversations(frame.where("conv_id = 7"), RANKS).collect()]
    assert len(parts) > 5 and all(len(x.ids) == len(x.loss) for x in parts) and sum(len(chat.read_turns(x.formatted)) for x in parts) == sum(c == 7 for c, *_ in rows)


def test_repeated_rows(spark):
    """50,000 equal rows are turns of their own."""
    frame = spark.range(50_000).selectExpr("3L AS conv_id", "0L AS turn", "'assistant' AS role", "'the same' AS text")
    (got,) = chat.formatted_digests(frame, RANKS).collect()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (50_000, 400_000, hashlib.sha256(b"the same" * 50_000).hexdigest())


@pytest.mark.parametrize("name", ["op12_chat_format"])
def test_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])
