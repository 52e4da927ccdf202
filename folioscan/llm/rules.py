"""Line-first quality rules: judge lines, drop the failing ones, then reject documents that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.common import arrow_limits, byte_values, mixed, per_row, span_hash, steps, texts, word_bounds

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A document is rejected if failing lines hold more than this percentage of its words.
MOST_LOST = 50
#: Line rules. A line's last characters (of Latin, Greek, Arabic, Indic and East Asian scripts), its cells, its share of
#: symbols and of capitals, and notices, in English, German, French and Spanish: other languages need their own.
MARKS = "…”»。！？：；，」』؟۔।॥·"
ENDS = re.compile(rb"(?:[.!?:;,]|[.!?]['\")\]]|" + b"|".join(c.encode() for c in MARKS) + rb")[\x20\x09-\x0d]*\Z")
LEAST_CELLS, SYMBOL_PERCENT, SHORT_LINE = 3, 5, 4
NOTICES = (
    "all rights reserved|licensed under|released under|under the terms of|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|subscribe to|sign up for|click here|log in to|skip to content",
    "alle rechte vorbehalten|ver.ffentlicht unter der lizenz|nutzungsbedingungen|cookie-richtlinie|javascript aktivieren|newsletter abonnieren|hier klicken|zum inhalt springen|jetzt anmelden",
    "tous droits r.serv|sous licence|conditions d.utilisation|politique de confidentialit|activer javascript|abonnez-vous|cliquez ici|aller au contenu|se connecter",
    "todos los derechos reservados|bajo licencia|t.rminos de uso|pol.tica de (?:privacidad|cookies)|active javascript|habilite javascript|haga clic|saltar al contenido|iniciar sesi",
)
NOTICE = re.compile("|".join(NOTICES).replace(".", "(?:[\\x00-\\x7f]|[\\xc0-\\xff][\\x80-\\xbf]+)").encode("latin-1"))
SYMBOLS = b"#*$%&|<>"
_ASCII_UPPER, _ASCII_LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def line_fails(line: bytes) -> bool:
    """Punctuation, navigation and boilerplate rules on one line that has a word."""
    if not ENDS.search(line):  # punctuation: an unfinished line of prose, a table row, a menu entry
        return True
    if line.count(b"|") >= LEAST_CELLS:  # navigation: cells
        return True
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if 100 * symbols > SYMBOL_PERCENT * len(line):
        return True
    upper = len(line) - len(line.translate(None, _ASCII_UPPER))
    if upper > SHORT_LINE and upper > len(line) - len(line.translate(None, _ASCII_LOWER)):  # shouted banners
        return True
    return NOTICE.search(line.lower()) is not None


def repeated_words(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in windows that are found twice or more in their row) of each row."""
    starts, stops, first = word_bounds(data, offsets)
    counts = np.diff(first)
    n = len(starts) - window + 1
    if n <= 0:
        return counts, np.zeros(len(counts), np.int64)
    word = span_hash(data, starts, stops, byte_values(1))
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += mixed(word[k : k + n] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    key = mixed(key[whole])
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (row[whole[order]][1:] == row[whole[order]][:-1])
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(starts) + 1, np.int64)
    at = whole[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return counts, per_row(np.cumsum(edge[:-1]) > 0, first)


def clean_lines(docs: DataFrame, texts_too: bool = True) -> DataFrame:
    """One row a document: the base counts, the lines and words that failing lines hold, base_failed, kept and,
    if asked for, clean_text (the lines that passed; null where the document is rejected).

    Null and empty texts have no words, so they fail the base. A line without a word passes. Repeated rows each give
    their row. Long documents are worked on whole, one at a time.
    """
    arrow_limits(docs.sparkSession)
    is_symbol = np.isin(np.arange(256), list(SYMBOLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioscan.llm.common import ASCII_SPACE

        for rows, data, offsets in steps(batches):
            words, repeated = repeated_words(data, offsets)
            chars = per_row(((data & 0xC0) != 0x80) & ~ASCII_SPACE[data], offsets)
            symbols = per_row(is_symbol[data], offsets)
            text, cuts = data.tobytes(), offsets.tolist()
            again, bad_lines, bad_words, clean = [], [], [], []
            for a, b in zip(cuts, cuts[1:]):
                seen, kept = set(), []
                twice = bad = lost = 0
                for line in text[a:b].split(b"\n"):
                    if line.strip():
                        if line in seen:
                            twice += 1
                        else:
                            seen.add(line)
                        if line_fails(line):
                            bad += 1
                            lost += len(line.split())
                            continue
                    if texts_too:
                        kept.append(line)
                again.append(twice)
                bad_lines.append(bad)
                bad_words.append(lost)
                clean.append(b"\n".join(kept).decode() if texts_too else None)
            failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
            keep = ~failed & (100 * np.array(bad_words) <= MOST_LOST * words)
            out = [rows.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (words, chars, symbols, again, repeated, bad_lines, bad_words)), pa.array(failed), pa.array(keep)]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_bad_words", "base_failed", "kept"]
            if texts_too:
                out.append(pa.array([c if k else None for c, k in zip(clean, keep.tolist())], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(out, names)

    longs = ", ".join(f"{c} long" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_bad_words"))
    return texts(docs).mapInArrow(run, longs + ", base_failed boolean, kept boolean" + ", clean_text string" * texts_too)


#: The same in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 4], ' ') AS g FROM pos),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(lines) AS l FROM w)),
bad AS (SELECT doc_id, l, len(lw) AS n,
    NOT regexp_matches(l, '([.!?:;,]|[.!?][''")\]]|[@MARKS@])[\x20\x09-\x0D]*$')
    OR len(l) - len(replace(l, '|', '')) >= 3
    OR 100 * (len(regexp_extract_all(l, '[#*$%&|<>]'))) > 5 * octet_length(encode(l))
    OR (len(regexp_extract_all(l, '[A-Z]')) > 4 AND len(regexp_extract_all(l, '[A-Z]')) > len(regexp_extract_all(l, '[a-z]')))
    OR regexp_matches(l, '(?i)(@NOTICES@)') AS fails
  FROM ln WHERE len(lw) > 0),
lines AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines, sum(fails::INT)::BIGINT AS n_bad_lines, sum(CASE WHEN fails THEN n ELSE 0 END)::BIGINT AS n_bad_words FROM bad GROUP BY doc_id),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(n_bad_words, 0) AS n_bad_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_bad_words <= 50 * n_words AS kept FROM base
""".replace("@MARKS@", MARKS).replace("@NOTICES@", "|".join(NOTICES))
