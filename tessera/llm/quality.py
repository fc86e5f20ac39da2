"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much go.

Every rule is evaluated per line of the whole text (lines end at ``\\n``):

* punctuation - more than one character in ten is a symbol, most words shout (``word!!``), or the
  line neither ends in sentence punctuation nor is a longer line that has some inside;
* navigation - menu separators stand between the words;
* boilerplate - a short line with a stock phrase, or a line that repeats an earlier one.

A document is rejected by its base figures (too few words, too much repeated text) or when the
removed lines held more than ``MAX_LOST_PERCENT`` of its word characters.

Null and empty texts have no words: all figures are 0, ``base_failed`` is true, ``kept`` false.
Repeated rows each get their own, equal, result. Other columns are not read by :func:`figures` and
pass through :func:`clean`; an empty table gives an empty table. One text is scanned at a time with
about 35 bytes of memory per byte of the longest text; no rule looks at more than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.memory import released
from tessera.llm.words import Scan, mix, scans, window_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
ENDINGS = b".!?:;\"')]}"
#: Sentence ends and closing quotes of more than one byte, as the last bytes of a word.
WIDE_ENDINGS = ("。", "！", "？", "…", "”", "»")
MENU = b"|>/-"
#: Stock phrases of pages, in the corpus's languages (English, German, French, Spanish); a parameter.
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service",
    "accept cookies", "use cookies", "enable javascript", "requires javascript", "lorem ipsum", "click here",
    "sign up", "log in", "subscribe to our newsletter", "share on", "skip to content", "back to top",
    "alle rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "klicken sie hier",
    "jetzt anmelden", "newsletter abonnieren", "teilen auf", "zum inhalt springen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "cliquez ici",
    "se connecter", "s'inscrire", "abonnez-vous", "partager sur", "aller au contenu", "haut de page",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "haga clic aquí",
    "iniciar sesión", "regístrate", "suscríbete", "compartir en", "saltar al contenido", "volver arriba",
)
#: A line with a stock phrase and at most so many words is boilerplate.
PHRASE_LINE_WORDS = 15

FIGURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("n_lines_removed", T.LongType()), T.StructField("chars_removed", T.LongType()),
])


def _is(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_SYMBOL, _END, _MENU, _NEWLINE = _is(SYMBOLS), _is(ENDINGS), _is(MENU), 0x0A
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32 if flags.dtype == bool and len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _ends_sentence(scan: Scan) -> np.ndarray:
    """For each word: its last character is sentence punctuation or closes a quote."""
    data, end = scan.data, scan.end
    found = _END[data[end - 1]]
    for mark in WIDE_ENDINGS:
        b = mark.encode()
        same = end - scan.start >= len(b)
        for k, x in enumerate(reversed(b)):
            same &= data[np.maximum(end - 1 - k, 0)] == x
        found |= same
    return found


def _later_equal(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Flags those that equal an earlier one of the same document."""
    _, first = np.unique(mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    later = np.ones(len(value), bool)
    later[first] = False
    return later


def _repeat_words(scan: Scan, size: int = 3) -> np.ndarray:
    """Words of each text that stand in windows found twice or more in it."""
    n, counts = len(scan.word), scan.last - scan.first
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        h = mix(window_hashes(scan.word, size)[at] + doc[at] * np.uint64(0x9E3779B97F4A7C15))
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            k = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            hit = at[twice[k] == h]
            flags = np.zeros(n, bool)
            for k in range(size):
                flags[hit + k] = True
            covered = _running(flags)
    return covered[scan.last] - covered[scan.first]


def examine(scan: Scan, phrases: tuple[str, ...] = PHRASES) -> dict[str, np.ndarray]:
    """Figures of every text of a scan, and of every line: where it lies and whether it is removed."""
    data, n_docs = scan.data, len(scan.lo)
    # a line of document d begins at its first byte and after every newline inside it
    breaks = np.flatnonzero(data == _NEWLINE)
    per_doc = np.searchsorted(breaks, scan.hi) - np.searchsorted(breaks, scan.lo) + 1
    line_doc = np.repeat(np.arange(n_docs), per_doc)
    head = np.cumsum(per_doc) - per_doc
    line_lo = np.empty(len(line_doc), np.int64)
    line_hi = np.empty(len(line_doc), np.int64)
    inner = np.ones(len(line_doc), bool)
    inner[head] = False
    line_lo[head] = scan.lo
    line_lo[inner] = breaks + 1
    line_hi[head + per_doc - 1] = scan.hi
    outer = np.zeros(len(line_doc), bool)
    outer[head + per_doc - 1] = True
    line_hi[~outer] = breaks

    w_lo, w_hi = np.searchsorted(scan.start, line_lo), np.searchsorted(scan.start, line_hi)
    words = w_hi - w_lo
    edge = np.zeros(len(data) + 1, np.int8)
    edge[scan.start] += 1
    edge[scan.end] -= 1
    solid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    chars, symbols = _running(solid & ((data & 0xC0) != 0x80)), _running(_SYMBOL[data])
    length = scan.end - scan.start
    last = data[scan.end - 1] if len(scan.end) else np.zeros(0, np.uint8)
    shout = _running((length > 2) & (last == 0x21) & (data[np.maximum(scan.end - 2, 0)] == 0x21) if len(length) else np.zeros(0, bool))
    menu = _running((length == 1) & _MENU[last])
    sentence = _ends_sentence(scan) if len(length) else np.zeros(0, bool)
    sentences = _running(sentence)

    line_chars = chars[line_hi] - chars[line_lo]
    line_symbols = symbols[line_hi] - symbols[line_lo]
    seps, shouts, inside = menu[w_hi] - menu[w_lo], shout[w_hi] - shout[w_lo], sentences[w_hi] - sentences[w_lo]
    worded = words > 0
    closed = np.zeros(len(words), bool)
    closed[worded] = sentence[w_hi[worded] - 1]
    later = np.zeros(len(words), bool)
    later[worded] = _later_equal(line_doc[worded], scan.span_hash(line_lo[worded], line_hi[worded]))
    stock = np.zeros(len(words), bool)
    folded = _FOLD[data].tobytes()
    for phrase in phrases:
        p, at = phrase.encode(), folded.find(phrase.encode())
        while at >= 0:
            k = int(np.searchsorted(line_lo, at, side="right")) - 1
            stock[k] |= at + len(p) <= line_hi[k]
            at = folded.find(p, at + 1)
    bad_punctuation = (10 * line_symbols > line_chars) | (2 * shouts > words) | ~(closed | ((words >= 8) & (inside > 0)))
    navigation = (seps >= 2) & (5 * seps >= words)
    boilerplate = later | (stock & (words <= PHRASE_LINE_WORDS))
    removed = worded & (bad_punctuation | navigation | boilerplate)

    def by_doc(x: np.ndarray) -> np.ndarray:
        total = _running(x)
        return total[head + per_doc] - total[head]

    n_words = scan.last - scan.first
    word_chars = chars[scan.hi] - chars[scan.lo]
    repeat = _repeat_words(scan)
    lost = by_doc(np.where(removed, line_chars, 0))
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[scan.hi] - symbols[scan.lo], "n_dup_lines": by_doc(later), "n_repeat_words": repeat,
        "base_failed": failed, "kept": ~failed & (100 * lost <= MAX_LOST_PERCENT * word_chars), "n_lines_removed": by_doc(removed), "chars_removed": lost,
        "line_head": head, "line_count": per_doc, "line_lo": line_lo, "line_hi": line_hi, "line_removed": removed,
    }


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """One row per document: its id and :data:`FIGURES`. Narrow: no shuffle."""
    schema = T.StructType([docs.schema[id_col], *FIGURES])

    def run(batches):
        target = pa.schema([(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.int64()) for f in FIGURES])
        for batch in batches:
            parts = [examine(scan, phrases) for scan in scans(batch.column(1), lower=False)]
            arrays = [pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *target.names])

    return docs.select(id_col, text_col).mapInArrow(released(run), schema)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``.

    ``chars_col``, where there is such a column, becomes the length of the cleaned text.
    """
    names = docs.columns
    at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for scan in scans(batch.column(at), lower=False):
                x = examine(scan, phrases)
                raw = scan.data.tobytes()
                for k in np.flatnonzero(x["kept"]).tolist():
                    a, n = int(x["line_head"][k]), int(x["line_count"][k])
                    keep.append(scan.rows[k])
                    if x["n_lines_removed"][k]:
                        texts.append(b"\n".join(raw[lo:hi] for lo, hi, gone in zip(x["line_lo"][a : a + n].tolist(), x["line_hi"][a : a + n].tolist(), x["line_removed"][a : a + n].tolist(), strict=True) if not gone).decode())
                    else:
                        texts.append(raw[scan.lo[k] : scan.hi[k]].decode())
            rows = batch.take(pa.array(keep, pa.int64()))
            columns = rows.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars_at >= 0:
                columns[chars_at] = pa.array([len(t) for t in texts], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(released(run), docs.schema)
