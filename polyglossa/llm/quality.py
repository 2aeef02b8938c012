"""Line-first quality rules.

Each line of a text is judged on its own. Lines without a word, lines of symbols and lines equal to an earlier one fail; so do
navigation (a separator or arrow for every four words, or one in a short line without a closing mark), boilerplate (page furniture in English, French,
German or Spanish, in lines of up to 30 words), and lines that break the punctuation rule: in a text most of whose words stand in lines that end with
a closing mark, a line of at most `stub` words must end with one too, unless the line behind it goes on in lower case or it is the first line,
a heading. The failing lines are removed, and a text that keeps less than `least_kept` of its word characters is rejected, as is one that fails the base rules (fewer than 50 words, or over
half of its words inside repeated three-word windows).

Null and empty texts have no words and are rejected. Rows are judged one by one; repeated rows get equal results, a null doc_id stays.
Other columns are not read. Texts of any length are judged whole. All counts and flags are those of the input text; `with_text` adds the
text of the lines that stay, in their order and unchanged (null for a null text).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix, raw_texts, text_buffers, text_steps, windows_of, words_of

SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture, in lower case, by language.
BOILERPLATE = {
    "en": ("all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "sign up for our newsletter", "subscribe to our", "share this", "log in", "read more", "skip to content", "back to top", "add to cart", "lorem ipsum"),
    "fr": ("tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "conditions générales", "cliquez ici", "abonnez-vous", "inscrivez-vous à", "se connecter", "lire la suite", "en savoir plus", "haut de page", "ajouter au panier", "activer javascript"),
    "de": ("alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "hier klicken", "newsletter abonnieren", "jetzt anmelden", "weiterlesen", "mehr erfahren", "nach oben", "in den warenkorb", "javascript aktivieren", "impressum"),
    "es": ("todos los derechos reservados", "aceptar cookies", "política de privacidad", "aviso legal", "términos de uso", "condiciones de uso", "haga clic aquí", "haz clic aquí", "suscríbete", "iniciar sesión", "leer más", "volver arriba", "añadir al carrito", "activar javascript"),
}
_BOILER = re.compile("|".join(re.escape(p) for ps in BOILERPLATE.values() for p in ps))
_NAV = re.compile(rb"[|>]|\xc2\xbb|\xe2\x80\xba")
_CLOSED = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\x9d", b"\xe2\x80\xa6", b",")
_NO_SYMBOL = bytes(range(256)).translate(None, SYMBOLS)


def line_fails(line: bytes, n_words: int) -> bool:
    """line: without surrounding white space, with at least one word."""
    if len(line.translate(None, _NO_SYMBOL)) * 10 > len(line):
        return True
    marks = len(_NAV.findall(line))
    if marks * 4 >= n_words or marks and n_words <= 8 and not line.endswith(_CLOSED):
        return True
    return n_words <= 30 and _BOILER.search(line.decode().lower()) is not None


def judge_lines(text: bytes, stub: int = 6, stay: list[bytes] | None = None) -> tuple[int, int, int]:
    """(lines equal to an earlier one, code points in words, of them in lines that stay); `stay` collects these lines."""
    seen, dup, total, closed = set(), 0, 0, 0
    lines: list[tuple[bytes, bytes, int, int]] = []  # the first of each kind: whole, stripped, words, code points
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        chars, bare = len(b"".join(words).decode()), line.strip()
        total += chars
        closed += chars * bare.endswith(_CLOSED)
        if line in seen:
            dup += 1
        else:
            seen.add(line)
            lines.append((line, bare, len(words), chars))
    left = 0
    for k, (line, bare, n, chars) in enumerate(lines):
        if line_fails(bare, n):
            continue
        if 0 < k and n <= stub and 2 * closed > total and not bare.endswith(_CLOSED):
            if k + 1 == len(lines) or not lines[k + 1][1].decode()[0].islower():
                continue
        left += chars
        if stay is not None:
            stay.append(line)
    return dup, total, left


def repeated_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in three-word windows that occur twice or more in the text) of each row."""
    data, offsets = text_buffers(column)
    n, repeated = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for a, b in text_steps(offsets):
        hashes, _, _, counts = words_of(data, offsets[a : b + 1], lower=False)
        n[a:b] = counts
        found, at = windows_of(hashes, counts, 3)
        if not len(at):
            continue
        doc = np.repeat(np.arange(b - a), counts)
        key = found ^ mix(doc[at].astype(U64) + U64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hot = at[order[np.r_[same, False] | np.r_[False, same]]]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[hot + k] = True
        repeated[a:b] = np.bincount(doc[covered], minlength=b - a)
    return n, repeated


def judge_documents(df: DataFrame, least_kept: float = 0.5, stub: int = 6, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars; with_text adds `cleaned`, the lines that stay."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            n, repeated = repeated_words(b.column(1))
            rows, cleaned = [], []
            for _, texts in raw_texts(b.column(1)):
                for t in texts:
                    stay = [] if with_text else None
                    rows.append((len(t.translate(None, _NO_SYMBOL)), *judge_lines(t, stub, stay)))
                    if with_text:
                        cleaned.append(b"\n".join(stay).decode())
            symbols, dup, chars, left = np.array(rows, np.int64).reshape(-1, 4).T
            failed = (n < 50) | (100 * repeated > 50 * n)
            kept = ~failed & (left >= least_kept * chars)
            columns = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"), map(pa.array, (n, chars, symbols, dup, repeated, failed, kept, left))))
            if with_text:
                columns["cleaned"] = pa.array(cleaned, pa.string(), mask=b.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns.values()], ["doc_id", *columns])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_chars long" + ", cleaned string" * with_text)
