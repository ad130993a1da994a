"""Quality rules, line first.

Every line meets the punctuation, navigation and boilerplate rules; lines that fail go. A
document is rejected when its base statistics fail or when the removed lines held too large a
share of its words. One pass of a vectorised Python function reads each text once and gives the
statistics, the verdict and the cleaned text; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, has_columns

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Marks that end a sentence, before closing quotes and brackets.
ENDS = re.compile("[.!?…。！？:;][\"'”’»)\\]]*$")
#: Separators of menus and bread crumbs.
MENU = ("|", "»", "›", "•", "·", "→")
#: What lines of page furniture say in English, German, French and Spanish; matched in lower case.
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "privacy policy",
    "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookie-einstellungen", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "aller au contenu", "cliquez ici", "conditions d’utilisation", "conditions générales", "en savoir plus", "lire la suite", "politique de confidentialité", "s’abonner à", "se connecter", "tous droits réservés",
    "aviso legal", "haga clic aquí", "iniciar sesión", "leer más", "política de cookies", "política de privacidad", "saltar al contenido", "suscríbete", "términos de uso", "todos los derechos reservados",
)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, bad_words long, kept boolean, clean_text string"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the share of words that a document may lose."""

    #: Symbols among a line's characters, in per cent.
    symbols: int = 10
    #: Menu separators in a line.
    separators: int = 2
    #: A line of at least so many words needs a sentence end, and may not be in capitals.
    prose_words: int = 4
    #: Capitals among its letters, in per cent.
    shout: int = 80
    #: Boilerplate phrases count in lines of at most so many words.
    phrase_words: int = 12
    #: Words lost to bad lines, in per cent of all words, that a document survives.
    lost: int = 30


_words = re.compile(WORD).findall


def bad_line(line: str, words: list[str], rules: LineRules) -> str | None:
    """The rule that a line with words fails: navigation, punctuation, shouting or boilerplate; None if it passes."""
    if sum(line.count(x) for x in MENU) >= rules.separators:
        return "navigation"
    marks = sum(line.count(x) for x in SYMBOLS)
    if 100 * marks > rules.symbols * sum(map(len, words)):
        return "punctuation"
    if len(words) >= rules.prose_words:
        if not any(map(ENDS.search, words)):
            return "punctuation"
        letters = sum(map(str.isalpha, line))
        if letters and 100 * sum(map(str.isupper, line)) > rules.shout * letters:
            return "shouting"
    if len(words) <= rules.phrase_words:
        low = line.lower()
        if any(x in low for x in PHRASES):
            return "boilerplate"
    return None


def repeat_words(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of width words which the text has twice or more, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    bits = max(1, (len(ids) - 1).bit_length())
    spans = n - width + 1
    key = code[:spans].copy()
    used = bits
    for k in range(1, width):
        if used + bits > 62:  # rank what is there, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = max(1, int(key.max()).bit_length())
        key = (key << bits) | code[k : k + spans]
        used += bits
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def judge(text: str | None, rules: LineRules) -> tuple:
    """One row of SCHEMA."""
    text = text or ""
    words = _words(text)
    n = len(words)
    repeated = repeat_words(words)
    failed = n < 10 or 100 * repeated > 20 * n
    seen: set[str] = set()
    lines = bad = lost = again = 0
    good: list[str] = []
    for line in text.split("\n"):
        if own := _words(line):
            lines += 1
            again += line in seen
            seen.add(line)
            if bad_line(line, own, rules):
                bad += 1
                lost += len(own)
                continue
        good.append(line)
    kept = not failed and 100 * lost <= rules.lost * n
    return (
        n, len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), again, repeated, failed,
        lines, bad, lost, kept, ("\n".join(good) if bad else text) if kept else None,
    )


def judge_documents(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """All rows and columns of docs, with a struct column quality of the fields of SCHEMA.

    Needs text. Base statistics: n_words; word_chars (code points in words); n_symbols
    (characters of #*$%&|<>); n_dup_lines (lines with a word that equal an earlier one);
    n_repeat_words (words in 5-word windows found twice or more). base_failed: fewer than 10
    words, or more than 20 % of them repeated. kept: not base_failed, and the bad lines held at
    most rules.lost per cent of the words. clean_text: the text without its bad lines (lines
    without words stay), null where the document is rejected.

    A null text counts as an empty one and is rejected, as is one without words. Rows that
    repeat are judged alike. An existing column named quality is replaced.
    """
    has_columns(docs, "text")
    bounded_batches(docs)
    rules = rules or LineRules()

    @F.pandas_udf(SCHEMA)
    def quality(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([judge(t, rules) for t in texts], columns=[x.split()[0] for x in SCHEMA.split(", ")])
        return out.astype({"base_failed": bool, "kept": bool}) if len(out) else out

    # Marked as such so that Spark runs it once, and not again for a filter on its result.
    return docs.withColumn("quality", quality.asNondeterministic()(F.col("text")))


def clean_documents(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """The kept documents with their cleaned texts, in the columns of docs."""
    judged = judge_documents(docs, rules)
    kept = judged.where("quality.kept")
    return kept.select(*[F.col("quality.clean_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
