"""Quality rules: line-first cleaning, in DataFrame functions alone.

Each line with a word is held against rules of three kinds, punctuation (no sentence mark in a line of some length, or
shouted marks), navigation (bars or symbols between words, menu words alone on a line) and boilerplate (licence, cookie
and script notices), the latter two in English, German, French and Spanish. Lines that fail are removed; a document is rejected when it loses more than ``MOST_LOST`` of its
words' lines, weighed by their characters, or when a base rule fails: too few words, or too many words in repeated
8-word windows.

Plan. One projection, no shuffle: a text is split once into words and once into lines, and all is array functions in the
row; each line is judged once. Windows are compared by 64-bit hashes: their distinct number tells most texts from those with a repeat, and only the
latter sort (hash, position) to find covered words, n log n in a text's length.

Defined results: a null or empty text has no words and fails the base; a text of under eight words has no window; ties and
equal rows have equal results; other columns of the table aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
MOST_LOST = 0.5

# Java and RE2 syntax alike, for lines whose A-Z are in lower case: no boundaries, cases or line ends that the two see apart
BOILERPLATE = r"(?:^|[^a-z])(?:all rights reserved|licensed under|released under|terms of (?:use|service)|privacy policy|cookies?|enable javascript|lorem ipsum|subscribe to our newsletter|alle rechte vorbehalten|nutzungsbedingungen|datenschutz(?:erkl[äÄ]rung)?|javascript aktivieren|newsletter abonnieren|tous droits r[éÉ]serv[éÉ]s|conditions d'utilisation|politique de confidentialit[éÉ]|activez javascript|abonnez-vous|todos los derechos reservados|condiciones de uso|pol[íÍ]tica de privacidad|active javascript|suscr[íÍ]bete)(?:[^a-z]|\z)"
MENU = r"^[\x20\x09-\x0D]*(?:home|menu|login|log in|sign in|sign up|next|previous|back|search|contact us|about us|read more|skip to content|startseite|anmelden|registrieren|weiter(?:lesen)?|zur[üÜ]ck|suche|kontakt|impressum|accueil|connexion|inscription|suivant|pr[éÉ]c[éÉ]dent|rechercher|lire la suite|inicio|iniciar sesi[óÓ]n|registrarse|siguiente|anterior|buscar|contacto|leer m[áÁ]s)[\x20\x09-\x0D]*\z"
_SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line (with a word) breaks a rule."""
    spaces = F.regexp_count(line, F.lit(SPACE + "+")) + 1  # words, or one or two more
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    symbols = F.regexp_count(line, F.lit(_SYMBOL))
    marks = F.regexp_count(line, F.lit("[.!?,;:…。]"))
    bangs = F.regexp_count(line, F.lit("!"))
    punctuation = ((marks == 0) & (spaces >= 8)) | ((bangs >= 4) & (3 * bangs >= spaces))
    navigation = ((symbols >= 2) & (5 * symbols >= spaces)) | low.rlike(MENU)
    return punctuation | navigation | low.rlike(BOILERPLATE)


def repeat_words(words: Column) -> Column:
    """How many words lie in 8-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    long = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), spread)

    def spread(placed: Column) -> Column:
        # positions whose hash equals a neighbour's in the order of hashes
        same = lambda x, at: F.coalesce(x["h"] == F.try_element_at(placed, at)["h"], F.lit(False))
        near = F.transform(placed, lambda x, k: F.when(same(x, k + 2) | ((k > 0) & same(x, F.greatest(k, F.lit(1)))), x["i"]))
        at = F.array_sort(F.filter(near, lambda i: i.isNotNull()))
        start = F.struct(long.alias("n"), long.alias("end"))
        step = lambda s, i: F.struct((s["n"] + WINDOW - F.greatest(long, s["end"] - i)).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(at, start, step, lambda s: s["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), long).otherwise(covered(hashes))

    return F.when(F.size(words) < WINDOW + 1, long).otherwise(_let(windows, counted))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value found once: a one-element array carries it."""
    return F.transform(F.array(value), body)[0]


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, lost, kept,
    cleaned (the text without failed lines) of every row."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    x = base.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("all"))
    x = x.select("doc_id", "t", "w", "all", F.filter("all", has_word).alias("lines"), F.transform("all", lambda line: has_word(line) & line_fails(line)).alias("fails"))
    count = lambda c: c.cast("long")
    x = x.select(
        "doc_id", "all", "lines", "fails",
        count(F.size("w")).alias("n_words"),
        count(F.char_length(F.array_join("w", ""))).alias("word_chars"),
        count(F.regexp_count("t", F.lit(_SYMBOL))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.filter("all", lambda line, i: F.get("fails", i)).alias("bad"),
    )
    chars = lambda c: F.char_length(F.array_join(c, ""))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.when(chars("lines") > 0, chars("bad") / chars("lines")).otherwise(0.0)
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        count(F.size("lines")).alias("n_lines"), count(F.size("bad")).alias("n_bad_lines"), lost.alias("lost"),
        (~failed & (lost <= MOST_LOST)).alias("kept"),
        F.array_join(F.filter("all", lambda line, i: ~F.get("fails", i)), "\n").alias("cleaned"),
    )
