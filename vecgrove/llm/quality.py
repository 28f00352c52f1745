"""Quality rules, line first, with built-in functions only.

Every line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too large a share of
its text, or fails a base rule, is rejected. Everything is a projection over
one row: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, pick

GAP = f"[{WORD_GAP}]+"
#: Fixed values of the rules.
END_MARKS = r"""[.!?…。！？:;]["'”’»)\]]*\s*$"""
#: A line of so many words with a sentence end inside is prose, whatever its end.
INNER_END, PROSE_WORDS = r"""[.!?]["'”’»)\]]*\s""", 12
SYMBOLS = "[#*$%&|<>]"
SHOUTS = r"!!"
#: Beginnings of menu lines, in English, German, French and Spanish; a dot stands for a letter with a mark.
MENU_WORDS = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top", "click here", "read more", "share", "tweet", "skip to content",
    "startseite", "anmelden", "registrieren", "weiterlesen", "mehr lesen", "nach oben", "zum inhalt springen", "teilen", "impressum",
    "accueil", "connexion", "se connecter", "lire la suite", "en savoir plus", "retour en haut", "aller au contenu", "partager",
    "inicio", "iniciar sesi.n", "registrarse", "leer m.s", "volver arriba", "saltar al contenido", "compartir",
)
MENU = r"(?i)^\W*(" + "|".join(MENU_WORDS) + r")\b[^.]{0,40}$"
#: What boilerplate lines hold, in lower case, in the same languages.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "subscribe to our", "powered by wordpress",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "javascript aktivieren", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "utilise des cookies", "activer javascript", "abonnez-vous à",
    "todos los derechos reservados", "términos de uso", "términos y condiciones", "política de privacidad", "aviso legal", "utiliza cookies", "activar javascript", "suscríbete a",
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document may lose this share of its word characters.
MAX_LOST_PERCENT = 30


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the list.

    Windows are compared by 64-bit hash. Most lists are cleared by one hash set;
    in the others the sorted (hash, position) pairs show which repeat.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            hit = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            return F.array_sort(hit)

        def spread(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.when(i == F.size(p) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(p, i + 1) - x))),
                F.lit(0),
                lambda a, x: a + x,
            )

        return let(let(pairs, places), spread)

    def judged(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(words, judged)


def line_verdict(line: Column) -> Column:
    """Null for a line that stays, else the name of a rule that it fails, the
    cheap ones first. Lines without a word always stay. Words are counted only
    where a rule comes down to their number."""
    n_words = F.size(F.split(F.trim(line), GAP))
    return (
        F.when(~line.rlike(f"[^{WORD_GAP}]"), F.lit(None).cast("string"))
        .when(F.contains(line, F.lit("|")) & (F.size(F.split(line, r"\|")) > 3), F.lit("navigation"))
        .when(~line.rlike(END_MARKS) & ((n_words < PROSE_WORDS) | ~line.rlike(INNER_END)), F.lit("punctuation"))
        .when(line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) * 4 > n_words), F.lit("punctuation"))
        .when(F.contains(line, F.lit(SHOUTS)) & ((F.size(F.split(line, SHOUTS)) - 1) * 4 > n_words), F.lit("punctuation"))
        .when(let(F.lower(line), lambda x: reduce(Column.__or__, (F.contains(x, F.lit(p)) for p in BOILERPLATE))), F.lit("boilerplate"))
        .when(line.rlike(MENU), F.lit("navigation"))
    )


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, carry: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines,
    lost_chars, kept, cleaned``.

    ``cleaned`` is the text without its failing lines, for rejected documents
    too. A null or empty text has no words, fails the base rules and is
    rejected; its ``cleaned`` is empty. Rows are judged one by one, so repeated
    rows, ties and a null id change nothing. Other columns are not read, or with
    ``carry`` come along inside one column, ``carried`` (a struct of the input).
    """
    rows = pick(df, carry, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    extra = ["carried"] if carry else []
    measured = F.struct(
        let(
            words_of(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                repeated_words(w).cast("bigint").alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(
            F.split("text", "\n", -1),
            lambda lines: F.struct(
                let(F.filter(lines, lambda x: x.rlike(f"[^{WORD_GAP}]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
                F.size(lines).cast("bigint").alias("n_lines"),
                let(
                    F.filter(lines, lambda x: line_verdict(x).isNull()),
                    lambda kept: F.struct(
                        F.size(kept).cast("bigint").alias("n"),
                        F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(F.regexp_replace(x, GAP, ""))).alias("chars"),
                        F.array_join(kept, "\n").alias("text"),
                    ),
                ).alias("kept"),
            ),
        ).alias("l"),
    )
    # generated, not projected: a filter on the verdict then can't draw the rules in and have them run twice
    counted = rows.select("doc_id", *extra, F.explode(F.array(measured)).alias("m")).select("doc_id", *extra, "m.*")
    w, l = F.col("w"), F.col("l")
    return counted.select(
        "doc_id",
        *extra,
        w["n_words"].alias("n_words"),
        w["word_chars"].alias("word_chars"),
        "n_symbols",
        l["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
        ((w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])).alias("base_failed"),
        l["n_lines"].alias("n_lines"),
        (l["n_lines"] - l["kept"]["n"]).alias("n_failed_lines"),
        (w["word_chars"] - l["kept"]["chars"]).alias("lost_chars"),
        l["kept"]["text"].alias("cleaned"),
    ).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))
