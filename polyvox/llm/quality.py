"""Quality rules, line first, with DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); lines that
fail are removed, and a document that loses too much of its text so, or
fails the base rules, is rejected. Everything is computed within the row: the plan
has no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, ascii_lower, let, strip_blanks

SYMBOLS = r"[#*$%&|<>]"

#: Phrases of pages rather than of prose, in the languages of the corpus; a short line with one, from the start of a word, is boilerplate.
BOILERPLATE = (
    "accept all cookies", "accept cookies", "add to cart", "all rights reserved", "back to top", "click here",
    "cookie policy", "enable javascript", "forgot password", "javascript is disabled", "leave a comment",
    "log in", "lorem ipsum", "page not found", "powered by", "privacy policy", "read more", "share on",
    "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use",
    "use cookies", "view cart",
    "allgemeine geschäftsbedingungen", "alle cookies akzeptieren", "alle rechte vorbehalten", "cookies akzeptieren", "in den warenkorb",
    "jetzt anmelden", "kommentar hinterlassen", "nach oben scrollen", "newsletter abonnieren", "passwort vergessen", "seite nicht gefunden",
    "zum inhalt springen", "zur kasse",
    "accepter les cookies", "ajouter au panier", "aller au contenu", "conditions générales", "gestion des cookies", "laisser un commentaire",
    "lire la suite", "mentions légales", "mot de passe oublié", "page introuvable", "politique de confidentialité", "retour en haut",
    "se connecter", "tous droits réservés",
    "aceptar cookies", "aceptar las cookies", "aviso legal", "añadir al carrito", "deja un comentario", "haz clic aquí", "iniciar sesión",
    "leer más", "olvidaste tu contraseña", "política de cookies", "política de privacidad", "página no encontrada", "saltar al contenido",
    "todos los derechos reservados", "términos y condiciones", "volver arriba",
)

#: Words up to which a line counts as short for the navigation and boilerplate rules.
SHORT_LINE = 15
#: Share of a document's non-blank characters that its failing lines may hold.
MAX_LOST = 0.5

_MARKS = r"[#*$%&|<>\\^~{}=]"
_BARS = "[|»›•·>]"
_WORD = r"[^\x20\x09-\x0D]+"


def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases at the start of a word; what they begin with in common is tried once."""

    def branch(rest: list[str]) -> str:
        heads = sorted({x[0] for x in rest})
        below = [(h, [x[1:] for x in rest if x[0] == h]) for h in heads]
        parts = [h + (branch(tails) if "" not in tails else "") for h, tails in below]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return r"(?:^|[^0-9a-z])" + branch(list(phrases))


def line_fails(line: Column) -> Column:
    """Whether one line, blanks stripped and not empty, fails a rule.

    Punctuation: no letter or digit at all, or symbols after a good part of its words.
    Navigation: a short line of items between bars, arrows or bullets. Boilerplate: a
    short line with a fixed phrase. Cheap tests go first, and the others see only what those leave.
    """
    punctuation = ~line.rlike(r"[\p{L}\p{N}]") | (line.rlike(_MARKS) & (4 * F.regexp_count(line, F.lit(_MARKS + "+")) > F.regexp_count(line, F.lit(_WORD))))
    short = ~line.rlike(f"^(?:{_WORD}{BLANK_RUN}){{{SHORT_LINE}}}{_WORD}")
    navigation = F.regexp_count(line, F.lit(rf"[\x20\x09-\x0D]{_BARS}[\x20\x09-\x0D]")) >= 2
    boilerplate = ascii_lower(line).rlike(any_of(BOILERPLATE))
    return F.coalesce(punctuation | (short & (navigation | boilerplate)), F.lit(False))


def _windows(words: Column) -> Column:
    """A hash of each 3-word window."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _placed(windows: Column) -> Column:
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(ordered: Column) -> Column:
    """Words in windows that the text holds twice or more: of the sorted windows those with an equal neighbour."""
    twice = F.filter(
        ordered,
        lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.transform(twice, lambda x: x["i"])
    return F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))))


def quality(docs: DataFrame, min_words: int = 50, max_lost: float = MAX_LOST) -> DataFrame:
    """Each row of docs as struct `doc`, with its counts, base_failed, kept and the cleaned text.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_failed_lines, base_failed, kept, cleaned. One row comes out for each that goes
    in, whatever its id; a null text has no words, fails the base rule and stays null.
    Equal lines and rows are judged alike. A document without failing lines keeps its
    text to the byte. Other columns pass through in `doc`, under any name.
    """
    text = F.col("text")
    stripped = strip_blanks(text)
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))

    def judged(line: Column) -> Column:
        return let(strip_blanks(line), lambda body: F.struct(line.alias("line"), body.alias("body"), ((body != "") & line_fails(body)).alias("fails")))

    split = rows.select(
        "doc",
        "text",
        F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, BLANK_RUN)).alias("words"),
        F.transform(F.split(text, "\n"), judged).alias("lines"),
    )
    counted = split.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.filter("lines", lambda x: x["body"] != ""), lambda x: x["line"]).alias("worded"),
        _windows(F.col("words")).alias("windows"),
        F.filter("lines", lambda x: x["fails"]).alias("failed"),
        F.filter("lines", lambda x: ~x["fails"]).alias("clean"),
    )
    # Windows are put in order only where some occur twice.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = counted.withColumn("ordered", F.when(repeats, _placed(F.col("windows"))))
    lost = F.char_length(F.translate(F.array_join("failed.body", ""), BLANKS, ""))
    verdict = ordered.select(
        "*",
        F.when(F.col("ordered").isNull(), 0).otherwise(_covered(F.col("ordered"))).cast("long").alias("n_repeat_words"),
        F.when(F.size("failed") == 0, F.lit(False)).otherwise(lost > max_lost * F.col("word_chars")).alias("lost_too_much"),
    ).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = verdict.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("failed").cast("long").alias("n_failed_lines"),
        "base_failed",
        (~F.col("base_failed") & ~F.col("lost_too_much")).alias("kept"),
        F.when(F.size("failed") == 0, F.col("doc.text").cast("string")).otherwise(F.array_join("clean.line", "\n")).alias("cleaned"),
    )
    # A filter on a verdict must stay above: moved below, it would have every expression worked out anew inside it.
    return out.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")
