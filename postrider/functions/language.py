"""Language detection by frequent words: native columns, and a plug-in point for a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, language_text, tokens, without_links

MIN_CHARS = 20
MIN_SHARE = 0.65
# Frequent short words by language.
FREQUENT = {
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "ist", "nicht", "ein", "eine", "auf", "für", "im", "dem"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "are", "from"),
    "es": ("el", "los", "las", "que", "y", "del", "se", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "pero"),
    "fr": ("le", "les", "et", "des", "du", "une", "dans", "qui", "est", "pour", "par", "sur", "pas", "au", "avec", "ce", "il", "sont"),
    "no": ("og", "det", "på", "som", "til", "av", "ikke", "jeg", "har", "med", "er", "var", "han", "hun", "seg", "fra", "etter", "også"),
}


def detect(text: Column) -> Column:
    """Language with the most frequent words, if it has at least MIN_SHARE of those found; null for short or doubtful texts.

    The text without its links, its frequent words and their counts are bound once each: what stands inside an expression several times may be computed as often.
    """
    known = sorted({w for own in FREQUENT.values() for w in own})

    def best(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda acc, c: acc + c["n"])
        return _bound(F.array_max(counts), lambda most: F.when((most["n"] > 0) & (most["n"] >= MIN_SHARE * total), most["lang"]))

    def judged(words: Column) -> Column:
        return _bound(F.array(*[_count(words, lang, own) for lang, own in FREQUENT.items()]), best)

    def of_text(clean: Column) -> Column:
        # The head of most texts is long enough; blanks of the rest are collapsed only where it is not.
        enough = (F.length(collapsed(F.left(clean, F.lit(8 * MIN_CHARS)))) >= MIN_CHARS) | (F.length(collapsed(clean)) >= MIN_CHARS)
        return F.when(enough, _bound(F.filter(tokens(clean), lambda w: w.isin(*known)), judged))

    return _bound(without_links(text), of_text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(words: Column, lang: str, own: tuple[str, ...]) -> Column:
    return F.struct(F.size(F.filter(words, lambda w: w.isin(*own))).alias("n"), F.lit(lang).alias("lang"))


def detect_with(model: Callable[[list[str]], list[tuple[str | None, float]]], text: Column, least: float = MIN_SHARE) -> Column:
    """A model's language where it is sure enough; texts that are too short never reach it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        known = texts.notna()
        if known.any():
            out[known] = [lang if sure >= least else None for lang, sure in model(texts[known].tolist())]
        return out

    clean = language_text(text)
    return run(F.when(F.length(clean) >= MIN_CHARS, clean))


def queue_state(text: Column, lang: Column, attempted: Column) -> Column:
    """pending, done or declined: declined texts were tried and got none."""
    return F.when(lang.isNotNull(), "done").when(attempted.isNotNull(), "declined").otherwise("pending")
