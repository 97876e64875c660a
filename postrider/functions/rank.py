"""Cover-density ranking of weighted documents (Clarke, Cormack and Tudhope)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import required_words, tokens

#: Weights of the classes D, C, B, A.
DEFAULT_WEIGHTS = (0.1, 0.2, 0.4, 1.0)


def boosts(to: float = 0.5, body: float = 1.0, sender: float = 2.0, subject: float = 3.0) -> tuple[float, ...]:
    """Class weights D to A from boosts, the largest becoming 1; all ones if none is positive."""
    most = max(to, body, sender, subject)
    return (1.0,) * 4 if most <= 0 else tuple(x / most for x in (to, body, sender, subject))


def weighted_document(subject: Column, sender: Column, body: Column, to: Column) -> Column:
    """array<struct<word,weight>> in order of position; weight is the class 0 (D) to 3 (A)."""
    part = lambda c, w: F.transform(tokens(F.coalesce(c, F.lit(""))), lambda t: F.struct(t.alias("word"), F.lit(w).alias("weight")))
    return F.concat(part(subject, 3), part(sender, 2), part(body, 1), part(to, 0))


def covers(places: list[tuple[int, int, int]], n_terms: int) -> list[list[tuple[int, int, int]]]:
    """Minimal runs of (position, term, class) that hold every term, by a two-pointer sweep."""
    found, seen, low, have = [], {}, 0, 0
    for high, (_, term, _) in enumerate(places):
        seen[term] = seen.get(term, 0) + 1
        have += seen[term] == 1
        if have < n_terms:
            continue
        while seen[places[low][1]] > 1:
            seen[places[low][1]] -= 1
            low += 1
        found.append(places[low : high + 1])
        seen[places[low][1]] -= 1
        have -= 1
        low += 1
    return found


def cover_density(words: list[str], classes: list[int], terms: list[str], weights=DEFAULT_WEIGHTS) -> float:
    """Each minimal cover adds the harmonic mean of its words' weights over one plus the other words inside it."""
    index = {t: i for i, t in enumerate(terms)}
    places = [(p, index[w], c) for p, (w, c) in enumerate(zip(words, classes)) if w in index]
    score = 0.0
    for cover in covers(places, len(index)):
        inverse = sum(1 / max(weights[c], 1e-9) for _, _, c in cover)
        noise = cover[-1][0] - cover[0][0] - (len(cover) - 1)
        score += len(cover) / inverse / (1 + noise)
    return score


def alternatives(tree) -> list[list[str]]:
    """Words to rank by, for each side of an OR of a match tree."""
    return [required_words(s) for s in (tree[1] if tree[0] == "any" else [tree])] if tree else []


def plain_document(text: Column) -> Column:
    """A document of one part, all of class D."""
    return F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("word"), F.lit(0).alias("weight")))


def density(places: Column, n_terms: int) -> Column:
    """Fold over array<struct<position, term, inverse>>, in order: the sum over minimal covers.

    A run of places that ends here is a minimal cover if the least of the terms' last
    places, where it starts, lies further on than it did before.  The state keeps that start, and for each term its
    last place: its number, its position, and the inverse weights of all places before it.
    """
    never = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"), F.lit(0.0).alias("before"))
    begin = F.struct(F.array_repeat(never, n_terms).alias("last"), F.lit(0).alias("i"), F.lit(0.0).alias("inverse"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))

    def step(state: Column, x: Column) -> Column:
        here = F.struct(state["i"].alias("i"), x["position"].alias("p"), state["inverse"].alias("before"))
        last = F.transform(state["last"], lambda v, k: F.when(k == x["term"], here).otherwise(v))
        inverse = state["inverse"] + x["inverse"]

        def close(last: Column) -> Column:
            first = F.array_min(last)
            within = state["i"] - first["i"]
            gain = (within + 1) / (inverse - first["before"]) / (1 + (x["position"] - first["p"]) - within)
            return F.struct(
                last.alias("last"), (state["i"] + 1).alias("i"), inverse.alias("inverse"), first["i"].alias("start"),
                (state["score"] + F.when(first["i"] > state["start"], gain).otherwise(0.0)).alias("score"),
            )

        return F.element_at(F.transform(F.array(last), close), 1)

    return F.aggregate(places, begin, step, lambda state: state["score"])


def cover_density_column(document: Column, alternatives: list[list[str]], weights=DEFAULT_WEIGHTS) -> Column:
    """Rank of a weighted document: the sum over alternatives (OR) of the density of their terms; null without a document."""
    inverse = F.array(*[F.lit(1 / max(w, 1e-9)) for w in weights])

    def of_side(doc: Column, terms: list[str]) -> Column:
        names = F.array(*[F.lit(t) for t in terms])
        place = lambda x, i: F.struct(i.alias("position"), (F.array_position(names, x["word"]) - 1).cast("int").alias("term"), F.get(inverse, x["weight"]).alias("inverse"))
        return density(F.filter(F.transform(doc, place), lambda x: x["term"] >= 0), len(terms))

    sides = [list(dict.fromkeys(a)) for a in alternatives if a]
    if not sides:
        return F.lit(0.0)

    def total(doc: Column) -> Column:
        found = of_side(doc, sides[0])
        for terms in sides[1:]:
            found = found + of_side(doc, terms)
        return found

    return total(document) if len(sides) == 1 else F.element_at(F.transform(F.array(document), total), 1)
