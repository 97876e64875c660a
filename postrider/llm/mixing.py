"""Mixing sources to target weights over a tree of domains, languages and sources.

A budget of tokens goes down the tree by weight.  A node can use at most what its
leaves hold times ``max_epochs``; what it cannot use goes to its siblings in
proportion to their weights, and only what a whole family cannot use returns to
the parent's siblings (water-filling at each level, with capacities added up from
the leaves).  A leaf takes its documents in a seeded order of its own for each
epoch: whole epochs first, then the longest prefix that fits what is left.

The prefix of a leaf of any size is found without sorting it in one task: tokens
are added up by leading digits of the order's hash, the bucket in which the budget
ends is refined by more digits until it has at most ``EDGE_ROWS`` rows, and only that
one is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed
from .host_rules import words

# Target weights of domains and languages; a language not named has OTHER_WEIGHT, sources weigh the same.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "forum": 0.2}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
OTHER_WEIGHT = 0.05
FRACTION = 0.5
MAX_EPOCHS = 4
SEED = 17
_DIGITS = 3
#: Rows of a leaf that are put in order in one task.
EDGE_ROWS = 10_000
BROADCAST_LEAVES = 100_000
SALTS = 16
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Domain of a source by the last character of its name."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin(*"0123"), "web").when(last.isin(*"456"), "books").otherwise("forum")


def _weight(name: str, weights: dict[str, float]) -> Column:
    found = F.lit(OTHER_WEIGHT)
    for key, w in weights.items():
        found = F.when(F.col(name) == key, F.lit(w)).otherwise(found)
    return found


def water_fill(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Add given: the family's budget dealt by weight, at most cap each, the excess of the full ones to the others."""
    ordered = W.partitionBy(*family).orderBy(F.col("cap") / F.col("weight"), name)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rest = ordered.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*family).orderBy("ratio", name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    nodes = nodes.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("weight"))
    nodes = nodes.withColumn("full", F.col("ratio") <= F.col("level"))
    open_level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    return nodes.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * open_level)).drop("level", "ratio", "full")


def leaf_budgets(leaves: DataFrame, budget: float, max_epochs: int = MAX_EPOCHS, domains=None, languages=None) -> DataFrame:
    """(domain, lang, source, tokens, take long): tokens to take from each leaf."""
    leaves = leaves.filter("tokens > 0").withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = by_domain.withColumn("weight", _weight("domain", domains or DOMAIN_WEIGHTS)).withColumn("budget", F.lit(float(budget))).withColumn("root", F.lit(0))
    top = water_fill(top, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    middle = by_lang.join(top, "domain").withColumn("weight", _weight("lang", languages or LANGUAGE_WEIGHTS))
    middle = water_fill(middle, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    bottom = leaves.join(middle, ["domain", "lang"]).withColumn("weight", F.lit(1.0))
    bottom = water_fill(bottom, ["domain", "lang"], "source")
    return bottom.select(*LEAF, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("take"))


def order_key(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """48 hexadecimal digits: the seeded hash of the id, then that of the whole row, which orders rows that share an id or have none."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(hashed, F.lower(F.lpad(F.hex(tie), 16, "0")))


def _join_leaves(rows: DataFrame, leaves: DataFrame, n: int, limit: int) -> DataFrame:
    if n <= limit:
        return rows.join(F.broadcast(leaves), LEAF)
    spread = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_tie"), F.lit(SALTS))).join(spread, [*LEAF, "_salt"]).drop("_salt")


def _ends(keyed: DataFrame, digits: int) -> DataFrame:
    """For each leaf the first bucket of ``digits`` that does not fit whole: (_bucket, before, n); none if all fit."""
    buckets = keyed.groupBy(*LEAF, F.substring("_key", 1, digits).alias("_bucket")).agg(F.sum("tokens").alias("held"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    upto = W.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.col("start") + F.sum("held").over(upto))
    return buckets.filter("upto > rest").groupBy(*LEAF).agg(F.min_by(F.struct("_bucket", (F.col("upto") - F.col("held")).alias("before"), "n"), "_bucket").alias("end"))


def mix(docs: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep_text: bool = False, broadcast_leaves: int = BROADCAST_LEAVES, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """One row per selected document and epoch: the columns of docs (text only if asked for), domain, tokens and epoch.

    The budget is ``fraction`` of all tokens (words).  Null lang and source count
    as 'unknown'; texts without words hold no tokens and are selected only inside
    a prefix of their leaf.  Input columns called domain, tokens or epoch are
    replaced; all others stay.  Rows are ordered by the seeded hash of their id; those
    that share an id, or have none, by the hash of the whole row, so the result does
    not depend on how rows are partitioned; rows equal in all columns are dealt with
    one by one, and are put in order in one task (without their texts, unless
    ``keep_text``) if the budget ends among them.
    """
    own = [c for c in docs.columns if c not in ("domain", "tokens", "epoch")]
    carried = F.struct(*[c for c in own if c not in ("doc_id", *LEAF)]).alias("_row")
    named = docs.select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), carried, F.xxhash64(*own).alias("_tie"))
    named = named.withColumn("domain", domain_of(F.col("source"))).withColumn("tokens", F.size(words(F.coalesce("_row.text", F.lit("")))).cast("long"))
    light = checkpointed(named.select("doc_id", *LEAF, "tokens", "_tie"))
    leaves = checkpointed(light.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    total = leaves.agg(F.sum("tokens"), F.count("*")).first()
    budget = int((total[0] or 0) * fraction)
    planned = checkpointed(
        leaf_budgets(leaves, budget, max_epochs).withColumn("whole", F.expr("take div tokens")).withColumn("rest", F.expr("take % tokens")).drop("tokens", "take")
    )
    key = order_key(seed, F.col("whole"), F.col("doc_id"), F.col("_tie"))
    joined = lambda rows, leaves: _join_leaves(rows, leaves, total[1], broadcast_leaves).withColumn("_key", key)
    digits = _DIGITS
    found = checkpointed(_ends(joined(light, planned.withColumn("start", F.lit(0).cast("long"))), digits))
    while digits < 48 and (found.agg(F.max("end.n")).first()[0] or 0) > edge_rows:
        digits += _DIGITS
        last = planned.join(found, LEAF).select(*LEAF, "whole", "rest", "end._bucket", F.col("end.before").alias("start"))
        found = checkpointed(_ends(joined(light, last).filter(F.col("_key").startswith(F.col("_bucket"))).drop("_bucket"), digits))
    ends = checkpointed(planned.join(found, LEAF, "left").select(*LEAF, "whole", "rest", "end._bucket", "end.before"))
    rows = joined(named if keep_text else light, ends)
    bucket = F.substring("_key", 1, digits)
    split = bucket == F.col("_bucket")
    inside = rows.filter(~F.coalesce(split, F.lit(False))).withColumn("_in", F.coalesce(bucket < F.col("_bucket"), F.lit(True)))
    running = W.partitionBy(*LEAF).orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.filter(split).withColumn("_in", F.col("before") + F.sum("tokens").over(running) <= F.col("rest"))
    copies = F.sequence(F.lit(0), (F.col("whole") + F.col("_in").cast("int") - 1).cast("int"))
    out = inside.unionByName(edge).filter((F.col("whole") > 0) | F.col("_in")).withColumn("epoch", F.explode(copies))
    columns = [F.col(c) if c in ("doc_id", *LEAF) else F.col("_row")[c].alias(c) for c in own] if keep_text else ["doc_id", "lang", "source"]
    return out.select(*columns, "domain", "tokens", "epoch")
