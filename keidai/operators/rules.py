"""First-wins matching of many substrings: the rules are a table, and texts meet only rules that share a piece with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keidai.functions.joins import small_side

#: Characters of a rule's seed: the beginning of its pattern by which texts and rules meet.
SEED = 4


def first_rule(texts: DataFrame, text: str, rules: DataFrame, key: list[str], seed: int = SEED) -> DataFrame:
    """Texts with `ord` of the first of rules (ord, pattern) whose pattern is in the text; null where none is.

    A rule's seed is the first characters of its pattern, as many as it has up to `seed`. A text's pieces of the seeds'
    lengths are joined with them by equality, and the whole pattern is compared at the place: so the work grows with the
    texts' lengths and the pieces that are seeds, not with texts times rules. A text without a rule, or that is null, is
    kept; equal texts are looked up once. An empty pattern is in every text that isn't null; null patterns are in none. `key`
    columns are kept beside ord.
    """
    wanted = rules.where("pattern <> ''").groupBy("pattern").agg(F.min("ord").alias("ord"))
    seeds = wanted.select(F.substring("pattern", 1, seed).alias("seed"), "pattern", "ord")
    lengths = [r["n"] for r in seeds.select(F.length("seed").alias("n")).distinct().collect()]  # 1 to `seed`
    always = rules.where("pattern = ''").agg(F.min("ord").alias("always"))
    distinct = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    places = lambda n: F.when(F.length("_text") >= n, F.sequence(F.lit(1), F.length("_text") - (n - 1)))
    out = None
    for n in sorted(lengths):
        pieces = distinct.select("_text", F.explode(places(n)).alias("_at")).select("_text", "_at", F.substr("_text", F.col("_at"), F.lit(n)).alias("seed"))
        own = small_side(seeds.where(F.length("seed") == n))
        hit = pieces.join(own, "seed").where(F.substr("_text", F.col("_at"), F.length("pattern")) == F.col("pattern")).select("_text", "ord")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        best = distinct.select("_text", F.lit(None).cast(rules.schema["ord"].dataType).alias("_ord"))
    else:
        best = out.groupBy("_text").agg(F.min("ord").alias("_ord"))
    joined = texts.join(best, F.col(text) == F.col("_text"), "left").crossJoin(F.broadcast(always))  # one row
    found = F.when(F.col(text).isNotNull(), F.least("_ord", "always"))  # least() skips nulls
    return joined.select(*key, found.alias("ord"))
