"""Mixing sources to target weights: temperature, bisection, budgeted block permutations. DataFrame functions only.

A source's weight is its share of the tokens to the power alpha, normalised. Alpha comes from a bisection: the largest whose
weights reach the target entropy, and then, if a source would have to be repeated too often, the smallest that keeps to the
limit. The budget is the least that uses every document at least once, or a given number of tokens. A source's part of it is spent epoch by epoch:
each epoch is another permutation of its documents, and the last one ends where the part is spent. The whole schedule is cut into
blocks of equal budget that hold all sources by their weights.

Running sums over a source go over three levels (documents of a bucket, buckets of a shelf, shelves), so that no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut

#: Documents in a bucket and buckets on a shelf that are aimed at; rounds of bisection; digits of alpha.
BUCKET, SHELF, ROUNDS, DIGITS = 256, 1024, 40, 6


def tokens(text: str = "text") -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column | str) -> Column:
    """60 bits of an MD5, which other engines can reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _bisected(above: callable) -> Column:
    """The edge between 0 and 1 where above(x) becomes false, to DIGITS digits."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        yes = above(middle)
        return F.struct(F.when(yes, middle).otherwise(s["lo"]).alias("lo"), F.when(yes, s["hi"]).otherwise(middle).alias("hi"))

    return F.round(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, halve, lambda s: s["hi"]), DIGITS)


def weights(sizes: DataFrame, entropy: float, repeats: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, share, alpha, weight, part) for each of sizes (source, tokens, docs); part is the source's budget.

    entropy is the target as a part of the most there is, log of the number of sources; repeats is the most epochs of a source. Sources without
    tokens have weight 0. A null source is a source.
    """
    some = sizes.where("tokens > 0")
    shares = some.agg(F.collect_list("tokens").alias("all"), F.sum("tokens").alias("total"))
    shares = shares.select("total", F.transform("all", lambda t: t / F.col("total")).alias("p"))

    def power_sum(a: Column) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, p: s + F.pow(p, a))

    def spread(a: Column) -> Column:  # the entropy of p ** a / z is log z - a * sum(p ** a * log p) / z
        z = power_sum(a)
        return F.ln(z) - a * F.aggregate("p", F.lit(0.0), lambda s, p: s + F.pow(p, a) * F.ln(p)) / z

    # the entropy falls as alpha grows; so do the epochs of the smallest source for one of the largest
    level = F.when(F.size("p") <= 1, F.lit(1.0)).otherwise(_bisected(lambda a: spread(a) >= F.lit(entropy) * F.ln(F.size("p"))))
    often = F.when(F.size("p") <= 1, F.lit(1.0)).otherwise(_bisected(lambda a: F.pow(F.array_max("p") / F.array_min("p"), 1 - a) > F.lit(repeats)))
    model = shares.select("total", F.greatest(level, often).alias("alpha"), "p").withColumn("z", power_sum(F.col("alpha")))
    # w / t is largest for the smallest source; the largest one sets the budget that uses every document once
    model = model.withColumn("budget", F.lit(budget).cast("double") if budget is not None else F.col("total") * F.array_max("p") / (F.pow(F.array_max("p"), "alpha") / F.col("z")))
    share = F.col("tokens") / F.col("total")
    weight = F.when(F.col("tokens") > 0, F.pow(share, "alpha") / F.col("z")).otherwise(0.0)
    return sizes.join(F.broadcast(model.select("total", "alpha", "z", "budget")), how="left").select("source", "tokens", "docs", share.alias("share"), "alpha", weight.alias("weight"), F.floor(F.round(weight * F.col("budget"), 3)).alias("part"))


def schedule(docs: DataFrame, entropy: float = 0.97, repeats: float = 4.0, budget: int | None = None, block: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place) for every use of every row of docs (doc_id, source, text; other columns are not looked at).

    epoch counts from 0; blocks count from 0 and hold about `block` tokens; rows of a block go by place. Documents without tokens are used
    once, in epoch 0. Rows equal in doc_id, source and tokens are each used, at one place. Nulls in doc_id or source are values like others. An empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", "source", tokens().alias("n_tokens"))
    rows = cut(rows.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("rows")))
    # few rows, one for each source; the join copes with any number
    sizes = cut(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.count(F.lit(1)).alias("docs")))
    plan = cut(weights(sizes, entropy, repeats, budget))
    whole = F.greatest(F.lit(1), F.ceil(F.col("part") / F.greatest("tokens", F.lit(1)))).cast("int")
    given = plan.select(F.col("source").alias("s"), "tokens", "part", F.when(F.col("tokens") > 0, whole).otherwise(1).alias("epochs"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).cast("long").alias("buckets"))
    given = given.crossJoin(F.broadcast(plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("part") / block)).alias("blocks"))))
    uses = rows.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    uses = uses.withColumn("key", _hash(F.lit(seed), name, "n_tokens", F.col("epoch").cast("string")))
    uses = uses.withColumn("bucket", F.col("key") % F.col("buckets")).withColumn("shelf", F.floor(F.col("bucket") / SHELF)).withColumn("size", F.col("n_tokens") * F.col("rows"))
    at = ["source", "epoch"]
    in_bucket = uses.groupBy(*at, "shelf", "bucket").agg(F.sum("size").alias("own"))
    before = in_bucket.withColumn("in_shelf", F.sum("own").over(Window.partitionBy(*at, "shelf").orderBy("bucket")) - F.col("own"))
    shelves = in_bucket.groupBy(*at, "shelf").agg(F.sum("own").alias("all"))
    shelves = shelves.withColumn("to_shelf", F.sum("all").over(Window.partitionBy(*at).orderBy("shelf")) - F.col("all"))
    start = before.alias("b").join(shelves.alias("h"), F.col("b.source").eqNullSafe(F.col("h.source")) & (F.col("b.epoch") == F.col("h.epoch")) & (F.col("b.shelf") == F.col("h.shelf")))
    start = start.select(F.col("b.source").alias("s"), F.col("b.epoch").alias("e"), F.col("b.bucket").alias("k"), (F.col("in_shelf") + F.col("to_shelf")).alias("start"))
    uses = uses.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("k")))
    own = Window.partitionBy(*at, "bucket").orderBy("key", "doc_id")
    spent = F.col("epoch") * F.col("tokens") + F.col("start") + F.sum("size").over(own) - F.col("size")
    uses = uses.withColumn("spent", spent).where((F.col("spent") < F.col("part")) | ((F.col("size") == 0) & (F.col("epoch") == 0)))
    number = F.least(F.floor(F.col("spent") / F.greatest("part", F.lit(1)) * F.col("blocks")), F.col("blocks") - 1)
    return uses.select("doc_id", "source", "n_tokens", "epoch", F.greatest(number, F.lit(0)).cast("long").alias("block"), _hash(F.lit(seed + "/place"), name, F.col("epoch").cast("string")).alias("place"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the schedule uses it; see schedule() for how and for nulls and ties."""
    uses = schedule(docs, **how).groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("uses"))
    # of rows equal in these three, each is used as often as the others
    uses = uses.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("n_tokens").alias("__n"), "uses")
    same = docs.groupBy(F.col("doc_id").alias("__d2"), F.col("source").alias("__s2"), tokens().alias("__n2")).agg(F.count(F.lit(1)).alias("rows"))
    each = uses.join(same, F.col("__d").eqNullSafe(F.col("__d2")) & F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__n") == F.col("__n2"))).select("__d", "__s", "__n", (F.col("uses") / F.col("rows")).cast("int").alias("__times"))
    rows = docs.withColumn("__t", tokens()).join(each, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__t") == F.col("__n")))
    return rows.withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
