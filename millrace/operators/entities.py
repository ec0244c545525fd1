"""Entity resolution of short names: scored candidate pairs, merged clusters, recall against a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import with_lcs, with_letter_bags
from millrace.functions.text import name_tokens, strip_company_endings
from millrace.operators.ordinals import with_ordinal
from millrace.storage import stage

#: Pairs of at least this score are the same without a review.
AUTOMATIC = 95


def scored_pairs(names: DataFrame, name: str = "name", threshold: int = 70, automatic: int = AUTOMATIC) -> DataFrame:
    """(name_a, name_b, fuzzy, score, band): pairs of distinct names that share a token and score at least the threshold.

    score = int(0.6 fuzzy + 0.4 * 100 * Jaccard of the token sets), fuzzy = rounded LCS ratio of the cleaned names in percent. The
    threshold bounds the Jaccard similarity from below, (threshold - 60) / 40, and with it the number of shared tokens; so only a
    name's rarest tokens are indexed, as many as a pair of these sizes may differ in and one more. Pairs meet by sizes and by how many
    tokens they share: the fewer, the more alike their letters must be, and a pair whose lengths or letters, in any order, are too far
    apart is dropped where it meets, before it is written anywhere. Names without a token pair with none. Above a threshold of 80, a
    name of few tokens pairs only with names of the same tokens; where no other name has them, it is dropped before all that.
    """
    least = max(0.0, (threshold - 60) / 40)
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    if least > 1 - least:
        # a pair whose tokens differ has a Jaccard similarity of m / (m + 1) at most, m being the lesser number of tokens
        tokens = F.array_distinct(name_tokens("name"))
        n = n.select("name", F.xxhash64(F.array_sort(tokens)).alias("set"), (F.size(tokens) * (1 - least) >= least - 1e-9).alias("may_differ"))
        n = n.withColumn("same", F.count("*").over(Window.partitionBy("set"))).where("may_differ or same > 1").select("name")
    n = n.withColumn("tokens", name_tokens("name")).withColumn("clean", F.array_join("tokens", " ")).withColumn("tokens", F.array_distinct("tokens")).where("size(tokens) > 0")
    # ids are places in the names' order, so that the lesser id is the lesser name
    n = stage(with_ordinal(n, "name", name="id"), "names")
    token = n.select("id", F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("token"))
    df = token.groupBy("token").agg(F.count("*").alias("df"))
    ranked = token.join(df.hint("merge"), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ranked = with_letter_bags(n.select("id", "clean"), "clean").select("id", F.length("clean").alias("letters"), "bag", "bag2").join(ranked.hint("merge"), "id")
    ranked = stage(ranked.select("id", "letters", "bag", "bag2", "t", F.size("t").alias("m")), "ranked")
    sizes = sorted(r.m for r in ranked.select("m").distinct().collect())
    # for partners of k tokens, at least `need` tokens are shared; those that share from `low` to `high` of them meet by one of the first m - low + 1 rarest
    fewer, more = F.least("m", "k"), F.greatest("m", "k")
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * (F.col("m") + F.col("k")) / (1 + least) - 1e-9)).cast("int")
    steps = [(0, 0)] + [(1 << i, (2 << i) - 1) for i in range((sizes[-1] if sizes else 1).bit_length())]
    steps = F.filter(F.array(*(F.struct(F.lit(x).alias("low"), F.lit(y).alias("high")) for x, y in steps)), lambda s: s["low"] <= fewer - need)
    sized = ranked.withColumn("k", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).where(need <= fewer).withColumn("step", F.explode(steps))
    sized = sized.withColumn("low", need + F.col("step.low")).withColumn("high", F.least(need + F.col("step.high"), fewer))
    # so large a part of both names' letters may be missing on either side; names that don't share all tokens differ in a letter at least
    sharing = F.ceil((threshold - 40 * F.col("high") / (F.col("m") + F.col("k") - F.col("high"))) / 0.6 - 1e-9)
    sized = sized.withColumn("part", F.least(F.greatest(1 - (sharing - 0.5) / 100, F.lit(0.0)) + 1e-6, F.lit(1.0))).withColumn("differ", F.col("high") < more)
    ratio = (1 + F.col("part")) / (1 - F.least("part", F.lit(0.9)))
    sized = sized.where(~F.col("differ") | (F.col("part") >= 0.9) | (F.col("part") * F.col("letters") * (1 + ratio) >= 1))
    # where that part is small, names meet by bands of lengths, next to each other, as wide as it allows; which also splits frequent tokens
    band = F.when(F.col("part") < 0.2, F.floor(F.log(F.greatest(F.col("letters"), F.lit(1)).cast("double")) / F.log(ratio) + 1e-9).cast("int"))
    rarest = F.filter(F.slice("t", 1, F.col("m") - F.col("low") + 1), lambda t: t["df"] > 1)["token"]
    keys = sized.select("id", "m", "k", "low", "part", "differ", "letters", "bag", "bag2", band.alias("band"), F.explode(rarest).alias("token"))
    # the name of fewer tokens, or of the lesser id, is looked up among the others
    a = keys.where("m <= k").select(F.col("id").alias("x"), "m", "k", "low", "token", F.coalesce("band", F.lit(-9)).alias("band"), "part", "differ", *(F.col(c).alias(f"{c}_x") for c in ("letters", "bag", "bag2")))
    near = F.explode(F.when(F.col("band").isNull(), F.array(F.lit(-9))).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    b = keys.where("m >= k").select(F.col("id").alias("y"), F.col("m").alias("k"), F.col("k").alias("m"), "low", "token", near.alias("band"), *(F.col(c).alias(f"{c}_y") for c in ("letters", "bag", "bag2")))
    apart, missing = F.abs(F.col("letters_x") - F.col("letters_y")), F.col("part") * (F.col("letters_x") + F.col("letters_y"))
    uncommon = F.bit_count(F.col("bag_x").bitwiseXOR(F.col("bag_y"))) + F.bit_count(F.col("bag2_x").bitwiseXOR(F.col("bag2_y")))
    close = (F.greatest(apart, uncommon) <= missing) & (~F.col("differ") | (missing >= F.when(apart > 0, 1).otherwise(2)))
    pairs = a.join(b.hint("merge"), ["token", "m", "k", "low", "band"]).where(((F.col("m") < F.col("k")) | (F.col("x") < F.col("y"))) & close)
    pairs = pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    codes = n.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), F.length("clean").alias("letters"))
    for side in ("a", "b"):
        pairs = pairs.join(codes.select(F.col("id").alias(f"id_{side}"), F.col("tokens").alias(f"tokens_{side}"), F.col("letters").alias(f"letters_{side}")).hint("merge"), f"id_{side}")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    jaccard = shared / (F.size("tokens_a") + F.size("tokens_b") - shared)
    length = F.col("letters_a") + F.col("letters_b")
    bound = 60.0 * 2 * F.least("letters_a", "letters_b") / length + 40 * jaccard + 1  # no pair of these lengths scores more
    pairs = stage(pairs.withColumn("jaccard", jaccard).where(bound >= threshold).select("id_a", "id_b", "jaccard"), "near-pairs")
    # the names themselves come in only now
    for side in ("a", "b"):
        pairs = pairs.join(n.select(F.col("id").alias(f"id_{side}"), F.col("name").alias(f"name_{side}"), F.col("clean").alias(f"clean_{side}")).hint("merge"), f"id_{side}")
    pairs = pairs.select("name_a", "name_b", "clean_a", "clean_b", "jaccard")
    length = F.length("clean_a") + F.length("clean_b")
    scored = with_lcs(pairs, "clean_a", "clean_b")
    fuzzy = F.round(F.try_divide(200.0 * F.col("lcs"), length)).cast("int")
    scored = scored.withColumn("fuzzy", fuzzy).withColumn("score", (0.6 * F.col("fuzzy") + 0.4 * 100 * F.col("jaccard")).cast("int"))
    band = F.when(F.col("score") >= automatic, "auto").otherwise("candidate")
    return scored.where(F.col("score") >= threshold).select("name_a", "name_b", "fuzzy", "score", band.alias("band"))


def merged_clusters(mentions: DataFrame, name: str, order: str, first: dict[str, str], last: dict[str, str], union: dict[str, str], most: int = 10) -> DataFrame:
    """Mentions with one normalised name as a cluster: variants, count, and other columns' first, last or united values that are set.

    first, last, union: new column by column; the order column decides, and of the united values the ``most`` least stay.
    """
    x = mentions.withColumn("_key", strip_company_endings(name)).where("_key <> ''")
    there = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    aggregates = [F.array_sort(F.collect_set(name)).alias("variants"), F.count("*").alias("mention_count")]
    aggregates += [F.min_by(F.when(there(c), F.col(c)), F.when(there(c), F.struct(order, c))).alias(k) for k, c in first.items()]
    aggregates += [F.max_by(F.when(there(c), F.col(c)), F.when(there(c), F.struct(order, c))).alias(k) for k, c in last.items()]
    aggregates += [F.slice(F.array_sort(F.collect_set(F.when(there(c), F.col(c)))), 1, most).alias(k) for k, c in union.items()]
    return x.groupBy(F.col("_key").alias("canonical")).agg(*aggregates)


def found_in(wanted: DataFrame, names: DataFrame, key: str = "id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(key, found): whether any of the names equals a wanted one or its aliases, or holds or is held by it, both normalised.

    Equal forms meet in a hash join. A form that holds another one holds its first four letters too: each shorter form is keyed by
    them, each longer one by every four letters in a row, distinct forms only, and the pairs that meet are compared. Forms of under four letters must be equal.
    """
    forms = wanted.select(key, F.explode(F.array_distinct(F.transform(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))), strip_company_endings))).alias("form")).where("form <> ''").distinct()
    seen = names.select(strip_company_endings("name").alias("seen")).where("seen <> ''").distinct()
    distinct = forms.select("form").distinct()
    equal = distinct.join(seen, F.col("form") == F.col("seen"), "left_semi")

    def grams(df: DataFrame, c: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(F.col(c), i, 4))
        return df.where(F.length(c) >= 4).select(c, F.explode(F.array_distinct(every)).alias("gram"))

    start = lambda df, c: df.where(F.length(c) >= 4).select(c, F.left(c, F.lit(4)).alias("gram"))
    held = start(distinct, "form").join(grams(seen, "seen"), "gram").where(F.contains("seen", "form")).select("form")
    holds = grams(distinct, "form").join(start(seen, "seen"), "gram").where(F.contains("form", "seen")).select("form")
    hit = forms.join(equal.unionByName(held).unionByName(holds).distinct(), "form").select(key).distinct()
    return wanted.select(key).distinct().join(hit.withColumn("found", F.lit(True)), key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))
