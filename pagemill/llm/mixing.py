"""Problem 9: mixing sources to target weights.

The weights run down a tree of domains (the first word of a source's name), languages and sources; a source's weight is spread over its languages by their tokens. A node that can't use
its share (its documents times its allowed repeats are too few) passes the shortage to its siblings in proportion to their
weights, and only what no sibling can take goes to the relatives of an ancestor: sources of one domain and language help each
other first, then the languages of a domain, then other domains. Each leaf takes whole epochs of its documents and a
token-prefix of one more, in an order seeded by the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.langid import LANGUAGES, label_column
from pagemill.llm.tokenizer import token_counts
from pagemill.sources.shared import write_through

#: Buckets of the seeded order in which a leaf's tokens are summed, so that no window holds a whole leaf.
ORDER_BUCKETS = 4096


def source_key(name: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.regexp_replace(name, r"^(?U:\s)+|(?U:\s)+$", ""))


def language_key(name: Column) -> Column:
    """The code of the language label in any of its spellings, ``other`` where it names none of the corpus's five."""
    code = label_column(name)
    return F.when(code.isin(*LANGUAGES), code).otherwise("other")


def fill(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """Split ``amount`` by weight without exceeding anyone's room; shortages go to those with room left, by weight."""
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    while amount > 1e-6 and open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if given[i] + amount * weights[i] / total >= room[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] += amount * weights[i] / total
            break
        for i in full:
            amount -= room[i] - given[i]
            given[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return given


def plan(leaves: list[dict], budget: float) -> list[dict]:
    """Epochs (``whole``) and tokens of one more (``rest``) for each leaf (source, language, weight of the source, repeats, tokens)."""
    of_source: dict[str, int] = {}
    for leaf in leaves:
        of_source[leaf["source"]] = of_source.get(leaf["source"], 0) + leaf["tokens"]
    tree: dict[str, dict[str, list[dict]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf["source"].split(" ")[0], {}).setdefault(leaf["language"], []).append(leaf)
    weight_of = lambda x: x["weight"] * x["tokens"] / of_source[x["source"]] if x["tokens"] else 0.0
    room_of = lambda x: float(x["tokens"] * x["repeats"]) if x["weight"] > 0 else 0.0

    def share(amount: float, groups: list[list[dict]]) -> list[float]:
        return fill(amount, [sum(map(weight_of, g)) for g in groups], [sum(map(room_of, g)) for g in groups])

    out = []
    domains = [list(languages.values()) for languages in tree.values()]
    for languages, amount in zip(domains, share(budget, [[x for g in d for x in g] for d in domains])):
        for sources, part in zip(languages, share(amount, languages)):
            for leaf, tokens in zip(sources, share(part, [[x] for x in sources])):
                whole = min(int(tokens // leaf["tokens"]), leaf["repeats"]) if leaf["tokens"] else 0
                rest = tokens - whole * leaf["tokens"] if whole < leaf["repeats"] else 0.0
                out.append(leaf | {"whole": whole, "rest": rest if rest >= 0.5 else 0.0})
    return out


def mix(documents: DataFrame, targets: DataFrame, budget_tokens: int | None = None, seed: int = 42, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: doc_id, source, language, n_tokens, uses; one row per document used at least once (never more often than
    its source's max_repeats). report: source, target_share, max_repeats, n_documents, available_tokens, used_tokens,
    actual_share (of all used tokens; 0 when nothing is used); one row per target source, sources without documents
    included. The budget defaults to all tokens of the target sources.

    Documents of sources without a target (a null source too) are not used; null and empty texts have no tokens and are
    not used; a null or negative target counts as 0, null repeats as 1. A source named twice in the targets keeps its
    largest target. Each row of the documents is one document. An empty table gives no selection and shares of 0.

    The texts are tokenized in one pass without a shuffle; from then on only ids and counts move. The leaf table (sources
    of the targets times six languages) is planned on the driver; the order within a leaf is summed in hash buckets, so a leaf with a third of
    all rows is still spread over all tasks.
    """
    spark = documents.sparkSession
    t = targets.select(
        source_key(F.col("source")).alias("source"),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"),
    ).where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    wanted = t.limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 target sources")
    docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), language_key(F.coalesce("language", F.lit(""))).alias("language"), "text")
    counts = write_through(token_counts(docs, text="text", path=tokenizer), "mix-counts")
    leaf_rows = counts.where("n_tokens > 0").groupBy("source", "language").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(t.select("source")), "source", "left_semi").collect()
    of = {r["source"]: r for r in wanted}
    leaves = [
        {"source": r["source"], "language": r["language"], "tokens": r["tokens"], "weight": of[r["source"]]["target_share"], "repeats": of[r["source"]]["max_repeats"]}
        for r in sorted(leaf_rows, key=lambda r: (r["source"], r["language"]))
    ]
    budget = float(sum(x["tokens"] for x in leaves)) if budget_tokens is None else float(budget_tokens)
    planned = [(x["source"], x["language"], x["whole"], float(x["rest"])) for x in plan(leaves, budget)]
    plan_df = spark.createDataFrame(planned, "source string, language string, whole int, rest double")

    order = F.xxhash64("doc_id", F.lit(seed), "whole")
    rows = counts.where("n_tokens > 0").join(F.broadcast(plan_df), ["source", "language"]).withColumn("o", order).withColumn("bucket", F.shiftrightunsigned("o", 52))
    sums = rows.where("rest > 0").groupBy("source", "language", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    w = Window.partitionBy("source", "language").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(w), F.lit(0)))
    placed = rows.join(starts, ["source", "language", "bucket"], "left")
    straddles = F.col("before") + F.col("bucket_tokens") > F.col("rest")
    keep = ["doc_id", "source", "language", "n_tokens", "whole"]
    inside = placed.where(F.col("before").isNull() | ~straddles | (F.col("before") >= F.col("rest"))).select(
        *keep, (F.coalesce(F.col("before") < F.col("rest"), F.lit(False))).cast("int").alias("extra"))
    in_bucket = Window.partitionBy("source", "language", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(straddles & (F.col("before") < F.col("rest"))).withColumn("upto", F.col("before") + F.sum("n_tokens").over(in_bucket)).select(
        *keep, (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int").alias("extra"))
    selection = inside.unionByName(edge).withColumn("uses", F.col("whole") + F.col("extra")).where("uses > 0").select("doc_id", "source", "language", "n_tokens", "uses")

    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    have = counts.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    report = t.join(have, "source", "left").join(used, "source", "left").na.fill(0)
    total = report.agg(F.sum("used_tokens").alias("total"))
    report = report.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_documents", "available_tokens", "used_tokens",
        F.when(F.col("total") > 0, F.round(F.col("used_tokens") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("actual_share"))
    return selection, report
