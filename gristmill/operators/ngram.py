"""How well text is predicted and which id may come next, from bigram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.runlog import perplexity
from gristmill.functions.text import hash_number, seeded_hash

IGNORED = -1
UNSEEN = -2
HEAD = 200_000
RECENT = 50


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(split, token, next, n)``, counted before the shuffle. Stage it: one pass serves all."""
    return pairs.groupBy("split", "token", "next").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(counts: DataFrame, split: str = "train") -> DataFrame:
    """``(token, next, n)`` of one split."""
    return counts.filter(F.col("split") == split).select("token", "next", "n")


def _scored(counted: DataFrame, bigrams: DataFrame, vocab_size: int) -> DataFrame:
    """Add ``loss``: negative log probability with add-one smoothing, and valid targets only."""
    # At most one row per id of the 16-bit vocabulary.
    contexts = F.broadcast(bigrams.groupBy("token").agg(F.sum("n").alias("context_n")))
    seen = bigrams.withColumnRenamed("n", "bigram_n")
    hit = F.coalesce(F.col("bigram_n"), F.lit(0)) + 1
    room = F.coalesce(F.col("context_n"), F.lit(0)) + vocab_size
    return (
        counted.filter(F.col("next") != IGNORED)
        .join(seen, ["token", "next"], "left")
        .join(contexts, "token", "left")
        .withColumn("loss", -F.log(hit / room))
    )


def _mean_loss(scored: DataFrame, key: str) -> DataFrame:
    loss = F.sum(F.col("n") * F.col("loss")) / F.sum("n")
    return (
        scored.groupBy(key)
        .agg(F.sum("n").alias("targets"), loss.alias("loss"))
        .withColumn("perplexity", perplexity(F.col("loss")))
    )


def bigram_loss(counts: DataFrame, bigrams: DataFrame, vocab_size: int) -> DataFrame:
    """Mean loss and perplexity per split; equal pairs are scored once."""
    return _mean_loss(_scored(counts, bigrams, vocab_size), "split")


def document_perplexity(
    pairs: DataFrame, bigrams: DataFrame, vocab_size: int, head: int = HEAD
) -> DataFrame:
    """The same per document.

    The ``head`` most frequent bigrams, a bounded table that covers most pairs, are broadcast
    and scored in place; those pairs leave their task as one sum per document. Only the rare
    rest is shuffled, counted per document and pair, to meet the whole table.
    """
    top = bigrams.orderBy(F.desc("n"), "token", "next").limit(head)
    contexts = bigrams.groupBy("token").agg(F.sum("n").alias("context_n"))
    frequent = top.join(F.broadcast(contexts), "token").select(
        "token", "next", (-F.log((F.col("n") + 1) / (F.col("context_n") + vocab_size))).alias("known")
    )
    found = pairs.filter(F.col("next") != IGNORED).join(F.broadcast(frequent), ["token", "next"], "left")
    rare = F.col("known").isNull()
    counted = found.groupBy(
        "doc_id", F.when(rare, F.col("token")).alias("token"), F.when(rare, F.col("next")).alias("next")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("known"))
    scored = _scored(counted.withColumn("next", F.coalesce("next", F.lit(UNSEEN))), bigrams, vocab_size)
    loss = F.sum(F.coalesce("known", F.col("n") * F.col("loss"))) / F.sum("n")
    return (
        scored.groupBy("doc_id")
        .agg(F.sum("n").alias("targets"), loss.alias("loss"))
        .withColumn("perplexity", perplexity(F.col("loss")))
    )


def candidate_scores(bigrams: DataFrame) -> DataFrame:
    """``(context, next, score)``: the log count of each id seen after a context."""
    return bigrams.select(
        F.col("token").alias("context"), "next", F.log(F.col("n").cast("double")).alias("score")
    )


def top_k_next(scores: DataFrame, k: int = 50) -> DataFrame:
    """Candidates whose score is not below the k-th of their context; ties at the border stay.

    A context has at most one candidate per id of the vocabulary.
    """
    best = Window.partitionBy("context").orderBy(F.desc("score"))
    return scores.withColumn("place", F.rank().over(best)).filter(F.col("place") <= k).drop("place")


def softmax_group(scores: DataFrame, temperature: float = 0.8) -> DataFrame:
    """Add ``p``: scores over temperature, exponentiated and normalised per context."""
    group = Window.partitionBy("context")
    scaled = F.col("score") / temperature
    raised = F.exp(scaled - F.max(scaled).over(group))
    return scores.withColumn("_e", raised).withColumn(
        "p", F.col("_e") / F.sum("_e").over(group)
    ).drop("_e")


def weighted_draw(weighted: DataFrame, seed: int = 42) -> DataFrame:
    """One candidate per context, drawn with probability ``p`` by a seeded hash."""
    draw = hash_number(seeded_hash(seed, F.col("context"))) / float(16**8)
    upto = Window.partitionBy("context").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    reached = weighted.withColumn("_through", F.sum("p").over(upto))
    # Rounding may leave the total just under the draw; the last candidate then wins.
    chosen = F.coalesce(
        F.min(F.when(F.col("_through") >= draw, F.col("next"))), F.max("next")
    )
    return reached.groupBy("context").agg(chosen.alias("next"))


def penalised_top_k(
    prompts: DataFrame, scores: DataFrame, k: int = 50, penalty: float = 1.15, most_recent: int = RECENT
) -> DataFrame:
    """``(doc_id, context, next, score)``: the ``k`` best after the penalty; ties at the border stay.

    ``prompts`` are ``(doc_id, context, recent)`` with at most ``most_recent`` ids. Scores are
    log counts, so a penalty only lowers them and at most ``most_recent`` of a context: the
    best ``k + most_recent`` before it hold the best ``k`` after it. These go to the prompts as
    one bounded list per context, so a context that most prompts share multiplies no rows.
    """
    best = top_k_next(scores, k + most_recent)
    lists = best.groupBy("context").agg(F.collect_list(F.struct("next", "score")).alias("all"))
    lowered = F.transform(
        "all",
        lambda c: F.struct(
            c["next"].alias("next"),
            F.when(F.array_contains("recent", c["next"]), c["score"] / penalty).otherwise(c["score"]).alias("score"),
        ),
    )
    joined = prompts.join(lists, "context").select("doc_id", "context", lowered.alias("all"))
    in_order = F.sort_array(F.transform("all", lambda c: c["score"]), asc=False)
    border = F.element_at(in_order, F.least(F.lit(k), F.size("all")))
    kept = joined.withColumn("border", border).select(
        "doc_id", "context", F.inline(F.filter("all", lambda c: c["score"] >= F.col("border")))
    )
    return kept.select("doc_id", "context", "next", "score")


def sample_next(
    prompts: DataFrame,
    scores: DataFrame,
    k: int = 50,
    penalty: float = 1.15,
    temperature: float = 0.8,
    seed: int = 42,
    most_recent: int = RECENT,
) -> DataFrame:
    """``(doc_id, next)``: one id per prompt, drawn from its ``k`` best after penalty and temperature.

    An exponential race: each candidate arrives at -ln(u) / exp(score), with u hashed from
    prompt and candidate, and the first to arrive is drawn, which happens with the softmax
    probability of its score. So there is no sum over a prompt's candidates to divide by or to
    walk along; the least arrival is a partial aggregate. A temperature divides all scores, so
    it changes no order and comes last.
    """
    best = penalised_top_k(prompts, scores, k, penalty, most_recent)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("next").cast("string"))
    u = (hash_number(seeded_hash(seed, key)) + 0.5) / float(16**8)
    arrival = F.log(-F.log(u)) - F.col("score") / temperature
    return best.groupBy("doc_id").agg(F.min_by("next", F.struct(arrival, "next")).alias("next"))


def repetition_penalty(
    scores: DataFrame, penalty: float = 1.15, recent: str = "recent"
) -> DataFrame:
    """Divide the scores of ids in the array column ``recent`` once, whatever their sign."""
    return scores.withColumn(
        "score",
        F.when(F.array_contains(recent, F.col("next")), F.col("score") / penalty).otherwise(
            F.col("score")
        ),
    )
