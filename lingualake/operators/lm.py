"""Token scores of a language model, and perplexity from them.

The built-in model is a bigram model with added counts, trained by grouped counts on the same tokens;
any other provider gives the same columns: logprob_actual, logprob_max, entropy, most_likely_token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .segment import starts_after


#: Parts that the followers of a word are dealt to.
SALTS = 16


def bigram_scores(tokens: DataFrame, key: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """tokens (key, pos, token) with scores; the first token of a key (pos 0) has none and no row.

    P(b | a) = (n(a, b) + alpha) / (n(a) + alpha V). Unseen followers share the rest evenly; ties for the
    likeliest go to the lesser token.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    pairs = tokens.withColumn("before", F.lag("token").over(w)).select(*key, "pos", "before", "token")
    return _scored(pairs, key, tokens.agg(F.count_distinct("token").alias("v")), alpha)


def bigram_scores_of(docs: DataFrame, key: Sequence[str], words: Column, alpha: float = 1.0) -> DataFrame:
    """The same for rows (key) with their tokens as an array: pairs are made in the row, without a shuffle."""
    ws = docs.select(*key, words.alias("ws"))
    pair = lambda x, i: F.struct(F.get("ws", i - 1).alias("before"), x.alias("token"))
    pairs = ws.select(*key, F.posexplode(F.transform("ws", pair)).alias("pos", "p")).select(*key, "pos", "p.before", "p.token")
    return _scored(pairs, key, ws.select(F.explode_outer("ws").alias("token")).agg(F.count_distinct("token").alias("v")), alpha)


def _scored(pairs: DataFrame, key: Sequence[str], vocabulary: DataFrame, alpha: float) -> DataFrame:
    """Pairs (key, pos, before, token) with their scores.

    All pairs are shuffled once, by the first word and a part of its followers, so a frequent word is many tasks' work.
    Counting and scoring read that one exchange: both windows have one order and both
    parts the join's filters, so that the exchange is the same and reused. What travels besides is a row for each word and part.
    """
    w = Window.partitionBy("before", "salt", "token").orderBy(*key, "pos")
    dealt = pairs.withColumn("salt", F.pmod(F.hash("token"), F.lit(SALTS))).filter("before IS NOT NULL AND salt IS NOT NULL").repartition("before", "salt")
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = dealt.withColumns({"n": n, "place": F.row_number().over(w)}).filter("place = 1")
    after = seen.groupBy("before").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("kinds"),
        F.max("n").alias("most"),
        F.min(F.struct(-F.col("n"), "token"))["token"].alias("most_likely_token"),
        F.sum((F.col("n") + alpha) * F.log(F.col("n") + alpha)).alias("plogp"),
        F.collect_set("salt").alias("salts"),
    )
    model = after.crossJoin(F.broadcast(vocabulary))  # one row
    z = F.col("total") + alpha * F.col("v")
    unseen = F.col("v") - F.col("kinds")
    entropy = F.log(z) - (F.col("plogp") + unseen * (alpha * F.log(F.lit(alpha)) if alpha > 0 else 0.0)) / z
    model = model.select("before", F.explode("salts").alias("salt"), z.alias("z"), F.log((F.col("most") + alpha) / z).alias("logprob_max"), entropy.alias("entropy"), "most_likely_token")
    actual = F.log((F.col("n") + alpha) / F.col("z")).alias("logprob_actual")
    # Every pair was counted, so no row is lost here.
    return dealt.withColumn("n", n).join(model, ["before", "salt"]).select(*key, "pos", "token", actual, "logprob_max", "entropy", "most_likely_token")


def normal_token(c: Column) -> Column:
    """A token as artifact sequences compare it: without space, quotes and word starts around it."""
    return F.regexp_replace(F.regexp_replace(T.strip(c), '^"+|"+$', ""), f"^{T.WORD_START}+", "")


def plain_token(token: str) -> str:
    """The same for a token of a configuration."""
    return str(token).strip().strip('"').lstrip(T.WORD_START)


def trim_artifacts(tokens: Column, sequences: Sequence[Sequence[str]]) -> Column:
    """An array of tokens without any of the sequences at its end: from the end, the longest first, as often as one is there.

    Only the last tokens that belong to some sequence are gone through, once each at most.
    """
    kinds = sorted({tuple(map(plain_token, s)) for s in sequences if s}, key=lambda s: (-len(s), s))
    if not kinds:
        return tokens
    known = sorted({t for s in kinds for t in s})

    def kept(normal: Column) -> Column:
        n = F.size(normal)

        def peel(left: Column, _: Column) -> Column:
            out = left
            for s in reversed(kinds):
                there = (left >= len(s)) & (F.slice(normal, F.greatest(left - len(s) + 1, F.lit(1)), len(s)) == F.array(*map(F.lit, s)))
                out = F.when(there, left - len(s)).otherwise(out)
            return out

        odd = F.array_position(F.transform(F.reverse(normal), lambda x: x.isin(*known)), False)
        return T.bound(F.when(odd > 0, (odd - 1).cast("int")).otherwise(n), lambda run: F.when(run > 0, F.aggregate(F.sequence(F.lit(1), run), n, peel)).otherwise(n))

    return F.slice(tokens, F.lit(1), T.bound(F.transform(tokens, normal_token), kept))


def prompt_length(tokens: Column, prompts: Sequence[Sequence[str]]) -> Column:
    """Tokens of the first configured sequence that the text begins with; 0 if none does."""
    bare = F.transform(tokens, lambda x: F.regexp_replace(T.strip(x), '^"+|"+$', ""))
    out = F.lit(0)
    for p in reversed([list(p) for p in prompts if p]):
        out = F.when(F.slice(bare, 1, len(p)) == F.array(*map(F.lit, p)), len(p)).otherwise(out)
    return out


def section_perplexity(scores: DataFrame, key: Sequence[str], whole: DataFrame | None = None) -> DataFrame:
    """exp of the negative mean log probability of the scored tokens; null scores count in the divisor, none at all gives null.

    A section's first token has no score, so it isn't among them. `whole` (key) adds the sections without any row, as null.
    """
    out = scores.groupBy(*key).agg(F.when(F.count("logprob_actual") > 0, F.exp(-F.sum("logprob_actual") / F.count(F.lit(1)))).alias("perplexity"))
    return out if whole is None else whole.select(*key).join(out, list(key), "left")


def sentence_perplexity(scores: DataFrame, key: str, prompt: Column | None = None) -> DataFrame:
    """key, sentence_index, perplexity; index 0 is the prompt, null without one.

    The prompt is the first so many scored tokens: those from place 1 on. A sentence ends after a token that holds a full
    stop. Those with at most one token that isn't punctuation are left out before the rest is numbered from 1.
    """
    p = scores.select(key, "pos", "logprob_actual", F.contains("token", F.lit(".")).alias("stop"), (~T.is_punctuation_token("token")).alias("word"), (F.col("pos") <= (prompt if prompt is not None else F.lit(0))).alias("in_prompt"))
    # The prompt is a sentence of its own before the others: one shuffle of the scores by key serves all that follows.
    p = p.withColumn("sentence", F.when(F.col("in_prompt"), -1).otherwise(starts_after(F.col("stop") & ~F.col("in_prompt"), [key], "pos")))
    value = F.exp(-F.sum("logprob_actual") / F.count(F.lit(1)))
    found = p.groupBy(key, "sentence").agg(F.sum(F.col("word").cast("int")).alias("words"), F.when(F.count("logprob_actual") > 0, value).alias("perplexity"))
    body = F.when((F.col("sentence") >= 0) & (F.col("words") > 1), F.struct("sentence", "perplexity"))
    rows = found.groupBy(key).agg(F.max(F.when(F.col("sentence") < 0, F.col("perplexity"))).alias("head"), F.sort_array(F.collect_list(body)).alias("body"))
    parts = F.concat(F.array("head"), F.transform("body", lambda x: x["perplexity"]))
    return rows.select(key, F.posexplode(parts).alias("sentence_index", "perplexity")).withColumn("sentence_index", F.col("sentence_index").cast("long"))
