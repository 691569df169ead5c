"""What surrounds a model call: bounded contexts, message lists, and the clean-up of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment import config as C
from parchment.functions.text import strip

# What ends a turn, and the phrase of an answer without information.
TURN_ENDS = ["<|im_end|>", "</s>", "<end_of_turn>", "<turn|>", "<|turn>", "<eos>"]
NO_INFORMATION = r"(?iu)\s*[-–•]?\s*(?:dazu\s+)?enthalten\s+die\s+dokumente\s+keine\s+(?:konkrete\s+)?angabe[.…]*\s*$"
#: Parts of the names of models that embed and don't write.
EMBEDDERS = ["minilm", "e5-", "-e5", "embed", "bge", "gte-", "nomic", "sentence"]
# End of fixed values.


def context_text(contexts: Column) -> Column:
    """The first six of array<struct<source,content>> as one text, each cut to its share where they are too long together."""
    first = F.slice(contexts, 1, C.CONTEXTS)
    total = F.aggregate(first, F.lit(0), lambda a, c: a + F.length(F.coalesce(c["content"], F.lit(""))))
    share = F.when(total <= C.PROMPT_BUDGET, total).otherwise(F.greatest(F.lit(C.LEAST_CONTEXT), F.floor(F.lit(C.PROMPT_BUDGET) / F.greatest(F.size(first), F.lit(1))).cast("int")))
    source = lambda c: F.when(F.coalesce(c["source"], F.lit("")) == "", "DOK").otherwise(c["source"])
    parts = F.transform(first, lambda c: F.concat(F.lit("["), source(c), F.lit("]\n"), F.substring(F.coalesce(c["content"], F.lit("")), F.lit(1), share)))
    return F.array_join(parts, "\n\n---\n\n")


def history_tail(conversations: DataFrame, with_context: bool = False) -> DataFrame:
    """(conv_id, turn, role, content): the last 4 turns, cut to 400 characters; 2 and 220 beside a context."""
    turns, chars = (2, 220) if with_context else (4, 400)
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = conversations.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= turns)
    return rows.select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("content"))


def messages(system: Column, history: Column, prompt: Column, context: Column) -> Column:
    """array<struct<role,content>>: system, history, and the question with its documents, if any."""
    asked = F.when(context != "", F.concat(F.lit("Dokumente:\n\n"), context, F.lit("\n\n---\nFrage: "), prompt)).otherwise(prompt)
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.concat(one("system", system), history, one("user", asked))


def clean_answer(raw: Column, thinking: bool = False) -> Column:
    """An answer without its reasoning, later turns, bold marks and headings, and without a closing phrase of no information."""
    close = "</think>"
    rest = F.when(raw.contains(close), strip(F.substring_index(raw, close, -1))).otherwise(F.lit("") if thinking else raw)
    rest = strip(F.regexp_replace(rest, r"(?s)<think>.*?</think>", ""))
    for mark in TURN_ENDS:
        rest = F.substring_index(rest, mark, 1)
    rest = F.regexp_replace(strip(rest), r"\*\*([^*]+)\*\*", "$1")
    rest = strip(F.regexp_replace(rest, r"(?m)^#{1,4}\s+", ""))
    bare = strip(F.regexp_replace(rest, NO_INFORMATION, ""))
    return F.when(rest.rlike(NO_INFORMATION) & (F.length(bare) >= 80), bare).otherwise(rest)


def embedding_text(text: Column, query: bool = False) -> Column:
    """What an embedding model is given; null for blank texts, which are skipped."""
    trimmed = strip(text)
    shown = F.concat(F.lit("query: "), F.substring(trimmed, 1, 400)) if query else F.concat(F.lit("passage: "), trimmed)
    return F.when(trimmed != "", shown)


def shard_chain(files: DataFrame, keys: list[str], number: str, size: str, most: int = 63) -> DataFrame:
    """Of numbered shards of each key, those of the chain 1, 2, ... up to the first gap: how many, their total and largest size."""
    order = Window.partitionBy(*keys).orderBy(number)
    chain = files.where(F.col(number).between(1, most)).withColumn("__gap", F.col(number) - F.row_number().over(order)).where("__gap = 0")
    return chain.groupBy(*keys).agg(F.count("*").alias("shards"), F.sum(size).alias("total"), F.max(size).alias("largest"))


def choose_variant(variants: DataFrame, key: str, preference: list[str], budget: int, largest: int, least: int = 100 * 1024 * 1024) -> DataFrame:
    """Of (key, dtype, total, largest), the first in order of preference that is large enough to be real and fits budget and buffer."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("dtype"))
    fits = variants.where((rank > 0) & (F.col("total") >= least) & (F.col("total") <= budget) & (F.col("largest") <= largest))
    return fits.groupBy(key).agg(F.min_by("dtype", rank).alias("dtype"), F.min_by("total", rank).alias("total"))


def decode_rate(tokens: DataFrame, key: str, at: str, began: Column) -> DataFrame:
    """(key, tokens, ttft, rate): seconds to the first token, and tokens a second up to the last one; more than one token."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    out = tokens.groupBy(key).agg(F.count("*").alias("tokens"), F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.min(F.unix_micros(began.cast("timestamp")) / 1e6).alias("began"))
    return out.where("tokens > 1").select(key, "tokens", F.round(F.col("first") - F.col("began"), 2).alias("ttft"), F.round(F.col("tokens") / F.greatest(F.lit(0.001), F.col("last") - F.col("first")), 8).alias("rate"))


def writers(models: DataFrame, name: str = "name") -> DataFrame:
    """The models whose names don't say that they embed, in order of name."""
    low = F.lower(name)
    return models.where(~F.exists(F.array(*map(F.lit, EMBEDDERS)), lambda m: F.contains(low, m))).orderBy(name)


def choose_split(variants: DataFrame, key: str, part: str, preference: list[str], budget: int, largest: int, least: int = 100 * 1024 * 1024) -> DataFrame:
    """(key, decoder, embedder, dtype, total, complete) of (key, part, dtype, total, largest), part being decoder, embedder or whole.

    A model with a usable decoder is a split one: its embedder takes the first kind that fits what the decoder leaves of the
    budget, and without one the model is incomplete. Others take the first usable whole model.
    """
    chosen = lambda which: choose_variant(variants.where(F.col(part) == which), key, preference, budget, largest, least)
    decoder = chosen("decoder").select(key, F.col("dtype").alias("decoder"), F.col("total").alias("__of"))
    whole = chosen("whole").select(key, F.col("dtype").alias("__whole"), F.col("total").alias("__all"))
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("dtype"))
    beside = variants.where(F.col(part) == "embedder").join(decoder, key).where((rank > 0) & (F.col("total") <= budget - F.col("__of")) & (F.col("largest") <= largest))
    beside = beside.groupBy(key).agg(F.min_by("dtype", rank).alias("embedder"), F.min_by("total", rank).alias("__beside"))
    rows = variants.select(key).distinct().join(decoder, key, "left").join(beside, key, "left").join(whole, key, "left")
    split = F.col("decoder").isNotNull()
    total = F.when(split, F.col("__of") + F.col("__beside")).otherwise(F.col("__all"))
    return rows.select(key, "decoder", "embedder", F.when(~split, F.col("__whole")).alias("dtype"), total.alias("total"), total.isNotNull().alias("complete"))
