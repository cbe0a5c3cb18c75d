"""Column functions over model ids: kind, tags, provider, resolution and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import contains_any

#: Ids of embedding and of reranking models.
EMBEDDING = r"(?i)(?:^text-|embed|bge-|e5-|LLM2Vec|retrieval|uae-|gte-|jina-clip|jina-embeddings|voyage-|minilm|qwen.*embedding)"
RERANKING = r"(?i)(?:rerank|re-rank|re-ranker|re-ranking|retrieval|retriever)"
#: Words by which the provider is told, in the order in which they are tried; all others are openai.
PROVIDERS = [(["doubao"], "doubao"), (["moonshot", "kimi"], "moonshot"), (["zhipu", "glm"], "zhipu"), (["minimax"], "minimax"), (["qwen", "alibaba"], "openai")]
PROVIDER_PREFIXES = [(["gpt", "text-embedding"], "openai"), (["claude"], "anthropic"), (["gemini"], "gemini")]
#: Lower-case ids by which a tag is told.
VISION = r"vision|vl|^gpt-(4o|4-turbo|4\.1|5)|^(o3|o4)(-|$)|^claude-(3|sonnet-4|opus-4|haiku-3|haiku-4)|^gemini-(2|[3-9])|^(qwen-vl|qwen-max)|^(grok-vision|grok-4)|^abab6\.5|^(doubao-1\.5-pro|doubao-seed)|^moonshot-v1"
REASONING = r"reasoning|think|reasoner|\b(o1|o3|o4)\b|gpt-4\.5|gpt-5|glm-4\.[5-9]|minimax-m2|deepseek-r"
CHINESE = "chinese|zh|multilingual"
#: Older ids and what replaces them, and embedding models in the order in which they are preferred.
REPLACED = {"qwen/qwen-embedding-8b": "Qwen/Qwen3-Embedding-8B", "text-embedding-ada-002": "text-embedding-3-small", "embo-01": "minimax-embedding-v2"}
PREFERRED = ["BAAI/bge-m3", "Qwen/Qwen3-Embedding-8B", "text-embedding-3-small", "text-embedding-3-large", "text-embedding-v3", "minimax-embedding-v2", "deepseek-embedding-v1", "moonshot-embedding-v1", "embedding-3", "Qwen/Qwen-Embedding-8B"]


def is_rerank_model(model: Column) -> Column:
    return model.rlike(RERANKING)


def is_embedding_model(model: Column) -> Column:
    return model.rlike(EMBEDDING) & ~is_rerank_model(model)


def model_type(model: Column, chosen: Column, disabled: Column) -> Column:
    """``chosen`` by the user, if that is not null; else by the id, kinds in the array ``disabled`` left out; ``chat`` otherwise."""
    allowed = lambda kind: ~F.coalesce(F.array_contains(disabled, kind), F.lit(False))
    return F.coalesce(chosen, F.when(allowed("rerank") & is_rerank_model(model), "rerank").when(allowed("embedding") & is_embedding_model(model), "embedding").otherwise("chat"))


def model_tags(model: Column) -> Column:
    """Of free, vision, chinese_optimized and reasoning those that an id tells, in this order."""
    low = F.lower(model)
    tag = lambda pattern, name: F.when(low.rlike(pattern), name)
    return F.array_compact(F.array(tag("free", "free"), tag(VISION, "vision"), tag(CHINESE, "chinese_optimized"), tag(REASONING, "reasoning")))


def provider_of(model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    out = F.when(F.lit(False), "")
    for words, provider in PROVIDERS:
        out = out.when(contains_any(low, words), provider)
    for prefixes, provider in PROVIDER_PREFIXES:
        for p in prefixes:
            out = out.when(F.startswith(low, F.lit(p)), provider)
    return out.otherwise("openai")


def resolved(asked: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """(asked, key): for ids ``asked``, plain or ``provider:model``, the key in ``registry`` (key, model_name, provider, base_url).

    An id that is a key as it stands comes first, then a model part that is one, then the first entry by key whose
    name is the model part, whose provider is one of the provider's ``aliases`` (name, provider, url_hint) and whose
    URL holds the hint.  All joins are by equality.
    """
    parts = asked.select("asked", F.when(F.contains("asked", F.lit(":")), F.split("asked", ":", 2)[0]).alias("name"), F.when(F.contains("asked", F.lit(":")), F.split("asked", ":", 2)[1]).alias("part")).distinct()
    keys = registry.select(F.col("key").alias("k"))
    whole = parts.join(keys, parts["asked"] == F.col("k")).select("asked", F.lit(0).alias("tier"), F.col("k").alias("key"))
    part = parts.join(keys, parts["part"] == F.col("k")).select("asked", F.lit(1).alias("tier"), F.col("k").alias("key"))
    named = registry.select("key", F.coalesce("model_name", "key").alias("part"), "provider", F.coalesce("base_url", F.lit("")).alias("url"))
    hinted = parts.join(aliases, "name").join(named, ["part", "provider"]).where(F.contains("url", F.coalesce("url_hint", F.lit(""))))
    all_ = whole.union(part).union(hinted.select("asked", F.lit(2), "key"))
    return parts.select("asked").join(all_.groupBy("asked").agg(F.min(F.struct("tier", "key"))["key"].alias("key")), "asked", "left")


def fallback_model(available: DataFrame, preferred: DataFrame) -> DataFrame:
    """(user, model): for each user's models (user, model, place) the one to fall back to for (user, preferred).

    First what replaces an older id, then one that ends with the preferred id, then by PREFERRED, then any embedding
    model; the first by place within each.  Users without one are left out.
    """
    low = F.lower("model")
    wanted = F.lower(F.trim(F.coalesce("preferred", F.lit(""))))
    new = F.element_at(F.create_map(*[F.lit(x) for k, v in REPLACED.items() for x in (k, v.lower())]), wanted)
    order = F.element_at(F.create_map(*[x for i, m in enumerate(PREFERRED) for x in (F.lit(m.lower()), F.lit(i))]), low)
    tier = F.when(low == new, F.lit(0)).when((wanted != "") & F.endswith(low, wanted), F.lit(1)).when(order.isNotNull(), order + 2).when(is_embedding_model(F.col("model")), F.lit(2 + len(PREFERRED)))
    rows = available.join(preferred, "user", "left").withColumn("tier", tier).where("tier is not null")
    best = F.row_number().over(Window.partitionBy("user").orderBy("tier", "place"))
    return rows.withColumn("n", best).where("n = 1").select("user", "model")


def key_pool(keys: Column) -> Column:
    """The keys of a comma-separated pool, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(keys, ","), lambda k: F.trim(k)), lambda k: k != "")


def first_filled(*values: Column) -> Column:
    """The first of several spellings of a field that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])
