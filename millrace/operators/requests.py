"""Requests to a model as JSON lines, and what comes back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import truthy

RESULT = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>, error struct<code: string, message: string>"


def labelled_lines(**parts: Column) -> Column:
    """Lines "Label: value" of the parts that are set, label by keyword."""
    return F.concat_ws("\n", *[F.when(truthy(c.cast("string")), F.concat(F.lit(k.replace("_", " ") + ": "), c)) for k, c in parts.items()])


def chat_request(custom_id: Column, user: Column, system: str | None = None, max_tokens: int = 512, model: str | None = None, tools: list[dict] | None = None, json_format: bool = False) -> Column:
    """One request as a JSON line; fields that are null, and options that aren't given, are left out. With tools, the model may choose one."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(*([message("system", F.lit(system))] if system else []), message("user", user))
    parts = [messages.alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens")]
    if model:
        parts.insert(0, F.lit(model).alias("model"))
    if json_format:
        parts.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    if tools:
        parts += [F.from_json(F.lit(json.dumps(tools)), F.schema_of_json(F.lit(json.dumps(tools)))).alias("tools"), F.lit("auto").alias("tool_choice")]
    body = F.struct(*parts)
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def embedding_request(custom_id: Column, text: Column, model: str | None = None) -> Column:
    """One request for a text's embedding as a JSON line."""
    body = F.struct(*([F.lit(model).alias("model")] if model else []), text.alias("input"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")))


def training_messages(talks: DataFrame, turns: str, score: str, system: str, roles: dict[str, str], least: float = 3.5) -> DataFrame:
    """talks with ``messages``: turns of the known roles under their new names, behind a system row; a talk of low or no score, or without turns, is left out."""
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    kept = F.filter(F.col(turns), lambda t: t["role"].isin(list(roles)))
    mapped = F.transform(kept, lambda t: F.struct(F.element_at(names, t["role"]).alias("role"), t["content"].alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    x = talks.where(F.coalesce(F.col(score), F.lit(0.0)) >= least).withColumn("messages", F.concat(first, mapped))
    return x.where(F.size("messages") > 1)


def content(response: str = "response") -> Column:
    """The reply's text; null where any level is missing."""
    return F.get(F.col(f"{response}.body.choices"), F.lit(0)).getField("message").getField("content")


def status(response: str = "response", error: str = "error") -> Column:
    """error, no_choices, empty or ok."""
    choices = F.col(f"{response}.body.choices")
    return F.when(F.col(error).isNotNull(), "error").when(F.coalesce(F.size(choices), F.lit(0)) < 1, "no_choices").when(~truthy(content(response)), "empty").otherwise("ok")


def usage(results: DataFrame, *by: str) -> DataFrame:
    """Requests and tokens by group and over all groups (null keys: all), missing counts 0."""
    t = lambda c: F.sum(F.coalesce(F.col(f"response.body.usage.{c}"), F.lit(0)))
    return results.rollup(*by).agg(F.count("*").alias("requests"), t("prompt_tokens").alias("prompt_tokens"), t("completion_tokens").alias("completion_tokens"))
