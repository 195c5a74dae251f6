"""JSON and fenced-block parsing as column expressions."""

from __future__ import annotations

import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "tool string, args string"
# Commands that only read.
READERS = ("ls", "cat", "head", "tail", "wc", "grep", "rg", "find", "tree", "file", "stat", "du", "pwd", "sort", "uniq", "cut", "git")
GIT_READERS = ("log", "show", "diff", "status", "branch", "blame", "ls-files")


def decode_list(data: Column) -> Column:
    """A JSON list of strings; bad JSON and null are the empty list."""
    return F.coalesce(F.from_json(data, "array<string>"), F.array().cast("array<string>"))


def encode_list(items: Column) -> Column:
    return F.to_json(items)


def fenced_blocks(text: Column, lang: str = "[A-Za-z0-9_+-]*") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)```{lang}[ \\t]*\\n(.*?)```"), F.lit(1)), F.trim)


def tool_call(text: Column) -> Column:
    """struct(tool, args as JSON) of the first fenced block, or else the whole text, that is an object with a tool; null if none is."""
    tried = F.concat(fenced_blocks(text), F.array(F.trim(text)))
    got = F.transform(tried, lambda b: F.struct(F.get_json_object(b, "$.tool").alias("tool"), F.coalesce(F.get_json_object(b, "$.args"), F.lit("{}")).alias("args")))
    return F.try_element_at(F.filter(got, lambda c: c["tool"].isNotNull()), F.lit(1))


def shell_command(text: Column) -> Column:
    """The first shell block, without prompt signs, comments and empty lines; null if there is none."""
    block = F.try_element_at(fenced_blocks(text, "(?:sh|bash|shell|zsh|console)"), F.lit(1))
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, "^\\s*[$>] ", "")))
    return F.nullif(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), "\n"), F.lit(""))


def _ms(text: Column, path: str) -> Column:
    return F.floor(F.get_json_object(text, path).cast("double") / 1e6).cast("long")


def ndjson_line(text: Column) -> Column:
    """A line of a newline-delimited chat stream: delta, done, token counts, duration in ms (from ns)."""
    return F.struct(F.get_json_object(text, "$.message.content").alias("delta"), F.coalesce(F.get_json_object(text, "$.done").cast("boolean"), F.lit(False)).alias("done"), F.get_json_object(text, "$.prompt_eval_count").cast("long").alias("prompt_tokens"), F.get_json_object(text, "$.eval_count").cast("long").alias("completion_tokens"), _ms(text, "$.total_duration").alias("duration_ms"))


def sse_line(text: Column) -> Column:
    """A line of a server-sent chat stream: delta, done, token counts; null for lines that carry no data."""
    data = F.trim(F.regexp_replace(text, "^data:", ""))
    return F.when(text.startswith("data:"), F.struct(F.get_json_object(data, "$.choices[0].delta.content").alias("delta"), (data == "[DONE]").alias("done"), F.get_json_object(data, "$.usage.prompt_tokens").cast("long").alias("prompt_tokens"), F.get_json_object(data, "$.usage.completion_tokens").cast("long").alias("completion_tokens"), F.lit(None).cast("long").alias("duration_ms")))


def model_names(text: Column) -> Column:
    """Names of a model list in either of the two layouts ({"models":[{"name"}]}, {"data":[{"id"}]})."""
    tags = F.from_json(text, "models array<struct<name:string>>, data array<struct<id:string>>")
    return F.filter(F.concat(F.coalesce(F.transform(tags["models"], lambda m: m["name"]), F.array().cast("array<string>")), F.coalesce(F.transform(tags["data"], lambda m: m["id"]), F.array().cast("array<string>"))), lambda x: x.isNotNull())


def model_matches(name: Column, wanted: Column) -> Column:
    """Equal, or equal but for a tag that one of them leaves out."""
    return (name == wanted) | (F.substring_index(name, ":", 1) == wanted) | (name == F.substring_index(wanted, ":", 1)) & ~name.contains(":")


def last_user(messages: Column) -> Column:
    """Content of the last message of role user in an array of (role, content)."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def prior_users(messages: Column, n: int) -> Column:
    """Contents of up to n user messages before the last one, oldest first."""
    said = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    before = F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0)))
    return F.slice(before, F.greatest(F.size(before) - n, F.lit(0)) + 1, n)


def supersede_args(text: Column) -> Column:
    """struct(loser, winner); null unless both are named and differ."""
    a, b = F.trim(F.get_json_object(text, "$.loser_id")), F.trim(F.get_json_object(text, "$.winner_id"))
    return F.when((a != "") & (b != "") & (a != b), F.struct(a.alias("loser_id"), b.alias("winner_id")))


def reads_only(command: str) -> bool:
    """Whether a shell command is a single call of a program that only reads, inside the current folder."""
    if any(x in command for x in (";", "|", "&", ">", "<", "`", "$(", "\n")):
        return False
    try:
        words = shlex.split(command)
    except ValueError:
        return False
    if not words or words[0] not in READERS or any(w.startswith("/") or ".." in w.split("/") for w in words[1:]):
        return False
    if words[0] == "git" and (len(words) < 2 or words[1] not in GIT_READERS):
        return False
    return not (words[0] == "find" and any(w in ("-exec", "-execdir", "-delete", "-ok", "-fprint") for w in words))
