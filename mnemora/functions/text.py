"""Text functions as column expressions.

Everything here stays in the JVM. Token lists are arrays; `toks` arguments are columns that tokenize() made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, cue words and verbs of the text rules.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so that the their them then there these "
    "they this to up was we were what when where which who will with you your about all also am been can do does did get got how just like more out over some than very"
).split()
IMPORTANCE_CUES = ("always", "never", "remember", "important", "must", "prefer", "preference", "deadline", "password", "key", "decided", "decision", "rule")
SWITCH_VERBS = ("switched switching switch migrated migrating migrate moved moving move changed changing change upgraded downgraded rotated rotate replaced replacing replace updated").split()
TYPE_BASE = {"foundation": 0.90, "preference": 0.75, "procedural": 0.70, "semantic": 0.65, "episodic": 0.50, "raw_event": 0.30, "archive": 0.10}
CODE_MARKS = ("```", "fn ", "class ", "import ", "use ", "const ", "let ", "=>")
LOG_MARKS = ("stack trace", "exception", "traceback", " error ", "warn ")
ARTICLE_MARKS = ("abstract", "introduction", "references", "conclusion")
OBJECT_SKIP = ("love", "prefer", "hate", "want", "need")

_NO_WORD = "[^\\p{L}\\p{N}]+"
_EDGES = "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$"


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def canonicalize(text: Column) -> Column:
    return F.lower(normalize(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonicalize(text), 256)


def new_id(prefix: str, *parts: Column) -> Column:
    """An id that depends on its parts alone."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def is_stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of two or more bytes that aren't stop words; null text: null."""
    return F.filter(F.split(F.lower(text), _NO_WORD), lambda t: (F.octet_length(t) > 1) & ~is_stopword(t))


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines, without an empty one after a last line end."""
    return F.when(text == "", 0).otherwise(_count(text, "\n") + F.when(text.endswith("\n"), 0).otherwise(1))


def input_mode(text: Column) -> Column:
    low, n, lines = F.lower(text), F.char_length(text), line_count(text)
    code = _any(low, CODE_MARKS) | (low.contains("{") & low.contains("}"))
    log = _any(low, LOG_MARKS) | ((_count(low, ":") > 20) & (_count(low, "\n") > 8))
    rows = F.split(text, "\n")
    doc = (F.size(F.filter(rows, lambda r: F.ltrim(r).startswith("#"))) >= 2) | (F.size(F.filter(rows, lambda r: F.ltrim(r).startswith("- "))) >= 6)
    return (
        F.when(code & ((n > 300) | (lines > 6)), "code_block")
        .when(log, "log_dump")
        .when(_any(low, ARTICLE_MARKS) & (n > 1000), "article_draft")
        .when((n > 3000) | (doc & (n > 800)), "pasted_document")
        .when((n >= 500) | (lines > 8), "mixed_message")
        .otherwise("conversation_message")
    )


def is_long(mode: Column) -> Column:
    return ~mode.isin("conversation_message", "mixed_message")


def phrase_after(text: Column, cue: str) -> Column:
    """The lower-case phrase after the first `cue`, up to a sentence's or line's end; null if there is none."""
    low = F.lower(text)
    after = F.regexp_replace(F.substring_index(F.substring(low, F.locate(cue, low) + F.lit(len(cue)), F.char_length(low)), "\x00", 1), "^[\\s:,]+", "")
    got = F.trim(F.regexp_extract(after, "^([^.!?\\n;]*)", 1))
    return F.when(low.contains(cue) & (got != ""), got)


def first_object(phrase: Column) -> Column:
    """The first token of a phrase that isn't one of the wish verbs; null if there is none."""
    return F.try_element_at(F.filter(tokenize(phrase), lambda t: ~t.isin(*OBJECT_SKIP)), F.lit(1))


def active_scope(location: Column, project: Column, topic: Column) -> Column:
    return F.coalesce(F.concat(F.lit("location:"), location), F.concat(F.lit("project:"), project), F.concat(F.lit("topic:"), topic))


def chunks(text: Column, target: int = 550, overlap: int = 80) -> Column:
    """Array of texts of `target` words that overlap by `overlap`; a text of up to `target` words is one chunk, one without words none."""
    target = max(target, 80)
    step = target - min(overlap, target // 2)
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    n = F.size(words)
    last = lambda n: F.when(n <= target, F.lit(0)).otherwise(F.ceil((n - target) / F.lit(float(step))).cast("int"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), last(F.size(w))), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(target)), " "))
    return F.when(n > 0, once(words, cut)).otherwise(F.array().cast("array<string>"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: a lambda's argument isn't evaluated anew inside inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keywords(text: Column, most: int) -> Column:
    """The most frequent tokens, of equal ones the alphabetically first. Counts are lengths of runs of the sorted tokens."""

    def count(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return once(first, lambda f: F.transform(f, lambda at, k: F.struct((at - F.coalesce(F.get(f, k + 1), F.size(t))).alias("n"), F.get(t, at).alias("t"))))

    counted = once(F.array_sort(tokenize(text)), lambda t: F.when(F.size(t) > 0, F.transform(F.slice(F.array_sort(count(t)), 1, most), lambda s: s["t"])).otherwise(F.array().cast("array<string>")))
    return F.when(text.isNotNull(), counted)


def guess_topic(tags: Column, words: Column) -> Column:
    """What follows the first project: or topic: tag that isn't empty there, else the first keyword."""
    named = F.filter(tags, lambda t: (t.startswith("project:") & (t != "project:")) | (t.startswith("topic:") & (t != "topic:")))
    return F.coalesce(F.regexp_replace(F.try_element_at(named, F.lit(1)), "^(project|topic):", ""), F.try_element_at(words, F.lit(1)))


def initial_importance(text: Column, memory_type: Column, tags: Column) -> Column:
    low, base = F.lower(text), F.lit(0.5)
    for k, v in TYPE_BASE.items():
        base = F.when(memory_type == k, v).otherwise(base)
    for c in IMPORTANCE_CUES:
        base = base + F.when(low.contains(c), 0.05).otherwise(0.0)
    base = base + F.when(F.size(tags) > 0, 0.05).otherwise(0.0) - F.when(F.octet_length(text) < 16, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), base))


def flat_tokens(items: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), tokenize))


def _share(query: Column, words: Column) -> Column:
    query = F.array_distinct(query)
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, words)) / F.size(query)).otherwise(0.0)


def keyword_overlap(query: Column, content: Column, tags: Column, topic: Column, entities: Column) -> Column:
    """Share of the query's distinct tokens among those of content, tags (but session tags), topic and entities."""
    named = F.filter(tags, lambda t: ~t.startswith("session:"))
    words = F.concat(tokenize(content), flat_tokens(named), F.coalesce(tokenize(topic), F.array().cast("array<string>")), flat_tokens(entities))
    return _share(query, words)


def entity_overlap(query: Column, topic: Column, entities: Column) -> Column:
    return _share(query, F.concat(F.coalesce(tokenize(topic), F.array().cast("array<string>")), flat_tokens(entities)))


def raw_words(text: Column) -> Column:
    """Words without signs at their ends."""
    return F.filter(F.transform(F.split(text, "(?U)\\s+"), lambda w: F.regexp_replace(w, _EDGES, "")), lambda w: w != "")


def significant(low: Column) -> Column:
    return ~is_stopword(low) & ~low.isin(*SWITCH_VERBS) & low.rlike("[\\p{L}\\p{N}]") & ((F.char_length(low) >= 2) | low.rlike("\\p{N}"))


def value_like(word: Column) -> Column:
    return word.rlike("^\\p{Lu}") | word.rlike("\\p{N}")


def value_tokens(text: Column) -> Column:
    """Sorted distinct lower-case words that look like values (capitalised or with a digit)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(raw_words(text), lambda w: significant(F.lower(w)) & value_like(w)), F.lower)))


def first_significant_after(words: Column, start: Column) -> Column:
    """The first significant word from place `start` (1-based) on."""
    return F.try_element_at(F.filter(F.slice(words, start, F.size(words) + 1), lambda w: significant(F.lower(w))), F.lit(1))


def recurrence_terms(topic: Column, entities: Column) -> Column:
    both = F.concat(F.coalesce(entities, F.array().cast("array<string>")), F.array(topic))
    return F.array_distinct(F.transform(F.filter(both, lambda x: x.isNotNull() & (x != "")), F.lower))


def recurrence_multiplier(source: Column, tags: Column) -> Column:
    """0 for code and logs, 1 for parts of source documents, else 2."""
    return F.when(F.coalesce(source, F.lit("")).isin("code_block", "log_dump"), 0).when(F.exists(tags, lambda t: t.startswith("source_doc:")), 1).otherwise(2)


def same_subject(topic_a: Column, topic_b: Column, entities_a: Column, entities_b: Column) -> Column:
    return F.coalesce(topic_a == topic_b, F.lit(False)) | F.coalesce(F.arrays_overlap(entities_a, entities_b), F.lit(False))


def subject_codes(topic: Column, entities: Column) -> Column:
    """Numbers of which two rows of the same subject (same_subject) have one in common: 64-bit hashes of the topic and of each entity."""
    code = lambda kind, v: F.xxhash64(F.lit(kind), v)
    named = F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull())
    return F.concat(F.when(topic.isNotNull(), F.array(code("topic", topic))).otherwise(F.array().cast("array<bigint>")), F.transform(named, lambda e: code("entity", e)))


def estimate_tokens(text: Column) -> Column:
    return F.floor((F.char_length(text) + 3) / 4).cast("long")


def context_block(memories: Column) -> Column:
    """Lines `- [type] text` of an array of (memory_type, text) under a heading; empty for none."""
    lines = F.transform(memories, lambda m: F.concat(F.lit("- ["), m["memory_type"], F.lit("] "), m["text"]))
    return F.when(F.size(memories) > 0, F.concat(F.lit("Relevant memories:\n"), F.array_join(lines, "\n"))).otherwise("")


def wrap_message(text: Column, block: Column) -> Column:
    return F.when(block == "", text).otherwise(F.concat(block, F.lit("\n\n"), text))


def remembered(text: Column) -> Column:
    """Facts of the first fenced `remember` block: its lines without list signs, up to 300 characters each."""
    body = F.regexp_extract(text, "(?s)```remember\\s*\\n(.*?)```", 1)
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-*]\\s+", "")))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.substring(x, 1, 300))


def edge_phrase(edge_type: Column) -> Column:
    return F.when(edge_type == "sequence", "led to").when(edge_type == "co_occurred", "recalled with").when(edge_type == "semantic_similar", "related to").otherwise("linked to")


def render_path(texts: Column, edges: Column) -> Column:
    """`"a" —(phrase)→ "b"`: snippets of 60 characters joined by the edges' phrases; null unless all nodes of two or more have a text."""
    shown = F.transform(texts, lambda t, i: F.concat(F.when(i > 0, F.concat(F.lit("—("), edge_phrase(F.try_element_at(edges, i)), F.lit(")→ "))).otherwise(F.lit("")), F.lit('"'), F.trim(F.substring(t, 1, 60)), F.lit('"')))
    return F.when((F.size(texts) > 1) & ~F.exists(texts, lambda t: t.isNull()), F.array_join(shown, " "))


def is_local_url(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/]*@)?(\\[[^\\]]*\\]|[^:/?#]*)", 1))
    return host.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0")
