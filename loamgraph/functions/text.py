"""Column expressions for names, tokens, token costs and rendered text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the specification.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are",
    "was", "were", "be", "by", "with", "as", "at", "that", "this", "it", "its",
    "from", "into", "what", "which", "who", "whom", "how", "when", "where",
    "do", "does", "did", "has", "have", "had", "?",
]
VACUOUS_CJK = ["信息碎片", "综合信息", "杂项", "其他", "未分类"]
VACUOUS_ENGLISH = [
    "miscellaneous", "uncategorized", "various topics",
    "various concepts", "general information", "comprehensive",
    "assorted", "catch-all", "information cluster", "grab bag",
    "other concepts", "mixed topics",
]
#: Tokens a CJK character takes, and other characters a token takes, by model family.
FAMILIES = {"claude": (1.7, 3), "gpt": (1.7, 3), "unknown": (1.7, 3), "deepseek": (1.3, 4), "ollama": (1.3, 4)}
#: Purposes for which nodes other than the focus are rendered by their summary.
SUMMARY_PURPOSES = {"decide_directions", "decide_hub", "navigate_hub", "extract_concepts"}
SEPARATORS = r"[\s,.;:!?　，。；！？]+"
CJK = "一-鿿"
EMPTY = "(无)"
RECALL_HEADER = "最近发生的事件（时间倒排）"


def cjk_length(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))


def estimate_from_lengths(cjk: Column, length: Column, family: str = "unknown") -> Column:
    """Token estimate of a text from its CJK and total lengths; it isn't additive, so lengths are
    summed first. Empty texts cost nothing, others one token at least."""
    per_cjk, divisor = FAMILIES.get(family, FAMILIES["unknown"])
    other = F.floor((length - cjk) / divisor)
    return F.when(length > 0, F.greatest(F.lit(1), F.floor(cjk * per_cjk + other).cast("int"))).otherwise(0)


def estimate(text: Column, family: str = "unknown") -> Column:
    text = F.coalesce(text, F.lit(""))
    return estimate_from_lengths(cjk_length(text), F.length(text), family)


def estimate_text(text: str, family: str = "unknown") -> int:
    """The same estimate of a Python string, for folds."""
    per_cjk, divisor = FAMILIES.get(family, FAMILIES["unknown"])
    cjk = sum(CJK[0] <= c <= CJK[-1] for c in text)
    return max(1, int(cjk * per_cjk + (len(text) - cjk) // divisor)) if text else 0


def rendered_node(id: str, name: str, content: str | None) -> str:
    """The same as ``render_node`` of a focus, for folds."""
    body = content or ""
    return f"- {name} (id={id})" + (f"\n  {body}" if body not in ("", name) else "")


def tokens(text: Column) -> Column:
    """Pieces between separators; a piece of CJK only gives its characters and itself."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda p: p != "")
    parts = lambda p: F.when(p.rlike(f"^[{CJK}]+$"), F.concat(F.filter(F.split(p, ""), lambda c: c != ""), F.array(p))).otherwise(F.array(p))
    return F.flatten(F.transform(pieces, parts))


def token_set(text: Column) -> Column:
    """Distinct lower-cased tokens without stop words."""
    lower = F.transform(tokens(text), F.lower)
    return F.array_distinct(F.array_except(lower, F.array(*map(F.lit, STOP_WORDS))))


def overlap_score(query: Column, title: Column, body: Column) -> Column:
    """(2 * words shared with the title + words shared with the body) / query words; 0 without any."""
    shared = lambda other: F.size(F.array_intersect(query, other))
    return F.when(F.size(query) > 0, (2 * shared(title) + shared(body)) / F.size(query)).otherwise(F.lit(0.0))


def norm_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))


def cut_text(text: Column, most: int) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def event_name(text: Column) -> Column:
    name = cut_text(text, 40)
    return F.when(name == "", "ingest").otherwise(name)


def short_name(summary: Column, most: int = 40) -> Column:
    first = F.substring(F.split(F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", ""), r"\r?\n")[0], 1, most)
    return F.when(first == "", "hub").otherwise(first)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def summary_text(summary: Column, content: Column) -> Column:
    return F.coalesce(F.when(summary != "", summary), F.substring(content, 1, 200), F.lit(""))


def render_node(id: Column, name: Column, content: Column, summary: Column, purpose: str, focus: Column) -> Column:
    """``- name (id=...)`` and the indented body, which is left out where it equals the name."""
    short = summary_text(summary, content)
    full = F.coalesce(F.when(content != "", content), short)
    if purpose == "arbitrate":
        body = short
    elif purpose in SUMMARY_PURPOSES:
        body = F.when(focus, full).otherwise(short)
    else:
        body = full
    name = F.coalesce(name, F.lit(""))
    head = F.concat(F.lit("- "), name, F.lit(" (id="), id, F.lit(")"))
    return F.concat(head, F.when((body != "") & (body != name), F.concat(F.lit("\n  "), body)).otherwise(""))


def render_edge(source_name: Column, target_name: Column, source_id: Column, target_id: Column) -> Column:
    return F.concat(F.coalesce(source_name, source_id), F.lit(" — "), F.coalesce(target_name, target_id))


def render_event(position: Column, id: Column, ts: Column, name: Column, content: Column) -> Column:
    name, content = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    stamp = F.when(F.coalesce(ts, F.lit("")) != "", F.concat(F.lit("（"), ts, F.lit("）"))).otherwise("")
    body = F.when((content != "") & (content != name), F.concat(F.lit(" — "), content)).otherwise("")
    return F.concat(position.cast("string"), F.lit(". [id:"), id, F.lit("]"), stamp, F.lit(" "), name, body)


def is_vacuous(summary: Column) -> Column:
    """A hub's label that is missing, too short, or of a kind that gathers anything."""
    plain = F.coalesce(summary, F.lit(""))
    lower = F.lower(plain)
    hits = [plain.contains(p) for p in VACUOUS_CJK] + [lower.contains(p) for p in VACUOUS_ENGLISH]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return (F.length(F.trim(plain)) < 3) | found


def ranked_indices(raw: Column, most: int) -> Column:
    """0-based indices from ``3, 1,7`` without repeats; ``none`` gives none; out of range ones go."""
    parts = F.filter(F.split(F.trim(F.coalesce(raw, F.lit(""))), r"[,，\s]+"), lambda p: p.rlike(r"^\d{1,9}$"))
    numbers = F.transform(parts, lambda p: p.cast("int"))
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n.between(1, most)), lambda n: n - 1))


def chunk_body(title: Column, body: Column, max_chunks: int | None = None, most: int = 1200) -> Column:
    """Paragraphs; longer ones as sentences packed up to ``most`` characters; the first gets the title.

    All of them, or the first ``max_chunks``; the reference takes 8.
    """
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n+"), strip), lambda p: p != "")

    def packed(paragraph: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

        def step(state: Column, sentence: Column) -> Column:
            full = (state["buf"] != "") & (F.length(state["buf"]) + F.length(sentence) > most)
            done = F.when(full, F.concat(state["done"], F.array(strip(state["buf"])))).otherwise(state["done"])
            buf = F.concat(F.when(full, F.lit("")).otherwise(state["buf"]), F.lit(" "), sentence)
            return F.struct(done.alias("done"), buf.alias("buf"))

        folded = F.aggregate(F.split(paragraph, r"(?<=[.!?])\s+"), start, step, lambda s: F.concat(s["done"], F.array(strip(s["buf"]))))
        return F.when(F.length(paragraph) > most, folded).otherwise(F.array(paragraph))

    chunks = F.filter(F.flatten(F.transform(paragraphs, packed)), lambda c: c != "")
    chunks = chunks if max_chunks is None else F.slice(chunks, 1, max_chunks)
    return F.transform(chunks, lambda c, i: F.when(i == 0, F.concat(title, F.lit(": "), c)).otherwise(c))
