"""Text functions as Spark columns; pandas UDFs only for the fixpoint rewrites."""

from __future__ import annotations

import ast
import json
import re
import textwrap

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Comparisons and words that give a score away in notes; fixed values.
COMPARISONS = ("much better", "much worse", "slight improvement", "better than", "worse than", "the best", "outperforms", "winning", "regression")
SCORE_WORDS = ("accuracy", "acc", "score", "stderr", "metric", "test_acc")


def normalize(text: Column) -> Column:
    """Lower case, everything but letters, digits and ``_`` to a space, spaces collapsed."""
    t = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def words(normalized: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.array_remove(F.split(normalized, " "), "")


def gram_hashes(hashes: Column, n: int) -> Column:
    """A 64-bit hash of every n-gram, from the hashes of the words; a shorter text is one gram, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) <= n, F.array(F.xxhash64(hashes))).otherwise(many)


def shingles(w: Column, n: int) -> Column:
    """Distinct n-word shingles; a shorter text is one shingle, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))


def ngrams(w: Column, n: int) -> Column:
    """All n-word grams, repeats included; none for texts shorter than n."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scrub(text: Column) -> Column:
    """Scores out of a note: percent signs go, then comparisons, score words and numbers, in that order."""
    t = F.regexp_replace(text, "[%\uff05]", "")
    t = F.regexp_replace(t, r"(?iU)\b(" + "|".join(COMPARISONS) + r")\b", "[redacted]")
    t = F.regexp_replace(t, r"(?iU)\b(" + "|".join(SCORE_WORDS) + r")\b", "[score]")
    return F.regexp_replace(t, r"(?U)\b\d+(?:\.\d+)?\b", "[n]")


def collapse(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def short_field(text: Column, n: int = 200) -> Column:
    """One scrubbed line of at most ``n`` characters; null and empty give an empty text."""
    return F.coalesce(F.substring(collapse(scrub(collapse(text))), 1, n), F.lit(""))


def strategy(hypothesis: Column, notes: Column, n: int = 120) -> Column:
    """The first line with content of the hypothesis, else of the notes without their ``# exp_N`` title."""
    title = r"^#\s*exp_\d+\s*$"
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)^#+\s*", "")
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), r"\r?\n")
    first = lambda a: F.try_element_at(F.filter(F.transform(a, clean), lambda x: x != ""), F.lit(1))
    body = F.filter(lines(notes), lambda x: ~F.trim(x).rlike(title))
    return F.coalesce(F.substring(F.coalesce(first(lines(hypothesis)), first(body)), 1, n), F.lit(""))


def parent_value(section: Column) -> Column:
    """The first line with content of a Parent section, without bullet, ``#`` and trailing comment."""
    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?U)^[\s]+|[\s]+$", "")
        x = F.regexp_replace(F.regexp_replace(x, r"^-+\s*", ""), r"^#+\s*", "")
        return F.trim(F.regexp_replace(x, r"\s+#.*$", ""))

    return F.try_element_at(F.filter(F.transform(F.split(section, r"\r?\n"), clean), lambda x: x != ""), F.lit(1))


def cross_parent(value: Column) -> Column:
    """Whether a parent is a well-formed ``agent/exp_N``."""
    return value.rlike(r"^[A-Za-z0-9._\-]+/exp_\d+$")


def redact(text: Column, secret: str, mark: str = "[REDACTED]") -> Column:
    """The exact secret, then its ten-character prefix with the rest of the token."""
    t = F.replace(text, F.lit(secret), F.lit(mark))
    return F.regexp_replace(t, re.escape(secret[:10]).replace("\\-", "-") + r"[A-Za-z0-9_-]*", re.escape(mark) if "$" in mark else mark)


def around(text: Column, pattern: str, reach: int = 50) -> Column:
    """Up to ``reach`` characters on both sides of the first place of ``pattern``, line breaks spelled out; null without one."""
    at = F.locate(pattern, text)
    begin = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.replace(F.substring(text, begin, at + F.lit(reach) - begin), F.lit("\n"), F.lit("\\n")))


def preview(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def path_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[/:\[\]]", "_")


def model_alias(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def cache_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def strip_think(text: Column, need_close: bool) -> Column:
    """Drop a leading think block; ``need_close`` keeps texts without the closing tag whole."""
    after = F.substring_index(text, "</think>", -1)
    cond = text.startswith("<think>")
    if need_close:
        return F.when(cond & text.contains("</think>"), F.trim(F.element_at(F.split(text, "</think>", 2), 2))).otherwise(text)
    return F.when(cond, F.trim(after)).otherwise(text)


def verdict(text: Column, patterns: tuple[str, ...] = (r"\[\[([AB<>=]+)\]\]", r"\[([AB<>=]+)\]")) -> Column:
    """Upper-case the text; the last match of the first pattern that matches."""
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(F.upper(text), F.lit(p), 1), F.lit(-1)) for p in patterns])


def markdown_counts(text: Column) -> Column:
    """Headers by level, list items and bold spans, fenced blocks left out."""
    t = F.regexp_replace(text, r"(?s)```.*?```", "")
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), 0))
    return F.struct(*[n("(?m)^#{%d}[ \t]" % k).alias(f"h{k}") for k in range(1, 7)],
                    n(r"(?m)^[ \t]*[0-9]+\.[ \t]").alias("ordered"), n(r"(?m)^[ \t]*[-*+][ \t]").alias("unordered"),
                    n(r"\*\*[^*\n]+\*\*").alias("bold_stars"), n(r"__[^_\n]+__").alias("bold_bars"))


def seconds_of(hms: Column) -> Column:
    """``H:M:S`` to seconds; minutes or seconds of 60 or more, or another form, to null."""
    p = r"^\s*([0-9]+):([0-9]{1,2}):([0-9]{1,2})\s*$"
    h, m, s = (F.try_to_number(F.regexp_extract(hms, p, k), F.lit("999999")).cast("long") for k in (1, 2, 3))
    return F.when(hms.rlike(p) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def hms_of(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def numeric(text: Column) -> Column:
    """A number as Python's ``float`` reads one, else null (no type suffixes)."""
    return F.when(~F.trim(text).rlike("[dDfF]$") | F.lower(F.trim(text)).rlike("^[+-]?inf$"), text.try_cast("double"))


def render_chat(messages: Column) -> Column:
    """ChatML text of an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def render_turns(messages: Column, prompt: bool = False) -> Column:
    """Turn-marked text: assistants are called model, a leading system text goes before the first turn's own text.

    With ``prompt`` the next turn is opened."""
    lead = F.get(messages, F.lit(0))
    system = lead["role"] == "system"
    rest = F.when(system, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    role = lambda m: F.when(m["role"] == "assistant", "model").otherwise(m["role"])
    prefix = F.when(system, F.concat(lead["content"], F.lit("\n\n"))).otherwise(F.lit(""))
    turn = lambda m, i: F.concat(F.lit("<start_of_turn>"), role(m), F.lit("\n"), F.when(i == 0, prefix).otherwise(F.lit("")), F.trim(m["content"]), F.lit("<end_of_turn>\n"))
    tail = "<start_of_turn>model\n" if prompt else ""
    return F.concat(F.lit("<bos>"), F.array_join(F.transform(rest, turn), ""), F.lit(tail))


def render_thinking(messages: Column, prompt: bool = False) -> Column:
    """ChatML text whose assistant turns after the last question keep their thoughts, and lose them before it.

    The last question is the last user turn that is no tool response; tool turns in a row share one user turn."""
    n = F.size(messages)
    indexed = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), i.alias("i")))
    asks = lambda m: (m["role"] == "user") & ~(m["content"].startswith("<tool_response>") & m["content"].endswith("</tool_response>"))
    last = F.coalesce(F.array_max(F.transform(F.filter(indexed, asks), lambda m: m["i"])), n - 1)
    at = lambda i: F.get(messages, i)
    edge = lambda c: F.regexp_replace(c, r"^\n+|\n+$", "")

    def turn(m: Column) -> Column:
        has = m["content"].contains("</think>")
        thought = F.when(has, edge(F.substring_index(F.split(m["content"], "</think>", 2)[0], "<think>", -1))).otherwise(F.lit(""))
        said = F.when(has, F.regexp_replace(F.substring_index(m["content"], "</think>", -1), r"^\n+", "")).otherwise(m["content"])
        keep = (m["i"] > last) & ((m["i"] == n - 1) | (thought != ""))
        answer = F.when(keep, F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), F.regexp_replace(said, r"^\n+", ""))).otherwise(said)
        plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.when(m["role"] == "assistant", answer).otherwise(m["content"]), F.lit("<|im_end|>\n"))
        opens = (m["i"] == 0) | ~F.coalesce(at(m["i"] - 1)["role"] == "tool", F.lit(False))
        closes = ~F.coalesce(at(m["i"] + 1)["role"] == "tool", F.lit(False))
        tool = F.concat(F.when(opens, F.lit("<|im_start|>user")).otherwise(F.lit("")), F.lit("\n<tool_response>\n"), m["content"], F.lit("\n</tool_response>"), F.when(closes, F.lit("<|im_end|>\n")).otherwise(F.lit("")))
        return F.when(m["role"] == "tool", tool).otherwise(plain)

    tail = "<|im_start|>assistant\n" if prompt else ""
    return F.concat(F.array_join(F.transform(indexed, turn), ""), F.lit(tail))


def fill(template: Column, values: dict[str, Column], left: str = "{", right: str = "}") -> Column:
    """A prompt template with its named places filled, one after another."""
    for name, value in values.items():
        template = F.replace(template, F.lit(left + name + right), value)
    return template


#: Model families by a part of a path or architecture, the first that fits; fixed values.
FAMILIES = ("qwen", "llama", "gemma", "smollm")
ARCHITECTURES = ("gemma", "llama", "qwen", "smollm")


def model_family(path: Column, architecture: Column) -> Column:
    """The family that the path names, else the architecture; an unknown one fails the job."""
    of = lambda c, names: F.coalesce(*[F.when(F.lower(c).contains(n), F.lit(n)) for n in names])
    return F.coalesce(of(path, FAMILIES), of(architecture, ARCHITECTURES), F.raise_error(F.concat(F.lit("unknown model "), path)).cast("string"))


def template_features(template: Column) -> Column:
    """Features of a chat template, ``basic`` if it has none."""
    low = F.lower(template)
    found = F.array_compact(F.array(
        F.when(low.contains("tools") | low.contains("tool_call"), F.lit("tool_calling")),
        F.when(template.contains("<think>") | template.contains("reasoning_content"), F.lit("thinking")),
        F.when(template.contains("multi_step_tool"), F.lit("multi_step"))))
    return F.when(F.size(found) == 0, F.array(F.lit("basic"))).otherwise(found)


def half_even(value: Column, digits: int = 0) -> Column:
    """A number with a fixed count of decimals, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("decimal(38,10)"), digits).cast("double"))


def remaining(begun: Column, hours: Column, now: Column) -> Column:
    """``H:MM`` until the deadline, from seconds since the epoch; a message once it has passed."""
    left = begun + hours * 3600 - now
    return F.when(left <= 0, F.lit("Timer expired!")).otherwise(F.format_string("%d:%02d", F.floor(left / 3600), F.floor(F.pmod(left, F.lit(3600)) / 60)))


def count_of(value: Column) -> Column:
    """A VARIANT that is a number, or an object of numbers, as one number: their sum."""
    of = F.try_variant_get(value, "$", "map<string,long>")
    return F.coalesce(F.try_variant_get(value, "$", "long"), F.aggregate(F.map_values(of), F.lit(0).cast("long"), lambda a, x: a + x))


#: Lengths of a repeated string that are tried together, in this order; fixed values.
BANDS = ((3, 30), (30, 60), (60, 120), (120, 250), (250, 500))


def _periodic(x: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, period) where ``most`` further copies of the next ``period`` characters follow.

    Equals of the text with itself shifted by the period stand in runs, so each period is one vector comparison."""
    out = []
    for period in range(low, min(high, len(x) // (most + 1)) + 1):
        same = np.concatenate(([False], x[period:] == x[:-period], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= period * most
        out.append(np.stack([begin[long], end[long], np.full(int(long.sum()), period)]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _limit_strings(text: str, most: int) -> str:
    """Strings that stand more than ``most`` times back to back are cut to ``most``, until none is left.

    In each band the leftmost place goes first and there the shortest period."""
    changed = True
    while changed:
        changed = False
        for low, high in BANDS:
            begin, end, period = _periodic(np.frombuffer(text.encode("utf-32-le"), np.uint32), low, high, most)
            parts, at = [], 0
            while len(begin):
                here = np.maximum(begin, at)
                here = np.where(here <= end - period * most, here, len(text))
                k = np.lexsort((period, here))[0]
                i, n = int(here[k]), int(period[k])
                if i == len(text):
                    break
                parts.append(text[at : i + n * most])
                at = i + n * ((int(end[k]) - i) // n + 1)
            if parts:
                changed, text = True, "".join(parts) + text[at:]
    return text


def _limit_blocks(lines: list[str], most: int) -> list[str] | None:
    """The first block of 2 to 29 lines that stands more than ``most`` times is cut to ``most`` (shortest blocks
    first), with a broken copy at the very end; null if there is none."""
    known: dict[str, int] = {}
    x = np.array([known.setdefault(v, len(known)) for v in lines])
    for size in range(2, min(30, len(lines) // 5 + 1)):
        same = np.concatenate(([False], x[size:] == x[:-size], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        long = np.flatnonzero(end - begin >= size * most)
        if len(long):
            i = int(begin[long[0]])
            block = lines[i : i + size]
            rest = lines[i + size * ((int(end[long[0]]) - i) // size + 1) :]
            alike = lambda a, b: a == b or (a.strip() and b.startswith(a.strip())) or (b.strip() and a.startswith(b.strip()))
            if rest and len(rest) <= size and all(alike(a, b) for a, b in zip(rest, block, strict=False)):
                rest = []
            return lines[:i] + block * most + rest
    return None


def _limit(text: str, most: int = 5, rounds: int = 10) -> str:
    """Equal lines in a row, then blocks of lines, then strings, at most ``most`` times each, round after round."""
    for _ in range(rounds):
        before, lines, run = text, [], 0
        for i, v in enumerate(all_lines := text.split("\n")):
            run = run + 1 if i and v == all_lines[i - 1] else 1
            if run <= most:
                lines.append(v)
        text = _limit_strings("\n".join(_limit_blocks(lines, most) or lines), most)
        if text == before:
            break
    return text


@F.pandas_udf(StringType())
def limit_repetitions(text: pd.Series) -> pd.Series:
    """Fixpoint rewriting, so an Arrow UDF."""
    return text.map(lambda x: None if x is None else _limit(x))


def _call(text: str) -> str | None:
    try:
        node = ast.parse(text.strip(), mode="eval").body
        args = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        return json.dumps({"name": ast.unparse(node.func), "args": args}, sort_keys=True)
    except (SyntaxError, ValueError, AttributeError):
        return None


@F.pandas_udf(StringType())
def parse_call(text: pd.Series) -> pd.Series:
    """``f(a=1, b=(2, 3))`` to canonical JSON, tuples as lists; null if it is no call of literals."""
    return text.map(lambda x: None if x is None else _call(x))


def _wrapped(text: str, indent: str, width: int) -> str:
    fit = textwrap.TextWrapper(width=width, initial_indent=indent, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)
    out: list[str] = []
    for line in (text or "").splitlines() or [""]:
        out += [indent.rstrip()] if not line else [indent + line] if len(line) <= width else fit.wrap(line)
    return "\n".join(out)


def wrapped(text: Column, indent: str = "  ", width: int = 100) -> Column:
    """Indented lines of at most ``width`` characters; a word is never broken.  Presentation, so an Arrow UDF."""
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: _wrapped(x, indent, width))

    return F.pandas_udf(run, StringType())(text)


def _pretty(value: object, depth: int = 0) -> str:
    pad = "  " * (depth + 1)
    if isinstance(value, str):
        return value if "\n" in value else json.dumps(value, ensure_ascii=False)
    if isinstance(value, (dict, list)) and value:
        inner = [f'{pad}"{k}": {_pretty(v, depth + 1)}' for k, v in value.items()] if isinstance(value, dict) else [pad + _pretty(v, depth + 1) for v in value]
        a, b = "{}" if isinstance(value, dict) else "[]"
        return a + "\n" + ",\n".join(inner) + "\n" + "  " * depth + b
    return json.dumps(value)


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON over several lines, with the line breaks inside strings left as they are; other text unchanged."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else _pretty(json.loads(x))
        except ValueError:
            return x

    return text.map(one)


@F.pandas_udf(StringType())
def call_text(call: pd.Series) -> pd.Series:
    """``parse_call`` back to ``f(a=1, b=[2, 3])``."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        c = json.loads(x)
        return f"{c['name']}({', '.join(f'{k}={v}' for k, v in c['args'].items())})"

    return call.map(one)
