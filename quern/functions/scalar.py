"""Scalar functions on columns: tokens, cost, ratios, formats, text. All run inside the JVM unless they say otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def billable_input(tokens: Column, read: Column, created: Column) -> Column:
    """Input tokens that were not in the cache, at least 0; negative cache counts count as 0."""
    return F.greatest(F.lit(0), tokens - F.greatest(F.lit(0), zero(read)) - F.greatest(F.lit(0), zero(created)))


def part_cost(tokens: Column, price: Column) -> Column:
    """Price per million tokens times tokens; null without a price."""
    return F.when(price.isNotNull(), tokens * price / 1e6)


def total_cost(*parts: Column) -> Column:
    """The sum of the known parts; null if none is known."""
    known = F.lit(False)
    total = F.lit(0.0)
    for p in parts:
        known |= p.isNotNull()
        total += F.coalesce(p, F.lit(0.0))
    return F.when(known, total)


def client_cost(tokens: Column, output: Column, read: Column, short: Column, long: Column, price_in: Column, price_out: Column, price_write: Column | None = None, price_read: Column | None = None) -> Column:
    """The other cost formula: cache writes cost 1.25 times the input price by default, hour-long ones twice, cache reads a tenth."""
    write = F.coalesce(price_write, price_in * 1.25) if price_write is not None else price_in * 1.25
    hit = F.coalesce(price_read, price_in * 0.1) if price_read is not None else price_in * 0.1
    return (tokens * price_in + output * price_out + read * hit + short * write + long * price_in * 2) / 1e6


def cache_write_split(total: Column, five: Column, hour: Column) -> Column:
    """Struct (five, hour): what is not said to be hour-long counts as five-minute."""
    long = F.greatest(F.lit(0), zero(hour))
    rest = F.greatest(F.lit(0), zero(total) - F.greatest(F.lit(0), zero(five)) - long)
    return F.struct((F.greatest(F.lit(0), zero(five)) + rest).alias("five"), long.alias("hour"))


def utf16_units(text: Column) -> Column:
    """The length that the application counts: a character beyond the basic plane is two units."""
    return F.length(text) + F.length(F.regexp_replace(text, "[\u0000-\uffff]", ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))


def cache_hit_rate(billable: Column, read: Column, created: Column) -> Column:
    return _ratio(read, billable + read + created)


def cache_read_ratio(tokens: Column, read: Column) -> Column:
    return F.least(F.lit(1.0), _ratio(read, tokens))


def session_hit_rate(hit: Column, miss: Column) -> Column:
    return _ratio(hit, hit + miss)


def cache_share(tokens: Column, read: Column) -> Column:
    return _ratio(read, tokens + read)


def tokens_per_second(tokens: Column, millis: Column) -> Column:
    return _ratio(tokens * 1000.0, millis)


def to_fixed(x: Column, decimals: int) -> Column:
    """A number rounded to so many decimals by its exact binary value, ties up: 1.005 (just below) gives 1.0, 1.125 gives 1.13."""
    scale = float(10**decimals)
    whole = F.floor(x * scale).cast("double")
    # Halves of the mantissa times the scale are exact, so the sign of the distance to the tie is.
    high = x.cast("float").cast("double")
    above = (high * scale - (whole + 0.5)) + (x - high) * scale
    return (whole + F.when(above >= 0, 1.0).otherwise(0.0)) / scale


def short_number(n: Column) -> Column:
    """Three digits with k, M, B or T; 999.6 carries to 1.00k; zero, negative and NaN give 0."""
    out = F.lit(None).cast("string")
    value = n.cast("double")
    big = F.round(value)

    def digits(x: Column, unit: str, carry: Column) -> Column:
        # As many decimals as make three digits, after rounding.
        two, one = to_fixed(x, 2), to_fixed(x, 1)
        text = F.when(two < 10, F.format_string("%.2f", two)).when(one < 100, F.format_string("%.1f", one)).otherwise(F.format_string("%.0f", to_fixed(x, 0)))
        return F.when(carry, F.lit(None).cast("string")).otherwise(F.concat(text, F.lit(unit)))

    for scale, unit, last in ((1e12, "T", True), (1e9, "B", False), (1e6, "M", False), (1e3, "k", False)):
        x = value / scale
        # A value that rounds to 1000 of a unit is 1.00 of the next.
        out = F.coalesce(out, F.when(F.round(x * 1e3) / 1e3 >= 0.9995, digits(F.greatest(x, F.lit(1.0)), unit, F.lit(False) if last else F.round(x) >= 1000)))
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), F.lit("0")).otherwise(F.coalesce(out, F.format_string("%.0f", big)))


def status_class(code: Column) -> Column:
    """The error class of an HTTP status; null without one."""
    return F.when(code >= 500, F.lit("http_5xx")).when(code.isNotNull(), F.concat(F.lit("http_"), code.cast("string")))


def snippet(text: Column, word: str, before: int = 20, after: int = 30) -> Column:
    """The text around the first hit (case folded), line ends as spaces, dots where it is cut; the head if there is none."""
    flat = F.regexp_replace(text, r"[\r\n]", " ")
    at = F.instr(F.lower(flat), F.lit(word.lower()))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + len(word) + after, F.length(flat) + 1)
    cut = F.substring(flat, start, end - start)
    framed = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end <= F.length(flat), "...").otherwise(""))
    return F.when(at > 0, framed).otherwise(F.substring(flat, 1, before + after))


def unescape(text: Column) -> Column:
    """Three references, in this order, so that an escaped reference stays text."""
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def strip_block(text: Column, tag: str) -> Column:
    """Without <tag>...</tag> blocks; an unclosed one goes to the end. Trimmed."""
    return F.trim(F.regexp_replace(text, rf"(?s)<{tag}>.*?(?:</{tag}>|$(?![\s\S]))", ""))


def flatten_blocks(text: Column, tag: str) -> Column:
    """<tag>...</tag> as a placeholder."""
    return F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", f"[{tag}]")


def normal_url(url: Column) -> Column:
    """Host without www. and path without a trailing slash, lower case; the text itself if it is no URL."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/$", "")
    return F.lower(F.coalesce(F.concat(host, path), F.trim(url)))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def strip_ansi(text: Column) -> Column:
    """Without colour codes; all line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", ""), r"\r\n?", "\n")


def looks_binary(text: Column, first: int = 256, share: float = 0.1) -> Column:
    """More than ``share`` control characters among the first ones."""
    head = F.substring(text, 1, first)
    rest = F.regexp_replace(head, "[\\u0000-\\u0008\\u000e-\\u001f\\ufffd]", "")
    return F.length(head) - F.length(rest) > F.length(head) * share


#: Idle days until a warm and a cold note, by priority (fixed values).
IDLE = {"ephemeral": (7, 21), "standard": (30, 90), "lasting": (90, 180)}


def demotion(priority: Column, status: Column, idle_days: Column) -> Column:
    """The status that a note falls to, or null if it stays."""
    out = F.lit(None).cast("string")
    for name, (warm, cold) in IDLE.items():
        own = priority == name
        if name == "standard":
            own = own | ~priority.isin(*IDLE) | priority.isNull()
        out = F.when(own & (idle_days >= cold) & status.isin("active", "warm"), "cold").when(own & (idle_days >= warm) & (status == "active"), "warm").otherwise(out)
    return out


def reheat(status: Column) -> Column:
    """One step up for a note that was recalled."""
    return F.when(status == "cold", "warm").when(status == "warm", "active").otherwise(status)


def relative_millis(text: Column) -> Column:
    """Milliseconds of +N and a unit of s, m, h or d; null for anything else."""
    unit = F.regexp_extract(text, r"^\+(\d{1,9})([smhd])$", 2)
    scale = F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.regexp_extract(text, r"^\+(\d{1,9})([smhd])$", 1).try_cast("long") * scale


def local_day(day: str, zone: str = "UTC") -> tuple[Column, Column]:
    """The first millisecond of a local day and of the next, across changes of the clock."""
    if len(day) != 10 or day[4] != "-" or day[7] != "-":
        raise ValueError(f"not a day: {day}")
    at = lambda d: F.unix_millis(F.to_utc_timestamp(d.cast("timestamp"), zone))
    start = F.lit(day).cast("date")
    return at(start), at(F.date_add(start, 1))


def backoff_seconds(failures: Column) -> Column:
    """Seconds to wait after so many failures: 2, 4, 8, 16, then ten minutes 36 times, then null: no more."""
    return F.when(failures < 1, 0).when(failures <= 4, F.pow(F.lit(2.0), failures).cast("int")).when(failures <= 40, 600)


def retry_delay(attempt: Column, hint: Column) -> Column:
    """Struct of seconds and phase of a retry (attempts from 0): a positive whole number as hint goes first, else 2, 4, 8, 16, ten minutes 36 times, and no more."""
    asked = F.when(F.trim(hint).rlike(r"^\+?\d{1,10}$"), F.trim(hint).try_cast("int"))
    seconds = F.when(asked > 0, asked).when(attempt < 4, F.pow(F.lit(2.0), attempt + 1).cast("int")).when(attempt < 40, 600).otherwise(0)
    phase = F.when(asked > 0, "retry-after").when(attempt < 4, "fast").when(attempt < 40, "minute").otherwise("timeout")
    return F.struct(seconds.alias("seconds"), phase.alias("phase"))


#: Patterns of text that looks secret and what stands in its place (fixed values).
SECRETS = (
    (r"(?i)-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED_OPENAI_KEY]"),
    (r"\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED_GOOGLE_KEY]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "[REDACTED_SLACK_TOKEN]"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|bearer|password|passwd|secret)\b\s*[:=]\s*\S+", "$1=[REDACTED]"),
)


def redact(text: Column) -> Column:
    for pattern, mark in SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def memory_text(text: Column) -> Column:
    """A note's text for comparison: no date bullets, no markup, single spaces, lower case."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^- \[\d{4}-\d{2}-\d{2}\]\s*", ""), r"[`*_~#\[\]()>-]", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def json_bool(text: Column, path: str, fallback: bool) -> Column:
    """A boolean, or a string that says so; ``fallback`` for anything else."""
    value = F.lower(F.trim(F.get_json_object(text, path)))
    return F.when(value == "true", True).when(value == "false", False).otherwise(F.lit(fallback))


def json_whole(text: Column, path: str, kind: str = "long") -> Column:
    """A whole number, or a string that holds one; null for anything else, beyond the range of ``kind`` too."""
    value = F.trim(F.get_json_object(text, path))
    return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast(kind))


def json_double(text: Column, path: str) -> Column:
    """A number, or a string that holds one; null for anything else."""
    value = F.trim(F.get_json_object(text, path))
    return F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))


def first_intent(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first rule one of whose words the text holds."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)), name).otherwise(out)
    return out


def truncate_middle(text: Column, limit: int = 32_768) -> Column:
    """Texts beyond ``limit`` UTF-8 bytes keep head and tail with a notice between, cut between characters."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def cut(t):
            data = t.encode() if t is not None else b""
            if len(data) <= limit:
                return t
            half = limit // 2
            head, tail = data[:half].decode(errors="ignore"), data[len(data) - half :]
            while tail and tail[0] & 0xC0 == 0x80:
                tail = tail[1:]
            return f"{head}\n... [{len(data) - len(head.encode()) - len(tail)} bytes left out] ...\n{tail.decode(errors='ignore')}"

        return batch.map(cut)

    # Short texts never leave the JVM.
    return F.when(F.octet_length(text) > limit, run(F.when(F.octet_length(text) > limit, text))).otherwise(text)
