"""Secret scans by character Markov models, in built-in expressions only.

Two models give the log-likelihood of a token, character by character: one of random strings and one of ordinary
identifiers. A token whose log-likelihood ratio is at least `bar` is taken for a secret. The models are pair counts
over labelled samples: random strings are digests of consecutive numbers in the alphabets that keys come in;
ordinary identifiers are the distinct tokens of at most `sample` documents of the table (those whose text has the
smallest MD5 values), without what the base patterns find. Counts of pairs are bounded by the alphabet.

Beside that, three base patterns (assignments, access keys, long hex numbers) are always reported.

Places come from the texts between matches, which `split` gives, and the matches themselves. Null text counts as
empty. Repeated rows are scanned each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: the base kinds in their order, pattern, the group whose length counts, that length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of 32 or more are the same matches as all runs, of which the shorter ones are dropped.
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
MODEL = "markov"

#: Tokens that the models judge, and the shorter ones from which ordinary identifiers are learnt.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}"

#: Documents from which identifiers are learnt, random strings of each alphabet, and the ratio (in nats) of a secret.
SAMPLE, RANDOM, BAR = 1000, 2000, 15.0

#: Characters by code, from '+' to 'z'; one more row for the start of a token.
FIRST, CODES = ord("+"), ord("z") - ord("+") + 1


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _with_places(df: DataFrame, name: str, pattern: str, group: int, least: int, kind: int) -> DataFrame:
    """A column `name` with the spans of the matches whose group has `least` characters, from the texts between them;
    `name`_found has all matches."""
    found, gap, counted = (f"{name}_{x}" for x in ("found", "gap", "counted"))
    none = f"CAST(array() AS {SPANS})"
    df = df.withColumn(found, F.expr(f"regexp_extract_all(text_, {_quoted(pattern)}, 0)"))
    df = df.withColumn(gap, F.expr(f"CASE WHEN size({found}) > 0 THEN split(text_, {_quoted(pattern)}, -1) END"))
    df = df.withColumn(counted, F.expr(f"CASE WHEN size({found}) > 0 THEN regexp_extract_all(text_, {_quoted(pattern)}, {group}) END" if group else found))
    start = f"s.at + char_length(m.{gap})"
    end = f"{start} + coalesce(char_length(m.{found}), 0)"
    walk = f"""aggregate(arrays_zip({gap}, {found}, {counted}), named_struct('at', 0L, 'out', {none}),
        (s, m) -> named_struct('at', {end}, 'out', IF(char_length(m.{counted}) >= {least},
            concat(s.out, array(named_struct('start', {start}, 'kind', {kind}, 'end', {end}))), s.out)),
        s -> s.out)"""
    return df.withColumn(name, F.expr(f"CASE WHEN size({found}) > 0 THEN {walk} ELSE {none} END")).drop(gap, counted)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _random_strings(spark: SparkSession, n: int) -> DataFrame:
    """Labelled random strings: digests of 0 to n - 1 as hex of both cases, base 64, and base 64 cut to key lengths."""
    digest = "sha2(CAST(id AS STRING), 256)"
    kinds = f"array(md5(CAST(id AS STRING)), sha1(CAST(id AS STRING)), upper({digest}), base64(unhex({digest})), substring(upper(base64(unhex({digest}))), 1, 20), substring(base64(unhex({digest})), 1, 32))"
    return spark.range(n).select(F.explode(F.expr(kinds)).alias("token"))


def _identifiers(texts: DataFrame, sample: int) -> DataFrame:
    """The distinct tokens of at most `sample` texts, without the base matches."""
    hashed = texts.select(F.md5("text_").alias("hash"))
    bar = hashed.distinct().orderBy("hash").limit(sample).agg(F.max("hash").alias("bar")).collect()[0]["bar"]
    chosen = texts.where(F.md5("text_") <= F.lit(bar)).dropDuplicates(["text_"])
    plain = F.col("text_")
    for _, pattern, _, _ in BASE:
        plain = F.regexp_replace(plain, pattern, " ")
    return chosen.select(plain.alias("plain")).select(F.explode(F.expr(f"regexp_extract_all(plain, {_quoted(IDENTIFIER)}, 0)")).alias("token")).distinct()


def _pairs(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of (code before, code), the start of a token as CODES: at most (CODES + 1) x CODES rows."""
    codes = f"transform(filter(split(token, ''), c -> c <> ''), c -> ascii(c) - {FIRST})"
    pairs = tokens.select(F.expr(codes).alias("codes")).select(
        F.explode(F.expr(f"transform(codes, (c, i) -> named_struct('a', IF(i = 0, {CODES}, codes[i - 1]), 'b', c))")).alias("p")
    )
    return {(r["a"], r["b"]): r["n"] for r in pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each pair, by code before and code; smoothed by one half."""
    texts = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text_"))
    counts = [_pairs(_random_strings(docs.sparkSession, RANDOM)), _pairs(_identifiers(texts, sample))]
    out = []
    for a in range(CODES + 1):
        total = [sum(c.get((a, b), 0) for b in range(CODES)) + 0.5 * CODES for c in counts]
        out += [math.log((counts[0].get((a, b), 0) + 0.5) / total[0]) - math.log((counts[1].get((a, b), 0) + 0.5) / total[1]) for b in range(CODES)]
    return out


def _ratio(weights: list[float], token: str) -> str:
    table = "CAST(split('" + ",".join(f"{w:.9f}" for w in weights) + "', ',') AS array<double>)"
    return f"""aggregate(filter(split({token}, ''), c -> c <> ''), named_struct('a', {CODES}, 'sum', 0D),
        (s, c) -> named_struct('a', ascii(c) - {FIRST}, 'sum', s.sum + element_at({table}, s.a * {CODES} + ascii(c) - {FIRST} + 1)), s -> s.sum)"""


def find_spans(docs: DataFrame, weights: list[float], text: str = "text", bar: float = BAR) -> DataFrame:
    """All columns of `docs` in a struct `row`, the text as `text_`, `base` and `spans`: sorted (start, kind, end).

    kind is the place of the kind's name in KINDS. The models' spans are those that overlap no base span.
    """
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = out.withColumn("text_", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    for kind, (name, pattern, group, least) in enumerate(BASE):
        out = _with_places(out, name, pattern, group, least, kind).drop(f"{name}_found")
    out = _with_places(out, "tokens", TOKEN, 0, 0, len(BASE))
    out = out.withColumn("base", F.array_sort(F.concat(*(name for name, *_ in BASE))))
    judged = f"""filter(zip_with(tokens, tokens_found, (t, m) -> IF(exists(base, b -> b.start < t.end AND t.start < b.end) OR {_ratio(weights, 'm')} < {bar}D, NULL, t)), t -> t IS NOT NULL)"""
    out = out.withColumn("model", F.expr(f"CASE WHEN size(tokens) = 0 THEN tokens ELSE {judged} END"))
    return out.withColumn("spans", F.array_sort(F.concat("base", "model"))).select("row", "text_", "base", "spans")


KINDS = [*(name for name, *_ in BASE), MODEL]


def _told(column: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.expr(f"transform({column}, s -> concat({names}[s.kind], ':', s.start, ':', s.end))"), ",")


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, bar: float = BAR) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of every row; spans as kind:start:end, in characters."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = find_spans(rows, train(rows, "text", sample), "text", bar)
    number = [F.expr(f"size(filter(base, s -> s.kind = {i}))").cast("long").alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    return found.select(F.col("row.key").alias(key), *number, F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars", mark: str = "[SECRET]", sample: int = SAMPLE, bar: float = BAR) -> DataFrame:
    """`docs` with every span replaced by `mark`, overlapping spans by one; `size`, where it is a column, follows."""
    found = find_spans(docs, train(docs, text, sample), text, bar)
    clean = f"""aggregate(spans, named_struct('at', 0L, 'out', ''),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', IF(x.start < s.at, s.out, concat(s.out, substring(text_, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)), '{mark}'))),
        s -> concat(s.out, substring(text_, CAST(s.at + 1 AS INT))))"""
    found = found.withColumn("clean", F.expr(f"CASE WHEN size(spans) = 0 THEN row.`{text}` ELSE {clean} END")).withColumn("changed", F.expr("size(spans) > 0"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text:
            value = F.col("clean")
        elif c == size:
            value = F.when(F.col("changed"), F.char_length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return found.select(*columns)
