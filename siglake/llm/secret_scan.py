"""Secret scans in DataFrame functions alone.

Three base kinds are patterns: assign, access and hex. The fourth, entropy, slides a window over candidate strings: runs of
`RUN` characters or more with both letters and digits, of the hex class if all characters are hex digits, else of the
base64 class. Counts of a window's characters are kept incrementally, and with them sum(c * log2 c) in fixed point, from
which Shannon entropy follows; a candidate whose best window reaches its class's bits is a span unless the allow-list
knows it or a base span covers it.

Positions are code points, end exclusive. Null text: as empty, no spans. Ties in start: kinds in the order of KINDS.
Repeated rows each give a row, empty tables none. Other columns are not read by `secret_spans`; `redacted` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
# Fixed values of the contract: the patterns of the base kinds.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run of A-Z0-9 that is too short from its first AKIA on is too short from any
HEX = "[0-9a-f]{32,}"
MIN_VALUE = 8

RUN, WINDOW, UNIT = 20, 20, 1_000_000
#: Characters of a run that are walked at once, besides those of a window that began before: reaching one costs its place.
PIECE = 1000
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that the best window must reach: random strings of WINDOW characters have 3.4 and 4.0 or so.
BITS = {"hex": 2.9, "base64": 3.75}
#: Candidates that are no secrets: UUIDs, runs of the alphabet or digits, placeholders, file paths and slugs of plain words.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(0123456789|abcdefghij|ABCDEFGHIJ|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee])",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[-_/=+]+)+[A-Za-z0-9]{0,12}$",
)


def weights() -> list[int]:
    """c * log2(c) in fixed point, for c from 0 to WINDOW."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1))]


def most_weight(kind: str) -> int:
    """The sum of weights of a window at which its entropy is BITS[kind]."""
    return round((math.log2(WINDOW) - BITS[kind]) * WINDOW * UNIT)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches. A text without one is read once."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gaps"])
        end = start + F.length(x["matches"])
        span = F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), x["matches"].alias("m"))
        return F.struct(end.cast("int").alias("at"), F.array_append(state["out"], span).alias("out"))

    walked = F.aggregate(
        F.filter(F.arrays_zip(matches.alias("matches"), gaps.alias("gaps")), lambda x: x["matches"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda state: state["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _least_weight(run: Column) -> Column:
    """The least sum of weights over the windows of a run, that is the highest entropy; a long run is walked by pieces."""

    def walked(pieces: Column) -> Column:
        before = lambda i: F.when(i > 0, F.substring(F.get(pieces, i - 1), 1 - WINDOW, WINDOW)).otherwise(F.lit(""))
        return F.array_min(F.transform(pieces, lambda x, i: _let(F.transform(F.split(F.concat(before(i), x), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), _walked)))

    return _let(F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), walked)


def _walked(codes: Column) -> Column:
    """The least sum of weights over the windows of a piece, from places in the alphabet, by counts kept incrementally."""
    f = weights()
    gain = F.array(*[F.lit(b - a) for a, b in zip(f, f[1:], strict=False)])  # of one more, by count

    def step(state: Column, i: Column) -> Column:
        def moved(k: Column, gone: Column) -> Column:
            n = F.transform(state["n"], lambda c, j: F.when(j == k, F.when(j == gone, c).otherwise(c + 1)).otherwise(F.when(j == gone, c - 1).otherwise(c)))
            lost = F.when(gone >= 0, F.get(gain, F.get(state["n"], gone) - 1)).otherwise(F.lit(0))
            s = F.when(k == gone, state["s"]).otherwise(state["s"] + F.get(gain, F.get(state["n"], k)) - lost)
            return _let(s, lambda s: F.struct(n.alias("n"), s.alias("s"), F.when(i >= WINDOW - 1, F.least(state["best"], s)).otherwise(state["best"]).alias("best")))

        return _let(F.get(codes, i), lambda k: _let(F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1)), lambda gone: moved(k, gone)))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).alias("s"), F.lit(2**31 - 1).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])


def _secret_run(run: Column) -> Column:
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    # Possessive, as Java's matcher recurses for each round of a group that it may give back. The parts of a slug end where
    # letters follow marks, so none is ever given back.
    allowed = run.rlike(ALLOW[0]) | run.rlike(ALLOW[1]) | run.rlike(ALLOW[2].replace(")+[", ")++["))
    most = F.when(run.rlike("^[0-9a-fA-F]+$"), F.lit(most_weight("hex"))).otherwise(F.lit(most_weight("base64")))
    return F.when(~mixed | allowed, F.lit(False)).otherwise(_least_weight(run) <= most)


def secret_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of a text, sorted; k indexes KINDS. Base spans are those with k < 3."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    of = lambda found, k: F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    assign = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= MIN_VALUE)
    base = F.concat(of(assign, 0), of(_found(text, ACCESS), 1), of(_found(text, HEX), 2))
    runs = F.filter(_found(text, CANDIDATE), lambda x: _secret_run(x["m"]))
    added = F.filter(runs, lambda x: ~F.exists(base, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    return F.array_sort(F.concat(base, of(added, 3)))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and secrets, the spans of each document row."""
    return docs.select(F.col("doc_id").cast("long"), secret_spans(F.col("text")).alias("secrets"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each maximal stretch of spans replaced by mark, n_chars recounted where a text changed; no row goes."""
    text = F.col("text")

    def step(state: Column, x: Column) -> Column:
        gap = F.when(x["s"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.array_append(state["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda state: F.concat(F.concat_ws("", state["out"]), F.substring(text, state["at"] + 1, F.length(text)))
    own = "_".join(["spans", *docs.columns])  # a name that no column has
    spans, out = F.col(own), docs.withColumn(own, secret_spans(text))
    out = out.withColumn("text", F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _sql_found(pattern: str, kind: int) -> str:
    pattern = pattern.replace("'", "''")
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return (
        f"SELECT doc_id, r, {kind} AS k, m[i] AS m, ({at})::BIGINT AS s, ({at} + length(m[i]))::BIGINT AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM"
        f" (SELECT doc_id, r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d))"
    )


def sql() -> str:
    """The contract query in DuckDB SQL."""
    candidate, q = CANDIDATE.split(")", 1)[1], lambda x: x.replace("'", "''")
    f = "[" + ", ".join(map(str, weights()[1:])) + "]"
    least = (
        f"list_min(list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: list_sum(list_transform(list_distinct(string_split(m[i:i + {WINDOW - 1}], '')),"
        f" lambda c: ({f})[{WINDOW} - length(replace(m[i:i + {WINDOW - 1}], c, ''))]))))"
    )
    allow = " OR ".join(f"regexp_matches(m, '{q(x)}')" for x in ALLOW)
    spell = lambda own: f"coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k){own}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
b AS (
  SELECT * FROM ({_sql_found(ASSIGN, 0)}) WHERE length(regexp_extract(m, '{q(ASSIGN)}', 1)) >= {MIN_VALUE}
  UNION ALL {_sql_found(ACCESS, 1)} UNION ALL {_sql_found(HEX, 2)}),
runs AS (SELECT * FROM ({_sql_found(candidate, 3)}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allow})),
high AS (SELECT * FROM runs WHERE {least} <= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {most_weight("hex")} ELSE {most_weight("base64")} END),
added AS (SELECT * FROM high WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = high.r AND b.s <= high.s AND b.e >= high.e)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM added),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    {spell(" FILTER (k < 3)")} AS base, {spell("")} AS spans
  FROM a GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""
