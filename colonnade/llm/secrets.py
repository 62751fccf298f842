"""Secret scans with DataFrame functions only.

Three base patterns find secrets by their form. Beside them, strings that are long runs of one
character class are candidates: a window slides over each, keeping per-character counts and the
sum of c*log2(c) up to date as one character enters and one leaves, so the Shannon entropy of
every window costs one step. Overlapping windows that reach the class's entropy form one finding,
unless the candidate is on the allow-list or the finding lies inside a base finding.

The counts of a window are packed, twelve characters in a long of five bits each (a window has fewer than
32 characters), so a step changes a few numbers whatever the alphabet; the finding that is still open is kept as two
numbers and goes to the list when it is closed. So a candidate's cost grows with its length alone.

Positions are code points, ends exclusive. Entropy sums are kept as whole numbers (millionths of a
bit), so no rounding error gathers while a window slides.

Defined cases: a null text counts as empty and has no finding; a null doc_id is kept; rows that
repeat are scanned each; texts and candidates of any length are scanned whole; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group that must be long enough, its least length; in the order of kinds.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a maximal run shorter than 24 never counts, so only long runs need to be brought up
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    pattern: str  # a run of the class, as long as the window at least
    alphabet: str
    window: int
    bits: float  # least entropy of a window


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{24,}", "0123456789abcdefABCDEF", 24, 3.0),
    CharacterClass(
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{24,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        24,
        4.0,
    ),
)

#: A candidate that one of these finds something in is no secret.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^sha(256|384|512)-",  # subresource integrity
    r"EXAMPLE",  # keys of documentation
    r"(?i)abcdefghijklm|nopqrstuvwxyz|0123456789",  # spelled-out alphabets
    r"^[A-Za-z_-]+$",  # words without a digit
    r"^[0-9_=+/-]+$",  # digits only
    r"^/?(?:[A-Za-z_-]++/)++[A-Za-z0-9_-]*+$",  # paths; nothing to go back to, so no recursion on long ones
)

#: Matches whose places are summed up together.
_BLOCK = 256


def _quote(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _located(matches: str, pattern: str) -> str:
    """SQL: array of (s, start, end) for the matches of a pattern in ``text``. Matches and the
    pieces between them alternate, so lengths add up to positions: block by block, then within blocks."""
    none, ints = "cast(array() as array<struct<s: string, start: int, end: int>>)", "cast(array() as array<int>)"
    block = f"slice(m, b * {_BLOCK} + 1, {_BLOCK})"
    ahead = f"""aggregate(transform(sequence(0, (size(m) - 1) div {_BLOCK}), b -> aggregate({block}, 0, (a, x) -> a + x.gap + length(x.s))),
      struct(0 as at, {ints} as found), (a, x) -> struct(a.at + x as at, array_append(a.found, a.at) as found), a -> a.found)"""
    starts = f"""flatten(transform(sequence(0, (size(m) - 1) div {_BLOCK}), b -> aggregate({block}, struct(h[b] as at, {ints} as found),
      (a, x) -> struct(a.at + x.gap + length(x.s) as at, array_append(a.found, a.at + x.gap) as found), a -> a.found)))"""
    placed = f"zip_with(m, {starts}, (x, at) -> struct(x.s as s, at as start, at + length(x.s) as end))"
    pairs = f"zip_with({matches}, slice(split(text, {_quote(pattern)}, -1), 1, size({matches})), (s, p) -> struct(s, length(p) as gap))"
    return f"if(size({matches}) = 0, {none}, {_let(pairs, 'm', _let(ahead, 'h', placed))})"


def _array(values) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _windows(c: CharacterClass) -> str:
    """SQL: array of (start, end) in candidate ``x.s`` where windows of high entropy cover it."""
    if c.window > 31:
        raise ValueError("a count has five bits: windows have 31 characters at most")
    w, n = c.window, len(c.alphabet)
    n_words = -(-n // 12)
    # how much more a character adds that is there k times, in millionths of a bit; and what a window of enough entropy has at most
    sums = [0] + [round(k * math.log2(k) * 1e6) for k in range(1, w + 1)]
    more = _array(b - a for a, b in zip(sums, sums[1:], strict=False))
    most = math.floor(w * (math.log2(w) - c.bits) * 1e6)
    # by place in the alphabet plus one; at 0, of no character, nothing
    place = f"array({', '.join(str(c.alphabet.find(chr(k)) + 1) for k in range(128))})"
    ones = [_array([0] + [1 << 5 * (k % 12) if k // 12 == j else 0 for k in range(n)]) for j in range(n_words)]
    masks = [_array([0] + [31 << 5 * (k % 12) if k // 12 == j else 0 for k in range(n)]) for j in range(n_words)]
    shifts = f"array(0, {', '.join(str(5 * (k % 12)) for k in range(n))})"
    count = lambda k: f"shiftright({' | '.join(f'(b.w{j} & {masks[j]}[{k}])' for j in range(n_words))}, {shifts}[{k}])"
    words = ", ".join(f"b.w{j} + {ones[j]}[k.e] - {ones[j]}[k.l] as w{j}" for j in range(n_words))
    change = f"if(k.e = k.l, 0L, {more}[cast({count('k.e')} as int)] - if(k.l = 0, 0L, {more}[cast({count('k.l')} as int) - 1]))"
    none = "cast(array() as array<struct<start: int, end: int>>)"
    kept = ", ".join(f"b.w{j} as w{j}" for j in range(n_words))
    rest = f"struct({kept}, b.sum as sum, {{}} as open, {{}} as till, {{}} as found)"
    # a window that touches the open finding makes it longer, another one closes it
    slide = f"""case when i + 1 < {w} or b.sum > {most}L then {rest.format("b.open", "b.till", "b.found")}
      when b.open >= 0 and b.till >= i + 1 - {w} then {rest.format("b.open", "i + 1", "b.found")}
      else {rest.format(f"i + 1 - {w}", "i + 1", "if(b.open >= 0, array_append(b.found, struct(b.open as start, b.till as end)), b.found)")} end"""
    zero = f"struct({', '.join(f'0L as w{j}' for j in range(n_words))}, 0L as sum, -1 as open, -1 as till, {none} as found)"
    # steps: add the character at i, drop the one at i - window, note the window that ends at i
    scan = f"""aggregate(sequence(0, size(q) - 1), {zero},
      (a, i) -> aggregate(array(struct(q[i] as e, if(i >= {w}, q[i - {w}], 0) as l)), a,
        (b, k) -> struct({words}, b.sum + {change} as sum, b.open as open, b.till as till, b.found as found), b -> {slide}),
      a -> if(a.open >= 0, array_append(a.found, struct(a.open as start, a.till as end)), a.found))"""
    return _let(f"transform(split(x.s, ''), ch -> {place}[ascii(ch)])", "q", scan)


def scan_secrets(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """doc_id and ``findings``: array of (start, rank, kind, end, text), sorted. rank: the kind's
    place, base kinds first."""
    kinds = [(k, p) for k, p, _, _ in BASE] + [(c.kind, c.pattern) for c in classes]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(F.expr(f"regexp_extract_all(text, {_quote(p)}, 0)").alias(f"m_{k}") for k, p in kinds))
    rows = rows.select("doc_id", *(F.expr(_located(f"m_{k}", p)).alias(k) for k, p in kinds))
    allowed = " or ".join(f"rlike(x.s, {_quote(a)})" for a in allow) or "false"
    base = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        long = f"length(regexp_extract(x.s, {_quote(pattern)}, {group})) >= {least}" if group else f"length(x.s) >= {least}"
        base.append(f"transform(filter({kind}, x -> {long}), x -> struct(x.start, {rank} as rank, '{kind}' as kind, x.end, x.s as text))")
    added = []
    for rank, c in enumerate(classes, len(BASE)):
        added.append(
            f"flatten(transform(filter({c.kind}, x -> not ({allowed})), x -> "
            + _let("split(x.s, '')", "ch", f"transform({_windows(c)}, y -> struct(x.start + y.start as start, {rank} as rank, '{c.kind}' as kind, "
            "x.start + y.end as end, array_join(slice(ch, y.start + 1, y.end - y.start), '') as text))")
            + "))"
        )
    rows = rows.select("doc_id", F.expr(f"concat({', '.join(base)})").alias("base"), *(F.expr(a).alias(f"added{i}") for i, a in enumerate(added)))
    more = ", ".join(f"filter(added{i}, e -> not exists(base, b -> b.start <= e.start and e.end <= b.end))" for i in range(len(added)))
    return rows.select("doc_id", F.expr(f"array_sort(concat(base, {more}))" if added else "array_sort(base)").alias("findings"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.expr(f"cast(size(filter(findings, x -> x.kind = '{kind}')) as bigint)")
    spans = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.expr(spans.format(f"filter(findings, x -> x.rank < {len(BASE)})")), 256).alias("base_sha256"),
        F.expr(spans.format("findings")).alias("spans"),
    )


def _oracle() -> str:
    """The same rows in DuckDB: every window's entropy from its own counts, then islands of windows."""
    kinds = [(k, p.replace("'", "''"), rank) for rank, (k, p, _, _) in enumerate(BASE)]
    kinds += [(c.kind, c.pattern, rank) for rank, c in enumerate(CLASSES, len(BASE))]
    located = " UNION ALL ".join(
        f"""SELECT doc_id, row, '{k}' AS kind, {rank} AS rank, unnest(regexp_extract_all(text, '{p}')) AS s,
          unnest(string_split_regex(text, '{p}')[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '{p}')))) AS k FROM texts
          WHERE regexp_matches(text, '{p}')"""
        for k, p, rank in kinds
    )
    long = " OR ".join(
        f"kind = '{k}' AND " + (f"length(regexp_extract(s, '{p.replace(chr(39), chr(39) * 2)}', {g})) >= {n}" if g else f"length(s) >= {n}")
        for k, p, g, n in BASE
    )
    plain = [re.sub(r"([+*])\+", r"\1", a) for a in ALLOW]  # the same, for an engine that never goes back
    allowed = " OR ".join(f"regexp_matches(s, '{a}')" for a in plain)
    limits = " UNION ALL ".join(f"SELECT '{c.kind}' AS kind, {c.window} AS w, {math.floor(c.window * (math.log2(c.window) - c.bits) * 1e6)} AS most" for c in CLASSES)
    return rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
located AS ({located}),
placed AS (
  SELECT *, (sum(length(gap) + length(s)) OVER (PARTITION BY row, kind ORDER BY k))::BIGINT AS fin FROM located
), base AS (
  SELECT row, kind, rank, fin - length(s) AS start, fin FROM placed WHERE {long}
), candidates AS (
  SELECT row, kind, rank, s, fin - length(s) AS start, w, most FROM placed JOIN ({limits}) USING (kind) WHERE NOT ({allowed})
), windows AS (
  SELECT *, unnest(range(length(s) - w + 1)) AS i FROM candidates
), letters AS (
  SELECT row, kind, rank, start, w, most, i, unnest(string_split(substr(s, (i + 1)::INT, w), '')) AS ch FROM windows
), counted AS (
  SELECT row, kind, rank, start, w, most, i, ch, count(*) AS n FROM letters GROUP BY ALL
), high AS (
  SELECT row, kind, rank, start, w, i FROM counted GROUP BY ALL HAVING sum(round(n * log2(n) * 1e6)) <= any_value(most)
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY row, kind, start ORDER BY i) AS island FROM (
    SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row, kind, start ORDER BY i) <= w THEN 0 ELSE 1 END AS fresh FROM high)
), added AS (
  SELECT row, kind, rank, start + min(i) AS start, start + max(i) + any_value(w) AS fin FROM islands GROUP BY row, kind, rank, islands.start, island
), spans AS (
  SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.row = a.row AND b.start <= a.start AND a.fin <= b.fin)
), joined AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (row)
"""


ORACLE = _oracle()
