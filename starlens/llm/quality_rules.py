"""Quality rules as a short-circuit cascade.

Each rule is a predicate over one document's lazily computed measures.  ``plan_rules`` times every rule and counts its
rejections on a bounded sample of documents and orders the rules by rejections per second; ``apply_rules`` then tests
each document in that order and stops at the first rule that rejects it.  The verdict is a conjunction, so the
order changes the cost only, never the result.

Defined cases: null text counts as the empty text; the empty text has no words and is rejected by ``few_words``;
texts of any length are read whole; repeated rows are judged one by one; rules of equal worth keep their given order; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows
from starlens.llm.registry import register, table

# The characters that count as symbols, and ASCII white space (what ``bytes.split`` splits on).
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))

SAMPLE_ROWS = 1000  # documents on which rules are timed; bounds the sample, not the result


class Measures:
    """Measures of one text, each computed on first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        covered, end = 0, 0  # end: first word position not yet counted
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def upper_share(self) -> float:
        up = len(self.raw) - len(self.raw.translate(None, UPPER))
        low = len(self.raw) - len(self.raw.translate(None, LOWER))
        return up / (up + low) if up + low else 0.0

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!") + self.text.count("?")

    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a document fails; thresholds are strict, so a text on the line is kept."""

    name: str
    rejects: Callable[[Measures], bool]


RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("capitals", lambda m: m.upper_share > 0.5),
    Rule("marks", lambda m: 2 * m.n_marks > m.n_words),
)


def plan_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds) and rejections of every rule on the ``sample_rows`` texts of smallest keyed hash, best rule first.

    Each rule is timed on fresh measures, so a shared measure is charged to every rule that needs it.
    """
    schema = pa.schema([("k", pa.int32()), ("seconds", pa.float64()), ("rejected", pa.int64())])

    def timed(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(bool(rule.rejects(Measures(t))) for t in texts)
                out.append({"k": k, "seconds": time.perf_counter() - began, "rejected": rejected})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    n = docs.count()
    place = F.xxhash64(F.col(text), F.lit(17))
    bound = int(min(1.0, 2 * sample_rows / max(n, 1)) * 2**63)  # about twice the sample, so that no task sends more than its share
    near = docs.where((F.shiftrightunsigned(place, 1) <= F.lit(min(bound, 2**63 - 1)))) if n else docs
    sample = near.select(F.col(text).cast("string").alias("t")).orderBy(F.xxhash64("t", F.lit(17))).limit(sample_rows)
    rows = (
        sample.mapInArrow(timed, "k int, seconds double, rejected long")
        .groupBy("k")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
        .collect()
    )  # one row per rule
    found = {r["k"]: r for r in rows}
    plan = [{"k": k, "name": r.name, "seconds": found[k]["seconds"] if found else 0.0, "rejected": found[k]["rejected"] if found else 0} for k, r in enumerate(rules)]
    return sorted(plan, key=lambda x: (-x["rejected"] / (x["seconds"] + 1e-9), x["seconds"], x["k"]))


def verdict(m: Measures, rules: list[Rule]) -> str | None:
    """Name of the first rule that rejects, None if the document passes all."""
    return next((r.name for r in rules if r.rejects(m)), None)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    ordered = [rules[x["k"]] for x in plan_rules(docs, text, rules, sample_rows)]
    at = docs.columns.index(text)

    def body(batches):
        for batch in batches:
            keep = [verdict(Measures(t), ordered) is None for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(body, docs.schema)


def measure_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base measures, whether the base fails, and the cascade's verdict."""
    ordered = [rules[x["k"]] for x in plan_rules(docs, text, rules, sample_rows)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([(key, pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def row(k, t):
        m = Measures(t)
        failed = m.base_failed()
        by = verdict(m, ordered)
        return {key: k, **{n: getattr(m, n) for n in names}, "base_failed": failed, "kept": not failed and by is None, "rejected_by": by}

    out = f"{key} long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(arrow_rows(row, schema), out)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
cnt AS (SELECT rid, i, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 THEN 1 ELSE 0 END AS rep FROM tri),
cov AS (SELECT rid, CASE WHEN rep = 1 OR lag(rep, 1, 0) OVER o = 1 OR lag(rep, 2, 0) OVER o = 1 THEN 1 ELSE 0 END AS r FROM cnt WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, CAST(sum(r) AS BIGINT) AS n FROM cov GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks
  FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN rep ON rep.rid = w.rid),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (2 * n_dup_lines > n_lines)
    AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND NOT (up > low) AND NOT (2 * marks > n_words) AS kept
FROM v
"""


@register("op4_quality_rules", ORACLE)
def op4_quality_rules(spark, sf_dir):
    return measure_rules(table(spark, sf_dir, "documents")).drop("rejected_by")
