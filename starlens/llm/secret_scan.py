"""Secret scan over a trigram inverted index, with DataFrame functions only.

``trigram_query`` derives from each rule's regex a Boolean query (an OR of ANDs) over lower-case trigrams that every match must
contain.  ``postings`` is the inverted index of the trigrams that some query names: (trigram, row).  ``candidates`` intersects postings per
row and says which rules may match; a rule without mandatory trigrams may match any row.  Candidates are verified by
the regex itself, so the index only saves work and never changes the result.

Spark has no function for match positions; they follow from the texts between matches (``split``) and the matches
(``regexp_extract_all``), added up in order per row and rule.

Defined cases: null text counts as empty; texts of any length are scanned whole; rows of one id are separate rows; an empty
table gives an empty result; positions are code points; spans that begin alike are ordered by kind as listed; columns other than those named
are not read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starlens.llm.base import materialise, numbered
from starlens.llm.registry import register, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

# The rules, base ones first, in the order in which kinds are listed.  A bound inside a pattern that ends in
# one run of characters is the same as dropping its short matches: no match can start inside a run and pass.
RULES = (
    Rule("assign", rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

TRUE = frozenset([frozenset()])  # one clause that asks for nothing
MOST_STRINGS = 64  # alternatives kept as exact strings before they are turned into trigrams


def _simple(query: frozenset) -> frozenset:
    """Without clauses that ask for more than another one."""
    return frozenset(c for c in query if not any(d < c for d in query))


def _and(a: frozenset, b: frozenset) -> frozenset:
    return _simple(frozenset(x | y for x, y in product(a, b)))


def _needs(strings: set[str]) -> frozenset:
    """Query of 'contains one of the strings'."""
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(nodes) -> tuple[set[str] | None, frozenset]:
    """(all lower-case strings that the nodes match, or None if there are too many; query)."""
    exact, whole, query = {""}, True, TRUE
    for op, arg in nodes:
        name = str(op)
        strings, inner = None, TRUE
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and not any(str(o) not in ("LITERAL",) for o, _ in arg):
            strings = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                inner = _simple(frozenset().union(*(q if s is None else _and(q, _needs(s)) for s, q in each)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, item = arg
            s, q = _walk(item)
            if s is not None and (low, high) == (0, 1):
                strings = s | {""}
            elif s is not None and low == high and low < 8:
                strings = {"".join(x) for x in product(s, repeat=low)}
            elif low:
                inner = q if s is None else _and(q, _needs(s))
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a, b in product(exact, strings)}
        else:
            query = _and(_and(query, _needs(exact)), inner if strings is None else _needs(strings))
            exact, whole = {""}, False
    return (exact, query) if whole else (None, _and(query, _needs(exact)))


def trigram_query(pattern: str) -> frozenset:
    """An OR of ANDs of lower-case trigrams that hold for every text with a match; ``TRUE`` where none is mandatory."""
    strings, query = _walk(regex_parser.parse(pattern))
    return query if strings is None else _and(query, _needs(strings))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(row, t) -> (trigram number, row): the inverted index of these trigrams, without regard to case."""
    low = docs.select("row", F.lower("t").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(x)), F.lit(i)) for i, x in enumerate(trigrams)]))
    return low.select(F.explode(held).alias("trigram"), "row")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, bool]]:
    """Rows with the kinds that may match there, and whether a kind is bound to the index."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q != TRUE for k, q in queries.items()}
    trigrams = sorted({t for k, q in queries.items() if indexed[k] for c in q for t in c})
    number = {t: i for i, t in enumerate(trigrams)}
    if not trigrams:
        return docs.sparkSession.createDataFrame([], "row long, kinds array<string>"), indexed
    held = postings(docs, trigrams).groupBy("row").agg(F.collect_set("trigram").alias("held"))

    def met(query) -> Column:
        out = F.lit(False)
        for clause in sorted(map(sorted, query)):
            out = out | (F.size(F.array_intersect("held", F.array(*[F.lit(number[t]) for t in clause]))) == len(clause))
        return out

    kinds = F.array_compact(F.array(*[F.when(met(q), F.lit(k)) for k, q in queries.items() if indexed[k]]))
    return held.select("row", kinds.alias("kinds")).where(F.size("kinds") > 0), indexed


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, t) -> (row, kind_no, kind, start, end, base)."""
    maybe, indexed = candidates(docs, rules)
    maybe = materialise(maybe, "secret-candidates")
    seen = docs.join(maybe, "row", "left")
    tests, parts = [], []
    for i, r in enumerate(rules):
        here = F.array_contains("kinds", r.kind) if indexed[r.kind] else F.lit(True)
        hit = F.coalesce(here, F.lit(False)) & F.col("t").rlike(r.pattern)
        tests.append(F.when(hit, F.lit(i)))
        get = lambda g: F.regexp_extract_all("t", F.lit(r.pattern), F.lit(g))  # noqa: B023, E731
        lengths = lambda a: F.transform(a, lambda x: F.length(x))
        found = F.arrays_zip(
            lengths(F.split("t", r.pattern, -1)).alias("gap"), lengths(get(0)).alias("len"), lengths(get(r.group)).alias("value")
        )
        parts.append((F.col("rule") == i, found))
    hits = seen.select("row", "t", F.explode(F.array_compact(F.array(*tests))).alias("rule"))
    found = F.lit(None)
    for is_rule, value in parts:
        found = F.when(is_rule, value).otherwise(found)
    each = hits.select("row", "rule", F.posexplode(found).alias("i", "m")).select("row", "rule", "i", "m.gap", "m.len", "m.value")
    before = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(W.partitionBy("row", "rule").orderBy("i"))
    spans = each.withColumn("end", before).where(F.col("len").isNotNull())  # the last gap follows the last match
    info = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("rule") + 1)
    spans = spans.where(F.col("value") >= info(lambda r: r.least))
    return spans.select(
        "row", F.col("rule").alias("kind_no"), info(lambda r: r.kind).alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end", info(lambda r: r.base).alias("base")
    )


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, a count for each kind (n_<kind>), base_sha256, spans."""
    d = numbered(docs, key, {"id": F.col(key).cast("long"), "t": F.coalesce(F.col(text).cast("string"), F.lit(""))})
    s = secret_spans(d.select("row", "t"), rules)
    word = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    one = F.struct("start", "kind_no", "base", word.alias("word"))
    per = s.groupBy("row").agg(
        F.sort_array(F.collect_list(one)).alias("all"), *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules]
    )
    words = lambda a: F.array_join(F.transform(a, lambda x: x["word"]), ",")
    per = per.select(
        "row", words(F.filter("all", lambda x: x["base"])).alias("base_spans"), words(F.col("all")).alias("spans"), *[f"n_{r.kind}" for r in rules]
    )
    out = d.select("row", "id").join(per, "row", "left")
    return out.select(
        "id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _oracle() -> str:
    lit = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {lit(r.pattern)}) AS ms, "
        f"regexp_extract_all(t, {lit(r.pattern)}, {r.group}) AS vs, string_split_regex(t, {lit(r.pattern)}) AS gs FROM d"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
p AS ({parts}),
u AS (SELECT rid, k, kind, least, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM p WHERE len(ms) > 0),
e AS (SELECT *, CAST(sum(length(m) + length(g)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS e FROM u),
s AS (SELECT rid, k, kind, e - length(m) AS a, kind || ':' || (e - length(m)) || ':' || e AS w FROM e WHERE length(v) >= least),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(w, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY a, k) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


@register("op10_secret_scan", _oracle())
def op10_secret_scan(spark, sf_dir):
    s = scan_secrets(table(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
