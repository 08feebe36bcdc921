"""Secret scan with one automaton for all rules (operator 8).

The rules' own patterns are compiled, and the automaton's pass gives their spans; lengths are checked
afterwards, since counters of several rules would multiply the states.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.automaton import Automaton, compiled


@dataclass(frozen=True)
class Rule:
    """A span has ``least`` bytes or more; with ``of_run`` these are counted from where the pattern first holds.

    For a pattern that ends in a run of one class that is the run itself. Matches that are too short use up
    their characters and are dropped.
    """

    kind: str
    pattern: str
    least: int = 1
    ignore_case: bool = False
    of_run: bool = False


# The base kinds by contract. Of the 32 digits of hex 4 stand in the pattern, so that not every
# letter from a to f is a match; shorter runs are dropped either way.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{4}[0-9a-f]*", 32),
)

# Published formats of tokens that the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("pem", r"-----BEGIN ([A-Z]+ )?([A-Z]+ )?([A-Z]+ )?PRIVATE KEY-----"),
)


def machine(rules: tuple[Rule, ...]) -> Automaton:
    return compiled(tuple((r.pattern, r.ignore_case) for r in rules))


def spans(data: bytes, rules: tuple[Rule, ...], automaton: Automaton) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) in code points of the UTF-8 text, ordered; leftmost and non-overlapping per rule."""
    found = [(s, k, e) for s, k, e, first in automaton.scan(data) if e - (first - 1 if rules[k].of_run else s) >= rules[k].least]
    if not found or data.isascii():
        return found
    places, at, points = {}, 0, 0
    for i in sorted({x for s, _, e in found for x in (s, e)}):
        points += len(data[at:i].decode())
        places[i], at = points, i
    return [(places[s], k, places[e]) for s, k, e in found]


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """The secrets in every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, a count n_<kind> for each base rule, base_sha256 (over the base spans as
    ``kind:start:end``, comma-joined in order of start and then rule) and spans (the same of all rules).
    A null text counts as empty: no spans, and the digest of the empty string. Rows come back as often
    as they come in, null doc_ids too; no rows give no rows. Very long texts are read in one pass. The secrets themselves are not returned.
    """
    rules = (*base, *more)
    shared = docs.sparkSession.sparkContext.broadcast(machine(rules))
    names = [f"n_{r.kind}" for r in base]

    def run(batches):
        automaton = shared.value
        for b in batches:
            counts, digests, joined = [[] for _ in base], [], []
            for t in b.column(1).cast(pa.binary()):
                found = spans(t.as_py() or b"", rules, automaton)
                own = [f"{rules[k].kind}:{s}:{e}" for s, k, e in found if k < len(base)]
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                joined.append(",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", *names, "base_sha256", "spans"],
            )

    schema = "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _found_sql(nth: int, kind: str, pattern: str, measured: str) -> str:
    """SQL for a kind's matches with their places: the pieces between the matches and the matches make the text."""
    return f"""SELECT r, {nth} AS k, '{kind}' AS kind, i, ms[i] AS m, {measured} AS long_enough,
    (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(s, '{pattern}') AS ms, string_split_regex(s, '{pattern}') AS ps FROM d))"""


_ANY_CASE = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
#: The same in SQL; the kinds are written out as they are defined.
ORACLE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents), f AS ("
    + " UNION ALL ".join(
        _found_sql(n, *kind)
        for n, kind in enumerate([
            ("assign", _ANY_CASE, f"length(regexp_extract(ms[i], '{_ANY_CASE}', 2)) >= 8"),
            ("access", "AKIA[A-Z0-9]+", "length(ms[i]) >= 16"),
            ("hex", "[0-9a-f]+", "length(ms[i]) >= 32"),
            ("github", "gh[pousr]_[A-Za-z0-9]+", "length(ms[i]) >= 40"),
            ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(ms[i]) >= 15"),
            ("google", "AIza[A-Za-z0-9_-]+", "length(ms[i]) >= 39"),
            ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(ms[i]) >= 36"),
            ("pem", "-----BEGIN ([A-Z]+ )?([A-Z]+ )?([A-Z]+ )?PRIVATE KEY-----", "true"),
        ])
    )
    + """), o AS (SELECT *, kind || ':' || s || ':' || (s + length(m)) AS span FROM f WHERE long_enough),
g AS (
  SELECT r, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c, string_agg(span, ',' ORDER BY s, k) AS spans, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base FROM o GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""
)
